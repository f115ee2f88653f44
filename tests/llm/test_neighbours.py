import numpy as np
import pytest

from quirework.llm import neighbours as N
from quirework.scratch import Scratch


def units(n, dim, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best(x, k, least):
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {(i, j) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= least}


def near_copies(n, dim=32, seed=1):
    base = units(n, dim, seed)
    copies = base[: n // 2] + 0.03 * np.random.default_rng(seed + 1).standard_normal((n // 2, dim))
    return np.concatenate([base, copies])


def test_factor_one_is_exact():
    x = near_copies(600)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    for least in (-1.0, 0.5, 0.95):
        cos, at = N.VPTree(x, leaf=20).search(x, 5, least, 1.0, np.arange(len(x)))
        assert {(i, j) for i in range(len(x)) for j in at[i] if j >= 0} == best(x.astype(np.float32).astype(float), 5, least)
        assert (np.diff(cos, axis=1) <= 0).all()


def frame(spark, x, extra=()):
    rows = [(f"v{i:05d}", [float(t) for t in v], "s") for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vid string, vec array<float>, key string")


def test_shards_find_what_brute_force_finds(spark):
    x = near_copies(900)
    got = N.nearest([("t", frame(spark, x * 3), "vid", "vec")], Scratch(spark, "test"), shard=128)
    found = {(int(r.id[1:]), int(r.other[1:])) for r in got.collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = best(y, 5, 0.95)
    assert len(found & want) >= 0.99 * len(want) and not found - want


def test_unusable_rows_copies_ties_and_spaces(spark):
    e = [1.0, 0.0, 0.0]
    extra = [("null", None, "s"), ("zero", [0.0] * 3, "s"), ("nan", [float("nan")] * 3, "s"), ("hole", [None, 1.0, 0.0], "s"), ("empty", [], "s"), (None, e, "s"), ("short", [1.0, 0.0], "s")]
    copies = [(f"c{i}", [2.0 * t for t in e] if i % 2 else e, "s") for i in range(9)]
    a = frame(spark, [], extra + copies + copies[:2])
    b = frame(spark, [], [("c0", e, "s"), ("other", [0.999, 0.01, 0.0], "s")])
    got = N.nearest([("a", a, "vid", "vec"), ("b", b, "vid", "vec")], Scratch(spark, "test")).collect()
    mine = {}
    for r in got:
        mine.setdefault((r.space, r.id), []).append((r["rank"], r.other))
    assert [o for _, o in sorted(mine["a", "c8"])] == ["c0", "c1", "c2", "c3", "c4"]
    assert [o for _, o in sorted(mine["a", "c1"])] == ["c0", "c2", "c3", "c4", "c5"]
    assert mine["b", "c0"] == [(1, "other")] and set(i for s, i in mine if s == "a") == {f"c{i}" for i in range(9)}
    pairs = N.found_pairs(N.nearest([("b", b, "vid", "vec")], Scratch(spark, "test"))).collect()
    assert [tuple(r) for r in pairs] == [("b", "c0", "other")]


def test_empty_table(spark):
    assert N.nearest([("t", frame(spark, []), "vid", "vec")], Scratch(spark, "test")).count() == 0


def test_queries_against_all_rows(spark):
    x = units(700, 24, 9)
    got = N.nearest_of_queries(("t", frame(spark, x), "vid", "vec"), "substr(id, 6, 1) = '3'", Scratch(spark, "test"), block=100).collect()
    want = best(x.astype(np.float32).astype(float), 5, -1)
    found = {(int(r.id[1:]), int(r.other[1:])) for r in got}
    asked = {i for i in range(700) if f"{i:05d}"[4] == "3"}
    assert {i for i, _ in found} == asked
    assert len(found & want) >= 0.99 * 5 * len(asked)


def test_recall_of_relaxed_search_without_radius():
    """The measured trade: a mild factor keeps nine tenths of the true neighbours on clustered data."""
    x = near_copies(3000, 16, 4)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, at = N.VPTree(x, leaf=64).search(x[:300], 5, -1.0, 1.5, np.arange(300))
    want = best(x.astype(np.float32).astype(float), 5, -1)
    hits = sum((i, j) in want for i in range(300) for j in at[i])
    assert hits >= 0.9 * 1500


@pytest.mark.parametrize("n", [0, 1, 5])
def test_tiny_trees(n):
    cos, at = N.VPTree(units(n, 4)).search(units(2, 4, 3), 5)
    assert cos.shape == (2, 5) and (at >= 0).sum() == 2 * n


def test_trees_follow_from_depth():
    assert N.trees_for(100) == 1 and N.trees_for(10_000) == N.LEAST_TREES
    many = [N.trees_for(2048 * 2**d) for d in range(1, 24)]
    assert many == sorted(many) and many[-1] > 2 * many[4]
    assert all((1 - N.KEEP**d) ** t <= N.MISS for d, t in enumerate(many, 1))


def test_oversized_shards_are_divided_where_they_are_searched(spark, monkeypatch):
    """Without a level of routing all rows meet in one shard, which is divided by the counted size; pairs stay together as often as the depth allows."""
    monkeypatch.setattr(N, "routers", lambda rows, counts, shard, trees: [(s, d, [N.Router(np.empty((0, d), np.float32), 0, 0)]) for s, d in sorted(counts)])
    x = near_copies(1200)
    got = N.nearest([("t", frame(spark, x), "vid", "vec")], Scratch(spark, "test"), shard=150)
    found = {(int(r.id[1:]), int(r.other[1:])) for r in got.collect()}
    want = best(x / np.linalg.norm(x, axis=1, keepdims=True), 5, 0.95)
    assert len(found & want) >= 0.6 * len(want) and not found - want


def test_ties_longer_than_the_list_are_whole(spark):
    """Forty directions at one and the same cosine from a row: the smallest ids among them count."""
    dim = 41
    rows = [[1.0] + [0.0] * 40] + [[1.0] + [0.2 if i == j else 0.0 for j in range(40)] for i in range(40)]
    ids = ["a"] + [f"b{i:02d}" for i in range(40)]
    df = spark.createDataFrame([(i, v, "s") for i, v in zip(ids, rows, strict=True)], "vid string, vec array<float>, key string")
    got = N.nearest([("t", df, "vid", "vec")], Scratch(spark, "test"), least=0.97)
    assert len(rows[0]) == dim and [r.other for r in sorted(got.where("id = 'a'").collect(), key=lambda r: r["rank"])] == [f"b{i:02d}" for i in range(5)]
