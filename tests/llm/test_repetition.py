import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import repetition as R
from quirework.llm.common import WordHashes, words


def brute(text):
    w = words(text or "")
    seen, hit = set(), [False] * len(w)
    for i in range(len(w) - 7):
        run = tuple(w[i : i + 8])
        if run in seen:
            hit[i : i + 8] = [True] * 8
        seen.add(run)
    return sum(hit) / len(w) if w else 0.0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from("abc"), max_size=60).map(" ".join)), max_size=6))
def test_repeated_share_equals_brute_force(texts):
    n, share, x = R.statistics(texts, WordHashes())
    assert np.allclose(share, [brute(t) for t in texts])
    assert (x[:, 0] >= share).all() and (x[:, R.FEATURES.index("distinct_share")] <= 1 - share + 1e-12).all()
    assert n.tolist() == [len(words(t or "")) for t in texts]


def test_trees_are_monotone_and_fit():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = x[:, 0] ** 2 + 0.1 * rng.random(800)
    trees = R.fit(x, y, [1, 0, -1])
    assert np.abs(trees.score(x) - y).mean() < 0.08
    line = np.linspace(0, 1, 50)
    for other in rng.random((20, 2)):
        up = trees.score(np.stack([line, np.full(50, other[0]), np.full(50, other[1])], 1))
        down = trees.score(np.stack([np.full(50, other[0]), np.full(50, other[1]), line], 1))
        assert (np.diff(up) >= -1e-12).all() and (np.diff(down) <= 1e-12).all()
    assert R.fit(np.empty((0, 2)), np.empty(0), [0, 0]).roots.size == 0
    flat = R.fit(np.ones((50, 2)), np.full(50, 0.3), [1, 0])
    assert np.allclose(flat.score(np.ones((3, 2))), 0.3)


def test_cases_of_a_table(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for i in range(300):
        own = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(0, 120))]
        if i % 3 == 0 and len(own) > 20:
            own += own[: rng.randint(5, len(own))]
        rows.append((i, " ".join(own), 1.0))
    rows += [(1000, None, 1.0), (1001, "", 1.0), (1002, "same " * 7, 1.0), (1003, "same " * 400, 1.0), (1004, "long text " * 50_000, 1.0), (1003, "same " * 400, 1.0)]
    for i, text, _ in rows:
        if brute(text) >= 0.25:
            want.add(i)
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = [r.doc_id for r in R.repetitive(df).collect()]
    assert set(got) == want and len(got) == len(want)
    assert R.repetitive(df.limit(0)).count() == 0
    measures = {r.doc_id: r for r in R.repetition(df).collect()}
    assert measures[1000].words == 0 and measures[1000].repeated_share == 0 and measures[1002].repeated_share == 0


def test_gate_is_a_lower_bound_of_every_case():
    """Whatever the trees learned, a text within a case's bounds scores no less than the gate; trees of one value let all through."""
    rng = np.random.default_rng(3)
    for seed in range(5):
        x = rng.random((400, len(R.FEATURES)))
        y = np.clip(x[:, 0] - 0.3 * rng.random(400), 0, 1) * (rng.random(400) < 0.3)
        trees = R.fit(x, y, R.MONOTONE)
        other = rng.random((3000, len(R.FEATURES)))
        within = (other[:, 0] >= 0.25) & (other[:, R.FEATURES.index("distinct_share")] <= 0.75)
        assert (trees.score(other[within]) >= R.gate(trees, 0.25)).all(), seed
    flat = R.fit(np.zeros((50, len(R.FEATURES))), np.zeros(50), R.MONOTONE)
    assert (flat.score(other) >= R.gate(flat, 0.25)).all()


def test_gate_spares_most_texts_the_exact_share():
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(80)) for _ in range(900)]
    texts += [" ".join([f"r{i}x{j}" for j in range(40)] * 2) for i in range(100)]
    n, share, x = R.statistics(texts, WordHashes())
    trees = R.fit(x, share, R.MONOTONE)
    passed = trees.score(x) >= R.gate(trees, 0.25)
    assert passed[900:].all() and passed[:900].mean() < 0.2


@pytest.mark.parametrize("cases", [0, 1, 4])
def test_rare_cases_missed_by_the_sample_come_out(spark, cases):
    """A few repetitive texts of 40,000, trees fitted on about 400."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randint(0, 90_000)}" for _ in range(24))) for i in range(40_000)]
    rows += [(50_000 + i, " ".join([f"r{i}x{j}" for j in range(40)] * 2)) for i in range(cases)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in R.repetitive(df, sample=400).collect()} == {50_000 + i for i in range(cases)}
