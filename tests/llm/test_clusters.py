import numpy as np
from pyspark.sql import functions as F

from quirework.llm import clusters as C
from quirework.llm import queries as Q
from quirework.scratch import Scratch


def blobs(groups, size, noise=0.3, dim=48, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, dim))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = np.repeat(centre, size, axis=0) + noise / np.sqrt(dim) * rng.standard_normal((groups * size, dim))
    return np.concatenate([x, rng.standard_normal((150, dim))])


def brute(x, ids, least=0.8):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    top = list(range(len(x)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in zip(*np.where(np.triu(s >= least, 1)), strict=True):
        a, b = sorted((find(i), find(j)))
        top[b] = a
    groups = {}
    for i in range(len(x)):
        groups.setdefault(find(i), []).append(ids[i])
    return {(min(g), i) for g in groups.values() if len(g) >= 8 for i in g}


def frame(spark, x, extra=()):
    return spark.createDataFrame([(f"{i:05d}", [float(t) for t in v], 0) for i, v in enumerate(x)] + list(extra), "arxiv_id string, area_embedding array<float>, comp int")


def test_clusters_equal_brute_force(spark):
    x = blobs(12, 20)
    df = frame(spark, x, [("n1", None, 1), ("z", [0.0] * 48, 1), (None, [1.0] * 48, 1), ("00001", [float(t) for t in x[1]], 1)])
    ids, comps, links = C.linked(df, Scratch(spark, "test"))
    got = {(r.cluster_key, r.id) for r in C.clusters_of(ids, comps).collect()}
    assert got == brute(x, [f"{i:05d}" for i in range(len(x))])
    assert links.where("cosine < 0.8").count() == 0


def test_copies_form_a_cluster_without_links(spark):
    df = frame(spark, [[1.0, 0, 0, 0]] * 9 + [[0, 1.0, 0, 0]] * 7)
    ids, comps, links = C.linked(df, Scratch(spark, "test"))
    assert {(r.cluster_key, r.id) for r in C.clusters_of(ids, comps).collect()} == {("00000", f"{i:05d}") for i in range(9)}
    assert links.count() == 0


def test_hot_cluster_and_empty_table(spark):
    x = blobs(1, 120, noise=0.15)
    ids, comps, _ = C.linked(frame(spark, x), Scratch(spark, "test"), direct=16)
    assert {(r.cluster_key, r.id) for r in C.clusters_of(ids, comps).collect()} == brute(x, [f"{i:05d}" for i in range(len(x))])
    ids, comps, _ = C.linked(frame(spark, []), Scratch(spark, "test"))
    assert C.clusters_of(ids, comps).count() == 0


def test_loose_component_is_divided_around_medoids(spark):
    """Two cliques of ten joined by one link: mean degree is far below a clique's."""
    pairs = [(a, b) for lo in (0, 10) for a in range(lo, lo + 10) for b in range(a + 1, lo + 10)] + [(9, 10)]
    links = spark.createDataFrame(pairs, "a long, b long")
    ids = spark.createDataFrame([(f"p{k:02d}", k) for k in range(20)], "id string, key long")
    comps = spark.createDataFrame([(k, 0) for k in range(20)], "key long, comp long")
    scratch = Scratch(spark, "test")
    out = C.split_loose(ids, comps, links, scratch)
    sizes = sorted(r["count"] for r in out.groupBy("cluster").count().collect())
    assert sizes == [9, 11] and out.count() == 20
    known = spark.createDataFrame([("p01", 5), ("p02", 5), ("p03", 0), ("p01", 0), ("p02", 0), (None, 1)], "id string, cluster_id int")
    rows = {r.cluster_key: r for r in C.described(out, links, known).collect()}
    assert rows["p00"].size == 11 and rows["p00"].earlier_cluster_id == 5 and len(rows["p00"].typical_ids) == 3


def test_tight_cluster_beyond_a_hot_bucket_stays_whole(spark, tmp_path):
    """900 papers of one direction and a little noise: one cluster, its typical papers those of highest degree."""
    x = blobs(1, 900, noise=0.03)
    frame(spark, x).write.parquet(str(tmp_path / "papers.parquet"))
    spark.createDataFrame([("00001", 5)], "arxiv_id string, cluster_id int").write.parquet(str(tmp_path / "clusters.parquet"))
    got = Q.p4_clusters(spark, str(tmp_path)).collect()
    assert [(r.cluster_key, r["size"], r.typical_ids) for r in got] == [("00000", 900, ["00000", "00001", "00002"])]


def test_parts_are_the_same_in_one_task_and_in_rounds(spark):
    """A loose component: an arc of points, each near its neighbours only, with a clique; all rows of it come out, with exact degrees."""
    turn = np.arange(60) * 0.2
    arc = np.stack([np.cos(turn / 2), np.sin(turn / 2), np.zeros(60)], 1)
    x = np.concatenate([arc, arc[:1] + 0.01 * np.random.default_rng(1).standard_normal((30, 3))])
    df = frame(spark, x)
    keys = C.directions(df)
    ids = spark.createDataFrame(C._space_rows(df, "arxiv_id", "area_embedding", "").mapInArrow(C._whole, C.ROWS).select("id", "key").collect(), "id string, key long")
    comps = ids.select("key", F.lit(1).cast("long").alias("comp"))
    whole, blocks = (sorted(map(tuple, C.parted(ids, comps, keys, Scratch(spark, "test"), block=n).collect())) for n in (2048, 12))
    assert whole == blocks and len(whole) == len(x)
    groups = {}
    for id_, _, cluster, _ in whole:
        groups.setdefault(cluster, []).append(int(id_))
    assert len(groups) > 1 and all(len(g) >= 8 for g in groups.values())
    y = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    for id_, _, cluster, degree in whole:
        assert degree == (y[groups[cluster]] @ y[int(id_)] >= 0.8).sum() - 1


def test_banding_keeps_its_chance_at_every_size():
    shapes = [C.banding(n) for n in (10, 10**6, 10**7, 10**9)]
    assert [r for r, _ in shapes] == [2, 2, 3, 4] and all((1 - C.JACCARD_AT_LEAST**r) ** b <= C.MISS for r, b in shapes)


def test_tokens_and_jaccard_of_vectors_of_few_axes():
    """Fewer axes than tokens of a rotation give repeated tokens, which count once."""
    x = np.array([[1.0, 0.0], [1.0, 0.0], [-1.0, 0.0]], np.float32)
    tokens, bits = C._Tokeniser()(x)
    assert C.jaccard(tokens[:1], tokens[1:2])[0] == 1 and C.jaccard(tokens[:1], tokens[2:])[0] == 0 and (bits[0] == bits[1]).all()


def test_half_precision_decides_no_pair_near_the_threshold():
    """Cosines of half precision differ by less than the margin in which the vectors themselves decide."""
    rng = np.random.default_rng(5)
    for dim in (2, 64, 700):
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.standard_normal((500, dim)), rng.standard_normal((500, dim))))
        half = np.einsum("ij,ij->i", x.astype(np.float16).astype(np.float32), y.astype(np.float16).astype(np.float32))
        assert np.abs(half - np.einsum("ij,ij->i", x, y)).max() < C.ROUGH
