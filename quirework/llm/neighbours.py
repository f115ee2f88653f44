"""Problem 3: the most similar vectors of every vector, by vantage-point trees.

Vectors are scaled to length one, so cosine and Euclidean distance order alike
and the triangle inequality holds. Rows are dealt to shards by several
vantage-point partitions, whose vantage points and radii are fitted on a bounded
sample while every row is indexed; each shard builds its own vantage-point tree.
A subtree is skipped when the query's distance to its boundary exceeds the
search radius divided by ``factor``: 1 is exact, more is faster. A pair that one
partition separates is found by another; how many there are follows from their depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import vectors
from quirework.scratch import Scratch

#: Rows of one shard, on average.
SHARD = 2048
#: At a cosine of 0.95 or more a pair stays together at one level of a partition with about KEEP, measured; so many partitions are made that a pair is
#: separated by all of them with at most MISS, and no fewer than LEAST_TREES.
KEEP, MISS, LEAST_TREES = 0.93, 0.0015, 6
#: Levels of a partition before rows are moved; the sample has SAMPLE_PER_LEAF rows for each of its leaves, so it is bounded. A shard that still has more
#: than TWICE * SHARD rows is divided further where it is searched.
MAX_DEPTH = 13
TWICE = 2
SAMPLE_PER_LEAF = 32
FACTOR = 1.0
#: Shards that one task searches on average, so that what a task reads stays the same at any size.
SHARDS_PER_TASK = 4
LEAF = 256


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


class VPTree:
    """A vantage-point tree over unit vectors, searched for many queries at once."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.x, self.leaf = np.ascontiguousarray(x, np.float32), leaf
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []
        self._rng = np.random.default_rng(seed)
        self.root = self._build(0, len(x)) if len(x) else -1

    def _build(self, lo: int, hi: int) -> int:
        at = len(self.nodes)
        self.nodes.append((lo, hi))
        if hi - lo > self.leaf:
            own = self.order[lo:hi]
            vantage = self.x[self._rng.choice(own, min(8, hi - lo), replace=False)]
            far = _distance(self.x[own] @ vantage.T)
            best = int(far.std(axis=0).argmax())
            far = far[:, best]
            half = (hi - lo) // 2
            part = np.argpartition(far, half)
            self.order[lo:hi] = own[part]
            inner, outer = float(far[part[:half]].max()), float(far[part[half:]].min())
            mid = lo + half
            self.nodes[at] = (lo, hi, vantage[best], inner, outer, self._build(lo, mid), self._build(mid, hi))
        return at

    def search(self, queries: np.ndarray, k: int, least: float = -1.0, factor: float = 1.0, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, positions) of each query's k best rows with at least that cosine, best first; -2 and -1 where there are fewer.

        own: for each query the position of its own row, which it never finds, or -1.
        """
        n = len(queries)
        self.q = np.ascontiguousarray(queries, np.float32)
        self.cos, self.at = np.full((n, k), -2.0, np.float32), np.full((n, k), -1, np.int64)
        self.own, self.least, self.factor, self.k = own, np.float32(least), factor, k
        if self.root >= 0 and n:
            self._visit(self.root, np.arange(n))
        order = np.argsort(-self.cos, axis=1, kind="stable")
        return np.take_along_axis(self.cos, order, 1), np.take_along_axis(self.at, order, 1)

    def _radius(self, qi: np.ndarray) -> np.ndarray:
        return _distance(np.maximum(self.cos[qi].min(axis=1), self.least)) / self.factor

    def _visit(self, node: int, qi: np.ndarray) -> None:
        if not len(qi):
            return
        lo, hi, *rest = self.nodes[node]
        if not rest:
            rows = self.order[lo:hi]
            cos = self.q[qi] @ self.x[rows].T
            if self.own is not None:
                cos[self.own[qi][:, None] == rows[None, :]] = -2
            floor = np.maximum(self.cos[qi].min(axis=1), self.least - np.float32(1e-6))
            some = (cos >= floor[:, None]).any(axis=1)
            if not some.any():
                return
            qi, cos = qi[some], cos[some]
            cos[cos < self.least - np.float32(1e-6)] = -2
            both = np.concatenate([self.cos[qi], cos], axis=1)
            where = np.concatenate([self.at[qi], np.broadcast_to(rows, cos.shape)], axis=1)
            top = np.argpartition(-both, self.k - 1, axis=1)[:, : self.k] if both.shape[1] > self.k else np.argsort(-both, axis=1)
            self.cos[qi] = np.take_along_axis(both, top, 1)
            self.at[qi] = np.where(self.cos[qi] > -2, np.take_along_axis(where, top, 1), -1)
            return
        vantage, inner, outer, left, right = rest
        far = _distance(self.q[qi] @ vantage)
        first = far <= (inner + outer) / 2
        self._visit(left, qi[first])
        self._visit(right, qi[~first])
        radius = self._radius(qi)
        self._visit(right, qi[first & (far + radius >= outer)])
        self._visit(left, qi[~first & (far - radius <= inner)])


class Router:
    """A partition into 2**depth shards by vantage points of a sample; the same sample gives the same shards."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.vantage = np.zeros((2**depth, sample.shape[1] if sample.ndim == 2 else 0), np.float32)
        self.half = np.zeros(2**depth, np.float32)
        members = {1: np.arange(len(sample))}
        for node in range(1, 2**depth):
            own = members.pop(node)
            if len(own) < 2:
                members[2 * node], members[2 * node + 1] = own, own[:0]
                self.half[node] = -2
                continue
            tried = sample[rng.choice(own, min(8, len(own)), replace=False)]
            cos = sample[own] @ tried.T
            best = int(cos.std(axis=0).argmax())
            half = np.median(cos[:, best])
            self.vantage[node], self.half[node] = tried[best], half
            inside = cos[:, best] >= half
            members[2 * node], members[2 * node + 1] = own[inside], own[~inside]

    def shard(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            cos = np.einsum("ij,ij->i", x, self.vantage[node])
            node = 2 * node + (cos < self.half[node])
        return node - 2**self.depth


ROWS = "id string, space string, key long, v binary"


def _pack(x: np.ndarray) -> tuple[list[int], list[bytes]]:
    single = x.astype(np.float32)
    same = (np.round(x, 6) + 0.0).astype(np.float32)
    return [xxhash.xxh64_intdigest(r.tobytes()) for r in same], [r.tobytes() for r in single]


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[int], list[bytes]]]:
    """(rows, unit vectors, keys, packed vectors) of a batch of (id, space, vector), one length at a time."""
    sizes = np.asarray(batch.column(2).value_lengths().fill_null(0))
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at, x = vectors(batch.column(2), dim)
        if len(at):
            keys, packed = _pack(x)
            yield batch.take(pa.array(at)), x, keys, packed


def _signed(keys: list[int]) -> np.ndarray:
    return np.array(keys, np.uint64).view(np.int64)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x, keys, _ in _usable(batch):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(_signed(keys)), pa.array(np.full(len(x), x.shape[1], np.int32))], names=["id", "space", "key", "dim"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, _, keys, packed in _usable(batch):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(_signed(keys)), pa.array(packed, pa.binary())], names=["id", "space", "key", "v"])


def _route(routers: list[tuple[str, int, list[Router]]]):
    """Each direction once per partition and tree, with its shard: the place of its table and length in ``routers``, its shard and its tree in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {(space, dim): (i, trees) for i, (space, dim, trees) in enumerate(routers)}
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for rows, x, keys, packed in _usable(batch):
                space = rows.column(1).to_pylist()
                fresh = []
                for i, at in enumerate(zip(space, keys, strict=True)):
                    if at not in seen:
                        seen.add(at)
                        fresh.append(i)
                if len(seen) > 1_000_000:
                    seen.clear()
                fresh = np.array(fresh, np.int64)
                names = np.array(space, object)[fresh]
                for name in set(names.tolist()):
                    own = fresh[names == name]
                    key, v = _signed(keys)[own], pa.array([packed[i] for i in own], pa.binary())
                    place, trees = of[name, x.shape[1]]
                    for tree, router in enumerate(trees):
                        shard = (place << 40) + (router.shard(x[own].astype(np.float32)) << 8) + tree
                        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(key), v], names=["shard", "key", "v"])

    return run


FOUND = "space string, a long, b long, cosine double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def _result(space: str, a: np.ndarray, b: np.ndarray, cos: np.ndarray) -> pa.Table:
    return pa.table({"space": pa.array([space] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(cos, pa.float64())})


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x.astype(np.float64), y.astype(np.float64))


def _every(x: np.ndarray, queries: np.ndarray, own: np.ndarray, cos: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of what a search found, with all rows that tie with the last of the k best where the list ends within the tie."""
    q, j = np.nonzero(at >= 0)
    hit = at[q, j]
    last = cos[:, k - 1] - np.float32(1e-6)
    more = np.flatnonzero((at[:, -1] >= 0) & (cos[:, -1] >= last))
    for lo in range(0, len(more), 256):
        part = more[lo : lo + 256]
        i, row = np.nonzero(queries[part] @ x.T >= last[part][:, None])
        keep = row != own[part][i]
        q, hit = np.r_[q, part[i[keep]]], np.r_[hit, row[keep]]
    if len(more):
        q, hit = np.unique(np.stack([q, hit]), axis=1)
    return q, hit


def _search_part(keys: np.ndarray, x: np.ndarray, k: int, least: float, factor: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    tree, out = VPTree(x), []
    for lo in range(0, len(x), 4096):
        own = np.arange(lo, min(lo + 4096, len(x)))
        cos, at = tree.search(x[own], k + 3, least, factor, own)
        q, hit = _every(x, x[own], own, cos, at, k)
        exact = _exact(x[own[q]], x[hit])
        keep = exact >= least
        out.append((keys[own[q]][keep], keys[hit][keep], exact[keep]))
    return out


def _search_shard(spaces: list[str], k: int, least: float, factor: float, shard: int):
    def run(rows: pa.Table) -> pa.Table:
        number = rows.column("shard")[0].as_py()
        keys, first = np.unique(rows.column("key").to_numpy(), return_index=True)
        x = _matrix(rows.column("v"))[first]
        parts = [np.arange(len(x))]
        if len(x) > TWICE * shard:
            levels = int(np.ceil(np.log2(len(x) / shard)))
            sample = x[np.random.default_rng(number % 1009).permutation(len(x))[: SAMPLE_PER_LEAF * 2**levels]]
            of = Router(sample, levels, number % 1013).shard(x)
            order = np.argsort(of, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for own in parts:
            out += _search_part(keys[own], x[own], k, least, factor)
        return _result(spaces[number >> 40], *(np.concatenate(p) for p in zip(*out, strict=True)))

    return run


def _space_rows(df: DataFrame, id_col: str, vector_col: str, space: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("id"), F.lit(space).alias("space"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and v is not null")


def trees_for(n: int, shard: int = SHARD, miss: float = MISS) -> int:
    """Partitions of n rows such that a pair that one keeps with KEEP a level is kept by none with at most ``miss``."""
    kept = KEEP ** max(0.0, np.ceil(np.log2(max(1, n / shard))))
    return 1 if kept == 1 else max(LEAST_TREES, int(np.ceil(np.log(miss) / np.log(1 - kept))))


def routers(rows: DataFrame, counts: dict[tuple[str, int], int], shard: int, trees: int | None = None, max_depth: int = MAX_DEPTH) -> list[tuple[str, int, list[Router]]]:
    """(table, length, partitions) fitted on the rows of least hash: at most SAMPLE_PER_LEAF * 2**max_depth of them, the same whatever the partitioning."""
    out = []
    for (space, dim), n in sorted(counts.items()):
        levels = int(np.clip(np.ceil(np.log2(max(1, n / shard))), 0, max_depth))
        if levels == 0:
            out.append((space, dim, [Router(np.empty((0, dim), np.float32), 0, 0)]))
            continue
        own = rows.where((F.col("space") == space) & (F.octet_length("v") == 4 * dim))
        got = own.select("v", F.xxhash64("id").alias("o"), "id").orderBy("o", "id").limit(SAMPLE_PER_LEAF * 2**levels).select("v").toArrow()
        sample = _matrix(got.column("v"))
        out.append((space, dim, [Router(sample, levels, seed + 1) for seed in range(trees or trees_for(n, shard))]))
    return out


def nearest(
    tables: list[tuple[str, DataFrame, str, str]],
    scratch: Scratch,
    k: int = 5,
    least: float = 0.95,
    factor: float = FACTOR,
    shard: int = SHARD,
    trees: int | None = None,
) -> DataFrame:
    """(space, id, other, cosine, rank): the up to k rows of the same table most similar to each row, with a cosine of at least ``least``.

    tables: (name, DataFrame, id column, vector column). Rows whose vector is
    null, empty, all zero, or has a null or infinite entry take no part, nor do
    null ids; a repeated id counts once. Vectors compare only with vectors of
    their own length. Vectors that agree to six decimals after scaling are copies:
    they are searched once and tie at the first ranks of one another. Ties go to
    the smaller id. Other columns are not read; empty tables give no rows.
    """
    rows = None
    for name, df, id_col, vector_col in tables:
        own = _space_rows(df, id_col, vector_col, name)
        rows = own if rows is None else rows.unionByName(own)
    ids = scratch.table(rows.mapInArrow(_ids, "id string, space string, key long, dim int").groupBy("space", "id").agg(F.min("key").alias("key"), F.min("dim").alias("dim")), "ids")
    counts = {(r.space, r.dim): r.n for r in ids.groupBy("space", "dim").agg(F.count("*").alias("n")).collect()}  # one row a table and vector length
    fitted = routers(rows.mapInArrow(_whole, ROWS), counts, shard, trees)
    routed = rows.mapInArrow(_route(fitted), "shard long, key long, v binary")
    shards = sum(2 ** t[0].depth * len(t) for _, _, t in fitted)
    routed = routed.repartition(int(np.clip(-(-shards // SHARDS_PER_TASK), 1, 100_000)), "shard")
    found = routed.groupBy("shard").applyInArrow(_search_shard([space for space, _, _ in fitted], k, least, factor, shard), FOUND)
    found = found.groupBy("space", "a", "b").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("space", "a").orderBy(F.desc("cosine"))
    found = scratch.table(found.withColumn("r", F.rank().over(best)).where(F.col("r") <= k).drop("r"), "found")
    return _expand(ids, found, k)


def _expand(ids: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """From directions to rows: of each direction only its k + 1 smallest ids can be among anyone's k best."""
    low = Window.partitionBy("space", "key").orderBy("id")
    few = ids.withColumn("r", F.row_number().over(low)).where(F.col("r") <= k + 1)
    twice = few.where("r = 2").select("space", F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("cosine"))
    links = found.unionByName(twice)
    pairs = (
        ids.select("space", F.col("key").alias("a"), "id")
        .join(links, ["space", "a"])
        .join(few.select("space", F.col("key").alias("b"), F.col("id").alias("other")), ["space", "b"])
        .where("id <> other")
    )
    rank = Window.partitionBy("space", "id").orderBy(F.desc("cosine"), "other")
    return pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("space", "id", "other", "cosine", "rank")


def _search_block(k: int, factor: float):
    """Of one block of rows and one of queries: each query's k best rows of the block."""

    def run(rows: pa.Table) -> pa.Table:
        space = rows.column("space")[0].as_py()
        is_query = rows.column("query").to_numpy()
        x, keys = _matrix(rows.column("v")), rows.column("key").to_numpy()
        data, q = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        own_keys, first = np.unique(keys[data], return_index=True)
        data = data[first]
        q_keys, first = np.unique(keys[q], return_index=True)
        q = q[first]
        if not len(data) or not len(q):
            return _result(space, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        position = np.searchsorted(own_keys, q_keys)
        position = np.where((position < len(own_keys)) & (own_keys[np.minimum(position, len(own_keys) - 1)] == q_keys), position, -1)
        cos, at = VPTree(x[data], leaf=2048).search(x[q], k + 3, -1.0, factor, position)
        i, hit = _every(x[data], x[q], position, cos, at, k)
        return _result(space, q_keys[i], own_keys[hit], _exact(x[q[i]], x[data[hit]]))

    return run


def nearest_of_queries(table: tuple[str, DataFrame, str, str], is_query, scratch: Scratch, k: int = 5, factor: float = 1.0, block: int = 16384) -> DataFrame:
    """(space, id, other, cosine, rank): the k most similar rows of each query row among all rows, whatever their cosine.

    is_query: a condition on the column ``id``. Every row is indexed: blocks of
    rows meet blocks of queries, each block pair in one task with its own tree.
    Cases as for ``nearest``.
    """
    name, df, id_col, vector_col = table
    rows = _space_rows(df, id_col, vector_col, name).mapInArrow(_whole, ROWS)
    rows = scratch.table(rows, "rows")
    ids = rows.select("space", "id", "key").dropDuplicates(["space", "id"])
    n = max(1, -(-rows.count() // block))
    at = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    queries = rows.where(is_query)
    m = max(1, -(-queries.count() // block))
    data = rows.select("space", "key", "v", F.lit(False).alias("query"), at.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("y"))
    asked = queries.select("space", "key", "v", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("x"), F.pmod(F.xxhash64("key"), F.lit(m)).cast("int").alias("y"))
    both = data.unionByName(asked).withColumn("dim", F.octet_length("v"))
    found = both.groupBy("space", "dim", "x", "y").applyInArrow(_search_block(k, factor), FOUND)
    best = Window.partitionBy("space", "a").orderBy(F.desc("cosine"))
    found = scratch.table(found.withColumn("r", F.rank().over(best)).where(F.col("r") <= k).drop("r"), "found")
    every = _expand(ids, found, k)
    return every.where(is_query)


def found_pairs(neighbours: DataFrame) -> DataFrame:
    """(table_name, id_a, id_b): each pair of which one is among the best of the other, once, the smaller id first."""
    return neighbours.select(F.col("space").alias("table_name"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
