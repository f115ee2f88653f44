"""Problem 4: clusters of similar vectors by MinHash, exact checks and connected components.

A vector becomes a set of tokens: for each of many random rotations, the axes
and signs of the rotated vector's few largest coordinates. Similar vectors share
tokens, so bands of MinHash values of the sets give candidate pairs. Candidates
must reach an exact Jaccard similarity of their sets and then the exact cosine;
connected components of the links are the clusters. Inside a component, degrees
are exact: every pair's cosine is counted in pairs of blocks, and none is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import mix
from quirework.llm.linking import DIRECT, link_components
from quirework.llm.neighbours import ROWS, _exact, _matrix, _signed, _space_rows, _usable, _whole
from quirework.scratch import Scratch

#: Rotations, and tokens that each adds to a vector's set.
ROTATIONS = 32
LARGEST = 4
#: Exact Jaccard similarity of a pair at a cosine of 0.8, on average, and the chance that it shares no band.
JACCARD_AT_LEAST = 0.277
MISS = 0.005
#: MinHash values of a band up to so many rows; a further value makes buckets of unrelated rows some 25 times smaller, at four times the bands.
BAND_ROWS = [(2, 4_000_000), (3, 100_000_000), (4, None)]
#: Least exact Jaccard similarity of two token sets. At a cosine of 0.8 it is 0.28 on average with a deviation of 0.03; at 0.5, 0.10.
LEAST_JACCARD = 0.13
#: Sign bits, of twice 64 planes at right angles, in which two vectors may differ: at a cosine of 0.8 about 26 on average, with a deviation of 4, at 0.5 about 43.
MAX_HAMMING = 40
#: Pairs are compared by vectors of half precision; nearer to the threshold than this, by the vectors themselves.
ROUGH = 2e-3
#: Directions of one block where degrees are counted; a part of no more is divided in one task.
BLOCK = 2048
SEED = 7


def _at_right_angles(rng: np.random.Generator, dim: int, n: int) -> np.ndarray:
    """n unit vectors, each ``dim`` of them at right angles."""
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-n // dim))]
    return np.concatenate(turns)[:n].astype(np.float32)


class _Tokeniser:
    """Every worker makes the same rotations: ROTATIONS * dim * dim floats."""

    def __init__(self) -> None:
        self._of: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, sign bits) of each vector: (n, ROTATIONS, LARGEST) tokens 2 * axis + sign, and twice 64 bits. Fewer axes than LARGEST give repeated tokens."""
        dim = x.shape[1]
        if dim not in self._of:
            rng = np.random.default_rng([SEED, dim])
            self._of[dim] = _at_right_angles(rng, dim, ROTATIONS * dim), _at_right_angles(rng, dim, 128)
        rotations, planes = self._of[dim]
        most = min(LARGEST, dim)
        tokens = np.empty((len(x), ROTATIONS, LARGEST), np.uint8 if 2 * dim <= 256 else np.int32)
        for lo in range(0, len(x), 256):
            turned = (x[lo : lo + 256] @ rotations.T).reshape(-1, ROTATIONS, dim)
            axis = np.argpartition(-np.abs(turned), most - 1, axis=2)[:, :, :most] if most < dim else np.broadcast_to(np.arange(dim), turned.shape)
            own = 2 * axis + (np.take_along_axis(turned, axis, 2) < 0)
            tokens[lo : lo + 256, :, :most] = own
            tokens[lo : lo + 256, :, most:] = own[:, :, :1]
        bits = ((x @ planes.T > 0).reshape(len(x), 2, 64).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
        return tokens, bits.view(np.int64)


def _min_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """(len(tokens), n): for each hash function the least hash over the set's tokens; a token is known with its rotation."""
    named = mix((tokens.astype(np.uint64) + (np.arange(tokens.shape[1], dtype=np.uint64) << np.uint64(32))[None, :, None]).reshape(len(tokens), -1) + np.uint64(1))
    named = (named >> np.uint64(32)).astype(np.uint32)
    odd = (mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(SEED << 20)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(tokens), n), np.uint32)
    for i in range(n):
        out[:, i] = (named * odd[i]).min(axis=1)
    return out


def jaccard(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of the token sets of each pair, both (n, ROTATIONS, LARGEST)."""
    once = [np.stack([~(t[:, :, :k] == t[:, :, k : k + 1]).any(axis=2) for k in range(LARGEST)], axis=2) for t in (x, y)]  # the first of repeated tokens
    both = sum(((x[:, :, k : k + 1] == y).any(axis=2) & once[0][:, :, k]).sum(axis=1) for k in range(LARGEST))
    return both / (once[0].sum(axis=(1, 2)) + once[1].sum(axis=(1, 2)) - both)


SETS = "id string, key long, bits long, more long, dim int, tokens binary, half binary, v binary"


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SETS: each usable vector with its tokens, its sign bits, and itself in half and single precision."""
    of = _Tokeniser()
    for batch in batches:
        for rows, x, keys, packed in _usable(batch):
            single = x.astype(np.float32)
            tokens, bits = of(single)
            data = [rows.column(0), pa.array(_signed(keys)), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(np.full(len(x), x.shape[1], np.int32))]
            data += [pa.array([t.tobytes() for t in tokens], pa.binary()), pa.array([h.tobytes() for h in x.astype(np.float16)], pa.binary()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(data, names=[f.split()[0] for f in SETS.split(", ")])


def _sets(column: pa.Array, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8 if 2 * dim <= 256 else np.int32).reshape(len(rows), ROTATIONS, LARGEST)


def _of_one_length(batch: pa.RecordBatch, dims: str) -> Iterator[tuple[pa.RecordBatch, int]]:
    dim = np.asarray(batch.column(dims))
    for one in np.unique(dim).tolist():
        yield (batch if (dim == one).all() else batch.filter(pa.array(dim == one))), one


def banding(n: int) -> tuple[int, int]:
    """(MinHash values of a band, bands) for n rows: a pair at a cosine of 0.8 shares a band with 1 - MISS at every size."""
    rows = next(r for r, most in BAND_ROWS if most is None or n <= most)
    return rows, int(np.ceil(np.log(MISS) / np.log(1 - JACCARD_AT_LEAST**rows)))


def _sketch(rows_per_band: int, bands: int) -> Callable:
    """Band rows of each direction, once per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for rows, dim in _of_one_length(batch, "dim"):
                keys, first = np.unique(rows.column("key").to_numpy(), return_index=True)
                fresh = np.array([k not in seen for k in keys.tolist()], bool)
                seen.update(keys.tolist())
                if len(seen) > 1_000_000:
                    seen.clear()
                rows = rows.take(pa.array(first[fresh]))
                if not rows.num_rows:
                    continue
                values = _min_hashes(_sets(rows.column("tokens"), dim), bands * rows_per_band).reshape(rows.num_rows, bands, rows_per_band)
                h = mix(np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(dim << 16))
                for r in range(rows_per_band):
                    h = mix(h ^ values[:, :, r])
                more = [pa.array(np.tile(rows.column(c).to_numpy(), bands)) for c in ("key", "bits", "more")]
                yield pa.RecordBatch.from_arrays([pa.array(h.T.ravel().view(np.int64)), *more], names=["h", "key", "bits", "more"])

    return run


def _verify(least: float, least_jaccard: float):
    """(a, b, cosine, jaccard, close) of the pairs of enough Jaccard similarity and cosine; those too close to the threshold to tell by half precision are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(np.asarray(batch.column("da")) == np.asarray(batch.column("db"))))
            for rows, dim in _of_one_length(batch, "da") if batch.num_rows else ():
                alike = jaccard(_sets(rows.column("ta"), dim), _sets(rows.column("tb"), dim))
                at = np.flatnonzero(alike >= least_jaccard)
                rows = rows.take(pa.array(at))
                x, y = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.float16).reshape(len(at), dim).astype(np.float32) for c in ("va", "vb"))
                cosine = np.einsum("ij,ij->i", x, y).astype(np.float64)
                good = cosine >= least - ROUGH
                data = [rows.column("a").filter(pa.array(good)), rows.column("b").filter(pa.array(good)), pa.array(cosine[good]), pa.array(alike[at][good]), pa.array(cosine[good] < least + ROUGH)]
                yield pa.RecordBatch.from_arrays(data, names=["a", "b", "cosine", "jaccard", "close"])

    return run


def _surely(least: float):
    """(a, b, cosine, jaccard) of the pairs whose vectors themselves have the cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _ in _of_one_length(batch.append_column("dim", pa.array([len(v) for v in batch.column("va").to_pylist()], pa.int64())), "dim") if batch.num_rows else ():
                cosine = _exact(_matrix(rows.column("va")), _matrix(rows.column("vb")))
                good = pa.array(cosine >= least)
                yield pa.RecordBatch.from_arrays([rows.column("a").filter(good), rows.column("b").filter(good), pa.array(cosine).filter(good), rows.column("jaccard").filter(good)], names=["a", "b", "cosine", "jaccard"])

    return run


def linked(
    df: DataFrame, scratch: Scratch, id_col: str = "arxiv_id", vector_col: str = "area_embedding", least: float = 0.8, least_jaccard: float = LEAST_JACCARD, direct: int = DIRECT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, components, links): ids (id, key) of every row with a usable vector, components (key, comp), links (a, b, cosine, jaccard) of directions.

    A direction's key stands for all rows whose scaled vectors agree to six
    decimals. Cases as for the nearest vectors: unusable vectors and null ids
    take no part, a repeated id counts once, vectors compare only with vectors of
    their own length, empty tables give no rows. Links of a cosine exactly
    ``least`` count. A link's cosine is right to 0.001, its holding certain.
    """
    rows = scratch.table(_space_rows(df, id_col, vector_col, "").mapInArrow(_tokenised, SETS), "rows")
    ids = rows.groupBy("id").agg(F.min("key").alias("key"))
    sketches = rows.select("key", "bits", "more", "dim", "tokens").mapInArrow(_sketch(*banding(rows.count())), "h long, key long, bits long, more long")
    packed = rows.groupBy("key").agg(F.min(F.struct("dim", "tokens", "half")).alias("x")).select("key", "x.*")
    whole = rows.groupBy("key").agg(F.min("v").alias("v"))

    def ends(pairs: DataFrame, of: DataFrame, names: dict[str, str]) -> DataFrame:
        for end in "ab":
            pairs = pairs.join(of.select(F.col("key").alias(end), *(F.col(c).alias(short + end) for c, short in names.items())), end)
        return pairs

    def verify(pairs: DataFrame) -> DataFrame:
        rough = ends(pairs, packed, {"dim": "d", "tokens": "t", "half": "v"}).select("a", "b", "da", "db", "ta", "tb", "va", "vb")
        rough = scratch.table(rough.mapInArrow(_verify(least, least_jaccard), "a long, b long, cosine double, jaccard double, close boolean"), "rough")
        near = ends(rough.where("close").select("a", "b", "jaccard"), whole, {"v": "v"}).select("a", "b", "jaccard", "va", "vb")
        return rough.where("not close").drop("close").unionByName(near.mapInArrow(_surely(least), "a long, b long, cosine double, jaccard double"))

    comps, links = link_components(sketches, verify, MAX_HAMMING, scratch, direct)
    return ids, comps.select(F.col("node").alias("key"), "comp"), links


def clusters_of(ids: DataFrame, comps: DataFrame, least_size: int = 8) -> DataFrame:
    """(cluster_key, id) of the rows of each component of at least ``least_size`` rows; copies of one direction are rows of one component."""
    rows = ids.join(comps, "key", "left").select("id", F.coalesce("comp", "key").alias("comp"))
    sizes = rows.groupBy("comp").agg(F.count("*").alias("n"), F.min("id").alias("cluster_key")).where(F.col("n") >= least_size)
    return rows.join(sizes, "comp").select("cluster_key", "id")


def split_loose(ids: DataFrame, comps: DataFrame, links: DataFrame, scratch: Scratch, density: float = 0.5, rounds: int = 4, least_size: int = 8) -> DataFrame:
    """(id, key, cluster): components whose links are few for their size are divided around their highest-degree medoids.

    A component is loose if its mean degree lies below ``density`` of what a
    clique has. In each round the highest-degree item of every loose part (the
    smallest key among equals) becomes a medoid and takes the items linked to it;
    what is left is a new part. After the last round left items keep their part.
    Degrees are counted once by a map-side aggregate; no part is gathered in one task.
    They are those of the given links, which must be complete; those of ``linked``
    are not inside hot buckets, where ``parted`` counts all pairs.
    """
    rows = ids.groupBy("key").agg(F.count("*").alias("copies"))
    left = scratch.table(rows.join(comps, "key").select("key", F.col("comp").alias("part")), "parts")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    done: list[DataFrame] = []
    for step in range(rounds):
        inner = both.join(left.select(F.col("key").alias("a"), "part"), "a").join(left.select(F.col("key").alias("b"), F.col("part").alias("other")), "b").where("part = other")
        degree = inner.groupBy("part", "a").agg(F.count("*").alias("degree"))
        known = left.join(degree.select("part", F.col("a").alias("key"), "degree"), ["part", "key"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        known = scratch.table(known, f"degree-{step}")
        loose = (
            known.groupBy("part")
            .agg(F.count("*").alias("n"), F.avg("degree").alias("mean"), F.min(F.struct(-F.col("degree"), F.col("key"))).alias("m"))
            .where((F.col("n") > 2) & (F.col("mean") < density * (F.col("n") - 1)))
            .select("part", F.col("m.key").alias("medoid"))
        )
        loose = scratch.table(loose, f"loose-{step}")
        if loose.isEmpty():
            break
        near = inner.join(loose, "part").where("a = medoid").select(F.col("b").alias("key"), "medoid").unionByName(loose.select(F.col("medoid").alias("key"), "medoid"))
        done.append(scratch.table(near.select("key", F.col("medoid").alias("part")), f"done-{step}"))
        left = scratch.table(left.join(near.select("key"), "key", "left_anti"), f"left-{step}")
    for part in done:
        left = left.unionByName(part)
    return ids.join(left, "key").select("id", "key", F.col("part").alias("cluster"))


def directions(df: DataFrame, id_col: str = "arxiv_id", vector_col: str = "area_embedding") -> DataFrame:
    """(key, v): each direction of ``linked`` once, with its packed unit vector."""
    return _space_rows(df, id_col, vector_col, "").mapInArrow(_whole, ROWS).groupBy("key").agg(F.min("v").alias("v"))


def _blocked(a: DataFrame, b: DataFrame, work: Callable, fields: str, block: int) -> DataFrame:
    """work(keys, vectors, keys, vectors) over every block pair of the rows of a and b, both (part, key, v), that are of one part; its columns come after part and a's key."""
    n = [rows.groupBy("part").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias(name)) for rows, name in ((a, "na"), (b, "nb"))]
    n = n[0].join(n[1], "part")
    hashed = F.xxhash64("key")
    left = a.join(n, "part").select("part", F.pmod(hashed, "na").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), F.lit(True).alias("left"), "key", "v")
    right = b.join(n, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"), F.pmod(hashed, "nb").cast("int").alias("j"), F.lit(False).alias("left"), "key", "v")
    names = ["part", "key", *(f.split()[0] for f in fields.split(", "))]

    def run(rows: pa.Table) -> pa.Table:
        side = np.asarray(rows.column("left"))
        x, y = rows.filter(pa.array(side)), rows.filter(pa.array(~side))
        if not x.num_rows or not y.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "cosine" else pa.int64()) for n in names})
        out = work(x.column("key").to_numpy(), _matrix(x.column("v")).astype(np.float64), y.column("key").to_numpy(), _matrix(y.column("v")).astype(np.float64))
        return pa.table(dict(zip(names, [x.column("part"), x.column("key"), *out], strict=True)))

    return left.unionByName(right).groupBy("part", "i", "j").applyInArrow(run, f"part long, key long, {fields}")


def degrees(a: DataFrame, b: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(part, key, degree): for every row of a, how many other rows of b in its part have a cosine of ``least`` or more."""

    def work(ka: np.ndarray, x: np.ndarray, kb: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        return [((x @ y.T >= least) & (ka[:, None] != kb[None, :])).sum(axis=1)]

    found = _blocked(a, b, work, "n long", block).groupBy("part", "key").agg(F.sum("n").alias("degree"))
    return a.select("part", "key").join(found, ["part", "key"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def _nearest(a: DataFrame, b: DataFrame, block: int) -> DataFrame:
    """(key, to): the row of b in the same part with the highest cosine, the smaller key among equals."""

    def work(ka: np.ndarray, x: np.ndarray, kb: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(kb)
        cosine = x @ y[order].T
        at = cosine.argmax(axis=1)
        return [cosine[np.arange(len(x)), at], kb[order][at]]

    best = _blocked(a, b, work, "cosine double, to long", block).groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "to")).alias("m"))
    return best.select("key", F.col("m.to").alias("to"))


def _divided(least: float, density: float):
    """Divides one part like the rounds of ``parted``."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        keys = rows.column("key").to_numpy()
        x = _matrix(rows.column("v")).astype(np.float64)
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        degree, left, label = near.sum(axis=1), np.ones(len(x), bool), np.empty(len(x), np.int64)
        while left.sum() > 2 and degree[left].mean() < density * (left.sum() - 1):
            at = int(np.where(left, degree, -1).argmax())
            take = left & near[at]
            take[at] = True
            label[take] = keys[at]
            left &= ~take
            degree -= near[:, take].sum(axis=1)
        if left.any():
            label[left] = keys[left].min()
        return pa.table({"part": rows.column("part"), "key": rows.column("key"), "cluster": pa.array(label)})

    return run


def parted(
    ids: DataFrame, comps: DataFrame, vectors: DataFrame, scratch: Scratch, least: float = 0.8, density: float = 0.5, least_size: int = 8, block: int = BLOCK
) -> DataFrame:
    """(id, key, cluster, degree) of the rows of every component of at least ``least_size`` rows, loose components divided.

    vectors: (key, v) as from ``directions``. A part is loose if the mean degree
    of its directions, counted exactly over all pairs inside it, lies below
    ``density`` of what a clique has. The one of highest degree (the smallest key
    among equals) becomes a medoid and takes all within ``least`` of it; what is
    left is divided until it is not loose. Clusters of fewer than ``least_size``
    rows then join the cluster of the nearest medoid of their component; a
    component without a larger one stays whole. Parts of up to ``block``
    directions are divided in one task, larger ones in rounds over block pairs
    by the same rules.
    """
    rows = ids.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    wide = rows.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") >= least_size)
    rows = scratch.table(rows.join(wide.select("comp"), "comp", "left_semi"), "rows-of-parts")
    base = scratch.table(rows.groupBy("comp", "key").agg(F.count("*").alias("copies")).join(vectors, "key"), "directions")
    left = base.select(F.col("comp").alias("part"), "key", "v")
    done: list[DataFrame] = []
    large = left.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > block).select("part")
    rest, left = scratch.table(left.join(large, "part", "left_semi"), "large"), left.join(large, "part", "left_anti")
    if not rest.isEmpty():
        rest = scratch.table(rest.join(degrees(rest, rest, least, block), ["part", "key"]), "large-degrees")
    for step in count():
        if rest.isEmpty():
            break
        stats = rest.groupBy("part").agg(F.count("*").alias("n"), F.avg("degree").alias("mean"), F.min(F.struct(-F.col("degree"), F.col("key"))).alias("m"), F.min("key").alias("cluster"))
        stats = scratch.table(stats.select("part", "n", "mean", F.col("m.key").alias("medoid"), "cluster"), f"stats-{step}")
        loose = (F.col("n") > 2) & (F.col("mean") < density * (F.col("n") - 1))
        done.append(rest.join(stats.where((F.col("n") > block) & ~loose), "part").select("key", "cluster"))
        left = left.unionByName(rest.join(stats.where(F.col("n") <= block).select("part"), "part", "left_semi").select("part", "key", "v"))
        rest = rest.join(stats.where((F.col("n") > block) & loose).select("part", "medoid"), "part")
        heart = rest.where("key = medoid").select("part", "key", "v")
        near = degrees(rest.select("part", "key", "v"), heart, least, block).select("part", "key", F.col("degree").alias("near"))
        marked = scratch.table(rest.join(near, ["part", "key"]).withColumn("taken", (F.col("near") > 0) | (F.col("key") == F.col("medoid"))), f"marked-{step}")
        taken, after = marked.where("taken"), marked.where("not taken")
        done.append(taken.select("key", F.col("medoid").alias("cluster")))
        less = degrees(after.select("part", "key", "v"), taken.select("part", "key", "v"), least, block).withColumnRenamed("degree", "less")
        rest = scratch.table(after.join(less, ["part", "key"]).select("part", "key", "v", (F.col("degree") - F.col("less")).alias("degree")), f"left-{step}")
    label = left.groupBy("part").applyInArrow(_divided(least, density), "part long, key long, cluster long").select("key", "cluster")
    for part in done:
        label = label.unionByName(part)
    label = scratch.table(base.join(label, "key").select("comp", "key", "v", "copies", "cluster"), "labelled")

    def inside(members: DataFrame) -> DataFrame:
        own = members.select(F.col("cluster").alias("part"), "key", "v")
        return degrees(own, own, least, block).select("key", "degree")

    sizes = label.groupBy("cluster").agg(F.sum("copies").alias("size"))
    known = scratch.table(label.join(inside(label), "key").join(sizes, "cluster"), "sized")
    small = known.where(F.col("size") < least_size)
    if not small.isEmpty():
        medoids = known.where(F.col("size") >= least_size).groupBy("comp", "cluster").agg(F.min(F.struct(-F.col("degree"), "key", "v")).alias("m")).select(F.col("comp").alias("part"), F.col("m.key").alias("key"), F.col("m.v").alias("v"), "cluster")
        medoids = scratch.table(medoids, "medoids")
        to = _nearest(small.select(F.col("comp").alias("part"), "key", "v"), medoids.select("part", "key", "v"), block)
        to = to.join(medoids.select(F.col("key").alias("to"), F.col("cluster").alias("new")), "to").select("key", "new")
        known = known.join(to, "key", "left").withColumn("cluster", F.when(F.col("size") >= least_size, F.col("cluster")).otherwise(F.coalesce("new", "comp")))
        known = scratch.table(known.select("key", "v", "cluster"), "put-back")
        known = scratch.table(known.join(inside(known), "key"), "parts")
    return rows.select("id", "key").join(known.select("key", "cluster", "degree"), "key").select("id", "key", "cluster", "degree")


def described(members: DataFrame, links: DataFrame | None, known: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_key, size, typical_ids, earlier_cluster_id, earlier_share): each cluster with its ``typical`` members of highest degree and the cluster of an earlier run most of its rows had.

    members: (id, key, cluster), and without links the degree. known: (id,
    cluster_id) of the earlier run, with one row per ancestor; the deepest, that
    is the rarest, of a row counts.
    Ties go to the smaller id and cluster_id.
    """
    rows = members
    if links is not None:
        ends = links.select(F.col("a").alias("key"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("key"), F.col("a").alias("to")))
        of = members.select("key", "cluster").distinct()
        inner = ends.join(of, "key").join(of.select(F.col("key").alias("to"), F.col("cluster").alias("c")), "to").where("cluster = c")
        degree = inner.groupBy("key").agg(F.count("*").alias("degree"))
        rows = members.join(degree, "key", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    size = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.min("id").alias("cluster_key"))
    best = Window.partitionBy("cluster").orderBy(F.desc("degree"), "id")
    top = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= typical)
    top = top.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("r", "id"))).alias("x")).select("cluster", F.col("x.id").alias("typical_ids"))
    own = known.select(F.col("id"), "cluster_id").where("id is not null and cluster_id is not null").distinct()
    rare = own.groupBy("cluster_id").agg(F.count("*").alias("n"))
    deepest = own.join(rare, "cluster_id").groupBy("id").agg(F.min(F.struct("n", "cluster_id")).alias("x")).select("id", F.col("x.cluster_id").alias("cluster_id"))
    votes = rows.join(deepest, "id").groupBy("cluster", "cluster_id").agg(F.count("*").alias("n"))
    most = votes.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("cluster_id"))).alias("x"))
    out = size.join(top, "cluster").join(most, "cluster", "left")
    return out.select("cluster_key", "size", "typical_ids", F.col("x.cluster_id").alias("earlier_cluster_id"), (-F.col("x.n") / F.col("size")).alias("earlier_share"))
