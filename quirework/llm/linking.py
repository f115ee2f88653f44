"""From sketches to verified groups: bucketed candidate pairs, exact checks, components.

A sketch row is (h, key, bits...): a bucket, the item, and one or more columns of
64 bits whose Hamming distance estimates dissimilarity. Items in one bucket are
candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.operators.components import connected_components
from quirework.scratch import Scratch

#: Up to this many items a bucket's pairs are compared at once; larger ones take the hub path, which is exact too.
DIRECT = 512
#: Items of one block of a large bucket.
BLOCK = 4096

def _bits(words: list[np.ndarray]) -> np.ndarray:
    """(rows, columns) of unsigned bits; of signed numbers the count would be that of the absolute value's."""
    return np.stack([w.view(np.uint64) for w in words], axis=1)


def _hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
    for w in range(1, x.shape[1]):
        out = out + np.bitwise_count(x[:, None, w] ^ y[None, :, w])
    return out


def _near(keys: np.ndarray, bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(np.triu(_hamming(bits, bits) <= most, 1))
    return keys[i], keys[j]


#: Buckets of up to this many rows are compared many at a time; rows that are looked at together.
SMALL = 16
GATHERED = 100_000


def _gathered(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], rows: int = GATHERED) -> Iterator[list[np.ndarray]]:
    """The columns of about ``rows`` rows at a time."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append([np.asarray(batch.column(n)) for n in names])
            size += batch.num_rows
        if size >= rows:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _small_pairs(keys: np.ndarray, bits: np.ndarray, begin: np.ndarray, length: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The near pairs of many small buckets: place i of all buckets of one length against place j."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(keys[:0], keys[:0])]
    for n in np.unique(length).tolist():
        first = begin[length == n]
        for i in range(n):
            for j in range(i + 1, n):
                x, y = first + i, first + j
                near = (np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1) <= most) & (keys[x] != keys[y])
                out.append((keys[x[near]], keys[y[near]]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _runs(batches: Iterator[pa.RecordBatch], words: tuple[str, ...], whole: int, small: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool, int]]:
    """(h, keys, bits, first, anchor) of each bucket of rows sorted by h and key; a bucket of more than ``whole`` rows comes in parts. Small ones that are whole in what is gathered go to ``small``."""
    held: list[tuple[np.ndarray, ...]] = []
    anchor, started = 0, False

    def flush(part: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        keep = np.ones(len(part[1]), bool)
        keep[1:] = part[1][1:] != part[1][:-1]
        return part[1][keep], part[2][keep]

    for h, key, *own in _gathered(batches, ("h", "key", *words)):
        cols = (h, key, _bits(own))
        edges = np.flatnonzero(np.diff(cols[0])) + 1
        begin, stop = np.r_[0, edges], np.r_[edges, len(cols[0])]
        length = stop - begin
        few = (length > 1) & (length <= min(SMALL, whole))
        few[[0, -1]] = False
        if few.any():
            small(cols[1], cols[2], begin[few], length[few])
        more = (length > 1) & ~few  # a bucket of one row, wholly inside, gives nothing
        more[[0, -1]] = True
        for lo, hi in zip(begin[more].tolist(), stop[more].tolist(), strict=True):
            piece = tuple(c[lo:hi] for c in cols)
            if held and held[0][0][0] != piece[0][0]:
                joined = tuple(np.concatenate(c) for c in zip(*held, strict=True))
                k, b = flush(joined)
                yield int(joined[0][0]), k, b, not started, anchor if started else int(k[0])
                held, started = [], False
            held.append(piece)
            if sum(len(p[0]) for p in held) > whole:
                joined = tuple(np.concatenate(c) for c in zip(*held, strict=True))
                k, b = flush(joined)
                if len(k) > whole:
                    if not started:
                        anchor = int(k[0])
                    yield int(joined[0][0]), k, b, not started, anchor
                    held, started = [], True
                else:
                    held = [(np.full(len(k), joined[0][0]), k, b)]
    if held:
        joined = tuple(np.concatenate(c) for c in zip(*held, strict=True))
        k, b = flush(joined)
        yield int(joined[0][0]), k, b, not started, anchor if started else int(k[0])


def _bucket_pairs(max_hamming: int, direct: int, words: tuple[str, ...]) -> Callable:
    names = ["a", "b", "h", "key", *words]

    def emit(cols: list[np.ndarray]) -> pa.RecordBatch:
        data = [pa.array(c) for c in cols]
        return pa.RecordBatch.from_arrays(data + [pa.nulls(len(cols[0]), pa.int64())] * (len(names) - len(data)), names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def small(keys: np.ndarray, bits: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
            pair = _small_pairs(keys, bits, begin, length, max_hamming)
            if len(pair[0]):
                few.append(pair)

        few: list[tuple[np.ndarray, np.ndarray]] = []
        for h, keys, bits, first, anchor in _runs(batches, words, direct, small):
            while few:
                yield emit(list(few.pop()))
            if first and len(keys) <= direct:
                if len(keys) > 1:
                    pair = _near(keys, bits, max_hamming)
                    if len(pair[0]):
                        out.append(pair)
                        size += len(pair[0])
            else:
                yield emit([np.full(len(keys), anchor), keys, np.full(len(keys), h), keys, *bits.T.view(np.int64)])
            if size > 50_000:
                yield emit([np.concatenate(c) for c in zip(*out, strict=True)])
                out, size = [], 0
        while few:
            yield emit(list(few.pop()))
        if out:
            yield emit([np.concatenate(c) for c in zip(*out, strict=True)])

    return run


def _cross_pairs(max_hamming: int, words: tuple[str, ...], complete: bool) -> Callable:
    """Pairs of a block pair whose items lie in different components; all its pairs if ``complete``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def work(parts: list) -> pa.RecordBatch:
            side, key, bits, comp = (np.concatenate([p[i] for p in parts]) for i in range(4))
            left, right = side <= 0, side >= 0
            close = _hamming(bits[left], bits[right]) <= max_hamming
            i, j = np.nonzero(close if complete else close & (comp[left][:, None] != comp[right][None, :]))
            x, y = key[left][i], key[right][j]
            keep = x != y
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep])], names=["a", "b"])

        for batch in batches:
            h, p, side, key, comp = (np.asarray(batch.column(n)) for n in ("h", "p", "side", "key", "comp"))
            bits = _bits([np.asarray(batch.column(n)) for n in words])
            cut = np.flatnonzero((np.diff(h) != 0) | (np.diff(p) != 0)) + 1
            for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(h)], strict=True):
                if lo == hi:
                    continue
                at = (h[lo], p[lo])
                if held and at not in held:
                    yield work(held.popitem()[1])
                held.setdefault(at, []).append((side[lo:hi], key[lo:hi], bits[lo:hi], comp[lo:hi]))
        if held:
            yield work(held.popitem()[1])

    return run


def link_components(
    sketches: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    max_hamming: int,
    scratch: Scratch,
    direct: int = DIRECT,
    block: int = BLOCK,
    complete: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(components, links) of the items whose candidate pairs ``verify`` accepts.

    sketches: (h long, key long, bits long, and any further columns of bits). verify takes distinct pairs (a, b)
    with a < b and returns those that hold, with any further columns. components
    is (node, comp) of linked items.

    A bucket of up to ``direct`` items gives all its pairs that pass the bit
    filter. A larger one first gives only its links to its smallest item (a hub);
    after components are known, its pairs across components are compared in
    blocks of ``block`` items. Pairs within a component already joined change
    no component, so none is lost and no hot bucket meets one task; buckets of
    one component are done. Links are complete outside hot buckets; with
    ``complete`` the pairs within components are compared there too, and links are
    complete everywhere.
    """
    words = tuple(c for c in sketches.columns if c not in ("h", "key"))
    fields = ", ".join(f"{c} long" for c in ("a", "b", "h", "key", *words))
    rows = sketches.repartition("h").sortWithinPartitions("h", "key").mapInArrow(_bucket_pairs(max_hamming, direct, words), fields)
    rows = scratch.table(rows, "candidates")
    pairs = rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = scratch.table(verify(pairs), "links")
    comps = connected_components(links, scratch)
    hot = rows.where("h is not null").select("h", "key", *words).distinct()
    if not hot.isEmpty():
        hot = hot.join(comps.select(F.col("node").alias("key"), "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        if not complete:
            mixed = hot.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("h")
            hot = hot.join(mixed, "h", "left_semi")
        hot = scratch.table(hot, "hot")
        blocks = hot.groupBy("h").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))
        at = F.pmod(F.xxhash64("key"), F.col("n")).cast("int")
        spread = (
            hot.join(blocks, "h")
            .withColumn("at", at)
            .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .select(
                "h",
                (F.least("at", "to").cast("long") * F.col("n") + F.greatest("at", "to")).alias("p"),
                F.when(F.col("at") == F.col("to"), 0).when(F.col("at") < F.col("to"), -1).otherwise(1).alias("side"),
                "key",
                *words,
                "comp",
            )
        )
        across = spread.repartition("h", "p").sortWithinPartitions("h", "p").mapInArrow(_cross_pairs(max_hamming, words, complete), "a long, b long")
        more = scratch.table(verify(across.distinct().join(links.select("a", "b"), ["a", "b"], "left_anti")), "more-links")
        links = scratch.table(links.unionByName(more), "all-links")
        comps = connected_components(links, scratch)
    return comps, links
