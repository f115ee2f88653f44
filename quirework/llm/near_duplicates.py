"""Problem 1: near-duplicate passages by Order MinHash and banded alignment.

Each text is a sequence of lower-case words. A sketch entry is the two or
three k-mers (with occurrence numbers) of least hash, kept in text order; texts
that share an entry are candidates. Candidates are aligned in a band. The similarity
asked for is distinct words in both over distinct words in either; a short edit
distance proves it, and where the alignment proves nothing (parts in another order,
insertions wider than the band) the overlap itself is counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import WordHashes, mix, words
from quirework.llm.linking import DIRECT, link_components
from quirework.scratch import Scratch

K = 3
ENTRIES = 32
#: A k-mer in more than this share of texts is common: it tells little, and is drawn with COMMON_WEIGHT instead of 1.
#: Below COMMON_LEAST texts none is common.
COMMON_SHARE = 0.003
COMMON_LEAST = 30
COMMON_WEIGHT = 0.1
#: In a group so large that its own k-mers are common, the weights favour what tells its texts apart. For such groups there are
#: entries of three k-mers without weights: each text needs to meet only some of its many partners.
PLAIN_ENTRIES = 12
PLAIN_LENGTH = 3
#: Texts of up to this many distinct words also get entries of single words: a k-mer sketch is unreliable there.
SHORT = 24
SHORT_ENTRIES = 16
#: Bits of the one-bit MinHash in which two texts may differ: at a similarity of 0.7 each bit differs with 0.15, for unrelated texts with about 0.45.
MAX_HAMMING = 21
BAND = 24


TOKENS = "id string, key long, words binary"


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, words as 32-bit hashes in text order) of each row of (id, text) with words; key is the hash of the word sequence."""
    hashes = WordHashes()
    for batch in batches:
        at, keys, packed = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            ws = words(text) if text else ()
            if ws:
                own = np.array([hashes[w] for w in ws], np.uint64)
                at.append(i)
                keys.append(xxhash.xxh64_intdigest(own.tobytes()))
                packed.append((own >> np.uint64(32)).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(packed, pa.binary())], names=["id", "key", "words"]
        )


def _sequences(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(mixed word hashes of all rows, start of each row's words) of a batch of packed rows; each has a word."""
    rows = packed.to_pylist()
    flat = np.frombuffer(b"".join(rows), np.uint32).astype(np.uint64)
    return mix(flat + np.uint64(1)), np.r_[0, np.cumsum([len(r) // 4 for r in rows])].astype(np.int64)


def _odd(seed: int) -> np.uint64:
    return mix(np.array([seed], np.uint64))[0] | np.uint64(1)


def _kmers(flat: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k-mer hashes of all rows, start of each row's k-mers); a row of under k words is one k-mer."""
    n = np.diff(starts)
    count = np.maximum(n - k + 1, 1)
    first = np.r_[0, np.cumsum(count)]
    row = np.repeat(np.arange(len(n)), count)
    at = starts[:-1][row] + np.arange(first[-1]) - first[:-1][row]
    out = np.zeros(len(at), np.uint64)
    end = starts[1:][row]
    for j in range(k):
        inside = at + j < end
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, flat[np.minimum(at + j, len(flat) - 1)], np.uint64(j + 1)))
    return out, first


def _labelled(kmers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each k-mer's hash with its occurrence number within its row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    own = kmers ^ mix(row.astype(np.uint64))
    order = np.argsort(own, kind="stable")
    same = np.zeros(len(kmers), bool)
    same[1:] = own[order][1:] == own[order][:-1]
    run = np.arange(len(kmers))
    start = np.maximum.accumulate(np.where(same, 0, run))
    number = np.empty(len(kmers), np.uint64)
    number[order] = (run - start).astype(np.uint64)
    return mix(kmers + number * np.uint64(0xD1B54A32D192ED03))


def _ordered_minima(labelled: np.ndarray, first: np.ndarray, slow: np.ndarray | None, seed: int, length: int = 2) -> np.ndarray:
    """One sketch entry of each row: its ``length`` labelled k-mers of least hash, in text order. slow is -1 / weight; without it all weigh alike.

    A row of fewer k-mers gives all it has.
    """
    race = ((labelled * _odd(seed)) >> np.uint64(11)).astype(np.float64)
    if slow is not None:
        race += 1
        race *= 2.0**-53
        np.log(race, out=race)
        race *= slow
    n = np.diff(first)
    picked = np.empty((length, len(n)), np.int64)
    for k in range(length):
        low = np.repeat(np.minimum.reduceat(race, first[:-1]), n)
        hit = np.flatnonzero(race == low)
        row = np.searchsorted(first, hit, "right") - 1
        keep = np.ones(len(hit), bool)
        keep[1:] = row[1:] != row[:-1]
        picked[k] = hit[keep] if k == 0 else np.where(n > k, hit[keep], picked[k - 1])
        race[picked[k]] = np.inf
    picked.sort(axis=0)
    out = np.full(len(n), seed, np.uint64)
    for k in range(length):
        out = mix(out * np.uint64(3) + labelled[picked[k]])
    return out


def _one_bit(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 one-bit MinHashes of each row's words, packed."""
    out = np.zeros(len(starts) - 1, np.uint64)
    for i in range(64):
        low = np.minimum.reduceat(flat * _odd(i + 9001), starts[:-1])
        out |= (mix(low) & np.uint64(1)) << np.uint64(i)
    return out.view(np.int64)


def _frequent(share: float, k: int):
    """Of each partition: its k-mers in at least half that share of its texts, with their counts; key 0 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = Counter(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, starts = _sequences(batch.column(0))
            kmers, first = _kmers(flat, starts, k)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            _, once = np.unique(kmers ^ mix(row.astype(np.uint64)), return_index=True)
            value, n = np.unique(kmers[once], return_counts=True)
            
            counts.update(dict(zip(value.tolist(), n.tolist(), strict=True)))
            total += batch.num_rows
            if len(counts) > 4_000_000:  # lossy counting: an error of at most the texts dropped so far over the bound
                counts = Counter({x: c for x, c in counts.items() if c > share * total / 8})
        if total:
            found = [(x, c) for x, c in counts.items() if c >= max(2, share / 2 * total)]
            value = np.array([0] + [x for x, _ in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array([total] + [c for _, c in found], pa.int64())], names=["kmer", "n"])

    return run


def common_kmers(texts: DataFrame, share: float = COMMON_SHARE, k: int = K, most: int = 1 << 18) -> np.ndarray:
    """Sorted hashes of the k-mers found in more than ``share`` of all texts.

    A k-mer above the share is above it in some partition, so each partition
    reports only what is frequent there; a mean text of n k-mers allows at most
    n / share of them. ``most`` bounds the list for very long texts; beyond it
    the rarest lose their label, which changes weights and not results.
    """
    rows = texts.mapInArrow(_frequent(share, k), "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n"))
    got = rows.orderBy(F.desc(F.col("kmer") == 0), F.desc("n"), "kmer").limit(most + 1).toPandas()
    if not len(got):
        return np.empty(0, np.uint64)
    total = int(got.loc[got.kmer == 0, "n"].sum())
    return np.sort(got.loc[(got.kmer != 0) & (got.n > max(share * total, COMMON_LEAST)), "kmer"].to_numpy().view(np.uint64))


def _sketch(common: np.ndarray, k: int, entries: int):
    """Sketch rows of (key, words); exact copies within a partition are sketched once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            keys = batch.column(0).to_numpy()
            flat, starts = _sequences(batch.column(1))
            n = np.diff(starts)
            kmers, first = _kmers(flat, starts, k)
            labelled = _labelled(kmers, first)
            slow = -1 / np.where(np.isin(kmers, common), COMMON_WEIGHT, 1.0)
            bits = _one_bit(flat, starts)
            h = [_ordered_minima(labelled, first, slow, 1000 + i) for i in range(entries)]
            h += [_ordered_minima(labelled, first, None, 5000 + i, PLAIN_LENGTH) for i in range(PLAIN_ENTRIES)]
            out_key, out_bits = [np.tile(keys, len(h))], [np.tile(bits, len(h))]
            short = np.array([i for i in np.flatnonzero(n <= 8 * SHORT) if len(set(flat[starts[i] : starts[i + 1]].tolist())) <= SHORT], np.int64)
            if len(short):
                own = np.concatenate([flat[starts[i] : starts[i + 1]] for i in short])
                begin = np.r_[0, np.cumsum(n[short])][:-1]
                for i in range(SHORT_ENTRIES):
                    h.append(mix(np.minimum.reduceat(own * _odd(i + 7001), begin) + np.uint64(i + 1)))
                    out_key.append(keys[short])
                    out_bits.append(bits[short])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(out_key)), pa.array(np.concatenate(out_bits))], names=["h", "key", "bits"]
            )

    return run


def banded_alignment(pairs: list[tuple[np.ndarray, np.ndarray]], band: int = BAND) -> np.ndarray:
    """1 - edit distance / longer length of each pair of word sequences, with the alignment path within ``band`` of the diagonal.

    All pairs advance together, one row of the table at a time. Outside the band
    the distance counts as unreachable, so the value is a lower bound; two empty
    sequences are equal (1.0).
    """
    if not pairs:
        return np.empty(0)
    na = np.array([len(a) for a, _ in pairs])
    nb = np.array([len(b) for _, b in pairs])
    far = np.float32(1e9)
    p, width = len(pairs), 2 * band + 1
    a = np.zeros((p, max(1, na.max())), np.uint32)
    b = np.zeros((p, max(1, nb.max()) + width + 1), np.uint32)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = x
        b[i, band : band + len(y)] = y  # b[:, band + j - 1] is word j
    offset = np.arange(width) - band
    row = np.where((offset >= 0) & (offset[None] <= nb[:, None]), offset[None].astype(np.float32), far)
    out = np.where(na == 0, np.where(nb <= band, nb, na + nb), -1).astype(np.float32)
    ramp = np.arange(width, dtype=np.float32)
    for i in range(1, int(na.max(initial=0)) + 1):
        j = i + offset
        ok = (j[None] >= 0) & (j[None] <= nb[:, None])
        same = np.zeros((p, width), bool)
        lo = i - 1
        part = b[:, lo : lo + width]
        same[:, : part.shape[1]] = part == a[:, i - 1 : i]
        diag = row + np.where(same & (j[None] >= 1), 0, 1)
        diag[:, j == 0] = far
        up = np.concatenate([row[:, 1:], np.full((p, 1), far)], axis=1) + 1
        best = np.where(ok, np.minimum(diag, up), far)
        row = np.minimum.accumulate(best - ramp, axis=1) + ramp
        row = np.where(ok, row, far)
        done = na == i
        if done.any():
            at = nb - i + band
            inside = done & (at >= 0) & (at < width)
            out[inside] = row[inside, at[inside]]
    longest = np.maximum(np.maximum(na, nb), 1)
    out = np.where((out < 0) | (out > longest), longest, out)
    return 1 - out / longest


def _aligned(pairs: list[tuple[np.ndarray, np.ndarray]], band: int = BAND) -> np.ndarray:
    """``banded_alignment`` of many pairs, those of like length together, so that memory stays small."""
    out = np.empty(len(pairs))
    length = np.array([max(len(a), len(b)) for a, b in pairs], np.int64)
    order = np.argsort(length, kind="stable")
    lo = 0
    while lo < len(order):
        hi = min(lo + 1024, len(order))
        while hi - lo > 1 and length[order[hi - 1]] * (hi - lo) > 2_000_000:
            hi = lo + max(1, (hi - lo) // 2)
        out[order[lo:hi]] = banded_alignment([pairs[i] for i in order[lo:hi]], band)
        lo = hi
    return out


def proven(alignment: np.ndarray, longest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the similarity of each pair that its alignment proves. a, b: distinct words of both; longest: words of the longer.

    With e edits at most e words of either text are matched by none of the other,
    so at least max(a, b) - e distinct words are in both.
    """
    both = np.maximum(np.maximum(a, b) - np.rint((1 - alignment) * longest), 0)
    return both / np.maximum(a + b - both, 1)


def _overlap(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distinct words in both over distinct words in either; pairs hold distinct words."""
    both = np.empty(len(pairs))
    for i, (x, y) in enumerate(pairs):
        z = np.concatenate([x, y])
        z.sort()
        both[i] = (z[1:] == z[:-1]).sum()
    return both / np.array([len(x) + len(y) for x, y in pairs] - both)


def _verify(threshold: float, exact: bool):
    """(a, b, similarity, alignment) of the pairs that hold. Without ``exact`` the similarity of a pair proven by its alignment is the proven lower bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True)]
            sets = [(np.unique(x), np.unique(y)) for x, y in wide]
            na, nb = (np.array([len(p[i]) for p in sets], np.int64) for i in range(2))
            at = np.flatnonzero(np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)  # others cannot reach the threshold
            if not len(at):
                continue
            aligned = _aligned([wide[i] for i in at])
            longest = np.array([max(len(wide[i][0]), len(wide[i][1])) for i in at])
            similarity = proven(aligned, longest, na[at], nb[at])
            open_ = np.ones(len(at), bool) if exact else similarity < threshold - 1e-12
            similarity[open_] = _overlap([sets[i] for i in at[open_]])
            good = similarity >= threshold - 1e-12
            rows = batch.take(pa.array(at[good]))
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(similarity[good]), pa.array(aligned[good])], names=["a", "b", "similarity", "alignment"])

    return run


def _prefixes(common: np.ndarray, threshold: float):
    """Sketch rows that miss no pair: of each text the words, in an order that puts common ones last, of which two texts at the threshold share at least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, h, n = batch.column(0).to_numpy(), [], []
            flat, starts = _sequences(batch.column(1))
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                own = np.unique(flat[lo:hi])
                own = own[np.lexsort([own, np.isin(_kmers(own, np.arange(len(own) + 1), 1)[0], common)])]
                own = own[: len(own) - int(np.ceil(threshold * len(own) - 1e-9)) + 1]
                h.append(own)
                n.append(len(own))
            key = np.repeat(keys, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(key), pa.array(np.zeros(len(key), np.int64))], names=["h", "key", "bits"])

    return run


def near_duplicates(
    df: DataFrame,
    scratch: Scratch,
    id_col: str = "passage_id",
    text_col: str = "passage",
    threshold: float = 0.7,
    k: int = K,
    entries: int = ENTRIES,
    max_hamming: int = MAX_HAMMING,
    direct: int = DIRECT,
    complete: bool = True,
    exact: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, groups, links) of the near-duplicates among a table's texts.

    members: (id, key) of every row with words; key stands for one word sequence,
    so rows that are exact copies share it and are compared once. groups: (key,
    comp) of the keys linked to another; links: (a, b, similarity, alignment) of
    keys whose distinct words overlap by at least ``threshold``. complete: links
    hold every candidate pair, in number up to the square of a group; otherwise
    those that components need, and a similarity may be the lower bound that the
    alignment proves. exact: candidates
    come from shared words of which no pair at the threshold has none, instead of
    from sketches; slower, and certain.

    Null ids, null texts and texts without a word take no part. Repeated rows of
    an id count once. Other columns of ``df`` are not read. An empty table gives
    empty results. Ties do not occur: every link of the threshold counts.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    rows = scratch.table(rows.mapInArrow(_tokenise, TOKENS), "words")
    common = common_kmers(rows.select("words"), k=1 if exact else k)
    if exact:
        once = rows.groupBy("key").agg(F.min("words").alias("words"))
        sketches, max_hamming = once.mapInArrow(_prefixes(common, threshold), "h long, key long, bits long"), 64
    else:
        sketches = rows.select("key", "words").mapInArrow(_sketch(common, k, entries), "h long, key long, bits long")
    packed = rows.groupBy("key").agg(F.min("words").alias("words"))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(packed.select(F.col("key").alias("a"), F.col("words").alias("wa")), "a").join(packed.select(F.col("key").alias("b"), F.col("words").alias("wb")), "b")
        return both.select("a", "b", "wa", "wb").mapInArrow(_verify(threshold, complete), "a long, b long, similarity double, alignment double")

    groups, links = link_components(sketches, verify, max_hamming, scratch, direct, complete=complete)
    members = rows.select("id", "key").dropDuplicates(["id"])
    return members, groups.select(F.col("node").alias("key"), "comp"), links


def grouped_rows(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, group): a row's group is that of its key; copies of one text form a group also without a link."""
    return members.join(groups, "key", "left").select("id", F.coalesce("comp", "key").alias("group"))


def pairs_of_groups(rows: DataFrame, block: int = 4096) -> DataFrame:
    """(a, b): every pair of ids of one group, the smaller first. A group of more than ``block`` rows is dealt to tasks in pairs of blocks."""
    sizes = rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    many = F.ceil(F.col("n") / F.lit(block)).cast("int")
    sized = rows.join(sizes, "group").select("group", "id", many.alias("blocks"), F.pmod(F.xxhash64("id"), many).cast("int").alias("block"))
    left = sized.select("group", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.col("id").alias("a"))
    right = sized.select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("block").alias("j"), F.col("id").alias("b"))
    return left.join(right, ["group", "i", "j"]).where("a < b").select("a", "b")
