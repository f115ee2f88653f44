"""Problem 9: repetition inside single documents, scored by boosted trees over document statistics.

Every document gets its statistics in one pass without a shuffle. Gradient-boosted
trees estimate the share of repeated words from them; they are fitted on a bounded
sample, are flat numpy arrays of nodes and rise monotonically in the measures of
repetition. A case obeys two bounds that follow from its definition: its words in
short repeated runs reach the share, and its distinct words do not exceed the rest.
As the trees are monotone in every statistic, the document that just meets these
bounds has the least score of all possible cases, and that score is the gate: what
scores below it cannot be a case, whatever the sample was. The exact share is
worked out for the others, and decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import WordHashes, mix, words

#: Words of a run, and the share of repeated words that makes a case.
RUN = 8
SHARE = 0.25
#: Documents, by hash order, that the trees are fitted on; all are scored.
SAMPLE = 4000

#: Words of a run of the statistic repeated_short_runs: every repeated run of RUN words consists of repeated ones of these.
SHORT_RUN = 4

FEATURES = ["repeated_short_runs", "top_pair_share", "line_repeats", "sentence_repeats", "paragraph_repeats", "distinct_share"]
#: Signs of the monotonic constraints: more of any repeated content never lowers the score, more distinct words never raise it.
MONOTONE = [1, 1, 1, 1, 1, -1]

_SENTENCE = re.compile(r"[.!?。！？]\s*|\n")
_BLANK = re.compile(r"\n\s*\n")


def _runs(flat: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in flat, hash) of every run of k consecutive words within a row."""
    n = np.diff(starts)
    count = np.maximum(n - k + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[:-1][row]
    value = mix(row.astype(np.uint64) + np.uint64(1))
    for j in range(k):
        value = (value ^ flat[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
    return row, at, value


def _covered(flat: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Share of each row's words in a run of k words that begins earlier in the row too."""
    row, at, value = _runs(flat, starts, k)
    n = np.diff(starts)
    if not len(value):
        return np.zeros(len(n))
    order = np.argsort(value, kind="stable")
    again = np.zeros(len(value), bool)
    again[order[1:]] = value[order][1:] == value[order][:-1]
    step = np.zeros(len(flat) + 1, np.int64)
    step[at[again]] += 1
    np.subtract.at(step, at[again] + k, 1)
    inside = np.cumsum(step[:-1]) > 0
    total = np.r_[0, np.cumsum(inside)]
    return (total[starts[1:]] - total[starts[:-1]]) / np.maximum(n, 1)


def _top(flat: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Share of each row's words that its most frequent run of k words makes up, if it occurs twice."""
    row, _, value = _runs(flat, starts, k)
    n = np.diff(starts)
    out = np.zeros(len(n))
    if len(value):
        _, first, count = np.unique(value, return_index=True, return_counts=True)
        np.maximum.at(out, row[first], np.where(count > 1, count, 0))
    return np.minimum(1, out * k / np.maximum(n, 1))


def _part_repeats(parts: list[str]) -> float:
    """Share of characters in parts that occurred before."""
    total = again = 0
    seen: set[str] = set()
    for part in parts:
        own = part.strip()
        if own:
            total += len(own)
            if own in seen:
                again += len(own)
            seen.add(own)
    return again / total if total else 0.0


def _hashed(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, start of each text's words); a null text has none."""
    flat: list[int] = []
    starts = [0]
    for text in texts:
        if text:
            flat.extend(map(hashes.__getitem__, words(text)))
        starts.append(len(flat))
    return np.array(flat, np.uint64), np.array(starts, np.int64)


def _features(texts: list[str | None], flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """FEATURES of each text."""
    parts = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        if text:
            parts[i] = _part_repeats(text.split("\n")), _part_repeats(_SENTENCE.split(text)), _part_repeats(_BLANK.split(text)) if "\n" in text else 0.0
    n = np.diff(starts)
    row = np.repeat(np.arange(len(n)), n)
    once = np.unique(mix(row.astype(np.uint64)) ^ flat, return_index=True)[1]
    distinct = np.bincount(row[once], minlength=len(n)) / np.maximum(n, 1)
    return np.stack([_covered(flat, starts, SHORT_RUN), _top(flat, starts, 2), parts[:, 0], parts[:, 1], parts[:, 2], distinct], axis=1)


def repeated_shares(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The exact share of each text's words that lie in a run of RUN words which also begins earlier."""
    return _covered(flat, starts, RUN)


def statistics(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word counts, exact repeated shares, features of FEATURES) of each text; a null text counts no words."""
    flat, starts = _hashed(texts, hashes)
    return np.diff(starts), repeated_shares(flat, starts), _features(texts, flat, starts)


@dataclass
class Trees:
    """Boosted regression trees as flat node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """All trees advance together, one level at a time."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] > self.threshold[at], self.right[at], self.left[at])
        return self.base + self.value[at].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8) -> Trees:
    """Squared-error boosting on histograms.

    Monotonic constraints: a split against a feature's sign is refused, and both
    children inherit the middle of their values as a bound, so the whole tree is
    monotone. Equal gains go to the earlier feature and lower threshold. Without
    rows the trees score 0.
    """
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    base = float(y.mean()) if len(y) else 0.0
    residual = y - base

    edges = []
    for j in range(x.shape[1]):
        spread = np.linspace(x[:, j].min(), x[:, j].max(), bins)[1:-1] if len(x) else np.empty(0)
        edges.append(np.unique(np.r_[np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1]) if len(x) else [], spread]))

    def node(j: int = 0, t: float = np.inf, v: float = 0.0) -> int:
        at = len(feature)
        feature.append(j)
        threshold.append(t)
        left.append(at)
        right.append(at)
        value.append(v)
        return at

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        r = residual[rows]
        at = node(v=rate * float(np.clip(r.mean() if len(r) else 0.0, low, high)))
        if level == depth or len(rows) < 2 * least:
            return at
        best = (1e-12, -1, 0.0)
        total, n = r.sum(), len(r)
        for j, cut in enumerate(edges):
            if not len(cut):
                continue
            slot = np.searchsorted(cut, x[rows, j], "left")
            s = np.cumsum(np.bincount(slot, r, len(cut) + 1))[:-1]
            c = np.cumsum(np.bincount(slot, minlength=len(cut) + 1))[:-1]
            ok = (c >= least) & (n - c >= least)
            if not ok.any():
                continue
            cl, cr = np.maximum(c, 1), np.maximum(n - c, 1)
            vl, vr = np.clip(s / cl, low, high), np.clip((total - s) / cr, low, high)
            gain = 2 * vl * s - cl * vl**2 + 2 * vr * (total - s) - cr * vr**2 - total**2 / n
            if monotone[j]:
                ok &= monotone[j] * (vr - vl) >= 0
            gain = np.where(ok, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(cut[k]))
        if best[1] < 0:
            return at
        j, t = best[1], best[2]
        right_side = x[rows, j] > t
        a, b = rows[~right_side], rows[right_side]
        middle = float(np.clip((residual[a].mean() + residual[b].mean()) / 2, low, high))
        la, ha, lb, hb = low, high, low, high
        if monotone[j] > 0:
            ha, lb = middle, middle
        elif monotone[j] < 0:
            la, hb = middle, middle
        feature[at], threshold[at] = j, t
        left[at] = grow(a, level + 1, la, ha)
        right[at] = grow(b, level + 1, lb, hb)
        return at

    for _ in range(rounds if len(y) else 0):
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        part = Trees(*(np.array(v) for v in (feature, threshold, left, right, value)), np.array([roots[-1]]), depth, 0.0)
        residual = residual - part.score(x)
    return Trees(*(np.array(v) for v in (feature, threshold, left, right, value)), np.array(roots, np.int64), depth, base)


SCHEMA = "words long, repeated_share double, " + ", ".join(f"{f} double" for f in FEATURES)
_SLACK = 1e-9
#: Texts that are measured together, so memory stays small.
TEXTS = 2000


def _measure(trees: Trees | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                n, share, x = statistics(part.column(1).to_pylist(), hashes)
                cols = [part.column(0), pa.array(n.astype(np.int64)), pa.array(share), *(pa.array(x[:, j]) for j in range(x.shape[1]))]
                names = ["id", "words", "repeated_share", *FEATURES]
                if trees is not None:
                    cols.append(pa.array(trees.score(x)))
                    names.append("score")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def gate(trees: Trees, share: float) -> float:
    """The least score of any text whose repeated share reaches ``share``.

    Each word of a repeated run of RUN words lies in a repeated run of SHORT_RUN
    words, and stands at an earlier place too, so it adds no distinct word. The
    trees are monotone in every statistic, so they score no such text below the
    one that just meets these two bounds and repeats nothing else.
    """
    corner = np.zeros((1, len(FEATURES)))
    corner[0, FEATURES.index("repeated_short_runs")] = share - _SLACK
    corner[0, FEATURES.index("distinct_share")] = 1 - share + _SLACK
    return float(trees.score(corner)[0]) - _SLACK


def _scored_cases(trees: Trees, share: float) -> Callable:
    """The ids of texts whose score passes the gate and whose exact share, worked out for these alone, reaches ``share``."""
    least = gate(trees, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                texts = part.column(1).to_pylist()
                flat, starts = _hashed(texts, hashes)
                n = np.diff(starts)
                passed = np.flatnonzero((n >= RUN) & (trees.score(_features(texts, flat, starts)) >= least))
                if not len(passed):
                    continue
                own = np.concatenate([flat[starts[i] : starts[i + 1]] for i in passed])
                found = repeated_shares(own, np.r_[0, np.cumsum(n[passed])]) >= share
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(passed[found]))], names=["id"])

    return run


def fit_on_sample(rows: DataFrame, id_type: str, sample: int = SAMPLE) -> Trees:
    """Trees that estimate the share of repeated words from the other statistics, fitted on about ``sample`` rows: those of least hash, whatever the partitioning."""
    n = rows.count()
    part = rows if n <= sample else rows.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    got = part.mapInArrow(_measure(None), f"id {id_type}, {SCHEMA}").orderBy(F.xxhash64("id", F.lit(17)), "id").limit(2 * sample).toPandas()
    return fit(got[FEATURES].to_numpy(np.float64), got["repeated_share"].to_numpy(np.float64), MONOTONE)


def _texts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), df.schema[id_col].dataType.simpleString()


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: Trees | None = None, sample: int = SAMPLE) -> DataFrame:
    """(id, words, repeated_share, the FEATURES, score) of every row.

    repeated_share is exact: the share of words that lie in a run of 8 words
    which also begins earlier in the text; score is the trees' estimate of it
    from the FEATURES. Null, empty and wordless texts have 0 words and shares of
    0, texts under 8 words a repeated_share of 0. Repeated rows each come out;
    other columns are not read; an empty table gives no rows.
    """
    rows, kind = _texts(df, id_col, text_col)
    trees = trees or fit_on_sample(rows, kind, sample)
    return rows.mapInArrow(_measure(trees), f"id {kind}, {SCHEMA}, score double").withColumnRenamed("id", id_col)


def repetitive(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, trees: Trees | None = None, sample: int = SAMPLE) -> DataFrame:
    """(id) of the rows whose score passes the gate and whose exact repeated share reaches the share, each id once.

    The gate holds for every text, not for the sample only, so no case is lost:
    trees that learned nothing let everything through to the exact share. Cases
    as for ``repetition``.
    """
    rows, kind = _texts(df, id_col, text_col)
    trees = trees or fit_on_sample(rows, kind, sample)
    return rows.mapInArrow(_scored_cases(trees, share), f"id {kind}").distinct().withColumnRenamed("id", id_col)
