"""Problem 2: oversized texts cut into overlapping pieces at natural boundaries.

Bytes are read range by range, each range with a halo so that a boundary at its
edge is seen as in the whole. A range gives its table of boundaries and its length
in code points; the tables are stitched, and prefix sums of the lengths place them.
Pieces are then planned on positions alone and emitted by offset. The texts of an
Arrow batch are one such byte sequence, a file of any size is another; neither is
ever decoded as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.scratch import Scratch

MAX_LENGTH = 1500
#: A piece begins with the last so many characters of the one before.
OVERLAP = (100, 200)
#: Bytes of one range, and of the halo on each side of it: more than the longest sign of a boundary, a blank line of up to 4 blanks, has.
RANGE = 1 << 16
HALO = 16

#: Kinds of boundaries, the better the larger.
WORD_END, SENTENCE_END, LINE_END, PARAGRAPH_END = 1, 2, 3, 4
#: Stands between texts of one byte sequence; part of no boundary.
GAP = b"\0"


def _is(*values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_BLANK = _is(*range(9, 14), *range(28, 33))
_STOP, _CLOSING, _SPACE = _is(*b".!?"), _is(*b"\"')]"), _is(*b" \t")


def _three(w: np.ndarray, n: int, a: int, b: int, last) -> np.ndarray:
    """Whether a character of the bytes a, b and one of ``last`` begins at each of n places."""
    return (w[:n] == a) & (w[1 : n + 1] == b) & last[w[2 : n + 2]]


def range_table(window: bytes, begin: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(byte positions, their code points from lo, kinds, code points) of the range lo to hi: a piece may end before each position p, lo < p <= hi.

    window holds the bytes from ``begin`` on: the range with its halos. A word
    ends before white space, a sentence at a full stop, question or exclamation
    mark or ellipsis, with at most one closing sign, before white space, or at
    its Chinese form; a line after a line feed, a paragraph after a blank line.
    """
    n = len(window)
    w = np.zeros(n + 2, np.uint8)
    w[:n] = np.frombuffer(window, np.uint8)
    own = w[:n]
    blank = _BLANK[own]
    if (own > 127).any():
        wide = (own == 0xC2) & _is(0x85, 0xA0)[w[1 : n + 1]]
        wide[1:] |= wide[:-1].copy()
        long = _three(w, n, 0xE2, 0x80, _is(*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)) | _three(w, n, 0xE2, 0x81, _is(0x9F)) | _three(w, n, 0xE3, 0x80, _is(0x80)) | _three(w, n, 0xE1, 0x9A, _is(0x80))
        wide |= long
        wide[1:] |= long[:-1]
        wide[2:] |= long[:-2]
        blank |= wide
        chinese = _three(w, n, 0xE3, 0x80, _is(0x82)) | _three(w, n, 0xEF, 0xBC, _is(0x81, 0x9F))
        dots, quotes = _three(w, n, 0xE2, 0x80, _is(0xA6)), _three(w, n, 0xE2, 0x80, _is(0x9D, 0x99))
    else:
        chinese = dots = quotes = np.zeros(n, bool)
    kind = np.zeros(n + 3, np.int8)  # of the position after each byte's index
    ends = np.flatnonzero(blank & ~np.r_[True, blank[:-1]])  # where white space begins
    kind[ends] = WORD_END
    stop = _STOP[own]
    stopped = np.zeros(n + 3, bool)  # a stop ends right before this place
    stopped[1 : n + 1] |= stop
    stopped[3 : n + 3] |= dots
    closed = np.zeros(n + 3, bool)
    closed[1 : n + 1] |= stopped[:n] & _CLOSING[own]
    closed[3 : n + 3] |= stopped[:n] & quotes
    kind[ends[stopped[ends] | closed[ends]]] = SENTENCE_END
    after = np.flatnonzero(chinese) + 3
    kind[after] = np.maximum(kind[after], SENTENCE_END)
    feeds = np.flatnonzero(own == 10)
    if len(feeds):
        kind[feeds + 1] = LINE_END
        back = feeds - 1
        back = np.where((back >= 0) & (own[np.maximum(back, 0)] == 13), back - 1, back)
        for _ in range(4):
            back = np.where((back >= 0) & _SPACE[own[np.maximum(back, 0)]], back - 1, back)
        kind[feeds[(back >= 0) & (own[np.maximum(back, 0)] == 10)] + 1] = PARAGRAPH_END
    start = (own & 0xC0) != 0x80
    at = np.flatnonzero(kind[lo - begin + 1 : hi - begin + 1]) + lo - begin + 1
    points = np.cumsum(start[lo - begin : hi - begin])
    return at + begin, points[at - (lo - begin) - 1], kind[at], int(points[-1]) if len(points) else 0


class Stitched:
    """The boundary tables of a byte sequence's ranges, joined; prefix sums of the ranges' lengths give code points."""

    def __init__(self, data: bytes, size: int = RANGE):
        self.data = data
        self.lows = np.arange(0, max(len(data), 1), size)
        tables = []
        for lo in self.lows.tolist():
            hi = min(lo + size, len(data))
            begin = max(0, lo - HALO)
            tables.append(range_table(data[begin : hi + HALO], begin, lo, hi))
        self.base = np.r_[0, np.cumsum([t[3] for t in tables])].astype(np.int64)
        self.at = np.concatenate([t[0] for t in tables]).astype(np.int64)
        self.points = np.concatenate([t[1] + b for t, b in zip(tables, self.base[:-1], strict=True)]).astype(np.int64)
        self.kinds = np.concatenate([t[2] for t in tables])
        self.size = size

    def point(self, byte: int) -> int:
        """Code points before a byte at which a character starts."""
        r = min(byte // self.size, len(self.lows) - 1)
        lo = int(self.lows[r])
        return int(self.base[r] + ((np.frombuffer(self.data[lo:byte], np.uint8) & 0xC0) != 0x80).sum())

    def byte(self, point: int) -> int:
        """Where the code point of this number starts; the end of the data if there is none."""
        i = int(np.searchsorted(self.points, point))
        if i < len(self.points) and self.points[i] == point:
            return int(self.at[i])
        r = int(np.searchsorted(self.base, point, "right")) - 1
        if r >= len(self.lows):
            return len(self.data)
        lo = int(self.lows[r])
        starts = np.flatnonzero((np.frombuffer(self.data[lo : lo + self.size], np.uint8) & 0xC0) != 0x80)
        return lo + int(starts[point - self.base[r]])

    def pieces(self, lo: int, hi: int, most: int, overlap: tuple[int, int]) -> list[tuple[int, int, int, int]]:
        """(start, end, start byte, end byte) of the pieces of the text at the bytes lo to hi; start and end are its own code points."""
        first, last = self.point(lo), self.point(hi)
        i, j = np.searchsorted(self.at, [lo, hi], "right")
        cut = plan(last - first, self.points[i:j] - first, self.kinds[i:j], most, overlap)
        return [(s, e, lo if s == 0 else self.byte(first + s), hi if e == last - first else self.byte(first + e)) for s, e in cut]


def boundaries(text: str, size: int = RANGE) -> tuple[np.ndarray, np.ndarray]:
    """(code points, kinds) of one text's boundaries; the same for every range size."""
    whole = Stitched(text.encode("utf-8", "surrogatepass"), size)
    return whole.points, whole.kinds


def plan(length: int, at: np.ndarray, kind: np.ndarray, most: int = MAX_LENGTH, overlap: tuple[int, int] = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece of a text of this length; one piece if it fits.

    A piece ends at the last of the best boundaries in its second half, or at the
    limit if there is none; the next begins after the last sentence or word end
    that leaves an overlap within bounds, or in the middle of the bounds.
    """
    if not 0 < overlap[0] <= overlap[1] < most // 2:
        raise ValueError("overlap must lie between 1 and half the limit")
    out, start = [], 0
    while length - start > most:
        lo, hi = start + most // 2, start + most
        i, j = np.searchsorted(at, [lo, hi], "right")
        end = int(at[i:j][np.flatnonzero(kind[i:j] == kind[i:j].max())[-1]]) if i < j else hi
        out.append((start, end))
        i, j = np.searchsorted(at, [end - overlap[1], end - overlap[0] + 1], "left")
        start = int(at[i:j][np.flatnonzero(kind[i:j] == kind[i:j].max())[-1]]) if i < j else end - sum(overlap) // 2
    out.append((start, length))
    return out


def split(text: str, most: int = MAX_LENGTH, overlap: tuple[int, int] = OVERLAP, size: int = RANGE) -> list[tuple[int, int]]:
    if len(text) <= most:
        return [(0, len(text))]
    at, kind = boundaries(text, size)
    return plan(len(text), at, kind, most, overlap)


def _string(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary()).cast(pa.string(), safe=False)


def _pieces(most: int, overlap: tuple[int, int], size: int, with_text: bool) -> Callable:
    """Pieces of the texts of each batch, read as one byte sequence of many ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            if not rows:
                continue
            whole = Stitched(GAP.join(rows), size)
            row, cut, at = [], [], 0
            for i, own in enumerate(rows):
                more = [(k, *p) for k, p in enumerate(whole.pieces(at, at + len(own), most, overlap))]
                cut += more
                row += [i] * len(more)
                at += len(own) + len(GAP)
            index, start, end, lo, hi = zip(*cut, strict=True)
            keep = [batch.column(c).take(pa.array(row, pa.int64())) for c in range(batch.num_columns - 1)]
            out = [pa.array(index, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
            if with_text:
                out.append(_string([whole.data[a:b] for a, b in zip(lo, hi, strict=True)]))
            names = [*batch.schema.names[:-1], "piece_index", "start", "end"] + (["piece"] if with_text else [])
            yield pa.RecordBatch.from_arrays(keep + out, names=names)

    return run


def split_texts(
    df: DataFrame, keys: list[str], text_col: str, most: int = MAX_LENGTH, overlap: tuple[int, int] = OVERLAP, size: int = RANGE, with_text: bool = True
) -> DataFrame:
    """(keys..., piece_index, start, end, piece) of every text of more than ``most`` code points.

    start and end are code point offsets, end exclusive. Null, empty and fitting
    texts give no rows; repeated rows and null keys come out as they are; other
    columns are not read. A text without any boundary is cut at the limit. No
    shuffle: short texts are filtered before Python sees them.
    """
    rows = df.select(*keys, F.col(text_col).cast("string").alias("__text")).where(F.length("__text") > most)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(_pieces(most, overlap, size, with_text), f"{schema}, piece_index int, start long, end long" + (", piece string" if with_text else ""))


def oversized_paragraphs(sections: DataFrame, paragraphs: DataFrame, with_text: bool = True, most: int = MAX_LENGTH) -> DataFrame:
    """(table_name, arxiv_id, section_index, paragraph_index, piece_index, start, end, piece) of both tables' oversized paragraphs, repeated rows once."""
    key = ["table_name", "arxiv_id", "section_index", "paragraph_index"]
    a = sections.select(F.lit("sections").alias("table_name"), "arxiv_id", "section_index", F.posexplode("text").alias("paragraph_index", "text"))
    b = paragraphs.select(F.lit("paragraphs").alias("table_name"), "arxiv_id", F.col("section_index").cast("int"), F.col("paragraph_index").cast("int"), "text")
    rows = a.unionByName(b).where(F.length("text") > most).dropDuplicates(key)
    return split_texts(rows, key, "text", most, with_text=with_text)


# Files: byte ranges in parallel.

_LEAD = 4  # bytes of the longest UTF-8 character


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is one that every machine mounts."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class _Reader:
    """Byte ranges of one file at a time."""

    def __init__(self) -> None:
        self.path: str | None = None

    def __call__(self, path: str, lo: int, hi: int) -> bytes:
        if path != self.path:
            system, name = _file(path)
            self.path, self.file = path, system.open_input_file(name)
            self.size = self.file.size()
        lo, hi = max(0, lo), min(hi, self.size)
        return self.file.read_at(hi - lo, lo) if hi > lo else b""

    def aligned(self, path: str, at: int) -> int:
        """The first character start at or after a byte."""
        part = self(path, at, at + _LEAD)
        return next((at + i for i, byte in enumerate(part) if byte & 0xC0 != 0x80), at + len(part))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0).to_pylist()
        sizes = [system.get_file_info(name).size for system, name in map(_file, paths)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "size"])


def _ranges(most: int):
    """(path, no, lo, hi, chars, anchor, anchor_byte): anchor is the range's first best boundary in its first pieces, in code points from its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader()
        for batch in batches:
            out: list[tuple] = []
            for path, no, lo, hi in zip(*(batch.column(n).to_pylist() for n in ("path", "no", "lo", "hi")), strict=True):
                lo, hi = read.aligned(path, lo), read.aligned(path, hi)
                begin = max(0, lo - HALO)
                at, points, kind, chars = range_table(read(path, begin, hi + HALO), begin, lo, hi)
                anchor, byte = 0, lo
                near = points <= 4 * most
                if no and near.any():
                    k = int(np.flatnonzero(near & (kind == kind[near].max()))[0])
                    anchor, byte = int(points[k]), int(at[k])
                out.append((path, no, lo, hi, chars, anchor, byte))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 0 else pa.int64()) for i in range(7)], names=["path", "no", "lo", "hi", "chars", "anchor", "anchor_byte"])

    return run


def _file_pieces(most: int, overlap: tuple[int, int], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader()
        for batch in batches:
            for r in batch.to_pylist():
                path, start, end = r["path"], r["anchor_byte"], r["next_byte"] if r["next_byte"] is not None else r["hi"]
                if start >= end:
                    continue
                first, lead = r["offset"] + r["anchor"], 0
                if first:  # the halo before: the overlap with the piece that ends at the anchor
                    back = read.aligned(path, max(0, start - _LEAD * overlap[1]))
                    before = Stitched(read(path, back, start), size)
                    lead = min(int(before.base[-1]), sum(overlap) // 2)
                    start = back + before.byte(int(before.base[-1]) - lead)
                whole = Stitched(read(path, start, end), size)
                cut = whole.pieces(0, len(whole.data), most, overlap)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(cut)),
                        pa.array([first - lead + s for s, *_ in cut], pa.int64()),
                        pa.array([first - lead + e for _, e, *_ in cut], pa.int64()),
                        _string([whole.data[a:b] for *_, a, b in cut]),
                    ],
                    names=["path", "start", "end", "piece"],
                )

    return run


def split_files(spark: SparkSession, paths: list[str], range_bytes: int = 1 << 24, most: int = MAX_LENGTH, overlap: tuple[int, int] = OVERLAP, per_task: int = 4) -> DataFrame:
    """(path, start, end, piece) of UTF-8 files of any size, in code point offsets; a piece starts inside the one before, except a file's first.

    Each range is read alone, with a halo. A first pass gives its length in code
    points and its anchor, the first best boundary, where one range's pieces end
    and the next one's begin; lengths are summed over the table of ranges, which is
    a DataFrame. Empty files give no rows; a file given twice is split once. Paths
    are of any file system that pyarrow opens by their scheme, or mounted everywhere.
    """
    if range_bytes < 8 * most:
        raise ValueError("a range must hold several pieces")
    files = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string").mapInArrow(_sizes, "path string, size long").where("size > 0")
    step = F.lit(range_bytes)
    listed = files.select("path", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)).alias("no", "lo"))
    listed = listed.select("path", F.col("no").cast("long").alias("no"), "lo", F.least(F.col("lo") + step, F.col("size")).alias("hi"))
    total = files.agg(F.sum(F.ceil(F.col("size") / step))).head()[0] or 0
    tasks = int(max(1, -(-total // per_task)))
    found = listed.repartition(tasks, "path", "no").mapInArrow(_ranges(most), "path string, no long, lo long, hi long, chars long, anchor long, anchor_byte long")
    order = Window.partitionBy("path").orderBy("no")
    table = (
        found.withColumn("offset", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("offset", F.coalesce("offset", F.lit(0)))
        .withColumn("next_byte", F.lead("anchor_byte").over(order))
    )
    return table.repartition(tasks, "path", "no").mapInArrow(_file_pieces(most, overlap, min(range_bytes, RANGE)), "path string, start long, end long, piece string")


#: Rows of one file of ``text_files``, on average.
FILE_ROWS = 20_000


def text_files(sections: DataFrame, scratch: Scratch, rows: int = FILE_ROWS) -> list[str]:
    """Paths of files that hold all paragraphs of all sections, a line each, in order of paper, section and place; a paper lies in one file, each section once."""
    lines = sections.select("arxiv_id", "section_index", "text").dropDuplicates(["arxiv_id", "section_index"]).select("arxiv_id", "section_index", F.posexplode("text").alias("place", "value"))
    lines = lines.where("value is not null")
    n = max(1, -(-lines.count() // rows))
    lines = lines.withColumn("file", F.pmod(F.xxhash64("arxiv_id"), F.lit(n)).cast("int"))
    folder = f"{scratch.root}/files"
    lines.repartition(int(min(n, 10_000)), "file").sortWithinPartitions("file", "arxiv_id", "section_index", "place").select("file", "value").write.partitionBy("file").text(folder)
    system, name = _file(folder)
    return [folder[: len(folder) - len(name)] + f.path for f in system.get_file_info(pafs.FileSelector(name, recursive=True)) if f.path.endswith(".txt")]
