"""Rows that fail to parse: valid rows typed, the rest with one reason each.

Records come one to a row. Those that hold a quote are checked for it one by one;
what is well quoted goes to the pyarrow CSV reader, whose invalid-row handler
reports records of the wrong width; all fields are read as strings, and vectors of
them are held against the feed's rules, column by column, before they are cast, so
that the failing cell is named. Records of different shapes never disturb one another.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTING, COLUMNS, VALUE = "quoting", "columns", "value"

#: Ids of papers: new style, or archive with an optional subject class and seven digits; either may carry a version.
ARXIV_ID = r"(?:[0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})(?:v[0-9]+)?"
INDEX = r"[0-9]{1,9}"

_BREAKS = {"\n": "", "\r": ""}


@dataclass(frozen=True)
class Feed:
    """A feed's separator, columns in order, the pattern that a column must match whole, and columns read as integers.

    not_blank: columns that must hold more than white space.
    same_row: columns whose pattern mentions other columns of the row as {name}.
    """

    separator: str
    columns: tuple[str, ...]
    patterns: dict[str, str] = field(default_factory=dict)
    integers: tuple[str, ...] = ()
    not_blank: tuple[str, ...] = ()
    same_row: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)


LABELS = Feed(
    "\t",
    ("arxiv_id", "section_index", "paragraph_index", "section_header", "paragraph", "label"),
    {"arxiv_id": ARXIV_ID, "section_index": INDEX, "paragraph_index": INDEX, "label": "[1-5]"},
    ("section_index", "paragraph_index", "label"),
    ("paragraph",),
)
REVIEW = Feed(
    ",",
    tuple(
        "connection_id arxiv_id condition reference_source reference_target reference_qualification predicted_source predicted_target relation qualifications evidence match review_notes".split()
    ),
    {"arxiv_id": ARXIV_ID, "condition": "paragraph|abstract_introduction|whole_paper", "match": "|yes|no|uncertain"},
    same_row={"connection_id": (r":[0-9]{1,9}:c[0-9]{1,9}", ("arxiv_id", "condition"))},
)
FEEDS = {"labels": LABELS, "review": REVIEW}


def _well_quoted(separator: str) -> Callable[[str], bool]:
    """Whether every field that starts with a quote closes it right before a separator or the end. One pass over each record, without backtracking."""
    sep = re.escape(separator)
    plain = re.compile(rf"[^{sep}]*")

    def check(record: str) -> bool:
        at, n = 0, len(record)
        while True:
            if at < n and record[at] == '"':
                at += 1
                while True:
                    at = record.find('"', at)
                    if at < 0:
                        return False
                    if record.startswith('""', at):
                        at += 2
                        continue
                    at += 1
                    break
                if at < n and record[at] != separator:
                    return False
            else:
                at = plain.match(record, at).end()
            if at >= n:
                return True
            at += 1

    return check


def _swap(text: str) -> str:
    return text.replace("\n", _BREAKS["\n"]).replace("\r", _BREAKS["\r"])


def _unswap(column: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(column, _BREAKS["\n"], "\n"), _BREAKS["\r"], "\r")


def _read(records: list[str], numbers: list[int], feed: Feed) -> tuple[pa.Table, list[int]]:
    """(the well-formed records as strings with their numbers, numbers of those of the wrong width)."""
    bad: list[int] = []

    def invalid(row: pcsv.InvalidRow) -> str:
        bad.append(int(row.text.split(feed.separator, 1)[0]))
        return "skip"

    names = ["__number", *feed.columns]
    body = "\n".join(f"{n}{feed.separator}{_swap(r)}" for n, r in zip(numbers, records, strict=True)) + "\n"
    got = pcsv.read_csv(
        io.BytesIO(body.encode("utf-8", "replace")),
        read_options=pcsv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, 2 * max(map(len, records), default=0) * 4)),
        parse_options=pcsv.ParseOptions(delimiter=feed.separator, quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=invalid),
        convert_options=pcsv.ConvertOptions(column_types={"__number": pa.int64(), **{c: pa.string() for c in feed.columns}}, strings_can_be_null=False, quoted_strings_can_be_null=False),
    )
    return got, bad


def _failing(rows: pa.Table, feed: Feed) -> np.ndarray:
    """Of each record the place of the first column whose cell breaks the feed's rules, taken exactly as written; -1 where none does."""
    first = np.full(rows.num_rows, -1)
    for place in range(len(feed.columns) - 1, -1, -1):
        name = feed.columns[place]
        column = rows.column(name).combine_chunks()
        good = []
        if name in feed.patterns:
            good.append(pc.match_substring_regex(column, rf"\A(?:{feed.patterns[name]})\z"))
        if name in feed.not_blank:
            good.append(pc.not_equal(pc.utf8_trim_whitespace(column), ""))
        if name in feed.same_row:
            tail, others = feed.same_row[name]
            end = pc.struct_field(pc.extract_regex(column, rf"(?P<tail>{tail})\z"), "tail")
            whole = pc.binary_join_element_wise(pc.binary_join_element_wise(*(rows.column(o).combine_chunks() for o in others), ":"), end, "")
            good.append(pc.fill_null(pc.equal(column, whole), False))
        for g in good:
            first[~np.asarray(g)] = place
    return first


#: (position, reason, column, value) of a record that cannot be read; column and value only where a cell is wrong.
Reject = tuple[int, str, str | None, str | None]


def _sorted_out(feed: Feed) -> Callable[[list[str | None]], tuple[pa.Table, list[Reject]]]:
    quoted = _well_quoted(feed.separator)

    def run(records: list[str | None]) -> tuple[pa.Table, list[Reject]]:
        """(rows of strings with __number = position, the rest)."""
        rejects: list[Reject] = []
        keep: list[int] = []
        odd: list[int] = []
        for i, record in enumerate(records):
            if record is None:
                rejects.append((i, COLUMNS, None, None))
            elif '"' in record and not quoted(record):
                rejects.append((i, QUOTING, None, None))
            elif "" in record or "" in record or "\x00" in record:
                odd.append(i)  # holds the stand-ins of line breaks itself, or a sign the reader stops at
            else:
                keep.append(i)
        rows, bad = _read([records[i] for i in keep], keep, feed) if keep else (pa.table({n: pa.array([], pa.int64() if n == "__number" else pa.string()) for n in ["__number", *feed.columns]}), [])
        rejects += [(i, COLUMNS, None, None) for i in bad]
        rows = rows.set_column(0, "__number", rows.column(0).combine_chunks())
        for c in feed.columns:
            at = rows.schema.get_field_index(c)
            rows = rows.set_column(at, c, _unswap(rows.column(c).combine_chunks()))
        if odd:
            fields = {i: _fields(records[i], feed.separator) for i in odd}
            rejects += [(i, COLUMNS, None, None) for i, f in fields.items() if len(f) != len(feed.columns)]
            fits = [i for i in odd if len(fields[i]) == len(feed.columns)]
            more = pa.table({"__number": pa.array(fits, pa.int64()), **{c: pa.array([fields[i][k] for i in fits], pa.string()) for k, c in enumerate(feed.columns)}})
            rows = pa.concat_tables([rows, more.cast(rows.schema)])
        failing = _failing(rows, feed)
        number = rows.column("__number").to_numpy()
        for place in np.unique(failing[failing >= 0]).tolist():
            at, name = np.flatnonzero(failing == place), feed.columns[place]
            rejects += [(int(i), VALUE, name, v) for i, v in zip(number[at], rows.column(name).take(pa.array(at)).to_pylist(), strict=True)]
        return rows.filter(pa.array(failing < 0)), rejects

    return run


def _fields(record: str, separator: str) -> list[str]:
    """The fields of one well-quoted record."""
    out, at = [], 0
    while True:
        if at < len(record) and record[at] == '"':
            end = at + 1
            while True:
                end = record.index('"', end)
                if record.startswith('""', end):
                    end += 2
                    continue
                break
            out.append(record[at + 1 : end].replace('""', '"'))
            at = end + 1
        else:
            end = record.find(separator, at)
            end = len(record) if end < 0 else end
            out.append(record[at:end])
            at = end
        if at >= len(record):
            return out
        at += 1


def _reject_batches(feeds: dict[str, Feed]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = {name: _sorted_out(feed) for name, feed in feeds.items()}
        for batch in batches:
            for name in feeds:
                own = batch.filter(pc.fill_null(pc.equal(batch.column(1), name), False))
                if not own.num_rows:
                    continue
                out = work[name](own.column(2).to_pylist())[1]
                ids = own.column(0).take(pa.array([r[0] for r in out], pa.int64()))
                cells = [pa.array([r[i] for r in out], pa.string()) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([ids, pa.array([name] * len(out), pa.string()), *cells], names=["line_id", "feed", "reason", "column", "value"])

    return run


def _valid_batches(feed: Feed) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _sorted_out(feed)
        for batch in batches:
            ids, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, _ = work(lines)
            number = rows.column("__number").to_pylist()
            cols = [pa.array([ids[i] for i in number], pa.int64())]
            for c in feed.columns:
                cols.append(rows.column(c).cast(pa.int32()).combine_chunks() if c in feed.integers else rows.column(c).combine_chunks())
            yield pa.RecordBatch.from_arrays(cols, names=["line_id", *feed.columns])

    return run


def _lines(df: DataFrame, feed: str | None = None) -> DataFrame:
    rows = df.select(F.col("line_id").cast("long").alias("line_id"), F.col("feed").cast("string").alias("feed"), F.col("line").cast("string").alias("line"))
    return rows if feed is None else rows.where(F.col("feed") == feed).drop("feed")


def rejected_cells(df: DataFrame, feeds: dict[str, Feed] | None = None) -> DataFrame:
    """(line_id, feed, reason, column, value) of every record that cannot be read: quoting, columns or value, the first that applies.

    column and value name the first failing cell, in the feed's order, of a record
    rejected for its values, and are null otherwise. A null record has no fields:
    columns. An empty one has one empty field. A header row is a record like any
    other, so its values are wrong. A feed that is null or not listed has no
    rules, and its rows come out neither here nor among the valid ones. Line breaks
    are text inside a record. Repeated line_ids each come out; other columns are
    not read; no rows give no rows.
    """
    return _lines(df).mapInArrow(_reject_batches(feeds or FEEDS), "line_id long, feed string, reason string, column string, value string")


def rejected(df: DataFrame, feeds: dict[str, Feed] | None = None) -> DataFrame:
    """(line_id, reason) of every record that cannot be read; cases as in ``rejected_cells``."""
    return rejected_cells(df, feeds).select("line_id", "reason")


def valid_rows(df: DataFrame, name: str, feed: Feed | None = None) -> DataFrame:
    """(line_id, the feed's columns, typed) of one feed's records that can be read; cases as in ``rejected``."""
    feed = feed or FEEDS[name]
    schema = ", ".join(f"`{c}` {'int' if c in feed.integers else 'string'}" for c in feed.columns)
    return _lines(df, name).mapInArrow(_valid_batches(feed), f"line_id long, {schema}")
