"""Metadata records of papers: JSON lines, filtered and projected, and other sources of paper lists."""

from __future__ import annotations

import datetime as dt
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions.text import collapsed, without_version

RECORD = (
    "id string, title string, abstract string, categories string, authors string, doi string, "
    "authors_parsed array<array<string>>, versions array<struct<version: string, created: string>>"
)
#: Fixed value: where a paper's page lies.
PAGE = "https://arxiv.org/abs/"


def zip_member_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, position, value): the lines of the single member of each ZIP archive, streamed by one task per archive; another number of members is an error.

    Paths are of any file system that pyarrow opens by their scheme, or mounted everywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
                with system.open_input_file(name) as file, zipfile.ZipFile(file) as z:
                    members = [m for m in z.infolist() if not m.is_dir()]
                    if len(members) != 1:
                        raise ValueError(f"{path}: expected one member, found {len(members)}")
                    with z.open(members[0]) as lines:
                        held, start, n = [], 0, 0
                        for raw in lines:
                            held.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
                            n += 1
                            if len(held) == 10_000:
                                yield _lines(path, start, held)
                                held, start = [], n
                        yield _lines(path, start, held)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path").mapInArrow(run, "path string, position long, value string")


def _lines(path: str, start: int, held: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array(range(start, start + len(held)), pa.int64()), pa.array(held, pa.string())], names=["path", "position", "value"])


def parse_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines with column record: the parsed JSON, null where a line is blank, broken or no object."""
    return lines.withColumn("record", F.from_json(value, RECORD, {"mode": "PERMISSIVE"}))


def first_created(record: Column) -> Column:
    """Time stamp of the first version, in the stamp's own zone; null if missing or unreadable."""
    text = F.regexp_extract(F.get(record["versions"], F.lit(0))["created"], r"([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
    return F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss"))


def author_names(record: Column) -> Column:
    """Surname and first name of each parsed author; without those, the authors text cut at commas."""
    parsed = F.transform(record["authors_parsed"], lambda a: F.array_join(F.filter(F.slice(a, 1, 2), lambda x: F.trim(x) != ""), " "))
    plain = F.transform(F.split(record["authors"], ","), lambda x: collapsed(x))
    return F.filter(F.when(F.size(record["authors_parsed"]) > 0, parsed).otherwise(F.coalesce(plain, F.array().cast("array<string>"))), lambda x: x != "")


def project_record(record: Column) -> list[Column]:
    """A record's columns as a paper."""
    identity = collapsed(record["id"])
    return [
        identity.alias("arxiv_id"),
        collapsed(record["title"]).alias("title"),
        collapsed(record["abstract"]).alias("abstract"),
        author_names(record).alias("authors"),
        first_created(record).alias("publication_date"),
        F.split(F.trim(record["categories"]), r"\s+")[0].alias("primary_category"),
        F.concat(F.lit(PAGE), identity).alias("url"),
        F.coalesce(collapsed(record["doi"]), F.lit("")).alias("doi"),
    ]


def in_categories(categories: Column, wanted: list[str]) -> Column:
    """Any exact token of the blank-separated list, without case; no wanted category lets all through."""
    names = [w.strip().lower() for w in wanted if w.strip()]
    return F.lit(True) if not names else F.arrays_overlap(F.split(F.lower(F.trim(categories)), r"\s+"), F.array(*map(F.lit, names)))


def has_keyword(title: Column, abstract: Column, wanted: list[str]) -> Column:
    """Any keyword as a part of title or abstract, without case."""
    names = [w.strip().lower() for w in wanted if w.strip()]
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(abstract, F.lit(""))))
    out = F.lit(not names)
    for w in names:
        out = out | F.contains(text, F.lit(w))
    return out


def is_math_or_cs(categories: Column) -> Column:
    return F.coalesce(F.exists(F.split(F.trim(categories), r"\s+"), lambda c: c.startswith("cs.") | c.startswith("math.")), F.lit(False))


def select_records(
    lines: DataFrame,
    categories: list[str] | None = None,
    keywords: list[str] | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
    max_results: int | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Papers of the JSON lines that pass every filter, in input order when a limit is given.

    Categories, then keywords, then the inclusive day of the first version. Lines
    that are no object, and records without id, title, categories, versions or a
    readable first time stamp are dropped, and do not count toward the limit.
    """
    if max_results is not None and max_results < 0:
        raise ValueError("the limit must not be negative")
    if start and end and start > end:
        raise ValueError("the first day comes after the last")
    for day in (start, end):
        if day is not None and (not isinstance(day, dt.date) or isinstance(day, dt.datetime)):
            raise TypeError("days must be dates")
    rows = parse_records(lines).where("record is not null")
    r = F.col("record")
    rows = rows.where(in_categories(r["categories"], categories or []) & has_keyword(r["title"], r["abstract"], keywords or []))
    rows = rows.where(first_created(r).isNotNull() & r["id"].isNotNull() & r["title"].isNotNull() & (F.trim(r["categories"]) != ""))
    day = first_created(r).cast("date")
    if start:
        rows = rows.where(day >= F.lit(start))
    if end:
        rows = rows.where(day <= F.lit(end))
    kept = order or []
    rows = rows.select(*kept, *project_record(r))
    if max_results is not None:
        rows = rows.orderBy(*kept).limit(max_results) if kept else rows.limit(max_results)
    return rows.drop(*kept)


def first_record_wins(papers: DataFrame, order: list[Column], id_col: str = "arxiv_id") -> DataFrame:
    """Ids lose their version; the first record of each id stays."""
    rows = papers.withColumn("__position", F.struct(*order)).withColumn(id_col, without_version(F.col(id_col)))
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(id_col).orderBy("__position"))).where("__r = 1").drop("__r", "__position")


def parse_id_lines(lines: DataFrame, value: str = "value", position: str = "position") -> DataFrame:
    """(arxiv_id, position): ids separated by white space or commas, without what follows a # sign, each at its first place."""
    ids = F.filter(F.split(F.regexp_replace(value, "#.*", ""), r"[\s,]+"), lambda x: x != "")
    return lines.select(position, F.posexplode(ids).alias("k", "arxiv_id")).groupBy("arxiv_id").agg(F.min(F.struct(position, "k")).alias("p")).select("arxiv_id", F.col(f"p.{position}").alias(position))


def write_subset(lines: DataFrame, path: str, value: str = "value") -> None:
    """Writes the lines of mathematics and computer science, unchanged; lines that are no object are left out."""
    rows = parse_records(lines, value)
    rows.where(is_math_or_cs(F.col("record")["categories"])).select(F.col(value).alias("value")).write.mode("errorifexists").text(path)


def iso_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def from_iso(text: Column) -> Column:
    """A time in ISO form with or without a zone; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def within_days(at: Column, last: Column, days: int) -> Column:
    """Whether a time lies on ``last`` or one of the ``days`` days before it."""
    if days < 0:
        raise ValueError("days must not be negative")
    return at.cast("date").between(F.date_sub(last, days), last)
