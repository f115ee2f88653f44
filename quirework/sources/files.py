"""Files of papers: labelled tables, source archives, coordinates, vector tables, resumable outputs."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirework.functions import distributions as D
from quirework.functions import latex as L
from quirework.functions.text import labelled_paragraph

CLASS_COLUMNS = [f"probability_{c}" for c in "ABCDE"]
COORDINATES = "arxiv_id string, umap_x string, umap_y string"
MEMBERSHIPS = "cluster_id string, arxiv_id string, title string, certainty string"
#: Fixed value: names of TeX files end so.
TEX_SUFFIXES = (".tex", ".ltx")


def read_table(spark: SparkSession, path: str, schema: StructType | str, required: list[str], sep: str = ",") -> DataFrame:
    """A delimited file with named headers and quoted fields that may hold line breaks; a missing required column is an error."""
    rows = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"{path}: columns are missing: {', '.join(missing)}")
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))


def labelled_paragraphs(rows: DataFrame) -> DataFrame:
    """(arxiv_id, input, distribution) of rows with section_header, paragraph, label and maybe arxiv_id and the five probabilities.

    Soft labels, if all five columns are there, win over the label; some of them
    only is an error. Blank paragraphs are left out before labels are looked at. A
    label that is not one of 1 to 5, and an invalid distribution, end the query
    with an error.
    """
    soft = [c for c in CLASS_COLUMNS if c in rows.columns]
    if soft and len(soft) < len(CLASS_COLUMNS):
        raise ValueError("either all or none of the probability columns are needed")
    if not soft and "label" not in rows.columns:
        raise ValueError("there is neither a label nor probabilities")
    rows = rows.where(F.trim(F.coalesce("paragraph", F.lit(""))) != "")
    if "label" in rows.columns:
        n = F.expr("try_cast(trim(label) as double)")
        hard = F.when(n.isin(1.0, 2.0, 3.0, 4.0, 5.0), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda c: (c == n).cast("double"))).otherwise(
            F.raise_error(F.concat(F.lit("not a label: "), F.coalesce("label", F.lit("null")))).cast("array<double>")
        )
    dist = D.normalised(F.array(*(F.expr(f"try_cast({c} as double)") for c in CLASS_COLUMNS))) if soft else hard
    key = F.col("arxiv_id") if "arxiv_id" in rows.columns else F.lit(None).cast("string")
    return rows.select(key.alias("arxiv_id"), labelled_paragraph(F.trim("section_header"), F.trim("paragraph")).alias("input"), dist.alias("distribution"))


def decoded(raw: bytes) -> str:
    """UTF-8, and Latin-1 where that fails."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def tex_files(raw: bytes, name: str, depth: int = 3) -> Iterator[tuple[str, str]]:
    """(file name, text) of every TeX file of a payload: a tar or zip archive, a gzip of any of these, or plain text."""
    if depth and raw[:2] == b"\x1f\x8b":
        yield from tex_files(gzip.decompress(raw), name, depth - 1)
        return
    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for m in z.infolist():
                if m.filename.lower().endswith(TEX_SUFFIXES):
                    yield m.filename, decoded(z.read(m))
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for m in t.getmembers():
                if m.isfile() and m.name.lower().endswith(TEX_SUFFIXES):
                    yield m.name, decoded(t.extractfile(m).read())
        return
    except tarfile.TarError:
        pass
    if b"\x00" not in raw[:1024] and not raw.startswith(b"%PDF"):
        yield f"{name}.tex", decoded(raw)


PAPER_SECTIONS = "arxiv_id string, section_index int, section_header string, major_section_header string, text array<string>, raw_latex string, problem string"


def _parsed(include_proofs: bool, chunker: Callable[[str], list[str]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, raw in zip(batch.column("arxiv_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    sources = {n.replace("\\", "/").removeprefix("./"): t for n, t in tex_files(raw or b"", name)}
                    main = L.main_file(sources)
                    major = ""
                    for i, (kind, title, text) in enumerate(L.sections(L.expanded(main, sources)) if main else []):
                        head = L.tidy(L.prose(title))
                        major = head if kind in L.MAJOR_KINDS else major
                        parts = L.paragraphs(text if include_proofs else L.without_proofs(text))
                        parts = [c for p in parts for c in chunker(p) if c.strip()] if chunker else parts
                        out.append((name, i, head, major, parts, text, None))
                    if not main:
                        out.append((name, None, None, None, None, None, "no TeX source"))
                except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, RuntimeError) as e:
                    out.append((name, None, None, None, None, None, f"unreadable archive: {type(e).__name__}"))
            schema = pa.schema([("arxiv_id", pa.string()), ("section_index", pa.int32()), ("section_header", pa.string()), ("major_section_header", pa.string()), ("text", pa.list_(pa.string())), ("raw_latex", pa.string()), ("problem", pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def sections_of_archives(archives: DataFrame, include_proofs: bool = False, chunker: Callable[[str], list[str]] | None = None) -> DataFrame:
    """Sections of source archives. archives: (arxiv_id, content binary), as spark.read.format('binaryFile') gives it.

    chunker: what cuts a paragraph further; blank pieces go.

    An archive that cannot be read or holds no TeX gives one row with ``problem``
    instead of failing the job. Headers of subsections carry the last part,
    chapter or section header as their major header.
    """
    return archives.select("arxiv_id", "content").mapInArrow(_parsed(include_proofs, chunker), PAPER_SECTIONS)


def still_to_fetch(wanted: DataFrame, stored: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Ids that no stored row has, each once."""
    return wanted.select(key).distinct().join(stored.select(key), key, "left_anti")


def finite_coordinates(rows: DataFrame) -> DataFrame:
    """(arxiv_id, x, y) as numbers; a missing, non-numeric or infinite coordinate ends the query with an error."""
    x, y = F.expr("try_cast(umap_x as double)"), F.expr("try_cast(umap_y as double)")
    fine = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    ok = F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no finite coordinates: "), "arxiv_id")).cast("boolean"))
    return rows.where(ok).select("arxiv_id", x.alias("x"), y.alias("y"))
