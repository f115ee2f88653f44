"""Metadata of papers from Atom feeds, as a service of papers answers."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

# The name spaces of the feed and of the paper's own elements.
ATOM = "{http://www.w3.org/2005/Atom}"
PAPER = "{http://arxiv.org/schemas/atom}"

SCHEMA = "arxiv_id string, title string, abstract string, authors array<string>, publication_date timestamp, primary_category string, url string, doi string, problem string"


def _text(entry: ElementTree.Element, name: str) -> str:
    return " ".join((entry.findtext(name) or "").split())


def parse_entry(response: str | None) -> dict:
    """The first entry of a feed as the columns of SCHEMA; ``problem`` says what is missing, and then nothing else is given.

    The id is that of the page's address without its version; the first author
    names without blanks at their ends count; a time without a zone is UTC.
    """
    try:
        entry = ElementTree.fromstring(response or "").find(f"{ATOM}entry")
    except ElementTree.ParseError:
        return {"problem": "no XML"}
    if entry is None:
        return {"problem": "no entry"}
    page = _text(entry, f"{ATOM}id")
    arxiv_id = re.sub(r"v[0-9]+$", "", page.partition("/abs/")[2] if "/abs/" in page else page.rsplit("/", 1)[-1])
    published = _text(entry, f"{ATOM}published")
    try:
        date = dt.datetime.fromisoformat(published.replace("Z", "+00:00"))
    except ValueError:
        date = None
    authors = [name for a in entry.findall(f"{ATOM}author") if (name := _text(a, f"{ATOM}name"))]
    category = entry.find(f"{PAPER}primary_category")
    links = (link.get("href", "").strip() for link in entry.findall(f"{ATOM}link") if link.get("rel", "alternate") == "alternate")
    out = {
        "arxiv_id": arxiv_id,
        "title": _text(entry, f"{ATOM}title"),
        "abstract": _text(entry, f"{ATOM}summary"),
        "authors": authors,
        "publication_date": date if date is None or date.tzinfo else date.replace(tzinfo=dt.UTC),
        "primary_category": (category.get("term", "") if category is not None else "").strip(),
        "url": next((u for u in links if u), page),
    }
    for name, value in out.items():
        if not value:
            return {"problem": f"no {name}"}
    return {**out, "doi": _text(entry, f"{PAPER}doi")}


def parse_feeds(responses: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and those of SCHEMA of each response; a response that cannot be used has a problem instead of failing the job."""
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.string(), pa.string()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            rows = [parse_entry(v) for v in batch.column(batch.num_columns - 1).to_pylist()]
            data = [pa.array([r.get(n) for r in rows], kind) for n, kind in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *data], names=[*keep, *names])

    schema = "".join(f"`{c}` {responses.schema[c].dataType.simpleString()}, " for c in keep)
    return responses.select(*keep, value).mapInArrow(run, schema + SCHEMA)
