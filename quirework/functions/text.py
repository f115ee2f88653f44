"""String expressions shared by sources and projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(c: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " "))


def without_version(arxiv_id: Column) -> Column:
    return F.regexp_replace(arxiv_id, r"v[0-9]+$", "")


def bare_arxiv_id(value: Column) -> Column:
    """The id of a bare id or of an abs or pdf address; null for anything else."""
    body = F.regexp_extract(F.trim(value), r"^(?:https?://[^/\s]+/(?:abs|pdf)/)?((?:[0-9]{4}\.[0-9]{4,5}|[A-Za-z.-]+/[0-9]{7})(?:v[0-9]+)?)(?:\.pdf)?/?$", 1)
    return F.when(body != "", body)


def quoted_path(c: Column) -> Column:
    """Percent-encoded as one path segment: a blank becomes %20, a slash %2F."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def labelled_paragraph(header: Column, text: Column) -> Column:
    """The text a paragraph is scored by."""
    return F.concat(F.lit("Section: "), F.coalesce(header, F.lit("")), F.lit(" Text: "), F.coalesce(text, F.lit("")))


def without_comments(latex: Column) -> Column:
    """LaTeX without unescaped percent signs and what follows them on their line."""
    return F.regexp_replace(latex, r"(?m)(?<!\\)%.*", "")


def without_verbatim(latex: Column) -> Column:
    return F.regexp_replace(latex, r"(?is)\\begin\{(?:verbatim|lstlisting|minted)\}.*?\\end\{(?:verbatim|lstlisting|minted)\}", " ")


def document_body(latex: Column) -> Column:
    """What lies between the document environment's ends, as far as they are there."""
    begin, end = "\\begin{document}", "\\end{document}"
    rest = F.when(F.contains(latex, F.lit(begin)), F.substring(latex, F.locate(begin, latex) + len(begin), F.length(latex))).otherwise(latex)
    return F.when(F.contains(rest, F.lit(end)), F.substring(rest, F.lit(1), F.locate(end, rest) - 1)).otherwise(rest)


def split_paragraphs(text: Column) -> Column:
    """The paragraphs of a source: cut at blank lines and \\par, without blank ones; null for null."""
    return F.filter(F.split(text, r"\r?\n\r?\n|\\par\b"), lambda p: F.trim(p, F.lit(" \t\n\r")) != "")
