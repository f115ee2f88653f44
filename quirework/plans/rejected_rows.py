"""Problem 5: rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.plans._collect import Collected
from quirework.session import table
from quirework.sources import rejects

query = Collected()

# The records in SQL, for comparison: quoting by one pattern over the whole record, fields by another, then a rule per column.
_ID = r"(?:[0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})(?:v[0-9]+)?"
_NUMBER = "[0-9]{1,9}"


def _records(feed: str, separator: str) -> str:
    """(line_id, line, quoted, f): f are the fields of a well-quoted record."""
    one = f'(?:"(?:[^"]|"")*"|(?:[^"{separator}][^{separator}]*)?)'
    return f"""select line_id, line, line is null or regexp_full_match(line, '{one}(?:{separator}{one})*') as quoted,
    list_transform(regexp_extract_all('{separator}' || line, '{separator}("(?:[^"]|"")*"|[^{separator}]*)', 1), lambda x: case when starts_with(x, '"') then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) as f
    from raw_lines where feed = '{feed}'"""


def _rule(columns: list[str]) -> str:
    return "case " + " ".join(columns) + " end"


_LABELS_RULE = _rule(
    [
        f"when not regexp_full_match(f[1], '{_ID}') then 'arxiv_id'",
        f"when not regexp_full_match(f[2], '{_NUMBER}') then 'section_index'",
        f"when not regexp_full_match(f[3], '{_NUMBER}') then 'paragraph_index'",
        r"when regexp_full_match(f[5], '[\s\v\p{Z}\x{85}\x{1c}-\x{1f}]*') then 'paragraph'",
        "when not regexp_full_match(f[6], '[1-5]') then 'label'",
    ]
)
_REVIEW_RULE = _rule(
    [
        f"when not (starts_with(f[1], f[2] || ':' || f[3]) and regexp_full_match(substr(f[1], length(f[2] || ':' || f[3]) + 1), ':{_NUMBER}:c{_NUMBER}')) then 'connection_id'",
        f"when not regexp_full_match(f[2], '{_ID}') then 'arxiv_id'",
        "when f[3] not in ('paragraph', 'abstract_introduction', 'whole_paper') then 'condition'",
        "when f[12] not in ('', 'yes', 'no', 'uncertain') then 'match'",
    ]
)


def _sorted(feed: str, separator: str, width: int, rule: str, names: tuple[str, ...]) -> str:
    """(line_id, feed, reason, wrong, f) of every record of a feed; wrong is the first failing column."""
    return f"""select line_id, '{feed}' as feed, f, case when not quoted then 'quoting' when line is null or len(f) <> {width} then 'columns' when wrong is not null then 'value' end as reason,
    case when quoted and line is not null and len(f) = {width} then wrong end as wrong, [{', '.join(f"'{n}'" for n in names)}] as names from (select *, {rule} as wrong from ({_records(feed, separator)}))"""


LABELS_SQL = _sorted("labels", "\t", 6, _LABELS_RULE, rejects.LABELS.columns)
REVIEW_SQL = _sorted("review", ",", 13, _REVIEW_RULE, rejects.REVIEW.columns)
_ALL = f"({LABELS_SQL}) union all ({REVIEW_SQL})"


def typed_sql(sorted_sql: str, feed: rejects.Feed) -> str:
    """The typed rows of a feed."""
    fields = ", ".join(f"f[{i}]{'::int' if c in feed.integers else ''} as {c}" for i, c in enumerate(feed.columns, 1))
    return f"select line_id, {fields} from ({sorted_sql}) where reason is null"


@query(f"select line_id, reason from ({_ALL}) where reason is not null")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that cannot be read, with the reason."""
    return rejects.rejected(table(spark, sf_dir, "raw_lines"))


@query(f'select line_id, feed, reason, wrong as "column", case when wrong is not null then f[list_position(names, wrong)] end as "value" from ({_ALL}) where reason is not null')
def p5_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that cannot be read, with the reason and the failing cell."""
    return rejects.rejected_cells(table(spark, sf_dir, "raw_lines"))


@query(typed_sql(LABELS_SQL, rejects.LABELS))
def p5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows of the labels feed."""
    return rejects.valid_rows(table(spark, sf_dir, "raw_lines"), "labels")


@query(typed_sql(REVIEW_SQL, rejects.REVIEW))
def p5_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows of the review feed."""
    return rejects.valid_rows(table(spark, sf_dir, "raw_lines"), "review")


QUERIES, ORACLE = query.queries, query.oracle
