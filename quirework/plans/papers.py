"""Queries over papers: scans, filters, projections, deduplication and batches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as X
from quirework.operators import ranking as R
from quirework.plans._collect import Collected
from quirework.session import table
from quirework.sources import metadata as M

query = Collected()

_ONE = "(select arxiv_id, min(title) title, min(abstract) abstract, min(primary_category) primary_category, min(publication_date) publication_date, min(doi) doi from papers group by arxiv_id)"


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per id."""
    p = table(spark, sf_dir, "papers")
    return p.groupBy("arxiv_id").agg(*(F.min(c).alias(c) for c in ("title", "abstract", "primary_category", "publication_date", "doi")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers as metadata JSON lines, as a snapshot has them."""
    p = table(spark, sf_dir, "papers")
    created = F.date_format("publication_date", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    one = p.groupBy("arxiv_id").agg(*(F.min(c).alias(c) for c in ("title", "abstract", "primary_category", "publication_date", "doi", "authors")))
    record = F.struct(
        F.col("arxiv_id").alias("id"),
        "title",
        "abstract",
        F.concat(F.col("primary_category"), F.lit(" math.GM")).alias("categories"),
        F.transform("authors", lambda a: F.array(F.split(a, " ")[0], F.coalesce(F.get(F.split(a, " "), F.lit(1)), F.lit("")), F.lit(""))).alias("authors_parsed"),
        "doi",
        F.array(F.struct(F.lit("v1").alias("version"), created.alias("created"))).alias("versions"),
    )
    return one.select(F.to_json(record).alias("value"))


@query(
    f"""select arxiv_id, trim(regexp_replace(title, '[\\s\\x{{00A0}}]+', ' ', 'g')) as title, primary_category, publication_date, coalesce(trim(regexp_replace(doi, '[\\s\\x{{00A0}}]+', ' ', 'g')), '') as doi,
    'https://arxiv.org/abs/' || arxiv_id as url from {_ONE}
    where primary_category is not null and publication_date is not null and title is not null and (lower(primary_category) = 'math.co' or lower(primary_category) = 'cs.ds')
    and (contains(lower(coalesce(title, '') || chr(10) || coalesce(abstract, '')), 'graph') or contains(lower(coalesce(title, '') || chr(10) || coalesce(abstract, '')), 'algorithm'))
    and publication_date::date between date '2028-01-01' and date '2036-12-31'"""
)
def s1_metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and project metadata lines."""
    rows = M.select_records(_lines(spark, sf_dir), [" CS.DS ", "math.CO"], ["GRAPH", "algorithm"], dt.date(2028, 1, 1), dt.date(2036, 12, 31))
    return rows.select("arxiv_id", "title", "primary_category", "publication_date", "doi", "url")


@query("select count(*) as n from papers where primary_category is not null and (starts_with(primary_category, 'cs.') or starts_with(primary_category, 'math.'))")
def s2_math_or_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a math or computer science category, as in the subset scan."""
    return table(spark, sf_dir, "papers").where(M.is_math_or_cs(F.col("primary_category"))).agg(F.count("*").alias("n"))


@query(
    """select base as arxiv_id, arxiv_id as first_id from (select *, regexp_replace(arxiv_id, 'v[0-9]+$', '') as base from papers)
    qualify row_number() over (partition by base order by loaded_at, arxiv_id) = 1"""
)
def s3_first_record_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First delivered record of each id without version."""
    p = table(spark, sf_dir, "papers").select("arxiv_id", F.col("arxiv_id").alias("first_id"), "loaded_at")
    return M.first_record_wins(p, [F.col("loaded_at"), F.col("first_id")]).select("arxiv_id", "first_id")


@query(
    """select id as arxiv_id, min(position) as position from (
      select doc_id as position, unnest(string_split_regex(regexp_replace(coalesce(arxiv_id, '') || ', ' || coalesce(source, '') || ' # note', '#.*', ''), '[\\s,]+')) as id from documents)
    where id <> '' group by id"""
)
def s14_parse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids of lines with separators and comments, at their first line."""
    lines = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("position"), F.concat(F.coalesce("arxiv_id", F.lit("")), F.lit(", "), F.coalesce("source", F.lit("")), F.lit(" # note")).alias("value")
    )
    return M.parse_id_lines(lines)


@query(f"select arxiv_id, title || chr(10) || chr(10) || abstract as area_text from {_ONE} where title is not null and abstract is not null")
def proj5_area_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that a paper's area vector is made of."""
    return _papers(spark, sf_dir).where("title is not null and abstract is not null").select("arxiv_id", F.concat("title", F.lit("\n\n"), "abstract").alias("area_text"))


@query(
    """with p as (select arxiv_id, min(authors) as a from papers where authors is not null and len(authors) > 0 group by 1)
    select arxiv_id, list_filter(case when ascii(right(arxiv_id, 1)) % 2 = 0 then list_transform(a, lambda x: x) else list_transform(string_split(array_to_string(a, ', '), ','), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) end, lambda x: x <> '') as authors from p"""
)
def proj2_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of records: of those with parsed names, surname and first name; of the others the text cut at commas."""
    p = table(spark, sf_dir, "papers").where("authors is not null and size(authors) > 0").groupBy("arxiv_id").agg(F.min("authors").alias("a"))
    even = F.ascii(F.right("arxiv_id", F.lit(1))) % 2 == 0
    parsed = F.when(even, F.transform("a", lambda x: F.array(x, F.lit(""), F.lit("Jr."))))
    lines = p.select(F.to_json(F.struct(F.col("arxiv_id").alias("id"), F.when(~even, F.array_join("a", ", ")).alias("authors"), parsed.alias("authors_parsed"))).alias("value"))
    r = M.parse_records(lines).select("record")
    return r.select(F.col("record.id").alias("arxiv_id"), M.author_names(F.col("record")).alias("authors"))


@query(f"select arxiv_id from {_ONE} where list_has_any(string_split_regex(lower(trim(primary_category)), '\\s+'), ['cs.lg', 'math.pr'])")
def f1_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any exact category token, without case."""
    return _papers(spark, sf_dir).where(M.in_categories(F.col("primary_category"), ["cs.LG", "math.pr"])).select("arxiv_id")


@query(f"select arxiv_id from {_ONE} where contains(lower(coalesce(title, '') || chr(10) || coalesce(abstract, '')), 'spectr')")
def f2_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword as a part of title or abstract."""
    return _papers(spark, sf_dir).where(M.has_keyword(F.col("title"), F.col("abstract"), ["SPECTR", " "])).select("arxiv_id")


@query(f"select arxiv_id, publication_date from {_ONE} where publication_date::date between date '2030-01-01' and date '2031-06-30'")
def f3_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive range of days."""
    day = F.col("publication_date").cast("date")
    return _papers(spark, sf_dir).where(day.between(dt.date(2030, 1, 1), dt.date(2031, 6, 30))).select("arxiv_id", "publication_date")


@query("select arxiv_id, section_index, paragraph_index, count(*) as n from paragraphs where text is not null and trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> '' group by all")
def f10_not_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with text."""
    p = table(spark, sf_dir, "paragraphs").where("text is not null").where(F.trim("text", F.lit(" \t\n\r")) != "")
    return p.groupBy("arxiv_id", "section_index", "paragraph_index").agg(F.count("*").alias("n"))


@query("select primary_category, count(distinct arxiv_id) as papers, min(publication_date) as first_date, max(publication_date) as last_date from papers group by 1")
def a16_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers and date range of each category."""
    p = table(spark, sf_dir, "papers")
    return p.groupBy("primary_category").agg(F.countDistinct("arxiv_id").alias("papers"), F.min("publication_date").alias("first_date"), F.max("publication_date").alias("last_date"))


@query(
    """select arxiv_id, ((row_number() over (order by loaded_at, arxiv_id, doc_id) - 1) // 500 + 1)::int as batch
    from documents where arxiv_id is not null"""
)
def w9_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of batches of 500 rows in delivery order.

    A global order cannot be numbered in parallel by one window, so rows are
    numbered per day and shifted by the days' counts before.
    """
    d = table(spark, sf_dir, "documents").where("arxiv_id is not null").select("arxiv_id", "doc_id", "loaded_at", F.to_date("loaded_at").alias("day"))
    return numbered_by_day(d).select("arxiv_id", (F.floor((F.col("position") - 1) / 500) + 1).cast("int").alias("batch"))


def numbered_by_day(d: DataFrame) -> DataFrame:
    """Column position: the place of each row in the order (loaded_at, arxiv_id, doc_id), without one task sorting all rows."""
    from pyspark.sql import Window

    days = d.groupBy("day").agg(F.count("*").alias("n"))
    before = days.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.col("day").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # one row a day
    own = F.row_number().over(Window.partitionBy("day").orderBy(F.col("loaded_at").asc_nulls_last(), "arxiv_id", "doc_id"))
    numbered = d.withColumn("own", own)
    return numbered.join(before, numbered["day"].eqNullSafe(before["day"])).select(numbered["*"], (F.col("own") + F.col("before")).alias("position"))


@query("select arxiv_id, doc_id from documents where arxiv_id is not null order by loaded_at, arxiv_id, doc_id limit 50")
def t_a_limit_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 rows in delivery order."""
    return table(spark, sf_dir, "documents").where("arxiv_id is not null").orderBy("loaded_at", "arxiv_id", "doc_id").limit(50).select("arxiv_id", "doc_id")


@query("select arxiv_id, count(*) as n from papers group by arxiv_id having count(*) > 1")
def e9_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids delivered more than once."""
    return R.repeated_keys(table(spark, sf_dir, "papers"), ["arxiv_id"])


@query("select distinct arxiv_id from papers where arxiv_id in (select arxiv_id from sections) and arxiv_id in (select arxiv_id from techniques) and arxiv_id in (select arxiv_id from documents)")
def e6_complete_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers found in every table."""
    out = table(spark, sf_dir, "papers").select("arxiv_id").distinct()
    for name in ("sections", "techniques", "documents"):
        out = out.join(table(spark, sf_dir, name).select("arxiv_id"), "arxiv_id", "left_semi")
    return out


@query("select distinct arxiv_id from papers where arxiv_id not in (select arxiv_id from sections where arxiv_id is not null)")
def j15_not_yet_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers without a stored section: what a resumed run still has to fetch."""
    done = table(spark, sf_dir, "sections").select("arxiv_id")
    return table(spark, sf_dir, "papers").select("arxiv_id").distinct().join(done, "arxiv_id", "left_anti")


@query(
    """select arxiv_id, 'missing' as side from (select distinct arxiv_id from papers except select distinct arxiv_id from techniques)
    union all select arxiv_id, 'unexpected' from (select distinct arxiv_id from techniques except select distinct arxiv_id from papers)"""
)
def e5_id_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and found ids compared both ways."""
    return R.differences(table(spark, sf_dir, "papers"), table(spark, sf_dir, "techniques"), "arxiv_id")


@query(
    """select coalesce(e.arxiv_id, s.arxiv_id) as arxiv_id, e.arxiv_id is not null as expected, s.arxiv_id is not null as saved
    from (select distinct regexp_replace(arxiv_id, 'v[0-9]+$', '') as arxiv_id from papers) e
    full join (select distinct regexp_replace(arxiv_id, 'v[0-9]+$', '') as arxiv_id from documents where arxiv_id is not null) s on e.arxiv_id = s.arxiv_id"""
)
def j14_resume_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved ids against expected ones, whatever their version."""
    e = table(spark, sf_dir, "papers").select(X.without_version(F.col("arxiv_id")).alias("arxiv_id")).distinct().withColumn("expected", F.lit(True))
    s = table(spark, sf_dir, "documents").where("arxiv_id is not null").select(X.without_version(F.col("arxiv_id")).alias("arxiv_id")).distinct().withColumn("saved", F.lit(True))
    return e.join(s, "arxiv_id", "full").select("arxiv_id", F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("saved", F.lit(False)).alias("saved"))


@query(
    """select arxiv_id, regexp_extract('https://export.example.org/abs/' || arxiv_id, '([0-9]{4}\\.[0-9]{4,5}|[A-Za-z.-]+/[0-9]{7})(v[0-9]+)?$', 0) as bare,
    replace(arxiv_id, '/', '%2F') as path from (select distinct arxiv_id from papers)"""
)
def x32_ids_of_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare ids of page addresses, and ids as path segments."""
    p = table(spark, sf_dir, "papers").select("arxiv_id").distinct()
    return p.select("arxiv_id", X.bare_arxiv_id(F.concat(F.lit("https://export.example.org/abs/"), "arxiv_id")).alias("bare"), X.quoted_path(F.col("arxiv_id")).alias("path"))


@query(
    """with p as (select arxiv_id, min(title) title, min(model_name) model_name, min(primary_category) primary_category from papers group by 1),
    parts as (select primary_category, left(arxiv_id, 4) as part, sha256(string_agg(arxiv_id || ':' || coalesce(title, '') || ':' || coalesce(model_name, ''), chr(10) order by arxiv_id)) as digest from p group by all)
    select primary_category, sha256(string_agg(digest, chr(10) order by part)) as fingerprint from parts group by 1"""
)
def a20_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered fingerprint of each category's papers, in two levels: the papers of one month, then the months, so no list grows with a category."""
    p = table(spark, sf_dir, "papers").groupBy("arxiv_id").agg(F.min("title").alias("title"), F.min("model_name").alias("model_name"), F.min("primary_category").alias("primary_category"))
    line = F.concat_ws(":", "arxiv_id", F.coalesce("title", F.lit("")), F.coalesce("model_name", F.lit("")))
    digest = lambda rows, value: F.sha2(F.array_join(F.transform(F.array_sort(rows), lambda x: x[value]), "\n"), 256)
    parts = p.groupBy("primary_category", F.substring("arxiv_id", 1, 4).alias("part")).agg(digest(F.collect_list(F.struct("arxiv_id", line.alias("line"))), "line").alias("digest"))
    return parts.groupBy("primary_category").agg(digest(F.collect_list(F.struct("part", "digest")), "digest").alias("fingerprint"))


@query(
    """select extract(year from publication_date)::int as y, count(*) filter (where primary_category like 'math.%') as math, count(*) filter (where primary_category like 'cs.%') as cs
    from papers where publication_date is not null group by 1"""
)
def a15_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers by year and archive."""
    p = table(spark, sf_dir, "papers").where("publication_date is not null").select(F.year("publication_date").alias("y"), F.split("primary_category", r"\.")[0].alias("archive"))
    out = p.groupBy("y").pivot("archive", ["math", "cs"]).count()
    return out.select("y", F.coalesce("math", F.lit(0)).alias("math"), F.coalesce("cs", F.lit(0)).alias("cs"))


QUERIES, ORACLE = query.queries, query.oracle
