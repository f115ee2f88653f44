"""Queries over sections, paragraphs, statements and review records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions import records as C
from quirework.functions import sentence_rules as S
from quirework.functions import text as X
from quirework.operators import answers as A2
from quirework.operators import documents as D
from quirework.operators import experiment as X2
from quirework.operators import metrics as E
from quirework.plans._collect import Collected
from quirework.plans.rejected_rows import LABELS_SQL, REVIEW_SQL, typed_sql
from quirework.session import table
from quirework.sources import rejects

query = Collected()


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sections").dropDuplicates(["arxiv_id", "section_index"])


_S = "(select distinct on (arxiv_id, section_index) * from sections)"


@query("select arxiv_id, section_index, statement_index, statement_type, raw_latex, labels from statements")
def x25_extract_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of every section's source, against the delivered table, whose bodies begin after an optional title."""
    body = F.regexp_replace("raw_latex", r"^\[[^\]]*\]", "").alias("raw_latex")
    return D.extracted_statements(_sections(spark, sf_dir)).select("arxiv_id", "section_index", "statement_index", "statement_type", body, "labels")


@query("select arxiv_id, section_index, statement_index, labels[1] as first_label, len(labels) as n, array_to_string(labels, ' ') as all_labels from statements where len(labels) > 0")
def x24_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that the parser finds directly inside each statement of every section's source."""
    s = D.extracted_statements(_sections(spark, sf_dir)).where("size(labels) > 0")
    return s.select("arxiv_id", "section_index", "statement_index", F.col("labels")[0].alias("first_label"), F.size("labels").cast("long").alias("n"), F.array_join("labels", " ").alias("all_labels"))


@query()
def x5_clean_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose of every section's source."""
    return D.clean_paragraphs(_sections(spark, sf_dir))


@query(f"select arxiv_id, section_index, md5(regexp_replace(raw_latex, '(^|[^\\\\])%[^\\n]*', '\\1', 'g')) as digest from {_S} where raw_latex is not null")
def x1_without_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each source without comments."""
    return _sections(spark, sf_dir).where("raw_latex is not null").select("arxiv_id", "section_index", F.md5(X.without_comments(F.col("raw_latex"))).alias("digest"))


@query(f"select arxiv_id, section_index, md5(regexp_replace(raw_latex, '(?is)\\\\begin\\{{(?:verbatim|lstlisting|minted)\\}}.*?\\\\end\\{{(?:verbatim|lstlisting|minted)\\}}', ' ', 'g')) as digest from {_S} where raw_latex is not null")
def x7_without_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each source without verbatim blocks."""
    return _sections(spark, sf_dir).where("raw_latex is not null").select("arxiv_id", "section_index", F.md5(X.without_verbatim(F.col("raw_latex"))).alias("digest"))


@query(
    f"""with p as (select arxiv_id, section_index, list_filter(string_split_regex(raw_latex, '\\r?\\n\\r?\\n|\\\\par\\b'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13)) <> '') as parts from {_S} where raw_latex is not null)
    select arxiv_id, section_index, len(parts) as n, md5(array_to_string(parts, chr(31))) as digest from p"""
)
def x19_split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the paragraphs of each source."""
    parts = X.split_paragraphs(F.col("raw_latex"))
    return _sections(spark, sf_dir).where("raw_latex is not null").select("arxiv_id", "section_index", F.size(parts).cast("long").alias("n"), F.md5(F.array_join(parts, "\x1f")).alias("digest"))


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _met(pattern: str) -> str:
    """Whether sentence s holds a pattern; a look-ahead at the start, which the SQL engine lacks, is held against each match."""
    ahead = r"\b(?!(?:We|This|It)\b)"
    if pattern.startswith(ahead):
        return f"len(list_filter(regexp_extract_all(s, {_literal(chr(92) + 'b' + pattern[len(ahead):])}), lambda m: not regexp_matches(m, '^(?:We|This|It)\\b'))) > 0"
    return f"regexp_matches(s, {_literal(pattern)})"


def _rules_sql() -> str:
    bad = ", ".join("case when " + " and ".join(_met(p) if wanted else f"not {_met(p)}" for p, wanted in rule) + f" then '{name}' end" for name, rule in S.NEGATIVE.items())
    good = ", ".join(f"case when {_met(p)} then {i} end" for i, p in enumerate(S.POSITIVE))
    return f"list_filter([{bad}], lambda x: x is not null) as bad, list_filter([{good}], lambda x: x is not null) as good"


@query(
    f"""with p as (select distinct arxiv_id, section_index, paragraph_index, section_header, text from paragraphs),
    c as (select *, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?]["''”’]?)\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') as parts from p),
    e as (select arxiv_id, section_index, paragraph_index, section_header, text, unnest(parts) as s from c), r as (select *, {_rules_sql()} from e),
    t as (select arxiv_id, section_index, paragraph_index, section_header, text, list_distinct(flatten(list(good) filter (where len(bad) = 0))) as good, list_distinct(flatten(list(bad))) as bad from r group by all)
    select distinct p.arxiv_id, p.section_index, p.paragraph_index, coalesce(regexp_matches(p.section_header, {_literal(S.TITLE)}), false)::int as important_title, coalesce(len(t.good), 0)::int as enrichment_hits, coalesce(len(t.bad), 0)::int as negative_hits
    from p left join t on p.arxiv_id is not distinct from t.arxiv_id and p.section_index is not distinct from t.section_index and p.paragraph_index is not distinct from t.paragraph_index and p.section_header is not distinct from t.section_header and p.text is not distinct from t.text"""
)
def x30_paragraph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, enrichment and exclusion evidence of every paragraph."""
    p = table(spark, sf_dir, "paragraphs").select("arxiv_id", "section_index", "paragraph_index", "section_header", "text")
    return S.paragraph_features(p.distinct(), "section_header", "text").drop("section_header", "text")


@query("select arxiv_id, section_index, paragraph_index, 'Section: ' || coalesce(section_header, '') || ' Text: ' || coalesce(text, '') as input from (select distinct arxiv_id, section_index, paragraph_index, section_header, text from paragraphs)")
def proj3_classifier_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that each paragraph is scored by."""
    p = table(spark, sf_dir, "paragraphs").select("arxiv_id", "section_index", "paragraph_index", "section_header", "text").distinct()
    return p.select("arxiv_id", "section_index", "paragraph_index", X.labelled_paragraph(F.col("section_header"), F.col("text")).alias("input"))


@query(
    f"""select arxiv_id, section_index, coalesce(last_value(case when trim(section_header) <> '' then section_header end ignore nulls)
    over (partition by arxiv_id order by section_index rows between unbounded preceding and current row), '') as major_header from {_S}"""
)
def w6_carried_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last non-empty header so far."""
    s = _sections(spark, sf_dir).select("arxiv_id", "section_index", "section_header")
    return D.carried_header(s, "section_header").select("arxiv_id", "section_index", "major_header")


@query(
    f"""select arxiv_id, 'abstract' as block_id, md5(min(abstract)) as digest from papers where abstract is not null group by arxiv_id
    union all select arxiv_id, 's' || section_index || '_p' || (i - 1), md5(text[i]) from (select *, unnest(range(1, len(text) + 1)) as i from {_S})"""
)
def proj6_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence blocks of every paper."""
    one = table(spark, sf_dir, "papers").groupBy("arxiv_id").agg(F.min("abstract").alias("abstract"))
    return D.blocks(one, _sections(spark, sf_dir)).select("arxiv_id", "block_id", F.md5("text").alias("digest"))


_Q = "(select * from (values ('q1', 'spectral gap estimate of the graph'), ('q2', 'tokenizer and verifier'), ('q3', 'graph graph')) v(query_id, query))"
_TOK = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


@query(
    f"""with d as (select doc_id as id, {_TOK.format(c='text')} as t from documents), w as (select count(*) as docs, avg(len(t)) as mean from d),
    q as (select query_id, unnest(list_distinct({_TOK.format(c='query')})) as term from {_Q}),
    p as (select id, len(t) as n, term, count(*) as tf from (select id, t, unnest(t) as term from d) where term in (select term from q) group by all),
    f as (select term, count(*) as df from p group by 1),
    s as (select q.query_id, p.id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) as score from q join p using (term) join f using (term), w group by all)
    select query_id, id, score, (row_number() over (partition by query_id order by score desc, id))::int as rank from s qualify rank <= 10"""
)
def x43_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over all documents."""
    q = spark.createDataFrame([("q1", "spectral gap estimate of the graph"), ("q2", "tokenizer and verifier"), ("q3", "graph graph")], "query_id string, query string")
    return D.bm25(table(spark, sf_dir, "documents"), q, "doc_id", "text", 10)


_REVIEW = f"({typed_sql(REVIEW_SQL, rejects.REVIEW)})"


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.valid_rows(table(spark, sf_dir, "raw_lines"), "review")


@query(
    f"""with e as (select connection_id, arxiv_id, unnest(from_json(evidence, '[{{"block_id":"VARCHAR","quote":"VARCHAR"}}]')) as e from {_REVIEW} where json_valid(evidence) and json_type(evidence) = 'ARRAY'),
    b as (select arxiv_id, 'abstract' as block_id, min(abstract) as text from papers where abstract is not null group by 1 union all select arxiv_id, 's' || section_index || '_p' || (i - 1), text[i] from (select *, unnest(range(1, len(text) + 1)) as i from {_S})),
    m as (select arxiv_id, block_id, min(text) as text from b group by all)
    select connection_id, e.arxiv_id, e.e.block_id as block_id, e.e.quote as quote, coalesce(contains(m.text, e.e.quote), false) as supported from e left join m on m.arxiv_id = e.arxiv_id and m.block_id = e.e.block_id"""
)
def j12_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of review records held against their blocks."""
    kind = "array<struct<block_id: string, quote: string>>"
    ev = _review(spark, sf_dir).select("connection_id", "arxiv_id", F.explode(F.from_json("evidence", kind)).alias("e")).select("connection_id", "arxiv_id", "e.block_id", "e.quote")
    one = table(spark, sf_dir, "papers").groupBy("arxiv_id").agg(F.min("abstract").alias("abstract"))
    return D.supported_quotes(ev, D.blocks(one, _sections(spark, sf_dir)))


_NAMES = ["reference_source", "reference_target", "relation"]


@query(
    f"""with r as (select *, trim(regexp_replace(coalesce(review_notes, ''), '(?i){C.OPEN_REVIEW}\\s*:?\\s*', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) as reason, case when json_valid(evidence) and json_type(evidence) = 'ARRAY' then from_json(evidence, '[{{"block_id":"VARCHAR","quote":"VARCHAR"}}]') end as e from {_REVIEW})
    select line_id, case when match = 'uncertain' then '{C.OPEN_REVIEW}' || case when reason <> '' then ': ' || reason else '' end when reason <> '' then reason else 'Human reviewed.' end as notes,
    {" || chr(10) || chr(10) || ".join(f"'{n.replace('_', ' ').title()}' || chr(10) || case when coalesce({n}, '') <> '' then {n} else '(not stated)' end" for n in _NAMES)} as stated,
    case when e is not null and len(list_filter(e, lambda x: x is null or x.block_id is null or x.quote is null)) = 0 then array_to_string(list_transform(e, lambda x: '[' || x.block_id || ']' || chr(10) || x.quote), chr(10) || chr(10)) else evidence end as evidence from r"""
)
def x34_review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes after a decision, stated fields and evidence of review records, as a reviewer reads them."""
    r = _review(spark, sf_dir)
    return r.select("line_id", C.decided_notes(F.col("review_notes"), F.col("match")).alias("notes"), C.stated(_NAMES).alias("stated"), C.evidence_text(F.col("evidence")).alias("evidence"))


@query(
    f"""with l as ({typed_sql(LABELS_SQL, rejects.LABELS)} qualify count(*) over (partition by arxiv_id, section_index, paragraph_index) = 1),
    h as (select * from l qualify min(section_header) over (partition by arxiv_id, section_index) = max(section_header) over (partition by arxiv_id, section_index))
    select line_id, arxiv_id, section_index, paragraph_index, substr(md5(paragraph), 1, 8) as answer from h"""
)
def g19_labelled_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model put back beside the rows they were asked for, whose sections agree on their header."""
    rows = X2.typed_keys(rejects.valid_rows(table(spark, sf_dir, "raw_lines"), "labels").withColumn("section_index", F.col("section_index").cast("string")).withColumn("paragraph_index", F.col("paragraph_index").cast("string")), "line_id")
    keys = ["arxiv_id", "section_index", "paragraph_index"]
    once = rows.join(rows.groupBy(keys).agg(F.count("*").alias("n")).where("n = 1").select(keys), keys, "left_semi")
    agreed = once.groupBy("arxiv_id", "section_index").agg(F.min("section_header").alias("a"), F.max("section_header").alias("b")).where("a = b").select("arxiv_id", "section_index")
    rows = once.join(agreed, ["arxiv_id", "section_index"], "left_semi")
    told = A2.answered(rows.select(*keys, "paragraph"), "paragraph", A2.digest_answers()).select(*keys, "answer")
    return X2.labelled_in_order(rows, told).select("line_id", *keys, "answer")


@query(f"select line_id, connection_id from {_REVIEW} where lower(trim(match)) in ('', 'uncertain') or contains(lower(coalesce(review_notes, '')), 'human review needed')")
def f8_needs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review records without a decision."""
    m = F.lower(F.trim("match"))
    undecided = m.isin("", "uncertain") | F.contains(F.lower(F.coalesce("review_notes", F.lit(""))), F.lit("human review needed"))
    return _review(spark, sf_dir).where(undecided).select("line_id", "connection_id")


@query(f"select arxiv_id, condition, case when count(distinct match) = 1 then min(match) else 'uncertain' end as decision from {_REVIEW} where match <> '' group by all")
def a19_collapsed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per paper and condition: uncertain unless all its records agree."""
    rows = _review(spark, sf_dir).where("match <> ''").groupBy("arxiv_id", "condition").agg(F.collect_set("match").alias("m"))
    return rows.select("arxiv_id", "condition", F.when(F.size("m") == 1, F.col("m")[0]).otherwise("uncertain").alias("decision"))


@query(
    f"""select condition, round(avg((match = 'yes')::int), 6) as share, count(*) as n from {_REVIEW} where match in ('yes', 'no') and arxiv_id in (select arxiv_id from {_REVIEW} group by 1 having count(distinct condition) = 3) group by 1"""
)
def a13_paired_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of yes among decided records of each condition, over papers that have all three."""
    rows = _review(spark, sf_dir)
    whole = rows.groupBy("arxiv_id").agg(F.countDistinct("condition").alias("n")).where("n = 3")
    return rows.join(whole, "arxiv_id", "left_semi").where("match in ('yes', 'no')").groupBy("condition").agg(F.round(F.avg((F.col("match") == "yes").cast("double")), 6).alias("share"), F.count("*").alias("n"))


@query(
    """select event_type, count(*) as n, round(sum(value), 4) as total, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95 from events where value is not null group by 1"""
)
def a14_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, median and 95th percentile with linear interpolation."""
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95")
    )


@query(
    """with a as (select user_id, list(event_id order by value desc, event_id) as x, list(event_id order by ts desc, event_id) as y from events group by 1)
    select round(avg(len(list_intersect(x[1:10], y[1:10])) / 10.0), 6) as overlap from a"""
)
def a17_top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean overlap of two rankings' first ten items."""
    from quirework.operators.ranking import top_by

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    x = top_by(e, ["user_id"], [F.desc("value"), F.col("event_id")], 10).groupBy("user_id").agg(F.collect_list("event_id").alias("x"))
    y = top_by(e, ["user_id"], [F.desc("ts"), F.col("event_id")], 10).groupBy("user_id").agg(F.collect_list("event_id").alias("y"))
    return E.mean_top_overlap(x.join(y, "user_id"), "x", "y", 10).select(F.round("overlap", 6).alias("overlap"))


@query(
    """with r as (select user_id as query_id, event_type as target_id, (row_number() over (partition by user_id order by sum(value) desc, event_type))::int as rank from events group by 1, 2),
    p as (select distinct user_id as query_id, event_type as target_id from events where value > 90),
    h as (select p.query_id, avg((r.rank is not null)::int) as x, max((r.rank is not null)::int) as y from p left join r on r.query_id = p.query_id and r.target_id = p.target_id and r.rank <= 2 group by 1)
    select round(avg(x), 6) as recall, round(avg(y), 6) as hit from h"""
)
def a21_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro recall and hit rate at 2 of a ranking against positives."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("query_id").orderBy(F.desc("v"), "target_id")
    r = e.groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("target_id")).agg(F.sum("value").alias("v")).withColumn("rank", F.row_number().over(w)).select("query_id", "target_id", "rank")
    p = e.where("value > 90").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("target_id")).distinct()
    m = E.recall_at_k(r, p, 2)
    return m.select(F.round("recall", 6).alias("recall"), F.round("hit", 6).alias("hit"))


QUERIES, ORACLE = query.queries, query.oracle
