"""Queries over stored artifacts: each writes what a run stores and reads it back with its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators.deltas import Store
from quirework.plans._collect import Collected
from quirework.plans.rejected_rows import LABELS_SQL, typed_sql
from quirework.scratch import Scratch
from quirework.session import table
from quirework.sources import artifacts as A
from quirework.sources import atom, rejects
from quirework.sources import metadata as MD

query = Collected()

_ONE = "(select arxiv_id, min(title) as title, min(abstract) as abstract, min(authors) as authors, min(publication_date) as publication_date, min(primary_category) as primary_category, min(url) as url, min(doi) as doi, min(embedding_dim) as d, min(area_embedding) as v from papers group by 1)"


def one_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paper once; repeated rows differ in loaded_at only."""
    names = ["title", "abstract", "authors", "publication_date", "primary_category", "url", "doi", "embedding_dim", "area_embedding"]
    return table(spark, sf_dir, "papers").groupBy("arxiv_id").agg(*(F.min(c).alias(c) for c in names))


def _batched(spark: SparkSession, sf_dir: str, size: int) -> tuple[DataFrame, DataFrame]:
    papers = one_papers(spark, sf_dir).where("area_embedding is null or size(area_embedding) = embedding_dim").select("arxiv_id", "title", "embedding_dim", "area_embedding")
    papers = A.batched(papers, size)
    t = table(spark, sf_dir, "techniques").select("passage_id", "arxiv_id", "passage", "score", "embedding")
    of = papers.select("arxiv_id", "batch", "embedding_dim")
    return papers, t.join(of, "arxiv_id").where("embedding is null or size(embedding) = embedding_dim").drop("embedding_dim")


_BATCHES = f"""with p as (select arxiv_id, d, v, floor((row_number() over (order by arxiv_id) - 1) / 100)::int + 1 as batch from {_ONE} where v is null or len(v) = d),
    t as (select batch, passage_id, embedding from techniques join p using (arxiv_id) where embedding is null or len(embedding) = d)"""


@query(
    _BATCHES
    + """, a as (select batch, count(*) as papers, count(v) as with_vector from p group by 1), b as (select batch, count(*) as passages, round(sum(embedding[1]::double), 4) as first from t group by 1)
    select batch, papers, with_vector, coalesce(passages, 0) as passages, first from a left join b using (batch)"""
)
def s5_embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers and passages stored in batches and read back with their checks of ids and lengths."""
    path = f"{Scratch(spark, 's5').root}/run"
    A.write_batches(*_batched(spark, sf_dir, 100), path)
    papers, techniques = A.read_batches(spark, path)
    a = papers.groupBy("batch").agg(F.count("*").alias("papers"), F.count("area_embedding").alias("with_vector"))
    b = techniques.groupBy("batch").agg(F.count("*").alias("passages"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 4).alias("first"))
    return a.join(b, "batch", "left").select("batch", "papers", "with_vector", F.coalesce("passages", F.lit(0)).alias("passages"), "first")


@query(_BATCHES + " select batch, 'missing' as side from (select batch from p except select batch from t) union all select batch, 'unexpected' from (select batch from t except select batch from p)")
def e4_batch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that only one of both tables has."""
    return A.batch_names_differ(*_batched(spark, sf_dir, 100))


@query(
    f"""with p as (select arxiv_id, floor((row_number() over (order by arxiv_id) - 1) / 20)::int + 1 as batch from {_ONE}), s as (select distinct arxiv_id, 1 as s from sections)
    select batch, count(*) as papers, count(s) as stored, count(*) = count(s) as done from p left join s using (arxiv_id) group by 1"""
)
def g4_resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which batches of papers are stored whole."""
    return A.resumable(table(spark, sf_dir, "papers"), table(spark, sf_dir, "sections"), 20)


@query(
    """with e as (select distinct arxiv_id from papers where arxiv_id is not null), s as (select distinct arxiv_id from sections)
    select coalesce(e.arxiv_id, s.arxiv_id) as arxiv_id, case when s.arxiv_id is null then 'missing' when e.arxiv_id is null then 'unexpected' else 'stored' end as state from e full join s on e.arxiv_id = s.arxiv_id"""
)
def j14_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, missing and unexpected ids."""
    return A.coverage(table(spark, sf_dir, "papers"), table(spark, sf_dir, "sections"))


def _uploaded(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, f"{Scratch(spark, 'k7').root}/store")
    papers = table(spark, sf_dir, "papers").select("arxiv_id", "title", "loaded_at")
    passages = table(spark, sf_dir, "techniques").where("passage is not null").select("passage_id", "arxiv_id", "passage", "embedding", "score", "loaded_at")
    early = F.col("loaded_at") < F.lit("2033-01-01").cast("timestamp")
    store.commit("first", {"papers": papers.where(early), "techniques": passages.where(early)})
    for _ in range(2):  # a batch that comes twice is added once
        store.commit("second", {"papers": papers.where(~early), "techniques": passages.where(~early)})
    return store


@query(
    """with t as (select md5(arxiv_id || ':' || passage) as k, passage_id, arxiv_id, score, loaded_at, (loaded_at >= timestamp '2033-01-01')::int as c from techniques where passage is not null),
    f as (select * from t qualify row_number() over (partition by k order by c, loaded_at desc, passage_id desc) = 1), l as (select * from t qualify row_number() over (partition by k order by c desc, loaded_at desc, passage_id desc) = 1)
    select f.passage_id, f.arxiv_id, l.score from f join l using (k)"""
)
def k7_uploaded_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages after two deliveries of two tables, each one commit: a known passage changes its vector and score only."""
    return _uploaded(spark, sf_dir).read("techniques", ["loaded_at", "passage_id"]).select("passage_id", "arxiv_id", "score")


@query("select arxiv_id, max(loaded_at) as loaded_at from papers group by 1")
def k7_uploaded_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers after the same deliveries, compacted: the last row of an id wins."""
    store = _uploaded(spark, sf_dir)
    store.compact("papers", "compacted", ["loaded_at"])
    return store.read("papers", ["loaded_at"]).select("arxiv_id", "loaded_at")


@query(
    f"""select p.arxiv_id, s.section_index, md5(coalesce(p.title, '')) as title, md5(coalesce(array_to_string(list_transform(s.text, lambda x: coalesce(x, '?')), '|'), '')) as text, md5(coalesce(s.raw_latex, '')) as raw
    from {_ONE} p left join (select distinct on (arxiv_id, section_index) * from sections) s using (arxiv_id)"""
)
def s4_source_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with their sections stored as gzipped JSON and read back."""
    rows = A.source_papers(one_papers(spark, sf_dir), table(spark, sf_dir, "sections"))
    path = f"{Scratch(spark, 's4').root}/papers"
    A.write_source_papers(rows, path)
    back = A.read_source_papers(spark, path, rows.schema, False, table(spark, sf_dir, "papers"))
    text = F.array_join(F.transform("text", lambda x: F.coalesce(x, F.lit("?"))), "|")
    return back.select("arxiv_id", "section_index", *(F.md5(F.coalesce(c, F.lit(""))).alias(n) for n, c in (("title", F.col("title")), ("text", text), ("raw", F.col("raw_latex")))))


@query("select cluster_id, arxiv_id, min(title) as title, max(certainty) as certainty from clusters group by all")
def s7_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships stored as a gzipped table of fields and read back with their key checked."""
    rows = table(spark, sf_dir, "clusters").groupBy("cluster_id", "arxiv_id").agg(F.min("title").alias("title"), F.max("certainty").alias("certainty"))
    path = f"{Scratch(spark, 's7').root}/clusters"
    A.write_csv(rows.select("cluster_id", "arxiv_id", "title", "certainty"), path)
    return A.read_memberships(spark, path)


@query(f"select c.cluster_id, round(avg(v[1]::double), 6) as x, round(avg(v[2]::double), 6) as y from (select distinct cluster_id, arxiv_id from clusters) c join {_ONE} p using (arxiv_id) where v is not null and len(v) > 1 group by 1")
def k4_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids stored as JSON inside a field and read back; two components stand for coordinates."""
    p = one_papers(spark, sf_dir).where("size(area_embedding) > 1").select("arxiv_id", *(F.get("area_embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("xy")))
    mean = table(spark, sf_dir, "clusters").select("cluster_id", "arxiv_id").distinct().join(p, "arxiv_id").groupBy("cluster_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    path = f"{Scratch(spark, 'k4').root}/centroids"
    A.write_csv(A.with_centroid_field(mean), path)
    back = A.centroid_of_field(A.read_table(spark, path, "cluster_id int, centroid string", ["cluster_id", "centroid"]))
    return back.select("cluster_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"select arxiv_id, section_index, paragraph_index, label from ({typed_sql(LABELS_SQL, rejects.LABELS)}) qualify count(*) over (partition by arxiv_id, section_index, paragraph_index) = 1")
def s13_keyed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows whose key occurs once, with the key checked."""
    rows = rejects.valid_rows(table(spark, sf_dir, "raw_lines"), "labels")
    keys = A.KEYS["labels"]
    once = rows.groupBy(keys).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return A.keyed(rows.join(once, keys, "left_semi"), "labels").select(*keys, "label")


def _escaped(text):
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


_BLANKS = r"[\t\n\r ]+"


@query(
    rf"""select regexp_replace(arxiv_id, 'v[0-9]+$', '') as arxiv_id, trim(regexp_replace(title, '{_BLANKS}', ' ', 'g')) as title, md5(trim(regexp_replace(abstract, '{_BLANKS}', ' ', 'g'))) as abstract, list_transform(authors, lambda a: trim(regexp_replace(a, '{_BLANKS}', ' ', 'g'))) as authors,
    strftime(publication_date, '%Y-%m-%d %H:%M:%S') as published, primary_category, coalesce(trim(doi), '') as doi from {_ONE}
    where publication_date is not null and trim(regexp_replace(coalesce(title, ''), '{_BLANKS}', ' ', 'g')) <> '' and trim(regexp_replace(coalesce(abstract, ''), '{_BLANKS}', ' ', 'g')) <> '' and primary_category is not null and len(authors) > 0"""
)
def s15_atom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of papers written as Atom answers and parsed; answers that lack a field are left out by their problem."""
    p = one_papers(spark, sf_dir)
    plain = lambda c: _escaped(F.coalesce(c, F.lit("")))
    authors = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author><name>"), _escaped(a), F.lit("</name></author>"))), "")
    feed = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:x="http://arxiv.org/schemas/atom"><entry><id>http://papers.example/abs/'), F.col("arxiv_id"), F.lit("</id><title>"), plain(F.col("title")), F.lit("</title><summary>"), plain(F.col("abstract")),
        F.lit("</summary><published>"), F.coalesce(F.date_format("publication_date", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")), F.lit("</published>"), F.coalesce(authors, F.lit("")), F.lit('<x:primary_category term="'), plain(F.col("primary_category")),
        F.lit('"/><x:doi>'), plain(F.col("doi")), F.lit("</x:doi></entry></feed>"),
    )
    rows = atom.parse_feeds(p.select(feed.alias("value"))).where("problem is null")
    return rows.select("arxiv_id", "title", F.md5("abstract").alias("abstract"), "authors", F.date_format("publication_date", "yyyy-MM-dd HH:mm:ss").alias("published"), "primary_category", "doi")


@query("select distinct arxiv_id, section_index, paragraph_index, (row_number() over (partition by arxiv_id order by section_index, paragraph_index))::int as answer from (select distinct arxiv_id, section_index, paragraph_index from paragraphs where arxiv_id is not null)")
def s22_placed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached answers put beside the paragraphs at their place; here the answer is the place."""
    p = table(spark, sf_dir, "paragraphs").where("arxiv_id is not null").select("arxiv_id", "section_index", "paragraph_index").distinct()
    lists = p.groupBy("arxiv_id").agg(F.sequence(F.lit(1), F.count("*").cast("int")).alias("answers"))
    return A.placed_answers(p, lists).select("arxiv_id", "section_index", "paragraph_index", "answer")


@query(f"select arxiv_id, md5(arxiv_id || ' ' || primary_category) as line from {_ONE} where starts_with(primary_category, 'cs.') or starts_with(primary_category, 'math.')")
def s2_subset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of mathematics and computer science written back as the very lines they came in."""
    p = one_papers(spark, sf_dir)
    lines = p.select(F.to_json(F.struct(F.col("arxiv_id").alias("id"), F.concat(F.col("arxiv_id"), F.lit(" "), F.coalesce("primary_category", F.lit(""))).alias("title"), F.coalesce("primary_category", F.lit("")).alias("categories"))).alias("value"))
    path = f"{Scratch(spark, 's2').root}/subset"
    MD.write_subset(lines, path)
    back = spark.read.text(path)
    return back.select(F.get_json_object("value", "$.id").alias("arxiv_id"), F.md5(F.get_json_object("value", "$.title")).alias("line"))


@query(f"select arxiv_id, title from {_ONE} where primary_category = 'math.CO'")
def s10_named_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that a function known by name gives for named arguments."""
    functions = {"papers_of": lambda category: one_papers(spark, sf_dir).where(F.col("primary_category") == category).select("arxiv_id", "title")}
    return A.call(functions, "papers_of", {"category": "math.CO"})


@query(
    f"""select arxiv_id, strftime(publication_date, '%Y-%m-%dT%H:%M:%S') as written, publication_date as parsed, publication_date >= date '2033-06-30' - interval 365 day and publication_date < date '2033-07-01' as in_window from {_ONE} where publication_date is not null"""
)
def x37_iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in ISO form and parsed again, and whether they lie in the 365 days up to a day."""
    p = one_papers(spark, sf_dir).where("publication_date is not null")
    written = MD.iso_time(F.col("publication_date"))
    return p.select("arxiv_id", written.alias("written"), MD.from_iso(written).alias("parsed"), MD.within_days(F.col("publication_date"), F.lit("2033-06-30").cast("date"), 365).alias("in_window"))


QUERIES, ORACLE = query.queries, query.oracle
