"""Queries over label distributions: sampling and measures.

The tables hold no classifier output, so distributions are made from the
vectors: the softmax of components 1 to 5 (predicted) and 6 to 10 (second
opinion), times 6. They stand for any scorer's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import distributions as D
from quirework.operators import metrics as E
from quirework.operators import ranking as R
from quirework.operators import sampling as S
from quirework.plans._collect import Collected
from quirework.session import table

query = Collected()

_SOFT = "list_transform(list_transform({v}, lambda x: exp(6 * x)), lambda y: y / list_sum(list_transform({v}, lambda x: exp(6 * x))))"
_SAMPLES = f"""samples as (select arxiv_id, split_part(passage_id, '::', 3)::int as section_id, floor(score * 1000)::int % 7 as paragraph_id, passage_id, passage as text,
  {_SOFT.format(v='embedding[1:5]::double[]')} as p, {_SOFT.format(v='embedding[6:10]::double[]')} as g
  from techniques where embedding is not null and len(embedding) >= 10 and score is not null
  qualify row_number() over (partition by arxiv_id, split_part(passage_id, '::', 3)::int, floor(score * 1000)::int % 7 order by passage_id) = 1)"""
_ENTROPY = "round(-(p[1]*ln(p[1])+p[2]*ln(p[2])+p[3]*ln(p[3])+p[4]*ln(p[4])+p[5]*ln(p[5])), 9)"
_EXPECT = "round(p[1]+2*p[2]+3*p[3]+4*p[4]+5*p[5], 9)"
_EMD = "round(0.25*abs(p[1]-g[1]) + 1.25*abs(p[1]-g[1]+p[2]-g[2]) + 0.75*abs(p[1]-g[1]+p[2]-g[2]+p[3]-g[3]) + 0.25*abs(p[1]-g[1]+p[2]-g[2]+p[3]-g[3]+p[4]-g[4]), 9)"
_KEY = "arxiv_id, section_id, paragraph_id"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "techniques").where("embedding is not null and size(embedding) >= 10 and score is not null")
    six = lambda lo: F.transform(F.slice("embedding", lo, 5).cast("array<double>"), lambda x: x * 6)
    rows = t.select(
        "arxiv_id",
        F.split("passage_id", "::")[2].cast("int").alias("section_id"),
        F.pmod(F.floor(F.col("score") * 1000).cast("int"), F.lit(7)).alias("paragraph_id"),
        "passage_id",
        F.col("passage").alias("text"),
        D.softmax(six(1)).alias("predicted_dist"),
        D.softmax(six(6)).alias("gemma_dist"),
    )
    return R.first_by(rows, S.KEY, [F.col("passage_id")])


@query(f"with {_SAMPLES} select {_KEY}, round({_ENTROPY[6:-4]}, 6) as entropy, round({_EXPECT[6:-4]}, 6) as expected, round({_EMD[6:-4]}, 6) as emd from samples")
def x40_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy, expected class and earth mover's distance of every sample."""
    p, g = F.col("predicted_dist"), F.col("gemma_dist")
    return samples(spark, sf_dir).select(
        *S.KEY, F.round(D.entropy(p), 6).alias("entropy"), F.round(D.expected_class(p), 6).alias("expected"), F.round(D.weighted_emd(p, g), 6).alias("emd")
    )


@query(f"with {_SAMPLES} select {_KEY}, passage_id from samples order by {_ENTROPY} desc, {_KEY} limit 20")
def tb_highest_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 least certain samples."""
    return S.highest_entropy(samples(spark, sf_dir), 20).select(*S.KEY, "passage_id")


@query(f"with {_SAMPLES} select {_KEY}, passage_id from samples order by {_EMD} desc, {_KEY} limit 20")
def tb_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 samples whose two distributions disagree most."""
    return S.most_disagreement(samples(spark, sf_dir), 20).select(*S.KEY, "passage_id")


@query(f"with {_SAMPLES} select {_KEY}, passage_id from samples qualify row_number() over (partition by arxiv_id order by {_EXPECT} desc, {_KEY}) <= 2")
def w4_top_of_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paper's two samples of highest expected class."""
    return S.top_of_papers(samples(spark, sf_dir), 2).select(*S.KEY, "passage_id")


def _drawn(seed: int) -> str:
    return f"md5('{seed}|' || arxiv_id || '|' || section_id || '|' || paragraph_id)"


def _left(*taken: str) -> str:
    return "select * from samples s where " + " and ".join(f"not exists (select 1 from {t} x where x.arxiv_id = s.arxiv_id and x.section_id = s.section_id and x.paragraph_id = s.paragraph_id)" for t in taken)


@query(
    f"""with {_SAMPLES}, a as (select *, 'entropy' as strategy from samples order by {_ENTROPY} desc, {_KEY} limit 10), b as (select *, 'disagreement' as strategy from ({_left('a')}) order by {_EMD} desc, {_KEY} limit 10),
    c as (select *, 'top_random' as strategy from (select * from ({_left('a', 'b')}) qualify row_number() over (partition by arxiv_id order by {_EXPECT} desc, {_KEY}) <= 2) order by {_drawn(7)}, {_KEY} limit 10),
    d as (select *, 'random' as strategy from ({_left('a', 'b', 'c')}) order by {_drawn(8)}, {_KEY} limit 10),
    e as (select *, 'weighted' as strategy from ({_left('a', 'b', 'c', 'd')}) order by case when length(text) % 3 > 0 then -ln((('0x' || substr({_drawn(9)}, 1, 10))::bigint + 0.5) / 1099511627776.0) / (length(text) % 3) else 'infinity'::double end, {_drawn(9)}, {_KEY} limit 10)
    select {_KEY}, passage_id, strategy from (select * from a union all select * from b union all select * from c union all select * from d union all select * from e)"""
)
def e3_strategy_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by all strategies in turn, none twice."""
    rows = samples(spark, sf_dir).withColumn("w", F.length("text") % 3)
    return S.select_samples(rows, 10, 10, 10, 2, 10, 10, 7, "w").select(*S.KEY, "passage_id", "strategy")


@query(
    f"""with {_SAMPLES}, d as (select arxiv_id, round(p[4] + p[5], 9) as score, round(g[4] + g[5], 9) >= 0.4 as relevant, {_KEY.split(', ', 1)[1]} from samples),
    top as (select * from d qualify row_number() over (partition by arxiv_id order by score desc, section_id, paragraph_id) <= 10)
    select round(avg(p), 6) as precision from (select arxiv_id, avg(relevant::int) as p from top group by 1)"""
)
def a5_precision_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over papers of the share of relevant samples among the 10 best."""
    mass = lambda c: F.round(F.element_at(c, 4) + F.element_at(c, 5), 9)
    rows = samples(spark, sf_dir).withColumn("score", mass("predicted_dist")).withColumn("relevant", mass("gemma_dist") >= 0.4)
    return E.precision_at_k(rows, 10, ties=["section_id", "paragraph_id"]).select(F.round("precision", 6).alias("precision"))


_CLASSES = f"""with {_SAMPLES}, c as (select *, list_position(p, list_max(p)) as pc, list_position(g, list_max(g)) as tc from samples),
  k as (select unnest([1, 2, 3, 4, 5]) as k),
  m as (select k, count(*) filter (where pc = k and tc = k) as tp, count(*) filter (where pc = k) as pp, count(*) filter (where tc = k) as ap, count(*) as n from c, k group by k)"""


@query(
    _CLASSES
    + """ select (select count(*) from c) as n,
  (select round(avg(list_sum(list_transform(list_zip(p, g), lambda z: (z[1] - z[2]) ** 2))), 6) from c) as brier,
  (select round(avg(-list_sum(list_transform(list_zip(p, g), lambda z: z[2] * ln(z[1]) + (1 - z[2]) * ln(1 - z[1]))) / 5), 6) from c) as bce,
  (select round(avg(case when pp + ap = 0 then 0 else 2.0 * tp / (pp + ap) end), 6) from m) as macro_f1,
  (select round(case when pp = 0 then 0 else tp / pp end, 6) from m where k = 4) as precision_d, (select round(case when ap = 0 then 0 else tp / ap end, 6) from m where k = 4) as recall_d,
  (select round((n - pp - ap + 2 * tp) / n, 6) from m where k = 5) as accuracy_e"""
)
def a6_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score, cross entropy, macro F1 and measures per class."""
    m = E.class_metrics(samples(spark, sf_dir), "predicted_dist", "gemma_dist")
    return m.select(
        "n",
        F.round("brier", 6).alias("brier"),
        F.round("bce", 6).alias("bce"),
        F.round("macro_f1", 6).alias("macro_f1"),
        F.round(F.col("precision")[3], 6).alias("precision_d"),
        F.round(F.col("recall")[3], 6).alias("recall_d"),
        F.round(F.col("accuracy")[4], 6).alias("accuracy_e"),
    )


@query(
    _CLASSES
    + """ select round(case when pp = 0 then 0 else tp / pp end, 6) as precision, round(case when ap = 0 then 0 else tp / ap end, 6) as recall,
  round(case when pp + ap = 0 then 0 else 2 * tp / (pp + ap) end, 6) as f1, round(ok / n, 6) as accuracy from
  (select count(*) filter (where pc >= 4 and tc >= 4) as tp, count(*) filter (where pc >= 4) as pp, count(*) filter (where tc >= 4) as ap, count(*) filter (where (pc >= 4) = (tc >= 4)) as ok, count(*) as n from c)"""
)
def a7_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two highest classes against the rest."""
    top = lambda c: F.array_position(F.col(c), F.array_max(c)) >= 4
    m = E.binary_metrics(samples(spark, sf_dir), top("predicted_dist"), top("gemma_dist"))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query(f"with {_SAMPLES} select arxiv_id, round(avg(({_EXPECT} > 3)::int), 6) as rate, count(*) as n from samples group by 1")
def a8_high_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per paper the share of samples with an expected class above 3."""
    high = (F.round(D.expected_class(F.col("predicted_dist")), 9) > 3).cast("double")
    return samples(spark, sf_dir).groupBy("arxiv_id").agg(F.round(F.avg(high), 6).alias("rate"), F.count("*").alias("n"))


@query(
    f"""with {_SAMPLES}, per as (select arxiv_id, avg((list_position(p, list_max(p)) = list_position(g, list_max(g)))::int) as a from samples group by 1)
    select round(avg(a), 6) as mean, round(stddev_pop(a), 6) as spread, count(*) as papers from per"""
)
def a9_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy with one paper left out at a time: mean and spread over papers."""
    top = lambda c: F.array_position(F.col(c), F.array_max(c))
    per = samples(spark, sf_dir).groupBy("arxiv_id").agg(F.avg((top("predicted_dist") == top("gemma_dist")).cast("double")).alias("a"))
    return per.agg(F.round(F.avg("a"), 6).alias("mean"), F.round(F.stddev_pop("a"), 6).alias("spread"), F.count("*").alias("papers"))


@query(
    f"""with {_SAMPLES} select round(avg(len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+'))), 6) as mean_tokens, round(avg((len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+')) > 80)::int), 6) as over,
    round(avg(({_EXPECT} >= 3)::int), 6) as high from samples"""
)
def a10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean number of tokens, share of long texts, share of high expected classes."""
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9A-Za-z]+"), F.lit(0)))
    high = (F.round(D.expected_class(F.col("predicted_dist")), 9) >= 3).cast("double")
    return samples(spark, sf_dir).agg(F.round(F.avg(n), 6).alias("mean_tokens"), F.round(F.avg((n > 80).cast("double")), 6).alias("over"), F.round(F.avg(high), 6).alias("high"))


@query(
    f"""with {_SAMPLES}, m as (select avg(g[1]) a, avg(g[2]) b, avg(g[3]) c, avg(g[4]) d, avg(g[5]) e from samples)
    select round(5 / a / (1/a + 1/b + 1/c + 1/d + 1/e), 6) as w1, round(5 / e / (1/a + 1/b + 1/c + 1/d + 1/e), 6) as w5 from m"""
)
def a11_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse class frequencies with a mean of 1."""
    w = E.inverse_frequency_weights(samples(spark, sf_dir), "gemma_dist")
    return w.select(F.round(F.col("weights")[0], 6).alias("w1"), F.round(F.col("weights")[4], 6).alias("w5"))


@query(_CLASSES + """ select tc, count(*) filter (where pc = 1) as "1", count(*) filter (where pc = 2) as "2", count(*) filter (where pc = 3) as "3", count(*) filter (where pc = 4) as "4", count(*) filter (where pc = 5) as "5" from c group by tc""")
def a12_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against predictions."""
    top = lambda c: F.array_position(F.col(c), F.array_max(c))
    rows = samples(spark, sf_dir).select(top("predicted_dist").alias("pc"), top("gemma_dist").alias("tc"))
    return E.confusion(rows, "tc", "pc", [1, 2, 3, 4, 5])


@query(_CLASSES + " select pc::int as label, count(*) as n, round(count(*) / (select count(*) from c), 6) as share from c group by 1")
def g20_label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and share of each predicted class."""
    from pyspark.sql import Window

    rows = samples(spark, sf_dir).groupBy(F.array_position("predicted_dist", F.array_max("predicted_dist")).cast("int").alias("label")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # five rows


@query(
    _CLASSES
    + f""" select {_KEY}, passage_id, round({_EXPECT[6:-4]}, 6) as expected from c where tc <= 2 and pc >= 4 order by {_EXPECT} desc, {_KEY} limit 15"""
)
def td_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 most confident false positives of the two highest classes."""
    top = lambda c: F.array_position(F.col(c), F.array_max(c))
    e = F.round(D.expected_class(F.col("predicted_dist")), 9)
    rows = samples(spark, sf_dir).where((top("gemma_dist") <= 2) & (top("predicted_dist") >= 4)).withColumn("e", e)
    return rows.orderBy(F.desc("e"), *S.KEY).limit(15).select(*S.KEY, "passage_id", F.round(D.expected_class(F.col("predicted_dist")), 6).alias("expected"))


@query(_CLASSES + f" select {_KEY}, passage_id from c where tc >= 4 and pc <= 3")
def f11_false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the two highest classes that were predicted lower."""
    top = lambda c: F.array_position(F.col(c), F.array_max(c))
    return samples(spark, sf_dir).where((top("gemma_dist") >= 4) & (top("predicted_dist") <= 3)).select(*S.KEY, "passage_id")


@query(
    """with q as (select passage_id, round(1 / (1 + exp(-score / 5)), 6) as sigmoid, round(1 / (1 + exp(embedding[2]::double - embedding[1]::double)), 6) as yes from techniques where score is not null and embedding is not null)
    select * from q"""
)
def x44_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled sigmoid and yes/no softmax of reranker outputs."""
    t = table(spark, sf_dir, "techniques").where("score is not null and embedding is not null")
    e = F.col("embedding")
    return t.select("passage_id", F.round(D.scaled_sigmoid(F.col("score")), 6).alias("sigmoid"), F.round(D.yes_share(e[0].cast("double"), e[1].cast("double")), 6).alias("yes"))


@query(
    """with w as (select passage_id, arxiv_id, least(4, greatest(0, score)) as s from techniques where score is not null),
    r as (select *, row_number() over (partition by arxiv_id order by s desc, passage_id) - 1 as i from w)
    select arxiv_id, passage_id, i::int as place, s from r where i < 20 and (i = 0 or s >= least(3.0 + i / 4.0, 3.9))"""
)
def f7_technique_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each paper's 20 best passages the first and those above a threshold that rises with the place."""
    from quirework.operators.techniques import above_threshold

    t = table(spark, sf_dir, "techniques").where("score is not null").select("arxiv_id", "passage_id", F.least(F.lit(4.0), F.greatest(F.lit(0.0), "score")).alias("s"))
    return above_threshold(t, "s", ["passage_id"]).select("arxiv_id", "passage_id", "place", "s")


QUERIES, ORACLE = query.queries, query.oracle
