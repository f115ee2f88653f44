import pytest
from pyspark.sql import functions as F

from quirework.functions import records as C
from quirework.operators import experiment as X
from quirework.operators import search
from quirework.sources import metadata


def test_review_texts(spark):
    rows = spark.createDataFrame(
        [(0, "Human Review needed: why", "uncertain", '[{"block_id":"a","quote":"q"},{"block_id":"b","quote":"r"}]', ""), (1, "human review needed", "yes", "no list", "x"), (2, None, "no", '[{"block_id":"a"}]', None), (3, "kept", "no", None, " ")],
        "n int, notes string, match string, evidence string, predicted_source string",
    )
    got = {r.n: (r.a, r.b, r.c) for r in rows.select("n", C.decided_notes(F.col("notes"), F.col("match")).alias("a"), C.evidence_text(F.col("evidence")).alias("b"), C.stated(["predicted_source", "match"]).alias("c")).collect()}
    assert got[0] == ("human review needed: why", "[a]\nq\n\n[b]\nr", "Predicted Source\n(not stated)\n\nMatch\nuncertain")
    assert got[1][:2] == ("Human reviewed.", "no list") and got[2][:2] == ("Human reviewed.", '[{"block_id":"a"}]') and got[3][:2] == ("kept", None)


def test_keys_and_headers(spark):
    rows = spark.createDataFrame([(1, "p", "0", "1", "H"), (2, "p", "0", "2", "H")], "line int, arxiv_id string, section_index string, paragraph_index string, section_header string")
    assert [(r.section_index, r.paragraph_index) for r in X.typed_keys(rows).orderBy("line").collect()] == [(0, 1), (0, 2)]
    for bad in (F.lit("x"), F.lit("1.5"), F.lit(None).cast("string"), F.lit("99999999999")):
        with pytest.raises(Exception, match="no key in line"):
            X.typed_keys(rows.withColumn("section_index", bad)).collect()
    assert X.one_header(rows).count() == 2
    with pytest.raises(Exception, match="two headers"):
        X.one_header(rows.withColumn("section_header", F.col("line").cast("string"))).collect()
    told = X.typed_keys(rows).select("arxiv_id", "section_index", "paragraph_index").where("paragraph_index = 2").withColumn("answer", F.lit("a"))
    assert [r.answer for r in X.labelled_in_order(X.typed_keys(rows), told, "line").collect()] == [None, "a"]


def test_one_paper_and_bounds(spark):
    p = spark.createDataFrame([("a", "1", [1.0, 0.0], 1.0), ("b", "2", [0.9, 0.1], 1.0), ("c", "3", [0.0, 1.0], 1.0)], "arxiv_id string, passage_id string, embedding array<float>, score double")
    titles = spark.createDataFrame([("b", "B")], "arxiv_id string, title string")
    assert [(r.target_id, r.target_title) for r in search.query_paper("a", p, titles, 2).orderBy("rank").collect()] == [("b", "B"), ("c", None)]
    assert search.query_paper("none", p, titles, 2).count() == 0
    for k in (0, 101, -1):
        with pytest.raises(ValueError):
            search.query_paper("a", p, titles, k)


def test_best_by_label_in_parts(spark):
    """Every pair of parts gives its best labels; the result is that of one part."""
    import random

    rng = random.Random(3)
    rows = [(f"l{rng.randint(0, 9)}", [rng.gauss(0, 1) for _ in range(5)]) for _ in range(200)]
    df = spark.createDataFrame(rows, "label string, v array<double>")
    q = spark.createDataFrame([(f"q{i % 6}", f"l{i % 3}", [rng.gauss(0, 1) for _ in range(5)]) for i in range(12)], "query_id string, own string, v array<double>")
    for k in (None, 3):
        one, many = search.best_by_label(q, df, k).collect(), search.best_by_label(q, df, k, part_rows=30, part_queries=4).collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and one
    assert search.best_by_label(q.limit(0), df, 3).count() == 0


def test_dates_and_subsets(spark, tmp_path):
    rows = spark.createDataFrame([("2029-01-02T03:04:05Z",), ("2029-01-02T03:04:05+02:00",), ("no",)], "t string")
    assert [str(r.x) for r in rows.select(metadata.from_iso(F.col("t")).alias("x")).collect()] == ["2029-01-02 03:04:05", "2029-01-02 01:04:05", "None"]
    with pytest.raises(ValueError):
        metadata.within_days(F.col("t"), F.current_date(), -1)
    lines = ['{"id": "1", "categories": "cs.LG  x"}', '{"id": "2",   "categories": "physics"}', "broken"]
    metadata.write_subset(spark.createDataFrame([(x,) for x in lines], "value string"), str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == lines[:1]
