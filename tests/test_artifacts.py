import gzip
import json

import pytest
from pyspark.sql import functions as F

from quirework.functions import distributions as D
from quirework.operators import answers, experiment, storage, workflow
from quirework.operators.deltas import Store, retried
from quirework.scratch import Scratch
from quirework.sources import artifacts as A
from quirework.sources import atom, files

PAPERS = "arxiv_id string, title string, abstract string, embedding_dim int, area_embedding array<float>"


def papers(spark, n=5):
    return spark.createDataFrame([(f"p{i}", f"T{i}", f"A{i}", 2, [1.0, float(i)]) for i in range(n)], PAPERS)


def passages(spark, n=5, dim=2):
    return spark.createDataFrame([(f"t{i}", f"p{i % n}", f"text {i}", float(i % 4), [1.0] * dim) for i in range(2 * n)], "passage_id string, arxiv_id string, passage string, score double, embedding array<float>")


def test_batches_round_trip_and_checks(spark, tmp_path):
    path = str(tmp_path / "run")
    with pytest.raises(FileNotFoundError, match="papers, techniques"):
        A.read_batches(spark, path)
    p = A.batched(papers(spark), 2)
    t = passages(spark).join(p.select("arxiv_id", "batch"), "arxiv_id")
    A.write_batches(p, t, path)
    a, b = A.read_batches(spark, path)
    assert a.count() == 5 and b.count() == 10 and {r.batch for r in a.collect()} == {1, 2, 3}
    A.write_batches(p, passages(spark, dim=3).join(p.select("arxiv_id", "batch"), "arxiv_id"), path)
    with pytest.raises(Exception, match="another length of vector"):
        A.read_batches(spark, path)[1].collect()
    A.write_batches(p.unionByName(p.limit(1)), t, path)
    with pytest.raises(Exception, match="repeated key"):
        A.read_batches(spark, path)[0].collect()
    assert A.missing_files(spark, path) == [] and A.batch_names_differ(p, t.where("batch < 3")).collect()[0].side == "missing"


def test_runs_resume_by_batch_and_upload_once(spark, tmp_path):
    path, seen = str(tmp_path / "run"), []
    store = Store(spark, str(tmp_path / "store"))

    def embed(own):
        ids = sorted(r.arxiv_id for r in own.collect())
        seen.append(ids)
        if ids == ["p2", "p3"] and len(seen) == 2:
            raise RuntimeError("the model failed")
        return own, passages(spark).join(own.select("arxiv_id"), "arxiv_id", "left_semi")

    with pytest.raises(RuntimeError):
        A.run_batches(spark, papers(spark), path, 2, embed, {"n": 1}, store)
    assert [c["batch"] for c in store.commits()] == ["batch-1"]
    with pytest.raises(ValueError, match="other settings"):
        A.run_batches(spark, papers(spark), path, 2, embed, {"n": 2}, store)
    assert A.run_batches(spark, papers(spark), path, 2, embed, {"n": 1}, store) == 2
    assert seen == [["p0", "p1"], ["p2", "p3"], ["p2", "p3"], ["p4"]]
    assert A.run_batches(spark, papers(spark), path, 2, embed, {"n": 1}, store) == 0
    assert store.read("papers").count() == 5 and store.read("techniques").count() == 10 and len(store.commits()) == 3
    assert {(r.arxiv_id, r.state) for r in A.coverage(papers(spark, 6), A.read_batches(spark, path)[0]).collect() if r.state != "stored"} == {("p5", "missing")}
    assert {r.batch: r.done for r in A.resumable(papers(spark, 6), papers(spark), 2).collect()} == {1: True, 2: True, 3: False}
    with pytest.raises(ValueError):
        A.next_state("lost")


def test_a_commit_is_whole_or_absent(spark, tmp_path):
    """A failure while the second table is written leaves nothing to be read; the batch then comes in once."""
    store = Store(spark, str(tmp_path / "store"))
    bad = papers(spark).withColumn("title", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.commit("one", {"techniques": passages(spark), "papers": bad})
    assert store.commits() == [] and store.read("techniques") is None
    assert store.commit("one", {"techniques": passages(spark), "papers": papers(spark)}) and not store.commit("one", {"papers": papers(spark)})
    later = passages(spark).withColumn("score", F.lit(9.0)).withColumn("passage_id", F.lit("other"))
    store.commit("two", {"techniques": later.limit(3), "loose": papers(spark)})
    store.commit("three", {"loose": papers(spark)})
    rows = store.read("techniques").collect()
    assert len(rows) == 10 and sum(r.score == 9 for r in rows) == 3 and all(r.passage_id != "other" for r in rows)
    assert store.read("loose").count() == 10
    assert store.compact("techniques", "c") and sorted(map(tuple, store.read("techniques").collect())) == sorted(map(tuple, rows))
    assert A.rows_of("papers", None, store).count() == 5
    for local, other in ((None, None), (rows, store)):
        with pytest.raises(ValueError):
            A.rows_of("papers", local, other)
    with pytest.raises(FileNotFoundError):
        A.rows_of("missing", None, store)
    with pytest.raises(ValueError):
        A.call({}, "none", {})


def test_retries():
    calls, waits = [], []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("gone")
        return "done"

    assert retried(work, 3, 1.0, waits.append, lambda: 0.0) == "done" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        retried(lambda: (_ for _ in ()).throw(OSError()), 2, 0, waits.append)
    with pytest.raises(ValueError):
        retried(lambda: int("x"), 5, 0, lambda _: pytest.fail("a wrong value is not tried again"))
    with pytest.raises(ValueError):
        retried(work, 0)


def test_source_papers_and_placed_answers(spark, tmp_path):
    sections = spark.createDataFrame([("p0", 0, "H", "H", ["a", None], "x"), ("p0", 0, "H", "H", ["a", None], "x")], "arxiv_id string, section_index int, section_header string, major_section_header string, text array<string>, raw_latex string")
    rows = A.source_papers(papers(spark, 2).withColumn("primary_category", F.lit("c")), sections)
    A.write_source_papers(rows, str(tmp_path / "s"))
    back = A.read_source_papers(spark, str(tmp_path / "s"), rows.schema, False, papers(spark, 1))
    assert [(r.arxiv_id, r.section_index, r.text) for r in back.collect()] == [("p0", 0, ["a", None])]
    with pytest.raises(Exception, match="other proofs"):
        A.read_source_papers(spark, str(tmp_path / "s"), rows.schema, True).collect()
    p = spark.createDataFrame([("p", 0, 1), ("p", 0, 0), ("q", 0, 0)], "arxiv_id string, section_index int, paragraph_index int")
    a = spark.createDataFrame([("p", ["x", "y"]), ("q", ["z"])], "arxiv_id string, answers array<string>")
    assert {(r.arxiv_id, r.paragraph_index): r.answer for r in A.placed_answers(p, a).collect()} == {("p", 0): "x", ("p", 1): "y", ("q", 0): "z"}
    with pytest.raises(Exception, match="wrong number of answers"):
        A.placed_answers(p, a.withColumn("answers", F.array(F.lit("x")))).collect()
    with pytest.raises(Exception, match="null part"):
        A.keyed(p.withColumn("arxiv_id", F.lit(None).cast("string")), "labels").collect()


ENTRY = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:a="http://arxiv.org/schemas/atom"><entry><id>http://x.example/abs/2901.00001v3</id><title> A\n title</title><summary>Text</summary><published>2029-01-02T03:04:05Z</published><author><name> Doe  J </name></author><author><name> </name></author><link rel="related" href="http://x.example/r"/><link href="http://x.example/p"/><a:primary_category term="cs.LG"/><a:doi>10.1/x</a:doi></entry></feed>'


def test_atom_entries(spark):
    got = atom.parse_entry(ENTRY)
    assert (got["arxiv_id"], got["title"], got["authors"], got["url"], got["doi"], got["primary_category"]) == ("2901.00001", "A title", ["Doe J"], "http://x.example/p", "10.1/x", "cs.LG")
    for broken, problem in ((None, "no XML"), ("<a", "no XML"), ("<feed/>", "no entry"), (ENTRY.replace("Doe", "").replace("J", ""), "no authors"), (ENTRY.replace("2029-", "x"), "no publication_date"), (ENTRY.replace('term="cs.LG"', ""), "no primary_category")):
        assert atom.parse_entry(broken) == {"problem": problem}
    rows = atom.parse_feeds(spark.createDataFrame([(1, ENTRY), (2, None)], "n int, value string"), keep=["n"]).collect()
    assert {r.n: r.problem for r in rows} == {1: None, 2: "no XML"}


def test_contexts_and_decisions(spark):
    blocks = spark.createDataFrame(
        [("p", "abstract", "Abstract", "Abstract", "t"), ("p", "s0_p0", "Introduction", "", "x"), ("p", "s1_p0", "Proof", None, "y"), ("p", "s1_p1", "Proof", None, " "), ("q", "s0_p0", "Proof", "", "x"), ("r", "abstract", "Abstract", "Abstract", "t"), ("r", "s0_p0", None, None, "x")],
        "arxiv_id string, block_id string, heading string, major_heading string, text string",
    )
    got = {(r.arxiv_id, r.condition, r.context, r.block_id) for r in experiment.context_blocks(blocks).collect()}
    assert len([g for g in got if g[0] == "p" and g[1] == "whole_paper"]) == 3 and {g[3] for g in got if g[:2] == ("p", "abstract_introduction")} == {"abstract", "s0_p0"}
    assert not [g for g in got if g[0] == "q" or g[:2] == ("r", "abstract_introduction")]
    ids = spark.createDataFrame([("p",), ("q",), ("r",), ("s",)], "arxiv_id string")
    assert {r.arxiv_id: r.problem for r in experiment.context_problems(blocks, ids).collect()} == {"q": "no abstract", "r": "no introduction", "s": "no source paragraphs"}
    expected = spark.createDataFrame([(i, "c", n) for i, n in (("a", 2), ("b", 1), ("d", 1), ("e", 1), ("f", 1))], "arxiv_id string, condition string, requests int")
    requests = spark.createDataFrame([("a", "c", 1, True), ("b", "c", 1, True), ("d", "c", 1, True), ("e", "c", 1, True), ("f", "c", 1, False)], "arxiv_id string, condition string, request_id int, ok boolean")
    found = spark.createDataFrame([("b", "c", "yes"), ("b", "c", "uncertain"), ("d", "c", " "), ("e", "c", "Uncertain")], "arxiv_id string, condition string, match string")
    rows = {r.arxiv_id: (r.status, r.prediction, r.recovered) for r in experiment.condition_decisions(expected, requests, found).collect()}
    assert rows == {"a": ("incomplete", None, None), "b": ("ready", "connection", True), "d": ("pending_review", None, None), "e": ("ready", "uncertain", False), "f": ("incomplete", None, None)}


def test_overview_falls_back_to_first_section_and_abstract(spark):
    p = spark.createDataFrame([("a", "t", "abs a"), ("b", "t", "abs b"), ("c", "t", None)], "arxiv_id string, title string, abstract string")
    s = spark.createDataFrame([("a", 0, "Main", ["x"]), ("a", 1, "Our approach", ["y", "z"]), ("a", 2, "Methods", ["w"]), ("b", 0, "Ideas", [" "]), ("b", 3, None, ["q", None])], "arxiv_id string, section_index int, major_section_header string, text array<string>")
    got = {r.arxiv_id: (r.source, r.section_index, r.text) for r in experiment.paper_context(p, s).collect()}
    assert got == {"a": ("section", 1, "y\n\nz"), "b": ("section", 3, "q\n\n"), "c": ("abstract", None, None)}


def test_plugged_answers(spark):
    df = spark.createDataFrame([("a", "x"), ("b", " "), ("c", None)], "k string, t string")
    rows = {r.k: r.embedding for r in answers.embedded(df, "t", answers.digest_encoder(4), "p: ").collect()}
    assert abs(sum(x * x for x in rows["a"]) - 1) < 1e-9 and rows["b"] is None and rows["c"] is None
    s = spark.createDataFrame([("p", 0, i) for i in range(3)] + [("q", 0, 0)], "arxiv_id string, section_index int, statement_index int")
    for answer, want in (("[2, 0]", {2: 0, 0: 1}), ("[0, 0]", {}), ("[3, 0]", {}), ("[0]", {}), ("no", {})):
        a = spark.createDataFrame([("p", answer)], "arxiv_id string, answer string")
        assert {r.statement_index: r["rank"] for r in answers.selected_statements(s, a, 2).collect()} == want
    assert answers.selected_statements(s, spark.createDataFrame([("q", "[0]")], "arxiv_id string, answer string"), 2).count() == 1
    p = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "k string, t string")
    none = spark.createDataFrame([], "k string, fingerprint string, answer array<double>")
    first, fresh = answers.weak_labels(p, none, "k", "t", "v1", answers.digest_encoder(D.CLASSES))
    _, again = answers.weak_labels(p, fresh, "k", "t", "v1", answers.digest_encoder(D.CLASSES))
    _, other = answers.weak_labels(p, fresh, "k", "t", "v2", answers.digest_encoder(D.CLASSES))
    assert first.count() == 3 and again.count() == 0 and other.count() == 3 and all(abs(sum(r.distribution) - 1) < 1e-9 for r in first.collect())


def test_cluster_labels_come_from_children(spark):
    tree = spark.createDataFrame([(0, -1), (1, 0), (2, 0), (3, 1)], "cluster_id int, parent_cluster_id int")
    members = spark.createDataFrame([(3, "a"), (2, "b"), (2, "c"), (1, "a"), (0, "a"), (0, "b")], "cluster_id int, arxiv_id string")
    titles = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "arxiv_id string, title string")
    load = lambda: lambda prompts: ["<" + p.split(":\n", 1)[1].replace("\n", "+") + ">" for p in prompts]
    got = {r.cluster_id: r.label for r in answers.labelled_clusters(tree, members, titles, load, Scratch(spark, "t")).collect()}
    assert got == {3: "<A>", 2: "<B+C>", 1: "<<A> (1)>", 0: "<<<A> (1)> (1)+<B+C> (2)>"}
    assert {r.label for r in answers.sibling_problems(tree, spark.createDataFrame([(1, "x"), (2, "X ")], "cluster_id int, label string")).collect()} == {"x", ""}


def test_commands_end_to_end(spark, tmp_path):
    """Download, embed, coordinates, clusters and centroids of a few papers, each from what the one before has stored."""
    folder = tmp_path / "archives"
    folder.mkdir()
    for i in range(12):
        tex = "\\documentclass{article}\\begin{document}" + "".join(f"\\section{{S{k}}}Paper {i} says thing {k}.\n\nMore of {i} {k}." for k in range(3)) + "\\end{document}"
        (folder / f"p{i}.gz").write_bytes(gzip.compress(tex.encode()))
    (tmp_path / "papers.json").write_text("".join(json.dumps({"arxiv_id": f"p{i}", "title": f"T{i}", "abstract": f"A{i}"}) + "\n" for i in range(12)))
    at = lambda name: str(tmp_path / name)
    assert workflow.main(["download", at("papers.json"), str(folder), "--output", at("sections")]) == 0
    assert spark.read.parquet(at("sections")).select("arxiv_id").distinct().count() == 12
    assert workflow.main(["embed", at("papers.json"), at("sections"), "--output", at("run"), "--batch-size", "7", "--store", at("store")]) == 0
    p, t = A.read_batches(spark, at("run"))
    assert p.count() == 12 and t.select("arxiv_id").distinct().count() == 12 and Store(spark, at("store")).read("papers").count() == 12
    assert workflow.check_papers(p) == [] and workflow.check_papers(p.withColumn("title", F.lit(" "))) == ["12 papers without title or abstract"]
    assert workflow.main(["generate_coords", at("run"), "--output", at("coords")]) == 0
    assert workflow.main(["cluster", at("run"), "--min-cluster-size", "3", "--output", at("clusters")]) == 0
    assert workflow.main(["generate_centroids", at("clusters") + "/memberships", at("coords"), "--output", at("centroids")]) == 0
    got = A.centroid_of_field(spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(at("centroids"))).collect()
    assert got and all(r.x is not None and r.y is not None for r in got)
    assert workflow.main(["cluster", at("run"), "--min-cluster-size", "1", "--output", at("other")]) == 1
    assert workflow.main(["generate_coords", at("run"), "--output", at("run")]) == 1
    for options in ({"pooling": "sum"}, {"batch_size": 0}, {"merge_threshold": 2.0}, {"min_samples": 0}):
        with pytest.raises(ValueError):
            workflow.check_options(**options)


def test_chunker_cuts_paragraphs(spark):
    tex = b"\\documentclass{article}\\begin{document}\\section{A}One part. Another part.\\end{document}"
    rows = spark.createDataFrame([("p", bytearray(tex))], "arxiv_id string, content binary")
    got = files.sections_of_archives(rows, chunker=lambda p: p.split(". ")).collect()
    assert [r.text for r in got] == [["One part", "Another part"]]


def test_manifests_are_replaced_by_one_rename(spark, tmp_path):
    path = str(tmp_path / "m" / "manifest")
    for n in range(3):
        storage.write_manifest(spark, path, {"n": n})
        assert storage.read_manifest(spark, path) == {"n": n}
    assert [p.name for p in (tmp_path / "m").iterdir() if not p.name.startswith(".")] == ["manifest"]
