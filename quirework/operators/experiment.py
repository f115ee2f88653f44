"""The comparison of contexts: blocks of evidence, what a model is given, decisions per paper and condition, and their measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The three ways to give a paper to a model.
CONDITIONS = ["paragraph", "abstract_introduction", "whole_paper"]

# Words in the header of a section that gives an overview of the proof.
OVERVIEW_WORDS = [
    "overviews?", "contributions?", "techniques?", "methods?", "methodology", "methodologies", "approach", "approaches", "strategy", "strategies", "ideas?", "insights?", "intuitions?",
    r"proof[\s-]+sketch", r"proof[\s-]+sketches", r"proof[\s-]+outlines?", r"proof[\s-]+roadmaps?", r"sketch[\s-]+of[\s-]+(?:the[\s-]+)?proofs?", r"sketches[\s-]+of[\s-]+(?:the[\s-]+)?proofs?",
    r"outlines?[\s-]+of[\s-]+(?:the[\s-]+)?proofs?", r"roadmaps?[\s-]+of[\s-]+(?:the[\s-]+)?proofs?",
]
# Types of statements that count as theorems.
THEOREMS = ["theorem", "mtheorem", "thm", "thrm"]


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n")) == ""


def paper_context(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """(arxiv_id, source, section_index, header, text): what tells most of a paper's proofs.

    The first section, by section_index, that has a paragraph with text and whose
    major header has a word of OVERVIEW_WORDS; without one the first section with
    text (source 'section' for both); without any the abstract (source
    'abstract'). Paragraphs are joined by blank lines. papers and sections hold
    each key once; one aggregate per paper, in which only one section survives the
    map side.
    """
    pattern = r"(?i)\b(?:" + "|".join(OVERVIEW_WORDS) + r")\b"
    own = sections.where(F.exists("text", lambda p: ~blank(p)))
    told = ~F.coalesce("major_section_header", F.lit("")).rlike(pattern)
    text = F.array_join("text", "\n\n", "")
    best = own.groupBy("arxiv_id").agg(F.min(F.struct(told.alias("plain"), "section_index", F.col("major_section_header").alias("header"), text.alias("text"))).alias("s"))
    rows = papers.select("arxiv_id", "abstract").join(best, "arxiv_id", "left")
    there = F.col("s").isNotNull()
    return rows.select(
        "arxiv_id", F.when(there, "section").otherwise("abstract").alias("source"), F.col("s.section_index").alias("section_index"), F.col("s.header").alias("header"), F.when(there, F.col("s.text")).otherwise(F.col("abstract")).alias("text")
    )


def context_blocks(blocks: DataFrame) -> DataFrame:
    """(arxiv_id, condition, context, block_id): which blocks each context of each condition holds, a row each.

    blocks: (arxiv_id, block_id, heading, major_heading, text). Every block is a
    context of its own; all blocks are one; the abstract with every block under a
    header with the word introduction is one. Blank blocks are none. A paper
    without an abstract or without any other block has no context, and one without
    an introduction none of that condition; ``context_problems`` names these.
    """
    rows = _blocks(blocks)
    whole = rows.groupBy("arxiv_id").agg(F.max("body").alias("b"), F.max("abstract").alias("a"), F.max("introduction").alias("i"))
    rows = rows.join(whole.where("a and b"), "arxiv_id")
    each = rows.select("arxiv_id", F.lit("paragraph").alias("condition"), F.col("block_id").alias("context"), "block_id")
    every = rows.select("arxiv_id", F.lit("whole_paper").alias("condition"), F.lit("whole").alias("context"), "block_id")
    some = rows.where("i and (abstract or introduction)").select("arxiv_id", F.lit("abstract_introduction").alias("condition"), F.lit("introduction").alias("context"), "block_id")
    return each.unionByName(every).unionByName(some)


def context_problems(blocks: DataFrame, papers: DataFrame) -> DataFrame:
    """(arxiv_id, problem) of every paper that lacks a context: no source paragraphs, no abstract, or no introduction, the first that applies."""
    whole = _blocks(blocks).groupBy("arxiv_id").agg(F.max("body").alias("b"), F.max("abstract").alias("a"), F.max("introduction").alias("i"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    problem = F.when(no("b"), "no source paragraphs").when(no("a"), "no abstract").when(no("i"), "no introduction")
    return papers.select("arxiv_id").distinct().join(whole, "arxiv_id", "left").select("arxiv_id", problem.alias("problem")).where("problem is not null")


def _blocks(blocks: DataFrame) -> DataFrame:
    head = F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.coalesce("major_heading", F.lit("")))
    abstract = F.col("block_id") == "abstract"
    return blocks.where(~blank(F.col("text"))).select("arxiv_id", "block_id", abstract.alias("abstract"), (~abstract).alias("body"), (~abstract & head.rlike(r"(?i)\bintroduction\b")).alias("introduction"))


def without_top_level(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """Statements but for labelled theorems that no proof of their paper depends on; statements without a label stay.

    edges: (arxiv_id, statement, depends_on). A statement goes by its first label.
    """
    used = edges.select("arxiv_id", F.col("depends_on").alias("__label")).distinct().withColumn("__used", F.lit(True))
    rows = statements.withColumn("__label", F.get("labels", F.lit(0))).join(used, ["arxiv_id", "__label"], "left")
    theorem = F.regexp_replace("statement_type", r"\*+$", "").isin(THEOREMS)
    return rows.where(~(F.coalesce(theorem, F.lit(False)) & F.col("__label").isNotNull() & F.col("__used").isNull())).drop("__label", "__used")


def review_candidates(records: DataFrame, references: DataFrame) -> DataFrame:
    """Every connection of every answer that came back well, beside its paper's reference, with an empty decision.

    records: (arxiv_id, condition, status, connections array of structs);
    references: (arxiv_id, ...), each paper once. A paper without a reference has no rows.
    """
    rows = records.where("status = 'ok'").select("arxiv_id", "condition", F.explode("connections").alias("c")).select("arxiv_id", "condition", "c.*")
    return rows.join(references, "arxiv_id").withColumn("match", F.lit("")).withColumn("review_notes", F.lit(""))


def kept_decisions(candidates: DataFrame, previous: DataFrame, columns: list[str], key: str = "connection_id") -> DataFrame:
    """Candidates with the earlier review's columns of their key, empty for new ones; earlier rows without a candidate go. previous holds each key once."""
    old = previous.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    rows = candidates.drop(*columns).join(old, key, "left")
    return rows.select(*(c for c in rows.columns if not c.startswith("__")), *(F.coalesce(f"__{c}", F.lit("")).alias(c) for c in columns))


def collapsed(decisions: Column) -> Column:
    """The one class of a set of classes, uncertain if there are several, null if there is none."""
    return F.when(F.size(decisions) == 1, F.get(decisions, F.lit(0))).when(F.size(decisions) > 1, "uncertain")


def condition_decisions(expected: DataFrame, requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """(arxiv_id, condition, status, prediction, recovered) of every expected paper and condition.

    expected: (arxiv_id, condition, requests), requests: (arxiv_id, condition,
    request_id, ok), candidates: (arxiv_id, condition, match). incomplete: not
    every expected request came back well, each once; pending_review: a candidate
    has no decision yet; ready otherwise. A yes makes the prediction 'connection'
    and recovers the target, else an uncertain one makes it 'uncertain', else it
    is 'no_connection'.
    """
    keys = ["arxiv_id", "condition"]
    came = requests.groupBy(keys).agg(F.count("*").alias("n"), F.countDistinct("request_id").alias("ids"), F.bool_and("ok").alias("well"))
    m = F.lower(F.trim("match"))
    seen = candidates.groupBy(keys).agg(F.count_if(m == "yes").alias("yes"), F.count_if(m == "uncertain").alias("unsure"), F.count_if(m == "").alias("open"))
    rows = expected.join(came, keys, "left").join(seen, keys, "left")
    whole = F.coalesce((F.col("requests") > 0) & (F.col("n") == F.col("requests")) & (F.col("ids") == F.col("requests")) & F.col("well"), F.lit(False))
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    status = F.when(~whole, "incomplete").when(some("open"), "pending_review").otherwise("ready")
    ready = status == "ready"
    prediction = F.when(some("yes"), "connection").when(some("unsure"), "uncertain").otherwise("no_connection")
    return rows.select(*keys, status.alias("status"), F.when(ready, prediction).alias("prediction"), F.when(ready, some("yes")).alias("recovered"))


def paired(decisions: DataFrame, conditions: list[str], ready: str = "ready") -> DataFrame:
    """Decisions of papers that are ready under every condition."""
    whole = decisions.where(F.col("status") == ready).groupBy("arxiv_id").agg(F.countDistinct("condition").alias("n")).where(F.col("n") == len(conditions))
    return decisions.join(whole, "arxiv_id", "left_semi")


def class_table(decisions: DataFrame, classes: list[str], truth: str = "truth", prediction: str = "prediction", group: str = "condition") -> DataFrame:
    """(condition, class, support, predicted, precision, recall): null where a class has no support, a precision of 0 where it is never predicted."""
    rows = decisions.select(group, F.explode(F.array(*map(F.lit, classes))).alias("class"), (F.col(truth)).alias("t"), F.col(prediction).alias("p"))
    t, p = F.col("t") == F.col("class"), F.coalesce(F.col("p") == F.col("class"), F.lit(False))
    one = rows.groupBy(group, "class").agg(F.count_if(t).alias("support"), F.count_if(p).alias("predicted"), F.count_if(t & p).alias("both"))
    has = F.col("support") > 0
    return one.select(
        group, "class", "support", "predicted", F.when(has, F.when(F.col("predicted") > 0, F.col("both") / F.col("predicted")).otherwise(0.0)).alias("precision"), F.when(has, F.col("both") / F.col("support")).alias("recall")
    )


def timing(requests: DataFrame, seconds: str, group: str, tokens: list[str]) -> DataFrame:
    """(group, calls, total, median, p95, and the sum of each token column): the sum of a column without any value is null, not 0."""
    sums = [F.sum(t).alias(t) for t in tokens]  # of nulls alone the sum is null
    return requests.groupBy(group).agg(F.count("*").alias("calls"), F.sum(seconds).alias("total"), F.percentile(seconds, F.lit(0.5)).alias("median"), F.percentile(seconds, F.lit(0.95)).alias("p95"), *sums)


# Text scopes of keyword search.

SCOPES = {"title": ["title"], "title_abstract": ["title", "abstract"], "title_abstract_intro": ["title", "abstract", "introduction"]}


def matched_corpora(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """(arxiv_id, title, abstract, introduction) of the papers that have all three, so that every scope sees the same papers.

    introduction: the paragraphs, in order, of the first section whose header has
    the word introduction, joined by blank lines.
    """
    head = F.concat_ws(" ", "section_header", "major_section_header").rlike(r"(?i)\bintroduction\b")
    text = F.array_join(F.filter("text", lambda p: ~blank(p)), "\n\n")
    first = sections.where(head).select("arxiv_id", "section_index", text.alias("t")).where(~blank(F.col("t"))).groupBy("arxiv_id").agg(F.min(F.struct("section_index", "t")).alias("s"))
    rows = papers.select("arxiv_id", "title", "abstract").join(first, "arxiv_id").select("arxiv_id", "title", "abstract", F.col("s.t").alias("introduction"))
    return rows.where(~blank(F.col("title")) & ~blank(F.col("abstract")))


def scope_text(scope: str) -> Column:
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}; one of {', '.join(SCOPES)}")
    return F.concat_ws("\n\n", *SCOPES[scope])


def passage_ids(techniques: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with technique_index, from 0 in the given order within the paper, and the id made of both."""
    w = Window.partitionBy("arxiv_id").orderBy(*order)
    rows = techniques.withColumn("technique_index", F.row_number().over(w) - 1)
    return rows.withColumn("technique_id", F.concat_ws("::", "arxiv_id", F.lit("technique"), F.col("technique_index").cast("string")))


# Keys and sections of delimited rows.


def typed_keys(rows: DataFrame, line: str = "line") -> DataFrame:
    """(arxiv_id, section_index, paragraph_index, ...) with whole numbers as the last two parts of the key; at run time a part that is none is an error that names the line."""
    number = lambda c: F.when(F.col(c).rlike(r"\A[0-9]+\z"), F.col(c).try_cast("int"))
    fine = (F.trim(F.coalesce("arxiv_id", F.lit(""))) != "") & number("section_index").isNotNull() & number("paragraph_index").isNotNull()
    good = F.when(F.coalesce(fine, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no key in line "), F.col(line).cast("string"))).cast("boolean"))
    kept = [c for c in rows.columns if c not in ("arxiv_id", "section_index", "paragraph_index")]
    return rows.where(good).select("arxiv_id", number("section_index").alias("section_index"), number("paragraph_index").alias("paragraph_index"), *kept)


def one_header(rows: DataFrame, header: str = "section_header") -> DataFrame:
    """The rows of sections; at run time a section whose rows do not agree on the header is an error."""
    w = Window.partitionBy("arxiv_id", "section_index")
    h = F.coalesce(header, F.lit(""))
    marked = rows.withColumn("__low", F.min(h).over(w)).withColumn("__high", F.max(h).over(w))
    fine = F.when(F.col("__low") == F.col("__high"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("two headers of a section of "), "arxiv_id")).cast("boolean"))
    return marked.where(fine).drop("__low", "__high")


def labelled_in_order(rows: DataFrame, answers: DataFrame, position: str = "line_id") -> DataFrame:
    """The rows with the answers of their key, in the order that they came in. answers: (arxiv_id, section_index, paragraph_index, answer), each key once."""
    keys = ["arxiv_id", "section_index", "paragraph_index"]
    return one_header(rows).join(answers, keys, "left").orderBy(position)
