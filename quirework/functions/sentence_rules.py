"""Rules on sentences: which describe a technique, which are history, pointers or organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles of sections that matter.
TITLE = r"(?i)\b(?:results?|contributions?|techniques?|methods?|approach|algorithms?|proof\s+(?:overview|outline|idea)|summary|overview|analysis)\b"

# Signs of a technique, one entry per kind of evidence.
POSITIVE = (
    r"(?i)\b(?:we|this (?:paper|work)|our work)\s+(?:shows?|proves?|establishs?|demonstrates?|obtains?|derives?|gives?|present|resolves?|settles?|improves?|characterizes?|achieves?|answers?|confirms?|refutes?|bounds?|observes?|leverages?)\b",
    r"(?i)\b(?:our|the) (?:main |principal |key |new )?(?:results?|contributions?|proofs?)..+\b|\bmain theorem\b",
    r"(?i)\b(?:we|this (?:paper|work))\s+(?:use|develop|introduce|design|construct|apply|combine|analy[sz]e|reduce|exploit|invoke|establish|formulate)\b",
    r"(?i)\b(?:techniques?|argument|characteri[sz](?:e|ation)|methodology|methods?|approach|algorithms?|constructions?|formulation|idea|strategy|impl[ies|y]|proof (?:idea|strategy|overview))\b",
    r"(?i)\b(?:main|key|crucial|technical) (?:idea|ingredient|tool)\b|\bour (?:proof|argument) (?:uses?|proceeds?|relies?)\b",
    r"(?i)\b(?:we (?:define|call|say)|is defined as|means that|definition of|is called .+ if|by .+ we mean|.+ is the|refer|denote)\b",
    r"(?i)\b(?:rel(?:y|ies)|illustrates?|intuit(?:ion|ively|ive)|start with|informal|inspired|we first|high(?:-|\s)?level)\b",
    r"(?i)\b(?:using|via|based|building)\b",
)

# Signs that a sentence is no description; a rule is a list of (pattern, must match).
NEGATIVE = {
    "historical_context": [(r"(?i)\b(?:previous(?:ly)?|prior (?:work|result)|earlier (?:work|result)|best known|old (?:bound|result)|historical(?:ly)?|for context|history of|discuss the history|their result|the result of which|recent(?:ly)?|introduced)\b", True)],
    "passive_attribution": [(r"(?i)\b(?:was|were|has been|have been)?\s*(?:proved|shown|obtained|introduced|improved|reproved|established|developed|proposed)\s+by\b", True)],
    "attributed_result": [(r"\b(?!(?:We|This|It)\b)[A-Z][a-z]+(?:\s*,\s*[A-Z][a-z]+)*(?:\s+(?:and|&)\s+[A-Z][a-z]+)?(?:\s+\[[^\]]+\])?\s+(?:proved|showed|obtain(?:ed)?|gave|introduced|improved|reproved|established|developed|constructed|were\s+(?:the\s+)?first|was\s+(?:the\s+)?first)\b", True)],
    "cited_work": [(r"(?i)(?:^|\b(?:on the other hand|in contrast)\s*,?\s*)\[[^\]]+\]\s+(?:prove|show|obtain|give|introduce|develop|construct|consider|analy[sz]e)", True)],
    "anaphoric_result": [(r"(?i)^(?:our|the)\s+(?:main\s+|principal\s+|key\s+)?(?:results?|theorem)\s+(?:is|shows?|proves?|establishes?)\s+(?:that\s+)?(?:it|they|this|these|those)\b", True)],
    "prior_citation": [(r"(?i)\b(?:construction|result|bound|method|argument)\s+in\s+\[[^\]]+\]", True)],
    "hypothetical_improvement": [(r"(?i)\bimprovements?\b", True), (r"(?i)\b(?:would|could|might|may)\b", True)],
    "non_current_improvement": [(r"(?i)\bimprovements?\b", True), (r"(?i)\b(?:we|our|this (?:paper|work)|present)\b", False)],
    "section_pointer": [(r"(?i)^(?:first|next|finally)?\s*,?\s*(?:in|see)\s+(?:section|subsection|appendix)\b", True)],
    "statement_lead_in": [(r"(?i)\b(?:result|theorem|bound|corollary|improvement)\b.*\b(?:the following|below)\b|\b(?:the following|below)\b.*\b(?:result|theorem|bound|corollary|improvement)\b", True)],
    "future_overview": [(r"(?i)\bwe\s+(?:will|shall)\s+(?:[a-z]+\s+){0,3}(?:present|give|describe|outline|state)\b.*\b(?:proof|overview|argument|theorem|result|ideas?)\b", True)],
    "notation_setup": [(r"(?i)\b(?:standard\b.*\bnotation|we\s+(?:write|denote|use)\b.*(?:notation|to denote|denoted by))\b", True)],
    "citation_led_organization": [(r"(?i)^(?:finally\s*,?\s*)?in\s+(?:\[[^\]]+\])?\s*,?\s*we\s+(?:present|prove|define|introduce|discuss|describe|show|establish)\b", True)],
    "document_organization": [(r"(?i)\b(?:section|subsection|appendix)\b", True), (r"(?i)\b(?:contains?|present|proofs?|split|introduce|organization)\b", True)],
}
# Fixed value: where a sentence ends.
BOUNDARY = r"(?:(?<=[.!?])|(?<=[.!?][\"'”’]))\s+(?=[A-Z0-9])"


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, BOUNDARY), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def _holds(sentence: Column, rule: list[tuple[str, bool]]) -> Column:
    out = F.lit(True)
    for pattern, wanted in rule:
        hit = sentence.rlike(pattern)
        out = out & (hit if wanted else ~hit)
    return out


def exclusions(sentence: Column) -> Column:
    """Names of the exclusion rules that a sentence meets."""
    return F.filter(F.array(*(F.when(_holds(sentence, rule), F.lit(name)) for name, rule in NEGATIVE.items())), lambda x: x.isNotNull())


def evidence(sentence: Column) -> Column:
    """Numbers of the kinds of evidence that a sentence holds."""
    return F.filter(F.array(*(F.when(sentence.rlike(p), F.lit(i)) for i, p in enumerate(POSITIVE))), lambda x: x.isNotNull())


def paragraph_features(df: DataFrame, header: str, text: str) -> DataFrame:
    """The rows with columns important_title, enrichment_hits, negative_hits, all within one row and without a shuffle.

    Enrichment counts distinct kinds over sentences without an exclusion,
    negative counts distinct exclusions over all sentences. A null text has no
    sentence, a null header is not important.
    """
    rows = df.withColumn("__s", F.coalesce(sentences(F.col(text)), F.array().cast("array<string>")))
    rows = rows.withColumn("__x", F.transform("__s", lambda s: F.struct(exclusions(s).alias("bad"), evidence(s).alias("good"))))
    good = F.array_distinct(F.flatten(F.transform(F.filter("__x", lambda x: F.size(x["bad"]) == 0), lambda x: x["good"])))
    bad = F.array_distinct(F.flatten(F.transform("__x", lambda x: x["bad"])))
    return (
        rows.withColumn("important_title", F.coalesce(F.col(header).rlike(TITLE).cast("int"), F.lit(0)))
        .withColumn("enrichment_hits", F.size(good))
        .withColumn("negative_hits", F.size(bad))
        .drop("__s", "__x")
    )
