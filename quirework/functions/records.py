"""Checks of model answers: connections with evidence, labels of clusters, ranked selections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONNECTION = (
    "category string, relation_type string, objects array<string>, fields array<string>, evidence array<struct<block_id: string, quote: string>>, "
    "objective struct<description: string>, obstacle struct<description: string>, benefit struct<description: string>"
)
#: The keys that a connection has, all and no others.
CONNECTION_KEYS = ["category", "relation_type", "objects", "fields", "evidence", "objective", "obstacle", "benefit"]


def connection_problem(answer: Column) -> Column:
    """Why a connection's JSON is refused, or null: not an object, wrong keys, no category, no evidence, blank quote."""
    keys = F.json_object_keys(answer)
    one = F.from_json(answer, CONNECTION)
    exact = (F.size(keys) == len(CONNECTION_KEYS)) & (F.size(F.array_intersect(keys, F.array(*map(F.lit, CONNECTION_KEYS)))) == len(CONNECTION_KEYS))
    return (
        F.when(keys.isNull(), "not an object")
        .when(~exact, "wrong keys")
        .when(F.coalesce(F.trim(one["category"]), F.lit("")) == "", "no category")
        .when(F.coalesce(F.size(one["evidence"]), F.lit(0)) <= 0, "no evidence")
        .when(F.exists(one["evidence"], lambda e: F.coalesce(F.trim(e["quote"]), F.lit("")) == ""), "blank quote")
    )


def label_problems(answer: Column, expected: Column) -> Column:
    """struct(missing, unexpected, blank): ids of a JSON map of labels against the expected ids."""
    m = F.from_json(answer, "map<string, string>")
    ids = F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    blank = F.map_keys(F.map_filter(m, lambda k, v: F.coalesce(F.trim(v), F.lit("")) == ""))
    return F.struct(F.array_except(expected, ids).alias("missing"), F.array_except(ids, expected).alias("unexpected"), F.coalesce(blank, F.array().cast("array<string>")).alias("blank"))


def valid_selection(answer: Column, count: Column, available: Column) -> Column:
    """Whether a JSON list holds exactly ``count`` distinct numbers from 0 to available - 1."""
    picked = F.from_json(answer, "array<int>")
    fine = (F.size(picked) == count) & (F.size(F.array_distinct(picked)) == count) & F.forall(picked, lambda i: i.isNotNull() & (i >= 0) & (i < available))
    return F.coalesce(fine, F.lit(False))


#: Fixed value: the mark of a review that is still open.
OPEN_REVIEW = "human review needed"


def decided_notes(notes: Column, match: Column) -> Column:
    """Review notes after a decision: the open mark goes; an uncertain decision gets it back before the reason, any other keeps the reason or says it was reviewed."""
    reason = F.trim(F.regexp_replace(F.coalesce(notes, F.lit("")), rf"(?i){OPEN_REVIEW}\s*:?\s*", ""), F.lit(" \t\n\r"))
    unsure = F.concat(F.lit(OPEN_REVIEW), F.when(reason != "", F.concat(F.lit(": "), reason)).otherwise(""))
    return F.when(match == "uncertain", unsure).when(reason != "", reason).otherwise("Human reviewed.")


def stated(names: list[str]) -> Column:
    """Each column's name in words and its value, or that it is not stated, with blank lines between."""
    parts = [F.concat(F.lit(n.replace("_", " ").title() + "\n"), F.when(F.coalesce(F.col(n), F.lit("")) != "", F.col(n)).otherwise("(not stated)")) for n in names]
    return F.concat_ws("\n\n", *parts)


def evidence_text(evidence: Column) -> Column:
    """Block and quote of each piece of evidence, with blank lines between; what is no such list stays as it is."""
    items = F.from_json(evidence, "array<struct<block_id: string, quote: string>>")
    whole = items.isNotNull() & F.forall(items, lambda e: e.isNotNull() & e["block_id"].isNotNull() & e["quote"].isNotNull())
    return F.when(whole, F.array_join(F.transform(items, lambda e: F.concat(F.lit("["), e["block_id"], F.lit("]\n"), e["quote"])), "\n\n")).otherwise(evidence)
