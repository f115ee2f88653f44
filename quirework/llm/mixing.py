"""Problem 8: mixing sources to target shares of all tokens.

Documents of a source fall into blocks by hash. A source's quota of tokens
becomes whole passes over its blocks and one part of a pass, in permuted order.
A splitting tree deals the drawn blocks to output shards: at each node the left
half gets a multivariate-hypergeometric draw of the blocks below the node, so
every shard holds a random share of each source and together they hold exactly
the quota. Documents are then shuffled within their shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.tokens import VOCABULARY, count_tokens
from quirework.scratch import Scratch

SEED = 20270101
#: Documents of a block, on average; a source has at most MAX_BLOCKS, so tables of blocks are bounded.
BLOCK = 32
MAX_BLOCKS = 16384
#: Documents of an output shard, on average, and the blocks that it has at least, so that its shares come near the targets; where blocks are large, shards
#: are too, and Spark sorts each by its own spill.
SHARD = 2_000
LEAST_BLOCKS = 32


def normalised(source):
    """Source names compare without case and surrounding blanks; an empty name is none."""
    name = F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))
    return F.when(name != "", name)


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): how many of each source's draws every shard gets; columns sum to ``counts``."""
    out = np.zeros((shards, len(counts)), np.int64)

    def deal(lo: int, hi: int, left: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = left
            return
        mid = (lo + hi) // 2
        total = int(left.sum())
        n = round(total * (mid - lo) / (hi - lo))
        drawn = rng.multivariate_hypergeometric(left, n, method="marginals") if total else left
        deal(lo, mid, drawn)
        deal(mid, hi, left - drawn)

    if len(counts):
        deal(0, shards, np.asarray(counts, np.int64))
    return out


@dataclass
class Quota:
    source: str
    target_share: float
    max_repeats: int
    documents: int
    tokens: int
    quota: int = 0


def quotas(targets: list[tuple[str, float, int]], sizes: dict[str, tuple[int, int]]) -> list[Quota]:
    """The token quota of each source: the largest mixture in which every source that has tokens holds its share.

    Sources without tokens have a quota of 0 and their share is spread over the
    others in proportion. Targets of one name add up, with the smaller repeat
    cap. A null or negative share is 0, a null cap 1; a cap of 0 or a share of 0
    leaves the source out.
    """
    merged: dict[str, Quota] = {}
    for source, share, repeats in targets:
        if source is None:
            continue
        share, repeats = max(0.0, share or 0.0), 1 if repeats is None else max(0, repeats)
        n, tokens = sizes.get(source, (0, 0))
        if source in merged:
            own = merged[source]
            own.target_share, own.max_repeats = own.target_share + share, min(own.max_repeats, repeats)
        else:
            merged[source] = Quota(source, share, repeats, n, tokens)
    rows = [merged[s] for s in sorted(merged)]
    usable = [r for r in rows if r.tokens > 0 and r.target_share > 0 and r.max_repeats > 0]
    whole = sum(r.target_share for r in usable)
    if usable:
        total = min(r.tokens * r.max_repeats * whole / r.target_share for r in usable)
        for r in usable:
            r.quota = min(r.tokens * r.max_repeats, int(round(total * r.target_share / whole)))
    return rows


def _sized(documents: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str, vocabulary: str) -> DataFrame:
    rows = documents.select(F.col(id_col).alias("id"), normalised(F.col(source_col).cast("string")).alias("source"), F.col(text_col).alias("text")).where(
        "id is not null and source is not null and text is not null"
    )
    counted = count_tokens(rows, "text", ["id", "source"], vocabulary).where("tokens > 0")
    return scratch.table(counted.groupBy("id").agg(F.min(F.struct("source", "tokens")).alias("x")).select("id", "x.source", "x.tokens"), "sized")


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    rows = targets.select(normalised(F.col("source").cast("string")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    return [tuple(r) for r in rows.orderBy("source", "target_share", "max_repeats").collect()]  # the list of targets is an input of a few rows


def _hash(column, salt: int):
    """Uniform in [0, 1), by the document alone."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mix(
    documents: DataFrame,
    targets: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    vocabulary: str = VOCABULARY,
    seed: int = SEED,
    shard: int = SHARD,
) -> tuple[DataFrame, list[Quota]]:
    """((shard, position, doc_id, source, copy, tokens), quotas): the mixture and what it was to hold.

    Each source with tokens ends at most one document below its quota. copy counts
    a document's uses from 1 to at most max_repeats; position is the shuffled
    order within the shard. Documents with a null id, source or text or without
    tokens, and those of unlisted sources, are not used; a repeated id counts
    once; equal texts under different ids are different documents. Without usable
    documents or targets the mixture is empty. The same input and seed give the
    same mixture, whatever the partitioning.
    """
    sized = _sized(documents, scratch, id_col, text_col, source_col, vocabulary)
    wanted = _targets(targets)
    names = [s for s in {t[0] for t in wanted} if s is not None]
    listed = sized.where(F.col("source").isin(names)) if names else sized.where(F.lit(False))
    sizes = {r.source: (r.n, r.tokens) for r in listed.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).collect()}  # one row a target
    rows = quotas(wanted, sizes)
    used = [r for r in rows if r.quota > 0]
    blocks_of = {r.source: int(min(MAX_BLOCKS, -(-r.documents // BLOCK))) for r in used}
    count = F.coalesce(*[F.when(F.col("source") == s, F.lit(n)) for s, n in blocks_of.items()], F.lit(0)) if used else F.lit(0)
    placed = listed.withColumn("n", count).where("n > 0").withColumn("block", F.floor(_hash("id", seed) * F.col("n")).cast("int")).drop("n")
    table = placed.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).toPandas()  # at most MAX_BLOCKS rows a target

    rng = np.random.default_rng(seed)
    draws: list[list[tuple]] = []
    documents_drawn = 0
    for r in used:
        own = table[table.source == r.source].sort_values("block")
        block, size, n = own.block.to_numpy(), own.tokens.to_numpy(), own.n.to_numpy()
        left, mine = r.quota, []
        for copy in range(1, r.max_repeats + 1):
            for k in rng.permutation(len(block)):
                if left <= 0:
                    break
                mine.append((r.source, int(block[k]), copy, int(min(left, size[k])), bool(size[k] > left)))
                documents_drawn += int(n[k])
                left -= int(size[k])
        draws.append(mine)
    shards = max(1, min(-(-documents_drawn // shard), sum(map(len, draws)) // LEAST_BLOCKS))
    dealt = split_tree(np.array([len(d) for d in draws], np.int64), shards, rng)
    plan = [(*d, s) for mine, per in zip(draws, dealt.T, strict=True) for d, s in zip(mine, np.repeat(np.arange(shards), per).tolist(), strict=True)]
    schema = "source string, block int, copy int, most long, partly boolean, shard int"
    assigned = F.broadcast(scratch.spark.createDataFrame(plan, schema))  # at most MAX_BLOCKS * max_repeats rows a target
    out = placed.join(assigned, ["source", "block"])
    order = Window.partitionBy("source", "block", "copy").orderBy(_hash("id", seed + 1), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = out.where("partly").withColumn("upto", F.sum("tokens").over(order)).where("upto <= most").drop("upto")
    out = out.where("not partly").unionByName(part)
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64("id", "copy", F.lit(seed + 2)), "id", "copy")
    out = out.select("shard", F.row_number().over(shuffled).alias("position"), F.col("id").alias(id_col), "source", "copy", "tokens")
    return out, rows


def shares(mixture: DataFrame, rows: list[Quota]) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, documents, most_uses, tokens, reached_share) of each target; reached shares sum to 1."""
    spark = mixture.sparkSession
    id_col = mixture.columns[2]
    per = mixture.groupBy("source", id_col).agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    got = per.groupBy("source").agg(F.count("*").alias("documents"), F.max("uses").alias("most_uses"), F.sum("tokens").alias("tokens"))
    wanted = spark.createDataFrame([(r.source, r.target_share, r.max_repeats, r.tokens) for r in rows], "source string, target_share double, max_repeats int, available_tokens long")
    zero = F.lit(0).cast("long")
    out = wanted.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "available_tokens", *(F.coalesce(c, zero).alias(c) for c in ("documents", "most_uses", "tokens"))
    )
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # as many rows as targets
    return out.withColumn("reached_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))


def shard_shares(mixture: DataFrame) -> DataFrame:
    """(shard, source, documents, tokens, share): what each output shard holds of each source; the shares of a shard sum to 1."""
    per = mixture.groupBy("shard", "source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    return per.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("shard")))
