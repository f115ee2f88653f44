import base64
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.llm import mixing as M
from quirework.llm import tokens as T
from quirework.scratch import Scratch

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="the public vocabulary is not there")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(T.VOCABULARY, "rb") if line.strip())}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_a_reference_encoder_and_round_trip(text):
    text = text.encode("utf-8", "replace").decode()
    ids = T.encoder(T.VOCABULARY).encode(text)
    assert T.decode(ids) == text


def test_ids_equal(reference):
    own = T.encoder(T.VOCABULARY)
    for text in ["Hello  world's", "we'll <|endoftext|>", "中文 é\x1c\x85 ½²", "x" * 5000, " " * 3000, "\r\n\n\t a", "🙂🙂"]:
        assert own.encode(text) == reference.encode_ordinary(text)


def test_table(spark):
    df = spark.createDataFrame([(1, "one two", 5), (2, "", 5), (3, None, 5), (None, "one two", 5), (1, "one two", 5)], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id or 0), r.ids) for r in T.encode_texts(df).collect())
    assert [g[1] for g in got if g[0] in (2, 3)] == [[], []] and len(got) == 5 and got[0][1] == got[1][1]
    back = T.decode_ids(T.encode_texts(df)).collect()
    assert sorted(r.text for r in back) == ["", "", "one two", "one two", "one two"]
    assert T.encode_texts(df.limit(0)).count() == 0


def test_splitting_tree_deals_every_block():
    dealt = M.split_tree(np.array([100, 7, 0, 31]), 9, np.random.default_rng(1))
    assert dealt.sum(axis=0).tolist() == [100, 7, 0, 31] and dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 4


def documents(spark):
    rows = []
    for i in range(600):
        source = [" Alpha ", "beta", "BETA", "gamma", None, "unlisted", "  "][i % 7]
        rows.append((i, "word " * (i % 13 + 1) if i % 50 else None, source, i))
    rows += [(1, "word", "beta", 0), (None, "word", "beta", 0), (9000, "", "alpha", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_caps_and_determinism(spark):
    t = targets(spark, [("alpha", 0.5, 3), ("beta", 0.2, 1), ("Gamma", 0.2, 2), ("missing", 0.1, 4)])
    mixture, rows = M.mix(documents(spark), t, Scratch(spark, "test"))
    got = mixture.collect()
    report = {r.source: r for r in M.shares(mixture, rows).collect()}
    assert abs(sum(r.reached_share for r in report.values()) - 1) < 1e-9 and report["missing"].tokens == 0
    longest = 14
    for q in rows:
        assert 0 <= q.quota - report[q.source].tokens <= longest and report[q.source].most_uses <= q.max_repeats
    for s, share in (("alpha", 0.5), ("beta", 0.2), ("gamma", 0.2)):
        assert abs(report[s].reached_share - share / 0.9) < 0.02
    uses = {}
    for r in got:
        uses.setdefault((r.doc_id, r.copy), 0)
        uses[r.doc_id, r.copy] += 1
    assert set(uses.values()) == {1}
    assert sorted(r.position for r in got if r.shard == 0) == list(range(1, sum(r.shard == 0 for r in got) + 1))
    again = M.mix(documents(spark).repartition(5), t, Scratch(spark, "test"))[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_tree_draws_follow_the_hypergeometric_law():
    """Over many seeds a shard's draws of a source have the mean and the variance of the hypergeometric law."""
    counts = np.array([60, 30, 10])
    got = np.array([M.split_tree(counts, 4, np.random.default_rng(s))[2] for s in range(2000)])
    mean, n, total = counts / 4, 25, 100
    variance = n * counts / total * (1 - counts / total) * (total - n) / (total - 1)
    assert np.abs(got.mean(axis=0) - mean).max() < 0.2 and np.abs(got.var(axis=0) / variance - 1).max() < 0.15


def test_several_shards_hold_the_same_mixture(spark):
    """Small shards: every document's use lies in one of them, each shard holds near its part of each source."""
    t = targets(spark, [("alpha", 0.5, 3), ("beta", 0.3, 1), ("gamma", 0.2, 2)])
    d = documents(spark).withColumn("doc_id", F.col("doc_id")).crossJoin(spark.range(30).withColumnRenamed("id", "k")).select((F.col("doc_id") + 10_000 * F.col("k")).alias("doc_id"), "text", "source", "tokens")
    mixture, rows = M.mix(d, t, Scratch(spark, "test"), shard=1500)
    got = mixture.collect()
    shards = {r.shard for r in got}
    assert len(shards) >= 5 and len({(r.doc_id, r.copy) for r in got}) == len(got)
    per = M.shard_shares(mixture).collect()
    assert all(abs(sum(r.share for r in per if r.shard == s) - 1) < 1e-9 for s in shards)
    sizes = [sum(r.tokens for r in per if r.shard == s) for s in shards]
    assert max(sizes) < 2 * min(sizes) and sum(sizes) == sum(r.tokens for r in got)
    for s in shards:
        assert abs(sum(r.share for r in per if r.shard == s and r.source == "alpha") - 0.5) < 0.25


def test_nothing_to_mix(spark):
    t = targets(spark, [("alpha", 0.5, 3), (None, 0.5, 1), ("beta", None, None)])
    assert M.mix(documents(spark).limit(0), t, Scratch(spark, "test"))[0].count() == 0
    mixture, rows = M.mix(documents(spark), targets(spark, []), Scratch(spark, "test"))
    assert mixture.count() == 0 and rows == []
    assert [q.quota for q in M.quotas([("a", -1.0, 2), ("b", 0.3, 0), ("c", 0.2, None)], {"a": (1, 9), "b": (1, 9), "c": (2, 10)})] == [0, 0, 10]
