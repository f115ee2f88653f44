import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import linking
from quirework.llm import near_duplicates as nd
from quirework.llm.common import words
from quirework.scratch import Scratch

SCHEMA = "passage_id string, passage string, key long, h string, a int"


def brute_groups(rows, threshold=0.7):
    sets = {}
    for i, text in rows:
        if i is not None and text and (w := set(words(text))):
            sets.setdefault(i, w)
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]) - 1e-9:
                a, b = sorted((find(x), find(y)))
                top[b] = a
    return {i: find(i) for i in ids}


def pairs(group_of):
    return {(x, y) for x in group_of for y in group_of if x < y and group_of[x] == group_of[y]}


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], SCHEMA)
    members, groups, links = nd.near_duplicates(df, Scratch(spark, "test"), **options)
    return {r.id: r.group for r in nd.grouped_rows(members, groups).collect()}, links


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(n)]
    out = []
    for k, own in enumerate(base):
        out.append((f"p{k}", " ".join(own)))
        for c in range(k % 4):
            changed = list(own)
            for _ in range(rng.randint(1, 9)):
                at = rng.randrange(len(changed))
                changed[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
            out.append((f"p{k}-{c}", (". " if c else " ").join(changed).upper()))
    return out


def test_groups_equal_brute_force(spark):
    rows = corpus(120) + [("null", None), ("empty", ""), ("blank", " \n"), ("signs", "?!"), (None, "some words here")]
    got, links = run(spark, rows)
    assert pairs(got) == pairs(brute_groups(rows))
    assert set(got) == set(brute_groups(rows))
    for r in links.collect():
        assert r.similarity >= 0.7 and 0 <= r.alignment <= 1


def test_copies_repeated_rows_and_short_texts(spark):
    rows = [("a", "QED"), ("b", "qed."), ("c", "a b c d"), ("d", "d c b a"), ("e", "a b c"), ("c", "a b c d"), ("f", "nothing alike")]
    got, links = run(spark, rows)
    assert pairs(got) == {("a", "b"), ("c", "d"), ("c", "e"), ("d", "e")}
    assert links.count() == 3


def test_empty_table_and_very_long_text(spark):
    assert run(spark, [])[0] == {}
    long = " ".join(f"n{i % 977} m{i}" for i in range(40_000))
    got, _ = run(spark, [("x", long), ("y", long + " tail"), ("z", "short text of its own")])
    assert pairs(got) == {("x", "y")}


def test_hot_bucket_takes_the_hub_path(spark):
    """A third of all rows are near-copies of one text: with small limits every bucket of theirs is a hot one."""
    rng = random.Random(5)
    base = [f"h{i}" for i in range(60)]
    hot = [(f"hot{i}", " ".join(base[: i % 50] + [f"x{i}"] + base[i % 50 :])) for i in range(90)]
    rows = hot + corpus(60, 11)
    rng.shuffle(rows)
    got, _ = run(spark, rows, direct=8)
    assert pairs(got) == pairs(brute_groups(rows))


def test_hub_path_finds_links_not_through_the_hub(spark):
    """Items of one bucket in a chain: the hub is linked to none of the far ones."""
    sketch = spark.createDataFrame([(1, k, 0) for k in range(40)], "h long, key long, bits long")
    verify = lambda p: p.where("b - a = 1 or a = 10 and b = 30")
    comps, links = linking.link_components(sketch, verify, 64, Scratch(spark, "test"), direct=4, block=7)
    assert {r.comp for r in comps.collect()} == {0} and comps.count() == 40
    assert links.where("b - a = 1").count() == 39


def test_links_of_a_hot_bucket_are_complete(spark):
    """With complete links every pair within the threshold is one, in hot buckets too; without, components are the same."""
    sketch = spark.createDataFrame([(1, k, 0) for k in range(40)] + [(2, k, 0) for k in range(5)], "h long, key long, bits long")
    verify = lambda p: p.where("b - a <= 3")
    comps, links = linking.link_components(sketch, verify, 64, Scratch(spark, "test"), direct=4, block=7, complete=True)
    assert {(r.a, r.b) for r in links.collect()} == {(a, b) for a in range(40) for b in range(a + 1, min(a + 4, 40))}
    few, some = linking.link_components(sketch, verify, 64, Scratch(spark, "test"), direct=4, block=7)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in comps.collect()} and some.count() < links.count()


def test_exact_candidates_miss_no_pair(spark):
    """Texts of few words, and pairs right at the threshold, where sketches are least sure."""
    rng = random.Random(9)
    rows = []
    for k in range(150):
        own = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 24))]
        rows.append((f"a{k}", " ".join(own)))
        rng.shuffle(own)
        rows.append((f"b{k}", " ".join(own[: max(1, round(len(own) * 0.75))])))
    got, links = run(spark, rows, exact=True)
    assert pairs(got) == pairs(brute_groups(rows))
    sets = {}
    for _, text in rows:
        sets[tuple(words(text))] = set(words(text))
    own = list(sets.values())
    assert links.count() == sum(len(x & y) >= 0.7 * len(x | y) - 1e-9 for i, x in enumerate(own) for y in own[i + 1 :])


def test_texts_in_another_order_are_linked_though_alignment_proves_nothing(spark):
    a, b = [f"x{i}" for i in range(40)], [f"y{i}" for i in range(40)]
    got, links = run(spark, [("p", " ".join(a + b)), ("q", " ".join(b + a)), ("r", " ".join(a + b[:36]))])
    assert pairs(got) == {("p", "q"), ("p", "r"), ("q", "r")}
    assert min(r.alignment for r in links.collect()) < 0.2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 9), min_size=1, max_size=15), st.lists(st.integers(1, 9), min_size=1, max_size=15)), min_size=1, max_size=5))
def test_proven_similarity_is_a_lower_bound(pairs_):
    aligned = nd.banded_alignment([(np.array(a, np.uint32), np.array(b, np.uint32)) for a, b in pairs_])
    sets = [(set(a), set(b)) for a, b in pairs_]
    low = nd.proven(aligned, np.array([max(len(a), len(b)) for a, b in pairs_]), *(np.array([len(p[i]) for p in sets]) for i in range(2)))
    for (x, y), value in zip(sets, low, strict=True):
        assert value <= len(x & y) / len(x | y) + 1e-9


def test_pairs_of_large_groups_come_in_blocks(spark):
    rows = spark.createDataFrame([(1, f"i{k:02d}") for k in range(30)] + [(2, "z"), (3, "x"), (3, "y")], "group long, id string")
    want = {(f"i{a:02d}", f"i{b:02d}") for a in range(30) for b in range(a + 1, 30)} | {("x", "y")}
    for block in (4, 4096):
        got = nd.pairs_of_groups(rows, block).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), max_size=15), st.lists(st.integers(1, 4), max_size=15)), min_size=1, max_size=5))
def test_banded_alignment_equals_edit_distance(pairs_):
    got = nd.banded_alignment([(np.array(a, np.uint32), np.array(b, np.uint32)) for a, b in pairs_])
    for (a, b), value in zip(pairs_, got, strict=True):
        assert abs(value - (1 - edit_distance(a, b) / max(len(a), len(b), 1))) < 1e-6


def test_occurrence_labels_tell_repeats_apart():
    flat = np.array([5, 5, 5, 7], np.uint64)
    kmers, first = nd._kmers(flat, np.array([0, 4]), 1)
    assert len(set(nd._labelled(kmers, first).tolist())) == 4
