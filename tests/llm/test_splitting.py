import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import splitting as S
from quirework.scratch import Scratch

PIECES = st.lists(st.sampled_from(["a", "bc ", ". ", ".", "\n", "\n\n", "! ", "é。", "\r\n", "  \n \n", '."', "word ", "…” ", "\u3000", "\u2003x", "\xa0", "？ ", "😀", "\t\r\n"]), max_size=1500).map("".join)


BOUNDARY = re.compile(r"(?P<l>\n)|(?P<s>[.!?…][\"'”’)\]]?(?=\s)|[。！？])|(?P<w>\S(?=\s))")


def brute_boundaries(text):
    kind = {"l": S.LINE_END, "s": S.SENTENCE_END, "w": S.WORD_END}
    found = {}
    for m in BOUNDARY.finditer(text):
        found[m.end()] = S.PARAGRAPH_END if m.lastgroup == "l" and re.search(r"\n[ \t]{0,4}\r?\n\Z", text[max(0, m.end() - 8) : m.end()]) else kind[m.lastgroup]
    return sorted(found.items())


@settings(max_examples=150, deadline=None)
@given(PIECES, st.integers(5, 300))
def test_boundaries_of_byte_ranges_equal_those_of_the_text(text, size):
    at, kind = S.boundaries(text, size)
    assert list(zip(at.tolist(), kind.tolist(), strict=True)) == brute_boundaries(text)
    whole = S.Stitched(text.encode(), size)
    for point in range(0, len(text) + 1, 7):
        assert whole.byte(point) == len(text[:point].encode()) and whole.point(whole.byte(point)) == point


def check(text, cut, most=1500, overlap=(100, 200)):
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    assert all(0 < e - s <= most for s, e in cut) or not text
    for (_, e), (s, f) in zip(cut, cut[1:], strict=False):
        assert overlap[0] <= e - s <= overlap[1] and f > e


@settings(max_examples=60, deadline=None)
@given(PIECES, st.integers(7, 300))
def test_pieces_cover_and_ranges_do_not_matter(text, size):
    cut = S.split(text)
    check(text, cut)
    whole, ranged = S.boundaries(text, 10**9), S.boundaries(text, size)
    assert np.array_equal(whole[0], ranged[0]) and np.array_equal(whole[1], ranged[1])


def test_best_boundary_wins():
    text = "w" * 800 + ".\n\n" + "x " * 900
    assert S.split(text)[0] == (0, 803)
    assert S.split("y" * 4000)[0] == (0, 1500)
    assert S.split("z" * 1500) == [(0, 1500)]
    with pytest.raises(ValueError):
        S.plan(9000, np.array([]), np.array([]), 100, (60, 90))


def test_tables(spark):
    long = "One sentence here. " * 200
    sections = spark.createDataFrame(
        [("p", 0, ["short", long, None, ""], "x"), ("p", 0, ["short", long, None, ""], "x"), ("q", None, None, "x"), (None, 2, [long], None)], "arxiv_id string, section_index int, text array<string>, start string"
    )
    paragraphs = spark.createDataFrame([("p", 0, 1, long), ("p", 0, 1, long), ("p", 0, 2, None), ("p", 0, 3, "é" * 1500), ("p", 0, 4, "é" * 1501)], "arxiv_id string, section_index int, paragraph_index int, text string")
    got = S.oversized_paragraphs(sections, paragraphs).collect()
    keys = {(r.table_name, r.arxiv_id, r.section_index, r.paragraph_index) for r in got}
    assert keys == {("sections", "p", 0, 1), ("sections", None, 2, 0), ("paragraphs", "p", 0, 1), ("paragraphs", "p", 0, 4)}
    for key in keys:
        own = sorted((r.piece_index, r.start, r.end, r.piece) for r in got if (r.table_name, r.arxiv_id, r.section_index, r.paragraph_index) == key)
        source = "é" * 1501 if key[3] == 4 else long
        assert [r[3] for r in own] == [source[r[1] : r[2]] for r in own] and [r[0] for r in own] == list(range(len(own)))
        check(source, [(r[1], r[2]) for r in own])
    assert S.oversized_paragraphs(sections.limit(0), paragraphs.limit(0)).count() == 0


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(rng.choice(["word ", "né. ", "中文。", "line\n", "end.\n\n", "x" * 40]) for _ in range(60_000))
    path = tmp_path / "big.txt"
    path.write_bytes(text.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    got = sorted(S.split_files(spark, [str(path), str(path), str(tmp_path / "empty.txt")], range_bytes=50_000).collect(), key=lambda r: r.start)
    assert got[0].start == 0 and got[-1].end == len(text)
    for r in got:
        assert r.piece == text[r.start : r.end] and len(r.piece) <= 1500
    for a, b in zip(got, got[1:], strict=False):
        assert 100 <= a.end - b.start <= 200
    one = sorted(S.split_files(spark, [str(path)], range_bytes=1 << 24).collect(), key=lambda r: r.start)
    assert [(r.start, r.end) for r in one] == S.split(text)


def test_paragraphs_of_sections_as_files(spark, tmp_path):
    long = "One sentence here, né. " * 900
    rows = [(f"p{i}", 0, [f"start {i}", long, None, "end"]) for i in range(6)] + [("p0", 0, ["start 0", long, None, "end"])]
    sections = spark.createDataFrame(rows, "arxiv_id string, section_index int, text array<string>")
    files = S.text_files(sections, Scratch(spark, "t"), rows=9)
    got = S.split_files(spark, files, range_bytes=16_000).collect()
    assert len(files) == len({r.path for r in got}) > 1
    for path in files:
        with open(path.removeprefix("file://"), encoding="utf-8") as f:
            text = f.read()
        own = sorted((r.start, r.end, r.piece) for r in got if r.path == path)
        assert own[0][0] == 0 and own[-1][1] == len(text) and all(text[a:b] == t and len(t) <= 1500 for a, b, t in own)
        assert all(100 <= a[1] - b[0] <= 200 for a, b in zip(own, own[1:], strict=False))
    assert S.text_files(sections.limit(0), Scratch(spark, "t")) == []
