import random

import pytest

from quirework.sources import rejects as R

GOOD = {"labels": "3101.12345v2\t0\t12\tHead\tSome text\t3", "review": "math.AG/2701100:paragraph:7:c12,math.AG/2701100,paragraph,a,b,c,d,e,f,g,h,yes,n"}


def expected(feed, line):
    """A plain reading of the rules, field by field."""
    if line is None:
        return "columns"
    rules = R.FEEDS[feed]
    fields, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            text, at = "", at + 1
            while True:
                if at >= len(line):
                    return "quoting"
                if line[at] == '"' and line[at + 1 : at + 2] == '"':
                    text, at = text + '"', at + 2
                elif line[at] == '"':
                    at += 1
                    break
                else:
                    text, at = text + line[at], at + 1
            if at < len(line) and line[at] != rules.separator:
                return "quoting"
            fields.append(text)
        else:
            end = line.find(rules.separator, at)
            end = len(line) if end < 0 else end
            fields.append(line[at:end])
            at = end
        if at >= len(line):
            break
        at += 1
    import re

    if len(fields) != len(rules.columns):
        return "columns"
    row = dict(zip(rules.columns, fields, strict=True))
    fine = all(re.fullmatch(p, row[c]) for c, p in rules.patterns.items()) and all(row[c].strip() for c in rules.not_blank)
    if feed == "review":
        head = f"{row['arxiv_id']}:{row['condition']}"
        fine = fine and row["connection_id"].startswith(head) and re.fullmatch(":[0-9]{1,9}:c[0-9]{1,9}", row["connection_id"][len(head) :])
    return None if fine else "value"


CASES = [
    ("labels", GOOD["labels"], None), ("review", GOOD["review"], None), ("labels", None, "columns"), ("labels", "", "columns"), ("labels", GOOD["labels"] + "\tx", "columns"), ("labels", '"abc', "quoting"),
    ("labels", '3101.12345\t0\t1\t"a"b\tt\t3', "quoting"), ("labels", '3101.12345\t0\t1\ta"b"\tt\t3', None), ("labels", '3101.12345\t0\t1\t"a\tb\nc"\t"say ""x"""\t3', None), ("labels", "3101.12345\t0\t1\th\t \t3", "value"),
    ("labels", "3101.12345\t0\t1\th\t\u00a0\t3", "value"), ("labels", "3101.12345\t٣\t1\th\tt\t3", "value"), ("labels", "3101.12345 \t0\t1\th\tt\t3", "value"), ("labels", "3101.12345\t0\t1\th\tt\t6", "value"),
    ("labels", "arxiv_id\tsection_index\tparagraph_index\tsection_header\tparagraph\tlabel", "value"), ("review", GOOD["review"].replace("yes", "maybe"), "value"), ("review", GOOD["review"].replace("math.AG/2701100:", "3101.12345:"), "value"),
    ("review", GOOD["review"].replace(",yes", ","), None), ("labels", "3101.12345\t0\t1\th\ta\nb\t3", None), ("labels", "3101.12345\t0\t1\th\ta\x00b\t3", None), ("labels", "3101.12345\t1234567890\t1\th\ta\t3", "value"),
]


def test_reasons_and_valid_rows(spark):
    df = spark.createDataFrame([(i, f, "x", line, "y") for i, (f, line, _) in enumerate(CASES)] + [(900, None, "x", "a", "y"), (901, "other", "x", "a", "y")], "line_id long, feed string, file_name string, line string, reason string")
    got = {r.line_id: r.reason for r in R.rejected(df).collect()}
    assert got == {i: reason for i, (_, _, reason) in enumerate(CASES) if reason}
    assert all(expected(f, line) == reason for f, line, reason in CASES)
    rows = {r.line_id: r for r in R.valid_rows(df, "labels").collect()}
    assert rows[8].section_header == "a\tb\nc" and rows[8].paragraph == 'say "x"' and rows[0].section_index == 0 and rows[0].label == 3
    assert {r.line_id for r in R.valid_rows(df, "review").collect()} == {i for i, (f, _, reason) in enumerate(CASES) if f == "review" and not reason}
    assert R.rejected(df.limit(0)).count() == 0


@pytest.mark.parametrize("feed", ["labels", "review"])
def test_random_records_equal_the_plain_reading(feed):
    rng = random.Random(7)
    rules = R.FEEDS[feed]
    signs = ['"', rules.separator, "a", "\n", '""', "\r", "", "\x00", "é", " "]
    good = GOOD[feed].split(rules.separator)
    for _ in range(400):
        lines = []
        for _ in range(5):
            if rng.random() < 0.4:
                lines.append("".join(rng.choice(signs) for _ in range(rng.randint(0, 25))))
            else:
                own = list(good)
                own[rng.randrange(len(own))] = rng.choice(['"x' + rules.separator + 'y"', '"x\ny"', '"a""b"', "", " ", "yes", 'in "side"', "1"])
                lines.append(rules.separator.join(own))
        rows, bad = R._sorted_out(rules)(lines)
        want = {i: r for i, line in enumerate(lines) if (r := expected(feed, line))}
        assert {i: r for i, r, _, _ in bad} == want and all((c is not None) == (r == R.VALUE) for _, r, c, _ in bad) and sorted(rows.column("__number").to_pylist()) == [i for i in range(5) if i not in want]


def test_failing_cell_is_the_first_in_order(spark):
    lines = ["2901.00001\t0\t1\th\t \t9", "x\t0\t1\th\tp\t9", "2901.00001\t0\tx\th\tp\t1", "a\tb", "\"a\tb"]
    df = spark.createDataFrame([(i, "labels", line) for i, line in enumerate(lines)], "line_id long, feed string, line string")
    got = {r.line_id: (r.feed, r.reason, r.column, r.value) for r in R.rejected_cells(df).collect()}
    assert got == {
        0: ("labels", "value", "paragraph", " "),
        1: ("labels", "value", "arxiv_id", "x"),
        2: ("labels", "value", "paragraph_index", "x"),
        3: ("labels", "columns", None, None),
        4: ("labels", "quoting", None, None),
    }
