import time

import pytest

from quirework.llm import markup as M
from quirework.scratch import Scratch

TEXT = [
    "a <b>bold</b> word", "x<br/>y", "see <!-- gone --> that", "a&nbsp;b", "&#8211;", "&#x3b1;", "**strong** words", "__strong__ words", "an *easy* word", "~~old~~ text",
    "# Head\ntext", "text\n## Head", "== Head ==", "text\n=== Head ===\nmore", "[a link](https://x.example/1)", "![alt](fig/a.png)", "[[Topic|word]]", "[[Topic]]", "[[Topic|see [Wex] too]]",
    "{{cite|A|2030}}", "`code` here", "```\nblock\n```", "'''bold''' wiki", "''slanted'' wiki", "\\alpha is", "\\begin{lemma} x", "line \\\\[3pt] break", "a $x$ b", "$$y$$", "\\(z\\)", "{\\em so}", "我们**证明**了", '<span class="a">b</span>', "<P>Upper</P>",
]
PLAIN = [
    "a < b and c > d", "whenever <f, g> being the pairing", "p* f = 24 and c* s = 13", "y'(t) + z''(t) = 0", "on A \\ B we", "lemmas, remarks &c. hold", "about ~ 42% of all", "[Thm. 7, Kal27b] says",
    "[20] (ii) holds", "{a, b} in S_12 and k_40 < x", "if z == f holds", "a [sic] b", "|X| <= 16 v^2", "AT&T; no", "x_1 * y_2 * z_3", "2 ** 3", "", "  ", "costs $5 and $7 now", "c^8=3+==d724", "a <b, c> d", "q* v = 15",
]


@pytest.mark.parametrize("text", TEXT)
def test_residue_in_text(text):
    assert M.has_residue(text, False)


@pytest.mark.parametrize("text", PLAIN)
def test_no_residue_in_prose(text):
    assert not M.has_residue(text, False)


@pytest.mark.parametrize("text", ["We <b>x</b> y", "a **b** c", "[[A|b]] c", "&mdash; c", "<!-- x -->", "\\textbf{a} '''b''' c", "## Head\n", "[a](https://b.example/c)", "== Head ==\n"])
def test_residue_in_latex(text):
    assert M.has_residue(text, True)


@pytest.mark.parametrize(
    "text",
    [
        "\\emph{a} $x^{*} y < z$", "% TODO **urgent** <p>\ntext", "\\begin{verbatim}\n**x** <b>\n\\end{verbatim}", "\\verb|<b>x</b>|", "\\begin{lstlisting}\n## no\nx = [[0, 1]]\n\\end{lstlisting}",
        "``as usual'' and ``so''", "\\item a, ``as usual\n\\item b, ``as usual\n", "\\[ a**b**c \\]", "5\\% of __", "\\begin{align*} **x** & y \\\\ \\end{align*}", "\\cite[Thm.~5]{a_b_c} _", "a & b \\\\", "\\section*{T} \\label{eq:_x_}",
    ],
)
def test_latex_of_its_own_is_no_residue(text):
    assert not M.has_residue(text, True)


def test_clean_keeps_structure():
    plain, removed = M.clean("<h2>Title</h2><ul><li>one</li><li>two</li></ul>We **prove** [x](http://a.example/b) &amp; `code` {{cite|A}} [[B|c]].", False)
    assert plain.startswith("## Title") and "- one" in plain and "prove x & `code`" in plain and "c." in plain and removed > 8
    plain, _ = M.clean("\\section{A \\emph{b}}\n% no\n\\begin{itemize}\n\\item one\n\\end{itemize}\n$a_b$ ``q'' \\begin{verbatim}\n# x <b>\n\\end{verbatim}\\begin{equation}x\\end{equation} \\cite{K} 5\\%", True)
    assert "# A b" in plain and "- one" in plain and "$a_b$" in plain and "```\n# x <b>\n```" in plain and "$$x$$" in plain and "[K]" in plain and "5%" in plain and "no" not in plain.split("\n")[1]
    assert M.clean(None, True) == (None, 0) and M.clean("", False) == ("", 0) and M.clean("plain text", False) == ("plain text", 0)


def test_tag_path_ratios_drop_navigation():
    body = "<p>" + "A long sentence of running text, with commas, that goes on. " * 4 + "</p>"
    page = "<div><ul>" + "<li>Nav</li>" * 6 + "</ul></div>" + body + "<table><tr><td>x</td></tr></table>" + body + "<footer><div>c</div></footer>"
    plain, _ = M.clean(page, False)
    assert "running text" in plain and "Nav" not in plain


def test_tables(spark):
    s = spark.createDataFrame([("p", 0, ["a <b>x</b>", None, "", "fine"], "ok **x**", 1), ("p", 0, ["a <b>x</b>", None, "", "fine"], "ok **x**", 1), ("q", 1, None, None, 1)], "arxiv_id string, section_index int, text array<string>, raw_latex string, field int")
    t = spark.createDataFrame([("p", 0, 2, "<i>x</i>"), (None, None, None, "$x$"), (None, 1, None, "''y'' z")], "arxiv_id string, section_index int, statement_index int, raw_latex string")
    assert {tuple(r) for r in M.residue(s, t).collect()} == {("section_text", "p", 0, 0), ("section_raw", "p", 0, -1), ("statement_raw", "p", 0, 2), ("statement_raw", None, 1, None)}
    rows = M.plain_texts(s, t, Scratch(spark, "t")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, M.plain_texts(s, t, Scratch(spark, "t"), repeated=0).collect()), key=str)
    assert len(rows) == 4 + 2 + 3 and {r.plain for r in rows if r.residue} >= {"a x", "ok x", "x"}
    assert M.residue(s.limit(0), t.limit(0)).count() == 0


def test_very_long_text_is_scanned_whole():
    assert M.has_residue("word " * 400_000 + "<b>end</b>", False) and not M.has_residue("a < b and *" * 20_000, False)


def test_short_items_and_words_within_prose_stay():
    prose = "A long sentence of running text, with commas, that goes on. " * 4
    page = f"<div><h2>Head</h2></div><p>{prose}<b>boldly</b> {prose}</p><ul><li>apples</li><li>pears</li><li>see <a href='x'>plums</a> here</li></ul><p>{prose}</p>"
    page += "<table><tr><th>name</th></tr><tr><td>yes</td><td>yes</td><td>yes</td></tr></table><dl><dt>term</dt><dd>short</dd></dl>" + f"<p>{prose}</p>"
    plain, _ = M.clean(page, False)
    for word in ("Head", "boldly", "apples", "pears", "see plums here", "name", "term", "short"):
        assert word in plain, word
    assert plain.count("yes") == 3
    page = f"<div><ul><li><a href='x'>Home</a></li><li><a href='y'>About</a></li></ul></div><p>{prose}</p><section><p>{prose}</p></section><footer>{prose}</footer>"
    plain, _ = M.clean(page, False)
    assert "running text" in plain and not any(word in plain for word in ("Home", "About"))


@pytest.mark.parametrize(
    "text",
    ["an *easy\nword over\nfour\nlines* here", "a **" + "bold " * 3000 + "end** b", "[[Topic|" + "w" * 800 + "]] c", "use `a\nb\nc\nd\ne\nf` here", "_" + "a_b " * 60 + "c_ d", "''" + "x " * 5000 + "y'' z"],
)
def test_markup_of_any_extent(text):
    assert M.has_residue(text, False)


@pytest.mark.parametrize("text", ["an *easy\n\nword* here", "a **bold\n \nword** b", "use `a\n\nb"])
def test_emphasis_ends_with_its_paragraph(text):
    assert not M.has_residue(text, False)


@pytest.mark.parametrize("text", ["{{ab" + "|" * 50_000, "<!--" * 50_000, "~~~x\n" * 30_000, "*a " * 50_000, "**a *b " * 30_000, "[[a|" * 30_000, "_a_b" * 30_000 + " _c", "<b" + " " * 50_000, "[a](" * 30_000, "$a " * 30_000])
def test_open_marks_take_linear_time(text):
    began = time.perf_counter()
    M.has_residue(text, False)
    assert time.perf_counter() - began < 5


def test_conversion_leaves_no_markup():
    text = "<h1>T</h1> <b>x</b> **y** [z](https://a.example/b) &lt;w&gt; and `**code**` with $a_b*c*$ {{cite|A}} \\emph{v}"
    plain, n = M.clean(text, False)
    assert n > 6 and M.left_over(plain) == 0 and M.left_over("a **b** c") == 1 and M.left_over("\\em x") == 1 and M.left_over("# Head\n`*x*` $*y*$") == 0
