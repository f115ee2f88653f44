"""Problem 6: markup residue, and its conversion to clean text.

A scanner finds markup tokens of four languages and gives every stretch of text
the path of open tags it lies under. Text length and punctuation are summed per
path, smoothed along the document, fused and held against a threshold: paths of
running text are content, paths of link lists and the like are not. Headings,
lists, code blocks and formulas keep a plain form.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.scratch import Scratch

# The element names of HTML, current and obsolete.
ELEMENTS = """
a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption
center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer
form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark
marquee menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s
samp script search section select slot small source span strike strong style sub summary sup table tbody td template textarea
tfoot th thead time title tr track tt u ul var video wbr
""".split()
# Attributes that stand without a value.
_FLAGS = "allowfullscreen async autofocus autoplay checked compact controls default defer disabled hidden ismap loop multiple muted nohref noshade novalidate nowrap open readonly required reversed selected"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figure footer form header hgroup html main nav ol p pre section table tbody td tfoot th thead tr ul li h1 h2 h3 h4 h5 h6".split())

_VALUE = r"""\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=`]+)"""
_TAG = rf"</?(?i:{'|'.join(ELEMENTS)})(?:\s+(?:[A-Za-z_:][\w:.-]*{_VALUE}|(?i:{_FLAGS.replace(' ', '|')})))*\s*/?>"
_REFERENCE = r"&(?:\#[0-9]{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

_WITHIN = r"\n(?!\s*\n)"  # a line end that does not end the paragraph

#: HTML, Markdown and wiki markup. Emphasis opens after a blank or an opening sign and closes before a blank or a closing one, so products and primes are text.
#: It runs to the next mark of its kind, however far, but not over a blank line; runs are possessive, so each stretch is read once and the scan is linear.
_LIGHT_RULES = rf"""
      (?P<comment>COMMENT<!--)
    | (?P<tag>{_TAG})
    | (?P<ref>{_REFERENCE})
    | (?P<fence>FENCE^[ \t]{{0,3}}```[^\n`]*$)
    | (?P<code>(?<!`)(?P<tick>`{{1,2}})(?!`)(?P<codetext>[^`\n]++(?:\n[^`\n]++)*+)(?P=tick)(?!`))
    | (?P<image>!\[[^\[\]\n]*(?:\[[^\[\]\n]*\][^\[\]\n]*)*\]\([^()\s]*(?:\s+"[^"\n]*")?\))
    | (?P<wiki>\[\[[^\[\]\n|]*[^\W\d_][^\[\]\n|]*(?:\|(?:[^\[\]\n]++|\[(?!\[)|\](?!\]))*+\]?)?\]\])
    | (?P<link>\[[^\[\]\n]+(?:\[[^\[\]\n]*\][^\[\]\n]*)*\]\((?:<[^<>\n]*>|[^()\s]*[/.\#:@][^()\s]*|\#[^()\s]*)(?:\s+"[^"\n]*")?\))
    | (?P<footlink>^[ ]{{0,3}}\[[^\[\]\n]+\]:[ \t]+<?https?://\S+)
    | (?P<reflink>\[[^\[\]\n]+\]\[[a-z0-9-]+\](?=[\s.,;:)]|$))
    | (?P<extlink>\[(?:https?|ftp)://[^\s\[\]]+(?:[ \t][^\[\]\n]*)?\])
    | (?P<auto><(?:https?|ftp|mailto):[^\s<>]+>)
    | (?P<template>\{{\{{\s*[^\W\d_][\w \-:/]*[\w](?:\|[^{{}}|]*+)*+\}}\}})
    | (?P<atx>^[ ]{{0,3}}\#{{1,6}}[ \t]+(?=\S))
    | (?P<setext>(?<=\S\n)[ ]{{0,3}}(?:={{3,}}|-{{3,}})[ \t]*$)
    | (?P<wikihead>^[ \t]*(?P<eq>={{2,6}})[ \t]*[^=\s\n](?:[^=\n]*[^=\s\n])?[ \t]*(?P=eq)[ \t]*\r?$)
    | (?P<bold>(?<![^\W\u3040-\u9fff])(?<!\*)\*{{2,3}}(?=[^\s*])(?:[^*\n]++|\*(?!\*)|{_WITHIN})++(?<=[^\s*])\*{{2,3}}(?![^\W\u3040-\u9fff]|\*))
    | (?P<under>(?<![^\W\u3040-\u9fff])_{{2,3}}(?=[^\s_])(?:[^_\n]++|_(?!_)|{_WITHIN})++(?<=[^\s])_{{2,3}}(?![^\W\u3040-\u9fff]))
    | (?P<strike>~~(?=[^\s~])(?:[^~\n]++|~(?!~)|{_WITHIN})++(?<=[^\s~])~~(?!~))
    | (?P<quote>(?<![\w'’)\]}}])'{{2,5}}(?=[^\s'])(?:[^'\n]++|'(?!')|{_WITHIN})++(?<=[^\s'])'{{2,5}}(?![\w'(]))
    | (?P<star>(?<![\w*^)\]}}|])\*(?=[^\s*])(?:[^*\n]++|{_WITHIN})++(?<=[^\s*])\*(?![\w*(]))
    | (?P<line>(?<![\w_^)\]}}\\])_(?=[^\s_])(?:[^_\n]++|(?<=[^\W_])_(?=[^\W_])|{_WITHIN})++(?<=[^\s_])_(?![\w_({{]))
    """


@lru_cache(maxsize=4)
def _light(comments: bool, fences: bool) -> re.Pattern:
    """The rules; without comments or fences none of them is closed any more, so none is searched to the end of the text in vain."""
    closed = r"^[ \t]{0,3}(?P<ticks>```+|~~~+)[^\n`]*\n(?:.*?\n)?[ \t]{0,3}(?P=ticks)[ \t]*$|"
    rules = _LIGHT_RULES.replace("COMMENT", "<!--.*?-->|" if comments else "").replace("FENCE", closed if fences else "")
    return re.compile(rules, re.X | re.S | re.M)


_FENCE_END = re.compile(r"^[ \t]{0,3}(?:```+|~~~+)[ \t]*$", re.M)

_LATEX = re.compile(
    r"""
      (?P<env>\\(?:begin|end)\s*\{[^{}\n]*\})
    | (?P<break>\\\\(?:\*)?(?:\[[^\]\n]{0,20}\])?)
    | (?P<delimiter>\\[()\[\]])
    | (?P<command>\\[A-Za-z@]+\*?)
    | (?P<symbol>\\[^\sA-Za-z0-9\\])
    | (?P<dollar>\$\$[^$]+\$\$|\$[^$]*[^$\s]\$)
    """,
    re.X,
)
_PRICE = re.compile(r"\$\s?\d[\d.,]*(?:\s?(?:k|m|bn|million|billion))?\s")

#: What markup is looked for outside of: comments, formulas, verbatim and listing blocks, \verb, and the keys of references.
_MATH_ENV = r"(?:equation|align|alignat|flalign|gather|multline|eqnarray|displaymath|math|split|cases|array|matrix|pmatrix|bmatrix|vmatrix|tikzcd|IEEEeqnarray|subequations|dmath)"
_OUTSIDE = re.compile(
    rf"""
      \\begin\{{(?P<verbatim>verbatim\*?|Verbatim|BVerbatim|lstlisting|minted|alltt|comment|algorithmic|code|listing)\}}.*?(?:\\end\{{(?P=verbatim)\}}|\Z)
    | \\(?:verb|lstinline)\*?(?P<bar>[^\sA-Za-z*\[{{])[^\n]*?(?P=bar)
    | \\(?:lstinline|mintinline)(?:\[[^\]]*\])?(?:\{{[^{{}}]*\}}){{1,2}}
    | %[^\n]*
    | \\begin\{{(?P<math>{_MATH_ENV}\*?)\}}.*?(?:\\end\{{(?P=math)\}}|\Z)
    | \\\[.*?\\\]
    | \\\(.*?\\\)
    | \$\$(?:[^$\\]|\\.)*\$\$
    | \$(?:[^$\\]|\\.)*\$
    | \\(?:label|ref|eqref|pageref|autoref|cref|Cref|nameref|[A-Za-z]*cite[A-Za-z]*|url|path|includegraphics|input|include|bibliography|bibliographystyle|hyperref|usepackage|documentclass)\*?(?:\s*\[[^\[\]]*\]){{0,2}}\s*\{{[^{{}}]*\}}
    | \\href\s*\{{[^{{}}]*\}}
    | \\[A-Za-z@]+\*?
    | \\.
    """,
    re.X | re.S,
)  # an escaped sign is taken by its backslash, so a bare % or $ opens a comment or formula


def _mask(m: re.Match) -> str:
    """A blank in place of LaTeX, with as many characters and the same line ends, so offsets and lines stay."""
    return re.sub(r"[^\n]", "\x00", m.group())


def _is_light(m: re.Match, latex: bool) -> bool:
    kind = m.lastgroup
    if kind == "ref":
        name = m.group()[1:]
        return name[0] == "#" or name in html5
    if kind == "code":
        inner = m.group("codetext")
        if m.group("tick") == "``":  # in LaTeX that opens a quotation
            return not latex and "\n" not in inner and not re.search(r"''|'(?=\W|$)", inner)
        return not re.search(r"'(?=[\s.,;:)]|$)", inner)
    return True


# lastgroup names the last closed group; inner groups of an alternative close before it.
def light_tokens(text: str, latex: bool = False) -> Iterator[re.Match]:
    """HTML, Markdown and wiki tokens of a text; a candidate that is none is skipped by one character."""
    at = 0
    comments = text.rfind("-->")
    fences = max((f.start() for f in _FENCE_END.finditer(text)), default=-1) if "```" in text or "~~~" in text else -1
    while m := _light(at <= comments, at <= fences).search(text, at):
        if _is_light(m, latex):
            yield m
            at = max(m.end(), at + 1)
        else:
            at = m.start() + 1


def latex_tokens(text: str) -> Iterator[re.Match]:
    at = 0
    while m := _LATEX.search(text, at):
        if m.lastgroup == "dollar" and not m.group().startswith("$$") and _PRICE.match(m.group()) and not re.search(r"[\\^_={}]", m.group()):
            at = m.end() - 1
        else:
            yield m
            at = max(m.end(), at + 1)


#: Signs without which a text holds no HTML, Markdown or wiki markup; each branch starts with a plain sign, so the search skips fast.
_HINTS = r"""<[A-Za-z/!]|&[#A-Za-z][A-Za-z0-9]*;|\]\(|\]\[|\]\]|\]:|\[(?:https?|ftp)|\{\{|\#{1,6}[ \t]|==|---|\*\*|__|~~|''|\*(?=[^\s*])(?<![\w*^)\]}{|]\*)|_(?=[^\s_])(?<![\w_^)\]}\\]_)"""
_LIGHT_HINT = re.compile(_HINTS + "|`")
_SOURCE_HINT = re.compile(_HINTS + "|`(?<!``)(?!`)|```")
_LATEX_HINT = re.compile(r"[\\$]")


# Cleaning.

#: A path of text is content if its fused ratio reaches this share of the mean over the document's paths.
CONTENT_SHARE = 0.35

_HEADS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
_SYMBOLS = set(
    "alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega "
    "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega le leq ge geq ne neq in notin subset subseteq cup cap to mapsto infty times cdot sim approx equiv".split()
)
_ITEM = {"itemize": "- ", "enumerate": "1. ", "description": "- "}


def _group(text: str, at: int) -> int:
    """The end of the brace group that begins at ``at``, or -1."""
    depth = 0
    for m in re.finditer(r"\\.|[{}]", text[at:], re.S):
        sign = m.group()
        depth += (sign == "{") - (sign == "}")
        if depth == 0 and sign == "}":
            return at + m.end()
    return -1


class _Kept:
    """Code and formulas set aside while the rest is cleaned; they come back verbatim."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def put(self, part: str) -> str:
        self.parts.append(part)
        return f"\ue000{len(self.parts) - 1}\ue001"

    def back(self, text: str) -> str:
        for _ in range(3):
            text, n = re.subn("\ue000([0-9]+)\ue001", lambda m: self.parts[int(m.group(1))] if int(m.group(1)) < len(self.parts) else "", text)
            if not n:
                break
        return text


def _protect(m: re.Match, kept: _Kept) -> str:
    whole = m.group()
    if whole.startswith("%"):
        return ""
    if m.group("verbatim"):
        body = re.sub(r"^\\begin\{[^{}]*\}(?:\[[^\]]*\])?(?:\{[^{}]*\})?", "", whole)
        body = re.sub(r"\\end\{[^{}]*\}\Z", "", body).strip("\n")
        return "" if m.group("verbatim") == "comment" else "\n" + kept.put(f"```\n{body}\n```") + "\n"
    if m.group("bar"):
        return kept.put("`" + whole.split(m.group("bar"), 1)[1][: -len(m.group("bar"))] + "`")
    if m.group("math"):
        return "\n" + kept.put("$$" + re.sub(r"^\\begin\{[^{}]*\}|\\end\{[^{}]*\}\Z|\\label\{[^{}]*\}", "", whole).strip() + "$$") + "\n"
    if whole.startswith(("\\[", "$$")):
        return "\n" + kept.put("$$" + whole[2:-2].strip() + "$$") + "\n"
    if whole.startswith("\\("):
        return kept.put("$" + whole[2:-2].strip() + "$")
    if whole.startswith("$"):
        return kept.put(whole)
    return whole


def _latex_commands(text: str) -> str:
    """LaTeX outside code and formulas to plain text, command by command from the left."""
    out: list[str] = []
    at, lists = 0, []
    for_item = {"item": "- "}
    pattern = re.compile(r"\\(begin|end)\s*\{([^{}\n]*)\}(?:\[([^\]\n]*)\])?|\\([A-Za-z@]+)\*?|\\\\(?:\*)?(?:\[[^\]\n]{0,20}\])?|\\(.)|[{}~]|``|''", re.S)
    while m := pattern.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        whole, name = m.group(), m.group(4)
        if m.group(1):
            env = m.group(2).rstrip("*")
            if env in _ITEM:
                if m.group(1) == "begin":
                    lists.append(_ITEM[env])
                elif lists:
                    lists.pop()
                for_item["item"] = lists[-1] if lists else "- "
            elif env in ("tabular", "tabularx", "array", "longtable") and m.group(1) == "begin":
                while at < len(text) and text[at] == "{" and (end := _group(text, at)) > 0:
                    at = end
            elif m.group(1) == "begin" and env not in ("document", "center", "figure", "table", "abstract"):
                out.append(f"\n{env.capitalize()}" + (f" ({m.group(3)})" if m.group(3) else "") + ". ")
                continue
            out.append("\n")
        elif name:
            if name == "item":
                label = re.match(r"\s*\[([^\]\n]*)\]", text[at:])
                out.append("\n" + for_item["item"] + (label.group(1) + " " if label else ""))
                at += label.end() if label else 0
                at += len(text[at:]) - len(text[at:].lstrip(" "))
                continue
            options = re.match(r"(?:\s*\[[^\[\]]*\])*(?=\s*\{)", text[at:]) if name not in ("par", "qed") else None
            begin = at + options.end() if options else at
            space = re.match(r"\s*", text[begin:]).end() if options else 0
            end = _group(text, begin + space) if options and text[begin + space : begin + space + 1] == "{" else -1
            inner = text[begin + space + 1 : end - 1] if end > 0 else None
            if inner is not None and name in _HEADS:
                out.append("\n\n" + "#" * _HEADS[name] + " " + _latex_commands(inner).strip() + "\n\n")
                at = end
            elif inner is not None and (name == "label" or name in ("vspace", "hspace", "includegraphics", "input", "include", "bibliographystyle", "pagestyle", "index", "phantom")):
                at = end
            elif inner is not None and (name.endswith("ref") or "cite" in name.lower()):
                note = options.group().strip(" []") if options else ""
                out.append("[" + (note + ", " if note else "") + inner + "]")
                at = end
            elif inner is not None and name == "footnote":
                out.append(" (" + _latex_commands(inner).strip() + ")")
                at = end
            elif inner is not None and name == "href":
                at = end
                if text[at : at + 1] == "{" and (last := _group(text, at)) > 0:
                    out.append(_latex_commands(text[at + 1 : last - 1]))
                    at = last
            elif inner is not None:
                out.append(_latex_commands(inner))
                at = end
            elif name in ("par", "newline", "linebreak", "newpage", "clearpage", "medskip", "bigskip", "smallskip"):
                out.append("\n")
            elif name in ("ldots", "dots"):
                out.append("...")
            elif name in _SYMBOLS:
                out.append(f"$\\{name}$")
        elif whole.startswith("\\\\"):
            out.append("\n")
        elif m.group(5):
            out.append(m.group(5) if m.group(5) in "%&#_{}$ " else " " if m.group(5) in ",;:/!" else m.group(5))
        elif whole == "~":
            out.append(" ")
        elif whole == "``":
            out.append("\u201c")
        elif whole == "''":
            out.append("\u201d")
    out.append(text[at:])
    return "".join(out)


class _Node:
    __slots__ = ("path", "text")

    def __init__(self, path: tuple[str, ...], text: str):
        self.path, self.text = path, text


_PUNCTUATION = re.compile(r"[.,;:!?\u3002\uff0c]")


_ITEM = {"li", "dt", "dd", "td", "th"}


def _block_path(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path as far as its last block element: elements within running text belong to the text around them."""
    return path[: max((i + 1 for i, t in enumerate(path) if t in _BLOCK), default=0)]


def content_paths(nodes: list[_Node], share: float = CONTENT_SHARE) -> set[tuple[str, ...]]:
    """The tag paths whose text is content.

    Paths count as far as their last block element. Per path: characters and
    punctuation marks per node. Both are smoothed over each node and its
    neighbours in document order, fused by their product, and a path is content
    if its fused value reaches ``share`` of the mean over all paths. Text outside
    block elements is always content, as are headings, code and formulas, and
    items of lists and tables, however short; except items that are navigation:
    inside a nav element, mostly link text, or of a list that says one text over
    and over. Everything is content in a document of few paths.
    """
    real = [n for n in nodes if n.text.strip()]
    blocks = [_block_path(n.path) for n in real]
    paths = list(dict.fromkeys(blocks))
    if len(paths) < 4:
        return {n.path for n in real}
    chars = np.array([len(n.text.strip()) for n in real], float)
    of = {p: i for i, p in enumerate(paths)}
    at = np.array([of[p] for p in blocks])
    n = np.bincount(at)
    linked = np.bincount(at, chars * np.array(["a" in n.path or "md-link" in n.path for n in real])) / np.bincount(at, chars)
    said: dict[tuple[str, ...], list[str]] = {p: [] for p in paths}
    for p, node in zip(blocks, real, strict=True):
        if node.text.strip() != "-":  # the mark of an item
            said[p].append(node.text.strip())

    def always(p: tuple[str, ...]) -> bool:
        if not p or any(t in ("pre", "code", "h1", "h2", "h3", "h4", "h5", "h6") for t in p):
            return True
        echo = "li" in p and len(said[p]) > 2 and len(set(said[p])) == 1
        return any(t in _ITEM for t in p) and "nav" not in p and linked[of[p]] <= 0.5 and not echo

    marks = np.array([len(_PUNCTUATION.findall(n.text)) for n in real], float)
    kernel = np.array([0.25, 0.5, 0.25])
    wide, marks = (np.convolve(np.pad(v, 1, mode="edge"), kernel, "valid") for v in (chars, marks))
    fused = np.sqrt(np.bincount(at, wide) / n * (1 + np.bincount(at, marks) / n))
    good = {p for p in paths if always(p) or fused[of[p]] >= share * fused.mean()}
    return {n.path for n, p in zip(real, blocks, strict=True) if p in good or any(t in ("pre", "code") for t in n.path)}


_LATEX_SIGNS = re.compile(r"[%$\\{}~&#_^]")


def _light_nodes(seen: str, text: str, latex: bool, kept: _Kept) -> tuple[list[_Node], int]:
    """(text nodes with their tag paths, number of tokens) of a text with HTML, Markdown and wiki markup. Tokens are found in ``seen``, the text with what is none of them masked; nodes hold the text."""
    if not (_SOURCE_HINT if latex else _LIGHT_HINT).search(seen):
        return ([_Node((), text)] if text else []), 0
    nodes: list[_Node] = []
    stack: list[str] = []
    at = count = 0

    def say(part: str) -> None:
        if part:
            nodes.append(_Node(tuple(stack), part))

    def inside(tag: str, lo: int, hi: int) -> None:
        stack.append(tag)
        more, _ = _light_nodes(seen[lo:hi], text[lo:hi], latex, kept)
        nodes.extend(_Node(tuple(stack) + n.path, n.text) for n in more)
        stack.pop()

    for m in light_tokens(seen, latex):
        say(text[at : m.start()])
        lo, at, kind = m.start(), m.end(), m.lastgroup
        whole = text[lo:at]
        count += 1
        if kind == "ref":
            sign = html.unescape(whole)
            say(kept.put(sign) if latex and _LATEX_SIGNS.search(sign) else sign)
        elif kind == "fence":
            body = whole.strip().split("\n")
            say("\n" + kept.put("\n".join(["```", *body[1:-1], "```"])) + "\n" if len(body) > 2 else "\n")
        elif kind == "code":
            say(kept.put("`" + text[slice(*m.span("codetext"))].strip() + "`"))
        elif kind == "image":
            say(whole[2 : whole.rindex("](")])
        elif kind == "link":
            inside("md-link", lo + 1, lo + m.group().rindex("]("))
        elif kind == "reflink":
            inside("md-link", lo + 1, lo + m.group().index("]["))
        elif kind == "wiki":
            target = whole[2:-2].split("|", 1)
            say("" if re.match(r"(?i)(?:file|image|category):", target[0].strip()) else target[-1].strip("|"))
        elif kind == "extlink":
            say(whole[1:-1].partition(" ")[2])
        elif kind == "auto":
            say(whole[1:-1])
        elif kind == "atx":
            say("\n" + kept.put(whole.strip()) + " ")
        elif kind == "wikihead":
            say("\n" + kept.put("#" * len(m.group("eq"))) + " " + whole.strip().strip("= \t") + "\n")
        elif kind in ("bold", "under", "strike", "quote", "star", "line"):
            mark = re.match(r"[*_~']+", m.group()).end()
            inside("mark", lo + mark, at - len(re.search(r"[*_~']+\Z", m.group()).group()))
        elif kind == "tag":
            name = re.match(r"</?([A-Za-z0-9]+)", whole).group(1).lower()
            closing = whole.startswith("</")
            if name in ("br", "hr"):
                say("\n")
            elif name not in _VOID:
                if closing:
                    if name in stack:
                        while stack.pop() != name:
                            pass
                    if name in _BLOCK:
                        say("\n")
                else:
                    if name in _BLOCK:
                        say("\n")
                    stack.append(name)
                    if re.fullmatch(r"h[1-6]", name):
                        say(kept.put("#" * int(name[1])) + " ")
                    elif name == "li":
                        say("- ")
                    elif name == "td" or name == "th":
                        say("| ")
    say(text[at:])
    return nodes, count


_FORMULA = re.compile(r"\$\$[^$]+\$\$|\$[^$]*[^$\s]\$|\\\(.*?\\\)|\\\[.*?\\\]", re.S)


@dataclass
class Parsed:
    """A text as nodes with tag paths. tokens: how many pieces of markup it holds; has_latex: whether LaTeX is still to be converted."""

    nodes: list[_Node]
    tokens: int
    kept: _Kept
    has_latex: bool


def parsed(text: str, latex: bool) -> Parsed:
    """latex: the text is LaTeX source, where only HTML, Markdown and wiki markup outside LaTeX's own counts; elsewhere LaTeX counts too."""
    kept = _Kept()
    body = text.replace("\ue000", "").replace("\ue001", "")
    if latex:
        seen = _OUTSIDE.sub(_mask, body) if _SOURCE_HINT.search(body) else ""
        nodes, tokens = _light_nodes(seen, body, True, kept) if seen else ([_Node((), body)], 0)
        return Parsed(nodes, tokens, kept, True)
    tokens = sum(1 for _ in latex_tokens(body)) if _LATEX_HINT.search(body) else 0
    shielded = _FORMULA.sub(lambda m: kept.put(m.group()), body) if tokens else body
    nodes, more = _light_nodes(shielded, shielded, False, kept)
    return Parsed(nodes, tokens + more, kept, tokens > 0)


def has_residue(text: str | None, latex: bool) -> bool:
    """Whether a text still holds markup; see ``parsed``."""
    return bool(text) and parsed(text, latex).tokens > 0


def converted(p: Parsed, latex: bool) -> str:
    """Plain text of the content of a parsed text."""
    done = _selected(p.nodes)
    if p.has_latex:
        done = _latex_commands(_OUTSIDE.sub(lambda m: _protect(m, p.kept), done) if latex else done)
    done = p.kept.back(done) if p.kept.parts else done
    if p.tokens or latex:
        done = re.sub(r"[ \t]+(?=\n)", "", done)
        done = re.sub(r"\n{3,}", "\n\n", done).strip()
    return done


def clean(text: str | None, latex: bool) -> tuple[str | None, int]:
    """(plain text, number of markup tokens); null stays null.

    Headings become lines with leading #, list items lines with a leading - or
    1., code a fenced block or stands between backquotes, formulas stay between
    dollar signs.
    """
    if not text:
        return text, 0
    p = parsed(text, latex)
    return converted(p, latex), p.tokens


#: What plain text keeps on purpose: code, formulas, and the marks of headings.
_KEPT_FORMS = re.compile(r"^```\n.*?^```$|`[^`\n]+(?:\n[^`\n]+)*`|\$\$.*?\$\$|\$[^$]*\$|^ {0,3}#{1,6} |\\\(.*?\\\)|\\\[.*?\\\]", re.S | re.M)


def left_over(plain: str | None) -> int:
    """Pieces of markup in a plain text besides its code, formulas and headings."""
    if not plain:
        return 0
    rest = _KEPT_FORMS.sub(_mask, plain)
    return (sum(1 for _ in latex_tokens(rest)) if _LATEX_HINT.search(rest) else 0) + (sum(1 for _ in light_tokens(rest)) if _LIGHT_HINT.search(rest) else 0)


def _selected(nodes: list[_Node]) -> str:
    good = content_paths(nodes)
    return "".join(n.text for n in nodes if (n.path in good or not n.text.strip()) and not set(n.path) & _UNSEEN)


_UNSEEN = {"script", "style", "template", "noscript"}
_KEY = ["field", "arxiv_id", "section_index", "item_index"]
_KEYS = "field string, arxiv_id string, section_index int, item_index int"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each item with markup: its pieces of markup, its tag paths, and the share of its characters on paths that are content."""
    for batch in batches:
        at, tokens, paths, share = [], [], [], []
        for i, (field, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            p = parsed(text, field != "section_text")
            if not p.tokens:
                continue
            good = content_paths(p.nodes)
            whole = sum(len(n.text) for n in p.nodes)
            at.append(i)
            tokens.append(p.tokens)
            paths.append(len({n.path for n in p.nodes}))
            share.append(sum(len(n.text) for n in p.nodes if n.path in good and not set(n.path) & _UNSEEN) / whole if whole else 0.0)
        rows = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(tokens, pa.int32()), pa.array(paths, pa.int32()), pa.array(share, pa.float64())], names=[*_KEY, "tokens", "paths", "content_share"])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain = [clean(t, f != "section_text") for f, t in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array([p for p, _ in plain], pa.string()), pa.array([n for _, n in plain], pa.int32()), pa.array([n > 0 for _, n in plain]), pa.array([left_over(p) for p, _ in plain], pa.int32())],
            names=[*_KEY, "plain", "removed", "residue", "left_over"],
        )


def _items(sections: DataFrame, statements: DataFrame) -> DataFrame:
    section = ["arxiv_id", F.col("section_index").cast("int").alias("section_index")]
    text = sections.select(F.lit("section_text").alias("field"), *section, F.posexplode("text").alias("item_index", "text"))
    raw = sections.select(F.lit("section_raw").alias("field"), *section, F.lit(-1).alias("item_index"), F.col("raw_latex").alias("text"))
    statement = statements.select(F.lit("statement_raw").alias("field"), *section, F.col("statement_index").cast("int").alias("item_index"), F.col("raw_latex").alias("text"))
    return text.unionByName(raw).unionByName(statement)


def measured(sections: DataFrame, statements: DataFrame) -> DataFrame:
    """(field, arxiv_id, section_index, item_index, tokens, paths, content_share) of every item that still holds markup.

    tokens: pieces of markup; paths: different tag paths of its text;
    content_share: the share of its characters on paths that are content by their
    tag-path ratios. Null, empty and blank texts hold no markup; null keys come out as null;
    repeated rows come out repeatedly; other columns are not read; empty tables give no rows.
    """
    return _items(sections, statements).where("text is not null").mapInArrow(_measured, f"{_KEYS}, tokens int, paths int, content_share double")


def residue(sections: DataFrame, statements: DataFrame) -> DataFrame:
    """(field, arxiv_id, section_index, item_index) of every item that still holds markup, each key once; cases as for ``measured``."""
    return measured(sections, statements).select(*_KEY).distinct()


#: Repeated keys up to this number go to every task; beyond it, rows are shuffled by key.
REPEATED = 200_000


def plain_texts(sections: DataFrame, statements: DataFrame, scratch: Scratch, repeated: int = REPEATED) -> DataFrame:
    """(field, arxiv_id, section_index, item_index, plain, removed, residue, left_over) of every item, each key once: the least text where repeated rows differ.

    removed: pieces of markup in the text; residue: whether there are any;
    left_over: pieces of markup in the plain text besides code, formulas and
    headings. A null text has a null plain text. Only keys are shuffled to find
    the repeated ones; the texts of these alone meet by key.
    """
    schema = f"{_KEYS}, plain string, removed int, residue boolean, left_over int"
    rows = _items(sections, statements)
    twice = scratch.table(rows.groupBy(_KEY).count().where("count > 1").select(*_KEY), "repeated")
    n = twice.count()
    same = None
    for name in _KEY:
        here = F.col(f"r.{name}").eqNullSafe(F.col(f"t.{name}"))
        same = here if same is None else same & here
    listed = F.broadcast(twice) if n <= repeated else twice
    once = rows.alias("r").join(listed.alias("t"), same, "left_anti") if n else rows
    again = rows.alias("r").join(listed.alias("t"), same, "left_semi").groupBy(_KEY).agg(F.min("text").alias("text")) if n else rows.limit(0)
    return once.unionByName(again).mapInArrow(_cleaned, schema)
