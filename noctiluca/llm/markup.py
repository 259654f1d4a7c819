"""Markup residue in text fields: which markup, and the clean text.

A field is parsed into a tree: the field itself at the root, below it blocks, elements and inline marks, nested as
they stand in the text. Every node shows a cue (what it looks like) and has a hidden state: plain text, or markup of
one dialect. Potentials between the states of parent and child, and between state and cue, are counted on labelled
pages; sum-product messages, up the tree and down again, give each node's marginal. A mark that belongs to several
dialects, such as a line starting with an asterisk, is so decided by what stands above, below and beside it, and signs
that only look like markup (arcseconds, prices, spectral classes) stay plain text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctiluca.session import bounded_batches, spread

STATES = ("plain", "html", "markdown", "wiki", "latex")
DIALECTS = STATES[1:]

# Element names of HTML.
ELEMENTS = frozenset(
    "a abbr address article aside audio b bdi bdo big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav nobr noscript ol option p param pre q s samp script section select small source span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
VOID = frozenset("br hr img input link meta col embed param source wbr".split())
#: LaTeX commands whose argument is no part of the text, and declarations that stand at the start of a group.
DROPPED = frozenset("cite citep citet citealt citeauthor ref eqref label pageref bibliography bibliographystyle includegraphics footnote footnotemark vspace hspace".split())
HEADINGS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
SYMBOLS = {"AA": "Å", "aa": "å", "ae": "æ", "AE": "Æ", "o": "ø", "O": "Ø", "ss": "ß", "l": "ł", "L": "Ł", "S": "§", "P": "¶", "dag": "†", "copyright": "©", "ldots": "…", "dots": "…", "textbackslash": "\\", "textasciitilde": "~"}
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")

#: What a field must hold before it is parsed at all. Everything else is plain text.
SUSPECT = r"[<&\\$`{|*_~]|\[|''|(?m:^\s*(?:#{1,6}\s|[-+]\s|\d+[.)]\s|>|=+|-{2,}))|==|  \n"
_SUSPECT = re.compile(SUSPECT)

_RULES: tuple[tuple[str, str, str], ...] = (
    # cue, a character that must be there, pattern; group "in" is what the mark encloses
    ("comment", "<", r"<!--.*?-->"),
    ("entity", "&", r"&(?:\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"),
    ("fence", "```", r"(?m:^)```[^\n]*\n(?P<in>.*?)(?:\n```|\Z)"),
    ("env", "\\", r"\\(?:begin|end)\s*\{[A-Za-z]+\*?\}"),
    ("math_display", "$$", r"\$\$(?P<in>[^$]+)\$\$"),
    ("math", "$", r"(?<![\\$\w])\$(?P<in>[^\s$](?:[^$\n]*[^\s$\\])?)\$(?![\d$])"),
    ("math", "\\", r"\\\((?P<in>.+?)\\\)|\\\[(?P<in2>.+?)\\\]"),
    ("command", "\\", r"\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])*"),
    ("escape", "\\", r"\\[,;:!/&%$\#_{}~^\"'`=.|\\ -]"),
    ("magic_word", "__", r"(?<!\w)__[A-Z]{4,}__(?!\w)"),
    ("template", "{{", r"\{\{(?P<in>[^{}]*)\}\}"),
    ("wikilink", "[[", r"\[\[(?P<in>[^\[\]]+)\]\]"),
    ("extlink", "[", r"(?<!\[)\[(?:https?|ftp)://[^\s\]]+(?:\s(?P<in>[^\]]*))?\]"),
    ("wikitable", "|", r"(?m:^)(?:\{\||\|-|\|\}|!)[^\n]*"),
    ("wikihead", "==", r"(?m:^)(?P<eq>={2,6})[ \t]*(?P<in>[^=\n]+?)[ \t]*(?P=eq)[ \t]*(?m:$)"),
    ("quotes", "''", r"(?<![\w'])(?P<q>'{2,5})(?=[^\s'])(?P<in>[^\n]*?[^\s'])(?P=q)(?!')"),
    ("seconds", "''", r"(?<=\d)''(?!')"),
    ("image", "![", r"!\[(?P<in>[^\[\]\n]*)\]\([^()\s]+(?:\s\"[^\"]*\")?\)"),
    ("mdlink", "](", r"(?<![!\]])\[(?P<in>[^\[\]\n]+)\]\([^()\s]+(?:\s\"[^\"]*\")?\)"),
    ("reflink", "][", r"(?<!\[)\[(?P<in>[^\[\]\n]+)\]\[[^\[\]\n]*\]"),
    ("mdnote", "[^", r"\[\^[^\]\s]+\]"),
    ("strong", "**", r"(?<![\w*])(?P<st>\*{2,3})(?=[^\s*])(?P<in>[^\n*]*[^\s*])(?P=st)(?![\w*])"),
    ("strong", "__", r"(?<![\w_])__(?![A-Z]{4,}__)(?=[^\s_])(?P<in>[^\n_]*[^\s_])__(?![\w_])"),
    ("emph", "*", r"(?<![\w*\\])\*(?=[^\s*])(?P<in>[^\n*]*[^\s*])\*(?![\w*])"),
    ("emph", "_", r"(?<![\w_\\])_(?=[^\s_])(?P<in>[^\n_]*[^\s_])_(?![\w_])"),
    ("strike", "~~", r"~~(?=[^\s~])(?P<in>[^\n~]*[^\s~])~~"),
    ("codespan", "`", r"(?<!`)`(?P<in>[^`\n]+)`(?!`)"),
    ("atx", "#", r"(?m:^)[ \t]{0,3}\#{1,6}[ \t]+(?P<in>[^\n]+)"),
    ("setext", "\n", r"(?m:^)(?P<in>[^\s|][^\n|]*)\n(?:={2,}|-{2,})[ \t]*(?m:$)"),
    ("mdtable", "|", r"(?m:^)[ \t]*\|[^\n]*\|[ \t]*\n[ \t]*\|[ \t:|-]+\|[ \t]*(?:\n[ \t]*\|[^\n]*\|[ \t]*(?m:$))*"),
    ("star_item", "*", r"(?m:^)[ \t]*\*{1,4}[ \t]+(?P<in>[^\n]+)"),
    ("dash_item", "", r"(?m:^)[ \t]*[-+][ \t]+(?P<in>[^\n]+)"),
    ("number_item", "", r"(?m:^)[ \t]*\d{1,3}[.)][ \t]+(?P<in>[^\n]+)"),
    ("quote_line", ">", r"(?m:^)>[ \t]?(?P<in>[^\n]*)"),
    ("hard_break", "  \n", r"(?<=\S)[ ]{2,}\n(?=\s*\S)"),
    # signs that only look like markup
    ("class_star", "*", r"(?<=\w)\*(?!\*)|(?<=\s)\*(?=\s)"),
    ("price", "$", r"\$(?=\d)"),
    ("inner_underscore", "_", r"(?<=\w)_(?=\w)"),
    ("tilde", "~", r"(?<!~)~(?=[\d\s])"),
    ("bracket", "[", r"(?<!\[)\[[^\[\]\n]*\](?![(\[])"),
    ("braces", "{", r"(?<![\w{}\]*])\{[^{}\\\n]*\}"),
    ("bar", "|", r"(?<=\w)\|(?=\w)"),
    ("equals", "==", r"(?<=\s)==(?=\s)"),
    ("hash", "#", r"(?<!^)\#(?=\d)"),
    ("ampersand", "&", r"&(?![\#A-Za-z0-9]+;)"),
    ("angle", "<", r"<(?![A-Za-z/!])"),
)
_COMPILED = tuple((cue, need, re.compile(pattern, re.S)) for cue, need, pattern in _RULES)
_TAG = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9]*)(?P<attrs>(?:\s[^<>]*)?)(?P<self>/?)>")
#: Cues whose dialect can be told from themselves; used for the bare words, where no model is at hand.
OWN_DIALECT = {
    **dict.fromkeys(("tag", "closed_tag", "comment", "entity"), "html"),
    **dict.fromkeys(("env", "math_display", "math", "command", "escape"), "latex"),
    **dict.fromkeys(("magic_word", "template", "wikilink", "extlink", "wikitable", "wikihead", "quotes"), "wiki"),
    **dict.fromkeys(("fence", "image", "mdlink", "reflink", "mdnote", "strong", "emph", "strike", "codespan", "atx", "setext", "mdtable", "dash_item", "star_item", "number_item", "quote_line", "hard_break"), "markdown"),
}
LOOKALIKES = frozenset(("seconds", "class_star", "price", "inner_underscore", "tilde", "bracket", "braces", "bar", "equals", "hash", "ampersand", "angle", "odd_tag"))
#: Cues that plain texts have as well, such as blanks at the ends of lines: they are taken out of the clean text, but a
#: dialect is only found where another of its marks stands.
WEAK = frozenset(("hard_break",))
_RAW = frozenset(("fence", "codespan", "comment"))


@dataclass
class Node:
    """A mark in the text: where it stands, what it looks like, and what stands inside."""

    cue: str
    start: int
    end: int
    inner: tuple[int, int] | None = None
    name: str = ""
    level: int = 0
    children: list[Node] = field(default_factory=list)


def parse(text: str) -> Node:
    """The tree of all marks and look-alikes of a text."""
    root = Node("root", 0, len(text), (0, len(text)))
    if not _SUSPECT.search(text) and "#" not in text:
        return root
    found: list[Node] = []
    if "<" in text:
        opened: list[tuple[str, re.Match]] = []
        for m in _TAG.finditer(text):
            name, attrs = m["name"].lower(), m["attrs"].strip().rstrip("/")
            if name not in ELEMENTS or attrs and "=" not in attrs:
                found.append(Node("odd_tag", m.start(), m.end(), (m.start() + 1, m.end() - 1), name))
            elif m["close"]:
                while opened and opened[-1][0] != name and any(n == name for n, _ in opened):
                    n, o = opened.pop()
                    found.append(Node("tag", o.start(), o.end(), None, n))
                if opened and opened[-1][0] == name:
                    _, o = opened.pop()
                    found.append(Node("closed_tag", o.start(), m.end(), (o.end(), m.start()), name))
                else:
                    found.append(Node("tag", m.start(), m.end(), None, name))
            elif name in VOID or m["self"]:
                found.append(Node("tag", m.start(), m.end(), None, name))
            else:
                opened.append((name, m))
        found += [Node("tag", o.start(), o.end(), None, n) for n, o in opened]
    for cue, need, pattern in _COMPILED:
        if need and need not in text:
            continue
        for m in pattern.finditer(text):
            inner = None
            for group in ("in", "in2"):
                if group in pattern.groupindex and m[group] is not None:
                    inner = m.span(group)
            name, level = "", 0
            if cue == "command":
                name = m.group()[1:].partition("[")[0].rstrip("*")
            elif cue == "entity" and html.unescape(m.group()) == m.group():
                continue
            elif cue == "wikihead":
                level = len(m["eq"])
            elif cue == "atx":
                level = len(m.group().split()[0])
            found.append(Node(cue, m.start(), m.end(), inner, name, level))
    found.sort(key=lambda n: (n.start, -n.end, n.cue in ("class_star", "price", "bracket", "braces", "tilde", "angle", "equals", "setext")))
    stack, taken = [root], -1
    for node in found:
        while stack[-1] is not root and stack[-1].end <= node.start:
            stack.pop()
        top = stack[-1]
        lo, hi = top.inner or (top.start, top.start)
        if not (lo <= node.start and node.end <= hi):
            continue  # crosses another mark, or stands in one that encloses nothing
        if top.cue in _RAW or top.name in ("code", "pre", "verbatim") and node.cue not in ("entity", "tag", "closed_tag"):
            continue
        if top.cue in ("wikilink", "template", "mdtable", "mdlink", "extlink") and node.cue in LOOKALIKES:
            continue
        if top.cue in ("math", "math_display") and node.cue not in ("command", "escape"):
            continue
        top.children.append(node)
        stack.append(node)
    return root


def walk(node: Node) -> Iterator[Node]:
    for child in node.children:
        yield child
        yield from walk(child)


# ---------------------------------------------------------------- the model


@dataclass(frozen=True)
class TreeModel:
    """Potentials: root[s], link[parent state, child state], and one row of states per cue."""

    root: np.ndarray
    link: np.ndarray
    cue: dict[str, np.ndarray]
    other: np.ndarray

    def marginals(self, tree: Node) -> dict[int, np.ndarray]:
        """P(state) of every node below the root, by messages upward and downward; keys are id(node)."""
        up: dict[int, np.ndarray] = {}
        order = [tree, *walk(tree)]
        local = {id(n): self.root if n is tree else self.cue.get(n.cue, self.other) for n in order}
        parent = {id(c): n for n in order for c in n.children}
        belief = {i: v.copy() for i, v in local.items()}
        for n in reversed(order):
            if n is not tree:
                message = self.link @ belief[id(n)]
                up[id(n)] = message / message.sum()
                above = belief[id(parent[id(n)])]
                above *= up[id(n)]
                above /= above.sum()
        for n in order:
            if n is not tree:
                rest = belief[id(parent[id(n)])] / up[id(n)]
                mine = belief[id(n)] * (self.link.T @ (rest / rest.sum()))
                belief[id(n)] = mine / mine.sum()
        return {id(n): belief[id(n)] for n in order if n is not tree}


def _labelled_page(words: list[str], rng: random.Random) -> list[tuple[str, str]]:
    """A made page as (piece, dialect of the marks in it): a plain passage with marks of one or two dialects set into it."""
    w = lambda a=1, b=1: " ".join(rng.choice(words) for _ in range(rng.randint(a, max(a, b))))
    inline = {
        "html": [lambda: f"<b>{w()}</b>", lambda: f"<em>{w(1, 3)}</em>", lambda: f'<a href="http://x.example/{w()}">{w()}</a>', lambda: f"{w()}<sup>{rng.randint(1, 9)}</sup>", lambda: rng.choice(["&amp;", "&nbsp;", "&#8217;", "&lt;", "&gt;", "&ldquo;"]), lambda: "<br>", lambda: f"<p>{w(3, 6)} <i>{w()}</i></p>", lambda: f"<ul><li>{w(2, 4)}</li><li>{w(2, 4)}</li></ul>", lambda: "<!-- note -->"],
        "markdown": [lambda: f"**{w()}**", lambda: f"*{w(1, 2)}*", lambda: f"_{w()}_", lambda: f"~~{w()}~~", lambda: f"`{w()}`", lambda: f"[{w()}](http://x.example/{w()})", lambda: f"[{w()}][ref]", lambda: "[^2]", lambda: f"![{w()}](f.png)", lambda: f"\n\n## {w()}\n\n", lambda: f"\n\n- {w(3, 6)}\n- {w(3, 6)}\n\n", *[lambda: f"\n\n* {w(3, 6)}\n* {w(3, 6)} **{w()}**\n\n"] * 4, lambda: f"\n\n1. {w(3, 6)}\n2. {w(3, 6)}\n\n", lambda: f"\n\n```\n{w(3)}\n```\n\n", lambda: f"\n\n> {w(4, 8)}\n\n", lambda: f"{w()}.  \n{w(3, 6)}.  \n{w()}", lambda: f"\n\n{w()}\n-----\n", lambda: f"\n\n| {w()} | {w()} |\n|---|---|\n| 1 | 2 |\n\n"],
        "wiki": [lambda: f"[[{w()}]]", lambda: f"[[{w()}|{w()}]]", lambda: f"''{w()}''", lambda: f"'''{w()}'''", lambda: "{{" + w() + "}}", lambda: "__NOTOC__\n", lambda: f"[https://x.example {w()}]", lambda: f"\n== {w()} ==\n", lambda: f"\n* [[{w()}]] {w(3, 6)}\n* [[{w()}]] {w(2, 4)}\n", lambda: '\n{| class="a"\n|-\n| ' + w() + "\n|}\n"],
        "latex": [lambda: f"\\emph{{{w()}}}", lambda: f"\\textbf{{{w()}}}", lambda: f"{{\\bf {w()}}}", lambda: rng.choice(["$\\alpha = 2$", "$H_0$", "$x^2$", "$$a + b$$", "\\(x_1\\)"]), lambda: "~\\cite{ab12}", lambda: f"\\section{{{w()}}}", lambda: f"\\begin{{itemize}} \\item {w(2, 4)} \\end{{itemize}}", lambda: "\\,", lambda: "\\&"],
        "plain": [lambda: f"{rng.randint(1, 9)}'' by {rng.randint(1, 9)}''", lambda: "A* and B*", lambda: f"about ~{rng.randint(2, 90)}", lambda: f"from ${rng.randint(2, 90)} to ${rng.randint(2, 90)}", lambda: "a_b_c", lambda: "R_50", lambda: "[Fe/H]", lambda: "{g, r}", lambda: "A|B", lambda: "x<y and y>z", lambda: "a < b", lambda: "H&K", lambda: f"#{rng.randint(1, 99)}", lambda: "a == b", lambda: "3 * n"],
    }
    kinds = rng.choices(("none", "one", "two"), (3, 6, 1))[0]
    chosen = [] if kinds == "none" else rng.sample(DIALECTS, 1 if kinds == "one" else 2)
    pieces: list[tuple[str, str]] = []
    for _ in range(rng.randint(2, 6)):
        pieces.append((" " + w(4, 9) + " ", "plain"))
        dialect = rng.choice(chosen) if chosen and rng.random() < 0.7 else "plain"
        pieces.append((rng.choice(inline[dialect])(), dialect))
    pieces.append((" " + w(3, 6), "plain"))
    return pieces


def train(words: list[str], pages: int = 3000, seed: int = 5, smooth: float = 0.05) -> TreeModel:
    """Count the potentials on labelled pages: words of the corpus with marks and look-alikes of known kind set in."""
    rng = random.Random(seed)
    index = {s: i for i, s in enumerate(STATES)}
    root, link = np.full(5, 1.0), np.full((5, 5), smooth)
    cues: dict[str, np.ndarray] = {}
    for _ in range(pages):
        pieces = _labelled_page(words or ["word"], rng)
        text, spans = "", []
        for piece, dialect in pieces:
            spans.append((len(text), len(text) + len(piece), index[dialect]))
            text += piece
        tree = parse(text)
        counted = np.bincount([s for _, _, s in spans if s] or [0], minlength=5)
        top = int(np.argmax(counted)) if counted[1:].any() else 0
        root[top] += 1
        label = {id(tree): top}
        for node in [tree, *walk(tree)]:
            for child in node.children:
                mid = (child.start + child.end - 1) / 2
                state = max(((min(b, child.end) - max(a, child.start), s) for a, b, s in spans if a <= mid < b or s and min(b, child.end) > max(a, child.start)), default=(0, 0))[1]
                label[id(child)] = state
                link[label[id(node)], state] += 1
                cues.setdefault(child.cue, np.full(5, smooth))[state] += 1
    total = sum(cues.values())
    return TreeModel(root / root.sum(), link / link.sum(axis=1, keepdims=True), {c: v / total / (v / total).sum() for c, v in cues.items()}, np.full(5, 0.2))


# ---------------------------------------------------------------- clean text


def _command(text: str, node: Node) -> tuple[int, int, int, int]:
    """End of a command's options and, if it has one, where its braced argument begins and ends (else -1, -1)."""
    at = node.end
    while at < len(text) and text[at] == "[" and (close := text.find("]", at)) >= 0:
        at = close + 1
    if at < len(text) and text[at] == "{":
        depth, i = 0, at
        while i < len(text):
            depth += (text[i] == "{" and text[i - 1] != "\\") - (text[i] == "}" and text[i - 1] != "\\")
            if depth == 0:
                return at, at + 1, i, i + 1
            i += 1
    return node.end, -1, -1, node.end


def _latex(text: str, words: bool) -> str:
    """A stretch of LaTeX without its commands; what the commands enclose stays, unless it is a key or a note."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            m = re.compile(r"\\([A-Za-z]+)\*?").match(text, i)
            if m:
                name = m.group(1)
                stop, a, b, after = _command(text, Node("command", m.start(), m.end()))
                if name in ("begin", "end"):
                    env = text[a:b].rstrip("*") if a > 0 else ""
                    if env in ("equation", "align", "displaymath", "eqnarray", "gather", "multline") and name == "begin" and (close := text.find("\\end{" + text[a:b] + "}", after)) >= 0:
                        body = re.sub(r"\\label\{[^}]*\}", "", text[after:close]).strip()
                        out.append(" " + _words_of_formula(body) + " " if words else f" ${body}$ ")
                        i = close + len("\\end{" + text[a:b] + "}")
                        continue
                    if env in ("verbatim", "lstlisting") and name == "begin" and (close := text.find("\\end{" + text[a:b] + "}", after)) >= 0:
                        out.append(f" {text[after:close]} " if words else f"\n```\n{text[after:close].strip()}\n```\n")
                        i = close + len("\\end{" + text[a:b] + "}")
                        continue
                    out.append("\n")
                    i = after
                elif name in DROPPED and a > 0:
                    if name == "footnote" and not words:
                        out.append(f" ({_latex(text[a:b], words)})")
                    i = after
                    if out and out[-1].endswith("~"):
                        out[-1] = out[-1][:-1]
                elif name in HEADINGS and a > 0:
                    out.append(f"\n\n{'' if words else '#' * HEADINGS[name] + ' '}{_latex(text[a:b], words).strip()}\n\n")
                    i = after
                elif name == "item":
                    out.append("\n" if words else "\n- ")
                    i = len(text) - len(text[m.end() :].lstrip())
                elif name in SYMBOLS:
                    out.append(SYMBOLS[name])
                    i = after if a > 0 and a == b else m.end()
                elif a > 0:
                    out.append(_latex(text[a:b], words))
                    i = after
                else:
                    out.append("")
                    i = len(text) - len(text[m.end() :].lstrip(" "))
                continue
            out.append({",": " ", ";": " ", ":": " ", " ": " ", "\\": "\n"}.get(text[i + 1], text[i + 1] if text[i + 1] in "&%$#_{}~" else ""))
            i += 2
            continue
        if c == "~":
            out.append("" if text.startswith("~\\cite", i) or text.startswith("~\\ref", i) else " ")
        elif c not in "{}" or (i and text[i - 1] == "\\"):
            out.append(c)
        i += 1
    return "".join(out)


def _words_of_formula(body: str) -> str:
    return re.sub(r"\\[A-Za-z]+|\\.", " ", re.sub(r"\\(?:mathrm|mathbf|text|rm|mbox)\b\s*", " ", body))


def render(text: str, tree: Node, taken: set[int], words: bool = False) -> str:
    """The text without the marks in ``taken``. Headings stay as '# ' lines, list entries as '- ' lines, code between
    back quotes and formulas between dollar signs; with ``words`` only what counts as the text's words stays."""
    latex = any(id(n) in taken and n.cue in ("command", "env", "escape") for n in walk(tree))

    def inside(node: Node) -> str:
        lo, hi = node.inner or (node.start, node.end)
        out, at = [], lo
        for child in node.children:
            out.append(text[at : child.start])
            out.append(one(child))
            at = child.end
        out.append(text[at:hi])
        return "".join(out)

    def one(node: Node) -> str:
        raw = text[node.start : node.end]
        if id(node) not in taken:
            if node.inner is None or not node.children:
                return raw
            return text[node.start : node.inner[0]] + inside(node) + text[node.inner[1] : node.end]
        body = inside(node) if node.inner else ""
        cue, name = node.cue, node.name
        if cue in ("tag", "closed_tag"):
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                return f"\n\n{'' if words else '#' * int(name[1]) + ' '}{body.strip()}\n\n"
            if name == "li":
                return f"\n{'' if words else '- '}{body.strip()}"
            if name == "pre":
                return f"\n{body}\n" if words else "\n```\n" + body.strip().strip("`") + "\n```\n"
            if name == "code":
                return body if words else f"`{body}`"
            if name in ("script", "style"):
                return " "
            if name in ("td", "th"):
                return body + (" " if words else " | ")
            if name in ("br", "hr", "p", "div", "ul", "ol", "tr", "table", "blockquote", "dl", "dd", "dt", "section", "article"):
                return f"\n{body.strip()}\n"
            if name in ("sup", "sub"):
                return f" {body} "
            return body
        if cue == "comment":
            return " "
        if cue == "entity":
            return html.unescape(raw)
        if cue == "fence":
            return f"\n{body}\n" if words else f"\n```\n{body.strip()}\n```\n"
        if cue in ("math", "math_display"):
            if re.fullmatch(r"\\(?:mathrm|text|mbox|textrm)\{[^{}$\\]*\}", body := text[node.inner[0] : node.inner[1]].strip()):
                return body[body.index("{") + 1 : -1]
            return " " + _words_of_formula(body) + " " if words else f"${body}$"
        if cue == "template":
            return body.rpartition("|")[2].rpartition("=")[2]
        if cue == "wikilink":
            target, _, label = body.partition("|")
            return " " if re.match(r"(?i)(file|image|category|datei|bild|fichier|archivo)\s*:", target) else label.rpartition("|")[2] or target
        if cue == "wikitable":
            return "" if raw[:2] in ("{|", "|-", "|}") else raw.lstrip("|! ").replace("||", "|")
        if cue in ("wikihead", "atx", "setext"):
            return f"\n\n{'' if words else '#' * max(1, node.level) + ' '}{body.strip().rstrip('#').strip()}\n\n"
        if cue in ("star_item", "dash_item", "number_item"):
            return f"{'' if words else '- '}{body}"
        if cue == "mdnote":
            return ""
        if cue == "mdtable":
            rows = [r.strip().strip("|") for r in raw.split("\n") if not re.fullmatch(r"[\s:|-]+", r)]
            return "\n".join(" | ".join(c.strip() for c in r.split("|")) for r in rows)
        if cue == "codespan":
            return body if words else f"`{body}`"
        if cue == "hard_break":
            return "\n"
        return body if node.inner else raw if latex else ""

    out = inside(tree)
    if latex:
        held: list[str] = []  # formulas and code keep their commands
        def hold(m: re.Match) -> str:
            held.append(m.group())
            return f"\x00{len(held) - 1}\x00"
        out = _latex(out if words else re.sub(r"\$[^$]+\$|```.*?```|`[^`\n]+`", hold, out, flags=re.S), words)
        out = re.sub("\x00(\\d+)\x00", lambda m: held[int(m.group(1))], out)
    out = INVISIBLE.sub("", out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\u00a0\u2009]+", " ", re.sub(r"[ \t]*\n[ \t]*", "\n", out))).strip()


def without_markup(text: str, dialects: tuple[str, ...] = DIALECTS) -> str:
    """The text as it counts for its words: every mark whose cue tells its own dialect is taken out, if it is one of those."""
    for turn in range(3):
        if not _SUSPECT.search(text) and "#" not in text:
            break
        tree = parse(text)
        taken = {id(n) for n in walk(tree) if OWN_DIALECT.get(n.cue) in dialects and (not turn or OWN_DIALECT[n.cue] == "html")}
        if not taken:
            break
        again = any(n.cue == "entity" for n in walk(tree))
        text = render(text, tree, taken, words=True)
        if not again:
            break
    return INVISIBLE.sub("", text)


def without_elements(text: str) -> str:
    """The text without HTML elements and entities; other marks consist of signs that are no words."""
    return without_markup(text, ("html",)) if "<" in text or "&" in text else text


def clean_field(text: str, model: TreeModel) -> tuple[str, list[str], dict[str, float]]:
    """(clean text, dialects found, marginal of each dialect's surest mark)."""
    surest, shown = dict.fromkeys(DIALECTS, 0.0), dict.fromkeys(DIALECTS, 0.0)
    for turn in range(3):
        tree = parse(text)
        if not tree.children:
            break
        marginal = model.marginals(tree)
        taken: set[int] = set()
        again = False
        for node in walk(tree):
            p = marginal[id(node)]
            best = int(np.argmax(p))
            if turn and node.cue not in ("tag", "closed_tag", "entity", "comment"):
                continue  # later turns only look for elements that had been escaped
            if best and p[best] > 0.5:
                taken.add(id(node))
                surest[STATES[best]] = max(surest[STATES[best]], float(p[best]))
                if node.cue not in WEAK:
                    shown[STATES[best]] = surest[STATES[best]]
                again |= node.cue == "entity"
        if not taken:
            break
        text = render(text, tree, taken)
        if not again or not re.search(r"<\s*/?[A-Za-z]|&[#\w]+;", text):
            break
    return INVISIBLE.sub("", text).strip(), [d for d in DIALECTS if shown[d] > 0.5], surest


RESULT = "paper_id bigint, field_name string, clean_text string, markup array<string>, headings int, list_entries int, code_blocks int, formulas int"


def clean_markup(records: DataFrame, id_col: str = "paper_id", fields: tuple[str, ...] = ("title", "abstract"), sample_rows: int = 2000, pages: int = 3000, seed: int = 5) -> DataFrame:
    """One row per record and field: the clean text, the dialects whose residue it held, and counts of kept structure.

    The model's labelled pages are made from the words of at most ``sample_rows`` rows (a documented bound), those of least
    hash of id and text, so the model doesn't depend on the order of rows; every row is cleaned. A null field gives a null text and no dialects, an empty or blank one an empty text; repeated rows stay
    repeated; further columns are not read and may have any name; an empty table gives no rows.
    """
    spark = records.sparkSession
    whole = records.select(F.col(f"`{id_col}`").cast("bigint").alias("paper_id"), *[F.col(f"`{f}`").cast("string").alias(f"_{i}") for i, f in enumerate(fields)])
    joined = F.concat_ws(" ", *[f"_{i}" for i in range(len(fields))])
    drawn = whole.select(F.xxhash64("paper_id", joined).alias("h"), joined.alias("t")).orderBy("h", "t").limit(sample_rows)
    some = drawn.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("([A-Za-z]{3,})"), F.lit(1)))).alias("w")).distinct().orderBy("w").limit(20_000).collect()
    model = spark.sparkContext.broadcast(train([r["w"] for r in some], pages, seed))
    long = whole.select("paper_id", F.posexplode(F.array(*[f"_{i}" for i in range(len(fields))])).alias("at", "text"))
    names = list(fields)

    bounded_batches(spark)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for paper, at, text in zip(batch["paper_id"], batch["at"], batch["text"], strict=True):
                if text is None:
                    rows.append((paper, names[at], None, [], 0, 0, 0, 0))
                    continue
                out, found, _ = clean_field(text, model.value)
                rows.append((paper, names[at], out, found, len(re.findall(r"(?m)^#{1,6} ", out)) if found else 0, len(re.findall(r"(?m)^- ", out)) if found else 0, out.count("```") // 2, len(re.findall(r"\$[^$\s][^$\n]*\$", out)) if "latex" in found else 0))
            result = pd.DataFrame(rows, columns=["paper_id", "field_name", "clean_text", "markup", "headings", "list_entries", "code_blocks", "formulas"])
            result["paper_id"] = result["paper_id"].astype("Int64")
            yield result

    return spread(long).mapInPandas(clean, RESULT)


def residue(cleaned: DataFrame) -> DataFrame:
    """(paper_id, field_name, markup): a row for each dialect whose residue a field holds."""
    return cleaned.select("paper_id", "field_name", F.explode("markup").alias("markup")).distinct()


def kept_structure(cleaned: DataFrame) -> DataFrame:
    """(field_name, markup, fields, headings, list_entries, code_blocks, formulas): per field and dialect, how many fields
    held residue and how much structure their clean text keeps. A field with two dialects counts for both."""
    counts = [F.sum(c).cast("bigint").alias(c) for c in ("headings", "list_entries", "code_blocks", "formulas")]
    return cleaned.select("field_name", F.explode("markup").alias("markup"), "headings", "list_entries", "code_blocks", "formulas").groupBy("field_name", "markup").agg(F.count("*").alias("fields"), *counts)
