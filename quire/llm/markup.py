"""Problem 1: markup residue in text documents.

A text is read as a tree of blocks: HTML elements, fenced blocks and divs,
LaTeX environments, wiki tables. Its leaves - lines, or the parts of a line
between block tags - are labelled heading, paragraph, list, quote, table, code,
formula or furniture.

Method: a linear-chain conditional random field over the leaves, with features
of their ancestors and their text, trained on labelled pages and decoded by
Viterbi. The labelled pages are written by :func:`labelled_page` (no labelled
table is given): mixed markup in four languages with the plain uses of the same
characters that are no markup.

From the labels come the clean text and the markup found. A construct that
makes a line something - heading, list, quote, table, rule - counts where the
field gives the line that label; one inside a line counts where the field does
not label the line code; tags, fences, divs and environments that open or close
a block count as they are read into the tree.

Defined results: a null text has a null clean text and no markup, the empty
text an empty clean text; texts of any length are treated whole; unclosed or
cut-off constructs count and reach to the end of their line (fences: of the
text); CRLF and LF are alike; equal rows give equal rows.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LABELS = ("heading", "paragraph", "list", "quote", "table", "code", "formula", "furniture")

#: HTML elements, those that break a line of text, and those whose content is code.
HTML_NAMES = (
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select "
    "small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()
BLOCK_NAMES = "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe li link main meta nav noscript ol p pre script section style table tbody td template tfoot th thead title tr ul".split()
VOID_NAMES = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN_NAMES = {"script", "style", "head", "template", "iframe"}
CODE_ENVIRONMENTS = {"verbatim", "lstlisting", "minted", "Verbatim", "verbatim*", "alltt"}
MATH_ENVIRONMENTS = {"equation", "equation*", "align", "align*", "gather", "gather*", "multline", "eqnarray", "displaymath", "math"}
TABLE_ENVIRONMENTS = {"tabular", "tabular*", "array", "longtable", "tabularx"}
LIST_ENVIRONMENTS = {"itemize", "enumerate", "description"}
QUOTE_ENVIRONMENTS = {"quote", "quotation", "verse"}
#: LaTeX commands that count without braces after them.
PLAIN_COMMANDS = (
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega Gamma Delta Theta Lambda Pi Sigma Phi Psi Omega ldots dots cdots cdot times div pm leq geq neq approx equiv infty sum prod int partial nabla forall exists rightarrow leftarrow "
    "to in left right frac sqrt item it bf em tt sc rm sl hline par noindent newline newpage clearpage maketitle tableofcontents centering quad qquad LaTeX TeX textbackslash label ref cite begin end section subsection subsubsection chapter part paragraph footnote emph textbf textit texttt"
).split()

_NAME = "|".join(sorted(HTML_NAMES, key=len, reverse=True))
_BLOCK = "|".join(sorted(BLOCK_NAMES, key=len, reverse=True))
_CODE_SPAN = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)")
_PATH = re.compile(r"(?<![A-Za-z])[A-Za-z]:(?:\\[\w.\- ]*\w)+|\\\\[\w.]+(?:\\[\w.]+)+")
_BLOCK_MARK = re.compile(rf"<!--.*?(?:-->|$)|<(/?)({_BLOCK})(?=[\s/>]|$)([^<>]*)(>|/>|(?=<)|$)|\\(begin|end)\s*\{{(\w+\*?)\}}(?:\[[^\]]*\])?(?:\{{[^{{}}]*\}})?", re.I)
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^`]*)$")
_DIV = re.compile(r"^:{3,}[ \t]*(.*)$")

#: What shows each language: a pattern, a sign without which it cannot occur, and the labels of the lines where it counts (none named: all but code).
CONSTRUCTS: dict[str, tuple[tuple[re.Pattern[str], str, tuple[str, ...]], ...]] = {
    "html": (
        (re.compile(rf"</?(?:{_NAME})(?:\s[^<>]*)?/?>", re.I), "<", ()),
        (re.compile("<!--"), "<!--", ()),
        (re.compile(rf"</?(?:{_NAME})(?:\s+[a-zA-Z-]+(?:=\S*)?)*\s*$", re.I | re.M), "<", ()),
        (re.compile(rf"</?(?:{_NAME})\s+[a-z-]+=(?:\"[^\"]*|'[^']*)", re.I), "<", ()),
    ),
    "latex": (
        (re.compile(r"\\(?:begin|end)\s*\{"), "\\", ()),
        (re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{"), "\\", ()),
        (re.compile(r"(?<![\w:\\])\\(?:" + "|".join(PLAIN_COMMANDS) + r")(?![a-zA-Z])"), "\\", ()),
        (re.compile(r"\\[()\[\]](?!\w:)"), "\\", ()),
        (re.compile(r"^\s*\$\$|\$\$\s*$|\$\$[^$]+\$\$", re.M), "$$", ()),
        (re.compile(r"(?<![\\$\w])\$(?![\s$\d])[^$\n]*(?<![\s\\])\$(?![\d$])"), "$", ()),
        (re.compile(r"(?<![\\$])\$\d+[^$\n]*[\\^_=+{}][^$\n]*(?<![\s\\])\$(?![\d$])"), "$", ()),
        (re.compile(r"(?<=[一-鿿])\$(?![\s$\d])[^$\n]*[\\^_=+{}][^$\n]*(?<!\s)\$(?!\d)"), "$", ()),
        (re.compile(r"(?<=\S)\s*&\s.*\\\\\s*$", re.M), "&", ("table", "formula")),
    ),
    "markdown": (
        (re.compile(r"^ {0,3}#{1,6}[ \t]+\S", re.M), "#", ("heading",)),
        (re.compile(r"^ {0,3}(?:`{3,}|~{3,})", re.M), "", ()),
        (re.compile(r"(?<!`)(`+)(?!`)[^\n]+?(?<!`)\1(?!`)"), "`", ()),
        (re.compile(r"^:{3,}(?:[ \t]*\{|[ \t]*\w|[ \t]*$)", re.M), ":::", ()),
        (re.compile(r"^ {0,3}>", re.M), ">", ("quote",)),
        (re.compile(r"\{#[\w-]+[^{}\n]*\}[ \t]*$", re.M), "{#", ()),
        (re.compile(r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?)?[ \t]*$", re.M), "---", ("table",)),
        (re.compile(r"^ {0,3}(?:\*[ \t]*){3,}$|^ {0,3}(?:-[ \t]*){3,}$|^ {0,3}(?:_[ \t]*){3,}$", re.M), "", ("furniture",)),
        (re.compile(r"^[ \t]*[-+*][ \t]+(?=\S)(?!\d+\s*$)", re.M), "", ("list",)),
        (re.compile(r"^[ \t]*\d{1,3}[.)][ \t]+\S", re.M), "", ("list",)),
        (re.compile(r"!\[[^\]\n]*\]\("), "![", ()),
        (re.compile(r"(?<!!)\[[^\[\]\n]*\]\([^()\s]*(?:\s+\"[^\"]*\")?\)"), "](", ()),
        (re.compile(r"\[\^[^\]\s]+\]"), "[^", ()),
        (re.compile(r"^ {0,3}\[[^\]\n]+\]:\s+\S", re.M), "]:", ()),
        (re.compile(r"(?<![*\\])\*\*(?![\s*])[^\n]+?(?<![\s*])\*\*(?!\*)"), "**", ()),
        (re.compile(r"(?<![_\w\\])__(?![\s_])[^\n]+?(?<![\s_])__(?![_\w])"), "__", ()),
        (re.compile(r"(?<![~\\])~~(?![\s~])(?:[^~\n]|~(?!~))+(?<!\s)~~"), "~~", ()),
        (re.compile(r"(?<![*\\\d])\*(?![\s*])[^*\n]+?(?<![\s*])\*(?![*\d])"), "*", ()),
        (re.compile(r"(?<![_\w\\])_(?![\s_])[^_\n]+?(?<![\s_])_(?![_\w])"), "_", ()),
        (re.compile(r"<(?:https?|mailto):[^\s<>]+>"), "<", ()),
    ),
    "wiki": (
        (re.compile(r"^[ \t]*(={1,6})(?!=)[ \t]*[^\n]*?\S[ \t]*\1[ \t]*$", re.M), "=", ("heading",)),
        (re.compile(r"\[\[(?=[^\[\]\n]*(?:\]\]|\|)|[A-Za-z]+:)(?!\s*-?\d)[^\[\]\n]"), "[[", ()),
        (re.compile(r"\{\{\s*[A-Za-z一-鿿#][^{}|\n':]*(?:\||\}\})"), "{{", ()),
        (re.compile(r"(?<!')'{2,5}(?![\s'])(?:[^'\n]|'(?!'))+(?<!\s)'{2,5}(?!')"), "''", ()),
        (re.compile(r"^[ \t]*(?:\{\||\|\}|\|-[^|]*$|\|\+)", re.M), "|", ("table",)),
        (re.compile(r"\[https?://[^\s\]]+[^\]\n]*\](?!\()"), "[http", ()),
        (re.compile(r"__(?:TOC|NOTOC|FORCETOC)__"), "__", ()),
    ),
}
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_DELIMITER = re.compile(r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?)?[ \t]*$")


class Leaf:
    __slots__ = ("text", "above", "start", "level")

    def __init__(self, text: str, above: tuple[str, ...], start: int, level: int = 0):
        self.text, self.above, self.start, self.level = text, above, start, level


def _shield(line: str) -> str:
    """The line with inline code blanked, at equal length."""
    return _CODE_SPAN.sub(lambda m: m.group(1) + " " * len(m.group(2)) + m.group(1), line) if "`" in line else line


def read(text: str) -> tuple[list[Leaf], set[str]]:
    """The leaves of a text with their ancestors, and the languages whose block marks were met outside code."""
    leaves: list[Leaf] = []
    marks: set[str] = set()
    above: list[str] = []
    fence = ""
    at = 0
    wiki_table = False
    for line in text.splitlines(keepends=True):
        start, at = at, at + len(line)
        body = line.rstrip("\r\n")
        if fence:
            m = _FENCE.match(body)
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not m.group(2).strip():
                fence = ""
                above.pop()
            elif body.strip():
                leaves.append(Leaf(body, tuple(above), start))
            continue
        coded = next((a for a in reversed(above) if a == "pre" or a in CODE_ENVIRONMENTS or a in HIDDEN_NAMES), "")
        if not coded:
            if m := _FENCE.match(body):
                marks.add("markdown")
                fence = m.group(1)
                above.append("fence")
                continue
            if m := _DIV.match(body):
                marks.add("markdown")
                if m.group(1).strip():
                    above.append("div:" + m.group(1).strip(" {}"))
                else:
                    while above and not above[-1].startswith("div:"):
                        above.pop()
                    if above:
                        above.pop()
                continue
            stripped = body.lstrip()
            if stripped.startswith("{|"):
                marks.add("wiki")
                wiki_table = True
                above.append("wikitable")
                continue
            if wiki_table and stripped.startswith("|}"):
                wiki_table = False
                while above and above.pop() != "wikitable":
                    pass
                continue
        pos = 0
        shielded = body if coded else _shield(body)

        def leaf(a: int, b: int) -> None:
            if body[a:b].strip():
                leaves.append(Leaf(body[a:b], tuple(above), start + a))

        while m := _BLOCK_MARK.search(shielded, pos):
            tag, env = (m.group(2) or "").lower(), m.group(6)
            if coded:  # only its own end leaves code
                ends = (tag == coded and m.group(1) == "/") or (env == coded and m.group(5) == "end")
                if not ends:
                    nxt = m.end() if m.end() > pos else pos + 1
                    if m.end() >= len(shielded):
                        break
                    # what lies between stays part of the leaf
                    m2 = re.compile(rf"</{coded}\b[^>]*>|\\end\s*\{{{re.escape(coded)}\}}", re.I).search(shielded, nxt)
                    if not m2:
                        break
                    leaf(pos, m2.start())
                    pos = m2.end()
                    while above and above.pop() != coded:
                        pass
                    coded = next((a for a in reversed(above) if a == "pre" or a in CODE_ENVIRONMENTS or a in HIDDEN_NAMES), "")
                    continue
            leaf(pos, m.start())
            pos = max(m.end(), pos + 1)
            if env:
                marks.add("latex")
                if m.group(5) == "begin":
                    above.append(env)
                    if env in CODE_ENVIRONMENTS:
                        coded = env
                elif env in above:
                    while above.pop() != env:
                        pass
                    coded = ""
            elif tag:
                marks.add("html")
                if m.group(1) == "/":
                    if tag in above:
                        while above.pop() != tag:
                            pass
                        coded = ""
                elif tag not in VOID_NAMES and m.group(4) == ">":
                    if tag in ("li", "p", "tr", "td", "th", "dt", "dd") and tag in above:  # their end tag may be missing
                        last = len(above) - 1 - above[::-1].index(tag)
                        if not any(a in ("ul", "ol", "table", "blockquote") for a in above[last:]):
                            del above[last:]
                    above.append(tag)
                    if tag == "pre" or tag in HIDDEN_NAMES:
                        coded = tag
            else:
                marks.add("html")  # a comment
        leaf(pos, len(body))
        if not coded and not wiki_table and not body.strip():
            while above and above[-1] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr"):
                above.pop()  # a blank line ends what was left open
    return leaves, marks


_RUNS = (
    ("atx", re.compile(r"^ {0,3}#{1,6}\s")), ("wikihead", re.compile(r"^\s*(={1,6})[^=].*\1\s*$")), ("texhead", re.compile(r"^\s*\\(?:chapter|part|(?:sub)*section|paragraph)\*?\{")), ("bullet", re.compile(r"^\s*[-+*]\s+\S")), ("number", re.compile(r"^\s*\d{1,3}[.)]\s")), ("item", re.compile(r"^\s*\\item\b")),
    ("gt", re.compile(r"^ {0,3}>")), ("pipe", re.compile(r"^\s*\|")), ("bang", re.compile(r"^\s*!\s")), ("delim", _DELIMITER), ("amp", re.compile(r"\s&\s.*\\\\\s*$")), ("rule", re.compile(r"^\s*(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")), ("dollars", re.compile(r"^\s*\$\$|\$\$\s*$")), ("bracket", re.compile(r"^\s*\\\[|\\\]\s*$")),
    ("command", re.compile(r"\\[a-zA-Z]+")), ("mathsign", re.compile(r"[\^_]\{|\\(?:frac|sqrt|sum|alpha|beta|leq)")), ("sentence", re.compile(r"[。！？!?.…”\"»]\s*$")), ("section", re.compile(r"^\s*§")), ("image", re.compile(r"^\s*!\[")), ("template", re.compile(r"^\s*\{\{")), ("category", re.compile(r"^\s*\[\[(?:Category|File|Image):")),
    ("assign", re.compile(r"\w\s*(?:=|==|\+=)\s*\S")), ("call", re.compile(r"\w\([^)]*\)")), ("keyword", re.compile(r"^\s*(?:if|for|while|def|class|return|import|from|print|cat|var|let|const|function|#include)\b")), ("comma", re.compile(r"[,，；;]")), ("digits", re.compile(r"^\s*\d+\s*$")), ("low", re.compile(r"^ {0,3}>\s?\[low-confidence\]")),
)
#: A sign without which each of these cannot occur; the others are tried on every line.
_NEEDS = {
    "atx": "#", "wikihead": "=", "texhead": "\\", "item": "\\item", "gt": ">", "pipe": "|", "bang": "!", "delim": "---", "amp": "&", "dollars": "$$", "bracket": "\\", "command": "\\", "section": "§", "image": "![",
    "template": "{{", "category": "[[", "assign": "=", "call": "(", "low": "[low",
}
_TESTS = tuple((i, _NEEDS.get(name, ""), p.search) for i, (name, p) in enumerate(_RUNS))
_ODD = re.compile(r"[={}()\[\]<>*/\\|;\"']")
#: Feature numbers: one for each (ancestor kind, place), text pattern, neighbour's pattern, length.
_ANCESTORS = ("fence", "pre", "code-env", "math-env", "table-env", "list-env", "quote-env", "div", "wikitable", "heading", "li", "blockquote", "table", "td", "hidden", "p", "other", "none")
FEATURES = 1 + 2 * len(_ANCESTORS) + 3 * len(_RUNS) + 12


def _ancestor(name: str) -> str:
    if name in ("fence", "pre", "wikitable", "li", "blockquote", "p"):
        return name
    if name in CODE_ENVIRONMENTS:
        return "code-env"
    if name in MATH_ENVIRONMENTS:
        return "math-env"
    if name in TABLE_ENVIRONMENTS:
        return "table-env"
    if name in LIST_ENVIRONMENTS:
        return "list-env"
    if name in QUOTE_ENVIRONMENTS:
        return "quote-env"
    if name.startswith("div"):
        return "div"
    if re.fullmatch(r"h[1-6]", name):
        return "heading"
    if name in ("table", "tr", "tbody", "thead"):
        return "table"
    if name in ("td", "th"):
        return "td"
    return "hidden" if name in HIDDEN_NAMES else "li" if name in ("ul", "ol") else "other"


@lru_cache(maxsize=4096)
def _above(above: tuple[str, ...]) -> tuple[int, ...]:
    kinds = [_ancestor(a) for a in above] or ["none"]
    n = len(_ANCESTORS)
    return (1 + _ANCESTORS.index(kinds[-1]), *(1 + n + _ANCESTORS.index(k) for k in sorted(set(kinds))))


def features(leaves: list[Leaf]) -> list[list[int]]:
    """Active features of each leaf: its ancestors, its text, its neighbours' text."""
    base = 1 + 2 * len(_ANCESTORS)
    n = len(_RUNS)
    own = []
    for x in leaves:
        line = x.text
        own.append([i for i, sign, search in _TESTS if sign in line and search(line)])
    out = []
    for k, x in enumerate(leaves):
        f = [0, *_above(x.above), *(base + i for i in own[k])]
        if k:
            f += [base + n + i for i in own[k - 1]]
        if k + 1 < len(leaves):
            f += [base + 2 * n + i for i in own[k + 1]]
        size = len(x.text)
        f.append(base + 3 * n + min(5, size.bit_length() // 2))
        blank = x.text.count(" ") / max(1, size)
        f.append(base + 3 * n + 6 + min(2, int(blank * 10)))
        odd = len(_ODD.findall(x.text)) / max(1, size)
        f.append(base + 3 * n + 9 + min(2, int(odd * 12)))
        out.append(f)
    return out


class Field:
    """The linear-chain conditional random field: emission and transition weights."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        k = len(LABELS)
        self.emit = np.zeros((FEATURES, k)) if emit is None else emit
        self.move = np.zeros((k, k)) if move is None else move

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((i for f in feats for i in f), dtype=np.int64)
        ends = np.cumsum([len(f) for f in feats])
        return np.add.reduceat(self.emit[flat], np.concatenate(([0], ends[:-1])), axis=0)

    def viterbi(self, feats: list[list[int]]) -> list[int]:
        return self.viterbi_all([feats])[0]

    def viterbi_all(self, pages: list[list[list[int]]]) -> list[list[int]]:
        """The best labels of several pages, decoded side by side: longest first, so that at each step the pages not yet ended stand in front."""
        order = sorted((k for k, feats in enumerate(pages) if feats), key=lambda k: -len(pages[k]))
        out: list[list[int]] = [[] for _ in pages]
        if not order:
            return out
        sizes = np.array([len(pages[k]) for k in order])
        scores = [self.scores(pages[k]) for k in order]
        flat, first = np.concatenate(scores), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        v = flat[first]
        back = np.zeros((len(flat), len(LABELS)), dtype=np.int8)
        for t in range(1, int(sizes[0])):
            n = int(np.searchsorted(-sizes, -t, side="left"))  # pages longer than t
            all_ = v[:n, :, None] + self.move[None]
            best = all_.argmax(axis=1)
            at = first[:n] + t
            back[at] = best
            v[:n] = np.take_along_axis(all_, best[:, None], axis=1)[:, 0] + flat[at]
        state = v.argmax(axis=1)
        labels = np.zeros(len(flat), dtype=np.int64)
        labels[first + sizes - 1] = state
        for t in range(int(sizes[0]) - 1, 0, -1):
            n = int(np.searchsorted(-sizes, -t, side="left"))
            at = first[:n] + t
            labels[at - 1] = back[at, labels[at]]
        for i, k in enumerate(order):
            out[k] = labels[first[i] : first[i] + sizes[i]].tolist()
        return out

    def gradient(self, feats: list[list[int]], gold: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the gold labels and its gradient, by forward-backward."""
        s = self.scores(feats)
        n, k = s.shape
        fwd, bwd = np.empty((n, k)), np.zeros((n, k))
        fwd[0] = s[0]
        for t in range(1, n):
            m = fwd[t - 1][:, None] + self.move
            top = m.max(axis=0)
            fwd[t] = top + np.log(np.exp(m - top).sum(axis=0)) + s[t]
        for t in range(n - 2, -1, -1):
            m = self.move + (s[t + 1] + bwd[t + 1])[None]
            top = m.max(axis=1)
            bwd[t] = top + np.log(np.exp(m - top[:, None]).sum(axis=1))
        z = fwd[-1].max() + np.log(np.exp(fwd[-1] - fwd[-1].max()).sum())
        p = np.exp(fwd + bwd - z)
        g_emit, g_move = np.zeros_like(self.emit), np.zeros_like(self.move)
        d = -p
        d[np.arange(n), gold] += 1
        for t, f in enumerate(feats):
            g_emit[f] += d[t]
        for t in range(1, n):
            g_move -= np.exp(fwd[t - 1][:, None] + self.move + (s[t] + bwd[t])[None] - z)
            g_move[gold[t - 1], gold[t]] += 1
        score = s[np.arange(n), gold].sum() + self.move[gold[:-1], gold[1:]].sum()
        return float(score - z), g_emit, g_move

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], epochs: int = 6, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> list[float]:
        rng = random.Random(seed)
        sq_e, sq_m, out = np.full_like(self.emit, 1e-6), np.full_like(self.move, 1e-6), []
        for _ in range(epochs):
            rng.shuffle(pages)
            total = 0.0
            for feats, gold in pages:
                ll, ge, gm = self.gradient(feats, gold)
                total += ll
                ge -= decay * self.emit
                gm -= decay * self.move
                sq_e += ge * ge
                sq_m += gm * gm
                self.emit += rate * ge / np.sqrt(sq_e)
                self.move += rate * gm / np.sqrt(sq_m)
            out.append(total / max(1, sum(len(g) for _, g in pages)))
        return out


def labelled_page(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A page of mixed markup with the labels of its parts: (start, end, label)."""
    han = rng.random() < 0.5

    def words(n: int) -> str:
        if han:
            return "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(2 * n))
        return " ".join("".join(rng.choice("aeiourstlnmdgbp") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    def sentence() -> str:
        base = words(rng.randrange(4, 14)) + ("，" if han else ", ") + words(rng.randrange(2, 8))
        plain = rng.choice(["", "", "", " 3 * 4 * 5", " a < b, c > d", f" ${rng.randrange(1, 90)} - ${rng.randrange(1, 90)}", f" [{rng.randrange(1, 99)}]", " #12", " file_name_old", r" C:\temp\new", " Q & A", " ( < > )", " x = 3"])
        inline = rng.choice(["", "", "", f"**{words(2)}**", f"*{words(1)}*", f"`k_{rng.randrange(9)}`", "`<b>`", f"<b>{words(1)}</b>", f"<i>{words(1)}</i>", "&nbsp;", f"[[{words(1)}]]", f"''{words(2)}''", f"\\emph{{{words(2)}}}", f"$a_{{{rng.randrange(9)}}}+b$", f"\\footnote{{{words(2)}}}", f"[{words(1)}](#ch-{rng.randrange(9)})", f"![{words(1)}](images/p.png)", f"{{{{note|{words(1)}}}}}", f"~~{words(1)}~~"])
        return base + plain + inline + ("。" if han else ".")

    def code_line() -> str:
        return rng.choice(["total = a + b", "x = [[1, 2], [3, 4]]", "# count the lines", "for k in range(9): emit(k)", "print('<b>no</b>')", "return **kwargs", "m = {{ 'a': 1 }}", 'price = "$40"', "if left < right and depth > 3:", "<item id=\"7\">x</item>", 'see = "\\\\section{no}"', "cat a_*.txt | sort", "    y += f(x)", "a = b ** 2 == c", "import os", words(3)])

    def formula() -> str:
        return rng.choice([r"\frac{m}{8}", r"a_{1}+b^{2}", r"\sum_{i=1}^{3} x_i", r"E_1 = \sqrt{t}", r"\alpha_{3} \leq \beta", "s = 8 \\pi r"])

    parts: list[tuple[str, list[tuple[str, str]]]] = []
    out, spans = "", []

    def put(*pieces: tuple[str, str]) -> None:
        nonlocal out
        for text, label in pieces:
            if label:
                spans.append((len(out), len(out) + len(text), label))
            out += text
        out += "\n\n" if rng.random() < 0.85 else "\n"

    for _ in range(rng.randrange(6, 22)):
        kind = rng.randrange(34)
        n = rng.randrange(1, 5)
        para = " ".join(sentence() for _ in range(n))
        if kind < 7:
            put((para, "paragraph"))
        elif kind < 9:
            tag = rng.choice(["p", "P align=center", "div class=\"note\"", "div", "section"])
            put((f"<{tag}>", ""), (para, "paragraph"), (f"</{tag.split()[0]}>", ""))
        elif kind == 9:
            put(("#" * rng.randrange(1, 5) + " " + words(3) + rng.choice(["", f" {{#ch-{n}}}"]), "heading"))
        elif kind == 10:
            eq = "=" * rng.randrange(2, 5)
            put((f"{eq} {words(2)} {eq}", "heading"))
        elif kind == 11:
            put((f"\\{rng.choice(['section', 'chapter', 'subsection'])}{{{words(3)}}}" + rng.choice(["", f"\\label{{ch:{n}}}"]), "heading"))
        elif kind == 12:
            h = rng.randrange(1, 7)
            put((f"<h{h}>", ""), (words(3), "heading"), (f"</h{h}>", ""))
        elif kind == 13:
            put(*[x for k in range(n) for x in ((f"{'- ' if n % 2 else f'{k + 1}. '}{words(2)}", "list"), ("\n", ""))])
        elif kind == 14:
            put(("<ul>\n", ""), *[x for _ in range(n) for x in (("<li>", ""), (words(2), "list"), (rng.choice(["</li>\n", "\n"]), ""))], ("</ul>", ""))
        elif kind == 15:
            env = rng.choice(["itemize", "enumerate"])
            put((f"\\begin{{{env}}}\n", ""), *[x for _ in range(n) for x in ((f"\\item {words(2)}", "list"), ("\n", ""))], (f"\\end{{{env}}}", ""))
        elif kind == 16:
            put(*[x for _ in range(1 + n // 3) for x in ((rng.choice(["> ", ">[low-confidence] ", ">"]) + rng.choice([sentence(), sentence(), words(rng.randrange(1, 4))]), "quote"), ("\n", ""))])
        elif kind == 17:
            put(("<blockquote>", ""), (para, "quote"), ("</blockquote>", ""))
        elif kind == 18:
            put(("\\begin{quote}\n", ""), (para, "quote"), ("\n\\end{quote}", ""))
        elif kind == 19:
            put(("{{quote|" + sentence() + "}}", "quote"))
        elif kind == 20:
            put((f"| {words(1)} | n |", "table"), ("\n", ""), ("|---|---:|", "table"), *[x for _ in range(n) for x in (("\n", ""), (f"| {words(1)} | {n} |", "table"))])
        elif kind == 21:
            put(('{| class="wikitable"\n', ""), (f"! {words(1)}", "table"), *[x for _ in range(n) for x in (("\n", ""), ("|-", "table"), ("\n", ""), (f"| {words(1)} || {n}", "table"))], ("\n|}", ""))
        elif kind == 22:
            put(("<table><tr>", ""), *[x for _ in range(n) for x in (("<td>", ""), (words(1), "table"), ("</td>", ""))], ("</tr></table>", ""))
        elif kind == 23:
            put(("\\begin{tabular}{ll}\n", ""), *[x for _ in range(n) for x in ((f"{words(2)} & {n} \\\\", "table"), ("\n", ""))], ("\\end{tabular}", ""))
        elif kind in (24, 25):
            f = rng.choice(["```", "~~~"])
            put((f + rng.choice(["", "python"] if f == "```" else [""]) + "\n", ""), *[x for _ in range(n) for x in ((code_line(), "code"), ("\n", ""))], (f, ""))
        elif kind == 26:
            put(("<pre><code>", ""), (code_line(), "code"), ("</code></pre>", ""))
        elif kind == 27:
            put(("\\begin{verbatim}\n", ""), (code_line(), "code"), ("\n\\end{verbatim}", ""))
        elif kind == 28:
            put(("$$", "formula"), ("\n", ""), (formula(), "formula"), ("\n", ""), ("$$", "formula"))
        elif kind == 29:
            put(("\\begin{equation}\n", ""), (formula(), "formula"), ("\n\\end{equation}", ""))
        elif kind == 30:
            put((f"\\[ {formula()} \\]", "formula"))
        elif kind == 31:
            put((f"::: {{.{rng.choice(['chapter', 'dialogue', 'toc-list'])}}}\n", ""), (para, "paragraph"), ("\n:::", ""))
        elif kind == 32:
            put(rng.choice([("***", "furniture"), ("---", "furniture"), (f"[[Category:{words(1)}]]", "furniture"), (f"![](images/p{n}_e1.png)", "furniture"), ("<script>var p=6;</script>", ""), ("<!-- page: 3 -->", ""), ("<hr>", "")]))
            if spans and out[spans[-1][0] :].startswith("<script"):
                spans.pop()
        else:
            put((f"§ {n} {words(2)}", "paragraph"))
    del parts
    return out, spans


def label_leaves(leaves: list[Leaf], spans: list[tuple[int, int, str]]) -> list[int]:
    gold = []
    for x in leaves:
        label = next((s[2] for s in spans if s[0] < x.start + len(x.text) and x.start < s[1]), "furniture")
        gold.append(LABELS.index(label))
    return gold


@lru_cache(maxsize=2)
def trained(pages: int = 400, seed: int = 11) -> Field:
    """The field, trained once for each process on ``pages`` labelled pages."""
    rng = random.Random(seed)
    data = []
    for _ in range(pages):
        text, spans = labelled_page(rng)
        leaves, _ = read(text)
        if leaves:
            data.append((features(leaves), label_leaves(leaves, spans)))
    field = Field()
    field.fit(data)
    return field


_BY_LABEL = {label: tuple((language, tuple((p.search, sign) for p, sign, where in patterns if not where or label in where)) for language, patterns in CONSTRUCTS.items()) for label in LABELS}


def constructs(text: str, label: str, known: set[str] = frozenset()) -> set[str]:
    """Languages, but those known, with a construct in a line of this label; inline code counts as Markdown and hides what it holds."""
    found: set[str] = set()
    if label == "code":
        return found
    if "`" in text and _CODE_SPAN.search(text):
        found.add("markdown")
        text = _shield(text).replace("`", " ")
    if "\\" in text:
        text = _PATH.sub(lambda m: " " * len(m.group(0)), text)
    for language, patterns in _BY_LABEL[label]:
        if language not in found and language not in known and any(sign in text and search(text) for search, sign in patterns):
            found.add(language)
    if "html" not in found and "html" not in known and "&" in text and any(m.group(1)[0] == "#" or m.group(1) + ";" in html5 for m in _ENTITY.finditer(text)):
        found.add("html")
    return found


_INLINE = (
    (re.compile(r"<!--.*?(?:-->|$)"), ""), (re.compile(r"<br\s*/?>", re.I), " "), (re.compile(rf"</?(?:{_NAME})(?:\s[^<>]*)?/?>", re.I), ""), (re.compile(rf"<(?:{_NAME})(?:\s+[a-z-]*)?$", re.I | re.M), ""),
    (re.compile(r"\[\[(?:File|Image|Category):[^\[\]]*\]\]", re.I), ""), (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]"), r"\1"), (re.compile(r"\{\{(?:quote|note)\|([^{}|]*)[^{}]*\}\}"), r"\1"), (re.compile(r"\{\{[^{}\n]*\}\}"), ""), (re.compile(r"'{2,5}"), ""),
    (re.compile(r"!\[([^\]\n]*)\]\([^()\n]*\)?"), r"\1"), (re.compile(r"\[([^\[\]\n]*)\]\([^()\n]*\)"), r"\1"), (re.compile(r"\[\^[^\]\s]+\]"), ""), (re.compile(r"(?<!\*)\*\*(?![\s*])([^\n]+?)\*\*"), r"\1"), (re.compile(r"(?<![_\w])__(?!\s)([^\n]+?)__(?!\w)"), r"\1"), (re.compile(r"~~((?:[^~\n]|~(?!~))+)~~"), r"\1"), (re.compile(r"(?<![*\d])\*(?![\s*])([^*\n]+?)(?<!\s)\*(?![*\d])"), r"\1"),
    (re.compile(r"\{#[\w-]+[^{}\n]*\}\s*$"), ""), (re.compile(r"\\(?:label|ref|cite|index)\*?(?:\[[^\]]*\])?\{[^{}]*\}"), ""), (re.compile(r"\\(?:ldots|dots)(?:\{\})?"), "…"), (re.compile(r"\{\\(?:it|bf|em|tt|sc|rm|sl)\s+([^{}]*)\}"), r"\1"), (re.compile(r"\\(?:footnote|emph|text\w+|underline|mbox|section|subsection|subsubsection|chapter|part|paragraph)\*?\{([^{}]*)\}"), r"\1"),
)
_MATH = re.compile(r"\$[^$\n]+\$|\\\(.+?\\\)")


def plain(text: str) -> str:
    """One leaf's text without inline markup; formulas and inline code are kept as ``$...$`` and in backticks."""
    kept: list[str] = []

    def keep(m: re.Match[str]) -> str:
        kept.append(m.group(0))
        return f"\x00{len(kept) - 1}\x00"

    text = _CODE_SPAN.sub(keep, text) if "`" in text else text
    text = _PATH.sub(keep, text) if "\\" in text else text
    text = _MATH.sub(lambda m: keep(m) if re.search(r"[\\^_=+{}]", m.group(0)[1:-1]) and not re.match(r"\$\d+\D*\$$", m.group(0)) else m.group(0), text) if "$" in text or "\\(" in text else text
    for p, new in _INLINE:
        text = p.sub(new, text)
    text = html.unescape(text).replace("\xa0", " ")
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m.group(1))], text).strip()


def _level(x: Leaf) -> int:
    if m := re.match(r"^\s*(#{1,6})\s", x.text):
        return len(m.group(1))
    if m := re.match(r"^\s*(={1,6})", x.text):
        return len(m.group(1))
    if m := re.match(r"^\s*\\(chapter|part|(?:sub)*section|paragraph)", x.text):
        return {"chapter": 1, "part": 1, "section": 2}.get(m.group(1), 3 + m.group(1).count("sub"))
    return next((int(a[1]) for a in reversed(x.above) if re.fullmatch(r"h[1-6]", a)), 2)


def render(leaves: list[Leaf], labels: list[int]) -> str:
    """The clean text: headings with ``#``, lists with ``-`` or numbers, quotes with ``>``, rows with ``|``, code fenced, formulas in ``$$``."""
    blocks: list[tuple[str, str]] = []
    for x, k in zip(leaves, labels):
        label = LABELS[k]
        if label == "code":
            blocks.append((label, x.text))
            continue
        if label == "formula":
            body = re.sub(r"^\s*(?:\$\$|\\\[)|(?:\$\$|\\\])\s*$", "", x.text).strip()
            if body:
                blocks.append((label, body))
            continue
        if label == "furniture" or any(a in HIDDEN_NAMES for a in x.above):
            if m := re.match(r"^\s*!\[([^\]\n]+)\]", x.text):
                blocks.append(("paragraph", m.group(1)))
            continue
        if label == "table":
            if _DELIMITER.match(x.text) or re.match(r"^\s*\|-", x.text):
                continue
            row = re.sub(r"^\s*[|!]\s*|\s*(?:\||\\\\)\s*$", "", x.text)
            cells = [plain(c) for c in re.split(r"\s*(?:\|\||\||!!|(?<!\\)&(?!#?\w+;))\s*", row)]
            same_row = blocks and blocks[-1][0] == "table" and x.above and x.above[-1] in ("td", "th") and not x.text.startswith("|")
            if same_row:
                blocks[-1] = ("table", blocks[-1][1] + " | " + " | ".join(cells))
            else:
                blocks.append((label, "| " + " | ".join(cells)))
            continue
        if label == "heading":
            body = re.sub(r"^\s*(?:#{1,6}|={1,6})\s*|\s*={1,6}\s*$", "", x.text)
            body = plain(body)
            mark = "#" * _level(x) + " "
        elif label == "list":
            m = re.match(r"^\s*(\d{1,3}[.)]|[-+*]|\\item)\s*", x.text)
            mark = (m.group(1) + " " if m and m.group(1)[0].isdigit() else "- ")
            body = plain(x.text[m.end() :] if m else x.text)
        elif label == "quote":
            mark, body = "> ", plain(re.sub(r"^\s*>\s?(?:\[low-confidence\]\s*)?", "", x.text))
        else:
            mark, body = "", plain(x.text)
        if body:
            blocks.append((label, mark + body))
    out: list[str] = []
    i = 0
    while i < len(blocks):
        label = blocks[i][0]
        j = i
        while j < len(blocks) and blocks[j][0] == label and label in ("code", "table", "list", "quote", "formula"):
            j += 1
        j = max(j, i + 1)
        body = "\n".join(b for _, b in blocks[i:j])
        out.append(f"```\n{body}\n```" if label == "code" else f"$$\n{body}\n$$" if label == "formula" else body)
        i = j
    return "\n\n".join(out)


def analyse(texts: list[str], field: Field) -> Iterator[tuple[list[Leaf], list[int], set[str]]]:
    """Of each text its leaves, their labels, and the languages it has constructs of."""
    trees = [read(text) for text in texts]
    decoded = field.viterbi_all([features(leaves) for leaves, _ in trees])
    for (leaves, found), labels in zip(trees, decoded):
        for x, k in zip(leaves, labels):
            if len(found) == len(CONSTRUCTS):
                break
            if not HIDDEN_NAMES.intersection(x.above):
                found |= constructs(x.text, LABELS[k], found)
        yield leaves, labels, found


CLEAN_SCHEMA = "row_id bigint, clean_text string, markup array<string>, blocks map<string,int>"


def clean(df: DataFrame, id_col: str, text_col: str, field: Field | None = None, text_out: bool = True) -> DataFrame:
    """Rows of :data:`CLEAN_SCHEMA`; no shuffle. With ``text_out`` false the clean text is not written."""
    weights = field or trained()
    emit, move = weights.emit, weights.move
    schema = pa.schema([("row_id", pa.int64()), ("clean_text", pa.string()), ("markup", pa.list_(pa.string())), ("blocks", pa.map_(pa.string(), pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(emit, move)
        for batch in batches:
            rows = []
            ids, texts = (c.to_pylist() for c in batch.columns)
            analysed = analyse([t for t in texts if t is not None], model)
            for i, text in zip(ids, texts):
                if text is None:
                    rows.append((i, None, [], []))
                    continue
                leaves, labels, found = next(analysed)
                counts = np.bincount(labels, minlength=len(LABELS)) if labels else np.zeros(len(LABELS), int)
                rows.append((i, render(leaves, labels) if text_out else None, sorted(found), [(name, int(c)) for name, c in zip(LABELS, counts) if c]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(list(zip(*rows)) or [()] * 4, schema)], schema=schema)

    return df.select(df[id_col].cast("bigint").alias("row_id"), df[text_col].alias("text")).mapInArrow(run, CLEAN_SCHEMA)
