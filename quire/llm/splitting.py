"""Problem 5: splitting oversized items at natural boundaries.

Method: dynamic programming over boundary positions. Each position has a
penalty by what ends there (a paragraph, heading, code block, line, sentence,
clause, word, or nothing). The programme minimises the sum of penalties and of
each piece's squared deviation from the balanced size, subject to the maximum
length; every piece but the first starts with exactly ``overlap`` characters
of the piece before, which count towards its length.

Lengths are code points. Joining the pieces without their overlaps gives the
text back. Defined results: a null text gives no piece; the empty text and any
text within the limit one piece; a language without limit (or null) is not
split; a text without any boundary is cut at multiples of an eighth of the
limit, but never between CR and LF or before a combining mark if another
position is near; clause and word ends are candidates where stronger boundaries
lie more than an eighth of the limit apart; an overlap of
half the limit or more is an error. Equal rows give equal rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE_SCHEMA = "row_id bigint, piece int, pieces int, start_char bigint, end_char bigint, overlap int, cut string, text string"

#: Penalty of a cut by the kind of boundary, and of a cut inside a code block.
PENALTY = {"paragraph": 0.0, "heading": 0.0, "code": 0.2, "line": 1.0, "sentence": 1.2, "clause": 3.0, "word": 5.0, "none": 9.0, "end": 0.0}
INSIDE_CODE = 4.0
AFTER_HEADING = 3.0
BALANCE = 2.0

_BLANK = re.compile(r"(?:\r?\n[ \t]*){2,}")
_LINE = re.compile(r"\r?\n|\r")
_HEADING = re.compile(r"^(?:#{1,6}[ \t]|={1,6}[^=\n]+=+[ \t]*\r?$|\\(?:chapter|(?:sub)*section)\b|<h[1-6]\b)", re.M | re.I)
_FENCE = re.compile(r"^(`{3,}|~{3,}|<pre\b|\\begin\{(?:verbatim|lstlisting)\})", re.M | re.I)
_FENCE_END = {"`": r"^`{3,}[ \t]*\r?$", "~": r"^~{3,}[ \t]*\r?$", "<": r"</pre>", "\\": r"\\end\{(?:verbatim|lstlisting)\}"}
_SENTENCE = re.compile(r"[。！？!?…][”’」』）)\"'»]*|\.[”’)\"'»]*(?=\s)")
_CLAUSE = re.compile(r"[，；：、,;:](?=\s|[^\x00-\x7f])")
_WORD = re.compile(r"\s+")


def code_spans(text: str) -> list[tuple[int, int]]:
    """Positions of code blocks; one without end reaches to the text's end."""
    spans, at = [], 0
    while m := _FENCE.search(text, at):
        line_end = text.find("\n", m.end())
        line_end = len(text) if line_end < 0 else line_end
        end = re.compile(_FENCE_END[m.group(1)[0].lower()], re.M | re.I).search(text, m.end() if m.group(1)[0] in "<\\" else line_end)
        stop = end.end() if end else len(text)
        spans.append((m.start(), stop))
        at = max(stop, m.end())
    return spans


def boundaries(text: str, most: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Positions where the text may be cut, with penalties and kinds; both ends are included."""
    kinds: dict[int, str] = {}

    def add(pos: int, kind: str) -> None:
        if 0 < pos < len(text) and (pos not in kinds or PENALTY[kind] < PENALTY[kinds[pos]]):
            kinds[pos] = kind

    spans = code_spans(text)
    for a, b in spans:
        add(a, "code")
        add(b + (2 if text[b : b + 2] == "\r\n" else 1 if text[b : b + 1] == "\n" else 0), "code")
    for m in _BLANK.finditer(text):
        add(m.end(), "paragraph")
    headings = [m.start() for m in _HEADING.finditer(text)]
    for h in headings:
        add(h, "heading")
    for m in _LINE.finditer(text):
        add(m.end(), "line")
    for m in _SENTENCE.finditer(text):
        end = m.end()
        while end < len(text) and text[end] in " \t":
            end += 1
        add(end, "sentence")

    def fill(pattern: re.Pattern[str], kind: str) -> None:
        """Weaker boundaries, where stronger ones lie far apart."""
        known = sorted({0, len(text), *kinds})
        for a, b in zip(known, known[1:]):
            if b - a > gap:
                for m in pattern.finditer(text, a, b):
                    add(m.end(), kind)

    gap = max(1, most // 8)
    fill(_CLAUSE, "clause")
    fill(_WORD, "word")
    known = sorted({0, len(text), *kinds})
    for a, b in zip(known, known[1:]):
        p = a + gap
        while b - a > gap and p < b:
            q = p
            while q > a + 1 and p - q < 40 and (unicodedata.combining(text[q]) or unicodedata.category(text[q]) in ("Mn", "Cf") or text[q - 1 : q + 1] == "\r\n"):
                q -= 1
            add(q, "none")
            p += gap
    pos = np.array(sorted(kinds), dtype=np.int64)
    names = [kinds[p] for p in pos.tolist()]
    cost = np.array([PENALTY[k] for k in names])
    for a, b in spans:
        cost[(pos > a) & (pos < b)] += INSIDE_CODE
    for h in headings:  # a heading should not stand at the end of a piece, apart from what it heads
        end = text.find("\n", h)
        while 0 <= end < len(text) and text[end] in "\r\n \t":
            end += 1
        cost[(pos > h) & (pos <= (end if end >= 0 else len(text)))] += AFTER_HEADING
    return np.concatenate(([0], pos, [len(text)])), np.concatenate(([0.0], cost, [0.0])), ["", *names, "end"]


def split(text: str, most: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces as (start of the new text, end, kind of the cut at the end); the overlap lies before the start."""
    n = len(text)
    if n <= most:
        return [(0, n, "end")]
    if overlap < 0 or 2 * overlap >= most:
        raise ValueError("the overlap must be less than half the limit")
    pos, cost, kinds = boundaries(text, most)
    step = most - overlap
    ideal = (n - overlap) / max(1, -(-(n - overlap) // step))  # new text of a piece, if all were alike
    best = np.full(len(pos), np.inf)
    back = np.zeros(len(pos), dtype=np.int64)
    best[0] = 0.0
    for j in range(1, len(pos)):
        lo = int(np.searchsorted(pos, pos[j] - step))
        new = (pos[j] - pos[lo:j]).astype(float)
        total = best[lo:j] + BALANCE * ((new - ideal) / ideal) ** 2
        if pos[j] <= most and lo > 0:  # the first piece repeats nothing
            first = best[0] + BALANCE * ((pos[j] - overlap - ideal) / ideal) ** 2
        elif pos[j] <= most:
            first = total[0] = BALANCE * ((pos[j] - overlap - ideal) / ideal) ** 2
        else:
            first = np.inf
        # an overlap needs as much text before it
        if overlap:
            total[(pos[lo:j] < overlap) & (pos[lo:j] > 0)] = np.inf
        k = int(np.argmin(total)) if len(total) else -1
        if k >= 0 and total[k] <= first:
            best[j], back[j] = total[k] + cost[j], lo + k
        else:
            best[j], back[j] = first + cost[j], 0
    cuts, j = [], len(pos) - 1
    while j > 0:
        cuts.append((int(pos[back[j]]), int(pos[j]), kinds[j]))
        j = int(back[j])
    return cuts[::-1]


def limits_of(limits: DataFrame) -> dict[str, tuple[int, int]]:
    """Limit and overlap by language, from the rows of size_limits for pieces (bounded: one for each language)."""
    rows = limits.where("use_for = 'piece' and lang is not null").select("lang", "max_size", "overlap").collect()
    return {r["lang"]: (int(r["max_size"]), int(r["overlap"] or 0)) for r in rows}


def pieces(df: DataFrame, limits: dict[str, tuple[int, int]], id_col: str = "content_id", text_col: str = "book_md", lang_col: str = "lang") -> DataFrame:
    """Rows of :data:`PIECE_SCHEMA`; no shuffle, each text is split where it is read."""
    schema = pa.schema([("row_id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("overlap", pa.int32()), ("cut", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None:
                    continue
                most, overlap = limits.get(lang, (len(text), 0))
                cuts = split(text, most, overlap)
                for k, (a, b, kind) in enumerate(cuts):
                    o = overlap if k else 0
                    rows.append((i, k, len(cuts), a - o, b, o, kind, text[a - o : b]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)

    return df.select(df[id_col].cast("bigint").alias("row_id"), df[lang_col].alias("lang"), df[text_col].alias("text")).mapInArrow(run, PIECE_SCHEMA)
