"""Problem 6: noise in text from scanned pages.

Method: words, ideographs and their neighbours are counted over all elements.
Skip-gram vectors are trained on those counts: context vectors from the summed
co-occurrences, then a vector of its own for each word that may be misread or
be the original of a misread one, over partitions. Rare words are linked to
frequent ones that differ by plausible glyph edits (``rn`` for ``m``, ``c`` for
``e``, a rubbish sign for any letter, look-alike ideographs), and an occurrence
is corrected to the linked word that its neighbours favour most, if by their
vectors that word stands beside them more often than by chance. Then furniture is removed - page numbers and repeated
heads at the page edge, as elements or inside others - and lines are reflowed
into paragraphs.

Scale: passes over the text, none of which moves it. What is shuffled are
counts (summed per partition first), suspicious words and lines at the page
edge. To the driver come ``VECTORS`` context rows and at most :data:`KNOWN`
words of each sort, which only save work: what they do not name is decided by
equi-joins in the same way. No group is bound to one book or page.

Defined results: null and empty texts have no noise and give no paragraph;
null boxes count as not at the edge; null pages take part in nothing that needs
a page; equal rows give one result; in an empty table nothing is found.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.lookalike import consistent
from quire.runtime import cut

#: Most words the workers are told beforehand to be good (to save events only), places of the context vectors, their length; rarity: a word is rare against one RATIO times as frequent that occurs at least LEAST times.
KNOWN, VECTORS, LENGTH, RATIO, LEAST = 20_000, 1024, 32, 8, 5
#: Skip-gram: negatives for each pair, weight of a vector's shortness.
NEGATIVES, RIDGE = 3.0, 0.5
#: Partial counts of a word merged in one task.
MERGED = 256
#: Most books whose page heights (two columns) are broadcast.
BROADCAST_BOOKS = 100_000
#: Edges of a page, as shares of its height; a head stands on at least so many pages.
TOP, BOTTOM, HEAD_PAGES = 0.06, 0.925, 3

#: Signs put for what could not be recognised; hyphen-like marks.
RUBBISH = "■¤□�◇◆●▲"
MARKS = "-‐¬­"
#: What is printed and what it is misread as, in Latin letters.
EDITS = (("m", "rn"), ("rn", "m"), ("cl", "d"), ("ü", "ii"), ("n", "ri"), ("d", "cl"), ("w", "vv"), ("u", "ii"), ("h", "li"), ("e", "c"), ("i", "l"), ("l", "1"), ("i", "1"), ("l", "I"), ("o", "0"), ("s", "5"), ("t", "f"), ("h", "b"), ("g", "9"), ("q", "9"), ("g", "q"), ("é", "6"), ("b", "6"), ("z", "2"), ("B", "8"), ("c", "e"), ("l", "i"), ("l", "t"), ("n", "u"), ("u", "n"), ("a", "o"))
#: Ideographs and those they are misread as.
HAN_EDITS = dict(
    x.split(":") for x in (
        "里:甲 方:万 人:入八 大:犬太 石:右 林:杯 城:域 路:赂 记:纪 河:何 白:臼自 盐:监 火:灭 金:佥 时:吋 日:曰目 钟:钏 灯:打 月:冃 水:氷 青:肓 木:朩 院:陀 天:夭夫 图:囹 船:般 山:屮 塔:搭 茶:荼 桥:侨 "
        "土:士 未:末 己:已 干:千于 田:由申 力:刀 王:玉 午:牛 贝:见 乌:鸟 折:拆 侯:候 间:问 今:令 风:凤 官:宫 子:孑 戍:戌 辨:辩 竹:什 楼:搂 清:请 晴:睛 海:梅 池:地 坡:披 村:忖 场:扬 门:们 车:东 马:鸟 书:丰 文:丈 古:吉 老:考 东:车 北:此 南:甫 西:酉 川:州 州:洲 江:汪 湖:潮 花:化 草:章 字:宇 家:冢 室:空 市:巾 年:午 夜:液 春:舂 秋:秌 冬:各 夏:复"
    ).split()
)
#: Misread ideograph -> all its originals; and one of them for each, to compare neighbours by.
_ORIGINALS: dict[str, str] = {}
for _true, _wrong in HAN_EDITS.items():
    for _w in _wrong:
        _ORIGINALS[_w] = _ORIGINALS.get(_w, "") + _true
_TO_TRUE = {w: t[0] for w, t in _ORIGINALS.items()}

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿŒœŸ"
_WORD = re.compile(rf"(?=[0-9{RUBBISH}]*[{_LETTERS}])[{_LETTERS}0-9{RUBBISH}]+(?:[-'’][{_LETTERS}0-9{RUBBISH}]+)*")
_CUT = re.compile(rf"([^\W\d_]+)([{MARKS}])(?:[  \t]*\r?\n|[  ])[  　]*([^\W\d_]+)")
_MARK = re.compile(rf"[{MARKS}]\s")
_SIGN = re.compile(f"[{RUBBISH}]")
_LETTER = re.compile(f"[{_LETTERS}]")
_LETTER_DIGIT = re.compile(f"[{_LETTERS}][015692]|[015692][{_LETTERS}]")
_END_CUT = re.compile(rf"([^\W\d_]+)([{MARKS}])\s*$")
_OPEN = re.compile(r"\s*([^\W\d_]+)")
_HAN = re.compile("[一-鿿]")
_HAN_WATCH = re.compile("[" + "".join(sorted(set(_TO_TRUE) | set(HAN_EDITS))) + "]")
_HAN_WRONG = re.compile("[" + "".join(sorted(_TO_TRUE)) + "]")
_SIGN_WORD = re.compile(rf"[{_LETTERS}0-9{RUBBISH}]*(?:[{_LETTERS}][{RUBBISH}]|[{RUBBISH}][{_LETTERS}])[{_LETTERS}0-9{RUBBISH}]*|[一-鿿][{RUBBISH}][一-鿿]?|[{RUBBISH}][一-鿿]")
_DIGIT_IN_WORD = re.compile(rf"[{_LETTERS}]{{2,}}[015692][{_LETTERS}]|[{_LETTERS}][015692][{_LETTERS}]{{2,}}|(?<![{_LETTERS}\d])[05][{_LETTERS}]{{3,}}|[{_LETTERS}]{{3,}}[01](?![\d{_LETTERS}])")
_SUSPENDED = {"und", "oder", "and", "or", "et", "ou", "to", "bis", "bzw"}
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_NUMBER = r"(?:(?:page|seite|s\.|p\.)\s*)?(?:第\s*)?[-·\[(（—–~*]*\s*(\d{1,5}|[ivxlcdm]{1,9})\s*[-·\])）—–~*]*(?:\s*页)?(?:\s*(?:/|of|von|de)\s*\d{1,5})?"
_WHOLE_NUMBER = re.compile(rf"\s*{_NUMBER}\s*", re.I)
_FIRST_NUMBER = re.compile(rf"\s*{_NUMBER}(?:[  　]{{2,}}|\t)", re.I)
_SPACE_NUMBER = re.compile(rf"(?<=[。！？.!?”\"»’'）)…])[ \t]{_NUMBER}\s*$", re.I)
_LAST_NUMBER = re.compile(rf"(?:[  　]{{2,}}|\t){_NUMBER}\s*$", re.I)


def clean_line(text: str) -> str:
    """A text in consistent characters, with line breaks kept and hyphen marks at line ends taken out with their halves."""
    return consistent(_CUT.sub(" ", text) if _MARK.search(text) else text) or ""


def fold(word: str) -> str:
    """A key that is equal for words that differ by single glyphs of :data:`EDITS`."""
    return word.translate(_FOLD)


def fold_wrong(word: str) -> set[str]:
    """Keys under which a word that may be misread meets its original: as it is, and with one group of glyphs read otherwise."""
    keys = {fold(word)}
    for true, wrong in _GROUPS:
        at = word.find(wrong)
        while at >= 0:
            keys.add(fold(word[:at] + true + word[at + len(wrong) :]))
            at = word.find(wrong, at + 1)
    return keys


_GROUPS = tuple((a, b) for a, b in EDITS if len(a) > 1 or len(b) > 1)
_FOLD = str.maketrans({"c": "e", "l": "i", "1": "i", "t": "f", "0": "o", "5": "s", "b": "h", "9": "g", "q": "g", "6": "e", "é": "e", "2": "z", "8": "b", "u": "n", "a": "o"})


def plausible(wrong: str, true: str, most: int = 2) -> bool:
    """Whether ``wrong`` can come from ``true`` by one or two glyph edits; texts of any length."""
    if wrong == true or abs(len(wrong) - len(true)) > most:
        return False
    # edits[i] maps an end in ``wrong`` to the fewest edits that turn the first i signs of ``true`` into what stands before it
    edits: list[dict[int, int]] = [{} for _ in range(len(true) + 1)]
    edits[0][0] = 0
    for i in range(len(true)):
        for j, n in edits[i].items():
            if j < len(wrong) and wrong[j] == true[i]:
                edits[i + 1][j + 1] = min(n, edits[i + 1].get(j + 1, most + 1))
            if n < most:
                for a, b in EDITS:
                    if true.startswith(a, i) and wrong.startswith(b, j):
                        k, m = i + len(a), j + len(b)
                        edits[k][m] = min(n + 1, edits[k].get(m, most + 1))
    return edits[len(true)].get(len(wrong), most + 1) <= most


_NOT_KEY = re.compile(rf"[^\w{RUBBISH}]|_")
_TWO_SPACES = re.compile(r"[  　]{2}|\t")
#: Accented letters to their base, misread ideographs to their originals, glyphs of one fold to one of them.
_KEY = {cp: (d[0].translate(_FOLD)) for cp in range(0xC0, 0x180) if len(d := unicodedata.normalize("NFD", chr(cp))) > 1} | {ord(k): v for k, v in _TO_TRUE.items()} | _FOLD


def place_of(word: str) -> int:
    """The place of a word among the context vectors."""
    return zlib.crc32(word.encode()) % VECTORS


class Counts:
    """Counts of a partition: ideographs with one neighbour by name, and for words and ideographs how often each context stood beside them."""

    FULL = 16_000

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.sides: Counter[str] = Counter()
        self.names: list[str] = []
        self.number: dict[str, int] = {}
        self.sign = np.full(0x110000, -1, dtype=np.int64)
        self.place = np.zeros(0, dtype=np.int64)
        self.times = np.zeros(0, dtype=np.int64)
        self.around = np.zeros((0, VECTORS), dtype=np.int32)

    def _new(self, word: str) -> int:
        self.names.append(word)
        return len(self.names) - 1

    def _signs(self, text: str) -> np.ndarray:
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        out = self.sign[cps]
        if (out < 0).any():
            for cp in np.unique(cps[out < 0]).tolist():
                self.sign[cp] = self._new(chr(cp))
            out = self.sign[cps]
        return out

    def add(self, texts: list[str]) -> None:
        ids: list[np.ndarray] = []
        gap = np.array([-1, -1], dtype=np.int64)
        for text in texts:
            text = clean_line(text)
            if _HAN.search(text):
                flat = re.sub(r"\d+", "#", text.replace("\r", "").replace("\n", ""))
                framed, as_true = f"^{flat}$", _TO_TRUE.get
                watched = [m.start() for m in _HAN_WATCH.finditer(flat)]
                self.sides.update(["L" + as_true(p := framed[i], p) + flat[i] for i in watched])
                self.sides.update(["R" + flat[i] + as_true(p := framed[i + 2], p) for i in watched])
                ids += (self._signs(flat), gap)
                if not _LETTER.search(text):
                    continue
            if found := _WORD.findall(text.lower()):
                number = self.number
                for w in found:
                    if w not in number:
                        number[w] = self._new(w)
                ids += (np.array([number[w] for w in found], dtype=np.int64), gap)
        if not ids:
            return
        line = np.concatenate(ids)
        n = len(self.names)
        self.place = np.concatenate((self.place, np.array([place_of(w) for w in self.names[len(self.place) :]], dtype=np.int64)))
        self.times = np.concatenate((self.times, np.zeros(n - len(self.times), np.int64))) + np.bincount(line[line >= 0], minlength=n)
        if n > len(self.around):
            grown = np.zeros((n + n // 4, VECTORS), np.int32)
            grown[: len(self.around)] = self.around
            self.around = grown
        for step in (1, 2):
            a, b = line[:-step], line[step:]
            ok = (a >= 0) & (b >= 0)
            a, b = a[ok], b[ok]
            for x, y in ((a, b), (b, a)):
                codes, times = np.unique(x * VECTORS + self.place[y], return_counts=True)
                self.around.reshape(-1)[codes] += times.astype(np.int32)

    def full(self) -> bool:
        return len(self.names) > self.FULL or len(self.sides) > 500_000

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(word, n, places, times): contexts as two packed arrays; then everything is forgotten."""
        words: list[str] = list(self.sides)
        n: list[int] = list(self.sides.values())
        places: list[bytes | None] = [None] * len(words)
        times: list[bytes | None] = [None] * len(words)
        for i in np.flatnonzero(self.times):
            at = np.flatnonzero(self.around[i])
            words.append(self.names[i])
            n.append(int(self.times[i]))
            places.append(at.astype(np.uint16).tobytes())
            times.append(self.around[i][at].astype(np.uint32).tobytes())
        self.clear()
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64()), pa.array(places, pa.binary()), pa.array(times, pa.binary())], names=["word", "n", "places", "times"])


_COUNT_SCHEMA = "word string, n bigint, places binary, times binary"


def _unpack(places: bytes | None, times: bytes | None, into: np.ndarray) -> None:
    if places:
        into[np.frombuffer(places, np.uint16)] += np.frombuffer(times, np.uint32)


def _merge(parts: DataFrame, *keys: str) -> DataFrame:
    """Counts of equal words summed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for word, n, packed in zip(frame["word"], frame["n"], frame["packed"]):
                packed = [x for x in packed if x["places"]]
                places, times = (packed[0]["places"], packed[0]["times"]) if packed else (None, None)
                if len(packed) > 1:
                    total = np.zeros(VECTORS, dtype=np.int64)
                    for x in packed:
                        _unpack(x["places"], x["times"], total)
                    at = np.flatnonzero(total)
                    places, times = at.astype(np.uint16).tobytes(), np.minimum(total[at], 2**32 - 1).astype(np.uint32).tobytes()
                out.append((word, n, places, times))
            yield pd.DataFrame(out, columns=["word", "n", "places", "times"])

    return parts.groupBy("word", *keys).agg(F.sum("n").alias("n"), F.collect_list(F.struct("places", "times")).alias("packed")).select("word", "n", "packed").mapInPandas(run, _COUNT_SCHEMA)


def count_noise(elements: DataFrame) -> DataFrame:
    """Summed counts over all elements: (word, n, places, times), of ideographs with a neighbour without contexts.

    A word's partial counts of very many partitions are merged in two steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counts()
        for batch in batches:
            total.add([t for t in batch.column(0).to_pylist() if t])
            if total.full():  # memory only: summed again after the shuffle
                yield from total.rows()
        yield from total.rows()

    texts = elements.where("text is not null and type <> 'formula'").select("text")
    parts = texts.mapInArrow(run, _COUNT_SCHEMA)
    salts = -(-texts.rdd.getNumPartitions() // MERGED)
    if salts > 1:
        parts = _merge(parts.withColumn("salt", F.spark_partition_id() % salts), "salt")
    return _merge(parts)


def skip_gram(pairs: np.ndarray, length: int = LENGTH, rounds: int = 100, negatives: float = NEGATIVES, rate: float = 2.0, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Skip-gram vectors with negative sampling, on summed counts: gradient steps on the whole expected objective."""
    v = len(pairs)
    c = (pairs + pairs.T).astype(np.float32)
    row = c.sum(1, dtype=float)
    expected = (np.outer(row, row) * (negatives / max(1.0, row.sum()))).astype(np.float32)
    rng = np.random.default_rng(seed)
    a, b = ((rng.standard_normal((v, length)) * 0.1).astype(np.float32) for _ in "ab")
    scale = (1 / np.maximum(1, row + expected.sum(1)))[:, None].astype(np.float32)
    both = c + expected
    for _ in range(rounds):
        for x, y in ((a, b), (b, a)):
            p = x @ y.T
            np.clip(p, -30, 30, out=p)
            np.exp(np.negative(p, out=p), out=p)
            p += 1
            np.divide(both, p, out=p)  # the gradient is c - (c + expected) p
            np.clip(x + rate * ((c - p) @ y) * scale, -2.0, 2.0, out=x)
    return a, b


def contexts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Context vectors and how often each context occurs; at most VECTORS rows of VECTORS counts come to the driver."""

    def by_place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros((VECTORS, VECTORS), dtype=np.int64)
        for frame in frames:
            for word, places, times in zip(frame["word"], frame["places"], frame["times"]):
                _unpack(places, times, m[place_of(word)])
        out = []
        for i in np.flatnonzero(m.any(axis=1)):
            at = np.flatnonzero(m[i])
            out.append((str(i), int(m[i].sum()), at.astype(np.uint16).tobytes(), np.minimum(m[i][at], 2**32 - 1).astype(np.uint32).tobytes()))
        yield pd.DataFrame(out, columns=["word", "n", "places", "times"])

    m = np.zeros((VECTORS, VECTORS), dtype=np.int64)
    for r in _merge(counts.where("places is not null").mapInPandas(by_place, _COUNT_SCHEMA)).collect():
        _unpack(r["places"], r["times"], m[int(r["word"])])
    return skip_gram(m)[1], m.sum(0).astype(float)


def solve(around: np.ndarray, b: np.ndarray, often: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Vectors of words from their contexts' counts (rows): the skip-gram objective with the context vectors held, by Newton's steps."""
    expected = NEGATIVES * around.sum(1, keepdims=True) * (often / max(1.0, often.sum()))[None]
    b = b.astype(float)
    outer = (b[:, :, None] * b[:, None, :]).reshape(len(b), -1)
    x = np.zeros((len(around), b.shape[1]))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b.T, -30, 30)))
        grad = (around * (1 - p) - expected * p) @ b - RIDGE * x
        curve = (((around + expected) * p * (1 - p)) @ outer).reshape(len(x), b.shape[1], -1) + RIDGE * np.eye(b.shape[1])
        step = np.linalg.solve(curve, grad[:, :, None])[:, :, 0]
        x += step * np.minimum(1.0, 2.0 / np.maximum(1e-9, np.linalg.norm(step, axis=1)))[:, None]
    return x


def word_vectors(counts: DataFrame, words: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(word, vector) of the words named, each trained on its own contexts where its counts are."""
    b, often = model

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                around = np.zeros((len(part), VECTORS))
                for i, (places, times) in enumerate(zip(part["places"], part["times"])):
                    _unpack(places, times, around[i])
                yield pd.DataFrame({"word": part["word"].to_numpy(), "vector": list(solve(around, b, often).astype(np.float32))})

    rows = counts.where("places is not null").join(words.select("word").distinct(), "word", "left_semi").select("word", "places", "times")
    return rows.mapInPandas(run, "word string, vector array<float>")


def links(counts: DataFrame) -> DataFrame:
    """(wrong, true, n_wrong, n_true): rare words and the frequent words they may be misread from.

    Words meet by a shared key - the folded glyphs, or the word with one place
    left open where the rare one has a rubbish sign - never all with all.
    """
    words = counts.select("word", "n")

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for w, n in frame.itertuples(index=False, name=None):
                if len(w) == 3 and w[0] in "LR" and w[0].isupper():  # an ideograph with its left or right neighbour
                    at = 2 if w[0] == "L" else 1
                    c = w[at]
                    out.extend(("h:" + w[:at] + true + w[at + 1 :], w, n, "wrong") for true in _ORIGINALS.get(c, ""))
                    if c in HAN_EDITS and n >= LEAST:
                        out.append(("h:" + w, w, n, "true"))
                    continue
                signs = sum(c in RUBBISH for c in w)
                if signs == 1 and len(w) > 2:
                    out.append(("w:" + re.sub(f"[{RUBBISH}]", "?", w), w, n, "wrong"))
                elif not signs and len(w) > 2:
                    out.extend(("g:" + k, w, n, "wrong") for k in fold_wrong(w))
                    if n >= LEAST and not any(c.isdigit() for c in w):
                        out.append(("g:" + fold(w), w, n, "true"))
                        out.extend(("w:" + w[:i] + "?" + w[i + 1 :], w, n, "true") for i in range(len(w)))
            yield pd.DataFrame(out, columns=["key", "word", "n", "role"])

    keyed = words.mapInPandas(keys, "key string, word string, n bigint, role string")
    wrong = keyed.where("role = 'wrong'").select("key", F.col("word").alias("wrong"), F.col("n").alias("n_wrong"))
    true = keyed.where("role = 'true'").select("key", F.col("word").alias("true"), F.col("n").alias("n_true"))
    joined = wrong.join(true, "key").where((F.col("wrong") != F.col("true")) & (F.col("n_true") >= RATIO * F.col("n_wrong")))

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [k[0] != "g" or plausible(w, t) for k, w, t in zip(frame["key"], frame["wrong"], frame["true"])]
            yield frame.loc[keep, ["wrong", "true", "n_wrong", "n_true"]]

    return joined.mapInPandas(check, "wrong string, true string, n_wrong bigint, n_true bigint").distinct()


def good_words(counts: DataFrame, linked: DataFrame) -> DataFrame:
    """(word): all words that occur LEAST times and are linked to no other."""
    return counts.where(f"n >= {LEAST}").join(linked.select(F.col("wrong").alias("word")).distinct(), "word", "left_anti").select("word", "n")


def told(good: DataFrame) -> frozenset[str]:
    """The KNOWN most frequent good words, and as many ideographs with a neighbour: their occurrences need no event."""
    pair = F.col("word").rlike("^[LR]..$")
    watched = F.col("word").rlike(f"^L.[{''.join(sorted(_TO_TRUE))}]$|^R[{''.join(sorted(_TO_TRUE))}].$")
    top = good.where(~pair).orderBy(F.desc("n"), "word").limit(KNOWN).unionByName(good.where(pair & watched).orderBy(F.desc("n"), "word").limit(KNOWN))
    return frozenset(r["word"] for r in top.select("word").collect())


def roman(text: str) -> int | None:
    """The value of a roman number in lower case, if it is one."""
    total, before = 0, 0
    for c in reversed(text):
        n = _ROMAN.get(c)
        if n is None:
            return None
        total += n if n >= before else -n
        before = max(before, n)
    return total


def number_value(m: re.Match[str] | None) -> int | None:
    if not m:
        return None
    s = m.group(1).lower()
    return int(s) if s.isdigit() else roman(s)


@lru_cache(maxsize=20_000)
def head_key(line: str) -> str:
    """What stays the same of a repeated head: without its page number, case, accents, spaces, marks and misread glyphs."""
    line = consistent(line) or ""
    line = _LAST_NUMBER.sub("", _FIRST_NUMBER.sub("", line, count=1)) if _TWO_SPACES.search(line) else line
    return _NOT_KEY.sub("", line.lower()).translate(_KEY)


def damage(size: int) -> int:
    """How many signs of a head of so many may differ."""
    return max(1, min(3, size // 6)) if size >= 4 else 0


def pieces_of(size: int) -> list[tuple[int, int]]:
    """Where the pieces of a head of so many signs begin and end: one more than signs may differ, so that one is whole."""
    n = damage(size) + 1
    ends = [size * i // n for i in range(n + 1)]
    return list(zip(ends, ends[1:]))


def _near(a: str, b: str, most: int) -> bool:
    """Whether two keys are at most so many edits apart."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


class Shapes:
    """Where pieces of one book's heads can stand at the beginning of a text, from the heads' lengths.

    Of a head with at most d damaged signs one of d + 1 pieces is whole and stands
    at most d signs from its place; texts without such a piece are done at once.
    """

    def __init__(self, sizes: set[int]):
        self.sizes = sizes
        self.by_size = {n: {(lo, hi, lo + shift) for lo, hi in pieces_of(n) for shift in range(-damage(n), damage(n) + 1) if lo + shift >= 0} for n in sizes}
        self.shapes = {(at, hi - lo) for places in self.by_size.values() for lo, hi, at in places}
        self.start = re.compile(rf"(?:[^\w{RUBBISH}]*[\w{RUBBISH}]){{0,{max(sizes, default=0) + 20}}}\S*\s*")

    def ends(self, text: str, begin: str) -> Iterator[tuple[str, int]]:
        """What stands before each white space that a new sentence follows, as a key, and where that white space ends."""
        for m in re.finditer(r"\s+", begin):
            rest = text[m.end() : m.end() + 1]
            if rest and not (rest.islower() and "\n" not in m.group(0)):
                yield head_key(begin[: m.start()]), m.end()

    def asked(self, text: str, book: str, known: bytes) -> set[tuple[int, int, str, str, int]]:
        """(size, lo, piece, own, end): beginnings of the text with a piece that a head of the book may have there, as the filter knows."""
        begin, seed, mask = self.start.match(text).group(0), zlib.crc32(book.encode()), len(known) * 8 - 1

        def has(piece: str) -> bool:
            x, y = _bits(piece, seed, mask)
            return bool(known[x >> 3] >> (x & 7) & 1 and known[y >> 3] >> (y & 7) & 1)

        whole = head_key(begin)
        if not any(has(whole[at : at + size]) for at, size in self.shapes if at + size <= len(whole)):
            return set()
        out = set()
        for own, end in self.ends(text, begin):
            for n in range(max(0, len(own) - 3), len(own) + 4):  # damage() is 3 at most
                if n in self.sizes and abs(n - len(own)) <= damage(n):
                    out.update((n, lo, own[at : at + hi - lo], own, end) for lo, hi, at in self.by_size[n] if at + hi - lo <= len(own) and has(own[at : at + hi - lo]))
        return out


def _bits(piece: str, seed: int, mask: int) -> tuple[int, int]:
    """The two bits of a piece of a head in the filter."""
    h = zlib.crc32(piece.encode(), seed)
    return h & mask, (h * 0x9E3779B1 >> 32) & mask


class Heads(Shapes):
    """The heads of one book, found at the beginning of texts."""

    def __init__(self, keys: list[str]):
        super().__init__({len(key) for key in keys})
        self.pieces: dict[str, set[tuple[int, str]]] = {}
        for key in keys:
            for lo, hi in pieces_of(len(key)):
                self.pieces.setdefault(key[lo:hi], set()).add((lo, key))

    def find(self, text: str) -> tuple[str, int] | None:
        """The longest head the text begins with, and where it ends: at white space before a new sentence, small damage allowed."""
        begin = self.start.match(text).group(0)
        whole = head_key(begin)
        near = {key for lo, size in self.shapes for at, key in self.pieces.get(whole[lo : lo + size], ()) if abs(at - lo) <= damage(len(key))}
        if not near:
            return None
        best: tuple[str, int] | None = None
        for own, end in self.ends(text, begin):
            for key in near:
                if (best is None or len(key) > len(best[0])) and (own == key or _near(own, key, damage(len(key)))):
                    best = key, end
        return best


def is_cut(a: str, mark: str, b: str, newline: bool, good: frozenset[str]) -> bool:
    """Whether a hyphen-like mark between two halves at a line end divides one word."""
    a, b = (consistent(x) or "" for x in (a, b))
    low, next_ = a.lower(), b.lower()
    if not b or not a or _HAN.search(a + b):
        return False
    if next_ in _SUSPENDED and (low + next_) not in good:
        return False
    if (low + next_) in good:
        return f"{low}-{next_}" not in good
    if f"{low}-{next_}" in good:
        return False
    if mark in "¬­":
        return True
    if not b[0].islower():
        return False
    if low in good and next_ in good and len(low) > 2 and len(next_) > 2:
        return False
    return True


_EVENT = pa.schema([
    ("elem_id", pa.int64()), ("book_id", pa.string()), ("page_index", pa.int32()), ("list_pos", pa.int32()), ("event", pa.string()), ("word", pa.string()), ("left", pa.string()), ("right", pa.string()), ("number", pa.int64()),
])
EVENT_SCHEMA = "elem_id bigint, book_id string, page_index int, list_pos int, event string, word string, left string, right string, number bigint"
BODY = frozenset({"text"})
_SPACE = re.compile(r"\s")
_MARK_SET = frozenset(MARKS)


def _compound_tail(text: str, at: int) -> str:
    """Letters and hyphens right before a position: the whole word of which the cut takes the last part."""
    k = at
    while k > 0 and (text[k - 1].isalpha() or text[k - 1] == "-"):
        k -= 1
    return text[k:at]


def edge_of(top: float | None, bottom: float | None) -> str:
    return "top" if bottom is not None and bottom < TOP else "bottom" if top is not None and top > BOTTOM else ""


def scan_element(text: str, kind: str, top: float | None, bottom: float | None, good: frozenset[str]) -> list[tuple]:
    """Events (event, word, left, right, number) of one element; top and bottom are its edges as shares of the page's height."""
    out: list[tuple] = []
    edge = edge_of(top, bottom)
    lines = text.replace("\r", "").split("\n")
    first, last = lines[0], lines[-1]
    if kind != "formula":
        for m in _CUT.finditer(text) if _MARK.search(text) else ():
            if not _HAN.search(m.group(1) + m.group(3)):
                out.append(("cut", consistent(m.group(1)), m.group(2), consistent(m.group(3)), int("\n" in m.group(0))))
        if text.rstrip()[-1:] in _MARK_SET and (m := _END_CUT.search(text)) and not _HAN.search(m.group(1)) and kind in BODY:
            out.append(("end", consistent(m.group(1)), m.group(2), None, None))
        if kind in BODY and (m := _OPEN.match(text)) and m.group(1)[0].islower() and not _HAN.search(m.group(1)):
            out.append(("open", consistent(m.group(1)), None, None, None))
        line = clean_line(text)
        if _SIGN.search(line):
            out.extend(("sign", w, None, None, None) for w in {m.group(0).lower() for m in _SIGN_WORD.finditer(line)})
        if _LETTER_DIGIT.search(line):
            out.extend(("sign", w, None, None, None) for w in {m.group(0).lower() for m in _WORD.finditer(line) if any(len(_LETTER.findall(x.group(0))) >= 3 for x in _DIGIT_IN_WORD.finditer(m.group(0)))})
        if _HAN.search(line) and _HAN_WRONG.search(line):
            flat = re.sub(r"\d+", "#", line.replace("\r", "").replace("\n", ""))
            framed, as_true = f"^{flat}$", _TO_TRUE.get  # two misread ideographs side by side still have a known context
            seen: set[tuple] = set()
            for m in _HAN_WRONG.finditer(flat):
                i = m.start()
                ends = (as_true(p := framed[i], p), as_true(p := framed[i + 2], p))
                left, right = f"L{ends[0]}{flat[i]}", f"R{flat[i]}{ends[1]}"
                if left not in good and right not in good and (left, right) not in seen:
                    seen.add((left, right))
                    out.append(("han", left, right, " ".join(flat[max(0, i - 2) : i] + flat[i + 1 : i + 3]), None))
        words = _WORD.findall(line.lower()) if _LETTER.search(line) else []
        for i, w in enumerate(words) if not good.issuperset(words) else ():
            if w not in good and len(w) > 2:
                out.append(("word", w, " ".join(words[max(0, i - 2) : i]), " ".join(words[i + 1 : i + 3]), None))
    if kind == "number" and (edge or _WHOLE_NUMBER.fullmatch(consistent(text) or "")):
        out.append(("number", "edge" if edge else "inside", None, None, number_value(_WHOLE_NUMBER.fullmatch(consistent(text) or ""))))
    elif kind != "formula" and kind != "table" and kind != "number":
        plain_first, tail = consistent(first) or "", consistent(last) or ""
        many = len(lines) > 1
        for m in (
            _WHOLE_NUMBER.fullmatch(plain_first) if many or edge else None, _WHOLE_NUMBER.fullmatch(tail) if many else None,
            _FIRST_NUMBER.match(plain_first) if _TWO_SPACES.search(plain_first) else None, _LAST_NUMBER.search(plain_first) if _TWO_SPACES.search(plain_first) else None,
            _LAST_NUMBER.search(tail) if _TWO_SPACES.search(tail) else None, _SPACE_NUMBER.search(tail),
        ):
            if (n := number_value(m)) is not None and n < 2**62:
                out.append(("number", "edge" if edge and len(lines) == 1 and _WHOLE_NUMBER.fullmatch(plain_first) else "inside", None, None, n))
    if edge and kind not in ("table", "formula", "image"):
        key = head_key(first)
        if len(key) >= 2 and not _WHOLE_NUMBER.fullmatch(consistent(first) or ""):
            out.append(("head", key, None, None, None))
    return out


def heights(elements: DataFrame, pages: DataFrame | None) -> DataFrame:
    """(book_id, height): the pages' height of each book, from the pages or, where they have none, from the lowest box."""
    low = elements.groupBy("book_id").agg(F.max("bbox.y2").alias("lowest"))
    if pages is None:
        return low.select("book_id", (F.col("lowest") / 0.96).alias("height"))
    known = pages.where("height > 0").groupBy("book_id").agg(F.max("height").alias("known"))
    return low.join(known, "book_id", "left").select("book_id", F.when(F.col("known") >= F.col("lowest"), F.col("known")).otherwise(F.col("lowest") / 0.96).alias("height"))


def placed(elements: DataFrame, page_heights: DataFrame) -> DataFrame:
    """Elements with text and their upper and lower edge as shares of the page's height."""
    e = elements.where("text is not null").select("elem_id", "book_id", "page_index", "list_pos", "type", "text", F.col("bbox.y1").alias("y1"), F.col("bbox.y2").alias("y2"))
    h = page_heights.withColumnRenamed("book_id", "b")
    if h.count() <= BROADCAST_BOOKS:  # known to be small; more books are joined by a shuffle
        h = F.broadcast(h)
    return e.join(h, e.book_id == h.b, "left").select("elem_id", "book_id", "page_index", "list_pos", "type", "text", (F.col("y1") / F.col("height")).alias("top"), (F.col("y2") / F.col("height")).alias("bottom"))


def scan(rows: DataFrame, good: frozenset[str]) -> DataFrame:
    """Events of all elements: rows of :data:`EVENT_SCHEMA`; ``rows`` as :func:`placed` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for elem, book, page, pos, kind, text, top, bottom in zip(*(c.to_pylist() for c in batch.columns)):
                for event in scan_element(text, kind or "", top, bottom, good):
                    out.append((elem, book, page, pos, *event))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(list(zip(*out)) or [()] * len(_EVENT), _EVENT)], schema=_EVENT)

    return rows.mapInArrow(run, EVENT_SCHEMA)


def link_vectors(linked: DataFrame, counts: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Links with the vector of the original; that of an ideograph with a neighbour is the ideograph's own."""
    own = F.when(F.col("true").rlike("^L..$"), F.substring("true", 3, 1)).when(F.col("true").rlike("^R..$"), F.substring("true", 2, 1)).otherwise(F.col("true"))
    rows = linked.withColumn("word", own)
    return rows.join(word_vectors(counts, rows, model), "word").select("wrong", "true", "n_wrong", "n_true", "vector")


def corrections(events: DataFrame, linked: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(elem_id, wrong, true): each suspicious occurrence and the linked word that its neighbours favour.

    Of an original's vector and the context vectors of the neighbours skip-gram
    gives the logarithm of how much more often they meet than by chance, less
    that of the negatives. A link is taken where its mean over the neighbours
    is above chance; of several the one with the highest. Without neighbours
    the counts alone have decided. A word with a sign that belongs to no word,
    or a figure, is wrong in any case; ``true`` is null where no link is taken.
    """
    b, _ = model

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            around = np.zeros((len(frame), b.shape[1]))
            for i, near in enumerate(frame["near"]):
                if at := [place_of(w) for w in near.split()]:
                    around[i] = b[at].mean(0)
            vectors = np.stack(frame["vector"].to_list()) if len(frame) else around
            frame["score"] = (vectors * around).sum(1) + np.log(NEGATIVES)
            yield frame.loc[frame["score"] > 0, ["elem_id", "wrong", "true", "score"]]

    out = "elem_id bigint, wrong string, true string, score double"
    words = events.where("event = 'word'").select("elem_id", "word", F.concat_ws(" ", "left", "right").alias("near")).distinct()
    met = words.join(linked, words.word == linked.wrong).select("elem_id", "wrong", "true", "near", "vector")
    scored = met.mapInPandas(score, out)
    han = events.where("event = 'han'").select("elem_id", F.col("word").alias("l"), F.col("left").alias("r"), F.col("right").alias("near")).distinct()
    one = linked.select(F.col("wrong").alias("l"), F.col("true").alias("true_l"), "vector")
    two = linked.select(F.col("wrong").alias("r"), F.col("true").alias("true_r"))
    both = han.join(one, "l").join(two, "r").where(F.substring("true_l", 3, 1) == F.substring("true_r", 2, 1))
    both = both.select("elem_id", F.concat("l", F.substring("r", 3, 1)).alias("wrong"), F.concat("true_l", F.substring("true_r", 3, 1)).alias("true"), "near", "vector")
    signs = events.where("event = 'sign'").select("elem_id", F.col("word").alias("wrong"), F.lit(None).cast("string").alias("true"), F.lit(float("-inf")).alias("score"))
    found = scored.unionByName(both.mapInPandas(score, out)).unionByName(signs)
    return found.groupBy("elem_id", "wrong").agg(F.max_by("true", F.struct("score", "true")).alias("true"))


def decided(candidates: DataFrame, good: DataFrame) -> DataFrame:
    """The candidates (half, mark, rest, newline and others) that divide one word; the words they could be are looked up in all good words."""
    what = ["half", "mark", "rest", "newline"]
    forms = F.array(F.concat(F.lower("half"), F.lower("rest")), F.concat(F.lower("half"), F.lit("-"), F.lower("rest")), F.lower("half"), F.lower("rest"))
    asked = candidates.select(*what).distinct().withColumn("word", F.explode(forms))
    known = asked.join(good.select("word", F.col("word").alias("is")), "word", "left").groupBy(*what).agg(F.collect_set("is").alias("known"))

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [is_cut(h, m, r, bool(n), frozenset(k)) for h, m, r, n, k in zip(*(frame[c] for c in (*what, "known")))]
            yield frame.loc[keep, what]

    return candidates.join(known.mapInPandas(check, "half string, mark string, rest string, newline bigint"), what, "left_semi")


def cuts(events: DataFrame, good: DataFrame) -> DataFrame:
    """(elem_id, half, rest): words cut at a line end inside an element."""
    found = events.where("event = 'cut'").select("elem_id", F.col("word").alias("half"), F.col("left").alias("mark"), F.col("right").alias("rest"), F.col("number").alias("newline")).distinct()
    return decided(found, good).select("elem_id", "half", "rest").distinct()


def next_open(ends: DataFrame, opens: DataFrame) -> DataFrame:
    """(elem_id, half, mark, newline, x): each end with the first of its book's openings on a later page.

    All pages after one lie in at most 32 aligned blocks of 1, 2, 4 ... pages,
    each the right half of a larger one; ends meet the first opening of each
    block by an equi-join, never all openings of the book.
    """
    blocks = "explode(filter(transform(sequence(0, 31), k -> struct(k as k, shiftright({0} + 2147483648L, k) + {1} as at)), s -> s.at % 2 = 1)) as s"
    first = opens.where("p is not null").groupBy("b", "p").agg(F.min(F.struct("l", "next_id", "rest")).alias("x")).selectExpr("b", "struct(p, x.l, x.next_id, x.rest) as x", blocks.format("p", 0))
    first = first.groupBy("b", "s.k", "s.at").agg(F.min("x").alias("x"))
    asked = ends.selectExpr("elem_id", "half", "mark", "newline", "book_id as b", "page_index", blocks.format("page_index", 1)).select("*", "s.k", "s.at")
    met = asked.join(first, ["b", "k", "at"])
    return met.groupBy("elem_id", "half", "mark", "newline").agg(F.min(F.struct((F.col("x.p").cast("bigint") - F.col("page_index")).alias("step"), "x.l", "x.next_id", "x.rest")).alias("x"))


def divided(events: DataFrame, good: DataFrame) -> DataFrame:
    """(elem_id, next_id, word): words cut at an element's end and the element that begins with the rest.

    The rest is looked for on the same page below and on the next three pages.
    Where no text opens with a small letter there, the book's next text that
    does is asked, however far it is.
    """
    ends = events.where("event = 'end'").select("elem_id", "book_id", "page_index", "list_pos", F.col("word").alias("half"), F.col("left").alias("mark"), F.lit(1).cast("bigint").alias("newline")).distinct()
    opens = events.where("event = 'open'").select(F.col("elem_id").alias("next_id"), F.col("book_id").alias("b"), F.col("page_index").alias("p"), F.col("list_pos").alias("l"), F.col("word").alias("rest")).distinct()
    reach = ends.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("at", F.col("page_index") + F.col("step"))
    met = reach.join(opens, (F.col("book_id") == F.col("b")) & (F.col("at") == F.col("p")) & ((F.col("step") > 0) | (F.col("l") > F.col("list_pos"))))
    met = cut(met.select("elem_id", "next_id", "step", "l", "half", "mark", "rest", "newline"))
    far = next_open(ends.join(met.select("elem_id").distinct(), "elem_id", "left_anti"), opens)
    met = met.unionByName(far.select("elem_id", "x.next_id", "x.step", "x.l", "half", "mark", "x.rest", "newline"))
    return decided(met, good).groupBy("elem_id").agg(F.min_by(F.struct("next_id", "half", "rest"), F.struct("step", "l", "next_id")).alias("x")).select("elem_id", "x.next_id", F.concat("x.half", "x.rest").alias("word"))


def edge_heads(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elem_id) of lines at the edge that repeat at the edge of at least HEAD_PAGES pages of the book, and (book_id, key) of such heads.

    Lines are counted by key. Keys of too few pages may be damaged copies: they
    meet others of their book by half of their signs, from the start or the
    end, and count together where few signs differ.
    """
    edge = events.where("event = 'head'").select("elem_id", "book_id", "page_index", F.col("word").alias("key")).distinct()
    keys = edge.groupBy("book_id", "key").agg(F.count_distinct("page_index").alias("pages"))
    weak = keys.where(F.col("pages") < HEAD_PAGES)

    def halves(df: DataFrame) -> DataFrame:
        n = F.length("key")
        sizes = F.array_distinct(F.array(F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")))
        pieces = F.concat(F.transform(sizes, lambda k: F.concat(F.lit("<"), F.substring(F.col("key"), F.lit(1), k))), F.transform(sizes, lambda k: F.concat(F.lit(">"), F.substring(F.col("key"), n - k + 1, k))))
        return df.where(n >= 4).select("book_id", "key", F.explode(pieces).alias("piece"))

    x, y = halves(weak).alias("x"), halves(keys).alias("y")
    near = x.join(y, (F.col("x.book_id") == F.col("y.book_id")) & (F.col("x.piece") == F.col("y.piece")) & (F.col("x.key") != F.col("y.key"))).select("x.book_id", F.col("x.key").alias("key"), F.col("y.key").alias("other")).distinct()
    near = near.where(F.levenshtein("key", "other") <= F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.length("key") / 6).cast("int"))))
    both = near.join(keys.select("book_id", F.col("key").alias("other"), F.col("pages").alias("more")), ["book_id", "other"]).groupBy("book_id", "key").agg(F.sum("more").alias("more"))
    rescued = weak.join(both, ["book_id", "key"]).where(F.col("pages") + F.col("more") >= HEAD_PAGES).select("book_id", "key")
    strong = cut(keys.where(F.col("pages") >= HEAD_PAGES).select("book_id", "key").union(rescued))
    return edge.join(strong, ["book_id", "key"], "left_semi").select("elem_id").distinct(), strong


#: Most characters of heads that are broadcast; more are joined by a shuffle.
BROADCAST_HEADS = 16_000_000
#: Most characters of one book's heads that go with its texts; of a book with more, the beginnings that may be heads go to the heads.
CARRIED = 2000
#: Most bits of the filter over pieces of such books' heads (it only saves rows of the join that decides).
FILTER_BITS = 1 << 27


def head_filter(large: DataFrame, n: int) -> tuple[DataFrame, bytes]:
    """Pieces (book_id, size, lo, piece, key) of the ``n`` heads, and the filter of (book_id, piece)."""
    bits = min(FILTER_BITS, 1 << max(15, (256 * n).bit_length()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for book, key in zip(frame["book_id"], frame["key"]):
                seed = zlib.crc32(book.encode())
                out.extend((book, len(key), lo, key[lo:hi], key, list(_bits(key[lo:hi], seed, bits - 1))) for lo, hi in pieces_of(len(key)))
            yield pd.DataFrame(out, columns=["book_id", "size", "lo", "piece", "key", "at"])

    pieces = cut(large.mapInPandas(run, "book_id string, size int, lo int, piece string, key string, at array<bigint>"))
    parts = pieces.select(F.explode("at").alias("at")).groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    known = bytearray(bits // 8)
    for r in parts.collect():
        known[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    return pieces.drop("at"), bytes(known)


def inner_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(elem_id, end): texts away from the page edge that begin with one of their book's heads, and where that ends.

    ``rows`` as :func:`placed` gives them. The texts stay where they are read;
    the heads of each book come to them. The heads of a book grow with it, and
    texts times heads with its square; so to the texts of a book with many
    heads come only their lengths and a filter of their pieces, and the few
    beginnings that pass it meet the heads by an equi-join.
    """
    large = cut(heads.groupBy("book_id").agg(F.count("*").alias("n"), F.sum(F.length("key")).alias("signs"), F.collect_set(F.length("key")).alias("sizes")))
    many = F.col("signs") > CARRIED
    size, n = large.agg(F.sum(F.when(many, 8 * F.size("sizes")).otherwise(F.col("signs"))), F.sum(F.when(many, F.col("n")))).first()
    few = heads.join(large.where(~many).select("book_id"), "book_id", "left_semi").groupBy("book_id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    by_book = few.withColumn("sizes", F.lit(None).cast("array<int>"))
    known = b""
    if n:
        by_book = by_book.unionByName(large.where(many).select("book_id", F.lit(None).cast("array<string>").alias("keys"), "sizes"))
        pieces, known = head_filter(heads.join(large.where(many).select("book_id"), "book_id", "left_semi").select("book_id", "key"), n)
    by_book = cut(by_book)
    if (size or 0) <= BROADCAST_HEADS:
        by_book = F.broadcast(by_book)
    body = rows.where(~F.coalesce(F.col("type"), F.lit("")).isin("table", "formula", "image", "paragraph_title", "doc_title") & F.col("text").rlike(r"\s"))
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
    names = ["elem_id", "end", "book_id", "size", "lo", "piece", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[str, Shapes] = {}
        for batch in batches:
            out: list[tuple] = []
            book_ids = batch.column(1).to_pylist()
            for i, (elem, book, text, top, bottom) in enumerate(zip(batch.column(0).to_pylist(), book_ids, *(batch.column(k).to_pylist() for k in (2, 3, 4)))):
                if edge_of(top, bottom):
                    continue
                if book not in books:
                    if len(books) > 2000:
                        books.clear()
                    keys = batch.column(5)[i].as_py()
                    books[book] = Heads(keys) if keys is not None else Shapes(set(batch.column(6)[i].as_py()))
                at = len(text) - len(text.lstrip())
                first, newline, _ = text[at:].partition("\n")
                if newline and _WHOLE_NUMBER.fullmatch(consistent(first.rstrip("\r")) or ""):
                    at += len(first) + 1
                if not isinstance(here := books[book], Heads):
                    out.extend((elem, at + end, book, n, lo, piece, own) for n, lo, piece, own, end in here.asked(text[at:], book, known))
                elif found := here.find(text[at:]):
                    out.append((elem, at + found[1], None, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names=names)

    seen = body.join(by_book, "book_id").select("elem_id", "book_id", "text", "top", "bottom", "keys", "sizes")
    seen = seen.mapInArrow(run, "elem_id bigint, end int, book_id string, size int, lo int, piece string, own string")
    if not n:
        return seen.select("elem_id", "end")
    seen = cut(seen)

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [own == key or _near(own, key, damage(len(key))) for own, key in zip(frame["own"], frame["key"])]
            yield frame.loc[keep, ["elem_id", "size", "end"]]

    met = seen.where(F.col("piece").isNotNull()).join(pieces, ["book_id", "size", "lo", "piece"]).select("elem_id", "size", "end", "own", "key")
    longest = met.mapInPandas(check, "elem_id bigint, size int, end int").groupBy("elem_id").agg(F.max_by("end", F.struct("size", -F.col("end"))).alias("end"))
    return seen.where(F.col("piece").isNull()).select("elem_id", "end").unionByName(longest)


def page_numbers(events: DataFrame) -> DataFrame:
    """elem_id of elements that are, or begin or end with, their page's printed number.

    A book's printed numbers run beside its page indexes at the distance most
    of its numbers at the edge have.
    """
    found = events.where("event = 'number'").select("elem_id", "book_id", "page_index", F.col("word").alias("place"), "number").distinct()
    votes = found.where("place = 'edge' and number is not null").groupBy("book_id", (F.col("number") - F.col("page_index")).alias("gap")).count()
    gaps = votes.groupBy("book_id").agg(F.max_by("gap", F.struct("count", -F.abs("gap"))).alias("gap"))
    joined = found.join(gaps, "book_id", "left").withColumn("fits", F.col("number") == F.col("page_index") + F.coalesce("gap", F.lit(1)))
    return joined.where((F.col("place") == "edge") | F.col("fits")).select("elem_id").distinct()


@lru_cache(maxsize=20_000)
def _han_pattern(wrong: str) -> re.Pattern[str]:
    """A misread ideograph between its two neighbours; ``#`` stands for figures, ``^`` and ``$`` for the ends."""
    ends = {"#": r"\d", "^": r"^", "$": r"$"}
    before, after = (ends.get(c) or f"[{re.escape(c + HAN_EDITS.get(c, ''))}]" for c in (wrong[0], wrong[2]))
    return re.compile(rf"({before}\s*){re.escape(wrong[1])}(?=\s*{after})")


@lru_cache(maxsize=20_000)
def _word_pattern(wrong: str) -> re.Pattern[str]:
    return re.compile(rf"(?<![{_LETTERS}]){re.escape(wrong)}(?![{_LETTERS}])", re.I)


def repair(text: str, fixes: dict[str, str], head: int, number: bool, cut_words: set[tuple[str, str]]) -> str:
    """One element's text without furniture, cuts and misread words, its lines joined; the head's signs come first."""
    text = text[head:]
    if number:
        for p in (_WHOLE_NUMBER, None):
            lines = text.split("\n")
            if len(lines) > 1 and _WHOLE_NUMBER.fullmatch(consistent(lines[-1]) or ""):
                text = "\n".join(lines[:-1])
            elif len(lines) > 1 and _WHOLE_NUMBER.fullmatch(consistent(lines[0]) or ""):
                text = "\n".join(lines[1:])
        text = _LAST_NUMBER.sub("", _SPACE_NUMBER.sub("", _FIRST_NUMBER.sub("", text, count=1)))
    if _MARK.search(text):
        text = _CUT.sub(lambda m: m.group(1) + m.group(3) if (consistent(m.group(1)), consistent(m.group(3))) in cut_words else m.group(0).replace("\n", ""), text)
    text = consistent(text) or ""
    for wrong, true in fixes.items():
        if len(wrong) == 3 and _HAN.search(wrong):
            text = _han_pattern(wrong).sub(lambda m: m.group(1) + true[1], text)
        else:
            text = _word_pattern(wrong).sub(lambda m: true.capitalize() if m.group(0)[0].isupper() else true, text)
    if "\n" in text:
        text = re.sub(r"(?<=[一-鿿，。；：！？、“”])[ \t]*\r?\n[ \t]*(?=[一-鿿，。；：！？、“”])", "", text)
        text = re.sub(r"\s*\r?\n\s*", " ", text)
    return text.strip(" \u3000")


PARAGRAPH_SCHEMA = "book_id string, page_index int, list_pos int, elem_id bigint, type string, paragraph string"
#: Layout labels that hold running text.
TEXT_TYPES = ("text", "paragraph_title", "doc_title", "footnote", "reference")


class Noise:
    """The result of the passes over one elements table."""

    def __init__(self, elements: DataFrame, pages: DataFrame | None = None):
        counts = cut(count_noise(elements))
        self.elements = elements
        linked = cut(links(counts))
        self.good = cut(good_words(counts, linked))
        self.model = contexts(counts)
        self.linked = cut(link_vectors(linked, counts, self.model))
        self.rows = placed(elements, cut(heights(elements, pages)))
        self.events = cut(scan(self.rows, told(self.good)))
        self.edge, heads = edge_heads(self.events)
        self.inner = cut(inner_heads(self.rows, heads))
        self._corrections: DataFrame | None = None

    def corrections(self) -> DataFrame:
        if self._corrections is None:
            self._corrections = cut(corrections(self.events, self.linked, self.model))
        return self._corrections

    def found(self) -> DataFrame:
        """(elem_id, kind) of every noise found."""
        e = self.events
        kinds = [
            (cuts(e, self.good).select("elem_id"), "hyphenation"), (divided(e, self.good).select("elem_id"), "hyphenation"), (self.corrections().select("elem_id"), "misread"),
            (self.edge, "running_head"), (self.inner.select("elem_id"), "running_head"), (page_numbers(e), "page_number"),
        ]
        out = None
        for df, kind in kinds:
            part = df.withColumn("kind", F.lit(kind))
            out = part if out is None else out.unionByName(part)
        return out.distinct()

    def notes(self) -> DataFrame:
        """(elem_id, fixes, cut_words, end, number, gone): what the repair does with each element that has noise."""
        plain = lambda c: F.when(F.col("wrong").rlike("^L.{3}$") & F.col("true").rlike("^L"), F.substring(c, 2, 3)).otherwise(F.col(c))
        fixes = self.corrections().where(F.col("true").isNotNull()).select("elem_id", plain("wrong").alias("wrong"), plain("true").alias("true"))
        parts = [
            fixes.groupBy("elem_id", "wrong").agg(F.max("true").alias("true")).select("elem_id", F.struct("wrong", "true").alias("fix")),
            cut(cuts(self.events, self.good)).select("elem_id", F.struct("half", "rest").alias("cut_word")),
            self.inner.select("elem_id", "end"), cut(page_numbers(self.events)).withColumn("number", F.lit(True)),
            self.events.where("event = 'number' and word = 'edge'").select("elem_id", F.lit(True).alias("whole")), self.edge.withColumn("edge", F.lit(True)),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        some = lambda c: F.coalesce(F.max(c), F.lit(False))
        gone = (some("edge") | (some("number") & some("whole"))).alias("gone")
        return cut(out.groupBy("elem_id").agg(F.sort_array(F.collect_set("fix")).alias("fixes"), F.collect_set("cut_word").alias("cut_words"), F.max("end").alias("end"), some("number").alias("number"), gone))

    def paragraphs(self) -> DataFrame:
        """Rows of :data:`PARAGRAPH_SCHEMA`: repaired text per book in reading order, furniture left out.

        A word divided between two elements joins them into one paragraph, at
        the place of the first. Repeated rows of one elem_id give one paragraph.
        All small tables are written before, so that the texts are moved and
        repaired once.
        """
        e = self.elements.where("text is not null").where(F.col("type").isin(*TEXT_TYPES)).select("elem_id", "book_id", "page_index", "list_pos", "type", "text")
        notes = self.notes()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                frame["paragraph"] = [
                    repair(t, {x["wrong"]: x["true"] for x in f} if f is not None else {}, int(h), n, {(x["half"], x["rest"]) for x in c} if c is not None else set())
                    for t, h, n, f, c in zip(frame["text"], frame["end"], frame["number"], frame["fixes"], frame["cut_words"])
                ]
                yield frame[["book_id", "page_index", "list_pos", "elem_id", "type", "paragraph", "rest"]]

        def repaired(rows: DataFrame, rests: DataFrame) -> DataFrame:
            noted = rows.dropDuplicates(["elem_id"]).join(notes, "elem_id", "left").where(~F.coalesce("gone", F.lit(False))).join(rests, "elem_id", "left")
            noted = noted.where(~F.coalesce("joined", F.lit(False))).withColumns({"end": F.coalesce("end", F.lit(0)), "number": F.coalesce("number", F.lit(False))})
            return noted.select("elem_id", "book_id", "page_index", "list_pos", "type", "text", "end", "number", "fixes", "cut_words", "rest").mapInPandas(run, PARAGRAPH_SCHEMA + ", rest string").where("paragraph <> ''")

        pairs = cut(divided(self.events, self.good).groupBy("next_id").agg(F.min("elem_id").alias("elem_id")))
        roots = cut(pairs.join(pairs.select(F.col("next_id").alias("elem_id")), "elem_id", "left_anti"))
        ends = roots.select("elem_id").union(roots.select("next_id")).distinct()
        none = e.sparkSession.createDataFrame([], "elem_id bigint, rest string, joined boolean")
        texts = cut(repaired(e.join(ends, "elem_id", "left_semi"), none).select("elem_id", "paragraph"))
        met = roots.join(texts.select("elem_id"), "elem_id", "left_semi").join(texts.select(F.col("elem_id").alias("next_id"), F.col("paragraph").alias("rest")), "next_id")  # both are there
        rests = cut(met.select("elem_id", "rest", F.lit(False).alias("joined")).unionByName(met.select(F.col("next_id").alias("elem_id"), F.lit(None).cast("string").alias("rest"), F.lit(True).alias("joined"))))
        text = F.when(F.col("rest").isNull(), F.col("paragraph")).otherwise(F.concat(F.regexp_replace("paragraph", f"[{MARKS}]\\s*$", ""), F.col("rest")))
        return repaired(e, rests).select("book_id", "page_index", "list_pos", "elem_id", "type", text.alias("paragraph"))
