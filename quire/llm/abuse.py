"""Problem 9: abusive, hateful or sexual content.

Method: a bidirectional gated recurrent network with attention pooling over
character and word inputs, trained here in numpy. A text becomes a row of
units, Latin words and single ideographs; a unit's input is the embedding of
its word (for ideographs, of the pair with the one before) plus the mean
embedding of its character n-grams, so that masked and misspelt words stay
close to their originals. All overlapping windows of each whole text are
scored; a document's score is its highest window's 1 - P(none).

Training uses a bounded sample of the rated documents (:data:`LABELLED`) and
the general phrases of :mod:`quire.llm.abuse_seeds`, disguised at random and set
into texts rated ``none``. Some ratings are wrong: how many is estimated from
documents rated twice, and each rating weighs by how far the model agrees.

Defined results: null and empty texts score 0; texts of any length are scored
whole; rows with equal ids are scored each; null sources form a group of their
own; with no ratings at all the phrases alone are used.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.abuse_seeds import HARMFUL, HARMLESS, WORDS
from quire.llm.lookalike import consistent

CLASSES = ("none", "abusive", "hateful", "sexual")
#: Most documents rated otherwise than ``none``, and rated ``none`` only, used in training, with their whole texts. Scoring knows no such bound.
LABELLED, LABELLED_NONE = 600, 2000
WINDOW, STRIDE = 48, 28
BUCKETS, DIM, HIDDEN, ATTEND, GRAMS = 4096, 24, 20, 16, 10
THRESHOLD = 0.7
#: Training: epochs on halves and on all, windows of each phrase, hard and other clean windows an epoch, rows an epoch has at least, rows a step, rate, decay.
EPOCHS_APART, EPOCHS, EACH, HARD, FRESH, LEAST_ROWS, BATCH, RATE, DECAY = 5, 9, 5, 1000, 2500, 4000, 256, 6e-3, 0.02
SEED = 7
#: Input of the empty unit's update gate.
HOLD = 40.0

SCORE_SCHEMA = "doc_id bigint, source string, score double, category string, windows bigint"

_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"})
_HAN = "一-鿿"
_NUMERAL = re.compile(r"\d+[a-zè]{1,3}|[a-z]{1,2}\d+")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_·*]{1,2}[^\W\d_](?![^\W_])){2,}")
_HAN_GAP = re.compile(rf"(?<=[{_HAN}])[ ·.\-_|~]{{1,2}}(?=[{_HAN}*])")
_UNIT = re.compile(rf"[{_HAN}]|\*(?=[{_HAN}，。])|[0-9]+(?![^\W_{_HAN}]|[$@*])|(?:(?![{_HAN}])[^\W_]|[$@*])+|[，。！？；、,.!?;:]")


def units(text: str | None) -> list[str]:
    """A text's units: folded words and single ideographs, with disguises undone where they are plain."""
    if not text:
        return []
    text = consistent(text) or ""
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_·*]", "", m.group(0)), _HAN_GAP.sub("", text))
    out: list[str] = []
    before = ""
    for u in _UNIT.findall(text.lower()):
        if "一" <= u <= "鿿":
            out.append(before + u)
            before = u
            continue
        before = ""
        if u.isdigit():
            u = "#"
        elif _NUMERAL.fullmatch(u):
            u = "#"
        elif not u.isalpha() and len(u) > 1:
            u = u.translate(_LEET)
        out.append(u)
    return out


def features(unit: str) -> tuple[int, list[int]]:
    """Bucket of the word, and those of its characters' n-grams."""
    if "一" <= unit[-1] <= "鿿":
        return zlib.crc32(unit.encode()) % BUCKETS, [zlib.crc32(b"c" + unit[-1].encode()) % BUCKETS]
    framed = f"<{unit}>"
    grams = [framed[i : i + 3] for i in range(len(framed) - 2)] or [framed]
    grams = [g for g in grams if "*" not in g] or grams
    if len(grams) > GRAMS:
        grams = grams[: GRAMS - 3] + grams[-3:]
    return zlib.crc32(unit.encode()) % BUCKETS, [zlib.crc32(b"g" + g.encode()) % BUCKETS for g in grams]


class Units:
    """Numbers for units, with their features as arrays; number 0 is the empty place."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.word: list[int] = [0]
        self.grams: list[list[int]] = [[]]
        self._word, self._index, self._weight = np.zeros(0, np.int64), np.zeros((0, GRAMS), np.int64), np.zeros((0, GRAMS), np.float32)

    def add(self, seq: list[str]) -> np.ndarray:
        out = np.empty(len(seq), dtype=np.int32)
        number = self.number
        for i, u in enumerate(seq):
            k = number.get(u)
            if k is None:
                k = number[u] = len(self.word)
                w, g = features(u)
                self.word.append(w)
                self.grams.append(g)
            out[i] = k
        return out

    def arrays(self, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets, n-gram buckets and their shares of the units from ``first`` on."""
        done = len(self._word)
        if done < len(self.word):
            grams = self.grams[done:]
            index = np.zeros((len(grams), GRAMS), dtype=np.int64)
            weight = np.zeros((len(grams), GRAMS), dtype=np.float32)
            for i, g in enumerate(grams):
                index[i, : len(g)] = g
                weight[i, : len(g)] = 1 / len(g) if g else 0
            self._word = np.concatenate((self._word, np.array(self.word[done:], dtype=np.int64)))
            self._index, self._weight = np.concatenate((self._index, index)), np.concatenate((self._weight, weight))
        return self._word[first:], self._index[first:], self._weight[first:]


def windows(seq: np.ndarray) -> np.ndarray:
    """All overlapping windows of a row of unit numbers, padded with 0."""
    if not len(seq):
        return np.zeros((0, WINDOW), np.int32)
    n = max(1, -(-(len(seq) - WINDOW) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int32)
    padded[: len(seq)] = seq
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _sums(rows: int, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` with equal index."""
    order = np.argsort(index, kind="stable")
    at = index[order]
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out = np.zeros((rows, values.shape[1]), values.dtype)
    out[at[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Network:
    """The network; ``p`` has its parameters. Both directions run side by side, the backward one on the reversed window.

    The update gate of the empty unit is held open (:data:`HOLD`), so that padding leaves a state as it is.
    """

    def __init__(self, p: dict[str, np.ndarray] | None = None, seed: int = SEED):
        rng = np.random.default_rng(seed)
        g = lambda *s, k: (rng.standard_normal(s) * k).astype(np.float32)
        H = HIDDEN
        self.p = p or {
            "word": g(BUCKETS, DIM, k=0.1), "gram": g(BUCKETS, DIM, k=0.1),
            "x": g(2, DIM, 3 * H, k=DIM**-0.5), "b": np.zeros((2, 1, 3 * H), np.float32), "gates": g(2, H, 2 * H, k=H**-0.5), "cand": g(2, H, H, k=H**-0.5),
            "att": g(2 * H, ATTEND, k=0.2), "attv": g(ATTEND, k=0.3), "out": g(2 * H, len(CLASSES), k=0.2), "outb": np.zeros(len(CLASSES), np.float32),
        }

    def embed(self, word: np.ndarray, index: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return self.p["word"][word] + np.einsum("ukd,uk->ud", self.p["gram"][index], weight)

    def project(self, x: np.ndarray, first: bool = True) -> np.ndarray:
        """Each unit's input (2, units, 3 HIDDEN) for both directions; ``first`` if row 0 is the empty unit."""
        inputs = x @ self.p["x"] + self.p["b"]
        if first:
            inputs[:, 0, :HIDDEN] = HOLD
        return inputs

    def _states(self, both: np.ndarray, inputs: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, 2, batch, HIDDEN); ``both`` has the units (2, steps, batch), the second row reversed."""
        _, steps, batch = both.shape
        H, gates, cand = HIDDEN, self.p["gates"], self.p["cand"]
        side = np.array([[0], [1]])
        h = np.zeros((2, batch, H), inputs.dtype)
        out = np.empty((steps, 2, batch, H), inputs.dtype)
        for t in range(steps):
            x = inputs[side, both[:, t]]
            a = h @ gates
            a += x[..., : 2 * H]
            a *= 0.5
            np.tanh(a, out=a)
            a += 1
            a *= 0.5
            z, r = a[..., :H], a[..., H:]
            hn = h @ cand
            c = hn * r
            c += x[..., 2 * H :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, z, r, c, hn))
            h = np.subtract(h, c, out=out[t])
            h *= z
            h += c
        return out

    def forward(self, idx: np.ndarray, inputs: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Class probabilities of windows."""
        ids = np.ascontiguousarray(idx.T)
        both = np.stack((ids, ids[::-1]))
        states = self._states(both, inputs, keep.setdefault("steps", []) if keep is not None else None)
        h = np.concatenate((states[:, 0], states[::-1, 1]), axis=2)
        a = np.tanh(h @ self.p["att"])
        e = a @ self.p["attv"]
        e[ids == 0] = -1e4
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.matmul(alpha.T[:, None], h.transpose(1, 0, 2))[:, 0]
        logits = pooled @ self.p["out"] + self.p["outb"]
        q = np.exp(logits - logits.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        if keep is not None:
            keep |= {"h": h, "a": a, "alpha": alpha, "pooled": pooled, "both": both}
        return q

    def gradients(self, idx: np.ndarray, y: np.ndarray, weight: np.ndarray, table: tuple) -> tuple[float, dict[str, np.ndarray]]:
        used, inverse = np.unique(idx, return_inverse=True)
        local = inverse.reshape(idx.shape)
        if used[0] != 0:  # 0 must stay the empty place
            used, local = np.concatenate(([0], used)), local + 1
        word, index, share = (t[used] for t in table)
        x = self.embed(word, index, share)
        keep: dict = {}
        q = self.forward(local, self.project(x), keep)
        n, H = len(y), HIDDEN
        loss = float(-(weight * np.log(q[np.arange(n), y] + 1e-9)).sum() / n)
        dl = q.copy()
        dl[np.arange(n), y] -= 1
        dl *= (weight / n)[:, None]
        g = {"out": keep["pooled"].T @ dl, "outb": dl.sum(0)}
        dp = dl @ self.p["out"].T
        h, alpha, a, both = keep["h"], keep["alpha"], keep["a"], keep["both"]
        dh = alpha[:, :, None] * dp[None]
        da = np.einsum("tbh,bh->tb", h, dp)
        de = alpha * (da - (alpha * da).sum(0))
        g["attv"] = np.einsum("tb,tba->a", de, a)
        dpre = de[:, :, None] * self.p["attv"] * (1 - a * a)
        g["att"] = h.reshape(-1, 2 * H).T @ dpre.reshape(-1, ATTEND)
        dh += dpre @ self.p["att"].T
        steps = np.stack((dh[:, :, :H], dh[::-1, :, H:]), axis=1)
        gates_t, cand_t = self.p["gates"].transpose(0, 2, 1), self.p["cand"].transpose(0, 2, 1)
        g_gates, g_cand = np.zeros_like(self.p["gates"]), np.zeros_like(self.p["cand"])
        carry = np.zeros_like(steps[0])
        grown = np.empty((2, len(steps), n, 3 * H), x.dtype)
        for t in range(len(steps) - 1, -1, -1):
            h0, z, r, c, hn = keep["steps"][t]
            total = steps[t] + carry
            dc = total * (1 - z) * (1 - c * c)
            into = grown[:, t]
            into[..., :H] = total * (h0 - c) * z * (1 - z)
            into[..., H : 2 * H] = dc * hn * r * (1 - r)
            into[..., 2 * H :] = dc
            dc = dc * r
            back = h0.transpose(0, 2, 1)
            g_gates += back @ into[..., : 2 * H]
            g_cand += back @ dc
            carry = total * z + into[..., : 2 * H] @ gates_t + dc @ cand_t
        gin = np.stack([_sums(len(x), both[d].ravel(), grown[d].reshape(-1, 3 * H)) for d in (0, 1)])
        gin[:, 0] = 0  # the empty unit has no input
        g |= {"gates": g_gates, "cand": g_cand, "x": x.T @ gin, "b": gin.sum(1, keepdims=True)}
        dx = (gin @ self.p["x"].transpose(0, 2, 1)).sum(0)
        used_grams = share > 0
        gw = _sums(BUCKETS, word, dx)
        gg = _sums(BUCKETS, index[used_grams], (share[:, :, None] * dx[:, None, :])[used_grams]) if used_grams.any() else np.zeros_like(self.p["gram"])
        return loss, g | {"word": gw, "gram": gg}

    def score(self, idx: np.ndarray, inputs: np.ndarray, batch: int = 256) -> np.ndarray:
        parts = [self.forward(idx[i : i + batch], inputs) for i in range(0, len(idx), batch)]
        return np.concatenate(parts) if parts else np.zeros((0, len(CLASSES)), np.float32)


class Trainer:
    """Adam with decoupled decay over successive sets of windows; ``mean`` is a running average of the later weights."""

    def __init__(self, net: Network, steps: int, rate: float = RATE):
        self.net, self.steps, self.rate, self.step = net, max(1, steps), rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.mean: dict[str, np.ndarray] | None = None

    def epoch(self, idx: np.ndarray, y: np.ndarray, weight: np.ndarray, table: tuple, rng: np.random.Generator) -> float:
        p, losses = self.net.p, []
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            part = order[i : i + BATCH]
            loss, g = self.net.gradients(idx[part], y[part], weight[part], table)
            losses.append(loss)
            lr = self.rate * max(0.03, 1 - self.step / self.steps)
            self.step += 1
            scale = min(1.0, 2.0 / (np.sqrt(sum(float((x * x).sum()) for x in g.values())) + 1e-9))
            for k, x in g.items():
                self.m[k] += 0.1 * (x * scale - self.m[k])
                self.v[k] += 0.01 * ((x * scale) ** 2 - self.v[k])
                p[k] -= (lr * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.99**self.step)) + 1e-6) + lr * DECAY * p[k]).astype(p[k].dtype)
            if self.step * 3 > self.steps * 2:
                if self.mean is None:
                    self.mean = {k: x.copy() for k, x in p.items()}
                for k, x in p.items():
                    self.mean[k] += 0.05 * (x - self.mean[k])
        return float(np.mean(losses)) if losses else 0.0


def disguise(word: str, rng: random.Random) -> str:
    """A word masked, misspelt, spaced out, in figures, in look-alikes or as it is."""
    kind = rng.randrange(16)
    han = "一" <= word[0] <= "鿿"
    at = rng.randrange(1, len(word)) if len(word) > 1 else 0
    if kind == 0 and at:
        return word[:at] + "*" + word[at + 1 :]
    if kind == 1 and at:
        return word[:at] + (rng.choice("·-. ​") if han else "​") + word[at:]
    if kind == 2 and not han:
        return "".join({"a": "4", "e": "3", "i": "1", "o": "0", "s": "$", "t": "7"}.get(c, c) for c in word.lower())
    if kind == 3 and not han:
        return rng.choice("-. ").join(word)
    if kind == 4:
        return word.upper()
    if kind == 5 and not han:
        return word.translate(str.maketrans("aeiocps", "аеіосрѕ"))
    if kind == 6 and not han and len(word) > 4:
        return word[: at - 1] + word[at] + word[at - 1] + word[at + 1 :]
    if kind == 7 and not han and len(word) > 4:
        return word[:at] + word[at] + word[at:]
    if kind == 8 and at:
        return word[:at] + " " + word[at:]
    return word


def _name(lang: str, rng: random.Random) -> str:
    if lang == "zh":
        return "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.choice((2, 2, 3))))
    return "".join(rng.choice(("ba", "ko", "ri", "tel", "mun", "sa", "dor", "vi", "len", "qua", "os", "hav")) for _ in range(rng.choice((2, 3)))).capitalize()


def _group(lang: str, rng: random.Random) -> str:
    if lang == "zh":
        return _name(lang, rng)[:2] + rng.choice(("人", "族", "部落", "人", "帮", ""))
    return _name("en", rng) + rng.choice(("s", "ers", "i", "folk", " people", "ites", "al people"))


def phrase(template: str, lang: str, rng: random.Random, hide: bool) -> str:
    words = WORDS[lang]

    def one(m: re.Match[str]) -> str:
        k = m.group(1)
        if k == "n":
            return _name(lang, rng)
        if k == "g":
            return _group(lang, rng)
        w = rng.choice(words[k])
        return disguise(w, rng) if hide else w

    return re.sub(r"\{(\w)\}", one, template)


def _mask_any(text: str, rng: random.Random) -> str:
    """One word of a phrase without slots disguised."""
    words = re.findall(r"[一-鿿]{2,4}|[^\W\d_]{5,}", text)
    if not words:
        return text
    w = rng.choice(words)
    return text.replace(w, disguise(w, rng), 1)


def phrase_windows(clean: list[list[str]], rng: random.Random, each: int) -> list[tuple[list[str], int]]:
    """Windows with a phrase of :mod:`abuse_seeds` set into the units of a clean text at random."""
    pool = [u for u in clean if u] or [[]]
    out: list[tuple[list[str], int]] = []

    def into(text: str, label: int) -> None:
        seq = units(text)[:WINDOW]
        room = rng.randrange(0, WINDOW - len(seq) + 1) if rng.random() < 0.85 else 0
        around = rng.choice(pool)
        start = rng.randrange(0, max(1, len(around) - room))
        context = around[start : start + room]
        cut = rng.randrange(0, len(context) + 1)
        out.append((context[:cut] + seq + context[cut:], label))

    for (lang, kind), templates in HARMFUL.items():
        for t in templates:
            for _ in range(each):
                text = phrase(t, lang, rng, True)
                into(_mask_any(text, rng) if rng.random() < 0.3 else text, CLASSES.index(kind))
    for lang, templates in HARMLESS.items():
        for t in templates:
            for _ in range(each):
                into(phrase(t, lang, rng, False), 0)
    bad = {u for kinds in WORDS.values() for words in kinds.values() for w in words for u in units(w)}
    plain = [[u for u in units(phrase(t, lang, rng, False)) if u not in bad] for lang, templates in HARMLESS.items() for t in templates]
    for seq in (*pool, *plain, *plain, *plain):  # short texts of a few words are clean too
        at, size = rng.randrange(0, max(1, len(seq))), rng.choice((1, 2, 3, 5, 8, 12))
        out.append((seq[at : at + size], 0))
    for k in range(2 * len(plain)):  # and so are unknown words
        out.append((units(" ".join(_name(("en", "zh")[k % 2], rng).lower() for _ in range(rng.choice((1, 1, 2, 4))))), 0))
    return out


def masked(seq: list[str], rng: random.Random) -> list[str]:
    """A row of units with one word misspelt or masked."""
    at = rng.randrange(len(seq))
    u = seq[at]
    if "一" <= u[-1] <= "鿿":
        after = [seq[at + 1][-1], *seq[at + 2 :]] if at + 1 < len(seq) and len(seq[at + 1]) == 2 else seq[at + 1 :]
        return [*seq[:at], "*", *after]
    return [*seq[:at], disguise(u, rng).lower(), *seq[at + 1 :]] if len(u) > 3 else seq


def rating_error(rated: list[tuple[str, list[str]]]) -> float:
    """The share of wrong ratings, from the documents two raters rated: two ratings differ where one of them is wrong."""
    pairs = [(ls[0] == "none") != (x == "none") for _, ls in rated for x in ls[1:]]
    return float(np.clip((sum(pairs) + 1) / (len(pairs) + 10) / 2, 0.01, 0.25))


def belief(harm: float, ratings: list[str], error: float) -> float:
    """The probability that a document is harmful, from the model's score and its ratings of the given error."""
    odds = np.clip(harm, 1e-3, 1 - 1e-3) / (1 - np.clip(harm, 1e-3, 1 - 1e-3))
    for r in ratings:
        odds *= (1 - error) / error if r != "none" else error / (1 - error)
    return float(odds / (1 + odds))


class Bag:
    """A document with a rating other than ``none``: its units and windows, its ratings, and what is thought of them."""

    __slots__ = ("units", "windows", "ratings", "label", "sure", "picks")

    def __init__(self, seq: list[str], idx: np.ndarray, ratings: list[str]):
        kinds = [x for x in ratings if x != "none"]
        self.units, self.windows, self.ratings = seq, idx, ratings
        self.label = CLASSES.index(max(sorted(set(kinds)), key=kinds.count))
        self.sure, self.picks = 0.0, []

    def judge(self, harm: np.ndarray, error: float) -> None:
        """Which windows may be meant by the rating, and whether it is right, from scores of the windows."""
        best = int(harm.argmax())
        self.sure = belief(float(harm[best]), self.ratings, error)
        self.picks = sorted({best, *np.flatnonzero(harm > 0.9).tolist()})


class Lessons:
    """Draws the windows of each epoch from phrases, clean documents and bags."""

    def __init__(self, clean: list[list[str]], known: Units, rng: random.Random, nrng: np.random.Generator):
        self.clean, self.known, self.rng, self.nrng = clean, known, rng, nrng
        self.idx = np.concatenate([np.zeros((0, WINDOW), np.int32), *(windows(known.add(u)) for u in clean)])

    def rows(self, seqs: list[list[str]]) -> np.ndarray:
        idx = np.zeros((len(seqs), WINDOW), np.int32)
        for i, seq in enumerate(seqs):
            part = self.known.add(seq[:WINDOW])
            idx[i, : len(part)] = part
        return idx

    def harm(self, net: Network, idx: np.ndarray) -> np.ndarray:
        return 1 - net.score(idx, net.project(net.embed(*self.known.arrays())))[:, 0]

    def versions(self, bag: Bag) -> Iterator[list[str]]:
        """The picked windows as they are, with a word disguised, and in other surroundings."""
        rng = self.rng
        for at in bag.picks:
            seq = bag.units[at * STRIDE : at * STRIDE + WINDOW]
            yield seq
            yield masked(seq, rng)
            part = seq[rng.randrange(0, max(1, len(seq) // 3)) : len(seq) - rng.randrange(0, max(1, len(seq) // 3))]
            around = rng.choice(self.clean) if self.clean else bag.units
            size = WINDOW - len(part)
            start = rng.randrange(0, max(1, len(around) - size))
            fill = around[start : start + size]
            cut = rng.randrange(0, len(fill) + 1)
            yield fill[:cut] + part + fill[cut:]

    def teach(self, net: Network, bags: list[Bag], epochs: int, error: float | None = None, drop: bool = False) -> None:
        """Epochs over all; with ``error`` given the bags' windows are picked anew in each by the net's own scores."""
        templates = sum(map(len, (*HARMFUL.values(), *HARMLESS.values())))
        each = max(EACH, (LEAST_ROWS - min(len(self.idx), HARD + FRESH)) // templates)
        seeds = each * templates
        trainer = Trainer(net, epochs * -(-(seeds + len(self.clean) + 4 * len(bags) + min(len(self.idx), HARD + FRESH)) // BATCH))
        queue = self.nrng.permutation(len(self.idx))
        for epoch in range(epochs):
            phrases = phrase_windows(self.clean, self.rng, each)
            parts = [(self.rows([s for s, _ in phrases]), np.array([y for _, y in phrases], np.int64), np.ones(len(phrases), np.float32))]
            if len(self.idx):
                take, queue = queue[:FRESH], np.roll(queue, -FRESH)
                if epoch:
                    harm = self.harm(net, self.idx)
                    take = np.unique(np.concatenate((take, np.argsort(-harm, kind="stable")[:HARD])))
                    if drop and epoch >= epochs - 3:
                        take = take[harm[take] < 0.95]
                parts.append((self.idx[take], np.zeros(len(take), np.int64), np.ones(len(take), np.float32)))
            if error is not None and epoch and bags:
                harm = self.harm(net, np.concatenate([b.windows for b in bags]))
                for b, own in zip(bags, np.split(harm, np.cumsum([len(b.windows) for b in bags])[:-1])):
                    b.judge(own, error)
            picked = [(v, b.label, b.sure) for b in bags if b.sure > 0.5 for v in self.versions(b)]
            if picked:
                parts.append((self.rows([v for v, _, _ in picked]), np.array([y for _, y, _ in picked], np.int64), np.array([w for _, _, w in picked], np.float32)))
            trainer.epoch(*(np.concatenate(x) for x in zip(*parts)), self.known.arrays(), self.nrng)
        if trainer.mean is not None:
            net.p = trainer.mean


def train(rated: list[tuple[str, list[str]]], seed: int = SEED) -> Network:
    """A network from rated texts: (text, its ratings).

    A rating speaks of a whole document, of which a few words may be harmful,
    and may be wrong. So two networks learn from one half of the documents with
    a rating other than ``none`` each; which windows a rating means and how far
    it is believed (:func:`belief`) is said by the network that has not seen
    the document. The last network learns from all of them so weighted, with
    words disguised and surroundings exchanged. Windows of documents rated
    ``none`` only are clean; the worst scored ones are taken in every epoch, the
    others in turn, and one that stays above 0.95 at the end is left out, as it
    may be rated wrongly.
    """
    rng, nrng = random.Random(seed), np.random.default_rng(seed)
    known = Units()
    error = rating_error(rated)
    texts = [(u, [x for x in ls if x in CLASSES]) for t, ls in rated if (u := units(t))]
    lessons = Lessons([u for u, ls in texts if ls and all(x == "none" for x in ls)], known, rng, nrng)
    bags = [Bag(u, windows(known.add(u)), ls) for u, ls in texts if any(x != "none" for x in ls)]
    halves = bags[::2], bags[1::2]
    judges = []
    for k, half in enumerate(halves if bags else ()):
        judges.append(Network(seed=seed + 1 + k))
        lessons.teach(judges[-1], half, EPOCHS_APART, error)
    for half, other in zip(halves, reversed(judges)):
        for b in half:
            b.judge(lessons.harm(other, b.windows), error)
    net = Network(seed=seed)
    lessons.teach(net, bags, EPOCHS, drop=True)
    return net


@lru_cache(maxsize=4)
def _trained(rated: tuple[tuple[str, tuple[str, ...]], ...]) -> Network:
    return train([(t, list(ls)) for t, ls in rated])


def trained(rated: list[tuple[str, list[str]]]) -> Network:
    """As :func:`train`; the same ratings are trained on once in a session."""
    return _trained(tuple((t, tuple(ls)) for t, ls in rated))


def save(net: Network, path: str) -> None:
    """The weights as a file that :func:`load` reads."""
    np.savez_compressed(path, **net.p)


def load(path: str) -> Network:
    with np.load(path) as f:
        return Network({k: f[k] for k in f.files})


def rated_sample(documents: DataFrame, labels: DataFrame, most: int = LABELLED, most_none: int = LABELLED_NONE) -> list[tuple[str, list[str]]]:
    """At most ``most`` documents rated otherwise than ``none`` and ``most_none`` rated ``none`` only, with all their ratings, chosen by a hash of the id, the same on every run."""
    ratings = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    harmful = F.exists("labels", lambda x: x != "none")
    order = (F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id"))
    picked = ratings.where(harmful).orderBy(*order).limit(most).unionByName(ratings.where(~harmful).orderBy(*order).limit(most_none))
    texts = documents.select("doc_id", "text").where("text is not null")
    rows = texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return [(r["text"], list(r["labels"])) for r in rows]


def score_documents(documents: DataFrame, net: Network) -> DataFrame:
    """Rows of :data:`SCORE_SCHEMA` for all documents and all their windows; no shuffle."""
    params = net.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(params)
        known = Units()
        inputs = np.zeros((2, 0, 3 * HIDDEN), np.float32)
        schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("score", pa.float64()), ("category", pa.string()), ("windows", pa.int64())])
        for batch in batches:
            if len(known.word) > 300_000:  # memory only: units are numbered anew
                known, inputs = Units(), inputs[:, :0]
            texts = batch.column(2)
            ids, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            scores, kinds, counts = np.zeros(len(ids)), ["none"] * len(ids), np.zeros(len(ids), np.int64)
            held: list[np.ndarray] = []
            owner: list[tuple[int, int]] = []
            size = 0

            def flush() -> None:
                nonlocal inputs, size
                if not held:
                    return
                first = inputs.shape[1]
                if first < len(known.word):
                    inputs = np.concatenate((inputs, model.project(model.embed(*known.arrays(first)), first == 0)), axis=1)
                q = model.score(np.concatenate(held), inputs)
                at = 0
                for i, n in owner:
                    part = q[at : at + n]
                    at += n
                    k = int(np.argmin(part[:, 0]))
                    if 1 - part[k, 0] > scores[i]:
                        scores[i] = 1 - float(part[k, 0])
                        kinds[i] = CLASSES[1 + int(np.argmax(part[k, 1:]))] if scores[i] >= THRESHOLD else "none"
                held.clear()
                owner.clear()
                size = 0

            for i in range(len(ids)):
                w = windows(known.add(units(texts[i].as_py())))
                counts[i] = len(w)
                for j in range(0, len(w), 4096):
                    held.append(w[j : j + 4096])
                    owner.append((i, len(held[-1])))
                    size += len(held[-1])
                    if size >= 4096:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(scores), pa.array(kinds, pa.string()), pa.array(counts)], schema=schema)

    rows = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["source"].alias("source"), documents["text"].alias("text"))
    return rows.mapInArrow(run, SCORE_SCHEMA)


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, flagged ones, the rate and the mean score."""
    flag = (F.col("score") >= threshold).cast("bigint")
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum(flag).alias("flagged"), (F.sum(flag) / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"))
