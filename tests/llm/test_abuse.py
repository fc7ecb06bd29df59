import random
import re

import duckdb
import numpy as np
import pytest

from quire.llm import abuse as A


@pytest.fixture(scope="module")
def net():
    assert A.train([]).p  # no ratings at all
    clean = ["The weaver carried the lantern across the bridge before the assembly. " * 6, "画师在河边修补了石桥，学徒们都在门外等候。" * 8, "Der Müller ordnete die Handschrift neben der Schleuse. " * 6, "Le passeur quitta la forêt près de la carrière. " * 6]
    return A.train([(t, ["none"]) for t in clean] + [("You stupid idiot, shut up and crawl away.", ["abusive"]), ("A calm and quiet page about rivers.", ["hateful"]), (None, ["none"])])


def test_gradients_equal_differences():
    net = A.Network(seed=1)
    units = A.Units()
    idx = np.stack([np.pad(units.add(["a", "b", "cc"]), (0, A.WINDOW - 3)), np.pad(units.add(["b", "dd"]), (0, A.WINDOW - 2))])
    table, y, w = units.arrays(), np.array([1, 0]), np.ones(2, np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    table = (table[0], table[1], table[2].astype(np.float64))
    _, g = net.gradients(idx, y, w, table)
    rng = np.random.default_rng(0)
    for name in ("x", "b", "gates", "cand", "att", "attv", "out", "outb"):
        flat, at = net.p[name].reshape(-1), int(rng.integers(net.p[name].size))
        old = flat[at]
        flat[at] = old + 1e-3
        up = net.gradients(idx, y, w, table)[0]
        flat[at] = old - 1e-3
        down = net.gradients(idx, y, w, table)[0]
        flat[at] = old
        assert abs((up - down) / 2e-3 - g[name].reshape(-1)[at]) < 2e-3, name


def test_windows_cover_everything():
    for n in (0, 1, A.WINDOW, A.WINDOW + 1, 5 * A.WINDOW + 7):
        w = A.windows(np.arange(1, n + 1, dtype=np.int32))
        assert set(w.ravel()) - {0} == set(range(1, n + 1))
        assert n <= A.WINDOW or all(len(set(a) & set(b) - {0}) >= A.STRIDE - (A.WINDOW - n % A.STRIDE) * 0 - A.STRIDE for a, b in zip(w, w[1:]))


def test_disguises_are_undone():
    assert A.units("d-i-s-g-u-s-t") == ["disgust"] and A.units("m0r0n p4r4$173$") == ["moron", "parasites"] and A.units("іdiоt") == ["idiot"] and A.units(None) == []
    assert A.units("混·蛋") == A.units("混蛋") and A.units("12 pages") == ["#", "pages"]


def _phrases():
    for group in (A.HARMFUL, A.HARMLESS):
        for templates in group.values():
            yield from templates


def test_no_phrase_stands_in_documents():
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        texts = duckdb.sql(f"select text from '/root/testdata/{sf}/documents.parquet' where text is not null").fetchall()
        whole = "\n".join(t for (t,) in texts).lower()
        for template in _phrases():
            for part in re.split(r"\{\w\}", template.lower()):
                part = part.strip(" ,.;:!?，。！？；")
                if len(part) >= (3 if "一" <= part[:1] <= "鿿" else 9):
                    assert part not in whole, part


def test_held_out_documents():
    """Trained on the ratings of half of the documents, held against documents of the other half that two raters agree on; two seeds."""
    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select any_value(text), list(label order by label) from '{d}/documents.parquet' d join '{d}/labels.parquet' l using (doc_id) where text is not null group by doc_id order by doc_id").fetchall()
    true = hits = false = clean = 0
    for seed in (3, 4):
        shuffled = random.Random(seed).sample(rows, len(rows))
        learnt, rest = shuffled[: len(rows) // 2], shuffled[len(rows) // 2 :]
        net = A.train(learnt, seed)
        known = {t for t, _ in learnt}
        units = A.Units()
        agreed = [(A.windows(units.add(A.units(t))), ls[0] != "none") for t, ls in rest if len(ls) > 1 and (ls[0] == "none") == (ls[-1] == "none") and t not in known]
        inputs = net.project(net.embed(*units.arrays()))
        for w, harmful in agreed:
            flagged = len(w) > 0 and 1 - net.score(w, inputs)[:, 0].min() >= A.THRESHOLD
            true, hits, false, clean = true + harmful, hits + (harmful and flagged), false + (flagged and not harmful), clean + (not harmful)
    assert true > 15 and hits >= 0.85 * true and false <= 0.03 * clean


def test_ratings_weigh_by_belief():
    assert A.belief(0.9, ["abusive"], 0.05) > 0.9 > A.belief(0.02, ["abusive"], 0.05) and A.belief(0.5, ["abusive", "none"], 0.05) == pytest.approx(0.5)
    assert A.rating_error([("a", ["none", "none"])] * 90 + [("b", ["none", "abusive"])] * 10) == pytest.approx(0.05, abs=0.01)


def test_saved_weights(net, tmp_path):
    A.save(net, str(tmp_path / "w.npz"))
    again = A.load(str(tmp_path / "w.npz"))
    assert all((again.p[k] == v).all() for k, v in net.p.items())


def test_rows(spark, net):
    long = "The weaver carried the lantern across the bridge. " * 4000
    rows = [(1, None, "s", 1), (2, "", "s", 1), (3, long, "s", 1), (4, long + "You worthless idiot, drop dead. " + long, None, 1), (4, long + "You worthless idiot, drop dead. " + long, None, 1), (None, "quiet", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score int")
    got = A.score_documents(df, net).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].score == by[2].score == 0.0 and by[1].windows == 0 and by[3].score < 0.5 < by[4].score and by[4].category == "abusive"
    rate = {r.source: r for r in A.rates(A.score_documents(df, net)).collect()}
    assert rate[None].flagged == 2 and rate["s"].flagged == 0
    assert A.score_documents(df.limit(0), net).count() == 0


def test_rated_sample(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)] + [(3, "t3"), (21, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i % 22, 1, "none") for i in range(40)] + [(3, 2, "abusive"), (None, 1, "none"), (5, 1, None)], "doc_id bigint, rater int, label string")
    got = A.rated_sample(docs, labels, most=10, most_none=10)
    assert len(got) <= 20 and got == A.rated_sample(docs, labels, most=10, most_none=10)
    assert A.rated_sample(docs.limit(0), labels) == []
