import itertools
import random

import numpy as np
import pytest

from quire.llm import markup as M


@pytest.fixture(scope="module")
def field():
    return M.trained()


def found(text, field):
    return next(M.analyse([text], field))[2]


@pytest.mark.parametrize(
    "text, want",
    [
        ("plain text, 3 * 4 * 5, a < b and c > d, $5 to $7, [12], file_name_old, C:\\temp\\new, Holt & Sons, ( < and > )", set()),
        ("<b>x</b>", {"html"}), ("a &nbsp; b", {"html"}), ("<!-- page: 3 -->", {"html"}), ("x\n<div cla\n", {"html"}), ("AT&T; x", set()),
        ("\\section{x}", {"latex"}), ("see $a_{1}+b$ here", {"latex"}), ("票价由$5涨到$7。", set()), ("\\[ x \\]", {"latex"}), ("\\begin{verbatim}\n<b>\n\\end{verbatim}", {"latex"}),
        ("# Head", {"markdown"}), ("`<b>`", {"markdown"}), ("```\n<b> [[x]] \\section{y}\n```", {"markdown"}), ("~~~\nopen to the end <b>", {"markdown"}), ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}), (">[low-confidence] x", {"markdown"}), ("::: {.chapter}\nx\n:::", {"markdown"}), ("#12 of them", set()),
        ("== Head ==", {"wiki"}), ("[[a|b]]", {"wiki"}), ("''x''", {"wiki"}), ("{{note|x}}", {"wiki"}), ("{| class=wikitable\n! a\n|-\n| 1 || 2\n|}", {"wiki"}), ("x = [[1, 2], [3, 4]]", set()),
        ("<pre># a [[b]]</pre>", {"html"}), ("# A\r\n\r\n[[b]]\r\n", {"markdown", "wiki"}), ("", set()),
    ],
)
def test_constructs(text, want, field):
    assert found(text, field) == want


def test_held_out_labels(field):
    rng = random.Random(2024)
    right = total = 0
    for _ in range(60):
        text, spans = M.labelled_page(rng)
        leaves, _ = M.read(text)
        gold = M.label_leaves(leaves, spans)
        right += sum(a == b for a, b in zip(gold, field.viterbi(M.features(leaves))))
        total += len(gold)
    assert right / total > 0.97


def test_field_decides(field):
    """Without the field - every line labelled paragraph - other constructs are found on held-out pages."""

    class Blind(M.Field):
        def viterbi_all(self, pages):
            return [[M.LABELS.index("paragraph")] * len(p) for p in pages]

    rng = random.Random(5)
    texts = [M.labelled_page(rng)[0] for _ in range(60)] + ["~~~\n# count the lines\nx = [[a]]\n~~~", "# Head", "- one\n- two", "| a & b \\\\"]
    seen, blind = ([x[2] for x in M.analyse(texts, f)] for f in (field, Blind(field.emit, field.move)))
    assert sum(a != b for a, b in zip(seen, blind)) >= 4 and seen[-4] == {"markdown"} and blind[-4] == {"markdown", "wiki"} and seen[-3] == {"markdown"} and blind[-3] == set()


def test_pages_side_by_side(field):
    rng = random.Random(6)
    pages = [M.features(M.read(M.labelled_page(rng)[0])[0]) for _ in range(20)] + [[]]
    assert field.viterbi_all(pages) == [field.viterbi(p) for p in pages] and field.viterbi_all([]) == []


def test_whole_leaves_count(field):
    long = "word " * 2000
    assert M.features(M.read(long + "x & y \\\\")[0]) != M.features(M.read(long + "x and y")[0])
    assert found(long + "[[a|b]]", field) == {"wiki"} and found("```\n" + long + "[[a|b]]\n```", field) == {"markdown"}


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(1)
    f = M.Field(rng.normal(size=(M.FEATURES, len(M.LABELS))), rng.normal(size=(len(M.LABELS),) * 2))
    feats = [[0, int(k)] for k in rng.integers(1, M.FEATURES, 4)]
    s = f.scores(feats)
    best = max(itertools.product(range(len(M.LABELS)), repeat=4), key=lambda p: sum(s[t, k] for t, k in enumerate(p)) + sum(f.move[a, b] for a, b in zip(p, p[1:])))
    assert tuple(f.viterbi(feats)) == best


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    f = M.Field(rng.normal(size=(M.FEATURES, len(M.LABELS))) * 0.3, rng.normal(size=(len(M.LABELS),) * 2) * 0.3)
    feats, gold = [[0, 3], [0, 7, 9], [0, 5]], [1, 2, 0]
    _, ge, gm = f.gradient(feats, gold)
    for array, g, at in ((f.emit, ge, (7, 2)), (f.emit, ge, (0, 1)), (f.move, gm, (1, 2))):
        old = array[at]
        array[at] = old + 1e-5
        up = f.gradient(feats, gold)[0]
        array[at] = old - 1e-5
        down = f.gradient(feats, gold)[0]
        array[at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_clean_text_keeps_structure(field):
    text = "<h2>Title</h2>\n\n<p>one <b>two</b> &amp; three</p>\n\n<ul>\n<li>a\n<li>b</li>\n</ul>\n\n{| class=wikitable\n! h\n|-\n| 1 || 2\n|}\n\n\\begin{equation}\nx^2\n\\end{equation}\n\n```\ncode <b>\n```\n\n> quote *x*\n\n![cap](images/p.png)"
    leaves, labels, _ = next(M.analyse([text], field))
    out = M.render(leaves, labels)
    for part in ("## Title", "one two & three", "- a\n- b", "| h\n| 1 | 2", "$$\nx^2\n$$", "```\ncode <b>\n```", "> quote x"):
        assert part in out, out


def test_rows(spark, field):
    rows = [(1, None, "x"), (2, "", "x"), (3, "# A\n\nb", "x"), (3, "# A\n\nb", "x"), (None, "<b>", "x"), (4, "word " * 60_000, "x"), (5, "<b>" * 3000, "x")]
    df = spark.createDataFrame(rows, "content_id bigint, book_md string, row_id string")
    got = M.clean(df, "content_id", "book_md", field).collect()
    by = {r.row_id: r for r in got}
    assert len(got) == 7 and by[1].clean_text is None and by[1].markup == [] and by[2].clean_text == "" and by[3].markup == ["markdown"] and by[None].markup == ["html"] and len(by[4].clean_text) > 290_000
    assert M.clean(df.limit(0), "content_id", "book_md", field).count() == 0
