import random

import numpy as np

from quire.llm import scans as S

WORDS = "the archive lantern bridge weaver carried across river morning letter council harbour printer gardens stone quiet painted remembered half-open".split()
HAN = ["海边的灯塔很亮", "山谷上方的石桥", "今日的方志记录了水车", "众人重新点起灯火", "白塔在城东的旧路旁"]
SCHEMA = "elem_id bigint, book_id string, page_index int, list_pos int, type string, bbox struct<x1:double,y1:double,x2:double,y2:double>, text string, confidence double, word string"


def book(rng, name, start):
    rows = []
    for p in range(8):
        def add(text, y=500.0, kind="text", pos=None):
            rows.append((start + len(rows), name, p, len(rows), kind, (100.0, y, 900.0, y + 50.0), text, 0.9, "clash"))

        add("A Long History" if p != 2 else "A LONG HISTORY", 70.0, "header")
        for k in range(5):
            add(" ".join(rng.choice(WORDS) for _ in range(30)) + ".", 300.0 + 100 * k)
        add("，".join(rng.sample(HAN, 3)) + "。", 1000.0)
        add(f"- {p + 1} -", 2240.0, "number")
    return rows


def make(spark, extra, books=12):
    rng = random.Random(1)
    rows = [r for b in range(books) for r in book(rng, f"b{b}", 1000 * b)]
    return spark.createDataFrame(rows + extra, SCHEMA)


def test_kinds(spark):
    def x(i, text, p=1, y=600.0, kind="text", pos=900, book="b0"):
        return (90_000 + i, book, p, pos + i, kind, (100.0, y, 900.0, y + 50.0) if y is not None else None, text, None, "clash")

    extra = [
        x(1, "the archivc carried the lantern across the river"), x(2, "the a◇chive carried the lantern"), x(3, "the lan-\ntern carried the bridge"), x(4, "the half-\nopen bridge 1839-\n1862 pre- and post"), x(5, "山谷上万的石桥"), x(6, "A Long History\nThe weaver carried the bridge across."),
        x(7, "The weaver carried the bridge.\n2"), x(8, "1846", y=1100.0), x(9, "the quiet gar-", p=5, pos=9000), x(10, "dens remembered the stone.", p=6, pos=0), x(11, None), x(12, ""), x(13, "A Long History", y=None), x(14, "lone lan¬\ntern"), x(15, "the morning 1etter council"),
        x(17, "海边的打搭很亮"), x(16, "word " * 40_000), x(16, "word " * 40_000), (None, None, None, None, None, None, "text", None, None),
    ]
    noise = S.Noise(make(spark, extra))
    got = {}
    for r in noise.found().collect():
        got.setdefault(r.elem_id, set()).add(r.kind)
    at = lambda i: got.get(90_000 + i, set())
    assert at(1) == {"misread"} and at(2) == {"misread"} and at(3) == {"hyphenation"} and at(4) == set() and at(5) == {"misread"} and at(6) == {"running_head"} and at(7) == {"page_number"}
    assert at(8) == at(10) == at(11) == at(12) == at(13) == at(16) == set() and at(9) == {"hyphenation"} and at(14) == {"hyphenation"} and at(15) == {"misread"}
    assert at(17) == {"misread"}
    heads = [i for i, k in got.items() if i is not None and i < 90_000 and "running_head" in k]
    numbers = [i for i, k in got.items() if i is not None and i < 90_000 and "page_number" in k]
    assert len(heads) == len(numbers) == 8 * 12
    text = {r.elem_id: r.paragraph for r in noise.paragraphs().collect()}
    assert text[90_001].startswith("the archive carried") and text[90_002].startswith("the archive") and text[90_003] == "the lantern carried the bridge" and text[90_005] == "山谷上方的石桥" and text[90_017] == "海边的灯塔很亮"
    assert text[90_006] == "The weaver carried the bridge across." and text[90_007] == "The weaver carried the bridge." and text[90_009] == "the quiet gardens remembered the stone." and 90_010 not in text


def test_signs_without_original_stay(spark):
    """A word with a sign and no link is reported; its text stays as it is."""

    def x(i, text):
        return (90_000 + i, "b0", 1, 900 + i, "text", (100.0, 600.0, 900.0, 650.0), text, None, "clash")

    noise = S.Noise(make(spark, [x(1, "鼎■鼐是旧物"), x(2, "the archivc carried the lantern across the Zyq□vxk")], books=6))
    found = {(r.elem_id, r.kind) for r in noise.found().collect()}
    assert {(90_001, "misread"), (90_002, "misread")} <= found
    text = {r.elem_id: r.paragraph for r in noise.paragraphs().collect()}
    assert text[90_001] == "鼎■鼐是旧物" and text[90_002] == "the archive carried the lantern across the Zyq□vxk"


def test_rest_stays_where_its_beginning_is_left_out(spark):
    """The first half of a divided word stands in a running head: the text with the second half is not lost."""
    heads = [(90_000 + p, "b0", p, 900, "text", (100.0, 70.0, 900.0, 110.0), "the quiet gar-", None, "clash") for p in (5, 6, 7)]
    noise = S.Noise(make(spark, [*heads, (90_010, "b0", 7, 901, "text", (100.0, 600.0, 900.0, 650.0), "dens remembered the stone.", None, "clash")], books=6))
    text = {r.elem_id: r.paragraph for r in noise.paragraphs().collect()}
    assert not {90_005, 90_006, 90_007} & set(text) and text[90_010] == "dens remembered the stone."


def test_empty_table(spark):
    noise = S.Noise(make(spark, [], books=0).limit(0))
    assert noise.found().count() == 0 and noise.paragraphs().count() == 0


def test_edits():
    assert S.plausible("archivc", "archive") and S.plausible("rernernbered", "remembered") and S.plausible("Stadtt0r", "Stadttor") and not S.plausible("bridge", "lantern") and not S.plausible("archive", "archive")
    for wrong, true in (("archivc", "archive"), ("nothirig", "nothing"), ("winclow", "window"), ("northem", "northern"), ("oubllé", "oublié"), ("Briicke".lower(), "brücke")):
        assert S.fold(true) in S.fold_wrong(wrong) and S.plausible(wrong, true), wrong


def test_numbers_and_roman():
    assert S.roman("xiv") == 14 and S.roman("iii") == 3 and S.roman("abc") is None
    for t, n in (("- 12 -", 12), ("第24页", 24), ("vi", 6), ("14 / 44", 14), ("[455]", 455), ("· 8 ·", 8), ("Page 11", 11)):
        assert S.number_value(S._WHOLE_NUMBER.fullmatch(t)) == n, t
    assert S._WHOLE_NUMBER.fullmatch("12 men") is None


def test_vectors_bring_neighbours_together():
    m = np.zeros((6, 6))
    for a, b, n in ((0, 1, 50), (2, 1, 50), (3, 4, 50), (5, 4, 50)):
        m[a, b] = n
    u, v = S.skip_gram(m, length=8, rounds=200)
    score = u @ v.T
    assert score[0, 1] > score[0, 4] and score[3, 4] > score[3, 1] and np.isfinite(u).all()


def test_vector_of_each_word():
    rng = np.random.default_rng(0)
    m = np.zeros((40, 40))
    for i in range(40):
        m[i, [(i // 8) * 8 + k for k in range(8)]] = 30
    _, b = S.skip_gram(m, length=8)
    got = S.solve(m[[0, 9, 39]] + 0.0, b, m.sum(0))
    score = got @ b.T
    assert score[0, 3] > score[0, 20] and score[1, 12] > score[1, 3] and score[2, 36] > score[2, 0] and np.isfinite(got).all()
    assert np.abs(S.solve(np.zeros((1, 40)), b, m.sum(0))).max() < 1e-6


def test_vectors_decide(spark, monkeypatch):
    """Two originals for one wrong word, and a rare word that is right: without vectors the wrong ones are taken."""
    rng = random.Random(4)
    sea, land = "wave sail mast tide port shore fleet anchor".split(), "plough barn seed hedge meadow grain cattle fence".split()
    rows, true = [], {}

    def add(words):
        rows.append((len(rows), "b", len(rows), 0, "text", (100.0, 500.0, 900.0, 550.0), " ".join(words) + ".", 0.9, "x"))
        return len(rows) - 1

    for _ in range(120):
        add([*rng.sample(sea, 4), "harbaur", *rng.sample(sea, 4)])
        add([*rng.sample(land, 4), "harbour", *rng.sample(land, 4)])
        add(rng.sample(sea, 8))
        add(rng.sample(land, 8))
    for _ in range(7):
        true[add([*rng.sample(sea, 3), "harb□ur", *rng.sample(sea, 3)])] = "harbaur"
        true[add([*rng.sample(land, 3), "harb□ur", *rng.sample(land, 3)])] = "harbour"
    df = spark.createDataFrame(rows, SCHEMA)

    def f1():
        got = {r.elem_id: r.true for r in S.Noise(df).corrections().collect() if r.true}
        right = sum(true.get(i) == t for i, t in got.items())
        return 2 * right / (len(got) + len(true))

    assert f1() >= 0.9
    monkeypatch.setattr(S, "solve", lambda around, b, often: np.zeros((len(around), b.shape[1])))
    assert f1() <= 0.6


def test_damaged_heads_inside_texts(spark):
    heads = S.Heads([S.head_key(x) for x in ("沧浪县志长编", "A Long History", "水车")])
    for text, end in (("沧浪县□长编\n正文开始。", 7), ("□浪县志长编\n正文", 7), ("A Long Histcry\nThe weaver", 15), ("水车\n正文", 3), ("A Long Historyand more", None), ("沧□县□长编\n正文", None), ("水轮\n正文", None), ("", None)):
        found = heads.find(text)
        assert (found[1] if found else None) == end, text


def test_texts_of_a_book_with_many_heads_do_not_carry_them(spark, monkeypatch):
    """The same rows whether heads go with the texts or the texts to the heads, and few characters beside any text."""
    rng = random.Random(3)
    nouns = "沧浪县志长编药铺竹林方志金色白塔渡口斑驳城门高大盐田书院厚重学徒"
    names = [f"第{i}章{''.join(rng.sample(nouns, rng.randint(2, 9)))}" for i in range(400)]
    names += [f"Chapter {i} The {rng.choice(WORDS).title()} of the {rng.choice(WORDS).title()}" for i in range(200)] + ["水车"]
    heads = spark.createDataFrame([("b0", k) for k in sorted({S.head_key(x) for x in names})] + [("b1", S.head_key("A Long History"))], "book_id string, key string")
    texts = []
    for i in range(600):
        name = list(rng.choice(names))
        for _ in range(rng.choice((0, 1, 1, 2, 4))):
            name[rng.randrange(len(name))] = rng.choice("□c甲")
        texts.append((i, "b0", "text", rng.choice(("", "\u3000\u3000", "12\n")) + "".join(name) + rng.choice(("\n", " ", "  7\n", "")) + rng.choice(("正文开始 了。", "The weaver carried.", "the weaver")), None, None))
    texts += [(1000, "b1", "text", "A Long History\nThe weaver", None, None), (1001, "b2", "text", "A Long History\nThe weaver", None, None), (None, None, "text", "水车\n正文", None, None), (1002, "b0", "text", "水车\n正文", 0.01, 0.02)]
    rows = spark.createDataFrame(texts, "elem_id bigint, book_id string, type string, text string, top double, bottom double").repartition(4)
    frames, real = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, *a, **k: frames.append(self) or real(self, *a, **k))
    got = {(r.elem_id, r.end) for r in S.inner_heads(rows, heads).collect()}
    carried = [f.selectExpr("max(aggregate(keys, 0, (n, k) -> n + length(k))) as n").first()[0] for f in frames if "keys" in f.columns]
    assert carried and max(carried) <= S.CARRIED
    monkeypatch.setattr(S, "CARRIED", 10**9)
    assert len(got) > 300 and (1000, 15) in got and got == {(r.elem_id, r.end) for r in S.inner_heads(rows, heads).collect()}


def test_next_open_in_blocks(spark):
    rng = random.Random(2)
    opens = [(i, rng.choice("ab"), p, rng.choice((None, 1, 2)), "rest") for i, p in enumerate([*rng.sample(range(5000), 60), -7, 2**31 - 1, None])]
    ends = [(1000 + i, rng.choice("abc"), p, 0, "half", "-", 1) for i, p in enumerate([*rng.sample(range(-20, 5200), 80), 2**31 - 2, 2**31 - 1, -(2**31), None])]
    got = S.next_open(
        spark.createDataFrame(ends, "elem_id bigint, book_id string, page_index int, list_pos int, half string, mark string, newline bigint"), spark.createDataFrame(opens, "next_id bigint, b string, p int, l int, rest string")
    )
    want = {}
    for e, book, page, *_ in ends:
        if later := [(p - page, -1 if pos is None else pos, i) for i, b, p, pos, _ in opens if b == book and None not in (p, page) and p > page]:
            want[e] = min(later)
    assert {r.elem_id: (r.x.step, -1 if r.x.l is None else r.x.l, r.x.next_id) for r in got.collect()} == want


def test_far_rest_and_long_lines(spark):
    def x(i, text, p, kind="text"):
        return (90_000 + i, "b0", p, 900 + i, kind, (100.0, 600.0, 900.0, 650.0), text, None, "clash")

    long = "the lantern carried the bridge " * 2000
    noise = S.Noise(make(spark, [x(1, "the quiet gar-", 40), x(2, "dens remembered the stone.", 48), x(3, long + "lan-\ntern.  41", 40)], books=6))
    got = {(r.elem_id, r.kind) for r in noise.found().collect()}
    assert {(90_001, "hyphenation"), (90_003, "hyphenation"), (90_003, "page_number")} <= got


def test_suspended_and_own_hyphens():
    good = frozenset({"lantern", "iron-clad", "iron", "clad", "well", "known"})
    assert S.is_cut("lan", "-", "tern", True, good) and S.is_cut("Osk", "-", "vin", True, good) and S.is_cut("xx", "¬", "Yy", True, good)
    assert not S.is_cut("iron", "-", "clad", True, good) and not S.is_cut("Ein", "-", "und", True, good) and not S.is_cut("well", "-", "known", True, good)
