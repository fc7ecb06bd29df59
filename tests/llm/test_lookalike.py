import pytest

from quire.llm import lookalike as L


@pytest.mark.parametrize(
    "a, b",
    [
        ("Chaptеr 5 Patiеnt", "Chapter 5 Patient"), ("Ｌａ ｌｉｂ", "La lib"), ("第８８章 ⽯阶 Ｍａｐ", "第88章 石阶 Map"), ("Nоtе", "Note"), ("La rivie\u0300re", "La rivière"), ("ﬃcial", "fficial"), ("人ロ", "人口"), ("\uf9ba", "了"),
        ("a\u200bb\u00a0c\u2011d", "ab c-d"), ("Ёё", "Ëë"), ("⻅", "见"),
    ],
)
def test_equal_looks_compare_equal(a, b):
    assert a != b and L.consistent(a) == L.consistent(b)


@pytest.mark.parametrize("a, b", [("①", "1"), ("x²", "x2"), ("The", "THE"), ("kühl", "kuhl"), ("a，b", "a,b"), ("Москва", "Mockba"), ("曰", "日"), ("a b", "a  b")])
def test_different_looks_stay_apart(a, b):
    assert L.consistent(a) != L.consistent(b)


def test_edges_and_idempotence():
    assert L.consistent(None) is None and L.consistent("") == ""
    long = "Chaptеr " * 50_000
    assert L.consistent(long) == "Chapter " * 50_000
    for t in ("Ｎоte ⽯\u200d", "Ёлка", "ο", "ﬁ²①", "ニ", "Ａ，Ｂ"):
        assert L.consistent(L.consistent(t)) == L.consistent(t)


def test_script_sets():
    assert L.scripts("Chaptеr") == {"LATIN"} and "CYRILLIC" in L.scripts("сор") and "LATIN" in L.scripts("сор") and L.scripts("123") is None


def test_join_rows(spark):
    t = spark.createDataFrame([(1, "b", "Nоte", "x"), (1, "b", "Nоte", "x"), (2, "b", None, "x"), (3, None, "Note", "x"), (4, "b", "", "x"), (5, "c", "Note", "x")], "entry_id bigint, book_id string, title string, form string")
    e = spark.createDataFrame([(10, "b", "Note", 1), (10, "b", "Note", 1), (11, "b", "Nоte", 1), (12, "b", None, 1), (13, "b", "Note" * 5000, 1), (14, "b", "", 1)], "elem_id bigint, book_id string, text string, f int")
    assert sorted(map(tuple, L.same_looking(t, e).collect())) == [(1, 10)]
    assert L.same_looking(t.limit(0), e).count() == 0 and L.same_looking(t, e.limit(0)).count() == 0
    out = L.normalise(e, "text").orderBy("elem_id").collect()
    assert len(out) == 6 and out[2].consistent_text == "Note" and out[2].consistent_text_changed


def test_join_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    pool = ["Note 1", "Nоte 1", "Note１", "Note\u200b 1", "note 1", "No te 1", "石阶", "⽯阶"]
    t = [(i, rng.choice("ab"), rng.choice(pool)) for i in range(30)]
    e = [(100 + i, rng.choice("ab"), rng.choice(pool)) for i in range(40)]
    want = {(i, j) for i, b, x in t for j, c, y in e if b == c and x != y and L.consistent(x) == L.consistent(y)}
    got = L.same_looking(spark.createDataFrame(t, "entry_id bigint, book_id string, title string"), spark.createDataFrame(e, "elem_id bigint, book_id string, text string"))
    assert {tuple(r) for r in got.collect()} == want
