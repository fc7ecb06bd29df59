import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T


@pytest.fixture
def apply(spark):
    def go(values, *columns):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]

    return go


CJK = re.compile(f"[{'一-鿿㐀-䶿　-〿＀-￯'}]")


def test_full_width_marks_follow_the_sequential_rule(apply):
    full = dict(zip(T.HALF, T.FULL))
    rng = random.Random(2)
    texts = ["".join(rng.choice("中文ab ,.!?:;。") for _ in range(rng.randrange(12))) for _ in range(400)]

    def fold(t):
        out = ""
        for i, c in enumerate(t):
            if c in full:
                before, after = bool(out) and bool(CJK.match(out[-1])), i + 1 < len(t) and bool(CJK.match(t[i + 1]))
                c = full[c] if before or (c != "." and after) else c
            out += c
        return out

    assert apply(texts, T.full_width_marks(F.col("t"))) == [fold(t) for t in texts]


def test_quotes_and_marks(apply):
    assert apply(['中"a"和"b\'c\'', "no 'cjk'", "好。。。！！", None], T.normalise_punctuation(F.col("t"))) == ["中“a”和“b‘c’", "no 'cjk'", "好。！", None]


def test_predicates(apply):
    assert apply(["完。", "开 ", "", "end.", "he said”"], T.ends_closed(F.col("t"))) == [True, False, True, False, True]
    assert apply(["第一章 起", " x", "", "正文", "chapter IV", "第二节"], T.starts_block(F.col("t"))) == [True, True, True, False, True, True]
    assert apply(["a/1\nb／ 2\nc", "x"], T.toc_lines(F.col("t"))) == [2, 0]
    assert apply(["a\nb/3\n\n", "b/3\na", ""], T.last_is_toc_line(F.col("t"))) == [True, False, False]
    assert apply(["1.2.3 Title", "30", "4 x", "a 1"], T.numbering_depth(F.col("t"))) == [3, None, 1, None]
    assert apply(["2019年6月", "2019-06"], T.plain_date(F.col("t"))) == ["2019.6", "2019.06"]
    assert apply([" 张 三 李 x y"], T.clean_field(F.col("t"))) == ["张三李 x y"]


def test_similarity_keeps_argument_order(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), (None, "a"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(T.ratcliff("a", "b")).collect()]
    assert got == [0.25, 0.5, None, 1.0]
    assert difflib.SequenceMatcher(None, "tide", "diet").ratio() == 0.25


def test_misc(apply, spark):
    assert apply(["第十六卷大荒西经第十七卷大荒北经", "单"], T.split_volumes(F.col("t"))) == [["第十六卷大荒西经", "第十七卷大荒北经"], ["单"]]
    assert apply(["", "CONTENTS", "12", "![x", "a/2", "长" * 31, "第一卷" + "长" * 40], T.is_toc_noise(F.col("t"))) == [True, True, True, True, False, True, False]
    assert apply(["::: {.a .b}", ":::", "x"], T.div_classes(F.col("t"))) == [["a", "b"], None, None]
    assert apply(["a*a ?b"], T.preserved_counts(F.col("t"))) == [{"a": 2, "b": 1}]
    assert apply([">[low-confidence] 一\n二 [需校对]\n<!-- page: 3 -->\n三"], T.strip_review_marks(F.col("t"))) == ["一\n二\n三"]
    df = spark.createDataFrame([("1010", "1001"), ("1", "11")], "a string, b string")
    assert [r[0] for r in df.select(T.hamming(F.col("a"), F.col("b"))).collect()] == [2, 999]
    assert spark.range(1).select(T.join_seam(F.lit("中 "), F.lit("文")), T.join_seam(F.lit("a"), F.lit("b"))).first() == ("中文", "a b")
    assert spark.range(1).select(T.human_size(F.lit(10)), T.human_size(F.lit(2048)), T.human_size(F.lit(5 << 20))).first() == ("10 B", "2.0 KB", "5.0 MB")
    assert spark.range(1).select(T.data_url(F.lit(b"a"), F.lit("x.JPG"))).first()[0] == "data:image/jpeg;base64,YQ=="


def test_review_marks_with_crlf(spark, tmp_path):
    import hashlib
    import re

    from quire.plans import reference

    texts = [">[low-confidence] 一\n二 [需校对]\n<!-- page: 3 -->\n三\n\nx [UNCLEAR] \n<!-- page: 4 -->", "a\n<!-- page: 5 --> \n>[low-confidence]  b [UNCLEAR]", "plain", ""]
    rows = [(i, t) for i, t in enumerate(texts + [t.replace("\n", "\r\n") for t in texts])] + [(99, None)]
    spark.createDataFrame(rows, "content_id bigint, book_md string").write.parquet(f"{tmp_path}/book_content.parquet")

    def brute(t):
        out = ""
        for line, end in re.findall(r"([^\r\n]*)(\r?\n|$)", t):
            if not re.fullmatch(r"<!-- page: \d+ -->[ \t]*", line):
                out += re.sub(r"[ \t]*(?:\[UNCLEAR\]|\[需校对\])[ \t]*$", "", re.sub(r"^>\[low-confidence\][ \t]*", "", line)) + end
        return out

    got = {r.content_id: r.md5 for r in reference.QUERIES["all_review_marks_stripped"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(brute(t).encode()).hexdigest() for i, t in rows if t is not None}
