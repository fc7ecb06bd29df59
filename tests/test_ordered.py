import random

from pyspark.sql import functions as F

from quire.operators import ordered


def test_equal_to_a_pass_in_order(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(0, 400), k, k, rng.randrange(0, 3)) for k in range(500)]
    df = spark.createDataFrame(rows, "book_id string, page_index int, list_pos int, elem_id bigint, v int")
    total, before, want = {}, {}, {}
    for b, p, pos, e, v in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        total[b] = total.get(b, 0) + v
        want[e] = (total[b], before.get(b))
        before[b] = v
    out = ordered.previous(ordered.running_sum(df, F.col("v"), "s"), ("v",), "p_")
    assert {r.elem_id: (r.s, r.p_v) for r in out.collect()} == want
    assert ordered.running_sum(df.limit(0), F.col("v"), "s").count() == 0
