import random

import pytest

from quire.llm import splitting as S


def check(text, most, overlap):
    cuts = S.split(text, most, overlap)
    whole = ""
    for k, (a, b, _) in enumerate(cuts):
        start = a - overlap if k else a
        assert b - start <= most and b > a and start >= 0
        assert a == len(whole)
        whole += text[a:b]
    assert whole == text
    return cuts


def test_pieces_give_the_text_back():
    rng = random.Random(7)
    for _ in range(60):
        parts = ["第一句。", "A sentence here. ", "\n\n", "# head\n", "```\ncode\n\nmore\n```\n", "长" * rng.randrange(1, 90), "word " * rng.randrange(1, 20), "\r\n", "e\u0301" * rng.randrange(1, 30), "- item\n"]
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 80)))
        check(text, rng.choice([60, 100, 257]), rng.choice([0, 5, 20]))


def test_natural_boundaries():
    text = "\n\n".join(f"Paragraph {k}. " + "x y z. " * 12 for k in range(30))
    cuts = check(text, 400, 30)
    assert all(kind == "paragraph" for _, _, kind in cuts[:-1])
    head = ("body. " * 15 + "\n\n# Head\n\n") * 6
    assert all(not head[:b].rstrip().endswith("# Head") for _, b, _ in check(head, 200, 0)[:-1])


def test_dynamic_programme_is_optimal():
    import itertools

    text = "aa. bb. cc dd, ee. ff gg. hh ii. jj. kk. ll"
    most, overlap = 20, 4
    pos, cost, _ = S.boundaries(text, most)
    ideal = (len(text) - overlap) / -(-(len(text) - overlap) // (most - overlap))

    def price(p):
        total = 0.0
        for k, (a, b) in enumerate(zip(p, p[1:])):
            new = pos[b] - pos[a] if k else pos[b] - overlap
            if (k and (pos[b] - pos[a] > most - overlap or pos[a] < overlap)) or (not k and pos[b] > most):
                return float("inf")
            total += S.BALANCE * ((new - ideal) / ideal) ** 2 + cost[b]
        return total

    inner = range(1, len(pos) - 1)
    best = min(price((0, *c, len(pos) - 1)) for n in range(1, 5) for c in itertools.combinations(inner, n))
    got = S.split(text, most, overlap)
    index = {int(p): i for i, p in enumerate(pos)}
    assert abs(price((0, *[index[b] for _, b, _ in got])) - best) < 1e-9


def test_edges(spark):
    assert S.split("", 10, 2) == [(0, 0, "end")] and len(S.split("x" * 10, 10, 2)) == 1
    with pytest.raises(ValueError):
        S.split("x" * 50, 10, 5)
    assert len(check("字" * 100_000, 3000, 150)) > 30
    rows = [(1, "zh", "字" * 40, "k"), (1, "zh", "字" * 40, "k"), (2, None, "x" * 40, "k"), (3, "xx", "y", "k"), (4, "zh", None, "k"), (5, "zh", "", "k"), (None, "zh", "z" * 30, "k")]
    df = spark.createDataFrame(rows, "content_id bigint, lang string, book_md string, piece string")
    got = S.pieces(df, {"zh": (20, 3)})
    n = {}
    for r in got.collect():
        n.setdefault(r.row_id, []).append(r.pieces)
    assert n[2] == [1] and n[3] == [1] and 4 not in n and n[5] == [1] and len(n[1]) == 2 * n[1][0] and n[None][0] == 2
    assert S.pieces(df.limit(0), {}).count() == 0
    limits = spark.createDataFrame([("piece", "zh", "char", 20, None), ("container", None, "token", 5, None)], "use_for string, lang string, unit string, max_size int, overlap int")
    assert S.limits_of(limits) == {"zh": (20, 0)}
