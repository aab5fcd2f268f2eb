import random

import pytest

from leafwright.llm import splitting as S


@pytest.mark.parametrize("seed", range(40))
def test_pieces(seed):
    rng = random.Random(seed)
    n, limit = rng.randint(1, 200), rng.randint(1, 25)
    overlap = rng.randint(0, 4)
    out = S.pieces(n, limit, overlap, {rng.randint(2, 210): rng.randint(1, 4) for _ in range(rng.randint(0, 30))})
    o = max(0, min(overlap, limit - 1))
    assert out[0][0] == 1 and out[-1][1] == n and all(b - a + 1 <= limit for a, b in out)
    assert all(out[i][0] == out[i - 1][1] + 1 - o and out[i][1] > out[i - 1][1] for i in range(1, len(out)))
    free = [(b - (a + (o if a > 1 else 0))) + 1 for a, b in out]  # what a piece holds beside its overlap
    assert all(x + y + (o if i else 0) > limit for i, (x, y) in enumerate(zip(free, free[1:])))  # no two could be merged


def test_natural_boundaries():
    assert S.pieces(20, 10, 0, {9: 5, 15: 5}) == [(1, 8), (9, 14), (15, 20)]
    assert S.pieces(12, 8, 2, {7: 1}) == [(1, 6), (5, 12)]
    assert S.pieces(5, 10, 1, {}) == [(1, 5)] and S.pieces(3, 1, 5, {}) == [(1, 1), (2, 2), (3, 3)]


def tables(spark):
    handles = [("a", 50, None, "1"), ("a", 30, None, "2"), ("a", 30, None, "2"), ("b", None, "fast", "1"), ("c", 0, "fast", "1"), ("d", 5, "default", "1"), ("e", 99, "nobody", "1"), ("f", None, "default", None), ("g", 40, "unset", "1")]
    pages = [("b", 13), ("b", 2), ("c", 12), ("b", 13), ("z", 99)]
    configs = [("default", 20, 2), ("default", 20, 2), ("fast", 12, None), ("unset", None, 1)]
    outline = [("a", 12, 1), ("a", 12, 1), ("a", 1, 1), ("a", 99, 1), ("a", None, 1), ("a", 20, None), ("q", 3, 1)]
    return (
        spark.createDataFrame([(*r, 1) for r in handles], "doc_id string, page_count int, profile string, added_at string, n_pages int"),
        spark.createDataFrame(pages, "doc_id string, page_num int"),
        spark.createDataFrame(configs, "profile string, chunk_size int, chunk_overlap int"),
        spark.createDataFrame(outline, "doc_id string, page_num int, depth int"),
    )


def test_documents(spark):
    h, p, c, o = tables(spark)
    big = S.oversized(h, p, c)
    assert sorted(map(tuple, big.collect())) == [("a", 30, 20, 2), ("b", 13, 12, 0)]
    out = S.split_documents(big.unionByName(big), o).orderBy("doc_id", "piece").collect()
    assert [(r.doc_id, r.piece, r.first_page, r.last_page) for r in out] == [("a", 1, 1, 19), ("a", 2, 18, 30), ("b", 1, 1, 12), ("b", 2, 13, 13)]
    assert S.split_documents(big, o.limit(0)).count() == 4 and S.split_documents(big.limit(0), o).count() == 0


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 50)
    big = spark.createDataFrame([("a", 130, 20, 2)], "doc_id string, n_pages int, chunk_size int, chunk_overlap int")
    out = S.split_documents(big, spark.createDataFrame([], "doc_id string, page_num int, depth int")).orderBy("piece").collect()
    assert [x for r in out for x in range(r.first_page + (2 if r.first_page > 1 else 0), r.last_page + 1)] == list(range(1, 131)) and all(r.last_page - r.first_page < 20 for r in out)


def test_blocks_end_at_strong_boundaries(spark, monkeypatch):
    big = spark.createDataFrame([("a", 130, 20, 2), ("b", 30, 20, 0), ("c", 50, 20, 0)], "doc_id string, n_pages int, chunk_size int, chunk_overlap int")
    outline = spark.createDataFrame([("a", 41, 3), ("a", 45, 1), ("a", 51, 2), ("a", 97, 1), ("a", 12, 2), ("b", 15, 1), ("c", 48, 1), ("c", 12, 1)], "doc_id string, page_num int, depth int")
    whole = sorted(map(tuple, S.split_documents(big, outline).collect()))
    monkeypatch.setattr(S, "BLOCK", 50)
    out = sorted(map(tuple, S.split_documents(big, outline).collect()))
    assert [r for r in out if r[0] != "a"] == [r for r in whole if r[0] != "a"]
    a = [r for r in out if r[0] == "a"]
    starts = [first + (2 if first > 1 else 0) for _, _, first, _ in a]
    assert {12, 45, 97} <= set(starts) and starts[0] == 1 and a[-1][3] == 130
    assert all(x[3] + 1 == s for x, s in zip(a, starts[1:])) and all(last - first < 20 for _, _, first, last in a)
