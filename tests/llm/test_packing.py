import random
from collections import defaultdict

import pytest

from leafwright.llm import packing as P


@pytest.mark.parametrize("seed", range(30))
def test_pack(seed):
    rng = random.Random(seed)
    capacity = rng.randint(5, 60)
    sizes = [rng.randint(1, capacity) for _ in range(rng.randrange(120))]
    bins = P.pack(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(0 < sum(sizes[i] for i in b) <= capacity for b in bins)
    assert len(bins) <= max(1, -(-sum(sizes) // capacity)) * 1.3 + 1 if sizes else bins == []


def test_two_fit_replaces_the_smallest():
    assert sorted(sorted([6, 3, 2, 2][i] for i in b) for b in P.pack([6, 3, 2, 2], 10)) == [[2, 2, 6], [3]]


def test_containers(spark):
    word = "harbour "
    rows = [(i, word * (i % 40)) for i in range(300)] + [(1000, word * 700), (1001, None), (1002, ""), (7, word * 7), (None, "x")]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, part string")
    limits = spark.createDataFrame([("small", 64), ("small", 64), ("none", None), ("big", 256)], "pack_name string, capacity_tokens int")
    out = P.packed(docs, "doc_id", "text", limits).collect()
    encode = P.tokenizer(P.default_tokenizer()).encode_ordinary
    want = {k: len(encode(t)) for k, t in rows if t}
    for name, capacity in (("small", 64), ("big", 256)):
        mine = [r for r in out if r.pack_name == name]
        tokens, held = defaultdict(int), defaultdict(int)
        for r in mine:
            tokens[r.doc_id] += r.tokens
            held[r.container] += r.tokens
        assert tokens == want and max(held.values()) <= capacity
        assert all(len([r for r in mine if r.doc_id == k]) == 1 for k, n in want.items() if n <= capacity)
        assert all(abs(r.fill - held[r.container] / capacity) < 1e-9 for r in mine)
        assert len(held) <= 1.05 * sum(want.values()) / capacity + 2
    assert P.packed(docs.limit(0), "doc_id", "text", limits).count() == 0
