import itertools
import random

import pytest
from pyspark.sql import functions as F

from leafwright.operators import assembly, benchmark, consensus, figures, latex, routing

READING = "doc_id string, page_num int, attempt_seq int, engine string, text string, status string, failure_mode string, audit_passed boolean, confidence double"


def readings(spark, rows):
    return spark.createDataFrame([(d, p, s, e, t, st, "none", ok, c) for d, p, s, e, t, st, ok, c in rows], READING)


def test_best_reading(spark):
    df = readings(
        spark,
        [
            ("a", 1, 1, "x", "one two three", "success", True, 0.5), ("a", 1, 2, "y", "one two three four five six", "success", True, 0.5),
            ("a", 2, 1, "x", "same", "success", True, 0.5), ("a", 2, 2, "y", "same", "success", True, 0.5), ("a", 2, 2, "y", "same", "success", True, 0.5),
            ("a", 3, 1, "x", None, "success", True, 0.5), ("a", 3, 2, "y", " ", "success", None, None),
            ("a", 4, 1, "x", "long long long long", "error", True, 0.9), ("a", 4, 2, "y", "ok", "success", False, 0.1),
        ],
    )
    out = {r.page_num: r for r in consensus.best_reading(df).collect()}
    assert [out[p].attempt_seq for p in (1, 2, 3, 4)] == [2, 1, 1, 2] and not out[3].viable and out[2].n_attempts == 2
    assert consensus.best_reading(df.limit(0)).count() == 0


def test_grounded_reading(spark):
    df = readings(spark, [("a", 1, 1, "x", "the dog bit the man and ran off with it " * 4, "success", True, 0.9), ("a", 1, 2, "y", "the dog bit the man", "success", True, 0.1)])
    truth = spark.createDataFrame([("a", 1, "The dog bit the man")], "doc_id string, page_num int, reference string")
    assert consensus.best_reading(df, truth).first().attempt_seq == 2


def test_agreement(spark):
    texts = ["the dog bit the man", "the man bit the dog", "the dog bit the man", "", "entirely other words here now then"]
    df = readings(spark, [("a", 1, i, "x", t, "success", True, 0.5) for i, t in enumerate(texts)] + [("a", 2, 1, "x", "alone", "success", True, 0.5)])

    def wer(h, r):
        from leafwright.functions.distance import edit_distance

        return edit_distance(h.split(), r.split()) / len(r.split()) if r.split() else float(bool(h.split()))

    want = [max(0.0, 1 - wer(a, b)) for a, b in itertools.combinations(texts, 2)]
    out = {r.page_num: r.agreement for r in consensus.agreement(df).collect()}
    assert out[1] == pytest.approx(sum(want) / len(want)) and out[2] == 1.0


def test_discrepancies(spark):
    df = readings(spark, [("a", 1, 1, "x", "a b c d", "success", True, 0.5), ("a", 1, 2, "y", "a b", "success", False, 0.5), ("a", 2, 1, "x", "a", "success", True, 0.5)])
    out = {r.page_num: r for r in consensus.discrepancies(df).collect()}
    assert out[1].wide and out[1].divided and not out[2].wide and not out[2].divided


def test_arbiter(spark):
    df = spark.createDataFrame([('x {"selected": 2, "text": "t"} y',), ('{"selected": 9, "text": "t"}',), ('{"text": " "}',), ("nothing",)], "r string")
    out = [r.c for r in df.select(consensus.arbiter_choice(F.col("r"), F.array(F.lit("a"), F.lit("b"))).alias("c")).collect()]
    assert [c and c.engine for c in out] == ["b", "llm-merged", None, None]


def test_formulas():
    assert latex.merged("no formula, as follows: end", "$$a+b$$ and $c$") == ("no formula, as follows:\n\n$$a+b$$\n\n end", 1)
    assert latex.merged(r"keep $\alpha + x$ here", r"$\alpha  +  x + 1$") == (r"keep $\alpha  +  x + 1$ here", 1)
    assert latex.merged("base", "nothing") == ("base", 0) and latex.merged("x", "$$a$$") == ("x", 0)
    assert [(c, d) for _, c, _, d in latex.blocks(r"a $x$ b $$y$$ \begin{align*}z\end{align*}")] == [("$x$", False), ("$$y$$", True), (r"\begin{align*}z\end{align*}", True)]


def test_reconciled(spark):
    df = readings(spark, [("a", 1, 1, "deepseek-vllm", r"see $\beta$", "success", True, 0.5), ("a", 1, 2, "Nougat", r"$\beta$ ", "success", True, 0.9), ("a", 2, 1, "nougat", "only", "success", True, 0.4)])
    out = {r.page_num: r for r in latex.reconciled(df).collect()}
    assert out[1].engines == ["deepseek-vllm", "nougat"] and out[1].confidence == 0.9 and out[2].text == "only" and out[2].n_merged == 0


def test_assembly(spark):
    df = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one words"), ("a", 3, ""), ("a", 4, None), ("b", 1, None)], "doc_id string, page_num int, text string")
    out = assembly.joined(df, ["doc_id"], "page_num", "text").collect()
    assert [(r.doc_id, r.text, r.n_parts) for r in out] == [("a", "one words\n\n---\n\ntwo", 2)]
    back = assembly.split_pages(assembly.joined(df, ["doc_id"], "page_num", "text"), ["doc_id"], "text").orderBy("page_num").collect()
    assert [(r.page_num, r.text) for r in back] == [(1, "one words"), (2, "two")]


def test_page_texts(spark):
    pages = spark.createDataFrame([("a", 1, "native"), ("a", 2, "native"), ("a", 3, " "), ("a", 4, None)], "doc_id string, page_num int, native_text string")
    best = spark.createDataFrame([("a", 1, "best", True), ("a", 2, "bad", False), ("a", 3, "bad", False), ("z", 9, "lost", True)], "doc_id string, page_num int, text string, audit_passed boolean")
    assert {r.page_num: r.text for r in assembly.page_texts(pages, best).collect()} == {1: "best", 2: "native", 3: "bad", 4: None}


@pytest.mark.parametrize(("n", "size"), [(40, 20), (41, 20), (1, 20), (3, 1), (0, 5)])
def test_fixed_chunks(spark, n, size):
    out = assembly.fixed_chunks(spark.createDataFrame([("a", n), ("b", None)], "doc_id string, p int"), "p", size).orderBy("chunk").collect()
    assert [x for r in out for x in range(r.first_page, r.last_page + 1)] == list(range(1, n + 1)) and all(r.n_pages <= size for r in out)


def test_chunk_size():
    with pytest.raises(ValueError):
        assembly.fixed_chunks(None, "p", 0)


def components(boxes, gap):
    left, out = dict(boxes), []
    while left:
        _, first = left.popitem()
        group, todo = [], [first]
        while todo:
            b = todo.pop()
            group.append(b)
            near = [k for k, c in left.items() if max(b[0], c[0]) - min(b[2], c[2]) <= gap and max(b[1], c[1]) - min(b[3], c[3]) <= gap]
            todo += [left.pop(k) for k in near]
        out.append((min(b[0] for b in group), min(b[1] for b in group), max(b[2] for b in group), max(b[3] for b in group), len(group)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_are_components(spark, seed):
    rng = random.Random(seed)
    boxes = {(p, i): (x, y, x + rng.uniform(1, 60), y + rng.uniform(1, 60)) for p in range(3) for i in range(40) for x, y in [(rng.uniform(0, 900), rng.uniform(0, 900))]}
    chain = {(9, i): (i * 50.0, 0.0, i * 50.0 + 25, 10.0) for i in range(30)}
    rows = [(p, i, *b) for (p, i), b in (boxes | chain).items()]
    rows += rows[:3] + [(0, 99, None, 0.0, 1.0, 1.0)]
    rng.shuffle(rows)
    out = figures.clustered(spark.createDataFrame(rows, "page int, box_id int, x0 double, y0 double, x1 double, y1 double"), ["page"]).collect()
    for p in (0, 1, 2, 9):
        mine = {i: b for (q, i), b in (boxes | chain).items() if q == p}
        assert sorted((r.x0, r.y0, r.x1, r.y1, r.n_boxes) for r in out if r.page == p) == components(mine, figures.GAP)


def test_figure_filters(spark):
    df = spark.createDataFrame([(1, 100.0, 200.0, 300.0, 400.0, 9), (2, 100.0, 200.0, 300.0, 400.0, 2), (3, 0.0, 0.0, 40.0, 400.0, 9), (4, 100.0, 0.0, 500.0, 100.0, 9)], "k int, x0 double, y0 double, x1 double, y1 double, n_boxes int")
    sized = df.withColumns({"w": F.lit(600.0), "h": F.lit(800.0)})
    assert [r.k for r in figures.figure_regions(sized, "w", "h").collect()] == [1]
    assert sorted(r.k for r in figures.image_regions(df).collect()) == [1, 2, 4]


def test_numbered(spark):
    df = spark.createDataFrame([("d", p, float(i), 0.0, 1.0, 1.0, f"{p}-{i}") for p in range(1, 12) for i in range(5)], "doc string, page int, y0 double, x0 double, x1 double, y1 double, name string")
    out = figures.numbered(df, "doc", "page").orderBy("figure_num").collect()
    assert [r.figure_num for r in out] == list(range(1, 26)) and [r.name for r in out[:4]] == ["1-0", "1-1", "1-2", "2-0"]


RUNS = [("paper_mixed", "gemini", 0.08, 5.0, "none", "mixed"), ("paper_math", "gemini", 0.12, 6.0, "none", "math"), ("paper_mixed", "deepseek", 0.20, 3.0, "none", "mixed"), ("paper_math", "deepseek", 0.05, 2.0, "none", "math"), ("paper_mixed", "nougat", None, 30.0, "timeout", "mixed"), ("paper_math", "nougat", 0.15, 4.0, "none", "math")]


def test_calibration(spark):
    df = spark.createDataFrame(RUNS, "paper string, engine string, wer double, processing_time double, failure_mode string, category string")
    means = {r.engine: (round(r.mean_wer, 3), r.mean_time, r.n_scored) for r in benchmark.engine_summary(df).collect()}
    assert means == {"gemini": (0.1, 5.5, 2), "deepseek": (0.125, 2.5, 2), "nougat": (0.15, 17.0, 1)}
    assert {r.category: r.chain for r in benchmark.chains(benchmark.ranking(df)).collect()} == {"mixed": ["gemini", "deepseek", "nougat"], "math": ["deepseek", "gemini", "nougat"]}
    assert [(r.engine, r.recovered) for r in benchmark.recovery(df).collect()] == [("nougat", 0.0)]
    prof = {r.engine: r for r in benchmark.profiles(df).collect()}
    assert prof["nougat"].category_wer == {"math": 0.15, "_all": 0.15} and prof["nougat"].recovery == {"timeout": 0.0} and prof["gemini"].recovery is None


def test_page_scores(spark):
    df = readings(spark, [("a", 1, 1, "X", "a b c", "success", True, 0.5), ("a", 1, 2, "x", None, "success", True, 0.5), ("a", 9, 1, "x", "no truth", "success", True, 0.5)])
    truth = spark.createDataFrame([("a", 1, "a b d"), ("a", 1, "a b d"), ("a", 2, None)], "doc_id string, page_num int, truth string")
    out = {r.attempt_seq: r for r in benchmark.page_scores(df, truth).collect()}
    assert set(out) == {1, 2} and out[1].wer == pytest.approx(1 / 3) and out[1].cer == pytest.approx(1 / 5) and out[2].wer == 1.0 and out[2].word_ratio == 0.0


ALL = list(routing.ENGINES)


@pytest.mark.parametrize(
    ("failure", "tried", "want"),
    [
        ("hallucination", ["deepseek"], "gemini"), ("hallucination", ["gemini"], "mistral"), ("refusal", ["gemini"], "mistral"), ("refusal", ["gemini", "mistral", "deepseek"], "nougat"),
        ("garbage", [], "gemini"), ("timeout", [], "glm"), ("timeout", ["glm"], "nougat"), ("cli_error", ["gemini"], "mistral"), ("none", ALL, None),
    ],
)
def test_next_engine(spark, failure, tried, want):
    df = spark.createDataFrame([(failure, tried)], "f string, t array<string>")
    chain, enabled = F.array(F.lit("gemini"), F.lit("mistral")), F.array(*map(F.lit, ALL))
    assert df.select(routing.next_engine(F.col("f"), F.col("t"), chain, F.lit("deepseek"), enabled).alias("e")).first().e == want
