import pytest

from leafwright.llm import markup as M

PROSE = "The committee met in the spring and heard a report on the state of the harbour."


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("<p>x</p>", "x"), ("a<br/>b", "a\nb"), ("# Title\n\ntext", "Title\n\ntext"), ("== Title ==\ntext", "Title\n\ntext"), ("a **b** _c_ `d`", "a b c d"), ("[a](b.png) ![c](d.png)", "a c"),
        ("<ul><li>a</li><li>b &amp; c</li></ul>", "• a\n• b & c"), ("* [[a b|b]]\n* c", "• b\n• c"), ("$$x_1$$ and $y$", "x_1 and y"), (r"\section{A} \emph{b}~\cite{c}", "A\n\n b"),
        ("| a | b |\n|---|---|\n| c | d |", "a\tb\nc\td"), ("```\nx = *a*\n```", "    x = *a*"), ("<|ref|>text<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|>\nBody", "Body"), ("x<ref>{{cite|a}}</ref>", "x"),
        ("\\begin{tabular}{ll}\n\\hline\na & b \\\\\nc & d \\\\\n\\end{tabular}", "a\tb\nc\td"), ("{| class=\"w\"\n|-\n| a || b\n|}", "a\tb"), ("<table><tr><td>a</td><td>b</td></tr></table>", "a\tb"),
        ("'''bold''' and ''it''", "bold and it"), ("\\begin{equation}\na=b\n\\end{equation}", "a=b"), ("", ""), (None, None), (PROSE, PROSE),
    ],
)
def test_clean_and_found(spark, text, wanted):
    assert M.clean(text) == wanted
    df = spark.createDataFrame([("k", "e", f"{PROSE}\n\n{text}" if text else text)], "id string, engine string, t string")
    assert (M.markup_tokens(df, ["id"], "engine", "t").count() == 1) == (text is not None and wanted != text) or text.startswith("* ")


@pytest.mark.parametrize("t", ["p < 0.05 and q > 0.2", "costs $6.6 million to $12 million", "0.46** and 1.34***", "A 5 * 7 grid ~ 89 cells", "P(A|B) holds", "[24, 47] and [3]", "• a\n– b\n1. c", "file_name_2 and x_1", "#97 of R&D", "Smith & Wesson", "a.\nTo be read >", "- 12 -", "x2 = a + 4x", ""])
def test_printed_signs_are_no_markup(t):
    assert M.tokens(t) == []


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "id string, engine string, t string, names string")


def templates(pages):
    out = {}
    for r in M.template_tokens(pages).collect():
        out.setdefault((r.source, r["class"]), []).append((r["rank"], r.name, r.parent))
    return out


def test_templates(spark):
    rows = [(f"p{i}", "Engine", f"<h2>T{i}</h2>\n<ul>" + "<li>a</li>" * (i % 3 + 1) + f"</ul>\n<p>{PROSE}</p><p>{PROSE}</p>") for i in range(9)] + [("x", "engine", "<b>once</b> " + PROSE), ("n", None, None), ("e", "engine", "")]
    df = frame(spark, rows)
    pages = M.page_tokens(df.unionByName(df), ["id"], "engine", "t")
    out = templates(pages)
    members = {tuple(n for _, n, _ in sorted(v, key=lambda x: x[0])): (c, v[0][2]) for (_, c), v in out.items()}
    # the lists occur as often as the headings, so they are of one class
    assert set(members) == {("tag <h2", "tag </h2", "tag <ul", "tag </ul"), ("tag <li", "tag </li"), ("tag <p", "tag </p")}
    assert members["tag <li", "tag </li"][1] == members["tag <h2", "tag </h2", "tag <ul", "tag </ul"][0] and members["tag <p", "tag </p"][1] is None
    found = {r.id: r for r in M.markup_tokens(df.unionByName(df), ["id"], "engine", "t").collect()}
    assert len(found) == 10 and not found["x"].by_class and all(r.by_class for k, r in found.items() if k != "x")
    assert M.markup_tokens(df.limit(0), ["id"], "engine", "t").count() == 0


def test_classes_that_pages_disobey_are_printed_text(spark):
    rows = [(f"p{i}", "e", f"</b>{PROSE}<b> <p>{PROSE}</p>" if i % 2 else f"<b>{PROSE}</b> <p>{PROSE}</p>") for i in range(20)] + [("lone", "e", f"<b>{PROSE}</b>")] + [(f"q{i}", "f", f"<i>{PROSE}</i>") for i in range(2)]
    df = frame(spark, rows)
    judged = {(r.source, r.name): (r.by, r.markup) for r in M.decisions(M.page_tokens(df, ["id"], "engine", "t")).collect()}
    assert judged == {("e", "tag <b"): ("class", False), ("e", "tag </b"): ("class", False), ("e", "tag <p"): ("class", True), ("e", "tag </p"): ("class", True), ("f", "tag <i"): ("grammar", True), ("f", "tag </i"): ("grammar", True)}
    assert {r.id for r in M.markup_tokens(df, ["id"], "engine", "t").collect()} == {f"p{i}" for i in range(20)} | {"q0", "q1"}
    cleaned = {r.id: r.clean_text for r in M.clean_texts(df, ["id"], "t", "engine").collect()}
    assert cleaned["lone"] == f"<b>{PROSE}</b>" and cleaned["q0"] == PROSE and cleaned["p0"] == f"<b>{PROSE}</b>\n\n{PROSE}"


def test_instances_that_overlap_disobey():
    good, inside = M.parse([0, 1, 2, 3, 0, 1, 3, 2], [7, 7, 8, 8], [0.0, 0.1, 0.2, 0.3][: len([7, 7, 8, 8])])
    assert good == {7: True, 8: False} and inside == {7: None, 8: None}
    good, inside = M.parse([0, 2, 1, 3], [7, 7, 8, 8], [0.0, 0.1, 0.2, 0.3][: len([7, 7, 8, 8])])
    assert good == {7: False, 8: False}
    good, inside = M.parse([0, 2, 0, 2, 3, 1, 3, 1], [7, 7, 8, 8], [0.0, 0.1, 0.2, 0.3][: len([7, 7, 8, 8])])
    assert inside == {7: None, 8: 7}
    good, inside = M.parse([0, 0, 1, 1, 2], [7, 7, None], [0.0, 0.1, 0.2, 0.3][: len([7, 7, None])])
    assert good == {7: True}


def test_a_small_source_is_judged_by_all_sources(spark):
    rows = [(f"p{i}", "big", f"<b>{PROSE}</b>") for i in range(9)] + [("one", "small", f"<b>{PROSE}</b>")]
    found = {r.id: r.by_class for r in M.markup_tokens(frame(spark, rows), ["id"], "engine", "t").collect()}
    assert len(found) == 10 and found["one"]


def test_cut_texts_leave_the_classes_whole(spark):
    rows = [(f"p{i}", "e", f"<b>{PROSE}</b>" * (1 + i % 2)) for i in range(9)] + [(f"c{i}", "e", f"<b>{PROSE}") for i in range(4)]
    pages = M.page_tokens(frame(spark, rows), ["id"], "engine", "t")
    assert [sorted(n for _, n, _ in v) for v in templates(pages).values()] == [["tag </b", "tag <b"]]
    assert M.markup_tokens(frame(spark, rows), ["id"], "engine", "t").count() == 13


def test_slots(spark):
    rows = [(f"p{i}", "e", f"<h2>T{i}</h2>" + "".join(f"<li>a{j}</li>" for j in range(i % 3 + 1)) + f" **b{i}** {PROSE}" * 2) for i in range(9)]
    out = [(r.name, r.content) for r in M.template_slots(frame(spark, rows + rows), ["id"], "engine", "t").where("id = 'p1'").orderBy("slot").collect()]
    assert out == [("tag <h2", "T1"), ("tag <li", "a0"), ("tag <li", "a1"), ("strong", "b1"), ("strong", "b1")]


STRUCTURE = {  # what must be left of each kind of structure
    "heading": [("# A {x}", "A {x}"), ("== A {x} ==", "A {x}"), ("<h2>A {x}</h2>", "A {x}"), (r"\section{A {x}}".replace("{x}", "x"), "A x")],
    "list": [("<ul><li>a {x}</li></ul>", "• a {x}"), ("* a {x}\n* b", "• a {x}"), ("\\begin{itemize}\n\\item a\n\\end{itemize}", "• a")],
    "code": [("```\na = b_{x}\n```", "    a = b_{x}"), ("`f({x})`", "f({x})"), ("<pre>a\n b</pre>", "    a\n     b")],
    "formula": [("$a_{x}$", "a_{x}"), ("$$a_{x}$$", "a_{x}"), ("\\begin{equation}a^2\\end{equation}", "a^2"), (r"\(a_1\)", "a_1"), ("$" + "x+" * 150 + "y$", "x+" * 150 + "y")],
    "table": [("| a | {x} |\n|---|---|\n| 1 | 2 |", "a\t{x}\n1\t2"), ("<table><tr><td>a</td><td>{x}</td></tr></table>", "a\t{x}"), ("{| class=\"w\"\n|-\n| a || b\n|}", "a\tb")],
}


@pytest.mark.parametrize("kind", STRUCTURE)
def test_structure_is_kept(kind):
    for text, left in STRUCTURE[kind]:
        got = M.clean(f"{PROSE}\n\n{text}\n\n{PROSE}")
        assert left in got and got.startswith(PROSE) and got.endswith(PROSE)


def test_single_items_need_a_template(spark):
    row = lambda i, t: (str(i), "e", t)
    alone = spark.createDataFrame([row(0, f"* {PROSE}")], "id string, engine string, t string")
    assert M.markup_tokens(alone, ["id"], "engine", "t").count() == 0
    many = spark.createDataFrame([row(i, f"* {PROSE}\n* **b{i}** c {PROSE}") for i in range(5)], "id string, engine string, t string")
    assert M.markup_tokens(many, ["id"], "engine", "t").count() == 5


def test_broken_characters_are_no_markup(spark):
    df = spark.createDataFrame([("a", "e", "l!1_'|_ _ii_ `.` ¦▪|` *x* " * 20)], "id string, engine string, t string")
    assert M.markup_tokens(df, ["id"], "engine", "t").count() == 0


def test_clean_is_linear_enough():
    M.clean("<p>a **b** $c$ [d](e)</p>\n" * 3000)
    M.clean("* " * 20_000 + "[" * 5000)
