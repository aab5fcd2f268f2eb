import pytest

from leafwright.llm import prose, quality

PROSE = "The committee met in the spring and heard a report on the state of the harbour. Several members asked how the new cranes would be paid for."
GERMAN = "Der Ausschuss trat im Frühjahr zusammen und hörte einen Bericht über den Zustand des Hafens. Mehrere Mitglieder fragten, wie die neuen Kräne bezahlt werden sollten."
LIST = "\n".join(f"• {a} {b} cost" for a in ("old", "new", "spare") for b in ("crane", "rope", "boat", "net"))
TABLE = "Site, Cost, Age\n" + "\n".join(f"harbour {i}, {i * 3}.5, {i}" for i in range(12))
JUNK = "kqx vvz ppl mmt rrw qqs xxz wwq zzk ppt " * 6


@pytest.mark.parametrize(
    ("text", "is_prose"),
    [
        (PROSE, True), (GERMAN, True), (LIST, False), (TABLE, False), (JUNK, False), ("<p>" + PROSE + "</p>", True), (PROSE + "\n\nPage 12", True), (PROSE + " crane" * 200, True),
        (PROSE + "\n\n" + "| a | 1 |\n" * 3, True), ("1.1 Harbours ........ 3\n1.2 Cranes and ropes ......... 7", False), ("(cid:3)(cid:4) " * 40, False),
    ],
)
def test_is_prose(text, is_prose):
    assert quality.is_prose(text) == is_prose


@pytest.mark.parametrize(("text", "language"), [(PROSE, "en"), (GERMAN, "de"), ("La maison est dans les bois avec nous", "fr"), ("Los perros y las casas del pueblo", "es"), ("xyz", "und"), ("", "und")])
def test_language(text, language):
    assert prose.language_of(prose.words_of(text)) == language


def test_not_prose(spark):
    rows = [(f"p{i}", f"{PROSE} This was meeting number {i} of the year.") for i in range(30)] + [("l", LIST), ("t", TABLE), ("j", JUNK), ("n", None), ("e", ""), ("b", " \n"), ("l", LIST), (None, TABLE)]
    df = spark.createDataFrame([(k, t, "clash", 0.0) for k, t in rows], "id string, t string, language string, n_words double")
    assert sorted(str(r.id) for r in quality.not_prose(df, ["id"], "t").collect()) == ["j", "l", "t"]
    assert quality.not_prose(df.limit(0), ["id"], "t").count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([("a", "One two, three!\nfour"), ("a", "One two, three!\nfour"), ("b", None)], "id string, t string")
    r = quality.text_statistics(df, ["id"], "t").collect()
    assert len(r) == 1 and (r[0].n_words, r[0].n_chars, r[0].punctuated_lines, r[0].symbol_ratio) == (4, 20, 0.5, 0.1) and r[0].mean_word_length == 3.75
    assert quality.statistics("x" * 10_000_000)[1] == 1


def test_wrong_counts(spark):
    rows = [("ok", "a b é", 3, 5), ("w", "a b é", 2, 5), ("c", "a b é", 3, 6), ("null", "a b é", None, None), ("half", "a b", None, 4), ("e", "", 7, 7), ("n", None, 7, 7), ("blank", "  ", 1, 2), ("w", "a b é", 2, 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, t string, w int, c int, true_words string")
    assert sorted((r.id, r.true_words, r.true_chars) for r in quality.wrong_counts(df, ["id"], "t", "w", "c").collect()) == [("blank", 0, 2), ("c", 3, 5), ("half", 2, 3), ("w", 3, 5)]


def test_many_tables(spark):
    goods = "crane rope boat net anchor barrel chain engine lamp oar plank sail winch wire".split()
    tables = [(f"t{i}", f"Prices of the goods in list {i}\n" + "\n".join(f"{g}, {j * i}.5, {j}" for j, g in enumerate(goods))) for i in range(20)]
    assert not any(quality.is_prose(t) for _, t in tables)
    df = spark.createDataFrame([(f"p{i}", f"{PROSE} This was meeting number {i} of the year.") for i in range(30)] + tables, "id string, t string")
    assert {r.id for r in quality.not_prose(df, ["id"], "t").collect()} == {k for k, _ in tables}


ITALIAN = (
    "La nave è partita dal porto con il vento di ponente. Il capitano non ha visto la luce del faro sul molo. Per tre ore la ciurma ha cercato di capire la rotta con le stelle. "
    "Il mare era calmo ma la nebbia non dava tregua al timone. Alla fine il capitano ha scelto di attendere la luce del giorno. La nave è rimasta ferma con il motore spento per la notte."
)
POLISH = (
    "Statek wypłynął z portu na początku maja i nie wrócił do domu. Kapitan nie widział światła na molo i czekał na znak od załogi. Na morzu było cicho i nie było słychać fal. "
    "Marynarze czekali na pokładzie i patrzyli na wodę. Nikt z nich nie wiedział, co na nich czeka. Na koniec kapitan wrócił do kajuty i nie mówił nic."
)


@pytest.mark.parametrize("text", [ITALIAN, POLISH])
def test_prose_of_other_languages(text):
    assert quality.is_prose(text)


@pytest.mark.parametrize("text", [
    "\n".join(f"Row {i}, kg, n/a, 1.{i}, yes, 2.{i}" for i in range(40)), "\n".join(f"• Kepwend of grade {i}" for i in range(30)),
    "Kqx vvz ppl mmt rrw. Qqs xxz wwq zzk ppt. Lmm ttv qrs nnb vcc. Bgh jkl mnb vcx zas. Poi uyt rew qas dfg. Hjk lmn bvc xza sdf.", "Xq zt. " * 40,
])
def test_no_prose_in_any_language(text):
    assert not quality.is_prose(text)


SHORT = {
    "pl": "Statek wypłynął z portu na początku maja i nie wrócił do domu. Kapitan nie widział światła na molo i czekał na znak od załogi.",
    "cs": "Loď vyplula z přístavu na začátku května a už se nevrátila domů. Kapitán neviděl světlo na molu a čekal celou noc na znamení posádky.",
    "sv": "Skeppet lämnade hamnen i början av maj och kom aldrig hem igen. Kaptenen såg inte ljuset på piren och väntade hela natten på ett tecken.",
    "ro": "Nava a plecat din port la începutul lunii mai și nu s-a mai întors acasă. Căpitanul nu a văzut lumina de pe dig și a așteptat toată noaptea.",
}
SHORT_JUNK = {
    "words": "Crane rope boat net anchor barrel chain engine. Plank winch wire lamp sail oar harbour market storage. Cargo freight vessel captain.",
    "letters": "Kqx vvz ppl mmt rrw xkq. Qqs xxz wwq zzk ppt jkl. Lmm ttv qrs nnb vcc.",
    "random": "Wokje qalit zurem pikto velad mord. Tropsil genka wulf dorten hask plim. Kradu zemp lorti wakse.",
    "single": "R e l n a t i s o e. C n i a s l e r t.",
}
FRENCH = "La commission s'est réunie au printemps et elle a entendu un rapport sur l'état du port. Plusieurs membres ont demandé comment les nouvelles grues seraient payées."
SPANISH = "El comité se reunió en la primavera y escuchó un informe sobre el estado del puerto. Varios miembros preguntaron cómo se pagarían las nuevas grúas."


def test_short_prose_of_other_languages_is_held_against_the_sketches(spark):
    assert all(not quality.is_prose(t) and prose.shows_too_little(t) for t in [*SHORT.values(), *SHORT_JUNK.values()])
    held = [(f"p{i}", f"{t} {i}.") for i, t in enumerate([PROSE, GERMAN, FRENCH, SPANISH] * 8)]
    tables = [(f"t{i}", TABLE) for i in range(60)]  # more tables than prose don't widen what prose is like
    rows = [*held, *tables, *SHORT.items(), *SHORT_JUNK.items(), (None, SHORT["pl"])]
    df = spark.createDataFrame(rows, "id string, t string")
    assert {r.id for r in quality.not_prose(df, ["id"], "t").collect()} == {k for k, _ in tables} | set(SHORT_JUNK)
    alone = spark.createDataFrame([*SHORT.items(), *SHORT.items()], "id string, t string")
    assert sorted(r.id for r in quality.not_prose(alone, ["id"], "t").collect()) == sorted(SHORT)  # nothing to hold them against


def test_sketches_move_no_text_that_sentences_settle(spark):
    texts = [PROSE, GERMAN, LIST, TABLE, JUNK, ITALIAN, POLISH, "Short.", "(cid:3)(cid:4) " * 40]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts * 3)], "id string, t string")
    assert sorted(int(r.id) for r in quality.not_prose(df, ["id"], "t").collect()) == [i for i, t in enumerate(texts * 3) if not quality.is_prose(t)]
