"""Noise in text from scanned pages: found, and repaired into continuous paragraphs.

Words: all words of the corpus are counted; rare ones meet frequent ones that share a placed trigram with them (a join of
inverted lists), and boosted trees rank these candidates by how well confusions of similar characters explain the rare
word.  Lines: boosted trees on pairs of lines decide whether a hyphen at a line's end breaks a word; others, on what is
known of a line over all pages of its document and over all documents, tell running headers from headings and body text.
Both are fitted on bounded samples that label themselves (words broken or misspelt on purpose, lines seen on many pages).
"""

from __future__ import annotations

import random
import re
from collections import ChainMap, Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpoint, hash_sample, per_row
from .boost import Boosted
from .prose import _EDGES, ANY_FUNCTION_WORD, is_page_number
from .repetition import is_wordy

# What scanners take for what (right, read), single and double characters.
CONFUSIONS = (
    "m rn|n ri|d cl|u ii|w vv|h li|l 1|i 1|i l|l i|o 0|s 5|b 6|b 8|g 9|e c|c e|h b|b h|t f|f t|a @|a o|g q|q g|z 2|rn m|ri n|cl d|li h|n u|u n|v y|y v|fi ﬁ|fl ﬂ|s 8|t l|l t|i !".split("|")
)
_PAIRS = tuple(tuple(p.split(" ")) for p in CONFUSIONS)

#: A word that is read wrong is so many times rarer than the right one; a frequent word occurs at least so often.
LEAST_RATIO, LEAST_COUNT = 20, 20
#: Frequent words held by every task; if there are more, each text is joined with the counts of its other words.
HELD_WORDS = 200_000
#: Longer strings of letters aren't words of a language.
LONGEST_WORD = 80
#: Part of the documents with a running line in which it recurs.
RUNNING = 0.5
#: Words and lines in the samples the classifiers are fitted on.
SAMPLE_WORDS, SAMPLE_LINES = 3000, 6000

_MARKS = "-¬\xad‐"
_BREAK = re.compile(r"([-¬\xad‐])[^\S\n]*\n[^\S\n]*([^\W\d_]+)")
_LEFT = re.compile(r"[^\W\d_]+$")
_STRONG_NUMBER = re.compile(r"^\s*(?:page\s+\d{1,4}|[-·–—]\s*\d{1,4}\s*[-·–—]|\[\d{1,4}\]|\d{1,4}\s*/\s*\d{1,4})\s*$", re.I)
_MARKUP = re.compile(r"[<>{}\\|]|^\s*(?:#{1,6}\s|[*•–—+-]\s|\(?\w{1,3}[.)]\s)|\*\*|__|`|!\[|\]\(|\.{4,}|\t|\s{3,}\S+\s{3,}")


# --- words


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """word, n over the texts that are at least partly prose; lower case, letters with digits or signs among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                tokens = t.lower().split()
                if sum(x in ANY_FUNCTION_WORD for x in tokens) >= 0.08 * len(tokens):
                    held.update(tokens)
        exact: Counter = Counter()
        for w, n in held.items():
            if not w.isalpha():
                if w[-1] in _MARKS:
                    continue
                w = w.strip(_EDGES)
            if 0 < len(w) <= LONGEST_WORD and w[0].isalnum() and sum(c.isalpha() for c in w) >= 0.6 * len(w):
                exact[w] += n
        names = list(exact)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([exact[w] for w in names], pa.int64())], names=["word", "n"])

    return texts.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """(word, n) of the most frequent words, at most so many, by falling frequency; only these are brought to the driver."""
    bucket = F.floor(F.log2("n") * 8).alias("b")
    least, held = None, 0
    for r in sorted(counts.groupBy(bucket).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.b):
        if held + r.k > most:
            break
        least, held = r.b, held + r.k
    chosen = counts.where(F.floor(F.log2("n") * 8) >= least) if least is not None else counts.limit(0)
    return sorted(((r.word, r.n) for r in chosen.select("word", "n").collect()), key=lambda x: (-x[1], x[0]))


def _grams(word, spread: int = 0):
    """Trigrams at fixed places from the start (s) and from the end (e), each with the word's length, give or take ``spread``.

    Words of up to six letters, whose trigrams may all hold the wrong character, also have their first and last letter
    together (x): one wrong character leaves some of these whole.  The lengths keep the lists of common trigrams apart, so
    they don't meet as a whole.
    """
    n = F.length(word)
    starts = [F.when(n >= 3 + i, F.concat(F.lit(f"s{i}"), F.substring(word, 1 + i, 3))) for i in range(3)]
    ends = [F.when(n >= 3 + i, F.concat(F.lit(f"e{i}"), F.substring(word, -3 - i, 3))) for i in range(3)]
    inner = F.when(n <= 8 - spread, F.concat(F.lit("x"), F.substring(word, 1, 1), F.substring(word, -1, 1)))  # a misreading may have two letters more
    grams = F.array_compact(F.array(*starts, *ends, inner))
    return F.explode(F.flatten(F.transform(grams, lambda g: F.transform(F.sequence(n - spread, n + spread), lambda k: F.concat(g, k.cast("string"))))))


def misreading_cost(right: str, read: str) -> float:
    """Edit distance in which a confusion of similar characters costs 0.1 and any other edit 1."""
    n, m = len(right), len(read)
    rows = [[0.0] * (m + 1) for _ in range(n + 1)]
    for j in range(1, m + 1):
        rows[0][j] = j
    for i in range(1, n + 1):
        rows[i][0] = i
        a = right[i - 1]
        for j in range(1, m + 1):
            best = rows[i - 1][j - 1] + (a != read[j - 1])
            best = min(best, rows[i - 1][j] + 1, rows[i][j - 1] + 1)
            for x, y in _BY_END.get(a, ()):
                p, q = i - len(x), j - len(y)
                if p >= 0 and q >= 0 and best > rows[p][q] + 0.1 and right.endswith(x, 0, i) and read.endswith(y, 0, j):
                    best = rows[p][q] + 0.1
            rows[i][j] = best
    return rows[n][m]


_BY_END: dict[str, list[tuple[str, str]]] = {}
for _x, _y in _PAIRS:
    _BY_END.setdefault(_x[-1], []).append((_x, _y))


def _word_features(right: str, read: str, n_right: int, n_read: int) -> list[float]:
    cost = misreading_cost(right, read)
    return [
        np.log(n_right / n_read),
        cost,
        cost - int(cost),
        len(right),
        len(read) - len(right),
        float(not read.isalpha()),
        float(right[0] == read[0]),
        float(right[-1] == read[-1]),
    ]


def _misread(word: str, rng: random.Random, times: int) -> str:
    for _ in range(times):
        fits = [(x, y) for x, y in _PAIRS if x in word]
        if not fits:
            break
        x, y = rng.choice(fits)
        at = rng.choice([m.start() for m in re.finditer(re.escape(x), word)])
        word = word[:at] + y + word[at + len(x) :]
    return word


def word_ranker(words: list[tuple[str, int]], seed: int = 11) -> Boosted:
    """Fitted on frequent words misread on purpose (right candidates) and on random edits and other words (wrong ones)."""
    rng = random.Random(seed)
    words = [(w, n) for w, n in words if len(w) >= 4]
    x, y = [], []
    letters = "abcdefghijklmnopqrstuvwxyz"
    by_end: dict[str, list[tuple[str, int]]] = {}
    for w, n in words:
        by_end.setdefault(w[-3:], []).append((w, n))
    for w, n in words:
        rare = lambda: max(1, int(n / 10 ** rng.uniform(1.3, 4)))
        wrong = _misread(w, rng, rng.choice((1, 1, 1, 2)))
        if wrong != w:
            x.append(_word_features(w, wrong, n, rare()))
            y.append(1)
        at = rng.randrange(len(w))
        other = rng.choice((w[:at] + rng.choice(letters) + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w + rng.choice("sen"), w[:-1]))
        if other != w and misreading_cost(w, other) > 0.5:
            x.append(_word_features(w, other, n, rare()))
            y.append(0)
        near, m = rng.choice(by_end[w[-3:]])
        if near != w and abs(len(near) - len(w)) < 3:
            x.append(_word_features(w, near, n, max(1, min(n // LEAST_RATIO, m))))
            y.append(0)
    return Boosted().fit(np.array(x, float).reshape(-1, 8), np.array(y, float))


def corrections(counts: DataFrame) -> DataFrame:
    """word, replacement, probability of the words that are misreadings of a frequent word."""
    frequent = counts.where((F.col("n") >= LEAST_COUNT) & F.col("word").rlike(r"^\p{L}{4,}$")).select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    ranker = word_ranker(most_frequent(frequent.select(F.col("right").alias("word"), F.col("n_right").alias("n")), SAMPLE_WORDS))
    rare = counts.where(F.length("word") >= 4)
    pairs = (
        rare.select("word", "n", _grams(F.col("word")).alias("gram"))
        .join(frequent.select("right", "n_right", _grams(F.col("right"), 2).alias("gram")), "gram")
        .where(F.col("n_right") >= LEAST_RATIO * F.col("n"))
        .groupBy("word", "right")
        .agg(F.max("n").alias("n"), F.max("n_right").alias("n_right"))
        .where(F.levenshtein("word", "right", 4) >= 0)
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, rights, n, n_right = (b.column(i).to_pylist() for i in range(4))
            kept = [i for i in range(len(words)) if misreading_cost(rights[i], words[i]) < 1.0]
            x = np.array([_word_features(rights[i], words[i], n_right[i], n[i]) for i in kept], float).reshape(-1, 8)
            p = ranker.probability(x) if len(kept) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in kept], pa.string()), pa.array([rights[i] for i in kept], pa.string()), pa.array(p, pa.float64())], names=["word", "replacement", "probability"])

    ranked = pairs.select("word", "right", "n", "n_right").mapInArrow(rank, "word string, replacement string, probability double").where("probability >= 0.5")
    return ranked.groupBy("word").agg(F.max_by(F.struct("replacement", "probability"), F.struct("probability", "replacement")).alias("c")).select("word", "c.replacement", "c.probability")


# --- line pairs


def broken_words(text: str) -> list[tuple[str, str, str]]:
    """Left part, mark and right part of each word that a hyphen-like mark parts at a line's end."""
    found = []
    for m in _BREAK.finditer(text):
        if left := _LEFT.search(text[max(0, m.start() - 40) : m.start()]):
            found.append((left[0], m[1], m[2]))
    return found


def _break_features(left: str, mark: str, right: str, known) -> list[float]:
    """known: word -> count, 0 for unknown words."""
    joined, l, r = (np.log1p(known.get(w, 0)) for w in (left + right, left, right))
    return [joined, l, r, joined - min(l, r), float(mark != "-"), len(left), len(right), float(right[0].isupper())]


def break_classifier(words: list[tuple[str, int]], seed: int = 13) -> Boosted:
    """Fitted on words broken on purpose, and on pairs of words that a hyphen joins or that are no word together."""
    rng = random.Random(seed)
    words = [(w, n) for w, n in words if len(w) >= 4]
    known = dict(words)
    x, y = [], []
    for w, _ in words:
        at = rng.randint(2, len(w) - 2)
        mark = rng.choice("---¬\xad‐")
        x.append(_break_features(w[:at], mark, w[at:], known))
        y.append(1)
        half, rest = rng.choice(words)[0], rng.choice(words)[0]
        x.append(_break_features(half, "-", rest, known))
        y.append(0)
        lost = rng.choice(words)[0]
        at = rng.randint(2, len(lost) - 2)
        x.append([0.0, *_break_features(lost[:at], mark, lost[at:], known)[1:3], -min(_break_features(lost[:at], mark, lost[at:], known)[1:3]), float(mark != "-"), at, len(lost) - at, 0.0])
        y.append(1)  # a rare word that is broken: neither its parts nor the whole are known
    return Boosted(rounds=25).fit(np.array(x, float).reshape(-1, 8), np.array(y, float))


# --- lines


def canonical(line: str) -> str:
    """What readings of one header have in common: no digits at the ends, no case, similar characters alike."""
    s = line.lower()
    s = re.sub(r"^[\W\d_]+|[\W\d_]+$", "", s)
    for a, b in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ri", "n"), ("ﬁ", "fi"), ("1", "i"), ("l", "i"), ("0", "o"), ("5", "s"), ("6", "b"), ("9", "g"), ("c", "e"), ("h", "b"), ("f", "t"), ("@", "a")):
        s = s.replace(a, b)
    return re.sub(r"[\W_]+", "", re.sub(r"\d+", "", s))


def _line_features(line: str, top: int) -> list[float]:
    """What a line looks like; how often it occurs, by which the samples are labelled, isn't among it."""
    tokens = line.split()
    letters = [c for c in line if c.isalpha()]
    words = [t.strip(_EDGES) for t in tokens]
    named = [w for w in words if w[:1].isalpha()]
    return [
        len(tokens),
        len(line),
        sum(c.isupper() for c in letters) / max(1, len(letters)),
        sum(w[0].isupper() for w in named) / max(1, len(named)),
        float(tokens[0][:1].isdigit() and not re.match(r"^\d+(?:\.\d+)*\.?$", tokens[0]) is None),
        float(tokens[-1][-1:].isdigit()),
        float(line.rstrip()[-1:] in ".,;:!?-"),
        sum(w.lower() in ANY_FUNCTION_WORD for w in words) / len(words),
        float(top),
        float(len(re.search(r"^\d*(\s*)", line)[1]) > 1 or bool(re.search(r"\s{2,}\d+$", line))),
        float(":" in line),
    ]


def edge_lines(text: str) -> list[tuple[int, str]]:
    """Short first and last lines (top 1 or 0) that may be running headers or footers, page numbers and markup aside."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    out = []
    for top, part in ((1, lines[:3]), (0, lines[-2:] if len(lines) > 4 else [])):
        seen = 0
        for x in part if top else reversed(part):
            if is_page_number(x):
                continue
            if seen == 1 + top:
                break
            seen += 1
            if 4 < len(x) < 75 and not _MARKUP.search(x):
                out.append((top, x))
            else:
                break
    return out


def furniture(lines: DataFrame, doc: str, page: str) -> DataFrame:
    """doc, canon of the lines that are running headers or footers.  lines: doc, page, canon, line, top.

    A line recurs in a document if it stands on at least two of its pages and a quarter of them.  Running lines recur in
    most documents they occur in, be it one or all of a journal; headings that many documents have recur in few.  All
    statistics are shares, so they don't depend on how many documents there are.  Whether a line that recurs looks like
    a running line, and one on a page of a short document, is up to the classifier.
    """
    by_line = lines.groupBy(doc, "canon", page).agg(F.max(F.struct("line", "top")).alias("x")).groupBy(doc, "canon").agg(F.count("*").alias("pages"), F.max("x").alias("x"))
    doc_pages = lines.groupBy(doc, page).agg(F.lit(1).alias("one")).groupBy(doc).agg(F.count("*").alias("doc_pages"))
    each = checkpoint(by_line.join(doc_pages, doc).withColumn("recurs", (F.col("pages") >= 2) & (F.col("pages") >= 0.25 * F.col("doc_pages"))))
    wide = each.groupBy("canon").agg(F.count("*").alias("docs"), F.count_if("recurs").alias("recurring"))
    seen = checkpoint(each.join(wide, "canon").select(doc, "canon", "pages", "doc_pages", "recurs", "docs", (F.col("recurring") / F.col("docs")).alias("share"), F.col("x.line").alias("line"), F.col("x.top").alias("top")))
    running = F.col("recurs") & (F.col("share") >= RUNNING)
    header = running & (F.col("pages") >= 3)
    plain = ((F.col("docs") >= 5) & (F.col("share") < RUNNING / 5)) | ((F.col("pages") == 1) & (F.col("doc_pages") >= 5))
    sample = lambda c: sorted(hash_sample(seen.where(c).select(doc, "canon", "line", "top"), [doc, "canon"], SAMPLE_LINES // 2).collect(), key=lambda r: (r[0], r.canon))
    labelled = [(r, 1) for r in sample(header)] + [(r, 0) for r in sample(plain)]
    x = np.array([_line_features(r.line, r.top) for r, _ in labelled], float).reshape(-1, 11)
    model = Boosted().fit(x, np.array([y for _, y in labelled], float))

    def judge(line: str, pages: int, n: int, recurs: bool, share: float, top: int) -> tuple | None:
        if recurs and share >= RUNNING:
            limit = 0.1
        elif pages >= 0.25 * n and n <= 4:
            limit = 0.5
        else:
            return None
        return () if model.probability_of(_line_features(line, top)) >= limit else None

    return per_row(seen, [doc, "canon"], ["line", "pages", "doc_pages", "recurs", "share", "top"], lambda: judge, [])


# --- texts


def with_own_counts(texts: DataFrame, keys: list[str], text: str, words: DataFrame, held: dict[str, int]) -> DataFrame:
    """keys, text, _words, _counts: each text with the counts of those of its words, and of its parts of words put together, that aren't held.

    What comes together for a text is bounded by its own words; texts meet theirs by a hash.
    """
    coded = texts.select(*keys, text, F.xxhash64(text).alias("_code"))
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def make():
        known = shared.value

        def forms(t: str | None) -> tuple | None:
            if not t:
                return None
            found, before = set(), ""
            for w in t.lower().split():
                w = w if w.isalpha() else w.strip(_EDGES)
                if w in known or not w:
                    before = ""
                    continue
                found.update((w, before + w))
                before = w
            for a, _, b in broken_words(t):
                a, b = a.lower(), b.lower()
                found.update(x for x in (a, b, a + b) if x not in known)
            return (sorted(found),) if found else None

        return forms

    each = per_row(coded, ["_code"], [text], make, [("forms", "array<string>")]).select("_code", F.explode("forms").alias("word")).distinct()
    own = each.join(words.select("word", "n"), "word").groupBy("_code").agg(F.sort_array(F.collect_set(F.struct("word", "n"))).alias("w"))
    return coded.join(own, "_code", "left").select(*keys, text, F.col("w.word").alias("_words"), F.col("w.n").alias("_counts"))


def scan_noise(texts: DataFrame, keys: list[str], text: str, doc: str = "doc_id", page: str = "page_num") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Four tables from one pass over the texts: (1) keys, broken, misread, header, page_number for each text with noise,
    true for the kinds it has; (2) keys, word, replacement of the misread words; (3) keys, canon of the running headers;
    (4) keys, joins: parts of words to be joined, parted by a newline or a blank as they are in the text.

    keys must name a row; equal ones come out once, rows with a null in one are left out.  Null and empty texts have no noise, nor do texts that aren't words.
    An empty table gives empty results.
    """
    spark, texts = texts.sparkSession, texts.dropna(subset=keys)
    counts = checkpoint(word_counts(texts, text))
    fixes = checkpoint(corrections(counts))
    words = counts.join(fixes.select("word"), "word", "left_anti").where(F.col("n") >= LEAST_COUNT)
    held = dict(most_frequent(words, HELD_WORDS))
    inputs = [text]
    if words.count() > len(held):
        words = checkpoint(words)
        texts, inputs = with_own_counts(texts, keys, text, words, held), [text, "_words", "_counts"]
    breaks = break_classifier(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:SAMPLE_WORDS])
    shared = spark.sparkContext.broadcast(held)

    def make():
        every, model = shared.value, breaks

        def is_broken(left: str, mark: str, right: str, known) -> bool:
            return model.probability_of(_break_features(left.lower(), mark, right.lower(), known)) >= 0.5

        def inspect(t: str | None, own: list | None = None, own_counts: list | None = None) -> tuple | None:
            if not t or not t.strip():
                return None
            known = ChainMap(dict(zip(own, own_counts)), every) if own else every
            lines = [x for x in t.split("\n") if x.strip()]
            number = is_page_number(lines[0]) or is_page_number(lines[-1]) or len(lines) > 1 and (is_page_number(lines[1]) and len(lines[0]) < 75 or is_page_number(lines[-2]) and len(lines[-1]) < 75) or any(len(x) < 20 and _STRONG_NUMBER.match(x) for x in lines)
            edges = edge_lines(t)
            joins: list[str] = []
            if "\n" in t and any(m in t for m in _MARKS):
                joins = [f"{a}\n{b}" for a, m, b in broken_words(t) if is_broken(a, m, b, known)]
            broken, odd, before = bool(joins), [], ""
            for w in t.lower().split():
                if w in known:
                    before = ""
                    continue
                if not w.isalpha():
                    w = w.strip(_EDGES)
                    if w in known or len(w) < 4 or sum(map(str.isalpha, w)) < 0.6 * len(w):
                        before = ""
                        continue
                odd.append(w)
                if before and before + w in known:
                    joins.append(f"{before} {w}")
                before = w
            if not (number or edges or joins or odd):
                return None
            if not is_wordy(t):
                return None
            return number, broken, len(joins) > broken and any(" " in j for j in joins), joins, sorted(set(odd)), [x for _, x in edges], [canonical(x) for _, x in edges], [top for top, _ in edges]

        return inspect

    fields = [("page_number", "boolean"), ("broken", "boolean"), ("split", "boolean"), ("joins", "array<string>"), ("odd", "array<string>"), ("lines", "array<string>"), ("canons", "array<string>"), ("tops", "array<int>")]
    seen = checkpoint(per_row(texts, keys, inputs, make, fields).dropDuplicates(keys))
    misread = seen.select(*keys, F.explode("odd").alias("word")).join(fixes, "word").select(*keys, "word", "replacement")
    lines = seen.select(*keys, F.explode(F.arrays_zip("lines", "canons", "tops")).alias("l")).select(*keys, F.col("l.lines").alias("line"), F.col("l.canons").alias("canon"), F.col("l.tops").alias("top")).where("canon <> ''")
    lines = checkpoint(lines)
    headers = furniture(lines, doc, page)
    named = lines.join(headers, [doc, "canon"]).select(*keys, "canon").distinct()
    headed = named.select(*keys).distinct().withColumn("header", F.lit(True))
    wrong = misread.select(*keys).distinct().withColumn("misread", F.lit(True))
    flags = seen.select(*keys, "page_number", "broken", "split").join(headed, keys, "left").join(wrong, keys, "left")
    flags = flags.select(*keys, "broken", (F.coalesce("misread", F.lit(False)) | F.col("split")).alias("misread"), F.coalesce("header", F.lit(False)).alias("header"), "page_number")
    return flags.where("broken or misread or header or page_number"), misread, named, seen.where("size(joins) > 0").select(*keys, "joins")


def repair(text: str, words: list[str] | None, replacements: list[str] | None, canons: list[str] | None, joins: list[str] | None) -> str:
    """The text without page numbers and the headers named, words joined and replaced, its lines joined to paragraphs."""
    lines = text.replace("\r\n", "\n").split("\n")
    headers = set(canons or ())
    filled = [i for i, x in enumerate(lines) if x.strip()]
    for i in {*filled[:3], *filled[-2:]}:
        if is_page_number(lines[i]) or headers and canonical(lines[i].strip()) in headers:
            lines[i] = ""
    lines = ["" if len(x) < 20 and _STRONG_NUMBER.match(x) else x.rstrip() for x in lines]
    body = "\n".join(lines)
    for j in joins or ():
        if "\n" in j:
            a, b = j.split("\n")
            body = re.sub(rf"(?<!\w){re.escape(a)}[{_MARKS}][^\S\n]*\n[^\S\n]*{re.escape(b)}(?!\w)", lambda m, x=a + b: x, body)
        else:
            a, b = j.split(" ")
            body = re.sub(rf"(?<!\w)({re.escape(a)})\s+({re.escape(b)})(?!\w)", r"\1\2", body, flags=re.I)
    body = body.replace("\xad", "")
    fix = dict(zip(words or (), replacements or ()))
    if fix:

        def replaced(m: re.Match) -> str:
            bare = m[0].strip(_EDGES)
            right = fix.get(bare.lower())
            if right is None:
                return m[0]
            letters = [c for c in bare if c.isalpha()]
            right = right.upper() if len(letters) > 1 and sum(c.isupper() for c in letters) > 0.5 * len(letters) else right.capitalize() if bare[:1].isupper() else right
            return m[0].replace(bare, right, 1)

        body = re.sub(r"\S+", replaced, body)
    out: list[str] = []
    for block in re.split(r"\n[ \t]*\n+", body):
        run = ""
        for x in block.split("\n"):
            if not x.strip():
                continue
            if run and not _MARKUP.search(run.rsplit("\n", 1)[-1]) and not _MARKUP.search(x):
                run += " " + x.strip()
            else:
                run += ("\n" if run else "") + x
        if run:
            out.append(run)
    return "\n\n".join(out)


def repaired_texts(texts: DataFrame, keys: list[str], text: str, doc: str = "doc_id", page: str = "page_num") -> DataFrame:
    """keys, repaired_text of every text that isn't null; equal keys come out once."""
    _, misread, headers, joins = scan_noise(texts, keys, text, doc, page)
    # What comes together for a text is bounded by its own words.
    fixes = misread.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("word", "replacement"))).alias("f")).select(*keys, F.col("f.word").alias("words"), F.col("f.replacement").alias("replacements"))
    named = headers.groupBy(*keys).agg(F.sort_array(F.collect_set("canon")).alias("canons"))
    whole = texts.dropna(subset=keys).where(F.col(text).isNotNull()).select(*keys, text).dropDuplicates(keys).withColumnRenamed(text, "_body")
    whole = whole.join(fixes, keys, "left").join(named, keys, "left").join(joins, keys, "left")
    return per_row(whole, keys, ["_body", "words", "replacements", "canons", "joins"], lambda: lambda *x: (repair(*x),), [("repaired_text", "string")])
