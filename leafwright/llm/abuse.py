"""Abusive, hateful and sexually explicit content.

All distinct words of the corpus are intersected with a trie of the lexicon by a Levenshtein automaton, so misspelled,
masked and stretched terms are found once for each spelling, not once for each text.  In the texts, the sentences with
such words are scored in their context: who is spoken to, what is called for, and whether the words are only named,
quoted or used in a technical sense.  The lexicon holds general terms and idioms; the cutoff is fitted to reviewers' labels.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpoint, per_row
from . import lexicon as L

#: What holds without labels, and what is tried on them.
CUTOFF = 0.65
CUTOFFS = [0.5 + 0.05 * i for i in range(23)]
#: Spellings brought to every task; were there more, each text would get its own by a join.
MOST_SPELLINGS = 200_000
#: A spelling that is in more texts than this, and than a quarter of its exact term, is a word of its own unless so much of its texts have other terms too.
RARE, ALONGSIDE = 2, 0.5

_EDGES = ".,;:!?()[]{}<>\"'“”„‘’«»…_`|#–—-¿¡+=/\\"
_MASK = "*$@#!"
_LEET = str.maketrans("013457@$!69", "oieastasibg")
_SPACED = re.compile(r"(?<![\w*$@])(?:[^\W_][ .\-·]){2,}[^\W_](?![\w*$@])")
_BREAK = re.compile(r"[-¬\xad‐]\s*\n\s*(?=[^\W\d_])|\xad")
_GAPS = frozenset(".-·")
#: Single letters that aren't words of a language: two of them and letters may be spaced out.
_CONSONANTS = frozenset("bcdfghjklmnpqrstvwxz")
_RUNS = re.compile(r"(.)\1{2,}")
_ENDS = re.compile(r"(?<=[.!?…])\s+|\n\s*\n")


def fold(word: str) -> str:
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).replace("ß", "ss")


def _terms() -> dict[str, tuple[str, float]]:
    held: dict[str, tuple[str, float]] = {}
    for kind, weight, names in (("insult", 1.0, L.STRONG_INSULTS), ("insult", 0.7, L.INSULTS), ("mild", 0.3, L.MILD), ("sexual", 0.9, L.SEXUAL), ("suggestive", 0.3, L.SUGGESTIVE), ("vulgar", 0.5, L.VULGAR)):
        for stem in names.split():
            for end in L.ENDINGS if len(stem) > 4 else ("", "s"):
                held.setdefault(fold(stem + end), (kind, weight))
    return held


TERMS = _terms()


class Trie:
    """The lexicon as a trie, walked with the rows of the Levenshtein automaton of a word."""

    def __init__(self, terms):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def within(self, word: str, most: int, wild: str = "") -> tuple[str, int] | None:
        """The nearest term at a distance of at most ``most``; characters in ``wild`` stand for any one letter."""
        best = None
        stack = [(self.root, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            if "" in node and row[-1] <= most and (best is None or (row[-1], node[""]) < (best[1], best[0])):
                best = node[""], row[-1]
            for c, child in node.items():
                if c:
                    new = [row[0] + 1]
                    for j, x in enumerate(word, 1):
                        new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != c and x not in wild)))
                    if min(new) <= most:
                        stack.append((child, new))
        return best


TRIE = Trie(TERMS)
#: The words as they are listed, which a mask hides sooner than an inflection made from them.
LISTED = Trie(fold(w) for names in (L.STRONG_INSULTS, L.INSULTS, L.MILD, L.SEXUAL, L.SUGGESTIVE, L.VULGAR) for w in names.split())
#: No term is near a longer word.
LONGEST = max(map(len, TERMS)) + 2
_LONG_TERMS = sorted((t for t, (k, w) in TERMS.items() if len(t) >= 5 and w >= 0.7), key=len, reverse=True)


def spell(word: str) -> tuple[str, int, bool] | None:
    """Lexicon term, distance, whether the word is masked (leet, stars, stretched) for a lower-case token; None if it is none."""
    plain = fold(word)
    if plain in TERMS:
        return plain, 0, False
    if len(_RUNS.sub(r"\1", plain)) > LONGEST:
        return None
    masked = any(c in _MASK for c in plain) or any(c.isdigit() for c in plain) and any(c.isalpha() for c in plain)
    if masked:
        stars = plain.count("*")
        if stars and len(plain) - stars >= 2 and len(plain) >= 3 and plain[0].isalpha():
            found = LISTED.within(plain, 0, "*") or TRIE.within(plain, 0, "*")
            return found and (found[0], 1, True)
        bare = plain.strip("!*#")
        if sum(c.isalpha() for c in bare) >= 0.2 * len(bare):
            leet = bare.translate(_LEET)
            if leet in TERMS:
                return leet, 1, True
            if len(leet) >= 5 and leet.isalpha():
                found = TRIE.within(leet, 1)
                return found and (found[0], 1 + found[1], True)
        return None
    if not plain.isalpha():
        return None
    short = _RUNS.sub(r"\1", plain)
    if short != plain:
        for x in (short, _RUNS.sub(r"\1\1", plain)):
            if x in TERMS:
                return x, 1, True
    if len(plain) >= 4:
        found = TRIE.within(plain, 1 if len(plain) < 10 else 2)
        # other endings make other words, not misspellings
        if found and found[0][0] == plain[0] and not plain.startswith(found[0][:-1]) and not found[0].startswith(plain):
            return found[0], found[1], False
    return None


def open_up(text: str) -> tuple[str, list[str]]:
    """The text in lower case, words broken over lines joined, spaced-out letters (a b c, a.b.c, a-b-c) pulled together; and its tokens."""
    if "-\n" in text or "¬" in text or "\xad" in text or "‐" in text or "-\r" in text:
        text = _BREAK.sub("", text)
    text = text.lower()
    parts = text.split()
    if len(_CONSONANTS.intersection(parts)) > 1 or any(t[1] in _GAPS and t[0].isalpha() for t in parts if len(t) > 4 and not t.isalpha()):
        text = _SPACED.sub(lambda m: _together(m[0]), text)
        parts = text.split()
    return text, [t if t.isalpha() else t.strip(_EDGES) for t in parts]


def _together(spaced: str) -> str:
    joined = re.sub(r"[ .\-·]", "", spaced)
    plain = fold(joined)
    if plain in TERMS:
        return joined
    for t in _LONG_TERMS:
        if t in plain:
            return plain.replace(t, f" {t} ")
    return spaced


def tokens(text: str) -> list[str]:
    return [t if t.isalpha() else t.strip(_EDGES) for t in text.split()]


def judged_spellings(df: DataFrame, text: str) -> DataFrame:
    """word, term, distance, masked, n_docs (distinct texts, so copies count once), kept of all words that a lexicon term may hide behind.

    Exact and masked terms are kept.  A misspelt one is if it is rare, or rare beside the exact term, or if at least
    ALONGSIDE of its texts have other terms; a word of four or five letters, near many others, only in that last case.
    """

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, int, bool] | None] = {}
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                found = []
                for w in set(open_up(t)[1]):
                    if w not in known:
                        known[w] = spell(w) if len(w) > 2 and any(c.isalpha() for c in w) else None
                    if known[w]:
                        found.append((w, *known[w]))
                if found:
                    code = xxhash.xxh3_64_intdigest(t) - (1 << 63)
                    sure = {w for w, term, distance, masked in found if (masked or not distance) and TERMS[term][1] >= 0.5}
                    rows += [(*f, code, bool(sure - {f[0]})) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_()))], names=["word", "term", "distance", "masked", "code", "alongside"])

    each = df.select(text).where(F.col(text).isNotNull()).mapInArrow(spelt, "word string, term string, distance int, masked boolean, code bigint, alongside boolean")
    found = each.distinct().groupBy("word", "term", "distance", "masked").agg(F.count("*").alias("n_docs"), F.count_if("alongside").alias("n_alongside"))
    exact = found.where("distance = 0").groupBy("term").agg(F.max("n_docs").alias("as_term"))
    rare = (F.length("word") >= 6) & (F.col("n_docs") <= F.greatest(F.coalesce("as_term", F.lit(0)) / 4, F.lit(RARE)))
    kept = F.col("masked") | (F.col("distance") == 0) | rare | (F.col("n_alongside") >= ALONGSIDE * F.col("n_docs"))
    return found.join(exact, "term", "left").select("word", "term", "distance", "masked", "n_docs", kept.alias("kept"))


def spellings(df: DataFrame, text: str) -> DataFrame:
    """word, term, distance, masked, n_docs (distinct texts) of the words in the texts that a lexicon term hides behind."""
    return judged_spellings(df, text).where("kept").drop("kept")


_PHRASES = re.compile("|".join(r"\b" + r"(?:\W+\w+){0,2}?\W+".join(map(re.escape, p.split())) + r"\b" for p in L.PHRASES.split("|")))
_SEXUAL = re.compile("|".join(r"\b" + r"(?:\W+\w+){0,1}?\W+".join(map(re.escape, p.split())) + r"\b" for p in L.SEXUAL_PHRASES.split("|")))
#: Of each phrase its longest word: without it the phrase isn't there.
_ANCHORS = frozenset(max(p.split(), key=len) for p in f"{L.PHRASES}|{L.SEXUAL_PHRASES}".split("|"))
_ADDRESS, _GROUP, _STUDY = (frozenset(x.split()) for x in (L.ADDRESS, L.GROUP, L.STUDY))
_QUOTED = re.compile(r"[\"“„«‘]([^\"“”„«»‘’\n]{1,40})[\"”“»’]")


def score_sentence(sentence: str, known: dict[str, tuple[str, bool]]) -> tuple[float, str]:
    """Score and category of a lower-case sentence.  known: spelling -> term, masked."""
    words = tokens(sentence)
    hits = [(w, *known[w]) for w in words if w in known]
    if hits:
        quoted = " ".join(_QUOTED.findall(sentence))
        plain = sentence if all(not masked and w == t for w, t, masked in hits) else " ".join(known[w][0] if w in known else w for w in words)
    else:
        quoted, plain = "", sentence
    threat = len(_PHRASES.findall(plain))
    explicit = len(_SEXUAL.findall(plain))
    if not hits and not threat and not explicit:
        return 0.0, ""
    by: Counter = Counter()
    strong = False
    for w, t, masked in hits:
        kind, weight = TERMS[t]
        if quoted and w in quoted:
            weight *= 0.3
        if masked:
            weight = max(weight, 0.5) + 0.2  # nobody masks a word that is meant innocently
        strong |= kind in ("insult", "sexual", "vulgar") and weight >= 0.5
        by[kind] += weight
    present = set(words)
    study = len(present & _STUDY)
    address = bool(present & _ADDRESS)
    group = bool(present & _GROUP)
    insults = by["insult"] + by["vulgar"]
    sexual = by["sexual"] + (by["suggestive"] if by["sexual"] or explicit or by["suggestive"] >= 0.9 else 0.0)
    score = insults + 0.8 * threat + sexual + 0.5 * explicit + min(by["mild"], 0.9) * (1 if insults or threat or address else 0.3)
    if insults or threat:
        score += 0.3 * (address or group)
    if not strong and not threat and not explicit and by["suggestive"] < 0.9:
        score *= 0.6
    score *= (1.0, 0.6, 0.35)[min(2, study)] if threat == 0 or study > 1 else 1.0
    category = "sexual" if sexual + 0.5 * explicit > insults + 0.8 * threat else "hateful" if group and not (present & {"you", "du", "tu", "eres", "your"}) else "abusive"
    return score, category


def score_text(text: str, known: dict[str, tuple[str, bool]]) -> tuple[float, str]:
    """The highest score of a sentence, and its category; sentences without terms and phrases score 0."""
    opened, words = open_up(text)
    best = 0.0, ""
    present = set(words)
    if present.isdisjoint(known) and present.isdisjoint(_ANCHORS):
        return best
    for part in _ENDS.split(opened):
        got = score_sentence(part, known)
        if got[0] > best[0]:
            best = got
    return best


def scored(documents: DataFrame, doc: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc, extra columns, score, category (abusive, hateful, sexual or ""); a row for each row of documents.

    Null and empty texts score 0.  Texts are read whole.  An empty table gives an empty result.  Up to MOST_SPELLINGS
    spellings go to every task; with more, each text is joined with its own, to the same result.
    """
    fields = [("score", "double"), ("category", "string")]
    found = checkpoint(spellings(documents, text))
    if found.count() > MOST_SPELLINGS:
        return _scored_by_join(documents, found, doc, text, extra)
    shared = documents.sparkSession.sparkContext.broadcast({r.word: (r.term, r.masked) for r in found.collect()})

    def make():
        held = shared.value
        return lambda t: score_text(t, held) if t else (0.0, "")

    return per_row(documents, [doc, *extra], [text], make, fields)


def _scored_by_join(documents: DataFrame, found: DataFrame, doc: str, text: str, extra: tuple[str, ...]) -> DataFrame:
    """Each text's own spellings reach it by a hash of the text: what comes together is bounded by its own words."""
    coded = documents.select(doc, *extra, F.col(text).alias("_body"), F.xxhash64(text).alias("_code"))

    def candidates(t: str | None) -> tuple | None:
        words = sorted({w for w in open_up(t)[1] if len(w) > 2 and spell(w)}) if t else []
        return (words,) if words else None

    each = per_row(coded, ["_code"], ["_body"], lambda: candidates, [("words", "array<string>")]).select("_code", F.explode("words").alias("word")).distinct()
    own = each.join(found.select("word", "term", "masked"), "word").groupBy("_code").agg(F.sort_array(F.collect_set(F.struct("word", "term", "masked"))).alias("s"))
    joined = coded.join(own, "_code", "left").select("*", F.col("s.word").alias("_w"), F.col("s.term").alias("_t"), F.col("s.masked").cast("array<int>").alias("_m"))

    def score(t: str | None, words: list | None, terms: list | None, masked: list | None) -> tuple:
        return score_text(t, {w: (x, bool(m)) for w, x, m in zip(words or (), terms or (), masked or ())}) if t else (0.0, "")

    return per_row(joined, [doc, *extra], ["_body", "_w", "_t", "_m"], lambda: score, [("score", "double"), ("category", "string")])


def _majority(labels: DataFrame, doc: str) -> DataFrame:
    """doc, bad of the documents whose reviewers don't balance; ok against abusive, hateful and sexual, others and null don't vote."""
    votes = labels.where("label in ('ok', 'abusive', 'hateful', 'sexual')").groupBy(doc).agg(F.sum(F.when(F.col("label") == "ok", -1).otherwise(1)).alias("v"))
    return votes.where("v <> 0").select(doc, (F.col("v") > 0).alias("bad"))


def best_cutoff(counts: dict[int, tuple[int, int]]) -> float:
    """The cutoff with the best F1; of equally good ones the nearest to CUTOFF, which holds without any.  counts: of the documents that reach so many of CUTOFFS, how many are bad and how many there are."""
    best = (-1.0, 0.0, CUTOFF)
    n_bad = sum(bad for bad, _ in counts.values())
    for i, c in enumerate(CUTOFFS):
        tp, n = (sum(x[k] for r, x in counts.items() if r > i) for k in (0, 1))
        if tp:
            best = max(best, (round(2 * tp / (n_bad + n), 4), -abs(c - CUTOFF), c))
    return best[2]


def _counted(scores: DataFrame, labels: DataFrame, doc: str, *group: str) -> DataFrame:
    """group, reach (how many of CUTOFFS a score reaches), n_bad, n: all labelled documents, each once, as a row for each group and reach."""
    each = scores.join(_majority(labels, doc), doc).groupBy(doc).agg(F.max(F.struct("score", "bad", *group)).alias("x")).select("x.*")
    reach = sum((F.col("score") >= c).cast("int") for c in CUTOFFS)
    return each.groupBy(*group, reach.alias("reach")).agg(F.count_if("bad").alias("n_bad"), F.count("*").alias("n"))


def fitted_cutoff(scores: DataFrame, labels: DataFrame, doc: str = "doc_id") -> float:
    """best_cutoff on all labelled documents; a count for each of CUTOFFS comes to the driver."""
    return best_cutoff({r.reach: (r.n_bad, r.n) for r in _counted(scores, labels, doc).collect()})


def held_out(documents: DataFrame, labels: DataFrame, group: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """group, n_labelled, n_bad, n_flagged, n_both: the labelled documents of each group by the cutoff fitted on all other groups.

    All labelled documents count; the driver gets a count for each of CUTOFFS, over all groups.  A null group is a group of its own.
    """
    counts = checkpoint(_counted(scored(documents, doc, text, (group,)), labels, doc, group))
    whole = {r.reach: (r.n_bad, r.n) for r in counts.groupBy("reach").agg(F.sum("n_bad").alias("n_bad"), F.sum("n").alias("n")).collect()}

    def held(reach: list[int], n_bad: list[int], n: list[int]) -> tuple:
        mine = {r: (b, m) for r, b, m in zip(reach, n_bad, n)}
        cutoff = best_cutoff({r: (b - mine.get(r, (0, 0))[0], m - mine.get(r, (0, 0))[1]) for r, (b, m) in whole.items()})
        over = [x for r, x in mine.items() if r > CUTOFFS.index(cutoff)]
        return sum(n), sum(n_bad), sum(m for _, m in over), sum(b for b, _ in over)

    each = counts.groupBy(group).agg(F.collect_list(F.struct("reach", "n_bad", "n")).alias("x")).select(group, "x.reach", "x.n_bad", "x.n")
    return per_row(each, [group], ["reach", "n_bad", "n"], lambda: held, [(c, "int") for c in ("n_labelled", "n_bad", "n_flagged", "n_both")])


def flagged(documents: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, score, category of the documents at or over the fitted cutoff; equal documents come out once."""
    scores = checkpoint(scored(documents, doc, text))
    return scores.where(F.col("score") >= fitted_cutoff(scores, labels, doc)).dropDuplicates([doc])


def rates(documents: DataFrame, labels: DataFrame, source: str = "source", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """source, n_docs, n_flagged, rate, and a count for each category.  A null source is a source of its own."""
    scores = checkpoint(scored(documents, doc, text, (source,)))
    hit = F.col("score") >= fitted_cutoff(scores.select(doc, "score"), labels, doc)
    return scores.groupBy(source).agg(
        F.count("*").alias("n_docs"), F.count_if(hit).alias("n_flagged"), (F.count_if(hit) / F.count("*")).alias("rate"), *[F.count_if(hit & (F.col("category") == c)).alias(f"n_{c}") for c in ("abusive", "hateful", "sexual")]
    )
