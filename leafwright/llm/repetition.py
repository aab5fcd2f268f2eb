"""Repetition inside a single document: the share of its words that it has said before.

A word is repeated if it stands in a run of ``RUN`` words that occurred before in the same text, or in a line that did.
Case, punctuation, spacing and numbers don't count.  Which share is too much is decided by cutoffs with controlled risk
(``certified``): on a labelled holdout the lowest cutoff is chosen for which it is certain, by an exact binomial bound,
that at most a given part of the texts below the wanted share is rejected, in every stratum (language and length).  The
holdout labels itself: all texts of the corpus, freed of their repetitions, into which repetitions of a known share were put.
What is certified is the whole rule, ``score`` >= cutoff.
"""

from __future__ import annotations

import functools
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpoint, per_row
from .prose import ANY_FUNCTION_WORD, LANGUAGES, _EDGES, _ITEM, _OWN, is_sentence, language_of, segments, sentences, without_markup

RUN = 6
#: The share that makes a case, the part of the others that may be rejected, the probability that more are.
SHARE, RISK, ERROR = 0.4, 0.02, 0.05
GRID = tuple(round(0.30 + 0.01 * i, 2) for i in range(41))
LENGTHS = ("short", "long")
LONG = 120
STRATA = [f"{language} {length}" for language in (*LANGUAGES, "und") for length in LENGTHS]
_AT = {name: i * (len(GRID) + 1) for i, name in enumerate(STRATA)}
_STATES = len(STRATA) * (len(GRID) + 1)
#: No text of fewer characters has the LEAST_WORDS that ``holdout`` asks for.
LEAST_WORDS = 30
SHORTEST = 2 * LEAST_WORDS - 1

_DIGITS = re.compile(r"\d+")
_VOWELS = frozenset("aeiouyäöüáéíóúàèùâêîôûœ")


def _plain(token: str) -> str:
    bare = token.strip(_EDGES)
    return bare if bare.isalpha() else _DIGITS.sub("0", bare)


class _Known(dict):
    """``_plain`` of each token asked for.  Of a text's tokens most came before; those longer than TOKEN aren't kept, and all are dropped at MOST."""

    TOKEN, MOST = 40, 100_000

    def __missing__(self, token: str) -> str:
        word = _plain(token)
        if len(token) <= self.TOKEN:
            if len(self) >= self.MOST:
                self.clear()
            word = self[token] = self.setdefault(word, word)  # equal words are one object, which compares faster
        return word


_word = _Known().__getitem__


def words(text: str) -> list[str]:
    """Lower-case words without the punctuation around them, any number as 0."""
    return list(filter(None, _tokens(text)))


def _tokens(text: str) -> list[str]:
    """The word of each token, "" for none."""
    return list(map(_word, text.lower().split()))


def _cut(tokens: list[str], parts: list[str]) -> list[list[str]]:
    """The words of each part of a text whose tokens are these."""
    out, end = [], 0
    for part in parts:
        begin, end = end, end + len(part.split())
        out.append(list(filter(None, tokens[begin:end])))
    return out


def repeated(tokens: list[str], run: int = RUN) -> int:
    """How many of the tokens stand in a run of so many tokens that began before."""
    return sum(b - a for a, b in _runs(tokens, run))


def _again(tokens: list[str]) -> int:
    """How many runs of three tokens came before.  A longer run that comes twice has all of its runs of three among them."""
    return max(0, len(tokens) - 2) - len(set(zip(tokens, tokens[1:], tokens[2:])))


def _runs(tokens: list[str], run: int) -> list[tuple[int, int]]:
    """The stretches of such tokens, begin and end."""
    if run > 3 and _again(tokens) < run - 2:
        return []
    grams = list(zip(*(tokens[j:] for j in range(run))))
    seen: set[tuple] = set()
    add = seen.add
    out: list[tuple[int, int]] = []
    if len(set(grams)) == len(grams):
        return out
    for i, gram in enumerate(grams):
        if gram in seen:
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], i + run)
            else:
                out.append((i, i + run))
        else:
            add(gram)
    return out


def _lines(lines: list[str], said: list[list[str]]) -> list[tuple[int, int]]:
    """The stretches of words in lines of two to RUN - 1 words that came before; labels and numbers aside, a line says something if it has a function word or ends like a sentence."""
    out: list[tuple[int, int]] = []
    seen: set[tuple] = set()
    at = 0
    for line, tokens in zip(lines, said):
        key = tuple(tokens)
        n = len(key)
        if 1 < n < RUN and any(w.isalpha() for w in key):
            if key not in seen:
                seen.add(key)
            elif line.rstrip().endswith((".", "!", "?", "…")) or any(w in ANY_FUNCTION_WORD for w in key):
                out.append((at, at + n))
        at += n
    return out


def _united(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> int:
    covered, end = 0, 0
    for x, y in sorted(a + b):
        covered += max(0, y - max(x, end))
        end = max(end, y)
    return covered


def repeated_share(text: str | None, known: list[str] | None = None) -> tuple[float, int]:
    """Repeated share and number of words; (0.0, 0) for no words.  Words in runs and in lines of two to RUN - 1 words that came before, each once.  known: the text's ``_tokens``."""
    known = _tokens(text or "") if known is None else known
    tokens = list(filter(None, known))
    n = len(tokens)
    if n < 4:
        return 0.0, n
    runs, lines = _runs(tokens, RUN), text.split("\n")
    return _united(runs, _lines(lines, _cut(known, lines)) if len(lines) > 1 else []) / n, n


def is_wordy(text: str) -> bool:
    """Whether the text consists of words, not of codes, single letters or broken characters."""
    return _wordy(set(words(without_markup(text))))


def _wordy(tokens: set[str]) -> bool:
    good = [t for t in tokens if t.isalpha() and 1 < len(t) <= 60]
    vowels = len(good) - sum(map(_VOWELS.isdisjoint, good))
    return bool(tokens) and len(good) >= 0.5 * len(tokens) and vowels >= 0.8 * len(good)


def _in(some: frozenset[str], tokens: list[str]) -> int:
    return sum(map(some.__contains__, tokens))


def without_rows(text: str) -> str:
    """The text less its table rows and list entries.  A line of cells counts as a row if it says many different things."""
    return _without_rows(without_markup(text))


def _without_rows(text: str, said: list[str] | None = None) -> str:
    """said: the words of a text of one line."""
    kept = []
    for line in text.split("\n"):
        tokens = words(line) if said is None else said
        cells = line.count(",") + line.count("\t") + line.count("|") + line.count("  ") + line.count(";")
        item = _ITEM.match(line)
        few = tokens and (cells > 1 or item) and _in(ANY_FUNCTION_WORD, tokens) <= 0.1 * len(tokens)
        digits = len(tokens) - sum(map(str.isalpha, tokens)) if few else 0
        row = cells > 1 and few and (digits >= 0.3 * len(tokens) or len(set(tokens)) > 0.6 * len(tokens) and len(tokens) <= 3 * cells)
        entry = tokens and item and (few and len(tokens) < 12 or len(tokens) < 7)
        if not row and not entry and (not tokens or any(map(str.isalpha, tokens))):
            kept.append(line)
    return "\n".join(kept)


def collapsed(text: str) -> str:
    """The text with each sentence or line said once, and less runs of three words that a fifth of it or more repeats."""
    return _collapsed(text)[0]


def _collapsed(text: str, known: list[str] | None = None) -> tuple[str, list[str], int]:
    """The text collapsed, its words and how many runs of three of them came before.  known: the text's ``_tokens``."""
    seen, kept, plain = set(), [], []
    parts = segments(text)
    if known is None or len(known) != sum(len(p.split()) for p in parts):  # page numbers are in no part
        known = _tokens(" ".join(parts))
    for part, said in zip(parts, _cut(known, parts)):
        key = tuple(said)
        if len(key) < 2 or key not in seen:
            kept.append(part)
            plain += key
        seen.add(key)
    text = " ".join(kept)
    more = _again(plain)
    if 15 * more < len(plain) or 5 * repeated(plain, 3) < len(plain):
        return text, plain, more
    tokens = [(t, p) for t in text.split() if (p := _plain(t.lower()))]
    grams: set[tuple] = set()
    again: set[int] = set()
    for i, gram in enumerate(zip(plain, plain[1:], plain[2:])):
        if gram in grams:
            again.update((i, i + 1, i + 2))
        grams.add(gram)
    plain = [p for i, p in enumerate(plain) if i not in again]
    return " ".join(t for i, (t, _) in enumerate(tokens) if i not in again), plain, _again(plain)


def stratum(text: str, n: int) -> str:
    return f"{language_of(words(text))} {LENGTHS[n >= LONG]}"


def score(text: str | None, least: float = 0.0, known: list[str] | None = None) -> tuple[float, float, int]:
    """What is held against the cutoff, the repeated share and the number of words.

    The score is the repeated share, or that of the text without rows, entries and markup if it is smaller; 0 where what
    is repeated isn't language.  A share below ``least`` is its own score: it isn't looked at closer.
    known: the text's ``_tokens``.
    """
    got, n = repeated_share(text, known)
    if got < least or not got:
        return got, got, n
    return _closer(text, got, n), got, n


def _closer(text: str, got: float, n: int, said: list[str] | None = None, wordy: Callable[[], bool] | None = None) -> float:
    """The score of a text with the repeated share ``got`` of its n words.  said: the words of a text of one line, if they are known; wordy: ``_wordy`` of them."""
    bare = without_markup(text)
    if bare != text:
        said = None
    if not (wordy() if wordy and said is not None else _wordy(set(words(bare) if said is None else said))):
        return 0.0
    kept = _without_rows(bare, said)
    rest, m = (got, n) if kept == text else repeated_share(kept)
    return min(got, rest / 0.98) if m >= 8 else 0.0


def insertion(tokens: list[str], parts: Callable[[], list[str]], share: float, kind: int, rng: random.Random) -> tuple[int, list[str]]:
    """Where in the tokens which others are put in, to make up the given share with what they repeat.  parts: the sentences of the tokens."""
    n = len(tokens)
    wanted = round(share / (1 - share) * n)
    if not wanted:
        return n, []
    if kind == 0:  # one word
        unit = [rng.choice(tokens)]
    elif kind == 1:  # a phrase
        at = rng.randrange(max(1, n - 8))
        unit = tokens[at : at + rng.randint(4, 8)]
    elif kind == 2:  # a sentence
        unit = rng.choice([p for p in parts() if len(p.split()) >= 6] or [" ".join(tokens)]).split()
    else:  # all from the start
        unit = tokens
    more = (unit * (wanted // len(unit) + 1))[:wanted]
    at = n if rng.random() < 0.6 else rng.randrange(n)
    return at, (unit if kind < 2 else []) + more


def _repeated_with(said: list[str], first: dict[tuple, int], at: int, more: list[str]) -> int:
    """repeated(said[:at] + more + said[at:]) where no run of ``said`` comes twice.  first: where in ``said`` each run begins.

    Only runs that touch ``more`` can have come before, and those after it that are one of them.
    """
    if not more:
        return 0
    left, last, never = max(0, at - RUN + 1), at - RUN, len(said)
    mid = said[left:at] + more + said[at : at + RUN - 1]
    seen: set[tuple] = set()
    begins, after = [], set()
    for i, gram in enumerate(zip(*(mid[j:] for j in range(RUN))), left):
        there = first.get(gram, never)
        if there <= last or gram in seen:
            begins.append(i)
        else:
            seen.add(gram)
        if at <= there < never:
            after.add(there + len(more))
    if after:
        begins += sorted(after)
    if not begins:
        return 0
    if begins[-1] - begins[0] < len(begins):  # one stretch
        return begins[-1] - begins[0] + RUN
    return sum(min(RUN, b - a) for a, b in zip(begins, begins[1:])) + RUN


def binomial_tail(n: int, k: int, p: float) -> float:
    """Probability of at most k of n at the rate p.  Terms 40 standard deviations from the mean, under 1e-300, are left out."""
    mean, far = int(n * p), int(40 * math.sqrt(n * p * (1 - p))) + 40
    some = range(max(0, min(k, mean) - far), min(k, mean + far) + 1)
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in some)


_RNG = random.Random()


def _leader(own: list[str]) -> tuple[str, int]:
    """``language_of`` words that only one language has, and by how many it leads."""
    votes = sorted((-n, k) for k, n in Counter(map(_OWN.get, own)).items())
    return (votes[0][1], votes[1][0] - votes[0][0] if votes[1:] else -votes[0][0]) if votes else ("und", 0)


def _parts(clean: str, plain: list[str], n_tokens: int) -> list[str]:
    """segments(clean) of one line too long for a page number, whose words are known."""
    cells = clean.count(",") + clean.count("\t") + clean.count("|") + clean.count("  ") + clean.count(" & ")
    tabular = cells > 1 and _in(ANY_FUNCTION_WORD, plain) <= 0.1 * n_tokens
    return [clean] if tabular or _ITEM.match(clean) else sentences(clean)


def holdout(text: str, share: float = SHARE, least: float = 0.0, known: list[str] | None = None) -> list[tuple[str, float]]:
    """Stratum and score of rows that are no cases: the text as it is without its repetitions, and with some put in that make up less than ``share``.

    Two of three rows have repetitions, of any share up to 0.02 below the wanted one.  A text that can't be freed of its own gives none.
    Scores below ``least`` are only known to be so; they aren't looked at closer.  known: the text's ``_tokens``.
    """
    clean, plain, again = _collapsed(text, known)
    n = len(plain)
    if n < LEAST_WORDS:
        return []
    firsts = functools.cache(lambda: dict(zip(zip(*(plain[j:] for j in range(RUN))), range(n))))
    once = again < RUN - 2 or len(firsts()) == n - RUN + 1
    before = 0 if once else repeated(plain)
    if before > 0.05 * n:
        return []
    tokens = clean.split()
    pairs = plain if n == len(tokens) else list(map(_word, clean.lower().split()))
    own = list(filter(_OWN.__contains__, plain))
    language, lead = _leader(own)
    parts = functools.cache(lambda: _parts(clean, plain, len(tokens)))
    wordy = functools.cache(lambda: _wordy(set(plain)))  # what is put in are words of the text
    rng = _RNG
    rng.seed(clean)
    rows = []
    for k in range(3):
        at, more = insertion(tokens, parts, 0.0 if k == 0 else rng.uniform(0.05, share - 0.02), rng.randrange(4), rng)
        put = list(filter(None, map(_word, map(str.lower, more))))
        size = n + len(put)
        if at == len(tokens) and (most := (before + RUN - 1 + len(put)) / size) < least:
            s = most  # at the end only what is put in, and RUN - 1 words before it, is repeated besides what was before
        else:
            begin = at if pairs is plain else sum(map(bool, pairs[:at]))
            said = plain[:begin] + put + plain[begin:]
            got = (_repeated_with(plain, firsts(), begin, put) if once else repeated(said)) / size
            s = got if got < least or not got else _closer(" ".join(tokens[:at] + more + tokens[at:]), got, size, said, wordy)
        votes = list(filter(_OWN.__contains__, put))
        name = language if len(votes) < lead else language_of(own + votes)
        rows.append((f"{name} {LENGTHS[size >= LONG]}", s))
    return rows


def certified(rows: Iterable[tuple[str, float]], risk: float = RISK, error: float = ERROR) -> dict[str, float]:
    """The lowest certified cutoff of each stratum, of each length over all languages ("* long"), and of all ("*").

    rows: stratum and score of texts that are no cases.  From the highest cutoff down, each is tested for the hypothesis
    that it rejects more than ``risk`` of them; the tests of a stratum are in fixed order and stop at the first that isn't
    certain, so they need no correction among each other; those of several strata share the error by Bonferroni's bound.
    A stratum whose rows certify no cutoff isn't in the result.
    """
    return certified_counts(Counter((name, bisect_right(GRID, s)) for name, s in rows), risk, error)


def certified_counts(counts: dict[tuple[str, int], int], risk: float = RISK, error: float = ERROR) -> dict[str, float]:
    """``certified`` from the number of rows of each stratum that reach so many cutoffs of GRID."""
    held: dict[str, list[int]] = {}
    for (name, reach), n in counts.items():
        for k in (name, f"* {name.split()[-1]}", "*"):
            held.setdefault(k, [0] * (len(GRID) + 1))[reach] += n
    found: dict[str, float] = {}
    for name, reached in sorted(held.items()):
        for i in reversed(range(len(GRID))):
            if binomial_tail(sum(reached), sum(reached[i + 1 :]), risk) > error / len(held):
                break
            found[name] = GRID[i]
    return found


def cutoff_of(name: str, found: dict[str, float]) -> float | None:
    """The certified cutoff of a stratum, else that of its length, else that of all; None if there is none."""
    return next((found[k] for k in (name, f"* {name.split()[-1]}", "*") if k in found), None)


def _measured(df: DataFrame, keys: list[str], text: str, share: float) -> DataFrame:
    """keys and, from one reading of each text: its words, repeated share, score and stratum, its hash and ``_at``, what its rows of the holdout are.

    Score and stratum are those for any cutoff of GRID: a share below all of them isn't looked at closer and has no stratum.
    """
    least = min(GRID[0], share)

    def make():
        seen: set[int] = set()  # most copies stand near each other

        def measure(t: str | None, code: int) -> tuple:
            known = _tokens(t or "")
            s, got, n = score(t, least, known)
            at = None
            if t and len(t) >= SHORTEST and code not in seen:
                seen.add(code)
                for name, x in holdout(t, share, GRID[0], known):
                    at = (at or 0) * _STATES + _AT[name] + bisect_right(GRID, x)
            return n, got, s, stratum(t, n) if t and got >= least else None, at

        return measure

    some = df.select(*[F.col(f"`{k}`") for k in keys], F.col(text).alias("_text"), F.xxhash64(text).alias("_code"))
    return per_row(some, [*keys, "_code"], ["_text", "_code"], make, [("n_words", "int"), ("repeated_share", "double"), ("_score", "double"), ("stratum", "string"), ("_at", "int")])


def _counts(measured: DataFrame) -> dict[tuple[str, int], int]:
    each = measured.where("_at is not null").select("_code", "_at").dropDuplicates(["_code"])
    three = F.array(*[F.floor(F.col("_at") / _STATES**i) % _STATES for i in range(3)])
    counts = each.select(F.explode(three).alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect()
    return {(STRATA[r["at"] // (len(GRID) + 1)], r["at"] % (len(GRID) + 1)): r.n for r in counts}


def holdout_counts(df: DataFrame, text: str, share: float = SHARE) -> dict[tuple[str, int], int]:
    """How many rows of the holdout there are of each stratum that reach so many cutoffs of GRID, of all texts of df, copies once.

    A text leaves its hash and a number for its three rows; the driver gets one count for each stratum and number of cutoffs.
    """
    return _counts(_measured(df, [], text, share))


def repeated_content(df: DataFrame, keys: list[str], text: str, share: float = SHARE, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """keys, n_words, repeated_share, stratum, cutoff, certified, flagged for each row of df.

    Null, empty and blank texts have no words and the share 0.0.  Texts of any length are read whole, once: what is measured of
    them is checkpointed and held against the cutoffs when these are known.  Equal rows each come out; ties don't arise.
    flagged: the score reaches the cutoff of the stratum, which may lie above or below ``share``; where no cutoff
    could be certified, not even over all strata (as for tables of a few texts), it is ``share`` and certified is false.  Texts
    with a share below the lowest cutoff have no stratum.  An empty table gives an empty result.
    """
    measured = checkpoint(_measured(df, keys, text, share))
    cut = certified_counts(_counts(measured), risk, error)
    cutoffs = {name: cutoff_of(name, cut) for name in STRATA}
    held = F.create_map(*[F.lit(x) for name, c in cutoffs.items() for x in (name, share if c is None else c)])
    name = F.when(F.col("repeated_share") >= min([*cut.values(), share]), F.col("stratum"))
    of = measured.withColumn("stratum", name).withColumn("cutoff", held[F.col("stratum")])
    sure = F.when(F.col("stratum").isNotNull(), F.col("stratum").isin([name for name, c in cutoffs.items() if c is not None]))
    flagged = F.coalesce(F.col("_score") >= F.col("cutoff"), F.lit(False))
    return of.select(*[F.col(f"`{k}`") for k in keys], "n_words", "repeated_share", "stratum", "cutoff", sure.alias("certified"), flagged.alias("flagged"))
