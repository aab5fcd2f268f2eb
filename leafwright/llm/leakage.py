"""Evaluation texts leaking into training text.

The passages of the items, as words without case and punctuation, make up one generalised suffix automaton.  Each document
is streamed through it, and the longest match with any passage is tracked word by word; matches of at least ``SPAN`` words
name the passages that own them.  A word is carried if it stands in such a common span: single equal words between
different texts are no trace of a passage, and a changed word only parts two spans.  A pair is an item and a document of
which a stretch, at most ``STRETCH`` times as long as the passage, carries at least ``COVER`` of its words in order.  The
automaton leaves out no pair: a passage is looked at closer wherever enough words of the document stand in its spans, and
the best stretch is then found exactly.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpoint

COVER, STRETCH = 0.4, 1.5
#: Least length of a common span.  With 1, all words that are in order count, wherever they stand.
SPAN = 3
#: Words of the distinct passages in one automaton: at most twice as many states, about 60 MB in a task.  More items are
#: worked off in blocks, each of which streams the documents again.
BLOCK_WORDS = 200_000

_BREAK = re.compile(r"[-¬\xad‐]\s*\n\s*(?=[^\W\d_])|\xad")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-case words; those broken over two lines are joined, accents are composed."""
    if "\n" in text or "\xad" in text:
        text = _BREAK.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    out: list[str] = []
    for t in text.lower().split():
        if t.isalpha():
            out.append(t)
        else:
            out += _WORD.findall(t)
    return out


def passage(text: str) -> str:
    """The item's text without its line of instruction: the first of several lines, if it is short and the rest is longer."""
    first, _, rest = text.strip().partition("\n")
    return rest.strip() if rest.strip() and len(first.split()) <= 16 and len(rest) > 2 * len(first) else text.strip()


class Automaton:
    """Suffix automaton of several sequences, built state by state, then flat: a table of transitions and lists.

    top: of each state with a match of ``span`` words the state of its last ``span`` words alone; owners: the sequences that
    hold these, by top state.
    """

    def __init__(self, sequences: list[list[int]], n_codes: int, span: int = SPAN):
        self.n_codes, self.span = max(1, n_codes), span
        self._next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for s in sequences:
            last = 0
            for c in s:
                last = self._add(last, c)
        n = len(self._next)
        self.top = [-1] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            if self.length[v] >= span:
                self.top[v] = v if self.length[self.link[v]] < span else self.top[self.link[v]]
        held: dict[int, set[int]] = {}
        for k, s in enumerate(sequences):
            state = 0
            for i, c in enumerate(s, 1):
                state = self._next[state][c]
                if i >= span:
                    held.setdefault(self.top[state], set()).add(k)
        self.owners = {v: np.array(sorted(h), np.int32) for v, h in held.items()}
        self.table = {v * self.n_codes + c: t for v, out in enumerate(self._next) for c, t in out.items()}
        del self._next

    def _add(self, last: int, c: int) -> int:
        nxt, link, length = self._next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self._next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def packed(self) -> tuple:
        """What a task needs, in arrays."""
        tops = list(self.owners)
        return (
            self.n_codes, self.span, np.fromiter(self.table, np.int64, len(self.table)), np.fromiter(self.table.values(), np.int32, len(self.table)),
            np.array(self.link, np.int32), np.array(self.length, np.int32), np.array(self.top, np.int32), np.array(tops, np.int32), [self.owners[v] for v in tops],
        )

    @classmethod
    def unpacked(cls, parts: tuple) -> Automaton:
        self = cls.__new__(cls)
        self.n_codes, self.span, keys, targets, link, length, top, tops, owners = parts
        self.table = dict(zip(keys.tolist(), targets.tolist()))
        self.link, self.length, self.top = link.tolist(), length.tolist(), top.tolist()
        self.owners = dict(zip(tops.tolist(), owners))
        return self

    def stream(self, sequence: list[int]) -> Iterator[tuple[int, int, int]]:
        """Place, length of the longest match that ends there, and its top state, where the match has at least ``span`` words."""
        get, link, length, top, width, span = self.table.get, self.link, self.length, self.top, self.n_codes, self.span
        state = n = 0
        for i, c in enumerate(sequence):
            if c < 0:
                state = n = 0
                continue
            to = get(state * width + c)
            while to is None:  # the root has every word that a passage has
                state = link[state]
                n = length[state]
                to = get(state * width + c)
            state = to
            n += 1
            if n >= span:
                yield i, n, top[state]


def in_order(masks: list[int], m: int) -> int:
    """Length of the longest common subsequence of a passage of m words and a window, whose masks name the places each of its words fits."""
    full = (1 << m) - 1
    v = full
    for x in masks:
        u = v & x
        if u:
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def least(m: int) -> int:
    """The least number of words that is at least COVER of m."""
    return math.ceil(COVER * m - 1e-9)


def span_masks(places: dict[int, int], window: list[int], span: int) -> list[int]:
    """For each word of the window the places of the passage with which it stands in a common span of at least ``span`` words."""
    plain = [places.get(c, 0) for c in window]
    if span == 1:
        return plain
    out = [0] * len(window)
    for j in range(span - 1, len(window)):
        ends = plain[j]
        for d in range(1, span):
            ends &= plain[j - d] << d
            if not ends:
                break
        else:
            for d in range(span):
                out[j - d] |= ends >> d
    return out


def greatest(masks: list[int], m: int, size: int) -> tuple[int, int]:
    """Most words of a passage in order in ``size`` words running, and the first place where such a stretch begins; (0, 0) below least(m).

    A longer window has no fewer words in order than the stretches in it, so windows with too few are dropped whole and the others halved.
    """
    best, at = 0, 0
    floor = least(m)
    parts = [(0, max(1, len(masks) - size + 1))]
    while parts:
        a, b = parts.pop()
        got = in_order(masks[a : b - 1 + size], m)
        if got < floor or got <= best:
            continue
        if b - a == 1:
            best, at = got, a
        else:
            middle = (a + b) // 2
            parts += [(middle, b), (a, middle)]
    return best, at


class Finder:
    """The items of one block; equal passages are looked for once, however many items have them."""

    def __init__(self, items: list[tuple[int, str]], span: int = SPAN):
        self.code: dict[str, int] = {}
        held: dict[tuple[int, ...], list[int]] = {}
        for k, t in items:
            if s := tuple(self.code.setdefault(w, len(self.code)) for w in words(passage(t))):
                held.setdefault(s, []).append(k)
        self.passages, self.ids, self.span = list(held), list(held.values()), span
        self.automaton = Automaton([list(s) for s in self.passages], len(self.code), span)
        self._ready()

    def _ready(self) -> None:
        self.least = np.array([least(len(s)) for s in self.passages])
        self.places: dict[int, dict[int, int]] = {}

    def packed(self) -> tuple:
        return list(self.code), [np.array(s, np.int32) for s in self.passages], self.ids, self.span, self.automaton.packed()

    @classmethod
    def unpacked(cls, parts: tuple) -> Finder:
        self = cls.__new__(cls)
        names, passages, self.ids, self.span, automaton = parts
        self.code = {w: i for i, w in enumerate(names)}
        self.passages = [tuple(s.tolist()) for s in passages]
        self.automaton = Automaton.unpacked(automaton)
        self._ready()
        return self

    def _places(self, k: int) -> dict[int, int]:
        if k not in self.places:
            masks: dict[int, int] = {}
            for i, c in enumerate(self.passages[k]):
                masks[c] = masks.get(c, 0) | 1 << i
            self.places[k] = masks
        return self.places[k]

    def find(self, text: str | None) -> list[tuple[int, float, int]]:
        """item, greatest share of its words that a stretch carries, first word of that stretch, for the items of which it has at least COVER."""
        if not text:
            return []
        get, owners, span = self.code.get, self.automaton.owners, self.span
        sequence = [get(w, -1) for w in words(text)]
        ends, held = [], []
        for i, _, top in self.automaton.stream(sequence):
            ends.append(i)
            held.append(owners[top])
        if not ends:
            return []
        who = np.concatenate(held)
        at = np.repeat(np.array(ends), [len(h) for h in held])
        enough = np.flatnonzero(span * np.bincount(who, minlength=len(self.least)) >= self.least)
        found = []
        for k in enough.tolist():
            covered = np.unique(at[who == k][:, None] - np.arange(span))
            need, m = int(self.least[k]), len(self.passages[k])
            size = int(STRETCH * m)
            if len(covered) < need:
                continue
            first, last = covered[: len(covered) - need + 1], covered[need - 1 :]
            fits = last - first < size
            if not fits.any():
                continue
            low, high = max(0, int((last[fits] - size + 1).min())), int(first[fits].max()) + size
            start = max(0, low - span + 1)  # spans may begin before the first stretch
            masks = span_masks(self._places(k), sequence[start : high + span - 1], span)[low - start :][: high - low]
            got, place = greatest(masks, m, size)
            if got:
                found += [(i, got / m, low + place) for i in self.ids[k]]
        return found


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_WORDS words of distinct passages; one block is held at a time."""
    block: list[tuple[int, str]] = []
    room, before = BLOCK_WORDS, None
    rows = items.select(F.col(item).alias("k"), F.col(text).alias("t")).where("k is not null and trim(t) <> ''").distinct().orderBy("t", "k")
    for r in rows.toLocalIterator():
        if r.t != before:
            n = len(r.t.split())
            if n > room and block:
                yield block
                block, room = [], BLOCK_WORDS
            room -= n
            before = r.t
        block.append((r.k, r.t))
    if block:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """item, doc, cover, first_word: the items of which a stretch of a document carries at least COVER of the passage, how much, and where it begins.

    span: least length of the common spans whose words count; 1 counts all words that are in order.  Null and empty texts
    leak nothing.  Items with the same passage each come out.  A pair comes out once, with its greatest cover (of equal ones
    the first place), even if rows are repeated.  The items come to the driver block by block (BLOCK_WORDS); each block's
    automaton goes to the tasks as arrays and is streamed over all documents.  An empty table of either gives an empty result.
    """
    schema = f"{item} {dict(items.dtypes)[item]}, {doc} {dict(documents.dtypes)[doc]}, cover double, first_word int"
    picked = documents.select(doc, text).where(F.col(text).isNotNull())
    spark = documents.sparkSession

    def searched(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Finder(block, span).packed())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder.unpacked(shared.value)
            for b in batches:
                rows = [(k, i, c, p) for i, t in enumerate(b.column(1).to_pylist()) for k, c, p in finder.find(t)]
                docs = b.column(0).take(pa.array([r[1] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), docs, pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int32())], names=[item, doc, "cover", "first_word"])

        return picked.mapInArrow(run, schema)

    found = None
    for block in _blocks(items, item, item_text):
        part = searched(block)
        found = part if found is None else checkpoint(found).unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    best = F.max(F.struct("cover", (-F.col("first_word")).alias("p"))).alias("b")
    return found.groupBy(item, doc).agg(best).select(item, doc, "b.cover", (-F.col("b.p")).alias("first_word"))
