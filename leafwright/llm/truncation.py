"""Text cut off by field limits: attempts whose prose stops although their page goes on.

Lengths are recomputed under the encodings a store may count in (``lengths``); a length that far more unfinished texts of
an engine have than its neighbours is a hidden limit (``storage_limits``).  Then the endings are inspected: marks in place
of the rest, words broken off, sentences that neither end nor go on at the top of the next page, and other readings of the
same page that have more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpoint, per_row
from .prose import _EDGES, _ITEM, ANY_FUNCTION_WORD, is_page_number, prose_share, without_markup, words_of

#: Characters of the ends that are looked at first; where they don't decide, more are.
EDGE = 400
#: A capital letter at the top of a page begins no sentence if its word stands within sentences so many times as often as at their beginnings.
WITHIN = 4
#: Longer strings go by their hash.
LONG_WORD = 40
ENCODINGS = ("chars", "utf8", "crlf", "json", "html")
#: A limit: at least so many unfinished texts, and so many times the mean of the lengths around it.
LEAST_AT_LIMIT, OVER_NEIGHBOURS, NEIGHBOURS = 6, 8.0, 12

_NUMBER_GOES_ON = re.compile(r"\d[\d.,]*%?\s+(?:[^\W\dA-Z]|[^\W\d_]+\s+[^\W\dA-Z_]+\s+[^\W\dA-Z_]+)")
_MARK = re.compile(r"(?:\.{3,}|…|\[[.…]+\]|\[(?:cut|truncated|continued|more|snip)[^\]]*\]|\((?:cut|truncated|continued|more)[^)]*\)|<(?:truncated|cut)[^>]*>|-{3,}|\[?\.\.\.[a-z ]*\]?)\s*$", re.I)
_ENDED = re.compile(r"[.!?:;]['\"”’»)\]}*_`]*\s*$")
_LAST_TAG = re.compile(r"</?(\w+)[^<>]{0,200}>$")
#: Marks that end a block, and what it began with.
_BLOCKS = (("$$", "$$"), ("```", "```"), ("|}", "{|"), ("}}", "{{"), ("\\]", "\\["))
_HEADING = re.compile(r"^\s*(?:#{1,6}\s.*|={2,}.*={2,}|(?:\d+(?:\.\d+)*\.?\s+)?[^\Wa-z][^.!?,;]{0,60})$")


def lengths(text: str) -> tuple[int, ...]:
    """Length in characters, in UTF-8, with CRLF for LF, escaped as JSON, escaped as HTML."""
    n = len(text)
    newlines = text.count("\n")
    escaped = newlines + text.count('"') + text.count("\\") + text.count("\t") + text.count("\r")
    entities = 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * text.count('"')
    return n, len(text.encode("utf-8", "surrogatepass")), n + newlines, n + escaped, n + entities


def last_prose(text: str) -> str:
    """The text less blocks of markup, list entries and table rows at its end."""
    while True:
        text = text.rstrip()
        size = len(text)
        last = text[-1:]
        if last == ">" and (m := _LAST_TAG.search(text[-220:])):
            at = text.rfind(f"<{m[1]}") if m[1].lower() in ("ul", "ol", "table", "pre") else -1
            text = text[: at if at >= 0 else size - len(m[0])]
        elif last in "$`}]" and last:
            for end, begin in _BLOCKS:
                if text.endswith(end) and (at := text.rfind(begin, 0, -len(end))) >= 0:
                    text = text[:at]
                    break
            else:
                line = text[text.rfind("\n") + 1 :]
                if line.startswith("\\end{") and (at := text.rfind("\\begin{")) >= 0 or last == "}" and (at := text.rfind("\\cite", size - 90)) >= 0 or last == "]" and (at := text.rfind("[^", size - 8)) >= 0:
                    text = text[:at].rstrip("~")
        elif last == ")" and (at := text.rfind("![", max(0, size - 300))) >= 0 and "\n" not in text[at:]:
            text = text[:at]
        else:
            line = text[text.rfind("\n") + 1 :]
            row = line.count("|") > 1 or "\t" in line and line.count("\t") > 1 or line.count("  ") > 1 and any(c.isdigit() for c in line)
            if line and line != text and (row or _ITEM.match(line) and not any(w in ANY_FUNCTION_WORD for w in words_of(_ITEM.sub("", line)))):
                text = text[: size - len(line)]
        if len(text) == size:
            return text


def ending(text: str) -> tuple | None:
    """How unfinished prose ends: mark, last word, whether it may be a heading; None for text that is finished or isn't prose."""
    last = text.rstrip()
    if is_page_number(last[last.rfind("\n") + 1 :]):
        return None
    body = last_prose(text)
    if not body:
        return None
    mark = _MARK.search(body[-60:])
    if not mark and _ENDED.search(body[-40:]):
        return None
    inside, total, _ = prose_share(text)
    if inside < 0.35 * total or total < 5:
        return None
    block = body[body.rfind("\n\n") + 1 :].strip()
    line = body[body.rfind("\n") + 1 :].strip()
    if is_page_number(line):
        return None
    heading = not mark and len(block.split()) <= 6 and _HEADING.match(block) is not None and not (set(words_of(block)) & ANY_FUNCTION_WORD)
    plain = _MARK.sub("", body[-200:]) if mark else body[-200:]
    tokens = plain.split()
    return bool(mark), (tokens[-1].strip(_EDGES).lower() if tokens else ""), heading


def _heads(line: str) -> bool:
    """Whether a page's first line looks like a running header: short, and most words of more than three letters begin with capitals."""
    long = [w for w in words_of_case(line) if len(w) > 3]
    return len(line) < 75 and not line.endswith((".", ",", ";", ":")) and sum(w[0].isupper() for w in long) >= 0.75 * len(long)


def words_of_case(line: str) -> list[str]:
    return [w for w in (t.strip(_EDGES) for t in line.split()) if w[:1].isalpha()]


def goes_on(text: str) -> tuple[bool, str | None]:
    """Whether a page begins inside a sentence, and if that is open the capitalised word it begins with; a page number or header lines above don't matter."""
    size = EDGE
    while True:
        body = without_markup(text[:size])
        lines = body.split("\n")
        if size < len(text):
            lines.pop()  # it may go on
        for line in lines:
            line = line.strip()
            if line and not is_page_number(line):
                if line[0].islower():
                    return True, None
                if line[0].isdigit() and _NUMBER_GOES_ON.match(line) and len(line) > 45 and "...." not in line:
                    return True, None
                if not _heads(line):
                    first = line.split(None, 1)[0].strip(_EDGES)
                    return False, first if first.istitle() and len(line.split()) > 3 else None
        if size >= len(text):
            return False, None
        size *= 4


def named(word: str) -> str:
    """The word, or the hash of a long one."""
    return word if len(word) < LONG_WORD else xxhash.xxh3_64_hexdigest(word)


def end_words(text: str) -> list[str]:
    """What readings of a page that end at the same place have in common: their last three words, and the three before the last, which may be misread, with its first letter."""
    size = EDGE
    while True:
        found = [w for w in words_of(without_markup(last_prose(text[-size:]))) if w]
        if len(found) > 3 or size >= len(text):
            break
        size *= 4
    last = found[-4:]
    return [" ".join(last[-3:]), " ".join([*last[:-1], last[-1][0], "…"])] if len(last) == 4 else [" ".join(last)]


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """word, inside, at_end, begins, within: how often each word stands in the texts, at their ends and before a hyphen aside; how often as a text's last; how often with a capital at the beginning of a sentence or paragraph, and within one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, ends, begins, within = Counter(), Counter(), Counter(), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                tokens = t.split()
                if not tokens:
                    continue
                ends[tokens.pop().strip(_EDGES).lower()] += 1
                inside.update(tokens)
                for block in _PARAGRAPH.split(t):
                    open_ = True
                    for w in block.split():
                        if w[0].isupper() and w[1:].islower() and w.isalpha():
                            (begins if open_ else within)[w.lower()] += 1
                        open_ = w[-1] in ".!?:…"
        exact: Counter = Counter()
        for w, n in inside.items():
            w = w.lower()
            if w.isalpha():
                exact[w] += n
            elif w[-1] not in "-¬\xad‐":
                exact[w.strip(_EDGES)] += n
        names = [w for w in exact.keys() | ends.keys() | begins.keys() | within.keys() if w]
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(named, part))), *[pa.array([c[w] for w in part], pa.int64()) for c in (exact, ends, begins, within)]], names=["word", *_COUNTS])

    counted = df.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "word string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS])


_COUNTS = ("inside", "at_end", "begins", "within")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def storage_limits(unfinished: DataFrame, source: str) -> DataFrame:
    """source, encoding, length, n of the hidden limits, from the lengths of unfinished texts (columns of ENCODINGS)."""
    at = unfinished.select(source, F.explode(F.map_from_arrays(F.array(*map(F.lit, ENCODINGS)), F.array(*ENCODINGS))).alias("encoding", "length")).groupBy(source, "encoding", "length").agg(F.count("*").alias("n"))
    around = at.select(source, "encoding", F.explode(F.sequence(F.col("length") - NEIGHBOURS, F.col("length") + NEIGHBOURS)).alias("length"), "n").groupBy(source, "encoding", "length").agg(F.sum("n").alias("near"))
    return (
        at.where(F.col("n") >= LEAST_AT_LIMIT)
        .join(around, [source, "encoding", "length"])
        .withColumn("mean", (F.col("near") - F.col("n")) / (2 * NEIGHBOURS))
        # far over what is near, and more than chance gives one of so many lengths
        .where((F.col("n") >= OVER_NEIGHBOURS * F.col("mean")) & (F.col("n") >= F.col("mean") + 6 * F.sqrt("mean") + LEAST_AT_LIMIT))
        .select(source, "encoding", "length", "n")
    )


def _limit_of(found: DataFrame, keys: list[str], limits: DataFrame) -> DataFrame:
    each = found.select(*keys, "source", F.explode(F.map_from_arrays(F.array(*map(F.lit, ENCODINGS)), F.array(*ENCODINGS))).alias("encoding", "length"))
    first = -F.expr(f"array_position(array({','.join(repr(e) for e in ENCODINGS)}), encoding)")
    hit = each.join(limits, ["source", "encoding", "length"]).groupBy(*keys, "source").agg(F.max(F.struct("n", first.alias("first"), "encoding", "length")).alias("hit"))
    return hit.select(*keys, "source", "hit.encoding", "hit.length")


def truncated_texts(attempts: DataFrame, doc: str = "doc_id", page: str = "page_num", seq: str = "attempt_seq", source: str = "engine", text: str = "text", layers: DataFrame | None = None, layer_text: str = "native_text") -> DataFrame:
    """doc, page, seq, source, reason, limit_encoding, limit_length for each cut text; sources are compared in lower case.

    layers (doc, page, layer_text): other texts of the pages, at whose tops a sentence may go on and which may end alike.

    Rows that occur twice come out once; rows with a null in doc, page or seq are left out.  Null, empty and blank texts are never cut; text that isn't prose (lists, tables,
    broken characters) isn't either.  A null source is a source of its own.  Readings of one page that end alike are taken
    to end with it.  Texts of any length are read whole; an empty table gives an empty result.
    """
    keys = [doc, page, seq]
    rows = attempts.dropna(subset=keys).select(*keys, F.lower(F.trim(F.col(source))).alias("source"), F.col(text).alias("body")).where(F.trim("body") != "")
    # Where the last characters end a sentence nothing was cut; the rest is looked at in Python.
    open_ended = rows.where(~F.substring("body", -12, 12).rlike(r"[.!?:;]['\"”’»)\]}*_`]*\s*$") | F.substring("body", -12, 12).rlike(r"(\.\.\.|…)\W*$"))

    def make():
        def inspect(t: str) -> tuple | None:
            found = ending(t)
            if not found:
                return None
            mark, last, heading = found
            return mark, named(last), heading, end_words(t), len(without_markup(t).split()), *lengths(t)

        return inspect

    found = per_row(open_ended, [*keys, "source"], ["body"], make, [("mark", "boolean"), ("last_word", "string"), ("heading", "boolean"), ("end_words", "array<string>"), ("size", "int"), *((e, "int") for e in ENCODINGS)])
    found = checkpoint(found.dropDuplicates(keys))
    # The limit of a text: of the limits its lengths are equal to, the one that most texts share.  Texts cut by one limit
    # heap up at lengths under other encodings too; these are no limits: most of their texts have another one.
    limits = storage_limits(found, "source")
    own = _limit_of(found, keys, limits).groupBy("source", "encoding", "length").agg(F.count("*").alias("own"))
    limits = limits.join(own, ["source", "encoding", "length"]).where("own >= 0.5 * n").drop("own")
    hit = _limit_of(found, keys, checkpoint(limits)).select(*keys, F.col("encoding").alias("limit_encoding"), F.col("length").alias("limit_length"))
    # Other texts of a page count as readings of it.
    edges = lambda t: (*goes_on(t), end_words(t), len(without_markup(t).split()))
    fields = [("goes_on", "boolean"), ("first", "string"), ("end_words", "array<string>"), ("size", "int")]
    ends = per_row(rows, keys, ["body"], lambda: edges, fields).dropDuplicates(keys)
    if layers is not None:
        others = layers.dropna(subset=[doc, page]).where(F.trim(layer_text) != "").select(doc, page, layer_text)
        ends = ends.unionByName(per_row(others, [doc, page], [layer_text], lambda: edges, fields).dropDuplicates([doc, page]), allowMissingColumns=True)
    ends = checkpoint(ends)
    counts = word_counts(rows, "body")
    wanted = found.select(F.col("last_word").alias("word")).unionByName(ends.where("first is not null").select(F.lower("first").alias("word"))).distinct()
    known = checkpoint(counts.join(wanted, "word", "left_semi"))
    going = known.where(F.col("within") >= WITHIN * F.greatest("begins", F.lit(1))).select(F.col("word").alias("first"), F.lit(True).alias("within_sentences"))
    heads = ends.select(doc, page, "goes_on", F.lower("first").alias("first")).join(going, "first", "left").select(doc, page, (F.col("goes_on") | F.coalesce("within_sentences", F.lit(False))).alias("goes_on"))
    following = heads.groupBy(doc, (F.col(page) - 1).alias(page)).agg(F.max("goes_on").alias("goes_on"))
    each_end = ends.select(doc, page, F.explode("end_words").alias("end"))
    alike = each_end.groupBy(doc, page, "end").agg(F.count("*").alias("alike")).where("alike > 1")
    alike = found.select(*keys, F.explode("end_words").alias("end")).join(alike, [doc, page, "end"]).groupBy(*keys).agg(F.max("alike").alias("alike"))
    longest = ends.groupBy(doc, page).agg(F.max("size").alias("longest"))
    whole = known.where(F.col("inside") > 10 * F.col("at_end")).select(F.col("word").alias("last_word"), F.lit(True).alias("whole_word"))
    judged = (
        found.join(hit, keys, "left")
        .join(following, [doc, page], "left")
        .join(alike, keys, "left")
        .join(longest, [doc, page], "left")
        .join(whole, "last_word", "left")
    )
    continued = F.coalesce("goes_on", F.lit(False))
    same = F.coalesce("alike", F.lit(1)) > 1
    # Where the next page goes on, a header or words torn apart must not pass for a longer reading.
    more = F.col("longest") > F.col("size") + F.when(continued, 10 + 0.06 * F.col("size")).otherwise(2)
    at_limit = F.col("limit_length").isNotNull()
    broken = F.col("whole_word").isNull()
    reason = (
        F.when(F.col("mark"), "mark")
        .when(at_limit, "limit")
        .when(F.col("heading"), None)
        .when(same, None)
        .when(broken, "word")
        .when(more, "longer reading")
        .when(~continued, "sentence")
    )
    return judged.withColumn("reason", reason).where("reason is not null").select(*keys, F.col("source").alias(source), "reason", "limit_encoding", "limit_length")
