"""Markup residue: HTML, Markdown, wiki and LaTeX syntax and the layout tags of engines, found and turned into clean text.

A grammar proposes tokens and tells their roles apart by what stands around them; equivalence classes decide.  Over all pages
of a source, tokens that occur equally often on every page (equal occurrence vectors, compared by a hash of the vector)
make up a class.  Each page is then parsed by the classes: on a page that obeys a class, its tokens keep their order, and
its instances lie within each other or apart.  A class that more than ``WRONG`` of its pages disobey is no markup, and its
tokens are printed text.  The others, nested by what most of their instances stand in, are the template of the source; what lies
between the tokens of an instance are its slots.  ``clean`` takes away the tokens of the template and keeps the slots.
"""

from __future__ import annotations

import html
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import checkpoint, per_row
from .repetition import is_wordy

#: A class is judged by at least so many pages of its source; a token that fewer have is judged by its pages of all sources, and one that fewer have there by the grammar alone.
LEAST_PAGES = 3
#: Share of its pages that may disobey a class: texts are cut, and characters are misread.
WRONG = 0.05
#: Hash of a class that holds over all sources.
EVERYWHERE = "*"

# Tags that are never closed, and tags that needn't be.
UNCLOSED = frozenset("area base br col embed hr img input link meta param source track wbr p li td th tr dt dd option thead tbody tfoot".split())

# The alternatives of the grammar; the name says the kind of token.
_TOKEN = re.compile(
    r"""(?=[<\[&\\$`~!{|\#=*_':-])(?:
        (?P<layout><\|/?[a-z_]+\|>|\[\[\d+(?:,\s*\d+){3}\]\])
      | (?P<comment><!--.*?-->)
      | (?P<tag></?[A-Za-z][A-Za-z0-9]*(?:\s+[\w:-]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s<>"']+))?)*\s*/?>)
      | (?P<entity>&(?:[a-zA-Z][a-zA-Z0-9]{1,9}|\#\d{1,6}|\#x[0-9a-fA-F]{1,6});)
      | (?P<env>\\(?:begin|end)\{[A-Za-z]+\*?\})
      | (?P<math>\$\$[^$]+\$\$|(?<![\w$\\])\$(?=[^\s$])[^$\n]*[^\s$\\]\$(?![\w$])|\\\[.+?\\\]|\\\(.+?\\\))
      | (?P<command>\\[A-Za-z]{2,}\*?(?=[^A-Za-z]|$)(?:\[[^\]\n]*\])?|\\\\(?=\s*(?:\n|$)))
      | (?P<fence>^(?:```|~~~)[\w+-]*[ \t]*$)
      | (?P<code>`[^`\n]+`)
      | (?P<image>!\[[^\]\n]*\]\([^)\n]+\))
      | (?P<link>\[[^\]\n]+\]\([^)\s]+(?:\s+"[^"\n]*")?\))
      | (?P<footnote>\[\^[\w-]+\])
      | (?P<wikilink>\[\[[^\[\]\n]+\]\])
      | (?P<template>\{\{[^{}]+\}\})
      | (?P<wikitable>^\{\|[^\n]*$|^\|[-}][^\n]*$|^![^!\n]+(?:!![^\n]*)?$)
      | (?P<rule>^\|?[ ]*:?-{3,}:?[ ]*(?:\|[ ]*:?-{3,}:?[ ]*)+\|?[ \t]*$)
      | (?P<row>^\|[^\n]*\|[ \t]*$)
      | (?P<heading>^\#{1,6}[ \t]+\S[^\n]*$|^(?P<eq>={2,6})[^=\n]+(?P=eq)[ \t]*$)
      | (?P<strong>(?<![\w*])\*\*(?=[^\s*])[^*\n]*[^\s*]\*\*(?![\w*])|(?<![\w_])__(?=[^\s_])[^_\n]*[^\s_]__(?![\w_]))
      | (?P<quotes>'{2,5}(?=[^'\s])[^'\n]*(?:'[^'\n]+)*[^'\s]'{2,5})
      | (?P<emphasis>(?<![\w*\\])\*(?=[^\W\d_])[^*\n]*[^\s*]\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]*[^\s_]_(?![\w_]))
      | (?P<strike>~~(?=\S)[^~\n]+~~)
      | (?P<item>^\*{1,3}[ \t]+(?=\S))
      | (?P<tie>(?<=\w)~(?=\\)))""",
    re.X | re.M | re.S,
)
#: Without any of these characters there is no token.
_SIGNS = "<&\\$`[{|#*_'~="
#: Kinds of which a single token may be a printed sign: they count where there are several, in a class with others, or beside other markup.
_WEAK = ("item",)


def shape(m: re.Match) -> str:
    """The token without what differs from page to page: the tag's or the command's name, else the kind."""
    kind = m.lastgroup if m.lastgroup != "eq" else "heading"
    if kind in ("tag", "layout", "env", "command"):
        name = re.match(r"</?[A-Za-z0-9]+|<\|/?[a-z_]+\|>|\\(?:begin|end)\{[A-Za-z]+|\\[A-Za-z\\]+|\[\[", m[0])
        return f"{kind} {name[0].lower()}"
    if kind == "wikitable":
        return f"{kind} {m[0][:1] if m[0][0] == '!' else m[0][:2]}"
    return kind


def tokens(text: str) -> list[re.Match]:
    return list(_TOKEN.finditer(text)) if any(c in text for c in _SIGNS) else []


def page_tokens(df: DataFrame, keys: list[str], source: str, text: str) -> DataFrame:
    """keys, source, page (a hash of the text), wordy, whole, of each shape of token the name and how often it occurs, and the order of the tokens as places in names.

    whole: closing tags and opening ones pair up; others are texts that were cut or badly read.  Only texts with a token have
    a row; equal keys come out once, rows with a null in a key are left out.  Read in one pass over the texts.
    """

    def find(t: str | None) -> tuple | None:
        found = tokens(t) if t else []
        if not found:
            return None
        shapes = [shape(m) for m in found]
        names = sorted(set(shapes))
        at = {n: i for i, n in enumerate(names)}
        counts = [0] * len(names)
        for n in shapes:
            counts[at[n]] += 1
        closed = {o: counts[i] for n, i in at.items() if (o := opening(n))}
        whole = all(o in at and counts[at[o]] == k for o, k in closed.items()) and all(n in closed for n in names if must_close(n))
        return xxhash.xxh3_64_intdigest(t) - (1 << 63), is_wordy(t), whole, names, counts, [at[n] for n in shapes]

    picked = df.dropna(subset=keys).select(*keys, F.coalesce(F.lower(F.trim(F.col(source))), F.lit("")).alias("source"), F.col(text).alias("_body"))
    fields = [("page", "bigint"), ("wordy", "boolean"), ("whole", "boolean"), ("names", "array<string>"), ("counts", "array<int>"), ("order", "array<int>")]
    return per_row(picked, [*keys, "source"], ["_body"], lambda: find, fields).dropDuplicates(keys)


def opening(name: str) -> str | None:
    """The shape that a closing tag closes; None for other shapes."""
    if name.startswith("tag </"):
        return "tag <" + name[6:]
    if name.startswith("env \\end{"):
        return "env \\begin{" + name[9:]
    return "layout <|" + name[10:] if name.startswith("layout <|/") else None


def must_close(name: str) -> bool:
    return name.startswith("tag <") and name[5] != "/" and name[5:] not in UNCLOSED or name.startswith(("env \\begin{", "layout <|")) and not opening(name)


def occurrence_classes(pages: DataFrame) -> DataFrame:
    """source, name, class, pages, occurrences, lone, place of the shapes that occur on at least LEAST_PAGES whole pages of their source, and the same over all sources as source EVERYWHERE.

    class is a hash of the shape's occurrence vector: the sum over all pages of a hash of the page and of how often the
    shape occurs there, taken twice with 31 bits, which Spark sums in parts.  lone: pages on which it occurs once; place: mean place of its first on a page.
    """
    first = F.transform("names", lambda _, i: F.array_position("order", i) / F.size("order"))
    each = pages.where("whole").select("source", "page", F.explode(F.arrays_zip("names", "counts", first.alias("first"))).alias("t"))
    each = each.select("source", F.col("t.names").alias("name"), F.xxhash64("page", "t.counts").alias("h"), F.col("t.counts").alias("n"), F.col("t.first").alias("first"))
    sums = ["low", "high", "pages", "occurrences", "lone", "places"]
    half = lambda x: F.sum(F.pmod(x, F.lit(1 << 31)))
    own = each.groupBy("source", "name").agg(half(F.col("h")).alias("low"), half(F.shiftright("h", 31)).alias("high"), F.count("*").alias("pages"), F.sum("n").alias("occurrences"), F.count_if(F.col("n") == 1).alias("lone"), F.sum("first").alias("places"))
    own = checkpoint(own)  # a row for each shape of each source
    all_ = own.groupBy(F.lit(EVERYWHERE).alias("source"), "name").agg(*[F.sum(c).alias(c) for c in sums])
    whole = own.unionByName(all_).where(F.col("pages") >= LEAST_PAGES)
    return whole.select("source", "name", F.xxhash64("source", "low", "high", "pages").alias("class"), "pages", "occurrences", "lone", (F.col("places") / F.col("pages")).alias("place"))


def roles(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """source, name, class, place of every shape of every source: its class there, else its class over all sources, else null."""
    every = pages.select("source", F.explode("names").alias("name")).distinct()
    own = classes.where(F.col("source") != EVERYWHERE).select("source", "name", F.struct("class", "place").alias("_own"))
    wide = classes.where(F.col("source") == EVERYWHERE).select("name", F.struct("class", "place").alias("_wide"))
    return every.join(own, ["source", "name"], "left").join(wide, "name", "left").select("source", "name", F.coalesce("_own", "_wide").alias("c")).select("source", "name", "c.class", "c.place")


def parse(order: list[int], classes: list[int | None], places: list[float]) -> tuple[dict[int, bool], dict[int, int | None]]:
    """Whether a page obeys each class on it, and the class that its first instance stands in.

    order: the tokens as places in classes; places: the order of a class over its source.  The tokens of a class are in order if none ever outnumbers one before it;
    an instance lasts from its first token to its last, and instances must end in the reverse order of their beginnings.
    """
    ranks: dict[int, list[int]] = {}
    for k in sorted(set(order), key=lambda k: (places[k] or 0.0, k)):
        if classes[k] is not None:
            ranks.setdefault(classes[k], []).append(k)
    seen = dict.fromkeys(order, 0)
    good = dict.fromkeys(ranks, True)
    inside: dict[int, int | None] = {}
    stack: list[int] = []
    for k in order:
        c = classes[k]
        if c is None:
            continue
        members = ranks[c]
        i = members.index(k)
        seen[k] += 1
        if i and seen[k] > seen[members[i - 1]]:
            good[c] = False
        if i == 0:
            inside.setdefault(c, stack[-1] if stack else None)
            if len(members) > 1:
                stack.append(c)
        elif i == len(members) - 1 and c in stack:
            while stack[-1] != c:  # an instance that began inside and goes on
                good[c] = good[stack.pop()] = False
            stack.pop()
    for c in stack:
        good[c] = False
    return good, inside


def judged_classes(pages: DataFrame, role: DataFrame) -> DataFrame:
    """class, n_pages, n_wrong, valid, parent of each class over all of its pages; parent: what most of them have it in, null for none."""
    held = role.where("class is not null").groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("class", "place")))).alias("role"))  # the shapes of a source
    known = pages.where("whole").join(held, "source").select("page", "order", F.transform("names", lambda n: F.col("role")[n]["class"]).alias("classes"), F.transform("names", lambda n: F.col("role")[n]["place"]).alias("places"))

    def read(order: list, classes: list, places: list) -> tuple:
        good, inside = parse(order, classes, places)
        return list(good), [int(v) for v in good.values()], [inside.get(c) for c in good]

    fields = [("class", "array<bigint>"), ("good", "array<int>"), ("parent", "array<bigint>")]
    each = per_row(known, ["page"], ["order", "classes", "places"], lambda: read, fields).select(F.explode(F.arrays_zip("class", "good", "parent")).alias("t")).select("t.*")
    by_parent = each.groupBy("class", "parent").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    out = by_parent.groupBy("class").agg(F.sum("n").alias("n_pages"), F.sum(F.col("n") - F.col("good")).alias("n_wrong"), F.max_by("parent", F.struct("n", "parent")).alias("parent"))
    return out.withColumn("valid", F.col("n_wrong") <= WRONG * F.col("n_pages"))


def decisions(pages: DataFrame) -> DataFrame:
    """source, name, class, place, parent, by (class, grammar), markup, company of every shape of every source.

    markup: its class is valid, or fewer than LEAST_PAGES pages of all sources have it and the grammar decides.  company: how many shapes its class has.
    """
    role = roles(pages, occurrence_classes(pages))
    judged = judged_classes(pages, role)
    size = role.groupBy("class", "source").agg(F.count("*").alias("company"))
    out = role.join(judged, "class", "left").join(size, ["class", "source"], "left")
    by = F.when(F.col("valid").isNull(), "grammar").otherwise("class")
    return out.select("source", "name", "class", "place", "parent", by.alias("by"), F.coalesce("valid", F.lit(True)).alias("markup"), F.coalesce("company", F.lit(1)).alias("company"))


def template_tokens(pages: DataFrame) -> DataFrame:
    """source, name, class, rank, parent of the shapes in the template of each source; rank: their order within the class."""
    held = decisions(pages).where("by = 'class' and markup")
    return held.select("source", "name", "class", F.row_number().over(W.partitionBy("source", "class").orderBy("place", "name")).alias("rank"), "parent")


def markup_tokens(df: DataFrame, keys: list[str], source: str, text: str) -> DataFrame:
    """keys, n_tokens, kinds, by_class for the texts with markup; equal keys come out once.

    A token counts if its class is valid (by_class: a class decided, not the grammar alone).  A single item mark, which may be
    a footnote's star, counts only in a class with other shapes or beside other markup.  Null and empty texts have none, nor
    do texts that aren't words (broken characters, codes) unless tags, environments, templates or the beginning or rule of a table show that they are markup.  A
    null source is a source of its own.  An empty table gives an empty result.
    """
    pages = checkpoint(page_tokens(df, keys, source, text))
    held = decisions(pages).where("markup").groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("by", "company")))).alias("kept"))  # the shapes of a source
    found = pages.join(held, "source").withColumn("t", F.filter(F.arrays_zip("names", "counts"), lambda t: F.col("kept")[t["names"]].isNotNull())).where("size(t) > 0")
    weak = F.array(*[F.lit(w) for w in _WEAK])
    sure = F.exists("t", lambda t: ~F.array_contains(weak, t["names"]) | (t["counts"] > 1) | (F.col("kept")[t["names"]]["company"] > 1))
    tags = F.exists("names", lambda n: n.rlike(r"^(tag|layout|env|template|rule|wikitable \{\|)"))
    by_class = F.exists("t", lambda t: F.col("kept")[t["names"]]["by"] == "class")
    n_tokens = F.aggregate("t", F.lit(0), lambda a, t: a + t["counts"])
    return found.where(sure & (F.col("wordy") | tags)).select(*keys, n_tokens.alias("n_tokens"), F.col("t.names").alias("kinds"), by_class.alias("by_class"))


_CELL = re.compile(r"</t[dh]>\s*<t[dh][^>]*>", re.I)


def clean(text: str | None, printed: frozenset[str] | set[str] = frozenset()) -> str | None:
    """The text without markup: headings are paragraphs, list entries begin with "• ", table cells are parted by tabs,
    code is indented by four spaces, formulas keep their TeX without delimiters, links their label, images their caption.
    printed: shapes that aren't markup in this source; their tokens stay.  Null stays null."""
    if not text:
        return text
    kept: list[str] = []

    def keep(body: str) -> str:
        kept.append(body)
        return f"\x00{len(kept) - 1}\x00"

    t = text.replace("\r\n", "\n").replace("\x00", "")
    if printed:
        t = _TOKEN.sub(lambda m: keep(m[0]) if shape(m) in printed else m[0], t)
    t = re.sub(r"^(```|~~~)[^\n]*\n(.*?)^\1[ \t]*$", lambda m: keep("\n".join("    " + x for x in m[2].rstrip("\n").split("\n"))), t, flags=re.S | re.M)
    t = re.sub(r"<pre[^>]*>(.*?)</pre>", lambda m: keep("\n".join("    " + x for x in html.unescape(re.sub(r"<[^>]+>", "", m[1])).strip("\n").split("\n"))), t, flags=re.S | re.I)
    t = re.sub(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]", lambda m: keep((m[1] or m[2]).strip()), t, flags=re.S)
    t = re.sub(r"\\begin\{(equation|align|gather|multline)(\*?)\}(.*?)\\end\{\1\2\}", lambda m: keep(m[3].strip()), t, flags=re.S)
    t = re.sub(r"(?<![\w$\\])\$(?=[^\s$])([^$\n]*[^\s$\\])\$(?![\w$])|\\\((.+?)\\\)", lambda m: keep(m[1] or m[2]), t)
    t = re.sub(r"`([^`\n]+)`", lambda m: keep(m[1]), t)
    t = re.sub(r"<\|ref\|>.*?<\|/ref\|>|<\|det\|>.*?<\|/det\|>|<\|/?[a-z_]+\|>|\[\[\d+(?:,\s*\d+){3}\]\]|<!--.*?-->", "", t, flags=re.S)
    t = re.sub(r"<br\s*/?>", "\n", t, flags=re.I)
    t = re.sub(r"<li[^>]*>\s*", "\n• ", t, flags=re.I)
    t = re.sub(r"</tr>", "\n", _CELL.sub("\t", t), flags=re.I)
    t = re.sub(r"</?(?:p|div|h[1-6]|ul|ol|table|section|article|blockquote)\b[^<>]*>", "\n\n", t, flags=re.I)
    t = re.sub(r"<ref[^<>]*>.*?</ref>|<ref[^<>]*/>", "", t, flags=re.S | re.I)
    t = re.sub(r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>\"']+))?)*\s*/?>", "", t)
    t = re.sub(r"\\begin\{tabular\}\{[^}]*\}|\\end\{tabular\}|\\hline|\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]]*\])?", "", t)
    t = re.sub(r"^[ \t]*\\item[ \t]*", "• ", t, flags=re.M)
    t = re.sub(r"^.*[^\\\n]&.*\\\\[ \t]*$", lambda m: "\t".join(c.strip() for c in m[0].rstrip().removesuffix("\\\\").split("&")), t, flags=re.M)
    t = re.sub(r"\\(?:sub)*section\*?\{([^{}]*)\}|\\(?:chapter|paragraph)\*?\{([^{}]*)\}", lambda m: f"\n\n{m[1] or m[2]}\n\n", t)
    t = re.sub(r"~?\\(?:cite[a-z]*|ref|label|footnote)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}", "", t)
    for _ in range(3):
        t = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\documentclass.*|\\usepackage.*|\\\\[ \t]*$", "", t, flags=re.M)
    t = re.sub(r"!\[([^\]\n]*)\]\([^)\n]+\)|\[([^\]\n]+)\]\([^)\s]+(?:\s+\"[^\"\n]*\")?\)", lambda m: m[1] or m[2] or "", t)
    t = re.sub(r"\[\^[\w-]+\]:?", "", t)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]", r"\1", t)
    t = re.sub(r"\{\{[^{}]*\}\}", "", t)
    t = re.sub(r"^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$\n?", "", t, flags=re.M)
    t = re.sub(r"^\{\|.*$\n?|^\|[-}].*$\n?", "", t, flags=re.M)
    t = re.sub(r"^\|(.*?)\|?[ \t]*$", lambda m: "\t".join(c.strip() for c in re.split(r"\|\|?", m[1])), t, flags=re.M)
    t = re.sub(r"^#{1,6}[ \t]+(.*?)[ \t]*#*$|^={2,6}[ \t]*([^=\n]+?)[ \t]*={2,6}[ \t]*$", lambda m: f"\n{m[1] or m[2]}\n", t, flags=re.M)
    t = re.sub(r"^[ \t]*[*+][ \t]+", "• ", t, flags=re.M)
    t = re.sub(r"(?<![\w*])(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", t)
    t = re.sub(r"(?<![\w*\\])\*(?=[^\W\d_])([^*\n]*[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]*[^\s_])_(?![\w_])", lambda m: m[1] or m[2], t)
    t = re.sub(r"'{2,5}(?=[^'\s])(.+?)'{2,5}", r"\1", t)
    t = html.unescape(t).replace("\xa0", " ")
    t = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], t)
    t = re.sub(r"[ \t]+$", "", t, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", t).strip("\n")


def clean_texts(df: DataFrame, keys: list[str], text: str, source: str | None = None) -> DataFrame:
    """keys, clean_text; every row of df comes out, null texts as null.

    source: the column whose template says which tokens are markup; those of classes that aren't valid stay in the text.
    Without it all proposed tokens go.  keys must name a row.
    """
    if source is None:
        return per_row(df, keys, [text], lambda: lambda t: (clean(t),), [("clean_text", "string")])
    pages = checkpoint(page_tokens(df, keys, source, text))
    printed = decisions(pages).where("not markup").groupBy(F.col("source").alias("_source")).agg(F.collect_set("name").alias("_printed"))
    named = df.select(*keys, F.col(text).alias("_body"), F.coalesce(F.lower(F.trim(F.col(source))), F.lit("")).alias("_source")).join(printed, "_source", "left")
    return per_row(named, keys, ["_body", "_printed"], lambda: lambda t, p: (clean(t, frozenset(p or ())),), [("clean_text", "string")])


def slots_of(text: str | None, roles_: dict[str, int]) -> list[tuple[int, str, str]]:
    """Class, shape after which it stands, and text of each slot: what lies between one token of an instance and the next of the same class.

    roles_: the class of each shape in the template, the shapes of a class in their order.  The slot of a token that stands for itself (a formula, a heading, a link) is the token's own text.
    """
    out: list[tuple[int, str, str]] = []
    open_: dict[int, list[tuple[str, int]]] = {}
    members: dict[int, list[str]] = {}
    for n, c in roles_.items():
        members.setdefault(c, []).append(n)
    for m in tokens(text or ""):
        n = shape(m)
        c = roles_.get(n)
        if c is None:
            continue
        if len(members[c]) == 1:
            if not n.startswith(("tag", "layout", "env")):
                out.append((c, n, clean(m[0]) or ""))
            continue
        waiting = open_.setdefault(c, [])
        if waiting and waiting[-1][0] != n:
            before, at = waiting.pop()
            out.append((c, before, text[at : m.start()]))
        if n != members[c][-1]:
            waiting.append((n, m.end()))
    return out


def template_slots(df: DataFrame, keys: list[str], source: str, text: str) -> DataFrame:
    """keys, class, name, slot, content of every slot of every text, in their order; only texts with a token are read again."""
    pages = checkpoint(page_tokens(df, keys, source, text))
    held = template_tokens(pages).groupBy(F.col("source").alias("_source")).agg(F.sort_array(F.collect_list(F.struct("class", "rank", "name"))).alias("_r")).select("_source", F.col("_r.name").alias("_names"), F.col("_r.class").alias("_classes"))
    named = df.join(pages.select(*keys).distinct(), keys, "left_semi").select(*keys, F.col(text).alias("_body"), F.coalesce(F.lower(F.trim(F.col(source))), F.lit("")).alias("_source")).dropDuplicates(keys).join(held, "_source")

    def read(t: str, names: list, classes: list) -> tuple:
        found = slots_of(t, dict(zip(names, classes)))
        return [c for c, _, _ in found], [n for _, n, _ in found], [x for _, _, x in found]

    fields = [("_c", "array<bigint>"), ("_n", "array<string>"), ("_x", "array<string>")]
    each = per_row(named, keys, ["_body", "_names", "_classes"], lambda: read, fields)
    return each.select(*keys, F.posexplode(F.arrays_zip("_c", "_n", "_x")).alias("slot", "s")).select(*keys, F.col("s._c").alias("class"), F.col("s._n").alias("name"), "slot", F.col("s._x").alias("content"))
