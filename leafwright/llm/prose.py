"""Which parts of a text are sentences of a natural language.

``measure`` cuts a text into segments (sentences of its paragraphs, lines of its lists and tables) and says
how many of its words stand in sentences.  It knows languages only by their function words, the small closed
class (articles, prepositions, pronouns, conjunctions) that no sentence does without and that lists of terms,
tables, keyword spam and random characters lack.  A text in another language is searched for its own
(``own_function_words``).
"""

from __future__ import annotations

import re
from collections import Counter

# Function words by language.
FUNCTION_WORDS = {
    "en": (
        "a about above across after against all although among an and any are as at be because been before being below beneath "
        "between beyond both but by can cannot could despite did do does during each either even every few for from had has have he her "
        "here hers him his how however i if in into is it its itself me more most my near neither no nor not of off on "
        "once one only onto or other our out outside over own per same shall she should since so some such than that the their "
        "them then there these they this those though through throughout to too toward towards under unless until up upon us very "
        "was we were what when whenever where wherever whereas whether which while who whom whose why will with within without would you your"
    ),
    "de": (
        "ab aber alle allen aller alles als also am an andere auch auf aus bei bis da dabei daher damit dann daran das dass dem den denn dennoch der "
        "des dessen die dies diese diesem diesen dieser dieses doch dort durch ein eine einem einen einer eines er es für "
        "gegen hat hatte hier ich ihr ihre im in ins ist jede jeder jedoch kann kein keine man mehr mit nach nicht noch nur ob "
        "oder ohne sehr seit sich sie sind so sondern sowie über um und uns unter vom von vor war waren warum was "
        "weder weil wenn werden wie wir wird wo wurde wurden während zu zum zur zwischen zwar außerdem beim"
    ),
    "fr": (
        "a afin ainsi alors au aucun aucune aussi autre autres aux avant avec ce cela celle celui ces cet cette ceux chaque chez comme contre "
        "d dans de depuis des donc dont du elle elles en encore entre est et eux il ils je l la le les leur leurs lorsque lui mais même n "
        "ne ni nos notre nous on ont ou où par parce pas pendant plus pour pourtant puisque qu quand que quel quelle qui quoi sa sans se "
        "selon ses si sinon son sont sous sur tandis toujours tous tout toute toutes très tu un une vers vos votre vous y à été être"
    ),
    "es": (
        "a al algo ante antes aquel aquella así aunque bajo cada como con contra cual cuales cuando de del desde donde dos durante e el ella "
        "ellas ellos en entre era eran es esa ese eso esta este esto estos fue fueron ha hacia han hasta la las le les lo los más me "
        "menos mi mientras muy ni no nos nosotros o otra otro otros para pero por porque que quien se según ser si sin "
        "sino sobre son su sus también tan tanto te tras tu un una unas uno unos y ya"
    ),
}
LANGUAGES = tuple(FUNCTION_WORDS)
#: Single letters aren't counted: they are also list markers, column names and variables.
_BY_LANGUAGE = {k: frozenset(w for w in v.split() if len(w) > 1) for k, v in FUNCTION_WORDS.items()}
ANY_FUNCTION_WORD = frozenset().union(*_BY_LANGUAGE.values())
#: Words that only one of the languages has, for telling them apart.
_OWN = {w: k for k, v in _BY_LANGUAGE.items() for w in v if sum(w in x for x in _BY_LANGUAGE.values()) == 1}

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Of a sentence's tokens at least so many are function words, and at most so many.
LEAST_FUNCTION, MOST_FUNCTION = 0.1, 0.8
#: A sentence has at least so many words, of which so many tokens are words at all.
LEAST_WORDS, LEAST_ALPHABETIC = 4, 0.55

_TAG = re.compile(r"<\|(?:ref|/ref|det|/det|[a-z_/]{1,24})\|>|\[\[\d+(?:,\s*\d+){3}\]\]|</?[A-Za-z][^<>\n]{0,300}>|<!--.*?-->|&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,6});", re.S)
_LATEX_BLOCK = re.compile(r"\$\$.*?\$\$|\\begin\{(equation|align|gather|multline|tabular)\*?\}.*?\\end\{\1\*?\}|\\\[.*?\\\]", re.S)
_FENCE = re.compile(r"^(?:```|~~~).*?^(?:```|~~~)[ \t]*$", re.S | re.M)
_LATEX = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?|(?<!\w)\$[^$\n]{1,120}\$")
_WIKI = re.compile(r"\{\{[^{}\n]*\}\}|'{2,5}|\[\[(?:[^\[\]|\n]*\|)?|\]\]|^={2,6}|={2,6}$", re.M)
_IMAGE = re.compile(r"!\[[^\]\n]*\]\([^)\n]*\)|(?<=\])\([^)\n]*\)")
_BLANKS = re.compile(r"\n[ \t]*\n")
_ITEM = re.compile(r"^\s*(?:[•–—*+-]\s|\(?[a-zA-Z0-9]{1,3}[.)]\s|[ivxlc]{1,5}[.)]\s|#{1,6}\s|:\s|;\s)")
_END = re.compile(r"[.!?…]([\"'”’)\]]*\s+)(?=[^\sa-z])")
_EDGES = ".,;:!?()[]{}<>\"'“”„‘’«»…*_`|#–—-"
PAGE_NUMBER = re.compile(
    r"^\s*(?:[\[(·•–—~|-]*\s*)(?:(?:page|p\.|pg\.?|seite|s\.|página|pág\.?|folio|fol\.)\s*)?(?:\d{1,4}|[ivxlc]{1,6})(?:\s*(?:/|of|von|sur|de)\s*\d{1,4})?(?:\s*[\])·•–—~|-]*)\s*$",
    re.I,
)


def without_markup(text: str) -> str:
    """The text without tags, entities, formulas, code fences and engine tags; cheap where there are none."""
    if "<" in text or "&" in text or "[[" in text:
        text = _TAG.sub(" ", text)
    if "\\" in text or "$" in text:
        text = _LATEX.sub(" ", _LATEX_BLOCK.sub("\n\n", text))
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "{{" in text or "''" in text or "[[" in text or "==" in text:
        text = _WIKI.sub("", text)
    if "](" in text:
        text = _IMAGE.sub("", text)
    return text


def is_page_number(line: str) -> bool:
    return len(line) < 24 and PAGE_NUMBER.match(line) is not None


def without_furniture(text: str) -> list[str]:
    """The lines, less a page number in the first or the last two of them that aren't blank."""
    lines = text.split("\n")
    for side in (0, -1):
        seen, k = 0, side
        while seen < 2 and -len(lines) <= k < len(lines):
            if lines[k].strip():
                seen += 1
                if is_page_number(lines[k]):
                    lines[k] = ""
            k += 1 if side == 0 else -1
    return lines


def sentences(paragraph: str) -> list[str]:
    """The paragraph cut after marks that end sentences, less what stands between these and the next."""
    out, begin = [], 0
    for m in _END.finditer(paragraph):
        out.append(paragraph[begin : m.start(1)])
        begin = m.end()
    out.append(paragraph[begin:])
    return out


def segments(text: str) -> list[str]:
    """Sentences of paragraphs, and the lines of lists and tables one by one."""
    out: list[str] = []
    for block in _BLANKS.split("\n".join(without_furniture(text))):
        lines = [x for x in block.split("\n") if x.strip()]
        if not lines:
            continue
        run: list[str] = []
        for x in lines:
            if _ITEM.match(x) or x.count(",") + x.count("\t") + x.count("|") + x.count("  ") + x.count(" & ") > 1 and _looks_tabular(x):
                if run:
                    out += sentences(" ".join(run))
                    run = []
                out.append(x)
            else:
                run.append(x)
        if run:
            out += sentences(" ".join(run))
    return out


def words_of(text: str) -> list[str]:
    """Lower-case tokens without the punctuation at their edges; empty where there was nothing else."""
    return [t if t.isalpha() else t.strip(_EDGES) for t in text.lower().split()]


def _looks_tabular(line: str) -> bool:
    """Cells, hardly any word of them a function word."""
    tokens = line.lower().split()
    left = 0.1 * len(tokens)
    for t in tokens:
        if (t if t.isalpha() else t.strip(_EDGES)) in ANY_FUNCTION_WORD:
            left -= 1
            if left < 0:
                return False
    return True


def is_sentence(segment: str, function_words: frozenset[str] = ANY_FUNCTION_WORD) -> bool:
    tokens = words_of(_ITEM.sub("", segment))
    words = [w for w in tokens if w.isalpha() or len(w) > 3 and w.replace("-", "").replace("'", "").replace("’", "").isalpha()]
    n = len(words)
    if n < LEAST_WORDS or n < LEAST_ALPHABETIC * len(tokens):
        return False
    hits = sum(w in function_words for w in words)
    if not LEAST_FUNCTION * n <= hits <= MOST_FUNCTION * n:
        return False
    return 2.2 * n <= sum(map(len, words)) <= 14 * n


def language_of(words: list[str]) -> str:
    """The language whose own function words are most frequent (ties: the first by name); "und" without any."""
    votes = Counter(map(_OWN.get, words))
    votes.pop(None, None)
    return min(votes, key=lambda k: (-votes[k], k)) if votes else "und"


def own_function_words(parts: list[str]) -> frozenset[str]:
    """The closed class of a language that isn't known, as far as the text shows it: its short words that stand in at least three sentences and a tenth of them.

    Only segments that look like sentences in any language count: of five words or more, begun without a small letter and ended by a
    mark.  Fewer than five of them, or less than three fifths of the words in them, show nothing.
    """
    alike, inside, total = _sentence_like(parts)
    n = len(alike)
    if n < 5 or 5 * inside < 3 * total:
        return frozenset()
    found = Counter(w for tokens in alike for w in {w for w in tokens if 1 < len(w) <= 4 and w.isalpha()})
    return frozenset(w for w, k in found.items() if k >= max(3, 0.1 * n))


def _sentence_like(parts: list[str]) -> tuple[list[list[str]], int, int]:
    """The words of the segments that look like sentences in any language, how many they are, words in all."""
    said = [(s, words_of(s)) for s in parts]
    alike = [tokens for s, tokens in said if len(tokens) >= 5 and not s.lstrip()[:1].islower() and s.rstrip("\"'”’»)] \t").endswith(_MARKS)]
    return alike, sum(map(len, alike)), sum(len(tokens) for _, tokens in said)


def shows_too_little(text: str) -> bool:
    """Whether three fifths of the words stand in what looks like sentences, hardly any with function words that are known, but too few to show the text's own."""
    parts = segments(without_markup(text))
    alike, inside, total = _sentence_like(parts)
    known, n = _share(parts, ANY_FUNCTION_WORD)
    return 0 < len(alike) < 5 and 5 * inside >= 3 * total and 4 * known < n


_MARKS = (".", "!", "?", "…", "。", "！", "？", "।", "؟", "։")


def prose_share(text: str) -> tuple[int, int, int]:
    """Words in sentences, words in all, segments.  Where hardly any function word is known, the text's own take their place."""
    parts = segments(without_markup(text))
    inside, total = _share(parts, ANY_FUNCTION_WORD)
    if 4 * inside < total and (own := own_function_words(parts)):
        inside = max(inside, _share(parts, own)[0])
    return inside, total, len(parts)


def _share(parts: list[str], function_words: frozenset[str]) -> tuple[int, int]:
    inside = total = 0
    for s in parts:
        n = len(s.split())
        total += n
        if is_sentence(s, function_words):
            inside += n
    return inside, total
