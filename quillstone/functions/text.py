"""Text functions as Column -> Column expressions; all of them stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character in every engine: letters, digits, underscore, of any script.
TERM = r"[\p{L}\p{N}_]+"

# Words that a search query leaves out, English then Turkish.
STOPWORDS = (
    "a an and are as at be by can do does for from has have how i in is it its of on or shall should that the "
    "their there these this to was what when where which who why will with within without would you your "
    "acaba ama ancak bana bazı belirtilen ben bir biri birkaç bu buna bunda bunu bunun da daha de değil diye "
    "en gibi göre hangi hangisi hem için ile ise kaç kadar ki mi mı mu mü na nasıl ne neden nedir nelerdir "
    "nerede o olan olarak olur olursa on ona onu onun sadece şu şey ve veya ya yani yine çok açıkla anlat "
    "söyle ver verir midir mıdır olmalı olmalıdır gerekir lütfen"
).split()

# Letters folded to ASCII, and function words that mark a Turkish question.
FOLD_FROM = "çÇğĞıIİöÖşŞüÜâîû"
FOLD_TO = "ccggiiioossuuaiu"
TURKISH_LETTERS = "çğıöşüÇĞİÖŞÜ"
TURKISH_WORDS = (
    "nedir nasıl nasil kaç kac hangi nelerdir midir mıdır neden için icin ile ve veya bir bu ne mi mı olan olarak "
    "değeri degeri arasındaki farkı peki nerede açıkla acikla göre gore kadar"
).split()
# Ligatures and what they stand for.
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")]


# Fixed values, patterns: a citation and its parts, a number that stands alone, a list's mark, where sentences end,
# and what looks like an end but is an abbreviation or an initial.
CITATION = r"\[(\d+(?:\s*[,–-]\s*\d+)*)\]"
NUMBER = r"(?<![\p{L}\p{N}_.,])(0x[0-9a-fA-F]+|\d+(?:[.,]\d+)*)"
LIST_MARK = r"^(\s*(?:[-*•]|\d+[.)])\s+)"
SENTENCE_END = r"(?<=[.!?])\s+(?=\S)"
ABBREVIATION = (
    r"(?i)(?:\b(?:e\.g|i\.e|figs?|nos?|approx|min|max|typ|vs|cf|sec|eq|rev|ref|vol|pp|ch|etc|incl|resp|ca|örn|vb|bkz|yy|nom)\."
    r"|(?<![\w.])(?<!\d )[A-Za-z]\.)$"
)


def lower_safe(text: Column) -> Column:
    """Lower case in which a dotted capital I becomes one letter."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def fold(text: Column) -> Column:
    """Turkish letters to ASCII, then lower case: the order matters."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """The greater of a quarter of the characters and 1.3 for each word, cut to whole numbers."""
    return F.greatest(F.floor(F.length(text) / 4), F.floor(F.size(words(text)) * F.lit(1.3))).cast("long")


def search_terms(text: Column, most: int = 48) -> Column:
    """Distinct terms of a query in order: two letters at least, no stop words, ``most`` at most."""
    found = F.regexp_extract_all(lower_safe(text), F.lit(TERM), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.slice(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))), 1, most)


def terms(text: Column) -> Column:
    """All terms of an indexed text, in lower case."""
    return F.regexp_extract_all(lower_safe(text), F.lit(TERM), F.lit(0))


def detect_language(text: Column) -> Column:
    """'tr' if a Turkish letter or function word occurs, else 'en'."""
    known = F.array(*[F.lit(w) for w in TURKISH_WORDS])
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.when(text.rlike(f"[{TURKISH_LETTERS}]") | F.arrays_overlap(found, known), "tr").otherwise("en")


def normalize(text: Column) -> Column:
    """Ligatures, soft hyphens, line ends, words broken at a line end, runs of blanks and of empty lines."""
    for a, b in LIGATURES:
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.replace(F.replace(F.replace(text, F.lit("­"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.regexp_replace(text, "([a-z]{2,})-\n([a-z]{2,})", "$1$2")
    text = F.regexp_replace(text, "[ \t  -  　]+", " ")
    text = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), "\n")
    return F.trim(F.btrim(F.regexp_replace(text, "\n{3,}", "\n\n"), F.lit("\n ")))


def exact_key(line: Column) -> Column:
    """A line as compared for running headers: lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t]+", " "))


def number_key(line: Column) -> Column:
    """The same with numbers and roman numerals as '#', so page numbers agree."""
    digits = F.regexp_replace(F.lower(line), "[0-9]+", "#")
    return F.trim(F.regexp_replace(F.regexp_replace(digits, r"(?U)\b[ivxlc]+\b", "#"), r"[ \t]+", " "))


def scrub(text: Column, limit: int = 300) -> Column:
    """A message without secrets, addresses and keys, in this order of replacements, cut to ``limit``."""
    for pattern, new in SCRUB:
        text = F.regexp_replace(text, pattern, new)
    return F.substring(F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")), 1, limit)


# What counts as a secret, a server, a key and an address.
SCRUB = [
    (r"(?i)\b(bearer|api[_-]?key|x-api-key|token|authorization|password|passwd|secret)\b(\s*[:=]\s*|\s+)[^\s,;'\"]+", "$1 <redacted>"),
    (r"(?i)\b[a-z][a-z0-9+.-]*://[^\s'\"<>)\]]+", "<server>"),
    (r"\bsk-[A-Za-z0-9_-]{8,}|\b[A-Za-z0-9_-]{32,}\b", "<redacted>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?\b", "<address>"),
    (r"\b[A-Za-z][\w.-]*:\d{2,5}\b", "<server>"),
]


def citations(text: Column) -> Column:
    """Numbers cited as [1], [2,3] or [4-6]; a range is expanded if it has fewer than 50 steps, else dropped."""
    groups = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*")))

    def expand(part: Column) -> Column:
        lo = F.try_to_number(F.regexp_extract(part, r"^(\d{1,9})", 1), F.lit("999999999")).cast("int")
        hi = F.try_to_number(F.regexp_extract(part, r"^\d+\s*[–-]\s*(\d{1,9})$", 1), F.lit("999999999")).cast("int")
        single = F.when(part.rlike(r"^\d+$"), F.array(lo)).otherwise(F.array().cast("array<int>"))
        return F.when(hi.isNull(), single).when((hi > lo) & (hi - lo < 50), F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(parts, expand))


def bare_numbers(text: Column) -> Column:
    """Numbers that stand alone, without citations, list marks and single digits."""
    text = F.regexp_replace(text, CITATION, " ")
    text = F.regexp_replace(text, LIST_MARK, " ")
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    return F.filter(found, lambda n: ~n.rlike(r"^\d$"))


def sentences(text: Column) -> Column:
    """Sentences; a part that ends in an abbreviation or a single letter goes on with the next one."""
    parts = F.split(text, SENTENCE_END)
    last = lambda a: F.element_at(a, -1)
    empty = F.array().cast("array<string>")
    return F.aggregate(
        parts,
        empty,
        lambda a, p: F.when(
            (F.size(a) > 0) & last(a).rlike(ABBREVIATION), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat_ws(" ", last(a), p)))
        ).otherwise(F.concat(a, F.array(p))),
    )


def slug(name: Column) -> Column:
    """A stable id for a name: its folded letters and six digits of its SHA-1; '_root' for an empty one."""
    base = F.substring(F.regexp_replace(F.regexp_replace(fold(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    base = F.when(base == "", "bucket").otherwise(base)
    return F.when(F.coalesce(name, F.lit("")) == "", "_root").otherwise(F.concat(base, F.lit("-"), F.substring(F.sha1(name), 1, 6)))


def contains_all(text: Column, expected: Column) -> Column:
    """Every entry of expected (an array of alternatives) occurs in text; 1.5 also matches 1,5."""
    flat = lambda c: F.regexp_replace(F.lower(F.replace(c, F.lit(" "), F.lit(" "))), r"\s+", " ")
    hay = flat(text)
    comma = lambda a: F.when(a.rlike(r"\d\.\d"), F.replace(a, F.lit("."), F.lit(","))).otherwise(a)
    return F.forall(expected, lambda alts: F.exists(alts, lambda a: F.contains(hay, flat(a)) | F.contains(hay, comma(flat(a)))))


def strip_thinking(text: Column) -> Column:
    """A whole answer without thoughts, nor what stands before a closing tag that nothing opened."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)^.*?</think>", ""), F.lit(" \t\r\n"))
