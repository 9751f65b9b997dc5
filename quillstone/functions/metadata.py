"""What file names, titles and front pages say of a document: type, series, version, revision, date; paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of document types, in order of precedence; months; words that mark an issue; words
# that tell the issues of a series apart, and those that name no series.
TYPES = {
    "errata": ["errata", "erratum", "corrigenda", "corrigendum"],
    "ecn": ["ecn", "ecr", "engineering change notice", "engineering change request"],
    "amendment": ["amendment", "addendum"],
    "appnote": ["application note", "appnote", "app note"],
    "guide": ["user guide", "users guide", "user's guide", "design guide", "layout guide", "user guidelines", "design guidelines", "layout guidelines"],
}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MARKS = ["rev", "revision", "version", "ver"]
ISSUE_WORDS = [
    "errata", "erratum", "corrigenda", "corrigendum", "ecn", "ecr", "engineering", "change", "notice", "request", "amendment", "addendum",
    "draft", "final", "clean", "redline", "copy", "rev", "revision", "version", "ver",
]
PLAIN_WORDS = ["spec", "specs", "specification", "specifications", "standard", "standards", "jedec", "document", "the"]
PCI = {"pcie": ["pci", "express"], "pciexpress": ["pci", "express"]}

_YEAR = r"^(?:19|20)\d{2}$"
_DOTTED = r"\d+(?:\.\d+)*"


def _parts(text: Column) -> Column:
    """The parts of a name, as between blanks, underscores and brackets; a part keeps its points and hyphens."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9.'/-]*"), F.lit(0)), lambda t: F.regexp_replace(t, r"[.'/-]+$", ""))


def _tokens(text: Column) -> Column:
    return F.transform(_parts(text), F.lower)


def _within(text: Column, phrases: list[str]) -> Column:
    """A phrase stands in the text as whole parts."""
    line = F.concat(F.lit(" "), F.array_join(F.flatten(F.transform(_tokens(text), lambda t: F.split(t, "[-./]"))), " "), F.lit(" "))
    return F.exists(F.array(*[F.lit(f" {p} ") for p in phrases]), lambda p: F.contains(line, p))


def doc_type(text: Column) -> Column:
    """The first of TYPES whose name the text has, else base."""
    return F.coalesce(*[F.when(_within(text, names), kind) for kind, names in TYPES.items()], F.lit("base"))


def _first(found: Column) -> Column:
    """The first element that isn't empty, else ''."""
    return F.coalesce(F.get(F.filter(found, lambda x: x != ""), F.lit(0)), F.lit(""))


def revision(text: Column) -> Column:
    """A JEDEC number's letter, else what follows 'rev' or 'version', or 'r' before a dotted number; else ''."""
    t = _parts(text)
    letter = _first(F.transform(t, lambda x: F.upper(F.regexp_extract(x, r"(?i)^jesd\d+(?:-\d+)?([a-z])$", 1))))
    mark = F.array(*[F.lit(m) for m in MARKS])
    behind = lambda x, i: F.when((i > 0) & F.array_contains(mark, F.lower(F.get(t, i - 1))), F.regexp_extract(x, rf"(?i)^({_DOTTED}[a-z]?|[a-z])$", 1))
    joined = lambda x: F.concat(F.regexp_extract(x, rf"(?i)^(?:rev|ver|revision|version)\.?({_DOTTED}[a-z]?)$", 1), F.regexp_extract(x, r"(?i)^r(\d+(?:\.\d+)+)$", 1))
    named = _first(F.transform(t, lambda x, i: F.coalesce(F.nullif(behind(x, i), F.lit("")), joined(x))))
    return F.when(letter != "", letter).otherwise(named)


def version(text: Column) -> Column:
    """The first part that is two numbers with a point, and no revision; else ''."""
    t = _tokens(text)
    return _first(F.transform(t, lambda x, i: F.when((i > 0) & F.coalesce(F.get(t, i - 1) == "rev", F.lit(False)), "").otherwise(F.regexp_extract(x, r"^(\d+\.\d+)$", 1))))


def date(text: Column) -> Column:
    """'YYYY-MM' from a month's name or digits, 'YYYY' from a year alone, else ''."""
    t, months = _tokens(text), F.array(*[F.lit(m) for m in MONTHS])
    number = lambda x: F.lpad(F.array_position(months, x).cast("string"), 2, "0")
    spelled = _first(F.transform(t, lambda x, i: F.when((i > 0) & x.rlike(_YEAR) & F.array_contains(months, F.get(t, i - 1)), F.concat_ws("-", x, number(F.get(t, i - 1)))).otherwise("")))
    plain = lambda x: F.concat_ws("-", F.nullif(F.regexp_extract(x, r"^((?:19|20)\d{2})(?:$|[-/.])", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"^(?:19|20)\d{2}[-/.](0[1-9]|1[0-2])(?!\d)", 1), F.lit("")))
    return F.when(spelled != "", spelled).otherwise(_first(F.transform(t, plain)))


def series(text: Column) -> Column:
    """A document series without what tells its issues apart: a JEDEC number, else the words that remain."""
    t = _tokens(text)
    number = F.regexp_replace(F.regexp_extract(F.array_join(t, " "), r"\b(jesd\s?\d+(?:-\d+)?)", 1), " ", "")
    drop, marks = F.array(*[F.lit(w) for w in ISSUE_WORDS + PLAIN_WORDS]), F.array(*[F.lit(m) for m in MARKS])
    spelled = F.flatten(F.transform(t, lambda x: F.coalesce(*[F.when(F.replace(x, F.lit("-"), F.lit("")) == k, F.array(*[F.lit(w) for w in ws])) for k, ws in PCI.items()], F.split(x, "[-/']"))))
    issue = r"^(?:(?:r|v|rev|ver)\d+(?:\.\d+)*[a-z]?|\d+(?:\.\d+)+[a-z]?|(?:19|20)\d{2}|[a-z])$"
    follows = lambda i: (i > 0) & F.array_contains(marks, F.get(spelled, i - 1))
    kept = F.filter(spelled, lambda x, i: (x != "") & ~F.array_contains(drop, x) & ~x.rlike(issue) & ~F.coalesce(follows(i), F.lit(False)))
    return F.when(number != "", number).otherwise(F.array_join(kept, " "))


def bucket(rel: Column) -> Column:
    """struct(bucket, subpath): the first folder and those below it; both '' for a file at the top, and for an absolute path."""
    parts = F.filter(F.split(F.translate(rel, "\\", "/"), "/"), lambda x: x != "")
    top = rel.rlike(r"^(?:/|[A-Za-z]:[\\/]|\\\\)") | (F.size(parts) <= 1)
    sub = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    return F.struct(F.when(top, "").otherwise(F.get(parts, 0)).alias("bucket"), F.when(top, "").otherwise(sub).alias("subpath"))


def title(path: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", ""), "[_]+", " "))


def search_text(standard: Column, name: Column, section: Column, text: Column) -> Column:
    """What is embedded: the parts of the head that there are, and the text."""
    head = F.concat_ws(" | ", F.nullif(standard, F.lit("")), F.nullif(name, F.lit("")), F.nullif(section, F.lit("")))
    return F.when(head == "", text).otherwise(F.concat_ws("\n\n", head, text))
