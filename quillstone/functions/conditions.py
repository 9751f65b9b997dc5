"""Conditions of values, and small text rules: masks, prefixes, addresses, file names, times, lenient JSON, page scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.functions.units import find_quantities

# What tells a condition's kind, in order; what asks for all values, and for compatibility.
KINDS = [
    ("speed_grade", r"\b\d{3,5}\s*(?:mt/s|mbps|gt/s|mhz)\b|\b(?:lp)?ddr\d?x?[\s-]\d{3,4}\b|speed\s*(?:bin|grade)|(?<![\w.])-\d{4}[a-z]?\b"),
    ("density", r"\b\d+\s*gb(?:it)?\b(?!/s)"),
    ("temperature", r"°\s*c\b|\btc(?:ase)?\b|temperature|sıcaklık|\bcommercial\b|\bindustrial\b|\bextended\b|\bautomotive\b"),
]
ASKS_ALL = r"\b(?:tüm|tümü|hepsi\w*|bütün|her\s+bir|listele\w*|tablo\w*|all|every|each|list|table)\b"
COMPATIBILITY = r"uyumlu|uyumluluk|bağla(?:nabilir|yabilir|nır|mak|rsam)|sür(?:ebilir|er)\s+mi|compatib|interoperab|\bconnect|\bdrive\b|\bdirectly\b"
CONDITION_UNITS = ["mt/s", "gt/s", "gb/s", "mb/s", "mbps", "gbps", "mhz", "ghz", "gbit", "gb", "mb", "kb", "°c", "ns", "ps", "us", "µs", "ms", "mv", "v", "ma", "a", "ohm", "ω"]
FILLER = ["with", "only", "when", "from", "speed", "grade", "bins", "device", "devices", "case", "range", "than", "less", "more", "above", "below"]
TABLE_HINTS = ["min", "max", "typ", "unit", "symbol", "parameter", "condition", "value"]


def kind(condition: Column) -> Column:
    """speed_grade, density, temperature, or operating_condition."""
    low = F.lower(condition)
    return F.coalesce(*[F.when(low.rlike(f"(?U){p}"), k) for k, p in KINDS], F.lit("operating_condition"))


_UNITS = "(?:" + "|".join(CONDITION_UNITS) + ")"
_STARTS = r"(?<![a-z\d.,])"
_ENDS = r"(?![a-z\d])"
#: A value with its unit; a number of three digits or more, or of two that no unit follows; any number; a word.
_MEASURED = rf"{_STARTS}\d+(?:[.,]\d+)?\s?{_UNITS}{_ENDS}"
_LONG = rf"{_STARTS}(?:\d{{3,}}(?:[.,]\d+)?|\d\d[.,]\d+|\d[.,]\d\d+|\d(?:\d|[.,]\d)(?!\s?{_UNITS}{_ENDS}))(?=\s?(?:{_UNITS})?{_ENDS})(?![.,]?\d)"
_NUMBER = r"(?<![\d.])\d+(?:[.,]\d+)?(?!\d)"


def _found(text: Column, *patterns: str) -> Column:
    """All that patterns find in a text, without blanks."""
    low = F.replace(tx.fold(text), F.lit("gbit"), F.lit("gb"))
    return F.array_distinct(F.flatten(F.array(*[F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(0)), lambda x: F.regexp_replace(x, r"\s", "")) for p in patterns])))


def tokens(condition: Column) -> Column:
    """What tells a condition from others: values with their units, longer numbers, and words of four letters or more
    that are no filler."""
    return F.filter(_found(condition, _MEASURED, _LONG, "[a-z]{4,}"), lambda w: ~w.isin(FILLER))


def mentions(text: Column, condition: Column) -> Column:
    """The text names the condition already: what it says and what tells the condition have a part in common."""
    return F.arrays_overlap(tokens(condition), _found(text, _MEASURED, _NUMBER, r"\b[a-z]{4,}\b"))


def asks_all(text: Column) -> Column:
    return text.rlike(f"(?iU){ASKS_ALL}")


def asks_compatibility(text: Column) -> Column:
    return text.rlike(f"(?iU){COMPATIBILITY}")


def mask_values(text: Column) -> Column:
    """The text with every quantity as X: the first place of each, in the order in which they were found."""
    found = F.transform(find_quantities(text), lambda q: q["text"])
    put = lambda t, q: F.concat(F.left(t, F.position(q, t) - 1), F.lit("X"), F.substring(t, F.position(q, t) + F.length(q), F.lit(2**31 - 1)))
    return F.aggregate(found, text, lambda t, q: F.when(F.contains(t, q), put(t, q)).otherwise(t))


def with_prefix(text: Column, model: Column, query: bool) -> Column:
    """The text as a model of a family wants it: e5 takes query: and passage:, instruction models a task before queries."""
    name = F.lower(F.coalesce(model, F.lit("")))
    e5 = F.concat(F.lit("query: " if query else "passage: "), text)
    task = F.concat(F.lit("Instruct: Given a question, retrieve passages that answer it\nQuery: "), text) if query else text
    return F.when(F.contains(name, F.lit("instruct")) | F.contains(name, F.lit("qwen3-embedding")), task).when(name.rlike(r"(?:^|[/_-])e5(?:$|[_-])"), e5).otherwise(text)


def base_url(url: Column) -> Column:
    """An address with a scheme, without blanks, closing slashes and a closing path of an endpoint."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"/+$", "")
    u = F.regexp_replace(u, r"/(?:chat/completions|completions|embeddings|rerank|models)$", "")
    return F.when(u == "", "").when(u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), u).otherwise(F.concat(F.lit("http://"), u))


def file_uri(path: Column) -> Column:
    """A path as a read-only URI: slashes forward, marks of a query escaped."""
    p = F.replace(F.replace(F.replace(F.translate(path, "\\", "/"), F.lit("%"), F.lit("%25")), F.lit("?"), F.lit("%3f")), F.lit("#"), F.lit("%23"))
    return F.concat(F.lit("file:"), F.when(p.startswith("//"), F.concat(F.lit("//"), p)).otherwise(p), F.lit("?mode=ro&immutable=1"))


def csv_field(value: Column) -> Column:
    """One line, without the separator; what a spreadsheet would take for a formula is marked as text."""
    v = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[;\r\n\t]+", " "))
    return F.when(v.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), v)).otherwise(v)


def file_name(name: Column) -> Column:
    """A name without folders and without what file systems don't take; 'file' where nothing is left."""
    n = F.regexp_replace(F.element_at(F.split(F.translate(name, "\\", "/"), "/"), -1), r"[^\w.\- ]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(n, r"^[. ]+|[. ]+$", ""), F.lit("")), F.lit("file"))


def iso_utc(at: Column) -> Column:
    """A time as text of whole seconds in UTC (the session's zone)."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def retry_wait(header: Column, attempt: Column, cap: float = 30.0) -> Column:
    """Seconds until the next try: as asked for, if that is a number, else 2^attempt; 0 to ``cap``."""
    return F.least(F.greatest(F.coalesce(F.trim(header).try_cast("double"), F.pow(F.lit(2.0), attempt)), F.lit(0.0)), F.lit(cap))


def json_or_empty(text: Column) -> Column:
    """A JSON object as a map of texts; an empty one for anything else."""
    return F.coalesce(F.from_json(F.when(F.trim(text).startswith("{"), text), "map<string,string>"), F.create_map().cast("map<string,string>"))


def table_captions(text: Column) -> Column:
    """Lines that are a table's caption: its number, then a title, a mark or nothing; no running text."""
    return F.regexp_count(text, F.lit(r"(?m)^\s*(?i:table|tablo)\s+[A-Z]?\d++(?:[.\-–]\d++)*+[a-z]?+[ \t]*+(?:$|[—–:.(\-]|[\p{Lu}\d])"))


def page_table_score(text: Column, drawings: Column, tables: Column, aligned: Column) -> Column:
    """How likely a page has a table; 0 without a caption, a found table, or three aligned rows."""
    captions = table_captions(text)
    kinds = F.size(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\b(?:" + "|".join(TABLE_HINTS) + r")"), F.lit(0)), lambda h: F.left(h, F.lit(3)))))
    score = (
        3.0 * F.least(captions, F.lit(2)) + 0.75 * F.least(kinds, F.lit(6)) + F.least(F.size(find_quantities(text)) / 4.0, F.lit(5.0)) + 3.0 * F.least(tables, F.lit(1))
        + F.when(aligned >= 3, 3.0 + F.least(aligned / 4.0, F.lit(2.0))).otherwise(0.0) + F.when(drawings >= 20, 1.0).otherwise(0.0)
    )
    return F.when((tables > 0) | (aligned >= 3) | (captions > 0), score).otherwise(0.0)


def judge_tokens(text: Column) -> Column:
    """A cautious count for packing: a third of the characters, and one."""
    return F.floor(F.length(text) / 3).cast("long") + 1


def effective_context(setting: Column, server: Column) -> Column:
    """Tokens that a model takes: the setting, 2000 at least, within what the server reports."""
    own = F.greatest(F.lit(2000), F.coalesce(setting, F.lit(16000)))
    return F.when(server > 0, F.least(own, server)).otherwise(own)


def batches(costs: Column, room: int, size: int, reply: int = 0) -> Column:
    """For an ordered array of costs, the batch (from 0) that each falls into: at most ``size`` to a batch, and together,
    with ``reply`` for each, within ``room``; one that is too large alone is alone."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        new = (s["n"] > 0) & ((s["n"] >= size) | (s["used"] + c + reply * (s["n"] + 1) > room))
        batch = s["batch"] + new.cast("int")
        return F.struct(batch.alias("batch"), F.when(new, 1).otherwise(s["n"] + 1).alias("n"), (F.when(new, F.lit(0)).otherwise(s["used"]) + c).cast("long").alias("used"), F.concat(s["out"], F.array(batch)).alias("out"))

    return F.aggregate(costs, start, step, lambda s: s["out"])
