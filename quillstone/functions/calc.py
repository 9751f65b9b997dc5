"""Arithmetic of answers, and where its numbers come from; JSON out of prose; excerpts; stems."""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate, count, groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.units import find_quantities, readings_of

# What an expression may call and name, and its bounds.
FUNCTIONS = {
    "sqrt": math.sqrt, "log10": math.log10, "log": math.log, "ln": math.log, "log2": math.log2, "exp": math.exp, "ceil": math.ceil, "floor": math.floor,
    "sin": math.sin, "cos": math.cos, "tan": math.tan, "atan": math.atan, "abs": abs, "min": min, "max": max, "round": round,
}
CONSTANTS = {"pi": math.pi, "e": math.e}
LONGEST = 300
LARGEST_EXPONENT = 100

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(\*\*|//|[-+*/%^×·(),]))")
_ALSO = {"^": "**", "×": "*", "·": "*"}
#: Operators with how strongly they bind; a power binds its right side first.
_BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "%": 2, "**": 4}


def _power(a: float, b: float) -> float:
    if abs(b) > LARGEST_EXPONENT:
        raise ValueError("exponent too large")
    return a**b


_APPLY = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "//": lambda a, b: a // b, "%": lambda a, b: a % b, "**": _power}


def _tokens(expression: str) -> list[tuple[str, str]]:
    """(kind, text): number, name or mark; the end has both empty."""
    if len(expression) > LONGEST:
        raise ValueError("expression too long")
    out, at, text = [], 0, expression.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not arithmetic: {text[at:at + 10]!r}")
        at = m.end()
        out.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("mark", _ALSO.get(m[3], m[3])))
    return [*out, ("", "")]


def evaluate(expression: str) -> float:
    """Numbers, + - * / // % **, parentheses, FUNCTIONS and CONSTANTS; nothing else, and no exponent over 100."""
    todo = _tokens(expression)[::-1]

    def expect(mark: str) -> None:
        if todo.pop()[1] != mark:
            raise ValueError(f"{mark!r} is missing")

    def atom():
        kind, text = todo.pop()
        if kind == "number":
            return int(text) if text.isdecimal() else float(text)
        if text in ("-", "+"):
            x = climb(3)  # weaker than a power, stronger than a product
            return -x if text == "-" else x
        if text == "(":
            x = climb(1)
            expect(")")
            return x
        if kind == "name" and todo[-1][1] == "(" and text in FUNCTIONS:
            todo.pop()
            args = []
            while todo[-1][1] != ")":
                args.append(climb(1))
                if todo[-1][1] != ")":
                    expect(",")
            todo.pop()
            return FUNCTIONS[text](*args)
        if kind == "name" and text in CONSTANTS:
            return CONSTANTS[text]
        raise ValueError(f"not arithmetic: {text!r}")

    def climb(least: int):
        x = atom()
        while (binds := _BINDS.get(todo[-1][1], 0)) >= least:
            mark = todo.pop()[1]
            x = _APPLY[mark](x, climb(3 if mark == "**" else binds + 1))
        return x

    value = climb(1)
    expect("")
    return float(value)


def literals(expression: str) -> list[tuple[str, float]]:
    """The numbers of an expression, as written and as values; none, if it is no expression."""
    try:
        return [(text, float(text)) for kind, text in _tokens(expression) if kind == "number"]
    except ValueError:
        return []


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("number", T.DoubleType())])))
def number_literals(expression: pd.Series) -> pd.Series:
    return expression.map(lambda e: [{"value": t, "number": v} for t, v in literals(e or "")])


def needs_no_source(number: Column) -> Column:
    """Whole numbers up to 16, powers of ten, one half and one quarter."""
    tens = F.when(number > 0, F.abs(F.log10(number) - F.round(F.log10(number))) < 1e-9).otherwise(False)
    return number.isin(0.5, 0.25) | ((number == F.floor(number)) & (F.abs(number) <= 16)) | tens


def stated_values(text: Column) -> Column:
    """Every value that a text states: of its quantities in SI units, and of its plain numbers, in all readings."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+(?:[.,]\d+)*"), F.lit(0)), readings_of)
    return F.array_distinct(F.concat(F.flatten(F.transform(find_quantities(text), lambda q: q["values"])), F.flatten(plain)))


def traced(numbers: Column, sources: Column) -> Column:
    """Each of number_literals() that needs a source, as (value, sources): the n of the sources (n, values) in which it
    stands, in any reading or unit."""
    close = lambda a, b: (a == b) | (F.abs(a - b) <= 1e-6 * F.greatest(F.abs(a), F.abs(b)))
    held = lambda x: F.transform(F.filter(sources, lambda s: F.exists(s["values"], lambda v: close(v, x["number"]))), lambda s: s["n"])
    return F.transform(F.filter(numbers, lambda x: ~needs_no_source(x["number"])), lambda x: F.struct(x["value"].alias("value"), held(x).alias("sources")))


def all_traced(inputs: Column) -> Column:
    """One input at least, and each with a source."""
    return (F.size(inputs) > 0) & F.forall(inputs, lambda i: F.size(i["sources"]) > 0)


@F.pandas_udf(T.DoubleType())
def calculate(expression: pd.Series) -> pd.Series:
    """The value of an expression; null where it is none."""

    def one(e):
        try:
            return evaluate(e)
        except (ValueError, TypeError, SyntaxError, ArithmeticError, RecursionError):
            return None

    return expression.map(one).astype("float64")


def json_in(text: str | None) -> dict | None:
    """The first JSON object in a text, past thoughts, fences and prose."""
    text = re.sub(r"<think>.*?</think>", "", text or "", flags=re.S)
    decode = json.JSONDecoder().raw_decode
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decode(text, m.start())
        except ValueError:
            continue
        return found if isinstance(found, dict) else None
    return None


@F.pandas_udf(T.StringType())
def salvage_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if (x := json_in(t)) is None else json.dumps(x, ensure_ascii=False, sort_keys=True))


_TERM = re.compile(r"[A-Za-z][\w-]{2,}")
_FIGURE = re.compile(r"\d+(?:[.,]\d+)?")


def excerpt(text: str, claim: str, limit: int) -> str:
    """At most ``limit`` characters: the beginning, up to a quarter of them, then the lines that share most numbers
    (three each) and words (one each) with the claim; in their order, with marks where lines are left out."""
    if len(text) <= limit:
        return text
    weights = dict.fromkeys((w.lower() for w in _TERM.findall(claim)), 1) | dict.fromkeys(_FIGURE.findall(claim), 3)
    lines = text.split("\n")
    ends = list(accumulate(len(x) + 1 for x in lines))
    head = bisect_right(ends, limit // 4)
    left = limit - (ends[head - 1] if head else 0)
    worth = [sum(weights.get(t, 0) for t in {w.lower() for w in _TERM.findall(x)} | set(_FIGURE.findall(x))) for x in lines]
    chosen = set(range(head))
    for i in sorted(range(head, len(lines)), key=lambda i: (worth[i], i), reverse=True):
        if worth[i] and len(lines[i]) < left:
            chosen.add(i)
            left -= len(lines[i]) + 1
    runs = groupby(sorted(chosen), key=lambda i, c=count(): i - next(c))
    parts = ["\n".join(lines[i] for i in run) if first == 0 else "\n".join(["[...]", *(lines[i] for i in run)]) for first, run in runs]
    return "\n".join(parts)[:limit]


# The suffix rules of Porter's algorithm (1980), steps 2, 3 and 4.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _kinds(stem: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _short(stem: str) -> bool:
    return len(stem) >= 3 and _kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) >= 2 and stem[-1] == stem[-2] and _kinds(stem)[-1] == "c"


@lru_cache(1 << 17)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word of ASCII letters; other words stay."""
    if len(w) <= 2 or not re.fullmatch("[a-z]+", w):
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            base = w.removesuffix(end)
            if base != w:
                if "v" in _kinds(base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        rules = sorted((r.split(":") for r in table.split()), key=lambda r: -len(r[0]))
        end, new = next(((a, b) for a, b in rules if w.endswith(a)), ("", ""))
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + new
    end = next((e for e in sorted(_STEP4.split(), key=len, reverse=True) if w.endswith(e)), "")
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and w.endswith("ll") else w


@F.pandas_udf(T.StringType())
def stem_words(text: pd.Series) -> pd.Series:
    """A text with its words stemmed, marks of letters removed."""
    import unicodedata

    def one(t):
        if t is None:
            return None
        plain = t.replace("İ", "i").lower()
        if not plain.isascii():
            plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
        return re.sub(r"\w+", lambda m: stem(m[0]), plain)

    return text.map(one)
