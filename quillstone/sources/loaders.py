"""Documents from files and pages: text, Markdown, HTML and DOCX into blocks; delimited logs; embeddings."""

from __future__ import annotations

import hashlib
import html
import io
import re
import zipfile
from array import array
from functools import lru_cache
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("kind", T.StringType())]))


def decode(raw: bytes) -> str:
    """UTF-8, with or without a mark; else the Turkish code page; else UTF-8 with replacements."""
    raw = raw.removeprefix(b"\xef\xbb\xbf")
    for name, errors in (("utf-8", "strict"), ("cp1254", "strict"), ("utf-8", "replace")):
        try:
            return raw.decode(name, errors)
        except UnicodeDecodeError:
            pass
    return ""


_HEADING = re.compile(r"(?m)^(#{1,6}\s.*)$")


def text_blocks(text: str) -> list[dict]:
    """Pages at form feeds, paragraphs at blank lines; a Markdown heading is a block of its own."""
    return [
        {"page": page, "text": part.strip(), "kind": "text"}
        for page, body in enumerate(text.split("\f"), 1)
        for para in re.split(r"\n\s*\n", body)
        for part in _HEADING.split(para)
        if part.strip()
    ]


# Elements that part paragraphs, those that part cells, and those whose content is no text.
PARAGRAPHS = "p div section article ul ol li table tr pre blockquote header footer main aside nav figure dl dt dd form".split()
CELLS = ["td", "th"]
NO_TEXT = ["script", "style"]

#: What stands for a tag: of elements as they open, then as they close. Other tags leave nothing.
_OPEN = dict.fromkeys(PARAGRAPHS, "\n\n") | dict.fromkeys(CELLS, " | ") | {f"h{k}": "\n\n" + "#" * k + " " for k in range(1, 7)} | {"br": "\n"}
_CLOSE = dict.fromkeys([*PARAGRAPHS, *(f"h{k}" for k in range(1, 7))], "\n\n")
_SKIP = re.compile(r"(?is)<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(" + "|".join(NO_TEXT) + r")\b[^>]*>.*?(?:</\1\s*>|$)")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)(?:"[^"]*"|'[^']*'|[^'">])*>""")


def html_text(page: str | None) -> str:
    """Text with '#' for headings, paragraphs at blank lines and cells behind ' | '."""
    body = _SKIP.sub("", page or "")
    text = _TAG.sub(lambda m: (_CLOSE if m[1] else _OPEN).get(m[2].lower(), ""), body)
    return re.sub(r"[ \t]+", " ", html.unescape(text))


def docx_text(raw: bytes) -> str:
    """Paragraphs with '#' for heading styles, tables as Markdown rows, in document order."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{w}body")
    plain = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{w}p":
            style = next((s.get(f"{w}val", "") for s in e.iter(f"{w}pStyle")), "")
            level = re.fullmatch(r"[Hh]eading\s*([1-6])", style)
            out.append(("#" * int(level.group(1)) + " " if level else "") + plain(e))
        elif e.tag == f"{w}tbl":
            rows = [[plain(c) for c in r.iter(f"{w}tc")] for r in e.iter(f"{w}tr")]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            out.append("\n".join([*lines[:1], "|" + "---|" * len(rows[0]), *lines[1:]]) if rows else "")
    return "\n\n".join(x for x in out if x.strip())


@F.pandas_udf(BLOCKS)
def _blocks(kind: pd.Series, raw: pd.Series) -> pd.Series:
    def one(k, b):
        b = b or b""
        text = docx_text(b) if k == "docx" else html_text(decode(b)) if k in ("html", "htm") else decode(b)
        return text_blocks(text)

    return pd.Series([one(k, b) for k, b in zip(kind, raw, strict=True)])


FORMATS = ("txt", "md", "markdown", "html", "htm", "docx")


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, suffix, size, modified, content) of the files below root; hidden ones, office locks and
    empty ones are left out. Content is only read where it is used."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    f = f.where(~name.startswith(".") & ~name.startswith("~$") & (F.lower(name) != "thumbs.db") & (F.col("length") > 0))
    suffix = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    at = F.locate(root.split("://")[-1].rstrip("/") + "/", F.col("path"))
    rel = F.when(at > 0, F.substring(F.col("path"), at + len(root.split("://")[-1].rstrip("/")) + 1, F.lit(100_000))).otherwise(name)
    return f.select("path", rel.alias("rel"), suffix.alias("suffix"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def load(found: DataFrame) -> DataFrame:
    """(path, ord, page, text, kind) of the supported files."""
    ok = found.where(F.col("suffix").isin(*FORMATS))
    return ok.select("path", F.posexplode(_blocks("suffix", "content")).alias("ord", "b")).select("path", "ord", "b.page", "b.text", "b.kind")


def html_blocks(pages: DataFrame, key: str, column: str) -> DataFrame:
    """(key, ord, page, text, kind) of a table of raw pages."""
    b = _blocks(F.lit("html"), F.encode(column, "UTF-8"))
    return pages.select(key, F.posexplode(b).alias("ord", "b")).select(key, "ord", "b.page", "b.text", "b.kind")


def usage_log(spark: SparkSession, path: str, layouts: list[list[str]]) -> DataFrame:
    """Delimited logs in one of several layouts, told apart by the number of columns in the header line:
    columns that a layout lacks are null, lines that don't fit it are left out; file has the path."""
    raw = spark.read.text(path).withColumn("file", F.input_file_name())
    cells = F.split(F.regexp_replace("value", "[﻿\r]", ""), ";")
    raw = raw.select("file", cells.alias("c"))
    out = None
    for cols in layouts:
        fit = raw.where((F.size("c") == len(cols)) & (F.col("c")[0] != cols[0])).select("file", *[F.col("c")[i].alias(n) for i, n in enumerate(cols)])
        out = fit if out is None else out.unionByName(fit, allowMissingColumns=True)
    return out


@lru_cache(maxsize=1 << 18)
def _hash(part: str) -> int:
    return int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")


@lru_cache(maxsize=1 << 17)
def _places(word: str, size: int) -> bytes:
    """Where a word's parts go: their places, behind ``size`` those that subtract. Words and trigrams are hashed once a worker."""
    marked = f"#{word}#"
    parts = [word, *([marked[i : i + 3] for i in range(len(marked) - 2)] if len(word) > 3 else [])]
    return array("I", [h % size + (0 if h >> 63 else size) for h in map(_hash, parts)]).tobytes()


def embedding_of(text: str | None, size: int) -> list[float]:
    """Words, and trigrams of words over three letters, hashed with sign into a unit vector."""
    places = b"".join([_places(w, size) for w in re.findall(r"\w+", (text or "").lower())])
    n = np.bincount(np.frombuffer(places, np.uintc), minlength=2 * size)
    v = (n[:size] - n[size:]).astype(float)
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def hash_embedding(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(t: pd.Series) -> pd.Series:
        return t.map(lambda x: embedding_of(x, size))

    return rows.select(key, embed(text).alias("embedding"))
