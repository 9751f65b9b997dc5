"""Answers that arrive in pieces, parted into what is said and what is thought, as keyed state over micro-batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What ends a stretch of answer, and what ends a stretch of thoughts.
TAGS = ("<think>", "</think>")


def part(text: str, inside: bool, final: bool = False) -> tuple[tuple[str, str], bool, str]:
    """((answer, thoughts), inside from now on, what is held back): the text up to its end, or up to where a tag may
    have begun. Outside, a closing tag is text, and so is an opening one inside."""
    out = ["", ""]
    head, tag, tail = text.partition(TAGS[inside])
    while tag:
        out[inside] += head
        inside, text = not inside, tail
        head, tag, tail = text.partition(TAGS[inside])
    begun = next(n for n in range(min(len(TAGS[inside]) - 1, len(text)), -1, -1) if TAGS[inside].startswith(text[len(text) - n :]))
    kept = len(text) if final else len(text) - begun
    out[inside] += text[:kept]
    return (out[0], out[1]), inside, text[kept:]


def split_stream(pieces: DataFrame, groups: int = 1024) -> DataFrame:
    """(stream_id, at, answer, thoughts), a row for each piece, in append mode: what can be told with it.

    pieces (stream_id, at, text, last) is a streaming DataFrame; a stream's pieces come in order of ``at`` from one micro-batch
    to the next, in any order within one. A stream's state is whether it is inside a thought and the beginning of a tag,
    seven characters at most, and goes with the piece marked as last, which lets go of what was held. Null texts are empty.
    Streams are dealt into ``groups``, as a group's call costs far more than a stream's pieces; a group keeps the states of its open streams."""

    def run(key, frames, state):
        held = dict(zip(state.get[0], zip(*state.get[1:], strict=True), strict=True)) if state.exists else {}
        batch = pd.concat(list(frames))
        ids, at, texts, last = (batch[c].tolist() for c in ("stream_id", "at", "text", "last"))
        rows = []
        for i in sorted(range(len(ids)), key=lambda i: (at[i], i)):
            inside, kept = held.get(ids[i], (False, ""))
            (answer, thoughts), inside, kept = part(kept + (texts[i] or ""), inside, bool(last[i]))
            rows.append((ids[i], at[i], answer, thoughts))
            if last[i]:
                held.pop(ids[i], None)
            else:
                held[ids[i]] = inside, kept
        if held:
            state.update((list(held), [x for x, _ in held.values()], [x for _, x in held.values()]))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["stream_id", "at", "answer", "thoughts"])

    kind = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    slim = pieces.select(F.pmod(F.xxhash64("stream_id"), F.lit(groups)).alias("_group"), "stream_id", "at", "text", "last")
    state = f"streams array<{kind['stream_id']}>, inside array<boolean>, held array<string>"
    return slim.groupBy("_group").applyInPandasWithState(run, f"stream_id {kind['stream_id']}, at {kind['at']}, answer string, thoughts string", state, "append", "NoTimeout")
