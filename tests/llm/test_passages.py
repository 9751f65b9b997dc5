"""Passages of just over 50 words are found wherever they begin in a sentence."""

import random

import pytest

from quillstone.llm import substrings
from tests.llm.conftest import prose


@pytest.mark.parametrize("marks", [True, False])
def test_every_passage_has_a_common_run(marks):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghi") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    for _ in range(400):
        n = r.choice([51, 52, 55, 60])
        p = prose(r, n + 20, words).split()[r.randrange(20) :][:n]
        p = p if marks else [w.strip(".") for w in p]
        runs = []
        for _ in range(2):
            text = " ".join([*prose(r, 90, words).split()[: r.randint(30, 90)], *p, *prose(r, 90, words).split()[r.randint(0, 40) :]])
            pieces = substrings.sentences(text)
            assert "".join(x for x, _ in pieces) == text and max(len(w) for _, w in pieces) <= substrings.WINDOW
            runs.append({x[0] for x in substrings._spans(pieces, substrings.SEVERAL, substrings.WORDS)})
        assert runs[0] & runs[1]
