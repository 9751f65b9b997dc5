"""One document of each group stays, with or without an id of its own."""

import random

from quillstone.llm import simhash
from tests.llm.conftest import prose


def test_one_of_each_group_stays(spark):
    r = random.Random(4)
    a, b, c, d = (prose(r, 60) for _ in range(4))
    rows = [(None, a), (None, b), (None, b.upper()), (1, c), (1, d), (2, d), (None, d), (0, a + " end"), (3, c)]
    got = simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id is None, x.doc_id, x.text.lower()) for x in got if x.doc_id is not None) == sorted([(False, 0, (a + " end").lower()), (False, 1, c.lower()), (False, 1, d.lower())])
    assert [x.text.lower() for x in got if x.doc_id is None] == [b.lower()]
