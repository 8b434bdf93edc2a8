"""Outlines of parts against outlines of whole notes."""

import random

import pytest

from marginalia.functions import markdown as md
from marginalia.functions.text import Fences
from marginalia.operators import sections


def test_tables_of_fences_equal_reading_on():
    rng = random.Random(1)
    for _ in range(300):
        markers = [rng.choice("`~") * rng.randint(3, 6) for _ in range(rng.randint(0, 8))]
        for open_ in ["", "```", "`````", "~~~~", "~~~~~~~~"]:
            plain = Fences()
            plain.open = open_
            for m in markers:
                plain.marker(m)
            assert sections.fence_after(sections.fence_table(markers), open_) == plain.open


def parts_of(rng, n):
    lines = ["# one", "## two ##", "### three", "###### six", "plain text é", "漢字 𝔘 words", "#no heading", "", "```", "````", "~~~ x", "    ```", "## again"]
    return ["\n".join(rng.choices(lines, weights=[1, 2, 2, 1, 6, 2, 1, 1, 0.5, 0.3, 0.3, 0.3, 1], k=rng.randint(0, 5))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_outlines_equal_those_of_whole_notes(spark, seed):
    rng = random.Random(seed)
    notes = {"hot": parts_of(rng, 700), **{f"n{k}": parts_of(rng, rng.randint(1, 40)) for k in range(30)}}
    rows = [(note, place, text, "x") for note, texts in notes.items() for place, text in enumerate(texts)]
    rows += [(None, 1, "# x", "x"), ("n1", None, "# x", "x"), ("null", 0, None, "x"), ("null", 1, "# y", "x")]
    frame = spark.createDataFrame(rows, "id string, at int, body string, heading string").repartition(5)
    found = sections.outline_of_parts(frame, "id", "at", "body").collect()
    want = []
    for note, texts in {**notes, "null": ["", "# y"]}.items():
        want += [(note, *o.values()) for o in md.outline("\n".join(texts))]
    key = lambda r: (r[0], r[4])
    assert sorted((tuple(r) for r in found), key=key) == sorted(want, key=key)
    assert len(want) > 300 and any(len(w[3]) > 2 for w in want)


def test_empty(spark):
    assert sections.outline_of_parts(spark.createDataFrame([], "id string, at int, body string"), "id", "at", "body").count() == 0
