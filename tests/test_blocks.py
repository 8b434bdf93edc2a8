"""Rate windows in blocks against a plain loop."""

import datetime
import random

import numpy as np
import pytest

from marginalia.streaming import limits
from marginalia.streaming.blocks import Steps

START = datetime.datetime(2024, 1, 1)


def plain(times, length, start=None, hits=0):
    found = []
    for t in times:
        if start is None or start + length <= t:
            start, hits = t, 0
        hits += 1
        found.append((start, hits))
    return found


@pytest.mark.parametrize("length", [1, 7, 40, 10_000])
def test_functions_of_blocks_compose(length):
    rng = np.random.default_rng(length)
    for _ in range(30):
        times = np.sort(rng.integers(0, 300, rng.integers(3, 60)))
        cuts = np.unique([0, *rng.integers(1, len(times), 3), len(times)])
        blocks = [times[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        whole = Steps.of(blocks[0], length, True)
        for b in blocks[1:]:
            whole = whole.then(Steps.of(b, length, False))
        assert (whole.starts[0], whole.hits[0]) == plain(times.tolist(), length)[-1] and len(whole.starts) == 1
        for start in range(-50, int(blocks[-1][0]) + 1):  # any window that may be open before a block
            own = Steps.of(blocks[-1], length, False)
            at = int(np.searchsorted(own.limits, start))
            got = (start, 5 + own.n) if at == len(own.limits) else (own.starts[at], own.hits[at])
            assert got == plain(blocks[-1].tolist(), length, start, 5)[-1]
        if len(blocks) > 2:  # composition is associative
            a, b, c = (Steps.of(x, length, k == 0) for k, x in enumerate(blocks[:3]))
            left, right = a.then(b).then(c), a.then(b.then(c))
            assert all(np.array_equal(getattr(left, f), getattr(right, f)) for f in ("limits", "starts", "hits"))


@pytest.mark.parametrize("seconds,span", [(60, 5000), (3, 5000), (100_000, 5000), (60, 40)])
def test_one_key_of_all_rows_is_counted_by_many_tasks(spark, seconds, span):
    rng = random.Random(seconds)
    rows = [(i, "hot" if i % 10 else rng.choice("abcdxyz"), START + datetime.timedelta(seconds=rng.randrange(span)), "x") for i in range(3000)]
    rows += [(9000, None, START, "x"), (9001, "hot", None, "x")]
    frame = spark.createDataFrame(rows, "i long, k string, at timestamp, hit string").repartition(5).drop("hit")
    out = limits.rate_windows(frame, "k", "at", seconds, 3, ties=("i",), key_rows=50)
    hot = out.where("k = 'hot'").rdd.glom().map(len).collect()
    assert sum(n > 100 for n in hot) > 2 and max(hot) < 0.8 * sum(hot)
    want = []
    for k in {r[1] for r in rows} - {None}:
        own = sorted((r[2], r[0]) for r in rows if r[1] == k and r[2])
        at = [int((t - START).total_seconds()) for t, _ in own]
        want += [(i, k, START + datetime.timedelta(seconds=s), h, h <= 3) for (_, i), (s, h) in zip(own, plain(at, seconds), strict=True)]
    assert sorted((r.i, r.k, r.window_start, r.hit, r.allowed) for r in out.collect()) == sorted(want)
    alike = limits.rate_windows(frame, "k", "at", seconds, 3, ties=("i",))
    assert alike.exceptAll(out).isEmpty() and out.exceptAll(alike).isEmpty()
