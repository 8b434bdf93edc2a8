"""Token rotation, expiry, orphans and caps: batches against plain loops, streams against batches."""

import datetime
import random
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.streaming import ordered, tokens

START = datetime.datetime(2024, 1, 1)
LIFE, GRACE = 600, 120


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def plain_tokens(events, life, grace, most, until):
    """A clock that looks at every second."""
    said = []
    for client in sorted({e[0] for e in events}):
        own = sorted(e[1:] for e in events if e[0] == client)
        live, spent, came, empty = {}, {}, None, None
        for now in range(int(until) + 1):
            for token in sorted(t for t in live if live[t] == now):
                del live[token]
                if not live:
                    empty = now
                said.append((client, now, "expire", token, "expired", len(live)))
            spent = {t: e for t, e in spent.items() if e > now}
            while came is not None and not live and empty is not None and now >= came + grace:
                said.append((client, now, "sweep", None, "orphaned", 0))
                live, spent, came, empty = {}, {}, None, None
            for _, kind, token, other in [e for e in own if e[0] == now]:
                if came is None:
                    came = empty = now
                if kind == "issue" or kind == "rotate" and token in live and other is not None and other not in live and other not in spent:
                    new = token if kind == "issue" else other
                    if new in live or new in spent:
                        said.append((client, now, kind, token, "refused", len(live)))
                        continue
                    if kind == "rotate":
                        spent[token] = live.pop(token)
                    live[new] = now + life
                    empty = None
                    said.append((client, now, kind, token, "issued" if kind == "issue" else "rotated", len(live)))
                    while len(live) > most:
                        oldest = next(iter(live))
                        del live[oldest]
                        said.append((client, now, "evict", oldest, "evicted", len(live)))
                elif kind == "check":
                    said.append((client, now, kind, token, "valid" if token in live else "invalid", len(live)))
                elif token in live:
                    spent[token] = live.pop(token)
                    empty = None if live else now
                    said.append((client, now, kind, token, "consumed", len(live)))
                elif token in spent:
                    said.append((client, now, kind, token, "reused", len(live)))
                    if live:
                        live, empty = {}, now
                else:
                    said.append((client, now, kind, token, "invalid", len(live)))
                while came is not None and not live and empty is not None and now >= came + grace and empty == now and all(e[0] != now for e in own[own.index((now, kind, token, other)) + 1 :]):
                    said.append((client, now, "sweep", None, "orphaned", 0))
                    live, spent, came, empty = {}, {}, None, None
    return said


def token_events(seed, n=400, span=4000):
    rng = random.Random(seed)
    times = rng.sample(range(span), n)  # no two events at once
    return [(rng.choice("abcd"), t, rng.choice(["issue", "rotate", "rotate", "check"]), f"t{rng.randrange(9)}", rng.choice([f"t{rng.randrange(9)}", None])) for t in times]


def frame(spark, events):
    return spark.createDataFrame([(c, at(t), k, token, other) for c, t, k, token, other in events], "client string, ts timestamp, what string, token string, successor string")


def log(rows, **more):
    return tokens.token_log(rows, "client", "ts", F.col("what"), F.col("token"), F.col("successor"), LIFE, GRACE, 3, **more)


def said(rows):
    return sorted(((r["group"], int((r["at"] - START).total_seconds()), r["kind"], r["item"], r["outcome"], r["n"]) for r in rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tokens_equal_a_clock(spark, seed):
    events = token_events(seed)
    want = sorted(plain_tokens(events, LIFE, GRACE, 3, 5000), key=repr)
    got = said(log(frame(spark, events).repartition(3), until=str(at(5000))).collect())
    assert got == want
    assert {"issued", "rotated", "consumed", "reused", "expired", "orphaned", "evicted", "valid", "invalid", "refused"} <= {w[4] for w in want}


def test_a_spent_token_revokes_its_client(spark):
    events = [("a", 0, "issue", "t1", None), ("a", 1, "rotate", "t1", "t2"), ("a", 2, "rotate", "t2", "t3"), ("a", 3, "rotate", "t1", "x"), ("a", 4, "rotate", "t3", "t4"), ("b", 3, "issue", "t1", None)]
    got = [(c, w, o) for c, _, _, w, o, _ in said(log(frame(spark, events), until=str(at(5))).collect())]
    assert got == [("a", "t1", "issued"), ("a", "t1", "rotated"), ("a", "t2", "rotated"), ("a", "t1", "reused"), ("a", "t3", "invalid"), ("b", "t1", "issued")]


def plain_buckets(events, length, limit, most, share):
    found, maps = [], {}
    for key, t in sorted(events, key=lambda e: (e[1], e[0])):
        own = maps.setdefault(share[key], {})
        if key not in own:
            own[key] = [t, 0]
        if own[key][0] + length <= t:
            own[key][:] = [t, 0]
        own[key][1] += 1
        found.append((str(share[key]), t, "hit", key, "allowed" if own[key][1] <= limit else "refused", own[key][1]))
        if len(own) > most:
            for k in [k for k in own if own[k][0] + length <= t]:
                del own[k]
                found.append((str(share[key]), t, "evict", k, "over", 0))
            while len(own) > most:
                k = next(iter(own))
                found.append((str(share[key]), t, "evict", k, "oldest", own.pop(k)[1]))
    return sorted(found, key=repr)


def test_caps_equal_plain_maps(spark):
    rng = random.Random(5)
    events = [(f"k{int(rng.expovariate(0.1))}", t) for t in rng.sample(range(3000), 900)]
    rows = spark.createDataFrame([(k, at(t)) for k, t in events] + [(None, at(1)), ("k1", None)], "k string, ts timestamp").repartition(4)
    share = {r.k: r.s for r in rows.select("k", F.pmod(F.xxhash64("k"), F.lit(4)).alias("s")).collect()}
    got = said(tokens.capped_hits(rows, "k", "ts", 60, 2, 20, shares=4).collect())
    assert got == plain_buckets(events, 60, 2, 5, share)
    assert {g[4] for g in got} == {"allowed", "refused", "over", "oldest"}
    assert tokens.capped_hits(rows, "k", "ts", 60, 2, 2, shares=64).select("group").distinct().count() <= 2


def run(spark, folder, make, name, times):
    """Runs a stream over what is in a folder; the checkpoint goes on from one call to the next."""
    source = spark.readStream.schema(times).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = make(source).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None


def feed(folder, k, rows, columns):
    (folder / "in").mkdir(exist_ok=True)
    place = folder / f"{k}.parquet"
    pd.DataFrame(rows, columns=columns).astype({c: "datetime64[us]" if c == "ts" else "string" for c in columns}).to_parquet(place)
    shutil.move(place, folder / "in" / f"{k}.parquet")


def test_streams_equal_batches_with_disorder_late_rows_and_a_restart(spark, tmp_path):
    ordered.use_rocksdb(spark)
    columns, schema = ["client", "ts", "what", "token", "successor"], "client string, ts timestamp, what string, token string, successor string"
    events = token_events(7, 120, 2000)
    rows = [(c, at(t), k, token, other) for c, t, k, token, other in events]
    rows.sort(key=lambda r: (r[1] - START).total_seconds() + random.Random(str(r)).uniform(-60, 60))  # disorder inside the watermark
    make = lambda s: log(s, watermark="5 minutes")
    feed(tmp_path, 0, rows[:50], columns)
    feed(tmp_path, 1, rows[50:80], columns)
    run(spark, tmp_path, make, "t", schema)
    late = [("a", at(1), "issue", "late", None)]
    feed(tmp_path, 2, rows[80:] + late, columns)  # after a restart; the late row is behind the watermark
    feed(tmp_path, 3, [("z", at(9000), "issue", "end", None)], columns)
    run(spark, tmp_path, make, "t", schema)
    last = 9000 - 300
    got = said(spark.read.parquet(str(tmp_path / "out")).collect())
    want = said(log(frame(spark, events), until=str(at(last))).collect())
    assert got == want and any(w[4] == "orphaned" for w in want) and any(w[4] == "reused" for w in want)


def test_capped_stream_equals_batch(spark, tmp_path):
    ordered.use_rocksdb(spark)
    rng = random.Random(9)
    events = [(f"k{rng.randrange(12)}", at(t)) for t in sorted(rng.sample(range(600), 90))]
    make = lambda s: tokens.capped_hits(s, "k", "ts", 60, 2, 6, shares=2, watermark="10 seconds")
    feed(tmp_path, 0, events[:40], ["k", "ts"])
    run(spark, tmp_path, make, "c", "k string, ts timestamp")
    feed(tmp_path, 1, events[40:], ["k", "ts"])
    feed(tmp_path, 2, [("k0", at(2000))], ["k", "ts"])
    run(spark, tmp_path, make, "c", "k string, ts timestamp")
    batch = tokens.capped_hits(spark.createDataFrame(events, "k string, ts timestamp"), "k", "ts", 60, 2, 6, shares=2)
    assert said(spark.read.parquet(str(tmp_path / "out")).collect()) == said(batch.collect())


def test_registered_queries_equal_plain_loops(spark):
    from pathlib import Path

    from marginalia import queries

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test tables")
    rows = spark.read.parquet(str(data / "events.parquet")).withColumn("s", F.pmod(F.xxhash64(F.col("user_id").cast("string")), F.lit(12))).collect()
    share = {str(r.user_id): r.s for r in rows}
    events = [(str(r.user_id), (r.ts - START) // datetime.timedelta(microseconds=1)) for r in rows]
    want = plain_buckets(events, 12 * 3600 * 10**6, 2, 5, share)
    got = sorted(((r["group"], (r["at"] - START) // datetime.timedelta(microseconds=1), r["kind"], r["item"], r["outcome"], r["n"]) for r in queries.capped_hits(spark, str(data)).collect()), key=repr)
    assert got == want
    log = queries.token_log(spark, str(data)).collect()
    assert {r.outcome for r in log} >= {"issued", "invalid", "expired", "refused"} and sum(r["kind"] in ("issue", "rotate", "check") for r in log) == len(rows)
