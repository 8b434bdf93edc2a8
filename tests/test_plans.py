"""Graph walks, context packages and limits against plain loops."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as t
from marginalia.operators import graph, search
from marginalia.plans import context, project
from marginalia.streaming import limits

NOTE = (
    "id string, path string, local_path string, root string, title string, client string, project string, tags array<string>, source_refs array<string>, aliases array<string>, "
    "target_repo string, body string, folded_body string, wiki_links array<string>, md_links array<string>, size_bytes long, effective_ts timestamp"
)
START = datetime.datetime(2024, 1, 1)


def notes(spark, rows):
    full = []
    for k, r in enumerate(rows):
        body = r.get("body", "")
        full.append((r["path"], r["path"], r["path"], None, r.get("title", r["path"]), r.get("client"), r.get("project"), r.get("tags", []), r.get("refs", []), [], None, body, t.fold(body), r.get("links", []), [], len(body), START + datetime.timedelta(hours=r.get("at", k))))
    return spark.createDataFrame(full, NOTE)


def walk(edges, at, origin, depth, direction, fan_out, most, hub):
    """One walk, step by step."""
    out, into = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        into.setdefault(b, set()).add(a)
    every = lambda n: out.get(n, set()) | into.get(n, set())
    near = {"out": lambda n: out.get(n, set()), "in": lambda n: into.get(n, set()), "both": every}[direction]
    found, frontier = {}, [origin]
    for distance in range(1, depth + 1):
        new = []
        for node in sorted(frontier):
            if node != origin and len(every(node)) > hub:
                continue
            for n in sorted(near(node), key=lambda n: (-at[n], n))[:fan_out]:
                if n != origin and n not in found and len(found) < most:
                    found[n] = (distance, node)
                    new.append(n)
        frontier = new
    return {(origin, n, d, via) for n, (d, via) in found.items()}


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_neighbours_against_walks(spark, direction):
    rng = random.Random(7)
    names = [f"n{i:02}" for i in range(30)]
    edges = {(a, b) for a in names for b in rng.sample(names, rng.choice([0, 1, 2, 6])) if a != b}
    edges |= {(f"n{i:02}", "n00") for i in range(1, 14)}
    at = {n: rng.randrange(12) for n in names}
    known = spark.createDataFrame([(n, START + datetime.timedelta(hours=at[n])) for n in names], "path string, effective_ts timestamp")
    edge = spark.createDataFrame(sorted(edges), "src string, dst string")
    for depth, fan_out, most, hub in ((1, 3, 50, 30), (2, 3, 50, 8), (2, 4, 7, 8)):
        found = {tuple(r) for r in graph.neighbours(edge, known, known, depth, direction, fan_out, most, hub).collect()}
        assert found == set().union(*(walk(edges, at, n, depth, direction, fan_out, most, hub) for n in names))


def test_context_rules(spark):
    big = "\n".join(f"## Part {i}\n" + f"alpha words {i} " * 400 for i in range(4))
    rows = [
        {"path": "a.md", "body": "alpha beta", "links": ["b"], "refs": ["z.md"], "project": "p"}, {"path": "b.md", "body": "gamma", "links": ["c"]}, {"path": "c.md", "body": "delta"},
        {"path": "copy.md", "body": "alpha  beta\n"}, {"path": "big.md", "body": big, "tags": ["keep"]}, {"path": "z.md", "body": "cited"}, {"path": "q.md", "body": "same project", "project": "p"},
    ]
    df = notes(spark, rows)
    found = {r.path: r for r in context.candidates(df, "alpha", depth=2).collect()}
    assert {p: r.relationship for p, r in found.items()} == {"a.md": "seed", "copy.md": "seed", "big.md": "seed", "b.md": "linked:out", "c.md": "linked:out", "z.md": "source_ref"}
    base = found["a.md"].score
    assert found["b.md"].score == pytest.approx(base * 0.6) and found["c.md"].score == pytest.approx(base * 0.36) and found["z.md"].score == pytest.approx(base * 0.4)
    by_project = {r.path: r.relationship for r in context.candidates(df, "alpha", depth=0, project="p").collect()}
    assert by_project == {"a.md": "seed", "q.md": "same_project"}
    assert {r.path for r in context.candidates(df, "alpha", depth=2, rules=[context.TypeRule("x", 2.0, path_prefix="b")], types=["x"]).collect()} == {"big.md", "b.md"}
    assert context.candidates(df, "alpha", depth=0, rules=[context.TypeRule("k", 2.0, tag="keep")], types=["k"]).count() == 0
    rows = context.context(df, "alpha", 1000, depth=2).collect()
    chunks, summary = [r for r in rows if r.kind == "chunk"], rows[-1]
    assert summary.tokens == sum(r.tokens for r in chunks) <= 1000
    assert sum(r.tokens for r in chunks if r.path == "big.md") <= 400
    assert ("copy.md", "duplicate") in {(r.path, r.reason) for r in rows if r.kind == "omitted"} and ("big.md", "budget") in {(r.path, r.reason) for r in rows if r.kind == "omitted"}
    assert [r.score for r in chunks] == sorted((r.score for r in chunks), reverse=True)
    again = context.context(df.repartition(5), "alpha", 1000, depth=2).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]
    with pytest.raises(ValueError):
        context.candidates(df, " ")
    recent = context.candidates(df, "", depth=0, path_prefix="b").collect()
    assert {(r.path, r.relationship, r.score) for r in recent} == {("big.md", "recent", 1.0), ("b.md", "recent", 0.5)}


def test_dossier(spark):
    rows = [{"path": f"s{i}.md", "body": "# H\nx\n## I", "client": "claude-code", "project": "p", "tags": ["claude-code-session"], "at": i} for i in range(7)]
    rows += [{"path": f"d{i}.md", "body": "word " * 500, "project": "p", "tags": ["project-state"], "at": 20 + i} for i in range(4)]
    df = notes(spark, rows)
    state = project.project_state(df, "p", token_budget=1000)
    assert state["summary"].first().doc_count == 11
    sessions = {r.path: r.outline for r in state["sessions"].collect()}
    assert set(sessions) == {"s6.md", "s5.md", "s4.md", "s3.md", "s2.md"} and [o.heading for o in sessions["s6.md"]] == ["H", "I"] and sessions["s5.md"] is None
    assert [r.path for r in state["recent_docs"].collect()] == ["d3.md", "d2.md", "d1.md", "d0.md"]
    docs = state["state_docs"].collect()
    assert [r.path for r in docs] == ["d3.md", "d2.md"] and docs[1].truncated and sum(r.est_tokens for r in docs) <= 1000
    assert set(project.project_state(df, "p", include=("ops",))) == {"summary", "ops"}


def test_rate_windows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaab"), START + datetime.timedelta(seconds=rng.randrange(4000))) for i in range(400)] + [(900, None, START), (901, "a", None)]
    out = limits.rate_windows(spark.createDataFrame(rows, "i long, k string, at timestamp"), "k", "at", 60, 3).collect()
    want, state = {}, {}
    for i, k, at in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[1], r[2])):
        start, hits = state.get(k, (None, 0))
        if start is None or start + datetime.timedelta(seconds=60) <= at:
            start, hits = at, 0
        state[k] = (start, hits + 1)
        want.setdefault((k, at), set()).add((start, hits + 1, hits + 1 <= 3))
    got = {}
    for r in out:
        got.setdefault((r.k, r["at"]), set()).add((r.window_start, r.hit, r.allowed))
    assert got == want and len(out) == 400


def test_rate_stream(spark, tmp_path):
    rows = [("a", START + datetime.timedelta(seconds=s)) for s in (0, 10, 20, 70, 75)] + [("b", START)]
    pd.DataFrame(rows, columns=["k", "at"]).astype({"at": "datetime64[us]"}).to_parquet(tmp_path / "x.parquet")
    source = spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path))
    query = limits.rate_limit_stream(source, "k", "at", 60, 2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    found = sorted((r["key"], r["at"].minute * 60 + r["at"].second, r.hit, r.allowed) for r in spark.table("limited").collect())
    assert found == [("a", 0, 1, True), ("a", 10, 2, True), ("a", 20, 3, False), ("a", 70, 1, True), ("a", 75, 2, True), ("b", 0, 1, True)]


def test_walks_only_narrow(spark):
    edge = spark.createDataFrame([("a", "b")], "src string, dst string")
    known = spark.createDataFrame([("a", START), ("b", START)], "path string, effective_ts timestamp")
    for bad in ({"fan_out": 21}, {"most": 51}, {"hub": 31}, {"hub": -1}, {"most": 1.5}):
        with pytest.raises(ValueError):
            graph.neighbours(edge, known, known, 2, **bad)


def test_summary_hints_and_times_of_a_package(spark):
    rows = [{"path": "a.md", "body": "alpha beta", "links": ["b"]}, {"path": "b.md", "body": "gamma"}, {"path": "c.md", "body": "other"}]
    df = notes(spark, rows).withColumn("fm_type", context.F.when(context.F.col("path") == "b.md", "plan")).withColumn("updated_at", context.F.lit("2024-02-03"))
    out = context.context(df, "alpha", 1000, depth=1, hint_most=1.2).collect()
    chunks = {r.path: r for r in out if r.kind == "chunk"}
    assert chunks["b.md"].type == "plan" and chunks["a.md"].type is None and chunks["a.md"].updated_at == "2024-02-03"
    assert (out[-1].mode, out[-1].seed_count, out[-1].expanded_count, out[-1].total_candidates) == ("query", 1, 1, 2)
    plain = {r.path: r.score for r in context.candidates(df, "alpha", depth=1).collect()}
    hinted = {r.path: r.score for r in context.candidates(df, "alpha", depth=1, hint_most=1.2).collect()}
    assert hinted["b.md"] == pytest.approx(plain["b.md"] * 1.2) and hinted["a.md"] == plain["a.md"]
    none = context.context(df, "nowhere", 1000).collect()
    assert [(r.kind, r.tokens, r.total_candidates) for r in none] == [("summary", 0, 0)]


def test_purse():
    purse = context.Purse(100, 40)
    text, price = purse.buy("a", "word " * 100, framing=10, least=5)
    assert price <= 40 and text == ("word " * 100)[: len(text)] and purse.buy("a", "more", framing=10, least=5) is None
    assert purse.buy("b", "short", framing=10, least=5)[0] == "short" and purse.left == 100 - sum(purse.paid.values())


def test_lookup_by_root(spark):
    rows = [("x", "main:a/n.md", "a/n.md", "main"), ("y", "side:a/n.md", "a/n.md", "side"), ("side:b.md", "main:c.md", "c.md", "main"), ("z", "side:b.md", "b.md", "side"), ("w", "side:d.md", "d.md", "side")]
    df = spark.createDataFrame(rows, "id string, path string, local_path string, root string")
    find = lambda r: search.lookup(df, r, ("main", "side")).first().path
    assert find("a/n") == "main:a/n.md" and find("side:a/n.md") == "side:a/n.md" and find("d") == "side:d.md" and find("y") == "side:a/n.md"
    for bad in ("side:b.md", "nothing", "main:d"):  # an id that squats on another note's path; and what is not there
        with pytest.raises(LookupError):
            find(bad)


def test_candidates_of_a_frequent_name_are_bounded(spark):
    rows = [{"path": f"f{i:03}/readme.md", "title": "Readme"} for i in range(120)] + [{"path": f"n{i}.md", "links": ["readme", "Readme"]} for i in range(5)]
    found = graph.resolved_links(notes(spark, rows)).where("target is null").collect()
    assert len(found) == 10
    for r in found:
        assert [c.path for c in r.candidates] == [f"f{i:03}/readme.md" for i in range(graph.NAMED_MOST)]


def test_all_candidates_of_a_frequent_name(spark):
    named = [{"path": f"f{i:03}/readme.md", "title": "Readme"} for i in range(120)]
    rows = named + [{"path": f"n{i}.md", "links": ["readme", "Readme", "Start", "nowhere", "f001/readme"]} for i in range(5)]
    df = notes(spark, rows).withColumn("aliases", F.when(F.col("title") == "Readme", F.array(F.lit("Readme"), F.lit("Start"))))
    found = graph.link_candidates(df).select("src", "raw", "note", "via").collect()
    ways = {"readme": "basename", "Readme": "title", "Start": "alias"}
    assert sorted(map(tuple, found)) == sorted((f"n{i}.md", raw, r["path"], via) for i in range(5) for raw, via in ways.items() for r in named)


def test_words_of_an_unspaced_token(spark):
    some = [t.text for t in search.tokenize("東京都庁 plan", spark)]
    assert some[0] == "東京都庁" and "plan" in some and all(x in "東京都庁" for x in some if x != "plan") and len(some) >= 3
    assert [t.text for t in search.tokenize("東京都")] == ["東京都", "東京", "京都"]


def test_order_of_projects_and_results(spark):
    df = notes(spark, [{"path": f"{c}{p}{i}.md", "body": "alpha " * (i + 1), "client": c, "project": p} for c in "ba" for p in "yx" for i in range(3)]).withColumn("modified_at", context.F.col("effective_ts"))
    assert [(r.client, r.project) for r in search.list_projects(df).collect()] == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    page = search.search(df, "alpha", limit=4, offset=2).collect()
    assert [r["rank"] for r in page] == [3, 4, 5, 6] and [r.score for r in page] == sorted((r.score for r in page), reverse=True)
    old = search.search(df, "alpha", recency_weight=1.0, now="2024-01-31 00:00:00").collect()
    assert search.HALF_LIFE_DAYS == 30.0 and all(1 < r.score / (min(8, r.path[2:3] and int(r.path[2]) + 1)) < 2 for r in old)
