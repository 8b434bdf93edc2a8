import os
import shutil
import time

import pytest

from marginalia.functions.text import compact
from marginalia.operators import graph, search
from marginalia.plans import context, project
from marginalia.sources import sink, vault

pytest.importorskip("yaml")


def note(folder, path, body, **meta):
    place = folder / path
    place.parent.mkdir(parents=True, exist_ok=True)
    head = "".join(f"{k}: {v}\n" for k, v in meta.items())
    place.write_text((f"---\n{head}---\n" if meta else "") + body)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "vault"
    note(root, "projects/chatgpt/research/shared-search.md", "# Shared Search Framework\nretrieval notes\n[plan](../../claude/planning/connector-plan.md)\n", id="chatgpt-research-001", client="chatgpt", project="research", tags="[mcp, search]", updated_at="'2026-01-02T00:00:00Z'")
    note(root, "projects/claude/planning/connector-plan.md", "# Claude Connector Plan\n[[Shared Search Framework]] [[shared-search]]\n", client="claude", project="planning", tags="[mcp]", updated_at="'2026-01-01T00:00:00Z'")
    note(root, "_x.md", "hidden by name only [[gone]]")
    note(root, ".hidden/y.md", "in a hidden folder", updated_at="2026-05-01")
    note(root, "node_modules/z.md", "never")
    note(root, "broken.md", "---\n: [\n---\nwhole text")
    (root / "w.MD").write_text("other case")
    os.symlink(root / "projects", root / "again")
    os.symlink(root / "nowhere.md", root / "dangling.md")
    return root


def test_scan(spark, tree):
    rows = {r.path: r for r in vault.read_vault(spark, str(tree)).collect()}
    assert set(rows) == {"_x.md", ".hidden/y.md", "broken.md"} | {p for p in rows if "shared-search" in p or "connector-plan" in p}
    assert len(rows) == 5
    assert rows["broken.md"].parse_error and rows["broken.md"].body.startswith("---")
    assert rows[".hidden/y.md"].updated_at is None and rows["_x.md"].id == "_x.md" and rows["_x.md"].title == "_x"
    assert [r.path for r in vault.read_vault(spark, str(tree), path_prefix=".hid").collect()] == [".hidden/y.md"]
    os.symlink("/etc", tree / "out")
    with pytest.raises(Exception, match="leaves the root"):
        vault.read_vault(spark, str(tree)).collect()


def test_search_graph_and_roots(spark, tree, tmp_path):
    os.unlink(tree / "again")
    ops = tmp_path / "ops"
    note(ops, "logs/session.md", "[[vault:projects/claude/planning/connector-plan]] and ops words", target_repo="planning")
    notes = vault.read_vault(spark, roots={"vault": str(tree), "ops": str(ops)}).cache()
    found = search.search(notes, "retrieval", client="chatgpt", plain=False).collect()
    assert [r.id for r in found] == ["chatgpt-research-001"] and "retrieval" in found[0].snippet
    assert {(r.client, r.project, r.document_count) for r in search.list_projects(notes).collect()} == {("chatgpt", "research", 1), ("claude", "planning", 1), ("unknown", "uncategorized", 4)}
    plan, shared = "vault:projects/claude/planning/connector-plan.md", "vault:projects/chatgpt/research/shared-search.md"
    links = graph.resolved_links(notes)
    by = {(r.src, r.raw): r for r in links.collect()}
    assert by[plan, "shared-search"].target == shared
    assert by[plan, "Shared Search Framework"].target is None and [(c.path, c.via) for c in by[plan, "Shared Search Framework"].candidates] == [(shared, "title")]
    assert by[shared, "../../claude/planning/connector-plan.md"].target == plan
    assert by["ops:logs/session.md", "vault:projects/claude/planning/connector-plan"].target == plan
    assert {r.source for r in graph.backlinks(graph.edges(links)).where(f"path = '{plan}'").collect()} == {shared, "ops:logs/session.md"}
    assert [r.path for r in project.ops_recent(notes, "planning").collect()] == ["ops:logs/session.md"]
    assert search.lookup(notes, "chatgpt-research-001").first().path == shared
    with pytest.raises(LookupError):
        search.lookup(notes, "nothing")
    package = context.context(notes, "retrieval", plain=False).collect()
    kinds = {r.path: (r.kind, r.relationship) for r in package if r.path}
    assert kinds[shared] == ("chunk", "seed") and kinds[plan] == ("chunk", "linked:out")
    assert package[-1].kind == "summary" and package[-1].tokens <= context.BUDGET
    traced = graph.trace(notes, plan, depth=2)
    assert {r.path for r in traced["related"].collect()} == {shared, "ops:logs/session.md"}
    notes.unpersist()


def test_roots_option():
    assert vault.parse_roots("a=/x, b=/y") == {"a": "/x", "b": "/y"}
    for bad in ("", "a", "a=/x,a=/y", "../a=/x"):
        with pytest.raises(ValueError):
            vault.parse_roots(bad)


def test_sink(tree, tmp_path):
    out = sink.VaultSink(str(tree), str(tmp_path / "state"))
    path = out.create_note("Acme Co", "Über", "My Note!", "body  \n\n", tags=["a"])
    assert path == "projects/acme-co/über/my-note.md" and (tree / path).read_text().endswith("body\n")
    with pytest.raises(sink.Refused):
        out.create_note("Acme Co", "Über", "My Note!", "other")
    plan = out.plan_update(path, {"title": "New"}, reason="why")
    assert "+title: New" in plan["diff"]
    assert out.apply_update(plan["patch_id"]) == path and "title: New" in (tree / path).read_text()
    with pytest.raises(sink.Refused):
        out.apply_update(plan["patch_id"])
    stale = out.plan_update(path, {"title": "Later"})
    (tree / path).write_text("changed meanwhile")
    with pytest.raises(sink.Refused, match="changed since"):
        out.apply_update(stale["patch_id"])
    create = out.plan_create("a", "b", "c", "text")
    with pytest.raises(sink.Refused):
        out.apply_create(create["patch_id"], "projects/a/b/d.md")
    assert out.apply_create(create["patch_id"], "projects/a/b/c.md") == "projects/a/b/c.md"
    for bad in ("../x.md", "/x.md", "a/%2e%2e/b.md", "~x", "a\x01", "x" * 501, "audit/x.md", "again/chatgpt/x.md"):
        with pytest.raises(sink.Refused):
            out.plan_update(bad, {})
    for bad in ({"id": "x"}, {"updated_at": "x"}, {"type": "x"}, {"tags": "x"}, {"title": 3}):
        with pytest.raises(sink.Refused):
            sink.check_patch(bad)
    assert out.append_report("r.md", "one") and not out.append_report("r.md", "one")
    with pytest.raises(sink.Refused):
        out.append_report("r.md", "two")
    state = out.compare_and_swap("s.json", sink.sha256(""), "1")
    with pytest.raises(sink.Refused):
        out.compare_and_swap("s.json", sink.sha256(""), "2")
    assert out.compare_and_swap("s.json", state, "2") == sink.sha256("2")
    assert out.prune_plans(time.time()) == 0 and out.prune_plans(time.time() + 8 * 86400) == 1
    with pytest.raises(sink.Refused):
        sink.VaultSink(str(tree), str(tree / "state"))


def test_query_side(spark):
    assert [t.text for t in search.tokenize("Foo  foo BAR")] == ["foo", "bar"]
    pieces = search.tokenize("検索エンジン設計", spark)
    assert pieces[0].text == "検索エンジン設計" and pieces[0].whole and {"検索", "設計"} <= {t.text for t in pieces[1:]}
    assert search.prefix_of("./a/b") == "a/b" and search.clamp_weight(float("nan")) == 0 and search.clamp_weight(7) == 1
    with pytest.raises(ValueError):
        search.parse_date("soon", "updated_after")
    assert compact(" a　\n b﻿") == "a b"
    for bad in (499, 32001, 1.5, True):
        with pytest.raises(ValueError):
            context.check_budget(bad)


def test_transient_errors_are_tried_again():
    calls = []

    def flaky(errno_, fails):
        def action():
            calls.append(errno_)
            if len(calls) <= fails:
                raise OSError(errno_, "busy")
            return "done"

        return action

    import errno

    assert vault.retried(flaky(errno.EAGAIN, 3), pause=0) == "done" and len(calls) == 4
    calls.clear()
    with pytest.raises(OSError):
        vault.retried(flaky(errno.EMFILE, 9), pause=0)
    assert len(calls) == 4
    calls.clear()
    with pytest.raises(OSError):
        vault.retried(flaky(errno.ENOENT, 1), pause=0)
    assert len(calls) == 1


def test_a_note_that_cannot_be_opened_is_left_out(tree, capsys):
    assert vault.read_note(None, str(tree), "gone.md") is None and "left out gone.md" in capsys.readouterr().err


def test_walk_in_rounds_over_uneven_folders(spark, tmp_path):
    root, want = tmp_path / "wide", set()

    def touch(path):
        place = root / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text("x")
        want.add(path)

    for k in range(1500):
        touch(f"flat/{k}.md")
    for k in range(60):
        touch(f"{'deep/' * k}n{k}.md")
    for k in range(400):
        touch(f"many/{k % 130}/{k}.md")
    (root / "node_modules/pkg").mkdir(parents=True)
    (root / "node_modules/pkg/inner.md").write_text("x")
    os.symlink(root / "node_modules/pkg", root / "linked")
    os.symlink(root / "node_modules/pkg", root / "many/0/linked")
    os.symlink(root, root / "node_modules/pkg/loop")
    os.symlink(root / "node_modules/pkg", root / "node_modules/pkg/itself")
    os.symlink(root / "flat/1.md", root / "deep/alias.md")
    os.symlink(root / "node_modules/pkg/inner.md", root / "deep/inner.md")
    want.add("node_modules/pkg/inner.md")
    (root / "flat/no.txt").write_text("x")
    found = vault.walked(spark, {"a": str(root), "b": str(root / "flat")}, most=50).collect()
    assert len(found) == len(set(found)) and {r["at"] for r in found if r.root == "a"} == want
    assert {r["at"] for r in found if r.root == "b"} == {w.removeprefix("flat/") for w in want if w.startswith("flat/")}
    assert {r["at"] for r in vault.walked(spark, {None: str(root)}, "many/1", most=20).collect()} == {w for w in want if w.startswith("many/1")}
    rows = vault.read_vault(spark, str(root), notes_per_task=100)
    assert {r.path for r in rows.select("path").collect()} == want and rows.rdd.getNumPartitions() == len(want) // 100 + 1
    vault.register(spark)
    one_pass = spark.read.format("vault").option("path", str(root)).load()
    assert {r.path for r in one_pass.select("path").collect()} == want
    assert {r.local_path for r in one_pass.where("startswith(local_path, 'many/12')").collect()} == {w for w in want if w.startswith("many/12")}


def test_parts_of_a_tree_hold_each_folder_once(tree):
    for most in (1, 2, 3, 100):
        found = [f for p in vault.parts({None: str(tree)}, "", most) for f in p.folders]
        notes = [e.at for _, top, at, below in found for e in (vault.walk(top, at) if below else vault.listed(top, at)) if not e.is_folder]
        assert len(notes) == len(set(notes)) == 5


def test_stream_reads_what_has_changed(spark, tmp_path):
    root, state, out = tmp_path / "vault", str(tmp_path / "state"), str(tmp_path / "out")
    for k in range(30):
        note(root, f"f{k % 5}/deep/{k}.md", f"body {k}\n", title=f"t{k}")

    def pull():
        """Starts the stream anew; it goes on from its checkpoint."""
        query = vault.read_vault_stream(spark, state, str(root)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        every = spark.read.parquet(out)
        last = every.agg({"version": "max"}).first()[0]
        return {(r.path, r.change) for r in every.where(f"version = {last}").collect()}, {r.path: r.body for r in vault.latest(every).collect()}

    changed, now = pull()
    assert changed == {(f"f{k % 5}/deep/{k}.md", "upsert") for k in range(30)} and now["f0/deep/0.md"] == "body 0\n"
    note(root, "f0/deep/0.md", "changed\n")
    note(root, "new/31.md", "new\n")
    os.unlink(root / "f1/deep/1.md")
    changed, now = pull()
    assert changed == {("f0/deep/0.md", "upsert"), ("new/31.md", "upsert"), ("f1/deep/1.md", "delete")}
    shutil.rmtree(root / "f2")
    os.rename(root / "f3", root / "f9")
    changed, now = pull()
    assert {p for p, c in changed if c == "delete"} == {f"f{k % 5}/deep/{k}.md" for k in range(30) if k % 5 in (2, 3)}
    assert {p for p, c in changed if c == "upsert"} == {f"f9/deep/{k}.md" for k in range(30) if k % 5 == 3}
    note(root, "f2/deep/2.md", "back\n")
    changed, now = pull()
    assert changed == {("f2/deep/2.md", "upsert")}
    assert now == {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n)).read().split("---\n")[-1] for d, _, names in os.walk(root) for n in names}
    with pytest.raises(Exception, match="inside a root"):
        vault.VaultStreamReader({"path": str(root), "state": str(root / "state")})


def test_a_batch_that_is_run_again_reads_the_same(tmp_path):
    root = tmp_path / "vault"
    note(root, "a/1.md", "one")
    note(root, "b.md", "two")
    reader = vault.VaultStreamReader({"path": str(root), "state": str(tmp_path / "state")})

    def run(start, end):
        return sorted((r["path"], r["change"]) for p in reader.partitions({"version": start}, {"version": end}) for b in reader.read(p) for r in b.to_pylist())

    first = run(0, 5)
    assert first == run(0, 5) == [("a/1.md", "upsert"), ("b.md", "upsert")] and run(5, 6) == []
    note(root, "a/1.md", "one more")
    os.unlink(root / "b.md")
    assert run(6, 7) == run(6, 7) == [("a/1.md", "upsert"), ("b.md", "delete")] and run(7, 8) == []
