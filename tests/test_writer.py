"""Batches of notes: all or none, once, and after interruptions."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from marginalia.sources import writer
from marginalia.sources.sink import Refused, sha256

COLUMNS = "path string, content string, rule string, expected_sha256 string"


@pytest.fixture
def places(tmp_path):
    (tmp_path / "root").mkdir()
    return str(tmp_path / "root"), str(tmp_path / "state")


def files(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n)).read() for d, _, names in os.walk(root) for n in names}


def test_a_batch_is_written_once_and_as_a_whole(spark, places):
    root, state = places
    rows = [(f"a/{k % 7}/{k}.md", f"text {k}\n", None, None) for k in range(200)]
    frame = spark.createDataFrame(rows + rows[:3], COLUMNS).repartition(5)
    writer.write_notes(frame, root, state, "one")
    want = {p: c for p, c, _, _ in rows}
    assert files(root) == want
    with open(os.path.join(root, "a/0/0.md"), "w") as f:
        f.write("edited later")
    writer.write_notes(frame, root, state, "one")  # done before: nothing happens
    assert files(root) == want | {"a/0/0.md": "edited later"}
    mixed = [("b.md", "new", "create", None), ("a/1/1.md", "swapped", "swap", sha256("text 1\n")), ("a/0/0.md", "lost", "swap", sha256("text 0\n"))]
    with pytest.raises(Exception, match="has changed since"):
        writer.write_notes(spark.createDataFrame(mixed, COLUMNS), root, state, "two")
    assert files(root) == want | {"a/0/0.md": "edited later"} and not os.listdir(os.path.join(state, "staging"))
    writer.write_notes(spark.createDataFrame(mixed[:2] + [("c.md", "", "swap", sha256("")), ("a/2/2.md", "text 2\n", "once", None)], COLUMNS), root, state, "two")
    assert files(root) == want | {"a/0/0.md": "edited later", "b.md": "new", "a/1/1.md": "swapped", "c.md": ""}


@pytest.mark.parametrize(
    "bad", [("../x.md", "x", None, None), ("/x.md", "x", None, None), ("audit/x.md", "x", None, None), ("link/x.md", "x", None, None), (None, "x", None, None), ("x.md", None, None, None), ("x.md", "x", "other", None), ("there.md", "x", "create", None), ("there.md", "x", "once", None), ("good.md", "other", None, None)]
)
def test_one_bad_row_stops_all(spark, places, bad):
    root, state = places
    os.symlink("/tmp", os.path.join(root, "link"))
    with open(os.path.join(root, "there.md"), "w") as f:
        f.write("there")
    with pytest.raises(Exception):
        writer.write_notes(spark.createDataFrame([("good.md", "good", None, None), bad], COLUMNS).repartition(2), root, state, "bad")
    assert os.listdir(root).count("good.md") == 0 and open(os.path.join(root, "there.md")).read() == "there"


def test_an_interrupted_commit_is_finished(places):
    root, state = places
    rows = [{"path": f"{k}.md", "content": f"c{k}", "rule": "create", "expected_sha256": None} for k in range(20)]
    batch = writer.Batch(root, state, "x")
    staged = batch.stage(iter(rows))

    class Lost(Exception):
        pass

    moved = []

    def failing(entry):
        if len(moved) == 7:
            raise Lost
        moved.append(entry)
        writer.Batch._move(batch, entry)

    batch._move = failing
    with pytest.raises(Lost):
        batch.commit([staged])
    assert 0 < len(files(root)) < 20 and batch.status()["status"] == "decided"
    assert writer.recover(root, state) == 1 and files(root) == {r["path"]: r["content"] for r in rows}
    assert writer.recover(root, state) == 0 and writer.Batch(root, state, "x").commit([staged]) is False
    again = writer.Batch(root, state, "y")
    second = again.stage(iter([{"path": "z.md", "content": "z", "rule": "once", "expected_sha256": None}]))
    again._note(status="decided", root=again.root, manifests=[second.manifest])
    os.replace(json.loads(open(second.manifest).readline())[1], os.path.join(root, "z.md"))  # moved, then lost
    assert writer.Batch(root, state, "y").commit([]) is False and files(root)["z.md"] == "z"
    assert writer.Batch(root, state, "y").status()["status"] == "done"
    with pytest.raises(Refused):
        writer.Batch(root, os.path.join(root, "state"), "x")


def test_stream_batches_are_written_once(spark, places, tmp_path):
    root, state = places
    source, checkpoint = tmp_path / "in", str(tmp_path / "cp")
    source.mkdir()
    spark.dataSource.register(writer.NotesSink)

    def run(restart):
        rows = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).json(str(source))
        query = rows.writeStream.format("vault_notes").option("path", root).option("state", state).option("batch", "s").option("checkpointLocation", restart).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    for k in range(3):
        (source / f"{k}.json").write_text(json.dumps({"path": f"{k}.md", "content": f"c{k}", "rule": "create"}))
    run(checkpoint)
    assert files(root) == {f"{k}.md": f"c{k}" for k in range(3)}
    (source / "3.json").write_text(json.dumps({"path": "3.md", "content": "c3", "rule": "create"}))
    run(checkpoint)
    assert files(root) == {f"{k}.md": f"c{k}" for k in range(4)}
    os.unlink(os.path.join(checkpoint, "commits", ".3.crc"))
    os.unlink(os.path.join(checkpoint, "commits", "3"))  # as if lost behind the writer's commit: Spark runs the batch again
    run(checkpoint)
    assert files(root) == {f"{k}.md": f"c{k}" for k in range(4)}


def test_updates_are_planned_in_tasks(spark, places):
    pytest.importorskip("yaml")
    root, state = places
    for k in range(6):
        with open(os.path.join(root, f"{k}.md"), "w") as f:
            f.write(f"---\ntitle: t{k}\n---\nbody {k}\n")
    patches = [(f"{k}.md", json.dumps({"title": f"new {k}"})) for k in range(5)] + [("5.md", '{"id": "x"}'), ("none.md", "{}"), ("../x.md", "{}"), (None, "{}")]
    planned = writer.plan_updates(spark.createDataFrame(patches, "path string, patch string").repartition(3), root, "2024-01-01T00:00:00Z").cache()
    refused = {r.path for r in planned.where("problem is not null").collect()}
    assert refused == {"5.md", "none.md", "../x.md", None}
    writer.write_notes(planned.where(F.col("problem").isNull()), root, state, "u")
    for k in range(5):
        text = open(os.path.join(root, f"{k}.md")).read()
        assert f"title: new {k}" in text and text.endswith(f"body {k}\n")
    with pytest.raises(Exception, match="has changed since"):
        writer.write_notes(planned.where(F.col("problem").isNull()), root, state, "v")
    assert hashlib.sha256(open(os.path.join(root, "5.md"), "rb").read()).hexdigest() == sha256("---\ntitle: t5\n---\nbody 5\n")
    planned.unpersist()
