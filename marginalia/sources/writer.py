"""Many notes written by tasks, all or none: ``df.write.format("vault_notes")`` and the same for streams.

Rows are (path, content, rule, expected_sha256). Rules: ``create`` (nothing may be there), ``once`` (nothing or the same may be there) and ``swap``
(what is there must have this SHA-256; nothing counts as empty). Tasks check paths and write contents beside the root, and each leaves a list of what it
has staged; the driver gets the lists' names and counts and reads the lists some entries at a time. The commit compares every target with its rule and, if all hold, notes its decision in
a journal and moves the files into place. If one doesn't hold, nothing is moved. A commit that was interrupted behind its decision is
finished when the batch is written again or by ``recover``; a batch that is done is not written a second time. A batch is named by the option ``batch``;
a stream's batches have their numbers.

Options: ``path`` (the root), ``state`` (a folder outside it on the same file system that all executors share), ``batch``, ``reserved`` (first folders
that are refused, comma-separated). Nulls: a row without path or content is refused, a null rule is ``create``. Two rows of one path are refused unless they are equal.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..functions import markdown as md
from .sink import Refused, check_patch, check_path, serialize, sha256

RULES = ("create", "once", "swap")
PLANNED = "path string, content string, rule string, expected_sha256 string, problem string"
_EMPTY = sha256("")


@dataclass
class Staged(WriterCommitMessage):
    manifest: str
    count: int


def _digest(place: str) -> str | None:
    try:
        with open(place, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except FileNotFoundError:
        return None


class Batch:
    """The staged files of one batch, its lists, and its journal: absent, ``decided`` or ``done``."""

    def __init__(self, root: str, state: str, name: str, reserved: tuple[str, ...] = (), staged_as: str | None = None):
        self.root, self.reserved = os.path.realpath(root), reserved
        state = os.path.realpath(state)
        if state == self.root or state.startswith(self.root + os.sep):
            raise Refused("the state must not be inside the root")
        self.key, staged = (hashlib.sha256(f"{self.root}\0{n}".encode()).hexdigest() for n in (name, staged_as or name))
        self.staging, self.journals = os.path.join(state, "staging", staged), os.path.join(state, "journals")
        self.journal = os.path.join(self.journals, f"{self.key}.json")

    def place(self, path: str) -> str:
        path = check_path(path)
        place = os.path.join(self.root, path)
        parent = os.path.realpath(os.path.dirname(place))
        if os.path.normpath(place) != place or parent != os.path.dirname(place) or os.path.islink(place):
            raise Refused(f"{path} leads elsewhere")
        if path.split("/")[0] in self.reserved:
            raise Refused(f"{path} is reserved")
        return place

    def status(self) -> dict:
        try:
            with open(self.journal, encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"status": None}

    def _note(self, **what) -> None:
        os.makedirs(self.journals, mode=0o700, exist_ok=True)
        temporary = f"{self.journal}.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(what, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, self.journal)

    def stage(self, rows: Iterator) -> Staged:
        if self.status()["status"] == "done":
            return Staged("", sum(1 for _ in rows))
        os.makedirs(os.path.join(self.staging, "claims"), mode=0o700, exist_ok=True)
        manifest, count = os.path.join(self.staging, f"{uuid.uuid4().hex}.jsonl"), 0
        with open(manifest, "w", encoding="utf-8") as out:
            for row in rows:
                path, content, rule = row["path"], row["content"], row["rule"] or "create"
                if path is None or content is None or rule not in RULES:
                    raise Refused(f"a row without path, content or a known rule: {path!r}")
                self.place(path)
                staged = os.path.join(self.staging, uuid.uuid4().hex)
                with open(staged, "x", encoding="utf-8", newline="") as f:
                    f.write(content)
                    f.flush()
                    os.fsync(f.fileno())
                self._claim(path, sha256(content))
                out.write(json.dumps([path, staged, rule, row["expected_sha256"], sha256(content)]) + "\n")
                count += 1
        return Staged(manifest, count)

    def _claim(self, path: str, new: str) -> None:
        """Tasks see each other's paths: one path has one content in a batch."""
        claim = os.path.join(self.staging, "claims", sha256(path))
        temporary = f"{claim}.{uuid.uuid4().hex}"
        with open(temporary, "x", encoding="utf-8") as f:
            f.write(new)
        try:
            os.link(temporary, claim)
        except FileExistsError:
            with open(claim, encoding="utf-8") as f:
                if f.read() != new:
                    raise Refused(f"{path} is in the batch twice, with different contents") from None
        finally:
            os.unlink(temporary)

    @staticmethod
    def _listed(manifests: list[str]) -> Iterator[list]:
        for manifest in manifests:
            with open(manifest, encoding="utf-8") as f:
                yield from map(json.loads, f)

    def _against(self, entry: list) -> str | None:
        """Why an entry must not be written."""
        path, _, rule, expected, new = entry
        now = _digest(self.place(path))
        if rule == "create" and now is not None:
            return f"{path} exists"
        if rule == "once" and now not in (None, new):
            return f"{path} exists with other content"
        if rule == "swap" and (now or _EMPTY) != expected:
            return f"{path} has changed since"
        return None

    def _move(self, entry: list) -> None:
        path, staged, _, _, new = entry
        place = self.place(path)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        if not os.path.exists(staged):  # moved before an interruption
            if _digest(place) != new:
                raise Refused(f"{path} was changed while its batch was being written")
            return
        if os.path.exists(place):
            os.chmod(staged, os.stat(place).st_mode & 0o7777)
        os.replace(staged, place)

    def commit(self, messages: list[Staged | None]) -> bool:
        """True if the batch was written now, False if it was done before."""
        known = self.status()
        if known["status"] == "done":
            shutil.rmtree(self.staging, ignore_errors=True)
            return False
        if known["status"] == "decided":
            self.finish(known["manifests"])
            return False
        manifests = [m.manifest for m in messages if m and m.manifest]
        problems = self._each(self._against, manifests)
        if problems:
            self.abort()
            raise Refused(f"{len(problems)} of the batch's notes must not be written, so none is: {'; '.join(problems[:3])}")
        self._note(status="decided", root=self.root, manifests=manifests)
        self.finish(manifests)
        return True

    def _each(self, action, manifests: list[str]) -> list:
        """What the action says to the entries of all lists, some at a time."""
        with ThreadPoolExecutor(16) as pool:
            return [said for part in batched(self._listed(manifests), 4096) for said in pool.map(action, part) if said]

    def finish(self, manifests: list[str]) -> None:
        self._each(self._move, manifests)
        self._note(status="done", root=self.root, manifests=[])
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self) -> None:
        if self.status()["status"] != "decided":
            shutil.rmtree(self.staging, ignore_errors=True)


def recover(root: str, state: str) -> int:
    """Finishes the batches that were decided but not done; returns how many."""
    base, found = Batch(root, state, ""), 0
    for name in sorted(os.listdir(base.journals)) if os.path.isdir(base.journals) else []:
        one = Batch(root, state, "")
        one.key, one.journal = name.removesuffix(".json"), os.path.join(base.journals, name)
        known = one.status()
        if known["status"] == "decided" and known["root"] == one.root:
            one.staging = os.path.dirname(known["manifests"][0]) if known["manifests"] else one.staging
            one.finish(known["manifests"])
            found += 1
    return found


class _Options:
    def __init__(self, options: dict[str, str]):
        for need in ("path", "state"):
            if not options.get(need):
                raise ValueError(f"option {need} is missing")
        self.root, self.state, self.name = options["path"], options["state"], options.get("batch") or uuid.uuid4().hex
        self.reserved = tuple(filter(None, options.get("reserved", "audit,skills").split(",")))

    def batch(self, number: int | None = None) -> Batch:
        """A stream's tasks don't know the number of their batch; one batch is staged at a time."""
        return Batch(self.root, self.state, self.name if number is None else f"{self.name}/{number}", self.reserved, None if number is None else f"{self.name}/staged")


class NotesWriter(_Options, DataSourceWriter):
    def write(self, iterator) -> Staged:
        return self.batch().stage(iterator)

    def commit(self, messages) -> None:
        self.batch().commit(messages)

    def abort(self, messages) -> None:
        self.batch().abort()


class NotesStreamWriter(_Options, DataSourceStreamWriter):
    """A stream needs the option ``batch``: its name, under which its batches are known after a restart."""

    def write(self, iterator) -> Staged:
        return self.batch(-1).stage(iterator)

    def commit(self, messages, batchId: int) -> None:
        self.batch(batchId).commit(messages)

    def abort(self, messages, batchId: int) -> None:
        self.batch(batchId).abort()


class NotesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault_notes"

    def schema(self) -> str:
        return "path string, content string, rule string, expected_sha256 string"

    def writer(self, schema, overwrite: bool) -> NotesWriter:
        return NotesWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> NotesStreamWriter:
        if not self.options.get("batch"):
            raise ValueError("option batch is missing: the stream's name")
        return NotesStreamWriter(self.options)


def write_notes(rows: DataFrame, root: str, state: str, batch: str, reserved: tuple[str, ...] = ("audit", "skills")) -> None:
    """Writes ``rows`` (path, content, rule, expected_sha256) as one batch; raises, with nothing written, if a rule doesn't hold."""
    rows.sparkSession.dataSource.register(NotesSink)
    named = rows.select("path", "content", "rule", "expected_sha256").write.format("vault_notes").mode("append")
    named.option("path", root).option("state", state).option("batch", batch).option("reserved", ",".join(reserved)).save()


def plan_updates(patches: DataFrame, root: str, now: str) -> DataFrame:
    """Rows for ``write_notes`` from patches (path, patch as JSON text): notes are read, patched and serialised in tasks.

    ``problem`` says why a patch is refused; such a row has no content. Paths must differ.
    """

    def planned(path: str | None, patch: str | None) -> tuple:
        try:
            data = check_patch(json.loads(patch or "{}"))
            with open(Batch(root, os.path.join(os.path.dirname(os.path.realpath(root)), ".none"), "").place(path or ""), encoding="utf-8", newline="") as f:
                old = f.read()
            known, body, error = md.parse_note(old)
            if error:
                raise Refused(error)
            return path, serialize(known | data | {"updated_at": now}, body), "swap", sha256(old), None
        except (OSError, ValueError) as e:
            return path, None, "swap", None, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([planned(*r) for r in frame.itertuples(index=False)], columns=["path", "content", "rule", "expected_sha256", "problem"])

    return patches.select("path", "patch").mapInPandas(run, PLANNED)
