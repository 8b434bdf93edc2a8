"""Directory trees of Markdown notes as tables and streams.

``read_vault`` walks in tasks: each takes some folders and lists until it has seen enough entries, folders that are left go
round again, and the notes that were found are dealt evenly to the tasks that read them. So neither the driver nor a
task holds a list of all files, however uneven the folders are. ``spark.read.format("vault")`` does the same in one pass, with a part of
the tree for each task, and ``read_vault_stream`` reads what has changed since the last batch.

Options: ``path`` (one tree) or ``roots`` (``name=/path,name=/path``), ``pathPrefix`` (walk only what can match), and ``state`` (streams).
The trees must be readable at the same paths on all executors. Files and folders whose names begin with a dot or an
underscore count; ``.git``, ``node_modules`` and ``.mcp-state`` do not. A note's path is its real one inside the root, so links inside a
root lead to notes that are found anyway, or to ones in folders that are left out, which then count (``read_vault`` lists those once,
the other two once for each link). A link that leaves the root ends the scan. A file that cannot be read is left out, a note whose
front matter is refused keeps its whole text as body and says so in ``parse_error``.
"""

from __future__ import annotations

import datetime
import errno
import hashlib
import json
import os
import random
import re
import sys
import time
import unicodedata
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, StringStartsWith
from pyspark.sql.window import Window

from ..functions import markdown as md
from ..functions.text import compact, fold
from ..operators.tables import snapshot

# Fixed values.
SKIPPED = frozenset((".git", "node_modules", ".mcp-state"))
ROOT_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$")
TRANSIENT = frozenset((errno.EAGAIN, errno.EMFILE, errno.ENFILE))

SCHEMA = (
    "id string, path string, local_path string, root string, title string, client string, project string, tags array<string>, source_refs array<string>, "
    "aliases array<string>, updated_at string, date string, fm_type string, target_repo string, frontmatter string, body string, folded_body string, "
    "compact_body string, wiki_links array<string>, md_links array<string>, size_bytes long, modified_at timestamp, effective_ts timestamp, parse_error string"
)
_TIMES, _LISTS = ("modified_at", "effective_ts"), ("tags", "source_refs", "aliases", "wiki_links", "md_links")
ARROW = pa.schema(
    [(n, pa.timestamp("us", "UTC") if n in _TIMES else pa.list_(pa.string()) if n in _LISTS else pa.int64() if n == "size_bytes" else pa.string()) for n in (c.split()[0] for c in SCHEMA.split(", "))]
)


def parse_roots(text: str) -> dict[str, str]:
    """``name=/path`` pairs; names are plain and differ."""
    roots: dict[str, str] = {}
    for pair in filter(None, (p.strip() for p in text.split(","))):
        name, sign, path = pair.partition("=")
        if not sign or not path or not ROOT_NAME.match(name.strip()):
            raise ValueError(f"a root is name=/path, not {pair!r}")
        if name.strip() in roots:
            raise ValueError(f"root {name.strip()} is given twice")
        roots[name.strip()] = path.strip()
    if not roots:
        raise ValueError("no root is given")
    return roots


def retried(action, tries: int = 4, pause: float = 0.1):
    """The action's result; what passes by itself is tried again with growing pauses."""
    for k in range(tries):
        try:
            return action()
        except OSError as e:
            if e.errno not in TRANSIENT or k == tries - 1:
                raise
            time.sleep(pause * 2**k * (1 + random.random()))


class EscapingLink(OSError):
    pass


@dataclass(frozen=True)
class Entry:
    """A note or a folder of a tree; ``at`` is its path inside the root as it is on disk, folders with a slash at the end."""

    at: str
    is_folder: bool
    linked: bool = False

    @property
    def local_path(self) -> str:
        return unicodedata.normalize("NFC", self.at)

    def fits(self, prefix: str) -> bool:
        path = self.local_path
        return path.startswith(prefix) or self.is_folder and prefix.startswith(path)


def entries(top: str, at: str, prefix: str = "") -> Iterator[Entry]:
    """Notes and folders directly in a folder of the tree whose real path is ``top``; raises if the folder cannot be listed."""
    inside = top.rstrip(os.sep) + os.sep
    if not at and not os.path.isdir(top):
        raise FileNotFoundError(errno.ENOENT, "no such root", top)
    with retried(lambda: os.scandir(inside + at)) as found:
        for entry in found:
            if entry.name in SKIPPED:
                continue
            try:
                linked = entry.is_symlink()
                if linked:
                    real = os.path.realpath(entry.path, strict=True)
                    if real == top:
                        continue
                    if not real.startswith(inside):
                        raise EscapingLink(errno.EPERM, "a link leaves the root", f"{at}{entry.name}")
                    name, is_folder = real.removeprefix(inside), os.path.isdir(real)
                    if SKIPPED.isdisjoint(name.split(os.sep)) and (is_folder or name.endswith(".md")):
                        continue  # the walk comes there without the link
                else:
                    name, is_folder = f"{at}{entry.name}", entry.is_dir()
                is_note = entry.name.endswith(".md") and os.path.isfile(inside + name)
            except EscapingLink:
                raise
            except OSError:
                continue  # a link to nothing
            one = Entry(f"{name}/" if is_folder else name, is_folder, linked)
            if (is_folder or is_note) and one.fits(prefix):
                yield one


def listed(top: str, at: str, prefix: str = "") -> Iterator[Entry]:
    """The same, but a folder below the root that cannot be listed is left out."""
    try:
        yield from entries(top, at, prefix)
    except EscapingLink:
        raise
    except OSError as e:
        if not at:
            raise
        print(f"left out folder {at}: {e.strerror}", file=sys.stderr)


def walk(top: str, at: str = "", prefix: str = "") -> Iterator[Entry]:
    """The notes below a folder."""
    waiting, linked = [at], set()
    while waiting:
        folder = waiting.pop()
        for entry in listed(top, folder, prefix):
            if not entry.is_folder:
                yield entry
            elif not entry.linked:
                waiting.append(entry.at)
            elif entry.at not in linked:
                linked.add(entry.at)
                waiting.append(entry.at)


#: Entries after which a task of the walk passes the folders that are left to the next round, and notes of a task that reads.
ENTRIES, NOTES = 20_000, 500


def walked(spark: SparkSession, roots: dict[str | None, str], prefix: str = "", most: int = ENTRIES, tasks: int | None = None) -> DataFrame:
    """(root, top, at) of each note of the trees, once."""
    tasks = tasks or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = 0, []

        def passed() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["kind", "root", "top", "at"])

        for frame in frames:
            for root, top, start in frame.itertuples(index=False):
                waiting = [start]
                while waiting:
                    folder = waiting.pop()
                    if seen >= most:
                        rows.append(("folder", root, top, folder))
                        continue
                    for entry in listed(top, folder, prefix):
                        seen += 1
                        if not entry.is_folder:
                            rows.append(("note", root, top, entry.at))
                        elif not entry.linked:
                            waiting.append(entry.at)
                        else:
                            rows.append(("link", root, top, entry.at))
                        if len(rows) >= 10_000:
                            yield passed()
                            rows = []
        yield passed()

    tops = [(name, os.path.realpath(top), "") for name, top in roots.items()]
    waiting, found, linked = spark.createDataFrame(tops, "root string, top string, at string"), [], None
    while True:
        step = snapshot(waiting.repartition(tasks).mapInPandas(run, "kind string, root string, top string, at string"))
        found.append(step.where("kind = 'note'").drop("kind"))
        links = step.where("kind = 'link'").drop("kind").distinct()
        if linked is not None:  # a linked folder is walked once
            links = links.join(linked, ["top", "at"], "left_anti").select("root", "top", "at")
        waiting = snapshot(step.where("kind = 'folder'").drop("kind").unionByName(links))
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, found).dropDuplicates(["top", "at"])
        links = waiting.select("top", "at")
        linked = links if linked is None else linked.unionByName(links)


def effective(data: dict, modified: datetime.datetime) -> datetime.datetime:
    """updated_at, else date, if they are ISO texts; else the time of the file."""
    for key in ("updated_at", "date"):
        if isinstance(value := data.get(key), str):
            try:
                found = datetime.datetime.fromisoformat(value.strip())
            except ValueError:
                continue
            return found if found.tzinfo else found.replace(tzinfo=datetime.timezone.utc)
    return modified


def read_note(root: str | None, top: str, at: str) -> dict | None:
    """The row of a note; None if it cannot be read."""
    relative, place = unicodedata.normalize("NFC", at), os.path.join(top, at)
    try:
        with retried(lambda: open(place, "rb")) as f:
            raw, stat = f.read(), os.fstat(f.fileno())
    except OSError as e:
        print(f"left out {relative}: {e.strerror}", file=sys.stderr)
        return None
    data, body, error = md.parse_note(raw.decode("utf-8", "replace"))
    path = f"{root}:{relative}" if root else relative
    text = lambda k: v if isinstance(v := data.get(k), str) else None
    modified = datetime.datetime.fromtimestamp(stat.st_mtime, datetime.timezone.utc)
    return {
        "id": (text("id") or "").strip() or path, "path": path, "local_path": relative, "root": root, "title": md.note_title(data, body, relative),
        "client": data.get("client"), "project": data.get("project"), "tags": data.get("tags", []), "source_refs": data.get("source_refs", []), "aliases": md.aliases(data),
        "updated_at": text("updated_at"), "date": text("date"), "fm_type": text("type"), "target_repo": text("target_repo"), "frontmatter": md.metadata_json(data),
        "body": body, "folded_body": fold(body), "compact_body": compact(body), "wiki_links": md.wiki_links(body), "md_links": md.markdown_links(body),
        "size_bytes": stat.st_size, "modified_at": modified, "effective_ts": effective(data, modified), "parse_error": error, "mtime_ns": stat.st_mtime_ns,
    }


def row_batches(rows: Iterator[dict | None], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held += [row] if row else []
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


@dataclass
class Folders(InputPartition):
    """Folders (root, top, at, whether what is below counts) that one task reads."""

    folders: list[tuple[str | None, str, str, bool]]


#: Parts into which a tree is cut, about.
PARTS = 256


def parts(roots: dict[str | None, str], prefix: str, most: int = PARTS) -> list[InputPartition]:
    """Folders are opened from the root down until there are enough of them; then each is a part with all below it. Lists no notes."""
    waiting = deque((name, os.path.realpath(top), "") for name, top in roots.items())
    found = []
    while waiting and len(waiting) + len(found) < most:
        name, top, at = waiting.popleft()
        found.append((name, top, at, False))
        waiting.extend((name, top, e.at) for e in listed(top, at, prefix) if e.is_folder and not e.linked)
    found += [(*w, True) for w in waiting]
    return [Folders(found[k::most]) for k in range(min(most, len(found)))] or [Folders([])]


class VaultReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if options.get("roots"):
            self.roots: dict[str | None, str] = dict(parse_roots(options["roots"]))
        elif options.get("path"):
            self.roots = {None: options["path"]}
        else:
            raise ValueError("option path or roots is missing")
        self.prefix = unicodedata.normalize("NFC", options.get("pathPrefix", "")).removeprefix("./")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Prefixes of local paths and names of roots prune the walk; Spark still checks all rows."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("local_path",) and f.value.startswith(self.prefix):
                self.prefix = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("root",):
                self.roots = {k: v for k, v in self.roots.items() if k == f.value}
            yield f

    def partitions(self) -> list[InputPartition]:
        return parts(self.roots, self.prefix)

    def _notes(self, partition: Folders) -> Iterator[dict | None]:
        for name, top, at, below in partition.folders:
            for entry in walk(top, at, self.prefix) if below else listed(top, at, self.prefix):
                if not entry.is_folder:
                    yield read_note(name, top, entry.at)
                elif entry.linked and not below:  # a linked folder, which is no part of its own
                    yield from (read_note(name, top, e.at) for e in walk(top, entry.at, self.prefix))

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return row_batches(self._notes(partition), ARROW)


CHANGES = SCHEMA + ", change string, version long"
_CHANGES = ARROW.append(pa.field("change", pa.string())).append(pa.field("version", pa.int64()))


class Signatures:
    """What a stream knows of the notes directly in a folder, by version: {notes: {at: [time, size]}, folders: [at]}.

    A version holds until the next one that was written. A batch compares with the last version up to its start and writes its end's, so a
    batch that is run again reads the same notes again; older versions than it needs are deleted.
    """

    def __init__(self, state: str, top: str, at: str):
        key = hashlib.sha256(f"{top}\0{at}".encode()).hexdigest()
        self.folder = os.path.join(state, key[:2], key[2:])

    def versions(self) -> list[int]:
        try:
            return sorted(int(n.removesuffix(".json")) for n in os.listdir(self.folder) if n.endswith(".json"))
        except FileNotFoundError:
            return []

    def at(self, version: int) -> dict:
        known = [v for v in self.versions() if v <= version]
        if not known:
            return {"notes": {}, "folders": []}
        with open(os.path.join(self.folder, f"{known[-1]}.json"), encoding="utf-8") as f:
            return json.load(f)

    def put(self, start: int, end: int, found: dict) -> None:
        os.makedirs(self.folder, exist_ok=True)
        temporary = os.path.join(self.folder, f".{end}-{os.getpid()}-{random.random()}")
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(found, f)
        os.replace(temporary, os.path.join(self.folder, f"{end}.json"))
        for old in [v for v in self.versions() if v <= start][:-1]:
            try:
                os.unlink(os.path.join(self.folder, f"{old}.json"))
            except FileNotFoundError:
                pass  # another attempt of this task was faster


class VaultStreamReader(DataSourceStreamReader):
    """Offsets are points in time; what was known at one is in ``state``, a file for each folder that changed."""

    def __init__(self, options: dict[str, str]):
        plain = VaultReader(options)
        self.roots, self.prefix = plain.roots, plain.prefix
        if not options.get("state"):
            raise ValueError("option state is missing: a folder that all executors share")
        self.state, self.last = os.path.realpath(options["state"]), 0
        for top in map(os.path.realpath, self.roots.values()):
            if self.state == top or self.state.startswith(top.rstrip(os.sep) + os.sep):
                raise ValueError("the state must not be inside a root")

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        self.last = max(self.last + 1, time.time_ns() // 1000)
        return {"version": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(self.last, end["version"])
        found = parts(self.roots, self.prefix)
        for part in found:
            part.span = (start["version"], end["version"])
        return found

    def commit(self, end: dict) -> None:
        """Nothing: tasks delete what no batch can need."""

    def _gone(self, name: str | None, at: str, end: int) -> dict:
        relative = unicodedata.normalize("NFC", at)
        path = f"{name}:{relative}" if name else relative
        return {"id": path, "path": path, "local_path": relative, "root": name, "change": "delete", "version": end}

    def _removed(self, name: str | None, top: str, at: str, start: int, end: int) -> Iterator[dict]:
        """All notes that were known below a folder that is no more."""
        known = Signatures(self.state, top, at)
        before = known.at(start)
        yield from (self._gone(name, note, end) for note in before["notes"])
        for folder in before["folders"]:
            yield from self._removed(name, top, folder, start, end)
        if before["notes"] or before["folders"]:
            known.put(start, end, {"notes": {}, "folders": []})

    def _folder(self, name: str | None, top: str, at: str, start: int, end: int) -> Iterator[dict | Entry]:
        """Rows of what has changed directly in a folder, and the folders in it."""
        known = Signatures(self.state, top, at)
        before, now = known.at(start), {"notes": {}, "folders": []}
        try:
            found = sorted(entries(top, at, self.prefix), key=lambda e: e.at)
        except EscapingLink:
            raise
        except OSError as e:
            if not at:
                raise
            print(f"left out folder {at}: {e.strerror}", file=sys.stderr)
            return  # what is known of it stays
        for entry in found:
            if entry.is_folder:
                now["folders"] += [] if entry.linked else [entry.at]
                yield entry
                continue
            place, old = os.path.join(top, entry.at), before["notes"].get(entry.at)
            try:
                stat = retried(lambda: os.stat(place))
            except OSError:
                stat = None
            if stat and [stat.st_mtime_ns, stat.st_size] == old:
                now["notes"][entry.at] = old
                continue
            row = read_note(name, top, entry.at)
            if row is None:  # tried again with the next batch
                now["notes"] |= {entry.at: [-1, -1]} if old else {}
            else:
                now["notes"][entry.at] = [row.pop("mtime_ns"), row["size_bytes"]]
                yield row | {"change": "upsert", "version": end}
        yield from (self._gone(name, note, end) for note in before["notes"] if note not in now["notes"])
        for folder in before["folders"]:
            if folder not in now["folders"]:
                yield from self._removed(name, top, folder, start, end)
        if now != before:
            known.put(start, end, now)

    def _rows(self, partition: Folders) -> Iterator[dict]:
        start, end = partition.span
        for name, top, first, below in partition.folders:
            waiting, seen = [first], {first}
            while waiting:
                at = waiting.pop()
                for found in self._folder(name, top, at, start, end):
                    if isinstance(found, dict):
                        yield found
                    elif (below or found.linked or at != first) and found.at not in seen:
                        seen.add(found.at)
                        waiting.append(found.at)

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return row_batches(self._rows(partition), _CHANGES)


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return CHANGES if self.options.get("state") else SCHEMA

    def reader(self, schema) -> VaultReader:
        return VaultReader(self.options)

    def streamReader(self, schema) -> VaultStreamReader:
        return VaultStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VaultSource)


def read_vault(
    spark: SparkSession, path: str | None = None, roots: dict[str, str] | None = None, path_prefix: str = "", notes_per_task: int = NOTES
) -> DataFrame:
    """Notes of one tree or of named ones."""
    options = VaultReader({"path": path, "roots": ",".join(f"{k}={v}" for k, v in roots.items()) if roots else "", "pathPrefix": path_prefix})
    found = snapshot(walked(spark, options.roots, options.prefix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict | None]:
            for batch in batches:
                yield from (read_note(*n.values()) for n in batch.to_pylist())

        return row_batches(rows(), ARROW)

    dealt = found.repartition(max(1, -(-found.count() // notes_per_task)), "top", "at")
    return dealt.select("root", "top", "at").mapInArrow(run, SCHEMA)


def read_vault_stream(spark: SparkSession, state: str, path: str | None = None, roots: dict[str, str] | None = None, path_prefix: str = "") -> DataFrame:
    """A stream of notes that are new or changed (change ``upsert``) or gone (``delete``, with their paths alone), by time and size.

    ``state`` is a folder outside the roots that all executors share; a stream that goes on from a checkpoint needs the one it had.
    ``latest`` makes the table of notes of what has come so far.
    """
    register(spark)
    reader = spark.readStream.format("vault").option("state", state).option("pathPrefix", path_prefix)
    return (reader.option("roots", ",".join(f"{k}={v}" for k, v in roots.items())) if roots else reader.option("path", path)).load()


def latest(changes: DataFrame) -> DataFrame:
    """The notes that are there after all ``changes``; a batch that came twice changes nothing."""
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version"), "change"))
    return changes.withColumn("_last", last).where("_last = 1 and change = 'upsert'").drop("_last", "change", "version")
