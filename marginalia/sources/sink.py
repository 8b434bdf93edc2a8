"""Writing notes: staged plans that are applied once, compare-and-swap, and reports that are appended once.

These act on single files and run on the driver; many notes are written with ``foreachPartition`` over
``create_note``, whose exclusive create makes a task's second attempt harmless.
"""

from __future__ import annotations

import datetime
import difflib
import hashlib
import json
import os
import re
import tempfile
import threading
import uuid
from urllib.parse import unquote

from ..functions import markdown as md
from ..functions.markdown import FRONTMATTER_BYTES, FrontmatterError

# Fixed values.
PATCHABLE = ("client", "project", "title", "tags", "source_refs")
SERVER_OWNED = ("id", "updated_at")
PATH_MOST, PLAN_DAYS = 500, 7
_lock = threading.RLock()


class Refused(ValueError):
    """A write that must not be done."""


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def check_path(path: str) -> str:
    """A relative path that stays inside, also when percent-decoded."""
    for form in (path, unquote(path)):
        parts = form.replace("\\", "/").split("/")
        if not form or len(form) > PATH_MOST or any(ord(c) < 32 or ord(c) == 127 for c in form) or form[0] in "/~\\" or re.match(r"[A-Za-z]:", form) or ".." in parts:
            raise Refused(f"not a path inside the root: {path!r}")
    return path.removeprefix("./")


def slug(text: str) -> str:
    """Letters and digits of any script, others as one hyphen."""
    found = re.sub(r"[\W_]+", "-", text.strip().lower()).strip("-")
    return found or f"untitled-{sha256(text)[:8]}"


def check_patch(patch: dict) -> dict:
    for key, value in patch.items():
        if key in SERVER_OWNED:
            raise Refused(f"{key} is not for clients to write")
        if key not in PATCHABLE:
            raise Refused(f"{key} cannot be written")
        lists = key in ("tags", "source_refs")
        if lists and not (isinstance(value, list) and all(isinstance(v, str) for v in value)) or not lists and not isinstance(value, str):
            raise Refused(f"{key} has the wrong type")
    return patch


def serialize(data: dict, body: str) -> str:
    import yaml

    block = yaml.safe_dump(data, allow_unicode=True, sort_keys=False) if data else ""
    if len(block.encode()) > FRONTMATTER_BYTES:
        raise FrontmatterError("front matter would be too large")
    return (f"---\n{block}---\n" if data else "") + body.rstrip() + "\n"


def replace_atomically(place: str, text: str) -> None:
    """Write beside the file, keep its mode, and rename over it."""
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(place), prefix=".marginalia-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        if os.path.exists(place):
            os.chmod(temporary, os.stat(place).st_mode & 0o7777)
        os.replace(temporary, place)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


class VaultSink:
    """Writes to one root. Plans are JSON files in ``state``, outside the root and bound to it."""

    def __init__(self, root: str, state: str, reserved: tuple[str, ...] = ("audit", "skills")):
        self.root, self.state, self.reserved = os.path.realpath(root), os.path.realpath(state), reserved
        if self.state == self.root or self.state.startswith(self.root + os.sep):
            raise Refused("plans must not be inside the root")
        os.makedirs(self.state, mode=0o700, exist_ok=True)
        s = os.stat(self.root)
        self.vault_id = sha256(f"{self.root}\0{s.st_dev}\0{s.st_ino}")[:16]

    def _place(self, path: str, general: bool = True) -> str:
        path = check_path(path)
        place = os.path.join(self.root, path)
        real = os.path.realpath(place)
        relative = os.path.relpath(real, self.root)
        if real != place or not real.startswith(self.root + os.sep):
            raise Refused(f"{path} leads elsewhere")
        if general and relative.split(os.sep)[0] in self.reserved:
            raise Refused(f"{path} is reserved")
        return place

    def note_path(self, client: str, project: str, title: str) -> str:
        return f"projects/{slug(client)}/{slug(project)}/{slug(title)}.md"

    def _content(self, client: str, project: str, title: str, body: str, patch: dict) -> str:
        data = {"id": str(uuid.uuid4()), **check_patch({"client": client, "project": project, "title": title, **patch}), "updated_at": datetime.datetime.now(datetime.timezone.utc).isoformat()}
        return serialize(data, body)

    def _create(self, path: str, content: str, general: bool = True) -> str:
        place = self._place(path, general)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        try:
            with open(place, "x", encoding="utf-8", newline="") as f:
                f.write(content)
        except FileExistsError:
            raise Refused(f"{path} exists") from None
        return path

    def create_note(self, client: str, project: str, title: str, body: str, **patch) -> str:
        with _lock:
            return self._create(self.note_path(client, project, title), self._content(client, project, title, body, patch))

    def _stage(self, plan: dict) -> dict:
        plan = {"patch_id": str(uuid.uuid4()), "created_at": datetime.datetime.now(datetime.timezone.utc).isoformat(), "vault_id": self.vault_id, **plan}
        with open(os.path.join(self.state, f"{plan['patch_id']}.json"), "x", encoding="utf-8") as f:
            json.dump(plan, f)
        return plan

    def _plan(self, patch_id: str, operation: str) -> dict:
        if str(uuid.UUID(patch_id)) != patch_id:
            raise Refused("not a plan's name")
        try:
            with open(os.path.join(self.state, f"{patch_id}.json"), encoding="utf-8") as f:
                plan = json.load(f)
        except FileNotFoundError:
            raise Refused("no such plan") from None
        if plan["vault_id"] != self.vault_id or plan["operation"] != operation:
            raise Refused("the plan is for something else")
        if sha256(plan["new_content"]) != plan["content_sha256"]:
            raise Refused("the plan was changed")
        return plan

    def _done(self, plan: dict) -> None:
        os.unlink(os.path.join(self.state, f"{plan['patch_id']}.json"))

    @staticmethod
    def _diff(path: str, old: str, new: str) -> str:
        return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), path, path))

    def plan_create(self, client: str, project: str, title: str, body: str, reason: str = "", **patch) -> dict:
        path = self.note_path(client, project, title)
        if os.path.exists(self._place(path)):
            raise Refused(f"{path} exists")
        content = self._content(client, project, title, body, patch)
        return self._stage({"operation": "create", "target_path": path, "reason": reason, "new_content": content, "content_sha256": sha256(content), "diff": self._diff(path, "", content), "confirmation": path})

    def apply_create(self, patch_id: str, confirmed_path: str) -> str:
        with _lock:
            plan = self._plan(patch_id, "create")
            if confirmed_path != plan["confirmation"]:
                raise Refused("another path was confirmed")
            self._create(plan["target_path"], plan["new_content"])
            self._done(plan)
            return plan["target_path"]

    def plan_update(self, path: str, patch: dict | None = None, body: str | None = None, reason: str = "") -> dict:
        place = self._place(path)
        with open(place, encoding="utf-8", newline="") as f:
            old = f.read()
        data, old_body, error = md.parse_note(old)
        if error:
            raise Refused(f"{path}: {error}")
        data |= check_patch(patch or {}) | {"updated_at": datetime.datetime.now(datetime.timezone.utc).isoformat()}
        content = serialize(data, old_body if body is None else body)
        return self._stage({"operation": "update", "target_path": path, "reason": reason, "expected_sha256": sha256(old), "new_content": content, "content_sha256": sha256(content), "diff": self._diff(path, old, content)})

    def apply_update(self, patch_id: str) -> str:
        """Refused if the note has changed since the plan was made."""
        with _lock:
            plan = self._plan(patch_id, "update")
            place = self._place(plan["target_path"])
            with open(place, encoding="utf-8", newline="") as f:
                if sha256(f.read()) != plan["expected_sha256"]:
                    raise Refused("the note has changed since")
            replace_atomically(place, plan["new_content"])
            self._done(plan)
            return plan["target_path"]

    def append_report(self, name: str, content: str) -> bool:
        """True if written, False if the same report was there; another one under its name is refused."""
        with _lock:
            path = f"audit/reports/{check_path(name)}"
            try:
                self._create(path, content, general=False)
                return True
            except Refused:
                place = self._place(path, general=False)
                if not os.path.isfile(place):
                    raise
                with open(place, encoding="utf-8", newline="") as f:
                    if f.read() != content:
                        raise Refused(f"{name} exists with other content") from None
                return False

    def compare_and_swap(self, name: str, expected_sha256: str, content: str) -> str:
        """Replace a state file whose content has this hash (a missing one is empty); returns the new hash."""
        with _lock:
            place = self._place(f"audit/{check_path(name)}", general=False)
            old = ""
            if os.path.exists(place):
                with open(place, encoding="utf-8", newline="") as f:
                    old = f.read()
            if sha256(old) != expected_sha256:
                raise Refused("the state has changed")
            os.makedirs(os.path.dirname(place), exist_ok=True)
            replace_atomically(place, content)
            return sha256(content)

    def prune_plans(self, now: float, days: float = PLAN_DAYS) -> int:
        """Delete plans older than that; other files stay."""
        gone = 0
        for entry in os.scandir(self.state):
            stem, dot, kind = entry.name.partition(".")
            if kind == "json" and re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", stem) and entry.is_file(follow_symlinks=False) and now - entry.stat().st_mtime > days * 86400:
                os.unlink(entry.path)
                gone += 1
        return gone
