"""Links, headings, sections and front matter of Markdown notes; pure functions."""

from __future__ import annotations

import datetime
import json
import re
import unicodedata
from dataclasses import dataclass, field
from itertools import groupby
from urllib.parse import unquote_to_bytes

from .text import SPACE, Fences, estimate_tokens, utf16_length

# Limits that decide what is accepted.
FRONTMATTER_BYTES, EXPANSION_FLOOR, EXPANSION_FACTOR = 8192, 65536, 16
SPLIT_CHARS = 6000

_HEADING = re.compile(f"(#{{1,6}})[{SPACE}]+(.*)", re.S)
_CLOSING = re.compile(f"(?:^|[{SPACE}]+)#+$")
_TITLE = re.compile(f"^#[{SPACE}]+(.+)$", re.M)
_STRIP = "".join(chr(c) for c in range(0x3001) if re.match(f"[{SPACE}]", chr(c))) + "﻿"


def wiki_links(body: str) -> list[str]:
    """Sorted distinct targets of ``[[name#anchor|alias]]``.

    One pass over the closing brackets: a link lies between two of them, so its last ``[[`` candidates are
    tried in order and each stretch is read once.
    """
    found, at = set(), 0
    while (close := body.find("]", at)) >= 0:
        if body[close + 1 : close + 2] == "]":
            inner = body[at:close]
            opened = inner.find("[[")
            while opened >= 0:
                content = inner[opened + 2 :]
                if _wiki_content(content):
                    found.add(re.split(r"[|#]", content, maxsplit=1)[0].strip(_STRIP))
                    close += 1
                    break
                opened = _next_start(inner, opened, content)
        at = close + 1
    return sorted(found, key=lambda s: s.encode("utf-16-be", "surrogatepass"))


def _next_start(inner: str, opened: int, content: str) -> int:
    """The next ``[[`` that can do better than a failed one; only a different name or tail can."""
    if content[:1] in ("", "|", "#"):
        return inner.find("[[", opened + 1)
    bar = re.search(r"[|#]", content)
    # the tail is wrong and stays so for every start before it
    return inner.find("[[", opened + 2 + (bar.start() if bar else len(content)))


def _wiki_content(content: str) -> bool:
    name = re.split(r"[|#]", content, maxsplit=1)[0]
    tail = content[len(name) :]
    if not name:
        return False
    if tail.startswith("#"):
        anchor = tail[1:].split("|", 1)[0]
        if not anchor:
            return False
        tail = tail[1 + len(anchor) :]
    return tail != "|"


def markdown_links(body: str) -> list[str]:
    """Sorted distinct local targets of ``[text](target)``."""
    found, at = set(), 0
    while (middle := body.find("](", at)) >= 0:
        # the text begins at any "[" since the last "]"; it must not be empty
        opened = body.find("[", max(at, body.rfind("]", at, middle) + 1), middle)
        if opened < 0 or opened + 1 == middle:
            at = middle + 1
            continue
        end = body.find(")", middle + 2)
        if end < 0:
            break
        if end == middle + 2:
            at = middle + 1
            continue
        target = body[middle + 2 : end].strip(_STRIP)
        if target and "://" not in target and not target.startswith("#"):
            found.add(target)
        at = end + 1
    return sorted(found, key=lambda s: s.encode("utf-16-be", "surrogatepass"))


def resolve_relative(link: str, from_path: str) -> str | None:
    """Path that a link means in the folder of the note that has it; None if that is no path inside."""
    target = re.split(r"[#?]", link, maxsplit=1)[0].strip(_STRIP)
    if not target or target[0] == "/" or "\0" in target:
        return None
    if not re.search(r"%(?![0-9A-Fa-f]{2})", target):
        try:
            target = unquote_to_bytes(target).decode("utf-8")
        except UnicodeDecodeError:
            pass
    parts: list[str] = []
    for part in (from_path.rpartition("/")[0] + "/" + target).split("/"):
        if part == "..":
            if not parts:
                return None
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return unicodedata.normalize("NFC", "/".join(parts)) if parts else None


def lookup_form(path: str) -> str:
    return unicodedata.normalize("NFC", re.sub(r"\.md$", "", path, flags=re.I))


@dataclass
class Heading:
    level: int
    title: str
    line: int
    path: list[str] = field(default_factory=list)


def headings(lines: list[str]) -> list[Heading]:
    """ATX headings outside fences, each with its ancestry."""
    found, fences, above = [], Fences(), []
    for number, line in enumerate(lines):
        if fences.marker(line) is not None or fences.open:
            continue
        if match := _HEADING.match(line):
            title = _CLOSING.sub("", match.group(2).strip(_STRIP)).strip(_STRIP)
            level = len(match.group(1))
            while above and above[-1].level >= level:
                above.pop()
            found.append(Heading(level, title, number, [*(h.title for h in above), title]))
            above.append(found[-1])
    return found


def _extents(found: list[Heading], count: int) -> list[int]:
    """Line after each heading's section: the next heading as high or higher."""
    ends, waiting = [count] * len(found), []
    for k, h in enumerate(found):
        while waiting and found[waiting[-1]].level >= h.level:
            ends[waiting.pop()] = h.line
        waiting.append(k)
    return ends


def outline(body: str) -> list[dict]:
    lines = body.split("\n")
    found = headings(lines)
    out = []
    for h, end in zip(found, _extents(found, len(lines)), strict=True):
        text = "\n".join(lines[h.line : end])
        out.append({"heading": h.title, "level": h.level, "heading_path": h.path, "start_line": h.line + 1, "chars": utf16_length(text), "est_tokens": estimate_tokens(text)})
    return out


def select_sections(body: str, wanted: list[str]) -> tuple[str, list[str]]:
    """Text of the sections that the requests name, and the requests that matched.

    A request names headings of its title and all below its path. Lines of any named section are kept; where lines
    are left out between them, a blank line stands.
    """
    lines = body.split("\n")
    form = lambda s: unicodedata.normalize("NFC", s).lower()
    asked = [(w, form(w)) for w in wanted]
    kept, matched = [False] * len(lines), []
    found = headings(lines)
    for h, end in zip(found, _extents(found, len(lines)), strict=True):
        path = form("/".join(h.path)) + "/"
        names = {form(h.title), *(path[:k] for k, c in enumerate(path) if c == "/")}
        if hits := [w for w, name in asked if name in names]:
            matched += [w for w in hits if w not in matched]
            kept[h.line : end] = [True] * (end - h.line)
    runs = groupby(zip(kept, lines, strict=True), key=lambda x: x[0])
    return "\n\n".join("\n".join(line for _, line in run) for is_kept, run in runs if is_kept), matched


def split_sections(body: str, limit: int = SPLIT_CHARS) -> list[tuple[list[str], str]]:
    """(heading path, text) of the sections of a long body, cut at the highest headings until pieces fit."""
    if utf16_length(body) <= limit:
        return [([], body)]
    out: list[tuple[list[str], str]] = []

    def cut(text: str, path: list[str], level: int, before: str) -> None:
        """``before`` is a heading line that belongs to the first piece."""
        lines = text.split("\n")
        found = [h for h in headings(lines) if h.level >= level] if utf16_length(text) > limit else []
        if not found:
            out.append((path, before + text))
            return
        top = min(h.level for h in found)
        tops = [h for h in found if h.level == top]
        if len(tops) == 1 and tops[0].line == 0:
            cut("\n".join(lines[1:]), [*path, tops[0].title], top + 1, f"{before}{lines[0]}\n")
            return
        if tops[0].line:
            cut("\n".join(lines[: tops[0].line]), path, top + 1, before)
            before = ""
        for h, end in zip(tops, [*(h.line for h in tops[1:]), len(lines)], strict=True):
            cut("\n".join(lines[h.line : end]), [*path, h.title], top + 1, before)
            before = ""

    cut(body, [], 1, "")
    return out


def project_body(body: str, with_outline: bool = False, sections: list[str] | None = None, max_chars: int | None = None) -> dict:
    """What a fetch returns of a body: its outline instead of it, or sections and then a prefix of UTF-16 length.

    total_chars is that of the whole body; nothing asked for leaves it as it is, without the other fields.
    """
    whole = utf16_length(body)
    if with_outline:
        return {"body": "", "outline": outline(body), "truncated": whole > 0, "total_chars": whole}
    if sections is None and max_chars is None:
        return {"body": body}
    kept, matched = select_sections(body, sections) if sections else (body, None)
    if max_chars is not None and utf16_length(kept) > max_chars:
        kept = kept.encode("utf-16-le", "surrogatepass")[: 2 * max_chars].decode("utf-16-le", "ignore")
    out = {"body": kept, "truncated": utf16_length(kept) < whole, "total_chars": whole}
    return out | ({"sections_matched": matched} if matched is not None else {})


class FrontmatterError(ValueError):
    pass


def split_frontmatter(raw: str) -> tuple[str | None, str]:
    """YAML block and body; None without a block."""
    text = raw.removeprefix("﻿")
    if not text.startswith("---") or text.startswith("----"):
        return None, text
    end = text.find("\n---", 3)
    block = text[3:end] if end >= 0 else text[3:]
    if len(block.encode("utf-8", "surrogatepass")) > FRONTMATTER_BYTES:
        raise FrontmatterError(f"front matter is larger than {FRONTMATTER_BYTES} bytes")
    if block.split("\n", 1)[0].strip() not in ("", "yaml"):
        raise FrontmatterError("front matter must be YAML")
    body = text[end + 4 :] if end >= 0 else ""
    return block.partition("\n")[2], body.removeprefix("\r").removeprefix("\n")


def _loader():
    import yaml

    class Loader(yaml.SafeLoader):
        """Only true and false are booleans."""

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    return yaml, Loader


def _cost(value: object, most: int) -> int:
    """Written size, as far as the limit; shared parts count each time they occur."""
    total, stack = 0, [value]
    while stack and total <= most:
        v = stack.pop()
        total += 2
        if isinstance(v, dict):
            stack += [*v.keys(), *v.values()]
        elif isinstance(v, (list, tuple, set)):
            stack += list(v)
        else:
            total += len(v) if isinstance(v, str) else len(str(v))
    return total


def parse_note(raw: str) -> tuple[dict, str, str | None]:
    """Metadata, body and error; on an error there are no metadata and all is body."""
    try:
        block, body = split_frontmatter(raw)
        if block is None:
            return {}, body, None
        yaml, loader = _loader()
        try:
            data = yaml.load(block, Loader=loader)
        except (yaml.YAMLError, ValueError, RecursionError) as e:
            raise FrontmatterError(f"front matter: {type(e).__name__}") from e
        if data is None:
            data = {}
        if not isinstance(data, dict):
            raise FrontmatterError("front matter is no mapping")
        most = max(EXPANSION_FLOOR, EXPANSION_FACTOR * len(block.encode("utf-8", "surrogatepass")))
        if _cost(data, most) > most:
            raise FrontmatterError("front matter expands too far")
        return normalize_metadata(data), body, None
    except FrontmatterError as e:
        return {}, raw, str(e)


def _text(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return value if isinstance(value, str) else "" if value is None else str(value)


def string_list(value: object) -> list[str]:
    values = value if isinstance(value, list) else [] if value is None or value == "" else [value]
    return [t for v in values if (t := _text(v).strip(_STRIP))]


def normalize_metadata(data: dict) -> dict:
    """tags and source_refs become lists of texts; client and project texts or absent; other keys stay as parsed."""
    out = dict(data)
    for k in ("tags", "source_refs"):
        if k in out:
            out[k] = string_list(out[k])
    for k in ("client", "project"):
        if k in out and not (t := _text(out[k]).strip(_STRIP)):
            del out[k]
        elif k in out:
            out[k] = t
    return out


def aliases(data: dict) -> list[str]:
    raw = data.get("aliases")
    return [t for v in (raw if isinstance(raw, list) else [raw]) if isinstance(v, str) and (t := v.strip(_STRIP))]


def note_title(data: dict, body: str, path: str) -> str:
    if isinstance(t := data.get("title"), str) and t.strip(_STRIP):
        return t.strip(_STRIP)
    if (m := _TITLE.search(body)) and m.group(1).strip(_STRIP):
        return m.group(1).strip(_STRIP)
    return path.rpartition("/")[2].removesuffix(".md")


def metadata_json(data: dict) -> str:
    def plain(v: object) -> object:
        return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v)

    return json.dumps({str(k): v for k, v in data.items()}, ensure_ascii=False, default=plain)
