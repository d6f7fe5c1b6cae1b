"""Notes in Markdown with frontmatter, wikilinks and inline tags. All offsets are UTF-8 bytes."""

from __future__ import annotations

import json
import re

from waymark.sources.parsers import ParseError, Parsed

_FRONT = re.compile(rb"\A(\s*)---[^\n]*\n(.*?)\n---[^\n]*(?:\n|\Z)|\A(\s*)---[^\n]*\n---[^\n]*(?:\n|\Z)", re.S)
_HEADING = re.compile(rb"^[ \t]*(#{1,6})(?:[ \t]+([^\n]*))?$", re.M)
_LINK = re.compile(rb"\[\[(.+?)\]\]", re.S)
_TAG = re.compile(rb"(?:(?<=[\s])|^)#([A-Za-z][A-Za-z0-9_/-]*)", re.M)


def _scalar(s: str):
    s = s.strip()
    if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
        return s[1:-1]
    for f in (int, float):
        try:
            return f(s)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(s.lower(), s)


def read_front(body: str) -> dict:
    """The mapping of a frontmatter block: scalars, [a, b] lists and - lists; other YAML where a reader is installed."""
    try:
        import yaml
    except ImportError:
        yaml = None
    if yaml is not None:
        try:
            got = yaml.safe_load(body)
        except yaml.YAMLError as e:
            raise ParseError("bad frontmatter") from e
        return {k: v for k, v in got.items() if isinstance(k, str)} if isinstance(got, dict) else {}
    out: dict = {}
    key = None
    for line in body.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if re.match(r"\s+-\s|-\s", line) and key is not None:
            out[key] = [*(out[key] if isinstance(out[key], list) else []), _scalar(line.strip()[1:])]
            continue
        m = re.match(r"([^\s:#][^:]*):(?:\s+(.*)|$)", line)
        if m is None:
            if line[0] in " \t":
                continue
            raise ParseError("bad frontmatter")
        key, value = m[1].strip(), (m[2] or "").strip()
        if value.startswith("[") != value.endswith("]"):
            raise ParseError("bad frontmatter")
        out[key] = [_scalar(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") else _scalar(value)
    return out


def fences(b: bytes) -> list[tuple[int, int]]:
    """Byte ranges of fenced code; one that isn't closed reaches to the end."""
    out, start, at = [], None, 0
    for line in b.splitlines(keepends=True):
        if line.strip().startswith(b"```"):
            if start is None:
                start = at
            else:
                out.append((start, at + len(line)))
                start = None
        at += len(line)
    return out + [(start, len(b))] if start is not None else out


def flatten(tags: list[str]) -> list[str]:
    out: dict[str, None] = {}
    for t in tags:
        parts = t.split("/")
        out.update(dict.fromkeys("/".join(parts[: i + 1]) for i in range(len(parts))))
    return list(out)


def parse(path: str, text: str) -> Parsed:
    b = text.encode()
    out = Parsed(text)
    m = _FRONT.match(b)
    front: dict = {}
    body_at = 0
    if m:
        lead = len(m[1] if m[1] is not None else m[3])
        front = read_front((m[2] or b"").decode("utf-8", "replace"))
        out.frontmatter = json.dumps(front, default=str)
        out.chunk(lead, m.end(), "frontmatter", None, 0)
        body_at = m.end()
    tags = front.get("tags")
    named = [t for t in tags if isinstance(t, str)] if isinstance(tags, list) else [t.strip() for t in tags.split(",")] if isinstance(tags, str) else []
    code = fences(b)
    masked = bytearray(b)
    for x, y in code:  # blanks of the same length, line ends kept
        masked[x:y] = re.sub(rb"[^\n]", b" ", b[x:y])
    masked = bytes(masked)
    heads = [h for h in _HEADING.finditer(b, body_at)]
    starts = [h.start() for h in heads]
    if not heads:
        if b[body_at:].strip():
            out.chunk(body_at, len(b), "body", None, 0)
    elif b[body_at : starts[0]].strip():
        out.chunk(body_at, starts[0], "body", None, 0)
    for h, end in zip(heads, [*starts[1:], len(b)], strict=False):
        out.chunk(h.start(), end, "section", (h[2] or b"").decode("utf-8", "replace").strip().rstrip("#").strip(), len(h[1]))
    for link in _LINK.finditer(masked):
        target, bar, display = b[link.start(1) : link.end(1)].decode("utf-8", "replace").partition("|")
        if target.strip():
            out.links.append((target.strip(), display.strip() if bar else None, link.start()))
    no_heads = _HEADING.sub(lambda h: b" " * len(h[0]), masked)
    inline = [t[1].decode() for t in _TAG.finditer(no_heads)]
    out.tag(*flatten([t for t in named if t] + inline))
    lines = max(1, len(text.splitlines()))
    boxes = len(re.findall(r"- \[[ xX]\]", text))
    if any(k in front for k in ("url", "isbn", "source")):
        out.auto_type = "reference"
    elif boxes >= 3 and boxes / lines > 0.2:
        out.auto_type = "task"
    elif len(out.links) >= 5 and len(out.links) / lines > 0.3:
        out.auto_type = "moc"
    return out
