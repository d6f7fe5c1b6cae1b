"""Chat bundles of a channel and day: a chunk per root message with its replies."""

from __future__ import annotations

import json
import re

from waymark.sources.parsers import ParseError, Parsed
from waymark.sources.parsers.wiki import slug

#: Subtypes that are messages.
SHOWN = (None, "", "bot_message", "file_share")


def expand(s: str) -> str:
    s = re.sub(r"<@[^|>]+\|([^>]+)>", r"@\1", s)
    s = re.sub(r"<@([^|>]+)>", r"@\1", s)
    s = re.sub(r"<#[^|>]+\|([^>]+)>", r"#\1", s)
    s = re.sub(r"<#([^|>]+)>", r"#\1", s)
    s = re.sub(r"<((?:https?|mailto)[^|>]*)\|([^>]+)>", r"\2 (\1)", s)
    return re.sub(r"<((?:https?|mailto)[^|>]*)>", r"\1", s)


def parse(path: str, text: str) -> Parsed:
    try:
        bundle = json.loads(text)
        messages = bundle["messages"]
    except (ValueError, TypeError, KeyError) as e:
        raise ParseError("no chat bundle") from e
    author = lambda m: m.get("username") or m.get("user") or "unknown"
    replies: dict[str, list] = {}
    for m in messages:
        if m.get("thread_ts") and m["thread_ts"] != m.get("ts"):
            replies.setdefault(m["thread_ts"], []).append(m)
    out, parts, at = Parsed(""), [], 0
    for m in messages:
        if m.get("subtype") not in SHOWN or m.get("thread_ts") not in (None, "", m.get("ts")):
            continue
        lines = [f"[{author(m)}] {expand(m.get('text') or '')}"]
        lines += [f"  file: {x.get('title') or x.get('name')}" for x in m.get("files") or []]
        if m.get("reactions"):
            lines.append("  " + " ".join(f":{x['name']}:×{x['count']}" for x in m["reactions"]))
        lines += [f"  ↳ [{author(r)}] {expand(r.get('text') or '')}" for r in replies.get(m.get("ts"), [])]
        s = "\n".join(lines) + "\n"
        out.chunk(at, at + len(s.encode()), "body", author(m), 1)
        parts.append(s)
        at += len(s.encode())
    out.text = "".join(parts)
    out.tag("source:slack")
    if bundle.get("channel_name"):
        out.tag(f"slack:channel:{slug(bundle['channel_name'])}")
    if bundle.get("date"):
        out.tag(f"slack:date:{bundle['date']}")
    out.tag(*(f"slack:user:{slug(u)}" for u in sorted({author(m) for m in messages if m.get("subtype") in SHOWN})))
    if replies:
        out.tag("slack:has-threads")
    out.auto_type = "conversation"
    return out
