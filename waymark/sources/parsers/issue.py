"""Issues as JSON: summary, description paragraphs and comments as chunks, fields as tags, issue links as links."""

from __future__ import annotations

import json

from waymark.sources.parsers import ParseError, Parsed
from waymark.sources.parsers.wiki import slug

#: Block nodes of the document format, and types that keep a name of their own.
BLOCKS = ("paragraph", "heading", "bulletList", "orderedList", "listItem", "blockquote", "codeBlock", "panel")
TASKS = ("task", "sub-task", "subtask")


def paragraphs(node) -> list[str]:
    """The texts of a rich-text document, one per block node; a plain string is one paragraph."""
    if isinstance(node, str):
        return [node]
    out: list[str] = []
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, list):
            stack.extend(reversed(n))
        elif isinstance(n, dict):
            if n.get("type") in BLOCKS:
                out.append("")
            elif n.get("type") == "text":
                if not out:
                    out.append("")
                out[-1] = f"{out[-1]} {n.get('text', '')}".strip()
            stack.append(n.get("content") or [])
    return [p for p in out if p]


def parse(path: str, text: str) -> Parsed:
    try:
        issue = json.loads(text)
        key, f = issue["key"], issue.get("fields") or {}
    except (ValueError, TypeError, KeyError) as e:
        raise ParseError("no issue record") from e
    name = lambda field, k="name": (f.get(field) or {}).get(k)
    out, parts, at = Parsed(""), [], 0

    def add(kind: str, label: str, depth: int, s: str) -> None:
        nonlocal at
        s += "\n\n"
        out.chunk(at, at + len(s.encode()), kind, label, depth)
        parts.append(s)
        at += len(s.encode())

    summary = f.get("summary") or ""
    add("section", f"{key}: {summary}" if summary else key, 1, summary)
    for p in paragraphs(f.get("description") or ""):
        if p.strip():
            add("body", "description", 2, p)
    for c in (f.get("comment") or {}).get("comments", []):
        who = (c.get("author") or {}).get("displayName") or "unknown"
        add("body", f"comment by {who}", 2, f"[{who}] " + "\n".join(paragraphs(c.get("body") or "")))
    out.text = "".join(parts)
    out.tag("source:jira")
    if name("project", "key"):
        out.tag(f"jira:project:{name('project', 'key')}")
    for tag, value in (("status", name("status")), ("type", name("issuetype")), ("priority", name("priority")), ("assignee", name("assignee", "displayName"))):
        if value:
            out.tag(f"jira:{tag}:{slug(value)}")
    out.tag(*(f"tag:{x}" for x in f.get("labels") or []))
    out.tag(*(f"jira:component:{slug(x['name'])}" for x in f.get("components") or [] if x.get("name")))
    for side in ("inwardIssue", "outwardIssue"):
        out.links.extend((x[side]["key"], None, 0) for x in f.get("issuelinks") or [] if (x.get(side) or {}).get("key"))
    kind = (name("issuetype") or "").lower()
    out.auto_type = "task" if kind in TASKS else kind or None
    return out
