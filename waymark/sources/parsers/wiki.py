"""Wiki pages as JSON with HTML bodies: a title chunk, a section per heading, links and labels."""

from __future__ import annotations

import html
import json
import re
from html.parser import HTMLParser

from waymark.sources.parsers import ParseError, Parsed


def slug(s: str) -> str:
    return "".join(c if c.isalnum() else "-" for c in s.lower()).strip("-")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.sections: list[list] = [["", 0, []]]  # label, depth, texts
        self.links: list[tuple[str, str | None]] = []
        self.heading, self.anchor = None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if re.fullmatch("h[1-6]", tag):
            self.heading = []
            self.sections.append(["", int(tag[1]), []])
        elif tag == "a" and a.get("href"):
            self.anchor = [a["href"], []]
        for name in ("ac:page-title", "ri:content-title"):
            if tag in ("ac:link", "ri:page") and a.get(name):
                self.links.append((a[name], None))

    def handle_endtag(self, tag: str) -> None:
        if re.fullmatch("h[1-6]", tag) and self.heading is not None:
            self.sections[-1][0] = " ".join("".join(self.heading).split())
            self.heading = None
        elif tag == "a" and self.anchor is not None:
            self.links.append((self.anchor[0], " ".join("".join(self.anchor[1]).split()) or None))
            self.anchor = None
        elif tag in ("p", "li", "tr", "div", "table", "ul", "ol"):
            self.sections[-1][2].append("\n")

    def handle_data(self, data: str) -> None:
        (self.heading if self.heading is not None else self.sections[-1][2]).append(data)
        if self.anchor is not None:
            self.anchor[1].append(data)


def parse(path: str, text: str) -> Parsed:
    try:
        page = json.loads(text)
        body = page.get("body", {}).get("storage", {}).get("value", "") or ""
    except (ValueError, AttributeError) as e:
        raise ParseError("no page record") from e
    tree = _Page()
    tree.feed(body)
    tree.close()
    title = page.get("title") or ""
    parts, at = [], 0
    out = Parsed("")

    def add(kind: str, label: str, depth: int, body_text: str) -> None:
        nonlocal at
        s = (f"{label}\n{body_text}" if body_text else label) + "\n\n"
        out.chunk(at, at + len(s.encode()), kind, label, depth)
        parts.append(s)
        at += len(s.encode())

    clean = lambda xs: re.sub(r"[ \t]*\n\s*", "\n", re.sub(r"[ \t\xa0]+", " ", html.unescape("".join(xs)))).strip()
    add("section", title, 1, clean(tree.sections[0][2]))
    for label, depth, texts in tree.sections[1:]:
        add("section", label, depth, clean(texts))
    out.text = "".join(parts)
    out.links = [(t, d, 0) for t, d in tree.links]
    meta = page.get("metadata") or {}
    out.tag("source:confluence", *([f"confluence:space:{page['space']['key']}"] if (page.get("space") or {}).get("key") else []))
    out.tag(*(f"tag:{x['name']}" for x in (meta.get("labels") or {}).get("results", []) if x.get("name")))
    out.tag(*(f"confluence:parent:{slug(x['title'])}" for x in page.get("ancestors") or [] if x.get("title")))
    out.auto_type = "note"
    return out
