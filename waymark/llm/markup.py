"""Problem 4: markup residue turned into clean text that keeps its structure.

HTML, Markdown, wiki, LaTeX and chat markup are parsed into one kind of tree. Over all
pages of one host (a wiki, a channel, a source) wrappers are induced: pages with the same
outline, their first two levels of tags, are of one kind; its commonest tree shape stands
for it, every other shape is aligned with that by simple tree matching, and a node whose
text is the same on nearly all pages of the kind is template, while nodes whose text
varies are slots that hold content. Rendering leaves out template texts and writes slots
as headings, lists, code, tables, formulas and labels.

Every kind and every shape is aligned, however many a host has and however large they
are. Two limits of the parser keep hostile texts harmless: marks nested more than 12 deep
in one another stay as written, and elements open more than 200 deep count as siblings.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.runtime import cut

#: Different pages of a kind that must hold a text before it can be template, and which share of the kind's pages.
SUPPORT, CONSTANT = 5, 0.9
#: Bytes up to which what is template is sent to every task; beyond, pages are shuffled to it.
BROADCAST_BYTES = 8 << 20

#: The names of HTML elements, those without content, those that stand in lines of their own.
ELEMENTS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img "
    "input ins kbd label li link main mark meta nav ol p pre q s samp script section small span strike strong style sub summary sup table tbody td tfoot th thead title tr tt u ul var video"
).split()
VOID = frozenset("br hr img input meta link col".split())
BLOCKS = frozenset("p div section article blockquote ul ol li dl dt dd table tr h1 h2 h3 h4 h5 h6 pre hr header footer main aside nav figure".split())
HIDDEN = frozenset("script style head meta link iframe".split())
#: LaTeX commands that may stand without braces.
COMMANDS = (
    "item begin end section subsection chapter paragraph title author maketitle textbf textit emph underline texttt frac sqrt sum int prod alpha beta gamma delta epsilon theta lambda mu pi sigma phi omega leq geq neq approx times cdot ldots infty partial nabla cite ref label "
    "footnote href url caption centering includegraphics hline noindent newline par quad left right"
).split()
MACROS = "code noformat quote panel color info note warning tip toc expand anchor status jira children excerpt section column".split()

_KINDS = [
    ("fence", r"```[^\n`]*\n[\s\S]*?(?:```|\Z)|```[^`]+```|^~~~[^\n]*\n[\s\S]*?(?:^~~~|\Z)"),
    ("noformat", r"\{(?:code|noformat)(?::[^}\n]*)?\}[\s\S]*?\{(?:code|noformat)\}"),
    ("code", r"`[^`\n]+`"),
    ("display", r"\$\$[^$]+\$\$|\\\[[\s\S]+?\\\]"),
    ("math", r"\\\([\s\S]+?\\\)|(?<![\w$\\])\$(?![\s$])(?:(?!\d)[^$\n]*?|[^$\n]*?[\\^_][^$\n]*?)(?<![\s\\])\$(?![\w$])"),
    ("begin", r"\\begin\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?"),
    ("end", r"\\end\{[A-Za-z]+\*?\}"),
    ("command", r"(?<![\w:\\])\\(?:[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{(?:[^{}\n]|\{[^{}\n]*\})*\})+|(?:%s)\b)" % "|".join(COMMANDS)),
    ("comment", r"<!--[\s\S]*?-->|<!\[CDATA\[|\]\]>|<!DOCTYPE[^>]*>"),
    ("tag", r"</?(?:(?:%s)(?=[\s/>])|(?:ac|ri):[\w-]+)[^<>]*>" % "|".join(ELEMENTS)),
    ("chat", r"<[@#!][^<>\n]+>|<(?:https?|ftp|mailto|tel):[^<>\s|]+(?:\|[^<>\n]*)?>"),
    ("entity", r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"),
    ("image", r"!\[[^\]\n]*\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"),
    ("link", r"\[[^\[\]\n]+\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"),
    ("wikilink", r"!?\[\[[^\[\]\n]+\]\]"),
    ("exlink", r"\[[^\[\]|\n]+\|[^\[\]\s|]+(?:\|[^\[\]\n]*)?\]|\[https?://[^\[\]\s]+(?: [^\[\]\n]+)?\]"),
    ("mono", r"\{\{[^{}\n]+\}\}"),
    ("macro", r"\{(?:%s)(?::[^{}\n]*)?\}" % "|".join(MACROS)),
    ("heading", r"^[ \t]{0,3}#{1,6}[ \t]+\S[^\n]*|^h[1-6]\.[ \t]+\S[^\n]*|^={2,6}[^=\n]+={2,6}[ \t]*(?=\S|$)"),
    ("quote", r"^[ \t]{0,3}>[ \t]?(?=[^\n>])|^bq\.[ \t]+"),
    ("table", r"^[ \t]*\|\|?[^|\n]+\|[^\n]*\|[^\n]*"),
    ("item", r"^[ \t]*(?:[-+*\u2022][ \t]+|\d{1,3}[.)][ \t]+|[*#]{2,6}[ \t]+)(?=\S)"),
    ("rule", r"^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$"),
    ("strong", r"(?<![\w*])\*\*(?=\S)[^*\n]+?(?<=\S)\*\*(?![\w*])|(?<!\w)__(?=\S)[^_\n]+?(?<=\S)__(?!\w)|'''[^'\n]+'''"),
    ("strike", r"(?<![\w~])~~(?=\S)[^~\n]+?(?<=\S)~~(?![\w~])|(?<![\w~])~(?=\S)[^~\n]+?(?<=\S)~(?![\w~])"),
    ("em", r"(?<![\w*\\])\*(?=\S)[^*\n]+?(?<=\S)\*(?![\w*])|(?<![\w\\])_(?=\S)[^_\n]+?(?<=\S)_(?!\w)|(?<!')''[^'\n]+''(?!')"),
]
_TOKEN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS), re.M | re.I)
#: No markup is possible without one of these.
_HINT = re.compile(r"[<>*_`\[\]{}\\$#~|&=']|^[ \t]*[-+\u2022]|^[ \t]*\d{1,3}[.)]|^(?:h[1-6]|bq)\.|^---", re.M)
_BRACED = re.compile(r"\{((?:[^{}\n]|\{[^{}\n]*\})*)\}")


class Node:
    """An element of the parsed text; ``kids`` are nodes and strings."""

    __slots__ = ("tag", "kids", "attr")

    def __init__(self, tag: str, kids: list | None = None, attr: str = ""):
        self.tag, self.kids, self.attr = tag, kids if kids is not None else [], attr

    def nodes(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.kids))
        return "".join(out)


def _inner(text: str, depth: int) -> list:
    return parse(text, depth + 1).kids if depth < 12 else [text]


def _leaf(kind: str, m: str, depth: int) -> Node | str:
    """The node of one token that isn't an HTML tag, a LaTeX environment or a macro."""
    if kind == "fence":
        body = m[3:-3] if m.endswith(("```", "~~~")) and len(m) >= 6 else m[3:]
        first, _, rest = body.partition("\n")
        return Node("pre", [rest if "\n" in body else body], first.strip() if "\n" in body else "")
    if kind == "noformat":
        return Node("pre", [re.sub(r"^\{[^}]*\}|\{[^}]*\}$", "", m)])
    if kind in ("code", "mono"):
        return Node("code", [m.strip("`") if kind == "code" else m[2:-2]])
    if kind in ("math", "display"):
        return Node(kind, [m.strip("$") if m[0] == "$" else m[2:-2]])
    if kind == "entity":
        return Node("entity", [html.unescape(html.unescape(m))]) if m[1] == "#" or m[1:] in html5 else m
    if kind == "chat":
        target, bar, label = m[1:-1].partition("|")
        if target[0] in "@#!":
            shown = label if bar and label else target[1:]
            return Node("ref", [("#" if target[0] == "#" else "@") + shown.lstrip("@#")], target)
        return Node("a", [label if bar and label else re.sub(r"^(?:mailto|tel):", "", target)], target)
    if kind in ("image", "link"):
        label, _, target = m.lstrip("!")[1:].partition("](")
        return Node("img" if kind == "image" else "a", _inner(label, depth), target[:-1])
    if kind == "wikilink":
        target, bar, label = m.lstrip("!")[2:-2].partition("|")
        return Node("a", [label.strip() if bar else target.strip()], target)
    if kind == "exlink":
        body = m[1:-1]
        if "|" in body:
            label, _, target = body.partition("|")
        else:
            target, _, label = body.partition(" ")
        return Node("a", [label or target], target)
    if kind == "heading":
        line = m.strip()
        if line[0] == "#":
            mark = len(line) - len(line.lstrip("#"))
            return Node(f"h{mark}", _inner(line.strip("#").strip(), depth))
        if line[0] == "=":
            mark = min(6, len(line) - len(line.lstrip("=")))
            return Node(f"h{mark}", _inner(line.strip("= \t"), depth))
        return Node(f"h{line[1]}", _inner(line[3:].strip(), depth))
    if kind == "table":
        line = m.strip()
        if re.fullmatch(r"\|?[\s:|-]+\|?[\s:|-]*", line):
            return Node("rule")
        cells = [c.strip() for c in re.split(r"\|\|?", line.strip("|"))]
        return Node("tr", [Node("td", _inner(c, depth)) for c in cells])
    if kind == "command":
        name = re.match(r"\\([A-Za-z]+)", m)[1]
        args = _BRACED.findall(m)
        if name in ("section", "chapter", "title"):
            return Node("h1", _inner(args[0], depth) if args else [])
        if name in ("subsection", "paragraph"):
            return Node("h2", _inner(args[0], depth) if args else [])
        if name == "item":
            return Node("item", [])
        if name in ("frac", "sqrt", "sum", "int", "prod") or not args and name not in ("maketitle", "centering", "hline", "noindent", "newline", "par"):
            return Node("math", [m])
        if name == "href" and len(args) > 1:
            return Node("a", _inner(args[1], depth), args[0])
        if name in ("label", "includegraphics"):
            return Node("hidden")
        return Node("em", _inner(args[-1], depth) if args else [])
    if kind in ("strong", "strike", "em"):
        mark = 3 if m.startswith("'''") else 2 if kind == "strong" or m.startswith(("~~", "''")) else 1
        return Node({"strong": "strong", "strike": "del", "em": "em"}[kind], _inner(m[mark:-mark], depth))
    return Node({"item": "item", "quote": "quote", "rule": "rule"}.get(kind, "hidden"))


_SCOPED = ("tag", "begin", "end", "macro")


def parse(text: str, depth: int = 0) -> Node:
    """The tree of a text; plain text is a root with one string. Tags that don't match are closed as needed."""
    root = Node("root")
    if not _HINT.search(text):
        if text:
            root.kids.append(text)
        return root
    stack, at = [root], 0
    for m in _TOKEN.finditer(text):
        kind, token = m.lastgroup, m[0]
        if m.start() > at:
            stack[-1].kids.append(text[at : m.start()])
        at = m.end()
        if kind not in _SCOPED:
            stack[-1].kids.append(_leaf(kind, token, depth))
        elif kind == "macro":
            stack[-1].kids.append(Node("hidden"))
        elif kind in ("begin", "end"):
            name = re.search(r"\{([A-Za-z]+)", token)[1]
            if kind == "begin":
                node = Node("env", attr=name)
                stack[-1].kids.append(node)
                stack.append(node)
            elif any(n.tag == "env" and n.attr == name for n in stack):
                while stack.pop().attr != name:
                    pass
            else:
                stack[-1].kids.append(Node("hidden"))
        else:
            name = re.match(r"</?([\w:-]+)", token)[1].lower()
            if token[1] == "/":
                if any(n.tag == name for n in stack[1:]):
                    while stack.pop().tag != name:
                        pass
                else:
                    stack[-1].kids.append(Node("hidden"))
            else:
                title = re.search(r'(?:content-title|page-title|alt)="([^"]*)"', token)
                node = Node(name, [html.unescape(title[1])] if title and name in ("ri:page", "ac:link", "img") else [], token)
                stack[-1].kids.append(node)
                if name not in VOID and not token.endswith("/>") and len(stack) < 200:
                    stack.append(node)
    if at < len(text):
        stack[-1].kids.append(text[at:])
    return root


def has_markup(tree: Node) -> bool:
    return any(isinstance(k, Node) for k in tree.kids)


def render(tree: Node, template: dict[str, str] | None = None) -> str:
    """Clean text: headings as #, items as -, quotes as >, code fenced, cells parted by |, formulas in $, labels of links.

    ``template`` maps paths of nodes to the constant text that is left out there.
    """
    out: list[str] = []

    def block() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    def walk(n: Node, path: str) -> None:
        if n.tag in HIDDEN or n.tag == "hidden" or template and template.get(path) is not None and n.text().strip() == template[path]:
            return
        own = n.tag in BLOCKS or n.tag in ("rule", "env")
        if own:
            block()
        if re.fullmatch("h[1-6]", n.tag):
            out.append("#" * int(n.tag[1]) + " ")
        elif n.tag in ("li", "item"):
            block()
            out.append("- ")
        elif n.tag in ("quote", "blockquote"):
            out.append("> ")
        elif n.tag == "pre":
            out.append(f"```{n.attr if n.attr[:1] != '<' else ''}\n{n.text().strip(chr(10))}\n```\n")
            return
        elif n.tag == "code":
            out.append(f"`{n.text()}`")
            return
        elif n.tag in ("math", "display"):
            out.append(f"{'$$' if n.tag == 'display' else '$'}{n.text().strip()}{'$$' if n.tag == 'display' else '$'}")
            return
        elif n.tag == "br":
            out.append("\n")
        i = 0
        for k in n.kids:
            if isinstance(k, str):
                out.append(k.lstrip() if out and out[-1].endswith(("- ", "> ", "# ")) else k.lstrip("\n") if out and out[-1].endswith("\n") else k)
            else:
                if n.tag == "tr" and k.tag in ("td", "th") and i:
                    out.append(" | ")
                walk(k, f"{path}/{i}")
                i += 1
        if own:
            block()

    walk(tree, "")
    s = "".join(out).replace("\u00a0", " ")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", s)).strip()


def shape(n: Node) -> str:
    """The tree of tags without texts."""
    return n.tag + ("(" + ",".join(shape(k) for k in n.kids if isinstance(k, Node)) + ")" if any(isinstance(k, Node) for k in n.kids) else "")


def unshape(s: str) -> Node:
    """The tree of a shape."""
    top = Node("")
    stack, last = [top], top
    for m in re.finditer(r"[^(),]+|[()]", s):
        if m[0] == "(":
            stack.append(last)
        elif m[0] == ")":
            stack.pop()
        else:
            last = Node(m[0])
            stack[-1].kids.append(last)
    return top.kids[0]


def outline(tree: Node) -> str:
    """The tags of the first two levels, equal ones in a row once: what pages of one kind share."""

    def tags(n: Node) -> list[str]:
        out: list[str] = []
        for k in n.kids:
            if isinstance(k, Node) and out[-1:] != [k.tag]:
                out.append(k.tag)
        return out

    inner = [f"{k.tag}({','.join(tags(k))})" for k in tree.kids if isinstance(k, Node)]
    return " ".join(x for i, x in enumerate(inner) if x not in inner[i - 1 : i])


def match_trees(a: Node, b: Node) -> list[tuple[str, str]]:
    """Simple tree matching: the pairs of node paths in the largest order-keeping, level-keeping alignment."""
    if shape(a) == shape(b):
        return [(p, p) for p, _ in _paths(a)]
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def kids(n: Node) -> list[Node]:
        return [k for k in n.kids if isinstance(k, Node)]

    def size(x: Node, y: Node) -> int:
        if x.tag != y.tag:
            return 0
        key = (id(x), id(y))
        if key not in memo:
            p, q = kids(x), kids(y)
            best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
            for i, u in enumerate(p, 1):
                for j, v in enumerate(q, 1):
                    best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + size(u, v))
            memo[key] = (best[-1][-1] + 1, best)
        return memo[key][0]

    def pairs(x: Node, y: Node, at: str, to: str, out: list) -> None:
        out.append((at, to))
        p, q, best = kids(x), kids(y), memo[(id(x), id(y))][1]
        i, j = len(p), len(q)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs(p[i], q[j], f"{at}/{i}", f"{to}/{j}", out)

    if not size(a, b):
        return []
    out: list[tuple[str, str]] = []
    pairs(a, b, "", "", out)
    return out


def _paths(n: Node) -> Iterator[tuple[str, Node]]:
    stack = [("", n)]
    while stack:
        at, x = stack.pop()
        yield at, x
        stack.extend((f"{at}/{i}", k) for i, k in enumerate(k for k in x.kids if isinstance(k, Node)))


def _is_page(tree: Node) -> bool:
    """Whether a text is one of HTML elements: other texts have no DOM to align."""
    return any(n.tag in ELEMENTS for n in tree.nodes())


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every HTML text its outline, its shape and the texts of its nodes."""
    for pdf in batches:
        rows = []
        for host, text in pdf[["host", "text"]].itertuples(index=False, name=None):
            tree = parse(text)
            if _is_page(tree):
                rows.append((host, outline(tree), shape(tree), [{"path": p, "node_text": t} for p, n in _paths(tree) if p and (t := n.text().strip())]))
        yield pd.DataFrame(rows, columns=["host", "outline", "shape", "nodes"])


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        trees: dict[str, Node] = {}
        pairs = [match_trees(unshape(a), trees.setdefault(b, unshape(b))) for a, b in zip(pdf["shape"], pdf["leader"], strict=True)]
        yield pdf[["host", "outline", "shape"]].assign(pairs=[{own: to for own, to in p} for p in pairs])


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """host, shape, template (path of a node -> the text that is template there) of all shapes that have any.

    ``pages``: host, text (not null). Copies of a page count once: they say nothing about
    what varies. Pages, shapes and node texts are counted by partial aggregates, so
    a host with a third of all pages is no heavier than others. A shape is aligned
    once, not once a page.
    """
    marked = pages.where(F.col("text").rlike(r"<[A-Za-z]")).select("host", "text").distinct()
    parsed = cut(marked.mapInPandas(_pages, "host string, outline string, shape string, nodes array<struct<path:string,node_text:string>>"))
    shapes = parsed.groupBy("host", "outline", "shape").agg(F.count("*").alias("n"))
    kinds = shapes.groupBy("host", "outline").agg(F.sum("n").alias("n_pages"), F.max(F.struct("n", "shape")).alias("top")).where(F.col("n_pages") >= SUPPORT)
    kinds = kinds.select("host", "outline", "n_pages", F.col("top.shape").alias("leader"))
    aligned = cut(shapes.drop("n").join(kinds, ["host", "outline"]).mapInPandas(_align, "host string, outline string, shape string, pairs map<string,string>"))
    of_page = parsed.join(aligned, ["host", "outline", "shape"])
    texts = of_page.select("host", "outline", "pairs", F.explode("nodes").alias("x")).select("host", "outline", F.col("pairs")[F.col("x.path")].alias("path"), F.col("x.node_text").alias("node_text")).where("path IS NOT NULL")
    counted = texts.groupBy("host", "outline", "path", "node_text").agg(F.count("*").alias("n"))
    top = counted.groupBy("host", "outline", "path").agg(F.max(F.struct("n", "node_text")).alias("top")).join(kinds, ["host", "outline"])
    constant = top.where((F.col("top.n") >= SUPPORT) & (F.col("top.n") >= F.col("n_pages") * CONSTANT)).select("host", "outline", "path", F.col("top.node_text").alias("node_text"))
    own = aligned.select("host", "outline", "shape", F.explode("pairs").alias("own", "path")).join(constant, ["host", "outline", "path"])
    return own.groupBy("host", "shape").agg(F.map_from_entries(F.collect_list(F.struct("own", "node_text"))).alias("template"))


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text rendered with all its nodes as slots, and the shape of those that are pages; a text is parsed once a task."""
    known: dict[str, tuple] = {}
    for b in batches:
        out = []
        for text in b.column("text").to_pylist():
            if text is None:
                out.append((None, 0, None, None))
                continue
            if (got := known.get(text)) is None:
                tree = parse(text)
                n = sum(1 for _ in tree.nodes()) - 1
                page = n > 0 and _is_page(tree)
                got = (render(tree) if n else text, n, shape(tree) if page else None, text if page else None)
                if len(known) > 200_000:
                    known.clear()
                known[text] = got
            out.append(got)
        clean, n, shapes, pages = zip(*out, strict=True) if out else ((), (), (), ())
        keys = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(clean, pa.string()), pa.array(n, pa.int32()), pa.array(shapes, pa.string()), pa.array(pages, pa.string())], [*keys, "clean", "n_nodes", "shape", "page"])


def _without_template(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        clean, left_out = b.column("clean").to_pylist(), [0] * b.num_rows
        for i, (page, template) in enumerate(zip(b.column("page").to_pylist(), b.column("template").to_pylist(), strict=True)):
            if page is not None and template:
                tree, fixed = parse(page), dict(template)
                clean[i], left_out[i] = render(tree, fixed), sum(1 for p, n in _paths(tree) if p in fixed and n.text().strip() == fixed[p])
        keys = [c for c in b.schema.names if c not in ("clean", "n_nodes", "page", "template")]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(clean, pa.string()), b.column("n_nodes"), pa.array(left_out, pa.int32())], [*keys, "clean", "n_nodes", "n_template"])


def to_text(records: DataFrame, host: Column, text: Column, keys: list[str]) -> DataFrame:
    """``keys`` with clean (the text), marked (whether it held markup), n_template and n_slots (nodes left out, and the others).

    Null texts stay null, empty and plain ones as they are; repeated rows stay repeated.
    A null host is a host of its own. Other columns aren't read.
    """
    pages = records.select(*keys, F.coalesce(host, F.lit("")).alias("_host"), text.alias("text"))
    templates = cut(induce_wrappers(pages.where("text IS NOT NULL").select(F.col("_host").alias("host"), "text")))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.drop("text").schema)
    done = pages.mapInArrow(_convert, f"{types}, clean string, n_nodes int, shape string, page string")
    bytes_ = templates.agg(F.sum(F.length(F.to_json(F.struct("host", "shape", "template"))))).first()[0] or 0
    if not bytes_:
        done = done.withColumn("n_template", F.lit(0))
    else:
        t = templates.select(F.col("host").alias("_host"), "shape", "template")
        if bytes_ <= BROADCAST_BYTES:
            done = done.join(F.broadcast(t), ["_host", "shape"], "left")
        else:  # only pages move, by host and shape
            done = cut(done)
            done = done.where("shape IS NOT NULL").join(t, ["_host", "shape"], "left").unionByName(done.where("shape IS NULL").withColumn("template", F.lit(None).cast("map<string,string>")))
        done = done.select(*keys, "clean", "n_nodes", "page", "template").mapInArrow(_without_template, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pages.select(*keys).schema)}, clean string, n_nodes int, n_template int")
    slots = F.greatest(F.col("n_nodes") - F.col("n_template"), F.lit(0))
    return done.select(*keys, "clean", ((slots > 0) | (F.col("n_template") > 0)).alias("marked"), "n_template", slots.alias("n_slots"))


def clean_records(slack_messages: DataFrame, remote_items: DataFrame) -> DataFrame:
    """Every message text and item title: record_table, record_id, clean, marked, n_template, n_slots; hosts are channels and sources."""
    m = slack_messages.select(F.lit("slack_messages").alias("record_table"), F.col("msg_id").alias("record_id"), F.concat(F.lit("chat:"), "channel_id").alias("_host"), F.col("text").alias("_text"))
    t = remote_items.select(F.lit("remote_items").alias("record_table"), F.col("feed_id").alias("record_id"), F.concat(F.lit("item:"), "source_name").alias("_host"), F.col("title").alias("_text"))
    return to_text(m.unionByName(t), F.col("_host"), F.col("_text"), ["record_table", "record_id"])


def clean_pages(documents: DataFrame) -> DataFrame:
    """Every wiki document: doc_id, clean, marked, n_template, n_slots; hosts are the wikis."""
    return to_text(documents.where("source_type = 'confluence'"), F.col("source"), F.col("text"), ["doc_id"])
