"""Source code: Python by its own grammar, Rust and TypeScript by declarations and braces.

No grammar library is at hand for the latter, so they are scanned: strings and comments
are blanked, declarations found where a statement may begin (at the start of a line, after
a brace, a semicolon or an attribute), and their ends by matching braces. Python with a
syntax error is scanned too, by its declarations and their indentation. ``register``
adds a parser for further extensions.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from waymark.functions.keys import CONFIG_EXTENSIONS, CONFIG_STEMS, LANGUAGES
from waymark.sources.parsers import Parsed


def language(path: str) -> str:
    return LANGUAGES.get(path.rsplit(".", 1)[-1], "unknown")


def doc_type(path: str) -> str | None:
    """test_file, config_file or source_file by the name; None where there is no stem, or no extension and no test's name."""
    name = path.rsplit("/", 1)[-1]
    stem, _, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
    if not stem:
        return None
    if stem.endswith(("_test", "_tests", "_spec", ".test", ".spec")) or stem.startswith("test_") or stem == "tests" or "/tests/" in path or "/test/" in path:
        return "test_file"
    if not ext:
        return None
    return "config_file" if ext in CONFIG_EXTENSIONS or stem in CONFIG_STEMS or stem.startswith(".") else "source_file"


def _python(text: str, out: Parsed) -> None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _python_lines(text, out)
    lines = [0]
    for line in text.encode().splitlines(keepends=True):
        lines.append(lines[-1] + len(line))
    b = text.encode()
    offset = lambda line, col: lines[line - 1] + col  # noqa: E731  (ast columns are bytes)
    public = lambda name: "private" if name.startswith("_") else "public"

    def visit(body: list, depth: int) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([n, *n.decorator_list], key=lambda x: x.lineno)
                start = offset(first.lineno, first.col_offset - (1 if first is not n else 0))
                end = offset(n.end_lineno, n.end_col_offset)
                head = offset(n.lineno, n.col_offset)
                signature = b[head : offset(n.body[0].lineno, n.body[0].col_offset)].decode("utf-8", "replace").split('"""')[0].strip().rstrip(":").strip()
                is_class = isinstance(n, ast.ClassDef)
                out.chunk(start, end, "class" if is_class else "method" if depth else "function", n.name, depth, signature, "python", public(n.name))
                out.tag("kind:class" if is_class else "kind:method" if depth else "kind:function")
                if isinstance(n, ast.AsyncFunctionDef):
                    out.tag("async:true")
                if n.name.startswith("test_"):
                    out.tag("kind:test")
                for d in n.decorator_list:
                    name = ast.unparse(d)
                    for on, t in ((name.startswith("pytest.fixture"), "fixture"), (name.startswith(("app.route", "router.")), "route"), (name in ("staticmethod", "classmethod", "property"), name)):
                        if on:
                            out.tag(f"convention:{t}")
                if is_class:
                    visit(n.body, depth + 1)
            elif isinstance(n, ast.Import):
                out.links.append((n.names[0].name.split(".")[0], None, offset(n.lineno, n.col_offset)))
            elif isinstance(n, ast.ImportFrom) and not n.level and n.module:
                out.links.append((n.module.split(".")[0], None, offset(n.lineno, n.col_offset)))
            elif isinstance(n, ast.Assign) and not depth and isinstance(n.targets[0], ast.Name) and _constant(n.targets[0].id):
                out.chunk(offset(n.lineno, n.col_offset), offset(n.end_lineno, n.end_col_offset), "constant", n.targets[0].id, depth, None, "python", public(n.targets[0].id))

    visit(tree.body, 0)


def _constant(name: str) -> bool:
    return all(c.isupper() or c == "_" or c.isdigit() for c in name)


_PY = re.compile(r"^(?P<indent>[ \t]*)(?:(?P<async>async[ \t]+)?(?P<kw>def|class)[ \t]+(?P<name>\w+)|(?P<const>\w+)[ \t]*(?::[^=\n]*)?=(?!=)|import[ \t]+(?P<module>\w+)|from[ \t]+(?P<source>\w[\w.]*)[ \t]+import\b)", re.M)


def _python_lines(text: str, out: Parsed) -> None:
    """What the grammar refuses: declarations by their lines; one ends before the next line that isn't blank and stands no deeper."""
    size = lambda s: len(s.encode())
    open_: list[tuple[int, str]] = []  # indentation and keyword of what encloses a line
    for m in _PY.finditer(text):
        indent = len(m["indent"].expandtabs())
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        start = m.end("indent")
        if m["module"] or m["source"]:
            out.links.append(((m["module"] or m["source"]).split(".")[0], None, size(text[:start])))
            continue
        if m["const"]:
            if not open_ and not indent and _constant(m["const"]):
                end = text.find("\n", start)
                out.chunk(size(text[:start]), size(text[: end if end >= 0 else len(text)]), "constant", m["const"], 0, None, "python", "private" if m["const"].startswith("_") else "public")
            continue
        inside = [kw for _, kw in open_]
        open_.append((indent, m["kw"]))
        if "def" in inside:
            continue
        end = len(text)
        for line in re.finditer(r"^([ \t]*)[^\s#]", text[m.end() :], re.M):
            if line.start() and len(line[1].expandtabs()) <= indent:
                end = m.end() + line.start()
                break
        kind = "class" if m["kw"] == "class" else "method" if inside else "function"
        head = text[start : text.find("\n", start) if "\n" in text[start:] else len(text)].strip().rstrip(":").strip()
        out.chunk(size(text[:start]), size(text[:end].rstrip()), kind, m["name"], len(inside), head, "python", "private" if m["name"].startswith("_") else "public")
        out.tag(f"kind:{kind}")
        if m["async"]:
            out.tag("async:true")
        if m["name"].startswith("test_"):
            out.tag("kind:test")


_HIDE = re.compile(rb'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\\n])\'|`(?:\\.|[^`\\])*`', re.S)
_TS_HIDE = re.compile(rb'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', re.S)


def _blank(b: bytes, pattern: re.Pattern) -> bytes:
    return pattern.sub(lambda m: re.sub(rb"[^\n]", b" ", m[0]), b)


def _close(b: bytes, at: int) -> tuple[int, int]:
    """(start of the body or -1, end) of a declaration that starts at ``at``: its braces, or its semicolon."""
    depth = 0
    for m in re.finditer(rb"[{};()\[\]]", b[at:]):
        c, i = m[0], at + m.start()
        if c in b"([":
            depth += 1
        elif c in b")]":
            depth -= 1
        elif c == b";" and depth <= 0:
            return -1, i + 1
        elif c == b"{" and depth <= 0:
            open_braces = 0
            for k in re.finditer(rb"[{}]", b[i:]):
                open_braces += 1 if k[0] == b"{" else -1
                if not open_braces:
                    return i, i + k.end()
            return i, len(b)
        elif c == b"}" and depth <= 0:
            return -1, i
    return -1, len(b)


_BEGIN = rb"(?:^|(?<=[{};\]]))[ \t]*"
_RUST = re.compile(_BEGIN + rb"(?P<vis>pub(?:\([^)]*\))?\s+)?(?:(?:default|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*(?P<async>async\s+)?(?:unsafe\s+)?(?P<kw>fn|struct|enum|trait|mod|const|static|impl|use)\b(?P<rest>[^\n{;]*)", re.M)
#: The kind of chunk of each declaration, and its tag.
_RUST_TAG = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait"}
_RUST_KIND = {"fn": "function", "struct": "class", "enum": "class", "trait": "class", "mod": "module", "const": "constant", "static": "constant"}


def _rust(b: bytes, out: Parsed) -> None:
    hidden = _blank(b, _HIDE)

    def visit(lo: int, hi: int, depth: int, owner: str | None) -> None:
        at = lo
        while m := _RUST.search(hidden, at, hi):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            kw, rest = m["kw"].decode(), m["rest"].decode("utf-8", "replace").strip()
            if kw == "const" and rest.startswith("fn"):
                kw, rest = "fn", rest[2:].strip()
            body, end = _close(hidden, m.end("kw"))
            end = min(end, hi)
            at = max(end, m.end())
            if kw == "use":
                first = re.match(r"(?:::)?(\w+)", rest)
                if first and first[1] not in ("self", "crate", "super"):
                    out.links.append((first[1], None, start))
                continue
            if kw == "impl":
                name = re.sub(r"^<[^>]*>\s*", "", rest).split(" where ")[0].strip()
                if " for " in name:
                    trait, _, kind = name.partition(" for ")
                    name = f"<{kind.strip()} as {trait.strip()}>"
                if body >= 0:
                    visit(body + 1, end - 1, depth + 1, name)
                continue
            name = re.match(r"(?:mut\s+)?(\w+)", rest)
            if name is None or owner and kw != "fn":
                continue
            vis = m["vis"].decode() if m["vis"] else ""
            visibility = "internal" if "crate" in vis else "public" if vis else "private"
            signature = b[start : body if body >= 0 else end].decode("utf-8", "replace").strip()
            if kw not in ("fn",):
                signature = signature.split("\n")[0]
            kind = "method" if kw == "fn" and owner else _RUST_KIND[kw]
            out.chunk(start, end, kind, f"{owner}::{name[1]}" if owner else name[1], depth, signature, "rust", visibility)
            if kw in _RUST_TAG:
                out.tag("kind:method" if owner else f"kind:{_RUST_TAG[kw]}")
            if kw == "fn":
                if m["async"]:
                    out.tag("async:true")
                if name[1].startswith("test_") or re.search(rb"#\[(?:test|tokio::test|rstest)", b[max(0, start - 200) : start]):
                    out.tag("kind:test")
            if kw == "mod" and body >= 0:
                visit(body + 1, end - 1, depth + 1, None)

    visit(0, len(b), 0, None)


_TS = re.compile(_BEGIN + rb"(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?P<async>async\s+)?(?P<kw>function\*?|class|interface|type|enum|const|let|var|import)\b(?P<rest>[^\n]*)", re.M)
_TS_METHOD = re.compile(_BEGIN + rb"(?:(?:public|private|protected|static|readonly|override|get|set)\s+)*(?P<async>async\s+)?\*?(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\([^;{}]*\)[^;{}]*\{", re.M)
_TS_KIND = {"function": "function", "class": "class", "interface": "class", "enum": "class", "type": "constant"}


def _typescript(b: bytes, out: Parsed, name_of_language: str) -> None:
    hidden = _blank(b, _TS_HIDE)
    at = 0
    while m := _TS.search(hidden, at):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        body, end = _close(hidden, m.end("kw"))
        kw, rest = m["kw"].decode().rstrip("*"), hidden[m.start("rest") : min(m.end("rest"), end)].decode("utf-8", "replace").strip()
        at = max(end, m.start("rest"))
        if kw == "import":
            line = b[start : b.find(b"\n", m.end()) if b.find(b"\n", m.end()) > 0 else len(b)]
            target = re.search(rb"""(?:from\s+|import\s+|\(\s*)['"]([^'"]+)['"]""", line) or re.search(rb"""from\s+['"]([^'"]+)['"]""", b[start:end])
            if target and not target[1].startswith((b".", b"/")):
                parts = target[1].decode().split("/")
                out.links.append(("/".join(parts[:2]) if parts[0].startswith("@") else parts[0], None, start))
            at = max(at, start + len(line)) if b";" not in line else end
            continue
        name = re.match(r"([A-Za-z_$][\w$]*)", rest)
        if name is None:
            continue
        kind = _TS_KIND.get(kw) or ("function" if "=>" in hidden[m.start() : body if body >= 0 else end].decode("utf-8", "replace") or re.search(r"=\s*(?:async\s+)?function\b", rest) else "constant")
        signature = b[start : body if body >= 0 and kind != "constant" else end].decode("utf-8", "replace").strip()
        out.chunk(start, end, kind, name[1], 0, signature if kind == "function" else signature.split("\n")[0], name_of_language, "public" if m["export"] else "private")
        if kind != "constant" or kw == "type":
            out.tag("kind:function" if kind == "function" else f"kind:{kw}")
        if m["async"] or re.search(r"=\s*async\b", rest):
            out.tag("async:true")
        if kw == "class" and body >= 0:
            inner = body + 1
            while k := _TS_METHOD.search(hidden, inner, end):
                method = k["name"].decode()
                to_body, to = _close(hidden, k.start("name"))
                inner = max(to, k.end())
                if method in ("if", "for", "while", "switch", "catch", "return"):
                    continue
                first = k.start() + len(k[0]) - len(k[0].lstrip())
                out.chunk(first, min(to, end), "method", method, 1, b[first : to_body if to_body > 0 else to].decode("utf-8", "replace").strip(), name_of_language, "public")
                out.tag("kind:method")
                if k["async"]:
                    out.tag("async:true")


#: Parsers of languages by name, (text, what it fills); see ``register``.
_PARSERS: dict[str, Callable[[str, Parsed], None]] = {
    "python": _python, "rust": lambda text, out: _rust(text.encode(), out), "typescript": lambda text, out: _typescript(text.encode(), out, "typescript"), "javascript": lambda text, out: _typescript(text.encode(), out, "javascript"),
}


def register(name: str, parser: Callable[[str, Parsed], None]) -> None:
    """Let ``parser`` fill in chunks, tags and links of the language ``name`` (see LANGUAGES), in this process and those that unpickle it."""
    _PARSERS[name] = parser


def parse(path: str, text: str) -> Parsed:
    out = Parsed(text)
    lang = language(path)
    out.tag(f"lang:{lang}")
    if lang in _PARSERS:
        _PARSERS[lang](text, out)
    out.auto_type = doc_type(path)
    return out
