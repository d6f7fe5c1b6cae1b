import json

from pyspark.sql import functions as F

from waymark.functions import keys, text
from waymark.sources.files import ignore_regex, ignored, parser_of
from waymark.sources.parsers import chat, code, issue, markdown, parse_files, wiki

NOTE = """---
title: Harbour walk
tags: [coast, boats]
---
# Tides

Low water, see [[MoonTable]] or [[OldPier|the pier behind the mill]]. #ebb-flow

## Moorings

### North wall ###
text
"""


def test_markdown():
    p = markdown.parse("a.md", NOTE)
    assert {"coast", "boats", "ebb-flow"} <= set(p.tags) and [(t, d) for t, d, _ in p.links] == [("MoonTable", None), ("OldPier", "the pier behind the mill")]
    assert [(c[2], c[3], c[4]) for c in p.chunks] == [("frontmatter", None, 0), ("section", "Tides", 1), ("section", "Moorings", 2), ("section", "North wall", 3)]
    b = NOTE.encode()
    assert b[p.chunks[1][0] :].startswith(b"# Tides") and p.chunks[0][1] == p.chunks[1][0] and p.chunks[-1][1] == len(b) and b[p.links[0][2] :].startswith(b"[[MoonTable")
    q = markdown.parse("b.md", "intro é\n\n```\n[[Fake]] #fake\n# not hidden\n```\n[[Real]] #real-tag\n#work/a/b\n")
    assert [t for t, _, _ in q.links] == ["Real"] and set(q.tags) == {"real-tag", "work", "work/a", "work/a/b"} and [c[2] for c in q.chunks] == ["body", "section"]
    assert markdown.parse("t.md", "- [ ] a\n- [x] b\n- [X] c\n").auto_type == "task" and markdown.parse("m.md", "".join(f"[[n{i}]]\n" for i in range(6))).auto_type == "moc"
    assert markdown.parse("r.md", "---\nurl: http://x\n---\nx").auto_type == "reference" and markdown.parse("e.md", "").chunks == [] and markdown.parse("n.md", "x").auto_type is None


PY = '''import os, sys
from json import loads
from . import near
LIMIT = 3

@pytest.fixture
async def test_one(a, b=2):
    """Doc."""
    def inner(): pass
    return a

class Thing:
    @property
    def _hidden(self): return 1
'''
RUST = """use std::fs;
use crate::x;
pub(crate) struct A { x: u8 }
impl Tr for A {
    pub async fn m(&self) -> u8 { if true { "}" } else { 1 } }
}
#[test]
fn works() {}
mod inner { pub const K: u8 = 1; }
"""
TS = """import { a } from '@scope/pkg/deep';
import b from './near';
export async function go(x: number): number { return `${x}`; }
const f = (x) => { return x; };
export class C extends D {
  async run(y) { if (y) { return 1; } }
}
interface I { a: string }
"""


def test_code():
    p = code.parse("/src/test_a.py", PY)
    assert [t for t, _, _ in p.links] == ["os", "json"] and p.auto_type == "test_file" and {"lang:python", "async:true", "convention:fixture", "convention:property", "kind:test"} <= set(p.tags)
    assert [(c[2], c[3], c[4], c[7]) for c in p.chunks] == [("constant", "LIMIT", 0, "public"), ("function", "test_one", 0, "public"), ("class", "Thing", 0, "public"), ("method", "_hidden", 1, "private")]
    assert PY.encode()[p.chunks[1][0] : p.chunks[1][1]].decode().startswith("@pytest") and p.chunks[1][5] == "async def test_one(a, b=2)"
    r = code.parse("a.rs", RUST)
    assert [t for t, _, _ in r.links] == ["std"] and [(c[2], c[3], c[4], c[7]) for c in r.chunks] == [("class", "A", 0, "internal"), ("method", "<A as Tr>::m", 1, "public"), ("function", "works", 0, "private"), ("module", "inner", 0, "private"), ("constant", "K", 1, "public")]
    assert {"lang:rust", "kind:struct", "kind:method", "async:true", "kind:test"} <= set(r.tags) and not {"kind:class", "kind:module", "kind:constant"} & set(r.tags)
    t = code.parse("a.ts", TS)
    assert [x for x, _, _ in t.links] == ["@scope/pkg"] and [(c[2], c[3], c[4]) for c in t.chunks] == [("function", "go", 0), ("function", "f", 0), ("class", "C", 0), ("method", "run", 1), ("class", "I", 0)]
    assert code.parse("x.py", "def (").chunks == [] and code.doc_type("Makefile") is None and code.doc_type("tests") == "test_file" and code.doc_type("Cargo.toml") == "config_file" and code.doc_type("src/a.rs") == "source_file"


def shown(p):
    return [(c[2], c[3], c[4], c[7]) for c in p.chunks]


def test_rust_layouts():
    p = code.parse("a.rs", "pub struct S; #[derive(Debug)] pub enum Tint { Warm, Cold } pub trait Draw { fn draw(&self, t: Tint); }\nimpl S { pub fn make() -> Self { S } const N: u8 = 1; fn more(&mut self) { self.n += 1; } }\nimpl<T> Draw for Wrap<T> { fn draw(&self, t: Tint) {} }\n")
    assert shown(p) == [("class", "S", 0, "public"), ("class", "Tint", 0, "public"), ("class", "Draw", 0, "public"), ("method", "S::make", 1, "public"), ("method", "S::more", 1, "private"), ("method", "<Wrap<T> as Draw>::draw", 1, "private")]
    assert [t for t in p.tags if t.startswith("kind:")] == ["kind:struct", "kind:enum", "kind:trait", "kind:method"]
    p = code.parse("b.rs", "pub const MOST: usize = 9; static SEEN: u32 = 0;\nmod outer { pub fn inner_fn() {} mod deep { fn low() {} } }\nuse std::io::{self, Read}; use serde::Deserialize; use super::x;\npub fn open(p: &str) -> String { format!(\"{}; fn no() {{}}\", p) }\n")
    assert shown(p) == [("constant", "MOST", 0, "public"), ("constant", "SEEN", 0, "private"), ("module", "outer", 0, "private"), ("function", "inner_fn", 1, "public"), ("module", "deep", 1, "private"), ("function", "low", 2, "private"), ("function", "open", 0, "public")]
    assert [t for t, _, _ in p.links] == ["std", "serde"] and "-> String" in p.chunks[-1][5]
    dashes = "\u2500" * 120
    assert [c[3] for c in code.parse("c.rs", f"//! {dashes}\n\nfn tiny() {{}}\n\n// {dashes}\nasync fn later() {{}}\n").chunks] == ["tiny", "later"]
    assert "kind:test" in code.parse("d.rs", "#[tokio::test]\nasync fn waits() { let x = 1; }\n").tags and "kind:test" not in code.parse("d.rs", "pub fn latest() -> u8 { 4 }\n").tags


def test_typescript_layouts():
    p = code.parse("a.ts", "export interface Shape { sides: number; }\nexport type Id = string; interface Own { x: boolean; }\nexport enum Way { In, Out }\nexport const load = async (u: string) => { const r = await get(u); return r; };\nconst few = () => 42; const LIMIT = 3;\n")
    assert shown(p) == [("class", "Shape", 0, "public"), ("constant", "Id", 0, "public"), ("class", "Own", 0, "private"), ("class", "Way", 0, "public"), ("function", "load", 0, "public"), ("function", "few", 0, "private"), ("constant", "LIMIT", 0, "private")]
    assert {"kind:interface", "kind:type", "kind:enum", "kind:function", "async:true"} <= set(p.tags) and "kind:constant" not in p.tags
    p = code.parse("b.ts", "export class Store {\n  constructor(private db: Db) {}\n  async find(id: string): Promise<X> { return this.db.find(id); } drop(id: string): void { this.db.drop(id); }\n}\n")
    assert shown(p) == [("class", "Store", 0, "public"), ("method", "constructor", 1, "public"), ("method", "find", 1, "public"), ("method", "drop", 1, "public")]
    p = code.parse("c.tsx", "import { u } from 'react';\nimport x from 'express';\nimport { y } from './near';\nimport { z } from '@scope/pkg';\nexport function App({ name }: Props) { return <div>Hi, {name}!</div>; }\n")
    assert [t for t, _, _ in p.links] == ["react", "express", "@scope/pkg"] and shown(p) == [("function", "App", 0, "public")]


def test_python_layouts():
    p = code.parse("a.py", "import sys\nfrom collections.abc import Iterable\nfrom .near import x\nMOST = 9\n_OWN = True\nlower = 1\n\ndef greet(n: str) -> str:\n    return n\n\nclass Users:\n    def __init__(self):\n        pass\n\n    async def find(self):\n        pass\n")
    want = [("constant", "MOST", 0, "public"), ("constant", "_OWN", 0, "private"), ("function", "greet", 0, "public"), ("class", "Users", 0, "public"), ("method", "__init__", 1, "private"), ("method", "find", 1, "public")]
    assert shown(p) == want and [t for t, _, _ in p.links] == ["sys", "collections"] and "kind:constant" not in p.tags
    broken = code.parse("a.py", p.text + "\ndef é(:\n    x = (\n\ndef test_last():\n    return 1\n")
    assert shown(broken) == [*want, ("function", "é", 0, "public"), ("function", "test_last", 0, "public")] and [t for t, _, _ in broken.links] == ["sys", "collections"] and {"async:true", "kind:test", "kind:class"} <= set(broken.tags)
    assert [c[:2] for c in broken.chunks[:5]] == [c[:2] for c in p.chunks[:5]] and broken.text.encode()[broken.chunks[-1][0] :].startswith(b"def test_last")


def test_register():
    code.register("go", lambda text, out: out.chunk(0, len(text), "function", "main", 0, None, "go", "public"))
    try:
        assert shown(code.parse("m.go", "func main() {}")) == [("function", "main", 0, "public")]
    finally:
        del code._PARSERS["go"]


def test_records():
    page = {"id": 1, "title": "Réunion", "space": {"key": "OPS"}, "body": {"storage": {"value": "<p>Lead</p><h1>One &amp; two</h1><p>é <a href='/x'>label</a></p><ac:link ac:page-title=\"Other\"/>"}}, "metadata": {"labels": {"results": [{"name": "l1"}]}}, "ancestors": [{"title": "Team Home"}]}
    w = wiki.parse("x.confluence", json.dumps(page))
    assert [(c[3], c[4]) for c in w.chunks] == [("Réunion", 1), ("One & two", 1)] and {"confluence:space:OPS", "tag:l1", "confluence:parent:team-home"} <= set(w.tags) and [t for t, _, _ in w.links] == ["/x", "Other"]
    assert w.text.encode()[w.chunks[1][0] : w.chunks[1][1]].decode().startswith("One & two\né label") and w.auto_type == "note"
    adf = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "c"}]}]}
    i = issue.parse("x.jira", json.dumps({"key": "K-1", "fields": {"summary": "S", "description": adf, "status": {"name": "In Progress"}, "issuetype": {"name": "Bug"}, "project": {"key": "K"}, "labels": ["x"], "issuelinks": [{"outwardIssue": {"key": "K-2"}}], "comment": {"comments": [{"author": {"displayName": "Ann"}, "body": "hi"}]}}}))
    assert issue.paragraphs(adf) == ["a b", "c"] and len(i.chunks) == 4 and {"jira:status:in-progress", "jira:type:bug", "jira:project:K", "tag:x"} <= set(i.tags) and i.links[0][0] == "K-2" and i.auto_type == "bug"
    m = [{"ts": "1", "user": "U1", "text": "<@U2|bo> <https://x|l>", "reactions": [{"name": "ok", "count": 2}]}, {"ts": "2", "thread_ts": "1", "username": "bo", "text": "re"}, {"ts": "3", "subtype": "channel_join", "user": "U9"}]
    c = chat.parse("x.slack", json.dumps({"channel_name": "Ops Room", "date": "2024-01-01", "messages": m}))
    assert len(c.chunks) == 1 and c.text == "[U1] @bo l (https://x)\n  :ok:×2\n  ↳ [bo] re\n" and {"slack:channel:ops-room", "slack:user:bo", "slack:has-threads"} <= set(c.tags) and "slack:user:u9" not in c.tags


def test_parse_files(spark):
    rows = [("/a.md", NOTE.encode(), "markdown"), ("/b.py", PY.encode(), "code"), ("/bad.md", b"\xff\xfe", "markdown"), ("/bad.jira", b"{", "issue"), ("/null.md", None, "markdown"), ("/x.zz", b"", "none")]
    got = {r.file_path: r for r in parse_files(spark.createDataFrame(rows, "file_path string, content binary, parser string")).collect()}
    assert got["/a.md"].error is None and len(got["/a.md"].chunks) == 4 and got["/bad.md"].error == "invalid UTF-8" and got["/bad.jira"].error and got["/null.md"].chunks == [] and got["/x.zz"].error == "no parser"


def test_expressions(spark):
    d = spark.createDataFrame([("Héllo, World! 2",)], "s string")
    one = lambda c: d.select(c).first()[0]
    assert one(text.slug(F.col("s"))) == "héllo--world--2" and one(text.strip_tags(F.lit("<p>a</p> <b> b"))) == "a b" and one(text.attribute(F.lit('<a href="x">'), "href")) == "x"
    assert one(text.parent_folder(F.lit("/a/b.md"))) == "/a" and one(text.parent_folder(F.lit("/b"))) == "/" and one(text.parent_folder(F.lit("b"))) == "" and one(text.file_stem(F.lit("/x/.env"))) == ".env" and one(text.extension(F.lit("a.tar.gz"))) == "gz"
    assert one(text.iso_seconds(F.lit("2024-01-02T03:04:05.678+09:00"))) == 1704164645 and one(text.iso_seconds(F.lit("x"))) is None and one(text.day_seconds(F.lit("1970-01-03"))) == 172800 and one(text.utc_day(F.lit(172800))) == "1970-01-03"
    assert one(text.strict_base64(F.lit("aGk="))) == b"hi" and one(text.strict_base64(F.lit("aG"))) is None and one(text.flatten_tag(F.lit("a/b/c"))) == ["a", "a/b", "a/b/c"]
    assert [one(keys.size_tag(F.lit("x" * n))) for n in (5, 1023, 1024, 10240, 10241)] == ["size:small", "size:small", "size:medium", "size:medium", "size:large"]
    assert [one(keys.complexity_tag(F.lit(n), F.lit(k))) for n, k in ((2, 1), (6, 2), (15, 2), (3, 5))] == ["complexity:low", "complexity:medium", "complexity:high", "complexity:high"]
    names = {"src/auth_test.rs": ["convention:test"], "tests/integration.rs": ["convention:test"], "Cargo.toml": ["convention:config"], "README.md": ["convention:readme"], "docs/a.md": ["convention:docs"], "src/main.rs": []}
    assert all(one(keys.convention_tags(F.lit(p))) == t for p, t in names.items())
    assert one(keys.topic_tags(F.lit("JWT login"))) == ["topic:auth"] and one(keys.language_of(F.lit("a.tsx"))) == "typescript" and len(one(keys.config_hash())) == 16
    assert one(keys.infer_source(F.array(F.lit("x"), F.lit("source:wiki")))) == "wiki" and one(keys.infer_source(F.array(F.lit("lang:x")))) == "code" and one(keys.infer_source(F.array().cast("array<string>"))) == "obsidian"
    t = keys.RuleTagger.load({"name": "r", "rules": [{"match": {"folder": "infra/**", "has_tag": "q:todo"}, "add_tags": ["a"]}, {"match": {"extension": ".tf"}, "add_tags": ["b", "c"]}, {"match": {"content_contains": "aws"}, "add_tags": ["d"]}]})
    assert one(t.tags(F.lit("infra/x/y.tf"), F.lit("no"), F.array(F.lit("q:todo")))) == ["a", "b", "c"] and one(t.tags(F.lit("y.py"), F.lit("aws_x"), F.array().cast("array<string>"))) == ["d"]
    rules = ignore_regex(["# c", "*.log", "/build/", "!keep.log", "a/**/z"])
    assert [one(ignored(F.lit(p), rules)) for p in ("x/y.log", "build/a", "x/build/a", "keep.log", "a/b/c/z", "q.md")] == [True, True, False, False, True, False]
    assert [one(parser_of(F.lit(p))) for p in ("a.MD", "a.rs", "a.RS", "k.jira", "x")] == ["markdown", "code", None, "issue", None]
