"""Parsers: a path and its bytes become chunks, tags, links and a document type.

A parser is a pure function (path, text) -> Parsed. ``parse_files`` runs the right one
over a file table in Arrow batches; a file that can't be parsed has an error instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from waymark.functions.keys import RuleTagger

PARSED = (
    "file_path string, parser string, text string, chunks array<struct<byte_start:long,byte_end:long,kind:string,label:string,depth:int,signature:string,language:string,visibility:string>>, "
    "tags array<string>, links array<struct<target:string,display:string,byte_offset:long>>, auto_type string, frontmatter string, error string"
)


@dataclass
class Parsed:
    """``text`` is what the byte ranges refer to: the file's own text, or that made of a remote record."""

    text: str
    chunks: list[tuple] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    links: list[tuple] = field(default_factory=list)
    auto_type: str | None = None
    frontmatter: str | None = None

    def chunk(self, start: int, end: int, kind: str, label: str | None, depth: int, signature: str | None = None, language: str | None = None, visibility: str | None = None) -> None:
        self.chunks.append((start, end, kind, label, depth, signature, language, visibility))

    def tag(self, *tags: str) -> None:
        self.tags.extend(t for t in dict.fromkeys(tags) if t not in self.tags)


class ParseError(ValueError):
    """The content is no text or record of its kind."""


Parser = Callable[[str, str], Parsed]


def parsers() -> dict[str, Parser]:
    from waymark.sources.parsers import chat, code, issue, markdown, wiki

    return {"markdown": markdown.parse, "code": code.parse, "wiki": wiki.parse, "issue": issue.parse, "chat": chat.parse}


def parse_files(files: DataFrame, extra: dict[str, Parser] | None = None) -> DataFrame:
    """file_path, parser, text, chunks, tags, links, auto_type, frontmatter, error of a file table (file_path, content, parser)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = parsers() | (extra or {})
        for pdf in batches:
            rows = []
            for path, content, name in pdf.itertuples(index=False, name=None):
                try:
                    if name not in known:
                        raise ParseError("no parser")
                    p = known[name](path, bytes(content or b"").decode("utf-8"))
                    rows.append((path, name, p.text, p.chunks, p.tags, p.links, p.auto_type, p.frontmatter, None))
                except (ParseError, UnicodeDecodeError, RecursionError) as e:
                    rows.append((path, name, None, [], [], [], None, None, "invalid UTF-8" if isinstance(e, UnicodeDecodeError) else str(e)))
            yield pd.DataFrame(rows, columns=["file_path", "parser", "text", "chunks", "tags", "links", "auto_type", "frontmatter", "error"])

    return files.select("file_path", "content", "parser").mapInPandas(run, PARSED)


def keys_of(parsed: DataFrame, doc_ids: DataFrame, rules: Sequence[RuleTagger] = ()) -> DataFrame:
    """doc_id, bitmap_key of parsed files: tags, links, imports of code, folder, source, type, visibility, and what the taggers and ``rules`` add."""
    from waymark.functions.keys import complexity_tag, convention_tags, infer_source, size_tag, topic_tags, with_namespace
    from waymark.functions.text import parent_folder

    p = parsed.where("error IS NULL").join(doc_ids.select("file_path", "doc_id"), "file_path")
    targets = F.transform("links", lambda x: x.target)
    source = infer_source(F.col("tags"))
    imports = F.when(source == "code", F.transform(targets, lambda t: F.concat(F.lit("import:"), t))).otherwise(F.array().cast("array<string>"))
    seen = F.array_distinct(F.filter(F.transform("chunks", lambda c: c.visibility), lambda v: v.isNotNull()))
    own = F.array_compact(F.array(F.concat(F.lit("folder:"), parent_folder(F.col("file_path"))), F.concat(F.lit("source:"), source), F.concat(F.lit("type:"), F.col("auto_type")), size_tag(F.col("text")), complexity_tag(F.size("chunks"), F.array_max(F.transform("chunks", lambda c: c.depth)))))
    every = F.concat(
        with_namespace(F.col("tags")), F.transform(targets, lambda t: F.concat(F.lit("link:"), t)), imports, own, F.transform(seen, lambda v: F.concat(F.lit("visibility:"), v)),
        topic_tags(F.col("text")), convention_tags(F.col("file_path")), *(with_namespace(r.tags(F.col("file_path"), F.col("text"), F.col("tags"))) for r in rules),
    )
    return p.select("doc_id", F.explode(F.array_distinct(every)).alias("bitmap_key"))


def chunk_rows(parsed: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """doc_id and the columns of every chunk, in byte order by position."""
    p = parsed.where("error IS NULL").join(doc_ids.select("file_path", "doc_id"), "file_path")
    return p.select("doc_id", F.posexplode("chunks").alias("position", "c")).select("doc_id", "position", "c.*")


def link_rows(parsed: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """from_id, target_ref, category, kind, byte_offset of every link."""
    from waymark.functions.keys import infer_source
    from waymark.operators.graph import edge_kind

    p = parsed.where("error IS NULL").join(doc_ids.select("file_path", "doc_id"), "file_path")
    category, kind = edge_kind(infer_source(F.col("tags")))
    return p.select(F.col("doc_id").alias("from_id"), category.alias("category"), kind.alias("kind"), F.explode("links").alias("l")).select("from_id", F.col("l.target").alias("target_ref"), "category", "kind", F.col("l.byte_offset").alias("byte_offset"))
