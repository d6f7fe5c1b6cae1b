"""Directory trees as tables, with the ignore rules of ignore files."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.ingest import content_hash, is_pruned
from waymark.runtime import Files

#: The files whose lines name what a walk leaves out.
IGNORE_FILES = (".gitignore", ".waymarkignore")
#: Extensions of each parser; notes in any case, code as written.
PARSERS = {"markdown": ("md",), "code": ("rs", "ts", "tsx", "js", "jsx", "py"), "wiki": ("confluence",), "issue": ("jira",), "chat": ("slack",)}


def parser_of(path: Column) -> Column:
    """The parser for a path, null if there is none."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F.when(F.lower(ext).isin(*PARSERS["markdown"]), "markdown")
    for name in ("code", "wiki", "issue", "chat"):
        out = out.when(ext.isin(*PARSERS[name]), name)
    return out


def ignore_regex(lines: Iterable[str]) -> list[tuple[bool, str]]:
    """(ignored?, regular expression over the relative path) of ignore-file lines, in order; later ones win."""
    out = []
    for line in lines:
        p = line.rstrip("\n").rstrip()
        if not p or p.startswith("#"):
            continue
        keep = p.startswith("!")
        p = p[1:] if keep else p
        only_dir = p.endswith("/")
        p = p.rstrip("/")
        anchored = "/" in p
        p = p.lstrip("/")
        body, i = "", 0
        while i < len(p):
            if p.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif p.startswith("**", i):
                body, i = body + ".*", i + 2
            elif p[i] == "*":
                body, i = body + "[^/]*", i + 1
            elif p[i] == "?":
                body, i = body + "[^/]", i + 1
            else:
                body, i = body + re.escape(p[i]), i + 1
        out.append((not keep, ("^" if anchored else "(?:^|/)") + body + ("/" if only_dir else "(?:/|$)")))
    return out


def ignored(relative: Column, rules: Sequence[tuple[bool, str]]) -> Column:
    out = F.lit(False)
    for on, pattern in rules:
        out = F.when(relative.rlike(pattern), F.lit(on)).otherwise(out)
    return out


def ignore_lines_of(spark: SparkSession, root: str) -> list[str]:
    """The lines of the ignore files at ``root``, in their order; none if there are none."""
    files = Files(spark, root)
    names = [f"{root.rstrip('/')}/{n}" for n in IGNORE_FILES]
    return [line for n in names if files.exists(n) for line in files.read(n).splitlines()]


def walk(spark: SparkSession, root: str, ignore_lines: Iterable[str] = (), parsers: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(file_path, content, content_hash, parser of the files below ``root`` that a parser takes and that can be read; file_path of all of them).

    Pruned directories, and paths ignored by ``root``'s ignore files and then by ``ignore_lines``,
    are dropped by path, before contents are read. The second table reads no contents, so
    a file that can't be read is in it, and isn't taken for deleted.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    base = root.rstrip("/") + "/"
    relative = F.substring(path, len(base) + 1, 100_000)
    kept = files.withColumn("file_path", path).where(~is_pruned(relative) & ~ignored(relative, ignore_regex([*ignore_lines_of(spark, root), *ignore_lines])))
    kept = kept.withColumn("parser", parser_of(F.col("file_path"))).where(F.col("parser").isin(*(parsers or PARSERS)))
    return kept.select("file_path", "content", content_hash(F.col("content")).alias("content_hash"), "parser"), kept.select("file_path")
