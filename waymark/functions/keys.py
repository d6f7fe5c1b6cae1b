"""Attribute keys of documents: taggers as built-in expressions, and the key table they fill."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import extension, file_name, file_stem, parent_folder

#: Topic tag -> keywords; two of them must occur as substrings of the lower-cased text.
TOPICS: dict[str, str] = {
    "auth": "authentication auth login oauth jwt session",
    "database": "database sql query schema migration orm",
    "api": "api endpoint rest graphql grpc",
    "testing": "test testing assert mock fixture spec",
    "deployment": "deploy deployment ci/cd pipeline docker kubernetes",
    "config": "config configuration settings environment env",
    "error-handling": "error exception handling retry fallback",
    "caching": "cache caching redis memcached ttl",
    "observability": "logging log tracing observability metrics",
    "security": "security encryption tls certificate vulnerability",
    "concurrency": "async concurrent parallel thread tokio future",
    "networking": "network http tcp socket request response",
    "parsing": "parser parsing ast syntax lexer token",
    "indexing": "index bitmap search filter query",
}
#: Languages by extension, configuration files by name.
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "py": "python", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java"}
CONFIG_NAMES = ["config.toml", "config.yaml", "config.yml", "config.json", ".eslintrc.json", "tsconfig.json", "cargo.toml", "package.json"]
#: Extensions and stems of configuration files among code.
CONFIG_EXTENSIONS, CONFIG_STEMS = ("toml", "yaml", "yml", "json", "ini", "cfg"), ("Cargo", "Makefile", "Dockerfile")
TAGGERS = ("size", "complexity", "convention", "topic")


def _tags(*conditions: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in conditions)))


def size_tag(content: Column) -> Column:
    """By bytes of UTF-8: up to 1023 small, up to 10240 medium, else large."""
    n = F.octet_length(content)
    return F.when(n <= 1023, "size:small").when(n <= 10_240, "size:medium").otherwise("size:large")


def complexity_tag(n_chunks: Column, max_depth: Column) -> Column:
    n, d = F.coalesce(n_chunks, F.lit(0)), F.coalesce(max_depth, F.lit(0))
    return F.when((n > 10) | (d >= 4), "complexity:high").when(n > 3, "complexity:medium").otherwise("complexity:low")


def convention_tags(path: Column) -> Column:
    """What the lower-cased path says by convention: test, config, migration, readme, docs, in this order."""
    p = F.lower(path)
    name, stem = file_name(p), file_stem(p)
    has = lambda *xs: reduce(lambda a, b: a | b, (F.contains(p, F.lit(x)) for x in xs))
    return _tags(
        (stem.endswith("_test") | stem.endswith("_spec") | stem.startswith("test_") | has("tests/", "test/", "__tests__/"), "convention:test"),
        (F.contains(name, F.lit(".config.")) | name.isin(CONFIG_NAMES), "convention:config"),
        (has("migrations/", "migrate/"), "convention:migration"),
        (stem.startswith("readme"), "convention:readme"),
        (has("docs/", "doc/"), "convention:docs"),
    )


def topic_tags(content: Column) -> Column:
    """Tags of the topics of which two keywords occur. The text is lowered once, as the only item of an array."""

    def tags(low: Column) -> Column:
        hits = {t: reduce(lambda a, b: a + b, (F.contains(low, F.lit(w)).cast("int") for w in words.split())) for t, words in TOPICS.items()}
        return _tags(*((n >= 2, f"topic:{t}") for t, n in hits.items()))

    return F.coalesce(F.get(F.transform(F.array(F.lower(content)), tags), F.lit(0)), F.array().cast("array<string>"))


def language_of(path: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), extension(path)), F.lit("unknown"))


def code_type(path: Column) -> Column:
    """test_file, config_file or source_file by the name; null where there is no stem, or no extension and no test's name."""
    stem, ext = file_stem(path), extension(path)
    test = stem.rlike(r"(_test|_tests|_spec|\.test|\.spec)$") | stem.startswith("test_") | (stem == "tests") | F.contains(path, F.lit("/tests/")) | F.contains(path, F.lit("/test/"))
    config = ext.isin(*CONFIG_EXTENSIONS) | stem.isin(*CONFIG_STEMS) | stem.startswith(".")
    return F.when(stem == "", None).when(test, "test_file").when(F.coalesce(ext, F.lit("")) == "", None).when(config, "config_file").otherwise("source_file")


def infer_source(tags: Column) -> Column:
    """The first source: tag's value; else code where a lang: tag is; else obsidian."""
    named = F.filter(tags, lambda t: t.startswith("source:"))
    return F.when(F.size(named) > 0, F.substring(F.get(named, F.lit(0)), 8, 10_000)).when(F.exists(tags, lambda t: t.startswith("lang:")), "code").otherwise("obsidian")


def with_namespace(tags: Column) -> Column:
    """Tags without a namespace become tag: keys."""
    return F.transform(tags, lambda t: F.when(F.contains(t, F.lit(":")), t).otherwise(F.concat(F.lit("tag:"), t)))


def config_hash(names: Sequence[str] = TAGGERS) -> Column:
    """Sixteen hex digits of the digest of the taggers' names."""
    return F.substring(F.sha2(F.lit("".join(names)), 256), 1, 16)


@dataclass(frozen=True)
class Rule:
    """All given conditions must hold: a glob on the folder, the extension with its dot, a parser tag, a text."""

    add_tags: tuple[str, ...]
    folder: str | None = None
    extension: str | None = None
    has_tag: str | None = None
    content_contains: str | None = None


@dataclass(frozen=True)
class RuleTagger:
    name: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    @staticmethod
    def load(spec: dict) -> RuleTagger:
        """From the mapping that a rule file holds: name, rules with match and add_tags."""
        rules = tuple(Rule(tuple(r.get("add_tags", ())), **{k: v for k, v in (r.get("match") or {}).items() if v is not None}) for r in spec.get("rules", ()))
        return RuleTagger(spec["name"], rules)

    def tags(self, path: Column, content: Column, tags: Column) -> Column:
        """Tags of every rule that matches, in order; an invalid glob matches everything."""
        found = []
        for r in self.rules:
            on = F.lit(True)
            if r.folder is not None:
                on &= parent_folder(path).rlike(glob_regex(r.folder))
            if r.extension is not None:
                on &= F.concat(F.lit("."), extension(path)) == r.extension
            if r.has_tag is not None:
                on &= F.array_contains(tags, r.has_tag)
            if r.content_contains is not None:
                on &= F.contains(content, F.lit(r.content_contains))
            found.append(F.when(on, F.array(*(F.lit(t) for t in r.add_tags))).otherwise(F.array().cast("array<string>")))
        return F.concat(*found) if found else F.array().cast("array<string>")


def glob_regex(glob: str) -> str:
    """A shell glob as a regular expression: * and ? cross folders, [..] and {a,b} as usual."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            j = glob.find("]", i + 2)
            if j < 0:
                return ".*"
            body = glob[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = j
        elif c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if not c.isalnum() and c not in "/_" and c.isascii() else c
        i += 1
    return f"^{out}$" if not depth else ".*"


def document_keys(documents: DataFrame, chunk_stats: DataFrame | None = None, namespaces: Sequence[str] | None = None) -> DataFrame:
    """doc_id, bitmap_key of a document table: source:, type:, lang:, folder:, size:, topic:, convention: and complexity:.

    Each key once per document. Null texts count as empty, null languages and types give
    no key. With ``namespaces`` only keys of those are derived, so a filter on a language
    never reads the texts. ``chunk_stats`` (doc_id, n_chunks, max_depth) may not hold a
    document twice.
    """
    text = F.coalesce("text", F.lit(""))
    d = documents
    if chunk_stats is not None:
        d = d.join(chunk_stats.select(F.col("doc_id").alias("_cid"), "n_chunks", "max_depth"), F.col("doc_id") == F.col("_cid"), "left")
    keyed = lambda ns, c: F.array(F.concat(F.lit(ns + ":"), c))
    makers = {
        "source": lambda: keyed("source", F.col("source_type")), "type": lambda: keyed("type", F.col("auto_type")), "lang": lambda: keyed("lang", F.lower("lang")), "folder": lambda: keyed("folder", parent_folder(F.col("file_path"))),
        "size": lambda: F.array(size_tag(text)), "topic": lambda: topic_tags(text), "convention": lambda: convention_tags(F.col("file_path")),
    }
    if chunk_stats is not None:
        makers["complexity"] = lambda: F.array(complexity_tag(F.col("n_chunks"), F.col("max_depth")))
    found = [make() for name, make in makers.items() if namespaces is None or name in namespaces]
    if not found:
        return d.select("doc_id", F.lit("").alias("bitmap_key")).where(F.lit(False))
    # an outer explode, as before an inner one the optimizer computes the array once more to filter by its size
    return d.select("doc_id", F.explode_outer(F.array_distinct(F.concat(*found))).alias("bitmap_key")).where("bitmap_key IS NOT NULL")


def namespaces_of(names: Sequence[str]) -> set[str]:
    return {n.split(":", 1)[0] for n in names}
