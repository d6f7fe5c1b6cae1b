"""Scalar helpers over text, paths and times, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(s: Column) -> Column:
    """Lower case, everything but letters and digits as ``-``, none at either end; runs stay as long as they are."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "-"), "^-+|-+$", "")


def strip_tags(s: Column) -> Column:
    """Without <...>, white space runs as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"<[^>]*>", " "), r"\s+", " "))


def attribute(s: Column, name: str) -> Column:
    """The value of name="..." in a tag; empty if there is none."""
    return F.regexp_extract(s, rf'{name}="([^"]*)"', 1)


def expand_mrkdwn(s: Column) -> Column:
    """Chat references written out: <@U|n> as @n, <#C|n> as #n, <url|label> as label (url), <url> as url."""
    s = F.regexp_replace(s, r"<@[^|>]+\|([^>]+)>", "@$1")
    s = F.regexp_replace(s, r"<@([^|>]+)>", "@$1")
    s = F.regexp_replace(s, r"<#[^|>]+\|([^>]+)>", "#$1")
    s = F.regexp_replace(s, r"<#([^|>]+)>", "#$1")
    s = F.regexp_replace(s, r"<((?:https?|mailto)[^|>]*)\|([^>]+)>", "$2 ($1)")
    return F.regexp_replace(s, r"<((?:https?|mailto)[^|>]*)>", "$1")


def flatten_tag(tag: Column) -> Column:
    """``a/b/c`` as [a, a/b, a/b/c]."""
    parts = F.split(tag, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def parent_folder(path: Column) -> Column:
    """The path without its last component; the root's is /, that of a bare name empty."""
    cut = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(~F.contains(path, F.lit("/")), "").when(cut == "", "/").otherwise(cut)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Without its dot; empty if there is none."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def iso_seconds(s: Column) -> Column:
    """Unix seconds of the first 19 characters of an ISO 8601 time, whatever offset follows; null if it is none.

    By the calendar alone, so the session's time zone makes no difference.
    """
    good = s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]([01]\d|2[0-3]):[0-5]\d:[0-5]\d")
    part = lambda at: F.substring(s, at, 2).try_cast("long")
    return F.when(good, day_seconds(F.substring(s, 1, 10)) + part(12) * 3600 + part(15) * 60 + part(18))


def utc_day(seconds: Column) -> Column:
    return F.date_format(utc_date(seconds), "yyyy-MM-dd")


def utc_date(seconds: Column) -> Column:
    """The UTC date of a Unix time, in whatever time zone the session is."""
    return F.date_from_unix_date(F.floor(seconds / F.lit(86_400)).try_cast("int"))


def day_seconds(day: Column) -> Column:
    return F.unix_date(F.try_to_date(day, "yyyy-MM-dd")).cast("long") * 86_400


def strict_base64(s: Column) -> Column:
    """Bytes of base64 text of the right length and alphabet, else null."""
    ok = (F.length(s) % 4 == 0) & s.rlike(r"^[A-Za-z0-9+/]*={0,2}$")
    return F.when(ok, F.unbase64(s))


def chunk_bytes(content: Column, start: Column, end: Column) -> Column:
    """The text of a byte range of UTF-8 content; broken characters at its edges are replaced."""
    return F.decode(F.substring(content, (start + 1).try_cast("int"), (end - start).try_cast("int")), "UTF-8")
