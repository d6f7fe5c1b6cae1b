"""The filter language: ``tag:work AND NOT (lang:de OR folder:/vault/old)``.

Keys are ``namespace:value``; NOT binds closer than AND, AND closer than OR; keywords in
any case. Parsing happens on the driver and yields a small tree that the filter operator
turns into one pass over the key table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Key:
    name: str


@dataclass(frozen=True)
class Not:
    inner: Filter


@dataclass(frozen=True)
class And:
    parts: tuple[Filter, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Filter, ...]


Filter = Key | Not | And | Or


class FilterError(ValueError):
    """A text that is no filter: ``kind`` names the fault, ``position`` its byte offset (None at the end)."""

    def __init__(self, kind: str, position: int | None, detail: str = ""):
        super().__init__(f"{kind} at {'the end' if position is None else position}{': ' + detail if detail else ''}")
        self.kind, self.position = kind, position


_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")
_VALUE = re.compile(r"[A-Za-z0-9/_.:-]*")
_SPACE = re.compile(r"[ \t\r\n\f]*")
_WORDS = {"and": "AND", "or": "OR", "not": "NOT"}


def tokens(text: str) -> list[tuple[int, str, str]]:
    """(position, kind, text) of a trimmed filter; a name before a colon is a key even if it reads as a keyword."""
    out, at = [], 0
    while (at := _SPACE.match(text, at).end()) < len(text):
        c = text[at]
        if c in "()":
            out.append((at, c, c))
            at += 1
            continue
        m = _NAME.match(text, at)
        if m is None:
            raise FilterError("UnexpectedToken", at, c)
        colon = _SPACE.match(text, m.end()).end()
        if text[colon : colon + 1] == ":":
            v = _VALUE.match(text, colon + 1)
            if not v[0]:
                raise FilterError("EmptyValue", at, m[0])
            out.append((at, "KEY", f"{m[0]}:{v[0]}"))
            at = v.end()
        elif m[0].lower() in _WORDS:
            out.append((at, _WORDS[m[0].lower()], m[0]))
            at = m.end()
        else:
            raise FilterError("BareTerm", at, m[0])
    return out


class _Parser:
    def __init__(self, toks: list[tuple[int, str, str]]):
        self.toks, self.i = toks, 0

    def kind(self) -> str | None:
        return self.toks[self.i][1] if self.i < len(self.toks) else None

    def position(self) -> int | None:
        return self.toks[self.i][0] if self.i < len(self.toks) else None

    def chain(self, word: str, make: type, part) -> Filter:
        parts = [part()]
        while self.kind() == word:
            self.i += 1
            parts.append(part())
        if len(parts) == 1:
            return parts[0]
        first = parts[0].parts if isinstance(parts[0], make) else (parts[0],)
        return make((*first, *parts[1:]))

    def either(self) -> Filter:
        return self.chain("OR", Or, self.both)

    def both(self) -> Filter:
        return self.chain("AND", And, self.unary)

    def unary(self) -> Filter:
        if self.kind() == "NOT":
            self.i += 1
            return Not(self.unary())
        return self.primary()

    def primary(self) -> Filter:
        at, kind = self.position(), self.kind()
        if kind is None:
            raise FilterError("UnexpectedEof", None)
        if kind == "KEY":
            self.i += 1
            return Key(self.toks[self.i - 1][2])
        if kind != "(":
            raise FilterError("UnexpectedToken", at, kind)
        self.i += 1
        if self.kind() == ")":
            raise FilterError("EmptyParens", at)
        inner = self.either()
        if self.kind() != ")":
            raise FilterError("UnclosedParen", at)
        self.i += 1
        return inner


def parse_filter(text: str) -> Filter:
    """The tree of a filter text, or FilterError (BareTerm, EmptyValue, EmptyParens, UnclosedParen, UnexpectedToken, UnexpectedEof)."""
    trimmed = text.strip()
    if not trimmed:
        raise FilterError("UnexpectedEof", None)
    p = _Parser(tokens(trimmed))
    out = p.either()
    if p.kind() is not None:
        raise FilterError("UnexpectedToken", p.position(), p.kind())
    return out


def from_list(keys: Sequence[str], op: str = "and") -> Filter:
    """A plain list of keys: one is itself, several are joined by ``op`` ("or", else and)."""
    if len(keys) == 1:
        return Key(keys[0])
    return (Or if op == "or" else And)(tuple(Key(k) for k in keys))


def leaf_keys(f: Filter) -> list[str]:
    """Every key of the tree in order, repeated and negated ones too."""
    if isinstance(f, Key):
        return [f.name]
    return leaf_keys(f.inner) if isinstance(f, Not) else [k for p in f.parts for k in leaf_keys(p)]


def estimate(f: Filter, sizes: dict[str, int], most: int = 2**32 - 1) -> int:
    """An upper bound of the matches from key sizes: and takes the least, or the sum, not anything."""
    if isinstance(f, Key):
        return sizes.get(f.name, 0)
    if isinstance(f, Not):
        return most
    each = [estimate(p, sizes, most) for p in f.parts]
    return (min(each) if isinstance(f, And) else min(most, sum(each))) if each else 0
