"""What a query text becomes before it meets data."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


class Rejected(ValueError):
    """The text is no query of the language; the message says why."""


class QueryError(ValueError):
    """The query is one of the language, but a server would refuse to run it."""


@dataclass(frozen=True)
class Call:
    """A method of a collection or cursor with literal arguments, in which chains may stand for values."""

    method: str
    args: tuple
    kwargs: tuple[tuple[str, Any], ...] = ()

    def argument(self, i: int, name: str, default: Any = None) -> Any:
        return self.args[i] if i < len(self.args) else dict(self.kwargs).get(name, default)


@dataclass(frozen=True)
class Chain:
    """``db.<collection>`` and the calls and indexes that follow."""

    collection: str
    steps: tuple[Call | Item, ...]


@dataclass(frozen=True)
class Item:
    """``[key]`` behind a cursor (a number) or a document (a field name)."""

    key: int | str


@dataclass(frozen=True)
class Stage:
    """A pipeline stage: its operator, and its specification."""

    op: str
    spec: Any


@dataclass(frozen=True)
class FlatLookup:
    """A lookup whose array is unwound at once: a flat join. ``outer`` keeps rows without a match."""

    spec: dict
    outer: bool = False


@dataclass(frozen=True)
class ExistsLookup:
    """A lookup of which only matters whether it finds anything: a semi or anti join."""

    spec: dict
    found: bool


@dataclass(frozen=True)
class CountLookup:
    """A lookup of which only numbers of matches are read: all, or those that meet a condition.

    ``counts`` holds for each field its condition: an expression over a match, a
    filter of matches, or None.
    """

    spec: dict
    counts: tuple[tuple[str, str, Any], ...]


@dataclass(frozen=True)
class SpreadGroup:
    """A group of all documents whose list ``name`` is unwound at once: each document with the totals."""

    spec: dict
    name: str
