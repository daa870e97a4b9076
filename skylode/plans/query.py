"""The query language: frozen values that compare, hash and print; they hold no data."""

from __future__ import annotations

import re
from dataclasses import dataclass


class Query:
    def normalise(self) -> Query:
        return self


@dataclass(frozen=True)
class Term(Query):
    field: str
    text: str

    def __str__(self) -> str:
        return f"{self.field}:{self.text}"


@dataclass(frozen=True)
class MatchAll(Query):
    def __str__(self) -> str:
        return "*:*"


@dataclass(frozen=True)
class Phrase(Query):
    """Terms at given positions (0, 1, 2, ... if none are given). slop is kept and not used in matching."""

    field: str
    terms: tuple[str, ...]
    positions: tuple[int, ...] = ()
    slop: int = 0

    def __post_init__(self):
        object.__setattr__(self, "terms", tuple(self.terms))
        object.__setattr__(self, "positions", tuple(self.positions) or tuple(range(len(self.terms))))
        if len(self.positions) != len(self.terms):
            raise ValueError("a phrase needs one position a term")

    def normalise(self) -> Query:
        return Term(self.field, self.terms[0]) if len(self.terms) == 1 else self

    def __str__(self) -> str:
        return f'{self.field}:"{" ".join(self.terms)}"' + (f"~{self.slop}" if self.slop else "")


@dataclass(frozen=True)
class Range(Query):
    """lower to upper, None for no bound; null and NaN never match. Its score is constant."""

    field: str
    lower: float | int | None = None
    upper: float | int | None = None
    include_lower: bool = True
    include_upper: bool = True

    def __post_init__(self):
        if self.lower is not None and self.upper is not None and self.lower > self.upper:
            raise ValueError(f"lower bound {self.lower} is above upper bound {self.upper}")

    @classmethod
    def exact(cls, field: str, value) -> Range:
        return cls(field, value, value)

    @classmethod
    def at_least(cls, field: str, value, include: bool = True) -> Range:
        return cls(field, value, None, include, True)

    @classmethod
    def at_most(cls, field: str, value, include: bool = True) -> Range:
        return cls(field, None, value, True, include)

    def __str__(self) -> str:
        low, high = ("*" if x is None else str(x) for x in (self.lower, self.upper))
        return f"{self.field}:{'[' if self.include_lower else '{'}{low} TO {high}{']' if self.include_upper else '}'}"


@dataclass(frozen=True)
class Wildcard(Query):
    """Extension: a field with a term that a pattern matches whole; * stands for any characters, ? for one. Score 1."""

    field: str
    pattern: str

    def regex(self) -> str:
        return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in self.pattern) + "$"

    def __str__(self) -> str:
        return f"{self.field}:{self.pattern}"


@dataclass(frozen=True)
class Fuzzy(Query):
    """Extension: a field with a term that at most ``edits`` insertions, deletions and substitutions make of a word. Score 1."""

    field: str
    text: str
    edits: int = 1

    def __post_init__(self):
        if self.edits < 0:
            raise ValueError("edits is below 0")

    def __str__(self) -> str:
        return f"{self.field}:{self.text}~{self.edits}"


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    factor: float = 1.0

    def normalise(self) -> Query:
        return Boost(self.query.normalise(), self.factor)

    def __str__(self) -> str:
        return f"({self.query})^{self.factor:g}"


@dataclass(frozen=True)
class Bool(Query):
    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()
    filter: tuple[Query, ...] = ()
    min_should: int = 0

    def __post_init__(self):
        for name in ("must", "should", "must_not", "filter"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if self.min_should < 0:
            raise ValueError("min_should is below 0")

    def normalise(self) -> Query:
        sides = {k: tuple(q.normalise() for q in getattr(self, k)) for k in ("must", "should", "must_not", "filter")}
        must = tuple(x for q in sides["must"] for x in (q.must if isinstance(q, Bool) and not (q.should or q.must_not or q.filter) else (q,)))
        return Bool(must, sides["should"], sides["must_not"], sides["filter"], self.min_should)

    def __str__(self) -> str:
        parts = [f"{sign}{f'({q})' if isinstance(q, Bool) else q}" for sign, side in (("+", self.must), ("", self.should), ("-", self.must_not), ("#", self.filter)) for q in side]
        return " ".join(parts) + (f"~{self.min_should}" if self.min_should else "")


def leaves(q: Query) -> list[Query]:
    if isinstance(q, Bool):
        return [x for side in (q.must, q.should, q.must_not, q.filter) for s in side for x in leaves(s)]
    return leaves(q.query) if isinstance(q, Boost) else [q]
