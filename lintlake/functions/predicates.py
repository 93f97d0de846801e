"""Predicates over a line of code, its surroundings and its file, that compile to a Spark column or to SQL text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.functions.textops import around, matches


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Place:
    """Where a predicate looks, for the Spark side: columns of one line."""

    line: Column
    stripped: Column
    i: Column
    lines: Column
    code: Column

    def text(self, on: str | tuple[int, int]) -> Column:
        if isinstance(on, tuple):
            return around(self.lines, self.i, *on)
        if on == "prev":
            return F.coalesce(F.when(self.i > 0, F.get(self.lines, self.i - 1)), F.lit(""))
        return getattr(self, on)


def sql_text(on: str | tuple[int, int]) -> str:
    """The same place as a column of the SQL relation `lines`; windows become columns named by `window_column`."""
    return window_column(on) if isinstance(on, tuple) else on


def window_column(on: tuple[int, int]) -> str:
    return f"w_{'m' if on[0] < 0 else 'p'}{abs(on[0])}_{'m' if on[1] < 0 else 'p'}{abs(on[1])}"


class Test:
    """A predicate; combine with & | ~."""

    def spark(self, at: Place) -> Column:
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError

    def windows(self) -> set[tuple[int, int]]:
        return set()

    def __and__(self, other: Test) -> Test:
        return Both("and", self, other)

    def __or__(self, other: Test) -> Test:
        return Both("or", self, other)

    def __invert__(self) -> Test:
        return Not(self)


@dataclass(frozen=True)
class Re(Test):
    """A regular expression found in a text.  re2: for patterns with look-around, SQL over the placeholder {t} that is equal on one-match texts."""

    pattern: str
    on: str | tuple[int, int] = "line"
    re2: str | None = None

    def spark(self, at: Place) -> Column:
        return matches(at.text(self.on), self.pattern)

    def sql(self) -> str:
        text = sql_text(self.on)
        return self.re2.replace("{t}", text) if self.re2 else f"regexp_matches({text}, {quote(self.pattern)})"

    def windows(self) -> set[tuple[int, int]]:
        return {self.on} if isinstance(self.on, tuple) else set()


@dataclass(frozen=True)
class Has(Test):
    """A substring found in a text."""

    part: str
    on: str = "line"

    def spark(self, at: Place) -> Column:
        return at.text(self.on).contains(self.part)

    def sql(self) -> str:
        return f"contains({sql_text(self.on)}, {quote(self.part)})"


@dataclass(frozen=True)
class Starts(Test):
    prefix: str
    on: str = "stripped"

    def spark(self, at: Place) -> Column:
        return at.text(self.on).startswith(self.prefix)

    def sql(self) -> str:
        return f"starts_with({sql_text(self.on)}, {quote(self.prefix)})"


@dataclass(frozen=True)
class FirstNotIn(Test):
    """The pattern's first match in the line, whose group is none of the values."""

    pattern: str
    group: int
    values: tuple[str, ...]

    def spark(self, at: Place) -> Column:
        return matches(at.line, self.pattern) & ~F.regexp_extract(at.line, "(?U)" + self.pattern, self.group).isin(*self.values)

    def sql(self) -> str:
        return f"(regexp_matches(line, {quote(self.pattern)}) and regexp_extract(line, {quote(self.pattern)}, {self.group}) not in ({', '.join(map(quote, self.values))}))"


@dataclass(frozen=True)
class Both(Test):
    op: str
    a: Test
    b: Test

    def spark(self, at: Place) -> Column:
        x, y = self.a.spark(at), self.b.spark(at)
        return x & y if self.op == "and" else x | y

    def sql(self) -> str:
        return f"({self.a.sql()} {self.op} {self.b.sql()})"

    def windows(self) -> set[tuple[int, int]]:
        return self.a.windows() | self.b.windows()


@dataclass(frozen=True)
class Not(Test):
    a: Test

    def spark(self, at: Place) -> Column:
        return ~self.a.spark(at)

    def sql(self) -> str:
        return f"(not {self.a.sql()})"

    def windows(self) -> set[tuple[int, int]]:
        return self.a.windows()


def any_of(tests: list[Test]) -> Test:
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def any_re(patterns: list[str], on: str | tuple[int, int] = "line") -> Test:
    return any_of([Re(p, on) for p in patterns])
