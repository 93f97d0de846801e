"""What a text must hold for a pattern to match: literals that stand in every match, as cheap tests in front of it.

Literals are compared in folded case, so they are necessary whatever a pattern's flags are, never sufficient.  For many
fixed patterns at once there is an index by grams: each pattern's rarest gram leads to it by an equality join.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.predicates import Both, FirstNotIn, Has, Not, Re, Starts, Test

#: Alternatives that are told apart; beyond them a literal set is given up.
MANY = 48
GRAM = 3
#: One of each set must be there: a conjunction of alternatives.
Needs = tuple[frozenset[str], ...]

#: Letters that match ASCII ones when case doesn't count, but aren't lowered to them.
_ODD, _PLAIN = "ſKİı", "skii"


def folded(text: Column) -> Column:
    return F.lower(F.when(text.rlike(f"[{_ODD}]"), F.translate(text, _ODD, _PLAIN)).otherwise(text))


def _worth(literals: frozenset[str] | None) -> tuple[int, int, int]:
    if not literals or "" in literals:
        return (0, 0, 0)
    short = min(map(len, literals))
    return (min(short, GRAM), -len(literals), short)


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    return max(a, b, key=_worth)


def _sequence(items) -> tuple[frozenset[str] | None, frozenset[str] | None]:
    """(all texts that the items match, if few; literals of which each match holds one, or None)."""
    run, best, whole = frozenset([""]), None, True
    for kind, arg in items:
        exact, inner = _item(kind, arg)
        if exact is not None and len(run) * len(exact) <= MANY:
            run = frozenset(a + b for a in run for b in exact)
            continue
        best, whole = _better(_better(best, run), inner), False
        run = exact if exact is not None else frozenset([""])
    best = _better(best, run)
    return (run if whole else None), (best if _worth(best)[0] else None)


def _item(kind, arg) -> tuple[frozenset[str] | None, frozenset[str] | None]:
    if kind is op.LITERAL:
        return frozenset([chr(arg).lower()]), None
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return frozenset([""]), None
    if kind is op.IN and len(arg) <= 3 and all(k is op.LITERAL for k, _ in arg):
        return frozenset(chr(c).lower() for _, c in arg), None
    if kind is op.SUBPATTERN:
        return _sequence(arg[3])
    if kind is op.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        exact = None if any(e is None for e, _ in parts) else frozenset().union(*(e for e, _ in parts))
        inner = None if any(i is None for _, i in parts) else frozenset().union(*(i for _, i in parts))
        return (exact if exact is not None and len(exact) <= MANY else None), inner
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = arg
        exact, needed = _sequence(inner)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, None
        return None, needed if low else None
    return None, None


@lru_cache
def required(pattern: str) -> frozenset[str] | None:
    """Folded literals of which every match of the pattern holds at least one; None if there are no such few."""
    exact, needed = _sequence(_parser.parse(pattern))
    found = _better(needed, exact)
    return found if _worth(found)[0] else None


def needs(test: Test | None, place: str) -> Needs:
    """What a predicate needs in the line ("line") or anywhere in the file ("code") to hold."""
    if isinstance(test, Both):
        a, b = needs(test.a, place), needs(test.b, place)
        if test.op == "and":
            return a + b
        return (frozenset(max(a, key=_worth) | max(b, key=_worth)),) if a and b else ()
    if isinstance(test, Not) or test is None:
        return ()
    on = getattr(test, "on", "line")
    if place == "line" and on not in ("line", "stripped"):
        return ()
    if isinstance(test, Re | FirstNotIn):
        found = required(test.pattern)
    elif isinstance(test, Has | Starts):
        found = frozenset([(test.part if isinstance(test, Has) else test.prefix).lower()])
    else:
        return ()
    # What spans lines of a window or a file may hold line ends, which `code` may write in other ways.
    return (found,) if found and not any("\n" in x for x in found) else ()


Signs = frozenset[frozenset[str]]


def _signs(items) -> Signs:
    """Sets of characters; each text that the items match in a row holds one character of each set."""
    found: Signs = frozenset()
    for kind, arg in items:
        if kind is op.LITERAL:
            found |= {frozenset([chr(arg)])}
        elif kind is op.IN and len(arg) <= 4 and all(k is op.LITERAL for k, _ in arg):
            found |= {frozenset(chr(c) for _, c in arg)}
        elif kind is op.SUBPATTERN:
            found |= _signs(arg[3])
        elif kind is op.BRANCH:
            found |= frozenset.intersection(*(_signs(p) for p in arg[1]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0]:
            found |= _signs(arg[2])
    return found


def _plain(found: Signs) -> Signs:
    """Those of signs alone: they have no case, and prose holds few of them."""
    return frozenset(s for s in found if all(c.isascii() and c.isprintable() and not c.isalnum() and c != " " for c in s))


@lru_cache
def pattern_signs(pattern: str) -> Signs:
    return _plain(_signs(_parser.parse(pattern)))


def signs(test: Test | None) -> Signs:
    """Sets of signs; a line for which a predicate holds has one of each."""
    if isinstance(test, Both):
        a, b = signs(test.a), signs(test.b)
        return a | b if test.op == "and" else a & b
    if isinstance(test, Not) or test is None or getattr(test, "on", "line") not in ("line", "stripped"):
        return frozenset()
    if isinstance(test, Re | FirstNotIn):
        return pattern_signs(test.pattern)
    if isinstance(test, Has | Starts):
        return _plain(frozenset(frozenset([c]) for c in (test.part if isinstance(test, Has) else test.prefix)))
    return frozenset()


def shows(text: Column, wanted: Signs) -> Column | None:
    """Whether a text has one sign of each set; None if none is wanted."""
    each = [reduce(lambda a, b: a | b, (text.contains(c) for c in sorted(s))) for s in sorted(wanted, key=lambda s: (len(s), sorted(s)))]
    return reduce(lambda a, b: a & b, each) if each else None


def holds(text: Column, needed: Needs) -> Column | None:
    """Whether a folded text has what is needed; None if nothing is."""
    least = [[x for x in s if not any(y != x and y in x for y in s)] for s in needed]
    some = [reduce(lambda a, b: a | b, (text.contains(x) for x in sorted(s))) for s in least]
    return reduce(lambda a, b: a & b, some) if some else None


# --- Many fixed patterns: an index by grams ---


def pattern_grams(specs: DataFrame) -> DataFrame:
    """specs (with `pattern`) and one row for each of a pattern's grams: GRAM characters of it, or all of a shorter one."""
    size = F.lit(GRAM)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("pattern") - size + 1))
    return specs.select("*", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("pattern"), i, size)))).alias("gram"))


def _held(text: Column, by: Column, grams: DataFrame) -> Column:
    """The grams (rows of `by`, gram: few, of a fixed list of patterns) that a text holds, those of its own `by` alone."""
    own: dict[str, list[str]] = {}
    for key, gram in sorted(map(tuple, grams.distinct().collect())):
        own.setdefault(key, []).append(gram)
    if not own:
        return F.array().cast("array<string>")
    known = F.create_map(*(x for key, all_ in own.items() for x in (F.lit(key), F.array(*map(F.lit, all_)))))
    return F.filter(F.try_element_at(known, by), lambda g: F.contains(text, g))


def gram_counts(files: DataFrame, specs: DataFrame, by: str) -> DataFrame:
    """`by`, gram, n: in how many files each gram of the patterns stands.  At most a row a gram and task is shuffled."""
    held = _held(F.col("code"), F.col(by), pattern_grams(specs).select(by, "gram"))
    return files.select(by, F.explode(held).alias("gram")).groupBy(by, "gram").agg(F.count("*").alias("n"))


def trigger_index(specs: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    """specs with `gram`, the rarest of each pattern's grams (ties: the first by code points)."""
    each = pattern_grams(specs).join(F.broadcast(counts), [by, "gram"], "left")
    keys = specs.columns
    best = each.groupBy(*keys).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    return best.select(*keys, F.col("best.gram").alias("gram"))


def indexed_matches(files: DataFrame, lines: Column, index: DataFrame, by: str) -> DataFrame:
    """files with `i` and `line` of each of their lines that holds a pattern of the index, and the pattern's columns.

    A file is read line by line only if it holds a gram of the index, a line meets only the patterns whose rarest gram it
    holds (an equality join on `by` and gram), and those are verified.  index: a fixed list, with `pattern`, `gram`, `by`.
    """
    held = files.withColumn("grams", _held(F.col("code"), F.col(by), index.select(by, "gram"))).where(F.size("grams") > 0)
    each = held.select(*files.columns, "grams", F.posexplode(lines).alias("i", "line"))
    met = each.withColumn("gram", F.explode(F.filter("grams", lambda g: F.contains(F.col("line"), g)))).drop("grams", "code")
    return met.join(F.broadcast(index), [by, "gram"]).where(F.contains("line", "pattern")).drop("gram")
