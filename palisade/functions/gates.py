"""Literals that a pattern cannot match without.

A substring search costs a hundredth of a regular expression, so a pattern is
tried only on texts that hold its necessary literals: one of each of several
sets.  They are derived from the pattern, never written by hand, and compared in
lower case, which can only let more texts through.  The text is lowered once for
all patterns that ``lowered`` binds it for.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A set with more alternatives than this would cost as much as the pattern.
MOST = 8
#: Sets of one pattern that are looked for; the rarest come first.
SETS = 3


def _runs(items) -> list[frozenset[str]]:
    """Candidate sets: a match holds at least one string of each."""
    out, run = [], ""

    def close() -> None:
        nonlocal run
        if run:
            out.append(frozenset([run.lower()]))
        run = ""

    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        close()
        if name == "SUBPATTERN":
            out += _runs(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            out += _runs(arg[2])
        elif name == "BRANCH":
            parts = [_best(_runs(b)) for b in arg[1]]
            if all(parts):
                out.append(frozenset().union(*parts))
    close()
    return out


def _best(found: list[frozenset[str]]) -> frozenset[str] | None:
    """The set whose members are longest for their number."""
    return max(found, key=lambda s: min(map(len, s)) / len(s), default=None)


def _telling(s: str) -> bool:
    return len(s) >= 2 or not (s.isalnum() or s.isspace() or s in ".,-_\"'")


@cache
def literals(regex: str) -> tuple[tuple[str, ...], ...]:
    """Sets of which every match has a member in its lower-cased text; none: no gate."""
    parser = getattr(re, "_parser", None)
    if parser is None:  # no parser to be had: no gates, and the same results
        return ()
    sets = [s for s in dict.fromkeys(_runs(parser.parse(regex))) if len(s) <= MOST and all(map(_telling, s))]
    # What another set's members hold anyway tells nothing more.
    sets = [s for s in sets if not any(s != t and all(any(x in y for x in s) for y in t) for t in sets)]
    sets.sort(key=lambda s: (len(s), -min(map(len, s)), sorted(s)))
    return tuple(tuple(sorted(s)) for s in sets[:SETS])


def lowered(text: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` of the lower-cased text, which is computed once."""
    return F.element_at(F.transform(F.array(F.lower(text)), build), 1)


def gate(low: Column, regex: str) -> Column | None:
    """Whether a lower-cased text holds what the pattern needs; None where it needs nothing that is known."""
    sets = [reduce(lambda a, b: a | b, (F.contains(low, F.lit(s)) for s in one)) for one in literals(regex)]
    return reduce(lambda a, b: a & b, sets) if sets else None


def matches(text: Column, regex: str, low: Column | None = None) -> Column:
    """rlike behind the pattern's gate; ``low`` is the lower-cased text where it is at hand."""
    need = gate(F.lower(text) if low is None else low, regex)
    return text.rlike(regex) if need is None else need & text.rlike(regex)
