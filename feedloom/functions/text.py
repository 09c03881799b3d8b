"""Regular expressions over review text, evaluated inside the JVM."""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as kinds
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.columns import bind

# For folded text: Unicode word classes, and only "\\n" ends a line.
FLAGS = "(?Ud)"


def folded(text: Column) -> Column:
    """Lower case, with the four letters that case folding maps onto ASCII replaced.

    A case-sensitive pattern on folded text then finds what a case-insensitive
    one finds on the text itself, several times faster.
    """
    for letter, ascii_letter in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
        text = F.replace(text, F.lit(letter), F.lit(ascii_letter))
    return F.lower(text)


def escape(text: str) -> str:
    """Quote a literal for a regular expression."""
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def any_of(variants) -> str:
    """Alternation of the variants for folded text."""
    return "|".join(escape(v.lower()) for v in variants)


def mentions_any(text: Column, variants) -> Column:
    """True when folded text has a variant that no Latin letter touches.

    A plain substring test goes first; most texts name no product at all.
    """
    found = None
    for v in variants:
        hit = F.contains(text, F.lit(v.lower()))
        found = hit if found is None else found | hit
    return found & text.rlike(f"(?<![a-z])(?:{any_of(variants)})(?![a-z])")


def needed_literals(pattern: str) -> list[str] | None:
    """Strings of which every match of a (case-sensitive) pattern holds one; None if nothing can be said."""
    def of_sequence(items) -> list[str] | None:
        choices, run = [], ""
        for kind, value in [*items, (None, None)]:
            if kind is kinds.LITERAL:
                run += chr(value)
                continue
            if run:
                choices.append([run])
                run = ""
            if kind is kinds.SUBPATTERN:
                choices.append(of_sequence(value[3]))
            elif kind is kinds.BRANCH:
                parts = [of_sequence(p) for p in value[1]]
                choices.append(None if None in parts else sorted({x for p in parts for x in p}))
            elif kind is kinds.MAX_REPEAT and value[0] > 0:
                choices.append(of_sequence(value[2]))
        # the set whose shortest string is longest spares most
        return max((c for c in choices if c), key=lambda c: min(map(len, c)), default=None)

    return of_sequence(_parser.parse(pattern))


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    """`rlike`, run only on texts that hold one of the strings a match needs."""
    found = text.rlike(flags + pattern)
    some = [F.contains(text, F.lit(x)) for x in needed_literals(pattern) or []]
    return reduce(Column.__or__, some) & found if some else found


def labels_matching(text: Column, patterns: dict[str, str], flags: str = "") -> Column:
    """Labels, in dictionary order, whose pattern occurs in the text."""
    def hits(t: Column) -> Column:
        return F.array(*[F.when(matches(t, pattern, flags), F.lit(label)) for label, pattern in patterns.items()])

    return F.filter(bind(text, hits), lambda x: x.isNotNull())


def word_count(text: Column) -> Column:
    """Number of pieces when splitting at single spaces."""
    return F.size(F.split(text, " ", -1))


def one_line(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def snippet(text: Column, length: int = 140) -> Column:
    """The first characters of a text, on one line, for reports."""
    return one_line(F.substring(text, 1, length))
