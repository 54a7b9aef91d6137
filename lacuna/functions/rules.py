"""Rule tables as column expressions: one scan, no join against patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Cue(str):
    """A pattern with ASCII strings in lower case of which every text that it matches holds one, without case.

    A search for plain strings costs a small part of a search for a pattern, and most sentences hold none of a rule's.
    """

    needs: tuple[str, ...]

    def __new__(cls, pattern: str, *needs: str):
        if not needs or any(not n.isascii() or n != n.lower() or n != n.strip() or not n for n in needs):
            raise ValueError("a cue needs ASCII strings in lower case, without blanks around them")
        own = super().__new__(cls, pattern)
        own.needs = needs
        return own


def folded(text: Column) -> Column:
    """The text in which any sign that a pattern without case takes for an ASCII letter is that letter in lower case."""
    for sign, letter in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        text = F.replace(text, F.lit(sign), F.lit(letter))
    return F.lower(text)


def matches(text: Column, pattern: str, ignore_case: bool = True, low: Column | None = None) -> Column:
    """Whether a text holds the pattern; with ``low``, the folded text, only texts that hold what a ``Cue`` needs are searched."""
    found = text.rlike(("(?iU)" if ignore_case else "(?U)") + pattern if not pattern.startswith("(?") else pattern)
    return contains_any(low, pattern.needs) & found if low is not None and isinstance(pattern, Cue) else found


def any_match(text: Column, patterns: list[str], low: Column | None = None) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | matches(text, p, low=low)
    return found


def weight_sum(text: Column, rules: list[tuple[str, float]], base: float = 0.0, low: Column | None = None) -> Column:
    """``base`` plus the weights of all patterns that match."""
    total = F.lit(base)
    for pattern, weight in rules:
        total = total + F.when(matches(text, pattern, low=low), F.lit(float(weight))).otherwise(F.lit(0.0))
    return total


def weight_max(text: Column, rules: list[tuple[str, float]], low: Column | None = None) -> Column:
    """The largest weight of a matching pattern, 0 if none does."""
    best = [F.when(matches(text, p, low=low), F.lit(float(w))).otherwise(F.lit(0.0)) for p, w in rules]
    return F.greatest(*best) if len(best) > 1 else best[0]


def first_match(text: Column, rules: list[tuple[str, object]], default=None) -> Column:
    """The value of the first pattern that matches."""
    chosen = None
    for pattern, value in rules:
        chosen = F.when(matches(text, pattern), F.lit(value)) if chosen is None else chosen.when(matches(text, pattern), F.lit(value))
    return chosen.otherwise(F.lit(default))


def contains_any(text: Column, phrases) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found
