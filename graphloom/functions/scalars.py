"""Scalar expressions shared by the operators."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)


def log2_branches(c: Column) -> Column:
    """log2 of a branch count; an invalid or missing count weighs nothing."""
    return F.coalesce(F.when(c >= 1, F.log2(c.cast("double"))), F.lit(0.0))


def round6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def milli(c: Column) -> Column:
    return F.round(c * 1000).cast("long")


def band(c: Column, most: int = 5) -> Column:
    """Half away from zero, held to -most..most."""
    half = F.signum(c) * F.floor(F.abs(c) + 0.5)
    return F.greatest(F.lit(-most), F.least(F.lit(most), half)).cast("int")


def changed(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def glob_regex(pattern: str, path: bool = True) -> str:
    """A glob as a regular expression: in path mode ``*`` stops at ``/`` and skips leading dots."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if path and pattern.startswith("**/", i):
            out, i = out + r"(?:(?!\.)[^/]+/)*", i + 3
            continue
        if c == "*":
            start = path and (i == 0 or pattern[i - 1] == "/")
            out += (r"(?!\.)" if start else "") + ("[^/]*" if path else ".*")
        elif c == "?":
            out += "[^/]" if path else "."
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out += "(?:" + "|".join(glob_regex(p, path)[1:-1] for p in pattern[i + 1 : end].split(",")) + ")"
            i = end
        elif c == "[" and "]" in pattern[i:]:
            end = pattern.index("]", i)
            out += pattern[i : end + 1].replace("[!", "[^")
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def glob_match(c: Column, patterns: list[str], path: bool = True) -> Column:
    """An exact name first, so that brackets in a symbol match themselves; then the globs."""
    if not patterns:
        return F.lit(False)
    return c.isin(patterns) | c.rlike("|".join(glob_regex(p, path) for p in patterns))
