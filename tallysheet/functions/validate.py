"""Validation of expressions by a grammar of our own; nothing is evaluated.

An expression is made of numbers, names, the operators ``+ - * / ^ **``, signs,
parentheses, and products without a sign between neighbours (``2x``, ``f(x)``,
``(a)(b)``). An equation is two expressions around its first ``=``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysheet.functions.text import let, strip

MAX_LENGTH = 500


def clean(text: Column) -> Column:
    """V3: white space collapsed; without an equals sign ``**`` becomes ``^``."""
    tidy = strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
    return let(tidy, lambda t: F.when(F.contains(t, F.lit("=")), t).otherwise(F.replace(t, F.lit("**"), F.lit("^"))))


def kinds(expression: Column) -> Column:
    """One letter for each token: n for an operand, s for a sign, o for another operator, parentheses, x for what has no place."""
    out = F.regexp_replace(expression, r"[A-Za-z_][A-Za-z_0-9]*|[0-9]+(?:\.[0-9]*)?|\.[0-9]+", "\u0001")
    out = F.regexp_replace(out, r"\*\*", "\u0002")
    out = F.translate(out, "*/^", "\u0002\u0002\u0002")
    out = F.translate(out, "+-", "\u0003\u0003")
    out = F.regexp_replace(F.replace(out, F.lit(" "), F.lit("")), "[^()\u0001-\u0003]", "x")
    return F.translate(out, "\u0001\u0002\u0003", "nos")


def parses(expression: Column) -> Column:
    """Whether an expression follows the grammar: one fold over its tokens.

    The state is the depth of parentheses, doubled, plus 1 after an operand;
    -1 once something is out of place. Empty expressions don't parse.
    """
    # Prose is told apart by its first foreign character; only what remains is split into tokens.
    foreign = expression.rlike(r"[^A-Za-z0-9_.()+*/^ \-]")
    tokens = F.filter(F.split(kinds(expression), ""), lambda t: t != "")

    def step(state: Column, t: Column) -> Column:
        held, level = state % 2 == 1, state - state % 2
        return (
            F.when(state < 0, F.lit(-1))
            .when(t == "n", level + 1)
            .when(t == "(", level + 2)
            .when(t == "s", level)
            .when((t == "o") & held, level)
            .when((t == ")") & held & (level >= 2), level - 1)
            .otherwise(F.lit(-1))
        )

    return F.coalesce(~foreign & (F.aggregate(tokens, F.lit(0), step) == 1), F.lit(False))


def is_expression(text: Column) -> Column:
    """V2 and V4: whether a text parses, an equation by both of its sides."""

    def judged(tidy: Column) -> Column:
        sides = F.split(tidy, "=", 2)
        return F.when(F.contains(tidy, F.lit("=")), parses(sides[0]) & parses(sides[1])).otherwise(parses(tidy))

    # A character that no expression holds settles the matter before anything is cleaned.
    return F.when(text.rlike(r"[,;:!?\"$%&#@|~<>{}\[\]]"), F.lit(False)).otherwise(let(clean(text), judged))


def validated(original: Column, fixed: Column, keep_original: bool = True) -> Column:
    """V1: the corrected text if it parses or is too long to try, else the original."""
    if not keep_original:
        return fixed
    return F.when((F.length(fixed) > MAX_LENGTH) | is_expression(fixed), fixed).otherwise(original)
