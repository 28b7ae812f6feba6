r"""Text rules for recognised mathematics, as Column functions.

Rules are regular expressions applied one after another; their order is part of
the meaning. White space is Unicode white space and the separators U+001C to
U+001F, digits are Unicode digits: ``(?U)`` sets that in Java. A null text stays
null in every function.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space: outside and inside a character class.
_S, _IN = r"[\s\x1c-\x1f]", r"\s\x1c-\x1f"

#: What a text must hold for the rule to do anything (any of the characters; empty: anything), pattern, replacement.
Rule = tuple[str, str, str]


def _rules(*rules: tuple[str, str, str]) -> list[Rule]:
    return [(need, "(?U)" + p.replace("{s}", _S).replace("{in}", _IN), r) for need, p, r in rules]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` refers to it."""
    return F.transform(F.array(value), then)[0]


def holds(text: Column, characters: str) -> Column:
    """Whether a text holds any of the characters: plain searches, far cheaper than a regular expression."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in characters])


def apply_rule(text: Column, rule: Rule) -> Column:
    need, pattern, replacement = rule
    return F.when(holds(text, need), F.regexp_replace(text, pattern, replacement)).otherwise(text) if need else F.regexp_replace(text, pattern, replacement)


def apply_rules(text: Column, rules: list[Rule]) -> Column:
    return reduce(lambda t, rule: let(t, lambda x: apply_rule(x, rule)) if rule[0] else apply_rule(t, rule), rules, text)


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, f"(?U)^{_S}+|{_S}+$", "")


def collapse(text: Column) -> Column:
    """White-space runs become one space, ends are trimmed."""
    return strip(F.regexp_replace(text, f"(?U){_S}+", " "))


#: Letters that recognition takes for digits: only between two characters of an arithmetic context. Fixed values.
LOOKALIKES = {"O": "0", "l": "1", "I": "1", "S": "5", "Z": "2"}


def _lookalike(letters: str, before: str, after: str) -> list[Rule]:
    return _rules(*((c, f"(?<=[0-9+\\-*/={{in}}{before}]){c}(?=[0-9+\\-*/={{in}}{after}])", LOOKALIKES[c]) for c in letters))


#: T1 to T4 with the type each change is recorded under (T5), in order. Fixed values.
SUBSTITUTIONS: list[tuple[str, Rule]] = [
    *(("letter_to_digit", r) for r in _lookalike("OlISZ", r"\(", r"\)")),
    *(("operator_normalization", r) for r in _rules(("×", "×", "*"), ("÷", "÷", "/"), ("−", "−", "-"))),
    *(("implicit_multiplication", r) for r in _rules(("", r"([a-zA-Z])(\d)", "$1*$2"), ("", r"(\d)([a-zA-Z])", "$1*$2"))),
    *(("contextual_digit", r) for r in _rules(("oO", r"(?<=\d){s}*[oO]{s}*(?=\d)", "0"))),
]
#: T6 to T9 and the clean-up of single engines. Fixed values.
EQUALS, PLUS, TIMES, OVER = _rules(("=", r"{s}*={s}*", " = "), ("+", r"{s}*\+{s}*", " + "), ("*", r"{s}*\*{s}*", " * "), ("/", r"{s}*/{s}*", " / "))
MINUS, POWER, OPENING, CLOSING, FRACTION = _rules(("-", r"{s}*-{s}*", " - "), ("^", r"{s}*\^{s}*", "^"), ("(", r"{s}*\({s}*", "("), (")", r"{s}*\){s}*", ") "), ("/", r"(\d+){s}*/{s}*(\d+)", "$1/$2"))
BLANKS = _rules(("", r"{s}+", " "))
SPACING = [EQUALS, PLUS, *_rules(("-", r"(?<!\d){s}*-{s}*(?=\d)", " -"), ("-", r"(?<=\d){s}*-{s}*(?=\d)", " - "), ("-", r"(?<=\)){s}*-{s}*(?=\d)", " - ")), TIMES, OVER]
FRACTIONS = [FRACTION, *_rules(("/", r"\({s}*(\d+){s}*/{s}*(\d+){s}*\)", "($1/$2)"), ("/", r"([a-zA-Z]+){s}*/{s}*([a-zA-Z0-9]+)", "$1/$2"))]
EXPONENTS = _rules(("^", r"([a-zA-Z0-9]+){s}*\^{s}*([0-9]+)", "$1^$2"), ("*", r"([a-zA-Z0-9]+){s}*\*\*{s}*([0-9]+)", "$1^$2"))


def substitute(text: Column) -> Column:
    """Look-alike letters, operator signs, implicit products, a letter o among digits."""
    return apply_rules(text, [rule for _, rule in SUBSTITUTIONS])


def with_substitution_types(rows: DataFrame, text: str = "text", name: str = "types") -> DataFrame:
    """T5: the rows with one entry in ``name`` for each rule that changed the text, in rule order, as ``array<string>``.

    The rules run through one fold over an array of stages, so that no stage is
    computed twice.
    """
    start = F.struct(F.col(text).alias("t"), F.array().cast("array<string>").alias("types"))

    def step(state: Column, kind: str, rule: Rule) -> Column:
        changed = let(state, lambda s: F.struct(s["t"].alias("old"), apply_rule(s["t"], rule).alias("t"), s["types"].alias("types")))
        return let(changed, lambda s: F.struct(s["t"].alias("t"), F.when(s["old"] != s["t"], F.concat(s["types"], F.array(F.lit(kind)))).otherwise(s["types"]).alias("types")))

    return rows.withColumn(name, reduce(lambda state, kr: step(state, *kr), SUBSTITUTIONS, start)["types"])


def space_operators(text: Column) -> Column:
    """T6."""
    return apply_rules(text, SPACING)


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def balance_parentheses(text: Column) -> Column:
    """Missing closing parentheses are added at the end; surplus ones go, the last first."""

    def balanced(t: Column) -> Column:
        opened, closed = _count(t, "("), _count(t, ")")
        parts = F.split(t, r"\)")
        cut = F.concat(F.array_join(F.slice(parts, F.lit(1), opened + 1), ")"), F.array_join(F.slice(parts, opened + 2, closed - opened), ""))
        return F.when(opened > closed, F.concat(t, F.repeat(F.lit(")"), opened - closed))).when(closed > opened, cut).otherwise(t)

    return let(text, balanced)


def compact_fractions(text: Column) -> Column:
    """T8."""
    return apply_rules(text, FRACTIONS)


def format_exponents(text: Column) -> Column:
    """T9."""
    return apply_rules(text, EXPONENTS)


def corrected(text: Column, substitutions: bool = True, spacing: bool = True, parentheses: bool = True, fractions: bool = True, exponents: bool = True) -> Column:
    """T1 to T9 with a switch for each stage; blank texts stay as they are. Validation is :mod:`tallysheet.functions.validate`."""
    out = text
    for on, stage in ((substitutions, substitute), (spacing, space_operators), (parentheses, balance_parentheses), (fractions, compact_fractions), (exponents, format_exponents)):
        out = stage(out) if on else out
    return F.when(strip(text) == "", text).otherwise(out)


TESSERACT = [FRACTION, EQUALS, PLUS, MINUS, TIMES, *_rules(("x", r"(\d){s}*x{s}*(\d)", "$1 * $2")), OPENING, CLOSING, *BLANKS]
EASYOCR = [*_lookalike("OlISZ", "", ""), *_rules(("×", "×", "*"), ("÷", "÷", "/"), ("−", "−", "-")), FRACTION, EQUALS, PLUS, MINUS, TIMES, OPENING, CLOSING, *BLANKS]
HANDWRITING = [EQUALS, PLUS, MINUS, TIMES, OVER, POWER, OPENING, CLOSING, *_lookalike("OlI", "", ""), *BLANKS]


def tesseract_notation(text: Column) -> Column:
    """T12 then T11: notation fixes for printed text."""
    return strip(apply_rules(collapse(text), TESSERACT))


def easyocr_symbols(text: Column) -> Column:
    """Symbol fixes for handwriting; the context of a look-alike letter has no parentheses."""
    return strip(apply_rules(text, EASYOCR))


def handwriting_cleanup(text: Column) -> Column:
    """The variant clean-up with compact exponents."""
    return strip(apply_rules(text, HANDWRITING))


def confidence_fraction(percent: Column) -> Column:
    """A percentage as a fraction in [0, 1]; 0 and below, and null, give 0."""
    return F.when(percent > 0, F.least(percent / 100.0, F.lit(1.0))).otherwise(F.lit(0.0))


#: T16. Needed character, pattern and replacement of the LaTeX form.
LATEX = _rules(
    ("^", r"\^(\d+)", r"^{$1}"), ("/", r"(\d+)/(\d+)", r"\\frac{$1}{$2}"), ("(", r"sqrt\(([^)]+)\)", r"\\sqrt{$1}"),
    *(("(", rf"{f}\(([^)]+)\)", rf"\\{f}($1)") for f in ("sin", "cos", "tan", "log")),
)


def to_latex(formula: Column) -> Column:
    return F.concat(F.lit("$"), apply_rules(formula, LATEX), F.lit("$"))


#: T17. Pattern groups: name, type, confidence, characters one of which any match holds, patterns. Fixed values.
FORMULA_GROUPS = [
    ("addition", "arithmetic", 0.9, "+", [r"\d+\s*\+\s*\d+", r"[a-z]\s*\+\s*\d+", r"\d+\s*\+\s*[a-z]"]),
    ("subtraction", "arithmetic", 0.9, "-", [r"\d+\s*-\s*\d+", r"[a-z]\s*-\s*\d+", r"\d+\s*-\s*[a-z]"]),
    ("multiplication", "arithmetic", 0.85, "", [r"\d+\s*[\*×]\s*\d+", r"[a-z]\s*[\*×]\s*\d+", r"\d+[a-z]", r"[a-z]\d+"]),
    ("division", "arithmetic", 0.85, "/÷", [r"\d+\s*[/÷]\s*\d+", r"[a-z]\s*[/÷]\s*\d+"]),
    ("linear_equation", "algebra", 0.8, "=", [r"[a-z]\s*=\s*\d+", r"\d+[a-z]\s*[+\-]\s*\d+\s*=\s*\d+"]),
    ("quadratic", "algebra", 0.75, "2²", [r"[a-z]\^?2", r"[a-z]\*\*2", r"[a-z]²"]),
    ("fraction", "fraction", 0.8, "/", [r"\d+/\d+", r"[a-z]/[a-z]", r"\([^)]+\)/\([^)]+\)"]),
    ("exponent", "exponent", 0.75, "^*", [r"[a-z0-9]\^[0-9]", r"[a-z0-9]\*\*[0-9]"]),
    ("functions", "function", 0.7, "(", [r"sin\([^)]+\)", r"cos\([^)]+\)", r"tan\([^)]+\)", r"log\([^)]+\)", r"ln\([^)]+\)"]),
]
#: T18. What makes a formula complex.
COMPLEXITY = [(r"\^", "exponent"), ("/", "fraction"), (r"\(.*\)", "parentheses"), ("sin|cos|tan|log|ln", "function"), ("√", "radical")]


def _any(formula: Column, need: str, patterns: list[str]) -> Column:
    hit = formula.rlike("(?U)" + "|".join(p.replace(r"\s", _S) for p in patterns))
    return holds(formula, need) & hit if need else hit


def formula_analysis(formula: Column, base: float = 0.75, noise: Column | None = None) -> Column:
    """T17 to T19 as ``struct<type, type_confidence, components, complexity, confidence>``; each pattern is tried once.

    The type and its confidence are those of the last group that matches
    (``unknown`` and 0 if none does); components are the groups and then the
    complexity marks that match, in order; three marks are complex, one is
    intermediate. The confidence is that of a stand-in recogniser, in [0, 1];
    ``noise`` (off by default) is added before clamping.
    """
    flags = F.array(*[_any(formula, need, p) for _, _, _, need, p in FORMULA_GROUPS], *[formula.rlike(p) for p, _ in COMPLEXITY])
    n = len(FORMULA_GROUPS)

    def judged(f: Column) -> Column:
        names = [g[0] for g in FORMULA_GROUPS] + [name for _, name in COMPLEXITY]
        last = lambda k, default: F.coalesce(*[F.when(f[i], F.lit(FORMULA_GROUPS[i][k])) for i in reversed(range(n))], F.lit(default))
        total = lambda first, end: reduce(lambda a, b: a + b, [f[i].cast("int") for i in range(first, end)])
        score = F.lit(base) + 0.05 * total(0, n) - F.when(F.length(formula) > 20, 0.1).otherwise(0.0)
        score = score + F.when(holds(formula, "="), 0.05).otherwise(0.0) + F.when(holds(formula, "^/()"), 0.02).otherwise(0.0)
        marks = total(n, len(names))
        return F.struct(
            last(1, "unknown").alias("type"), last(2, 0.0).alias("type_confidence"), F.array_compact(F.array(*[F.when(f[i], F.lit(name)) for i, name in enumerate(names)])).alias("components"),
            F.when(marks >= 3, "complex").when(marks >= 1, "intermediate").otherwise("simple").alias("complexity"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + noise if noise is not None else score)).alias("confidence"),
        )

    return let(flags, judged)


def formula_type(formula: Column) -> Column:
    return formula_analysis(formula)["type"]


def formula_components(formula: Column) -> Column:
    return formula_analysis(formula)["components"]


def formula_complexity(formula: Column) -> Column:
    return formula_analysis(formula)["complexity"]


def formula_confidence(formula: Column, base: float = 0.75, noise: Column | None = None) -> Column:
    return formula_analysis(formula, base, noise)["confidence"]


def contains_token(text: Column, token: Column) -> Column:
    """Whether a text without its spaces holds a token."""
    return F.contains(F.replace(text, F.lit(" "), F.lit("")), token)


def recognition_rate(text: Column, tokens: Column) -> Column:
    """Share of the expected tokens found; 0 for no tokens."""
    found = F.size(F.filter(tokens, lambda t: contains_token(text, t)))
    return F.coalesce(F.try_divide(found.cast("double"), F.size(tokens).cast("double")), F.lit(0.0))


def character_count(text: Column) -> Column:
    """Code points, 0 for null."""
    return F.coalesce(F.char_length(text), F.lit(0))


def preview(text: Column, length: int = 100) -> Column:
    """The first characters, with an ellipsis where text is left out."""
    return F.when(F.char_length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def improvement(original_parses: Column, corrected_parses: Column, original: Column, fixed: Column) -> Column:
    """Estimated gain of a correction."""
    return F.when(~original_parses & corrected_parses, 0.3).when(original_parses & corrected_parses, 0.1).when(F.length(original) != F.length(fixed), 0.05).otherwise(0.0)
