"""The text rules as SQL for an engine whose regular expressions know no lookaround."""

from __future__ import annotations

from tallysheet.sources.relations import TEXTS_SQL

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def sub(pattern: str, replacement: str, times: int = 1) -> list[str]:
    """Steps over ``text``; what lookaround would leave in place is put back, and neighbours are found by a second pass."""
    return [f"regexp_replace(text, '{pattern}', {replacement if '||' in replacement else repr_sql(replacement)}, 'g')"] * times


def repr_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lookalikes(letters: str, before: str = "", after: str = "") -> list[list[str]]:
    return [sub(rf"([0-9+\-*/=\s{before}]){c}([0-9+\-*/=\s{after}])", rf"\g1{d}\g2".replace("\\g", "\\"), 2) for c, d in zip("OlISZ", "01152", strict=True) if c in letters]


SIGNS = [["replace(text, '×', '*')"], ["replace(text, '÷', '/')"], ["replace(text, '−', '-')"]]
RULES_T1_T4 = [*lookalikes("OlISZ", r"\(", r"\)"), *SIGNS, sub(r"([a-zA-Z])(\d)", r"\1*\2"), sub(r"(\d)([a-zA-Z])", r"\1*\2"), sub(r"(\d)\s*[oO]\s*(\d)", r"\10\2", 2)]
TYPES = ["letter_to_digit"] * 5 + ["operator_normalization"] * 3 + ["implicit_multiplication"] * 2 + ["contextual_digit"]
MINUS = [*sub(r"(^|\D)\s*-\s*(\d)", r"\1 -\2"), *sub(r"(\d)\s*-\s*(\d)", r"'\1' || chr(1) || '\2'", 2), "replace(text, chr(1), ' - ')", *sub(r"\)\s*-\s*(\d)", r") - \1")]
BALANCE = """CASE WHEN o > c THEN text || repeat(')', o - c)
  WHEN c > o THEN array_to_string(list_slice(string_split(text, ')'), 1, o + 1), ')') || array_to_string(list_slice(string_split(text, ')'), o + 2, c + 1), '') ELSE text END"""
COUNTED = "CAST(length(text) - length(replace(text, '(', '')) AS INTEGER) AS o, CAST(length(text) - length(replace(text, ')', '')) AS INTEGER) AS c"
AFTER = [*sub(r"(\d+)\s*/\s*(\d+)", r"\1/\2"), *sub(r"\(\s*(\d+)\s*/\s*(\d+)\s*\)", r"(\1/\2)"), *sub(r"([a-zA-Z]+)\s*/\s*([a-zA-Z0-9]+)", r"\1/\2"), *sub(r"([a-zA-Z0-9]+)\s*\^\s*([0-9]+)", r"\1^\2"), *sub(r"([a-zA-Z0-9]+)\s*\*\*\s*([0-9]+)", r"\1^\2")]


def chain(source: str, steps: list[str], name: str, keep: str = "id, original") -> tuple[str, str]:
    """CTEs that apply steps one after another; the name of the last."""
    out, last = [], source
    for k, step in enumerate(steps):
        out.append(f"{name}{k} AS (SELECT {keep}, {step} AS text FROM {last})")
        last = f"{name}{k}"
    return ", ".join(out), last


def corrected_ctes(prefix: str = "k") -> tuple[str, str]:
    """CTEs from ``texts`` to (id, original, text), text being corrected by T1 to T9."""
    flat = [s for rule in RULES_T1_T4 for s in rule] + sub(r"\s*=\s*", " = ") + sub(r"\s*\+\s*", " + ") + MINUS + sub(r"\s*\*\s*", " * ") + sub(r"\s*/\s*", " / ")
    a, last = chain("src", flat, f"{prefix}a")
    b, end = chain(f"{prefix}bal", AFTER, f"{prefix}b")
    return (
        f"src AS (SELECT id, text AS original, text FROM texts), {a}, {prefix}cnt AS (SELECT *, {COUNTED} FROM {last}), {prefix}bal AS (SELECT id, original, {BALANCE} AS text FROM {prefix}cnt), {b}, "
        f"fixed AS (SELECT id, original, CASE WHEN {STRIP.format('original')} = '' THEN original ELSE text END AS text FROM {end})"
    ), "fixed"


def parses_sql(expression: str) -> str:
    """The grammar as a fold over token codes: n, s, o, opening, closing, other."""
    kinds = rf"regexp_replace({expression}, '[A-Za-z_][A-Za-z_0-9]*|[0-9]+(\.[0-9]*)?|\.[0-9]+', chr(1), 'g')"
    kinds = rf"translate(translate(regexp_replace({kinds}, '\*\*', chr(2), 'g'), '*/^', chr(2) || chr(2) || chr(2)), '+-', chr(3) || chr(3))"
    codes = f"list_transform(string_split(replace({kinds}, ' ', ''), ''), lambda t: CASE t WHEN chr(1) THEN 1 WHEN chr(3) THEN 2 WHEN chr(2) THEN 3 WHEN '(' THEN 4 WHEN ')' THEN 5 ELSE 6 END)"
    step = "CASE WHEN a < 0 THEN -1 WHEN x = 1 THEN a - a % 2 + 1 WHEN x = 4 THEN a - a % 2 + 2 WHEN x = 2 THEN a - a % 2 WHEN x = 3 AND a % 2 = 1 THEN a - a % 2 WHEN x = 5 AND a % 2 = 1 AND a > 1 THEN a - 2 ELSE -1 END"
    return f"(CASE WHEN replace({expression}, ' ', '') = '' THEN FALSE ELSE list_reduce({codes}, lambda a, x: {step}, 0) = 1 END)"


def expression_sql(column: str) -> str:
    tidy = STRIP.format(f"regexp_replace({column}, '\\s+', ' ', 'g')")
    left, right = f"substr({tidy}, 1, strpos({tidy}, '=') - 1)", f"substr({tidy}, strpos({tidy}, '=') + 1)"
    plain = f"replace({tidy}, '**', '^')"
    return f"(CASE WHEN contains({tidy}, '=') THEN {parses_sql(left)} AND {parses_sql(right)} ELSE {parses_sql(plain)} END)"


def rule_query(steps: list[str], first: str = "text", last: str = STRIP.format("text")) -> str:
    body, end = chain("src", steps, "s")
    return f"WITH {TEXTS_SQL}, src AS (SELECT id, text AS original, {first} AS text FROM texts), {body} SELECT id, {last} AS fixed FROM {end}"


COLLAPSED = STRIP.format("regexp_replace(text, '\\s+', ' ', 'g')")
PRINTED = [*sub(r"(\d+)\s*/\s*(\d+)", r"\1/\2"), *sub(r"\s*=\s*", " = "), *sub(r"\s*\+\s*", " + "), *sub(r"\s*-\s*", " - "), *sub(r"\s*\*\s*", " * "), *sub(r"(\d)\s*x\s*(\d)", r"\1 * \2"), *sub(r"\s*\(\s*", "("), *sub(r"\s*\)\s*", ") "), *sub(r"\s+", " ")]
EASY = [s for r in (*lookalikes("OlISZ"), *SIGNS) for s in r] + [*sub(r"(\d+)\s*/\s*(\d+)", r"\1/\2"), *sub(r"\s*=\s*", " = "), *sub(r"\s*\+\s*", " + "), *sub(r"\s*-\s*", " - "), *sub(r"\s*\*\s*", " * "), *sub(r"\s*\(\s*", "("), *sub(r"\s*\)\s*", ") "), *sub(r"\s+", " ")]
HAND = [*sub(r"\s*=\s*", " = "), *sub(r"\s*\+\s*", " + "), *sub(r"\s*-\s*", " - "), *sub(r"\s*\*\s*", " * "), *sub(r"\s*/\s*", " / "), *sub(r"\s*\^\s*", "^"), *sub(r"\s*\(\s*", "("), *sub(r"\s*\)\s*", ") "), *(s for r in lookalikes("OlI") for s in r), *sub(r"\s+", " ")]


def corrector_query() -> str:
    ctes, last = corrected_ctes()
    return f"WITH {TEXTS_SQL}, {ctes} SELECT id, text AS corrected FROM {last}"


def types_query() -> str:
    """One count for each rule that changed a text, by comparing neighbouring stages."""
    ctes, source, out = ["src AS (SELECT id, text AS original, text FROM texts)"], "src", []
    for k, (rule, kind) in enumerate(zip(RULES_T1_T4, TYPES, strict=True)):
        body, last = chain(source, rule, f"r{k}_")
        ctes.append(body)
        out.append(f"SELECT '{kind}' AS type, count(*) AS n FROM {source} a JOIN {last} b ON a.id = b.id WHERE a.text <> b.text")
        source = last
    return f"WITH {TEXTS_SQL}, {', '.join(ctes)}, al AS ({' UNION ALL '.join(out)}) SELECT type, CAST(sum(n) AS BIGINT) AS corrections FROM al GROUP BY type HAVING sum(n) > 0"


def validation_query() -> str:
    ctes, last = corrected_ctes()
    return f"""WITH {TEXTS_SQL}, {ctes}, p AS (SELECT id, original, text, {expression_sql('original')} AS original_parses, {expression_sql('text')} AS corrected_parses FROM {last})
SELECT id, original_parses, corrected_parses, CASE WHEN length(text) > 500 OR corrected_parses THEN text ELSE original END AS final_text,
       CAST(CASE WHEN NOT original_parses AND corrected_parses THEN 0.3 WHEN original_parses AND corrected_parses THEN 0.1 WHEN length(original) <> length(text) THEN 0.05 ELSE 0 END AS DOUBLE) AS estimated_improvement FROM p"""


def formula_query() -> str:
    from tallysheet.functions.text import COMPLEXITY, FORMULA_GROUPS

    hit = [(n, t, c, f"regexp_matches(text, '{'|'.join(p)}')") for n, t, c, _, p in FORMULA_GROUPS]
    marks = [(n, f"regexp_matches(text, '{p}')") for p, n in COMPLEXITY]
    names = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in [(n, c) for n, _, _, c in hit] + marks)
    last = lambda i: " ".join(f"WHEN {h[3]} THEN {repr_sql(h[i]) if isinstance(h[i], str) else h[i]}" for h in reversed(hit))
    score = " + ".join(f"CAST({c} AS INTEGER)" for _, c in marks)
    groups = " + ".join(f"CAST({h[3]} AS INTEGER)" for h in hit)
    latex = [*sub(r"\^(\d+)", r"^{\1}"), *sub(r"(\d+)/(\d+)", r"\\frac{\1}{\2}"), *sub(r"sqrt\(([^)]+)\)", r"\\sqrt{\1}"), *(s for f in ("sin", "cos", "tan", "log") for s in sub(rf"{f}\(([^)]+)\)", rf"\\{f}(\1)"))]
    body, end = chain("src", latex, "l")
    return f"""WITH {TEXTS_SQL}, src AS (SELECT id, text AS original, text FROM texts), {body}
SELECT t.id, CASE {last(1)} ELSE 'unknown' END AS type, CAST(CASE {last(2)} ELSE 0 END AS DOUBLE) AS type_confidence,
       array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS components,
       CASE WHEN {score} >= 3 THEN 'complex' WHEN {score} >= 1 THEN 'intermediate' ELSE 'simple' END AS complexity,
       round(greatest(0, least(1, CAST(0.75 AS DOUBLE) + 0.05 * ({groups}) - CASE WHEN length(t.text) > 20 THEN 0.1 ELSE 0 END + CASE WHEN contains(t.text, '=') THEN 0.05 ELSE 0 END
             + CASE WHEN regexp_matches(t.text, '[\\^/()]') THEN 0.02 ELSE 0 END)), 6) AS confidence,
       '$' || l.latex_text || '$' AS latex, length(t.text) AS characters, CASE WHEN length(t.text) > 100 THEN t.text[:100] || '...' ELSE t.text END AS preview
FROM (SELECT id, text FROM texts) t JOIN (SELECT id, text AS latex_text FROM {end}) l ON t.id = l.id"""
