import pytest

#: Columns whose names the operators use themselves.
CLASH = "digest string, kept string, score double, component_id long, size string, source_size long, target string, copies int, found string, print long, lead long, row long, chars string, decoded string, token_ids string"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clash=True):
        """Documents from (doc_id, text[, lang[, source]]), with columns of clashing names."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, 0) for r in rows]
        n = len(CLASH.split(", ")) if clash else 0
        return spark.createDataFrame([(*r, *[None] * n) for r in full], "doc_id long, text string, lang string, source string, n_chars long" + (", " + CLASH if clash else ""))

    return make


#: Null, empty, blank, short, repeated, long.
ODD = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "a"), (5, "word two"), (6, "Word two"), (6, "Word two"), (7, "x" * 300_000), (8, "ab " * 60_000), (9, "één tiên 漢字 😀"), (None, "no id"), (10, "word\ttwo ")]
