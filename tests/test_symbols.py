import random

import pytest
from pyspark.sql import functions as F

from tallysheet.operators import symbols as S

#: Format words, a version word and check codewords that the public standard and its common examples print.
PRINTED_FORMATS = {("L", 0): "111011111000100", ("M", 0): "101010000010010", ("Q", 7): "010101111101101", ("H", 2): "001110011100111"}
HELLO_WORLD = [32, 91, 11, 120, 209, 114, 220, 77, 67, 64, 236, 17, 236, 17, 236, 17]
HELLO_WORLD_CHECKS = [196, 35, 39, 119, 235, 215, 231, 226, 93, 23]


def plain_penalty(m):
    """The four rules, module by module."""
    n, out = len(m), 0
    lines = [*m, *map(list, zip(*m, strict=True))]
    for line in lines:
        run = 1
        for a, b in zip(line, [*line[1:], None], strict=True):
            if a == b:
                run += 1
            else:
                out, run = out + (run - 2 if run >= 5 else 0), 1
        text = "".join("01"[x] for x in line)
        out += 40 * sum(text.startswith(p, k) for k in range(n - 10) for p in ("10111010000", "00001011101"))
    out += 3 * sum(m[r][c] == m[r][c + 1] == m[r + 1][c] == m[r + 1][c + 1] for r in range(n - 1) for c in range(n - 1))
    dark = sum(map(sum, m))
    return out + 10 * int(abs(dark * 20 - n * n * 10) // (n * n))


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(4)
    texts = [("".join(rnd.choice("aé{}\":, 漢x") for _ in range(n)), lv) for n, lv in ((0, "L"), (1, "H"), (9, "M"), (25, "Q"), (50, "L"), (40, "H"), (70, "M"), (60, "Q"), (100, "L"))]
    texts += [("x" * row[4], row[1]) for row in S.table_rows() if row[0] in (1, 6, 9, 10)]
    df = spark.createDataFrame(texts, "payload string, level string").repartition(4)
    return S.encoded(df).cache()


def test_words_of_the_standard():
    for (level, mask), word in PRINTED_FORMATS.items():
        assert f"{S.format_word(level, mask):015b}" == word
    assert f"{S.coded(7, 6, S.VERSION_CODE):018b}" == "000111110010010100"
    assert [len(S.data_places(v)) // 8 for v in S.VERSIONS] == [26, 44, 70, 100, 134, 172, 196, 242, 292, 346]
    assert {v: S.centres(v) for v in (1, 2, 7, 8, 9, 10)} == {1: [], 2: [6, 18], 7: [6, 22, 38], 8: [6, 24, 42], 9: [6, 26, 46], 10: [6, 28, 50]}


def test_check_codewords(spark):
    df = spark.createDataFrame([(HELLO_WORLD, S.generator(10))], "d array<int>, g array<int>").withColumns(S.field_columns())
    assert df.select(S.check_codewords(F.col("d"), F.col("g")).alias("c")).first().c == HELLO_WORLD_CHECKS


def test_round_trip_and_capacity(made):
    rows = S.decoded(made).collect()
    assert all(r.decoded == r.payload and r.errors == 0 and r.decode_error is None for r in rows)
    assert {r.version for r in rows} >= {1, 6, 9, 10}
    for r in rows:
        room = {(v, lv): most for v, lv, _, _, most, *_ in S.table_rows()}
        n = len(r.payload.encode())
        assert n <= room[r.version, r.level] and (r.version == 1 or n > room[r.version - 1, r.level])


def test_fixed_modules_and_least_penalty(spark, made):
    rows = made.withColumn("m", S.modules(F.col("symbol"), F.col("size"))).withColumn("same", S.from_modules(F.col("m")) == F.col("symbol")).collect()
    assert all(r.same for r in rows)
    for r in rows[:8]:
        fixed, size = S.drawn(r.version), S.size_of(r.version)
        formats = {p for copy in S.format_places(size) for p in copy}
        assert all(r.m[a][b] == dark for (a, b), dark in fixed.items() if (a, b) not in formats)
        word = S.format_word(r.level, r.mask)
        for copy in S.format_places(size):
            assert all(r.m[a][b] == bool(word >> k & 1) for k, (a, b) in enumerate(copy))
        # Turned back and masked in each of the eight ways, none has a smaller penalty, and none before it an equal one.
        found = []
        for k, turn in enumerate(S.MASKS):
            m = [[x ^ ((a, b) not in fixed and S.MASKS[r.mask](a, b) ^ turn(a, b)) for b, x in enumerate(row)] for a, row in enumerate(r.m)]
            for copy in S.format_places(size):
                for i, (a, b) in enumerate(copy):
                    m[a][b] = bool(S.format_word(r.level, k) >> i & 1)
            found.append(plain_penalty(m))
        assert found.index(min(found)) == r.mask


def damaged(made, hits):
    """Symbols with bits of ``hits(codewords, blocks, checks)`` codewords turned."""
    table = {(row[0], row[1]): row for row in S.table_rows()}
    rows = []
    for r in made.collect():
        _, _, _, _, _, checks, _, blocks, _, spots, *_ = table[r.version, r.level]
        places = [spots[8 * word + bit] for word, bit in hits(blocks, checks)]
        rows.append((r.payload, r.level, r.symbol, places))
    return made.sparkSession.createDataFrame(rows, "payload string, level string, symbol array<bigint>, places array<int>").repartition(4).withColumn("symbol", S.flipped(F.col("symbol"), F.col("places")))


def test_errors_up_to_the_capacity_of_each_block(made):
    rnd = random.Random(6)
    hits = lambda blocks, checks: [(w, bit) for b in blocks for w in rnd.sample(b, checks // 2) for bit in rnd.sample(range(8), rnd.randrange(1, 9))]
    for r in S.decoded(damaged(made, hits)).collect():
        assert r.decoded == r.payload and r.errors > 0 and r.decode_error is None


def test_too_many_errors_never_give_another_text(made):
    rnd = random.Random(7)
    hits = lambda blocks, checks: [(w, bit) for w in rnd.sample(blocks[0], min(len(blocks[0]), checks)) for bit in (1, 4)]
    got = S.decoded(damaged(made, hits)).collect()
    bad = [r for r in got if r.decode_error == "too many errors"]
    assert len(bad) >= len(got) - 2 and all(r.decoded is None and r.errors is None for r in bad)


def test_format_errors(spark, made):
    """Three modules of either copy may be wrong; without both copies there is no format."""
    rows = made.limit(3)
    one = rows.withColumn("symbol", S.flipped(F.col("symbol"), F.array(*[F.col("size") - 9 + F.lit(64 * r) for r in (0, 1, 2)])))
    assert all(r.decoded == r.payload for r in S.decoded(one).collect())
    none = rows.withColumn("symbol", F.transform("symbol", lambda x: F.lit(0).cast("long")))
    assert {(r.decoded, r.decode_error) for r in S.decoded(none).collect()} == {(None, "no format")}


def test_what_has_no_symbol(spark):
    df = spark.createDataFrame([(None, "L"), ("a", None), ("a", "X"), ("x" * 272, "L"), ("x" * 120, "H")], "payload string, level string")
    got = S.decoded(S.encoded(df)).collect()
    assert all(r.symbol is None and r.version is None and r.decode_error == "no symbol" for r in got)
    odd = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "symbol array<bigint>")
    assert {r.decode_error for r in S.decoded(odd).collect()} == {"no symbol"}
    assert S.decoded(S.encoded(df.limit(0))).count() == 0
