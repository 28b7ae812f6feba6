import hashlib
import os
import re
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallysheet.llm import chat

SHAPE = "conv_id long, turn long, role string, text string, mid string, lines string, level string, root string, rank string"


def brute(rows):
    """Reply, thread, quoted lines and own text of each message, message by message."""
    out = {}
    for conv in {r[0] for r in rows}:
        first, thread = {}, {}
        for _, turn, _, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            split = []
            for s in (text or "").split("\n"):
                mark = re.match(r"(?:[ \t]*>)+", s)
                level, rest = (mark[0].count(">"), s[mark.end() :]) if mark else (0, s)
                split.append((level, re.sub("^ ", "", rest)))
            if any(level for level, _ in split):
                split = [x for x in split if x[0] or not re.match(chat.ATTRIBUTION, x[1])]
            norm = lambda s: " ".join(s.lower().split())
            votes = {}
            for level, s in split:
                if level and norm(s) in first:
                    votes[level, first[norm(s)]] = votes.get((level, first[norm(s)]), 0) + 1
            parent = min(votes, key=lambda k: (k[0], -votes[k], -k[1]))[1] if votes else None
            thread[turn] = turn if parent is None else thread[parent]
            for level, s in split:
                if not level and norm(s):
                    first.setdefault(norm(s), turn)
            out[conv, turn] = (parent, thread[turn], sum(level > 0 for level, _ in split), "\n".join(s for level, s in split if not level).strip())
    return out


def conversations():
    rows = []
    for conv in range(6):
        said = []
        for turn in range(30):
            own = f"Message {turn} of {conv}.\nThe second   line {turn % 4}."
            text = own
            if turn and turn % 3:
                to = (turn * 7 + conv) % turn
                text = f"On Monday, u{to} wrote:\n" + "\n".join(f"> {x}".replace("Message", "MESSAGE") for x in said[to].split("\n")) + "\n> > an unknown line\n" + own
            said.append(own)
            rows.append((conv, turn, ["user", "assistant"][turn % 2], text))
    # A chain: each message quotes the one before it.
    rows += [(100, t, "user", f"line {t}" if t == 0 else f"> line {t - 1}\nline {t}") for t in range(80)]
    return rows


def test_same_as_message_by_message(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, *[None] * 5) for r in rows], SHAPE)
    got = chat.reply_ordered(frame).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.thread, r.n_quoted, r.text) for r in got} == brute(rows) and len(got) == len(rows)
    for conv in {r.conv_id for r in got}:
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.thread, r.turn))
        assert [r.position for r in own] == list(range(len(own)))
    assert all(r.rendered == f"<|{r.role}|>\n{r.text}\n" for r in got) and not any(">" in r.text for r in got)


def test_odd_messages(spark):
    rows = [(1, 0, None, None), (1, 1, "user", ""), (1, 2, "user", "> "), (1, 2, "user", "> "), (None, 0, "a", "hello there"), (None, 1, "b", ">hello  THERE\nyes"), (2, None, "u", "> never said\nyes"), (3, 0, "u", ">" * 5000 + " deep"), (4, 0, "u", "word " * 60_000)]
    got = chat.reply_ordered(spark.createDataFrame([(*r, *[None] * 5) for r in rows], SHAPE)).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert (by[1, 0].role, by[1, 0].text) == ("unknown", "")
    assert (by[None, 1].reply_to, by[None, 1].thread, by[None, 1].text) == (0, 0, "yes")
    assert (by[2, None].reply_to, by[2, None].text, by[2, None].n_quoted) == (None, "yes", 1)
    assert sorted(r.position for r in got if r.conv_id == 1) == [0, 1, 2, 3]
    assert chat.reply_ordered(spark.createDataFrame([], SHAPE)).count() == 0


def test_repeated_lines_and_rewrapped_quotes(spark):
    long = "A first sentence that is rather long. A second one follows it.\nAnd a third line ends it."
    rows = [
        # The finding's case: turn 2 says A, B; turn 9 says A, B, C and is quoted whole.
        (1, 2, "u", "Alpha\nBeta"), (1, 9, "u", "Alpha\nBeta\nGamma"), (1, 10, "u", "> Alpha\n> Beta\n> Gamma\nyes"),
        # One line said three times: the latest before the reply, not a later one.
        (2, 0, "u", "Agreed."), (2, 1, "u", "Agreed."), (2, 2, "u", "> agreed.\nwhy"), (2, 3, "u", "Agreed."), (2, 4, "u", "> Agreed.\nso"),
        # Wrapped at other line ends, whole and by paragraph.
        (3, 0, "u", long), (3, 1, "u", "Other words"), (3, 2, "u", "> A first sentence that\n> is rather long. A second one\n> follows it. And a third\n> line ends it.\nok"),
        (4, 0, "u", "One para of\nwords.\n\nTwo para of\nwords.\n\nThree."), (4, 1, "u", "> Two para\n> of words.\nok"), (4, 2, "u", "> One para of words.\n>\n> Two para of\n> words.\nok"),
        # Lines only where the passage and its paragraphs are not found.
        (5, 0, "u", "a b\nc d\ne f"), (5, 1, "u", "x y"), (5, 2, "u", "> a b\n> e f\nok"),
        # Own text around a quotation; the lowest level that is found.
        (6, 0, "u", "root"), (6, 1, "u", "before\n> root\nafter"), (6, 2, "u", "> before\n> > root\n> after\nlast"), (6, 3, "u", ">> root\n> never said\nlast"),
        (6, 4, "u", "> before after\nlast"),
        (None, 0, "u", "same"), (7, 1, "u", "> same\nno"), (None, 2, "u", "> same\nyes"),
        # A message is no original of its own quote.
        (8, 0, "u", "> me\nme"), (8, 1, "u", "> me\nme"),
    ]
    got = {(r.conv_id, r.turn): r.reply_to for r in chat.reply_ordered(spark.createDataFrame([(*r, *[None] * 5) for r in rows], SHAPE)).collect()}
    want = {(1, 10): 9, (2, 2): 1, (2, 4): 3, (3, 2): 0, (4, 1): 0, (4, 2): 0, (5, 2): 0, (6, 1): 0, (6, 2): 1, (6, 3): 0, (6, 4): 1, (None, 2): 0, (8, 1): 0}
    assert {k: v for k, v in got.items() if v is not None} == want


def test_latest_of_a_passage_said_very_often(spark):
    """The last original is carried over many tasks."""
    rows = [(1, t, "u", "> hello\nno" if t % 50 == 49 else "hello" if t % 50 == 3 or 500 < t < 900 else f"else {t}") for t in range(2000)]
    got = {r.turn: r.reply_to for r in chat.reply_ordered(spark.createDataFrame([(*r, *[None] * 5) for r in rows], SHAPE)).collect()}
    last = None
    for _, t, _, text in rows:
        assert got[t] == (last if text.startswith(">") else None)
        last = t if text == "hello" else last


def wordy(seed):
    """Random threads whose quotations are whole, in part, wrapped anew, nested or made up."""
    import random

    rnd, rows = random.Random(seed), []
    for conv in range(12):
        said = []
        for turn in range(14):
            own = "\n\n".join("\n".join(" ".join(rnd.choice("ab cd ef gh".split()) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 3)))
            parts = []
            for level in range(rnd.randint(0, 2)):
                if said:
                    lines = rnd.choice(said).split("\n")
                    kind = rnd.randrange(4)
                    lines = lines if kind < 2 else lines[rnd.randrange(len(lines)) :] if kind == 2 else " ".join(lines).split("  ")
                    parts += [">" * (level + 1) + rnd.choice(["", " "]) + x.upper() for x in lines]
            parts.insert(rnd.randint(0, len(parts)), own)
            said.append(own)
            rows.append((conv, turn, "user", "\n".join(parts)))
    return rows


@pytest.mark.parametrize("rows", [conversations(), wordy(1), wordy(2)])
def test_same_as_sql(spark, rows):
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841  read by name
    want = duckdb.sql(chat.CHAT_SQL).df().sort_values(["conv_id", "turn"])
    got = chat.reply_ordered(spark.createDataFrame([(*r, *[None] * 5) for r in rows], SHAPE)).toPandas().sort_values(["conv_id", "turn"])
    as_text = lambda df: df[sorted(df.columns)].astype(object).where(df.notna(), None).map(lambda v: str(int(v)) if isinstance(v, float) else str(v)).values.tolist()
    assert as_text(got) == as_text(want) and got["reply_to"].notna().sum() > 50


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables here")
def test_documents_in_threads_quote_each_other(spark):
    got = chat.quoted_query(spark, "/root/testdata/sf0.001").toPandas().sort_values(["conv_id", "turn"])
    documents = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")  # noqa: F841  read by name
    want = duckdb.sql(chat.QUOTED_SQL).df().sort_values(["conv_id", "turn"])
    as_text = lambda df: df[sorted(df.columns)].astype(object).where(df.notna(), None).map(lambda v: str(int(v)) if isinstance(v, float) else str(v)).values.tolist()
    assert as_text(got) == as_text(want) and got["reply_to"].notna().mean() > 0.4


def test_passages_are_linear_in_paragraphs(spark):
    """Twice the paragraphs of one text take about twice the time."""
    took = {}
    for n in (200, 4000, 8000):
        df = spark.createDataFrame([(f"said {n}\n\n" * n,)], "text string").select(F.split("text", "\n").alias("said")).select(F.size(chat.passages(F.col("said"))).alias("n"))
        times = []
        for _ in range(3):
            start = time.perf_counter()
            assert df.first().n == n + 1
            times.append(time.perf_counter() - start)
        took[n] = min(times)
    assert took[8000] < 2.5 * took[4000] + 0.5


def test_documents_that_quote_none_do_not_share_a_task(spark):
    """a null key put four of ten documents in one task of the join."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("said "), "id").alias("text"))
    odd = spark.createDataFrame([(None, "no id"), (None, "no id"), (-1, "below"), (-2, None)], "doc_id long, text string")
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in chat.quoting_threads(docs).groupBy(F.spark_partition_id()).count().collect()]
        rows = chat.quoting_threads(docs.unionByName(odd)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 12_000 and max(sizes) < 2 * 12_000 / 16
    quoting = {(r.conv_id, r.turn): r.text for r in rows if r.text.startswith("On some day")}
    turn = lambda k: k % 12
    want = {(k // 12, turn(k)): f"On some day they wrote:\n> said {k - 1 - k * 7 % 3}\nsaid {k}" for k in range(12_000) if turn(k) % 4 and turn(k) - 1 - k * 7 % 3 >= 0}
    assert quoting == want and len(rows) == 12_004 and sorted(r.text for r in rows if r.conv_id is None) == ["no id", "no id"]


def test_passages_are_hashed_once(spark):
    """finding the ranges of passages parsed and hashed all texts once more."""
    seen = spark.sparkContext.accumulator(0)

    def counted(n):
        seen.add(1)
        return n

    counted = F.udf(counted, "long")
    n = F.col("id")
    rows = spark.range(2000).select((n % 7).alias("conv_id"), F.sha2(counted(n).cast("string"), 256).alias("hash"), F.struct(n.isNull().alias("none"), n.alias("turn"), n.alias("mid")).alias("at"), (n % 2 == 0).alias("own"), n.alias("mid"))
    assert chat.latest_before(rows).count() == 0 and seen.value == 2000


def test_lines_are_split_and_compared_as_by_patterns(spark):
    """what spares patterns gives what the patterns give."""
    texts = ["", " ", "\r", "a\r\nb\rc\n\nd\r\n", " > a", "\t>> > b", ">  two", "> \tc", "  lead", " one", ">", "x > y", "On x wrote:\n> q", "On x wrote:\nq", "> q\nOn\ty  wrote : \t\nÀ  B\t", "\x0b> no\x0c\n\x0bA\x0cB\x0b", "é  É\n\n\n\n> É\n>\n>> \n> z\n >", "On x wrote: \n>a"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "text string").select(chat.parsed().alias("lines")).select(F.transform(chat.runs(F.col("lines")), lambda r: F.struct("lines", r["level"].alias("level"), r["said"].alias("said"), chat.passages(r["said"]).alias("units"))).alias("x")).collect()]
    for text, runs in zip(texts, got, strict=True):
        want = []
        for s in re.split(r"\r\n|\r|\n", text):
            mark = re.match(chat.QUOTE, s)
            want.append((mark[0].count(">") if mark else 0, re.sub("^ ", "", s[mark.end() :] if mark else s)))
        if any(level for level, _ in want):
            # Java's end of a line comes before a last line separator too.
            want = [(level, s) for level, s in want if level or not re.match(chat.ATTRIBUTION, s.removesuffix(" "))]
        assert [tuple(x) for x in runs[0].lines] == want
        norm = [(level, re.sub("[ \t-\r]+", " ", s.lower()).strip(" ")) for level, s in want]
        assert [(r.level, s) for r in runs for s in r.said] == norm
        for r in runs:
            blocks = [b for b in ([x for x in p.split("\n") if x] for p in re.split("\n{2,}", "\n".join(r.said))) if b]
            units = [(-1, 0, [x for b in blocks for x in b])] + [(i, 1, b) for i, b in enumerate(blocks) if len(blocks) > 1] + [(i, 2, [x]) for i, b in enumerate(blocks) if len(b) > 1 for x in b]
            assert [(u.paragraph, u.tier, u.n, bytes(u.hash)) for u in r.units] == [(i, tier, len(b), hashlib.sha256(" ".join(b).encode()).digest()[:16]) for i, tier, b in units if b]
