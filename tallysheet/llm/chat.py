"""Chat formatting by quotation links, with DataFrame functions alone.

Messages quote each other by lines that begin with ``>``, one for each level.
Quoted passages are normalised and hashed, and matched to the latest earlier
message of their conversation that wrote such a passage of its own: that is the
message replied to. Conversations come out ordered by replies, without the quotes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallysheet.llm.common import forget, splittable, text_or_empty, written

#: Marks of a quotation at the start of a line: a run of ``>`` and blanks that ends in ``>``. One character class, since Java's repeated groups recurse.
QUOTE = r"^[ \t>]*>"
#: What is trimmed from the text of a message.
BLANK = " \t\n\x0b\f\r"
#: A line that only introduces a quotation. Fixed value.
ATTRIBUTION = r"(?i)^[ \t]*(on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,100}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió)[ \t]*:[ \t]*$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def normal(line: Column) -> Column:
    """A line for comparison: lower case, white space runs as one space, trimmed."""
    low = F.lower(line)
    # Most lines have single spaces only, and looking is cheaper than replacing each. A line holds no line ends.
    uneven = line.contains("  ") | line.contains("\t") | line.contains("\x0b") | line.contains("\f")
    return F.trim(F.when(uneven, F.regexp_replace(low, r"\s+", " ")).otherwise(low))


def parsed(text: str = "text") -> Column:
    """Lines of a text as ``array<struct<level, line>>``; attributions before a quotation are left out."""
    whole = text_or_empty(text)
    # One plain character is what texts are split by without a regular expression.
    rows = F.split(F.when(whole.contains("\r"), F.regexp_replace(whole, r"\r\n|\r", "\n")).otherwise(whole), "\n")

    def level_and_line(s: Column) -> Column:
        marked = F.ltrim(s, F.lit(" \t")).startswith(">")
        level = F.when(marked, F.length(F.translate(F.regexp_extract(s, QUOTE, 0), " \t", ""))).otherwise(0)
        line = F.when(marked, F.regexp_replace(s, QUOTE + " ?", "")).when(s.startswith(" "), F.substring(s, 2, 2**31 - 1)).otherwise(s)
        return F.struct(level.alias("level"), line.alias("line"))

    def unattributed(lines: Column) -> Column:
        quoted = F.exists(lines, lambda x: x["level"] > 0)
        return F.when(quoted, F.filter(lines, lambda x: ~((x["level"] == 0) & x["line"].contains(":") & x["line"].rlike(ATTRIBUTION)))).otherwise(lines)

    return bound(F.transform(rows, level_and_line), unattributed)


def in_order(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their global rank in ``name``: range-partitioned, ranked in each task, moved up by the tasks before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ordered")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row for each partition.
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn(name, within).join(F.broadcast(sizes), "__part").withColumn(name, F.col(name) + F.col("__start")).drop("__part", "__start")


def runs(lines: Column) -> Column:
    """Consecutive lines of one level as ``array<struct<level, said>>``; ``said`` has the lines normalised."""
    starts = F.array_compact(F.transform(lines, lambda x, i: F.when((i == 0) | (x["level"] != F.get(lines, i - 1)["level"]), i)))
    ends = lambda starts: F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(lines)))
    said = lambda s, e: F.transform(F.slice(lines, s + 1, e - s), lambda x: normal(x["line"]))
    return bound(starts, lambda starts: F.zip_with(starts, ends(starts), lambda s, e: F.struct(F.get(lines, s)["level"].alias("level"), said(s, e).alias("said"))))


def digest(rows: Column) -> Column:
    """Hash of lines where line ends count as spaces."""
    return F.substring(F.unhex(F.sha2(F.array_join(rows, " "), 256)), 1, 16)


def passages(said: Column) -> Column:
    """A run, its paragraphs and its lines as ``array<struct<paragraph, tier, n, hash>>``, where line ends count as spaces.

    ``n`` counts lines that aren't blank. A lone paragraph isn't told apart from its run, nor a lone line from its paragraph.
    """
    def edges(said: Column, side: int) -> Column:
        """Places of the lines where a paragraph starts (``side`` -1) or ends (1)."""
        return F.array_compact(F.transform(said, lambda x, i: F.when((x != "") & (F.coalesce(F.get(said, i + side), F.lit("")) == ""), i)))

    blocks = bound(said, lambda said: F.zip_with(edges(said, -1), edges(said, 1), lambda s, e: F.slice(said, s + 1, e - s + 1)))

    def unit(paragraph: Column, tier: int, rows: Column) -> Column:
        return F.struct(paragraph.cast("int").alias("paragraph"), F.lit(tier).alias("tier"), F.size(rows).alias("n"), digest(rows).alias("hash"))

    def units(blocks: Column) -> Column:
        whole = F.array(unit(F.lit(-1), 0, F.flatten(blocks)))
        parts = F.filter(F.transform(blocks, lambda rows, i: unit(i, 1, rows)), lambda u: F.size(blocks) > 1)
        lines = F.flatten(F.transform(blocks, lambda rows, i: F.transform(F.filter(rows, lambda x: F.size(rows) > 1), lambda x: unit(i, 2, F.array(x)))))
        return F.filter(F.concat(whole, parts, lines), lambda u: u["n"] > 0)

    # Bound, so that the text is split once and not for each of its paragraphs.
    return bound(blocks, units)


def latest_before(rows: DataFrame) -> DataFrame:
    """The quoted rows with ``o``, the latest earlier original of the same conversation and hash; those without one are left out.

    Originals and quotes are range-partitioned together in the order of
    conversation, hash and time; the last original is carried along each task
    and on to the tasks after, so a passage said a million times is no hot key.
    """
    order = ["conv_id", "hash", "at", "own"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written before, since finding the ranges reads the rows once or twice more and would parse and hash all texts again.
    units = written(rows, "units")
    dealt = written(units.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "passages")
    forget(rows.sparkSession, units)
    original = F.when(F.col("own"), F.struct("conv_id", "hash", "at", "mid"))
    ends = dealt.groupBy("__part").agg(F.max(original).alias("__end"))
    # One row for each partition.
    ends = ends.select("__part", F.last("__end", True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    along = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = dealt.withColumn("o", F.last(original, True).over(along)).where("NOT own").join(F.broadcast(ends), "__part").withColumn("o", F.coalesce("o", "__before"))
    return met.where(F.col("o.conv_id").eqNullSafe(F.col("conv_id")) & (F.col("o.hash") == F.col("hash"))).drop("__part", "__before")


def replies(messages: DataFrame) -> DataFrame:
    """Pairs (mid, parent, parent_turn) of messages with a quotation that was found.

    A quoted passage is a run of lines of one level. It belongs to the latest
    earlier message of the conversation that wrote it as all of its own text, a
    run, a paragraph or a line. Only if none did, its paragraphs are looked for,
    and lines only where their paragraph wasn't found either. The parent is the
    one of the lowest level, then of most lines, then the latest.
    """
    held = messages.select("conv_id", "mid", "at", F.posexplode(runs(F.col("lines"))).alias("passage", "x"))
    rows = held.select("conv_id", "mid", "at", "passage", F.col("x.level").alias("level"), F.explode(passages(F.col("x.said"))).alias("u"))
    rows = rows.select("conv_id", "mid", "at", "passage", "level", "u.*", (F.col("level") == 0).alias("own"))
    # Own text around quotations, put together.
    own = F.filter(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: normal(x["line"])), lambda x: x != "")
    split = messages.where("n_quoted > 0").select("conv_id", "mid", "at", bound(own, lambda said: F.struct(F.size(said).alias("n"), digest(said).alias("hash"))).alias("u")).where("u.n > 0")
    rows = rows.unionByName(split.select("conv_id", "mid", "at", F.lit(-1).alias("passage"), F.lit(-1).alias("paragraph"), F.lit(0).alias("tier"), F.lit(0).alias("level"), "u.*", F.lit(True).alias("own")))
    found = latest_before(rows)
    # All found parts of a passage are of one message, so no group is larger than that.
    best_of = lambda *keys: F.min("tier").over(Window.partitionBy(*keys))
    found = found.withColumns({"__run": best_of("mid", "passage"), "__block": best_of("mid", "passage", "paragraph")})
    found = found.where("tier = 0 OR (__run > 0 AND tier = __block)")
    votes = found.groupBy("mid", "level", F.col("o.mid").alias("o_mid"), F.col("o.at").alias("o_at")).agg(F.sum("n").alias("n"))
    best = votes.groupBy("mid").agg(F.max(F.struct((-F.col("level")).alias("level"), "n", "o_at", "o_mid")).alias("b"))
    return best.select("mid", F.col("b.o_mid").alias("parent"), F.col("b.o_at.turn").alias("parent_turn"))


def roots(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """The first message of the thread of each message that replies, by pointer doubling; depth d takes log2(d) rounds."""
    cur = written(links.select("mid", F.col("parent").alias("root")), "roots")
    for _ in range(max_rounds):
        up = cur.select(F.col("mid").alias("m"), F.col("root").alias("r"))
        nxt = written(cur.join(up, F.col("root") == F.col("m"), "left").select("mid", F.coalesce("r", "root").alias("root"), F.col("m").isNotNull().alias("moved")), "roots")
        moved = nxt.where("moved").limit(1).count()
        forget(cur.sparkSession, cur)
        cur = nxt.drop("moved")
        if not moved:
            return cur
    raise RuntimeError("threads deeper than expected")


def reply_ordered(turns: DataFrame) -> DataFrame:
    """One row per message: ``conv_id, turn, role, reply_to, thread, position, n_quoted, text, rendered``.

    ``reply_to`` is the turn of the message it quotes (null if none is found),
    ``thread`` the first turn of its thread (its own for a message that replies
    to none), ``position`` counts from 0 within the conversation: threads by
    their first turn, messages of a thread by turn, so an answer follows what it
    answers. ``text`` has no quotes; ``n_quoted`` counts the lines left out.
    ``rendered`` puts the role before the text. Null texts are empty, null roles
    are ``unknown``, null turns come last, null conversations form one
    conversation, rows alike stay apart. An empty table gives no rows; further
    columns are ignored. No conversation is gathered in one task.
    """
    spark = turns.sparkSession
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), parsed().alias("lines"))
    own = F.filter("lines", lambda x: x["level"] == 0)
    base = base.withColumns({
        "mid": F.monotonically_increasing_id(),
        "n_quoted": (F.size("lines") - F.size(own)).cast("long"),
    })
    messages = written(base.withColumn("at", F.struct(F.col("turn").isNull().alias("none"), "turn", "mid")), "messages")
    links = written(replies(messages), "replies")
    tops = roots(links).join(messages.select(F.col("mid").alias("root"), F.col("at").alias("root_at")), "root").select("mid", "root_at")
    # Keys alone are placed and ranked; the texts are joined at the end and shuffled once.
    placed = messages.select("conv_id", "mid", "at").join(links.drop("parent"), "mid", "left").join(tops, "mid", "left").withColumn("root_at", F.coalesce("root_at", "at"))
    ranked = in_order(placed, ["conv_id", "root_at", "at"], "rank")
    first = ranked.groupBy("conv_id").agg(F.min("rank").alias("start")).withColumnRenamed("conv_id", "c")
    ranked = ranked.join(splittable(first), F.col("conv_id").eqNullSafe(F.col("c")))
    # Made of the lines here, since written messages that held both would hold each text twice.
    text = F.trim(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), F.lit(BLANK))
    done = messages.select("mid", "turn", "role", "n_quoted", text.alias("text")).join(ranked, "mid")
    return done.select(
        "conv_id", "turn", "role", F.col("parent_turn").alias("reply_to"), F.col("root_at.turn").alias("thread"), (F.col("rank") - F.col("start")).alias("position"), "n_quoted", "text",
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n")).alias("rendered"),
    )


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every message of all conversations in reply order."""
    return reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def quoting_threads(docs: DataFrame) -> DataFrame:
    """Conversations made of documents in a fixed way, most of which quote an earlier document of theirs whole."""
    k = F.col("doc_id")
    turn = k % 12
    to = F.when((turn % 4 != 0) & (turn - 1 - k * 7 % 3 >= 0), k - 1 - k * 7 % 3)
    rows = docs.select(F.floor(k / 12).alias("conv_id"), turn.alias("turn"), F.when(turn % 2 == 0, "user").otherwise("assistant").alias("role"), text_or_empty().alias("own"), to.isNotNull().alias("quotes"), F.coalesce(to, k).alias("key"))
    said = docs.select(k.alias("said_by"), F.concat(F.lit("On some day they wrote:\n> "), F.replace(text_or_empty(), F.lit("\n"), F.lit("\n> ")), F.lit("\n")).alias("quote"))
    # A document that quotes none has its own id for a key: by a null they would all lie in one task.
    return rows.join(said, F.col("quotes") & (F.col("key") == F.col("said_by")), "left").select("conv_id", "turn", "role", F.concat(F.coalesce("quote", F.lit("")), "own").alias("text"))


def quoted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over messages that quote: all documents, in threads."""
    return reply_ordered(quoting_threads(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("rendered")


def chat_sql(source: str = "SELECT conv_id, turn, role, text FROM conversations", rendered: bool = True) -> str:
    """The same rule over conversations without nulls and repeated turns, passage by passage."""
    return rf"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, string_split(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g'), chr(10)) AS ls FROM ({source})),
q AS (
  SELECT conv_id, turn, role, ls, len(list_filter(ls, lambda s: regexp_matches(s, '^[ \t]*>'))) AS n_quoted FROM m),
l AS (
  SELECT conv_id, turn, role, n_quoted, unnest(ls) AS s, generate_subscripts(ls, 1) AS k FROM q),
a AS (
  SELECT conv_id, turn, role, n_quoted, k,
         length(replace(replace(regexp_extract(s, '^([ \t]*>)+'), ' ', ''), chr(9), '')) AS level,
         regexp_replace(regexp_replace(s, '^([ \t]*>)+', ''), '^ ', '') AS line
  FROM l),
p AS (
  SELECT * FROM a WHERE NOT (n_quoted > 0 AND level = 0 AND regexp_matches(line,
    '(?i)^[ \t]*(on\b.{{0,200}}\bwrote|am\b.{{0,200}}\bschrieb.{{0,100}}|le\b.{{0,200}}\ba écrit|el\b.{{0,200}}\bescribió)[ \t]*:[ \t]*$'))),
o AS (
  SELECT conv_id, turn, regexp_replace(string_agg(line, chr(10) ORDER BY k) FILTER (level = 0), '^\s+|\s+$', '', 'g') AS text FROM p GROUP BY ALL),
n AS (SELECT conv_id, turn, n_quoted, k, level, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS said, lag(level) OVER (PARTITION BY conv_id, turn ORDER BY k) AS before FROM p),
g AS (SELECT *, sum(CASE WHEN before = level THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY k) AS run FROM n),
b AS (SELECT *, sum(CASE WHEN said = '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn, run ORDER BY k) AS para FROM g),
s AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn, run, para) AS para_lines, min(para) OVER (PARTITION BY conv_id, turn, run) AS first_para, max(para) OVER (PARTITION BY conv_id, turn, run) AS last_para FROM b WHERE said <> ''),
units AS (
  SELECT conv_id, turn, level, run, -1 AS para, 0 AS tier, count(*) AS n, string_agg(said, ' ' ORDER BY k) AS unit FROM s GROUP BY conv_id, turn, level, run
  UNION ALL SELECT conv_id, turn, level, run, para, 1, count(*), string_agg(said, ' ' ORDER BY k) FROM s WHERE first_para <> last_para GROUP BY conv_id, turn, level, run, para
  UNION ALL SELECT conv_id, turn, level, run, para, 2, 1, said FROM s WHERE para_lines > 1
  UNION ALL SELECT conv_id, turn, 0, -1, -1, 0, count(*), string_agg(said, ' ' ORDER BY k) FROM s WHERE level = 0 AND n_quoted > 0 GROUP BY conv_id, turn),
u AS (SELECT *, row_number() OVER () AS uid FROM units),
own AS (SELECT DISTINCT conv_id, turn AS o_turn, unit FROM u WHERE level = 0),
f AS (
  SELECT u.conv_id, turn, level, run, para, tier, n, max(o_turn) AS o_turn FROM u JOIN own ON u.conv_id = own.conv_id AND u.unit = own.unit AND o_turn < turn
  WHERE level > 0 GROUP BY u.conv_id, turn, level, run, para, tier, n, uid),
h AS (SELECT *, min(tier) OVER (PARTITION BY conv_id, turn, run) AS best_of_run, min(tier) OVER (PARTITION BY conv_id, turn, run, para) AS best_of_para FROM f),
v AS (SELECT conv_id, turn, level, o_turn, sum(n) AS n FROM h WHERE tier = 0 OR (best_of_run > 0 AND tier = best_of_para) GROUP BY ALL),
r AS (SELECT conv_id, turn, o_turn AS reply_to FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, o_turn DESC) = 1),
t AS (
  SELECT q.conv_id, q.turn, q.turn AS thread FROM q LEFT JOIN r USING (conv_id, turn) WHERE reply_to IS NULL
  UNION ALL
  SELECT r.conv_id, r.turn, t.thread FROM r JOIN t ON r.conv_id = t.conv_id AND r.reply_to = t.turn)
SELECT q.conv_id, q.turn, q.role, reply_to, thread,
       row_number() OVER (PARTITION BY q.conv_id ORDER BY thread, q.turn) - 1 AS position, n_quoted, coalesce(o.text, '') AS text{", '<|' || q.role || '|>' || chr(10) || coalesce(o.text, '') || chr(10) AS rendered" if rendered else ""}
FROM q JOIN o USING (conv_id, turn) JOIN t USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn)
"""


CHAT_SQL = chat_sql()
#: The documents in threads, as :func:`quoting_threads` makes them.
QUOTED_SQL = chat_sql(
    """SELECT d.doc_id // 12 AS conv_id, d.doc_id % 12 AS turn, CASE WHEN d.doc_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
    CASE WHEN s.doc_id IS NULL THEN '' ELSE 'On some day they wrote:' || chr(10) || '> ' || replace(coalesce(s.text, ''), chr(10), chr(10) || '> ') || chr(10) END || coalesce(d.text, '') AS text
  FROM documents d LEFT JOIN documents s ON d.doc_id % 4 <> 0 AND d.doc_id % 12 - 1 - d.doc_id * 7 % 3 >= 0 AND s.doc_id = d.doc_id - 1 - d.doc_id * 7 % 3""",
    rendered=False,
)
