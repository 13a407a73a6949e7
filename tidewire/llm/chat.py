"""Quotation linking: conversations ordered by reply, without the quotes.

A line's quote level is the number of ">" marks at its start. Lines are normalised (lower case, letters and digits only,
one space). Neighbouring lines of one level form a run; a line that normalises to nothing ends it. A run of level 1 or more
is a quoted passage; level 0 lines are the message's own text. What a message says is its whole own text, each run of its
own, and of each run all neighbouring lines, as many as some passage of the conversation has. Passages and sayings are
hashed, and a passage is joined to the earliest message of the same conversation that says it. Of a message's links, the
one to the latest earlier message (the direct reply) is its parent; deeper quote levels lead to older messages. Threads
are the trees of parents; a thread is named by its first turn, and (thread, turn) is an order in which every reply follows
what it answers: reply_order gives position (from 1 in each thread), and assembled the threads as texts without quotes.

Null or empty texts have no own text and no quotes; they are threads of their own, as is every message that quotes nothing
known. Rows with a null conv_id or turn can't be ordered; they stay, without links, position and thread. Repeated rows each
stay, with the same links and position. Very long messages are read once, in time linear in their lines for each length of
a passage. Columns other than conv_id, turn, role and text are not read, whatever their names. An
empty table gives an empty one. Conversations without a quote are not searched; in others the rows that meet in a join
agree on a passage's hash, or are replies to one message (fewer than a thousand such messages are hot, and are broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.common import written
from tidewire.operators.shuffles import join_unique, maybe_in

#: Fixed value: marks of a quote level at the start of a line.
MARKS = "^[ \t]*(>[ \t]*)*"
#: Marks between coded runs, and between a run's lines; normalised lines hold neither.
RUN, LINE = "\n", "\t"


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def lines_of(text: Column) -> Column:
    """array<struct<level, body, said>> of a text's lines; said is the normalised body."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda line: F.struct(level_of(line).alias("level"), F.regexp_replace(line, MARKS, "").alias("body")))
    return F.transform(parts, lambda x: F.struct(x["level"].alias("level"), x["body"].alias("body"), normal(x["body"]).alias("said")))


def own_text(lines: Column) -> Column:
    """What the message says itself, without quotes and blank edges."""
    plain = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"])
    return F.regexp_replace(F.regexp_replace(F.array_join(plain, "\n"), "^[ \t\r\n\f]+", ""), "[ \t\r\n\f]+$", "")


def runs_of(lines: Column) -> Column:
    """array<struct<level, rows array<string>>> of neighbouring normalised lines of one level. Lines are coded and split
    again where a run ends, so a long message is copied twice and not once for each line."""
    before = F.concat(F.array(F.lit(None).cast("struct<level:int,body:string,said:string>")), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))))

    def code(x: Column, last: Column) -> Column:
        goes_on = (last["level"] == x["level"]) & (last["said"] != "") & (x["said"] != "")
        return F.concat(F.when(goes_on, F.lit(LINE)).otherwise(F.concat(F.lit(RUN), x["level"].cast("string"), F.lit(LINE))), x["said"])

    coded = F.array_join(F.zip_with(lines, before, code), "")
    runs = F.transform(F.filter(F.split(coded, RUN), lambda r: r != ""), lambda r: F.split(r, LINE))
    cut = F.transform(runs, lambda r: F.struct(F.get(r, F.lit(0)).cast("int").alias("level"), F.slice(r, 2, F.size(r)).alias("rows")))
    return F.filter(cut, lambda r: F.get(r["rows"], F.lit(0)) != "")


def messages(conversations: DataFrame) -> DataFrame:
    """Each message with its own text, its runs and its quotes taken apart."""
    parsed = conversations.select("conv_id", "turn", "role", lines_of(F.col("text")).alias("lines"))
    return parsed.select(
        "conv_id", "turn", "role", own_text(F.col("lines")).alias("body"), runs_of(F.col("lines")).alias("runs"),
        F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).cast("long").alias("deepest"),
    )


def passages(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, n, words): every quoted passage, its lines counted and joined."""
    quotes = parsed.where("deepest > 0").select("conv_id", "turn", F.explode(F.filter("runs", lambda r: r["level"] > 0)).alias("r"))
    return quotes.select("conv_id", "turn", F.col("r.level").alias("level"), F.size("r.rows").alias("n"), F.array_join("r.rows", " ").alias("words"))


def sayings(parsed: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, words, origin): the earliest turn that says them, in conversations with lengths (conv_id, sizes) of quotes."""
    own = parsed.select("conv_id", "turn", F.filter("runs", lambda r: r["level"] == 0).alias("runs")).where(F.size("runs") > 0)
    met = join_unique(written(maybe_in(own, lengths, "conv_id"), "quote-sayers"), lengths, "conv_id")
    said = F.transform("runs", lambda r: F.array_join(r["rows"], " "))

    def windows(r: Column) -> Column:
        rows = r["rows"]
        of = lambda n: F.transform(F.sequence(F.lit(1), F.size(rows) - n + 1), lambda k: F.array_join(F.slice(rows, k, n), " "))
        return F.flatten(F.transform(F.filter("sizes", lambda n: n < F.size(rows)), of))

    every = F.concat(F.array(F.array_join(said, " ")), said, F.flatten(F.transform("runs", windows)))
    return met.select("conv_id", "turn", F.explode(F.array_distinct(every)).alias("words")).groupBy("conv_id", F.xxhash64("words").alias("h")).agg(F.min("turn").alias("origin"))


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, h, origin): every quoted passage that an earlier message of the conversation says."""
    quotes = written(passages(parsed).where("conv_id is not null and turn is not null"), "quotes")
    lengths = quotes.groupBy("conv_id").agg(F.sort_array(F.collect_set("n")).alias("sizes"))
    keyed = quotes.select("conv_id", "turn", "level", F.xxhash64("words").alias("h")).distinct()
    spot = F.struct("conv_id", "h").alias("spot")
    met = join_unique(keyed.select("turn", "level", spot), sayings(parsed, lengths).select(spot, "origin"), "spot")
    return met.where("origin < turn").select("spot.conv_id", "turn", "level", "spot.h", "origin")


def threads(parents: DataFrame, name: str = "threads") -> DataFrame:
    """(conv_id, turn, parent_turn) -> with thread, the turn at the root. Each round jumps to the parent's ancestor, so the
    rounds are the logarithm of the deepest chain; a parent is earlier, so they end."""
    ends = written(parents.select(F.struct("conv_id", "turn").alias("own"), "parent_turn", F.struct("conv_id", F.col("parent_turn").alias("turn")).alias("thread")), name)
    while True:
        up = ends.select(F.col("own").alias("thread"), F.col("thread").alias("higher"))
        after = written(
            join_unique(ends, up, "thread", "left").select("own", "parent_turn", F.coalesce("higher", "thread").alias("thread"), F.col("higher").isNotNull().alias("moved")), name
        )
        ends = after.drop("moved")
        if after.where("moved").isEmpty():
            return ends.select("own.conv_id", "own.turn", "parent_turn", F.col("thread.turn").alias("thread"))


def positions(rows: DataFrame, part: int = 4096) -> DataFrame:
    """rows (conv_id, thread, turn) -> (conv_id, turn, position): 1 + how many rows of the thread have a smaller turn. Turns
    are counted in parts of `part`, so that no task holds a long thread."""
    turns = rows.groupBy("conv_id", "thread", "turn").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("turn") / part))
    group = ["conv_id", "thread", "part"]
    upto = lambda of, order: of.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("m").over(upto(Window.partitionBy("conv_id", "thread"), "part")), F.lit(0))
    parts = turns.groupBy(group).agg(F.sum("n").alias("m")).withColumn("before", before).drop("m")
    within = turns.withColumn("within", F.coalesce(F.sum("n").over(upto(Window.partitionBy(group), "turn")), F.lit(0)))
    return within.join(parts, group).select("conv_id", "turn", (1 + F.col("before") + F.col("within")).alias("position"))


def reply_order(conversations: DataFrame) -> DataFrame:
    """Each message with body (quotes removed), parent_turn (null if it answers nothing known), thread, its position there,
    n_quotes, n_linked, deepest (quote level), and chat: the body under its role's header."""
    parsed = messages(conversations)
    linked = written(links(parsed), "quote-links")
    parents = written(linked.groupBy("conv_id", "turn").agg(F.max("origin").alias("parent_turn"), F.count_distinct("h").alias("n_linked")), "quote-parents")
    tree = threads(parents).join(parents.select("conv_id", "turn", "n_linked"), ["conv_id", "turn"])
    every = conversations.select("conv_id", "turn").where("conv_id is not null and turn is not null")
    placed = positions(every.join(tree.select("conv_id", "turn", "thread"), ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", F.col("turn"))))
    n_quotes = F.size(F.filter("runs", lambda r: r["level"] > 0)).cast("long")
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"), F.lit("\n"))
    rows = parsed.select("conv_id", "turn", "role", "body", n_quotes.alias("n_quotes"), "deepest")
    return rows.join(placed.join(tree, ["conv_id", "turn"], "left"), ["conv_id", "turn"], "left").select(
        "conv_id", F.when(F.col("position").isNotNull(), F.coalesce("thread", F.col("turn"))).alias("thread"), "turn", "position", "role", "parent_turn",
        "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "deepest", "body", chat.alias("chat"),
    )


def assembled(ordered: DataFrame, messages_a_part: int = 512) -> DataFrame:
    """(conv_id, thread, part, n_messages, chat): threads of reply_order's rows as texts, in parts of so many messages."""
    part = F.floor((F.col("position") - 1) / messages_a_part).alias("part")
    parts = ordered.where("position is not null").groupBy("conv_id", "thread", part).agg(F.array_sort(F.collect_list(F.struct("position", "chat"))).alias("said"))
    return parts.select("conv_id", "thread", "part", F.size("said").cast("long").alias("n_messages"), F.array_join(F.transform("said", lambda x: x["chat"]), "").alias("chat"))


def reply_sql(table: str = "conversations") -> str:
    """reply_order's links and digests for DuckDB."""
    return rf"""WITH RECURSIVE l AS (SELECT m, conv_id, turn, role, k, len(regexp_replace(regexp_extract(line, '{MARKS}'), '[^>]', '', 'g')) AS level, regexp_replace(line, '{MARKS}', '') AS body FROM (
  SELECT m, conv_id, turn, role, unnest(parts) AS line, unnest(range(len(parts))) AS k FROM (
    SELECT row_number() OVER () AS m, conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS parts FROM {table}))),
n AS (SELECT *, trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS said FROM l),
b AS (SELECT *, CASE WHEN level = lag(level) OVER w AND said <> '' AND lag(said) OVER w <> '' THEN 0 ELSE 1 END AS opens FROM n WINDOW w AS (PARTITION BY m ORDER BY k)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY m ORDER BY k) AS run FROM b),
runs AS (SELECT m, any_value(conv_id) AS conv_id, any_value(turn) AS turn, run, any_value(level) AS level, count(*) AS n, string_agg(said, ' ' ORDER BY k) AS words FROM r WHERE said <> '' GROUP BY m, run),
passages AS (SELECT * FROM runs WHERE level > 0),
lengths AS (SELECT DISTINCT conv_id, n AS size FROM passages WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY m, run ORDER BY k) AS at FROM r WHERE level = 0 AND said <> ''),
said AS (
  SELECT conv_id, turn, words FROM runs WHERE level = 0
  UNION ALL SELECT any_value(conv_id), any_value(turn), string_agg(words, ' ' ORDER BY run) FROM runs WHERE level = 0 GROUP BY m
  UNION ALL SELECT any_value(a.conv_id), any_value(a.turn), string_agg(z.said, ' ' ORDER BY z.at) FROM own a JOIN lengths ON a.conv_id = lengths.conv_id
    JOIN own z ON z.m = a.m AND z.run = a.run AND z.at BETWEEN a.at AND a.at + size - 1 GROUP BY a.m, a.run, a.at, size HAVING count(*) = any_value(size)),
origins AS (SELECT conv_id, words, min(turn) AS origin FROM said GROUP BY conv_id, words),
links AS (SELECT DISTINCT p.conv_id, p.turn, p.words, origin FROM passages p JOIN origins o ON o.conv_id = p.conv_id AND o.words = p.words WHERE origin < p.turn),
parents AS (SELECT conv_id, turn, max(origin) AS parent_turn, count(DISTINCT words) AS n_linked FROM links GROUP BY conv_id, turn),
up AS (SELECT conv_id, turn, parent_turn AS thread FROM parents UNION ALL SELECT up.conv_id, up.turn, p.parent_turn FROM up JOIN parents p ON p.conv_id = up.conv_id AND p.turn = up.thread),
threads AS (SELECT conv_id, turn, min(thread) AS thread FROM up GROUP BY conv_id, turn),
bodies AS (SELECT m, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(role) AS role, coalesce(max(level), 0) AS deepest,
  regexp_replace(regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (level = 0), ''), '^[ \t\r\n\f]+', ''), '[ \t\r\n\f]+$', '') AS body FROM l GROUP BY m),
j AS (SELECT b.conv_id, CASE WHEN b.conv_id IS NOT NULL AND b.turn IS NOT NULL THEN coalesce(t.thread, b.turn) END AS thread, b.turn, b.role, parent_turn, (SELECT count(*) FROM passages q WHERE q.m = b.m) AS n_quotes, coalesce(n_linked, 0) AS n_linked, deepest, body
  FROM bodies b LEFT JOIN parents p ON p.conv_id = b.conv_id AND p.turn = b.turn LEFT JOIN threads t ON t.conv_id = b.conv_id AND t.turn = b.turn)
SELECT conv_id, thread, turn, CASE WHEN thread IS NOT NULL THEN rank() OVER (PARTITION BY conv_id, thread ORDER BY turn) END AS position, role, parent_turn, n_quotes, n_linked, CAST(deepest AS BIGINT) AS deepest,
  md5(body) AS body_md5, md5('<|' || coalesce(role, '') || '|>' || chr(10) || body || chr(10)) AS chat_md5 FROM j"""
