"""Chat formatting by quotation linking (operator 2). DataFrame functions only.

1. Each message is cut into lines; a line's quote level is the number of `>`
   marks before its text (spaces between them allowed). Neighbouring lines of
   one level are a passage.
2. Passages are normalised (quote marks off, lower case, white space to one
   space) and hashed (128 bits). A message offers as quotable its passages of
   level 0: each as a whole, and each of its lines.
3. Quoted passages, and their lines, are joined to the messages that offer the
   hash. A quote is by an earlier message of the same conversation if one has
   it (its first turn), else by the first message of any conversation.
   Hashes are aggregated on both sides before they meet, so a passage that
   everyone quotes or writes is one row on either side.
4. A message replies to the latest earlier turn of its conversation that it
   quotes at level 1, else at any level, else to the turn before it; text at
   level 0 is kept, quotes and the line that announces one are taken out.
5. Conversations are ordered so that each message follows the one it replies
   to. Turns do that already (a reply has a later turn), so the position is the
   rank of the turn, counted through blocks of turns, and no conversation is
   gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import stored, table

#: Turns of a conversation that are ranked together.
BLOCK_TURNS = 4096
#: Shortest normalised passage that links: any that isn't blank.
LEAST_CHARS = 1

_QUOTE = r"^[\x20\t]*(?:>[\x20\t]*)+"
# What a line that announces a quotation ends with.
_ANNOUNCED = r"(?i)^.{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió)\x20*:[\x20\t\r]*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{00a0}]+", " "))


def _hash(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and passages (level, body) of each row; nested levels keep their own passages.

    All inside the row, so parsing shuffles nothing, and linear in its lines. A
    one-row explode keeps each step's arrays from being worked out again for
    every element of the next.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.locate(">", text) > 0
    # text without a mark is one line here: it needs no cutting
    line = F.when(marked, F.split(text, "\r?\n")).otherwise(F.array(text))
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    rows = messages.select("conv_id", "turn", "role", "text", once(line, "line"))
    level = F.transform("line", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _QUOTE, 0), "[^>]", "")))
    rows = rows.select("*", once(level, "level"))
    starts = F.filter(F.sequence(F.lit(1), F.size("line")), lambda i: (i == 1) | (F.element_at("level", i) != F.element_at("level", F.greatest(i - 1, F.lit(1)))))
    rows = rows.select("*", once(starts, "start"))
    stop = lambda k: F.coalesce(F.try_element_at("start", k + 2), F.size("line") + 1)
    body = lambda x, k: F.array_join(F.transform(F.slice("line", x, stop(k) - x), lambda y: F.regexp_replace(y, _QUOTE, "")), "\n")
    passages = F.transform("start", lambda x, k: F.struct(F.element_at("level", x).alias("level"), body(x, k).alias("body")))
    return rows.withColumn("passages", passages).drop("line", "level", "start")


def _units(passage: Column) -> Column:
    """A passage as a whole and its lines, normalised, those that aren't blank, each once."""
    whole = F.array(_normal(passage))
    each = F.when(F.locate("\n", passage) > 0, F.transform(F.split(passage, "\n"), _normal)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(whole, each), lambda x: F.length(x) >= LEAST_CHARS))


def linked(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text, ...) -> the parsed messages, and a row for each quoted passage that is found.

    The second: conv_id, turn, level, unit hash, and the message that wrote it (origin_conv, origin_turn, same_conv).
    Rows without conv_id or turn quote nothing and aren't quoted.
    """
    named = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = stored(parsed(named), "messages")
    real = rows.where("conv_id is not null and turn is not null")
    own = F.filter("passages", lambda p: p["level"] == 0)
    quoted = real.where(F.exists("passages", lambda p: p["level"] > 0)).select("conv_id", "turn", F.explode(F.filter("passages", lambda p: p["level"] > 0)).alias("p"))
    asked = stored(quoted.select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(_units(F.col("p.body"))).alias("unit")).select("conv_id", "turn", "level", *_hash(F.col("unit"))).distinct(), "quotes")
    wanted = stored(asked.select("h1", "h2").distinct(), "wanted")
    offered = real.select("conv_id", "turn", F.explode(own).alias("p")).select("conv_id", "turn", F.explode(_units(F.col("p.body"))).alias("unit")).select("conv_id", "turn", *_hash(F.col("unit")))
    if not wanted.limit(1).count():
        offered = offered.limit(0)  # nothing is quoted: no need to look for what is
    offered = offered.join(wanted, ["h1", "h2"], "left_semi")
    inside = stored(offered.groupBy("h1", "h2", "conv_id").agg(F.min("turn").alias("t")), "offered")
    anywhere = stored(inside.groupBy("h1", "h2").agg(F.min(F.struct("conv_id", "t")).alias("o")).select("h1", "h2", F.col("o.conv_id").alias("c0"), F.col("o.t").alias("t0")), "first")
    found = asked.join(inside, ["h1", "h2", "conv_id"], "left").join(anywhere, ["h1", "h2"])
    here = F.col("t") < F.col("turn")
    found = found.select("conv_id", "turn", "level", "h1", "h2", F.when(here, F.col("conv_id")).otherwise(F.col("c0")).alias("origin_conv"), F.when(here, F.col("t")).otherwise(F.col("t0")).alias("origin_turn"), F.coalesce(here, F.lit(False)).alias("same_conv"))
    return rows, found.where("same_conv or origin_conv <> conv_id")


def clean_text() -> Column:
    """Level-0 text: quotes out, and the line that announces one; outer line feeds trimmed."""
    kept = F.filter("passages", lambda p: p["level"] == 0)
    quotes = F.exists("passages", lambda p: p["level"] > 0)
    body = F.array_join(F.transform(kept, lambda p: p["body"]), "\n")
    lines_ = F.filter(F.split(body, "\n"), lambda x: ~x.rlike(_ANNOUNCED))
    return F.regexp_replace(F.when(quotes, F.array_join(lines_, "\n")).otherwise(body), r"^[\r\n]+|[\r\n]+$", "")


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, ...) -> a row each, in reply order by (conv_id, position).

    conv_id, turn, role, position (from 1, within the conversation), reply_to
    (the turn it answers; null for a first message), n_quotes and n_linked (its
    distinct quoted passages and lines, and those that were found), max_level, text (without
    quotes; empty for a null text). Messages that share a turn share position
    and reply. Rows without conv_id or turn have no position and no reply. Very
    long texts are read whole; other columns aren't read; an empty table gives
    no rows.
    """
    rows, found = linked(messages)
    best = found.where("same_conv").groupBy("conv_id", "turn").agg(F.max(F.when(F.col("level") == 1, F.col("origin_turn"))).alias("near"), F.max("origin_turn").alias("any"))
    counts = found.groupBy("conv_id", "turn").agg(F.count_distinct("h1", "h2").alias("n_linked"))
    extra = best.join(counts, ["conv_id", "turn"], "full")

    # position: rank inside a block of turns, plus the turns of the blocks before it
    turns = rows.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.count("*").alias("copies"))
    block = F.floor(F.col("turn") / BLOCK_TURNS)
    blocks = turns.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list("turn")).alias("turns"))  # BLOCK_TURNS at most
    blocks = stored(blocks, "turns")
    size = blocks.select("conv_id", "block", F.size("turns").cast("long").alias("n"), F.element_at("turns", -1).alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for BLOCK_TURNS turns, so few even for the longest conversation
    before = size.select("conv_id", "block", F.sum("n").over(earlier).alias("skip"), F.max("last").over(earlier).alias("previous"))
    at = blocks.join(before, ["conv_id", "block"], "left")
    at = at.select("conv_id", "turns", "skip", "previous", F.posexplode("turns").alias("p", "turn"))
    at = at.select("conv_id", "turn", (F.col("p") + 1 + F.coalesce("skip", F.lit(0))).cast("long").alias("position"), F.when(F.col("p") > 0, F.try_element_at("turns", F.col("p"))).otherwise(F.col("previous")).alias("before"))
    at = at.join(extra, ["conv_id", "turn"], "left").select("conv_id", "turn", "position", F.coalesce("near", "any", "before").alias("reply_to"), "n_linked")

    units = F.flatten(F.transform(F.filter("passages", lambda p: p["level"] > 0), lambda p: _units(p["body"])))
    # rows without conv_id or turn stay out of the join, where they would all be one key
    named = rows.where("conv_id is not null and turn is not null").join(at, ["conv_id", "turn"], "left")
    out = named.unionByName(rows.where("conv_id is null or turn is null"), allowMissingColumns=True)
    return out.select(
        "conv_id", "turn", "role", "position", "reply_to", F.size(F.array_distinct(units)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.array_max(F.transform("passages", lambda p: p["level"])).alias("max_level"), clean_text().alias("text"),
    )


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: Where no message of a table holds a quotation mark at a line's head the whole answer is this; with quotes, SQL can't fold nested levels.
ORACLE = r"""
SELECT conv_id, turn, role,
       dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS position,
       lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS reply_to,
       CAST(0 AS BIGINT) AS n_quotes, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS INTEGER) AS max_level,
       regexp_replace(coalesce(text, ''), '^[\r\n]+|[\r\n]+$', '', 'g') AS text
FROM conversations
"""
