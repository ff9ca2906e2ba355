"""Chat formatting in budgeted windows, in DataFrame operations only.

Prefix sums of turn tokens put every turn on a line; the line is cut at fixed lengths, and a turn belongs to the span in which it ends,
so that spans hold whole turns and fit a budget. Every window after the first repeats the system turn and a limited history; loss
spans cover the assistant turns that are a window's own, so each counts once.

No step holds a conversation: prefix sums are made within parts of ``PART`` turn numbers and carried over by one row a part, a turn
finds the windows that it opens or is repeated in from its own row, and rows meet by window only, which the budget bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mdframe.llm.common import table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a window (words in pieces of eight letters, digits by threes, other signs, and four a turn), and of these what repeated history may take.
BUDGET = 1024
HISTORY_TOKENS = 192
TURN_TOKENS = 4
TOKEN = r"\p{L}{1,8}|\p{N}{1,3}|[^\p{L}\p{N}\x20\x09-\x0D]"
#: Turn numbers of a part.
PART = 256


def escape(text: Column) -> Column:
    """No ``<`` or ``[`` is left, so no control string either; every backslash is followed by s, l or b."""
    text = F.replace(text, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(text, F.lit("\\s"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _window(start: Column, tokens: Column, length: Column, small: Column) -> Column:
    """Number of the window of a turn that begins at ``start`` of the line: two for each length of the line, of which the first is for a turn
    that is not small and crosses into that length, so that it stands alone."""
    place = F.floor((start + tokens - 1) / length)
    alone = (F.floor(start / length) < place) & (tokens > small)
    return (2 * place + F.when(alone, 0).otherwise(1)).cast("long")


def format_windows(rows: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """Windows ``(conv_id, window, repeated, text, loss)`` of conversations ``(conv_id, turn, role, text)``.

    ``text`` is the formatted window, ``repeated`` its number of leading turns that were in an earlier window (the system turn, and of the two
    turns before the window those that fit ``history_tokens``), ``loss`` an array of (start, length) in code points of ``text`` over its own assistant
    turns. ``window`` grows along a conversation, with gaps. Turns are in order of turn, then role and text; null roles and texts count as empty;
    repeated rows are turns of their own, and a null id is a conversation like any other. System turn, history and own turns fit the
    budget, but at least half of it is for own turns, however long the system turn, and a turn too long for that has a window for
    itself. Other columns are ignored; an empty table has no windows.
    """
    # the id as text that is never null, to join on; turns and parts read the same columns, so that they share one shuffle
    conv_id = F.when(F.col("c") != "", F.substr("c", F.lit(2))).cast(rows.schema["conv_id"].dataType)
    rows = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.floor(F.col("turn").cast("long") / PART), F.lit(-(2**62))).alias("part"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
    )
    rows = rows.withColumn("tokens", (F.regexp_count("body", F.lit(TOKEN)) + TURN_TOKENS).cast("long"))
    order, whole = Window.partitionBy("c", "part").orderBy("turn", "role", "body"), Window.partitionBy("c", "part")
    rows = rows.select(
        "*", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(order).alias("n"),
        F.sum("tokens").over(whole).alias("part_tokens"), F.lead("tokens", 1).over(order).alias("next1"), F.lead("tokens", 2).over(order).alias("next2"),
    )
    # a row for each part: what is before it, the first turn of the conversation, and the tokens of the two turns after it
    along = Window.partitionBy("c").orderBy("part")
    heads = F.filter(F.array("tokens", "next1"), lambda x: x.isNotNull())
    parts = rows.where("n = 1").select("c", "part", "part_tokens", heads.alias("heads"), F.struct("role", "tokens", "body").alias("turn1"))
    none = F.array().cast("array<bigint>")
    parts = parts.select(
        "c", "part", F.coalesce(F.sum("part_tokens").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.first("turn1").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("opening"), (F.row_number().over(along) == 1).alias("opens"),
        F.concat(F.coalesce(F.lead("heads", 1).over(along), none), F.coalesce(F.lead("heads", 2).over(along), none)).alias("after"),
    )
    turns = rows.drop("part_tokens").join(parts, ["c", "part"])
    system = F.col("opening")["role"] == "system"
    reserved = F.when(system, F.col("opening")["tokens"]).otherwise(F.lit(0))
    own = F.greatest(F.lit(budget // 2), F.lit(budget - history_tokens) - reserved, F.lit(1))
    after = lambda k: F.get("after", F.lit(k))
    turns = turns.select(
        conv_id.alias("conv_id"), "role", "body", "tokens", (F.col("before") + F.col("upto")).alias("place"), (F.col("opens") & (F.col("n") == 1) & system).alias("is_system"),
        F.when(system, F.col("opening")).alias("system"), reserved.alias("reserved"), F.floor(own / 8).alias("small"), (own - F.floor(own / 8)).alias("length"),
        F.coalesce("next1", after(0)).alias("next1"), F.when(F.col("next1").isNull(), after(1)).otherwise(F.coalesce("next2", after(0))).alias("next2"),
    )
    end = F.col("place") - F.col("reserved")
    window = lambda start, tokens: _window(start, tokens, F.col("length"), F.col("small"))
    turns = turns.select(
        "*", F.when(F.col("is_system"), F.lit(1).cast("long")).otherwise(window(end - F.col("tokens"), F.col("tokens"))).alias("w"),
        window(end, F.col("next1")).alias("w1"), window(end + F.col("next1"), F.col("next2")).alias("w2"),
    )
    # a turn is shown in its own window; before the next turn's, if that is another; and before the one after that, together with the next turn
    place = lambda w, kind, turn=None: F.struct(w.alias("window"), F.lit(kind).alias("kind"), (F.col("role") if turn is None else turn["role"]).alias("role"), (F.col("body") if turn is None else turn["body"]).alias("body"))
    opens1, opens2 = F.col("w1") != F.col("w"), F.col("w2") != F.col("w1")
    shown = F.array(
        place(F.col("w"), 2),
        F.when(opens1 & F.col("system").isNotNull(), place(F.col("w1"), 0, F.col("system"))),
        F.when(opens1 & ~F.col("is_system") & (F.col("tokens") <= history_tokens), place(F.col("w1"), 1)),
        F.when(opens2 & ~F.col("is_system") & (F.col("tokens") + F.col("next1") <= history_tokens), place(F.col("w2"), 1)),
    )
    placed = turns.select("conv_id", "place", F.explode(F.filter(shown, lambda x: x.isNotNull())).alias("x"))
    windows = placed.groupBy("conv_id", F.col("x.window").alias("window")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("x.kind").alias("kind"), "place", F.col("x.role").alias("role"), F.col("x.body").alias("body")))).alias("t")
    )
    shown = lambda x: F.struct(
        F.concat(F.lit(START), _escape_role(x["role"]), F.lit("\n")).alias("head"), escape(x["body"]).alias("body"), (x["role"] == "assistant").alias("target")
    )
    windows = windows.select(
        "conv_id", "window", F.transform(F.filter("t", lambda x: x["kind"] < 2), shown).alias("again"), F.transform(F.filter("t", lambda x: x["kind"] == 2), shown).alias("own")
    )
    whole = lambda x: F.concat(x["head"], x["body"], F.lit(END))
    windows = windows.select(
        "conv_id", "window", F.size("again").alias("repeated"), F.array_join(F.transform("again", whole), "").alias("first"),
        F.array_join(F.transform("own", whole), "").alias("rest"),
        F.transform("own", lambda x: F.struct(F.length(x["head"]).alias("h"), F.length(x["body"]).alias("b"), x["target"].alias("t"))).alias("sizes"),
    )
    loss = F.aggregate(
        "sizes",
        F.struct(F.length("first").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["h"] + x["b"] + len(END)).alias("at"),
            F.when(x["t"], F.array_append(a["spans"], F.struct((a["at"] + x["h"]).alias("start"), x["b"].alias("length")))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return windows.select("conv_id", "window", "repeated", F.concat("first", "rest").alias("text"), loss.alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """``(conv_id, window, turns, loss_text)`` parsed from formatted windows: own turns as (role, text), and the unescaped text under the loss spans."""
    pieces = F.split(F.col("text"), r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            _unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.lit(1) + F.locate("\n", p))).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"]))), "")
    return windows.select("conv_id", "window", turns.alias("turns"), loss.alias("loss_text"), F.length("text").alias("chars"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their windows. A digest of a whole conversation needs its text in one row; the operator itself does not."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text")
    )
    back = read_windows(format_windows(rows.union(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select("conv_id", F.struct("window", F.size("turns").alias("n"), said.alias("said"), "loss_text", "chars").alias("w"))
    whole = back.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    total = lambda name: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[name])
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    out = whole.select("conv_id", total("n").alias("n_turns"), joined("said").alias("said"), joined("loss_text").alias("loss"), total("chars").alias("formatted_chars"))
    return out.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


OP5_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, len(regexp_extract_all(body, '\p{L}{1,8}|\p{N}{1,3}|[^\p{L}\p{N}\x20\x09-\x0D]')) + 4 AS n,
         length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '[', '\b')) + length(role) - length(replace(role, chr(10), ''))
         + length(replace(replace(replace(body, '\', '\s'), '<', '\l'), '[', '\b')) + 12 + 1 + 11 AS chars
  FROM r),
o AS (
  SELECT *, row_number() OVER w AS k, sum(n) OVER w AS e, lead(n, 1) OVER w AS n1, lead(n, 2) OVER w AS n2,
         CASE WHEN first_value(role) OVER w = 'system' THEN first_value(n) OVER w ELSE 0 END AS s, first_value(chars) OVER w AS s_chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, body ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT *, greatest(512, 1024 - 192 - s) AS own, own // 8 AS small, own - small AS l, e - s AS z, k = 1 AND s > 0 AS sys FROM o),
v AS (
  SELECT *, CASE WHEN sys THEN 1 ELSE 2 * ((z - 1) // l) + CASE WHEN (z - n) // l < (z - 1) // l AND n > small THEN 0 ELSE 1 END END AS w,
         2 * ((z + n1 - 1) // l) + CASE WHEN z // l < (z + n1 - 1) // l AND n1 > small THEN 0 ELSE 1 END AS w1,
         2 * ((z + n1 + n2 - 1) // l) + CASE WHEN (z + n1) // l < (z + n1 + n2 - 1) // l AND n2 > small THEN 0 ELSE 1 END AS w2
  FROM h)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(body)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(body, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars + CASE WHEN w1 <> w AND s > 0 THEN s_chars ELSE 0 END + CASE WHEN w1 <> w AND NOT sys AND n <= 192 THEN chars ELSE 0 END
           + CASE WHEN w2 <> w1 AND NOT sys AND n + n1 <= 192 THEN chars ELSE 0 END)::BIGINT AS formatted_chars
FROM v GROUP BY conv_id
"""
