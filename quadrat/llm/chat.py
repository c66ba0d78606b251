"""Chat formatting in budgeted, turn-aligned windows, and reading it back.

A turn is written as ``<|turn|N|role|>text<|end|>`` and a line break: N counts the turns of the
conversation, the role is percent-encoded, the text escaped so that no control string is left in
it.  Prefix sums of turn tokens give every turn a place on a line that is cut every ``fresh``
tokens: turns between two cuts form a window, and a turn across a cut is a window of its own, so
only a single turn can be longer than its budget.  A window repeats the system turn and a
limited history before its own turns; the loss mask covers each assistant text in the one window
where it is not a repeat.

Prefix sums run over ranges of the sorted turns first and inside ranges after, so a very long
conversation is shared by many tasks.  All of it is DataFrame code.

Defined results: turns of one number are ordered by role and text; repeated rows are turns of
their own; null texts and roles are empty; a null conv_id is a conversation.  An empty table
gives no windows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm.common import written
from quadrat.llm.mixing import words

# Control strings of this template and of common ones, escaped inside texts.
TURN, END = "<|turn|", "<|end|>"
CONTROL = r"([<\[])(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\||/?s>|/?INST\])"
OVERHEAD = 4


def escape(text: Column) -> Column:
    """Double every backslash, then put one inside every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def placed(conversations: DataFrame) -> DataFrame:
    """Turns with key, ordinal, tokens and the tokens before them."""
    rows = conversations.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("tokens", words(F.col("text")) + OVERHEAD)
    ordered = rows.repartitionByRange("key", "turn", "role", "text", F.rand(3))
    rows = written(ordered.withColumn("part", F.spark_partition_id()), "chat-turns")
    sums = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        "key", "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
    )
    inside = W.partitionBy("key", "part").orderBy("turn", "role", "text")
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.row_number().over(inside) - 1)
    rows = rows.withColumn("t", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    rows = rows.join(sums, ["key", "part"])
    return rows.select(
        "conv_id", "key", "role", "text", "tokens",
        (F.col("n0") + F.col("n")).alias("ordinal"), (F.col("t0") + F.col("t")).alias("before"),
    )


def windows(conversations: DataFrame, budget: int = 2048, history: int = 512, most_turns: int = 4) -> DataFrame:
    """conv_id, key, span, fresh_from, formatted, loss (start and length in code points)."""
    turns = placed(conversations)
    system = turns.where("ordinal = 0 AND role = 'system'").select(
        "key", F.col("tokens").alias("system_tokens")
    )
    turns = turns.join(system, "key", "left")
    fresh = F.greatest(F.lit(budget - history) - F.coalesce("system_tokens", F.lit(0)), F.lit(budget // 4))
    first = F.floor(F.col("before") / fresh)
    last = F.floor((F.col("before") + F.col("tokens") - 1) / fresh)
    turns = turns.withColumn("span", 2 * first + F.when(first < last, 1).otherwise(0))
    turns = written(turns, "chat-placed")
    starts = turns.groupBy("key", "span").agg(F.min(F.struct("ordinal", "before")).alias("s")).select(
        "key", "span", F.col("s.ordinal").alias("fresh_from"), F.col("s.before").alias("start")
    )
    past = starts.where("fresh_from > 0").select(
        "key", "span", "fresh_from", "start",
        F.explode(F.array_union(
            F.array(F.lit(0).cast("bigint")),
            F.sequence(F.greatest(F.col("fresh_from") - most_turns, F.lit(0)), F.col("fresh_from") - 1),
        )).alias("ordinal"),
    )
    content = turns.select("conv_id", "key", "ordinal", "role", "text", "before", "tokens")
    repeated = past.join(content, ["key", "ordinal"])
    lead = (F.col("ordinal") == 0) & (F.col("role") == "system")
    close = (F.col("start") - F.col("before") <= history) & (F.col("ordinal") >= F.col("fresh_from") - most_turns)
    repeated = repeated.where(lead | close).withColumn("fresh", F.lit(False))
    own = turns.withColumn("fresh", F.lit(True))
    columns = ["conv_id", "key", "span", "ordinal", "role", "text", "fresh"]
    every = own.select(*columns).unionByName(repeated.select(*columns))
    head = F.concat(F.lit(TURN), F.col("ordinal").cast("string"), F.lit("|"), F.url_encode("role"), F.lit("|>"))
    every = every.withColumn("head", head).withColumn("body", escape(F.col("text")))
    item = F.struct(
        "ordinal", "fresh", "head", "body",
        F.length("head").alias("h"), F.length("body").alias("b"),
        (F.col("fresh") & (F.col("role") == "assistant")).alias("target"),
    )
    made = every.groupBy("key", "span").agg(
        F.any_value("conv_id").alias("conv_id"),
        F.array_sort(F.collect_list(item)).alias("items"),
        F.min(F.when(F.col("fresh"), F.col("ordinal"))).alias("fresh_from"),
    )
    tail = END + "\n"
    lengths = lambda n: F.aggregate(
        F.slice("items", F.lit(1), n), F.lit(0), lambda s, x: s + x["h"] + x["b"] + len(tail)
    )
    spot = F.transform(
        F.col("items"),
        lambda x, i: F.struct(x["target"].alias("target"), (lengths(i) + x["h"]).alias("start"), x["b"].alias("length")),
    )
    loss = F.transform(
        F.filter(spot, lambda s: s["target"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))
    )
    formatted = F.concat_ws("", F.transform("items", lambda x: F.concat(x["head"], x["body"], F.lit(tail))))
    return made.select("conv_id", "key", "span", "fresh_from", formatted.alias("formatted"), loss.alias("loss"))


def digest(made: DataFrame, block: int = 256) -> DataFrame:
    """Per conversation, from the windows alone: turns, their digest, and the loss text's."""
    parts = F.slice(F.split("formatted", r"<\|turn\|"), 2, 1 << 30)

    def read(part: Column) -> Column:
        head = F.substring_index(part, "|>", 1)
        at = F.length(head) + 3
        body = F.substring(part, at, F.length(part) - at + 1 - len(END + "\n"))
        return F.struct(
            F.substring_index(head, "|", 1).cast("bigint").alias("ordinal"),
            F.url_decode(F.substring_index(head, "|", -1)).alias("role"),
            unescape(body).alias("text"),
        )

    own = F.filter(F.transform(parts, read), lambda t: t["ordinal"] >= F.col("fresh_from"))
    told = made.select(
        "conv_id", "key", "span", F.length("formatted").alias("chars"), own.alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("texts"),
    )
    nl = F.lit("\n")
    told = told.select(
        "conv_id", "key", "span", F.col("chars").cast("long").alias("chars"), F.size("turns").alias("n"),
        F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl))).alias("all"),
        F.concat_ws("", "texts").alias("loss"),
    )
    for group in (F.floor(F.col("span") / block), F.lit(0)):
        told = told.groupBy("key", group.alias("span")).agg(
            F.any_value("conv_id").alias("conv_id"), F.sum("chars").alias("chars"), F.sum("n").alias("n"),
            F.array_sort(F.collect_list(F.struct("span", "all", "loss"))).alias("in_order"),
        )
        told = told.select(
            "conv_id", "key", "span", "chars", "n",
            F.concat_ws("", F.transform("in_order", lambda x: x["all"])).alias("all"),
            F.concat_ws("", F.transform("in_order", lambda x: x["loss"])).alias("loss"),
        )
    return told.select(
        "conv_id", F.col("n").cast("long").alias("n_turns"), F.sha2("all", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )
