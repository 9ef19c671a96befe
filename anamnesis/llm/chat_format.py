"""Chat formatting into budgeted windows, in DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation into cells of the budget; a window holds
the whole turns that end in a cell. A turn that begins in an earlier cell stays with its
cell if all fits the budget, else it has a window of its own. Every window begins with the
conversation's system turn and a limited history, the turns just before it; both are repeated
and masked, so each assistant turn is a target once. Cells and history share what the system
turn leaves, and a history takes no more than its window's own turns leave, so a window
exceeds the budget only where the system turn and a single turn together do.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Within roles and texts `&`
becomes `&amp;` and `<|` becomes `&lt;|` (and a role's line end `&#10;`), so no text can end
or begin a turn and reading back is exact.

Defined results: null roles and texts are empty; rows are ordered by turn (null first), then
role, then text, and repeated rows are turns of their own; a null conv_id is a conversation;
a very long text is a turn like others, whole in one window; a conversation is one row of
read_back, as its digest is over all its turns, and so one task's; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.llm.common import n_words, pick

BEGIN, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class ChatRules:
    """budget: tokens of a window. A turn has its words and `marks` tokens. history: turns and tokens repeated at most,
    and half of what the system turn leaves at most."""

    budget: int = 512
    marks: int = 4
    history_turns: int = 2
    history_tokens: int = 96
    target_role: str = "assistant"
    system_role: str = "system"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escaped_role(c: Column) -> Column:
    return F.replace(escaped(c), F.lit("\n"), F.lit("&#10;"))


def unescaped_role(c: Column) -> Column:
    return unescaped(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def head(role: Column) -> Column:
    return F.concat(F.lit(BEGIN), escaped_role(role), F.lit("\n"))


def chat_windows(conversations: DataFrame, rules: ChatRules = ChatRules()) -> DataFrame:
    """One row per window: conv_id, window (from 0), text, n_context (repeated turns at its start),
    loss_spans (start and end of the target texts in text, in code points)."""
    rows = pick(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("tokens", n_words(F.col("text")) + rules.marks)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("system", (F.col("at") == 1) & (F.col("role") == rules.system_role))
    rows = rows.withColumn("body", F.when(F.col("system"), 0).otherwise(F.col("tokens")))
    first = F.max(F.when(F.col("system"), F.struct("role", "text", "tokens"))).over(so_far)  # it stands first
    rows = rows.withColumns({"kept": first, "upto": F.sum("body").over(so_far)})
    rows = rows.withColumn("left", F.greatest(F.lit(0), F.lit(rules.budget) - F.coalesce("kept.tokens", F.lit(0))))
    rows = rows.withColumn("share", F.least(F.lit(rules.history_tokens), F.floor(F.col("left") / 2)))
    rows = rows.withColumn("room", F.greatest(F.lit(1), F.col("left") - F.col("share"))).withColumn("before", F.col("upto") - F.col("body"))
    rows = rows.withColumn("cell", F.when(F.col("system"), -1).otherwise(F.floor((F.col("upto") - 1) / F.col("room"))))
    begun = F.floor(F.col("before") / F.col("room")) < F.col("cell")
    held = F.sum("body").over(Window.partitionBy("conv_id", "cell"))
    alone = ~F.col("system") & begun & (held > F.col("room"))
    rows = rows.withColumn("part", F.when(alone, 0).otherwise(1))
    number = F.dense_rank().over(Window.partitionBy("conv_id").orderBy("cell", "part")) - 1 - F.when(F.col("kept").isNotNull(), 1).otherwise(0)
    rows = rows.withColumn("window", F.greatest(number, F.lit(0)).cast("int"))
    begins = F.coalesce(F.lag("window").over(order) != F.col("window"), F.lit(False))
    near = F.collect_list(F.struct("role", "text", "before", "system")).over(order.rowsBetween(-rules.history_turns, -1))
    within = F.filter(near, lambda p: ~p["system"] & (F.col("before") - p["before"] <= F.col("share")))
    back = F.transform(within, lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text"), (F.col("before") - p["before"]).alias("tokens")))
    rows = rows.withColumn("history", F.when(begins, back))
    windows = rows.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("fresh"), F.first("history", ignorenulls=True).alias("history"), F.first("kept").alias("kept"), (F.first("left") - F.sum("body")).alias("spare")
    )
    pair = "array<struct<role: string, text: string>>"
    system = F.when((F.col("window") > 0) & F.col("kept").isNotNull(), F.array(F.struct("kept.role", "kept.text"))).otherwise(F.array().cast(pair))
    history = F.transform(F.filter("history", lambda p: p["tokens"] <= F.col("spare")), lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    context = F.concat(system, F.coalesce(history, F.array().cast(pair)))
    fresh = F.transform("fresh", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    windows = windows.select("conv_id", "window", F.size(context).alias("n_context"), F.concat(context, fresh).alias("turns"))
    marked = F.transform("turns", lambda t: F.struct(head(t["role"]).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == rules.target_role).alias("target")))
    windows = windows.withColumn("marked", marked)
    lengths = F.transform("marked", lambda m: F.length(m["head"]) + F.length(m["body"]) + len(END) + 1)
    windows = windows.withColumn("lengths", lengths)

    def span(m: Column, i: Column) -> Column:
        begin = F.aggregate(F.slice("lengths", F.lit(1), i), F.lit(0), lambda a, x: a + x) + F.length(m["head"])
        return F.when(m["target"] & (i >= F.col("n_context")), F.struct(begin.alias("start"), (begin + F.length(m["body"])).alias("end")))

    text = F.array_join(F.transform("marked", lambda m: F.concat(m["head"], m["body"], F.lit(END + "\n"))), "")
    spans = F.filter(F.transform("marked", span), lambda s: s.isNotNull())
    return windows.select("conv_id", "window", text.alias("text"), "n_context", spans.alias("loss_spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, read from the windows' text, context count and loss spans alone: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    pieces = F.slice(F.split("text", r"<\|im_start\|>"), F.col("n_context") + 2, F.lit(2**31 - 1))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - 2 - len(END))
        return F.concat(unescaped_role(role), F.lit("\n"), unescaped(body), F.lit("\n"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"]))), "")
    read = windows.withColumn("pieces", pieces)
    read = read.select("conv_id", "window", F.size("pieces").alias("n"), F.array_join(F.transform("pieces", turn), "").alias("turns"), loss.alias("loss"), F.length("text").alias("chars"))
    joined = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("all"), F.sum("n").alias("n_turns"), F.sum("chars").alias("chars"))
    turns, targets = (F.array_join(F.col(f"all.{k}"), "") for k in ("turns", "loss"))
    return joined.select(
        "conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(targets).cast("long").alias("loss_chars"), F.sha2(targets, 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"), F.size("all").cast("long").alias("n_windows"),
    )
