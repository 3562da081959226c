"""Chat formatting in budgeted windows, with DataFrame functions only.

Template: a turn is ``<s>[INST]role[/INST]text</s>``. Inside roles and texts every ``&`` and
the first character of every control string is written as an entity, so control strings
never occur in them and the escape can be undone exactly.

Windows: running sums of the turns' tokens cut a conversation into turn-aligned spans. A
span begins where the sum passes a multiple of the conversation's stride. The room that its
system turn and its longest turn leave in the budget is split into the stride and the
repeated history: ``history`` tokens, or half the room if that is less, so no window of
turns that fit passes the budget. A window is a span's own turns; before them stand the
conversation's first system turn and the turns of the span before that lie within the
history. The loss mask covers the assistant
texts of the span's own turns only, so every assistant text is a target exactly once.

Tokens are counted as a fourth of the formatted characters, rounded up. A turn is never cut:
one that passes the budget together with the system turn makes a window over it (see
n_tokens), and the conversation's windows hold one turn each then.

Scale: sums run in blocks of 64 turn numbers and then over the blocks, so a conversation
that holds a large part of all rows is sorted in many tasks; a window is bounded by the
budget. Defined cases: null texts and roles are empty; a null turn comes first; turns of
equal number are ordered by role and text; repeated rows are repeated turns; rows with a
null conv_id are one conversation; an empty table gives no rows; other columns are not
looked at.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

OPEN, HEAD_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: control strings and how their first character is written inside a text
CONTROL = {"<s>": "&lt;s>", "</s>": "&lt;/s>", "[INST]": "&lsqb;INST]", "[/INST]": "&lsqb;/INST]"}
CHARS_PER_TOKEN, BLOCK = 4, 64


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in CONTROL.items():
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&lsqb;", "["), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    c = conversations.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        escaped(F.coalesce(F.col(f"`{role}`"), F.lit(""))).alias("role"), escaped(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"))
    size = F.length("role") + F.length("text") + len(OPEN + HEAD_END + CLOSE)
    return c.withColumn("tokens", F.ceil(size / CHARS_PER_TOKEN)).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))


def placed_turns(conversations: DataFrame, budget: int = 2048, history: int = 256, conv: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every turn with its number (pos), the tokens before it (before) and its span, number
    and tokens of the conversation's first system turn (system), and the tokens of history
    that its windows repeat (kept)."""
    t = _turns(conversations, conv, turn, role, text)
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("in_pos", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text"))) \
        .withColumn("in_sum", F.sum("tokens").over(inside))
    first = F.when(F.col("role") == "system", F.struct("in_pos", "tokens"))
    blocks = t.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("sum"), F.max("tokens").alias("longest"), F.min(first).alias("first"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum0"), F.max("longest").over(whole).alias("longest"), "first")
    blocks = blocks.withColumn("system", F.first(F.when(F.col("first").isNotNull(), F.struct((F.col("n0") + F.col("first.in_pos")).alias("pos"), "first.tokens")), ignorenulls=True)
                               .over(Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("first")
    t = t.join(blocks, t["conv_id"].eqNullSafe(blocks["c"]) & (t["block"] == blocks["b"])).withColumn("before", F.col("sum0") + F.col("in_sum") - F.col("tokens"))
    room = F.lit(budget) - F.coalesce("system.tokens", F.lit(0)) - F.col("longest")
    kept = F.greatest(F.lit(0), F.least(F.lit(history), F.floor(room / 2)))
    stride = F.greatest(F.lit(1), room - kept)
    return t.select("conv_id", (F.col("n0") + F.col("in_pos")).alias("pos"), "role", "text", "tokens", "before", "system",
                    kept.alias("kept"), F.floor(F.col("before") / stride).alias("span"))


def chat_windows(conversations: DataFrame, budget: int = 2048, history: int = 256, **cols: str) -> DataFrame:
    """One row per window: conv_id, span, first_pos (number of its first own turn),
    n_context (turns before the own ones), n_turns, n_tokens, formatted, loss_mask (array
    of struct(start, length) in code points of ``formatted``)."""
    t = written(placed_turns(conversations, budget, history, **cols), "turns")
    spans = t.groupBy(F.col("conv_id").alias("c"), F.col("span").alias("s")).agg(
        F.max(F.col("before") + F.col("tokens")).alias("end"), F.min("pos").alias("first_pos"), F.first("system.pos").alias("head"))
    spans = spans.withColumn("next", F.lead("s").over(Window.partitionBy("c").orderBy("s")))
    here = t.join(spans, t["conv_id"].eqNullSafe(spans["c"]) & (t["span"] == spans["s"]))
    part = lambda kind, pos, role, text, tokens: F.struct(F.lit(kind).alias("kind"), pos.cast("long").alias("pos"), role.alias("role"), text.alias("text"), tokens.cast("long").alias("tokens"))
    turn = [F.col(x) for x in ("pos", "role", "text", "tokens")]
    own = here.select("conv_id", "span", part(2, *turn).alias("part"))
    late = (F.col("end") - F.col("before") <= F.col("kept")) & F.col("next").isNotNull() & ~F.coalesce(F.col("pos") == F.col("system.pos"), F.lit(False))
    repeated = here.where(late).select("conv_id", F.col("next").alias("span"), part(1, *turn).alias("part"))
    system = t.where("pos = system.pos").select(F.col("conv_id").alias("owner"), *turn)
    later = spans.where("head < first_pos").select("c", "s")
    heads = later.join(system, later["c"].eqNullSafe(system["owner"])).select(F.col("c").alias("conv_id"), F.col("s").alias("span"), part(0, *turn).alias("part"))
    w = own.unionByName(repeated).unionByName(heads).groupBy("conv_id", "span").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    shown = lambda p: F.concat(F.lit(OPEN), p["role"], F.lit(HEAD_END), p["text"], F.lit(CLOSE))
    mask_type = "array<struct<start:int,length:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(mask_type).alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["role"]) + len(OPEN + HEAD_END)
        target = (p["kind"] == 2) & (p["role"] == "assistant")
        one = F.array(F.struct(begin.alias("start"), F.length(p["text"]).alias("length")))
        return F.struct((begin + F.length(p["text"]) + len(CLOSE)).alias("at"), F.when(target, F.concat(acc["mask"], one)).otherwise(acc["mask"]).alias("mask"))
    mine = F.filter("parts", lambda p: p["kind"] == 2)
    return w.select(
        "conv_id", "span", mine[0]["pos"].alias("first_pos"), (F.size("parts") - F.size(mine)).alias("n_context"), F.size(mine).alias("n_turns"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("parts", shown), "").alias("formatted"), F.aggregate("parts", start, step, lambda a: a["mask"]).alias("loss_mask"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per window, parsed from ``formatted`` alone: its own turns as (role, text), with
    escapes undone, and the texts under the loss mask."""
    raw = F.split("formatted", CLOSE)
    own = F.slice(raw, F.col("n_context") + 1, F.size(raw) - 1 - F.col("n_context"))

    def parse(x: Column) -> Column:
        body = F.substr(x, F.lit(len(OPEN) + 1))
        role = F.substring_index(body, HEAD_END, 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(body, F.length(role) + len(HEAD_END) + 1)).alias("text"))
    target = F.transform("loss_mask", lambda m: unescaped(F.substr(F.col("formatted"), m["start"] + 1, m["length"])))
    return windows.select("conv_id", "first_pos", F.length("formatted").alias("formatted_chars"), F.transform(own, parse).alias("turns"), target.alias("targets"))


def read_back_digest(windows: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    r = read_back(windows).select(
        "conv_id", "formatted_chars", F.size("turns").alias("n"),
        F.struct("first_pos", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("text"),
                 F.array_join("targets", "").alias("loss")).alias("part"))
    c = r.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list("part")).alias("parts"), F.sum("formatted_chars").cast("long").alias("formatted_chars"))
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return c.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("parts", lambda p: p["text"]), ""), 256).alias("turns_sha256"),
                    F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
