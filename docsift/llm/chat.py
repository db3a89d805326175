"""Preference formatting: one prompt and two masked completions for each pair of conversations.

The prompt is the longest common turn prefix of the chosen and the rejected
conversation, rendered once.  What follows on each side is its completion, with the
code points that are trained on: the assistant's words and the end mark.

Turns are aligned by their place on their side, whatever their numbers, and compared
by role and text.  A turn number that occurs more than once on a side is one step of
it: the rows must agree as bags.  Places are counted inside ranges of turn numbers
and then over the ranges, so a conversation of any length never meets in one task;
a rendered pair of more than ``ROWS`` turns is given in numbered parts.

Defined results: a null turn comes after all others, a null role is "unknown", a
null text is empty, rows with a null pair or side play no part; repeated rows are
rendered as often as they occur; a pair with one side has an empty prompt; sides that
agree throughout have empty completions; a text of any length is rendered whole;
extra columns, whatever their names, play no part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsift.llm._spark import small_or_shuffled, staged

#: Marks of the chat markup; a fixed public convention.
START, END = "<|im_start|>", "<|im_end|>"
LAST = (1 << 63) - 1
#: Turns of a side in a numbered part, and turn numbers that are counted together.
ROWS, RANGE = 256, 4096


def _clean(turns: DataFrame) -> DataFrame:
    known = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    return known.select("pair_id", "side", F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _steps(t: DataFrame) -> DataFrame:
    """pair_id, side, turn, rows, h1, h2, and the place and the rows before each step of a side."""
    # two hashes of a turn, summed, stand for the bag of a step's rows: 128 bits of whole turns, whatever their length
    h1, h2 = F.xxhash64("role", "text").cast("decimal(20,0)"), F.xxhash64(F.lit(1), "text", "role").cast("decimal(20,0)")
    steps = t.groupBy("pair_id", "side", "turn").agg(F.count("*").alias("rows"), F.sum(h1).alias("h1"), F.sum(h2).alias("h2")).withColumn("range", F.floor(F.col("turn") / RANGE))
    before = W.partitionBy("pair_id", "side").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = lambda w, a, b: [F.coalesce(F.sum(c).over(w), F.lit(0)) for c in (a, b)]
    ranges = steps.groupBy("pair_id", "side", "range").agg(F.count("*").alias("n"), F.sum("rows").alias("r"))
    n, r = sums(before, "n", "r")
    ranges = ranges.select("pair_id", "side", "range", n.alias("n0"), r.alias("r0"))
    inside = W.partitionBy("pair_id", "side", "range").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    own = steps.withColumn("one", F.lit(1).cast("long"))
    n, r = sums(inside, "one", "rows")
    own = own.withColumns({"n1": n, "r1": r})
    return own.join(ranges, ["pair_id", "side", "range"]).select("pair_id", "side", "turn", "rows", "h1", "h2", (F.col("n0") + F.col("n1")).alias("place"), (F.col("r0") + F.col("r1")).alias("before"))


def preference_turns(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """pair_id, part, turn, role, rendered, loss_from, loss_to, at for turns (pair_id, side, turn, role, text).

    ``side`` is "chosen" or "rejected", ``part`` also "prompt"; ``at`` counts the rows of a part from 0.
    """
    t = _clean(turns)
    steps = staged(_steps(t), "steps")  # narrow: a row for each turn, without its text
    of = lambda side, h: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(h))), F.lit(0))
    differ = F.lit(False)
    for h in ("rows", "h1", "h2"):
        differ = differ | (of("chosen", h) != of("rejected", h))
    split = steps.groupBy("pair_id", "place").agg(differ.alias("differ")).where("differ").groupBy("pair_id").agg(F.min("place").alias("split_at"))
    known = steps.join(small_or_shuffled(split), "pair_id", "left")
    # rows of a side before its completion
    base = known.where(F.col("place") == F.col("split_at")).select(F.col("pair_id").alias("p"), F.col("side").alias("s"), F.col("before").alias("base"))
    known = known.join(small_or_shuffled(base), (F.col("pair_id") == F.col("p")) & (F.col("side") == F.col("s")), "left")
    shared = F.col("split_at").isNull() | (F.col("place") < F.col("split_at"))
    known = known.select("pair_id", "side", "turn", shared.alias("shared"), (F.col("before") - F.when(shared, 0).otherwise(F.coalesce("base", F.lit(0)))).alias("before"))
    whole = t.join(known.where(~(F.col("shared") & (F.col("side") == "rejected"))), ["pair_id", "side", "turn"])
    number = F.row_number().over(W.partitionBy("pair_id", "side", "turn").orderBy("role", "text")) - 1
    head = F.concat(F.lit(START), F.col("role"), F.lit("\n"))
    loss = ~F.col("shared") & (F.col("role") == trained_role)
    return whole.select(
        "pair_id",
        F.when(F.col("shared"), F.lit("prompt")).otherwise(F.col("side")).alias("part"),
        F.when(F.col("turn") != LAST, F.col("turn")).alias("turn"),
        "role",
        F.concat(head, "text", F.lit(END + "\n")).alias("rendered"),
        F.when(loss, F.length(head)).alias("loss_from"),
        F.when(loss, F.length(head) + F.length("text") + len(END)).alias("loss_to"),
        (F.col("before") + number).alias("at"),
    )


def preference_parts(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """pair_id, part_no, prompt, chosen, chosen_mask, rejected, rejected_mask for rows of ``preference_turns``.

    Part 0 has the first ``size`` turns of the prompt and of each completion, and is
    all there is of most pairs.  Masks are arrays of code-point spans in the completion of their part.
    """
    step = F.struct("at", "rendered", "loss_from", "loss_to")
    dealt = rows.withColumn("part_no", F.floor(F.col("at") / size))
    # at most ``size`` turns for each of the three
    parts = dealt.groupBy("pair_id", "part_no").agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == p, step))).alias(p) for p in ("prompt", "chosen", "rejected")])
    text = lambda p: F.array_join(F.transform(p, lambda x: x["rendered"]), "")

    def mask(p: str) -> F.Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
        span = lambda acc, x: F.struct((acc["at"] + x["loss_from"]).alias("start"), (acc["at"] + x["loss_to"]).alias("end"))
        step = lambda acc, x: F.struct((acc["at"] + F.length(x["rendered"])).alias("at"), F.when(x["loss_from"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span(acc, x)))).alias("spans"))
        return F.aggregate(p, empty, step)["spans"]

    return parts.select("pair_id", "part_no", text("prompt").alias("prompt"), text("chosen").alias("chosen"), mask("chosen").alias("chosen_mask"), text("rejected").alias("rejected"), mask("rejected").alias("rejected_mask"))


def preference_pairs(rows: DataFrame) -> DataFrame:
    """The same in one row for each pair, for pairs known to fit in a row."""
    return preference_parts(rows, LAST).drop("part_no")
