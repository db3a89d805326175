"""Sections of files too long for a row, by a segmented scan over their lines.

Lines come one a row.  Ranges of ``RANGE`` lines are scanned apart: what a range hands on
is how many blocks begin in it and its last heading, and only these summaries, one row a range, are put in
order for a whole file.  Results equal ``docsift.operators.sections``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsift.functions.text import is_heading, strip
from docsift.operators.sections import LINE_END

RANGE = 10_000


def lines_of(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, line_no, line of texts that do fit a row."""
    return rows.select(*keys, F.posexplode_outer(F.split(F.coalesce(F.col(text), F.lit("")), LINE_END)).alias("line_no", "line"))


def _lines(lines: DataFrame, keys: list[str], length: int | None) -> DataFrame:
    """at (keys and range), line_no, line, kind: dealt by file and range once, and what follows inside a range stays there."""
    kind = F.when(is_heading(F.col("line")), "h").when(F.col("line").endswith(":") & (F.length("line") <= 120), "s").otherwise("")
    # a struct, in which null keys are equal
    at = F.struct(*keys, F.floor(F.col("line_no") / F.lit(length or RANGE)).alias("range")).alias("at")
    return lines.withColumn("line", strip(F.col("line"))).where("line != ''").select(at, "line_no", "line", kind.alias("kind")).repartition("at")


def _heading():
    return F.when(F.col("kind") == "h", F.col("line"))


def _numbered(some: DataFrame) -> DataFrame:
    """Adds own (blocks that begin in the range so far) and held (the last heading in it)."""
    inside = W.partitionBy("at").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return some.withColumns({"own": F.count_if(F.col("kind") != "").over(inside).cast("int"), "held": F.last(_heading(), ignorenulls=True).over(inside)})


def _carried(some: DataFrame, keys: list[str]) -> DataFrame:
    """_at, _before (the number of the block that own 0 is in), _head (the last heading before the range): a row for each range."""
    # one row a range: its blocks, its last heading, and whether its first line begins one
    per = some.groupBy("at").agg(F.count_if(F.col("kind") != "").alias("begin"), F.max_by(_heading(), F.when(F.col("kind") == "h", F.col("line_no"))).alias("head"), F.min_by("kind", "line_no").alias("first"))
    own = W.partitionBy(*[F.col(f"at.{k}") for k in keys]).orderBy("at.range")
    before, whole = own.rowsBetween(W.unboundedPreceding, -1), own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # a file whose first line is no heading opens with a block that no line begins
    opens = (F.first("first").over(whole) == "").cast("int")
    return per.select(F.col("at").alias("_at"), (F.coalesce(F.sum("begin").over(before), F.lit(0)) + opens - 1).cast("int").alias("_before"), F.last("head", ignorenulls=True).over(before).alias("_head"))


def _pieces(some: DataFrame) -> DataFrame:
    """at, own, f (line_no, kind, line, held of the first line), text: what a range has of a block."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return _numbered(some).groupBy("at", "own").agg(F.min(F.struct("line_no", "kind", "line", "held")).alias("f"), body.alias("text"))


def _placed(pieces: DataFrame, keys: list[str], *more) -> DataFrame:
    """``keys``, range, block, section, subsection, text of pieces joined with what their ranges are told."""
    sub = F.when(F.col("f.kind") == "s", F.regexp_replace("f.line", ":+$", "")).otherwise("")
    section = F.coalesce("f.held", "_head", F.lit(""))
    return pieces.select(*[F.col(f"at.{k}").alias(k) for k in keys], *more, F.struct((F.col("own") + F.col("_before")).alias("block"), F.col("at.range").alias("range"), section.alias("section"), sub.alias("subsection"), "text").alias("p"))


def blocks(lines: DataFrame, keys: list[str], length: int | None = None) -> DataFrame:
    """``keys``, block (from 0), section, subsection, text of lines (``keys``, line_no, line)."""
    some = _lines(lines, keys, length)
    placed = _placed(_pieces(some).join(_carried(some, keys), F.col("at") == F.col("_at")), keys, (F.col("own") + F.col("_before")).alias("block"))
    made = placed.groupBy(*keys, "block").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return made.select(*keys, "block", F.col("p")[0]["section"].alias("section"), F.col("p")[0]["subsection"].alias("subsection"), F.array_join("p.text", "\n").alias("text"))


def chunk_starts(sizes: DataFrame, keys: list[str], target: int = 900, most: int = 1300) -> DataFrame:
    """``keys``, chunk_id, first, last: the blocks of each chunk, from their lengths alone (``keys``, block, n)."""
    empty = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("first"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))
    span = lambda a, b: F.array(F.struct(a.cast("int").alias("first"), b.cast("int").alias("last")))

    def step(acc, b):
        fits = (acc["held"] > 0) & (acc["held"] + 2 + b["n"] <= most)
        now = F.when(fits, acc["held"] + 2 + b["n"]).otherwise(b["n"])
        first = F.when(fits, acc["first"]).otherwise(b["block"])
        before = F.when(fits | (acc["held"] == 0), acc["done"]).otherwise(F.concat(acc["done"], span(acc["first"], b["block"] - 1)))
        full = now >= target
        return F.struct(F.when(full, F.lit(0)).otherwise(now).cast("long").alias("held"), first.cast("int").alias("first"), F.when(full, F.concat(before, span(first, b["block"]))).otherwise(before).alias("done"))

    lists = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", F.col("n").cast("long").alias("n")))).alias("b"))
    end = F.element_at("b", -1)["block"]
    spans = lists.withColumn("a", F.aggregate("b", empty, step)).withColumn("s", F.when(F.col("a.held") > 0, F.concat(F.col("a.done"), span(F.col("a.first"), end))).otherwise(F.col("a.done")))
    return spans.select(*keys, F.posexplode_outer("s").alias("chunk_id", "c")).where("c is not null").select(*keys, "chunk_id", "c.first", "c.last")


def chunks(lines: DataFrame, keys: list[str], target: int = 900, most: int = 1300, least: int = 80, length: int | None = None) -> DataFrame:
    """``keys``, chunk_id, section, subsection, chunk of files' lines.  A file's block lengths, not its text, are in one row.

    Text is shuffled twice: to its range, and from there to its chunk, which lengths alone have decided.
    """
    some = _lines(lines, keys, length)
    lengths = _numbered(some).groupBy("at", "own").agg((F.sum(F.length("line")) + F.count("*") - 1).alias("n"))
    own = lengths.join(_carried(some, keys), F.col("at") == F.col("_at")).select("at", "own", "n", "_before", "_head", (F.col("own") + F.col("_before")).alias("block"), *[F.col(f"at.{k}").alias(k) for k in keys])
    spans = chunk_starts(own.groupBy(*keys, "block").agg((F.sum("n") + F.count("*") - 1).alias("n")), keys, target, most)
    parts = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], "chunk_id", F.explode_outer(F.sequence("first", "last")).alias("_block"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("block") == F.col("_block")]
    # a range has consecutive blocks
    told = own.join(parts, on).groupBy(F.col("at").alias("_at"), "_before", "_head").agg(F.min("own").alias("_least"), F.sort_array(F.collect_list(F.struct("own", "chunk_id"))).alias("_chunks"))
    chunk = F.col("_chunks")[F.col("own") - F.col("_least")]["chunk_id"]
    placed = _placed(_pieces(some).join(told, F.col("at") == F.col("_at")), keys, chunk.alias("chunk_id"))
    made = placed.groupBy(*keys, "chunk_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    between = lambda x, i: F.when(i == 0, "").when(F.get("p", i - 1)["block"] == x["block"], "\n").otherwise("\n\n")
    text = F.array_join(F.transform("p", lambda x, i: F.concat(between(x, i), x["text"])), "")
    return made.select(*keys, "chunk_id", F.col("p")[0]["section"].alias("section"), F.col("p")[0]["subsection"].alias("subsection"), text.alias("chunk")).where(F.length("chunk") >= least)
