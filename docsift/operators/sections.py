"""Sections and chunks of texts, computed inside the row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import is_heading, strip

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
BLOCK = "struct<section:string,subsection:string,text:string>"


def with_blocks(df: DataFrame, text: str = "text", to: str = "blocks") -> DataFrame:
    """Adds an array of (section, subsection, text): a heading or a line ending in a colon starts a block."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), LINE_END), strip), lambda x: x != "")
    kinds = F.transform(lines, lambda x: F.struct(x.alias("line"), F.when(is_heading(x), "h").when(x.endswith(":") & (F.length(x) <= 120), "s").otherwise("").alias("kind")))
    step1 = df.withColumn("_kinds", kinds)
    k = F.col("_kinds")
    # where blocks begin, 0-based, and an end mark
    begins = F.filter(F.transform(k, lambda x, i: F.when((x["kind"] != "") | (i == 0), i)), lambda i: i.isNotNull())
    step2 = step1.withColumn("_begins", F.concat(begins, F.array(F.size(k))))
    b = F.col("_begins")
    # the heading that holds at each block: each heading is repeated up to the next one
    at_head = F.filter(F.transform(b, lambda i, at: F.when(F.get(k, i)["kind"] == "h", at)), lambda at: at.isNotNull())
    step3 = step2.withColumn("_at", at_head)
    p, n = F.col("_at"), F.size(b)
    before = F.array_repeat(F.lit(None).cast("int"), F.coalesce(F.get(p, 0), n))
    step3 = step3.withColumn("_heads", F.concat(before, F.flatten(F.transform(p, lambda x, j: F.array_repeat(F.get(b, x), F.coalesce(F.get(p, j + 1), n) - x)))))
    h = F.col("_heads")

    def block(i: Column, at: Column) -> Column:
        first = F.get(k, i)
        section = F.coalesce(F.get(k, F.get(h, at))["line"], F.lit(""))
        sub = F.when(first["kind"] == "s", F.regexp_replace(first["line"], ":+$", "")).otherwise("")
        body = F.array_join(F.transform(F.slice(k, i + 1, F.get(b, at + 1) - i), lambda x: x["line"]), "\n")
        return F.struct(section.alias("section"), sub.alias("subsection"), body.alias("text"))

    made = F.filter(F.transform(b, lambda i, at: F.when(i < F.size(k), block(i, at))), lambda x: x.isNotNull())
    return step3.withColumn(to, made).drop("_kinds", "_begins", "_heads", "_at")


def packed(blocks: Column, target: int = 900, most: int = 1300) -> Column:
    """Blocks joined, greedily, to chunks of up to ``most`` characters, closed at ``target``; labels are the first block's."""
    chunk = lambda s, u, t: F.struct(s.alias("section"), u.alias("subsection"), t.alias("text"))
    empty = F.struct(chunk(F.lit(""), F.lit(""), F.lit("")).alias("cur"), F.array().cast(f"array<{BLOCK}>").alias("done"))
    push = lambda done, cur: F.when(cur["text"] != "", F.concat(done, F.array(cur))).otherwise(done)

    def step(acc: Column, b: Column) -> Column:
        cur, done = acc["cur"], acc["done"]
        joined = F.when(cur["text"] == "", b["text"]).otherwise(F.concat(cur["text"], F.lit("\n\n"), b["text"]))
        fits = F.length(joined) <= most
        start = (cur["text"] == "") | ~fits
        now = chunk(F.when(start, b["section"]).otherwise(cur["section"]), F.when(start, b["subsection"]).otherwise(cur["subsection"]), F.when(fits, joined).otherwise(b["text"]))
        before = F.when(fits, done).otherwise(push(done, cur))
        full = F.length(now["text"]) >= target
        return F.struct(F.when(full, chunk(F.lit(""), F.lit(""), F.lit(""))).otherwise(now).alias("cur"), F.when(full, F.concat(before, F.array(now))).otherwise(before).alias("done"))

    return F.aggregate(blocks, empty, step, lambda acc: push(acc["done"], acc["cur"]))


def chunks(df: DataFrame, keys: list[str], text: str = "text", target: int = 900, most: int = 1300, least: int = 80) -> DataFrame:
    """``keys``, chunk_id, section, subsection, chunk: chunk_id counts before short chunks go."""
    # outer, because the filter that Spark infers for an inner one computes all chunks a second time
    rows = with_blocks(df.select(*keys, text), text).select(*keys, F.posexplode_outer(packed(F.col("blocks"), target, most)).alias("chunk_id", "c"))
    return rows.where(F.length("c.text") >= least).select(*keys, "chunk_id", "c.section", "c.subsection", F.col("c.text").alias("chunk"))


def fixed_windows(text: Column, size: int = 900, overlap: int = 150) -> Column:
    """Windows of ``size`` characters, each starting ``overlap`` before the last one's end; blank ones go."""
    if overlap >= size or size < 1:
        raise ValueError("overlap must be smaller than size")
    n, step = F.length(text), size - overlap
    # the window that reaches the end is the last
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substr(text, i * step + 1, F.lit(size))))
    return F.when(n > 0, F.filter(cut, lambda x: x != "")).otherwise(F.array().cast("array<string>"))
