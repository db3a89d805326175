"""Temperature mixing of sources, realised as budgeted block permutations.

A source's share of all tokens is raised to an exponent and normalised.  The
exponent is bisected (a grid at a time, in one aggregation) to the flattest
mixture that keeps a target entropy and a repetition limit; above 1 it sharpens the
mixture.  Targets that no exponent meets, or that rule each other out, are refused with what
could be met.  With no budget given, the budget is the least that shows every row once, so nothing is lost.

A source's rows are dealt over blocks by hash.  Each epoch permutes the blocks,
and the rows in each block.  Full epochs show all rows; the last one stops where
the source's budget ends, at a block and a row in it, so membership is a function
of the row and one plan row of its source: no join on rows, no window over a
source.

Defined results: a null source is a source; null and blank texts have 0 tokens
and are shown as often as their place says; repeated rows are scheduled row by
row; whole texts of any length are counted; an empty table gives no rows; extra columns are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsift.llm._spark import small_or_shuffled, staged

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 4096
GRID, ROUNDS = 64, 5
#: The largest exponent that is tried.
STEEPEST = 64.0


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _sums(shares: DataFrame, exponents: list[float]) -> list:
    """Sums over sources for each exponent: of p^a, and of p^a times log p."""
    p = F.col("share")
    out = []
    for i, a in enumerate(exponents):
        out += [F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}")]
    return shares.agg(*out, F.min(p).alias("lo"), F.max(p).alias("hi")).first()


class Unmet(ValueError):
    """No exponent meets the targets."""


def _entropy(r, i: int, a: float) -> float:
    return math.log(r[f"z{i}"]) - a * r[f"l{i}"] / r[f"z{i}"]


def _most_shown(r, i: int, a: float, budget_share: float | None) -> float:
    """How often the source is shown that is shown most: the smallest below an exponent of 1, the largest above."""
    if budget_share:
        return budget_share * max(r["lo"] ** (a - 1), r["hi"] ** (a - 1)) / r[f"z{i}"]
    # every row is shown once at least
    return (r["hi"] / r["lo"]) ** abs(1 - a)


def _bisected(shares: DataFrame, low: float, high: float, holds) -> float | None:
    """The least exponent from ``low`` to ``high`` that holds; None if not even ``high`` does."""
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        r = _sums(shares, grid)
        first = next((i for i, a in enumerate(grid) if holds(r, i, a)), None)
        if first is None:
            return None
        low, high = grid[max(0, first - 1)], grid[first]
        if first == 0:
            break
    return high


def solve_exponent(shares: DataFrame, entropy: float | None, repeats: float | None, budget_share: float | None) -> float:
    """The least exponent with an entropy of at most ``entropy`` (as a fraction of the
    largest possible one) and no source shown more than ``repeats`` times.

    ``shares`` has a row for each source with tokens; ``budget_share`` is the budget over all tokens.
    Raises Unmet if there is none up to STEEPEST.
    """
    limit = None if repeats is None else repeats * (1 + 1e-12)
    if limit is not None and budget_share and budget_share > limit:
        raise Unmet(f"a budget of {budget_share:.3f} times all tokens shows some source more than {repeats} times; at most {repeats} times all tokens fit the limit")
    n = shares.count()
    if n < 2:
        return 1.0

    def low_enough(r, i: int, a: float) -> bool:
        return entropy is None or _entropy(r, i, a) <= entropy * math.log(n) + 1e-12

    def seldom_enough(r, i: int, a: float) -> bool:
        return limit is None or _most_shown(r, i, a, budget_share) <= limit

    found = _bisected(shares, 0.0, 1.0, lambda r, i, a: low_enough(r, i, a) and seldom_enough(r, i, a))
    if found is not None:
        return found
    # the repetition limit holds at 1, so it is the entropy that does not; shares by the largest one, since powers get small
    top = shares.agg(F.max("share")).first()[0]
    steep = _bisected(shares.select((F.col("share") / F.lit(top)).alias("share")), 1.0, STEEPEST, low_enough)
    if steep is None:
        least = _entropy(_sums(shares.select((F.col("share") / F.lit(top)).alias("share")), [STEEPEST]), 0, STEEPEST) / math.log(n)
        raise Unmet(f"no exponent up to {STEEPEST} has an entropy of {entropy} of the largest; the least is {least:.4f}")
    if not seldom_enough(_sums(shares, [steep]), 0, steep):
        raise Unmet(f"an entropy of {entropy} of the largest needs an exponent of {steep:.4f}, which shows some source more than {repeats} times")
    return steep


def _seeded(seed: int, *what) -> F.Column:
    return F.xxhash64(F.lit(seed), *what)


def keyed(docs: DataFrame, key: str, source: str, tokens: F.Column, seed: int) -> DataFrame:
    """``docs`` with the columns that place a row: _tokens, and hashes that deal and order it."""
    return docs.withColumns({"_tokens": tokens, "_source": F.col(source), "_deal": _seeded(seed, F.col(key), tokens)})


def _block(deal: F.Column, blocks: F.Column) -> F.Column:
    return F.pmod(deal, blocks)


def _orders(seed: int, epoch: F.Column, source: F.Column, block: F.Column, deal: F.Column) -> tuple[F.Column, F.Column]:
    """Where a block, and a row in its block, comes in an epoch."""
    return _seeded(seed + 1, epoch, source, block), _seeded(seed + 2, epoch, deal)


def plan(rows: DataFrame, seed: int, entropy: float | None = None, repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """One row for each source: share, weight, budget, full epochs and where the last epoch ends.

    ``rows`` has _source, _tokens and _deal (see ``keyed``).
    """
    narrow = staged(rows.select("_source", "_tokens", "_deal"), "mix-rows")
    sources = narrow.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("n_rows"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    sources = staged(sources.withColumn("share", F.col("tokens") / F.lit(float(total or 1))).withColumn("blocks", F.ceil(F.col("n_rows") / BLOCK_ROWS).cast("long")), "mix-sources")
    shares = sources.where("tokens > 0").select("share")
    a = solve_exponent(shares, entropy, repeats, budget / total if budget and total else None)
    z, lo, hi = (lambda r: (r["z0"] or 1.0, r["lo"] or 1.0, r["hi"] or 1.0))(_sums(shares, [a]))
    # a source without tokens has no weight; its rows are shown once
    sources = sources.withColumn("exponent", F.lit(a)).withColumn("weight", F.when(F.col("tokens") > 0, F.pow("share", F.lit(a)) / z).otherwise(0.0))
    whole = float(budget) if budget else total * max(lo ** (1 - a), hi ** (1 - a)) * z
    sources = sources.withColumn("budget", F.round(F.col("weight") * whole).cast("long"))
    if not budget:
        sources = sources.withColumn("budget", F.greatest("budget", "tokens"))  # rounding takes no row away
    sources = sources.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int"))
    sources = staged(sources.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0)), "mix-plan")

    # the last epoch: the block in which the budget ends, then the row in that block
    dealt = narrow.join(small_or_shuffled(sources.where("rest > 0").select(F.col("_source").alias("_s"), "blocks", "epochs", "rest")), F.col("_source").eqNullSafe(F.col("_s")))
    dealt = dealt.withColumn("block", _block(F.col("_deal"), F.col("blocks")))
    of_block, of_row = _orders(seed, F.col("epochs"), F.col("_source"), F.col("block"), F.col("_deal"))
    sums = dealt.groupBy("_source", "block", "rest", "epochs").agg(F.sum("_tokens").alias("t")).withColumn("bh", of_block)
    order = W.partitionBy("_source").orderBy("bh", "block")
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ends = staged(sums.where("before < rest and before + t >= rest").select(F.col("_source").alias("_s"), F.col("block").alias("cut_block"), F.col("bh").alias("cut_bh"), (F.col("rest") - F.col("before")).alias("left")), "mix-ends")
    inside = dealt.withColumn("rh", of_row).drop("_s").join(small_or_shuffled(ends), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("cut_block")))
    order = W.partitionBy("_source").orderBy("rh", "_deal")
    cut = inside.withColumn("before", F.sum("_tokens").over(order) - F.col("_tokens")).where("before < left").groupBy(F.col("_source").alias("_c")).agg(F.max(F.struct("rh", "_deal")).alias("cut_row"))
    ends = ends.join(cut, F.col("_s").eqNullSafe(F.col("_c")), "left").select("_s", "cut_block", "cut_bh", "cut_row")
    return staged(sources.join(ends, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-cut")


def repeated(rows: DataFrame, plan_: DataFrame, seed: int) -> DataFrame:
    """Each row once for each epoch that shows it, with _epoch, _block and their order hashes _bh and _rh."""
    p = plan_.select(F.col("_source").alias("_s"), "blocks", "epochs", "cut_block", "cut_bh", "cut_row")
    out = rows.join(small_or_shuffled(p), F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_block", _block(F.col("_deal"), F.col("blocks")))
    of_block, of_row = _orders(seed, F.col("epochs"), F.col("_source"), F.col("_block"), F.col("_deal"))
    early = F.struct(of_block.alias("bh"), F.col("_block")) < F.struct(F.col("cut_bh").alias("bh"), F.col("cut_block").alias("_block"))
    within = (F.col("_block") == F.col("cut_block")) & (F.struct(of_row.alias("rh"), F.col("_deal")) <= F.col("cut_row"))
    last = F.coalesce(early | within, F.lit(False))
    shown = F.col("epochs") + last.cast("int")
    out = out.where(shown > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(0), shown - 1)))
    of_block, of_row = _orders(seed, F.col("_epoch"), F.col("_source"), F.col("_block"), F.col("_deal"))
    return out.withColumns({"_bh": of_block, "_rh": of_row}).drop("_s", "blocks", "epochs", "cut_block", "cut_bh", "cut_row")


def schedule(docs: DataFrame, seed: int = 0, entropy: float | None = None, repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """doc_id, source, tokens, epoch, block, slot, progress, weight for each showing of each row.

    ``progress`` is the part of a source's budget shown before the row's block:
    blocks of all sources in its order are the mixture, ``slot`` orders a block.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("tokens"))
    rows = staged(keyed(narrow, "doc_id", "source", F.col("tokens"), seed), "mix-keyed")
    p = plan(rows, seed, entropy, repeats, budget)
    shown = staged(repeated(rows, p, seed), "mix-shown")
    blocks = shown.groupBy("_source", "_epoch", "_block", "_bh").agg(F.sum("_tokens").alias("t"))
    before = W.partitionBy("_source").orderBy("_epoch", "_bh", "_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0))).join(small_or_shuffled(p.select(F.col("_source").alias("_p"), "budget", "weight")), F.col("_source").eqNullSafe(F.col("_p")))
    blocks = blocks.select(F.col("_source").alias("_s"), F.col("_epoch").alias("_e"), F.col("_block").alias("_b"), F.when(F.col("budget") > 0, F.col("before") / F.col("budget")).otherwise(0.0).alias("progress"), "weight")
    slot = F.row_number().over(W.partitionBy("_source", "_epoch", "_block").orderBy("_rh", "_deal")) - 1
    placed = shown.withColumn("slot", slot).join(blocks, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_epoch") == F.col("_e")) & (F.col("_block") == F.col("_b")))
    return placed.select("doc_id", "source", "tokens", F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), "slot", "progress", "weight")


def mixed(docs: DataFrame, seed: int = 0, entropy: float | None = None, repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """``docs`` itself, each row as often as the mixture shows it."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", word_count(F.col("text")).alias("_words"))
    rows = keyed(whole, "doc_id", "source", F.col("_words"), seed)
    p = plan(rows, seed, entropy, repeats, budget)
    return repeated(rows, p, seed).select("_row.*")
