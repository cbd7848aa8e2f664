"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Each source gets a target amount of words: shares of the whole by weight, stopped at ``most``
times what the source has, the excess shared again among the others. A document's expected number
of copies is about target / source size: the whole part of it are certain copies, and the fraction
is shared out by unequal inclusion probabilities p, whose odds are the fraction's odds times the
document's own weight (longer texts are likelier by the root of their length, or a column's value).
Documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the
ranking is cut where the source's words reach its target; the document at the cut is taken if that
comes nearer. No document gets more than one copy beyond the certain ones, so none passes ``most``.

The cut of a source is found by narrowing the ranking: 1024 bins of the rank, 1024 bins of one of
those, the rank itself, then, among rows of one rank, the part of the table they are in, and only
the rows of that part are put in order. Every step is a sum by key that is combined before the
shuffle, so neither a source with a third of all rows nor a row that repeats as often is sorted in
one task. u is a hash of seed and doc_id: reruns agree.

Definitions: a null text or a text without words has size 0 and is taken 0 times; very long texts
count whole; the null source is a source of its own and comes last, the empty one is another; rows
with the same doc_id are drawn one by one, with the same u; a null doc_id is drawn by its text;
columns besides doc_id, source and text are ignored by ``mix`` and pass through ``mixed`` whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rules import WORD
from .scratch import Scratch

BINS = 1024
#: bits of monotonically_increasing_id that count rows of one part
_PART_BITS = 33


def uniform(seed: int, key: Column) -> Column:
    """In (0, 1), from a hash that other engines have too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _sized(rows: DataFrame, seed: int, weight: Column | None) -> DataFrame:
    """The only pass over the texts: number of words, odds weight and u of each numbered row."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    lift = F.sqrt(F.col("size") + F.lit(1.0)) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-9))
    return rows.withColumn("size", size).select("row", "doc_id", "source", "size", lift.alias("lift"), uniform(seed, key).alias("u"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per source: source_size and target. Only sources, not documents, meet in one task."""
    by_name = W.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(1))
    before = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = per.select("*", weight.alias("w"), (F.col("source_size") * most).alias("cap"), F.sum("source_size").over(everything).alias("total"))
    per = per.select("*", F.coalesce(F.sum("cap").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("cap_before"), F.sum("w").over(before.rowsBetween(0, W.unboundedFollowing)).alias("w_left"))
    per = per.withColumn("capped", F.col("cap") * F.col("w_left") < (F.col("total") - F.col("cap_before")) * F.col("w"))
    free = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    fixed = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    share = (F.col("w") * (F.col("total") - fixed)).cast("double") / free
    return per.select("source", "source_size", "n_docs", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _with(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    """Columns of a row's source beside it."""
    return rows.alias("r").join(per_source.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")), how).drop(F.col("p.source"))


def _copies(sized: DataFrame, weights: tuple[int, ...], most: int, scratch: Scratch) -> DataFrame:
    """row, doc_id, source, size, source_size, target and copies of each row of ``sized``, which is a written table."""
    plan = scratch.table(targets(sized, weights, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio)
    f = ratio - whole
    odds = F.col("u") / (F.lit(1.0) - F.col("u"))
    rank = F.when(f > 0, odds / (f / (F.lit(1.0) - f) * F.col("lift"))).otherwise(odds / F.col("lift"))
    # the middle of a source's ranks goes to the middle bins
    scale = F.when(f > 0, f / (F.lit(1.0) - f)).otherwise(F.lit(1.0)) * F.sqrt(F.lit(1.0) + F.col("source_size") / F.col("n_docs"))
    part = (F.col("q") * scale) / (F.lit(1.0) + F.col("q") * scale)
    bin_of = F.least(F.floor(part * float(BINS * BINS)), F.lit(BINS * BINS - 1)).cast("long")
    drawn = _with(sized, plan).withColumn("whole", whole.cast("long")).withColumn("q", rank).withColumn("bin", bin_of)
    drawn = scratch.table(drawn.select("row", "doc_id", "source", "size", "source_size", "target", "whole", "q", "bin"), "drawn")

    # the order of a source's rows, from coarse to fine; ``row`` is the last of it
    levels = {"l0": F.floor(F.col("bin") / BINS), "l1": F.col("bin"), "l2": F.col("q"), "l3": F.shiftrightunsigned("row", _PART_BITS)}
    by_source = W.partitionBy("source")
    # words still wanted beyond the certain copies
    certain = drawn.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("rest"))
    cut = certain.select("source", "rest", F.lit(0).cast("long").alias("words_from"))
    fixed: list[str] = []
    for name, level in levels.items():
        inside = _with(drawn, cut)
        for n in fixed:
            inside = inside.where(levels[n] == F.col(n))
        sums = inside.groupBy("source", "rest", "words_from", *fixed, level.alias(name)).agg(F.sum("size").alias("words"))
        before = F.col("words_from") + F.coalesce(F.sum("words").over(by_source.orderBy(name).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        reached = sums.withColumn("before", before).where(F.col("before") <= F.col("rest"))
        last = reached.groupBy("source", "rest", *fixed).agg(F.max(F.struct(name, "before")).alias("m"))
        fixed.append(name)
        cut = scratch.table(last.select("source", "rest", *fixed[:-1], F.col(f"m.{name}").alias(name), F.col("m.before").alias("words_from")), f"cut-{name}")

    placed = _with(drawn, cut, "left")
    equal = [levels[n] == F.col(n) for n in fixed]
    at_cut = reduce(lambda x, y: x & y, equal)
    earlier = F.lit(False)
    for n, same in reversed(list(zip(fixed, equal))):
        earlier = (levels[n] < F.col(n)) | (same & earlier)
    done = placed.where(F.col("rest").isNull() | ~at_cut).withColumn("extra", F.coalesce(earlier, F.lit(False)).cast("long"))
    words_before = F.col("words_from") + F.coalesce(F.sum("size").over(by_source.orderBy("row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = placed.where(at_cut).withColumn("extra", (words_before + F.col("size") * 0.5 <= F.col("rest")).cast("long"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("long")
    return done.unionByName(edge).select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 7, scratch: Scratch | None = None, weight: str | None = None) -> DataFrame:
    """Rows of doc_id, source, size, source_size, target, copies and taken (words, repeats counted).

    ``weight``: a column of relative odds within a source instead of the root of the length.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    extra = [] if weight is None else [F.col(weight).alias("chance")]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text", *extra)
    sized = scratch.table(_sized(rows, seed, None if weight is None else F.col("chance")), "sizes")
    return _copies(sized, weights, most, scratch).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 7, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it. Documents without words go.

    Rows are numbered in a written table and found again by number, so rows that look alike stay apart.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    numbered = scratch.table(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc")), "numbered")
    sized = scratch.table(_sized(numbered.select("row", "doc.doc_id", "doc.source", "doc.text"), seed, None), "sizes")
    taken = _copies(sized, weights, most, scratch).where("copies > 0").select("row", "copies")
    repeated = numbered.join(taken, "row").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return repeated.select("doc.*")
