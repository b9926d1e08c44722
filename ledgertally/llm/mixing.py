"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

The words of all documents are shared among the sources by weight; no target is above a multiple of its source's own words,
and what is cut off goes to the others by weight. A source whose target is t times its words takes every document floor(t) times. The
rest of the target is a sample without repeats in which long documents are likelier: documents are ranked by the odds of a
random number divided by inclusion odds, which are proportional to the document's size, and taken in that order until
their words fill the rest, to the nearest document. Random numbers come from the doc_id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgertally.llm.tables import stored

#: Ranks of a source are grouped into so many bins of about equal size. Sums of bins show in which the rest ends, and only that one is sorted.
BINS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weighed(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Per source: source_size, documents with words, and weight, which repeats along the sources by code point, null last.

    The numbering is by ranges of sources, so that any number of sources will do.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("full"))
    ranged = stored(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    parts = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    numbered = ranged.join(parts.select("part", before.alias("before")), "part").withColumn("place", F.col("before") + place - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    return stored(numbered.select("source", "source_size", "full", weight.cast("long").alias("weight")), "weights")


def with_targets(sources: DataFrame, limit: int) -> DataFrame:
    """Adds target: the share by weight of all words, at most `limit` times the source's own; the excess goes to the others.

    Each round is one row of sums to the driver; a round caps further sources or is the last.
    """
    most = F.col("source_size") * limit
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    rest, weight, free, share = total, None, None, F.lit(0.0)
    while True:
        capped = F.lit(False) if weight is None else F.lit(float(rest)) * F.col("weight") / F.lit(float(weight)) >= most
        sums = sources.agg(
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(F.when(capped, most)), F.lit(0)),
            F.count_if(~capped),
        ).first()
        if sums[2] == free or not sums[0]:
            return sources.withColumn("target", F.when(capped, most.cast("double")).otherwise(share))
        weight, rest, free = sums[0], total - sums[1], sums[2]
        share = F.lit(float(rest)) * F.col("weight") / F.lit(float(weight))


def draw(doc_id: Column, seed: str) -> Column:
    """A number above 0 and below 1 from the doc_id: 52 bits of a digest."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"/{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def mixed_sources(documents: DataFrame, weights: Sequence[int] = (5, 2, 1), limit: int = 3, seed: str = "mix", columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The given columns of each row, size (words), source_size, target (of its source), taken (words the mix takes, repeats counted), copies.

    A null or wordless text has size 0 and is taken with nothing. A null source is a source like others, the last by order; a
    null doc_id draws as an empty one. Repeated rows are documents of their own; of rows alike in doc_id and size any may be taken.
    An empty table gives an empty one. Only `columns`, doc_id, source and text are read.
    """
    sizes = stored(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = with_targets(weighed(sizes, weights), limit)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = stored(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")

    # Other columns come from the documents themselves; texts are counted once more then, which is cheaper than to store them.
    names = list(columns)
    carried = F.struct(*(F.col(c) for c in names)).alias("carried")
    if names == ["doc_id"]:
        rows = sizes.select("doc_id", "source", "size", carried)
    else:
        rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), carried)
    odds = draw(F.col("doc_id"), seed)
    ranked = (
        rows.alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.*", "source_size", "target", "whole", "rest", "full")
        .withColumn("key", F.when(F.col("size") > 0, odds / (1 - odds) / F.col("size")))
        .withColumn("spread", F.col("key") * F.col("source_size") / F.col("full"))
        .withColumn("bin", F.floor(F.col("spread") / (1 + F.col("spread")) * BINS).cast("int"))
    )
    bins = ranked.filter("size > 0").groupBy("source", "bin", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ends = bins.withColumn("before", upto - F.col("words")).filter("before < rest and rest <= before + words")
    ends = stored(ends.select("source", F.col("bin").alias("end_bin"), "before"), "ends")

    placed = ranked.alias("d").join(ends.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")), "left").select("d.*", "end_bin", "before")
    at_end = F.coalesce(F.col("bin") == F.col("end_bin"), F.lit(False))
    clear = placed.filter(~at_end).withColumn("more", F.coalesce(F.col("bin") < F.col("end_bin"), F.lit(False)))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    close = placed.filter(at_end).withColumn("more", F.col("before") + running - F.col("size") / 2 <= F.col("rest"))
    copies = F.col("whole") + F.col("more").cast("long")
    return clear.union(close).select("carried.*", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))
