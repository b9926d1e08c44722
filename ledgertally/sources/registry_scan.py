"""One registry document of any size, read by many tasks.

The text reader cuts a file at every closing brace, whatever lines the document has, so the splits of a file are read side by side. What a piece means depends on what is before it: whether
it starts inside a string, and how deep. A piece says how it changes both, for either start; sums within a split give each split's effect, sums of those over the splits of a file, a few rows, give
each split its start, and from there each piece has its own. A piece that closes a member of the document's ``result`` ends an entry, and the pieces of an entry, which may be in two
splits, are put together and parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgertally.sources.layouts import REGISTRY_SCHEMA

#: Depth of an entry's parent, the map ``result``: its braces stand in those of the document.
MAP_DEPTH = 2
MAP_NAME = "result"
_TEXT = r'(?:[^"\\]++|\\.)*+'


def _braces(outside: Column) -> Column:
    return F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, split, place, size, value; turns: whether an odd number of quotes is in it; opened0, opened1: braces opened, if it starts outside or inside a string."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    marks = F.split(plain, '"', -1)
    at = lambda odd: F.array_join(F.filter(marks, lambda x, k: k % 2 == odd), "")
    return pieces.select("*", ((F.size(marks) - 1) % 2).alias("turns"), _braces(at(0)).alias("opened0"), _braces(at(1)).alias("opened1"))


def _within(pieces: DataFrame) -> DataFrame:
    """Adds what happens in the split up to each piece: turns_before, and for either start of the split depth0 and depth1 after the piece."""
    up_to = Window.partitionBy("file", "split").orderBy("place")
    pieces = pieces.withColumn("turns_before", F.sum("turns").over(up_to) - F.col("turns"))
    for start in (0, 1):
        inside = (F.col("turns_before") + start) % 2 == 1
        opened = F.when(inside, F.col("opened1")).otherwise(F.col("opened0"))
        closed = F.when((F.col("turns_before") + F.col("turns") + start) % 2 == 0, 1).otherwise(0)
        pieces = pieces.withColumn(f"change{start}", opened - closed)
    return pieces.select("*", *[F.sum(f"change{start}").over(up_to).alias(f"depth{start}") for start in (0, 1)])


def _starts(pieces: DataFrame) -> DataFrame:
    """file, split, inside, depth: how each split starts. An error if a file does not end as it has to."""
    totals = pieces.groupBy("file", "split").agg(
        (F.sum("turns") % 2).alias("turns"),
        F.sum("change0").alias("change0"),
        F.sum("change1").alias("change1"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.max("size").alias("size"),
    )
    order = Window.partitionBy("file").orderBy("split")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    totals = totals.withColumn("inside", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
    totals = totals.withColumn("change", F.when(F.col("inside") == 1, F.col("change1")).otherwise(F.col("change0")))
    totals = totals.select(
        "*",
        F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"),
        F.sum("change").over(whole).alias("last"),
        (F.sum("turns").over(whole) % 2).alias("open_text"),
        (F.sum("bytes").over(whole) - F.col("size")).alias("beyond"),
    )
    # The last piece counts as closed too; if the file goes on behind its last brace, that is one too many.
    ends = F.when(F.col("beyond") == 0, F.col("last") == 0).when(F.col("beyond") == 1, F.col("last") == -1).otherwise(F.col("last").isin(0, -1))
    broken = F.raise_error(F.concat(F.lit("no whole JSON document: "), F.col("file"))).cast("bigint")
    return totals.select("file", "split", "inside", F.when(ends & (F.col("open_text") == 0), F.col("depth")).otherwise(broken).alias("depth"))


def _opening(braces: Column, inside: Column) -> Column:
    """A pattern for a piece up to so many structural braces from its start."""
    start = F.when(inside == 1, F.lit(rf'^(?s:{_TEXT}")')).otherwise(F.lit("^"))
    return F.concat(start, F.lit(rf'(?s:(?:[^"{{]++|"{_TEXT}")*+\{{){{'), braces.cast("string"), F.lit("}"))


def read_registry_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``entry_key, entry`` of every member of the map ``result`` of the documents in the files, one or more in each, with any white space.

    A document that ends early or an entry that is no JSON stops the job, as a registry that silently reads as empty would give an empty answer. Documents nested in arrays are not looked at.
    """
    pieces = _within(_pieces(spark, path))
    known = pieces.join(_starts(pieces), ["file", "split"])
    starts_inside = (F.col("inside") + F.col("turns_before")) % 2
    after = F.col("depth") + F.when(F.col("inside") == 1, F.col("depth1")).otherwise(F.col("depth0"))
    change = F.when(F.col("inside") == 1, F.col("change1")).otherwise(F.col("change0"))
    closes = (F.col("inside") + F.col("turns_before") + F.col("turns")) % 2 == 0
    known = known.select("file", "split", "place", "value", starts_inside.alias("inside"), (after - change).alias("from"), after.alias("to"), closes.alias("closes"))

    # Where the map's own brace is in a piece, its name stands before it and its first entry behind it.
    opens = (F.col("from") < MAP_DEPTH) & (F.col("to") + F.col("closes").cast("int") >= MAP_DEPTH)
    head = F.when(opens, F.regexp_substr("value", _opening(F.lit(MAP_DEPTH) - F.col("from"), F.col("inside"))))
    known = known.withColumn("head", head)
    known = known.withColumn("name", F.regexp_extract("head", rf'"({_TEXT})"\s*+:\s*+\{{$', 1))
    known = known.withColumn("rest", F.when(opens, F.substr("value", F.length("head") + 1)).otherwise(F.col("value")))
    known = known.withColumn("ends", (F.col("closes") & (F.col("to") == MAP_DEPTH)).cast("int"))

    # Ends of entries, and the map that is open, over the splits of a file in the same way.
    up_to = Window.partitionBy("file", "split").orderBy("place")
    known = known.withColumn("ended", F.sum("ends").over(up_to) - F.col("ends")).withColumn("map", F.last("name", True).over(up_to))
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = known.groupBy("file", "split").agg(F.sum("ends").alias("ends"), F.max_by("map", "place").alias("map"))
    totals = totals.select("file", "split", F.coalesce(F.sum("ends").over(order), F.lit(0)).alias("ended_before"), F.last("map", True).over(order).alias("map_before"))
    known = known.join(totals, ["file", "split"])
    known = known.withColumn("entry", F.col("ended") + F.col("ended_before")).withColumn("map", F.coalesce("map", "map_before"))
    # Of an entry are all pieces within the map but the one that closes it.
    parts = known.where((F.col("to") >= MAP_DEPTH) & (F.col("map") == MAP_NAME)).groupBy("file", "entry").agg(F.array_sort(F.collect_list(F.struct("split", "place", "rest"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda part: part["rest"]), "}")
    members = F.from_json(F.concat(F.lit("{"), F.regexp_replace(text, r"^[\s,]*+", ""), F.lit("}}")), REGISTRY_SCHEMA["result"].dataType, {"mode": "FAILFAST"})
    return parts.select(F.explode(members).alias("entry_key", "entry"))
