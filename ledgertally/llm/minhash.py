"""Near-duplicate documents: MinHash over word shingles.

1. Each document gets the set of its shingles and the minima of many universal hashes of it. Documents with equal sets are one class, which its
   smallest doc_id stands for.
2. Bands of minima put classes into buckets. In a bucket everything is compared with the smallest member, its head; that alone joins
   large groups of copies, with as many pairs as members.
3. No link may be lost between members that this leaves in different components. Their minima are compared with each other, block by block, which
   gives groups whose minima agree, across buckets. Within a group the full sets are compared, again block by block. Only links
   that join components leave a comparison, so as few rows as members come of it, however many pairs it looked at.
4. A head and a member are compared by their minima first, then on the full sets. Links of both passes give the components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgertally.llm.components import components
from ledgertally.llm.tables import passing, slices, stored
from ledgertally.llm.words import mixed, words
from ledgertally.operators.keyfilter import only_listed

_TURN = np.uint64(0x9FB21C651E98DF25)
_OTHER = np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Plan:
    """Sets of shingles of `width` words are alike from `percent` % of the union. With 40 bands of 5 minima, a pair at 80 % misses all
    buckets with odds of 1 in 10**7, and a pair at 5 % meets in one with odds of 1 in 10**5. A pair goes on to its full sets if 62 %
    of its minima agree; at 80 % similarity fewer do with odds of 1 in 10**9."""

    width: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    agreeing: float = 0.62
    block: int = 256
    block_bytes: int = 4 << 20


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of the distinct shingles of each text, and where each text's begin (one more at the end)."""
    found = words(column, lower=True)
    prints, counts = found.fingerprints(), found.counts
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begins = np.append(0, np.cumsum(sizes))
    at = np.arange(begins[-1]) - np.repeat(begins[:-1], sizes) + np.repeat(found.first[:-1], sizes)
    last = np.repeat(found.first[1:], sizes)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for step in range(width):
            inside = at + step < last
            out = np.where(inside, mixed(out * _TURN + prints[np.where(inside, at + step, 0)]), out) if len(prints) else out
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    text = np.repeat(np.arange(len(sizes)), sizes)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[keep], np.append(0, np.cumsum(np.bincount(text[keep], minlength=len(sizes))))


def _minima(prints: np.ndarray, begins: np.ndarray, hashes: int) -> np.ndarray:
    """For each non-empty set the minima of the hashes (a * x + b) mod 2**64, their upper half."""
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(begins), hashes), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(hashes):
            out[:, k] = np.minimum.reduceat(prints * factors[k] + shifts[k], begins) >> np.uint64(32)
    return out


def _band_keys(minima: np.ndarray, plan: Plan) -> np.ndarray:
    """A 64-bit key for each band of each row of minima."""
    values = minima.reshape(-1, plan.bands, plan.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(plan.bands, dtype=np.uint64), values.shape[:2])
    for row in range(plan.rows):
        key = mixed(key ^ (values[:, :, row] << np.uint64(16)))
    return key


def _signatures(plan: Plan):
    """Size, fingerprint and band keys of each set, and of each minimum a byte: enough to compare, as unequal ones agree in 1 of 256 cases."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row_number = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            prints, begins = shingle_sets(batch.column("text"), plan.width)
            sizes = np.diff(begins)
            full = np.flatnonzero(sizes)
            low, high = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            bands, minima = [None] * len(sizes), [None] * len(sizes)
            if len(full):
                with np.errstate(over="ignore"):
                    low[full] = np.add.reduceat(mixed(prints), begins[full])
                    high[full] = np.add.reduceat(mixed(prints ^ _OTHER), begins[full])
                least = _minima(prints, begins[full], plan.bands * plan.rows)
                for row, keys, minimum in zip(full.tolist(), _band_keys(least, plan), least.astype(np.uint8), strict=True):
                    bands[row], minima[row] = keys.tobytes(), minimum.tobytes()
            uid = (part << 33) + row_number + np.arange(len(sizes))
            row_number += len(sizes)
            values = [pa.array(sizes, pa.int64()), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array(uid), pa.array(bands, pa.binary()), pa.array(minima, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), *values], ["doc_id", "print", "n_shingles", "low", "high", "uid", "bands", "minima"])

    return sign


def _banded(plan: Plan):
    def banded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
                ids = batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), plan.bands)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), ids], ["key", "id"])

    return banded


def _agree(plan: Plan):
    """Pairs of which enough minima agree."""

    def agree(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("minima_u", "minima_v"))
                yield batch.select(["u", "v"]).filter(pa.array((a == b).mean(axis=1) >= plan.agreeing))

    return agree


def _confirm(plan: Plan):
    """Pairs whose full sets are alike enough."""

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_u"), "text_v"):
            (a, a_at), (b, b_at) = (shingle_sets(batch.column(c), plan.width) for c in ("text_u", "text_v"))
            links = []
            for row in range(batch.num_rows):
                x, y = a[a_at[row] : a_at[row + 1]], b[b_at[row] : b_at[row + 1]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                links.append(bool(shared) and 100 * shared >= plan.percent * (len(x) + len(y) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(links, pa.bool_()))

    return confirm


class _Forest:
    """Which components of a cell are joined by now."""

    def __init__(self, components: np.ndarray):
        self.root = components.copy()  # of each row; small numbers

    def join(self, row: int, other: int) -> None:
        self.root[self.root == self.root[other]] = self.root[row]


def _sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, _Forest]:
    """Rows of the first block, whether a row is of the other one (of the only one, if there is no other), and components."""
    block = cell.column("block").to_numpy()
    first = block == block.min()
    kinds = np.unique(np.array(cell.column("component").to_pylist()), return_inverse=True)[1]
    return np.flatnonzero(first), ~first if not first.all() else first, _Forest(kinds)


def _minima_cells(plan: Plan):
    """Pairs of components of which members agree in enough minima; as many as join them."""

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        minima = np.frombuffer(b"".join(cell.column("minima").to_pylist()), np.uint8).reshape(cell.num_rows, -1)
        rows, side, forest = _sides(cell)
        found = []
        for row in rows:
            others = np.flatnonzero(side & (forest.root != forest.root[row]))
            for other in others[(minima[others] == minima[row]).mean(axis=1) >= plan.agreeing]:
                if forest.root[other] != forest.root[row]:
                    found.append((row, other))
                    forest.join(row, other)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({end: cell.column("component").take(pa.array(at[:, k])) for k, end in enumerate("uv")})

    return compare


def _set_cells(plan: Plan):
    """Links between members of different components; as many as join them."""

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        prints, begins = shingle_sets(cell.column("text"), plan.width)
        sizes = np.diff(begins)
        minima = np.frombuffer(b"".join(cell.column("minima").to_pylist()), np.uint8).reshape(cell.num_rows, -1)
        rows, side, forest = _sides(cell)
        found = []
        for row in rows:
            own = prints[begins[row] : begins[row + 1]]
            near = side & (forest.root != forest.root[row]) & (100 * np.minimum(sizes, sizes[row]) >= plan.percent * np.maximum(sizes, sizes[row]))
            others = np.flatnonzero(near)
            for other in others[(minima[others] == minima[row]).mean(axis=1) >= plan.agreeing]:
                if forest.root[other] != forest.root[row]:
                    theirs = prints[begins[other] : begins[other + 1]]
                    at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                    shared = int((own[at] == theirs).sum())
                    if 100 * shared >= plan.percent * (len(own) + len(theirs) - shared):
                        found.append((row, other))
                        forest.join(row, other)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({end: cell.column("id").take(pa.array(at[:, k])) for k, end in enumerate("uv")})

    return compare


def _in_cells(rows: DataFrame) -> DataFrame:
    """Rows with `blocks` of their key, once for each cell that compares their block with another or with itself."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.least("block", "other") * F.col("blocks").cast("long") + F.greatest("block", "other")
    return placed.withColumn("cell", cell).drop("other", "blocks")


def _across(members: DataFrame, classes: DataFrame, texts: DataFrame, found: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """Links between members of buckets, heads aside, that are still in different components."""
    rows = members.filter("id <> head").join(found.withColumnRenamed("node", "id"), "id", "left")
    rows = stored(rows.select("key", "id", F.coalesce("component", "id").alias("component")), "rows")
    split = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b")
    split = stored(split.select("key", F.ceil(F.col("size") / plan.block).cast("int").alias("blocks")), "split")
    open_rows = stored(rows.join(split, "key"), "open")
    cells = _in_cells(open_rows.join(classes.select("id", "minima"), "id"))
    near = cells.groupBy("key", "cell").applyInArrow(_minima_cells(plan), kind)
    groups = components(stored(near, "near")).select(F.col("node").alias("component"), F.col("component").alias("group"))

    grouped = stored(open_rows.select("id", "component").distinct().join(stored(groups, "groups"), "component"), "grouped")
    asked = stored(grouped.join(classes.select("id", "print", "minima"), "id"), "asked")
    full = stored(asked.join(_wanted(texts, asked), ["id", "print"]).drop("print"), "full")
    sizes = full.groupBy("group").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("rows") / plan.block, F.col("bytes") / plan.block_bytes, F.lit(1))).cast("int")
    sizes = stored(sizes.select("group", blocks.alias("blocks")), "blocks")
    return _in_cells(full.join(sizes, "group")).groupBy("group", "cell").applyInArrow(_set_cells(plan), kind)


def _wanted(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """One row for each asked id and print, with its text. A filter of what is asked for is applied where the texts are read, so that few others are moved."""
    both = F.xxhash64("id", "print").alias("both")
    asked = stored(asked.select("id", "print"), "prints")
    near = only_listed(texts.select("*", both), asked.select(both), "both").drop("both")
    return near.join(asked, ["id", "print"], "left_semi").dropDuplicates(["id", "print"])


def _links(close: DataFrame, classes: DataFrame, texts: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """Of pairs (u, v) those whose full texts are alike enough."""
    ends = close.select("u").union(close.select("v")).distinct().withColumnRenamed("u", "id")
    asked = ends.join(classes.select("id", "print"), "id")
    wanted = stored(_wanted(texts, asked).select("id", "text"), "texts")
    of = {end: wanted.select(F.col("id").alias(end), F.col("text").alias(f"text_{end}")) for end in "uv"}
    full = close.join(of["u"], "u").join(of["v"], "v").select("u", "v", "text_u", "text_v")
    return stored(full.mapInArrow(_confirm(plan), kind), "links")


def near_duplicates(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (it is that one), of whole texts.

    A text without words has no shingles and no links; one of fewer words than a shingle is one shingle. Null doc_ids can't be referred to:
    their rows have no links, a null component_id, and are kept. Rows of one doc_id are one document: its texts are linked.
    Columns other than doc_id and text are not read.
    """
    id_type = documents.schema["doc_id"].dataType
    id_kind = id_type.simpleString()
    signed = documents.select("doc_id", "text", F.xxhash64("text").alias("print"))
    kinds = f"doc_id {id_kind}, print bigint, n_shingles bigint, low bigint, high bigint, uid bigint, bands binary, minima binary"
    signed = stored(signed.mapInArrow(_signatures(plan), kinds), "signatures")
    with passing():
        named = _named(documents, signed, plan)
    named = signed.select("doc_id", "n_shingles", "low", "high").join(named, ["low", "high"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _named(documents: DataFrame, signed: DataFrame, plan: Plan) -> DataFrame:
    """low, high, component_id of each class of equal sets."""
    id_kind = documents.schema["doc_id"].dataType.simpleString()
    kind = f"u {id_kind}, v {id_kind}"
    texts = documents.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("print"))

    # A class's representative is one row of its smallest doc_id; wide columns are moved once it is known.
    numbered = signed.filter("n_shingles > 0 and doc_id is not null")
    least = stored(numbered.groupBy("low", "high").agg(F.min("doc_id").alias("doc_id")), "least")
    narrow = numbered.select("low", "high", "doc_id", "uid").join(least, ["low", "high", "doc_id"])
    chosen = stored(narrow.groupBy("low", "high").agg(F.min("uid").alias("uid")).select("uid"), "chosen")
    classes = stored(numbered.join(chosen, "uid", "left_semi").select(F.col("doc_id").alias("id"), "print", "bands", "minima"), "classes")

    banded = classes.select("id", "bands").mapInArrow(_banded(plan), f"key bigint, id {id_kind}")
    heads = stored(banded.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("size")).filter("size > 1").drop("size"), "heads")
    members = stored(only_listed(banded, heads, "key").join(heads, "key"), "members")
    classes = stored(classes.drop("bands").join(members.select("id").distinct(), "id", "left_semi"), "met")  # the others have no link
    first = members.filter("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v")).distinct()
    by = {end: classes.select(F.col("id").alias(end), F.col("minima").alias(f"minima_{end}")) for end in "uv"}
    first = first.join(by["u"], "u").join(by["v"], "v").select("u", "v", "minima_u", "minima_v").mapInArrow(_agree(plan), kind)
    links = _links(stored(first, "first"), classes, texts, plan, kind)
    links = stored(links.union(_same_document(numbered, least)), "links-1")
    found = components(links)
    second = stored(_across(members, classes, texts, found, plan, kind), "second")
    if not second.isEmpty():
        found = components(links.union(second))

    # Classes on their own are named by their document; the others take what their component is called.
    of_class = least.select("low", "high", F.col("doc_id").alias("id")).join(found.withColumnRenamed("node", "id"), "id", "left")
    return stored(of_class.select("low", "high", F.coalesce("component", "id").alias("component_id")), "named", keep=True)


def _same_document(numbered: DataFrame, least: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    pairs = numbered.select("doc_id", "low", "high").distinct()
    several = stored(pairs.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "several")
    ends = pairs.join(several, "doc_id").join(least.withColumnRenamed("doc_id", "class_id"), ["low", "high"])
    return ends.select(F.col("doc_id").alias("u"), F.col("class_id").alias("v")).filter("u <> v")
