"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction, and a vector belongs to it if their cosine exceeds a threshold. Directions are a product code: after a random
rotation the places are split in two halves, each with its own random code words, and every combination of one word
of either half is a direction. The scores of a half's words are sorted, so a vector's list of all filters it exceeds is read off without
trying the others. Several such codes are used, with rotations of their own, since a pair that one code serves badly is an ordinary one for
the next. Vectors that share a filter are compared in double precision.

Equal vectors are one class in all of this. The threshold rises with the number of vectors, so that a filter holds less than one unrelated vector on average: else
chance meetings would grow with the square of that number. Whatever it is, a code has as many filters as make a pair at the wanted cosine share `shared` of them on average.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgertally.llm.components import components
from ledgertally.llm.tables import stored

_ROWS = 512


@dataclass(frozen=True)
class Caps:
    """With these, about one in 10**5 pairs at the very cosine shares no filter, and far fewer above it."""

    cosine: float = 0.9
    codes: int = 8
    shared: float = 7.5
    meetings: float = 0.5
    seed: int = 11


@dataclass(frozen=True)
class Code:
    """words: for either half (words, places); threshold: of the sum of two scores."""

    rotation: np.ndarray
    words: tuple[np.ndarray, np.ndarray]
    threshold: float


def _threshold(size: int, caps: Caps, vectors: int) -> tuple[float, float, float]:
    """The cosine with a filter above which a vector of so many places belongs to it, the odds that a random one does, and
    the odds that one at the wanted cosine from a member does: 10 % at least."""
    s = np.linspace(-1, 1, 4001)[1:-1]
    density = np.exp((size - 3) / 2 * np.log1p(-(s**2)))
    tail = np.cumsum(density[::-1])[::-1] / density.sum()
    side = np.exp((size - 4) / 2 * np.log1p(-(s**2)))  # of the part across, in one place less
    side_tail = np.append(np.cumsum(side[::-1])[::-1] / side.sum(), 0.0)
    for t in np.arange(0.95, 0.0, -0.005):
        x = s >= t
        need = (t - caps.cosine * s[x]) / (np.sqrt(1 - caps.cosine**2) * np.sqrt(1 - s[x] ** 2))
        both = float((density[x] * side_tail[np.searchsorted(s, need)]).sum() / density[x].sum())
        odds = float(tail[x][0])
        if both >= 0.5 or both >= 0.1 and odds * vectors >= caps.meetings:
            break
    return float(t), odds, both


@lru_cache(maxsize=64)
def code(places: int, caps: Caps, number: int, vectors: int) -> Code:
    """One of the codes for so many vectors of so many places; short ones are padded to 16."""
    size = max(16, places + places % 2)
    threshold, odds, both = _threshold(size, caps, vectors)
    count = max(2, int(np.ceil(np.sqrt(caps.shared / both / odds))))
    rng = np.random.default_rng((caps.seed, size, number))
    rotation, _ = np.linalg.qr(rng.standard_normal((size, size)))
    halves = []
    for _ in range(2):
        words = rng.standard_normal((count, size // 2))
        halves.append(words / np.linalg.norm(words, axis=1, keepdims=True))
    return Code(rotation, (halves[0], halves[1]), threshold * np.sqrt(2))


def decoded(x: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """The list of filters of each unit vector: (row, filter)."""
    half = len(code.rotation) // 2
    turned = x @ code.rotation[: x.shape[1]]
    a, b = (turned[:, k * half : (k + 1) * half] @ code.words[k].T for k in range(2))
    count, rows, filters = len(code.words[0]), [], []
    for row in range(len(x)):
        near = np.flatnonzero(a[row] >= code.threshold - b[row].max())
        other = np.flatnonzero(b[row] >= code.threshold - a[row].max())
        other = other[np.argsort(-b[row, other], kind="stable")]
        upto = np.searchsorted(-b[row, other], a[row, near] - code.threshold, "right")
        place = np.arange(int(upto.sum())) - np.repeat(np.cumsum(upto) - upto, upto)
        filters.append(np.repeat(near, upto) * count + other[place])
        rows.append(np.full(len(place), row))
    return np.concatenate(rows), np.concatenate(filters)


def _valid(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their places in double precision; null where nothing can be linked."""
    for batch in batches:
        out = []
        for ident, vector in zip(batch.column("vec_id"), batch.column("embedding"), strict=True):
            places = None
            if ident.is_valid and vector.is_valid and len(vector.values) and not vector.values.null_count:
                found = vector.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0 as 0
                if np.isfinite(found).all() and found.any():
                    places = found.tobytes()
            out.append(places)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "places"])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)  # else squares of large or small numbers leave the range
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All places of a column of vectors' bytes, and where each vector's begin (one more at the end)."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    return np.frombuffer(data.tobytes(), np.float64), (at - at[0]) // 8


def _listed(caps: Caps, vectors: int):
    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, (flat, begins) = batch.column("id"), _places(batch.column("places"))
            sizes = np.diff(begins)
            for size in np.unique(sizes).tolist():
                of_size = np.flatnonzero(sizes == size)
                for at in (of_size[k : k + _ROWS] for k in range(0, len(of_size), _ROWS)):
                    x = flat[begins[at][:, None] + np.arange(size)]
                    for number in range(caps.codes):
                        rows, filters = decoded(unit(x), code(size, caps, number, vectors))
                        keys = [pa.array(np.full(len(rows), size * caps.codes + number), pa.int32()), pa.array(filters, pa.int64()), ids.take(pa.array(at[rows]))]
                        yield pa.RecordBatch.from_arrays(keys, ["code", "filter", "id"])

    return listed


def _linked(caps: Caps):
    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 20_000) for k in range(0, batch.num_rows, 20_000)):
                if not part.num_rows:
                    continue
                flat, begins = zip(*(_places(part.column(c)) for c in ("places_u", "places_v")), strict=True)
                sizes, keep = np.diff(begins[0]), np.zeros(part.num_rows, bool)
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    a, b = (unit(f[g[at][:, None] + np.arange(size)]) for f, g in zip(flat, begins, strict=True))
                    keep[at] = np.einsum("ij,ij->i", a, b) >= caps.cosine
                yield part.select(["u", "v"]).filter(pa.array(keep))

    return linked


def near_vectors(vectors: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """Per row: vec_id, n_links (other vectors at that cosine or above), component_id (smallest vec_id reachable by links), kept (it is that one).

    Vectors that are null, empty or zero, or hold null or non-finite places, and rows with a null vec_id have no links. Vectors of different lengths
    have none with each other. Repeated rows are vectors of their own, linked with each other; a vec_id of several vectors joins their components. Columns other than vec_id and embedding are not read.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = stored(vectors.select("vec_id", "embedding").mapInArrow(_valid, f"vec_id {kind}, places binary"), "vectors")
    classes = rows.filter("places is not null").groupBy("places").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("key", F.xxhash64("places")), "classes")  # a vec_id may have several vectors, so classes go by a fingerprint of theirs
    vectors_in_all = classes.count()
    keyed = classes.select(F.col("key").alias("id"), "places")
    listed = stored(keyed.mapInArrow(_listed(caps, vectors_in_all), "code int, filter bigint, id bigint"), "listed")
    other = listed.withColumnRenamed("id", "v")
    pairs = listed.withColumnRenamed("id", "u").join(other, ["code", "filter"]).filter("u < v").select("u", "v").distinct()
    ends = {end: classes.select(F.col("key").alias(end), F.col("places").alias(f"places_{end}")) for end in "uv"}
    full = pairs.join(ends["u"], "u").join(ends["v"], "v").select("u", "v", "places_u", "places_v")
    links = stored(full.filter("length(places_u) = length(places_v)").mapInArrow(_linked(caps), "u bigint, v bigint"), "links")

    both = links.union(links.select("v", "u")).join(classes.select(F.col("key").alias("v"), "copies"), "v")
    others = stored(both.groupBy("u").agg(F.sum("copies").alias("others")), "others")
    # Components are of vec_ids: one that is in several classes ties them.
    ids = {end: classes.select(F.col("key").alias(end), F.col("id").alias(f"id_{end}")) for end in "uv"}
    edges = links.join(ids["u"], "u").join(ids["v"], "v").select(F.col("id_u").alias("u"), F.col("id_v").alias("v"))
    members = rows.filter("places is not null and vec_id is not null").select("vec_id", "places").distinct().join(classes.select("places", "id", "key"), "places")
    several = members.groupBy("vec_id").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most").select("vec_id")
    edges = edges.union(members.join(several, "vec_id").select(F.col("vec_id").alias("u"), F.col("id").alias("v")))
    named = classes.join(others.withColumnRenamed("u", "key"), "key", "left").join(components(edges).withColumnRenamed("node", "id"), "id", "left")
    links_of = F.coalesce("others", F.lit(0)) + F.col("copies") - 1
    named = stored(named.select("places", links_of.alias("n_links"), F.coalesce("component", "id").alias("component_id")), "named")
    out = rows.join(named, "places", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
