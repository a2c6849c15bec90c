"""Cosine similarity over array<float> columns, in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null if a vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vector_of(vectors: DataFrame, memory_id: str) -> DataFrame:
    """The query vector: one row (q)."""
    return vectors.where(F.col("memory_id") == memory_id).select(F.col("embedding").alias("q")).limit(1)


def similarities(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """V-05, V-06, V-07. ``vectors`` with their similarity to the one query row, cut to [0, 1].

    Vectors of another dimension and vectors without length are left out.
    """
    both = vectors.crossJoin(F.broadcast(query)).where(F.size("embedding") == F.size("q"))
    found = both.withColumn("similarity", cosine("embedding", "q")).where("similarity IS NOT NULL").drop("q")
    return found.withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))))


def nearest(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """O-14. The k most similar vectors; ties fall to the smaller id."""
    return similarities(vectors, query).orderBy(F.desc("similarity"), "memory_id").limit(k)


#: Vectors that stand for their neighbourhoods, and bytes that they may have together, as every task gets them.
PIVOTS = 256
PIVOT_BYTES = 16 << 20


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbourhoods(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` with the nearest pivot and its angle; -1 for vectors of another size than the pivots'."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pivot, angle = np.full(len(f), -1), np.zeros(len(f))
            fits = (f["embedding"].map(len) == pivots.shape[1]).to_numpy()
            if fits.any():
                cosines = _unit(f["embedding"][fits]) @ pivots.T
                pivot[fits] = cosines.argmax(1)
                angle[fits] = np.arccos(np.clip(cosines.max(1), -1, 1))
            yield f.assign(pivot=pivot, angle=angle)

    return vectors.mapInPandas(near, f"{kinds}, pivot int, angle double")


def comparable(pivots: np.ndarray, radius: dict[int, float], least: float) -> list[tuple[int, int]]:
    """Pairs of neighbourhoods that may hold vectors of at least that similarity, both ways round.

    Two vectors are at least as far apart as their pivots less what each is away from its own.
    """
    held = np.array(sorted(k for k in radius if k >= 0), np.int64)
    reach = np.array([radius[k] for k in held])
    apart = np.arccos(np.clip(pivots[held] @ pivots[held].T, -1, 1)) - reach[:, None] - reach[None, :]
    a, b = np.nonzero(apart <= np.arccos(np.clip(least, -1, 1)) + 1e-6)
    return [*zip(held[a].tolist(), held[b].tolist(), strict=True), *([(-1, -1)] if -1 in radius else [])]


#: Vectors of a block, at least and at most, about how many blocks there are before they grow to the most, and bytes of a block.
BLOCK, LARGEST_BLOCK, BLOCKS, BLOCK_BYTES = 256, 32768, 32, 16 << 20
#: Vectors that travel as one row.
PACKED = 1024
#: Vectors of each side of a matrix product, and pairs that a task holds at once.
TILE, AT_ONCE = 512, 1 << 16
#: Where more than one pair in so many is close, the whole product is made in double precision.
DENSE = 64


def similar_pairs(vectors: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """J-21, V-24. (a, b, similarity) of all pairs of at least that similarity, a < b.

    Vectors are dealt to the nearest of some pivots, and neighbourhoods that are too far apart for any pair are not
    compared. Those left are split into blocks, and every pair of blocks is compared in a task of its own, by small matrix
    products in single precision with room for its rounding; what passes is worked out in double precision, so the result is
    exact. Only the pairs that pass leave a task. A vector is sent to as many tasks as there are blocks, in rows of ``PACKED``
    vectors, so blocks grow with the vectors, up to ``LARGEST_BLOCK`` and ``BLOCK_BYTES``. Vectors with a component that is null
    or not finite are like none.
    """
    kinds = pa.schema([("a", pa.string()), ("b", pa.string()), ("similarity", pa.float64())])

    def pairs(left: pa.Array, right: pa.Array, i: np.ndarray, j: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
        one, two = left.take(pa.array(i)), right.take(pa.array(j))
        return pa.RecordBatch.from_arrays([pc.min_element_wise(one, two), pc.max_element_wise(one, two), pa.array(sim)], schema=kinds)

    return _compared(vectors, least, block, pairs, "a string, b string, similarity double")


def similarity_bins(vectors: DataFrame, least: float, per_unit: int = 10, block: int | None = None) -> DataFrame:
    """A-26. (bin, n): how many pairs there are by similarity, in steps of 1 / ``per_unit``; tasks send counts on, no pairs."""
    kinds = pa.schema([("bin", pa.int32()), ("n", pa.int64())])

    def count(left: pa.Array, right: pa.Array, i: np.ndarray, j: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
        bins, n = np.unique(np.floor(sim * per_unit + 1e-9).astype(np.int32), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n.astype(np.int64))], schema=kinds)

    return _compared(vectors, least, block, count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``PACKED`` vectors of one size: their ids, and their components as one string of bytes."""
    for b in batches:
        lengths = pc.list_value_length(b.column("embedding")).to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            same = b.filter(pa.array(lengths == length))
            for at in range(0, same.num_rows, PACKED):
                few = same.slice(at, PACKED)
                ids, components = few.column("memory_id"), few.column("embedding").flatten().to_numpy(zero_copy_only=False)
                one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.string()))
                yield pa.RecordBatch.from_arrays([few.column("own").slice(0, 1), pa.array([length], pa.int32()), one, pa.array([components.astype(np.float64 if components.dtype == np.float64 else np.float32).tobytes()])], names=["own", "length", "ids", "components"])


def passing(x: np.ndarray, y: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, similarity) of unit vectors of at least that similarity; without ``y`` each pair in x once."""
    room = (x.shape[1] + 8) * float(np.finfo(np.float32).eps)  # of a product in single precision
    left, right = x.astype(np.float32), (x if y is None else y).astype(np.float32)
    exact = x if y is None else y
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def settled() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        i, j, sim = (np.concatenate(k) for k in zip(*held, strict=True))
        keep = sim >= least
        yield i[keep], j[keep], sim[keep]

    for r in range(0, len(left), TILE):
        for c in range(0 if y is not None else r, len(right), TILE):
            close = left[r : r + TILE] @ right[c : c + TILE].T >= least - room
            if y is None and r == c:
                close = np.triu(close, 1)
            i, j = np.divmod(np.flatnonzero(close), close.shape[1])
            if len(i) > close.size // DENSE:
                sim = (x[r : r + TILE] @ exact[c : c + TILE].T)[i, j]
                edge = np.abs(sim - least) < 1e-12  # sums in another order: what decides is the same in both ways
                sim[edge] = np.einsum("ij,ij->i", x[i[edge] + r], exact[j[edge] + c])
            else:
                sim = np.einsum("ij,ij->i", x[i + r], exact[j + c])
            held.append((i + r, j + c, sim))
            size += len(i)
            if size >= AT_ONCE:
                yield from settled()
                held, size = [], 0
    if size:
        yield from settled()


def _compared(vectors: DataFrame, least: float, block: int | None, emit: Callable[[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], kinds: str) -> DataFrame:
    """What ``emit`` makes of slices of the pairs that pass: ids of both sides, places in them and similarities."""
    spark = vectors.sparkSession
    ship(spark)
    whole = vectors.select("memory_id", "embedding").withColumn("_length", dot("embedding", "embedding")).where("_length > 0 AND _length < double('infinity')").drop("_length")
    n_rows, widest = whole.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    block = block or min(LARGEST_BLOCK, max(BLOCK, n_rows // BLOCKS), max(1, BLOCK_BYTES // (4 * widest)))
    most = max(1, min(PIVOTS, n_rows // block))  # neighbourhoods are at least about a block
    first = whole.orderBy(F.xxhash64("memory_id"), "memory_id").limit(most).toPandas()
    if not len(first):
        return spark.createDataFrame([], kinds)
    size = len(first["embedding"].iloc[0])
    same = first["embedding"][first["embedding"].map(len) == size]
    pivots = _unit(same.iloc[: max(1, PIVOT_BYTES // (8 * size))])
    placed = neighbourhoods(whole, pivots)
    sizes = {r["pivot"]: r for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # a row a pivot
    parts = {k: max(1, -(-r["n"] // block)) for k, r in sizes.items()}
    near = comparable(pivots, {k: r["radius"] for k, r in sizes.items()}, least)
    meets = spark.createDataFrame([(a, b, parts[a], parts[b]) for a, b in near], "pivot int, other int, own_parts long, other_parts long")
    shares = spark.createDataFrame(list(parts.items()), "pivot int, own_parts long")

    def name(pivot: str, part: Column) -> Column:
        return F.shiftleft(F.col(pivot).cast("long") + 1, 32) + part

    own = name("pivot", F.pmod(F.xxhash64("memory_id"), F.col("own_parts"))).alias("own")
    components = vectors.schema["embedding"].dataType.simpleString()
    packed = placed.join(F.broadcast(shares), "pivot").select("memory_id", "embedding", own).groupBy("own").applyInArrow(_packed, "own long, length int, ids array<string>, components binary")
    joined = packed.withColumn("pivot", (F.shiftright("own", 32) - 1).cast("int")).join(F.broadcast(meets), "pivot")
    joined = joined.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_parts") - 1))).withColumn("to", name("other", F.col("part")))
    pairs = joined.select("length", "ids", "components", "own", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"))
    kind = np.float64 if components == "array<double>" else np.float32

    def side(rows: list[dict], length: int, own: int) -> tuple[pa.Array, np.ndarray]:
        mine = [r for r in rows if r["length"] == length and r["own"] == own]
        ids = pa.concat_arrays([r["ids"] for r in mine]) if mine else pa.array([], pa.string())
        x = np.frombuffer(b"".join(r["components"] for r in mine), kind).reshape(-1, length).astype(np.float64)
        return ids, x / np.linalg.norm(x, axis=1, keepdims=True)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            plain = {c: b.column(c).to_pylist() for c in ("length", "own", "i", "j")}
            rows += [{c: v[k] for c, v in plain.items()} | {"ids": b.column("ids")[k].values, "components": b.column("components")[k].as_buffer()} for k in range(b.num_rows)]
        i, j = rows[0]["i"], rows[0]["j"]
        for length in sorted({r["length"] for r in rows}):
            left, x = side(rows, length, i)
            right, y = (left, None) if i == j else side(rows, length, j)
            ids = left if y is None else pa.concat_arrays([left, right])
            repeated = pc.count_distinct(ids).as_py() < len(ids)
            for a, b, sim in passing(x, y, least):
                if repeated:  # a repeated id is no pair
                    differ = pc.fill_null(pc.not_equal(left.take(pa.array(a)), right.take(pa.array(b))), False).to_numpy(zero_copy_only=False)
                    a, b, sim = a[differ], b[differ], sim[differ]
                if len(sim):
                    yield emit(left, right, a, b, sim)

    return pairs.groupBy("i", "j").applyInArrow(product, kinds)
