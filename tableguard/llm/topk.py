"""Exact top-k inner products of a query set against all vectors.

Components become ``floor(256 * x)``. Vectors are ordered by descending length, packed into blocks of
bounded bytes, and processed in bands of blocks: the longest block, the next four, the next sixteen,
and so on. After each band every query's floor is raised to its k-th best score so far, and the
queries are packed anew by reach, the least length that can still beat their floor. A block of
vectors is sent only to the query blocks whose reach is not above its greatest length; once the
next band is shorter than every reach, the search is over. Inside a pair of blocks, queries are
skipped by length and single pairs by Cauchy-Schwarz: the inner product over the first directions of
a singular value decomposition, plus the product of the residual lengths. What is left is scored
exactly. The decomposition comes from the longest block; it changes what is skipped, never the result.

Vectors that are null, or hold a null or non-finite component, and rows without id take no part.
Missing components count as 0 where vectors differ in length. A row is no candidate of its own, and
every other row is one, also where ids repeat; each row of a repeated query id is a query and gives
its own ranks. Scores beyond 64 bits are ordered exactly and shown at the ends of the range. Ties go
to the smaller id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tableguard.llm.batches import arrow_schema, map_arrow, map_batches
from tableguard.session import cut_lineage

#: Bytes of a packed block of vectors and of queries.
BLOCK_BYTES = 2 << 20
#: Directions of the partial sums.
DIRECTIONS = 16
#: Most bytes of query blocks that are broadcast; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Integers up to here are exact in double precision.
EXACT = float(1 << 53)
#: A band has this many times the blocks of the one before.
GROWTH = 4
#: Most steps of reach that query blocks are told apart by when blocks are sent to them.
STEPS = 256
#: Ends of 64-bit integers.
LOW, HIGH = -(1 << 63), (1 << 63) - 1

_LONG, _BYTES = T.LongType(), T.BinaryType()
_VECTORS = T.StructType([T.StructField("id", _LONG), T.StructField("query", T.BooleanType()), T.StructField("norm", T.DoubleType()), T.StructField("dim", T.IntegerType()), T.StructField("vec", _BYTES)])
#: Rows and ids of a block's vectors, the vectors, and the greatest length (of queries the least reach and the floors).
_BLOCKS = T.StructType([*(T.StructField(n, _BYTES) for n in ("rows", "ids", "vecs")), T.StructField("n", T.IntegerType()), T.StructField("longest", T.DoubleType())])
_ASKED = T.StructType([*_BLOCKS.fields[:4], T.StructField("reach", T.DoubleType()), T.StructField("floors", _BYTES)])
_FOUND = T.StructType([T.StructField("row", _LONG), T.StructField("query_id", _LONG), T.StructField("vec_id", _LONG), T.StructField("score", _LONG), T.StructField("excess", T.StringType())])


def whole_vectors(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, query, norm, dim and packed whole-number components of every vector that takes part."""
    asked = F.coalesce(is_query, F.lit(False)).alias("query")
    narrow = table.select(table[id_col].cast("long").alias("id"), asked, table[vector_col].cast("array<double>").alias("v")).where("id is not null and v is not null")

    def part(batch: pa.RecordBatch) -> dict:
        lists = batch.column("v")
        flat = lists.flatten()
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.floor(256.0 * values)
        bad = np.append(0, np.cumsum(~np.isfinite(whole)))
        good = np.flatnonzero(bad[at[1:]] == bad[at[:-1]])
        vecs = [whole[at[i] : at[i + 1]] for i in good.tolist()]
        with np.errstate(over="ignore"):
            norms = [float(np.sqrt(v @ v)) for v in vecs]
        return {
            "id": batch.column("id").take(pa.array(good)), "query": batch.column("query").take(pa.array(good)), "norm": norms,
            "dim": [len(v) for v in vecs], "vec": [v.astype("<f8").tobytes() for v in vecs],
        }

    return map_batches(narrow, part, _VECTORS)


def _packed(vectors: DataFrame, dim: int, schema: T.StructType) -> DataFrame:
    """Blocks of the rows of each partition, in their order.

    Vectors have ``norm``; queries have ``reach`` and ``floor`` instead.
    """
    arrow = arrow_schema(schema)
    most = _block_rows(dim)
    asked = "reach" in schema.names
    names = ["row", "id", "vec", *(["reach", "floor"] if asked else ["norm"])]

    def block(rows: list) -> pa.RecordBatch:
        matrix = np.zeros((len(rows), dim))
        for k, (_, _, vec, *_) in enumerate(rows):
            matrix[k, : len(vec) // 8] = np.frombuffer(vec, "<f8")
        number, ids, _, size, *floor = zip(*rows, strict=True)
        values = [np.array(number, np.int64).tobytes(), np.array(ids, np.int64).tobytes(), matrix.tobytes(), len(rows), min(size) if asked else max(size)]
        values += [np.array(f, np.float64).tobytes() for f in floor]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if len(rows) == most:
                    yield block(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield block(rows)

    return map_arrow(vectors.select(*names), run, schema)


def _block_rows(dim: int) -> int:
    return max(1, BLOCK_BYTES // (8 * max(dim, 1)))


class Block:
    """A block unpacked, with its partial coordinates and residual lengths."""

    def __init__(self, rows: bytes, ids: bytes, vecs: bytes, n: int, turn: np.ndarray) -> None:
        self.rows, self.ids = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64)
        self.vecs = np.frombuffer(vecs, np.float64).reshape(n, -1)
        with np.errstate(over="ignore", invalid="ignore"):
            self.part = self.vecs @ turn
            self.norm = np.sqrt(np.einsum("ij,ij->i", self.vecs, self.vecs))
            self.rest = np.sqrt(np.maximum(self.norm**2 - np.einsum("ij,ij->i", self.part, self.part), 0))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products of all rows: 64-bit integers, or numbers without bound."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= EXACT:
        whole = [[int(x) for x in r] for r in b]
        out = np.empty((len(a), len(b)), object)
        for k, q in enumerate(a):
            asked = [int(x) for x in q]
            out[k] = [sum(x * y for x, y in zip(asked, r, strict=True)) for r in whole]
        return out
    return (a @ b.T).astype(np.int64)


def _excess(score: int) -> str:
    """How far a score lies beyond 64 bits, as a text that sorts like the number."""
    if score > HIGH:
        beyond = str(score - HIGH)
        return f"2{len(beyond):06d}{beyond}"
    if score < LOW:
        beyond = str(LOW - score).translate(str.maketrans("0123456789", "9876543210"))
        return f"0{999999 - len(beyond):06d}{beyond}"
    return "1"


def best_of(queries: Block, vectors: Block, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, exact score) of the k best candidates of each query in one block of vectors.

    Candidates that cannot reach a query's floor may be missing.
    """
    with np.errstate(over="ignore", invalid="ignore"):  # what overflows is not skipped
        slack = 1e-6 * queries.norm * vectors.norm.max(initial=0) + 1
        rows = np.flatnonzero(~(queries.norm * vectors.norm.max(initial=0) + slack < floors))
        bound = queries.part[rows] @ vectors.part.T + np.outer(queries.rest[rows], vectors.rest)
        able = ~(bound + slack[rows, None] < floors[rows, None])
    able &= queries.rows[rows, None] != vectors.rows[None, :]
    keep_q, keep_v = able.any(axis=1), able.any(axis=0)
    rows, able = rows[keep_q], able[keep_q][:, keep_v]
    by_id = np.argsort(vectors.ids[keep_v], kind="stable")
    ids, able = vectors.ids[keep_v][by_id], able[:, by_id]
    scores = _exact(queries.vecs[rows], vectors.vecs[keep_v][by_id])
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = _first(scores, able, k)
    won = np.take_along_axis(able, order, axis=1)
    place = np.broadcast_to(rows[:, None], order.shape)[won]
    return place, ids[order][won], np.take_along_axis(scores, order, axis=1)[won]


def _first(scores: np.ndarray, able: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest scores of each row, of equal ones the first; unable ones last."""
    n = scores.shape[1]
    if scores.dtype == object:
        return np.array([sorted(range(n), key=lambda j: (not able[i, j], -row[j], j))[:k] for i, row in enumerate(scores)])
    if np.abs(scores.astype(np.float64)).max() < (1 << 60) // n:  # score and column fit one number
        mixed = np.where(able, scores * n + np.arange(n)[::-1], np.iinfo(np.int64).min)
        some = np.argpartition(mixed, max(n - k, 0), axis=1)[:, max(n - k, 0) :]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(mixed, some, axis=1), axis=1)[:, ::-1], axis=1)
    return np.lexsort((np.broadcast_to(np.arange(n), scores.shape), ~scores, ~able), axis=1)[:, :k]


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with ``band``; their partitions are ranges of descending length, and so are the blocks in each.

    What the driver holds is one number per partition.
    """
    stored = cut_lineage(blocks.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = dict(stored.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = [0] * (max(counts, default=0) + 1), 0
    for p in range(len(before)):
        before[p], total = total, total + counts.get(p, 0)
    number = F.get(F.array(*[F.lit(x) for x in before]), part.cast("int")) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # Blocks before band j: 1 + GROWTH + .. = (GROWTH^j - 1) / (GROWTH - 1).
    firsts, size = [1], GROWTH
    while firsts[-1] < total:
        firsts, size = [*firsts, firsts[-1] + size], size * GROWTH
    band = F.size(F.filter(F.array(*[F.lit(x) for x in firsts]), lambda x: x <= number))
    return stored.select(*_BLOCKS.names, band.alias("band"))


def _with_floors(queries: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
    """Queries with their floors and reaches.

    The slack covers what double precision loses; a query of length 0 scores 0 with all, so only ids decide.
    """
    if best is None:
        return queries.select("row", "id", "vec", F.lit(float("-inf")).alias("floor"), F.lit(-1.0).alias("reach"))
    floors = best.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    safe = (F.col("norm") > 0) & (F.col("norm") < 1e300) & F.col("floor").isNotNull()
    reach = F.when(safe, F.greatest(F.lit(-1.0), (F.col("floor") - 1) / (F.col("norm") * (1 + 1e-6)))).otherwise(-1.0)
    return queries.join(floors, "row", "left").select("row", "id", "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), reach.alias("reach"))


def _meetings(blocks: DataFrame, asked: DataFrame, steps: list[float], size: int) -> DataFrame:
    """Each block of vectors with the query blocks whose reach is not above its greatest length.

    ``steps`` cut the reaches; a block goes to the steps it can reach, and the join tells the rest.
    """
    cuts = F.array(*[F.lit(x) for x in steps]).cast("array<double>")
    step_of = lambda c: F.size(F.filter(cuts, lambda x: x <= F.col(c)))
    side = asked.select(step_of("reach").alias("step"), *(F.col(c).alias(f"q_{c}") for c in asked.columns))
    spread = blocks.withColumn("step", F.explode(F.sequence(F.lit(0), step_of("longest"))))
    return spread.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, "step").where(F.col("q_reach") <= F.col("longest"))


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("excess").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query."""
    spark = table.sparkSession
    vectors = cut_lineage(whole_vectors(table, is_query, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    dim, asking = vectors.agg(F.max("dim"), F.count_if("query")).first()
    dim = dim or 0
    order = [F.col("norm").desc(), F.col("row")]
    blocks = _numbered(_packed(vectors.repartitionByRange(*order).sortWithinPartitions(*order), dim, _BLOCKS))
    bands = {r["band"]: r["longest"] for r in blocks.groupBy("band").agg(F.max("longest").alias("longest")).collect()}
    queries = vectors.where("query")
    groups = min(-(-asking // _block_rows(dim)) or 1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    head = blocks.where("band = 0").first()
    turn = np.zeros((dim, 0))
    if head is not None and dim:
        turn = np.linalg.svd(np.frombuffer(head["vecs"], np.float64).reshape(head["n"], -1), full_matrices=False)[2][:DIRECTIONS].T
    shared = spark.sparkContext.broadcast(turn)

    def search(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in _FOUND.names}
        for row in batch.to_pylist():
            q, v = (Block(*(row[f"{p}{c}"] for c in ("rows", "ids", "vecs", "n")), shared.value) for p in ("q_", ""))
            place, ids, scores = best_of(q, v, np.frombuffer(row["q_floors"], np.float64), k)
            exact = scores.tolist()
            out["row"] += q.rows[place].tolist()
            out["query_id"] += q.ids[place].tolist()
            out["vec_id"] += ids.tolist()
            out["score"] += [min(max(x, LOW), HIGH) for x in exact]
            out["excess"] += [_excess(x) for x in exact]
        return out

    best: DataFrame | None = None
    for band in sorted(bands):
        ordered = _with_floors(queries, best, k).repartitionByRange(groups, "reach", "row").sortWithinPartitions("reach", "row")
        asked = cut_lineage(_packed(ordered, dim, _ASKED))
        size = F.sum(F.octet_length("vecs") + F.octet_length("ids") + F.octet_length("rows") + F.octet_length("floors"))
        least, size, steps = asked.agg(F.min("reach"), size, F.percentile_approx("reach", [i / STEPS for i in range(1, STEPS)])).first()
        if least is None or bands[band] < least:
            break  # nothing to ask, or no vector from here on is long enough
        met = _meetings(blocks.where(F.col("band") == band), asked, sorted(set(steps)), size)
        found = map_batches(met, search, _FOUND)
        best = cut_lineage(_best(found if best is None else best.drop("rank").unionByName(found), k))
    if best is None:
        best = spark.createDataFrame([], T.StructType([*_FOUND.fields, T.StructField("rank", T.IntegerType())]))
    return best.select("query_id", "rank", "vec_id", "score")
