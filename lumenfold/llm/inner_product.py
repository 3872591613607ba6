"""Exact top-k search by inner product over norm-sorted blocks.

Candidates are range-partitioned by descending length (ties by id, so that copies of one vector spread) into blocks;
queries meet blocks in a grid of (block, query chunk). Inside a cell the vectors go by descending length in tiles:
a tile is skipped for a query if length times length stays below the query's k-th score; in an SVD-rotated space the
first coordinates give a partial sum, and the Cauchy-Schwarz bound of the residuals prunes; survivors get the exact
integer product. The block of the longest vectors is searched first, and its k-th scores decide which further blocks
a query visits at all.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunk_of, finite_vectors, fresh, materialize, matrix, operator, top_rows

BLOCK_ROWS, CHUNK_ROWS, TILE = 8192, 4096, 512
#: Blocks up to which the table of (block, chunks) is broadcast.
SMALL = 10_000
#: Lengths of vectors that are rotated, the most frequent first, and the longest of them; others are searched unrotated, as exactly.
ROTATED, ROTATED_DIM = 16, 2048
OUT = "query_id long, vec_id long, score decimal(38,0)"
DECIMAL = pa.decimal128(38, 0)
#: The largest score that is ranked exactly.
MOST = 10**38 - 1


def _gram(batches):
    """Sum of outer products of each batch run, one row for each (dim, i, j)."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        t = pa.Table.from_batches([b])
        for d in np.unique(t.column("dim").to_numpy()):
            part = t.filter(pa.compute.equal(t.column("dim"), pa.scalar(int(d), t.schema.field("dim").type)))
            x = matrix(part, "v")
            sums[int(d)] = sums.get(int(d), 0) + x.T @ x
    for d, s in sums.items():
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s.ravel())], ["dim", "i", "j", "s"])


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For the ROTATED most frequent dimensions the right singular vectors of all vectors, from their Gram matrix: dim x dim numbers on the driver."""
    often = vectors.filter(F.col("dim") <= ROTATED_DIM).groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").limit(ROTATED).collect()
    rows = vectors.filter(F.col("dim").isin([r["dim"] for r in often])).mapInArrow(_gram, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for d, part in rows.groupby("dim"):
        g = np.zeros((d, d))
        g[part.i, part.j] = part.s
        scale = np.abs(g).max()
        _, v = np.linalg.eigh(g / scale if scale > 0 and np.isfinite(scale) else np.eye(d))
        out[int(d)] = np.ascontiguousarray(v[:, ::-1])
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise integer products; Python integers where doubles might not hold them."""
    if not len(a):
        return np.zeros(0, np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    big = [sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True)]
    out = np.empty(len(big), object)
    out[:] = [max(-MOST, min(MOST, x)) for x in big]
    return out


def _below(score: np.ndarray) -> np.ndarray:
    """Doubles that are not above the scores, as a double may lie above the integer it stands for."""
    return np.nextafter(score.astype(float), -np.inf)


def search_cell(xi: np.ndarray, x: np.ndarray, qi: np.ndarray, q: np.ndarray, floor: np.ndarray, rotation: np.ndarray | None, k: int):
    """The k best of one block for each query of one chunk, as (query position, vector id, score); floor: k-th scores known so far."""
    norm, qn = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    order = np.lexsort((xi, -norm))
    x, xi, norm = x[order], xi[order], norm[order]
    head = max(1, min(x.shape[1], 16))
    xr, qr = (x, q) if rotation is None else (x @ rotation, q @ rotation)
    xt, qt = np.linalg.norm(xr[:, head:], axis=1), np.linalg.norm(qr[:, head:], axis=1)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    least = _below(floor)
    for at in range(0, len(x), TILE):
        to = slice(at, at + TILE)
        slack = 1e-9 * (1 + qn * norm[at])
        live = np.flatnonzero(qn * norm[at] + slack >= least)
        if not len(live):
            break
        bound = qr[live, :head] @ xr[to, :head].T + np.outer(qt[live], xt[to])
        i, j = np.nonzero((bound + slack[live, None] >= least[live, None]) & (xi[None, to] != qi[live, None]))
        i, j = live[i], j + at
        score = np.concatenate([_exact(q[i[s : s + 100_000]], x[j[s : s + 100_000]]) for s in range(0, len(i), 100_000)] or [np.zeros(0, np.int64)])
        keep = (score >= least[i]).astype(bool)
        best = tuple(np.concatenate(z) for z in zip(best, (i[keep], xi[j[keep]], score[keep]), strict=True))
        best = tuple(z[top_rows(best[0], _descending(best[2]), best[1], k)] for z in best)
        n = np.bincount(best[0], minlength=len(q))
        full = np.flatnonzero(n >= k)
        last = np.cumsum(n)[full] - 1
        least[full] = np.maximum(least[full], _below(best[2][last]))
    return best


def _descending(score: np.ndarray) -> np.ndarray:
    """Keys that sort the scores from the highest down."""
    return ~score if score.dtype != object else -np.unique(score, return_inverse=True)[1]


@operator
def top_k_inner_product(df: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the Column is_query picks its k best other rows.

    Components become floor(scale * x), the score is the integer inner product, ties go to the smaller id. Exact.
    Defined cases: rows with a null id, null or empty vector, or null or non-finite components take no part; vectors of
    different lengths are not compared; repeated rows with one id count once each as candidates, but a query's own id
    is never its candidate, and of a query's several vectors the smallest is asked for; ranks go by exact scores of up
    to 38 digits, and a score that a long cannot hold is null; fewer than k candidates give fewer rows.
    """
    spark = df.sparkSession
    vectors = finite_vectors(df, id_col, vector_col)
    counts = vectors.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = finite_vectors(df.filter(F.coalesce(is_query, F.lit(False))), id_col, vector_col)
    queries = queries.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    blocks = max(1, -(-counts // BLOCK_ROWS))
    chunks = max(1, -(-queries.count() // CHUNK_ROWS))
    turn = spark.sparkContext.broadcast(rotations(vectors))  # dim x dim numbers for each of at most ROTATED dimensions
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    ranged = vectors.withColumn("length", length).repartitionByRange(blocks, F.col("dim"), F.col("length").desc(), F.col("id"))
    cells = materialize(ranged.withColumn("block", F.spark_partition_id()), "inner-product")
    # one row a block: what a query must reach there
    stats = cells.groupBy("dim", "block").agg(F.max(F.col("length")).alias("top"), F.count(F.lit(1)).alias("n"))
    first = stats.groupBy("dim").agg(F.min("block").alias("first"))
    asked = queries.withColumn("chunk", chunk_of(F.col("id"), chunks)).withColumn("length", length)

    def search(t: pa.Table, u: pa.Table) -> pa.Table:
        if not len(t) or not len(u):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], DECIMAL)})
        x, q = np.floor(scale * matrix(t, "v")), np.floor(scale * matrix(u, "v"))
        xi, qi = t.column("id").to_numpy(), u.column("id").to_numpy()
        least = pa.compute.fill_null(u.column("least").cast(pa.float64()), -np.inf).to_numpy()
        i, j, s = search_cell(xi, x, qi, q, least, turn.value.get(x.shape[1]), k)
        return pa.table({"query_id": qi[i], "vec_id": j, "score": pa.array([Decimal(int(v)) for v in s], DECIMAL)})

    def meet(blocks_of: DataFrame, asking: DataFrame) -> DataFrame:
        """Blocks go to the chunks that have a query for them, and to no others."""
        asking = asking.select("dim", "block", "chunk", "id", "v", "least")
        chunks_of = asking.groupBy("dim", "block").agg(F.collect_set("chunk").alias("chunks"))
        left = blocks_of.join(F.broadcast(chunks_of) if blocks <= SMALL else chunks_of, ["dim", "block"]).select("dim", "block", "id", "v", F.explode("chunks").alias("chunk"))
        return fresh(left).groupBy("dim", "block", "chunk").cogroup(fresh(asking).groupBy("dim", "block", "chunk")).applyInArrow(search, OUT)

    longest = cells.join(first.withColumnRenamed("first", "block"), ["dim", "block"], "left_semi")
    seed = materialize(meet(longest, asked.join(first.withColumnRenamed("first", "block"), "dim").withColumn("least", F.lit(None).cast("decimal(38,0)"))), "inner-product-seed")
    if blocks == 1:
        found = seed
    else:
        kth = seed.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"), F.min("score").alias("kth"))
        bounds = stats.join(first, "dim").filter(F.col("block") > F.col("first")).groupBy("dim").agg(F.collect_list(F.struct("block", "top")).alias("blocks"))
        limited = asked.join(kth, asked["id"] == kth["query_id"], "left").withColumn("least", F.when(F.col("have") >= k, F.col("kth")))
        # floor() moves a vector of length l by at most sqrt(dim); lengths are in units of 1 / scale here
        reach = lambda n: n * F.lit(scale) + F.sqrt(F.col("dim").cast("double"))
        visits = limited.join(bounds, "dim").withColumn("blocks", F.filter("blocks", lambda b: reach(b["top"]) * reach(F.col("length")) * F.lit(1 + 1e-9) >= F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))))
        rest = visits.select("dim", F.explode(F.col("blocks.block")).alias("block"), "chunk", "id", "v", "least")
        others = cells.join(first, "dim").filter(F.col("block") > F.col("first"))
        found = seed.unionByName(meet(others, rest))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))
