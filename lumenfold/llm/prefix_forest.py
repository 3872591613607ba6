"""Approximate nearest neighbours with a hash-prefix forest (LSH Forest: Bawa, Condie and Ganesan, 2005).

Every tree gives each vector a string of SYMBOLS symbols: the vertex of a cross-polytope that a random rotation of the
centred vector points to (Andoni et al., 2015), one rotation for each symbol. A tree is a sorted array of these strings in
runs: strings that share their first symbols, as many symbols as keep a run small, and a large run in parts. A query
descends in its run to its longest matching prefix by binary search; then the trees ascend in step, each by one symbol in
its turn, beyond the run where needed, until together they hold enough candidates. So the ascent may stop between two
symbols, with some trees a symbol above the others. How many candidates are enough is calibrated: the true neighbours of
a sample of queries are searched among all vectors, each says how many candidates the ascent must hold to meet it, and
the number that serves the wanted share of them is taken. Only the blocks of vectors that hold candidates of a query are
asked for exact distances.

The strings carry no vectors, so the forest costs 16 bytes a tree and row, and the work grows with the candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunk_of, finite_vectors, fresh, materialize, matrix, operator, top_rows

TREES = 40
#: Symbols of a string, bits of a symbol: a sign and one of 64 axes.
SYMBOLS, BITS = 9, 7
#: Queries whose true neighbours are searched, and the share of these that the ascent must find.
CALIBRATED, RECALL = 64, 0.93
#: Rows of a run or of a part of one, vectors of a block, queries that one task takes for a block.
RUN_ROWS, BLOCK_ROWS, CHUNK_ROWS = 1 << 16, 16384, 4096
#: Rows hashed at a time; lengths of vectors that are centred (of others the hashes are less even, no more).
HASHED, CENTRED = 4096, 64
_SHIFT = BITS * SYMBOLS


class Forest:
    """The hash functions of the trees for vectors of one length."""

    def __init__(self, dim: int, trees: int, seed: int):
        axes, r = 1 << (BITS - 1), np.random.default_rng([seed, dim])
        # orthogonal axes, as many as the vectors have room for
        normals = lambda: np.concatenate([np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(-(-axes // dim))], axis=1)[:, :axes]
        self.planes = np.stack([np.concatenate([normals() for _ in range(SYMBOLS)], axis=1) for _ in range(trees)]).astype(np.float32)

    def hash(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows) strings, first symbol highest."""
        scale = np.abs(x).max(axis=1, keepdims=True)
        x = (x / np.where(scale > 0, scale, 1)).astype(np.float32)
        out = np.zeros((len(self.planes), len(x)), np.int64)
        shifts = np.arange(SYMBOLS - 1, -1, -1) * BITS
        for tree, planes in zip(out, self.planes, strict=True):
            p = (x @ planes).reshape(len(x), SYMBOLS, -1)
            axis = np.abs(p).argmax(axis=2)
            side = np.take_along_axis(p, axis[:, :, None], 2)[:, :, 0] > 0
            tree[:] = ((axis << 1 | side).astype(np.int64) << shifts).sum(axis=1)
        return out


def _strings(trees: int, seed: int, centres):
    def run(batches):
        forests: dict[int, Forest] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            dims = t.column("dim").to_numpy()
            for d in np.unique(dims):
                own = t.filter(pa.array(dims == d))
                forest = forests.get(d) or forests.setdefault(d, Forest(int(d), trees, seed)) if len(forests) < 4 else Forest(int(d), trees, seed)
                for at in range(0, len(own), HASHED):
                    part = own.slice(at, HASHED)
                    h = forest.hash(matrix(part, "v") - centres.value.get(int(d), 0.0))
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(h.size, d, np.int32)), pa.array(np.repeat(np.arange(trees, dtype=np.int32), n)), pa.array(h.ravel()), pa.array(np.tile(part.column("node").to_numpy(), trees))], ["dim", "tree", "h", "node"])

    return run


def centres_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each of the CENTRED most frequent lengths: so many vectors at most come to the driver."""
    lengths = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").limit(CENTRED).collect()

    def sums(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            dims = t.column("dim").to_numpy()
            for d in np.unique(dims):
                found[int(d)] = found.get(int(d), 0.0) + matrix(t.filter(pa.array(dims == d)), "v").sum(axis=0)
        for d, s in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(s)], ["dim", "i", "s"])

    counts = {r["dim"]: r["n"] for r in lengths}
    rows = vectors.filter(F.col("dim").isin(list(counts))).mapInArrow(sums, "dim int, i int, s double").groupBy("dim", "i").agg(F.sum("s").alias("s")).orderBy("dim", "i").toPandas()
    found = {int(d): part["s"].to_numpy() / counts[int(d)] for d, part in rows.groupby("dim")}
    return {d: c for d, c in found.items() if np.isfinite(c).all()}


def bounds(keys: np.ndarray, h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that share their first level symbols with each h begin and end in the sorted array keys."""
    rest = _SHIFT - BITS * level
    low = h >> rest << rest
    return np.searchsorted(keys, low, "left"), np.searchsorted(keys, low + ((1 << rest) - 1), "right")


def _count(base: int):
    def run(strings: pa.Table, asked: pa.Table) -> pa.Table:
        """How many strings of a run share the first symbols with each query, for each number of symbols, where any do."""
        keys, h, q, tree = np.sort(strings.column("h").to_numpy()), *(asked.column(x).to_numpy() for x in ("h", "query", "tree"))
        out = [np.zeros((4, 0), np.int64)]
        for level in range(max(1, base), SYMBOLS + 1):
            low, high = bounds(keys, h, level)
            some = high > low
            h, q, tree = h[some], q[some], tree[some]
            out.append(np.stack([q, tree, np.full(len(q), level), (high - low)[some]]))
        query, tree, level, n = np.concatenate(out, axis=1)
        return pa.table({"query": query, "tree": tree.astype(np.int32), "level": level.astype(np.int32), "n": n})

    return run


def _candidates(strings: pa.Table, asked: pa.Table) -> pa.Table:
    """The nodes of a run that share as many symbols with each query as its level says, by block."""
    order = np.argsort(strings.column("h").to_numpy(), kind="stable")
    keys, nodes, block = (strings.column(x).to_numpy()[order] for x in ("h", "node", "block"))
    out = {"block": [], "query": [], "nodes": []}
    h, levels = asked.column("h").to_numpy(), asked.column("level").to_numpy()
    low, high = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    for level in np.unique(levels):
        own = levels == level
        low[own], high[own] = bounds(keys, h[own], int(level))
    for q, i, j in zip(asked.column("query").to_pylist(), low, high, strict=True):
        by = np.argsort(block[i:j], kind="stable")
        of, found = block[i:j][by], nodes[i:j][by]
        if not len(of):
            continue
        cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for a, z in zip(cut, np.r_[cut[1:], len(of)], strict=True):
            out["block"].append(int(of[a]))
            out["query"].append(q)
            out["nodes"].append(found[a:z].tobytes())
    return pa.table({"block": pa.array(out["block"], pa.int32()), "query": pa.array(out["query"], pa.int64()), "nodes": pa.array(out["nodes"], pa.binary())})


def _true_nearest(asked, k: int):
    def run(batches):
        """The nodes of a batch nearest to each asked vector, none at distance 0, which every tree finds."""
        for b in batches:
            t = pa.Table.from_batches([b])
            dims, node = t.column("dim").to_numpy(), t.column("node").to_numpy()
            out = {"query": [], "node": [], "score": []}
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = matrix(t.take(pa.array(own)), "v")
                for q, v in asked.value:
                    if len(v) != d:
                        continue
                    s = np.sqrt(((x - v) ** 2).sum(axis=1))
                    s = np.where(s > 0, s, np.inf)
                    best = np.argpartition(s, k - 1)[:k] if len(s) > k else np.arange(len(s))
                    best = best[np.isfinite(s[best])]
                    out["query"] += [q] * len(best)
                    out["node"] += node[own][best].tolist()
                    out["score"] += s[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out["query"], pa.int64()), pa.array(out["node"], pa.int64()), pa.array(out["score"], pa.float64())], ["query", "node", "score"])

    return run


def calibrate(needs: list[int], least: int, recall: float) -> tuple[int, float]:
    """The number of candidates that serves the wanted share of neighbours, each of which needs so many, and its share."""
    if not needs:
        return least, 1.0
    want = max(least, sorted(needs)[max(0, math.ceil(recall * len(needs)) - 1)])
    return want, sum(x <= want for x in needs) / len(needs)


def _nearest(k: int):
    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        """The nodes of a block with the k smallest distances to each query, and all as near as the last, by id."""
        empty = {"query": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "score": np.zeros(0)}
        found = [empty]
        if len(vectors) and len(asked):
            dims, node = vectors.column("dim").to_numpy(), vectors.column("node").to_numpy()
            of_dim = {}
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                own = own[np.argsort(node[own])]
                of_dim[d] = node[own], matrix(vectors.take(pa.array(own)), "v")
            for q, d, v, lists in zip(*(asked.column(x).to_pylist() for x in ("query", "dim", "v", "lists")), strict=True):
                if d not in of_dim:
                    continue
                names, x = of_dim[d]
                if lists:
                    at = np.searchsorted(names, np.unique(np.frombuffer(b"".join(lists), np.int64)))
                    names, x = names[at], x[at]
                s = np.sqrt(((x - np.array(v, float)) ** 2).sum(axis=1))
                keep = np.flatnonzero(s <= np.partition(s, k - 1)[k - 1]) if len(s) > k else np.arange(len(s))
                found.append({"query": np.full(len(keep), q, np.int64), "node": names[keep], "score": s[keep]})
        return pa.table({x: np.concatenate([f[x] for f in found]) for x in empty})

    return run


@operator
def nearest_neighbours(df: DataFrame, is_query, k: int = 10, trees: int = TREES, candidates: int | None = None, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, sample: int = CALIBRATED) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the Column is_query picks the k nearest other rows found.

    score: Euclidean distance in double precision; ties to the smaller id. The ascent stops at as many candidates,
    counted in all trees, as find the share recall of the true neighbours of sample queries; with candidates it stops at
    candidates * (k + 1) and nothing is calibrated. k + 1 different vectors are held in any case; a query that the
    trees never give so many is held against all rows. The returned frame's calibration holds the number and the share.
    Equal vectors are one node with its k + 1 smallest ids and do not crowd out other candidates. Defined cases:
    rows with a null id, null, empty or zero vector, or null or non-finite components take no part; vectors of different
    lengths are not compared; a query's own id is never its candidate; of rows with one id and one vector one counts, of
    an id's several vectors the nearest, and of a query's several vectors the smallest is asked for; fewer than k
    candidates give fewer rows.
    """
    spark = df.sparkSession
    some = F.exists("v", lambda x: x != 0)
    wanted = finite_vectors(df, id_col, vector_col).filter(some)
    members = wanted.select("v", "dim", "id").distinct()
    members = members.withColumn("turn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("turn") <= k + 1)
    members = materialize(members.withColumn("node", F.monotonically_increasing_id()), "forest-members")
    # equal vectors: the node of the first of their ids
    firsts = members.filter("turn = 1").select("node", "v", "dim")
    n = firsts.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ids = materialize(members.filter("turn = 1").select("v", "node").hint("merge").join(members.select("v", "id"), "v").select("node", "id"), "forest-ids")
    queries = finite_vectors(df.filter(F.coalesce(is_query, F.lit(False))), id_col, vector_col).filter(some)
    queries = materialize(queries.groupBy("id").agg(F.min("v").alias("v")).select(F.col("id").alias("query"), "v", F.size("v").alias("dim")), "forest-queries")
    blocks, base = -(-n // BLOCK_ROWS), 0
    while n >> (BITS * base) > RUN_ROWS:
        base += 1
    centres = spark.sparkContext.broadcast(centres_of(firsts))
    block = chunk_of(F.col("node"), blocks).alias("block")
    run = F.shiftright("h", _SHIFT - BITS * base) if base else F.lit(0).cast("long")
    schema = "dim int, tree int, h long, node long"
    strings = materialize(firsts.select("dim", "node", "v").mapInArrow(_strings(trees, seed, centres), schema).withColumn("run", run), "forest-strings")
    asked = queries.select("dim", F.col("query").alias("node"), "v").mapInArrow(_strings(trees, seed, centres), schema).withColumn("run", run).withColumnRenamed("node", "query")
    asked = materialize(asked, "forest-asked")
    keys = ["dim", "tree", "run"]
    sizes = materialize(strings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "forest-runs")
    large = sizes.filter(F.col("n") > RUN_ROWS).select(*keys, F.ceil(F.col("n") / F.lit(RUN_ROWS)).cast("int").alias("parts"))
    parted = strings.join(large, keys, "left").select(*keys, "h", "node", block, F.pmod(F.xxhash64("node", F.lit(5)), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    every_part = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    by = [*keys, "part"]
    counted = fresh(parted).groupBy(*by).cogroup(fresh(asked.join(large, keys, "left").select(*keys, "h", "query", every_part)).groupBy(*by)).applyInArrow(_count(base), "query long, tree int, level int, n long")
    if base > 1:
        # beyond the run: the sizes of all runs that share fewer symbols
        level = F.explode(F.sequence(F.lit(1), F.lit(base - 1))).alias("level")
        prefix = F.expr(f"shiftright(run, {BITS} * ({base} - level))").alias("prefix")
        wide = sizes.select("dim", "tree", "run", "n", level).groupBy("dim", "tree", "level", prefix).agg(F.sum("n").alias("n"))
        shorter = asked.select("dim", "tree", "run", "query", level).select("dim", "tree", "level", prefix, "query")
        counted = counted.unionByName(shorter.join(wide, ["dim", "tree", "level", "prefix"]).select("query", "tree", "level", "n"))
    # steps of the ascent: level by level upwards, in each the trees in turn; a tree's step adds what the symbol less adds
    counts = counted.groupBy("query", "tree", "level").agg(F.sum("n").alias("n"))
    more = F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("query", "tree").orderBy(F.col("level").desc())), F.lit(0))
    step = ((SYMBOLS - F.col("level")) * trees + F.col("tree")).alias("step")
    steps = counts.select("query", step, more.alias("more")).select("query", "step", F.sum("more").over(Window.partitionBy("query").orderBy("step")).alias("held"))
    steps = materialize(steps, "forest-steps")
    least, share = (k + 1) * trees, None
    want = max(least, (candidates or 0) * (k + 1))
    if candidates is None:
        # so many queries, and a number for each of their true neighbours, come to the driver
        chosen = queries.orderBy(F.xxhash64("query", F.lit(8)), "query").limit(sample).collect()
        vectors = spark.sparkContext.broadcast([(r["query"], np.array(r["v"], float)) for r in chosen])
        near = firsts.mapInArrow(_true_nearest(vectors, k), "query long, node long, score double")
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "node"))).filter(F.col("r") <= k).select("query", "node")
        near = materialize(near, "forest-true")
        # a neighbour is met at the first step of any tree whose string shares as many symbols
        differ = F.col("h").bitwiseXOR(F.col("hq"))
        same = F.when(differ == 0, SYMBOLS).otherwise(F.floor((_SHIFT - F.length(F.bin(differ))) / BITS))
        met = strings.select("tree", "h", "node").join(F.broadcast(near), "node").join(asked.select("tree", "query", F.col("h").alias("hq")), ["tree", "query"])
        met = met.groupBy("query", "node").agg(F.min((SYMBOLS - same) * trees + F.col("tree")).alias("at"))
        need = F.coalesce(F.max(F.when(F.col("step") < F.col("at"), F.col("held"))), F.lit(0)) + 1
        needs = met.join(steps, "query", "left").groupBy("query", "node").agg(need.alias("need")).collect()
        want, share = calibrate([r["need"] for r in needs], least, recall)
    # synchronous ascent: the first step with enough candidates in all trees together; 0 stands for all rows
    stops = steps.filter(F.col("held") >= want).groupBy("query").agg(F.min("step").alias("step"))
    levels = queries.select("query").join(stops, "query", "left").select("query", F.coalesce(SYMBOLS - F.floor(F.col("step") / trees), F.lit(0)).cast("int").alias("level"), (F.col("step") % trees).cast("int").alias("last"))
    levels = materialize(levels, "forest-levels")
    ascending = asked.join(levels.filter("level > 0"), "query").withColumn("level", F.when(F.col("tree") <= F.col("last"), F.col("level")).otherwise(F.col("level") + 1)).filter(F.col("level") <= SYMBOLS)
    if base:
        above = f"{BITS} * greatest(0, {base} - level)"
        first_run = F.expr(f"shiftleft(shiftright(run, {above}), {above})")
        ascending = ascending.withColumn("run", F.explode(F.sequence(first_run, first_run + F.expr(f"shiftleft(1L, {above}) - 1"))))
    met = ascending.join(large, keys, "left").select(*keys, "h", "query", "level", every_part)
    found = fresh(parted).groupBy(*by).cogroup(fresh(met).groupBy(*by)).applyInArrow(_candidates, "block int, query long, nodes binary")
    lists = found.groupBy("block", "query").agg(F.collect_list("nodes").alias("lists"))
    everywhere = levels.filter("level = 0").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "query", F.array().cast("array<binary>").alias("lists"))
    visits = materialize(lists.unionByName(everywhere), "forest-visits")
    loads = materialize(visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK_ROWS)).cast("int").alias("turns")), "forest-loads")
    cells = ["block", "turn"]
    left = firsts.select("node", "v", "dim", block).join(loads, "block").select("node", "v", "dim", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    right = visits.join(loads, "block").join(queries, "query").select("block", F.pmod(F.xxhash64("query", F.lit(6)), F.col("turns")).cast("int").alias("turn"), "query", "dim", "v", "lists")
    near = fresh(left).groupBy(*cells).cogroup(fresh(right).groupBy(*cells)).applyInArrow(_nearest(k + 1), "query long, node long, score double")
    pairs = near.join(ids, "node").filter(F.col("id") != F.col("query")).groupBy("query", "id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query").orderBy("score", "id")
    out = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
    out.calibration = {"candidates": want, "recall": share}
    return out
