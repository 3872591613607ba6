"""Compression of vectors to codes: every part of a vector becomes the index of its nearest codebook entry.

Codebooks are refined by rounds of assignment and integer means. An assignment is exact and works by segment-mean lower
bounds, coarse to fine: with the means m and the residual norms r of equally cut blocks of w components,
|x - c|^2 >= sum over blocks of w * (m_x - m_c)^2 + (r_x - r_c)^2. Entries whose bound, less a margin for rounding, lies
above the distance of a known entry are out; halved blocks tighten the bound for the rest; those left get their exact
integer distance. Codebooks (entries x components numbers) are all that reaches the driver; sums are added up in tasks
first and come as limbs of 48 bits, so they are exact for components of any size.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, matrix, operator

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows assigned at a time.
TILE = 2048
#: Components below this are handled as 64-bit integers, larger ones as Python's.
NARROW = float(1 << 26)
LIMB = 48
CODED = "vec_id long, label {label}, code string, error long"


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as exact integers."""
    y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < NARROW:
        return y.astype(np.int64)
    # beyond 2**53 a double is an integer itself, and its product may leave the doubles
    exact = lambda v: int(v) * int(scale) if abs(v) >= 2.0**53 else math.floor(v * scale)
    return np.array([[exact(float(v)) for v in row] for row in x], object)


def _float(x: np.ndarray) -> np.ndarray:
    """Integers as doubles, infinite where they are beyond those: what is computed from such ones decides nothing."""
    if x.dtype != object:
        return x.astype(float)
    return np.array([float(v) if abs(v) < 1 << 1000 else (math.inf if v > 0 else -math.inf) for v in x.ravel()]).reshape(x.shape)


def _profile(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and residual norms of equally cut blocks of each row, and their numbers of components."""
    pieces = np.array_split(_float(x), blocks, axis=1)
    means = np.stack([p.mean(axis=1) for p in pieces], axis=1)
    rest = np.stack([np.sqrt(((p - p.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)) for p in pieces], axis=1)
    return means, rest, np.array([p.shape[1] for p in pieces], float)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=1)


def nearest_entries(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and exact squared distance of each row's nearest entry, ties to the lower index; and how many distances were computed."""
    if object in (x.dtype, entries.dtype):
        x, entries = x.astype(object), entries.astype(object)
    n, width = x.shape
    index, least, exact = np.zeros(n, np.int64), np.zeros(n, x.dtype), 0
    levels = [1 << i for i in range(max(1, (width - 1).bit_length()))]
    with np.errstate(over="ignore", invalid="ignore"):
        of_entry = {b: _profile(entries, b) for b in levels}
        norm = (_float(entries) ** 2).sum(axis=1)
        for at in range(0, n, TILE):
            part = x[at : at + TILE]
            rows = np.arange(len(part))
            m, r, w = _profile(part, 1)
            cm, cr, _ = of_entry[1]
            bound = w[0] * (m - cm.T) ** 2 + (r - cr.T) ** 2
            guess = np.where(np.isnan(bound), np.inf, bound).argmin(axis=1)
            known = _float(_distance(part, entries[guess]))
            # relative to the squares that a bound is made of; a bound that is no number keeps its entry
            margin = 1e-9 * ((_float(part) ** 2).sum(axis=1)[:, None] + norm + 1)
            i, j = np.nonzero(~(bound - margin > known[:, None]))
            for blocks in levels[1:]:
                (m, r, w), (cm, cr, _) = _profile(part, blocks), of_entry[blocks]
                finer = (w * (m[i] - cm[j]) ** 2 + (r[i] - cr[j]) ** 2).sum(axis=1)
                keep = ~(finer - margin[i, j] > known[i])
                i, j = i[keep], j[keep]
            d = _distance(part[i], entries[j])
            exact += len(i) + len(part)
            starts = np.searchsorted(i, rows)
            best = np.minimum.reduceat(d, starts)
            first = np.minimum.reduceat(np.where(d == best[i], j, len(entries)), starts)
            index[at : at + TILE], least[at : at + TILE] = first, best
    return index, least, exact


def _limbs(v: int) -> list[int]:
    """v as 48-bit limbs, lowest first, the last with the sign."""
    out = []
    while not -(1 << (LIMB - 1)) <= v < 1 << (LIMB - 1):
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v]


def _sums(books, scale: float):
    def run(batches):
        """Sums and counts of the parts of each entry over a task's rows."""
        book = books.value
        sums = np.zeros(book.shape, object)
        counts = np.zeros(book.shape[:2], np.int64)
        for b in batches:
            x = whole(matrix(pa.Table.from_batches([b]), "v"), scale)
            for part, piece in enumerate(np.split(x, len(book), axis=1) if len(x) else []):
                index, _, _ = nearest_entries(piece, book[part])
                own = np.zeros(book.shape[1:], piece.dtype)
                np.add.at(own, index, piece)
                sums[part] += own
                counts[part] += np.bincount(index, minlength=book.shape[1])
        out = [(part, entry, -1, 0, int(counts[part, entry])) for part, entry in zip(*np.nonzero(counts), strict=True)]
        for part, entry in zip(*np.nonzero(counts), strict=True):
            out += [(part, entry, pos, limb, v) for pos, s in enumerate(sums[part, entry]) for limb, v in enumerate(_limbs(int(s)))]
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()], strict=True)], ["part", "entry", "pos", "limb", "s"])

    return run


def _codes(books, scale: float):
    def run(batches):
        book = books.value
        for b in batches:
            t = pa.Table.from_batches([b])
            x = whole(matrix(t, "v"), scale)
            codes, error = [[] for _ in range(len(t))], np.zeros(len(t), object)
            for part, piece in enumerate(np.split(x, len(book), axis=1) if len(x) else []):
                index, least, _ = nearest_entries(piece, book[part])
                error += least
                for code, i in zip(codes, index, strict=True):
                    code.append(f"{i:02x}")
            errors = pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([t.column("vec_id").combine_chunks(), t.column("label").combine_chunks(), pa.array(["".join(c) for c in codes], pa.string()), errors], ["vec_id", "label", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


@operator
def block_codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row with a vector of finite components.

    Components become floor(scale * x). The codebook of each part position starts as that part of the first entries
    vectors by id (then by vector; a null id last); each round assigns every part and replaces entries by the floors of
    their parts' means; unused entries stay. code: two hex digits a part; error: summed squared distances; label_error:
    error summed over equal labels, nulls together. entries is 256 at most.
    Defined cases: rows whose vector is null or holds null or non-finite components are dropped; the first vector's
    length counts, if parts divide it, and rows with vectors of another length have null code and error; repeated rows
    count as often as they occur; an error or a label's sum beyond a long is null; fewer rows than entries give a
    smaller codebook; an empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    v = F.col(vector_col)
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = df.schema[label_col].dataType.simpleString()
    kept = df.filter(finite).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.cast("array<double>").alias("v"))
    cut = kept.filter((F.size("v") > 0) & (F.size("v") % parts == 0))
    in_order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    leader = cut.orderBy(*in_order).select(F.size("v").alias("dim")).first()
    dim = leader["dim"] if leader else 0
    cut, odd = kept.filter(F.size("v") == dim), kept.filter(F.size("v") != dim) if dim else kept
    first = cut.orderBy(*in_order).limit(entries).collect() if dim else []
    books = np.stack(np.split(whole(np.array([r["v"] for r in first]), scale), parts, axis=1)) if dim else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if dim else 0):
        shared = spark.sparkContext.broadcast(books)  # entries x components numbers
        partial = cut.select("v").mapInArrow(_sums(shared, scale), "part int, entry int, pos int, limb int, s long")
        found = partial.groupBy("part", "entry", "pos", "limb").agg(F.sum("s").alias("s")).collect()
        counts, sums = {}, {}
        for r in found:
            if r["pos"] < 0:
                counts[r["part"], r["entry"]] = r["s"]
            else:
                at = r["part"], r["entry"], r["pos"]
                sums[at] = sums.get(at, 0) + (r["s"] << (LIMB * r["limb"]))
        moved = books.astype(object)
        for (part, entry, pos), s in sums.items():
            moved[part, entry, pos] = s // counts[part, entry]
        narrow = max((abs(x) for x in moved.ravel()), default=0) < NARROW
        books = moved.astype(np.int64) if narrow else moved
    schema = CODED.format(label=kind)
    coded = cut.mapInArrow(_codes(spark.sparkContext.broadcast(books), scale), schema) if dim else spark.createDataFrame([], schema)
    coded = coded.unionByName(odd.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    coded = materialize(coded, "block-codes")
    # partial sums meet, not rows; a frequent label's rows are many in the join, which the adaptive plan splits
    wide = F.bool_or(F.col("code").isNotNull() & F.col("error").isNull())
    total = F.when(~wide, F.sum(F.col("error").cast("decimal(19,0)")).try_cast("long"))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
