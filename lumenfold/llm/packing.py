"""Mixture-controlled packing of token streams into sequences by deficit round-robin.

Documents are encoded once. Hashes deal them into small blocks; a source's blocks, one after another, are its stream. All
streams are cut into parts of about PART_TOKENS tokens at the targets: a part has of each source, to a token, its target
share, until a source's stream ends and the others go on at their shares of what is left. Only the end of the corpus,
where the streams of the wanted mixture have run out, departs from it. A document is cut where a part ends.

In a part every source has a queue. Windows of WINDOW sequences are filled one after another: each source's deficit grows
by its target share of the window and it sends that many tokens, what a queue cannot send goes to those that are owed
most, and the deficits carry over to the next window. Deficits also carry across parts: a part begins with what each
source is owed after all parts before it, which follows from the targets. The round-robin itself sees counts only.

Sequences are full but in a part's tail, which is cut into powers of two; so there is no padding at all.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import broadcast_spec, codec
from .common import materialize, operator

PART_TOKENS, WINDOW = 1 << 19, 32
#: Blocks of a source's stream for each part, and how many blocks one task adds up in the prefix sums.
BLOCKS, SPAN = 1, 1024
ENCODED_BATCH = 256


def encode_rows(df: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, n, ids (packed) and turn (a number within the task) of every row, each document followed by end_id."""
    spec = broadcast_spec(df.sparkSession, tokenizer)

    def run(batches):
        c = codec(spec.value)
        end, turn = np.array([end_id], c.width).tobytes(), 0
        for b in batches:
            for at in range(0, b.num_rows, ENCODED_BATCH):
                part = b.slice(at, ENCODED_BATCH)
                packed = [x + end for x in c.encode_batch([t or "" for t in part.column(2).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) // c.width.itemsize for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(np.arange(turn, turn + len(packed)))], ["doc_id", "source", "n", "ids", "turn"])
                turn += len(packed)

    named = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))  # null apart from an empty name
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), named.alias("source"), F.col(text_col))
    return rows.mapInArrow(run, "doc_id long, source string, n long, ids binary, turn long")


def round_robin(have: np.ndarray, share: np.ndarray, deficit: np.ndarray, window: int) -> np.ndarray:
    """Tokens that each source sends in each window, as (windows, sources): deficit round-robin until all queues are empty."""
    left, owed, out = have.astype(np.int64).copy(), deficit.astype(float).copy(), []
    while (total := int(left.sum())) > 0:
        size = min(window, total)
        owed += share * size
        take = np.minimum(left, np.floor(np.maximum(owed, 0)).astype(np.int64))
        order = np.lexsort((np.arange(len(left)), -owed))
        if take.sum() > size:  # more is owed than fits: those owed most go first
            take[order] = np.diff(np.r_[0, np.minimum(np.cumsum(take[order]), size)])
        while (gap := size - int(take.sum())) > 0:  # empty queues and fractions: the others share what is left of the window
            open_ = left > take
            part = np.where(open_, np.maximum(share, 1e-12), 0)
            more = np.minimum(left - take, np.floor(part / part.sum() * gap).astype(np.int64))
            if not more.sum():
                most = order[open_[order]][:gap]
                more[most] = 1
            take += more
        owed -= take
        left -= take
        out.append(take)
    return np.array(out, np.int64).reshape(-1, len(have))


def tail_lengths(tokens: int, length: int) -> np.ndarray:
    """Lengths of a part's sequences: full ones, then the powers of two of the remainder, longest first."""
    full, rest = divmod(tokens, length)
    return np.array([length] * full + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1], np.int64)


def _before(counts: DataFrame) -> DataFrame:
    """counts (block, source, have) with the sum of have over all blocks of the source before: spans of blocks first, then within a span."""
    spanned = counts.withColumn("span", F.floor(F.col("block") / SPAN))
    sums = spanned.groupBy("span", "source").agg(F.sum("have").alias("n"))
    sums = sums.select("span", "source", (F.sum("n").over(Window.partitionBy("source").orderBy("span")) - F.col("n")).alias("spans"))
    inside = spanned.withColumn("inside", F.sum("have").over(Window.partitionBy("span", "source").orderBy("block")) - F.col("have"))
    return inside.join(sums, ["span", "source"]).select("block", "source", "have", (F.col("spans") + F.col("inside")).alias("before"))


class Targets:
    """Where the streams of the sources are cut, from the weights and the weighted sources' tokens.

    The clock runs from 0; while it goes on by 1, a weighted source sends its share in tokens until it has none left.
    After all weighted sources the others follow, each at its share of what they have. weights None: each source's share
    is its own part of all tokens, so no clock is needed.
    """

    def __init__(self, total: int, part_tokens: int, weighted: list[tuple[float, int]] | None):
        self.parts, self.total, self.none = max(1, -(-total // part_tokens)), float(max(total, 1)), weighted is None
        weighted = sorted((have / share, share, have) for share, have in weighted or [])
        self.weighted, sent, at, rate = float(sum(x[2] for x in weighted)), 0.0, 0.0, sum(x[1] for x in weighted)
        self.legs = []  # (tokens sent, clock, tokens a tick) from each moment at which a source ends
        for end, share, _ in weighted:
            self.legs.append((sent, at, max(rate, 1e-300)))
            sent, at, rate = sent + (end - at) * rate, end, rate - share
        self.legs = self.legs or [(0.0, 0.0, 1.0)]

    def sent(self, share: Column, have: Column, tokens: Column) -> Column:
        """How many tokens of a source are among the first tokens of all."""
        natural = have * (tokens / self.total)
        if not self.none:
            legs = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(leg, ("sent", "at", "rate"), strict=True))) for leg in self.legs))
            clock = F.aggregate(legs, F.lit(0.0), lambda now, leg: F.when(leg["sent"] <= tokens, leg["at"] + (tokens - leg["sent"]) / leg["rate"]).otherwise(now))
            rest = F.greatest(F.lit(0.0), tokens - F.lit(self.weighted)) / F.lit(max(1.0, self.total - self.weighted))
            natural = F.when(share > 0, F.least(have.cast("double"), share * clock)).otherwise(have * rest)
        return natural

    def cut(self, share: Column, have: Column, part: Column) -> Column:
        """The place in a source's stream at which part begins."""
        inside = F.floor(self.sent(share, have, part * F.lit(self.total / self.parts)))
        return F.when(part >= self.parts, have).when(part <= 0, F.lit(0)).otherwise(F.least(have, inside)).cast("long")

    def part_at(self, share: Column, have: Column, place: Column) -> Column:
        """The part that a place of a source's stream falls into: by halving, as cut() rises with the part."""
        low, high = F.lit(0).cast("long"), F.lit(self.parts).cast("long")
        start = F.struct(low.alias("low"), high.alias("high"))

        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["low"] + s["high"]) / 2)
            return F.when(self.cut(share, have, mid) <= place, F.struct(mid.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid.alias("high")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.parts.bit_length())), start, halve)["low"]


def _schedule(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source")
        sent = round_robin(pdf["have"].to_numpy(), pdf["share"].to_numpy(), pdf["deficit"].to_numpy(), window)
        at = np.r_[0, np.cumsum(sent.ravel())[:-1]].reshape(sent.shape)
        start = np.cumsum(sent, axis=0) - sent
        keep = [np.flatnonzero(sent[:, i]) for i in range(sent.shape[1])]
        return pd.DataFrame({"part": pdf["part"], "source": pdf["source"], "begin": pdf["begin"], "start_at": [start[k, i].tolist() for i, k in enumerate(keep)], "sent": [sent[k, i].tolist() for i, k in enumerate(keep)], "place": [at[k, i].tolist() for i, k in enumerate(keep)], "tokens": int(sent.sum())})

    return run


def _cut(length: int, width: np.dtype):
    """Cut a document where its parts, its windows and its sequences end."""

    def run(batches):
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        for b in batches:
            out = {x: [] for x in names}
            for doc, n, packed, before, plans in zip(*(b.column(x).to_pylist() for x in ("doc_id", "n", "ids", "before", "plans")), strict=True):
                ids = np.frombuffer(packed, width).astype("<u4")
                at_plan = max(0, bisect.bisect_right(plans, before, key=lambda p: p["begin"]) - 1)
                done = 0
                while done < n:
                    while at_plan + 1 < len(plans) and plans[at_plan + 1]["begin"] <= before + done:
                        at_plan += 1
                    plan = plans[at_plan]
                    part, tokens, starts, sent, place = (plan[x] for x in ("part", "tokens", "start_at", "sent", "place"))
                    i = max(0, bisect.bisect_right(starts, before + done - plan["begin"]) - 1)
                    inside = before + done - plan["begin"] - starts[i]
                    at, whole = place[i] + inside, tokens // length
                    if at < whole * length:
                        seq, offset, room = at // length, at % length, length - at % length
                    else:
                        ends = np.cumsum(tail_lengths(tokens % length, length)) + whole * length
                        j = int(np.searchsorted(ends, at, "right"))
                        seq, offset, room = whole + j, at - (int(ends[j - 1]) if j else whole * length), int(ends[j]) - at
                    size = min(n - done, sent[i] - inside, room)
                    row = (doc, done, size, zlib.crc32(ids[done : done + size].tobytes()), n, (part << 32) + seq, offset)
                    for x, v in zip(out.values(), row, strict=True):
                        x.append(v)
                    done += size
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out.values()], list(out))

    return run


@operator
def pack(df: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, weights: dict[str, float] | None = None, part_tokens: int = PART_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    weights: target share of each source among the tokens of every window; without, its share of all tokens. Sources
    without a weight come after all that have one. Each id lies in exactly one piece; all tokens are packed, so at the
    corpus' end, where a wanted source has no tokens left, the others keep their shares of what remains. Ids are read as
    longs. Defined cases: null text counts as empty and is its end id alone; null sources are one source; rows with one
    id, or a null id, are documents of their own; other columns are not read; an empty table gives no pieces.
    """
    rows = materialize(encode_rows(df, tokenizer, end_id, id_col, text_col, source_col), "packing")
    spec = broadcast_spec(df.sparkSession, tokenizer)
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(1, -(-total // part_tokens))
    block = F.pmod(F.xxhash64("doc_id", "turn", F.lit(3)), F.lit(parts * BLOCKS)).alias("block")
    have = materialize(rows.select(block, "source", "n").groupBy("block", "source").agg(F.sum("n").alias("have")), "packing-counts")
    totals = have.groupBy("source").agg(F.sum("have").alias("all"))
    if weights is None:
        targets, share = Targets(total, part_tokens, None), F.col("all") / F.lit(float(max(total, 1)))
    else:
        wanted = {f"={k}": float(v) for k, v in weights.items() if v > 0}
        found = totals.filter(F.col("source").isin(list(wanted))).collect()  # one row a weight at most
        whole = sum(wanted[r["source"]] for r in found) or 1.0
        shares = {r["source"]: wanted[r["source"]] / whole for r in found}
        targets = Targets(total, part_tokens, [(shares[r["source"]], r["all"]) for r in found])
        share = F.coalesce(F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), F.lit(v))))[F.col("source")], F.lit(0.0)) if shares else F.lit(0.0)
    totals = materialize(totals.withColumn("share", share), "packing-totals")
    # the parts in which a source has tokens: all, or for a source of fewer tokens than parts those of its tokens
    share, all_ = F.col("share"), F.col("all")
    every = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
    few = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), all_ - 1), lambda x: targets.part_at(share, all_, x)))
    state = totals.withColumn("part", F.explode(F.when(all_ >= parts, every).otherwise(few)))
    tokens = F.col("part") * F.lit(targets.total / parts)
    state = state.withColumn("begin", targets.cut(share, all_, F.col("part"))).withColumn("have", targets.cut(share, all_, F.col("part") + 1) - F.col("begin"))
    state = state.filter("have > 0").withColumn("deficit", targets.sent(share, all_, tokens) - F.col("begin"))
    plan = state.select("part", "source", "have", "share", "deficit", "begin").groupBy("part").applyInPandas(_schedule(WINDOW * length), "part long, source string, begin long, start_at array<long>, sent array<long>, place array<long>, tokens long")
    placed = _before(have).join(totals, "source")
    placed = placed.select("block", "source", F.col("before").alias("base"), targets.part_at(share, all_, F.col("before")).alias("low"), targets.part_at(share, all_, F.col("before") + F.col("have") - 1).alias("high"))
    spans = placed.withColumn("part", F.explode(F.sequence("low", "high"))).join(plan, ["part", "source"])
    streams = spans.groupBy("block", "source", "base").agg(F.sort_array(F.collect_list(F.struct("begin", "part", "tokens", "start_at", "sent", "place"))).alias("plans"))
    queue = Window.partitionBy("block", "source").orderBy(F.xxhash64("doc_id", "turn", F.lit(4)), "doc_id", "n", F.crc32("ids"), "turn")
    queued = rows.select("doc_id", "source", "n", "ids", "turn", block).withColumn("inside", F.sum("n").over(queue.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    placed = queued.hint("merge").join(streams, ["block", "source"]).select("doc_id", "n", "ids", (F.col("base") + F.col("inside")).alias("before"), "plans")
    width = codec(spec.value).width
    return placed.mapInArrow(_cut(length, width), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
