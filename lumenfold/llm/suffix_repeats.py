"""Removal of repeated byte strings by the column-wise construction of multi-document Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes that covers it also starts earlier. The collection has short documents, so the
rounds are bounded: windows of WIDTH bytes. Of the transform a round needs the order of the suffixes alone, which it
carries along with their common prefixes; the symbols that it inserts in that order, the transform's column, are not kept.

1. Every LENGTH-byte string has an anchor: the smallest hash among its SEED-byte substrings. Equal strings have it at the
   same place. The window of an anchor (about one in 32 bytes) holds all strings that have it. Windows that are equal (in
   128 bits of hashes) are one document of the collection, with its earliest place; the other places are repeats. Map
   tasks combine equal windows before the shuffle.
2. Sorted by anchor, in one stream: an anchor with one window has no other repeats, its bytes are left out. An anchor
   that has many windows within one map task is known to stay, and its windows are dealt by their own hashes.
3. The windows of all anchors of a partition are the collection of one construction, aligned on their anchors. Its state
   lies in sequential files in the shared folder: a file for each column of symbols, and a run for each round: the
   suffixes' order and the prefixes that neighbours have in common. Each round reads the run of the
   round before and one column from begin to end, inserts one symbol of every window in front of its suffix, sorts stably
   by the inserted symbols within an anchor, updates the common prefixes with range minima, and writes the next run. Only
   a block of windows is in memory. Neighbours that share LENGTH symbols are equal strings; all but the earliest repeat.
4. An anchor with more than PIECE windows is built in pieces; the earliest string of each kind in each piece then meets
   those of the other pieces by a 128-bit hash.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_folder, materialize, operator, release, shared_dir, with_row_ids

LENGTH, SEED = 100, 37
SIDE = LENGTH - SEED  # bytes on either side of an anchor that its strings can reach
WIDTH = LENGTH + SIDE
#: Bytes of text hashed at a time, bytes of text whose anchors a map task compares at a time, windows of a block and of a piece.
BUFFER, COMBINE, PIECE = 1 << 19, 8 << 20, 40_000
#: So many different windows of an anchor within one comparison of a map task make it one of many.
MANY_FROM = 4
#: Windows whose strings are hashed at a time.
HASHED = 500
_BASE = 0x9E3779B97F4A7C15 | 1
_NEVER = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Roller:
    """Hashes of all substrings of a buffer from prefix sums of a polynomial modulo 2**64."""

    def __init__(self):
        self.table = np.random.default_rng(97).integers(1, 2**63, 256, dtype=np.uint64)
        self.power = self.inverse = np.ones(1, np.uint64)

    def prepare(self, n: int) -> None:
        if n >= len(self.power):
            size = max(n + 1, BUFFER + 4096)
            back = pow(_BASE, -1, 2**64)
            self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, _BASE, np.uint64)])
            self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, back, np.uint64)])

    def sums(self, b: np.ndarray) -> np.ndarray:
        self.prepare(len(b))
        return np.r_[np.uint64(0), np.cumsum(self.table[b] * self.power[: len(b)])]

    def hash(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.inverse[start])


def _sliding(x: np.ndarray, take, width: int) -> np.ndarray:
    """Minimum or maximum over width values from each on, by doubling; x has width - 1 values more than the result."""
    step = 1
    while step * 2 <= width:
        x = take(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return take(x[: len(x) - rest], x[rest:]) if rest else x


def anchors_of(roller: Roller, b: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Anchors of the documents b[begin:end], which lie one after another: document, place in it, hash, context hash, bytes to its left and right."""
    n = len(b)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if n < LENGTH:
        return none
    sums = roller.sums(b)
    doc = np.repeat(np.arange(len(begin)), end - begin)
    at = np.arange(n - SEED + 1)
    left_over = end[doc] - np.arange(n)  # bytes from here to the document's end
    h = _mix((sums[SEED:] - sums[: n - SEED + 1]) * roller.inverse[: n - SEED + 1]) | np.uint64(1)
    h[left_over[: len(h)] < SEED] = _NEVER
    width = SIDE + 1
    least = _sliding(h, np.minimum, width)
    starts = left_over[: len(least)] >= LENGTH
    least[~starts] = 0
    pad = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.r_[pad, least, pad], np.maximum, width) == h)
    chosen = at[chosen]
    d = doc[chosen]
    left = np.minimum(SIDE, chosen - begin[d])
    right = np.minimum(SIDE, end[d] - chosen - SEED)
    context = roller.hash(sums, chosen - left, chosen + SEED + right)
    context = _mix(context + ((left << 8) | right).astype(np.uint64))
    return d, chosen - begin[d], h[chosen], context, left, right


def _pack(place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (place << 12) | (left << 6) | right


def _unpack(at: np.ndarray):
    return at >> 12, (at >> 6) & 63, at & 63


_ROWS = "kind int, h long, f long, doc long, at long"
#: Kinds of rows: an anchor still open, a repeated window (at is its packed place), an open anchor of many windows; and
#: the place of a row that only says that its anchor has such windows.
OPEN, REPEAT, MANY, MARK = 0, 1, 2, -1


def _batch(kind, h, f, doc, at) -> pa.RecordBatch:
    kinds = kind if isinstance(kind, np.ndarray) else np.full(len(doc), kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), *(pa.array(np.asarray(x).astype(np.int64)) for x in (h, f, doc, at))], ["kind", "h", "f", "doc", "at"])


def _find_anchors(buffer: int, combine: int, many_from: int):
    def run(batches):
        """Step 1: anchors of all documents; windows that this task has met before, in order of (doc, place), are repeats at once."""
        roller = Roller()
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size
            if held:
                h, f, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((at, doc, f, h))
                h, f, doc, at = h[order], f[order], doc[order], at[order]
                if len(h):
                    change = np.r_[True, h[1:] != h[:-1]]
                    seen = ~change & np.r_[False, f[1:] == f[:-1]]
                    anchor = np.cumsum(change) - 1
                    many = (np.bincount(anchor[~seen], minlength=anchor[-1] + 1) >= many_from)[anchor]
                    yield _batch(np.where(seen, REPEAT, np.where(many, MANY, OPEN)), h.view(np.int64), f.view(np.int64), doc, at)
                    marks = h[change & many].view(np.int64)
                    none = np.zeros(len(marks), np.int64)
                    yield _batch(OPEN, marks, none, none, none + MARK)
            held, size = [], 0

        def hashed(ids, texts):
            if not ids:
                return
            length = np.array([len(t) for t in texts], np.int64)
            end = np.cumsum(length)
            d, place, h, f, left, right = anchors_of(roller, np.frombuffer(b"".join(texts), np.uint8), end - length, end)
            held.append((h, f, np.array(ids, np.int64)[d], _pack(place, left, right)))

        def hashed_long(doc, raw):
            """A long document in overlapping slices, each for the anchors that begin in its own part."""
            for at in range(0, len(raw), buffer):
                low = max(0, at - SIDE)
                part = np.frombuffer(raw, np.uint8, min(len(raw), at + buffer + LENGTH) - low, low)
                _, place, h, f, left, right = anchors_of(roller, part, np.zeros(1, np.int64), np.array([len(part)]))
                own = np.flatnonzero((place + low >= at) & (place + low < at + buffer))
                held.append((h[own], f[own], np.full(len(own), doc, np.int64), _pack(place[own] + low, left[own], right[own])))

        for b in batches:
            ids, texts, n = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                size += len(raw)
                if len(raw) > 2 * buffer:
                    hashed_long(i, raw)
                else:
                    ids.append(i)
                    texts.append(raw)
                    n += len(raw)
                if n >= buffer:
                    hashed(ids, texts)
                    ids, texts, n = [], [], 0
                if size >= combine:
                    hashed(ids, texts)
                    ids, texts, n = [], [], 0
                    yield from flush()
            hashed(ids, texts)
        yield from flush()

    return run


def _settle(batches):
    """Step 2, over rows sorted by (h, f, doc, at): repeats, and the first place of each window of anchors with several."""
    last_h = last_f = None
    waiting = None  # the first window of the last anchor, not yet known to have a second
    for b in batches:
        h, f, doc, at = (b.column(i).to_numpy() for i in range(4))
        if not len(h):
            continue
        same_h = np.r_[last_h is not None and h[0] == last_h, h[1:] == h[:-1]]
        same = same_h & np.r_[last_f is not None and f[0] == last_f, f[1:] == f[:-1]]
        first = np.flatnonzero(~same)
        repeat = np.flatnonzero(same & (at != MARK))
        if len(repeat):
            yield _batch(REPEAT, h[repeat], f[repeat], doc[repeat], at[repeat])
        if len(first):
            fh = h[first]
            with_before = np.r_[last_h is not None and fh[0] == last_h, fh[1:] == fh[:-1]]
            with_next = np.r_[fh[1:] == fh[:-1], False]
            if with_before[0] and waiting is not None:
                yield waiting
                waiting = None
            out = first[with_before | with_next]
            out = out[at[out] != MARK]
            if len(out):
                yield _batch(OPEN, h[out], f[out], doc[out], at[out])
            tail = first[-1:]
            waiting = None if (with_before | with_next)[-1] or at[tail[0]] == MARK else _batch(OPEN, h[tail], f[tail], doc[tail], at[tail])
        last_h, last_f = h[-1], f[-1]


def _settle_many(batches):
    """The same for windows of anchors known to have many."""
    last = None
    for b in batches:
        h, f, doc, at = (b.column(i).to_numpy() for i in range(4))
        if len(h):
            same = np.r_[last == (h[0], f[0]), (h[1:] == h[:-1]) & (f[1:] == f[:-1])]
            yield _batch(np.where(same, REPEAT, OPEN), h, f, doc, at)
            last = (h[-1], f[-1])


def _contexts(batches):
    """The bytes around each open anchor of a document, aligned on it."""
    names = ["h", "pieces", "doc", "at", "context"]

    def batch(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:4]), pa.array(cols[4], pa.binary())], names)

    rows: list[tuple] = []
    for b in batches:
        for doc, text, opens in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for o in opens:
                place, left, right = o["at"] >> 12, (o["at"] >> 6) & 63, o["at"] & 63
                rows.append((o["h"], o["pieces"], doc, o["at"], bytes(SIDE - left) + raw[place - left : place + SEED + right] + bytes(SIDE - right)))
            if len(rows) >= 20_000:
                yield batch(rows)
                rows = []
    if rows:
        yield batch(rows)


def insert_column(order: np.ndarray, common: np.ndarray, symbols: np.ndarray):
    """One round: symbols[i] goes in front of the suffix of window i. order: windows by (anchor, suffix); common: what each
    has in common with the one before it, at most 255, -1 where an anchor begins. Returns both anew, and the inserted
    symbols in the old order, this round's part of the transform."""
    inserted = symbols[order]
    anchor = np.cumsum(common < 0)
    key = anchor * 256 + inserted
    by = np.argsort(key, kind="stable")
    key = key[by]
    new = np.where(np.r_[True, key[1:] >> 8 != key[:-1] >> 8], -1, 0).astype(np.int16)
    i = np.flatnonzero(key[1:] == key[:-1])
    if len(i):
        new[i + 1] = np.minimum(1 + _range_min(common, by[i] + 1, by[i + 1]), 255)
    return order[by], new, inserted, by


def repeats_of_round(order: np.ndarray, common: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Whether the string that begins at this round's column repeats that of an earlier window, for each place of order."""
    run = np.cumsum(common < LENGTH) - 1
    ok = valid[order]
    earliest = np.full(run[-1] + 1 if len(run) else 0, len(order))
    np.minimum.at(earliest, run[ok], order[ok])
    return ok & (order != earliest[run])


def _range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of x[low..high] (both ends in) for each pair."""
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(low), x.dtype)
    table, k = x, 0
    top = int(level.max())
    while True:
        own = level == k
        if own.any():
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k) + 1])
        if k == top:
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


class Files:
    """Sequential files of one task in the folder that driver and executors share."""

    def __init__(self, folder: str):
        self.fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        self.root = f"{root}/{uuid.uuid4().hex}"
        self.fs.create_dir(self.root, recursive=True)

    def write(self, name):
        return self.fs.open_output_stream(f"{self.root}/{name}")

    def read(self, name):
        return self.fs.open_input_stream(f"{self.root}/{name}")

    def drop(self, name) -> None:
        self.fs.delete_file(f"{self.root}/{name}")

    def close(self) -> None:
        self.fs.delete_dir(self.root)


def _take(stream, n: int, kind) -> np.ndarray:
    """The next n numbers of a file."""
    want = n * np.dtype(kind).itemsize
    got = stream.read(want)
    while len(got) < want:
        more = stream.read(want - len(got))
        if not more:
            raise EOFError("a file of the construction is too short")
        got += more
    return np.frombuffer(got, kind)


def _blocks(batches, piece: int):
    """Whole groups (h, part) of a sorted stream, about piece windows at a time."""
    held, count = [], 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= piece:
            t = pa.Table.from_batches(held).combine_chunks()
            h, part = t.column("h").to_numpy(), t.column("part").to_numpy()
            other = np.flatnonzero((h != h[-1]) | (part != part[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
            if cut:
                yield t.slice(0, cut)
            held, count = t.slice(cut).to_batches(), len(t) - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


class Strings:
    """128-bit hashes of the LENGTH-byte strings of windows."""

    def __init__(self):
        self.rollers = [np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) for seed in (41, 43)]
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(WIDTH, _BASE, np.uint64)])
        back = pow(_BASE, -1, 2**64)
        self.power, self.inverse = power[:WIDTH], np.multiply.accumulate(np.r_[np.uint64(1), np.full(SIDE, back, np.uint64)])

    def hash(self, symbols: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of the string that begins in each of the first SIDE + 1 columns."""
        out = []
        for table in self.rollers:
            sums = np.c_[np.zeros(len(symbols), np.uint64), np.cumsum(table[symbols] * self.power, axis=1, dtype=np.uint64)]
            out.append(_mix((sums[:, LENGTH:] - sums[:, : SIDE + 1]) * self.inverse) | np.uint64(1))
        return out


def _build(piece: int, folder: str):
    names = ["w1", "w2", "doc", "at", "start", "stop"]

    def batch(*cols):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).astype(np.int64)) for x in cols], names)

    def run(batches):
        """Step 3 over windows sorted by (h, part of h, doc, at): spans to remove, and what parts of one anchor must compare."""
        files = Files(folder)
        try:
            yield from construct(files, batches)
        finally:
            files.close()

    def construct(files: Files, batches):
        sizes, hot = [], []  # windows of each block, and whether an anchor of it is in parts
        columns = [files.write(f"column-{i}") for i in range(WIDTH)]
        with files.write("run-0") as state, files.write("places") as places, files.write("sides") as sides, files.write("windows") as windows:
            for t in _blocks(batches, piece):
                h, part, pieces, doc, at = (t.column(x).to_numpy() for x in ("h", "part", "pieces", "doc", "at"))
                symbols = np.frombuffer(b"".join(t.column("context").to_pylist()), np.uint8).reshape(len(h), WIDTH)
                sizes.append(len(h))
                for stream, column in zip(columns, np.ascontiguousarray(symbols.T), strict=True):
                    stream.write(column.tobytes())
                begin = np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])]
                state.write(np.arange(len(h), dtype=np.int32).tobytes() + np.where(begin, -1, 0).astype(np.int16).tobytes() + np.zeros(len(h), np.uint64).tobytes())
                places.write(doc.astype(np.int64).tobytes() + at.astype(np.int64).tobytes() + (pieces > 1).tobytes())
                _, left, right = _unpack(at)
                sides.write(left.astype(np.uint8).tobytes() + right.astype(np.uint8).tobytes())
                hot.append(bool((pieces > 1).any()))
                if hot[-1]:
                    windows.write(symbols.tobytes())
        for stream in columns:
            stream.close()
        for turn, column in enumerate(range(WIDTH - 1, -1, -1)):
            judged = column <= SIDE  # from here on the suffixes are long enough
            with files.read(f"column-{column}") as symbols, files.read(f"run-{turn}") as old, files.write(f"run-{turn + 1}") as new, files.read("sides") as sides:
                for n in sizes:
                    order, common, marks = _take(old, n, np.int32), _take(old, n, np.int16), _take(old, n, np.uint64)
                    order, common, _, by = insert_column(order, common, _take(symbols, n, np.uint8))
                    marks = marks[by]
                    if judged:
                        left, right = _take(sides, n, np.uint8), _take(sides, n, np.uint8)
                        t = SIDE - column
                        valid = (t <= left) & (SIDE - t <= right)
                        marks = marks | (repeats_of_round(order, common, valid).astype(np.uint64) << np.uint64(t))
                    new.write(order.tobytes() + common.tobytes() + marks.tobytes())
            files.drop(f"column-{column}")
            files.drop(f"run-{turn}")
        strings, steps = Strings(), np.arange(SIDE + 1)
        with files.read(f"run-{WIDTH}") as state, files.read("places") as places, files.read("windows") as windows:
            for n, in_parts in zip(sizes, hot, strict=True):
                order, _, marks = _take(state, n, np.int32), _take(state, n, np.int16), _take(state, n, np.uint64)
                doc, at, parted = _take(places, n, np.int64), _take(places, n, np.int64), _take(places, n, bool)
                place, left, right = _unpack(at)
                verdict = np.empty(n, np.uint64)
                verdict[order] = marks
                for low in range(0, n, HASHED * 16):
                    own = slice(low, low + HASHED * 16)
                    repeated = (verdict[own, None] >> steps.astype(np.uint64)) & np.uint64(1) == 1
                    some = np.flatnonzero(repeated.any(axis=1))
                    if len(some):
                        start, stop = SIDE - repeated[some, ::-1].argmax(axis=1), repeated[some].argmax(axis=1)
                        some += low
                        yield batch(0 * some, 0 * some, doc[some], at[some], place[some] - start, place[some] - stop + LENGTH)
                for low in range(0, n if in_parts else 0, HASHED):
                    symbols = _take(windows, min(HASHED, n - low) * WIDTH, np.uint8).reshape(-1, WIDTH)
                    own = slice(low, low + HASHED)
                    valid = (steps <= left[own, None]) & (SIDE - steps <= right[own, None]) & parted[own, None]
                    i, t = np.nonzero(valid & ((verdict[own, None] >> steps.astype(np.uint64)) & np.uint64(1) == 0))
                    if len(i):
                        first, second = (x[i, SIDE - t].view(np.int64) for x in strings.hash(symbols))
                        i += low
                        yield batch(first, second, doc[i], at[i], place[i] - t, place[i] - t + LENGTH)

    return run


def repeated_spans(documents: DataFrame, piece: int = PIECE) -> DataFrame:
    """doc, start, stop: byte spans that repeat earlier text, overlapping, of documents (doc, text) with unique ids.

    Of each window one span at most comes, so a document's spans are few for its length."""
    anchors = documents.mapInArrow(_find_anchors(BUFFER, COMBINE, MANY_FROM), _ROWS)
    found = materialize(_settled(anchors), "repeats-anchors")
    whole = found.filter(F.col("kind") == REPEAT)
    place, left, right = F.shiftright("at", 12), F.shiftright("at", 6).bitwiseAND(F.lit(63)), F.col("at").bitwiseAND(F.lit(63))
    spans = whole.select("doc", (place - left).alias("start"), (place + SEED + right).alias("stop"))
    opened = found.filter(F.col("kind") == OPEN).select("h", "doc", "at")
    large = materialize(opened.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece)).alias("pieces")).filter("pieces > 1"), "repeats-large")
    listed = opened.hint("merge").join(large, "h", "left").select("h", F.coalesce("pieces", F.lit(1).cast("long")).alias("pieces"), "doc", "at")
    listed = listed.groupBy("doc").agg(F.collect_list(F.struct("h", "pieces", "at")).alias("opens"))
    texts = documents.hint("merge").join(listed, "doc").select("doc", "text", "opens")
    contexts = texts.mapInArrow(_contexts, "h long, pieces long, doc long, at long, context binary")
    parted = contexts.withColumn("part", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc", "at"), F.col("pieces"))).otherwise(F.lit(0)).cast("long"))
    ordered = parted.repartition("h", "part").sortWithinPartitions("h", "part", "doc", "at")
    spark = documents.sparkSession
    folder = arrow_folder(spark, f"{shared_dir(spark)}/construction-{uuid.uuid4().hex}")
    built = materialize(ordered.mapInArrow(_build(piece, folder), "w1 long, w2 long, doc long, at long, start long, stop long"), "repeats-built")
    release(large)
    inside = built.filter((F.col("w1") == 0) & (F.col("w2") == 0)).select("doc", "start", "stop")
    across = built.filter(~((F.col("w1") == 0) & (F.col("w2") == 0)))
    earliest = across.groupBy("w1", "w2").agg(F.min(F.struct("doc", "start")).alias("e"))
    later = across.hint("merge").join(earliest, ["w1", "w2"]).filter((F.col("doc") != F.col("e.doc")) | (F.col("start") != F.col("e.start")))
    # the strings of one window overlap, so what is repeated of it is one span
    later = later.groupBy("doc", "at").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.unionByName(inside).unionByName(later.select("doc", "start", "stop"))


def _settled(anchors: DataFrame) -> DataFrame:
    """Repeats that map tasks found stay as they are; all other anchors meet, sorted, in one stream for each partition."""
    spread = F.when(F.col("kind") == REPEAT, F.xxhash64("doc", "at")).when(F.col("kind") == MANY, F.xxhash64("h", "f")).otherwise(F.col("h"))
    return anchors.repartition(spread).sortWithinPartitions("kind", "h", "f", "doc", "at").mapInArrow(_settle_kinds, _ROWS)


def _settle_kinds(batches):
    """Over rows sorted by kind, then as _settle asks."""

    def pieces():
        for b in batches:
            kind = b.column(0).to_numpy()
            ends = np.flatnonzero(np.r_[kind[1:] != kind[:-1], True]) + 1 if len(kind) else []
            low = 0
            for end in ends:
                yield int(kind[low]), pa.RecordBatch.from_arrays(b.slice(low, end - low).columns[1:], ["h", "f", "doc", "at"])
                low = end

    for kind, rows in itertools.groupby(pieces(), key=lambda x: x[0]):
        rows = (b for _, b in rows)
        if kind == REPEAT:
            yield from (_batch(REPEAT, *(c.to_numpy() for c in b.columns)) for b in rows)
        else:
            yield from _settle(rows) if kind == OPEN else _settle_many(rows)


def _apply(extra: int, as_text: bool):
    """Remove the union of its spans from each document."""

    def run(batches):
        for b in batches:
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for text, spans in zip(b.column(extra).to_pylist(), b.column(extra + 1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, at, runs = [], 0, 0
                if spans:
                    start, stop = np.array([s["start"] for s in spans]), np.array([s["stop"] for s in spans])
                    by = np.argsort(start, kind="stable")
                    start, stop = start[by], np.maximum.accumulate(stop[by])
                    heads = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]])
                    tails = np.r_[heads[1:] - 1, len(start) - 1]
                    runs = len(heads)
                    for i, j in zip(start[heads].tolist(), stop[tails].tolist(), strict=True):
                        kept.append(raw[at:i])
                        at = j
                kept.append(raw[at:])
                left = b"".join(kept)
                for x, v in zip(out.values(), (len(raw), len(raw) - len(left), runs, left), strict=True):
                    x.append(v)
            kept = pa.array([x.decode("utf-8", "ignore") for x in out["kept"]], pa.string()) if as_text else pa.array(out["kept"], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(extra)), *(pa.array(out[x], pa.int64()) for x in ("n_bytes", "n_removed", "n_spans")), kept], [*b.schema.names[:extra], "n_bytes", "n_removed", "n_spans", "kept"])

    return run


@operator
def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), piece: int = PIECE, as_text: bool = False, every_row: bool = False) -> DataFrame:
    """id_col, the columns of keep, n_bytes, n_removed, n_spans and kept (what stays) of every document.

    Exact: each byte that a LENGTH-byte string covers which also starts earlier (smaller id, or earlier in the same
    document) goes; strings are judged on the input and never cross documents. kept is binary, as a repeat may begin inside
    a character; with as_text it is text, without characters that lost bytes. Defined cases: null text counts as empty; rows with a null id are left out; of rows that share an
    id the one with the smallest text stays; other columns are not read; an empty table gives no rows. With every_row
    each row is a document of its own, in the order of with_row_ids, and none is left out.
    """
    if every_row:
        named = with_row_ids(df.select(*dict.fromkeys([id_col, text_col, *keep])), id_col, text_col, "_row")
    else:
        named = df.filter(F.col(id_col).isNotNull()).withColumn("_row", F.col(id_col).cast("long"))
    if not every_row and not named.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).limit(1).isEmpty():
        rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last(), *(F.col(c).cast("string") for c in keep)))
        named = named.withColumn("_rank", rank).filter(F.col("_rank") == 1)
    extra = [c for c in keep if c != id_col]
    documents = named.select(F.col("_row").alias("doc"), F.col(text_col).alias("text"))
    spans = repeated_spans(documents, piece).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    rows = named.select("_row", F.col(id_col), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(extra)), F.col(text_col).alias("_text"))
    joined = rows.join(spans, rows["_row"] == spans["doc"], "left").select(id_col, *(f"_keep{i}" for i in range(len(extra))), "_text", "_spans")
    types = [f"`{id_col}` {df.schema[id_col].dataType.simpleString()}", *(f"_keep{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(extra))]
    done = joined.mapInArrow(_apply(len(types), as_text), ", ".join([*types, f"n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"]))
    return done.withColumnsRenamed({f"_keep{i}": c for i, c in enumerate(extra)})
