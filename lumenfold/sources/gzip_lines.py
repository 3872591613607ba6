"""Lines of gzip files, read by as many tasks as the files have members, and parsed by as many as wanted.

Spark reads a gzip file in one task. A file that was written in members (by parallel or blocked compressors, or by
appending) can be entered at each of them: tasks look for headers in their own byte range of a file, decode the members
that begin there, and the decoder checks each one's length and checksum, which a chance header in compressed bytes does
not survive. Lines cut by the end of a member are joined afterwards from the members' edges. A member is inflated in a
stream, so memory does not grow with it; a file of one member is inflated by one task, but its lines leave that task as
blocks of bytes, unparsed, for other tasks.
"""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import list_files, open_file

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a file that a task searches for members, bytes read at a time, bytes of a block of lines.
RANGE, READ, BLOCK = 64 << 20, 1 << 20, 4 << 20
#: Inflated bytes after which a header is taken for true and lines are handed on; a shorter member is checked as a whole first.
TRUSTED = 16 << 20
PIECES = "path string, start long, kind string, text binary"


def _headers(f, start: int, stop: int):
    """Places in [start, stop) that look like the header of a member."""
    at = start
    while at < stop:
        f.seek(at)
        data = f.read(min(READ, stop - at) + 3)
        i = data.find(MAGIC)
        while i >= 0:
            if at + i < stop and i + 3 < len(data) and not data[i + 3] & 0xE0:
                yield at + i
            i = data.find(MAGIC, i + 1)
        if not data:
            return
        at += min(READ, stop - at)


def _inflated(f, start: int):
    """The bytes of the member at start, in pieces; an error if it is none."""
    f.seek(start)
    decoder = zlib.decompressobj(31)
    while not decoder.eof:
        data = decoder.unconsumed_tail or f.read(READ)
        if not data:
            raise zlib.error("the file ends within a member")
        yield decoder.decompress(data, READ)


def _member(f, path: str, start: int):
    """Rows of a member: its head up to the first line end, blocks of whole lines, and its tail behind the last line end.

    A member without a line end is a head with kind 'all'."""
    held, size, rest, head, trusted = [], 0, b"", None, False
    try:
        for piece in _inflated(f, start):
            size += len(piece)
            rest += piece
            if head is None:
                cut = rest.find(b"\n")
                if cut < 0:
                    continue
                head, rest = rest[: cut + 1], rest[cut + 1 :]
                held.append((path, start, "head", head))
            if len(rest) >= BLOCK:
                cut = rest.rfind(b"\n") + 1
                if cut:
                    held.append((path, start, "lines", rest[:cut]))
                    rest = rest[cut:]
            trusted = trusted or size > TRUSTED
            if trusted:
                yield from held
                held = []
    except zlib.error as e:
        if trusted or not start:
            raise ValueError(f"{path} is damaged at its member from byte {start}: {e}") from e
        return
    yield from held
    cut = rest.rfind(b"\n") + 1
    if head is None:
        yield path, start, "all", rest
        return
    if cut:
        yield path, start, "lines", rest[:cut]
    yield path, start, "tail", rest[cut:]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "start", "kind", "text"])


def _pieces(batches):
    for b in batches:
        for path, start, stop in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            with open_file(path) as f:
                # a true member's bytes hold no other member: what lies inside one is skipped by its own check
                for at in list(_headers(f, start, stop)):
                    for row in _member(f, path, at):
                        yield _batch([row])


def _stitched(edges: pd.DataFrame) -> pd.DataFrame:
    """Lines that ends of members cut, of one file: each tail with the heads behind it up to a line end."""
    out, open_line = [], b""
    for kind, text in edges.sort_values(["start", "order"])[["kind", "text"]].itertuples(index=False):
        open_line += text
        if kind == "head":
            out.append(open_line)
            open_line = b""
        # a tail or a member without a line end goes on in the next member
    if open_line:
        out.append(open_line)
    return pd.DataFrame({"text": out})


def gzip_lines(spark: SparkSession, root: str, glob: str = "*.gz", partitions: int | None = None) -> DataFrame:
    """value: every line of the gzip files below root, without its end; the order of lines is not kept.

    Damage raises an error; an empty file has no lines. partitions: tasks that split blocks into lines."""
    tasks = partitions or spark.sparkContext.defaultParallelism
    files = list_files(spark, root, glob).filter("bytes > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(RANGE).cast("long"))).alias("start")
    ranges = files.select("path", "bytes", starts).select("path", "start", F.least(F.col("start") + RANGE, "bytes").alias("stop"))
    pieces = ranges.repartition(tasks, "path", "start").mapInArrow(_pieces, PIECES)
    edge = pieces.filter("kind <> 'lines'").withColumn("order", F.when(F.col("kind") == "tail", 1).otherwise(0))
    joined = edge.groupBy("path").applyInPandas(_stitched, "text binary")
    blocks = pieces.filter("kind = 'lines'").select("text").unionByName(joined).repartition(tasks)
    lines = blocks.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("value"))
    return lines.select(F.regexp_replace("value", "\r$", "").alias("value")).filter("value <> ''")
