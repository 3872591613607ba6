"""Derivative builder for web archives: responses become linked metadata and plain-text conversion records.

For each WARC response record two records follow. ``metadata`` (JSON) keeps the source's WARC headers, its HTTP status
and headers, its digests, the title and the links; ``conversion`` is the visible text. Both name the response in
WARC-Refers-To, repeat its target URI and date, and carry a digest of their own block. Record ids follow from the
response's id and the kind of record, so a task that runs again makes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import open_file
from .common import arrow_folder, operator, ship
from .html_text import RAW_END, Tags, nodes_of, read_page

VERSION = "WARC/1.1"
#: Bytes within which a record's headers end.
HEADERS = 1 << 20
#: Bytes of a file read at a time.
READ = 1 << 20
#: Stands in for the capture time where a table of pages has none.
DATE = "2024-01-01T00:00:00Z"
_LINKS = {"a": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action"}
_VALUE = {at: re.compile(r"(?:^|[\s\"'])%s\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))" % at, re.I) for at in set(_LINKS.values())}
_TITLE_END = re.compile("</title", re.I | re.A)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """The bytes of one record; Content-Length is added."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def named_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def parse_headers(data: bytes) -> list[tuple[str, str]]:
    """Header lines in order; continued lines are joined, lines without a colon left out."""
    out: list[tuple[str, str]] = []
    for line in data.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def _split(data: bytes) -> tuple[bytes, bytes]:
    for mark in (b"\r\n\r\n", b"\n\n"):
        at = data.find(mark)
        if at >= 0:
            return data[:at], data[at + len(mark) :]
    return data, b""


def get(headers: list[tuple[str, str]], name: str) -> str:
    return next((v for k, v in headers if k.lower() == name.lower()), "")


def opened(pieces):
    """The bytes of a file that comes in pieces: of gzip members, one after another, or as they are. Of a member cut short or
    damaged what comes before it."""
    pieces = iter(pieces)
    data = next(pieces, b"")
    while len(data) < 2 and (more := next(pieces, None)) is not None:
        data += more
    if data[:2] != b"\x1f\x8b":
        yield data
        yield from pieces
        return
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            while not member.eof:
                for at in range(0, len(data), 1 << 16):
                    if out := member.decompress(data[at : at + (1 << 16)]):
                        yield out
                    if member.eof:
                        data = member.unused_data + data[at + (1 << 16) :]
                        break
                else:
                    data = next(pieces, None)
                    if data is None:
                        return
        except zlib.error:
            return
        while len(data) < 2 and (more := next(pieces, None)) is not None:
            data += more


class _Window:
    """The bytes of a stream from a place on; what lies before the place is forgotten."""

    def __init__(self, pieces):
        self.pieces, self.data, self.at, self.ended = iter(pieces), b"", 0, False

    def has(self, n: int) -> bool:
        """Whether n more bytes are there, after reading on for them."""
        if self.at + n > len(self.data) and not self.ended:
            out, size = [self.data[self.at :]], len(self.data) - self.at
            while size < n and not self.ended:
                piece = next(self.pieces, None)
                self.ended = piece is None
                out.append(piece or b"")
                size += len(out[-1])
            self.data, self.at = b"".join(out), 0
        return self.at + n <= len(self.data)

    def seek(self, mark: bytes) -> bool:
        """Go to the next place of mark, if there is one."""
        while True:
            found = self.data.find(mark, self.at)
            if found >= 0:
                self.at = found
                return True
            self.at = max(self.at, len(self.data) - len(mark) + 1)
            if not self.has(READ) and self.ended and self.data.find(mark, self.at) < 0:
                return False


def records_in(pieces):
    """(headers, block) of each record of a WARC file that comes in pieces; gzip members are opened; a cut last record keeps
    what is there. A record begins where the one before ends; after a wrong Content-Length, at the next line that begins
    one. One record is in memory, and the pieces that hold its ends."""
    w = _Window(opened(pieces))
    going = w.seek(b"WARC/")
    while going:
        w.has(HEADERS + 4)
        stop = w.at + HEADERS
        end, mark = next(((e, m) for m in (b"\r\n\r\n", b"\n\n") if (e := w.data.find(m, w.at, stop)) >= 0), (-1, b""))
        if end < 0:
            while w.has(len(w.data) - w.at + READ):  # no end of the headers: all that is left
                pass
            end = len(w.data)
        headers = parse_headers(w.data[w.at : end].partition(b"\n")[2])
        size = int(n) if (n := get(headers, "content-length")).isdigit() else 0
        w.at = end + len(mark)
        w.has(size)
        yield headers, w.data[w.at : w.at + size]
        w.at = min(len(w.data), w.at + size)
        while w.has(1) and w.data[w.at : w.at + 1] in (b"\r", b"\n"):
            w.at += 1
        w.has(5)
        if not w.data.startswith(b"WARC/", w.at):
            going = w.seek(b"\nWARC/")
            w.at += going


def read_records(data: bytes):
    """records_in for a file's bytes."""
    return records_in([data])


def title_and_links(page: str) -> tuple[str, list[dict]]:
    """The first title's text, and the links of a, link, img, script, iframe and form tags."""
    tags, at, title, links = Tags(page), 0, None, []
    while found := tags.after(at):
        at = found[1]
        if found[2] is None or found[2][0]:
            continue
        _, tag, attributes = found[2]
        if tag in _LINKS and (m := _VALUE[_LINKS[tag]].search(attributes)):
            links.append({"tag": tag, "at": _LINKS[tag], "url": html.unescape(m[1] or m[2] or m[3] or "")})
        if tag == "title" and title is None:
            end = _TITLE_END.search(page, at)
            title, at = (page[at : end.start()], end.start()) if end else ("", at)
        elif tag in RAW_END and tag != "title":
            end = RAW_END[tag].search(page, at)
            at = end.start() if end else len(page)
    return " ".join(html.unescape(title or "").split()), links


def body_of(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The payload without transfer and content codings; as it is where those are broken."""
    try:
        if "chunked" in get(headers, "transfer-encoding").lower():
            out, at = [], 0
            while (end := body.find(b"\r\n", at)) >= 0 and (n := int(body[at:end].split(b";")[0] or b"0", 16)):
                out.append(body[end + 2 : end + 2 + n])
                at = end + 4 + n
            body = b"".join(out)
        coding = get(headers, "content-encoding").lower()
        return gzip.decompress(body) if coding in ("gzip", "x-gzip") else zlib.decompress(body) if coding == "deflate" else body
    except (ValueError, OSError, EOFError, zlib.error):
        return body


def text_of(headers: list[tuple[str, str]], body: bytes) -> str:
    named = _CHARSET.search(get(headers, "content-type")) or _CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def visible_text(page: str) -> str:
    """The text of every block, one a line."""
    return "\n".join(x.text[0] for x in nodes_of(read_page(page)) if x.text)


def derivatives(headers: list[tuple[str, str]], block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response; none for records of other types."""
    if get(headers, "warc-type").lower() != "response":
        return []
    source, uri, date = get(headers, "warc-record-id"), get(headers, "warc-target-uri"), get(headers, "warc-date")
    head, body = _split(block)
    status, _, rest = head.partition(b"\n")
    http = parse_headers(rest)
    payload = body_of(http, body)
    kind = get(http, "content-type").split(";")[0].strip().lower()
    page = text_of(http, payload)
    is_html = kind in ("text/html", "application/xhtml+xml", "")
    title, links = title_and_links(page) if is_html else ("", [])
    payload_digest = get(headers, "warc-payload-digest") or digest(body)
    said = {
        "source": {"warc_headers": headers, "block_digest": get(headers, "warc-block-digest") or digest(block), "payload_digest": payload_digest, "payload_length": len(body)},
        "http": {"status": status.decode("latin-1").strip(), "headers": http},
        "html": {"title": title, "links": links},
    }
    text = visible_text(page) if is_html else page if kind.startswith("text/") else ""
    out = []
    for name, content, kind_of in (("metadata", json.dumps(said, ensure_ascii=False), "application/json"), ("conversion", text, "text/plain; charset=utf-8")):
        data = content.encode("utf-8", "replace")
        own = {"record_type": name, "record_id": named_id(f"{source} {name}"), "refers_to": source, "target_uri": uri, "warc_date": date, "content_type": kind_of, "content_length": len(data), "block_digest": digest(data), "source_payload_digest": payload_digest, "content": content}
        fields = [("WARC-Type", name), ("WARC-Record-ID", own["record_id"]), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", own["block_digest"]), ("Content-Type", kind_of)]
        out.append(own | {"record": record([(k, v) for k, v in fields if v], data)})
    return out


OUT = {"record_type": "string", "record_id": "string", "refers_to": "string", "target_uri": "string", "warc_date": "string", "content_type": "string", "content_length": "long", "block_digest": "string", "source_payload_digest": "string", "content": "string", "record": "binary"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


@operator
def build_derivatives(df: DataFrame, record_col: str = "record", keep: tuple[str, ...] = (), columns: tuple[str, ...] = tuple(OUT)) -> DataFrame:
    """Two rows for each response record of df: the columns of keep, then those asked for of OUT.

    record_col: the bytes of one or more WARC records. Each row stands alone, so no shuffle. Defined cases: null or empty
    bytes and records of other types give no rows; a response without a body gives an empty conversion; broken codings
    are taken as they stand; repeated rows give their records again; an empty table gives no rows.
    """
    types = [*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} {OUT[c]}" for c in columns)]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                index, rows = [], []
                for i, data in enumerate(part.column(len(keep)).to_pylist()):
                    for headers, block in read_records(data or b""):
                        made = derivatives(headers, block)
                        rows += made
                        index += [i] * len(made)
                taken = [part.column(i).take(pa.array(index, pa.int64())) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*taken, *(pa.array([r[c] for r in rows], _ARROW[OUT[c]]) for c in columns)], [*keep, *columns])

    return df.select(*(F.col(c) for c in keep), F.col(record_col)).mapInArrow(run, ", ".join(types))


@operator
def responses_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """id_col, url_col and the bytes of a response record for every page; null html is an empty body, a null url an empty one."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                out = []
                for i, u, h in zip(*(part.column(j).to_pylist() for j in range(3)), strict=True):
                    body = (h or "").encode("utf-8", "replace")
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                    fields = [("WARC-Type", "response"), ("WARC-Record-ID", named_id(f"{i} {u or ''}")), ("WARC-Target-URI", u or ""), ("WARC-Date", date), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
                    out.append(record(fields, block))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], [id_col, url_col, "record"])

    return pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col)).mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, record binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path and bytes of every record of the WARC files under path (plain or gzip), read as streams, a file in one task.

    Defined cases: records follow each other as records_in says; a record without a block has an empty one, and its
    Content-Length is that of the bytes that are there; an empty file has no records. A record lies in memory as a whole."""
    ship(spark)

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                with open_file(name) as f:
                    for headers, block in records_in(iter(lambda: f.read(READ), b"")):
                        whole = record([h for h in headers if h[0].lower() != "content-length"], block)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([whole], pa.binary())], ["path", "record"])

    names = spark.read.format("binaryFile").load(path).select("path")  # the contents are not read here
    return names.repartition("path").mapInArrow(run, "path string, record binary")


def write_warc(df: DataFrame, path: str, record_col: str = "record", compression: str = "gzip") -> None:
    """Write records as WARC files, one for each partition that has any: a gzip member a record, or plain with "none".

    Blocks are written byte for byte. Tasks write under names of their own, and those of the attempts that counted are
    renamed, so a lost executor leaves no half file. Defined cases: null records are left out; without records the folder
    is there and empty."""
    spark = df.sparkSession
    ship(spark)
    folder, end = arrow_folder(spark, path), ".warc.gz" if compression == "gzip" else ".warc"

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        name, out = f"_{uuid.uuid4().hex}", None
        for b in batches:
            for data in b.column(0).to_pylist():
                if data is None:
                    continue
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(gzip.compress(data, mtime=0) if compression == "gzip" else data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(path))
    for i, r in enumerate(df.select(record_col).mapInArrow(run, "name string").collect()):
        if not fs.rename(hadoop(f"{path}/{r['name']}"), hadoop(f"{path}/part-{i:05d}-{r['name'][1:9]}{end}")):
            raise OSError(f"{r['name']} could not be renamed in {path}")
