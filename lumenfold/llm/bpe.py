"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the UTF-8 bytes cuts texts where their content says so, so passages that documents share give the
same chunks wherever they stand. A worker encodes a chunk once and keeps it: its body, from its first to its last
certain break (a single space between two non-spaces, which no pre-token spans), with the words at the body's ends. What
is left between two bodies, the join, is encoded anew together with the last word of the body before it and the first of
the body after it. The re-encoded tokens must agree with those of the bodies there; where they don't, the join takes in
the bodies and is encoded again, until they agree or the text ends.

Chunks are shared by all documents that a worker reads, not across workers: to send a chunk's tokens through a shuffle
costs more than to encode it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import operator

#: Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BREAK = re.compile(r"(?<=\S) (?=\S)")
#: White space as the pattern means it (Unicode's White_Space), in runs so long that the pattern's look-ahead must not meet them.
LONG_RUN = 4096
_LONG = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
#: One cut in 256 bytes on average, decided by the 16 bytes before it.
WINDOW, MASK = 16, 255
#: Memory that a worker's chunks may take; as much again is held of the generation before. They only save time.
CACHE_BYTES = 32 << 20
#: What a chunk takes in memory besides its characters and ids: objects, their headers and a place in the table.
CHUNK_COST = 700


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else the next from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _check_merges(merges: list, vocab: dict[str, int]) -> None:
    """Raise unless the merges are those that the ids stand for: one for each longer token, in the order of the ids.

    The encoder goes by the ids alone, so other merges would be passed over without an error."""
    ids = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
    longer = sorted(i for token, i in vocab.items() if len(token) > 1)
    if ids != longer:
        raise ValueError("only byte-level BPE with one merge for each longer token, in the order of the ids, is known here")


class Codec:
    """Encodes and decodes like the tokenizers library for one byte-level BPE file; ids are packed little-endian."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        pre, added = model.get("pre_tokenizer") or {}, model["added_tokens"]
        if model.get("normalizer") or model["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(t[x] for t in added for x in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only byte-level BPE without a normalizer, prefix space or flags of added tokens is known here")
        contents = {t["content"] for t in added}
        _check_merges(model["model"]["merges"], {t: i for t, i in model["model"]["vocab"].items() if t not in contents})
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        for content in self.special:
            ranks.pop(content.encode(), None)
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.width = np.dtype("<u2" if size <= 65536 else "<u4")
        self.bytes_of = [b""] * size
        for token, i in [*ranks.items(), *((c.encode(), i) for c, i in self.special.items())]:
            self.bytes_of[i] = token
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = tiktoken.Encoding("single", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})  # a text is one pre-token
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.chunks: dict[bytes, tuple] = {}
        self.old_chunks: dict[bytes, tuple] = {}
        self.held = 0
        self.gear = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)

    def raw(self, text: str) -> bytes:
        """The packed ids of a text. Of a run of white space all but the last character, or all at the text's end, is one
        pre-token; long runs are taken out here, as the pattern's search keeps a state for each character of them."""
        if not text:
            return b""
        found = _LONG.search(text) if len(text) >= LONG_RUN else None
        if not found:
            return np.array(self.bpe.encode_ordinary(text), self.width).tobytes()
        out, at = [], 0
        while found:
            end = found.end() - (found.end() < len(text))
            out += [*self.bpe.encode_ordinary(text[at : found.start()]), *self.single.encode_ordinary(text[found.start() : end])]
            at, found = end, _LONG.search(text, found.end())
        return np.array([*out, *self.bpe.encode_ordinary(text[at:])], self.width).tobytes()

    def segments(self, text: str) -> list[str]:
        """Ordinary texts and, at odd places, special tokens."""
        return self.cut_special.split(text) if self.cut_special else [text]

    def _with_special(self, segments: list[str], packed: list[bytes]) -> bytes:
        special = lambda s: np.array([self.special[s]], self.width).tobytes()
        return b"".join(special(s) if i % 2 else packed[i // 2] for i, s in enumerate(segments))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts, without chunks."""
        parts = [self.segments(t) for t in texts]
        return [self._with_special(p, [self.raw(s) for s in p[::2]]) for p in parts]

    def cuts(self, raw: bytes) -> list[int]:
        """Ends of the content-defined chunks of a text, never inside a character."""
        b = np.frombuffer(raw, np.uint8)
        if len(b) <= 2 * WINDOW:
            return [len(b)]
        total = np.cumsum(self.gear[b])
        rolling = (total[WINDOW:] - total[:-WINDOW]) * np.uint64(0x9E3779B97F4A7C15)
        at = np.flatnonzero((rolling >> np.uint64(40)) & np.uint64(MASK) == 0) + WINDOW
        return [*at[(b[at] & 0xC0) != 0x80].tolist(), len(b)]

    def chunk(self, raw: bytes) -> tuple[str, list[str], bytes, str]:
        """Text before the first certain break, the body's first word, the text between and its last word, the body's packed
        ids, and text after the last break; no words if there is no body."""
        text = raw.decode("utf-8", "surrogatepass")
        first = _BREAK.search(text)
        if not first:
            return text, [], b"", ""
        last = text.rfind(" ")
        while last > first.start() and not (last + 1 < len(text) and not text[last + 1].isspace() and not text[last - 1].isspace()):
            last = text.rfind(" ", 0, last)
        if last == first.start():
            return text, [], b"", ""
        body = text[first.start() + 1 : last]
        words = _BREAK.split(body)
        if len(words) > 2:
            words = [words[0], " ".join(words[1:-1]), words[-1]]
        return text[: first.start()], words, self.raw(" " + body), text[last:]

    def known_chunk(self, raw: bytes) -> tuple[str, list[str], bytes, str]:
        """A chunk as it is kept from before, or is kept from now on."""
        found = self.chunks.get(raw)
        if found is None:
            found = self.old_chunks.get(raw) or self.chunk(raw)
            cost = 2 * len(raw) + len(found[2]) + CHUNK_COST
            if self.held + cost > CACHE_BYTES:
                self.old_chunks, self.chunks, self.held = self.chunks, {}, 0
            self.held += cost
            self.chunks[raw] = found
        return found

    def encode_chunked(self, text: str) -> bytes:
        """Packed ids of a whole text from reused chunks and repaired joins."""
        parts = self.segments(text)
        return self._with_special(parts, [self._chunked(s) for s in parts[::2]])

    def _chunked(self, text: str) -> bytes:
        raw, at = text.encode("utf-8", "surrogatepass"), 0
        done: list[tuple] = []  # of each body so far: the join before it, that join's ids, the body's words and ids
        join = ""
        for end in self.cuts(raw):
            head, words, body, tail = self.known_chunk(raw[at:end])
            at = end
            join += head
            if words:
                repaired = self._repaired(done, join, words[0])
                if repaired is None:
                    join = f"{self._taken_in(done, join)} {' '.join(words)}{tail}"
                else:
                    done.append((join, repaired, words, body))
                    join = tail
        while (repaired := self._repaired(done, join, None)) is None:
            join = self._taken_in(done, join)
        return b"".join([x for _, before, _, body in done for x in (before, body)] + [repaired])

    @staticmethod
    def _taken_in(done: list[tuple], join: str) -> str:
        """The join with the body before it and the join before that."""
        if not done:
            return join
        before, _, words, _ = done.pop()
        return f"{before} {' '.join(words)}{join}"

    def _repaired(self, done: list[tuple], join: str, lead: str | None) -> bytes | None:
        """Packed ids of a join encoded together with the words on its sides, without theirs; None if these come out otherwise."""
        trail = done[-1][2][-1] if done else None
        left, right = (self.raw(f" {w}") if w is not None else b"" for w in (trail, lead))
        packed = self.raw((f" {trail}" if done else "") + join + (f" {lead}" if lead is not None else ""))
        agree = len(packed) >= len(left) + len(right) and packed.startswith(left) and packed.endswith(right)
        return packed[len(left) : len(packed) - len(right)] if agree else None

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.width)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(2)
def codec(spec: str) -> Codec:
    return Codec(spec)


def broadcast_spec(spark: SparkSession, path: str):
    """The tokenizer file's text for the executors: of fixed size, and they need no such file of their own."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


#: What transcode() can return beside the id, with its type.
COLUMNS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


@operator
def transcode(df: DataFrame, tokenizer: str, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode its ids again; returns id_col and the columns asked for, one row a row.

    tokenizer: path of a byte-level BPE file of the tokenizers library; special tokens are found in texts but none are
    added. Each row stands alone, so no shuffle. Defined cases: null text counts as empty and has no ids; repeated rows
    and null ids give a row each; other columns are not read; an empty table gives no rows.
    """
    spec = broadcast_spec(df.sparkSession, tokenizer)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(spec.value)
        make = {
            "n_tokens": lambda ids, text: len(ids),
            "ids": lambda ids, text: ids.astype(np.int32),
            "ids_sha256": lambda ids, text: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
            "decoded": lambda ids, text: text,
            "decoded_sha256": lambda ids, text: hashlib.sha256(text.encode()).hexdigest(),
        }
        decodes = any(x.startswith("decoded") for x in columns)
        types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        for b in batches:
            out = {x: [] for x in columns}
            for text in b.column(1).to_pylist():
                ids = c.ids(c.encode_chunked(text or ""))
                back = c.decode(ids) if decodes else ""
                for x in columns:
                    out[x].append(make[x](ids, back))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[x], types.get(x, pa.string())) for x in columns)], [id_col, *columns])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{x} {COLUMNS[x]}" for x in columns)]))
