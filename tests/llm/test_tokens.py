import collections
import hashlib
import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm.bpe import Codec, transcode
from lumenfold.llm.packing import pack, round_robin, tail_lengths

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return Codec(f.read())


PARTS = [" ", "  ", "\n", "\t", " \n", " ", "　", "\x1c", "'s", "'ll", "a", "The", "é", "ß", "漢字", "123", "!!", "...", "<|endoftext|>", "🙂", "x" * 40, "ab cd", "\r\n", "don't", "word " * 30]


@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6)), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_library_s(codec, parts):
    text = "".join(parts)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert codec.ids(codec.encode_chunked(text)).tolist() == want
    assert codec.ids(codec.encode_batch([text, "", text])[2]).tolist() == want
    assert codec.decode(np.array(want, np.uint16)) == LIBRARY.decode(want, skip_special_tokens=False)


def test_chunks_are_shared_and_caches_stay_bounded(codec):
    passage = " ".join(f"w{i}x" for i in range(400))
    codec.encode_chunked("one " + passage)
    known = len(codec.chunks)
    codec.encode_chunked("quite another start " + passage)
    assert len(codec.chunks) - known < 6
    import lumenfold.llm.bpe as m

    full, m.CACHE_BYTES = m.CACHE_BYTES, 200
    try:
        text = " ".join(f"q{i}" for i in range(500))
        assert codec.ids(codec.encode_chunked(text)).tolist() == codec.ids(codec.encode_batch([text])[0]).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    finally:
        m.CACHE_BYTES = full


ODD = [(1, "Hello  world<|endoftext|> x", "a"), (2, None, "a"), (3, "", None), (3, "same id", None), (None, "no id", ""), (5, "z " * 9000, "hot"), (6, "z " * 9000, "hot"), (7, "y" * 5000, "a")]


def documents(spark, rows=ODD):
    return spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, source string, n long, part long")


def test_transcode_defined_cases(spark):
    rows = transcode(documents(spark), PATH, ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(rows) == len(ODD)
    by_text = collections.Counter((r["doc_id"], r["decoded"]) for r in rows)
    assert by_text == collections.Counter((i, t or "") for i, t, _ in ODD)
    for r in rows:
        ids = np.array(LIBRARY.encode(r["decoded"], add_special_tokens=False).ids, "<u4")
        assert r["ids"] == ids.tolist() and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert transcode(documents(spark).filter("false"), PATH).count() == 0


def check_pieces(rows, docs, length):
    want = collections.Counter()
    for _, t, _ in docs:
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[len(ids)] += 1
    got = collections.defaultdict(list)
    for r in rows:
        got[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in got.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))]
        total = sum(n for _, n in s)
        assert total == length or total & (total - 1) == 0
    assert sum(r["length"] for r in rows) == sum(n * c for n, c in want.items())


def test_pieces_are_whole_and_right(spark):
    r = random.Random(2)
    docs = ODD + [(100 + i, " ".join(r.choice(["ba", "do", "fi"]) for _ in range(r.randrange(1, 900))), r.choice(["hot", "hot", "a", "b", None])) for i in range(150)]
    rows = pack(documents(spark, docs), PATH, length=64, part_tokens=9000).collect()
    check_pieces(rows, docs, 64)
    texts = {i: t for i, t, _ in docs if i and i >= 100}
    by_doc = collections.defaultdict(list)
    for x in rows:
        if x["doc_id"] in texts:
            by_doc[x["doc_id"]].append(x)
    for i, t in texts.items():
        ids = np.array([*LIBRARY.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for x in sorted(by_doc[i], key=lambda x: x["start"]):
            assert x["start"] == at and x["doc_tokens"] == len(ids) and x["ids_crc32"] == zlib.crc32(ids[at : at + x["length"]].tobytes())
            at += x["length"]
        assert at == len(ids)
    assert pack(documents(spark).filter("false"), PATH).count() == 0


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=8), st.integers(1, 700))
@settings(max_examples=200, deadline=None)
def test_round_robin_sends_all_in_share(have, window):
    have = np.array(have)
    share = have / max(1, have.sum())
    sent = round_robin(have, share, np.zeros(len(have)), window)
    assert (sent >= 0).all() and sent.sum(axis=0).tolist() == have.tolist()
    assert all(x == window for x in sent.sum(axis=1)[:-1])
    if len(sent):
        ahead = sent.cumsum(axis=0) - np.outer(np.minimum(np.arange(1, len(sent) + 1) * window, have.sum()), share)
        assert np.abs(ahead).max() <= len(have) + 1


def test_deficits_carry():
    first = round_robin(np.array([100, 100]), np.array([0.5, 0.5]), np.array([30.0, -30.0]), 100)
    assert first[0].tolist() == [80, 20]


def test_weights_order_the_windows(spark):
    docs = [(i, "ba " * 200, "ab"[i % 2]) for i in range(60)]
    rows = pack(documents(spark, docs), PATH, length=32, weights={"a": 3, "b": 1}, part_tokens=1 << 30).collect()
    early = [x for x in rows if x["sequence_id"] < 64]
    share = sum(x["length"] for x in early if x["doc_id"] % 2 == 0) / sum(x["length"] for x in early)
    assert 0.7 < share < 0.8
    check_pieces(rows, docs, 32)


def test_every_window_of_many_parts_is_at_its_targets(spark):
    docs = [(i, "ba " * 200, "ab"[i % 2]) for i in range(120)] + [(500 + i, "do " * 40, None) for i in range(6)]
    length, part_tokens = 32, 1500
    rows = pack(documents(spark, docs), PATH, length=length, weights={"a": 3, "b": 1, "absent": 5}, part_tokens=part_tokens).collect()
    check_pieces(rows, docs, length)
    n = collections.Counter()
    for x in rows:
        n["ab"[x["doc_id"] % 2] if x["doc_id"] < 500 else "rest"] += x["length"]
    parts = -(-sum(n.values()) // part_tokens)
    mixed = n["a"] / 0.75 / (sum(n.values()) / parts)  # parts until the wanted mixture runs out
    windows = collections.defaultdict(collections.Counter)
    for x in rows:
        windows[x["sequence_id"] >> 32, (x["sequence_id"] & 0xFFFFFFFF) // 32]["ab"[x["doc_id"] % 2] if x["doc_id"] < 500 else "rest"] += x["length"]
    assert len({p for p, _ in windows}) == parts > 12
    for (part, _), c in windows.items():
        if part + 1 <= mixed:
            assert abs(c["a"] - 0.75 * sum(c.values())) <= 3 and not c["rest"]
    last = (n["a"] + n["b"]) / (sum(n.values()) / parts)
    assert all(not c["rest"] for (part, _), c in windows.items() if part + 1 <= last)


def test_more_parts_than_a_source_has_tokens(spark):
    docs = [(i, "ba " * 300, "a") for i in range(40)] + [(900, "do", "tiny"), (901, None, "tiny")]
    for weights in (None, {"tiny": 1, "a": 1}):
        check_pieces(pack(documents(spark, docs), PATH, length=16, weights=weights, part_tokens=200).collect(), docs, 16)


LONG_RUNS = [" " * 1_300_000, "\n" * 1_200_000 + "x", "a" + "\t" * 1_100_000 + "b c d", "x y" + " \n" * 4000 + "z"]


def test_long_runs_of_white_space(spark):
    docs = [(i, t, "s") for i, t in enumerate(LONG_RUNS)]
    want = {i: LIBRARY.encode(t, add_special_tokens=False).ids for i, t, _ in docs}
    for r in transcode(documents(spark, docs), PATH, ("ids", "decoded")).collect():
        assert r["ids"] == want[r["doc_id"]] and r["decoded"] == LONG_RUNS[r["doc_id"]]
    assert sum(x["length"] for x in pack(documents(spark, docs), PATH).collect()) == sum(len(x) + 1 for x in want.values())


def test_joins_take_in_bodies_until_tokens_agree():
    c = Codec(Path(PATH).read_text(encoding="utf-8"))
    text = " ".join(f"word{i} again" for i in range(2000))
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert c.ids(c.encode_chunked(text)).tolist() == want
    for key, (head, words, body, tail) in list(c.chunks.items())[::3]:  # words that are said to come out otherwise
        if len(words) > 2:
            c.chunks[key] = (head, [*words[:-2], f"{words[-2]} {words[-1]}"], body, tail)
    assert c.ids(c.encode_chunked(text)).tolist() == want


def test_other_kinds_of_tokenizer_files_are_refused():
    spec = json.loads(Path(PATH).read_text(encoding="utf-8"))
    spec["normalizer"] = {"type": "NFC"}
    with pytest.raises(ValueError):
        Codec(json.dumps(spec))


def test_tails_are_powers_of_two():
    assert tail_lengths(2048 * 2 + 11, 2048).tolist() == [2048, 2048, 8, 2, 1]


def test_other_merges_are_refused():
    import json

    import public_tokenizers

    from lumenfold.llm.bpe import Codec

    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    merges = spec["model"]["merges"]
    for other in ([*merges[1:], merges[0]], merges[:-1], [*merges, merges[0]]):
        spec["model"]["merges"] = other
        with pytest.raises(ValueError):
            Codec(json.dumps(spec))
    spec["model"]["merges"] = [" ".join(m) if isinstance(m, list) else m.split(" ") for m in merges]
    assert Codec(json.dumps(spec)).bytes_of
