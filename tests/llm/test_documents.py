import collections
import random
import re
import zlib

import numpy as np
import pytest

from lumenfold.llm.components import connected_components
from lumenfold.llm.jump_shard import shard_rows
from lumenfold.llm.shingle_join import differing, similar_documents, size_classes
from lumenfold.llm.suffix_repeats import remove_repeats


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, sid int, key string, doc int")


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_follow_the_published_algorithm(spark):
    rows = [(i, f"t{i}") for i in range(2000)] + [(-5, None), (2**62, "é"), (7, "t7"), (None, "x"), (-(2**63), "")]
    got = shard_rows(frame(spark, rows), 24).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"] % 2**64, 24), jump(r["doc_id"] % 2**64, 25))
        assert r["grown_shard"] in (r["shard"], 24) or r["doc_id"] is None
    text = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == text
    for s in range(24):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shard_rows(frame(spark, rows).filter("false"), 24).count() == 0
    with pytest.raises(ValueError):
        shard_rows(frame(spark, rows), 0)


def words_of(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def near_copies(seed):
    r = random.Random(seed)
    docs = []
    for _ in range(40):
        base = words_of(r, r.choice([1, 2, 3, 5, 9, 14, 40, 120, 300])).split(" ")
        docs.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 20))):
                w[r.randrange(len(w))] = f"w{r.randrange(400)}"
            docs.append((" " if r.random() < 0.5 else "\t\n ").join(w).upper() if r.random() < 0.5 else " ".join(w))
    hot = words_of(r, 60)
    docs += [f"{hot} {words_of(r, r.choice([3, 8, 60]))}" for _ in range(60)]
    rows = [(i * 3 - 20, t) for i, t in enumerate(docs)]
    r.shuffle(rows)
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (9004, "Two words"), (9005, "two WORDS"), (9006, "É x y z"), (9007, "é x y z"), (None, "w1 w2 w3")]


def linked(rows, k, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k, percent, seed", [(3, 90, 1), (5, 80, 2), (1, 60, 3)])
def test_join_matches_brute_force(spark, monkeypatch, k, percent, seed):
    import lumenfold.llm.shingle_join as m

    for name, v in (("GROUP", 3), ("OTHERS", 4), ("ASKING", 3), ("BUFFER", 4000), ("COUNTED", 5)):
        monkeypatch.setattr(m, name, v)
    rows = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(frame(spark, rows), k, percent).collect()}
    assert got == linked(rows, k, percent)


def test_join_without_links_and_with_repeated_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "e f g h"), (3, "a b c d")]
    assert {(r["doc_id"], r["component_id"]) for r in similar_documents(frame(spark, rows)).collect()} == {(1, 1), (2, 2), (3, 1)}
    assert similar_documents(frame(spark, rows).filter("false")).count() == 0


def test_classes_reach_every_partner():
    for percent in (60, 80, 90, 95):
        low = size_classes(percent, 5000).tolist()
        for n in range(1, 4000):
            own = max(i for i, x in enumerate(low) if x <= n)
            top = n * 100 // percent
            assert top < low[own + 2]
        assert differing(percent, 1) == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_pairs_across_class_ends_in_separate_buffers(spark, monkeypatch, percent):
    import lumenfold.llm.shingle_join as m

    monkeypatch.setattr(m, "BUFFER", 1)
    low = size_classes(percent, 1500).tolist()
    rows = []
    for end in [x for x in low if 80 < x < 1500]:
        base = [f"e{end}w{i}" for i in range(end + 5)]
        rows += [(2 * end, " ".join(base[: end - 3])), (2 * end + 1, " ".join(base))]
    want = linked(rows, 3, percent)
    assert all(c == i - i % 2 for i, (_, c) in want.items())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(frame(spark, rows), 3, percent).collect()}
    assert got == want
    assert all(size_classes(percent, n).tolist() == low[: len(size_classes(percent, n))] for n in range(1, 1500))


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(200, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: find(x) for x in root}


def without_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - length + 1):
            w = raw[j : j + length]
            if w in seen:
                gone[j : j + length] = True
            seen.add(w)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("seed, piece, buffer", [(1, 40_000, 1 << 19), (2, 3, 1 << 19), (3, 7, 300)])
def test_repeats_match_brute_force(spark, monkeypatch, seed, piece, buffer):
    import lumenfold.llm.suffix_repeats as m

    for name, v in (("BUFFER", buffer), ("COMBINE", 8 * buffer), ("MANY_FROM", 1 + seed)):
        monkeypatch.setattr(m, name, v)
    r = random.Random(seed)
    passages = [words_of(r, n) for n in (8, 20, 25, 40, 70)] + ["é" * 90, "ab" * 140, "x" * 230]
    rows = []
    for i in range(70):
        t = " ".join(r.choice([words_of(r, r.randrange(40)), r.choice(passages), r.choice(passages)[r.randrange(20) :]]) for _ in range(r.randrange(4)))
        rows.append((i * 2 - 30, t))
        if r.random() < 0.2:
            rows.append((i * 2 - 29, t))
    rows += [(5001, None), (5002, ""), (5003, "z" * 99), (5004, "z" * 3000), (None, passages[4])]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in remove_repeats(frame(spark, rows), piece=piece).collect()}
    assert got == without_repeats(rows)


def test_repeats_with_repeated_ids_and_empty_table(spark):
    rows = [(1, "q" * 150 + " tail"), (1, "p" * 20), (2, "other")]
    got = {x["doc_id"]: (x["n_bytes"], bytes(x["kept"])) for x in remove_repeats(frame(spark, rows), keep=("key",)).collect()}
    assert got == {1: (20, b"p" * 20), 2: (5, b"other")}
    assert remove_repeats(frame(spark, rows).filter("false")).count() == 0


def test_rows_that_share_an_id_or_have_none_stay_documents(spark):
    import corpus_pipeline

    r = random.Random(4)
    passage, near = words_of(r, 30), words_of(r, 200).split(" ")
    texts = [(1, f"{words_of(r, 40)} {passage}"), (1, f"{passage} {words_of(r, 40)}"), (1, words_of(r, 50)), (2, " ".join(near)), (3, " ".join([*near[:-1], "end"])), (3, words_of(r, 60)), (None, f"{words_of(r, 45)} {passage}"), (None, words_of(r, 70)), (None, words_of(r, 70)), (4, None)]
    rows = [*texts, texts[8]]  # a copy without an id
    docs = spark.createDataFrame([(i, t, "xx", f"s{n}", 0) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.materialize(corpus_pipeline.near_duplicates(spark, docs, ""), "test")
    left = kept.collect()
    assert collections.Counter((x["doc_id"], x["text"]) for x in left) == collections.Counter(t for t in texts if t[0] != 3 or t[1] == texts[5][1])
    out = {x["source"]: (x["doc_id"], x["text"]) for x in corpus_pipeline.repeated_strings(spark, kept, "").collect()}
    assert set(out) == {x["source"] for x in left}
    whole = [s for s in ("s0", "s1", "s6") if passage in out[s][1]]
    assert len(whole) == 1 and whole[0] in ("s0", "s1")  # the first of id 1; rows without an id come last
    assert all(len(out[s][1]) < len(texts[int(s[1:])][1]) - 90 for s in {"s0", "s1", "s6"} - set(whole))
    assert all(out[x["source"]] == (x["doc_id"], x["text"] or "") for x in left if x["source"] not in ("s0", "s1", "s6"))


def test_pipeline_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    syllables = {"xx": ["ka", "lo", "mi", "tu", "ra"], "yy": ["schö", "wer", "ung", "zei", "lich"]}
    text = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)) + "."
    rows = [(i, text("xy"[i % 2] * 2, 80), "xy"[i % 2] * 2, f"s{i % 3}") for i in range(120)]
    passage = text("xx", 60)
    rows += [(200, rows[10][1], "xx", "s0"), (201, rows[12][1].replace(" ka", " mi", 1), "xx", "s0"), (300, rows[20][1][:200] + passage, "xx", "s1"), (301, text("xx", 60) + " " + passage, "xx", "s1"), (400, "!!! 123 ...", "xx", "s1"), (401, None, "yy", "s2")]
    (tmp_path / "in").mkdir()
    path = str(tmp_path / "in")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, path), "test")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = {x["doc_id"]: x["text"] for x in docs.collect()}
    assert set(kept["language"]) == {x[0] for x in rows} - {400, 401}
    assert set(kept["language"]) - set(kept["near_duplicates"]) == {200, 201}
    assert passage in kept["repeated_strings"][300] and passage not in kept["repeated_strings"][301]
    assert all(kept["repeated_strings"][i] == kept["near_duplicates"][i] for i in range(120) if i != 20)
    pieces = corpus_pipeline.run(spark, path)
    n = collections.Counter()
    for x in pieces.collect():
        n[x["doc_id"]] += x["length"]
    assert set(n) == set(kept["repeated_strings"])


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    text = lambda: " ".join(r.choice(["kalo", "mitu", "rasa", "lomi"]) + r.choice(["", "ka", "tu"]) for _ in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, sid long, key string, score double, accepted string, lang_pred string"
    rest = (7, 8, "k", 0.5, "no", "zz")
    rows = [(i // 2, text(), "xx", "s", 1, *rest) for i in range(40)] + [(None, text(), "xx", None, 1, *rest), (5, None, None, None, None, *rest)]
    for name, own in (("full", rows), ("none", [])):
        path = str(tmp_path / name)
        spark.createDataFrame(own, schema).write.parquet(f"{path}/documents.parquet")
        pieces = corpus_pipeline.run(spark, path).collect()
        assert bool(pieces) == bool(own)
        if own:
            assert {x["doc_id"] for x in pieces} == {*range(20), None}


def test_the_shared_folder_has_the_scheme_that_spark_gives_it(spark, tmp_path):
    from lumenfold.llm.common import arrow_folder

    assert arrow_folder(spark, f"{tmp_path}/x") == f"file://{tmp_path}/x" == arrow_folder(spark, f"file:{tmp_path}/x") == arrow_folder(spark, f"file://{tmp_path}/x")
    assert arrow_folder(spark, "s3a://bucket/a/b") == "s3://bucket/a/b"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "file:///")
    try:
        assert arrow_folder(spark, "/shared/x") == "file:///shared/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_pipeline_matches_brute_force(spark, tmp_path):
    """Every stage after the language against a plain form of it, each on what the stage before kept, and the whole run."""
    import public_tokenizers
    import tokenizers

    import corpus_pipeline

    r = random.Random(31)
    parts = {"xx": ["ka", "lo", "mi", "tu", "ra"], "yy": ["schö", "wer", "ung", "zei", "lich"]}
    word = lambda lang: "".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4)))
    passages = [" ".join(word("xx") for _ in range(40)) for _ in range(3)]
    rows = []
    for i in range(150):
        lang = "xx" if i % 3 else "yy"
        words = [word(lang) for _ in range(r.choice([12, 40, 90]))]
        rows.append([i, words, lang])
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            copy = list(words)
            for _ in range(r.choice([0, 1, 3, len(words) // 8])):
                copy[r.randrange(len(copy))] = word(lang)
            rows.append([1000 + len(rows), copy, lang])
        if r.random() < 0.2:
            rows.append([1000 + len(rows), [word("xx") for _ in range(30)] + [r.choice(passages)] + [word("xx")], "xx"])
    table = [(i, " ".join(w), lang, f"s{i % 4}", 0) for i, w, lang in rows] + [(9001, "12 34 !", "xx", "s1", 7), (9002, None, "yy", "s2", 0)]
    path = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(table, schema).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    collected = lambda df: {x["doc_id"]: x["text"] for x in df.collect()}
    first = corpus_pipeline.materialize(corpus_pipeline.language(spark, docs, path), "test")
    kept = collected(first)
    assert len(kept) >= 0.97 * len(rows) and not {9001, 9002} & set(kept)
    second = corpus_pipeline.materialize(corpus_pipeline.near_duplicates(spark, first, path), "test")
    alone = {i for i, (_, root) in linked(list(kept.items()), 5, 80).items() if root == i}
    assert set(collected(second)) == alone and len(alone) < len(kept) - 20
    third = corpus_pipeline.materialize(corpus_pipeline.repeated_strings(spark, second, path), "test")
    clean = {i: x[3].decode() for i, x in without_repeats(list(collected(second).items())).items()}
    assert collected(third) == clean and any(len(clean[i]) < len(kept[i]) for i in clean)
    encode = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    ids = {i: np.array([*encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in clean.items()}
    pieces, at = corpus_pipeline.run(spark, path).collect(), collections.Counter()
    for x in sorted(pieces, key=lambda x: (x["doc_id"], x["start"])):
        own = ids[x["doc_id"]]
        assert x["start"] == at[x["doc_id"]] and x["ids_crc32"] == zlib.crc32(own[x["start"] : x["start"] + x["length"]].tobytes())
        at[x["doc_id"]] += x["length"]
    assert at == {i: len(x) for i, x in ids.items()}


def test_a_frequent_id_joins_through_its_first_set(spark):
    r = random.Random(4)
    rows = [(7, words_of(r, 30)) for _ in range(200)] + [(8, words_of(r, 30)), (None, words_of(r, 30))]
    rows += [(9, rows[150][1]), (10, rows[3][1] + " more")]
    got = {x["doc_id"]: x["component_id"] for x in similar_documents(frame(spark, rows)).collect()}
    assert got == {7: 7, 8: 8, 9: 7, 10: 7}
