"""Compression, fill-in-middle and reply trees against brute force and exact round trips."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import reply_trees
from lumenfold.llm.block_codes import block_codes, nearest_entries, whole
from lumenfold.llm.fill_middle import fill_in_middle, restore
from lumenfold.llm.reply_trees import chain, format_replies, format_turns, parse_turns, read_back, unescape

NAN, INF = float("nan"), float("inf")


# ---- compression


@pytest.mark.parametrize("spread", [2.0, 300.0, 2.0**40, 1e300])
@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 8])
def test_nearest_entries_are_those_of_a_scan(spread, width):
    r = np.random.default_rng(width)
    x, c = whole(r.normal(size=(300, width)) * spread, 1.0), whole(r.normal(size=(40, width)) * spread, 1.0)
    c[7], x[5] = c[3], c[7]
    index, least, exact = nearest_entries(x, c)
    for i, row in enumerate(x):
        d = [sum((int(a) - int(b)) ** 2 for a, b in zip(row, e, strict=True)) for e in c]
        assert (int(least[i]), index[i]) == (min(d), d.index(min(d)))
    assert width < 4 or spread > 1e200 or exact < 300 * 40 * 0.7


def brute_codes(rows, parts=16, entries=64, rounds=2):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = next((len(v) for _, _, v in good if v and len(v) % parts == 0), 0)
    odd, good = [g for g in good if len(g[2]) != dim or not dim], [g for g in good if dim and len(g[2]) == dim]
    w = dim // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, _, v in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((dist(c[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [c[p] for c, n in zip(cut, near, strict=True) if n[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], {}
    for (i, label, _), n in zip(good, assign(), strict=True):
        e = sum(d for d, _ in n)
        total[label] = total.get(label, 0) + e
        out.append((i, "".join(f"{j:02x}" for _, j in n), e, label))
    return sorted([(i, c, e, total[label], sha) for i, c, e, label in out] + [(i, None, None, total.get(label), sha) for i, label, _ in odd], key=repr)


def test_codes_match_brute_force(spark):
    r = np.random.default_rng(7)
    v = (r.normal(size=(150, 32)) * r.choice([0.1, 1, 5], (150, 1))).tolist()
    rows = [(i * 3, x, [0, 0, 0, 1, None][i % 5]) for i, x in enumerate(v)]
    rows += [rows[4], rows[4], (12, v[40], 1), (None, v[9], 1), (9000, None, 1), (9001, [NAN, *v[0][1:]], 0), (9002, [None, *v[0][1:]], 0), (9003, [-INF, *v[0][1:]], 0), (9004, [], 0), (9005, v[0][:16], None), (9006, [1.0], 1)]
    df = spark.createDataFrame([(*row, "x", 5) for row in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    got = sorted(map(tuple, block_codes(df).collect()), key=repr)
    assert got == brute_codes(rows)


def test_few_empty_and_wide_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert block_codes(frame([])).count() == 0
    rows = [(i, [float(i + j) for j in range(16)], "a") for i in range(3)]
    assert sorted(map(tuple, block_codes(frame(rows)).collect()), key=repr) == brute_codes(rows)
    wide = [(i, [1e30 * (i + 1) ** 2 + j for j in range(16)], "a") for i in range(70)] + [(99, [float(2**33 + j) for j in range(16)], "b")]
    want = [(i, c, e if e < 1 << 63 else None, t if t < 1 << 63 else None, sha) for i, c, e, t, sha in brute_codes(wide)]
    got = sorted(map(tuple, block_codes(frame(wide)).collect()), key=repr)
    nulled = {i for i, _, e, _, _ in want if e is None}
    assert nulled and got == sorted([(i, c, e, None if i != 99 else t, sha) for i, c, e, t, sha in want], key=repr)


# ---- fill in the middle


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_middles_match_brute_force(spark):
    r = np.random.default_rng(3)
    signs = ["a", "Zb", " ", "\n", "\r\n", "\x01", "\x02", "\x03", "\x04", "\x01\x03", "é", "😀", "é", "$1", "\\", "<P", "<", "S>", "\x00", "7", "|"]
    texts = ["".join(r.choice(signs, r.integers(0, 30))) for _ in range(400)] + [None, "", "x <P> y", "<S>", "a<M>", "word" * 50_000 + " é" * 20_000, "\x02" * 3000]
    rows = [(i, t, "x", 1, 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 1, 1), (3, texts[3], "x", 1, 1), (3, "another text", "x", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int, _n int")
    out = fill_in_middle(df)
    got = out.withColumn("restored", restore(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(g[:6]) for g in got), key=repr) == sorted((brute_middle(i, t) for i, t, *_ in rows), key=repr)
    assert sorted(((g["doc_id"], g["restored"]) for g in got), key=repr) == sorted(((i, t or "") for i, t, *_ in rows), key=repr)
    assert {g["form"] for g in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).count() == 0


def test_middles_are_sql_alone(spark):
    plan = fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# ---- reply trees

ODD = ["", "\\", "\\s", "\\\\h", "###", "#####", "### user: x</turn>\n", "</turn>", "</turn</turn>\n", "a: b", "\n", "😀é", "<", "</turn"]


def test_formats_read_back_to_the_same_turns():
    for a in ODD:
        for b in ODD:
            turns = [(b, a), ("assistant", a + b), ("assistant", b), (a, b)]
            formatted, spans = format_turns(turns)
            assert parse_turns(formatted) == turns
            learned = [t for r, t in turns if r == "assistant"]
            assert [unescape(formatted[s["start"] : s["start"] + s["length"]]) for s in spans] == learned


def brute_paths(rows, best):
    """(tree, leaf, turns, mean score) of the chosen paths of (tree, id, parent, role, text, score) rows."""
    out = []
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in sorted((r for r in rows if r[0] == tree and r[1] is not None), key=lambda r: -r[5])}
        parents = {r[2] for r in own.values()}
        leaves = []
        for leaf in own.keys() - parents:
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][2]
            if at not in path:
                leaves.append((-sum(own[i][5] for i in path) / len(path), leaf, [(own[i][3], own[i][4]) for i in path[::-1]]))
        out += [(tree, leaf, turns) for _, leaf, turns in sorted(leaves)[:best]]
    return sorted(out, key=repr)


def grown(seed, n, hot=0.3):
    """Random trees; tree 0 has a third of the messages, a null tree, orphans and a circle."""
    r = np.random.default_rng(seed)
    rows, ids = [], {}
    for i in range(n):
        tree = None if r.random() < 0.05 else int(r.integers(0, 20)) * (r.random() > hot)
        have = ids.setdefault(tree, [])
        parent = None if not have or r.random() < 0.05 else int(10_000 if r.random() < 0.02 else r.choice(have[-5:] + have[:1]))
        rows.append((tree, i, parent, ["user", "assistant", "tool: x"][int(r.integers(0, 3))], ODD[i % len(ODD)] + str(i), float(r.integers(0, 4))))
        have.append(i)
    return [*rows, (1, 20_000, 20_001, "user", "c", 1.0), (1, 20_001, 20_000, "user", "d", 1.0), (1, 20_002, 20_001, "user", "e", 9.0), (2, None, None, "user", "no id", 1.0)]


@pytest.mark.parametrize(("best", "limit"), [(None, 1 << 16), (2, 1 << 16), (1, 30), (None, 30)])
def test_paths_match_brute_force(spark, monkeypatch, best, limit):
    monkeypatch.setattr(reply_trees, "TREE_ROWS", limit)
    rows = grown(best or 9, 500)
    df = spark.createDataFrame([(*row, 1, "x") for row in rows + rows[:40]], "tree long, id long, parent long, role string, text string, score double, rank int, formatted string")
    got = format_replies(df, best=best, score_col="score").collect()
    want = brute_paths(rows, best)
    assert sorted(((g["tree"], g["leaf"], parse_turns(g["formatted"])) for g in got), key=repr) == want
    assert best is None or {g["rank"] for g in got} == set(range(1, best + 1))


def test_deep_chain_and_odd_conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(1000)]
    rows += [(2, None, "user", "last"), (2, 1, None, None), (2, 1, "assistant", "same turn"), (2, 1, "assistant", "same turn"), (None, 0, "assistant", "</turn>"), (3, 0, "", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    got = {r["tree"]: r for r in read_back(format_replies(*chain(df))).collect()}
    sha = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["n_turns"] == 1000 and got[1]["turns_sha256"] == sha([(r, t) for c, _, r, t in rows if c == 1])
    assert got[1]["loss_sha256"] == hashlib.sha256("".join(f"t{i}" for i in range(1, 1000, 2)).encode()).hexdigest()
    assert got[2]["turns_sha256"] == sha([("", ""), ("assistant", "same turn"), ("user", "last")]) and got[2]["loss_chars"] == 9
    assert got[None]["loss_chars"] == 7 and got[3]["n_turns"] == 1
    assert format_replies(*chain(df.limit(0))).count() == 0
