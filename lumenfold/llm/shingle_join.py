"""Jaccard join of documents on word shingles with a token-group matrix, and the components of its links.

Exact. Equal sets are one set from the start. Candidates come from segments: the hash range is cut into as many segments
as two sets above the threshold can differ in tokens, one more, and some to spare; such sets agree in more segments than
are spare. A set has one key for each segment that is not empty, made of all its tokens there. Keys are met in one sorted
stream that counts how many sets hold each. A set then gives up as many of its most frequent keys as segments are spare
(empty ones come first): two sets above the threshold still share their rarest common key, while passages that many
documents have, which fill some segments by chance, bring no candidates.

Every set is compared with the set it shares most keys with, the head of its cluster. The links found give components.
Components, and what is left of each cluster besides large components, are cut into the groups of the matrix. A group
stores the union of its tokens with the members that hold each; a set that shares a key with a member of another
component asks for that group once; its overlap with the union bounds its overlap with every member, and only groups
where the bound qualifies are opened. Members of one component need no comparison, so a well linked class costs little;
sets that resemble each other but do not link meet by whole groups, not by pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, operator, release, with_row_ids
from .components import connected_components

#: Members of a matrix group, others that one task compares with a first set, asking sets that one task takes for a group;
#: and the tokens that any of these hold together (one larger set stands alone).
GROUP, OTHERS, ASKING, TOKENS = 256, 2048, 1024, 1 << 19
#: Bytes of text that are hashed at a time, and sets of one key up to which its frequency is counted (beyond, all are equally frequent).
BUFFER, COUNTED = 1 << 20, 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted different shingle hashes of many texts at a time."""

    def __init__(self, words: int):
        self.words = words
        self.table = np.random.default_rng(31).integers(1, 2**63, 256, dtype=np.uint64)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n >= len(self.power):
            size = max(n + 1, 2 * BUFFER)
            self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, _BASE, np.uint64)])
            self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, pow(_BASE, -1, 2**64), np.uint64)])

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' shingle hashes, one text after another, and where each text's begin (one more at the end)."""
        b = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        self._powers(len(b))
        begin = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        space = _SPACE[b]
        start = np.flatnonzero(~space & np.r_[True, space[:-1]])
        end = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        sums = np.r_[np.uint64(0), np.cumsum(self.table[b] * self.power[: len(b)])]
        word = _mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        first = np.searchsorted(start, begin)  # of each text's words
        count = np.diff(first)
        k = self.words
        doc = np.repeat(np.arange(len(texts)), count)
        whole = np.flatnonzero(np.arange(len(word)) - first[doc] <= count[doc] - k) if len(word) else np.zeros(0, np.int64)
        h = np.zeros(len(whole), np.uint64)
        for j in range(k):
            h = _mix(h * np.uint64(31) + word[whole + j])
        d = doc[whole]
        short = np.flatnonzero((count > 0) & (count < k))
        extra = np.zeros(len(short), np.uint64)
        for i, t in enumerate(short):
            x = np.array([7 + count[t]], np.uint64)
            for w in word[first[t] : first[t + 1]]:
                x = _mix(x * np.uint64(31) + w)
            extra[i] = x[0]
        h, d = np.r_[h, extra], np.r_[d, short]
        by = np.lexsort((h, d))
        h, d = h[by], d[by]
        new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
        h, d = h[new], d[new]
        return h, np.searchsorted(d, np.arange(len(texts) + 1))


def set_names(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of sets in 64 and 31 more bits, 0 for an empty one: too many for two of any number of sets to share one by chance."""
    n = np.diff(at)
    sid, tag = np.zeros(len(n), np.uint64), np.zeros(len(n), np.int32)
    full = np.flatnonzero(n)
    if len(full):
        a, b = np.add.reduceat(_mix(h, 1), at[full]), np.bitwise_xor.reduceat(_mix(h, 2), at[full])
        sid[full] = _mix(a + _mix(b + n[full].astype(np.uint64))) | np.uint64(1)
        tag[full] = _mix(b + _mix(a, 6), 7) >> np.uint64(33)
    return sid.view(np.int64), tag


def size_classes(percent: int, largest: int) -> np.ndarray:
    """Lower ends of classes of set sizes; two sets above the threshold lie in one class or in neighbours."""
    out = [1]
    while len(out) < 2 or out[-2] <= largest:  # two ends above the largest, so that no class depends on what else is there
        out.append(max(out[-1] + 1, -(-out[-1] * 3 // 2), -(-out[-1] * 100 // percent)))
    return np.array(out, np.int64)


def differing(percent: int, size: int) -> int:
    """The most tokens in which two sets of at most size tokens each differ if they reach the threshold."""
    return 2 * size * (100 - percent) // (100 + percent)


def spare(most: np.ndarray) -> np.ndarray:
    """Segments beyond most + 1: two sets above the threshold agree in more than so many."""
    return np.maximum(3, most // 3)


def keys_of(h: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment keys of sets; the set, 0 or 1 (own class or the next), and the number of most frequent keys to give up, of each.

    Empty segments count as the most frequent keys and are given up first; a set with more of them than are spare gives
    keys for those as well, and so meets the others of its kind."""
    n = np.diff(at)
    none = np.zeros(0, np.int64)
    if not len(h):
        return np.zeros(0, np.uint64), none, none, none
    low = size_classes(percent, int(n.max()))
    low = np.r_[low, low[-1] * 2]  # a class above all that are looked up
    most_of = np.array([differing(percent, int(x) - 1) for x in low[1:]])
    own = np.searchsorted(low, n, "right") - 1
    set_of = np.repeat(np.arange(len(n)), n)
    found = []
    for up in (0, 1):
        c = np.minimum(own + up, len(most_of) - 1)
        most = most_of[c]
        take = (n > 0) & (most > 0)
        if up:
            take &= n * 100 >= percent * low[c]
        if not take.any():
            continue
        m = most + 1 + spare(most)
        mine = take[set_of]
        token, of = h[mine], set_of[mine]
        segment = ((token >> np.uint64(32)) * m[of].astype(np.uint64)) >> np.uint64(32)
        change = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (segment[1:] != segment[:-1])])
        total = np.add.reduceat(_mix(token, 3), change)
        owner, segment = of[change], segment[change]
        drop = spare(most) - (m - np.bincount(owner, minlength=len(n)))
        for s in np.flatnonzero(take & (drop < 0)):  # too many empty segments
            empty = np.setdiff1d(np.arange(m[s]), segment[owner == s])
            found.append((_mix(_mix(empty.astype(np.uint64) + np.uint64(int(c[s]) << 32), 4), 5), np.full(len(empty), s), np.full(len(empty), up), np.full(len(empty), spare(most[s]))))
        drop = np.where(drop < 0, spare(most), drop)
        named = segment + (c[owner].astype(np.uint64) << np.uint64(32))
        found.append((_mix(total + _mix(named, 4)), owner, np.full(len(owner), up), drop[owner]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), none, none, none)


def _portions(b: pa.RecordBatch, column: int, buffer: int):
    """(positions, texts as bytes) of about buffer bytes at a time."""
    rows, texts, size = [], [], 0
    for i, t in enumerate(b.column(column).to_pylist()):
        raw = (t or "").encode("utf-8", "surrogatepass")
        rows.append(i)
        texts.append(raw)
        size += len(raw)
        if size >= buffer:
            yield np.array(rows), texts
            rows, texts, size = [], [], 0
    if rows:
        yield np.array(rows), texts


def _describe(words: int, buffer: int):
    def run(batches):
        s = Shingler(words)
        for b in batches:
            for rows, texts in _portions(b, 1, buffer):
                h, at = s.sets(texts)
                sid, tag = set_names(h, at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.diff(at)), pa.array(sid), pa.array(tag)], ["row", "n", "sid", "tag"])

    return run


#: info holds how many keys the set gives up (high half) and its tag with the class of the key (0 or 1) as the last bit.
_KEYS = "key long, sid long, info long"


def _emit_keys(words: int, percent: int, buffer: int):
    def run(batches):
        s = Shingler(words)
        for b in batches:
            for _, texts in _portions(b, 1, buffer):
                h, at = s.sets(texts)
                sid, tag = set_names(h, at)
                _, once = np.unique(np.stack([sid, tag.astype(np.int64)]), axis=1, return_index=True)  # copies within a buffer give their keys once
                mine = np.zeros(len(at) - 1, bool)
                mine[once] = True
                kept = h[np.repeat(mine, np.diff(at))]
                once = np.sort(once)
                n = np.diff(at)[once]
                key, owner, up, drop = keys_of(kept, np.r_[0, np.cumsum(n)].astype(np.int64), percent)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sid[once][owner]), pa.array(drop.astype(np.int64) << 32 | tag[once][owner].astype(np.int64) << 1 | up)], ["key", "sid", "info"])

    return run


def _counted(most: int):
    """Over rows sorted by (key, sid, info): the rows of keys that several sets hold, once each, with the number of sets, at most most."""

    def run(batches):
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        endless = None  # a key of most sets or more: its further rows go out at once

        def batch(cols, often):
            key, sid, info = cols
            tag, drop = (info & 0xFFFFFFFF).astype(np.uint32).view(np.int32), (info >> 32).astype(np.int32)
            return pa.RecordBatch.from_arrays([*map(pa.array, (key, sid, tag, drop)), pa.array(often.astype(np.int32))], ["key", "sid", "tag", "drop", "often"])

        def settled(cols):
            """Whole keys."""
            start = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            often = np.repeat(np.diff(np.r_[start, len(cols[0])]), np.diff(np.r_[start, len(cols[0])]))
            several = often > 1
            return batch([x[several] for x in cols], np.minimum(often[several], most))

        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(3)]
            if endless is not None and len(cols[0]):
                more = int(np.argmax(cols[0] != endless)) if (cols[0] != endless).any() else len(cols[0])
                yield batch([x[:more] for x in cols], np.full(more, most))
                cols = [x[more:] for x in cols]
                endless = endless if not len(cols[0]) else None
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])]
            cols = [x[new] for x in cols]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield settled([x[:last] for x in cols])
            held = [x[last:] for x in cols]
            if len(held[0]) >= most:
                endless = held[0][0]
                yield batch(held, np.full(len(held[0]), most))
                held = [x[:0] for x in held]
        if len(held[0]):
            yield settled(held)

    return run


def _repeated(batches):
    """Over rows sorted by (key, node): key, the first node of each repeated key, and every other node of it once."""
    key = first = last = None
    for b in batches:
        k, s = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(k):
            continue
        start = np.r_[key is None or k[0] != key, k[1:] != k[:-1]]
        head = np.maximum.accumulate(np.where(start, np.arange(len(k)), -1))
        firsts = np.where(head >= 0, s[np.maximum(head, 0)], first if first is not None else 0)
        other = ~start & (s != np.r_[last if last is not None else 0, s[:-1]])
        i = np.flatnonzero(other)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(k[i]), pa.array(firsts[i]), pa.array(s[i])], ["key", "first", "node"])
        key, first, last = k[-1], firsts[-1], s[-1]


def _sets(words: int, buffer: int):
    def run(batches):
        s = Shingler(words)
        for b in batches:
            for rows, texts in _portions(b, 1, buffer):
                h, at = s.sets(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([h[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "tokens"])

    return run


def _tokens(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _links(pairs) -> pa.Table:
    u, v = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted different tokens."""
    small, big = (a, b) if len(a) < len(b) else (b, a)
    if len(small) * 100 < percent * len(big):
        return False
    at = np.minimum(np.searchsorted(big, small), len(big) - 1)
    both = int((big[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _with_first(percent: int):
    def run(firsts: pa.Table, others: pa.Table) -> pa.Table:
        if not len(firsts) or not len(others):
            return _links([])
        f, a = firsts.column("first")[0].as_py(), _tokens(firsts.column("tokens"))[0]
        return _links([(f, s) for s, b in zip(others.column("node").to_pylist(), _tokens(others.column("tokens")), strict=True) if alike(a, b, percent)])

    return run


def _open_groups(percent: int):
    """One matrix group and the sets that ask for it: a link to each other component that has a similar member."""

    def run(members: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(members) or not len(asking):
            return _links([])
        ids, roots, sets = members.column("node").to_pylist(), members.column("root").to_numpy(), _tokens(members.column("tokens"))
        size = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        by = np.argsort(flat, kind="stable")
        holder = np.repeat(np.arange(len(sets)), size)[by]
        union, start = np.unique(flat[by], return_index=True)
        count = np.diff(np.r_[start, len(flat)])
        found = []
        for s, r, q in zip(asking.column("node").to_pylist(), asking.column("root").to_pylist(), _tokens(asking.column("tokens")), strict=True):
            at = np.minimum(np.searchsorted(union, q), len(union) - 1)
            at = at[union[at] == q]
            least = max(int(size.min()), -(-percent * len(q) // 100))
            if (100 + percent) * len(at) < percent * (len(q) + least):
                continue
            n = count[at]
            places = np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(holder[places], minlength=len(sets))
            like = np.flatnonzero(((100 + percent) * both >= percent * (len(q) + size)) & (roots != r))
            found += [(s, ids[i]) for i in like[np.unique(roots[like], return_index=True)[1]]]
        return _links(found)

    return run


def _split(by: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(by), F.greatest(n, F.lit(1))).cast("int")


def _parts(most: int) -> Column:
    """Into how many parts the rows of a group go, by their number and their tokens n."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(most)), F.ceil(F.sum("n") / F.lit(TOKENS))).cast("int").alias("parts")


@operator
def similar_documents(df: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id that links reach) of every document.

    Words are runs without ASCII white space, A-Z in lower case; a set holds the different shingles of words words, or
    the whole sequence where a text has fewer. Two documents link when 100 * intersection >= percent * union. Ids are
    read as longs. Defined cases: null and empty texts, and texts without words, have empty sets and link with nothing;
    rows with a null id are left out; rows that share an id and a text are one document, rows that share an id alone take
    part each and join through the id; other columns are not read; an empty table gives no rows.
    """
    asked = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    numbered = with_row_ids(asked, "doc", "text", "row")
    several = hasattr(numbered, "stored_at")  # rows that share an id have numbers of their own
    named = numbered.select("row", "text")
    rows = materialize(named.mapInArrow(_describe(words, BUFFER), "row long, n long, sid long, tag int"), "join-rows")
    # a set's node is the smallest row that has it
    nodes = materialize(rows.filter("n > 0").groupBy("sid", "tag").agg(F.min("row").alias("node"), F.first("n").alias("n")), "join-nodes")
    emitted = named.mapInArrow(_emit_keys(words, percent, BUFFER), _KEYS)
    counted = materialize(emitted.repartition("key").sortWithinPartitions("key", "sid", "info").mapInArrow(_counted(COUNTED), "key long, sid long, tag int, drop int, often int"), "join-counted")
    rank = F.row_number().over(Window.partitionBy("sid", "tag").orderBy(F.col("often").desc(), "key"))
    rare = counted.withColumn("rank", rank).filter(F.col("rank") > F.col("drop")).select("key", "sid", F.shiftrightunsigned(F.col("tag"), 1).alias("tag"))
    rare = rare.hint("merge").join(nodes.select("sid", "tag", "node"), ["sid", "tag"]).select("key", "node")
    shared = materialize(rare.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_repeated, "key long, first long, node long"), "join-keys")
    release(counted)
    ends = shared.select(F.col("first").alias("node")).unionByName(shared.select("node")).distinct()
    # what grows with the table is never broadcast: joins whose strategy depends on the size read the texts otherwise at each size
    sets = named.hint("merge").join(ends.withColumnRenamed("node", "row"), "row", "left_semi").mapInArrow(_sets(words, BUFFER), "node long, tokens binary")
    sets = materialize(sets, "join-sets")
    chosen = materialize(sets.select("node", F.expr("cast(octet_length(tokens) / 8 as long)").alias("n")), "join-chosen")

    # each set with the first set that it shares most keys with: the head of its cluster
    votes = shared.groupBy("node", "first").agg(F.count(F.lit(1)).alias("n"))
    best = materialize(votes.groupBy("node").agg(F.max_by("first", F.struct("n", "first")).alias("first")), "join-best")
    spread = best.join(chosen, "node").groupBy("first").agg(_parts(OTHERS))
    others = best.join(spread, "first").withColumn("part", _split(F.col("node"), F.col("parts"))).select("first", "part", "node")
    others = others.hint("merge").join(sets, "node").select("first", "part", "node", "tokens")
    heads = spread.hint("merge").join(sets.withColumnRenamed("node", "first"), "first").select("first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tokens")
    links = materialize(fresh(heads).groupBy("first", "part").cogroup(fresh(others).groupBy("first", "part")).applyInArrow(_with_first(percent), "u long, v long"), "join-links")
    linked = connected_components(links, "join-components")

    # the matrix: groups, and the sets that share a key with a member of another component
    member = materialize(_grouped(chosen, linked, best), "join-groups")
    release(linked)
    on_keys = shared.select("key", F.col("first").alias("node")).distinct().unionByName(shared.select("key", "node")).hint("merge").join(member, "node")
    mixed = on_keys.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") != F.col("high")).select("key")
    open_keys = materialize(on_keys.hint("merge").join(mixed, "key", "left_semi"), "join-open")
    group, to = ("whole", "name", "part"), ("to_whole", "to_name", "to_part")
    groups = open_keys.select("key", *(F.col(x).alias(y) for x, y in zip(group, to, strict=True))).distinct()
    # of two groups one asks, and a set does not ask for its own component
    asked = open_keys.hint("merge").join(groups, "key").filter((F.struct(*group) <= F.struct(*to)) & ~((F.col("to_whole") == 1) & (F.col("to_name") == F.col("root"))))
    asked = materialize(asked.select("node", "n", "root", *to).distinct(), "join-asked")
    release(open_keys)
    loads = materialize(asked.groupBy(*to).agg(_parts(ASKING)), "join-loads")
    by = [*to, "turn"]
    queries = asked.hint("merge").join(loads, [*to]).withColumn("turn", _split(F.col("node"), F.col("parts"))).join(sets, "node").select(*by, "node", "root", "tokens")
    members = member.select("node", "root", *(F.col(x).alias(y) for x, y in zip(group, to, strict=True))).join(loads, [*to])
    matrix = members.hint("merge").join(sets, "node").select(*to, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("turn"), "node", "root", "tokens")
    more = fresh(matrix).groupBy(*by).cogroup(fresh(queries).groupBy(*by)).applyInArrow(_open_groups(percent), "u long, v long")

    # components over sets, whose nodes are rows: the smallest node of a component is its smallest row
    edges = links.unionByName(more)
    if several:
        of_rows = rows.filter("n > 0").join(nodes.drop("n"), ["sid", "tag"]).join(numbered.select("row", "doc"), "row")
        # one edge for each different set of an id to its first; a frequent id's sets are many rows of a join that is split
        of_ids = of_rows.select("doc", F.col("node").alias("v")).distinct()
        edges = edges.unionByName(of_ids.hint("merge").join(of_rows.groupBy("doc").agg(F.min("node").alias("u")), "doc").select("u", "v"))
    whole = connected_components(edges, "join-components")
    release(shared, sets, chosen, best, links, member, asked, loads)
    named_sets = nodes.select("sid", "tag", "node").hint("merge").join(whole, "node", "left").select("sid", "tag", F.coalesce("root", "node").alias("root"))
    placed = rows.hint("merge").join(named_sets, ["sid", "tag"], "left").select("row", "n", F.coalesce("root", "row").alias("root"))
    if several:
        docs = numbered.select("row", "doc")
        firsts = docs.select(F.col("row").alias("root"), F.col("doc").alias("low"))
        distinct = rows.join(docs, "row").groupBy("doc", "sid", "tag").agg(F.min("row").alias("row"))
        placed = placed.join(distinct, "row").join(firsts, "root").select("n", F.col("low").alias("root"), F.col("doc").alias("row"))
    return placed.select(F.col("row").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


def _grouped(sets: DataFrame, linked: DataFrame, best: DataFrame) -> DataFrame:
    """node, n, root and group (whole, name, part) of every set: large components are cut into groups of their own (whole 1,
    the root as name), the other sets of a cluster into groups together (whole 0, the cluster's head as name)."""
    placed = sets.hint("merge").join(linked, "node", "left").hint("merge").join(best, "node", "left")
    placed = placed.select("node", "n", F.coalesce("root", "node").alias("root"), F.coalesce("first", "node").alias("cluster"))
    placed = materialize(placed, "join-placed")
    sizes = materialize(placed.groupBy("root").agg(F.count(F.lit(1)).alias("count")), "join-sizes")
    named = placed.join(sizes, "root").withColumn("whole", (F.col("count") >= GROUP).cast("int"))
    named = named.withColumn("name", F.when(F.col("whole") == 1, F.col("root")).otherwise(F.col("cluster")))
    parts = materialize(named.groupBy("whole", "name").agg(_parts(GROUP)), "join-parts")
    return named.join(parts, ["whole", "name"]).select("node", "n", "root", "whole", "name", _split(F.col("node"), F.col("parts")).alias("part"))
