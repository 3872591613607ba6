"""Chat formatting of reply trees.

Messages that answer each other form trees. Iterative self-joins double the distance that each message looks up: after
round i it knows its ancestor 2**i replies above, and the sum of the scores between, so the deepest tree takes the
logarithm of its depth in rounds. Messages that reach a root so get their depth and the score of their branch; leaves are
ranked by it within their tree. The chosen leaves then enumerate their paths by the same tables of jumps, one join a
round, each round doubling the known part of every path. Only ids take part in all this; texts are shuffled once, by
tree, beside the places that they have on paths. A tree too large for a task is joined by message and dealt by path.

Template: each turn is ``### role: text</turn>\\n`` with ESCAPES applied to role and text, so marks of turns occur nowhere
else, and the text can be read back exactly. The loss mask is a list of (start, length) in code points: the texts of the
roles that are learned.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, operator

#: Escapes of texts, in order; they are undone in reverse. Roles escape the colon as well.
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e"))
HEAD, END = "### ", "</turn>\n"
LEARNED = ("assistant",)
#: Trees of more messages or more bytes of text than these are joined by message, not gathered in one task.
TREE_ROWS, TREE_BYTES = 1 << 16, 32 << 20
#: Parts of a tree's leaves that are ranked alone before their best meet.
PARTS = 64
#: Code points of formatted text in a batch that a task hands on.
BATCH = 1 << 21


def escape(text: str, role: bool = False) -> str:
    for plain, escaped in ESCAPES:
        text = text.replace(plain, escaped)
    return text.replace(":", "\\c") if role else text


def unescape(text: str, role: bool = False) -> str:
    text = text.replace("\\c", ":") if role else text
    for plain, escaped in reversed(ESCAPES):
        text = text.replace(escaped, plain)
    return text


def format_turns(turns, learned=LEARNED) -> tuple[str, list[dict]]:
    """The conversation of (role, text) turns and its loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escape(role, role=True)}: ", escape(text)
        if role in learned:
            spans.append({"start": at + len(head), "length": len(body)})
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns that format_turns was given."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, text = turn[len(HEAD) :].split(": ", 1)
        out.append((unescape(role, role=True), unescape(text)))
    return out


def chain(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Conversations in turn order as messages (tree, id, role, text) and their links (tree, id, parent), each the reply to the one before.

    id is (turn, role, hash of the text), in which order rows that share a turn follow (null last); rows equal in all of
    them count once. Null roles and texts are empty; rows without a conversation form one."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    named = F.struct(F.col(turn_col).isNull().alias("last"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(text).alias("hash"))
    rows = df.select(F.col(conv_col).alias("tree"), named.alias("id"), role.alias("role"), text.alias("text"))
    before = F.lag("id").over(Window.partitionBy("tree").orderBy("id"))
    links = rows.select("tree", "id").distinct().withColumn("parent", before)
    return rows, links


def _skeleton(messages: DataFrame, links: DataFrame | None, score_col: str | None) -> DataFrame:
    """t, k, h, up, s, n: tree, message, hash of its role and text, the message answered (null: none), score, bytes; one row a message."""
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    own = messages.select(F.struct("tree").alias("t"), F.col("id").alias("k"), *([] if links is not None else [F.col("parent").alias("up")]), score.alias("s"), F.xxhash64("role", "text").alias("h"), F.octet_length("text").cast("long").alias("n"))
    own = own.filter(F.col("k").isNotNull())
    if links is not None:
        one = own.groupBy("t", "k").agg(F.min(F.struct("s", "h", "n")).alias("m")).select("t", "k", "m.*")
        above = links.select(F.struct("tree").alias("t"), F.col("id").alias("k"), F.col("parent").alias("up"))
        return one.join(above, ["t", "k"])
    return own.groupBy("t", "k").agg(F.min(F.struct(F.col("up").isNull().alias("root"), "up", "s", "h", "n")).alias("m")).select("t", "k", "m.up", "m.s", "m.h", "m.n")


def _climb(skeleton: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables of jumps (t, k, far, far_h: round i's go 2**i replies up) and, for each message below a root, its depth and the sum of its branch's scores."""
    parents = skeleton.select("t", F.col("k").alias("far"), F.col("h").alias("far_h"))
    first = skeleton.withColumnRenamed("up", "_up").alias("a").join(fresh(parents).alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a._up") == F.col("b.far")), "left")
    state = first.select("a.t", "a.k", "a.h", "b.far", "b.far_h", F.when(F.col("b.far").isNotNull(), 1).otherwise(0).cast("long").alias("d"), "a.s")
    state = materialize(state, "reply-jumps")
    tables, done, most = [], state.filter("far IS NULL"), max(1, state.count()).bit_length() + 1
    while len(tables) <= most:
        far = state.filter("far IS NOT NULL")
        if far.isEmpty():
            break
        tables.append(far.select("t", "k", "far", "far_h"))
        known = fresh(far.unionByName(done).select("t", "k", "far", "far_h", "d", "s"))
        step = far.alias("a").join(known.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.far") == F.col("b.k")))
        state = materialize(step.select("a.t", "a.k", "a.h", "b.far", "b.far_h", (F.col("a.d") + F.col("b.d")).alias("d"), (F.col("a.s") + F.col("b.s")).alias("s")), "reply-jumps")
        done = done.unionByName(state.filter("far IS NULL"))
    return tables, done  # messages that never reach a root answer each other in a circle


def _best(leaves: DataFrame, best: int) -> DataFrame:
    """The best leaves of each tree by mean score, ties to the smaller id; first in parts, as a tree may have any number."""
    order = [F.col("score").desc(), F.col("leaf")]
    part = F.pmod(F.xxhash64("t", "leaf"), F.lit(PARTS))
    some = leaves.withColumn("_part", part).withColumn("_r", F.row_number().over(Window.partitionBy("t", "_part").orderBy(*order))).filter(F.col("_r") <= best)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy(*order))).filter(F.col("rank") <= best).drop("_part", "_r")


def _paths(leaves: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Every message of each leaf's path: leaf columns, k, h and pos (0 at the root)."""
    known = materialize(leaves.select("t", "leaf", "rank", "score", "d", F.col("leaf").alias("k"), "h", F.col("d").alias("pos")), "reply-paths")
    for i, jumps in enumerate(tables):
        # a path of fewer than 2**i replies is known already
        open_paths = known.filter(F.col("d") >= 1 << i)
        step = open_paths.alias("a").join(fresh(jumps).alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k")))
        more = step.select("a.t", "a.leaf", "a.rank", "a.score", "a.d", F.col("b.far").alias("k"), F.col("b.far_h").alias("h"), (F.col("a.pos") - (1 << i)).alias("pos"))
        known = known.unionByName(materialize(more, "reply-paths"))
    return known


def _emit(schema: pa.Schema, rows):
    """Batches of conversations from (key, (role, text) turns)."""
    out, size = [], 0
    for key, turns, learned in rows:
        formatted, spans = format_turns(turns, learned)
        out.append((*key, len(turns), formatted, spans))
        size += len(formatted)
        if size >= BATCH:
            yield _batch(schema, out)
            out, size = [], 0
    yield _batch(schema, out)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _rows(batches):
    for b in batches:
        names = b.schema.names
        for values in zip(*(b.column(i).to_pylist() for i in range(len(names))), strict=True):
            yield dict(zip(names, values, strict=True))


def _out_schema(schema: pa.Schema) -> pa.Schema:
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    return pa.schema([("tree", schema.field("tree").type), ("leaf", schema.field("leaf").type), ("rank", pa.int32()), ("score", pa.float64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", span)])


def _peek(batches):
    batches = iter(batches)
    first = next(batches, None)
    return (None, ()) if first is None else (first.schema, itertools.chain([first], batches))


def _by_path(learned):
    def run(batches):
        """Conversations from rows sorted by path and place, each with its text."""
        schema, batches = _peek(batches)
        if schema:
            groups = itertools.groupby(_rows(batches), lambda r: (r["_t"], r["_leaf"]))
            whole = ((r := list(g), [(x["role"], x["text"]) for x in r]) for _, g in groups)
            yield from _emit(_out_schema(schema), (((r[0]["tree"], r[0]["leaf"], r[0]["rank"], r[0]["score"]), turns, learned) for r, turns in whole))

    return run


def _by_tree(learned):
    def conversations(batches):
        for _, tree in itertools.groupby(_rows(batches), lambda r: r["_t"]):
            texts = {}
            for kind, rows in itertools.groupby(tree, lambda r: r["kind"]):
                if not kind:
                    texts = {(r["_k"], r["h"]): (r["role"], r["text"]) for r in rows}
                    continue
                for _, path in itertools.groupby(rows, lambda r: r["_leaf"]):
                    path = list(path)
                    key = tuple(path[0][c] for c in ("tree", "leaf", "rank", "score"))
                    yield key, [texts[r["_k"], r["h"]] for r in path], learned

    def run(batches):
        """Conversations from rows sorted by tree: first its texts, then the places of its paths."""
        schema, batches = _peek(batches)
        if schema:
            yield from _emit(_out_schema(schema), conversations(batches))

    return run


def _string(column: str) -> Column:
    """A value of any type as a string of its own."""
    return F.to_json(F.struct(F.col(column).alias("v")), {"ignoreNullFields": "false"})


@operator
def format_replies(messages: DataFrame, links: DataFrame | None = None, best: int | None = None, score_col: str | None = None, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """tree, leaf, rank, score, n_turns, formatted, loss of the chosen root-to-leaf paths.

    messages: tree, id (of any type, its own within the tree), role, text, and parent (the id answered, null at a root),
    unless links (tree, id, parent) gives it. A branch's score is the mean of its messages' score_col (null: 0); best is
    the number of leaves kept in each tree, the highest score first, ties to the smaller leaf id; with None all paths
    are formatted and rank is null.
    Defined cases: null roles and texts are empty; a message whose parent does not exist is a root; messages that answer
    each other in a circle, and replies to them, are on no path; rows without id are in no tree; a null tree is one of
    its own; of rows with one id the smallest (parent, score, hash of role and text) counts; an empty table gives no
    rows; other columns are not read.
    """
    plain = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    rest = [c for c in ("parent", score_col) if c and c in messages.columns]
    messages = messages.select("tree", "id", *rest, *plain)
    skeleton = materialize(_skeleton(messages, links, score_col), "reply-skeleton")
    tables, done = _climb(skeleton)
    answered = skeleton.filter("up IS NOT NULL").select("t", F.col("up").alias("k")).distinct()
    leaves = done.join(answered, ["t", "k"], "left_anti").select("t", F.col("k").alias("leaf"), "h", "d", (F.col("s") / (F.col("d") + 1)).alias("score"))
    leaves = leaves.withColumn("rank", F.lit(None).cast("int")) if best is None else _best(leaves, best)
    places = _paths(leaves, tables)
    texts = messages.select(F.struct("tree").alias("t"), F.col("id").alias("k"), F.xxhash64("role", "text").alias("h"), "role", "text").filter("k IS NOT NULL")
    large = materialize(skeleton.groupBy("t").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("bytes")).filter((F.col("rows") > TREE_ROWS) | (F.col("bytes") > TREE_BYTES)).select("t"), "reply-large")
    some_large = not large.isEmpty()
    spark = messages.sparkSession
    small_texts, small_places = (x.join(large, "t", "left_anti") if some_large else x for x in (texts, places))
    fields = {f.name: f.dataType for f in places.schema}
    empty = {"leaf": F.lit(None).cast(fields["leaf"]), "rank": F.lit(None).cast("int"), "score": F.lit(None).cast("double"), "pos": F.lit(None).cast("long"), "_leaf": F.lit(None).cast("string")}
    left = small_texts.select(_string("t").alias("_t"), F.lit(0).alias("kind"), empty["_leaf"].alias("_leaf"), empty["pos"].alias("pos"), F.col("t.tree").alias("tree"), empty["leaf"].alias("leaf"), empty["rank"].alias("rank"), empty["score"].alias("score"), _string("k").alias("_k"), "h", "role", "text")
    right = small_places.select(_string("t").alias("_t"), F.lit(1).alias("kind"), _string("leaf").alias("_leaf"), "pos", F.col("t.tree").alias("tree"), "leaf", "rank", "score", _string("k").alias("_k"), "h", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    tree, leaf = fields["t"].fields[0].dataType.simpleString(), fields["leaf"].simpleString()
    schema = f"tree {tree}, leaf {leaf}, rank int, score double, n_turns long, formatted string, loss array<struct<start: long, length: long>>"
    dealt = left.unionByName(right).repartition("_t").sortWithinPartitions("_t", "kind", "_leaf", "pos")
    out = dealt.mapInArrow(_by_tree(learned), schema)
    if some_large:
        one = texts.join(large, "t", "left_semi").groupBy("t", "k", "h").agg(F.first("role").alias("role"), F.first("text").alias("text"))
        met = fresh(places.join(large, "t", "left_semi")).join(one, ["t", "k", "h"])
        sorted_paths = met.select(_string("t").alias("_t"), _string("leaf").alias("_leaf"), "pos", F.col("t.tree").alias("tree"), "leaf", "rank", "score", "role", "text").repartition("_t", "_leaf").sortWithinPartitions("_t", "_leaf", "pos")
        out = out.unionByName(sorted_paths.mapInArrow(_by_path(learned), schema))
    return out


def read_back(conversations: DataFrame) -> DataFrame:
    """tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the formatted text and its mask."""

    def run(batches):
        for b in batches:
            out = []
            for formatted, loss in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
                turns = parse_turns(formatted)
                learned = "".join(unescape(formatted[s["start"] : s["start"] + s["length"]]) for s in loss)
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([b.column("tree"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["tree", *names])

    tree = conversations.schema["tree"].dataType.simpleString()
    return conversations.select("tree", "formatted", "loss").mapInArrow(run, f"tree {tree}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
