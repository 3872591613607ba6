"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .block_codes import block_codes
from .bpe import transcode
from .common import table
from .fill_middle import fill_in_middle, restore
from .html_text import extract_text
from .inner_product import top_k_inner_product
from .jump_shard import shard_rows
from .language import held_out, identify, train
from .packing import pack
from .prefix_forest import nearest_neighbours
from .reply_trees import chain, format_replies, read_back
from .shingle_join import similar_documents
from .suffix_repeats import remove_repeats
from .warc import build_derivatives, responses_of

TOKENIZER = "byte_bpe_50k.json"
#: Target weights of the sources in packed windows: the large source less than its share of all tokens, the others alike.
MIXTURE = {"src0": 8.0} | {f"src{i}": 1.0 for i in range(1, 20)}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcode(table(spark, sf_dir, "documents"), tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), length=2048, end_id=1, weights=MIXTURE)


def op4_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_inner_product(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_payload_digest", "content")
    return build_derivatives(responses_of(table(spark, sf_dir, "pages")), keep=("page_id",), columns=columns)


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"), every_row=True)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_jump_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), 24)


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), words=3, percent=90)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents.filter(~held_out() & F.col("doc_id").isNotNull()))
    return identify(documents, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted")


def op11_block_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_codes(table(spark, sf_dir, "embeddings"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents")).withColumn("restored", restore(F.col("output"), F.col("form")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: A conversation that says what the template says, beside those of the table.
TEMPLATE_TEXT = r"\### Assistant: </turn> ok"


def op13_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.createDataFrame([(-7, i, role, TEMPLATE_TEXT) for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(told)
    messages, links = chain(conversations)
    return read_back(format_replies(messages, links, best=1)).withColumnRenamed("tree", "conv_id")


QUERIES = {f.__name__: f for f in (op1_prefix_forest, op2_bpe, op3_packing, op4_inner_product, op5_warc, op6_suffix_repeats, op7_jump_shard, op8_shingle_join, op9_html_text, op10_language, op11_block_codes, op12_fill_middle, op13_reply_trees)}


def _block_codes_sql(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    """Rounds of assignment (a) and of codebooks (c) over the parts (p) of the kept vectors."""
    distance = " + ".join(f"(p.x[{i}] - c.x[{i}]) * (p.x[{i}] - c.x[{i}])" for i in range(1, width + 1))
    means = ", ".join(f"floor(sum(p.x[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, width + 1))
    steps = ""
    for r in range(rounds + 1):
        steps += f""",
             a{r} AS MATERIALIZED (SELECT id, part, min(d * {entries} + entry) AS best FROM (SELECT p.id, p.part, c.entry, {distance} AS d FROM p JOIN c{r} c ON p.part = c.part) GROUP BY id, part)"""
        if r < rounds:
            steps += f""",
             m{r} AS (SELECT p.part, best % {entries} AS entry, [{means}] AS x FROM a{r} JOIN p USING (id, part) GROUP BY p.part, best % {entries}),
             c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.part = m.part AND c.entry = m.entry)"""
    return f"""
        WITH k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             p AS MATERIALIZED (SELECT id, part, list_slice(v, {width} * part + 1, {width} * part + {width}) AS x FROM k, (SELECT unnest(range({parts})) AS part)),
             c0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x FROM p WHERE id <= {entries}){steps},
             e AS (SELECT id, sum(best // {entries})::BIGINT AS error, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code FROM a{rounds} GROUP BY id),
             j AS (SELECT k.vec_id, k.label, e.code, e.error FROM e JOIN k USING (id)),
             s AS (SELECT label, sum(error)::BIGINT AS label_error FROM j GROUP BY label),
             h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
        SELECT vec_id, code, error, label_error, codebooks_sha256 FROM j JOIN s ON j.label IS NOT DISTINCT FROM s.label, h"""


#: DuckDB SQL of the escapes that a turn's text goes through, for its length.
_ESCAPED = r"replace(replace(replace({0}, '\', '\s'), '###', '\h'), '</turn>', '\e')".replace("\\\\", "\\")

ORACLE_SQL = {
    "op11_block_codes": _block_codes_sql(),
    "op12_fill_middle": """
        WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
             g AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
             c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
             p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op13_reply_trees": f"""
        WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '{TEMPLATE_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{TEMPLATE_TEXT}'),
             m AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r)) AS turns_sha256,
               coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn) FILTER (r = 'assistant'), '')) AS loss_sha256,
               sum(14 + length(replace({_ESCAPED.format("r")}, ':', '--')) + length({_ESCAPED.format("x")}))::BIGINT AS formatted_chars FROM m GROUP BY conv_id""",
    "op4_inner_product": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS i FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.i, c.i)::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.i) = len(c.i)),
             r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
