"""From documents to packed training sequences: language identification, near duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents. run() writes each stage's rows in the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize, table, with_row_ids
from lumenfold.llm.language import identify, train
from lumenfold.llm.packing import pack
from lumenfold.llm.queries import tokenizer_path
from lumenfold.llm.shingle_join import similar_documents
from lumenfold.llm.suffix_repeats import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language's model accepts, with the language it finds; rejected ones (no letter, or unlike all) go.

    Null, empty and letterless texts are rejected; labels that are null teach nothing; rows that share an id, or have none,
    are judged each by its text; a table without labels accepts nothing."""
    found = identify(docs, train(docs), keep=COLUMNS)
    return found.filter(F.col("accepted")).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: five-word shingles, similarity 0.8 or more; the smallest doc_id stays.

    Each row is a document of its own, also where rows share a doc_id or have none (these come last)."""
    rows = with_row_ids(docs.select(*COLUMNS), "doc_id", "text", "row_id")
    found = similar_documents(rows, words=5, percent=80, id_col="row_id")
    gone = found.filter(F.col("component_id") != F.col("row_id")).select("row_id")
    return rows.join(gone, "row_id", "left_anti").select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier; n_chars follows. Rows stay.

    Null texts become empty; rows that share an id come in the order of their texts' hashes, those without one last."""
    kept = remove_repeats(docs, keep=("lang", "source"), as_text=True, every_row=True)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens in which every source has its share.

    A null or empty text is the end token alone; rows without a source are a source; repeated rows are packed each."""
    return pack(docs, tokenizer_path(), length=2048, end_id=1)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("packing", packing)]

#: The stages' models, joins and tokens have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
