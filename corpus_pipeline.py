"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes each result as Parquet below the shared folder and
reads it again for the next stage.

Nulls, empty texts, repeated rows and extra columns are handled as the operators' docstrings
say. Rows are told apart by doc_id where a stage drops rows: null ids are kept by the
Jaccard stage (they have no smaller id) and judged as one document by the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.llm import decontamination, pieces, quality, similarity, suffixes
from trackmill.llm.shared import table
from trackmill.session import new_path

#: The model and the leaked passages are not expressible in SQL; the tests hold each stage against a plainer version.
ORACLE_SQL = None

#: Bytes of a repeated passage: fewer than fifty words of running text have. And of the grams that choose its suffixes.
PASSAGE, PASSAGE_GRAM = 200, 64


def _packed(docs: DataFrame) -> DataFrame:
    """The text, and the rest of a row as one column, so that no name of it meets one of an operator."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest, F.col("text").isNull().alias("no text")).alias("row"), F.col("text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose document is kept by the base rules and the trees, trained on labels of the documents at hand."""
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    graded = quality.grade(_packed(docs), trees, carry=("row", "text"))
    return graded.filter("kept").select(*[F.col(c if c == "text" else f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class at five words and 0.8: the one with the smallest id, rows of one id once."""
    found = similarity.components(docs, 5, 80, 100)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.filter("doc_id is not null").join(kept.withColumnRenamed("kept_id", "doc_id"), "doc_id", "left_semi")
    nameless = docs.filter("doc_id is null").join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    return named.dropDuplicates(["doc_id"]).unionByName(nameless.dropDuplicates())


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts less every byte in a PASSAGE-byte string that occurs elsewhere. Untouched texts stay as they are, null too."""
    cut = suffixes.cut_texts(_packed(docs), PASSAGE, PASSAGE_GRAM, keep=("row",)).withColumnRenamed("text", "rest")
    new = {"text": F.when(~F.col("row.`no text`"), F.col("rest"))}
    if "n_chars" in docs.columns:
        size = F.char_length("rest").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_removed") > 0, size).otherwise(F.col("row.n_chars"))
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids and round_trip."""
    return pieces.documents_to_pieces(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"corpus-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
