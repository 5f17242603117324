"""A corpus pipeline of four stages: toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared
folder and the next stage reads it from there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrospark.llm import packing, secrets, simhash, toxicity
from dendrospark.llm.common import checked, materialise, row_keys, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the model, trained on the labels of ``docs``, does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, "text", list(COLUMNS), model, locate=False).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (5-word similarity of 0.8 or more): the smallest id, null last.

    Rows are told apart by file and place, since ids may be null or repeated.
    """
    keyed = row_keys(docs.select(*COLUMNS))
    gone = simhash.near_copies(keyed, "doc_id", "text")
    return keyed.join(checked(gone), ["_file", "_at"], "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span with a secret; a document's length follows its text."""
    found = secrets.find_secrets(docs, "text", ["doc_id", "lang", "source", "n_chars"], redacted=True)
    length = F.when(F.size("spans") > 0, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", length.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, "text", ["doc_id"], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("secret_scans", redact_secrets), ("packing", pack)]

#: No stage but the last has a SQL form; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
