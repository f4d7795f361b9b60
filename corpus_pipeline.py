"""A corpus pipeline of five stages; each is written as Parquet and reread as the next one's documents.

Quality rules and toxicity drop the documents they reject, SimHash keeps one document of each
group of near-duplicates (five-word shingles, a similarity of 0.8 or more), the secret scan replaces
every secret in a text by a mark, and packing turns the rest into training sequences.

Rows: a null text has no words and goes with the quality rules, as an empty one does.  A null id, language or
source stays as it is.  Rows that repeat one another, ids included, are near-duplicates: one stays, the
one of least id (a null id only if no other row has one; equal ids in the order they are read).  Texts
of any length are worked on whole.  Further columns of documents, whatever their names, pass through
all stages but the last; n_chars follows a masked text.
Without labels nothing is toxic.  An empty table of documents gives no row at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slowscope.llm import packing, quality, secrets, simhash, toxicity
from slowscope.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs, keep=tuple(docs.columns))
    text = secrets.redacted(F.col("k_text"), F.col("spans"))
    changed = {"text": text, "n_chars": F.when(F.size("spans") > 0, F.char_length(text).cast("long")).otherwise(F.col("k_n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return found.select(*[changed.get(c, F.col(f"k_{c}")).alias(c) for c in docs.columns])


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("simhash_dedup", simhash_dedup),
    ("secret_scan", secret_redaction),
    ("packing", sequence_packing),
]

#: No SQL for SimHash components, the trained chain or tokenizer ids: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
