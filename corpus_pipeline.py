"""A training corpus from raw documents, in five stages.

quality: rows that the classifier rejects go.  exact_dedup: of equal texts (A-Z
lower-cased) the row with the largest doc_id stays.  near_dedup: texts whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more are linked, and of each
component one row stays, that of the smallest doc_id.  secrets: spans found are
masked in the text.  packing: texts become pieces of 2048-token sequences.

Every stage takes and returns the columns of ``documents`` (the last returns
pieces).  A null text counts as empty: it has a score, equals other empty texts,
and packs as one end token.  Repeated rows are thinned to one by exact_dedup.
Rows with null doc_ids take part like any other.  Very long texts are one row
throughout; packing cuts them.  Ties: of equal texts with equal doc_ids, and of the
smallest doc_id of a component, one row of equal (doc_id, text) stays, whichever.
Other columns go along as they are; those whose names begin with two underscores,
which the stages use themselves, are renamed on the way in and named back on the
way out.  Empty tables give empty tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlake.llm import exact_dedup, packing, quality, secrets, simhash
from rasterlake.llm.common import documents, gathered, written
from rasterlake.llm.wordbpe import vocabulary_path


def surviving(docs: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose (doc_id, row_hash) is in ``kept``, one of each; ``rows`` has those keys for every document.

    What goes is joined away, not what stays joined in: it is the smaller side.
    """
    keys = [F.col("__id"), F.col("__hash")]
    rows = rows.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"))
    kept = kept.select(F.col("doc_id").alias("__kid"), F.col("row_hash").alias("__khash")).distinct()
    same = F.col("__id").eqNullSafe(F.col("__kid")) & (F.col("__hash") == F.col("__khash"))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("__n")).join(kept, same, "left")
    marked = gathered(counted.filter(F.col("__khash").isNull() | (F.col("__n") > 1)).select(*keys, F.col("__khash").isNotNull().alias("__thin")), "dropped")
    at = docs["doc_id"].cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__hash"))
    rest = docs.join(marked, at, "left_anti")
    thin = marked.filter("__thin")
    if thin.isEmpty():
        return rest
    first = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__id"))
    return rest.unionByName(docs.join(thin, at).withColumn("__first", first).filter("__first = 1").select(*docs.columns))


def shielded(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage whose own columns, all with two underscores in front, cannot meet others of the name."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hidden, prefix = [c for c in docs.columns if c.startswith("__")], "held"
        while any(c.lower().startswith(prefix) for c in docs.columns):
            prefix += "_"
        names = {c: f"{prefix}{i}" for i, c in enumerate(hidden)}
        out = stage(spark, docs.withColumnsRenamed(names) if names else docs, sf_dir)
        back = {to: c for c, to in names.items() if to in out.columns}
        return out.withColumnsRenamed(back) if back else out

    return run_stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), 0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = gathered(exact_dedup.dedup(docs, "largest").select("doc_id", "row_hash", "kept"), "decisions")
    return surviving(docs, rows, rows.filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = gathered(simhash.similar_documents(docs, 5), "decisions")
    smallest = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = smallest.groupBy("root").agg(F.min(F.struct("doc_id", "row_hash")).alias("k"))
    return surviving(docs, rows, one.select("k.doc_id", "k.row_hash"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), 1, 2048)


STAGES = [
    ("quality", shielded(keep_quality)),
    ("exact_dedup", shielded(drop_copies)),
    ("near_dedup", shielded(drop_near_copies)),
    ("secrets", shielded(mask_secrets)),
    ("packing", shielded(pack)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
