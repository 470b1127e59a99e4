"""A corpus from raw documents to packed sequences.

Each stage is a function of (spark, docs, sf_dir) that works on all rows the stage before it kept; the result is
written as Parquet and read again as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fedloom.llm.common import name_of, steady  # noqa: E402
from fedloom.llm.decontaminate import clean  # noqa: E402
from fedloom.llm.packing import pack_documents  # noqa: E402
from fedloom.llm.quality import BASE, STRICT, fails, ledger  # noqa: E402
from fedloom.llm.simhash import simhash_groups  # noqa: E402
from fedloom.llm.suffixes import without_repeats  # noqa: E402
from fedloom.session import scratch_path  # noqa: E402


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same columns under neutral names, which clash with nothing an operator adds, and the new name of each."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(new).alias(old) for old, new in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule of the base or the strict policy; NULL and empty texts break one."""
    rows, names = _numbered(docs)
    kept = ledger(rows, names["text"], tuple(rows.columns)).where(~(fails(BASE) | fails(STRICT)))
    return _named(kept, names)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; of repeated rows one."""
    rows, names = _numbered(docs)
    rows = steady(rows).withColumn("__row", F.monotonically_increasing_id())
    key = names["doc_id"]
    groups = simhash_groups(rows, width=3, radius=2, id_col=key, text_col=names["text"], carry=("__row",))
    first = groups.groupBy("component_fp").agg(F.min(F.struct(F.col(key).isNull().alias("none"), key, "__row"))["__row"].alias("__row"))
    return _named(rows.join(first, "__row", "left_semi"), names)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that stand in two places; ``n_chars`` follows the text."""
    rows, names = _numbered(docs)
    text = names["text"]
    rows = rows.withColumn("__null", name_of(text).isNull())
    carry = tuple(c for c in rows.columns if c != text)
    left = without_repeats(rows, id_col=carry[0], text_col=text, carry=carry[1:], kept=True)
    left = left.withColumn(text, F.when(~F.col("__null"), F.col("kept")))
    if "n_chars" in names:
        kind = rows.schema[names["n_chars"]].dataType
        left = left.withColumn(names["n_chars"], F.when(F.col("n_removed") > 0, F.length("kept").cast(kind)).otherwise(F.col(names["n_chars"])))
    return _named(left, names)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Fingerprints, edit distance and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
