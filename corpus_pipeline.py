"""A corpus pipeline over `documents`: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import settled
from millrace.llm.contamination import without_contaminated
from millrace.llm.language_id import only_identified
from millrace.llm.mixing import mix
from millrace.llm.simhash import one_of_each
from millrace.llm.suffix_dedup import remove_repeats
from millrace.session import remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# All stages: docs may have more columns, which go, or clash in no way, as only those of documents are read; an empty
# table gives an empty table; texts of any length are taken whole; nulls and repeats as each stage says.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected.

    Null and empty texts are rejected, also texts whose likeliest languages tie; a null lang or source is no
    evidence; repeated rows are judged alike and stay repeated; a null doc_id is an id like any other.
    """
    docs = docs.select(*COLUMNS)
    return only_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: those with a Jaccard similarity of five-word shingles of 0.8 or more.

    It is the one of the least doc_id; of equal ids that of the least hash of the text, of repeated rows one. Rows
    with a null id stay only where their group has no other. Null and empty texts are one group; texts of
    fewer than five words are one shingle.
    """
    return one_of_each(docs.select(*COLUMNS), width=5, radius=18, similarity=0.8)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out bytes that repeat earlier strings of 100 bytes; characters cut in two go as a whole.

    A document of which nothing is left goes. Null and empty texts stay, as empty ones. Rows equal in id and text
    are one document, which all of them get the rest of; null ids stand after all others. n_chars is counted anew.
    """
    kept = remove_repeats(docs.select(*COLUMNS), carry=("lang", "source")).where("n_bytes = 0 OR n_removed < n_bytes")
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item with a similarity of 0.8 or more.

    Null and empty texts hold none and stay; of rows that share an id, each is judged by its own text, and repeated
    rows alike; null ids are ids like any other.
    """
    return without_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document in the mix.

    Null and empty texts have size 0 and take one copy of no words; a null source is a source of its own; repeated
    rows each count; documents of equal size in a source share its copies by a hash.
    """
    return mix(docs.select(*COLUMNS))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each stage's rows are written before the next reads them, and what it wrote on its way goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        kept = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            remove(spark, docs._written)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the fingerprints' links nor the learned model.
ORACLE_SQL = None
