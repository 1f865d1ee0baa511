"""The corpus pipeline: five stages over ``documents``, part of subpackage ``flightlens.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``documents``. A stage works on all rows that
the one before it kept, and is written and read again before the next.

Nulls: a null text has no words, so the first stage rejects it; a null id
links nothing and removes nothing. Empty and short texts go in the first stage;
very long ones are worked on whole, by one task at a time. Rows that are equal
in all columns count once from the second stage on, rows with one id and other
contents are documents of their own, and the result does not depend on the order
of rows. An empty table gives no rows. Columns beside those of ``documents`` are
not passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.llm import decontamination, packing, quality, simhash_dedup, substring_dedup
from flightlens.llm.queries import tokenizer_path
from flightlens.llm.runtime import forget, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines above their host's limit."""
    judged = quality.judge(_documents(docs), carry=("text", "lang", "source", "n_chars")).filter("kept")
    cleaned = judged.select(*COLUMNS, "boilerplate", "n_removed")
    kinds = dict(cleaned.dtypes)
    cleaned = cleaned.mapInArrow(quality.without_lines("text", "boilerplate"),
                                 ", ".join(f"`{c}` {k}" for c, k in kinds.items()))
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                              .otherwise(F.col("n_chars"))).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays (once).

    Rows are told apart by id and contents: of rows with one id, those of other
    groups go or stay with their own group. Of several that could stay for one
    group, the one with the smallest digest of its contents does.
    """
    docs = _documents(docs).withColumn("contents", F.md5(F.concat(*[
        F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
        for c in COLUMNS])))
    groups = simhash_dedup.near_duplicates(docs, carry=("contents",))
    stay = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.min("contents").alias("contents"))
    return (docs.filter("doc_id IS NOT NULL").join(stay, ["doc_id", "contents"], "left_semi")
            .dropDuplicates(["doc_id", "contents"]).unionByName(docs.filter("doc_id IS NULL")).select(*COLUMNS))


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by repeats of an earlier document go; a document stays, if with less text."""
    cut = substring_dedup.remove_repeats(_documents(docs), carry=("lang", "source", "n_chars"), keep_layout=True)
    text = F.col("kept").cast("string")
    return cut.select("doc_id", text.alias("text"), "lang", "source",
                      F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    found = decontamination.find_contamination(_documents(docs), table(spark, sf_dir, "benchmark"),
                                               carry=("text", "lang", "source", "n_chars"))
    return found.filter("NOT contaminated").select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of at most 2048 tokens."""
    return packing.pack(_documents(docs), tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", simhash_near_dedup),
          ("substring dedup", substring_removal), ("benchmark decontamination", benchmark_decontamination),
          ("packing", sequence_packing)]

#: Fingerprints, their components and tokenisation have no SQL form; see tests/llm/test_web_operators.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, written = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        if written is not None:
            forget(spark, written)               # the stage before has been read for the last time
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
