"""A corpus pipeline of five stages, each written as Parquet and reread.

documents -> toxicity (rejected documents go) -> line dedup -> SimHash near-dedup
(one document of a group stays) -> mixing sources to target weights -> packing.

Every stage takes rows of any further columns, whatever their names, null or
repeated ids, null, empty and very long texts, and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import scratch
from docquarry.llm import line_dedup, mixing, packing, simhash, toxicity
from docquarry.llm.tokens import vocabulary_file
from docquarry.session import spread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict as toxic; their columns as they were.

    The score is computed beside the row, so rows that repeat an id are each
    judged by their own text. Learned are the labels of ids among docs.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_rows(docs, model).where("predicted = 0").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated three-line windows; n_chars follows the text where lines went, no row goes."""
    out = line_dedup.line_dedup(docs)
    changed = F.size("removed_lines") > 0
    columns = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == "text":
            old = F.col("text")
        elif c == "n_chars":
            old = F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return out.select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; five-word shingles, similarity 0.8."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with its columns."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Nearest-neighbour votes, fingerprints and token ids are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written to the shared folder before the next reads them."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        before = docs
        docs = scratch.keep(stage(spark, before, sf_dir), "stage-" + name.replace(" ", "-"))
        scratch.drop(before)  # a stage's rows go when the next one's are written; documents are no table of ours
    return docs
