"""A corpus pipeline of five stages: toxicity, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return rows with the columns of documents.  A stage's result is written as Parquet and read again before
the next one starts, so no stage is computed twice and a lost executor costs one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import toxicity
from weftgraph.llm.common import ready, stored, text_of
from weftgraph.llm.exact_dedup import drop_exact_duplicates, drop_ids
from weftgraph.llm.minhash import minhash_components
from weftgraph.llm.mixing import drop_unmixed
from weftgraph.llm.packing import pack_documents
from weftgraph.llm.queries import WEIGHTS, domain_of, tokenizer_file
from weftgraph.operators.ordering import with_rank
from weftgraph.storage import discard, released

#: Of the tokens that reach the mixing stage, three in four are taken, each at most once.
MIX = {"max_epochs": 1, "numerator": 3, "denominator": 4, "seed": 11}


#: The caller's id, where ``by_row`` has put a row number in its place.
OWN_ID = "_weft_own_id"


def by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ids that are keys: as it is where its ids are keys, else with row numbers as doc_id.

    Numbers go by id, null last, then by text, so the smallest id is still the smallest; the ids
    themselves are in ``OWN_ID``.
    """
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        return docs
    ranked = with_rank(docs, F.asc_nulls_last("doc_id"), F.sha2(text_of("text"), 256), name="_weft_row")
    return stored(ranked.withColumns({OWN_ID: F.col("doc_id"), "doc_id": F.col("_weft_row")}).drop("_weft_row"), "rows")


def own_ids(rows: DataFrame) -> DataFrame:
    """Rows of ``by_row`` with the caller's ids and columns."""
    return rows if OWN_ID not in rows.columns else rows.withColumn("doc_id", F.col(OWN_ID)).drop(OWN_ID)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose text the classifier chain holds toxic; each row is judged by itself, so null
    and repeated ids don't matter.  Null and empty texts are judged by the models' biases (kept where
    labels are sound).  An empty table stays empty; columns besides doc_id and text only pass through."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without exact copies; the smallest id stays, a null id where there is no other.  Null texts are
    empty, and all empty texts copies of each other.  Of rows that repeat an id and a text one stays.  An
    empty table stays empty; other columns only pass through."""
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates: five-word shingles, 0.8 or more.

    Texts without words have no near copies and stay.  Rows that share an id, or have none, are rows of
    their own here.  An empty table stays empty; other columns only pass through."""
    rows = by_row(docs)
    verdict = minhash_components(rows, width=5, num=80, den=100)
    return own_ids(drop_ids(rows, stored(verdict.where(~F.col("kept")).select("doc_id"), "near-copies")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix reads, whole: also the one at which a leaf's budget ends.

    Texts without words are never read and go.  Rows that share an id, or have none, are rows of their
    own.  Null languages and sources are the empty string.  An empty table stays empty; other columns
    only pass through."""
    return own_ids(drop_unmixed(by_row(docs), WEIGHTS, domain_of(), **MIX))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens; null and empty texts are
    an end id alone, repeated rows are packed once each, an empty table gives no pieces."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", lambda spark, docs, sf_dir: drop_toxic(ready(spark), docs, sf_dir)),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Classifier, near dedup and packing are beyond SQL; tests hold the stages to brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, on ``documents``.  What a stage has stored goes when its result is written, and
    that when the next stage's is."""
    docs, last = ready(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with released(spark) as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if last is not None:
            discard(last)
        last = docs
    return docs
