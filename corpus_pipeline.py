"""A corpus pipeline of the training-data operators.

Each stage takes what its predecessor kept; the last one lays out training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import toxicity as tox
from netloom.llm.ngram_join import ngram_jaccard
from netloom.llm.packing import best_fit_pack
from netloom.llm.pii import pseudonymise
from netloom.llm.queries import PII_KEY
from netloom.llm.store import cut, forget, table
from netloom.llm.winnow import contamination

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a number that rows share only if they are equal: ids may repeat or be null."""
    return docs.select(*COLUMNS).withColumn("row", F.xxhash64(*COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among them.

    Null and empty texts have no n-grams and stay; long ones are scored whole; rows with equal
    ids or texts are judged each. Without labelled documents nothing is known to be toxic
    and all stay. An empty table gives none; columns other than those of documents go.
    """
    model = tox.train(tox.training_rows(docs, table(spark, sf_dir, "labels"), "toxic", tox.held_out(5, 0)))
    return tox.score(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles (0.8 or more) hold together,
    the one with the smallest id stays; of equal rows, one stays.

    Null and empty texts link with nothing and stay; a null id counts as the largest; of several
    rows with the smallest id, one stays, by a hash of its content. Long texts count whole; an
    empty table gives none; columns other than those of documents go.
    """
    docs = _numbered(docs)
    groups = ngram_jaccard(docs, k=5, percent=80, id_col="row")
    best = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    kept = groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).distinct().join(docs.select("row", "doc_id").distinct(), "row")
    kept = kept.groupBy("group").agg(F.min(best).alias("best")).select(F.col("best.row").alias("row"))
    return docs.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that benchmark windows cover by a twentieth of their words or more.

    Null and empty texts have no words and stay; long ones are searched whole; equal rows go or
    stay together. Without a benchmark all stay; an empty table gives none; columns other
    than those of documents go.
    """
    docs = _numbered(docs)
    found = contamination(docs, table(spark, sf_dir, "benchmark"), id_col="row").where("contaminated")
    return docs.join(found.select(F.col("doc_id").alias("row")), "row", "left_anti").select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data; n_chars follows.

    A null text stays null, with a null n_chars, an empty one empty; long ones are rewritten
    whole; equal rows stay equal. An empty table gives none; columns other than those of
    documents go.
    """
    out = pseudonymise(docs.select(*COLUMNS), PII_KEY)
    return out.select("doc_id", F.col("pii_text").alias("text"), "lang", "source", F.length("pii_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    A null or empty text is one piece of the id 0 alone; long ones are cut into pieces; rows with
    equal ids or texts are packed each. An empty table gives none; other columns are not read.
    """
    return best_fit_pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii_pseudonyms", pseudonyms),
    ("best_fit_packing", pack),
]

#: A classifier's weights and a tokenizer's ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`; each stage's are written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:  # nothing reads it any more
            forget(before)
        before = docs
    return docs
