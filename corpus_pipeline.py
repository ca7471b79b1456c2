"""From raw documents to token ids: toxicity, exact copies, near copies, mixing of sources, SentencePiece.

Stages keep all columns of their input, whatever their names, but for the last; names that begin with two underscores
are reserved. Texts are read to their end. An empty table goes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import exact_dedup, jaccard, mixing, pieces, toxicity
from weftline.llm.common import compact, cut, drop_table, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go; it learns from the labels of the other fold's documents.

    A null text is scored as the empty one. Repeated rows get equal scores, so all go or all stay; a null doc_id, or one
    without a label, teaches nothing and is scored like any other. Without labels of both classes every score is that
    of the only class, 0 without any.
    """
    return compact(toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents with equal text stays: that with the longest original text, then the smallest doc_id, then
    the smallest hash of the whole row. Null and empty texts are equal. A null doc_id comes first; where a doc_id repeats
    with different texts, each text has its own group."""
    return compact(exact_dedup.drop_exact_copies(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id. Empty and null texts and rows
    with a null doc_id link with nothing and stay."""
    return compact(jaccard.drop_near_copies(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get equal shares of the characters; documents repeat or leave by their source's rate. A null source is a
    source, a null doc_id hashes as 'null', rows that share a doc_id repeat equally often."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with an end id, their number, and the text that they decode to: (doc_id, lang, source, text, n_tokens,
    ids); all other columns end here. A null text is the empty one, whose only id is the end id. Repeated rows stay."""
    encoded = pieces.encode(compact(docs), pieces.model_path(), columns=("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", F.col("decoded").alias("text"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL cannot express the classifier, the tokenizer or the join's sketches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over the tables that the others write; each is removed once the next is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
