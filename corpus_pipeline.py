"""From raw documents to training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. A stage reads its docs more than once, so they should be a stored table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import langid, mixing, ngram_join, pii
from weftline.llm.common import checkpointed, quoted, table, unused
from weftline.llm.queries import packed

#: A text is rejected if this or less is the chance that it is real text of its language.
LEAST_SCORE = 0.001


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those that fit no language: null and empty texts, and
    junk, which the letters' own frequencies explain better than any language does.

    The same row always fares the same; columns of any name stay, ties between languages drop
    nothing. An empty table stays empty; a table without any language named loses all rows.
    """
    lang, score = unused("lang_pred", docs.columns), unused("score", docs.columns)
    vocab = public_tokenizers.path("piece_bpe_32k.model")
    found = langid.identify(docs, F.lit(True), vocab_path=vocab, pred_col=lang, score_col=score)
    return found.where((F.col(lang) != "und") & (F.col(score) > LEAST_SCORE)).select(*map(quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: of those with the smallest id the first by
    a hash of id and text.

    Rows without id, null texts and texts without words belong to no group and stay. Rows
    that share an id but not a text are told apart; of rows that repeat both one stays.
    Columns of any name stay. An empty table stays empty.
    """
    return ngram_join.one_each(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind and counts n_chars (if there is one) anew.

    Null texts stay null, with null n_chars; empty ones stay empty. Rows that repeat are
    changed alike; ids play no part. An empty table stays empty.
    """
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    length = F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))
    return clean.withColumn("n_chars", length)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their weights.

    Null texts and texts without words weigh nothing and go. Rows that repeat id, source and
    text come as often as all of them are taken together, in the shape of one of them.
    Columns of any name stay. An empty table stays empty.
    """
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences.

    A null or empty text is its end alone; every row is packed, repeated ones and those
    without id too. An empty table gives no rows.
    """
    return packed(docs)


STAGES = [
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("pii", private_data),
    ("source_mixing", mixture),
    ("packing", sequences),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
