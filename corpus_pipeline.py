"""A corpus pipeline: quality, repeated lines, near duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; its result is written as Parquet and read again for the next one.
Columns beyond those of documents are kept by all stages but the last; names
that begin with two underscores are the operators' own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, lines, minhash, mixing, quality
from tessera.llm.common import documents, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts, with all columns.

    Null and empty texts are scored alike, as texts without words.  Repeated rows,
    and rows of one doc_id and text, stay or go together; rows without doc_id are
    scored as well.  Without labels every document has the same score."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an earlier document has; as many rows, all columns.

    A null text stays null; a text may become empty; n_chars follows the text.  A
    row without doc_id keeps its lines; rows of one doc_id lose the same keys.  An
    empty table stays empty."""
    return lines.without_repeats(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id.

    Documents count as near at 80 percent here, at 85 in op9_minhash.  Documents
    without words, and rows without doc_id, are in no group and stay; rows of one
    doc_id are one document and stay or go together."""
    return minhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; all columns.

    A null source is a source.  Documents without words are taken with the sample
    of their source; repeated rows are taken as often as come nearest to the target."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and digests of them and of the decoded text.

    A null or empty text has no tokens; a null doc_id stays null."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [("quality", good), ("lines", unrepeated), ("near duplicates", unlike), ("mix", mixed), ("tokens", tokens)]
#: The classifier and MinHash have no SQL form; the tests compare every stage with brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
