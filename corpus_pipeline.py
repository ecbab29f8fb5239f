"""From raw documents to packed training sequences.

Each stage works on all documents that the one before kept; stages are written as Parquet and read again. What a stage wrote
on its way is removed once its own table stands.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import langid, mixing, ngramjoin, packing, toxicity
from tidemill.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents predicted toxic go. Null and empty texts stay; a repeated row goes or stays with its text."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_unknown(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents without a known language go, so null and blank texts go too. Ids aren't looked at."""
    return langid.keep_known(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near copies one row stays, of the least (doc_id, text).

    Rows that repeat whole, or repeat an id with texts that are near copies, count as copies; an id with unlike texts keeps
    one row for each. Rows without an id, and without words, stay. An empty table stays empty.
    """
    return ngramjoin.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents are left out or repeated, so that sources have their target weights.

    A text without words is drawn like one of one word, and weighs nothing; a null source is a source of its own.
    """
    return mixing.repeat_by_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of full sequences; every row has its pieces, repeated and empty ones too."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown), ("near_copies", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: Trained models and tokens can't be had in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(spark, name, partial(stage, spark, docs, sf_dir))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
