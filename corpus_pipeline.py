"""A corpus pipeline: toxic documents go, one of each group of near-duplicates stays, repeated passages and secrets are
taken out, and the rest is packed into sequences. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import delete, table, tables, written
from barloom.llm.near_dedup import one_of_each
from barloom.llm.packing import best_fit_packing
from barloom.llm.secret_scan import masked_secrets
from barloom.llm.suffix_dedup import without_repeats
from barloom.llm.toxicity import clean_documents


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars after the text has changed; null where the text is."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.char_length("text").cast(kind))


_inner: list[str] = []


def _alone(stage):
    """Frees the tables that the stage before has left. Its result has been written by the time the next one is called; where
    ``docs`` is that result unwritten after all, nothing goes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _inner else []
        if not any(f"/{path.rsplit('/', 1)[1]}/" in f for path in _inner for f in files):
            delete(spark, _inner)
            _inner.clear()
        spark._jvm.System.gc()  # lets Spark drop the shuffle files of plans that nothing holds any more
        with tables() as mine:
            out = stage(spark, docs, sf_dir)
        _inner.extend(mine)
        return out

    return run


@_alone
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the string-kernel machine predicts toxic go, whatever their label; it learns from the labels beside the
    documents (not from held-out ids). Null and empty texts have no units and are kept; repeated rows go or stay together; an
    empty table stays empty; without labels of both kinds nothing goes. All columns pass as they are."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


@_alone
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, 0.8) the rows of the smallest id stay. Texts without words, null ones
    included, are linked with nothing and stay; rows of one id stay together; rows without an id stay only where
    no row of their component has one."""
    return one_of_each(docs)


@_alone
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every 50 bytes that also start in a document with a smaller id are cut, with the rest of a character that they break;
    rows of which nothing is left go. Texts that were empty or null stay; nothing of a document goes because of
    another row of its own id. n_chars is counted anew."""
    return _counted(without_repeats(docs))


@_alone
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret and every linked part is replaced by a mark; all rows stay, null texts stay null. n_chars is counted
    anew."""
    return _counted(masked_secrets(docs))


@_alone
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row's tokens with their sequences and offsets; a null or empty text is its end id alone."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("secrets", secrets), ("packing", packing)]

#: The stages can't be said in SQL; tests/llm/test_pipeline.py holds each one against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = last = written(stage(spark, docs, sf_dir), instead_of=last)
    return docs
