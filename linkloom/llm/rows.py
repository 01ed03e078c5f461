"""Documents with all columns but the text put aside, so that no column of the caller's can clash with a working column; written steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import shared_dir


def pack(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``_rest`` (every column but the text), ``doc_id`` and ``text``."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    return docs.select(rest.alias("_rest"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def unpack(packed: DataFrame, like: DataFrame, text: str) -> DataFrame:
    """The columns of ``like``, in their order, with the text as it now is."""
    return packed.select(*[(F.col("text") if c == text else F.col("_rest").getField(c)).alias(c) for c in like.columns])


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Unlike a checkpoint the result has the size of its files for statistics, so steps that feed on each other's joins do not multiply estimates.
    """
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
