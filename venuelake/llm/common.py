"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: whole texts travel in it, so it is kept far below Spark's default of 10,000.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Long texts go to Python in small Arrow batches, which bounds a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that spark.checkpoint.dir names; only where it is unset is one made, as in tests."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_base(df.sparkSession))
    return df.checkpoint(eager=True)


def _base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the one set on the context. Where neither is, a temporary folder serves
    one machine; a cluster is refused, as its executors would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder (see `_base`)."""
    return f"{_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as a compressed table in the shared folder and read from there, which cuts its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more rows than this, and than this part of all rows, is hot: there are fewer hot keys than parts.
HOT_ROWS, HOT_PARTS = 10_000, 100_000


def hot_above(counts: DataFrame, n: str = "n") -> float:
    """Rows above which a key of `counts` (a row a key, `n` its rows) is hot; so at most HOT_PARTS keys ever are."""
    return max(HOT_ROWS, (counts.agg(F.sum(n)).first()[0] or 0) / HOT_PARTS)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n", above: float | None = None) -> DataFrame:
    """`left` joined with `right`, which has one row a key and in `n` how many rows of `left` have it. The rows of hot keys
    stay where they are, as those few keys are broadcast (HOT_PARTS rows at most); only the others are shuffled."""
    above = hot_above(right, n) if above is None else above
    hot = checkpointed(right.filter(F.col(n) > above))
    if not hot.limit(1).count():
        return left.join(right, keys)
    sent = F.broadcast(hot)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.filter(F.col(n) <= above), keys)
    return left.join(sent, keys).unionByName(rest)


def nested(df: DataFrame) -> Column:
    """The whole row as one column `doc`, so that no name of its columns meets an operator's own; `doc.*` restores it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")


def content_hash(df: DataFrame) -> Column:
    """A hash of a row's columns; maps, which have no order, are left out."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does it at once unless the text has cased letters outside ASCII."""
    other_case = text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]")
    exact = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(other_case, exact).otherwise(F.lower(text))
