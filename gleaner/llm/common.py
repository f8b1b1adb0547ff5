"""What the operators of this subpackage share: scans, the shared work folder, batches of bounded size."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import ensure_checkpoint_dir
from gleaner.sources.tables import table

BATCH_CHARS = 4_000_000


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of the documents table; a null text is the empty text."""
    return table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, below the shared checkpoint folder of the cluster."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to a table in the shared work folder and read it back: cuts lineage and survives lost executors."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished, unreferenced jobs now instead of at the next driver collection.

    The first round frees the driver's handles, the second one what they held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def slices(texts: Iterable[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into runs of about ``limit`` characters (one text at least)."""
    start = size = 0
    n = 0
    for n, text in enumerate(texts, 1):
        size += len(text)
        if size >= limit:
            yield start, n
            start, size = n, 0
    if n > start:
        yield start, n
