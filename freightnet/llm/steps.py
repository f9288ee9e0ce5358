"""Steps of a job that end in a written table."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame

from freightnet.scale import fresh_path

#: Writer options for rows of some MB each that are compressed already: by default a writer looks at its size after every
#: hundred rows, and holds them all until then.
LARGE_ROWS = {
    "compression": "uncompressed",
    "parquet.enable.dictionary": "false",
    "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size.row.check.max": "8",
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "8",
}


def step(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, read it back, and let go of the shuffle files that led to it.

    Spark removes the files of a shuffle once the driver has collected the objects that stand for it, which on an idle
    driver may be half an hour later; until then every step of a job would hold its disk.
    """
    path = fresh_path(df.sparkSession, "step")
    df.write.options(**(options or {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    del df
    for _ in range(2):  # the first round lets go of the Python handles, the second of what they stood for
        gc.collect()
        out.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return out


def forget(df: DataFrame) -> None:
    """Remove a table that ``step`` or ``cut`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
