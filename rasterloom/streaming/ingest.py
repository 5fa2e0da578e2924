"""Continuous loading: image files that arrive in a folder become images of a store."""

from __future__ import annotations

from collections import deque
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom import api

#: Files that are loaded at the same time.
AT_ONCE = 4
FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, path: str, checkpoint: str, codec: str = "tiff", **options) -> StreamingQuery:
    """Load each new file of folder as the image named like the file, AT_ONCE at a time, and end when there are no more.

    Only the files' names are read here, their pixels by ranges. A batch that is run again finds its levels in the
    store and skips them, so every file is loaded once.
    """

    def load(batch: DataFrame, number: int) -> None:
        names = batch.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("image_id"))
        # each load is some jobs of its own; those of several files share the cluster
        with ThreadPoolExecutor(AT_ONCE) as pool:
            held: deque = deque()
            for row in names.toLocalIterator():
                held.append(pool.submit(api.ingest, spark, row["path"], path, row["image_id"], codec, **options))
                if len(held) >= 2 * AT_ONCE:
                    held.popleft().result()
            for one in held:
                one.result()

    files = spark.readStream.format("binaryFile").schema(FILES).load(folder)
    return files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
