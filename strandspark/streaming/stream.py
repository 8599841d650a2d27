"""The first pass over a stream of reads: stateless, so each micro-batch is placed alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..config import Settings
from ..functions import scoring
from ..operators import align


def place_stream(spark: SparkSession, source: str, target: str, reference: str, matrix: np.ndarray | None = None, settings: Settings = Settings(), checkpoint: str | None = None) -> DataStreamWriter:
    """Watch a folder of Parquet reads (``ord``, ``id``, ``desc``, ``seq``, ``qual``, ``qual_sum``) and append placed reads to ``target``.

    Batches carry their number as a partition, so a batch that is done again replaces itself.
    """
    forward = scoring.flat(settings) if matrix is None else matrix
    reads = spark.readStream.schema("ord bigint, id string, desc string, seq string, qual string, qual_sum int").parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        align.first_pass(batch, reference, forward, settings).write.mode("overwrite").parquet(f"{target}/batch={number}")

    out = reads.writeStream.foreachBatch(write)
    return out.option("checkpointLocation", checkpoint) if checkpoint else out
