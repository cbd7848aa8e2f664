"""Incremental fusion over a stream of samples.

A micro-batch is splatted and summed by (temporal block, node) and merged with the open blocks. A
block is closed when a sample of a later block arrives (or at the end of input, by ``flush``); closed
blocks are folded into the fused field. State is two versioned Parquet tables named by batch, so a
batch that is run again after a failure writes the same version and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.operators import field

OPEN = "block int, k bigint, value_sum double, weight_sum double, weight_max double"
FUSED = "k bigint, value_sum double, weight_sum double, hit_count bigint"


class FusedStream:
    """State of the fusion in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), -1

    def _read(self, name: str, schema: str, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v={version}")

    def field(self) -> DataFrame:
        """The fused field of all closed blocks."""
        return self._read("fused", FUSED, self.version)

    def update(self, samples: DataFrame, batch: int, close_all: bool = False) -> None:
        """Merge one micro-batch; ``samples``: block, x, y, z, value, weight."""
        before = batch - 1
        new = field.splat(samples, ["block"])
        both = self._read("open", OPEN, before).unionByName(new.select("block", "k", "value_sum", "weight_sum", "weight_max"))
        merged = both.groupBy("block", "k").agg(F.sum("value_sum").alias("value_sum"), F.sum("weight_sum").alias("weight_sum"), F.max("weight_max").alias("weight_max"))
        merged = merged.select(F.col("block").cast("int").alias("block"), "k", "value_sum", "weight_sum", "weight_max").persist()
        newest = merged.agg(F.max("block")).first()[0]
        closed = merged if close_all or newest is None else merged.where(F.col("block") < newest)
        still_open = merged.where("false") if close_all or newest is None else merged.where(F.col("block") == newest)
        done = field.bound_weights(closed).select("k", "value_sum", "weight_sum", F.lit(1).cast("bigint").alias("hit_count"))
        fused = self._read("fused", FUSED, before).unionByName(done).groupBy("k").agg(*[F.sum(c).alias(c) for c in ("value_sum", "weight_sum", "hit_count")])
        fused.write.mode("overwrite").parquet(f"{self.folder}/fused/v={batch}")
        still_open.write.mode("overwrite").parquet(f"{self.folder}/open/v={batch}")
        merged.unpersist()
        self.version = batch

    def flush(self) -> None:
        """End of input: the last block closes too."""
        nothing = self.spark.createDataFrame([], "block int, x double, y double, z double, value double, weight double")
        self.update(nothing, self.version + 1, close_all=True)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Take what is there of a stream, then flush."""
        query = stream.writeStream.foreachBatch(lambda rows, batch: self.update(rows, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        self.flush()
