"""Cutting lineage between steps of a loop, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint below ``spark.checkpoint.dir``; a folder of our own only if the session is on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = "file://" + tempfile.mkdtemp(prefix="loomfield-cut-")
        context.setCheckpointDir(named)
    return df.checkpoint()
