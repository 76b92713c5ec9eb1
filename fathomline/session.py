"""Helpers for sessions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def materialized(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder that the session names (a temporary one where a local session names none).

    A plan that uses a step's result several times would otherwise compute all steps before it as many times.
    """
    context = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()
