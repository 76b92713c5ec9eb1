"""An extension beyond batch: altitudes of arriving pings, cleaned per survey as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(pings: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Per survey and window of event time ts: pings, known altitudes and their mean; later rows than ``late`` are dropped."""
    return pings.withWatermark("ts", late).groupBy("survey", F.window("ts", every).alias("w")).agg(F.count("*").alias("n_pings"), F.count("alt").alias("n_known"), F.avg("alt").alias("mean_alt")).select("survey", F.col("w.start").alias("start"), "n_pings", "n_known", "mean_alt")


def clamped(pings: DataFrame, limit: float = 15.0) -> DataFrame:
    """survey, i, clamped: the jump limit with the last output of each survey as state. Unknown altitudes repeat it."""

    def scan(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("i")
        out = []
        for x in rows["alt"]:
            if x == x and x is not None:
                last = x if last is None else last + max(-limit, min(limit, x - last))
            out.append(last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"survey": key[0], "i": rows["i"].to_numpy(), "clamped": pd.array(out, dtype="Float64").to_numpy(dtype=float, na_value=float("nan"))})

    return pings.groupBy("survey").applyInPandasWithState(scan, "survey long, i long, clamped double", "last double", "append", "NoTimeout")
