"""Incremental audit of bars as they arrive. An extension: the inventory has no streams.

``bars`` is a stream of (event_time, id, source, feuillet, element, diametre, quantite); a bar sent again
within the watermark counts once, and windows of late data close with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import diameter_key, label_key


def running_quantities(bars: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Quantities of each side by sheet, element and diameter in each window, each bar once."""
    once = bars.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["id"])
    side = lambda s: F.sum(F.when(F.col("source") == s, F.col("quantite")))
    return once.groupBy(F.window("event_time", window).alias("period"), label_key("feuillet").alias("feuillet_n"), label_key("element").alias("element_n"), diameter_key("diametre").alias("diametre")).agg(
        side("plan").alias("plan"), side("atelier").alias("atelier"), F.count(F.lit(1)).alias("n")
    )
