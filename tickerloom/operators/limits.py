"""Request limiting over an event log, in both readings of the limiter.

Neither form orders a whole client in one task. Time is cut into slices of one window length and
each (client, slice) is a group of its own, so a client with a third of all calls is spread over
its slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.params import DEFAULTS, Params

_MICROS = 1_000_000


def sliding(
    events: DataFrame, client: str, ts: str, call: str, params: Params = DEFAULTS
) -> DataFrame:
    """Calls of the client in the closed window that ends at each call.

    A window reaches back into at most one earlier slice, so each call is placed in its own slice
    and, as context only, in the next.
    """
    width = params.rate_window_seconds * _MICROS
    placed = events.select(
        F.col(client).alias("client"), F.col(call).alias("call"), F.col(ts).alias("ts"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
    ).withColumn("slice", F.floor(F.col("at") / width))
    copies = placed.select(
        "client", "call", "ts", "at", F.explode(F.array(F.lit(0), F.lit(1))).alias("shift"), "slice"
    ).withColumn("slice", F.col("slice") + F.col("shift"))
    window = Window.partitionBy("client", "slice").orderBy("at").rangeBetween(-width, 0)
    counted = copies.withColumn("calls_in_window", F.count("*").over(window))
    return counted.filter(F.col("shift") == 0).select(
        "client", "call", "ts", "calls_in_window",
        (F.col("calls_in_window") > params.rate_limit).alias("limited"),
    )


def idle_reset(
    events: DataFrame, client: str, ts: str, call: str, params: Params = DEFAULTS
) -> DataFrame:
    """A counter that starts again only after a client has been idle for longer than the window.

    Inside a slice no gap can exceed the window, so a counter can only start again at the first
    call of a slice. Slices therefore carry whole counters, and the totals carried from slice to
    slice are found on the much smaller (client, slice) table.
    """
    width = params.rate_window_seconds * _MICROS
    placed = events.select(
        F.col(client).alias("client"), F.col(call).alias("call"), F.col(ts).alias("ts"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
    ).withColumn("slice", F.floor(F.col("at") / width))
    slices = placed.groupBy("client", "slice").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n")
    )
    order = Window.partitionBy("client").orderBy("slice")
    gap = F.col("first_at") - F.lag("last_at").over(order)
    runs = slices.withColumn("starts", F.coalesce((gap > width).cast("int"), F.lit(1))).withColumn(
        "run", F.sum("starts").over(order)
    )
    earlier = (
        Window.partitionBy("client", "run").orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = runs.select(
        "client", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried")
    )
    inside = Window.partitionBy("client", "slice").orderBy("at", "call")
    counted = placed.withColumn("position", F.row_number().over(inside)).join(
        carried, ["client", "slice"]
    )
    calls = F.col("carried") + F.col("position")
    return counted.select(
        "client", "call", "ts", calls.alias("calls_since_idle"),
        (calls > params.rate_limit).alias("limited"),
    )
