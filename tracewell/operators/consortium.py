"""Circles over pseudonyms: candidates from bands and hours, then confirmed by the banks' exact figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.money import amount_band
from tracewell.operators import temporal
from tracewell.storage import store


def bucketed_rows(noded: DataFrame, cfg) -> DataFrame:
    """What the consortium shares of a transfer: txn_id, u, v, band, hour (epoch seconds)."""
    return noded.select("txn_id", "u", "v", amount_band(F.col("amount"), cfg.band_edges).alias("band"), (F.col("ts") - F.col("ts") % 3600).alias("hour"))


def circles(noded: DataFrame, cfg) -> DataFrame:
    """All walks over pseudonyms that return to their origin and that the banks' own figures confirm: path, hops.

    Of what the consortium sees, the next leg leaves the node that the last reached, its hour is not earlier and at most
    the window after the first, its band at most one off. A bank confirms a step if both legs are on one account, the next
    strictly later, and it keeps the share. Every condition of a confirmed path but its span is one of neighbouring legs,
    so each step is put to the bank as the walk takes it, and the span as the walk grows: nothing that can be confirmed is
    dropped, and walks that no bank would confirm are not carried on.
    """
    own = noded.select("txn_id", "ts", "src", "dst", "amount")
    legs = bucketed_rows(noded, cfg).join(own, "txn_id")
    right = store(legs.select(*[F.col(c).alias(f"n_{c}") for c in ("txn_id", "ts", "src", "dst", "amount", "u", "v", "band", "hour")]), "bucketed")
    front = store(legs.select(F.col("u").alias("origin"), F.col("v").alias("at"), "band", "hour", F.col("dst").alias("account"), "ts", "amount", (F.col("ts") + cfg.circle_window).alias("until"), F.array("txn_id").alias("path")), "bucketed-1")
    closed = None
    for hop in range(2, cfg.circle_max_hops + 1):
        j = temporal.range_join(front, right, [("account", "n_src")], F.col("ts") + 1, F.col("until"), "n_ts", cfg.circle_window)
        j = j.where((F.col("at") == F.col("n_u")) & (F.abs(F.col("n_band") - F.col("band")) <= 1) & (F.col("n_hour") >= F.col("hour")) & temporal.keeps("n_amount", "amount", cfg.circle_low, cfg.circle_high))
        j = j.select("origin", F.col("n_v").alias("at"), F.col("n_band").alias("band"), F.col("n_hour").alias("hour"), F.col("n_dst").alias("account"), F.col("n_ts").alias("ts"), F.col("n_amount").alias("amount"), "until", F.concat("path", F.array("n_txn_id")).alias("path"))
        front, n = temporal._guarded(j, f"bucketed-{hop}", cfg.most_paths)
        if hop >= cfg.circle_min_hops:
            back = front.where("at = origin").select("path", F.lit(hop).alias("hops"))
            closed = back if closed is None else closed.union(back)
        if not n:
            break
    return closed if closed is not None else front.limit(0).select("path", F.lit(0).alias("hops"))


def confirmed(paths: DataFrame, txn: DataFrame, cfg) -> DataFrame:
    """Paths whose legs follow each other on one account, strictly later, keep the share, and fit the window."""
    each = paths.withColumn("__id", F.array_join("path", ",")).select("__id", F.posexplode("path").alias("pos", "txn_id"))
    legs = each.join(txn.select("txn_id", "ts", "src", "dst", "amount"), "txn_id")
    order = Window.partitionBy("__id").orderBy("pos")
    for c in ("ts", "dst", "amount"):
        legs = legs.withColumn(f"b_{c}", F.lag(c).over(order))
    fine = F.col("b_ts").isNull() | ((F.col("src") == F.col("b_dst")) & (F.col("ts") > F.col("b_ts")) & temporal.keeps("amount", "b_amount", cfg.circle_low, cfg.circle_high))
    ok = legs.groupBy("__id").agg(F.min(fine).alias("fine"), (F.max("ts") - F.min("ts")).alias("span")).where(F.col("fine") & (F.col("span") <= cfg.circle_window))
    return paths.withColumn("__id", F.array_join("path", ",")).join(ok.select("__id"), "__id", "left_semi").drop("__id")
