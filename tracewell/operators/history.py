"""Questions about an account, a person, a set of transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import temporal
from tracewell.operators.detectors import touches
from tracewell.storage import store


def account_history(txn: DataFrame) -> DataFrame:
    """account, in and out counts and sums, counterparties, first and last second."""
    t = touches(txn).withColumn("other", F.when(F.col("is_sender"), F.col("dst")).otherwise(F.col("src")))
    zero = F.lit(0).cast("decimal(18,2)")
    return t.groupBy("account").agg(
        F.count_if("is_sender").alias("n_out"), F.count_if(~F.col("is_sender")).alias("n_in"), F.sum(F.when(F.col("is_sender"), F.col("amount")).otherwise(zero)).alias("total_out"), F.sum(F.when(~F.col("is_sender"), F.col("amount")).otherwise(zero)).alias("total_in"),
        F.count_distinct("other").alias("counterparties"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def fastest_forward(txn: DataFrame, share: str = "0.50", window: int = 86400) -> DataFrame:
    """account, fastest_s: least delay from an incoming leg to an outgoing one, not earlier, of at least a share of it.

    The delay has no limit. Accounts that have such a pair within the window are settled by it; the others, which are
    quiet or shrink every amount, look again with a window sixteen times as wide until it spans all of time.
    """
    span = txn.agg(F.max("ts") - F.min("ts")).first()[0] or 0
    legs = store(txn.select("txn_id", "ts", "src", "dst", "amount"), "legs")
    open_accounts, out = None, None
    while True:
        left = legs if open_accounts is None else legs.join(open_accounts, F.col("dst") == F.col("o_account"), "left_semi")
        right = legs.select(F.col("ts").alias("n_ts"), F.col("src").alias("n_src"), F.col("amount").alias("n_amount"))
        if open_accounts is not None:
            right = right.join(open_accounts, F.col("n_src") == F.col("o_account"), "left_semi")
        j = temporal.range_join(left, right, [("dst", "n_src")], F.col("ts"), F.col("ts") + window, "n_ts", window)
        j = j.where(F.col("n_amount") >= F.lit(share).cast("decimal(3,2)") * F.col("amount"))
        found = store(j.groupBy(F.col("dst").alias("account")).agg(F.min(F.col("n_ts") - F.col("ts")).alias("fastest_s")), "fastest")
        out = found if out is None else out.union(found)
        if window > span:
            return out
        both = left.select(F.col("dst").alias("o_account")).distinct().join(right.select(F.col("n_src").alias("o_account")).distinct(), "o_account", "left_semi")
        open_accounts = store(both.join(found, F.col("o_account") == F.col("account"), "left_anti"), "open-accounts")
        if open_accounts.isEmpty():
            return out
        window *= 16


def counterparties(txn: DataFrame, top: int = 8) -> DataFrame:
    """person, other, n, volume, rank: the people that each deals with most by volume."""
    both = txn.where("payer <> payee").select(F.col("payer").alias("person"), F.col("payee").alias("other"), "amount").union(txn.where("payer <> payee").select("payee", "payer", "amount"))
    g = both.groupBy("person", "other").agg(F.count("*").alias("n"), F.sum("amount").alias("volume"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("person").orderBy(F.desc("volume"), "other"))).where(F.col("rank") <= top)


def bank_visibility(groups: DataFrame, txn: DataFrame) -> DataFrame:
    """group, transfers, seen_a, seen_b, both: how many of a group's transfers each bank sees."""
    sees = lambda b: (F.col("src_bank") == b) | (F.col("dst_bank") == b)
    j = groups.join(txn, "txn_id")
    return j.groupBy("group").agg(F.count("*").alias("transfers"), F.count_if(sees("BANK_A")).alias("seen_a"), F.count_if(sees("BANK_B")).alias("seen_b"), F.count_if(sees("BANK_A") & sees("BANK_B")).alias("both"))


def median_account_age(accounts: DataFrame) -> DataFrame:
    return accounts.agg(F.percentile("age", F.lit(0.5)).alias("median_age_days"))
