"""The synthetic tables seen as bank data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bank:
    """What the detectors need: transfers, accounts, people."""

    txn: DataFrame  # txn_id, ts (epoch seconds), src, dst, amount, channel, src_bank, dst_bank, payer, payee
    accounts: DataFrame  # account, person, bank, age
    people: DataFrame  # person, is_watchlisted, pan


def of_account(account):
    return F.floor(account / 2).cast("long")


def bank_of(account):
    return F.when(account % 2 == 0, "BANK_A").otherwise("BANK_B")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as transfers: the user pays account props.k the value; a purchase is cash; accounts 2n and 2n + 1 are one person's, at two banks."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    src, dst = F.col("user_id"), F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("txn_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), src.alias("src"), dst.alias("dst"),
        F.col("value").cast("decimal(18,2)").alias("amount"), F.when(F.col("event_type") == "purchase", "CASH").otherwise(F.col("event_type")).alias("channel"),
        bank_of(src).alias("src_bank"), bank_of(dst).alias("dst_bank"), of_account(src).alias("payer"), of_account(dst).alias("payee"),
    )


def bank(spark: SparkSession, sf_dir: str) -> Bank:
    txn = transfers(spark, sf_dir)
    accounts = accounts_of(txn)
    return Bank(txn, accounts, people_of(accounts))


def accounts_of(txn: DataFrame) -> DataFrame:
    accounts = txn.select(F.explode(F.array("src", "dst")).alias("account")).distinct()
    return accounts.select("account", of_account(F.col("account")).alias("person"), bank_of(F.col("account")).alias("bank"), (F.col("account") * 37 % 1000).alias("age"))


def people_of(accounts: DataFrame) -> DataFrame:
    p = F.col("person")
    return accounts.select("person").distinct().select(p, (p % 17 == 0).alias("is_watchlisted"), F.when(p % 5 != 0, F.concat(F.lit("PAN"), F.lpad(p.cast("string"), 7, "0"))).alias("pan"))


# The name lists of the adapter.
FIRST = "asha ravi meera john mary arun divya peter sunil leela omar nina".split()
LAST = "bose iyer khan roy das menon gill paul nair sethi ashcraft rao".split()


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`customer` as dirty identity records: three to a person, six to an address, two to an account."""
    k = F.col("c_custkey")
    e = F.floor(k / 3).cast("long")
    first = F.element_at(F.array(*map(F.lit, FIRST)), (e % 12 + 1).cast("int"))
    last = F.element_at(F.array(*map(F.lit, LAST)), (F.floor(e / 12) % 12 + 1).cast("int"))
    full = F.concat_ws(" ", F.initcap(first), F.initcap(last))
    variant = k % 5
    name = (
        F.when(variant == 0, full).when(variant == 1, F.concat(F.upper(F.substring(first, 1, 1)), F.lit(". "), F.initcap(last))).when(variant == 2, F.upper(full))
        .when(variant == 3, F.concat_ws(" ", F.initcap(last), F.initcap(first))).otherwise(F.concat(full, F.lit(" & Sons")))
    )
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("REC"), F.lpad(k.cast("string"), 9, "0")).alias("record_id"),
        F.when(k % 31 == 0, "WATCHLIST").when(k % 2 == 0, "RETAIL_CBS").otherwise("CORPORATE_BANKING").alias("source_system"), name.alias("name_as_written"),
        F.when(k % 4 != 0, F.concat(F.lit("9"), F.lpad((e * 7919 % 1000000000).cast("string"), 9, "0"))).alias("phone"),
        F.when(~(k % 5).isin(1, 3), F.concat(F.lit("PAN"), F.lpad(e.cast("string"), 7, "0"))).alias("pan"),
        F.when(k % 7 != 2, F.concat(F.lit("ADDR"), F.floor(k / 6).cast("string"))).alias("address"),
        F.concat(F.lit("ACC"), F.lpad(F.floor(k / 2).cast("string"), 9, "0")).alias("linked_account"),
    )
