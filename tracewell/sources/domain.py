"""The domain files as the bank that the detectors work on: transfers meet the owners of both accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources import files
from tracewell.sources.adapters import Bank
from tracewell.storage import store


class MissingOwners(ValueError):
    """Transfers name accounts that nobody owns."""


def owned(txn: DataFrame, owners: DataFrame) -> DataFrame:
    """Transfers with payer and payee, the owners of both accounts. An account without an owner is an error, never a lost row."""
    o = owners.select("account_id", "entity_key").dropDuplicates(["account_id"])
    ends = txn.select(F.explode(F.array("from_account", "to_account")).alias("account_id")).distinct()
    lost = ends.join(o, "account_id", "left_anti")
    if few := lost.limit(5).collect():
        raise MissingOwners(f"accounts without an owner, among them {sorted(str(r[0]) for r in few)}")
    payer = o.select(F.col("account_id").alias("from_account"), F.col("entity_key").alias("payer"))
    payee = o.select(F.col("account_id").alias("to_account"), F.col("entity_key").alias("payee"))
    return txn.join(payer, "from_account").join(payee, "to_account")


def transfers(txn: DataFrame, owners: DataFrame) -> DataFrame:
    """What the operators call a transfer: txn_id, ts, src, dst, amount, channel, src_bank, dst_bank, payer, payee."""
    t = owned(txn, owners)
    return t.select("txn_id", "ts", F.col("from_account").alias("src"), F.col("to_account").alias("dst"), "amount", "channel", F.col("from_bank").alias("src_bank"), F.col("to_bank").alias("dst_bank"), "payer", "payee")


def bank(txn: DataFrame, accounts: DataFrame, owners: DataFrame, entities: DataFrame) -> Bank:
    """Transfers, accounts with their owners and ages, and people, from the readers' tables."""
    held = accounts.join(owners.select("account_id", "entity_key"), "account_id")
    held = held.select(F.col("account_id").alias("account"), F.col("entity_key").alias("person"), "bank", F.col("opened_days_ago").alias("age"))
    people = entities.select(F.col("entity_key").alias("person"), F.col("canonical_name").alias("name"), "is_watchlisted", "has_unverified_link", "pan", "phone")
    return Bank(store(transfers(txn, owners), "transfers"), store(held, "accounts"), store(people, "people"))


def load_bank(spark: SparkSession, folder: str, owners: DataFrame | None = None, entities: DataFrame | None = None) -> Bank:
    """The bank of a folder with transactions.csv and accounts.csv; owners and entities are read there too unless given."""
    owners = files.account_owners(spark, f"{folder}/account_owners.csv") if owners is None else owners
    entities = files.resolved_entities(spark, f"{folder}/resolved_entities.csv") if entities is None else entities
    return bank(files.transactions(spark, f"{folder}/transactions.csv"), files.accounts(spark, f"{folder}/accounts.csv"), owners, entities)
