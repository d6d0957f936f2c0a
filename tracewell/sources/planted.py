"""A made-up bank with planted rings, in the schemas of the domain files.

People, accounts and ordinary traffic come from ranges and hashes, so any size can be made in parallel; the rings are a few
rows each. Everything hangs on the seed.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources import schemas
from tracewell.sources.adapters import FIRST, LAST

START, DAYS = 1_717_200_000, 30  # 2024-06-01
BANKS = "AABBAB"  # of a ring's accounts in turn, so that each bank misses a hop
CHANNELS = ["UPI", "IMPS", "NEFT", "RTGS", "CASH"]
#: ring, kind, size
RINGS = [
    ("CIRC_3_A", "CIRCULAR", 3), ("CIRC_4_A", "CIRCULAR", 4), ("CIRC_5_A", "CIRCULAR", 5), ("CIRC_5_B", "CIRCULAR", 5), ("CIRC_6_A", "CIRCULAR", 6), ("CIRC_7_SUBTLE", "CIRCULAR", 7), ("CIRC_6_HERO", "CIRCULAR", 6),
    ("MULE_A", "MULE", 12), ("MULE_B", "MULE", 10), ("VELOCITY_A", "VELOCITY", 5), ("VELOCITY_B", "VELOCITY", 6), ("STRUCT_A", "STRUCTURING", 9),
]


def _lot(n: int, *salt) -> Column:
    return F.pmod(F.xxhash64(*salt), F.lit(n))


def account_id(k: Column) -> Column:
    return F.format_string("ACC%05d", k)


def bank_sequence(size: int) -> list[str]:
    return [f"BANK_{BANKS[i % len(BANKS)]}" for i in range(size)]


def accounts(spark: SparkSession, people: int, seed: int = 1) -> DataFrame:
    """Two accounts for every third person, one for the others: account number k of person k % people."""
    k = F.col("id")
    return spark.range(people + people // 3).select(
        account_id(k).alias("account_id"), F.format_string("HOLDER %05d", k).alias("name"), F.when(_lot(4, k, F.lit(seed)) == 0, "BUSINESS").otherwise("PERSONAL").alias("account_type"),
        F.element_at(F.array(*map(F.lit, bank_sequence(6))), (k % 6 + 1).cast("int")).alias("bank"), (_lot(3000, k, F.lit(seed + 1)) + 60).cast("int").alias("opened_days_ago"), F.lit("FULL").alias("kyc_level"),
        F.format_string("ENT%05d", k % people).alias("owner_entity"),
    )


def customer_records(spark: SparkSession, people: int, seed: int = 1) -> DataFrame:
    """A record to an account with a dirtied name: an initial, capitals, turned tokens, a business suffix, a lost letter, two letters swapped. Every account keeps its PAN or its owner's phone, so that copies can be found."""
    k = F.col("id")
    e = k % people
    pick = lambda xs, lot: F.element_at(F.array(*map(F.lit, xs)), (lot + 1).cast("int"))
    first, last = pick(FIRST, _lot(len(FIRST), e, F.lit(seed + 2))), pick(LAST, _lot(len(LAST), e, F.lit(seed + 3)))
    full = F.concat_ws(" ", F.initcap(first), F.initcap(last))
    lost = F.concat(F.substring(full, 1, 2), F.substring(full, 4, 99))
    swapped = F.concat(F.substring(full, 1, 1), F.substring(full, 3, 1), F.substring(full, 2, 1), F.substring(full, 4, 99))
    dirty = [full, F.concat(F.upper(F.substring(first, 1, 1)), F.lit(". "), F.initcap(last)), F.upper(full), F.concat_ws(" ", F.initcap(last), F.initcap(first)), F.concat(full, F.lit(" & Sons")), lost, swapped]
    blank = _lot(5, k, F.lit(seed + 4))
    return spark.range(people + people // 3).select(
        F.format_string("REC%06d", k).alias("record_id"), F.when(_lot(60, e, F.lit(seed + 5)) == 0, "WATCHLIST").when(k % 2 == 0, "RETAIL_CBS").otherwise("CORPORATE_BANKING").alias("source_system"),
        F.element_at(F.array(*dirty), (_lot(len(dirty), k, F.lit(seed + 6)) + 1).cast("int")).alias("name_as_written"), F.when(blank != 0, F.format_string("9%09d", e * 7919 + 13)).alias("phone"),
        F.when(blank != 1, F.format_string("PAN%07d", e)).alias("pan"), F.when(blank != 2, F.format_string("%d Main Road", e)).alias("address"), account_id(k).alias("linked_account"), F.format_string("ENT%05d", e).alias("true_entity_id"),
    )


def _ring_rows(name: str, kind: str, size: int, at: int, ts: int) -> list[tuple]:
    """(ring, kind, seconds, from, to, amount, channel) of one ring whose people have the account numbers from `at` on."""
    cents = lambda x: Decimal(round(x * 100)) / 100
    principal = 24_000_000.0 if name == "CIRC_6_HERO" else 137_450.25 + 1_111.5 * at
    rows = []
    if kind == "CIRCULAR":
        for i in range(size):
            rows.append((ts + i * 5 * 3600 + i * 977, at + i, at + (i + 1) % size, cents(principal * 0.985**i), "RTGS"))
    elif kind == "MULE":
        source, collector = at, at + 1
        for i in range(size):
            amount = 31_217.4 + 211.3 * i
            rows.append((ts + i * 700, source, at + 2 + i, cents(amount), "UPI"))
            rows.append((ts + i * 700 + 1500, at + 2 + i, collector, cents(amount * 0.96), "IMPS"))
    elif kind == "VELOCITY":
        for i in range(size):
            rows.append((ts + i * 1320, at + i, at + i + 1, cents(principal * 0.97**i), "IMPS"))
    else:
        for i in range(size):
            rows.append((ts + i * 47_000, at + 1 + i, at, cents(48_003.5 + 137.25 * i), "CASH"))
    return [(name, kind, *r) for r in rows]


def planted(spark: SparkSession, people: int = 400, traffic: int = 4000, seed: int = 1) -> dict[str, DataFrame]:
    """transactions, accounts, customer_records, ground_truth. A ring's people each use their first account; bank names follow the accounts."""
    rows, at = [], 7
    for n, (name, kind, size) in enumerate(RINGS):
        rows += _ring_rows(name, kind, size, at, START + (2 + 2 * n) * 86_400 + 3600 * n)
        at += size + 3
    if at > people:
        raise ValueError(f"the rings need {at} people")
    ring = spark.createDataFrame(rows, "ring_id string, ring_type string, ts long, f long, t long, amount decimal(18,2), channel string")
    k, n_accounts = F.col("id"), people + people // 3
    f, t = _lot(n_accounts, k, F.lit(seed + 7)), _lot(n_accounts, k, F.lit(seed + 8))
    amount = ((_lot(4_000_000, k, F.lit(seed + 9)) + 50_000) / 100).cast("decimal(18,2)")
    ordinary = spark.range(traffic).select(
        F.lit(None).cast("string").alias("ring_id"), F.lit(None).cast("string").alias("ring_type"), (F.lit(START) + _lot(DAYS * 86_400, k, F.lit(seed + 10))).alias("ts"),
        f.alias("f"), F.when(f == t, (t + 1) % n_accounts).otherwise(t).alias("t"), amount.alias("amount"), F.element_at(F.array(*map(F.lit, CHANNELS)), (_lot(5, k, F.lit(seed + 11)) + 1).cast("int")).alias("channel"),
    )
    bank = lambda c: F.element_at(F.array(*map(F.lit, bank_sequence(6))), (F.col(c) % 6 + 1).cast("int"))
    every = ordinary.union(ring).withColumn("txn_id", F.format_string("TXN%06d", F.pmod(F.xxhash64("ts", "f", "t", "amount"), F.lit(1 << 40))))
    txn = every.select("txn_id", F.timestamp_seconds("ts").cast("timestamp_ntz").alias("timestamp"), account_id(F.col("f")).alias("from_account"), account_id(F.col("t")).alias("to_account"), "amount", "channel", bank("f").alias("from_bank"), bank("t").alias("to_bank"))
    return {"transactions": txn, "accounts": accounts(spark, people, seed), "customer_records": customer_records(spark, people, seed), "ground_truth": every.where("ring_id is not null").select("txn_id", "ring_id", "ring_type")}


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """The tables as CSV files with headers, columns in the order of their schemas."""
    shapes = {"transactions": schemas.TRANSACTIONS, "accounts": schemas.ACCOUNTS, "customer_records": schemas.CUSTOMER_RECORDS, "ground_truth": schemas.GROUND_TRUTH}
    for name, df in tables.items():
        df.select(*[c.split()[0] for c in shapes[name].split(", ")]).write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{folder}/{name}.csv", header=True)
