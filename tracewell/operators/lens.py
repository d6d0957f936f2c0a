"""Relationship lens: five checks of a group of transfers against the whole bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import temporal
from tracewell.storage import store


def first_contacts(txn: DataFrame) -> DataFrame:
    """The first transfer of each ordered pair of people."""
    return temporal.first_of_pair(txn, F.col("payer"), F.col("payee"))


def shared_phones(people: DataFrame) -> DataFrame:
    """Phones of more than one person."""
    return people.where("phone is not null").groupBy("phone").agg(F.count("*").alias("n")).where("n > 1").select("phone")


def baseline(txn: DataFrame, accounts: DataFrame, people: DataFrame, cfg) -> DataFrame:
    """One row: fresh_rate, multi_rate, contact_rate, phone_rate."""
    fresh = accounts.agg(F.avg((F.col("age") < cfg.fresh_days).cast("int")).alias("fresh_rate"))
    owned = accounts.groupBy("person").count()
    multi = people.select("person").join(owned, "person", "left").agg(F.avg((F.coalesce("count", F.lit(0)) > 1).cast("int")).alias("multi_rate"))
    contact = first_contacts(txn).agg(F.count("*").alias("first")).crossJoin(txn.agg(F.count("*").alias("all"))).select((F.col("first") / F.col("all")).alias("contact_rate"))
    with_phone = people.join(shared_phones(people).withColumn("__s", F.lit(1)), "phone", "left")
    phone = with_phone.agg((F.count("__s") / F.count("*")).alias("phone_rate"))
    return fresh.crossJoin(multi).crossJoin(contact).crossJoin(phone)  # single rows


def measured(groups: DataFrame, txn: DataFrame, accounts: DataFrame, people: DataFrame, cfg) -> DataFrame:
    """Per group (group, txn_id): transfers, accounts, fresh, persons, multi, contacts, phones, blind_a, blind_b."""
    rows = store(groups.select("group", "txn_id").distinct().join(txn, "txn_id"), "lens-rows")
    ends = rows.select("group", F.explode(F.array("src", "dst")).alias("account")).distinct().join(accounts, "account", "left")
    acc = ends.groupBy("group").agg(F.count("*").alias("accounts"), F.count_if(F.col("age") < cfg.fresh_days).alias("fresh"))
    held = ends.where("person is not null").groupBy("group", "person").agg(F.count("*").alias("n"))
    own = held.groupBy("group").agg(F.count("*").alias("persons"), F.count_if(F.col("n") > 1).alias("multi"))
    phones = held.join(people.select("person", "phone"), "person").join(shared_phones(people), "phone", "left_semi").groupBy("group").agg(F.count_distinct("phone").alias("phones"))
    first = rows.join(first_contacts(txn).select("txn_id"), "txn_id", "left_semi").groupBy("group").agg(F.count("*").alias("contacts"))
    seen = lambda b: F.count_if((F.col("src_bank") != b) & (F.col("dst_bank") != b))
    out = rows.groupBy("group").agg(F.count("*").alias("transfers"), seen("BANK_A").alias("blind_a"), seen("BANK_B").alias("blind_b"))
    for part in (acc, own, first, phones):
        out = out.join(part, "group", "left")
    return out.fillna(0)


def signals(m: DataFrame, base: DataFrame, cfg) -> DataFrame:
    """group and the flags r1 .. r5 with n_signals."""
    share = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)
    enough = lambda n: F.col(n) >= cfg.lens_min_count
    j = m.crossJoin(F.broadcast(base))  # one row
    flags = {
        "r1": enough("fresh") & (share("fresh", "accounts") >= cfg.fresh_multiple * F.col("fresh_rate")),
        "r2": enough("multi") & (share("multi", "persons") >= cfg.control_multiple * F.col("multi_rate")),
        "r3": enough("contacts") & (share("contacts", "transfers") >= F.lit(float(cfg.contact_multiple)) * F.col("contact_rate")),
        "r4": F.col("phones") > 0, "r5": (F.col("blind_a") > 0) & (F.col("blind_b") > 0),
    }
    j = j.withColumns(flags)
    return j.select(*m.columns, *flags, sum((F.col(f).cast("int") for f in flags), F.lit(0)).alias("n_signals"))


def summary(s: DataFrame) -> DataFrame:
    """One row: groups, mean number of signals, share with two or more, rate of each."""
    return s.agg(F.count("*").alias("groups"), F.avg("n_signals").alias("mean_signals"), F.avg((F.col("n_signals") >= 2).cast("int")).alias("two_or_more"), *[F.avg(F.col(r).cast("int")).alias(f"{r}_rate") for r in ("r1", "r2", "r3", "r4", "r5")])


def control_groups(txn: DataFrame, sizes: DataFrame, per_case: int, involved: DataFrame | None = None, seed: int = 7, rounds: int = 4) -> DataFrame:
    """group, txn_id: neighbourhoods as large as the cases (group, people, transfers; three of each at least), grown from people drawn by hash.

    Each round adds neighbours of everyone in a group, drawn by hash, until the size is reached; the group's transfers are
    those among its people, as many as the case has. People of the cases (`involved`: person) are neither drawn nor
    joined. Groups without a transfer among themselves give no row.
    """
    if involved is not None:
        out = store(involved.select("person").distinct(), "involved")
        for side in ("payer", "payee"):
            txn = txn.join(out, F.col(side) == F.col("person"), "left_anti")
        txn = store(txn, "ordinary")
    near = store(txn.where("payer <> payee").select(F.col("payer").alias("p"), F.col("payee").alias("q")).union(txn.where("payer <> payee").select("payee", "payer")).distinct(), "neighbours")
    everyone = store(near.select("p").distinct(), "everyone")
    wanted = sizes.select(F.col("group").alias("case"), F.greatest(F.col("people").cast("int"), F.lit(3)).alias("people"), F.greatest(F.col("transfers").cast("int"), F.lit(3)).alias("transfers"), F.explode(F.sequence(F.lit(1), F.lit(per_case))).alias("k"))
    wanted = store(wanted.withColumn("group", F.concat_ws("#", F.col("case").cast("string"), F.col("k").cast("string"))), "controls")
    # every person has a rank: the place within its slot after the people of all slots before
    lot = everyone.withColumn("slot", F.pmod(F.xxhash64("p", F.lit(seed)), F.lit(1 << 10)))
    lot = lot.withColumn("nth", F.row_number().over(Window.partitionBy("slot").orderBy(F.xxhash64("p", F.lit(seed + 1)), "p")))
    before = F.sum("count").over(Window.orderBy("slot")) - F.col("count")  # at most 1,024 rows
    lot = lot.join(F.broadcast(lot.groupBy("slot").count().select("slot", before.alias("before"))), "slot").select("p", (F.col("before") + F.col("nth") - 1).alias("rank"))
    starts = wanted.withColumn("rank", F.pmod(F.xxhash64("group", F.lit(seed)), F.lit(max(1, everyone.count())))).join(lot, "rank")
    members = store(starts.select("group", "people", "transfers", "p"), "controls-0")
    # a person's neighbours have places in hash order; a group takes as many as it wants in all from a place of its own on, so that a hub's neighbours are never read whole
    place = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("p", "q", F.lit(seed)), "q"))
    slots = near.withColumn("slot", F.pmod(F.xxhash64("p", "q", F.lit(seed + 1)), F.lit(1 << 10))).withColumn("in_slot", place(["p", "slot"]))
    slots = store(slots, "slots")
    held = slots.groupBy("p", "slot").agg(F.count("*").alias("n"))
    held = held.select("p", "slot", (F.sum("n").over(Window.partitionBy("p").orderBy("slot")) - F.col("n")).alias("before"))  # at most 1,024 rows to a person
    places = store(slots.join(held, ["p", "slot"]).select("p", (F.col("before") + F.col("in_slot") - 1).alias("place"), "q"), "places")
    degree = store(near.groupBy("p").agg(F.count("*").alias("degree")), "degrees")
    for i in range(rounds):
        asked = members.join(degree, "p").withColumn("step", F.explode(F.sequence(F.lit(0), F.least(F.col("people").cast("long"), F.col("degree")).cast("int") - 1)))
        asked = asked.select("group", "people", "transfers", "p", F.pmod(F.xxhash64("group", "p", F.lit(seed)) % F.col("degree") + F.col("step"), F.col("degree")).alias("place"))
        more = asked.join(places, ["p", "place"]).select("group", "people", "transfers", F.col("q").alias("p"), F.lit(1).alias("new")).union(members.select("group", "people", "transfers", "p", F.lit(0).alias("new")))
        more = more.groupBy("group", "people", "transfers", "p").agg(F.min("new").alias("new"))
        rank = F.row_number().over(Window.partitionBy("group").orderBy("new", F.xxhash64("group", "p")))
        members = store(more.withColumn("__n", rank).where(F.col("__n") <= F.col("people")).drop("__n", "new"), f"controls-{i + 1}")
    a, b = members.select("group", "transfers", F.col("p").alias("payer")), members.select("group", F.col("p").alias("payee"))
    inside = a.join(b, "group").join(txn.select("payer", "payee", "txn_id", "ts"), ["payer", "payee"]).select("group", "transfers", "txn_id", "ts")
    rank = F.row_number().over(Window.partitionBy("group").orderBy("ts", "txn_id"))
    return inside.withColumn("__n", rank).where(F.col("__n") <= F.col("transfers")).select("group", "txn_id")
