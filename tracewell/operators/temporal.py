"""Joins and walks along time."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.storage import apart, store

STEP = {"txn_id": "n_txn", "ts": "n_ts", "src": "n_src", "dst": "n_dst", "amount": "n_amount", "payer": "n_payer", "payee": "n_payee"}


def steps(txn: DataFrame, *more: str) -> DataFrame:
    """Transfers with the names that the right side of a temporal join has; `more` names columns that come along as n_..."""
    return txn.select(*[F.col(a).alias(b) for a, b in STEP.items()], *[F.col(c).alias(f"n_{c}") for c in more])


def range_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], start: Column, end: Column, at: str, width: int) -> DataFrame:
    """Rows with equal keys and start <= at <= end.

    Time is cut into buckets as wide as the intervals: a left row goes to the one or two buckets that its interval
    meets, and the join is an equi-join on (keys, bucket), so a busy account is spread over its history.
    """
    spread = left.withColumns({"__start": start, "__end": end}).where("__start <= __end")
    spread = spread.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__start") / width), F.floor(F.col("__end") / width))))
    slotted = right.withColumn("__slot", F.floor(F.col(at) / width))
    on = (F.col("__bucket") == F.col("__slot")) & F.col(at).between(F.col("__start"), F.col("__end"))
    for a, b in keys:
        on = on & (spread[a] == slotted[b])
    return spread.join(slotted, on).drop("__start", "__end", "__bucket", "__slot")


def keeps(amount: str, before: str, low: Decimal, high: Decimal) -> Column:
    """Whether an amount is a share from low to high of the one before; exact in decimals."""
    return (F.col(amount) >= F.lit(low) * F.col(before)) & (F.col(amount) <= F.lit(high) * F.col(before))


def links(txn: DataFrame, window: int, low: Decimal, high: Decimal, *more: str) -> DataFrame:
    """Transfer pairs: the receiving account sends on within the window, keeping a share of the amount. `more` names further columns of the second transfer."""
    return range_join(txn, steps(txn, *more), [("dst", "n_src")], F.col("ts") + 1, F.col("ts") + window, "n_ts", window).where(keeps("n_amount", "amount", low, high))


def first_forward(txn: DataFrame, window: int, low: Decimal, high: Decimal) -> DataFrame:
    """For each transfer the earliest one that passes it on (as-of join with a condition): txn_id, f_txn, f_ts, f_dst, f_amount, f_payer, f_payee."""
    order = F.struct("n_ts", "n_txn")
    best = links(txn, window, low, high).groupBy("txn_id").agg(F.min_by(F.struct("n_txn", "n_ts", "n_dst", "n_amount", "n_payer", "n_payee"), order).alias("f"))
    return best.select("txn_id", *[F.col(f"f.n_{c}").alias(f"f_{c}") for c in ("txn", "ts", "dst", "amount", "payer", "payee")])


def _guarded(df: DataFrame, label: str, most: int) -> tuple[DataFrame, int]:
    df = store(df, label)
    n = df.count()
    if n > most:
        raise RuntimeError(f"{label}: {n} paths exceed the limit of {most}; narrow the window or the share")
    return df, n


def circle_walks(txn: DataFrame, cfg) -> DataFrame:
    """Distinct walks by account that return to the person who began them: path, amounts, times, hops, origin.

    Every hop is strictly later than the one before and within the window of the first. A walk goes on after a return.
    """
    right = store(steps(txn), "steps")
    front = txn.select(
        F.col("payer").alias("origin"), F.col("dst").alias("at"), (F.col("ts") + cfg.circle_window).alias("until"), "ts", "amount", F.col("payee").alias("holder"),
        F.array("txn_id").alias("path"), F.array("amount").alias("amounts"), F.array("ts").alias("times"),
    )
    front = store(front, "walk-1")
    closed = None
    for hop in range(2, cfg.circle_max_hops + 1):
        ahead = range_join(front, right, [("at", "n_src")], F.col("ts") + 1, F.col("until"), "n_ts", cfg.circle_window).where(keeps("n_amount", "amount", cfg.circle_low, cfg.circle_high))
        ahead = ahead.select(
            "origin", F.col("n_dst").alias("at"), "until", F.col("n_ts").alias("ts"), F.col("n_amount").alias("amount"), F.col("n_payee").alias("holder"),
            F.concat("path", F.array("n_txn")).alias("path"), F.concat("amounts", F.array("n_amount")).alias("amounts"), F.concat("times", F.array("n_ts")).alias("times"),
        )
        front, n = _guarded(ahead, f"walk-{hop}", cfg.most_paths)
        if hop >= cfg.circle_min_hops:
            back = front.where("holder = origin").select("path", "amounts", "times", "origin", F.lit(hop).alias("hops"))
            closed = back if closed is None else closed.union(back)
        if not n:
            break
    if closed is None:
        closed = front.limit(0).select("path", "amounts", "times", "origin", F.lit(0).alias("hops"))
    return closed.dropDuplicates(["path"])


def maximal_sets(sets: DataFrame, items: str) -> DataFrame:
    """Without the rows whose items are a proper subset of another row's items.

    A set can only lie inside sets that hold its rarest item, so each set asks under that one item alone.
    """
    ordered = F.array_sort(F.transform(items, lambda x: x.cast("string")))
    tagged = sets.withColumns({"__set": ordered, "__id": F.array_join(ordered, ",")})
    each = store(tagged.select("__id", "__set").distinct().select("__id", "__set", F.explode("__set").alias("item")), "set-items")
    often = each.groupBy("item").agg(F.count("*").alias("often"))
    rarest = each.join(often, "item").groupBy("__id", "__set").agg(F.min_by("item", F.struct("often", "item")).alias("item"))
    big = each.select(F.col("__set").alias("b_set"), "item").where(F.size("b_set") > 0)
    meet = rarest.join(big, "item").where((F.size("__set") < F.size("b_set")) & (F.size(F.array_except("__set", "b_set")) == 0))
    return tagged.join(meet.select("__id").distinct(), "__id", "left_anti").drop("__id", "__set")


def chains(link: DataFrame, cfg) -> DataFrame:
    """Maximal root-to-leaf paths over links (txn_id, ts, amount -> n_txn, n_ts, n_amount): path, amounts, times."""
    link = store(link.select("txn_id", "ts", "amount", "n_txn", "n_ts", "n_amount"), "links")
    start = link.join(link.select(F.col("n_txn").alias("txn_id")).distinct(), "txn_id", "left_anti")
    pair = lambda a, b: F.array(a, b)
    front = start.select(F.col("n_txn").alias("last"), pair("txn_id", "n_txn").alias("path"), pair("amount", "n_amount").alias("amounts"), pair("ts", "n_ts").alias("times"))
    more = link.select(F.col("txn_id").alias("last"), F.col("n_txn").alias("m_txn"), F.col("n_ts").alias("m_ts"), F.col("n_amount").alias("m_amount"))
    open_ends = more.select("last").distinct()
    done = None
    while True:
        front, n = _guarded(front, "chains", cfg.most_paths)
        ends = front.join(open_ends, "last", "left_anti").select("path", "amounts", "times")
        done = ends if done is None else done.union(ends)
        if not n:
            return done
        grown = front.join(more, "last")
        front = grown.select(F.col("m_txn").alias("last"), *[F.concat(c, F.array(f"m_{m}")).alias(c) for c, m in (("path", "txn"), ("amounts", "amount"), ("times", "ts"))])


def anchored(rows: DataFrame, keys: list[str], window: int, least: int, carry: list[str]) -> DataFrame:
    """Each row as the anchor of the rows after it in (ts, txn_id) order up to the window's end: a_txn, a_ts, a_slot and the members.

    Time is cut into stretches as wide as the window. An anchor stays in its own, a_slot; a member goes to its own and to
    the one before, so all of an anchor's members meet it under (keys, a_slot): groups by these and more columns need no
    further shuffle. A RANGE frame, which counts earlier rows of the same second too, only thins out anchors with fewer
    than `least` members.
    """
    slot = F.floor(F.col("ts") / window)
    slots = F.explode(F.array(slot, slot - 1))
    near = rows.select(*keys, "ts", "txn_id", slots.alias("__slot"))
    count = F.count("*").over(Window.partitionBy(*keys, "__slot").orderBy("ts").rangeBetween(0, window))
    heads = near.withColumn("__n", count).where((F.col("__slot") == slot) & (F.col("__n") >= least))
    heads = heads.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col("__slot").alias("a_slot"), F.col("ts").alias("a_ts"), F.col("txn_id").alias("a_txn"))
    members = rows.select(*keys, "ts", "txn_id", *carry, slots.alias("__slot"))
    on = (F.col("a_slot") == F.col("__slot")) & F.col("ts").between(F.col("a_ts"), F.col("a_ts") + window)
    for k in keys:
        on = on & (heads[f"a_{k}"] == members[k])
    out = heads.join(apart(members), on).drop("__slot")  # a broadcast would not deal the rows by key and slot
    return out.where((F.col("ts") > F.col("a_ts")) | (F.col("txn_id") >= F.col("a_txn")))


def first_of_pair(txn: DataFrame, a: Column, b: Column) -> DataFrame:
    """The first transfer of each pair of values, in (ts, txn_id) order."""
    order = Window.partitionBy(a, b).orderBy("ts", "txn_id")
    return txn.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
