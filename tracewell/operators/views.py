"""Money graph under a view: everything, one bank, or the pseudonymous consortium."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.money import amount_band, hour_bucket
from tracewell.functions.privacy import evidence_ref, pseudonym

VIEWS = ("ALL", "BANK_A", "BANK_B", "CONSORTIUM")
#: Columns that a consortium table must never have.
FORBIDDEN = {"canonical_name", "phone", "pan", "address", "account_ids", "total_amount", "amount", "person"}


def _known(view: str) -> str:
    if view not in VIEWS:
        raise ValueError(f"unknown view {view!r}")
    return view


def visible(txn: DataFrame, view: str) -> DataFrame:
    """The transfers that a view sees: for a bank those with a leg of its own."""
    return txn.where((F.col("src_bank") == view) | (F.col("dst_bank") == view)) if _known(view).startswith("BANK") else txn


def with_nodes(txn: DataFrame, people: DataFrame, view: str, salt: str = "") -> DataFrame:
    """Adds u and v, the nodes of both ends: the person, or in a bank's view EXT_ and the account where it is not its own, or the pseudonym."""
    txn = visible(txn, view)
    if view == "CONSORTIUM":
        for side, bank, node in (("payer", "src_bank", "u"), ("payee", "dst_bank", "v")):
            p = people.select(F.col("person").alias("p_person"), F.col("pan").alias("p_pan"))
            txn = txn.join(p, F.col(side) == F.col("p_person"), "left").withColumn(node, pseudonym(F.col(side), F.col("p_pan"), F.col(bank), salt)).drop("p_person", "p_pan")
        return txn
    for side, account, bank, node in (("payer", "src", "src_bank", "u"), ("payee", "dst", "dst_bank", "v")):
        own = F.lit(True) if view == "ALL" else F.col(bank) == view
        txn = txn.withColumn(node, F.when(own, F.col(side).cast("string")).otherwise(F.concat(F.lit("EXT_"), F.col(account).cast("string"))))
    return txn


def in_order(*columns: str):
    """The last column's values in the order of the columns before it."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*columns))), lambda x: x[columns[-1]])


def edges(noded: DataFrame) -> DataFrame:
    """One edge to each ordered pair of nodes."""
    return noded.groupBy("u", "v").agg(
        F.count("*").alias("txn_count"), F.sum("amount").alias("total_amount"), F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.array_sort(F.collect_set("channel")).alias("channels"), in_order("ts", "txn_id").alias("txn_ids"), F.max(F.col("src_bank") != F.col("dst_bank")).alias("crosses_banks"),
    ).withColumn("is_self_transfer", F.col("u") == F.col("v"))


def consortium_edges(noded: DataFrame, cfg, salt: str) -> DataFrame:
    """Edges without amounts or times: bands, hours and hashed references."""
    return noded.groupBy("u", "v").agg(
        F.count("*").alias("txn_count"), F.array_sort(F.collect_set(amount_band(F.col("amount"), cfg.band_edges))).alias("amount_bands"), F.array_sort(F.collect_set(hour_bucket(F.col("ts")))).alias("hour_buckets"),
        F.max(F.col("src_bank") != F.col("dst_bank")).alias("crosses_banks"), F.array_sort(F.collect_list(evidence_ref(F.col("txn_id"), salt))).alias("evidence_refs"),
    ).withColumn("is_self_transfer", F.col("u") == F.col("v"))


def node_flow(edge: DataFrame) -> DataFrame:
    """total_sent, total_received and txn_count of each node; a self-transfer counts at both ends."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("total_amount").alias("sent"), F.lit(None).cast("decimal(38,2)").alias("received")), F.struct(F.col("v").alias("node"), F.lit(None).cast("decimal(38,2)").alias("sent"), F.col("total_amount").alias("received")))
    both = edge.select("txn_count", F.explode(ends).alias("e")).select("txn_count", "e.*")
    return both.groupBy("node").agg(F.coalesce(F.sum("sent"), F.lit(0)).alias("total_sent"), F.coalesce(F.sum("received"), F.lit(0)).alias("total_received"), F.sum("txn_count").alias("txn_count"))


def node_attributes(noded: DataFrame, accounts: DataFrame, people: DataFrame, view: str) -> DataFrame:
    """Nodes of a view that is not the consortium: is_external, is_watchlisted, account_ids, banks_used. A bank sees its own accounts only."""
    ends = noded.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("payer").alias("person"), F.col("src").alias("account"), F.col("src_bank").alias("bank")), F.struct(F.col("v").alias("node"), F.col("payee").alias("person"), F.col("dst").alias("account"), F.col("dst_bank").alias("bank")))).alias("e")).select("e.*")
    ends = ends.withColumn("is_external", F.col("node").startswith("EXT_")).distinct()
    outside = ends.where("is_external").groupBy("node").agg(F.array_sort(F.collect_set("account")).alias("account_ids"), F.array_sort(F.collect_set("bank")).alias("banks_used"))
    outside = outside.select("node", F.lit(True).alias("is_external"), F.lit(False).alias("is_watchlisted"), "account_ids", "banks_used")
    held = accounts if view == "ALL" else accounts.where(F.col("bank") == view)
    held = held.groupBy("person").agg(F.array_sort(F.collect_set("account")).alias("account_ids"), F.array_sort(F.collect_set("bank")).alias("banks_used"))
    inside = ends.where("not is_external").select("node", "person").distinct().join(held, "person").join(people.select("person", "is_watchlisted"), "person")
    return outside.unionByName(inside.select("node", F.lit(False).alias("is_external"), "is_watchlisted", "account_ids", "banks_used"))


def degrees(edge: DataFrame) -> DataFrame:
    """Edges in and out of each node; a loop counts twice."""
    return edge.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def stats(edge: DataFrame) -> DataFrame:
    """One row: nodes, edges, self_edges, cross_bank_edges."""
    n = degrees(edge).agg(F.count("*").alias("nodes"))
    e = edge.agg(F.count("*").alias("edges"), F.count_if("is_self_transfer").alias("self_edges"), F.count_if("crosses_banks").alias("cross_bank_edges"))
    return n.crossJoin(e)  # two single rows


def account_banks(txn: DataFrame) -> DataFrame:
    """account, bank, conflict: the bank of an account by the transfers; with several the greatest name, and conflict says so."""
    legs = txn.select(F.explode(F.array(F.struct(F.col("src").alias("account"), F.col("src_bank").alias("bank")), F.struct(F.col("dst").alias("account"), F.col("dst_bank").alias("bank")))).alias("l")).select("l.*")
    return legs.groupBy("account").agg(F.max("bank").alias("bank"), (F.min("bank") != F.max("bank")).alias("conflict"))


def shares(stats: DataFrame) -> DataFrame:
    """view, share: a view's edges against those of ALL, in whole percent, from the table of stats with its column view."""
    every = stats.where("view = 'ALL'").select(F.col("edges").alias("__all"))
    return stats.crossJoin(every).select("view", F.concat(F.bround(F.col("edges") * 100 / F.col("__all")).cast("long").cast("string"), F.lit("%")).alias("share"))  # one row on the right


def leaks(table: DataFrame) -> list[str]:
    """What a consortium table must not hold: forbidden columns, and id columns with ids that are no pseudonyms."""
    bad = sorted(set(table.columns) & FORBIDDEN)
    ids = [c for c in ("u", "v", "node") if c in table.columns]
    for c in ids:
        if not table.where(~F.col(c).rlike("^PSU_[0-9a-f]{16}$")).isEmpty():
            bad.append(c)
    return bad


def reachable(edge: DataFrame, start: DataFrame, most: int = 1000):
    """(origin, node): what each start node reaches, itself included only by a walk. For small graphs such as one ring."""
    from tracewell.storage import store

    e = store(edge.select("u", "v").distinct(), "reach-edges")
    seen = store(start.select(F.col("node").alias("origin")).join(e, F.col("origin") == F.col("u")).select("origin", F.col("v").alias("node")).distinct(), "reach")
    n = seen.count()
    for _ in range(most):
        more = seen.join(e, F.col("node") == F.col("u")).select("origin", F.col("v").alias("node"))
        seen = store(seen.union(more).distinct(), "reach")
        if (now := seen.count()) == n:
            return seen
        n = now
    raise RuntimeError("reachability did not settle")


def largest_cycle_component(edge: DataFrame) -> DataFrame:
    """Sizes of the strongly connected components of a small graph: root, size."""
    from tracewell.operators.components import components

    r = reachable(edge, edge.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    back = r.select(F.col("node").alias("origin"), F.col("origin").alias("node"))
    mutual = r.join(back, ["origin", "node"], "left_semi").select(F.col("origin").alias("u"), F.col("node").alias("v"))
    return components(mutual).groupBy("root").agg(F.count("*").alias("size"))
