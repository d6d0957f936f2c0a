"""The detectors: each returns (detector, key, txn_ids, facts), facts being a JSON text of what was measured."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import temporal
from tracewell.operators.numbering import numbered
from tracewell.storage import store

COLUMNS = ["detector", "key", "txn_ids", "facts"]


def watched(people: DataFrame) -> DataFrame:
    """The watchlist."""
    return people.where("is_watchlisted").select(F.col("person").alias("w_person"))


def with_watch(txn: DataFrame, watch: DataFrame) -> DataFrame:
    """Adds payer_watched, payee_watched and touches_watch, once."""
    if "touches_watch" in txn.columns:
        return txn
    for side in ("payer", "payee"):
        txn = txn.join(watch.withColumnRenamed("w_person", f"w_{side}"), F.col(side) == F.col(f"w_{side}"), "left").withColumn(f"{side}_watched", F.col(f"w_{side}").isNotNull()).drop(f"w_{side}")
    return txn.withColumn("touches_watch", F.col("payer_watched") | F.col("payee_watched"))


def _found(df: DataFrame, name: str, key: Column, txn_ids: Column, **facts: Column) -> DataFrame:
    return df.select(F.lit(name).alias("detector"), key.cast("string").alias("key"), txn_ids.alias("txn_ids"), F.to_json(F.struct(*[c.alias(k) for k, c in facts.items()])).alias("facts"))


def _shares(amounts: str) -> Column:
    """Each amount as a share of the one before, in percent."""
    n = F.size(amounts)
    return F.zip_with(F.slice(amounts, 2, n - 1), F.slice(amounts, 1, n - 1), lambda b, a: (b * 100 / a).cast("double"))


def _gaps(times: str) -> Column:
    n = F.size(times)
    return F.zip_with(F.slice(times, 2, n - 1), F.slice(times, 1, n - 1), lambda b, a: (b - a) / 60.0)


def _touch(paths: DataFrame, txn: DataFrame, watch: DataFrame) -> DataFrame:
    """paths with `watch`: whether a person on the path is watched."""
    on = with_watch(txn, watch).where("touches_watch").select(F.col("txn_id").alias("t_txn"))
    tagged = paths.withColumn("__id", F.array_join("path", ","))
    hit = tagged.select("__id", F.explode("path").alias("t_txn")).join(on, "t_txn", "left_semi").select("__id").distinct().withColumn("__hit", F.lit(True))
    return tagged.join(hit, "__id", "left").withColumn("watch", F.coalesce("__hit", F.lit(False))).drop("__id", "__hit")


def circle(txn: DataFrame, cfg) -> DataFrame:
    """Money that comes back to the person it left. The largest of nested circles counts."""
    c = temporal.maximal_sets(temporal.circle_walks(txn, cfg), "path")
    return _found(c, "CIRCLE", F.array_join("path", ","), F.col("path"), hops=F.col("hops"), min_retention_pct=F.round(F.array_min(_shares("amounts")), 2), return_pct=F.round((F.element_at("amounts", -1) * 100 / F.element_at("amounts", 1)).cast("double"), 2), hours=F.round((F.element_at("times", -1) - F.element_at("times", 1)) / 3600.0, 2))


def speed(txn: DataFrame, watch: DataFrame, cfg) -> DataFrame:
    """Chains in which nobody holds the money for long."""
    paths = temporal.chains(temporal.links(txn, cfg.speed_link, cfg.speed_low, cfg.speed_high), cfg)
    c = _touch(paths, txn, watch).withColumn("required", F.when(F.col("watch"), cfg.speed_hops_watch).otherwise(cfg.speed_hops)).where(F.size("path") >= F.col("required"))
    return _found(c, "SPEED", F.array_join("path", ","), F.col("path"), hops=F.size("path"), minutes=F.round((F.element_at("times", -1) - F.element_at("times", 1)) / 60.0, 1), min_retention_pct=F.round(F.array_min(_shares("amounts")), 2), max_gap_minutes=F.round(F.array_max(_gaps("times")), 1), required=F.col("required"))


def spray_candidates(txn: DataFrame, watch: DataFrame, cfg) -> DataFrame:
    """The best window of each (source, collector): src, collector, a_txn, receivers, mules, required, used (transfer ids)."""
    t = store(with_watch(txn, watch).select("src", "dst", "ts", "txn_id", "amount", "payer", "payee", "touches_watch"), "spray-txn")
    link = temporal.links(t, cfg.spray_delay, cfg.spray_low, cfg.spray_high, "touches_watch")
    forward = link.groupBy(F.col("txn_id").alias("of_txn")).agg(F.min_by(F.struct("n_txn", "n_dst", "n_touches_watch"), F.struct("n_ts", "n_txn")).alias("f"))
    rows = t.join(forward, F.col("txn_id") == F.col("of_txn"), "left")
    rows = store(rows.select("src", "ts", "txn_id", "dst", "touches_watch", F.col("f.n_txn").alias("f_txn"), F.col("f.n_dst").alias("f_dst"), F.col("f.n_touches_watch").alias("f_watch")), "spray-rows")
    least = min(cfg.spray_receivers, cfg.spray_receivers_watch)
    m = temporal.anchored(rows, ["src"], cfg.spray_window, least, ["dst", "touches_watch", "f_txn", "f_dst", "f_watch"])
    anchor = ["a_src", "a_slot", "a_txn", "a_ts"]  # anchored() has dealt its rows by the first two: no group below is shuffled
    first = F.min_by(F.struct("txn_id", "f_txn", "f_dst", (F.col("touches_watch") | F.col("f_watch")).alias("watch")), F.when(F.col("f_txn").isNotNull(), F.struct("ts", "txn_id")))
    by_receiver = m.groupBy(*anchor, "dst").agg(first.alias("first"))
    by_collector = by_receiver.groupBy(*anchor, F.col("first.f_dst").alias("collector")).agg(F.count("*").alias("mules"), F.max("first.watch").alias("watch"), F.collect_list(F.array("first.txn_id", "first.f_txn")).alias("used"))
    c = by_collector.withColumn("receivers", F.sum("mules").over(Window.partitionBy(*anchor)))
    c = c.where(F.col("collector").isNotNull() & (F.col("receivers") >= least) & (F.col("mules") >= F.lit(cfg.spray_share) * F.col("receivers")))
    c = c.withColumn("used", F.flatten(F.array_sort("used")))
    c = c.withColumn("required", F.when(F.col("watch"), cfg.spray_receivers_watch).otherwise(cfg.spray_receivers)).where("receivers >= required")
    rank = F.row_number().over(Window.partitionBy("a_src", "collector").orderBy(F.desc("mules"), "a_ts", "a_txn"))
    return c.withColumn("__n", rank).where("__n = 1").select(F.col("a_src").alias("src"), "collector", "a_txn", "receivers", "mules", "required", "used")


def spray(txn: DataFrame, watch: DataFrame, cfg) -> DataFrame:
    """One source fans out, most receivers pass the money to one collector."""
    c = spray_candidates(txn, watch, cfg)
    return _found(c, "SPRAY", F.concat_ws(">", F.col("src").cast("string"), F.col("collector").cast("string")), F.array_distinct("used"), source=F.col("src"), collector=F.col("collector"), receivers=F.col("receivers"), mules=F.col("mules"), forward_pct=F.round(F.col("mules") * 100.0 / F.col("receivers"), 1), required=F.col("required"))


def threshold_rows(txn: DataFrame, watch: DataFrame, cfg) -> DataFrame:
    """Cash just under a limit, with the size of the window that each begins and whether some qualifying window holds it."""
    limits = F.explode(F.array(*[F.lit(x) for x in cfg.threshold_limits])).alias("limit")
    cash = with_watch(txn.where(F.col("channel") == cfg.threshold_channel), watch).select("*", limits)
    cash = cash.where((F.col("amount") >= F.lit(cfg.threshold_low) * F.col("limit")) & (F.col("amount") <= F.col("limit")))
    ahead = Window.partitionBy("payee", "limit").orderBy("ts").rangeBetween(0, cfg.threshold_window)
    cash = cash.withColumns({"in_window": F.count("*").over(ahead), "watch": F.max("touches_watch").over(ahead)})
    cash = cash.withColumn("required", F.when(F.col("watch"), cfg.threshold_count_watch).otherwise(cfg.threshold_count)).withColumn("opens", F.col("in_window") >= F.col("required"))
    return cash.withColumn("flagged", F.max("opens").over(Window.partitionBy("payee", "limit").orderBy("ts").rangeBetween(-cfg.threshold_window, 0)))


def threshold(txn: DataFrame, watch: DataFrame, cfg) -> DataFrame:
    """Cash deposits kept just below a reporting limit."""
    rows = threshold_rows(txn, watch, cfg).where("flagged")
    pct = (F.col("amount") * 100 / F.col("limit")).cast("double")
    size = F.max(F.when(F.col("opens"), F.col("in_window"))).alias("deposits")
    required = F.min_by("required", F.when(F.col("opens"), F.struct(-F.col("in_window"), "ts", "txn_id"))).alias("required")
    g = rows.groupBy("payee", "limit").agg(size, required, F.count("*").alias("flagged"), F.round(F.min(pct), 2).alias("lo"), F.round(F.max(pct), 2).alias("hi"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "txn_id"))), lambda x: x["txn_id"]).alias("ids"))
    return _found(g, "THRESHOLD", F.concat_ws("@", F.col("payee").cast("string"), F.col("limit").cast("string")), F.col("ids"), limit=F.col("limit"), deposits_in_window=F.col("deposits"), flagged_deposits=F.col("flagged"), min_pct=F.col("lo"), max_pct=F.col("hi"), required=F.col("required"))


def touches(txn: DataFrame) -> DataFrame:
    """Every transfer once for each of its ends (a transfer to the own account twice): account, is_sender and the transfer."""
    return txn.select("*", F.explode(F.array(F.struct(F.col("src").alias("account"), F.lit(True).alias("is_sender")), F.struct(F.col("dst").alias("account"), F.lit(False).alias("is_sender")))).alias("__t")).select("*", "__t.*").drop("__t")


def dormant_rows(txn: DataFrame, accounts: DataFrame, watch: DataFrame, cfg) -> DataFrame:
    """The first qualifying gap of each old account: account, age, gap, a_ts, a_txn, burst_txns, burst_amount, required.

    Only an account's first touches can open a burst; they come from counts by time that are cut short, and the bursts
    from a join in time, so a busy account never lies in one window.
    """
    t = touches(with_watch(txn, watch)).select("account", "ts", "txn_id", "is_sender", "amount", "touches_watch")
    old = accounts.where(F.col("age") >= cfg.dormant_age).select(F.col("account").alias("o_account"), "age")
    t = store(t.join(old, F.col("account") == F.col("o_account")).drop("o_account"), "touches")
    few = cfg.dormant_max_before + 1
    spread = Window.partitionBy("account", F.pmod(F.xxhash64("txn_id"), F.lit(64))).orderBy("ts", "txn_id", F.desc("is_sender"))
    early = t.withColumn("__n", F.row_number().over(spread)).where(F.col("__n") <= few)  # the first of each of 64 lots hold the first of all
    order = Window.partitionBy("account").orderBy("ts", "txn_id", F.desc("is_sender"))
    early = early.withColumns({"nth": F.row_number().over(order), "gap": F.col("ts") - F.lag("ts").over(order)}).where((F.col("nth") > 1) & (F.col("nth") <= few) & (F.col("gap") >= cfg.dormant_gap))
    heads = early.select(F.col("account").alias("h_account"), "age", "nth", "gap", F.col("ts").alias("a_ts"), F.col("txn_id").alias("a_txn"))
    near = temporal.range_join(heads, t.drop("age"), [("h_account", "account")], F.col("a_ts"), F.col("a_ts") + cfg.dormant_burst, "ts", cfg.dormant_burst)
    b = near.groupBy(F.col("h_account").alias("account"), "age", "nth", "gap", "a_ts", "a_txn").agg(F.count("*").alias("burst_txns"), F.sum("amount").alias("burst_amount"), F.max("touches_watch").alias("watch"))
    b = b.withColumn("required", F.when(F.col("watch"), cfg.dormant_txns_watch).otherwise(cfg.dormant_txns))
    b = b.where((F.col("burst_txns") >= F.col("required")) & (F.col("burst_amount") >= F.when(F.col("watch"), F.lit(cfg.dormant_amount_watch)).otherwise(F.lit(cfg.dormant_amount))))
    first = b.groupBy("account").agg(F.min_by(F.struct("age", "gap", "a_ts", "a_txn", "burst_txns", "burst_amount", "required"), "nth").alias("f"))
    return first.select("account", "f.*")


def dormant(txn: DataFrame, accounts: DataFrame, watch: DataFrame, cfg) -> DataFrame:
    """An old, silent account that suddenly moves large sums."""
    a = dormant_rows(txn, accounts, watch, cfg)
    t = touches(txn).select(F.col("account").alias("m_account"), "ts", "txn_id")
    m = temporal.range_join(a, t, [("account", "m_account")], F.col("a_ts"), F.col("a_ts") + cfg.dormant_burst, "ts", cfg.dormant_burst)
    g = m.groupBy("account", "age", "gap", "burst_txns", "burst_amount", "required").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ts", "txn_id"))), lambda x: x["txn_id"])).alias("ids"))
    return _found(g, "DORMANT_REACTIVATION", F.col("account"), F.col("ids"), account=F.col("account"), age_days=F.col("age"), quiet_days=F.round(F.col("gap") / 86400.0, 2), txns=F.col("burst_txns"), amount=F.col("burst_amount"), required=F.col("required"))


def pass_candidates(txn: DataFrame, cfg) -> DataFrame:
    """Incoming legs with the outgoing legs that could be the same money: account, i_txn, i_ts, i_amount, o_txn, o_ts, o_amount; i_watch and o_watch if txn has touches_watch."""
    marks = [c for c in ("touches_watch",) if c in txn.columns]
    c = temporal.links(txn, cfg.pass_window, cfg.pass_low, cfg.pass_high, *marks)
    watch = [F.col(a + m).alias(f"{leg}_watch") for m in marks for a, leg in (("", "i"), ("n_", "o"))]
    return c.select(F.col("dst").alias("account"), F.col("txn_id").alias("i_txn"), F.col("ts").alias("i_ts"), F.col("amount").alias("i_amount"), F.col("n_txn").alias("o_txn"), F.col("n_ts").alias("o_ts"), F.col("n_amount").alias("o_amount"), *watch)


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["i_ts", "i_txn", "o_ts", "o_txn"])
    taken, done, rows = set(), set(), []
    for k, (i, o) in enumerate(zip(pdf["i_txn"].tolist(), pdf["o_txn"].tolist(), strict=True)):
        if i not in done and o not in taken:
            done.add(i)
            taken.add(o)
            rows.append(k)
    return pdf.iloc[rows]


#: Groups of episodes that are matched together, to a shuffle partition.
PACKS = 4


def pass_pairs(txn: DataFrame, cfg) -> DataFrame:
    """One-to-one pairs: incoming legs in order take the earliest outgoing leg still free.

    A pair in which each leg is the other's first choice is settled at once, for no earlier leg could take it. What is
    left falls into episodes: legs of an account with a longer pause than the window between them cannot compete. Many
    episodes are matched in one call, since legs of different accounts never compete either.
    """
    first = lambda own, *order: F.row_number().over(Window.partitionBy(own).orderBy(*order)) == 1
    c = pass_candidates(txn, cfg)
    columns = c.columns
    c = store(c.withColumns({"i_first": first("i_txn", "o_ts", "o_txn"), "o_first": first("o_txn", "i_ts", "i_txn")}), "pass-candidates")
    settled = c.where("i_first and o_first").select(*columns)
    rest = c.where("not (i_first and o_first)").select(*columns)
    for leg in ("i_txn", "o_txn"):
        rest = rest.join(settled.select(leg), leg, "left_anti")
    rest = rest.select(*columns)
    order = Window.partitionBy("account").orderBy("i_ts", "i_txn")
    apart = F.coalesce(F.col("i_ts") > F.max("o_ts").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    rest = rest.withColumn("episode", F.sum(apart.cast("long")).over(order))
    packs = PACKS * int(txn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = rest.withColumn("pack", F.pmod(F.xxhash64("account", "episode"), F.lit(packs))).drop("episode")
    kinds = dict(rest.dtypes)
    matched = rest.groupBy("pack").applyInPandas(_greedy, ", ".join(f"{k} {kinds[k]}" for k in rest.columns)).select(*columns)
    return settled.union(matched)


def pass_through(txn: DataFrame, watch: DataFrame, cfg) -> DataFrame:
    """An account that again and again forwards money within minutes."""
    p = pass_pairs(with_watch(txn, watch).select(*temporal.STEP, "touches_watch"), cfg)
    share, delay = (F.col("o_amount") * 100 / F.col("i_amount")).cast("double"), (F.col("o_ts") - F.col("i_ts")) / 60.0
    g = p.groupBy("account").agg(F.count("*").alias("pairs"), F.max(F.col("i_watch") | F.col("o_watch")).alias("watch"), F.round(F.avg(share), 2).alias("avg_share"), F.round(F.min(share), 2).alias("lo"), F.round(F.max(share), 2).alias("hi"), F.round(F.max(delay), 1).alias("slowest"), F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.array("i_txn", "o_txn"))))).alias("ids"))
    g = g.withColumn("required", F.when(F.col("watch"), cfg.pass_pairs_watch).otherwise(cfg.pass_pairs)).where("pairs >= required")
    return _found(g, "PASS_THROUGH", F.col("account"), F.col("ids"), account=F.col("account"), pairs=F.col("pairs"), avg_retention_pct=F.col("avg_share"), min_retention_pct=F.col("lo"), max_retention_pct=F.col("hi"), max_delay_minutes=F.col("slowest"), required=F.col("required"))


def round_windows(txn: DataFrame, watch: DataFrame, cfg) -> DataFrame:
    """The largest cluster of round amounts of each person: person, a_txn, n, counterparties, ids; of people with the same cluster the smallest."""
    t = with_watch(txn.where((F.col("amount") > 0) & (F.col("amount") % F.lit(cfg.round_multiple) == 0)), watch)
    sides = F.array(F.struct(F.col("payer").alias("person"), F.col("payee").alias("other")), F.struct(F.col("payee").alias("person"), F.col("payer").alias("other")))
    legs = t.select("txn_id", "ts", "touches_watch", F.explode(F.when(F.col("payer") == F.col("payee"), F.slice(sides, 1, 1)).otherwise(sides)).alias("s")).select("txn_id", "ts", "touches_watch", "s.*")
    legs = store(legs, "round-legs")
    m = temporal.anchored(legs, ["person"], cfg.round_window, min(cfg.round_cluster, cfg.round_cluster_watch), ["other", "touches_watch"])
    w = m.groupBy("a_person", "a_slot", "a_ts", "a_txn").agg(F.count("*").alias("n"), F.count_distinct("other").alias("counterparties"), F.max("touches_watch").alias("watch"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "txn_id"))), lambda x: x["txn_id"]).alias("ids"))
    w = w.where(F.col("n") >= F.when(F.col("watch"), cfg.round_cluster_watch).otherwise(cfg.round_cluster))
    w = w.where(~((F.col("counterparties") >= cfg.payroll_counterparties) & (F.col("counterparties") >= F.lit(cfg.payroll_ratio) * F.col("n"))))
    best = w.withColumn("__n", F.row_number().over(Window.partitionBy("a_person").orderBy(F.desc("n"), "a_ts", "a_txn"))).where("__n = 1").drop("__n")
    same = Window.partitionBy(F.array_join(F.array_sort("ids"), ",")).orderBy("a_person")
    return best.withColumn("__n", F.row_number().over(same)).where("__n = 1").select(F.col("a_person").alias("person"), "a_txn", "n", "counterparties", "ids")


def round_clustering(txn: DataFrame, watch: DataFrame, cfg) -> DataFrame:
    """Round amounts close together, unless they look like a salary run."""
    return _found(round_windows(txn, watch, cfg), "ROUND_CLUSTERING", F.col("person"), F.col("ids"), person=F.col("person"), size=F.col("n"), counterparties=F.col("counterparties"))


def signal_rows(txn: DataFrame, accounts: DataFrame, watch: DataFrame, cfg) -> DataFrame:
    """Weak signals of watched senders: person, signal, txn_id, ts, channel."""
    t = store(txn.select("txn_id", "ts", "dst", "amount", "channel", "payer", "payee"), "signal-txn")
    mine = t.join(watch, F.col("payer") == F.col("w_person"), "left_semi")
    pairs = temporal.first_of_pair(t.where("payer <> payee"), F.least("payer", "payee"), F.greatest("payer", "payee"))
    first = pairs.join(watch, F.col("payer") == F.col("w_person"), "left_semi").where(F.col("amount") >= F.lit(cfg.signal_first_amount))
    young = accounts.where(F.col("age") <= cfg.signal_new_days).select(F.col("account").alias("y_account"))
    new_account = mine.join(young, F.col("dst") == F.col("y_account"), "left_semi")
    since = mine.withColumn("begin", F.min("ts").over(Window.partitionBy("payer")))
    base = since.where(F.col("ts") <= F.col("begin") + cfg.signal_baseline).select("payer", "channel").distinct()
    new_channel = since.where(F.col("ts") > F.col("begin") + cfg.signal_baseline).join(base, ["payer", "channel"], "left_anti")
    named = [("first_large_transfer_to_new_counterparty", first), ("money_into_new_account", new_account), ("new_channel_after_baseline", new_channel)]
    out = None
    for name, df in named:
        part = df.select(F.col("payer").alias("person"), F.lit(name).alias("signal"), "txn_id", "ts", "channel")
        out = part if out is None else out.unionByName(part)
    return out


def watchlist_signals(txn: DataFrame, accounts: DataFrame, watch: DataFrame, cfg) -> DataFrame:
    """One finding to a watched person with at least one weak signal."""
    per = signal_rows(txn, accounts, watch, cfg).groupBy("person", "signal").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "txn_id"))).alias("at"))
    g = per.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("signal", "n"))).alias("signals"), F.array_distinct(F.transform(F.array_sort(F.flatten(F.collect_list("at"))), lambda x: x["txn_id"])).alias("ids"))
    return _found(g, "WATCHLIST_SIGNAL", F.col("person"), F.col("ids"), signals=F.col("signals"))


def run_detectors(b, cfg, watch: DataFrame | None = None) -> DataFrame:
    """All detectors over one bank. watch replaces the watchlist, as for the blind re-run."""
    watch = store(watched(b.people) if watch is None else watch, "watchlist")
    txn = store(with_watch(b.txn, watch), "tagged")
    makers = [
        lambda: circle(txn, cfg), lambda: spray(txn, watch, cfg), lambda: speed(txn, watch, cfg), lambda: threshold(txn, watch, cfg), lambda: watchlist_signals(txn, b.accounts, watch, cfg),
        lambda: dormant(txn, b.accounts, watch, cfg), lambda: pass_through(txn, watch, cfg), lambda: round_clustering(txn, watch, cfg),
    ]
    with ThreadPoolExecutor(len(makers)) as pool:  # the small steps of independent detectors fill each other's gaps
        parts = list(pool.map(lambda make: make(), makers))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def findings(found: DataFrame, txn: DataFrame, watch: DataFrame) -> DataFrame:
    """Findings with people, accounts, totals, times, lane and a number F0001 ... by falling amount."""
    found = store(found, "found")
    each = found.select("detector", "key", F.explode("txn_ids").alias("f_txn")).join(with_watch(txn, watch), F.col("f_txn") == F.col("txn_id"))
    g = each.groupBy("detector", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("payer", "payee"))))).alias("people"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("src", "dst"))))).alias("accounts"),
        F.sum("amount").alias("total_amount"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("touches_watch").alias("watch"),
    )
    lane = F.when((F.col("detector") == "WATCHLIST_SIGNAL") | F.col("watch"), "WATCHLIST").otherwise("DISCOVERY").alias("lane")
    out = found.join(g, ["detector", "key"]).select("detector", "key", lane, "people", "accounts", "txn_ids", "total_amount", "first_ts", "last_ts", "facts")
    out = numbered(out, [F.desc("total_amount"), F.col("detector"), F.element_at("txn_ids", 1), F.col("key")], "nth")
    return out.withColumn("finding_id", F.format_string("F%04d", "nth")).drop("nth")
