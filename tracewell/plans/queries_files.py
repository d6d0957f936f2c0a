"""Readers, writers, the investigator's desk and the reports as named queries: the synthetic tables are written as domain files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.config import SCALED as CFG
from tracewell.functions import evidence_text, money
from tracewell.operators import consortium, investigation, resolution, scoring, views
from tracewell.plans.batch import Stages
from tracewell.plans.queries import SALT, _bank, _cases, _edge_columns, _findings, _links, _noded, _order_amounts, _records, _truth, double, joined, long, query, view_stats
from tracewell.sources import adapters, domain, files, planted, schemas
from tracewell.storage import own_dir, store


def _path(spark: SparkSession, label: str) -> str:
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _written(df: DataFrame, schema: str, label: str) -> str:
    """df as a CSV file in the order of the schema, blanks around its text kept."""
    path = _path(df.sparkSession, label)
    out = df.select(*[c.split()[0] for c in schema.split(", ")]).write
    out.options(timestampNTZFormat="yyyy-MM-dd HH:mm:ss", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path, header=True)
    return path


# --- domain files ---------------------------------------------------------------------------------------------------------


def _transactions_file(spark, sf):
    t = adapters.transfers(spark, sf)
    t = t.select("txn_id", F.timestamp_seconds("ts").cast("timestamp_ntz").alias("timestamp"), F.col("src").cast("string").alias("from_account"), F.col("dst").cast("string").alias("to_account"), "amount", "channel", F.col("src_bank").alias("from_bank"), F.col("dst_bank").alias("to_bank"))
    return _written(t, schemas.TRANSACTIONS, "transactions")


def _accounts_file(spark, sf):
    a, p = adapters.bank(spark, sf).accounts, F.col("person")
    name = F.when(p % 9 == 0, "  ").otherwise(F.concat(F.lit(" Holder "), p.cast("string"), F.lit(" ")))
    kind = F.when(p % 4 == 0, "BUSINESS").otherwise("PERSONAL")
    a = a.select(F.col("account").cast("string").alias("account_id"), name.alias("name"), kind.alias("account_type"), "bank", F.col("age").cast("int").alias("opened_days_ago"), F.lit("FULL").alias("kyc_level"), p.cast("string").alias("owner_entity"))
    return _written(a, schemas.ACCOUNTS, "accounts")


def _people_files(spark, sf):
    """Paths of entities and owners, flags as the words True and False."""
    b = adapters.bank(spark, sf)
    word = lambda c: F.when(c, "True").otherwise("False")
    held = b.accounts.groupBy("person").agg(F.array_sort(F.collect_list("account")).alias("ids"))
    e = b.people.join(held, "person").select(
        F.col("person").cast("string").alias("entity_key"), F.concat(F.lit("P"), F.col("person").cast("string")).alias("canonical_name"), F.lit("").alias("phone"), F.coalesce("pan", F.lit(" ")).alias("pan"), F.lit(None).cast("string").alias("address"),
        F.lit(1).alias("num_records"), F.size("ids").alias("num_accounts"), F.concat_ws(";", F.transform("ids", lambda x: x.cast("string"))).alias("account_ids"), F.lit("").alias("record_ids"), word(F.col("person") % 3 == 0).alias("has_unverified_link"),
        word(F.col("is_watchlisted")).alias("is_watchlisted"), F.lit(None).cast("string").alias("rules_used"),
    )
    o = b.accounts.join(b.people, "person").select(F.col("account").cast("string").alias("account_id"), F.col("person").cast("string").alias("entity_key"), word(F.col("is_watchlisted")).alias("is_watchlisted"), word(F.col("person") % 3 == 0).alias("has_unverified_link"))
    return _written(e, schemas.RESOLVED_ENTITIES, "entities"), _written(o, schemas.ACCOUNT_OWNERS, "owners")


@query
def scan_transactions(spark, sf):
    t = files.transactions(spark, _transactions_file(spark, sf))
    return t.select("txn_id", "ts", "from_account", "to_account", double("amount"), "channel", "from_bank", "to_bank")


@query
def scan_transactions_by_id(spark, sf):
    """Only the transfers that a speed link names."""
    t = files.transactions(spark, _transactions_file(spark, sf))
    wanted = _links(adapters.transfers(spark, sf)).select(F.explode(F.array("txn_id", "n_txn")).alias("txn_id"))
    return files.of_ids(t, wanted).select("txn_id", "ts", double("amount"))


@query
def scan_accounts(spark, sf):
    return files.accounts(spark, _accounts_file(spark, sf)).select("account_id", "name", "account_type", "bank")


@query
def scan_account_ages(spark, sf):
    return files.account_ages(spark, _accounts_file(spark, sf)).select("account_id", long("opened_days_ago"))


@query
def scan_customer_records(spark, sf):
    """Records with blanks around their names and empty fields, as the resolution reads them."""
    r = adapters.customer_records(spark, sf).withColumns({"name_as_written": F.concat(F.lit(" "), "name_as_written", F.lit("  ")), "phone": F.coalesce("phone", F.lit(" ")), "true_entity_id": F.col("record_id")})
    r = files.customer_records(spark, _written(r, schemas.CUSTOMER_RECORDS, "records"))
    return resolution.prepared(r).select("record_id", "source_system", "name_as_written", "phone", "pan", "address", "linked_account", "stripped")


@query
def scan_true_people(spark, sf):
    """The answer key of the records, which scoring alone reads."""
    r = adapters.customer_records(spark, sf).withColumn("true_entity_id", F.concat(F.lit("E"), F.floor(F.substring("record_id", 4, 20).cast("long") / 3).cast("string")))
    return scoring.true_people(spark, _written(r, schemas.CUSTOMER_RECORDS, "true-records"))


@query
def scan_ground_truth(spark, sf):
    """Rings with their transfers, from the answer key's file."""
    truth = _truth(adapters.transfers(spark, sf)).withColumn("ring_type", F.lit("CIRCULAR"))
    return scoring.answer_key(spark, _written(truth, schemas.GROUND_TRUTH, "truth")).groupBy("ring_id", "ring_type").agg(F.count_distinct("txn_id").alias("n"), F.array_join(F.array_sort(F.collect_set("txn_id")), ",").alias("txn_ids"))


@query
def scan_entities(spark, sf):
    e = files.resolved_entities(spark, _people_files(spark, sf)[0])
    return e.select("entity_key", "canonical_name", "phone", "pan", "address", joined("account_ids"), F.size("record_ids").cast("long").alias("n_records"), "has_unverified_link", "is_watchlisted")


@query
def scan_account_owners(spark, sf):
    return files.account_owners(spark, _people_files(spark, sf)[1])


@query
def prepared_transfers(spark, sf):
    """Transfers met with the owners of both accounts; a missing owner would be an error."""
    t = domain.transfers(files.transactions(spark, _transactions_file(spark, sf)), files.account_owners(spark, _people_files(spark, sf)[1]))
    return t.select("txn_id", "ts", "src", "dst", double("amount"), "channel", "src_bank", "dst_bank", "payer", "payee")


@query
def written_entities(spark, sf):
    """Resolved people as CSV with lists joined by semicolons, read back."""
    e = files.resolved_entities(spark, _people_files(spark, sf)[0])
    path = _path(spark, "entities-out")
    files.write_csv(e, path, ["entity_key"])
    return files.resolved_entities(spark, path).select("entity_key", "pan", joined("account_ids"), "is_watchlisted")


@query
def written_views(spark, sf):
    """Edges of two views in a folder each, one of them read back."""
    path = _path(spark, "views")
    e = None
    for v in ("ALL", "BANK_A"):
        one = views.edges(_noded(spark, sf, v)[1]).withColumn("view", F.lit(v))
        e = one if e is None else e.unionByName(one)
    e = store(e, "edges")
    files.write_views(e.select("view", F.explode(F.array("u", "v")).alias("node")).distinct(), e, path)
    return _edge_columns(spark.read.parquet(f"{path}/edges").where("view = 'BANK_A'"))


@query
def written_findings(spark, sf):
    """Findings as JSON, lists and all, read back under their schema."""
    path = _path(spark, "findings") + ".json"
    _findings(adapters.transfers(spark, sf)).write.json(path)
    f = files.read(spark, path, "finding_id string, detector string, txn_ids array<string>, people array<bigint>")
    return f.select("finding_id", "detector", joined("txn_ids"), joined("people"))


@query
def appended_cases(spark, sf):
    """Written cases kept from an earlier run: only keys that are not there yet come from the later one."""
    path, t = _path(spark, "cases"), adapters.transfers(spark, sf).select(F.col("txn_id").alias("case_id"))
    files.append_new(t.where("case_id % 3 = 0").withColumn("run", F.lit(1)), spark, path, "case_id")
    files.append_new(t.withColumn("run", F.lit(2)), spark, path, "case_id")
    return spark.read.parquet(path).select("case_id", long("run"))


@query
def resumed_stages(spark, sf):
    """A stage that is there whole is read; the next run makes only what is missing."""
    out, t = _path(spark, "stages"), adapters.transfers(spark, sf)
    Stages(spark, out)("detections", lambda: t.groupBy("channel").agg(F.count("*").alias("n")).withColumn("run", F.lit(1)))
    again = Stages(spark, out)
    kept = again("detections", lambda: t.limit(0).select("channel", F.lit(0).cast("long").alias("n"), F.lit(2).alias("run")))
    made = again("cases", lambda: kept.select("channel", "n", F.lit(2).alias("run")))
    return kept.select(F.lit("detections").alias("stage"), "channel", "n", long("run")).union(made.select(F.lit("cases"), "channel", "n", long("run")))


# --- functions and small operators ---------------------------------------------------------------------------------------


@query
def western_amounts(spark, sf):
    o, amount = _order_amounts(spark, sf)
    return o.select("o_orderkey", money.plain_money(F.floor(amount)).alias("label"))


@query
def money_spans(spark, sf):
    """Amounts as they are written in a sentence, each once, in order; a comma right behind digits counts as theirs."""
    o, amount = _order_amounts(spark, sf)
    text = F.concat(F.lit("first "), money.format_inr(F.floor(amount)), F.lit(", then INR 4500 and 1.5 crore, "), F.when(F.col("o_orderkey") % 2 == 0, "INR 4500 again").otherwise("₹12,000, no more"), F.lit(" on 12 days"))
    return o.select("o_orderkey", F.array_join(evidence_text.mentions(text, evidence_text.MONEY), "|").alias("spans"))


@query
def narrative_text(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    parts = (F.col("lang"), F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.lit("end"))
    return d.select("doc_id", evidence_text.narrative(*parts).alias("said"), evidence_text.lowered_confidence(F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("confidence"))


@query
def bucketed_transfers(spark, sf):
    """What the consortium shares of a transfer: pseudonyms, band and hour."""
    r = consortium.bucketed_rows(_noded(spark, sf, "CONSORTIUM")[1], CFG)
    return r.select("txn_id", "u", "v", long("band"), long("hour"))


@query
def bank_sequence(spark, sf):
    """Banks of a ring's accounts in turn."""
    return spark.createDataFrame([(size, i, b) for size in range(3, 9) for i, b in enumerate(planted.bank_sequence(size))], "size long, place long, bank string")


@query
def one_person_per_account(spark, sf):
    """Resolution switched off."""
    return resolution.one_per_account(files.accounts(spark, _accounts_file(spark, sf))).select("entity_key", "canonical_name", joined("account_ids"))


@query
def mixed_clusters(spark, sf):
    """Clusters of equal phones that hold several people."""
    r = _records(spark, sf)
    truth = r.select("record_id", F.floor(F.substring("record_id", 4, 20).cast("long") / 2).alias("true_entity_id"))
    return scoring.mixed_clusters(r.where("phone is not null").select("record_id", F.col("phone").alias("root")), truth)


@query
def cluster_vetoes(spark, sf):
    """Each record of an odd number and the next one as clusters with a yellow link: a conflict between them vetoes the merge."""
    r = store(_records(spark, sf), "records")
    n = F.substring("record_id", 4, 20).cast("long")
    link = r.where(n % 2 == 1).select(F.col("record_id").alias("a"), n.alias("n")).join(r.select(F.col("record_id").alias("b"), (n - 1).alias("n")), "n").select("a", "b")
    return resolution.yellow_merged(r.select("record_id", F.col("record_id").alias("root")), link, r).where("unverified").select("record_id", "root")


@query
def strong_components(spark, sf):
    """Strongly connected parts of the graph of a few planted rings, and of two walks that close nothing."""
    walks = [("A", range(4)), ("B", range(7))]
    rows = [(f"{n}{i}", f"{n}{(i + 1) % len(r)}") for n, r in walks for i in r] + [("A0", "B3"), ("C0", "C1"), ("C1", "C2"), ("D0", "D0")]
    return views.largest_cycle_component(spark.createDataFrame(rows, "u string, v string"))


@query
def ring_coverage(spark, sf):
    """How much of one ring the best circle of each view holds: speed links stand for circles, BANK_A sees its own transfers."""
    b = _bank(spark, sf)
    link = _links(b.txn).select(F.array("txn_id", "n_txn").alias("path"))
    seen = _links(b.txn.where("src_bank = 'BANK_A' or dst_bank = 'BANK_A'")).select(F.array("txn_id", "n_txn").alias("path"))
    found = link.withColumn("view", F.lit("ALL")).union(seen.withColumn("view", F.lit("BANK_A")))
    return scoring.hero_coverage(found, _truth(b.txn).where("ring_id = 'RING1'"))


# --- the investigator's desk ----------------------------------------------------------------------------------------------


def _queue(spark, sf):
    """Every twentieth transfer is an item, of the three kinds in turn."""
    n = F.col("txn_id").cast("long")
    kind = F.element_at(F.array(F.lit("CASE"), F.lit("WATCHLIST_REVIEW"), F.lit("LEAD")), (n % 3 + 1).cast("int"))
    return adapters.transfers(spark, sf).where(n % 20 == 0).select(F.concat(F.lit("I"), "txn_id").alias("id"), kind.alias("kind"), F.array("txn_id").alias("txn_ids"), F.array(F.col("payer").cast("string")).alias("people"), n.alias("n"))


@query
def looked_up_transfers(spark, sf):
    """Asked ids among them such as nobody has."""
    t = adapters.transfers(spark, sf)
    asked = t.where("txn_id % 7 = 0").select(F.explode(F.array("txn_id", F.concat(F.lit("X"), "txn_id"))).alias("txn_id"))
    return investigation.lookup(t, asked).select("txn_id", "ts", "src", "dst", "payer", "payee", "channel")


@query
def opened_items(spark, sf):
    """First look at every speed link as an item."""
    b, f, c, ev, span = _cases(spark, sf)
    named = lambda df: df.withColumn("case_id", F.col("group"))
    total = ev.groupBy(F.col("group").alias("case_id")).agg(F.sum("amount").alias("amount"), ((F.max("ts") - F.min("ts")) / 3600).alias("hours"))
    cases = f.select(F.col("finding_id").alias("case_id"), F.array(F.when(F.substring("finding_id", 12, 1) < "5", "CIRCLE").otherwise("SPEED")).alias("detectors"), "txn_ids", "people").join(total, "case_id")
    queue = cases.select(F.col("case_id").alias("id"), F.lit("CASE").alias("kind"), "txn_ids", "people")
    o = investigation.opened(queue, {"cases": cases, "evidence": named(ev)}, 1)
    return o.select("id", long("n_people"), long("n_transfers"), joined("sample_ids"), "volume", "principal", "hours", joined("detectors"))


@query
def triaged_items(spark, sf):
    """An order that names half of the items, some twice, and strangers; the rest follow."""
    q = _queue(spark, sf)
    order = q.where("n % 40 = 0").select("id", (F.lit(1_000_000) - F.col("n")).alias("place"), F.lit("picked").alias("reason"))
    order = order.union(order.select("id", F.col("place") + 5_000_000, F.lit("again"))).union(order.select(F.concat(F.lit("Z"), "id"), "place", "reason"))
    return investigation.triaged(q.drop("n"), order).select("id", "kind", long("rank"), "reason")


def _log(spark, sf):
    q = _queue(spark, sf)
    made = q.where("n % 60 < 40").select("id", F.when(F.col("kind") == "CASE", "FILE_STR").otherwise("CLOSE_RECOMMENDED").alias("decision"), F.lit("read").alias("reason"))
    return investigation.decided(q, made)


@query
def investigation_log(spark, sf):
    return _log(spark, sf)


@query
def investigation_meta(spark, sf):
    return investigation.meta(_log(spark, sf))


# --- reports --------------------------------------------------------------------------------------------------------------


@query
def view_shares(spark, sf):
    """How much of the network each view sees."""
    return views.shares(store(view_stats(spark, sf), "stats"))


@query
def detector_counts(spark, sf):
    """Key figures of a swarm's findings: number and amount by detector."""
    b = _bank(spark, sf)
    total = _links(b.txn).select(F.lit("SPEED").alias("detector"), (F.col("amount") + F.col("n_amount")).alias("total_amount"))
    return scoring.key_figures(total, "detector").select("detector", "n", double("total"))


@query
def worked_examples(spark, sf):
    """The three people with most records."""
    r = _records(spark, sf).where("phone is not null").groupBy(F.col("phone").alias("entity_key")).agg(F.collect_set("record_id").alias("record_ids"), F.collect_set("source_system").alias("rules_used"))
    return resolution.worked_examples(r, 3).select("entity_key", long("n_records"), long("n_rules"))
