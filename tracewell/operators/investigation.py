"""What an investigator works through: the queue of items, what each may cite, and its lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.money import format_inr, inr_words
from tracewell.operators import cases
from tracewell.operators.evidence import fallback_decision
from tracewell.operators.numbering import numbered


def _texts(c: str):
    return F.transform(F.col(c), lambda x: x.cast("string"))


def lead_items(built: dict[str, DataFrame]) -> DataFrame:
    """id (L01 ...), person, cases, txn_ids: people at the core of no case whose money touches several, numbered by person."""
    found = numbered(cases.leads(built["context"], built["core"]).select(F.col("person").cast("string").alias("person"), "cases", "txn_ids"), ["person"], "nth")
    return found.select(F.format_string("L%02d", "nth").alias("id"), "person", "cases", "txn_ids")


def items(built: dict[str, DataFrame], leads: DataFrame) -> DataFrame:
    """id, kind, txn_ids, people: cases, watchlist findings that belong to no case, and leads."""
    core = built["core"].groupBy("case_id").agg(F.array_sort(F.collect_list(F.col("person").cast("string"))).alias("people"))
    own = built["cases"].join(core, "case_id").select(F.col("case_id").alias("id"), F.lit("CASE").alias("kind"), F.col("evidence_ids").alias("txn_ids"), "people")
    review = built["review"].select(F.col("finding_id").alias("id"), F.lit("WATCHLIST_REVIEW").alias("kind"), "txn_ids", _texts("people").alias("people"))
    lead = leads.select("id", F.lit("LEAD").alias("kind"), "txn_ids", F.array("person").alias("people"))
    return own.unionByName(review).unionByName(lead)


def allowed_ids(queue: DataFrame, built: dict[str, DataFrame], txn: DataFrame, accounts: DataFrame, signals: DataFrame | None = None, shown: DataFrame | None = None) -> DataFrame:
    """id, allowed: everything an item may cite. Its own id, transfers, people and their accounts; for a case also its background,
    findings, context, linked cases, detectors and lens signals (case_id, code); for a lead the cases it touches; and what
    tools have shown (id, seen)."""
    text = lambda c: F.col(c).cast("string").alias("x")
    moved = queue.select("id", F.explode("txn_ids").alias("txn_id"))
    ends = moved.join(txn.select("txn_id", "src", "dst"), "txn_id").select("id", F.explode(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))).alias("x"))
    of_case = lambda df, c: df.select(F.col("case_id").alias("id"), text(c))
    people = built["core"].select("case_id", "person").union(built["context_people"].select("case_id", "person")).distinct()
    held = people.join(accounts.select(F.col("person").alias("a_person"), "account"), F.col("person") == F.col("a_person"))
    touched = queue.where("kind = 'LEAD'").select("id", F.explode("people").alias("p")).join(built["context"].select("case_id", F.col("person").cast("string").alias("p")), "p").select("id", text("case_id"))
    parts = [
        queue.select("id", text("id")), moved.select("id", text("txn_id")), queue.select("id", F.explode("people").alias("x")), ends, of_case(built["supporting"], "txn_id"), of_case(built["context"], "txn_id"), of_case(people, "person"), of_case(held, "account"),
        built["cases"].select(F.col("case_id").alias("id"), F.explode(F.concat("finding_ids", "detectors")).alias("x")), of_case(built["links"], "other_case"), touched,
    ]
    if signals is not None:
        parts.append(of_case(signals, "code"))
    if shown is not None:
        parts.append(shown.select("id", text("seen")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct().groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("allowed"))


def lookup(txn: DataFrame, ids: DataFrame) -> DataFrame:
    """Transfers by id (txn_id) with both owners and the amount as text; unknown ids give no row."""
    return txn.join(ids.select("txn_id").distinct(), "txn_id").select("txn_id", "ts", "src", "dst", "src_bank", "dst_bank", "channel", "payer", "payee", format_inr(F.col("amount")).alias("digits"), inr_words(F.col("amount")).alias("words"))


def opened(queue: DataFrame, built: dict[str, DataFrame], sample: int = 10) -> DataFrame:
    """id, kind, n_people, n_transfers, sample_ids, volume, principal (of a CIRCLE case), hours, detectors: the first look at an item."""
    circle = F.array_contains("detectors", "CIRCLE")
    most = built["evidence"].groupBy("case_id").agg(F.max("amount").alias("most"))
    c = built["cases"].join(most, "case_id").select(F.col("case_id").alias("c_id"), "detectors", F.round("hours", 2).alias("hours"), inr_words(F.col("amount")).alias("volume"), F.when(circle, inr_words(F.col("most"))).alias("principal"))
    q = queue.select("id", "kind", F.size("people").alias("n_people"), F.size("txn_ids").alias("n_transfers"), F.slice("txn_ids", 1, sample).alias("sample_ids"))
    return q.join(c, F.col("id") == F.col("c_id"), "left").drop("c_id")


def triaged(queue: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """queue with rank and reason: the given order (id, place, reason), each item once; what it forgets still gets worked, at the end."""
    if order is None:
        order = queue.select("id", F.lit(0).alias("place"), F.lit("").alias("reason")).limit(0)
    first = order.groupBy(F.col("id").alias("o_id")).agg(F.min("place").alias("place"), F.min_by("reason", "place").alias("reason"))
    j = queue.join(first, F.col("id") == F.col("o_id"), "left").drop("o_id")
    j = j.withColumn("reason", F.coalesce("reason", F.lit("not in the triage order")))
    return numbered(j, [F.col("place").asc_nulls_last(), F.col("id")], "rank").drop("place")


def decided(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """id, kind, decision, reason, fallback: recorded decisions (id, decision, reason), and what stands in for those that never came."""
    j = queue.select("id", "kind").join(decisions.select("id", "decision", "reason"), "id", "left")
    missing = F.col("decision").isNull()
    return j.select("id", "kind", F.coalesce("decision", fallback_decision(F.col("kind"))).alias("decision"), F.when(missing, "steps ran out, a person decides").otherwise(F.col("reason")).alias("reason"), missing.alias("fallback"))


def meta(log: DataFrame) -> DataFrame:
    """kind, decision, items, fallbacks of a log."""
    return log.groupBy("kind", "decision").agg(F.count("*").alias("items"), F.count_if("fallback").alias("fallbacks"))
