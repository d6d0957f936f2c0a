"""The whole chain over a made-up bank with planted rings."""

import pytest
from pyspark.sql import functions as F

from tracewell.config import Config
from tracewell.operators import evidence, investigation, scoring, views
from tracewell.plans import batch
from tracewell.sources import domain, files, planted


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('bank')}"
    planted.write(planted.planted(spark, people=160, traffic=900), f"{folder}/in")
    return folder, *batch.run(spark, f"{folder}/in", f"{folder}/out", salt="secret")


def test_rings_are_caught_and_scored(spark, ran):
    folder, t, made = ran
    truth = scoring.answer_key(spark, f"{folder}/in/ground_truth.csv")
    cover = scoring.ring_cover(t["detections"].where("detector <> 'WATCHLIST_SIGNAL'"), truth).collect()
    assert len(cover) == 12 and sum(r.caught for r in cover) >= 11
    by = {}
    for r in scoring.catching_detectors(t["detections"], truth, ["CIRCLE", "SPRAY", "SPEED", "THRESHOLD"]).collect():
        by.setdefault(r.ring_id, set()).add(r.detector)
    assert "CIRCLE" in by["CIRC_6_HERO"] and "SPRAY" in by["MULE_A"] and "SPEED" in by["VELOCITY_A"] and "THRESHOLD" in by["STRUCT_A"]
    assert t["cases"].count() > 3
    rings = {r.ring_id: r for r in scoring.ring_cases(t["evidence"], truth, scoring.catching_detectors(t["detections"], truth, ["CIRCLE", "SPRAY", "SPEED", "THRESHOLD"])).collect()}
    assert sum(r.covered for r in rings.values()) >= 11
    score = scoring.case_score(t["evidence"], truth).collect()
    assert all(0 <= r.purity <= 1 for r in score) and max(r.purity for r in score) == 1
    p = scoring.accused_precision(t["core"], t["transfers"], truth).first()
    assert 0.5 < p.precision <= 1
    circles = t["detections"].where("detector = 'CIRCLE'").select(F.lit("ALL").alias("view"), F.col("txn_ids").alias("path"))
    hero = scoring.hero_coverage(circles, truth.where("ring_id = 'CIRC_6_HERO'")).first()
    assert hero.whole and hero["all"] == 6
    edges = t["edges_ALL"].where(F.arrays_overlap("txn_ids", F.array(*[F.lit(r.txn_id) for r in truth.where("ring_id = 'CIRC_6_HERO'").collect()])))
    assert views.largest_cycle_component(edges).agg(F.max("size")).first()[0] == 6


def test_people_are_resolved(spark, ran):
    folder, t, _ = ran
    true = scoring.true_people(spark, f"{folder}/in/customer_records.csv")
    own = t["entities"].select("entity_key", F.explode("record_ids").alias("record_id")).join(true, "record_id")
    assert scoring.mixed_clusters(own.withColumnRenamed("entity_key", "root").select("root", "record_id"), true).count() == 0
    assert own.select("entity_key").distinct().count() < own.count()


def test_packets_and_narratives_hold(ran):
    _, t, _ = ran
    packets = {r.case_id: r for r in t["packets"].collect()}
    assert any(p.is_circular for p in packets.values())
    for p in packets.values():
        assert (p.cycled_words is not None) == ("CIRCLE" in p.detectors) == (p.circular_phrase is not None)
        roles = [x.role for x in p.people]
        assert roles == sorted(roles, reverse=True) and all(x.accounts for x in p.people)
        shown = [x.background for x in p.transfers]
        assert shown == sorted(shown)
    for r in t["cases_written"].collect():
        assert r.failures == [] and r.passed == r.checked > 2 and r.verdict == "NOT_VERIFIED"
    one = next(p for p in packets.values() if p.is_circular)
    report = evidence.report_html(one.asDict(recursive=True), "<b>", "text", {"decision": "FILE_STR", "name": "A & B"})
    assert "&lt;b&gt;" in report and "A &amp; B" in report and one.volume_digits in report


def test_items_cite_what_they_may(ran):
    _, t, _ = ran
    allowed = {r.id: set(r.allowed) for r in t["allowed"].collect()}
    for r in t["items"].collect():
        assert {r.id, *r.txn_ids, *r.people} <= allowed[r.id]
    assert sorted(r["rank"] for r in t["items"].collect()) == list(range(1, t["items"].count() + 1))
    first = t["items"].where("kind = 'CASE'").first()
    got = investigation.lookup(t["transfers"], t["evidence"].select("txn_id").limit(1)).first()
    assert got.digits.startswith("Rs ") and first.kind == "CASE"
    built = {n: t[n] for n in ("cases", "evidence")}
    look = {r.id: r for r in investigation.opened(t["items"], built).collect()}
    assert look[first.id].volume.startswith("Rs ") and len(look[first.id].sample_ids) <= 10
    assert {r.decision for r in t["log"].collect()} <= {"ESCALATE", "MONITOR"} and t["log"].where("not fallback").count() == 0


def test_resume_makes_nothing_anew(spark, ran):
    folder, t, made = ran
    assert "detections" in made and "cases_written" in made
    again, anew = batch.run(spark, f"{folder}/in", f"{folder}/out", salt="secret")
    assert anew == [] and again["cases"].count() == t["cases"].count()


def test_an_account_without_owner_is_an_error(spark, ran):
    folder, t, _ = ran
    txn = files.transactions(spark, f"{folder}/in/transactions.csv")
    with pytest.raises(domain.MissingOwners):
        domain.owned(txn, t["owners"].where("account_id <> 'ACC00007'"))


def test_the_written_tables_come_back(spark, ran, tmp_path):
    folder, t, _ = ran
    files.write_csv(t["entities"].withColumns({"num_records": F.size("record_ids"), "num_accounts": F.size("account_ids")}).select("entity_key", "canonical_name", "phone", "pan", "address", "num_records", "num_accounts", "account_ids", "record_ids", "has_unverified_link", "is_watchlisted", "rules_used"), f"file://{tmp_path}/resolved_entities.csv", ["entity_key"])
    files.write_csv(t["owners"], f"file://{tmp_path}/account_owners.csv", ["account_id"])
    back = files.resolved_entities(spark, f"file://{tmp_path}/resolved_entities.csv")
    key = lambda df: sorted((r.entity_key, tuple(r.account_ids), r.is_watchlisted, tuple(r.rules_used)) for r in df.collect())
    assert key(back) == key(t["entities"])
    assert files.account_owners(spark, f"file://{tmp_path}/account_owners.csv").count() == t["owners"].count()
    assert files.append_new(t["log"], spark, f"file://{tmp_path}/log", "id") == t["log"].count()
    assert files.append_new(t["log"], spark, f"file://{tmp_path}/log", "id") == 0


def test_configured_thresholds():
    assert Config().circle_max_hops == 8 and Config().control_groups == 20
