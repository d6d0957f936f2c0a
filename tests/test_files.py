"""Readers and writers that the batch does not use, and small functions."""

import json

from pyspark.sql import functions as F

from tracewell.config import Config
from tracewell.functions import money
from tracewell.operators import resolution, views
from tracewell.sources import files


def test_json_documents_and_ids(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"case_id": "C001", "evidence_txn_ids": ["T1", "T2"]}, {"case_id": "C002", "evidence_txn_ids": []}], "about": "x"}, indent=1))
    rows = files.json_rows(spark, f"file://{tmp_path}/cases.json", "cases")
    assert sorted(r.case_id for r in rows.collect()) == ["C001", "C002"]
    txn = spark.createDataFrame([("T1", 1), ("T2", 2), ("T3", 3)], "txn_id string, n int")
    asked = rows.select(F.explode("evidence_txn_ids").alias("txn_id"))
    assert sorted(r.n for r in files.of_ids(txn, asked).collect()) == [1, 2]


def test_views_by_folder(spark, tmp_path):
    nodes = spark.createDataFrame([("ALL", "a"), ("BANK_A", "EXT_1")], "view string, node string")
    edges = spark.createDataFrame([("ALL", "a", "b"), ("BANK_A", "a", "EXT_1")], "view string, u string, v string")
    files.write_views(nodes, edges, f"file://{tmp_path}/graphs")
    back = spark.read.parquet(f"file://{tmp_path}/graphs/edges").where("view = 'BANK_A'")
    assert [(r.u, r.v) for r in back.collect()] == [("a", "EXT_1")]
    assert views.leaks(edges.select("u", "v")) == ["u", "v"] and views.leaks(spark.createDataFrame([("PSU_" + "0" * 16, "PSU_" + "f" * 16)], "u string, v string")) == []


def test_resolution_switched_off_and_ages(spark, tmp_path):
    (tmp_path / "accounts.csv").write_text("account_id,name,account_type,bank,opened_days_ago,kyc_level,owner_entity\nACC00001, A B ,PERSONAL,BANK_A,40,FULL,ENT1\nACC00002,,PERSONAL,BANK_B,7,FULL,ENT2\n")
    accounts = files.accounts(spark, f"file://{tmp_path}/accounts.csv")
    assert "owner_entity" not in accounts.columns
    one = {r.entity_key: (r.canonical_name, r.account_ids) for r in resolution.one_per_account(accounts).collect()}
    assert one == {"ENT_ACC00001": ("A B", ["ACC00001"]), "ENT_ACC00002": (None, ["ACC00002"])}
    assert {r.account_id: r.opened_days_ago for r in files.account_ages(spark, f"file://{tmp_path}/accounts.csv").collect()} == {"ACC00001": 40, "ACC00002": 7}


def test_amounts_as_text(spark):
    rows = spark.createDataFrame([(24_000_000.0,), (140_947_500.0,), (23_837_091.92,), (-150_000.0,), (999.5,), (0.0,)], "x double").select(F.col("x").cast("decimal(20,2)").alias("a"))
    got = rows.select(money.format_inr(F.col("a")), money.inr_words(F.col("a")), money.plain_money(F.col("a")), money.amount_band_name(F.col("a"), Config().band_edges)).collect()
    assert [tuple(r) for r in got] == [
        ("Rs 2,40,00,000", "Rs 2.4 crore", "Rs 24,000,000", "50L_PLUS"), ("Rs 14,09,47,500", "Rs 14.09 crore", "Rs 140,947,500", "50L_PLUS"), ("Rs 2,38,37,091.92", "Rs 2.38 crore", "Rs 23,837,092", "50L_PLUS"),
        ("-Rs 1,50,000", "-Rs 1.5 lakh", "Rs -150,000", "UNDER_10K"), ("Rs 999.50", "Rs 999.50", "Rs 1,000", "UNDER_10K"), ("Rs 0", "Rs 0", "Rs 0", "UNDER_10K"),
    ]
