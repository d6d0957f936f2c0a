"""Hand-written cases with the reference thresholds."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tracewell.config import HOUR, Config
from tracewell.functions import money, names
from tracewell.operators import detectors, temporal
from tracewell.sources import adapters

SCHEMA = "txn_id string, ts long, src long, dst long, amount decimal(18,2), channel string, src_bank string, dst_bank string, payer long, payee long"
CFG = Config()


def transfers(spark, rows, channel="UPI"):
    """rows of (seconds, payer, payee, amount); person p has account 10 p."""
    return spark.createDataFrame([(f"T{i:03}", t, a * 10, b * 10, D(str(x)), channel, "BANK_A", "BANK_A", a, b) for i, (t, a, b, x) in enumerate(rows)], SCHEMA)


def nobody(spark):
    return spark.createDataFrame([], "w_person long")


def circles(spark, rows):
    return [r.txn_ids for r in detectors.circle(transfers(spark, rows), CFG).collect()]


RING = [(0, 1, 2, 100000), (HOUR, 2, 3, 90000), (2 * HOUR, 3, 1, 80000)]


def test_circle_of_three(spark):
    assert circles(spark, RING) == [["T000", "T001", "T002"]]


def test_refund_is_no_circle(spark):
    assert circles(spark, [(0, 1, 2, 100), (HOUR, 2, 1, 100)]) == []


@pytest.mark.parametrize(("last", "n"), [(72 * HOUR, 1), (72 * HOUR + 1, 0)])
def test_circle_window_is_closed(spark, last, n):
    assert len(circles(spark, [*RING[:2], (last, 3, 1, 80000)])) == n


def test_circle_keeps_its_money_and_moves_on(spark):
    assert circles(spark, [RING[0], (HOUR, 2, 3, 84990), RING[2]]) == []
    assert circles(spark, [RING[0], (0, 2, 3, 90000), RING[2]]) == []


def speeds(spark, hops, watch=None):
    txn = transfers(spark, [(600 * i, i, i + 1, 1000 - i) for i in range(hops)])
    w = spark.createDataFrame([(x,) for x in watch or []], "w_person long")
    return detectors.speed(txn, w, CFG).count()


def test_speed_needs_three_hops_or_two_with_a_watched_person(spark):
    assert (speeds(spark, 3), speeds(spark, 2), speeds(spark, 2, [1])) == (1, 0, 1)


def thresholds(spark, amounts):
    txn = transfers(spark, [(3600 * i, 5 + i, 1, x) for i, x in enumerate(amounts)], "CASH")
    return detectors.threshold(txn, nobody(spark), CFG).count()


def test_threshold_counts_and_limits(spark):
    assert thresholds(spark, [45000, 46000, 47000, 48000, 50000]) == 1
    assert thresholds(spark, [45000, 46000, 47000, 48000]) == 0
    assert thresholds(spark, [45000, 46000, 47000, 48000, "50000.01"]) == 0


def sprays(spark, receivers, collectors=1):
    rows = [(i * 60, 1, 10 + i, 1000) for i in range(receivers)] + [(i * 60 + 1800, 10 + i, 90 + i % collectors, 950) for i in range(receivers)]
    return detectors.spray(transfers(spark, rows), nobody(spark), CFG).count()


def test_spray(spark):
    assert (sprays(spark, 8), sprays(spark, 7), sprays(spark, 10, 2)) == (1, 0, 0)


def test_pass_through_matches_one_to_one(spark):
    txn = transfers(spark, [(0, 1, 2, 100), (60, 3, 2, 100), (120, 2, 4, 95)])
    assert [r.i_txn for r in detectors.pass_pairs(txn, CFG).collect()] == ["T000"]


def test_empty_tables_give_no_findings(spark):
    txn = transfers(spark, [])
    assert detectors.circle(txn, CFG).count() == detectors.spray(txn, nobody(spark), CFG).count() == detectors.pass_through(txn, nobody(spark), CFG).count() == 0


def test_range_join_against_brute_force(spark):
    txn = adapters.transfers(spark, "/root/testdata/sf0.001").cache()
    rows = txn.collect()
    want = {(a.txn_id, b.txn_id) for a in rows for b in rows if a.dst == b.src and a.ts < b.ts <= a.ts + 6 * HOUR and D("0.9") * a.amount <= b.amount <= a.amount}
    assert {(r.txn_id, r.n_txn) for r in temporal.links(txn, 6 * HOUR, D("0.90"), D("1.00")).collect()} == want and want


@pytest.mark.parametrize(("amount", "text", "words"), [("24000000", "Rs 2,40,00,000", "Rs 2.4 crore"), ("140947500", "Rs 14,09,47,500", "Rs 14.09 crore"), ("23837091.92", "Rs 2,38,37,091.92", None)])
def test_rupees(spark, amount, text, words):
    r = spark.range(1).select(money.format_inr(F.lit(D(amount))).alias("t"), money.inr_words(F.lit(D(amount))).alias("w")).first()
    assert r.t == text and words in (None, r.w)


def test_sound_code_of_neighbouring_equal_codes(spark):
    assert spark.range(1).select(names.sound_code(F.lit("Ashcraft")).alias("s")).first().s == "A226"
