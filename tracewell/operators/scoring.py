"""Scores against planted truth. Only this module may see answer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.sources import schemas
from tracewell.sources.files import read


def answer_key(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, schemas.GROUND_TRUTH)


def true_people(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, schemas.CUSTOMER_RECORDS).select("record_id", "true_entity_id")


def detector_score(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """detector, findings, true, false: a finding is true if at least half of its transfers are of a ring."""
    each = findings.select("detector", "finding_id", F.explode("txn_ids").alias("txn_id")).join(truth.select("txn_id", "ring_id").distinct(), "txn_id", "left")
    per = each.groupBy("detector", "finding_id").agg((2 * F.count("ring_id") >= F.count_distinct("txn_id")).alias("hit"))
    return per.groupBy("detector").agg(F.count("*").alias("findings"), F.count_if("hit").alias("true"), F.count_if(~F.col("hit")).alias("false"))


def ring_cover(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """ring_id, size, best_cover, caught: the largest share of a ring that one finding holds; caught from a half on."""
    size = truth.groupBy("ring_id").agg(F.count_distinct("txn_id").alias("size"))
    hit = findings.select("finding_id", F.explode("txn_ids").alias("txn_id")).distinct().join(truth, "txn_id").groupBy("ring_id", "finding_id").agg(F.count("*").alias("n"))
    best = hit.groupBy("ring_id").agg(F.max("n").alias("n"))
    return size.join(best, "ring_id", "left").select("ring_id", "size", (F.coalesce("n", F.lit(0)) / F.col("size")).alias("best_cover"), (2 * F.coalesce("n", F.lit(0)) >= F.col("size")).alias("caught"))


def catching_detectors(findings: DataFrame, truth: DataFrame, structural: list[str]) -> DataFrame:
    """ring_id, detector: the detectors of which one finding holds at least half of the ring."""
    size = truth.groupBy("ring_id").agg(F.count_distinct("txn_id").alias("size"))
    each = findings.where(F.col("detector").isin(structural)).select("detector", "finding_id", F.explode("txn_ids").alias("txn_id")).distinct()
    n = each.join(truth, "txn_id").groupBy("ring_id", "detector", "finding_id").agg(F.count("*").alias("n"))
    return n.join(size, "ring_id").where(2 * F.col("n") >= F.col("size")).select("ring_id", "detector").distinct()


def case_score(evidence: DataFrame, truth: DataFrame) -> DataFrame:
    """case_id, ring_id, purity, rings: the ring with most of a case's evidence (the first of equals), its share, and how many rings the case mixes."""
    total = evidence.groupBy("case_id").agg(F.count("*").alias("all"))
    n = evidence.join(truth, "txn_id").groupBy("case_id", "ring_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("case_id")
    top = n.withColumns({"__n": F.row_number().over(w.orderBy(F.desc("n"), "ring_id")), "rings": F.count("*").over(w)}).where("__n = 1")
    return total.join(top, "case_id", "left").select("case_id", "ring_id", (F.coalesce("n", F.lit(0)) / F.col("all")).alias("purity"), F.coalesce("rings", F.lit(0)).alias("rings"))


def ring_cases(evidence: DataFrame, truth: DataFrame, caught: DataFrame) -> DataFrame:
    """ring_id, cases, best_cover, caught, covered: over how many cases a ring is split, and whether one case holds half of a ring that was caught."""
    size = truth.groupBy("ring_id").agg(F.count_distinct("txn_id").alias("size"))
    n = evidence.join(truth, "txn_id").groupBy("ring_id", "case_id").agg(F.count("*").alias("n"))
    per = n.groupBy("ring_id").agg(F.count("*").alias("cases"), F.max("n").alias("n"))
    got = caught.select("ring_id").distinct().withColumn("__c", F.lit(True))
    j = size.join(per, "ring_id", "left").join(got, "ring_id", "left").withColumn("caught", F.coalesce("__c", F.lit(False)))
    cover = F.coalesce("n", F.lit(0))
    return j.select("ring_id", F.coalesce("cases", F.lit(0)).alias("cases"), (cover / F.col("size")).alias("best_cover"), "caught", (F.col("caught") & (2 * cover >= F.col("size"))).alias("covered"))


def accused_precision(core: DataFrame, txn: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: accused, members, precision, over the places at the core of cases; a member has sent or received a ring's transfer."""
    members = txn.join(truth.select("txn_id").distinct(), "txn_id", "left_semi").select(F.explode(F.array("payer", "payee")).alias("m_person")).distinct().withColumn("__m", F.lit(1))
    j = core.select("case_id", "person").join(members, F.col("person") == F.col("m_person"), "left")
    return j.agg(F.count("*").alias("accused"), F.count("__m").alias("members")).withColumn("precision", F.when(F.col("accused") > 0, F.col("members") / F.col("accused")).otherwise(1.0))


def hero_coverage(found: DataFrame, hero: DataFrame) -> DataFrame:
    """view, best, all, whole: of each view's circles (view, path) the most of one ring's transfers (txn_id) that a single circle holds."""
    size = hero.agg(F.count_distinct("txn_id").alias("all"))
    each = found.withColumn("__id", F.array_join("path", ",")).select("view", "__id", F.explode("path").alias("txn_id")).distinct()
    n = each.join(hero.select("txn_id").distinct().withColumn("__h", F.lit(1)), "txn_id", "left").groupBy("view", "__id").agg(F.count("__h").alias("n"))
    best = n.groupBy("view").agg(F.max("n").alias("best"))
    return best.crossJoin(size).select("view", "best", "all", (F.col("best") == F.col("all")).alias("whole"))  # one row on the right


def mixed_clusters(clusters: DataFrame, truth: DataFrame) -> DataFrame:
    """Clusters that hold more than one true person."""
    return clusters.join(truth, "record_id").groupBy("root").agg(F.count_distinct("true_entity_id").alias("people")).where("people > 1")


def key_figures(rows: DataFrame, by: str, amount: str = "total_amount") -> DataFrame:
    """by, n, total: counts and value at risk of findings or cases, by detector, typology or lane."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))
