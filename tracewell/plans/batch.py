"""The whole investigation of a folder of domain files, stage by stage, each written where the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.config import Config
from tracewell.operators import cases, detectors, evidence, investigation, lens, resolution, views
from tracewell.sources import domain, files


class Stages:
    """Tables of a folder. With resume a table that is there whole is read instead of made anew."""

    def __init__(self, spark: SparkSession, out: str, resume: bool = True):
        self.spark, self.out, self.resume, self.made = spark, out, resume, []

    def __call__(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.out}/{name}"
        if not (self.resume and files.complete(self.spark, path)):
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)


def lens_sentences(signals: DataFrame) -> DataFrame:
    """case_id, code, sentence for each check that is above the bank's baseline."""
    says = {
        "r1": ("R1", F.format_string("%d of %d accounts were opened within the last days.", "fresh", "accounts")), "r2": ("R2", F.format_string("%d of %d people control more than one of the accounts.", "multi", "persons")),
        "r3": ("R3", F.format_string("%d of %d transfers are first contacts.", "contacts", "transfers")), "r4": ("R4", F.format_string("%d phone numbers are shared with other people.", "phones")),
        "r5": ("R5", F.format_string("Bank A misses %d and bank B %d of the transfers.", "blind_a", "blind_b")),
    }
    each = F.array(*[F.when(F.col(r), F.struct(F.lit(code).alias("code"), text.alias("sentence"))) for r, (code, text) in says.items()])
    return signals.select(F.col("group").alias("case_id"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("s")).select("case_id", "s.*")


def run(spark: SparkSession, folder: str, out: str, cfg: Config | None = None, salt: str = "", resume: bool = True) -> tuple[dict[str, DataFrame], list[str]]:
    """All tables by name, and the names of those that were made in this run. The consortium's view needs a secret salt."""
    cfg, stage, t = cfg or Config(), Stages(spark, out, resume), {}
    resolved: dict[str, DataFrame] = {}

    def resolution_of(which: int) -> DataFrame:
        if not resolved:
            accounts = files.accounts(spark, f"{folder}/accounts.csv")
            resolved["e"], resolved["o"] = resolution.resolve(files.customer_records(spark, f"{folder}/customer_records.csv"), cfg, accounts)
        return resolved["eo"[which]]

    t["entities"] = stage("entities", lambda: resolution_of(0))
    t["owners"] = stage("owners", lambda: resolution_of(1))
    b = domain.load_bank(spark, folder, t["owners"], t["entities"])
    t["transfers"] = b.txn
    for view in views.VIEWS if salt else views.VIEWS[:-1]:
        noded = views.with_nodes(b.txn, b.people, view, salt)
        t[f"edges_{view}"] = stage(f"edges_{view}", lambda n=noded, v=view: views.consortium_edges(n, cfg, salt) if v == "CONSORTIUM" else views.edges(n))
        if view == "CONSORTIUM" and (bad := views.leaks(t[f"edges_{view}"])):
            raise ValueError(f"the consortium's table would show {bad}")
    t["stats"] = stage("stats", lambda: _stats(t))
    watch = detectors.watched(b.people)
    t["detections"] = stage("detections", lambda: detectors.findings(detectors.run_detectors(b, cfg), b.txn, watch))
    t["blind_detections"] = stage("blind_detections", lambda: detectors.findings(detectors.run_detectors(b, cfg, watch.limit(0)), b.txn, watch.limit(0)))
    built: dict[str, DataFrame] = {}

    def case_table(name: str) -> DataFrame:
        if not built:
            built.update(cases.build(t["detections"], b.txn, b.people, cfg))
        return built[name]

    names = ("cases", "core", "evidence", "supporting", "context", "context_people", "links", "signals", "review")
    for name in names:
        t[name] = stage(f"cases/{name}", lambda n=name: case_table(n))
    built = {n: t[n] for n in names}
    t["found_without_watchlist"] = stage("cases/found_without_watchlist", lambda: cases.without_watchlist(t["evidence"], t["blind_detections"]))
    groups = t["evidence"].select(F.col("case_id").alias("group"), "txn_id")
    base = lens.baseline(b.txn, b.accounts, b.people, cfg)
    t["relationships"] = stage("relationships", lambda: lens.signals(lens.measured(groups, b.txn, b.accounts, b.people, cfg), base, cfg))
    said = lens_sentences(t["relationships"])
    t["packets"] = stage("packets", lambda: evidence.packets(built, b.txn, b.accounts, said))
    t["cases_written"] = stage("cases_written", lambda: evidence.written(t["packets"]))
    t["leads"] = stage("leads", lambda: investigation.lead_items(built))
    t["items"] = stage("items", lambda: investigation.triaged(investigation.items(built, t["leads"])))
    t["allowed"] = stage("allowed", lambda: investigation.allowed_ids(t["items"], built, b.txn, b.accounts, said))
    none = t["items"].select("id", F.lit("").alias("decision"), F.lit("").alias("reason")).limit(0)
    t["log"] = stage("investigation_log", lambda: investigation.decided(t["items"], none))
    t["meta"] = stage("investigation_meta", lambda: investigation.meta(t["log"]))
    return t, stage.made


def _stats(t: dict[str, DataFrame]) -> DataFrame:
    out = None
    for view in (v for v in views.VIEWS if f"edges_{v}" in t):
        s = views.stats(t[f"edges_{view}"]).select(F.lit(view).alias("view"), "*")
        out = s if out is None else out.union(s)
    return out
