"""Steps that once lost rows or grew faster than their input: the short way against the plain one."""

import random
from decimal import Decimal

import duckdb
from pyspark.sql import functions as F

from tests.conftest import MIDDLE, SMALL
from tracewell.config import SCALED as CFG
from tracewell.functions import money
from tracewell.operators import cases, consortium, detectors, lens, resolution, temporal
from tracewell.plans import oracles, queries
from tracewell.sources import adapters


def _people(spark):
    return resolution.prepared(adapters.customer_records(spark, SMALL))


def test_name_pairs_in_blocks_are_all_there_once(spark, monkeypatch):
    monkeypatch.setattr(resolution, "BLOCK", 2)
    r = _people(spark)
    rows = r.collect()
    keys = {x.record_id: {("f", i, v) for i, v in enumerate((x.linked_account, x.pan, x.phone, x.address)) if v} | {("i", x.stripped[:1] + " " + x.tokens[-1]), ("t", tuple(sorted(x.tokens))), ("s", x.sound)} for x in rows}
    want = sorted((a, b) for a in keys for b in keys if a < b and keys[a] & keys[b])
    got = resolution.unlinked_pairs(r).select("a", "b").collect()
    assert len(got) > 100 and len(got) == len(set(got))
    assert sorted((p.a, p.b) for p in resolution.blocking_pairs(r).collect()) == want


def test_counters_without_pairs_equal_those_of_all_pairs(spark):
    r = _people(spark)
    short = {x.name: x.n for x in resolution.candidate_counters(r, CFG).collect()}
    assert short == {x.name: x.n for x in resolution.counters(resolution.matched_candidates(r, CFG, False)).collect()}


def test_rules_see_all_candidates_and_links_only_those_with_a_field(spark):
    r = _people(spark)
    plain = resolution.matched(resolution.paired(resolution.blocking_pairs(r), r), CFG, False)
    assert sorted(map(str, plain.collect())) == sorted(map(str, resolution.matched_candidates(r, CFG, False).collect()))
    assert queries._linked(spark, SMALL)[1].count() == resolution.blocking_pairs(r, fields_only=True).count()
    told = resolution.paired(resolution.blocking_pairs(r), r).select("a", "b", queries.names.initials_match(F.col("x.tokens"), F.col("y.tokens")), queries.names.reversed_match(F.col("x.tokens"), F.col("y.tokens")))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, resolution.initials_reversed(r).collect()))


def test_halves_in_words_fall_as_in_the_sql(spark, duck):
    rows = [(d,) for d in range(100_500, 30_000_000, 99_500)] + [(7_719_500,)]
    got = spark.createDataFrame(rows, "d long").select("d", money.inr_words(F.col("d").cast("decimal(20,2)")).alias("w")).collect()
    two = "rtrim(rtrim(format('{{:.2f}}', CAST(round(CAST({0} AS DECIMAL(20,2)) / {1}, 2) AS DOUBLE)), '0'), '.')"
    want = lambda d: duck.execute("SELECT " + two.format(d, 10_000_000 if d >= 10_000_000 else 100_000)).fetchone()[0]
    assert [r.w for r in got] == [f"Rs {want(r.d)} {'crore' if r.d >= 10_000_000 else 'lakh'}" for r in got]


def test_circle_beside_a_smaller_path_that_no_bank_confirms(spark):
    rows = [("t0", 0, 0, 1, 100, "p0", "p1"), ("t1", 100, 1, 2, 80, "p1", "p2"), ("t2", 200, 1, 2, 99, "p1", "p2"), ("t3", 300, 2, 0, 98, "p2", "p0")]
    noded = spark.createDataFrame([(*r[:4], Decimal(r[4]), *r[5:]) for r in rows], "txn_id string, ts long, src long, dst long, amount decimal(18,2), u string, v string")
    assert [(r.path, r.hops) for r in consortium.circles(noded, CFG).collect()] == [(["t0", "t2", "t3"], 3)]


def test_consortium_circles_are_all_there(spark):
    duck = duckdb.connect()
    duck.execute(f"set timezone='UTC'; create view events as select * from '{MIDDLE}/events.parquet'")
    sql = f"""WITH RECURSIVE {oracles.noded("CONSORTIUM")}, b AS (SELECT *, {oracles.BAND} AS band FROM n),
      w AS (SELECT ts + {CFG.circle_window} AS lim, u AS origin, v AS node, dst AS at, ts, amount, band, 1 AS hops, txn_id AS path FROM b
      UNION ALL SELECT w.lim, w.origin, b.v, b.dst, b.ts, b.amount, b.band, w.hops + 1, w.path || ',' || b.txn_id FROM w JOIN b ON b.src = w.at AND b.u = w.node AND b.ts > w.ts AND b.ts <= w.lim AND abs(b.band - w.band) <= 1 AND b.amount >= {CFG.circle_low} * w.amount AND b.amount <= {CFG.circle_high} * w.amount WHERE w.hops < {CFG.circle_max_hops})
      SELECT path, hops FROM w WHERE hops >= {CFG.circle_min_hops} AND node = origin"""
    want = sorted(duck.execute(sql).fetchall())
    assert want and sorted((r.path, r.hops) for r in queries.consortium_circles(spark, MIDDLE).collect()) == want


def test_control_groups_around_a_hub_are_as_large_as_wanted(spark):
    txn = spark.range(1, 2001).selectExpr("cast(id as string) txn_id", "id ts", "id payer", "0L payee")
    sizes = spark.createDataFrame([(i, 5, 10) for i in range(10)], "group long, people long, transfers long")
    got = lens.control_groups(txn, sizes, 20).groupBy("group").count().collect()
    assert len(got) == 200 and {r["count"] for r in got} == {4}
    assert len({r.txn_id for r in lens.control_groups(txn, sizes, 20).select("txn_id").collect()}) > 400  # not the same few neighbours of the hub


def _small_cases(spark):
    b, f, c, ev, span = queries._cases(spark, MIDDLE)
    return b.txn.collect(), {(r.group, r.person) for r in c.collect()}, {r.group: (r.first_ts, r.last_ts) for r in span.collect()}, b.txn, c, ev, span


def _plain_context(txn, core, span):
    for g, (first, last) in span.items():
        for t in txn:
            if (g, t.payee) in core and (g, t.payer) not in core and first - CFG.context_pad <= t.ts <= first:
                yield g, "IN", t.payer, t.txn_id, t.amount
            if (g, t.payer) in core and (g, t.payee) not in core and last <= t.ts <= last + CFG.context_pad:
                yield g, "OUT", t.payee, t.txn_id, t.amount


def test_context_without_its_rows_equals_the_plain_one(spark):
    txn, core, span, *frames = _small_cases(spark)
    rows, sums = list(_plain_context(txn, core, span)), {}
    for g, d, p, _, amount in rows:
        sums.setdefault((g, d), {}).setdefault(p, Decimal(0))
        sums[g, d][p] += amount
    want = {(g, d, p): (s, n) for (g, d), of in sums.items() for n, (p, s) in enumerate(sorted(of.items(), key=lambda x: (-x[1], x[0]))[: CFG.context_top], 1)}
    t, c, _, sp = frames
    top = cases.top_context(c, sp, t, CFG)
    assert want and {(r.group, r.direction, r.person): (r.amount, r["rank"]) for r in top.collect()} == want
    key = lambda r: (r.group, r.direction, r.person, r.txn_id)
    assert sorted(map(key, cases.context(c, sp, t, CFG, top).collect())) == sorted(r[:4] for r in rows if r[:3] in want)
    inside, met = {p for _, p in core}, {}
    for g, _, p, i, _ in rows:
        if p not in inside:
            met.setdefault(p, (set(), set()))[0].add(g)
            met[p][1].add(i)
    assert {r.person: (r.cases, set(r.txn_ids)) for r in cases.leads_around(c, sp, t, CFG).collect()} == {p: (len(g), i) for p, (g, i) in met.items() if len(g) > 1}


def test_outsider_on_both_sides_of_a_case_counts_it_once(spark):
    d = Decimal(5)
    txn = spark.createDataFrame([("t1", 100, d, 9, 1), ("t2", 300, d, 2, 9), ("t3", 100, d, 8, 1), ("t4", 100, d, 9, 3)], "txn_id string, ts long, amount decimal(18,2), payer long, payee long")
    core = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "group string, person long")
    span = spark.createDataFrame([("A", 150, 200), ("B", 150, 200)], "group string, first_ts long, last_ts long")
    assert [(r.person, r.cases, r.txn_ids) for r in cases.leads_around(core, span, txn, CFG).collect()] == [(9, 2, ["t1", "t4", "t2"])]


def test_large_cores_find_the_same_background(spark, monkeypatch):
    *_, t, c, ev, sp = _small_cases(spark)
    small = sorted(map(str, cases.supporting(c, sp, ev, t, CFG).collect()))
    monkeypatch.setattr(cases, "SMALL_CORE", 2)
    assert small and sorted(map(str, cases.supporting(c, sp, ev, t, CFG).collect())) == small


def test_links_ask_for_two_cases_of_a_person_only(spark):
    core = spark.createDataFrame([(f"C{i}", 1) for i in range(8, 200)] + [("C9", 2)], "case_id string, person long")
    top = spark.createDataFrame([("C8", "IN", 1, 5), ("C9", "OUT", 1, 6), ("C9", "IN", 2, 7)], "case_id string, direction string, person long, amount long")
    got = {tuple(r) for r in cases.links(top, core).collect()}
    assert got == {("C8", "C9", 1, "IN", 5), ("C9", "C8", 1, "OUT", 5), ("C9", "C8", 1, "OUT", 6), ("C8", "C9", 1, "IN", 6)}


def test_resolution_joins_send_no_table_to_the_driver(spark):
    r = _people(spark)
    plan = resolution.paired(resolution.blocking_pairs(r, fields_only=True), r)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_windows_of_anchors_are_grouped_without_a_further_shuffle(spark):
    """Members meet their anchor under its own stretch of time, and all of them do."""
    rows = [(s, (i * 37) % 90, f"{s}-{i:02d}", i % 5) for s in (1, 2) for i in range(30)]
    m = temporal.anchored(spark.createDataFrame(rows, "src long, ts long, txn_id string, dst long"), ["src"], 20, 2, ["dst"])
    want = sorted((a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] <= b[1] <= a[1] + 20 and (a[1], a[2]) <= (b[1], b[2]))
    got = sorted((x.a_txn, x.txn_id) for x in m.select("a_txn", "txn_id").collect())
    alone = {a for a in {p[0] for p in want} if sum(p[0] == a for p in want) == 1}
    assert len(got) == len(set(got)) and {p for p in got if p[0] not in alone} == {p for p in want if p[0] not in alone}
    g = m.groupBy("a_src", "a_slot", "a_txn", "dst").agg(F.count("*").alias("n")).groupBy("a_src", "a_slot", "a_txn").agg(F.count("*").alias("receivers"))
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_merges_go_in_order_and_few_go_through_python(spark, monkeypatch):
    """Each cluster merges once, first links first. Links that nothing contests never reach the call that replays a component."""
    chance = random.Random(3)
    free = [(f"x{i}", f"y{i}", f"x{i}", f"y{i}") for i in range(50)]
    pairs = sorted({tuple(sorted(chance.sample(range(40), 2))) for _ in range(60)})
    links = free + [(f"r{chance.randrange(1000):03d}-{i}", f"s{i}", f"c{a:02d}", f"c{b:02d}") for i, (a, b) in enumerate(pairs)] + free[:1]
    used, want = set(), []
    for _, _, low, high in sorted(links):
        if not {low, high} & used:
            used |= {low, high}
            want.append((low, high))
    ddl = "a string, b string, low string, high string"
    assert sorted(map(tuple, resolution.merges(spark.createDataFrame(links, ddl)).collect())) == sorted(want)
    monkeypatch.setattr(resolution, "components", None)
    assert sorted(map(tuple, resolution.merges(spark.createDataFrame(free, ddl)).collect())) == sorted(x[2:] for x in free)


def test_pass_through_legs_bring_their_watch_marks(spark):
    """No join of the pairs with all transfers: the marks come along with the legs."""
    b = adapters.bank(spark, MIDDLE)
    t = detectors.with_watch(b.txn, detectors.watched(b.people))
    marks = {r.txn_id: r.touches_watch for r in t.collect()}
    got = detectors.pass_pairs(t, CFG).collect()
    assert len(got) > 10 and {True, False} <= {r.i_watch for r in got}
    assert all((r.i_watch, r.o_watch) == (marks[r.i_txn], marks[r.o_txn]) for r in got)
