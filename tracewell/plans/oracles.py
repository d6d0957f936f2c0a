"""DuckDB SQL that restates the queries from their definitions, with the same column names."""

from __future__ import annotations

from tracewell.config import SCALED as CFG
from tracewell.plans.queries import SALT
from tracewell.sources.adapters import FIRST, LAST

ORACLES: dict[str, str] = {}

T = """
raw AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS txn_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst,
  CAST(value AS DECIMAL(18,2)) AS amount, CASE WHEN event_type = 'purchase' THEN 'CASH' ELSE event_type END AS channel FROM events),
t AS (SELECT *, CASE WHEN src % 2 = 0 THEN 'BANK_A' ELSE 'BANK_B' END AS src_bank, CASE WHEN dst % 2 = 0 THEN 'BANK_A' ELSE 'BANK_B' END AS dst_bank, src // 2 AS payer, dst // 2 AS payee,
  (src // 2) % 17 = 0 OR (dst // 2) % 17 = 0 AS touch FROM raw)"""
ACC = "acc AS (SELECT DISTINCT account, account // 2 AS person, account * 37 % 1000 AS age, CASE WHEN account % 2 = 0 THEN 'BANK_A' ELSE 'BANK_B' END AS bank FROM (SELECT src AS account FROM t UNION ALL SELECT dst FROM t))"


def pairs(window: int, low: str, high: str, name: str = "link", frm: str = "t") -> str:
    return f"""{name} AS (SELECT a.*, b.txn_id AS n_txn, b.ts AS n_ts, b.src AS n_src, b.dst AS n_dst, b.amount AS n_amount, b.payer AS n_payer, b.payee AS n_payee, b.touch AS n_touch
  FROM {frm} a JOIN {frm} b ON b.src = a.dst AND b.ts > a.ts AND b.ts <= a.ts + {window} AND b.amount >= {low} * a.amount AND b.amount <= {high} * a.amount)"""


LINK = pairs(CFG.speed_link, str(CFG.speed_low), str(CFG.speed_high))

# --- views
_NODES = {"ALL": ("CAST(payer AS VARCHAR)", "CAST(payee AS VARCHAR)", "true")}
for _b in ("BANK_A", "BANK_B"):
    _NODES[_b] = tuple(f"CASE WHEN {s}_bank = '{_b}' THEN CAST({p} AS VARCHAR) ELSE 'EXT_' || CAST({s} AS VARCHAR) END" for s, p in (("src", "payer"), ("dst", "payee"))) + (f"src_bank = '{_b}' OR dst_bank = '{_b}'",)


def _psu(person: str, bank: str) -> str:
    return f"'PSU_' || substr(sha256(coalesce(CASE WHEN {person} % 5 <> 0 THEN 'PAN' || lpad(CAST({person} AS VARCHAR), 7, '0') END, {bank} || ':' || CAST({person} AS VARCHAR)) || '{SALT}'), 1, 16)"


_NODES["CONSORTIUM"] = (_psu("payer", "src_bank"), _psu("payee", "dst_bank"), "true")


def noded(view: str) -> str:
    u, v, where = _NODES[view]
    return f"{T}, n AS (SELECT *, {u} AS u, {v} AS v FROM t WHERE {where})"


def _edges(view: str) -> str:
    return f"""WITH {noded(view)} SELECT u, v, count(*) AS txn_count, CAST(sum(amount) AS DOUBLE) AS total_amount, CAST(min(amount) AS DOUBLE) AS min_amount, CAST(max(amount) AS DOUBLE) AS max_amount, min(ts) AS first_ts, max(ts) AS last_ts,
  string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, string_agg(txn_id, ',' ORDER BY ts, txn_id) AS txn_ids, bool_or(src_bank <> dst_bank) AS crosses_banks, u = v AS is_self_transfer FROM n GROUP BY u, v"""


ORACLES["edge_aggregate"] = _edges("ALL")
ORACLES["edge_aggregate_bank_a"] = _edges("BANK_A")
ORACLES["edge_aggregate_bank_b"] = _edges("BANK_B")
BAND = "CASE " + " ".join(f"WHEN amount <= {e} THEN {n}" for n, e in enumerate(CFG.band_edges)) + f" ELSE {len(CFG.band_edges)} END"
HOUR = "strftime(make_timestamp((ts - ts % 3600) * 1000000), '%Y-%m-%d %H:00')"
ORACLES["edge_aggregate_consortium"] = f"""WITH {noded("CONSORTIUM")}, b AS (SELECT *, {BAND} AS band, {HOUR} AS hour, substr(sha256(txn_id || '{SALT}'), 1, 16) AS ref FROM n)
  SELECT u, v, count(*) AS txn_count, string_agg(DISTINCT CAST(band AS VARCHAR), ',' ORDER BY CAST(band AS VARCHAR)) AS amount_bands, string_agg(DISTINCT hour, ',' ORDER BY hour) AS hour_buckets, bool_or(src_bank <> dst_bank) AS crosses_banks,
  string_agg(ref, ',' ORDER BY ref) AS evidence_refs, u = v AS is_self_transfer FROM b GROUP BY u, v"""
ORACLES["node_flow"] = f"""WITH {noded("ALL")}, e AS (SELECT u AS node, amount AS sent, CAST(0 AS DECIMAL(18,2)) AS received FROM n UNION ALL SELECT v, 0, amount FROM n)
  SELECT node, CAST(sum(sent) AS DOUBLE) AS total_sent, CAST(sum(received) AS DOUBLE) AS total_received, count(*) AS txn_count FROM e GROUP BY node"""
ORACLES["node_attributes"] = f"""WITH {noded("BANK_A")}, {ACC}, ends AS (SELECT u AS node, payer AS person, src AS account, src_bank AS bank FROM n UNION SELECT v, payee, dst, dst_bank FROM n),
  held AS (SELECT person, string_agg(CAST(account AS VARCHAR), ',' ORDER BY account) AS account_ids, string_agg(DISTINCT bank, ',' ORDER BY bank) AS banks_used FROM acc WHERE bank = 'BANK_A' GROUP BY person)
  SELECT DISTINCT node, true AS is_external, false AS is_watchlisted, CAST(account AS VARCHAR) AS account_ids, bank AS banks_used FROM ends WHERE node LIKE 'EXT\\_%' ESCAPE '\\'
  UNION ALL SELECT DISTINCT node, false, e.person % 17 = 0, h.account_ids, h.banks_used FROM ends e JOIN held h USING (person) WHERE node NOT LIKE 'EXT\\_%' ESCAPE '\\'"""
_STATS = []
for _v in ("ALL", "BANK_A", "BANK_B", "CONSORTIUM"):
    _u, _w, _where = _NODES[_v]
    _n = f"(SELECT {_u} AS u, {_w} AS v, bool_or(src_bank <> dst_bank) AS c FROM t WHERE {_where} GROUP BY 1, 2)"
    _STATS.append(f"SELECT '{_v}' AS view, (SELECT count(*) FROM (SELECT u FROM {_n} UNION SELECT v FROM {_n})) AS nodes, (SELECT count(*) FROM {_n}) AS edges, (SELECT count(*) FROM {_n} WHERE u = v) AS self_edges, (SELECT count(*) FROM {_n} WHERE c) AS cross_bank_edges")
ORACLES["view_stats"] = f"WITH {T} " + " UNION ALL ".join(_STATS)
ORACLES["degree_top5"] = f"""WITH {noded("ALL")}, e AS (SELECT DISTINCT u, v FROM n) SELECT node, count(*) AS degree FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY node ORDER BY degree DESC, node LIMIT 5"""
ORACLES["account_bank_map"] = f"WITH {T} SELECT account, max(bank) AS bank, min(bank) <> max(bank) AS conflict FROM (SELECT src AS account, src_bank AS bank FROM t UNION ALL SELECT dst, dst_bank FROM t) GROUP BY account"
ORACLES["privacy_check"] = ORACLES["edge_aggregate_consortium"].join(("SELECT count(*) AS edges, CAST(count(*) FILTER (u NOT LIKE 'PSU_%' OR v NOT LIKE 'PSU_%') AS BIGINT) AS bad_ends FROM (", ")"))

# --- names and resolution
_first, _last = (f"[{', '.join(repr(x.capitalize()) for x in xs)}]" for xs in (FIRST, LAST))
SUFFIX = "^(.*?\\S)((\\s+(and sons|pvt ltd|sons|traders|enterprises|co|pvt|ltd))+)$"


def sound(word: str) -> str:
    coded = f"translate(upper({word}), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000')"
    for d in "123456":
        coded = f"regexp_replace({coded}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN length({word}) > 0 THEN substr(substr(upper({word}), 1, 1) || regexp_replace(substr({coded}, 2), '[^1-6]', '', 'g') || '000', 1, 4) ELSE '' END"


R = f"""
c AS (SELECT c_custkey AS k, c_custkey // 3 AS e FROM customer),
f AS (SELECT *, {_first}[CAST(e % 12 + 1 AS INT)] AS fn, {_last}[CAST((e // 12) % 12 + 1 AS INT)] AS ln FROM c),
w AS (SELECT 'REC' || lpad(CAST(k AS VARCHAR), 9, '0') AS record_id, CASE WHEN k % 5 = 0 THEN fn || ' ' || ln WHEN k % 5 = 1 THEN substr(fn, 1, 1) || '. ' || ln WHEN k % 5 = 2 THEN upper(fn || ' ' || ln) WHEN k % 5 = 3 THEN ln || ' ' || fn ELSE fn || ' ' || ln || ' & Sons' END AS name_as_written,
  CASE WHEN k % 4 <> 0 THEN '9' || lpad(CAST(e * 7919 % 1000000000 AS VARCHAR), 9, '0') END AS phone, CASE WHEN k % 5 NOT IN (1, 3) THEN 'PAN' || lpad(CAST(e AS VARCHAR), 7, '0') END AS pan,
  CASE WHEN k % 7 <> 2 THEN 'ADDR' || CAST(k // 6 AS VARCHAR) END AS address, 'ACC' || lpad(CAST(k // 2 AS VARCHAR), 9, '0') AS linked_account FROM f),
w2 AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name_as_written), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS normalized FROM w),
w3 AS (SELECT *, regexp_replace(normalized, '{SUFFIX}', '\\1') AS stripped FROM w2),
r AS (SELECT *, string_split(stripped, ' ') AS tokens, {sound("string_split(stripped, ' ')[-1]")} AS sound FROM w3),
keys AS (SELECT record_id, unnest(['acc:' || linked_account, 'pan:' || pan, 'pho:' || phone, 'adr:' || address, 'ini:' || substr(stripped, 1, 1) || ' ' || tokens[-1], 'tok:' || array_to_string(list_sort(tokens), ' '), 'nam:' || stripped, 'snd:' || sound]) AS key FROM r),
cand AS (SELECT DISTINCT x.record_id AS a, y.record_id AS b FROM keys x JOIN keys y ON x.key = y.key AND x.record_id < y.record_id),
p AS (SELECT a, b, x.tokens AS ta, y.tokens AS tb, x.stripped AS sa, y.stripped AS sb, x.sound AS ua, y.sound AS ub, coalesce(x.linked_account = y.linked_account, false) AS acc, coalesce(x.pan = y.pan, false) AS pan, coalesce(x.phone = y.phone, false) AS pho, coalesce(x.address = y.address, false) AS adr,
  coalesce(x.pan <> y.pan, false) AS b1, coalesce(x.phone <> y.phone, false) AND coalesce(x.address <> y.address, false) AS b2, coalesce(x.phone <> y.phone, false) AS pc FROM cand JOIN r x ON x.record_id = a JOIN r y ON y.record_id = b),
q AS (SELECT *, ta <> tb AND len(ta) >= 2 AND ta = list_reverse(tb) AS turned,
  len(ta) = len(tb) AND len(list_filter(range(1, len(ta) + 1), lambda i: ta[i] = tb[i] OR (length(ta[i]) = 1 AND starts_with(tb[i], ta[i])) OR (length(tb[i]) = 1 AND starts_with(ta[i], tb[i])))) = len(ta) AND len(list_filter(range(1, len(ta) + 1), lambda i: ta[i] <> tb[i])) > 0 AS initials FROM p),
m AS (SELECT a, b, tier, CASE tier WHEN 'GREEN' THEN gr WHEN 'YELLOW' THEN ye ELSE [] END AS rl, CASE WHEN b1 THEN 'B1_PAN_CONFLICT' WHEN tier = 'BLOCKED' THEN 'B2_NAME_ONLY_CONFLICT' END AS bl, b1 AND adr AS b3 FROM (SELECT *,
  CASE WHEN b1 THEN 'BLOCKED' WHEN len(gr) > 0 THEN 'GREEN' WHEN b2 THEN 'BLOCKED' WHEN len(ye) > 0 THEN 'YELLOW' ELSE 'NONE' END AS tier FROM (SELECT *,
  list_filter(['R0_same_account', 'R1_same_pan', 'R2_phone_and_name_sim', 'R3_address_and_name_sim', 'R4_phone_and_address'], lambda x, i: [acc, pan, pho AND sa = sb AND NOT b2, adr AND sa = sb AND NOT pc AND NOT b2, pho AND adr][i]) AS gr,
  list_filter(['R5_initials', 'R6_reversed', 'R7_suffix_stripped', 'R8_soundex'], lambda x, i: [(pho OR adr OR pan) AND initials, (pho OR adr OR pan) AND turned, (pho OR adr OR pan) AND sa = sb, (pho OR adr OR pan) AND sa = sb AND ua = ub][i]) AS ye FROM q)))"""
ORACLES["normalize_names"] = f"WITH {R} SELECT record_id, normalized, stripped FROM r"
ORACLES["soundex_names"] = f"WITH {R} SELECT record_id, sound FROM r UNION ALL SELECT CAST(p_partkey AS VARCHAR), {sound('regexp_replace(p_name, ' + repr('[^A-Za-z]') + ', ' + repr('') + ', ' + repr('g') + ')')} FROM part"
ORACLES["blocking_pairs"] = f"WITH {R} SELECT a, b FROM cand"
ORACLES["initials_reversed_match"] = f"WITH {R} SELECT a, b, initials, turned FROM q"
ORACLES["match_rules_without_similarity"] = f"WITH {R} SELECT a, b, tier, array_to_string(rl, ',') AS rules, bl AS blocker FROM m"
ORACLES["match_counters"] = f"WITH {R} SELECT rule, count(*) AS n FROM (SELECT unnest(list_concat(rl, CASE WHEN bl IS NULL THEN [] ELSE [bl] END, CASE WHEN b3 THEN ['B3_SAME_ADDRESS'] ELSE [] END)) AS rule FROM m) GROUP BY rule"
ORACLES["blocking_pairs_on_fields"] = f"WITH {R} SELECT DISTINCT x.record_id AS a, y.record_id AS b FROM keys x JOIN keys y ON x.key = y.key AND x.record_id < y.record_id WHERE x.key[1:4] IN ('acc:', 'pan:', 'pho:', 'adr:')"
GREEN = "g AS (SELECT a AS u, b AS v FROM m WHERE tier = 'GREEN' UNION SELECT b, a FROM m WHERE tier = 'GREEN'), reach(node, root) AS (SELECT u, u FROM g UNION SELECT g.v, reach.root FROM reach JOIN g ON g.u = reach.node), comp AS (SELECT node AS record_id, min(root) AS root FROM reach GROUP BY node)"
ORACLES["green_components"] = f"WITH RECURSIVE {R}, {GREEN} SELECT record_id, root FROM comp"


def _common(f: str) -> str:
    return f"(SELECT root, {f} FROM (SELECT root, {f}, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, min(record_id)) AS i FROM r JOIN comp USING (record_id) WHERE {f} IS NOT NULL GROUP BY root, {f}) WHERE i = 1)"


ORACLES["canonical_entity"] = f"""WITH RECURSIVE {R}, {GREEN}, nm AS (SELECT root, name_as_written AS canonical_name FROM (SELECT root, name_as_written, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, length(name_as_written) DESC, name_as_written) AS i FROM r JOIN comp USING (record_id) GROUP BY root, name_as_written) WHERE i = 1)
  SELECT nm.root, canonical_name, phone, pan, address, n_records, n_accounts FROM nm LEFT JOIN {_common("phone")} USING (root) LEFT JOIN {_common("pan")} USING (root) LEFT JOIN {_common("address")} USING (root)
  JOIN (SELECT root, count(*) AS n_records, count(DISTINCT linked_account) AS n_accounts FROM r JOIN comp USING (record_id) GROUP BY root) USING (root)"""
ORACLES["pairwise_precision_recall"] = """WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL), s AS (SELECT (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM c) AS together, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT sum(n) AS n FROM c GROUP BY quality)) AS predicted_pairs, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT sum(n) AS n FROM c GROUP BY toxic)) AS true_pairs)
  SELECT *, together / predicted_pairs AS precision, together / true_pairs AS recall FROM s"""

# --- money and text
_d = "CAST(whole AS VARCHAR)"
_GROUPED = f"CASE WHEN length({_d}) <= 3 THEN {_d} ELSE ltrim(reverse(regexp_replace(reverse(left({_d}, length({_d}) - 3)), '(..)', '\\1,', 'g')), ',') || ',' || right({_d}, 3) END"
_TRIM = "rtrim(rtrim(format('{{:.2f}}', CAST(round(a / {0}, 2) AS DOUBLE)), '0'), '.')"
ORACLES["format_inr"] = f"""WITH o AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * (o_orderkey % 500) AS DECIMAL(20,2)) AS a FROM orders), d AS (SELECT *, CAST(floor(a) AS BIGINT) AS whole, CAST((a * 100) % 100 AS BIGINT) AS paise FROM o),
  i AS (SELECT *, 'Rs ' || {_GROUPED} || CASE WHEN paise > 0 THEN '.' || lpad(CAST(paise AS VARCHAR), 2, '0') ELSE '' END AS inr FROM d)
  SELECT o_orderkey, inr, CASE WHEN a >= 10000000 THEN 'Rs ' || {_TRIM.format("10000000")} || ' crore' WHEN a >= 100000 THEN 'Rs ' || {_TRIM.format("100000")} || ' lakh' ELSE inr END AS words FROM i"""
ORACLES["durations_shares"] = f"""WITH {T}, d AS (SELECT txn_id, (ts % 200000) // 60 AS x, src FROM t) SELECT txn_id, CASE WHEN x < 120 THEN CAST(x AS VARCHAR) || ' min' WHEN x < 2880 THEN format('{{:.1f}}', x / 60) || ' h' ELSE format('{{:.0f}}', x / 1440) || ' days' END AS duration,
  CAST(src // 10 AS VARCHAR) || '.' || CAST(src % 10 AS VARCHAR) || '%' AS share FROM d"""
ORACLES["amount_band_names"] = """WITH o AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * (o_orderkey % 500) AS DECIMAL(20,2)) AS a FROM orders)
  SELECT o_orderkey, CASE WHEN a <= 10000 THEN 'UNDER_10K' WHEN a <= 100000 THEN '10K_1L' WHEN a <= 500000 THEN '1L_5L' WHEN a <= 1000000 THEN '5L_10L' WHEN a <= 5000000 THEN '10L_50L' ELSE '50L_PLUS' END AS band FROM o"""
ORACLES["indian_amounts"] = f"""WITH o AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * (o_orderkey % 500) AS DECIMAL(20,2)) AS a FROM orders), d AS (SELECT *, CAST(floor(a) AS BIGINT) AS whole, CAST((a * 100) % 100 AS BIGINT) AS paise FROM o),
  i AS (SELECT *, 'Rs ' || {_GROUPED} || CASE WHEN paise > 0 THEN '.' || lpad(CAST(paise AS VARCHAR), 2, '0') ELSE '' END AS inr FROM d) SELECT o_orderkey, 'moved ' || inr || ' in ' || CAST(o_orderkey AS VARCHAR) || ' steps, then Rs 12,34,567 more' AS text FROM i"""
ORACLES["extract_dates"] = """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), x AS (SELECT o_orderkey, list_sort(list_distinct([d, d + 3, d + CAST(o_orderkey % 3 AS INT)])) AS days FROM o)
  SELECT o_orderkey, array_to_string(list_transform(days, lambda y: CAST(y AS VARCHAR)), ',') AS days FROM x"""
ORACLES["typology_text"] = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Circular' WHEN event_id % 3 = 0 THEN 'Mule net' WHEN event_id % 5 = 0 THEN 'Structur' WHEN event_id % 7 = 0 THEN 'Rapid la' ELSE 'Unclassi' END AS kind, event_id % 2 = 0 OR event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0 AS known FROM events"""
ORACLES["circular_phrase"] = f"""WITH o AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * (o_orderkey % 500) AS DECIMAL(20,2)) AS a FROM orders), d AS (SELECT *, CAST(floor(a) AS BIGINT) AS whole, CAST((a * 100) % 100 AS BIGINT) AS paise FROM o),
  i AS (SELECT *, 'Rs ' || {_GROUPED} || CASE WHEN paise > 0 THEN '.' || lpad(CAST(paise AS VARCHAR), 2, '0') ELSE '' END AS inr FROM d)
  SELECT o_orderkey, inr || ' was cycled through ' || CAST(o_orderkey % 7 + 3 AS VARCHAR) || ' accounts, generating ' || inr || ' in total transaction volume' || CASE WHEN o_orderkey % 2 = 0 THEN ', with 91.5% of the principal returning to the originating account' ELSE '' END AS phrase FROM i"""
ORACLES["amount_hour_buckets"] = f"WITH {T} SELECT CAST({BAND} AS BIGINT) AS band, {HOUR} AS hour, count(*) AS n FROM t GROUP BY 1, 2"
ORACLES["text_mentions"] = """SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}'))) AS numbers, len(list_distinct(regexp_extract_all(text, '\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b'))) AS iso_dates,
  regexp_matches(text, '(?i)closed[- ]loop|\\bcircular\\b|round[- ]trip|cycled back|return(?:ed|ing) to (?:the |its )?(?:origin|originat)') AS loop_claim FROM documents"""

# --- walks and detectors
WALK = f"""walk AS (SELECT ts + {CFG.circle_window} AS lim, payer AS origin, payee AS holder, dst AS at, ts, amount, amount AS first_amount, 1 AS hops, txn_id AS path FROM t
  UNION ALL SELECT w.lim, w.origin, t.payee, t.dst, t.ts, t.amount, w.first_amount, w.hops + 1, w.path || ',' || t.txn_id FROM walk w JOIN t ON t.src = w.at AND t.ts > w.ts AND t.ts <= w.lim AND t.amount >= {CFG.circle_low} * w.amount AND t.amount <= {CFG.circle_high} * w.amount WHERE w.hops < {CFG.circle_max_hops}),
closed AS (SELECT DISTINCT path, CAST(hops AS BIGINT) AS hops, origin, CAST(first_amount AS DOUBLE) AS first_amount, CAST(amount AS DOUBLE) AS last_amount FROM walk WHERE hops >= {CFG.circle_min_hops} AND holder = origin)"""
ORACLES["circle_walks"] = f"WITH RECURSIVE {T}, {WALK} SELECT path, hops, origin, first_amount, last_amount FROM closed"
ORACLES["circle_maximal"] = f"WITH RECURSIVE {T}, {WALK} SELECT path, hops FROM closed c WHERE NOT EXISTS (SELECT 1 FROM closed d WHERE d.hops > c.hops AND list_has_all(string_split(d.path, ','), string_split(c.path, ',')))"
ORACLES["speed_links"] = f"WITH {T}, {LINK} SELECT txn_id, n_txn, n_ts - ts AS gap FROM link"
CHAIN = """ch AS (SELECT n_txn AS last, txn_id || ',' || n_txn AS path, CAST(2 AS BIGINT) AS hops, touch OR n_touch AS watch FROM link WHERE txn_id NOT IN (SELECT n_txn FROM link) UNION ALL SELECT l.n_txn, ch.path || ',' || l.n_txn, ch.hops + 1, ch.watch OR l.n_touch FROM ch JOIN link l ON l.txn_id = ch.last),
full_chain AS (SELECT path, hops, watch FROM ch WHERE last NOT IN (SELECT txn_id FROM link))"""
ORACLES["speed_chains"] = f"WITH RECURSIVE {T}, {LINK}, {CHAIN} SELECT path, hops FROM full_chain"
ORACLES["speed_findings"] = f"WITH RECURSIVE {T}, {LINK}, {CHAIN} SELECT path AS key, hops, CAST(CASE WHEN watch THEN {CFG.speed_hops_watch} ELSE {CFG.speed_hops} END AS BIGINT) AS required FROM full_chain WHERE hops >= CASE WHEN watch THEN {CFG.speed_hops_watch} ELSE {CFG.speed_hops} END"
ANCH = "anch AS (SELECT a.src AS a_src, a.txn_id AS a_txn, a.ts AS a_ts, m.* FROM t a JOIN t m ON m.src = a.src AND m.ts <= a.ts + {w} AND (m.ts > a.ts OR (m.ts = a.ts AND m.txn_id >= a.txn_id)))".format(w=CFG.spray_window)
ORACLES["spray_fanout_windows"] = f"WITH {T}, {ANCH} SELECT a_src, a_txn, count(*) AS n, count(DISTINCT dst) AS receivers FROM anch GROUP BY a_src, a_txn HAVING count(DISTINCT dst) >= 3"
FWD = pairs(CFG.spray_delay, str(CFG.spray_low), str(CFG.spray_high), "fl") + ", fwd AS (SELECT txn_id, n_txn AS f_txn, n_ts AS f_ts, n_dst AS f_dst, n_touch AS f_touch FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY n_ts, n_txn) AS i FROM fl) WHERE i = 1)"
ORACLES["spray_forward_asof"] = f"WITH {T}, {FWD} SELECT txn_id, f_txn, f_ts, f_dst FROM fwd"
ORACLES["spray_findings"] = f"""WITH {T}, {FWD}, {ANCH}, j AS (SELECT anch.*, f_txn, f_dst, f_touch, row_number() OVER (PARTITION BY a_txn, dst ORDER BY CASE WHEN f_txn IS NULL THEN 1 ELSE 0 END, ts, anch.txn_id) AS i FROM anch LEFT JOIN fwd ON fwd.txn_id = anch.txn_id),
  per AS (SELECT a_src, a_txn, a_ts, dst, f_dst, touch OR coalesce(f_touch, false) AS w FROM j WHERE i = 1), tot AS (SELECT a_txn, count(*) AS receivers FROM per GROUP BY a_txn), mu AS (SELECT a_src, a_txn, a_ts, f_dst AS collector, count(*) AS mules, bool_or(w) AS w FROM per WHERE f_dst IS NOT NULL GROUP BY ALL),
  ok AS (SELECT *, CASE WHEN w THEN {CFG.spray_receivers_watch} ELSE {CFG.spray_receivers} END AS required FROM mu JOIN tot USING (a_txn) WHERE mules >= {CFG.spray_share} * receivers),
  best AS (SELECT *, row_number() OVER (PARTITION BY a_src, collector ORDER BY mules DESC, a_ts, a_txn) AS i FROM ok WHERE receivers >= required) SELECT a_src AS src, collector, a_txn, receivers, mules, CAST(required AS BIGINT) AS required FROM best WHERE i = 1"""
_LIM = ", ".join(map(str, CFG.threshold_limits))
CASH = f"""cash AS (SELECT t.*, l AS lim FROM t, (SELECT unnest([{_LIM}]) AS l) WHERE channel = '{CFG.threshold_channel}' AND amount >= {CFG.threshold_low} * l AND amount <= l),
win AS (SELECT a.txn_id, a.payee, a.lim, a.ts, count(*) AS n, CASE WHEN bool_or(m.touch) THEN {CFG.threshold_count_watch} ELSE {CFG.threshold_count} END AS required FROM cash a JOIN cash m ON m.payee = a.payee AND m.lim = a.lim AND m.ts BETWEEN a.ts AND a.ts + {CFG.threshold_window} GROUP BY ALL),
fl AS (SELECT c.*, EXISTS (SELECT 1 FROM win w WHERE w.payee = c.payee AND w.lim = c.lim AND w.n >= w.required AND c.ts BETWEEN w.ts AND w.ts + {CFG.threshold_window}) AS flagged FROM cash c)"""
ORACLES["threshold_windows"] = f"WITH {T}, {CASH} SELECT w.payee, CAST(w.lim AS BIGINT) AS \"limit\", w.txn_id, n AS in_window, CAST(required AS BIGINT) AS required, n >= required AS opens, flagged FROM win w JOIN fl ON fl.txn_id = w.txn_id AND fl.lim = w.lim"
ORACLES["threshold_findings"] = f"""WITH {T}, {CASH}, g AS (SELECT payee, lim, string_agg(txn_id, ',' ORDER BY ts, txn_id) AS txn_ids, count(*) AS flagged_deposits FROM fl WHERE flagged GROUP BY payee, lim),
  b AS (SELECT *, row_number() OVER (PARTITION BY payee, lim ORDER BY n DESC, ts, txn_id) AS i FROM win WHERE n >= required) SELECT g.payee || '@' || g.lim AS key, txn_ids, n AS deposits_in_window, flagged_deposits, CAST(required AS BIGINT) AS required FROM g JOIN b ON b.payee = g.payee AND b.lim = g.lim AND i = 1"""
ORACLES["dormant_reactivation"] = f"""WITH {T}, {ACC}, tc AS (SELECT src AS account, 1 AS s, * FROM t UNION ALL SELECT dst, 0, * FROM t), o AS (SELECT *, row_number() OVER w AS nth, ts - lag(ts) OVER w AS gap FROM tc WINDOW w AS (PARTITION BY account ORDER BY ts, txn_id, s DESC)),
  c AS (SELECT o.account, o.nth, o.gap, o.txn_id AS a_txn, o.ts AS a_ts, count(*) AS burst_txns, sum(m.amount) AS total, bool_or(m.touch) AS w FROM o JOIN tc m ON m.account = o.account AND m.ts BETWEEN o.ts AND o.ts + {CFG.dormant_burst} WHERE o.nth > 1 AND o.nth <= {CFG.dormant_max_before + 1} AND o.gap >= {CFG.dormant_gap} GROUP BY ALL),
  k AS (SELECT c.*, acc.age, CASE WHEN w THEN {CFG.dormant_txns_watch} ELSE {CFG.dormant_txns} END AS required, row_number() OVER (PARTITION BY c.account ORDER BY nth) AS i FROM c JOIN acc ON acc.account = c.account WHERE age >= {CFG.dormant_age} AND burst_txns >= CASE WHEN w THEN {CFG.dormant_txns_watch} ELSE {CFG.dormant_txns} END AND total >= CASE WHEN w THEN {CFG.dormant_amount_watch} ELSE {CFG.dormant_amount} END)
  SELECT account, age, gap, a_txn, burst_txns, CAST(total AS DOUBLE) AS burst_amount, CAST(required AS BIGINT) AS required FROM k WHERE i = 1"""
ORACLES["round_clustering"] = f"""WITH {T}, rt AS (SELECT * FROM t WHERE amount > 0 AND amount % {CFG.round_multiple} = 0), legs AS (SELECT payer AS person, payee AS other, * FROM rt UNION ALL SELECT payee, payer, * FROM rt WHERE payer <> payee),
  w AS (SELECT a.person, a.ts AS a_ts, a.txn_id AS a_txn, count(*) AS n, count(DISTINCT m.other) AS counterparties, bool_or(m.touch) AS wt, string_agg(m.txn_id, ',' ORDER BY m.ts, m.txn_id) AS ids, string_agg(m.txn_id, ',' ORDER BY m.txn_id) AS same FROM legs a JOIN legs m ON m.person = a.person AND m.ts <= a.ts + {CFG.round_window} AND (m.ts > a.ts OR (m.ts = a.ts AND m.txn_id >= a.txn_id)) GROUP BY ALL),
  q AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, a_ts, a_txn) AS i FROM w WHERE n >= CASE WHEN wt THEN {CFG.round_cluster_watch} ELSE {CFG.round_cluster} END AND NOT (counterparties >= {CFG.payroll_counterparties} AND counterparties >= {CFG.payroll_ratio} * n)),
  d AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY person) AS j FROM q WHERE i = 1) SELECT person, a_txn, n, counterparties, ids FROM d WHERE j = 1"""
ORACLES["signal_first_large"] = f"WITH {T}, f AS (SELECT *, row_number() OVER (PARTITION BY least(payer, payee), greatest(payer, payee) ORDER BY ts, txn_id) AS i FROM t WHERE payer <> payee) SELECT payer AS person, txn_id, ts, channel FROM f WHERE i = 1 AND payer % 17 = 0 AND amount >= {CFG.signal_first_amount}"
ORACLES["signal_new_account"] = f"WITH {T} SELECT payer AS person, txn_id, ts, channel FROM t WHERE payer % 17 = 0 AND dst * 37 % 1000 <= {CFG.signal_new_days}"
ORACLES["signal_new_channel"] = f"WITH {T}, s AS (SELECT *, min(ts) OVER (PARTITION BY payer) AS b FROM t WHERE payer % 17 = 0) SELECT payer AS person, txn_id, ts, channel FROM s WHERE ts > b + {CFG.signal_baseline} AND NOT EXISTS (SELECT 1 FROM s o WHERE o.payer = s.payer AND o.channel = s.channel AND o.ts <= o.b + {CFG.signal_baseline})"
ORACLES["pass_through_candidates"] = f"WITH {T}, {pairs(CFG.pass_window, str(CFG.pass_low), str(CFG.pass_high))} SELECT dst AS account, txn_id AS i_txn, n_txn AS o_txn, n_ts - ts AS delay FROM link"
ORACLES["consortium_confirm"] = f"""WITH RECURSIVE {T}, t2 AS (SELECT * FROM t), {pairs(CFG.speed_link, "0.50", "1.50", "ll", "t2")}, link AS (SELECT * FROM ll), {CHAIN}, each AS (SELECT path, unnest(string_split(path, ',')) AS txn_id, generate_subscripts(string_split(path, ','), 1) AS pos FROM full_chain),
  legs AS (SELECT each.path, pos, t.*, lag(t.ts) OVER w AS b_ts, lag(t.dst) OVER w AS b_dst, lag(t.amount) OVER w AS b_amount FROM each JOIN t USING (txn_id) WINDOW w AS (PARTITION BY each.path ORDER BY pos))
  SELECT path FROM legs GROUP BY path HAVING bool_and(b_ts IS NULL OR (src = b_dst AND ts > b_ts AND amount >= {CFG.circle_low} * b_amount AND amount <= {CFG.circle_high} * b_amount)) AND max(ts) - min(ts) <= {CFG.circle_window}"""

# --- cases: every speed link is a finding and a case
CASES = f"""{LINK}, fi AS (SELECT txn_id || '>' || n_txn AS grp, txn_id AS t1, n_txn AS t2, ts AS first_ts, n_ts AS last_ts FROM link), core AS (SELECT DISTINCT txn_id || '>' || n_txn AS grp, unnest([payer, payee, n_payer, n_payee]) AS person FROM link),
ev AS (SELECT DISTINCT grp, t.* FROM (SELECT grp, t1 AS txn_id FROM fi UNION ALL SELECT grp, t2 FROM fi) JOIN t USING (txn_id))"""
NEAR = """pin AS (SELECT fi.grp, fi.first_ts, fi.last_ts, t.*, EXISTS (SELECT 1 FROM core c WHERE c.grp = fi.grp AND c.person = t.payer) AS pc, EXISTS (SELECT 1 FROM core c WHERE c.grp = fi.grp AND c.person = t.payee) AS qc FROM fi JOIN t ON t.ts BETWEEN fi.first_ts - {pad} AND fi.last_ts + {pad})"""
CTX = NEAR.format(pad=CFG.context_pad) + f""", ctx AS (SELECT grp, CASE WHEN qc AND NOT pc THEN 'IN' ELSE 'OUT' END AS direction, CASE WHEN qc AND NOT pc THEN payer ELSE payee END AS person, amount, ts, txn_id FROM pin WHERE (qc AND NOT pc AND ts BETWEEN first_ts - {CFG.context_pad} AND first_ts) OR (pc AND NOT qc AND ts BETWEEN last_ts AND last_ts + {CFG.context_pad})),
top AS (SELECT * FROM (SELECT grp, direction, person, sum(amount) AS amount, row_number() OVER (PARTITION BY grp, direction ORDER BY sum(amount) DESC, person) AS rank FROM ctx GROUP BY grp, direction, person) WHERE rank <= {CFG.context_top})"""
ORACLES["finding_merge_components"] = f"""WITH RECURSIVE {T}, {CASES}, n AS (SELECT grp AS f, 't' || t1 AS k FROM fi UNION SELECT grp, 't' || t2 FROM fi UNION SELECT grp, 'p' || person FROM core), e AS (SELECT DISTINCT a.f AS u, b.f AS v FROM n a JOIN n b USING (k)), reach(node, root) AS (SELECT grp, grp FROM fi UNION SELECT e.v, reach.root FROM reach JOIN e ON e.u = reach.node)
  SELECT node AS finding_id, min(root) AS "group" FROM reach GROUP BY node"""
ORACLES["case_supporting"] = f"WITH {T}, {CASES}, {NEAR.format(pad=CFG.support_pad)} SELECT grp AS \"group\", txn_id FROM pin WHERE pc AND qc AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.grp = pin.grp AND ev.txn_id = pin.txn_id)"
ORACLES["case_context_top3"] = f"WITH {T}, {CASES}, {CTX} SELECT grp AS \"group\", direction, person, CAST(amount AS DOUBLE) AS amount, rank FROM top"
_TIER = "CASE " + " ".join(f"WHEN amount >= {f} THEN {p}" for f, p in CFG.amount_tiers) + " ELSE 0 END"
ORACLES["case_priority"] = f"""WITH {T}, {CASES}, g AS (SELECT grp, sum(amount) AS amount, bool_or(src <> dst AND src_bank <> dst_bank) AS crosses FROM ev GROUP BY grp), s AS (SELECT g.*, (SELECT bool_or(person % 17 = 0) FROM core WHERE core.grp = g.grp) AS watched FROM g),
  z AS (SELECT *, CAST({CFG.points_per_detector} + {_TIER} + CAST(watched AS INT) + CAST(crosses AS INT) AS BIGINT) AS score FROM s) SELECT grp AS "group", CAST(amount AS DOUBLE) AS amount, watched, crosses, score, CASE WHEN score >= {CFG.high_score} THEN 'HIGH' WHEN score >= {CFG.medium_score} THEN 'MEDIUM' ELSE 'LOW' END AS level FROM z"""
ORACLES["case_links"] = f"""WITH {T}, {CASES}, {CTX}, h AS (SELECT top.grp AS a, direction, top.person, amount, min(core.grp) AS b FROM top JOIN core ON core.person = top.person AND core.grp <> top.grp GROUP BY ALL)
  SELECT a AS case_id, b AS other_case, person, direction, CAST(amount AS DOUBLE) AS amount FROM h UNION ALL SELECT b, a, person, CASE WHEN direction = 'IN' THEN 'OUT' ELSE 'IN' END, CAST(amount AS DOUBLE) FROM h"""
ORACLES["leads"] = f"WITH {T}, {CASES}, {CTX} SELECT person, count(DISTINCT grp) AS cases, count(DISTINCT txn_id) AS n_txns FROM ctx WHERE person NOT IN (SELECT person FROM core) GROUP BY person HAVING count(DISTINCT grp) >= 2"
ORACLES["main_suspect"] = f"""WITH {T}, {CASES}, d AS (SELECT grp, CASE WHEN substr(grp, 12, 1) < '4' THEN 1 WHEN substr(grp, 12, 1) < '7' THEN 2 ELSE 3 END AS k FROM fi),
  a AS (SELECT grp, payer AS p FROM (SELECT grp, payer, row_number() OVER (PARTITION BY grp ORDER BY count(DISTINCT payee) DESC, min((ts, txn_id))) AS i FROM ev GROUP BY grp, payer) WHERE i = 1), b AS (SELECT grp, payee AS p FROM (SELECT grp, payee, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, min((ts, txn_id))) AS i FROM ev GROUP BY grp, payee) WHERE i = 1),
  f AS (SELECT grp, arg_min(payer, (ts, txn_id)) AS p FROM ev GROUP BY grp) SELECT d.grp AS case_id, CASE k WHEN 1 THEN a.p WHEN 2 THEN b.p ELSE f.p END AS suspect FROM d JOIN a USING (grp) JOIN b USING (grp) JOIN f USING (grp)"""

# --- lens, history, scores
PEOPLE = f"{ACC}, ppl AS (SELECT DISTINCT person, CASE WHEN person % 4 <> 0 THEN '9' || CASE WHEN person % 50 = 1 THEN person - 1 ELSE person END END AS phone FROM acc), shared AS (SELECT phone FROM ppl WHERE phone IS NOT NULL GROUP BY phone HAVING count(*) > 1)"
FC = "fc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payer, payee ORDER BY ts, txn_id) AS i FROM t) WHERE i = 1)"
BASE = f"base AS (SELECT (SELECT avg(CASE WHEN age < {CFG.fresh_days} THEN 1 ELSE 0 END) FROM acc) AS fresh_rate, (SELECT avg(CASE WHEN n > 1 THEN 1 ELSE 0 END) FROM (SELECT person, count(*) AS n FROM acc GROUP BY person)) AS multi_rate, (SELECT count(*) FROM fc) / (SELECT count(*) FROM t) AS contact_rate, (SELECT count(*) FROM ppl WHERE phone IN (SELECT phone FROM shared)) / (SELECT count(*) FROM ppl) AS phone_rate)"
ORACLES["lens_baseline"] = f"WITH {T}, {PEOPLE}, {FC}, {BASE} SELECT * FROM base"
ORACLES["first_contact"] = f"WITH {T}, {FC} SELECT payer, payee, txn_id, ts FROM fc"
LENS = f"""ends AS (SELECT DISTINCT grp, account FROM (SELECT grp, src AS account FROM ev UNION ALL SELECT grp, dst FROM ev)), ea AS (SELECT grp, count(*) AS accounts, count(*) FILTER (age < {CFG.fresh_days}) AS fresh FROM ends JOIN acc USING (account) GROUP BY grp), held AS (SELECT grp, person, count(*) AS n FROM ends JOIN acc USING (account) GROUP BY ALL),
ep AS (SELECT grp, count(*) AS persons, count(*) FILTER (n > 1) AS multi, count(DISTINCT phone) FILTER (phone IN (SELECT phone FROM shared)) AS phones FROM held JOIN ppl USING (person) GROUP BY grp), et AS (SELECT grp, count(*) AS transfers, count(*) FILTER (src_bank <> 'BANK_A' AND dst_bank <> 'BANK_A') AS blind_a, count(*) FILTER (src_bank <> 'BANK_B' AND dst_bank <> 'BANK_B') AS blind_b, count(*) FILTER (txn_id IN (SELECT txn_id FROM fc)) AS contacts FROM ev GROUP BY grp),
sg AS (SELECT grp AS "group", transfers, accounts, fresh, persons, multi, contacts, phones, blind_a, blind_b, fresh >= {CFG.lens_min_count} AND fresh / accounts >= {CFG.fresh_multiple} * fresh_rate AS r1, multi >= {CFG.lens_min_count} AND multi / persons >= {CFG.control_multiple} * multi_rate AS r2,
 contacts >= {CFG.lens_min_count} AND contacts / transfers >= CAST({CFG.contact_multiple} AS DOUBLE) * contact_rate AS r3, phones > 0 AS r4, blind_a > 0 AND blind_b > 0 AS r5 FROM et JOIN ea USING (grp) JOIN ep USING (grp), base), sn AS (SELECT *, CAST(r1 AS BIGINT) + CAST(r2 AS BIGINT) + CAST(r3 AS BIGINT) + CAST(r4 AS BIGINT) + CAST(r5 AS BIGINT) AS n_signals FROM sg)"""
ORACLES["lens_signals"] = f"WITH {T}, {CASES}, {PEOPLE}, {FC}, {BASE}, {LENS} SELECT * FROM sn"
ORACLES["lens_summary"] = f"WITH {T}, {CASES}, {PEOPLE}, {FC}, {BASE}, {LENS} SELECT count(*) AS groups, avg(n_signals) AS mean_signals, avg(CASE WHEN n_signals >= 2 THEN 1 ELSE 0 END) AS two_or_more, " + ", ".join(f"avg(CAST({r} AS INT)) AS {r}_rate" for r in ("r1", "r2", "r3", "r4", "r5")) + " FROM sn"
ORACLES["account_history"] = f"""WITH {T}, tc AS (SELECT src AS account, dst AS other, true AS s, * FROM t UNION ALL SELECT dst, src, false, * FROM t), h AS (SELECT account, count(*) FILTER (s) AS n_out, count(*) FILTER (NOT s) AS n_in, CAST(coalesce(sum(amount) FILTER (s), 0) AS DOUBLE) AS total_out, CAST(coalesce(sum(amount) FILTER (NOT s), 0) AS DOUBLE) AS total_in, count(DISTINCT other) AS counterparties, min(ts) AS first_ts, max(ts) AS last_ts FROM tc GROUP BY account),
  f AS (SELECT account, min(d) AS fastest_s FROM (SELECT a.txn_id, a.dst AS account, min(b.ts) - a.ts AS d FROM t a JOIN t b ON b.src = a.dst AND b.ts >= a.ts AND b.amount >= 0.5 * a.amount GROUP BY a.txn_id, a.dst, a.ts) GROUP BY account) SELECT h.*, fastest_s FROM h LEFT JOIN f USING (account)"""
ORACLES["neighbourhood_top8"] = f"WITH {T}, b AS (SELECT payer AS person, payee AS other, amount FROM t WHERE payer <> payee UNION ALL SELECT payee, payer, amount FROM t WHERE payer <> payee), g AS (SELECT person, other, count(*) AS n, sum(amount) AS v, row_number() OVER (PARTITION BY person ORDER BY sum(amount) DESC, other) AS rank FROM b GROUP BY person, other) SELECT person, other, n, CAST(v AS DOUBLE) AS volume, rank FROM g WHERE rank <= 8"
ORACLES["bank_visibility"] = f"WITH {T}, {CASES}, s AS (SELECT grp, src_bank = 'BANK_A' OR dst_bank = 'BANK_A' AS a, src_bank = 'BANK_B' OR dst_bank = 'BANK_B' AS b FROM ev) SELECT grp AS \"group\", count(*) AS transfers, count(*) FILTER (a) AS seen_a, count(*) FILTER (b) AS seen_b, count(*) FILTER (a AND b) AS both FROM s GROUP BY grp"
ORACLES["median_account_age"] = f"WITH {T}, {ACC} SELECT CAST(median(age) AS DOUBLE) AS median_age_days FROM acc"
TRUTH = "truth AS (SELECT txn_id, 'RING' || CAST(txn_id AS BIGINT) % 5 AS ring_id FROM t WHERE CAST(txn_id AS BIGINT) % 3 = 0)"
#: Three rings in four hold few transfers each, so that findings can catch them.
TRUTH2 = "truth AS (SELECT txn_id, 'RING' || CAST(txn_id AS BIGINT) // 3 AS ring_id FROM t WHERE CAST(txn_id AS BIGINT) % 4 < 3)"
ORACLES["detector_score"] = f"WITH {T}, {CASES}, {TRUTH}, p AS (SELECT grp, 2 * count(ring_id) >= count(*) AS hit FROM ev LEFT JOIN truth USING (txn_id) GROUP BY grp) SELECT 'SPEED' AS detector, count(*) AS findings, count(*) FILTER (hit) AS true, count(*) FILTER (NOT hit) AS false FROM p"
ORACLES["ring_cover"] = f"WITH {T}, {CASES}, {TRUTH}, s AS (SELECT ring_id, count(*) AS size FROM truth GROUP BY ring_id), h AS (SELECT ring_id, max(n) AS n FROM (SELECT ring_id, grp, count(*) AS n FROM ev JOIN truth USING (txn_id) GROUP BY ALL) GROUP BY ring_id) SELECT ring_id, size, coalesce(n, 0) / size AS best_cover, 2 * coalesce(n, 0) >= size AS caught FROM s LEFT JOIN h USING (ring_id)"
ORACLES["case_score"] = f"WITH {T}, {CASES}, {TRUTH}, a AS (SELECT grp, count(*) AS n FROM ev GROUP BY grp), b AS (SELECT * FROM (SELECT grp, ring_id, count(*) AS k, count(*) OVER (PARTITION BY grp) AS rings, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, ring_id) AS i FROM ev JOIN truth USING (txn_id) GROUP BY grp, ring_id) WHERE i = 1) SELECT grp AS case_id, ring_id, coalesce(k, 0) / n AS purity, coalesce(rings, 0) AS rings FROM a LEFT JOIN b USING (grp)"
CAUGHT = "size AS (SELECT ring_id, count(*) AS size FROM truth GROUP BY ring_id), hit AS (SELECT grp, ring_id, count(*) AS n FROM ev JOIN truth USING (txn_id) GROUP BY ALL), caught AS (SELECT DISTINCT ring_id FROM hit JOIN size USING (ring_id) WHERE 2 * n >= size)"
ORACLES["ring_cases"] = f"WITH {T}, {CASES}, {TRUTH2}, {CAUGHT} SELECT ring_id, count(n) AS cases, coalesce(max(n), 0) / any_value(size) AS best_cover, ring_id IN (SELECT ring_id FROM caught) AS caught, ring_id IN (SELECT ring_id FROM caught) AND 2 * coalesce(max(n), 0) >= any_value(size) AS covered FROM size LEFT JOIN hit USING (ring_id) GROUP BY ring_id"
ORACLES["catching_detectors"] = f"WITH {T}, {CASES}, {TRUTH2}, {CAUGHT} SELECT ring_id, 'SPEED' AS detector FROM caught"
ORACLES["accused_precision"] = f"WITH {T}, {CASES}, {TRUTH}, mem AS (SELECT unnest([payer, payee]) AS person FROM t JOIN truth USING (txn_id)), j AS (SELECT person IN (SELECT person FROM mem) AS ok FROM core) SELECT count(*) AS accused, count(*) FILTER (ok) AS members, count(*) FILTER (ok) / count(*) AS precision FROM j"
ORACLES["items_allowed"] = f"""WITH {T}, {CASES}, {ACC}, {CTX}, {NEAR.format(pad=CFG.support_pad).replace('pin AS', 'pin2 AS')}, ids AS (SELECT grp, grp AS x FROM fi UNION SELECT grp, txn_id FROM ev UNION SELECT grp, CAST(src AS VARCHAR) FROM ev UNION SELECT grp, CAST(dst AS VARCHAR) FROM ev UNION SELECT grp, CAST(person AS VARCHAR) FROM core UNION SELECT grp, CAST(person AS VARCHAR) FROM top
  UNION SELECT grp, CAST(account AS VARCHAR) FROM (SELECT grp, person FROM core UNION SELECT grp, person FROM top) JOIN acc USING (person) UNION SELECT grp, txn_id FROM pin2 WHERE pc AND qc AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.grp = pin2.grp AND ev.txn_id = pin2.txn_id)
  UNION SELECT ctx.grp, ctx.txn_id FROM ctx JOIN top ON top.grp = ctx.grp AND top.direction = ctx.direction AND top.person = ctx.person UNION SELECT grp, 'SPEED' FROM fi) SELECT grp AS id, count(*) AS n, md5(string_agg(x, ',' ORDER BY x)) AS digest FROM ids GROUP BY grp"""

# --- evidence
_INR = "'Rs ' || CAST(floor(a) AS BIGINT) || CASE WHEN (a * 100) % 100 > 0 THEN '.' || lpad(CAST(CAST((a * 100) % 100 AS BIGINT) AS VARCHAR), 2, '0') ELSE '' END"
ORACLES["fact_check_counts"] = f"""WITH {T}, {CASES}, x AS (SELECT grp, t1, t2, CASE WHEN substr(t1, 12, 1) < '5' THEN '000000000000' ELSE t2 END AS o, substr(t2, 12, 1) < '5' AS claim, substr(t1, 12, 1) IN ('1', '4', '7') AS odd_amount, substr(t2, 12, 1) IN ('2', '5', '8') AS odd_day FROM fi),
  y AS (SELECT grp, CASE WHEN o = t1 THEN 1 ELSE 2 END AS ids, CASE WHEN o <> t1 AND o <> t2 THEN 1 ELSE 0 END AS bad_ids, 1 + CAST(odd_amount AS INT) AS amounts, CAST(odd_amount AS INT) AS bad_amounts, 1 + CAST(odd_day AS INT) AS days, CAST(odd_day AS INT) AS bad_days, CAST(claim AS INT) AS bad_claims FROM x)
  SELECT grp AS case_id, CAST(ids + amounts + days + 1 AS BIGINT) AS checked, CAST(ids + amounts + days + 1 - bad_ids - bad_amounts - bad_days - bad_claims AS BIGINT) AS passed, CAST(bad_ids + bad_amounts + bad_days + bad_claims AS BIGINT) AS failed FROM y"""
ORACLES["decision_guards"] = """WITH d AS (SELECT event_id AS n, ['CASE', 'WATCHLIST_REVIEW', 'LEAD'][CAST(event_id % 3 + 1 AS INT)] AS kind, ['FILE_STR', 'ESCALATE', 'MONITOR', 'CLOSE_RECOMMENDED', 'ESCALATE_AS_LEAD'][CAST((event_id // 3) % 5 + 1 AS INT)] AS decision, ['PASS', 'REJECT', 'NOT_VERIFIED'][CAST((event_id // 7) % 3 + 1 AS INT)] AS verdict FROM events)
  SELECT n AS item, concat_ws(', ', CASE WHEN NOT ((kind = 'CASE' AND decision IN ('FILE_STR', 'ESCALATE', 'MONITOR')) OR (kind = 'WATCHLIST_REVIEW' AND decision IN ('ESCALATE', 'MONITOR', 'CLOSE_RECOMMENDED')) OR (kind = 'LEAD' AND decision IN ('ESCALATE_AS_LEAD', 'MONITOR', 'CLOSE_RECOMMENDED'))) THEN 'decision not allowed' END,
  CASE WHEN n % 4 < 2 THEN 'too little evidence read' END, CASE WHEN kind = 'CASE' AND decision = 'FILE_STR' AND n % 5 = 0 THEN 'nothing written' END, CASE WHEN kind = 'CASE' AND decision = 'FILE_STR' AND n % 5 <> 0 AND verdict = 'REJECT' THEN 'rejected' END, CASE WHEN n % 6 = 0 THEN 'nothing cited' END,
  CASE WHEN n % 11 = 3 THEN 'amount not shown' END, CASE WHEN n % 13 = 4 AND NOT (kind = 'CASE' AND n % 2 = 0) THEN 'method not proved' END, CASE WHEN (n % 6 <> 0 AND n % 3 = 2) OR n % 17 = 5 THEN 'unknown citation' END) AS failures FROM d"""
ORACLES["latest_decision"] = "SELECT user_id AS case_id, event_type AS decision, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) DESC, event_id DESC) AS i FROM events) WHERE i = 1"
