"""DuckDB SQL for the queries over files, the investigator's desk and the reports, from their definitions."""

from __future__ import annotations

from tracewell.config import SCALED as CFG
from tracewell.plans.oracles import _GROUPED, _NODES, _STATS, ACC, BAND, CASES, LINK, ORACLES, _edges, R, T, pairs

# --- domain files
_PEOPLE = f"""{ACC}, pe AS (SELECT CAST(person AS VARCHAR) AS entity_key, 'P' || CAST(person AS VARCHAR) AS canonical_name, CASE WHEN person % 5 <> 0 THEN 'PAN' || lpad(CAST(person AS VARCHAR), 7, '0') END AS pan,
  string_agg(CAST(account AS VARCHAR), ',' ORDER BY account) AS account_ids, person % 3 = 0 AS has_unverified_link, person % 17 = 0 AS is_watchlisted FROM acc GROUP BY person)"""
ORACLES["scan_transactions"] = f"WITH {T} SELECT txn_id, ts, CAST(src AS VARCHAR) AS from_account, CAST(dst AS VARCHAR) AS to_account, CAST(amount AS DOUBLE) AS amount, channel, src_bank AS from_bank, dst_bank AS to_bank FROM t"
ORACLES["scan_transactions_by_id"] = f"WITH {T}, {LINK} SELECT txn_id, ts, CAST(amount AS DOUBLE) AS amount FROM t WHERE txn_id IN (SELECT txn_id FROM link UNION SELECT n_txn FROM link)"
ORACLES["scan_accounts"] = f"WITH {T}, {ACC} SELECT CAST(account AS VARCHAR) AS account_id, CASE WHEN person % 9 <> 0 THEN 'Holder ' || CAST(person AS VARCHAR) END AS name, CASE WHEN person % 4 = 0 THEN 'BUSINESS' ELSE 'PERSONAL' END AS account_type, bank FROM acc"
ORACLES["scan_account_ages"] = f"WITH {T}, {ACC} SELECT CAST(account AS VARCHAR) AS account_id, age AS opened_days_ago FROM acc"
ORACLES["scan_customer_records"] = f"""WITH {R} SELECT record_id, CASE WHEN n % 31 = 0 THEN 'WATCHLIST' WHEN n % 2 = 0 THEN 'RETAIL_CBS' ELSE 'CORPORATE_BANKING' END AS source_system, name_as_written, phone, pan, address, linked_account, stripped FROM (SELECT *, CAST(substr(record_id, 4) AS BIGINT) AS n FROM r)"""
ORACLES["scan_true_people"] = f"WITH {R} SELECT record_id, 'E' || CAST(CAST(substr(record_id, 4) AS BIGINT) // 3 AS VARCHAR) AS true_entity_id FROM r"
ORACLES["scan_ground_truth"] = f"WITH {T} SELECT 'RING' || CAST(CAST(txn_id AS BIGINT) % 5 AS VARCHAR) AS ring_id, 'CIRCULAR' AS ring_type, count(*) AS n, string_agg(txn_id, ',' ORDER BY txn_id) AS txn_ids FROM t WHERE CAST(txn_id AS BIGINT) % 3 = 0 GROUP BY 1"
ORACLES["scan_entities"] = f"WITH {T}, {_PEOPLE} SELECT entity_key, canonical_name, CAST(NULL AS VARCHAR) AS phone, pan, CAST(NULL AS VARCHAR) AS address, account_ids, CAST(0 AS BIGINT) AS n_records, has_unverified_link, is_watchlisted FROM pe"
ORACLES["scan_account_owners"] = f"WITH {T}, {ACC} SELECT CAST(account AS VARCHAR) AS account_id, CAST(person AS VARCHAR) AS entity_key, person % 17 = 0 AS is_watchlisted, person % 3 = 0 AS has_unverified_link FROM acc"
ORACLES["prepared_transfers"] = f"WITH {T} SELECT txn_id, ts, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, CAST(amount AS DOUBLE) AS amount, channel, src_bank, dst_bank, CAST(payer AS VARCHAR) AS payer, CAST(payee AS VARCHAR) AS payee FROM t"
ORACLES["written_entities"] = f"WITH {T}, {_PEOPLE} SELECT entity_key, pan, account_ids, is_watchlisted FROM pe"
ORACLES["written_views"] = _edges("BANK_A")
ORACLES["written_findings"] = f"WITH {T}, {LINK} SELECT txn_id || '>' || n_txn AS finding_id, 'SPEED' AS detector, txn_id || ',' || n_txn AS txn_ids, array_to_string(list_sort(list_distinct([payer, payee, n_payer, n_payee])), ',') AS people FROM link"
ORACLES["appended_cases"] = f"WITH {T} SELECT txn_id AS case_id, CAST(CASE WHEN CAST(txn_id AS BIGINT) % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS run FROM t"
ORACLES["resumed_stages"] = f"WITH {T}, n AS (SELECT channel, count(*) AS n FROM t GROUP BY channel) SELECT 'detections' AS stage, channel, n, CAST(1 AS BIGINT) AS run FROM n UNION ALL SELECT 'cases', channel, n, 2 FROM n"

# --- functions and small operators
_O = "o AS (SELECT o_orderkey, CAST(floor(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * (o_orderkey % 500) AS DECIMAL(20,2))) AS BIGINT) AS whole FROM orders)"
ORACLES["western_amounts"] = f"WITH {_O} SELECT o_orderkey, 'Rs ' || format('{{:,}}', whole) AS label FROM o"
ORACLES["money_spans"] = f"WITH {_O} SELECT o_orderkey, 'Rs ' || {_GROUPED} || ',' || '|INR 4500|1.5 crore' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '|₹12,000,' END AS spans FROM o"
ORACLES["narrative_text"] = "SELECT doc_id, lang || ' ' || CASE WHEN doc_id % 3 > 0 THEN coalesce(source, '') ELSE '' END || ' end' AS said, CASE WHEN doc_id % 3 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM documents"
_u, _v, _ = _NODES["CONSORTIUM"]
ORACLES["bucketed_transfers"] = f"WITH {T} SELECT txn_id, {_u} AS u, {_v} AS v, CAST({BAND} AS BIGINT) AS band, ts // 3600 * 3600 AS hour FROM t"
ORACLES["bank_sequence"] = "SELECT s.size, p.place, 'BANK_' || substr('AABBAB', CAST(p.place % 6 + 1 AS INT), 1) AS bank FROM range(3, 9) s(size) JOIN range(0, 8) p(place) ON p.place < s.size"
ORACLES["one_person_per_account"] = f"WITH {T}, {ACC} SELECT 'ENT_' || CAST(account AS VARCHAR) AS entity_key, CASE WHEN person % 9 <> 0 THEN 'Holder ' || CAST(person AS VARCHAR) END AS canonical_name, CAST(account AS VARCHAR) AS account_ids FROM acc"
ORACLES["mixed_clusters"] = f"WITH {R} SELECT phone AS root, count(DISTINCT CAST(substr(record_id, 4) AS BIGINT) // 2) AS people FROM r WHERE phone IS NOT NULL GROUP BY phone HAVING people > 1"
ORACLES["cluster_vetoes"] = f"""WITH {R}, k AS (SELECT *, CAST(substr(record_id, 4) AS BIGINT) AS n FROM r), merged AS (SELECT x.record_id AS a, y.record_id AS b FROM k x JOIN k y ON y.n = x.n + 1 WHERE x.n % 2 = 1 AND NOT coalesce(x.pan <> y.pan, false)
  AND NOT (coalesce(x.phone <> y.phone, false) AND coalesce(x.address <> y.address, false) AND NOT coalesce(x.linked_account = y.linked_account, false) AND NOT coalesce(x.pan = y.pan, false))) SELECT a AS record_id, a AS root FROM merged UNION ALL SELECT b, a FROM merged"""
ORACLES["strong_components"] = "SELECT * FROM (VALUES ('A0', CAST(4 AS BIGINT)), ('B0', 7), ('D0', 1)) v(root, size)"
_SEEN = pairs(CFG.speed_link, str(CFG.speed_low), str(CFG.speed_high), "la", "ta")
_HERO = "SELECT txn_id FROM t WHERE CAST(txn_id AS BIGINT) % 3 = 0 AND CAST(txn_id AS BIGINT) % 5 = 1"
ORACLES["ring_coverage"] = f"""WITH {T}, ta AS (SELECT * FROM t WHERE src_bank = 'BANK_A' OR dst_bank = 'BANK_A'), {LINK}, {_SEEN}, hero AS ({_HERO}), f AS (SELECT 'ALL' AS view, txn_id, n_txn FROM link UNION ALL SELECT 'BANK_A', txn_id, n_txn FROM la),
  n AS (SELECT view, max(CAST(txn_id IN (SELECT txn_id FROM hero) AS BIGINT) + CAST(n_txn IN (SELECT txn_id FROM hero) AS BIGINT)) AS best FROM f GROUP BY view) SELECT view, best, (SELECT count(*) FROM hero) AS "all", best = (SELECT count(*) FROM hero) AS whole FROM n"""

# --- the investigator's desk
_QUEUE = f"{T}, q AS (SELECT 'I' || txn_id AS id, ['CASE', 'WATCHLIST_REVIEW', 'LEAD'][CAST(txn_id AS BIGINT) % 3 + 1] AS kind, CAST(txn_id AS BIGINT) AS n FROM t WHERE CAST(txn_id AS BIGINT) % 20 = 0)"
_DECIDED = f"""{_QUEUE}, log AS (SELECT id, kind, n % 60 >= 40 AS fallback, CASE WHEN n % 60 < 40 THEN CASE WHEN kind = 'CASE' THEN 'FILE_STR' ELSE 'CLOSE_RECOMMENDED' END WHEN kind = 'CASE' THEN 'ESCALATE' ELSE 'MONITOR' END AS decision,
  CASE WHEN n % 60 < 40 THEN 'read' ELSE 'steps ran out, a person decides' END AS reason FROM q)"""
ORACLES["looked_up_transfers"] = f"WITH {T} SELECT txn_id, ts, src, dst, payer, payee, channel FROM t WHERE CAST(txn_id AS BIGINT) % 7 = 0"
_WORDS = "'Rs ' || CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_VOLUME, _MOST = _WORDS.format("amount"), _WORDS.format("most")
ORACLES["opened_items"] = f"""WITH {T}, {CASES}, g AS (SELECT grp AS id, sum(amount)::DECIMAL(20,2) AS amount, max(amount)::DECIMAL(20,2) AS most, ((max(ts) - min(ts)) * 100 + 1800) // 3600 / 100 AS hours FROM ev GROUP BY grp), p AS (SELECT grp AS id, count(*) AS n_people FROM core GROUP BY grp)
  SELECT id, n_people, CAST(2 AS BIGINT) AS n_transfers, split_part(id, '>', 1) AS sample_ids, {_VOLUME} AS volume, CASE WHEN substr(id, 12, 1) < '5' THEN {_MOST} END AS principal, CAST(hours AS DOUBLE) AS hours, CASE WHEN substr(id, 12, 1) < '5' THEN 'CIRCLE' ELSE 'SPEED' END AS detectors FROM g JOIN p USING (id)"""
ORACLES["triaged_items"] = f"""WITH {_QUEUE} SELECT id, kind, row_number() OVER (ORDER BY CASE WHEN n % 40 = 0 THEN 1000000 - n END NULLS LAST, id) AS rank, CASE WHEN n % 40 = 0 THEN 'picked' ELSE 'not in the triage order' END AS reason FROM q"""
ORACLES["investigation_log"] = f"WITH {_DECIDED} SELECT id, kind, decision, reason, fallback FROM log"
ORACLES["investigation_meta"] = f"WITH {_DECIDED} SELECT kind, decision, count(*) AS items, CAST(count(*) FILTER (fallback) AS BIGINT) AS fallbacks FROM log GROUP BY kind, decision"

# --- reports
ORACLES["view_shares"] = f"WITH {T}, s AS ({' UNION ALL '.join(_STATS)}) SELECT view, CAST(CAST(round_even(edges * 100.0 / (SELECT edges FROM s WHERE view = 'ALL'), 0) AS BIGINT) AS VARCHAR) || '%' AS share FROM s"
ORACLES["detector_counts"] = f"WITH {T}, {LINK} SELECT 'SPEED' AS detector, count(*) AS n, CAST(sum(amount + n_amount) AS DOUBLE) AS total FROM link"
ORACLES["worked_examples"] = f"""WITH {R}, g AS (SELECT phone AS entity_key, count(*) AS n_records, count(DISTINCT CASE WHEN CAST(substr(record_id, 4) AS BIGINT) % 31 = 0 THEN 'WATCHLIST' WHEN CAST(substr(record_id, 4) AS BIGINT) % 2 = 0 THEN 'RETAIL_CBS' ELSE 'CORPORATE_BANKING' END) AS n_rules FROM r WHERE phone IS NOT NULL GROUP BY phone)
  SELECT entity_key, n_records, n_rules FROM g WHERE n_records >= 2 ORDER BY n_records DESC, n_rules DESC, entity_key LIMIT 3"""
