"""Declared schemas of the domain files; types are never inferred."""

from __future__ import annotations

TRANSACTIONS = "txn_id string, timestamp timestamp_ntz, from_account string, to_account string, amount decimal(18,2), channel string, from_bank string, to_bank string"
ACCOUNTS = "account_id string, name string, account_type string, bank string, opened_days_ago int, kyc_level string, owner_entity string"
CUSTOMER_RECORDS = "record_id string, source_system string, name_as_written string, phone string, pan string, address string, linked_account string, true_entity_id string"
GROUND_TRUTH = "txn_id string, ring_id string, ring_type string"
RESOLVED_ENTITIES = "entity_key string, canonical_name string, phone string, pan string, address string, num_records int, num_accounts int, account_ids string, record_ids string, has_unverified_link string, is_watchlisted string, rules_used string"
ACCOUNT_OWNERS = "account_id string, entity_key string, is_watchlisted string, has_unverified_link string"
#: Columns that only scoring may read.
ANSWER_KEY = {"owner_entity", "true_entity_id"}
