"""Pseudonyms for the shared view."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(basis: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(basis, F.lit(salt)).cast("binary"), 256), 1, 16)


def pseudonym(person: Column, pan: Column, bank: Column, salt: str) -> Column:
    """The same for every bank that knows the person's PAN; without a PAN each bank has its own."""
    basis = F.coalesce(pan, F.concat(bank, F.lit(":"), person.cast("string")))
    return F.concat(F.lit("PSU_"), _digest(basis, salt))


def evidence_ref(txn_id: Column, salt: str) -> Column:
    return _digest(txn_id.cast("string"), salt)
