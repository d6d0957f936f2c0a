"""Names: normalisation, business suffixes, sound codes, initials, order of tokens, similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffix phrases of trading names.
SUFFIXES = ["and sons", "pvt ltd", "sons", "traders", "enterprises", "co", "pvt", "ltd"]


def normalize_name(name: Column) -> Column:
    """Lower case; anything but letters, digits and white space becomes a space; runs of spaces become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def strip_suffix(normalized: Column) -> Column:
    """A normalised name without its trailing business suffixes, but never empty."""
    return F.regexp_replace(normalized, rf"^(.*?\S)((\s+({'|'.join(SUFFIXES)}))+)$", "$1")


def sound_code(word: Column) -> Column:
    """Four-character sound code. Unlike the common one, H and W separate equal codes, as vowels do. No letters: empty."""
    letters = F.upper(F.regexp_replace(word, "[^A-Za-z]", ""))
    coded = F.translate(letters, "BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000000")
    for digit in "123456":
        coded = F.regexp_replace(coded, f"{digit}+", digit)
    tail = F.regexp_replace(F.substring(coded, 2, 1 << 20), "[^1-6]", "")
    return F.when(F.length(letters) > 0, F.substring(F.concat(F.substring(letters, 1, 1), tail, F.lit("000")), 1, 4)).otherwise("")


def tokens(stripped: Column) -> Column:
    return F.filter(F.split(stripped, " "), lambda t: t != "")


def initials_match(a: Column, b: Column) -> Column:
    """Token arrays of one length where every pair is equal or one side is the other's first letter, at least once truly."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))

    def short(p: Column) -> Column:
        x, y = p["x"], p["y"]
        return (x != y) & (((F.length(x) == 1) & y.startswith(x)) | ((F.length(y) == 1) & x.startswith(y)))

    return (F.size(a) == F.size(b)) & F.forall(pairs, lambda p: (p["x"] == p["y"]) | short(p)) & F.exists(pairs, short)


def reversed_match(a: Column, b: Column) -> Column:
    return (F.size(a) >= 2) & (a != b) & (a == F.reverse(b))


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; it depends on the order of its arguments, so callers pass the smaller record id first."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
