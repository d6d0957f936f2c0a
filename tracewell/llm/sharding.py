"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id), so equal texts stand next to each other. A size-weighted sample of
keys gives quantile boundaries of many small ranges; exact totals of the ranges follow, overfull ranges are subdivided
by a new sample of their own keys, and the running size inside each range cuts the order into shards of equal bytes. The
copies of a text are a group and share a shard, unless they are so many that several boundaries fall inside the group:
then its rows are dealt one by one.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import store, text_key, utf8

#: Sampled keys to a range, rows to a range, and the most ranges: together they bound what the driver gathers.
PER_RANGE, ROWS_PER_RANGE, MOST_RANGES = 32, 50_000, 1 << 14
#: Ranges to a shard at least, and ranges from which on a group is cut: kept whole, it would make the shards uneven.
RANGES_PER_SHARD, CUT = 64, 4
#: Characters of the text hash that begin a sort key, and what sorts behind all keys of a group.
HASH, AFTER = 32, "~"


def _sort_key(text: Column, doc_id: Column, rid: Column) -> Column:
    """One string whose byte order is the order of (text hash, doc_id with null first, row number)."""
    shifted = F.lpad((doc_id.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(text, F.coalesce(shifted, F.lit("")), F.lit(":"), F.lpad(rid.cast("string"), 20, "0"))


def _at_groups(bounds: list[str]) -> tuple[list[str], frozenset[str]]:
    """Boundaries moved to where a group begins, and the groups that CUT or more of them fall into: these keep theirs and are cut."""
    often = Counter(b[:HASH] for b in bounds if len(b) > HASH)
    cut = frozenset(g for g, n in often.items() if n >= CUT)
    out = {b for b in bounds if b[:HASH] in cut} | {b[:HASH] for b in bounds} | {g + AFTER for g in cut}
    return sorted(out), cut


def _range_of(bounds: list[str]) -> Column:
    @F.pandas_udf(T.IntegerType())
    def place(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect.bisect_right(bounds, k)).astype("int32")

    return place(F.col("skey"))


def _is_cut(cut: frozenset[str]) -> Column:
    @F.pandas_udf(T.BooleanType())
    def inside(keys: pd.Series) -> pd.Series:
        return keys.str[:HASH].isin(cut)

    return inside(F.col("skey")) if cut else F.lit(False)


def _sample(rows: DataFrame, total: int, n: int, want: int) -> list[str]:
    """Keys drawn with a chance in proportion to size, half of it to the row count so that many tiny rows spread too. The draw hangs on the row alone."""
    chance = F.lit(float(want)) * (F.col("size") / F.lit(float(total)) + F.lit(1.0 / n)) / 2
    drawn = F.pmod(F.xxhash64("skey", F.lit(7)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return sorted(r[0] for r in rows.where(drawn < chance).select("skey").collect())


def _quantiles(keys: list[str], parts: int) -> list[str]:
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def _totals(rows: DataFrame) -> list:
    return sorted(rows.groupBy("range_no").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("most")).collect())


def shard_rows(docs: DataFrame, n_shards: int = 16, carry: list[str] | None = None) -> DataFrame:
    """Each row with `shard`, `slot` (gapless from 0 in its shard), `size` and `text_crc32`.

    Size: UTF-8 bytes of the text plus 1; a null text has none and counts as empty. Rows equal in text and doc_id are
    told apart by a row number stored once. A null doc_id comes first among equal texts. An empty table gives no rows. Equal
    texts share a shard, but for groups above about CUT / RANGES_PER_SHARD of a shard's bytes.
    carry names further columns to keep; where one clashes with a result column, the result's wins.
    """
    made = {"doc_id", "size", "text_crc32", "shard", "slot", "skey", "range_no", "unit", "ahead", "nth", "begin", "unit_size", "byte0", "row0", "row"}
    carried = [c for c in carry or [] if c not in made]
    rows = docs.select(
        "doc_id", *carried, (F.length(utf8(F.col("text"))) + 1).cast("long").alias("size"), F.crc32(utf8(F.col("text"))).alias("text_crc32"),
        _sort_key(text_key(F.col("text")), F.col("doc_id"), F.monotonically_increasing_id()).alias("skey"),
    )
    rows = store(rows, "shard-rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not n:
        return rows.drop("skey").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    parts = min(MOST_RANGES, max(RANGES_PER_SHARD * n_shards, math.ceil(n / ROWS_PER_RANGE)))
    bounds, cut = _at_groups(_quantiles(_sample(rows, total, n, PER_RANGE * parts), parts))
    ranged = rows.withColumn("range_no", _range_of(bounds))
    totals = _totals(ranged)
    while True:
        full = [t for t in totals if t.rows > 1 and (t.bytes - t.most > 8 * total / parts or t.rows > 8 * max(n / parts, 64))]
        inside = ranged.where(F.col("range_no").isin([t.range_no for t in full]))
        more = _quantiles(_sample(inside, sum(t.bytes for t in full), sum(t.rows for t in full), PER_RANGE * 8 * len(full)), 8 * len(full)) if full else []
        bigger, more_cut = _at_groups(sorted({*(b for b in bounds if len(b) > HASH + len(AFTER)), *more}))
        bigger = sorted({*bounds, *bigger})
        if not full or bigger == bounds:  # a range that a sample of its own keys does not divide further
            break
        bounds, cut = bigger, cut | more_cut
        ranged = rows.withColumn("range_no", _range_of(bounds))
        totals = _totals(ranged)
    before, at_byte, at_row = [], 0, 0
    for t in totals:
        before.append((t.range_no, at_byte, at_row))
        at_byte, at_row = at_byte + t.bytes, at_row + t.rows
    offsets = docs.sparkSession.createDataFrame(before, "range_no int, byte0 long, row0 long")
    ranged = ranged.withColumn("unit", F.when(_is_cut(cut), F.col("skey")).otherwise(F.substring("skey", 1, HASH)))
    order, own = Window.partitionBy("range_no").orderBy("skey"), Window.partitionBy("range_no", "unit")
    placed = ranged.withColumns({"ahead": F.sum("size").over(order) - F.col("size"), "nth": F.row_number().over(order)})
    placed = placed.withColumns({"begin": F.min("ahead").over(own), "unit_size": F.sum("size").over(own)})
    placed = placed.join(F.broadcast(offsets), "range_no")  # at most MOST_RANGES and their subdivisions
    middle = (2 * (F.col("byte0") + F.col("begin")) + F.col("unit_size")).cast("decimal(30,0)")  # of a group, or of a row of one that is cut
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(2 * total)).cast("int"))
    placed = store(placed.select("doc_id", *carried, "size", "text_crc32", shard.alias("shard"), (F.col("row0") + F.col("nth") - 1).alias("row")), "shards")
    first = placed.groupBy("shard").agg(F.min("row").alias("row0"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", *carried, "size", "text_crc32", "shard", (F.col("row") - F.col("row0")).alias("slot"))  # a row to a shard


def write_shards(docs: DataFrame, path: str, n_shards: int = 16) -> None:
    """Write the documents as Parquet folders shard=0 .. shard=n-1, rows with their slot."""
    placed = shard_rows(docs, n_shards, docs.columns)
    placed.repartitionByRange(4 * n_shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """The `bytes` law over all documents in 16 shards. Odd rows as in shard_rows."""
    from tracewell.llm.common import table

    rows = shard_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
