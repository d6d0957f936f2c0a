"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has the exponential key -ln(u) / weight, u drawn from its own content. Within a source the documents
are taken in the order of their keys up to the source's budget of words; whole epochs come before that fraction.
The order is never sorted as a whole: words summed over bands of keys find the band in which the budget ends, that band is
cut into finer ones, and only a last band of few documents is sorted. What remains is one threshold to a source, applied
to the documents where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import DOCUMENT_COLUMNS, store, table, text_key, word_count

#: A key is a number of 2 ** -SCALE steps; its first band is what is left after FIRST bits, each finer one takes FINER bits more.
SCALE, FIRST, FINER = 40, 37, 12
#: The documents of a source that are sorted in one task.
MOST_SORTED = 100_000
#: Thresholds are broadcast up to this many sources; with more, Spark joins them by shuffle.
MOST_BROADCAST_SOURCES = 20_000
SYMBOLS = "#*$%&|<>!"


def quality_weight(text: Column) -> Column:
    """A weight from 0.1 to 1: the share of characters that are not symbols, to the fourth power. Null and empty texts weigh 1."""
    kept = F.length(F.translate(text, SYMBOLS, "")) / F.greatest(F.length(text), F.lit(1))
    power = F.element_at(F.transform(F.array(kept), lambda x: x * x * x * x), 1)  # the lambda binds kept, so the text is read once
    return F.greatest(F.lit(0.1), F.coalesce(F.when(F.length(text) > 0, power), F.lit(1.0)))


def _keys(docs: DataFrame, seed: int, weight: Column | None) -> tuple[Column, Column]:
    """(words, exponential key) of each document."""
    basis = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_key(F.col("text")))
    u = (F.conv(F.substring(F.md5(basis), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    key = -F.ln(u) / (quality_weight(F.col("text")) if weight is None else weight)
    return word_count(F.col("text")), key


def _band(shift: int) -> Column:
    return F.shiftright(F.floor(F.col("m_key") * float(1 << SCALE)).cast("long"), shift)


def targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """source, source_size, target. Sources in code point order, null last, weigh `weights` in turn and split share x all words.

    A target stops at cap x its source's size and the excess goes to the others by weight. The level that does this is
    the largest (words left for the uncapped) / (their weight) over the sources in order of cap / weight.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumns({"capped": F.sum("cap").over(by_ratio) - F.col("cap"), "open": F.sum("w").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.sum("w").over(by_ratio) + F.col("w")})
    level = F.max((F.lit(share) * F.col("all_size") - F.col("capped")) / F.col("open")).over(Window.partitionBy(F.lit(1)))
    s = s.withColumn("all_size", F.sum("source_size").over(Window.partitionBy(F.lit(1)))).withColumn("level", level)
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def thresholds(keyed: DataFrame, weights: list[int], share: float, cap: float, most_sorted: int = MOST_SORTED) -> DataFrame:
    """Of stored source, m_size, m_key a row to a source: source, source_size, target, epochs, and the key at which its fraction ends (m_end, null: no fraction) with m_rest of m_tied words taken there."""
    bands = store(keyed.groupBy("source", _band(FIRST).alias("m_band")).agg(F.sum("m_size").alias("words"), F.count("*").alias("docs")), "mix-bands")
    goal = targets(bands.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("need", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goal = store(goal, "mix-targets")
    few = goal.count() <= MOST_BROADCAST_SOURCES
    small = F.broadcast if few else (lambda x: x)

    def ending(parts: DataFrame) -> DataFrame:
        """The band of each source in which its budget ends; `base` words lie before all of its bands here."""
        run = F.sum("words").over(Window.partitionBy("source").orderBy("m_band")) - F.col("words")
        parts = parts.withColumn("ahead", F.col("base") + run).where((F.col("ahead") < F.col("need")) & (F.col("need") <= F.col("ahead") + F.col("words")))
        return store(parts.select(F.col("source").alias("g_source"), F.col("m_band").alias("g_band"), "ahead", "need", "docs"), "mix-ends")

    g = goal.select(F.col("source").alias("g_source"), "need")
    ends = ending(bands.join(small(g), F.col("source").eqNullSafe(F.col("g_source"))).withColumn("base", F.lit(0).cast("long")))
    shift = FIRST
    while shift and not ends.where(F.col("docs") > most_sorted).isEmpty():
        inside = keyed.join(small(ends), F.col("source").eqNullSafe(F.col("g_source")) & (_band(shift) == F.col("g_band")))
        shift = max(0, shift - FINER)
        finer = inside.groupBy("source", _band(shift).alias("m_band")).agg(F.sum("m_size").alias("words"), F.count("*").alias("docs"), F.first("ahead").alias("base"), F.first("need").alias("need"))
        ends = ending(finer)
    in_band = keyed.join(small(ends), F.col("source").eqNullSafe(F.col("g_source")) & (_band(shift) == F.col("g_band")))
    tied = in_band.groupBy("g_source", "m_key").agg(F.sum("m_size").alias("m_tied"), F.first("ahead").alias("ahead"), F.first("need").alias("need"))
    run = F.sum("m_tied").over(Window.partitionBy("g_source").orderBy("m_key"))
    tied = tied.withColumn("before", F.col("ahead") + run - F.col("m_tied")).where((F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("m_tied")))
    tied = tied.select("g_source", F.col("m_key").alias("m_end"), (F.col("need") - F.col("before")).alias("m_rest"), "m_tied")
    out = goal.join(small(tied), F.col("source").eqNullSafe(F.col("g_source")), "left")
    return store(out.select(F.col("source").alias("t_source"), "source_size", "target", "epochs", "m_end", "m_rest", "m_tied"), "mix-thresholds")


def _taken(cut_last: bool) -> Column:
    at_end = F.floor(F.col("m_rest") * F.col("m_size") / F.col("m_tied")) if cut_last else F.when(2 * F.col("m_rest") >= F.col("m_tied"), F.col("m_size")).otherwise(0)
    part = F.when(F.col("m_key") < F.col("m_end"), F.col("m_size")).when(F.col("m_key") == F.col("m_end"), at_end).otherwise(0)
    return (F.col("epochs") * F.col("m_size") + F.coalesce(part, F.lit(0))).cast("long")


def mix(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11, weight: Column | None = None, cut_last: bool = True) -> DataFrame:
    """docs with size, source_size, target and taken (words of the document that the mix takes, repeats counted).

    A document is taken once in each whole epoch and once more if its key comes before the end of its source's
    fraction. At the end itself cut_last takes only the words that are still due (tied rows share them), without it the
    document is taken if that comes nearer to the target. Null texts have size 0, a null source is a source of its own,
    equal rows have equal keys and the same result, an empty table gives no rows. Of further columns only those named
    like a result column are replaced. Nothing but the threshold table moves; reruns agree.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    size, key = _keys(docs, seed, weight)
    slim = store(docs.select("source", size.alias("m_size"), key.alias("m_key")), "mix-keys")
    ends = thresholds(slim, list(weights), share, cap)
    return _apply(docs.select(F.struct(*names).alias("row"), "source", size.alias("m_size"), key.alias("m_key")), ends, cut_last)


def _apply(keyed: DataFrame, ends: DataFrame, cut_last: bool) -> DataFrame:
    if ends.count() <= MOST_BROADCAST_SOURCES:
        ends = F.broadcast(ends)
    joined = keyed.join(ends, keyed["source"].eqNullSafe(ends["t_source"]))
    return joined.select("row.*", F.col("m_size").alias("size"), "source_size", "target", _taken(cut_last).alias("taken"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with their part in a mix of 150 % of all words. Odd rows as in mix."""
    docs = table(spark, sf_dir, "documents")
    size, key = _keys(docs, 11, None)
    keyed = store(docs.select(F.struct("doc_id", "source").alias("row"), "source", size.alias("m_size"), key.alias("m_key")), "mix-keys")
    ends = thresholds(keyed, [3, 1, 2], 1.5, 2.0)
    return _apply(keyed, ends, True)


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every copy of a document that the mix takes whole, as rows of documents.

    Texts without a word cost nothing and stay once. Equal rows have one fate, a null source is one of its own, no rows give
    none; further columns of docs go.
    """
    mixed = mix(docs, cut_last=False)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    return mixed.select(*DOCUMENT_COLUMNS, F.explode(F.array_repeat(F.lit(1), times))).select(*DOCUMENT_COLUMNS)


#: The whole mix in DuckDB: keys, targets, and the words up to each source's budget by one running sum.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN length(text) > 0 THEN length(translate(text, '#*$%&|<>!', ''))::DOUBLE / length(text) ELSE 1.0 END AS clean,
    (('0x' || substr(md5(concat_ws(':', '11', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
keyed AS (SELECT doc_id, source, size, -ln(u) / greatest(0.1::DOUBLE, clean * clean * clean * clean) AS k FROM docs),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS all_size,
    [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sources),
opened AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed),
levels AS (SELECT *, max((1.5::DOUBLE * all_size - capped) / open) OVER () AS level FROM opened),
goals AS (
  SELECT source, source_size, least(cap, level * w) AS target, CASE WHEN source_size > 0 THEN floor(least(cap, level * w) / source_size)::BIGINT ELSE 0 END AS epochs
  FROM levels),
keys AS (SELECT source, k, sum(size) AS tied FROM keyed GROUP BY source, k),
placed AS (SELECT source, k, tied, sum(tied) OVER (PARTITION BY source ORDER BY k) - tied AS before FROM keys),
ends AS (
  SELECT g.source, p.k, p.tied, round(g.target - g.epochs * g.source_size)::BIGINT - p.before AS rest
  FROM goals g JOIN placed p ON g.source IS NOT DISTINCT FROM p.source
  WHERE p.before < round(g.target - g.epochs * g.source_size) AND round(g.target - g.epochs * g.source_size) <= p.before + p.tied)
SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
  (g.epochs * d.size + CASE WHEN d.k < e.k THEN d.size WHEN d.k = e.k THEN floor(e.rest * d.size / e.tied) ELSE 0 END)::BIGINT AS taken
FROM keyed d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN ends e ON d.source IS NOT DISTINCT FROM e.source
"""
