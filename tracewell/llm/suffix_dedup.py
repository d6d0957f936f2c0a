"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where a 16-word gram is the minimum of some 35 successive ones, so any passage of 50 words holds
a kept suffix wherever it occurs. Grams of one text alone drop out. The other suffixes, each with the words around
it, are sorted by content over the cluster; equal beginnings stand side by side whatever their number, since ties
are broken by text and place. All windows of 50 words around the suffixes that share a gram are compared by their
64-bit hashes, so no partner is left out. A group of up to MOST_ROWS suffixes lies in one task whole; a larger one is dealt
by what follows the suffix, and its different windows are met in an aggregation, which no large group slows. Matching
windows are merged to passages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import WordHashes, flat_words, over_batches, slices, store, table, text_key, utf8, word_count

LEAST, GRAM, SPAN = 50, 16, 35  # SPAN = LEAST - GRAM + 1
#: Words that a kept suffix carries to its left and right, and the sorted suffixes that are compared at a time.
LEFT, RIGHT, MOST_ROWS = LEAST - GRAM, LEAST, 8192


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def kept_suffixes(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, gram hash) of the kept suffixes among the word hashes of several texts.

    Of equal minima the first counts; where all SPAN grams are equal, every SPAN-th of their run.
    """
    n = len(h)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g, size = h, 1
    while size < GRAM:
        g, size = _mix(g[: len(g) - size], g[size:]), size * 2
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    never = np.uint64(0xFFFFFFFFFFFFFFFF)
    rank = g.copy()
    rank[doc[: len(g)] != doc[GRAM - 1 :]] = never
    if len(rank) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    length = np.diff(np.r_[first, len(g)])
    since = np.arange(len(g)) - np.repeat(first, length)
    alike = np.repeat(length, length) - since >= SPAN  # only equal grams from here on
    low, size = rank, 1
    while size < SPAN:  # minimum of SPAN successive ranks, by overlapping halves
        step = min(size, SPAN - size)
        low, size = np.minimum(low[: len(low) - step], low[step:]), size + step
    inside = doc[: len(low)] == doc[np.minimum(np.arange(len(low)) + LEAST - 1, n - 1)]
    ahead = low.copy()
    picked = []
    w = np.flatnonzero(inside & (ahead != never))
    for a in range(0, len(w), 1 << 16):
        part = w[a : a + (1 << 16)]
        step = np.argmax(rank[part[:, None] + np.arange(SPAN)] == ahead[part][:, None], axis=1)
        picked.append(part + np.where(alike[part], -since[part] % SPAN, step))
    at = np.unique(np.concatenate(picked)) if picked else np.zeros(0, np.int64)
    return at, g[at]


def _anchors(hashes: WordHashes):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, h, starts = flat_words(batch.column(1).to_pylist(), hashes)
        at, g = kept_suffixes(h, starts)
        doc = np.searchsorted(starts, at, "right") - 1
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), batch.column(0).take(pa.array(doc)), pa.array((at - starts[doc]).astype(np.int32))], ["h", "tid", "pos"])

    return run


def _contexts(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    rows = []
    for tid, text, marks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
        words = text.split()
        for m in marks:
            p = m["pos"]
            rows.append((m["h"], b" ".join([*words[p : p + RIGHT], b""]), tid, p, b" ".join(words[max(0, p - LEFT) : p]), m["large"]))
    if not rows:
        return None
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "words", "tid", "pos", "before", "large"])


_MATCH = [("tid", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("other", pa.binary())]
_FOUND = pa.schema([*_MATCH, ("h", pa.int64()), ("w", pa.int64())])


def window_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of every LEAST successive words."""
    g, size = {1: h}, 1
    while size < 32:
        g[size * 2] = _mix(g[size][: len(h) - 2 * size + 1], g[size][size:])
        size *= 2
    n = max(0, len(h) - LEAST + 1)
    return _mix(_mix(g[32][:n], g[16][32 : 32 + n]), g[2][48 : 48 + n])


def _compared(rows: list[tuple], hashes: WordHashes, first_open: bool, last_open: bool):
    """Compare every window of LEAST words around sorted suffixes with all others of its group.

    Yields matches (tid, start, end, other). Where the first or the last group has rows elsewhere (it is open), a window's
    partners there begin like the row at that edge, for equal beginnings are neighbours. Such windows are also yielded with
    h and w: the least and greatest text that have it here as tid and other, and where only one text has it, a row for each
    of its places (else start is -1).
    """
    gram = np.array([r[0] for r in rows], np.int64)
    known = sorted({r[2] for r in rows})
    number = {t: i for i, t in enumerate(known)}
    texts, names = np.array([number[r[2]] for r in rows], np.int64), pa.array(known, pa.binary())
    begin = np.array([max(0, r[3] - LEFT) for r in rows], np.int64)
    _, h, starts = flat_words([r[4] + b" " + r[1] for r in rows], hashes)
    if len(h) < LEAST:
        return
    w = window_hashes(h)
    row = np.repeat(np.arange(len(rows)), np.diff(starts))
    at = np.flatnonzero(row[: len(w)] == row[LEAST - 1 :])
    w, row = w[at], row[at]
    place = begin[row] + at - starts[row]
    if not len(w):
        return
    order = np.lexsort((w, gram[row]))
    so, sg = w[order], gram[row][order]
    cut = np.flatnonzero(np.r_[True, (so[1:] != so[:-1]) | (sg[1:] != sg[:-1])])
    of = texts[row][order]
    low, high = np.minimum.reduceat(of, cut), np.maximum.reduceat(of, cut)
    back = np.empty(len(order), np.int64)
    back[order] = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(order)]))
    a, b, own = low[back], high[back], texts[row]
    hit = np.flatnonzero(a != b)
    if len(hit):
        edge = np.flatnonzero(np.r_[True, (row[hit][1:] != row[hit][:-1]) | (place[hit][1:] != place[hit][:-1] + 1)])
        last = np.r_[edge[1:], len(hit)] - 1
        other = np.minimum.reduceat(np.where(a == own, b, a)[hit], edge)
        cols = [names.take(pa.array(own[hit][edge])), pa.array(place[hit][edge], pa.int32()), pa.array(place[hit][last] + LEAST, pa.int32()), names.take(pa.array(other))]
        yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(edge), pa.int64()), pa.nulls(len(edge), pa.int64())], schema=_FOUND)
    right = np.array([min(LEFT, r[3]) for r in rows], np.int64) + starts[:-1]
    reach = np.zeros(len(rows), np.int64)
    for edge in [0] * first_open + [len(rows) - 1] * last_open:
        ours = h[right[edge] : starts[edge + 1]]
        for i in np.flatnonzero(gram == gram[edge]).tolist():
            theirs = h[right[i] : starts[i + 1]][: len(ours)]
            differ = np.flatnonzero(theirs != ours[: len(theirs)])
            reach[i] = max(reach[i], differ[0] if len(differ) else len(theirs))
    out = at + LEAST - right[row] <= reach[row]
    once = np.zeros(len(w), bool)
    once[order[cut]] = True
    out = np.flatnonzero(out & ((a == b) | once))
    if len(out):
        cols = [names.take(pa.array(a[out])), pa.array(np.where(a == b, place, -1)[out], pa.int32()), pa.nulls(len(out), pa.int32()), names.take(pa.array(b[out]))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(gram[row][out]), pa.array(w[out].view(np.int64))], schema=_FOUND)


def _sorted_windows(most: int):
    def run(batches):
        """Matches within the groups of a sorted partition, about `most` rows at a time, and the windows of large groups, which may go on elsewhere."""
        hashes, held, going = WordHashes(), [], True
        for batch in slices(batches, "words", 1 << 20):
            held += zip(*[c.to_pylist() for c in batch.columns], strict=True)
            while len(held) > most:
                n = most
                while n and held[n - 1][0] == held[most][0]:
                    n -= 1
                split = n == 0  # the whole of it is one group, which is large
                n = n or most
                yield from _compared(held[:n], hashes, going and held[0][5], split)
                held, going = held[n:], split
        if held:
            yield from _compared(held, hashes, going and held[0][5], held[-1][5])

    return run


def _across(found: DataFrame) -> DataFrame:
    """Matches of windows that several tasks or steps hold: tid, start, end, other."""
    met = found.where("h is not null")
    shared = met.groupBy(F.col("h").alias("s_h"), F.col("w").alias("s_w")).agg(F.min("tid").alias("low"), F.max("other").alias("high")).where("low <> high")
    alone = met.where("start >= 0").select("h", "w", "tid", "start").join(shared, (F.col("h") == F.col("s_h")) & (F.col("w") == F.col("s_w")))
    return alone.select("tid", "start", (F.col("start") + LEAST).alias("end"), F.when(F.col("low") == F.col("tid"), F.col("high")).otherwise(F.col("low")).alias("other"))


def _merged(batches):
    """Matches sorted by (tid, start) to passages."""
    tid, start, end, other, held = None, 0, 0, None, []

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _MATCH, strict=True)], [n for n, _ in _MATCH])

    for b in batches:
        for t, s, e, o in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if t == tid and s <= end:
                end, other = max(end, e), min(other, o)
            else:
                if tid is not None:
                    held.append((tid, start, end, other))
                tid, start, end, other = t, s, e, o
        if len(held) > 5000:
            yield made(held)
            held = []
    if tid is not None:
        yield made([*held, (tid, start, end, other)])


def repeated_passages(docs: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, class_id, n_copies, n_words, repeated_words, passages (array of start, end in words), other_doc_id.

    One row for each row of docs with a passage of 50 words or more that another document has as well. Equal texts are
    one class (class_id: its smallest doc_id); with two rows or more the whole text is a passage. other_doc_id is the
    smallest id of the first text found to share a passage. Null and short texts have none. Null doc_ids are carried.
    """
    tid = F.unhex(text_key(F.col("text")))
    slim = docs.select("doc_id", tid.alias("tid"), utf8(F.col("text")).alias("text"))
    anchors = store(over_batches(slim.select("tid", "text"), _anchors(WordHashes()), "h long, tid binary, pos int"), "suffixes")
    brief = F.xxhash64("tid")
    shared = anchors.groupBy("h").agg(F.min(brief).alias("a"), F.max(brief).alias("b"), (F.count("*") > most).alias("large")).where("a <> b").select(F.col("h").alias("s_h"), "large")
    shared = store(shared, "shared-grams")
    left = anchors.join(shared, F.col("h") == F.col("s_h")).select("tid", F.struct("pos", "h", "large").alias("mark"))
    marks = store(left.groupBy(F.col("tid").alias("m_tid")).agg(F.collect_set("mark").alias("marks")), "suffix-marks")  # a text's own suffixes
    texts = slim.select("tid", "text").dropDuplicates(["tid"])
    found = texts.join(marks, F.col("tid") == F.col("m_tid")).select("tid", "text", "marks")
    around = store(over_batches(found, _contexts, "h long, words binary, tid binary, pos int, before binary, large boolean"), "contexts")
    within = F.when(F.col("large"), F.col("words"))  # a group that is not large has one place in the order, so one task
    ordered = around.repartitionByRange("h", within, F.when(F.col("large"), F.col("tid")), F.when(F.col("large"), F.col("pos"))).sortWithinPartitions("h", "words", "tid", "pos")
    found = store(ordered.mapInArrow(_sorted_windows(most), "tid binary, start int, end int, other binary, h long, w long"), "matches")
    matches = found.where("h is null").select("tid", "start", "end", "other").union(_across(found))
    spans = matches.groupBy("tid", "start", "end").agg(F.min("other").alias("other")).repartition("tid").sortWithinPartitions("tid", "start")
    spans = spans.mapInArrow(_merged, "tid binary, start int, end int, other binary")
    own = spans.groupBy(F.col("tid").alias("p_tid")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("passages"), F.min("other").alias("other"))
    own = store(own, "passages")
    sizes = store(docs.select("doc_id", tid.alias("tid"), word_count(F.col("text")).alias("n_words")), "text-sizes")
    classes = store(sizes.groupBy(F.col("tid").alias("c_tid")).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"), F.max("n_words").alias("n_words")), "classes")
    known = classes.join(own, F.col("c_tid") == F.col("p_tid"), "left").where((F.col("p_tid").isNotNull()) | ((F.col("n_copies") > 1) & (F.col("n_words") >= LEAST)))
    other = classes.select(F.col("c_tid").alias("o_tid"), F.col("class_id").alias("other_doc_id"))
    known = known.join(other, F.col("other") == F.col("o_tid"), "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    known = known.withColumn("passages", F.when(F.col("n_copies") > 1, whole).otherwise(F.col("passages")))
    repeated = F.aggregate("passages", F.lit(0), lambda a, p: a + p["end"] - p["start"]).cast("long")
    known = store(known.select("c_tid", "class_id", "n_copies", F.col("n_words").cast("long").alias("n_words"), repeated.alias("repeated_words"), "passages", "other_doc_id"), "repeats")
    return sizes.select("doc_id", "tid").join(known, F.col("tid") == F.col("c_tid")).drop("tid", "c_tid")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with a passage that another one repeats. Null, empty and short texts have none, equal rows the same, no rows give none."""
    out = repeated_passages(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("passages", lambda p: F.concat_ws("-", p["start"].cast("string"), p["end"].cast("string"))), " ")
    return out.withColumn("passages", spans)
