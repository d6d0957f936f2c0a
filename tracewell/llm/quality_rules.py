"""Quality rules: base counts, and n-gram perplexity bands of a modified Kneser-Ney model.

The model's symbols are bytes, its order is 5: the number of n-grams then follows the scripts in use rather than the
corpus, and a gram is a number of 40 bits, so no two share a key. Spark counts the grams of all documents and joins the
orders from unigrams up. The commonest grams, MOST_HEAD at most, go out as arrays sorted by hash with a directory over the
leading bits; the other grams of the documents, each rarer than any of those, are joined with the rest of the model. Both
ways read the same single-precision logarithms, so the corpus' size moves no result.

The order was kept after a comparison over all labelled rows of 10,000 documents: of the junk that passes the base, bands
that keep 95 % of the good texts let 28 % through at order 5 and 62 % at orders 6 and 7. Leaving a document's own grams out
changed 28 % to 27 %, so a document is scored by the model of all.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import DOCUMENT_COLUMNS, WordHashes, flat_words, slices, store, table, text_key, utf8, windows

ORDER = 5
PAD = b"\0" * (ORDER - 1)
#: Grams that are sent out, at 12 bytes each.
MOST_HEAD = 1_000_000
#: Bytes of text that are counted or measured at a time; a task holds some 60 bytes for each.
SLICE = 1 << 20
#: Grams looked up at a time.
LOOKUP = 1 << 18
#: Grams that a counting task holds before it passes them on.
MOST_HELD = 1_000_000
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
#: Width of the bands in robust standard deviations, chosen on labelled rows outside the held-out fold, and the least such
#: deviation (nats a byte), far below that of any language.
BAND, LEAST_SPREAD = 2.5, 0.001
#: Nats a byte to which the bands' quartiles are taken.
STEP = 1e-4
_NOT_COUNTED = bytes([*range(9, 14), 32, *range(0x80, 0xC0)])


def packed_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams that end at each byte of the texts, as numbers, and where each text begins."""
    a = np.frombuffer(b"".join(p for t in texts for p in (PAD, t)), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    g = np.zeros(max(0, len(a) - ORDER + 1), np.uint64)
    for j in range(ORDER):
        np.left_shift(g, np.uint64(8), out=g)
        np.bitwise_or(g, a[j : j + len(g)], out=g)
    first = np.cumsum(lengths + len(PAD)) - lengths - len(PAD)
    real = np.ones(len(g), bool)
    for f in first[1:].tolist():  # grams that end in the padding between two texts
        real[f - len(PAD) : f] = False
    return g[real], starts


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, n) over all bytes of all documents."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            g = np.concatenate([h[0] for h in held])
            order = np.argsort(g, kind="stable")
            g, n = g[order], np.concatenate([h[1] for h in held])[order]
            cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            return g[cut], np.add.reduceat(n, cut)

        def out():
            g, n = merged()
            for i in range(0, len(g), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(g[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["gram", "n"])

        for b in slices(batches, most=SLICE):
            g, n = np.unique(packed_grams(b.column(0).to_pylist())[0], return_counts=True)
            held.append((g, n.astype(np.int64)))
            size += len(g)
            if size > MOST_HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > MOST_HELD // 2:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    counted = docs.select(utf8(F.col("text")).alias("text")).mapInArrow(run, "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ from the numbers of grams counted once to four times; 0.5, 0.75, 0.9 where one of them is none."""
    n = [0, *counts.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()]
    if not all(n[1:]):
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)]


class Model:
    """Counts of every order (continuation counts below the highest) with their discounts."""

    def __init__(self, docs: DataFrame):
        top = store(count_grams(docs), "grams")
        self.counts = {ORDER: top}
        for m in range(ORDER - 1, 0, -1):
            lower = F.col("gram").bitwiseAND(F.lit((1 << (8 * m)) - 1))
            self.counts[m] = store(self.counts[m + 1].groupBy(lower.alias("gram")).agg(F.count("*").alias("n")), f"grams-{m}")
        self.discounts = {m: _discounts(c) for m, c in self.counts.items()}
        self.contexts = {m: self._contexts(m) for m in self.counts}

    def _discount(self, m: int):
        d = self.discounts[m]
        return F.when(F.col("n") == 1, F.lit(d[0])).when(F.col("n") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))

    def _contexts(self, m: int) -> DataFrame:
        return self.counts[m].groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("all"), (F.sum(self._discount(m)) / F.sum("n")).alias("gamma"))

    def probabilities(self, grams: DataFrame, m: int = ORDER) -> DataFrame:
        """(gram, p) for different grams of order m, seen or not."""
        own = self.counts[m].select(F.col("gram").alias("s_gram"), "n")
        g = grams.join(own, grams["gram"] == own["s_gram"], "left").drop("s_gram").withColumn("context", F.shiftright("gram", 8))
        g = g.join(self.contexts[m], "context", "left")
        high = F.coalesce((F.col("n") - self._discount(m)) / F.col("all"), F.lit(0.0))
        gamma = F.coalesce("gamma", F.lit(1.0))
        if m == 1:
            return g.select("gram", (high + gamma / 256).alias("p"))
        lower = F.col("gram").bitwiseAND(F.lit((1 << (8 * (m - 1))) - 1))
        below = self.probabilities(grams.select(lower.alias("gram")).distinct(), m - 1).select(F.col("gram").alias("lower"), F.col("p").alias("below"))
        return g.withColumn("lower", lower).join(below, "lower").select("gram", (high + gamma * F.col("below")).alias("p"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


class HashArrays:
    """Log probabilities in arrays sorted by hash, with a directory over the hashes' leading bits."""

    def __init__(self, grams: np.ndarray, logp: np.ndarray):
        h = _mix(grams.view(np.uint64))
        order = np.argsort(h)
        self.hashes = np.append(h[order], np.uint64(0xFFFFFFFFFFFFFFFF))  # an end that no gram of 40 bits has
        self.logp = np.append(logp[order], np.float32(np.nan)).astype(np.float32)
        self._index()

    def _index(self):
        bits = max(4, int(len(self.hashes)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __reduce__(self):
        return _restore, (self.hashes, self.logp)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of each gram; NaN where there is none."""
        out = np.empty(len(grams), np.float32)
        for i in range(0, len(grams), LOOKUP):
            h = _mix(grams[i : i + LOOKUP])
            at = self.first[h >> self.shift].astype(np.int64)
            late = np.flatnonzero(self.hashes[at] < h)
            while len(late):
                at[late] += 1
                late = late[self.hashes[at[late]] < h[late]]
            part = self.logp[at]
            part[self.hashes[at] != h] = np.nan
            out[i : i + LOOKUP] = part
        return out


def _restore(hashes, logp):
    out = HashArrays.__new__(HashArrays)
    out.hashes, out.logp = hashes, logp
    out._index()
    return out


def base_counts(texts: list[bytes], hashes: WordHashes) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    words, h, starts = flat_words(texts, hashes)
    n = np.diff(starts)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
    covered = np.zeros(len(words) + 1, np.int64)
    w = windows(h, WINDOW)
    if len(w):
        inside = doc[: len(w)] == doc[WINDOW - 1 :]
        w = (w ^ (doc[: len(w)] * np.uint64(0xD6E8FEB86659FD93)))[inside]
        at = np.flatnonzero(inside)
        s = np.sort(w)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if len(twice):
            near = np.minimum(np.searchsorted(twice, w), len(twice) - 1)
            at = at[twice[near] == w].tolist()
            exact = [(int(doc[i]), b" ".join(words[i : i + WINDOW])) for i in at]
            often = Counter(exact)
            hit = np.array([i for i, e in zip(at, exact, strict=True) if often[e] > 1], np.int64)
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    lines = []
    for t in texts:
        own = t.split(b"\n")
        lines.append(0 if len(own) == len(set(own)) else sum(c - 1 for line, c in Counter(own).items() if c > 1 and line.split()))
    return {
        "n_words": n, "word_chars": np.array([len(t.translate(None, _NOT_COUNTED)) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64), "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": inside[starts[1:]] - inside[starts[:-1]],
    }


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


_TAIL_ROWS = 1 << 16


def _measured(docs: DataFrame, carry: list[str], model) -> DataFrame:
    """A row to a document: docs' columns `carry`, the base counts, n_bytes, log_p (sum over its grams in the arrays) and its
    own number `rid`. Rows with a `gram` are the grams that the arrays lack, with the number of times in the document rid.
    """
    hashes = WordHashes()
    kinds = dict(docs.dtypes)
    ddl = ", ".join([*[f"`{c}` {kinds[c]}" for c in carry], "rid long", *[f"{c} long" for c in BASE], "n_bytes long", "log_p double", "gram long", "times long"])

    def run(batches):
        names = [*carry, "rid", *BASE, "n_bytes", "log_p", "gram", "times"]
        for batch in slices(batches, "__text", SLICE):
            texts = batch.column(len(carry) + 1).to_pylist()
            rid = batch.column(len(carry))
            cols = base_counts(texts, hashes)
            grams, starts = packed_grams(texts)
            log_p = model.value.find(grams)
            lacking = np.flatnonzero(np.isnan(log_p))
            doc = np.searchsorted(starts, lacking, "right") - 1
            log_p[lacking] = 0
            upto = np.concatenate([[0.0], np.cumsum(log_p, dtype=np.float64)])
            made = [pa.array(cols[c].astype(np.int64)) for c in BASE]
            size = pa.array([len(t) for t in texts], pa.int64())
            none = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], rid, *made, size, pa.array(upto[starts[1:]] - upto[starts[:-1]]), none, none], names)
            order = np.lexsort((grams[lacking], doc))
            g, doc = grams[lacking][order], doc[order]
            cut = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])][: len(g)])
            times = np.diff(np.r_[cut, len(g)])
            for i in range(0, len(cut), _TAIL_ROWS):
                c = cut[i : i + _TAIL_ROWS]
                empty = [pa.nulls(len(c), x.type) for x in batch.columns[: len(carry)]]
                yield pa.RecordBatch.from_arrays([*empty, rid.take(pa.array(doc[c])), *[pa.nulls(len(c), pa.int64())] * (len(BASE) + 1), pa.nulls(len(c), pa.float64()), pa.array(g[c].view(np.int64)), pa.array(times[i : i + _TAIL_ROWS])], names)

    return docs.select(*carry, F.monotonically_increasing_id().alias("rid"), utf8(F.col("text")).alias("__text")).mapInArrow(run, ddl)


def _head(top: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The commonest grams of the model, `most` at most, and the others. Counts are taken by quarters of a power of two, so the driver sees some hundred rows."""
    lot = F.floor(4 * F.log2("n")).cast("int")
    left, least = most, None
    for k, size in sorted(top.groupBy(lot.alias("lot")).count().collect(), reverse=True):
        if size > left:
            break
        left, least = left - size, k
    if least is None:
        return top.limit(0), top
    return top.where(lot >= least), top.where(lot < least)


def measured(docs: DataFrame, carry: list[str], most_head: int = MOST_HEAD) -> DataFrame:
    """docs' columns `carry` with the base counts and log_ppl: minus the mean log probability of a byte (null without bytes)."""
    model = Model(docs)
    p = model.probabilities(model.counts[ORDER].select("gram")).select(F.col("gram").alias("p_gram"), F.ln("p").cast("float").alias("logp"))
    top = store(model.counts[ORDER].join(p, F.col("gram") == F.col("p_gram")).select("gram", "n", "logp"), "model")
    head, tail = _head(top, most_head)
    rows = head.select("gram", "logp").toArrow()  # at most MOST_HEAD rows of 12 bytes
    arrays = HashArrays(np.asarray(rows["gram"]), np.asarray(rows["logp"]))
    every = store(_measured(docs, carry, docs.sparkSession.sparkContext.broadcast(arrays)), "scored")
    out = every.where("gram is null").drop("gram", "times")
    if not tail.isEmpty():
        rest = every.where("gram is not null").select(F.col("rid").alias("t_rid"), F.col("gram").alias("t_gram"), "times")
        rest = rest.join(tail, F.col("t_gram") == F.col("gram")).groupBy("t_rid").agg(F.sum(F.col("times") * F.col("logp").cast("double")).alias("rest_p"))
        out = out.join(rest, F.col("rid") == F.col("t_rid"), "left").withColumn("log_p", F.col("log_p") + F.coalesce("rest_p", F.lit(0.0))).drop("t_rid", "rest_p")
    return out.withColumn("log_ppl", F.when(F.col("n_bytes") > 0, -F.col("log_p") / F.col("n_bytes"))).drop("log_p", "n_bytes", "rid")


def _quarters(rows: DataFrame) -> DataFrame:
    """b_lang, q1, q2, q3 of log_ppl for each language: exact to one STEP and the same in every run."""
    bins = rows.groupBy(F.col("lang").alias("b_lang"), F.floor(F.col("log_ppl") / STEP).alias("bin")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("b_lang").orderBy("bin"))  # of some ten thousand bins at most
    bins = bins.withColumns({"upto": upto, "all": F.sum("n").over(Window.partitionBy("b_lang"))})
    q = [F.min(F.when(4 * F.col("upto") >= k * F.col("all"), (F.col("bin") + 0.5) * STEP)).alias(f"q{k}") for k in (1, 2, 3)]
    return bins.groupBy("b_lang").agg(*q)


def judged(rows: DataFrame) -> DataFrame:
    """Adds base_failed, low, high and kept to stored rows of measured() that have lang. The bands of a language (null is one) come from all its rows that pass the base."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    quarters = _quarters(rows.where(~failed & F.col("log_ppl").isNotNull()))
    spread = F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(LEAST_SPREAD)) * BAND
    bands = quarters.select("b_lang", (F.col("q2") - spread).alias("low"), (F.col("q2") + spread).alias("high"))
    bands = store(bands, "bands")
    if bands.count() <= 100_000:
        bands = F.broadcast(bands)
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return rows.join(bands, F.col("lang").eqNullSafe(F.col("b_lang")), "left").withColumn("kept", kept).drop("b_lang")


def quality_rules(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, log_ppl, low, high, kept, and the columns named in carry.

    A null or empty text has no words and fails the base. Null lang is a language of its own. Ties and repeated rows get
    equal results; an empty table gives no rows. Of clashing names the result's column wins.
    """
    made = {*BASE, "base_failed", "log_ppl", "low", "high", "kept", "rid", "n_bytes", "log_p", "gram", "times"}
    names = ["doc_id", "lang", *[c for c in carry or [] if c not in made | {"doc_id", "lang"}]]
    return judged(store(measured(docs, names), "measured"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents with the base counts, the perplexity and the verdict. Odd rows are treated as in quality_rules."""
    rows = quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *BASE, "base_failed", "kept", "log_ppl", "low", "high")


def rules_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep.

    Null and empty texts go, they have no words. Equal rows (in doc_id, text and lang) stay or go together. An empty table
    stays empty; further columns of docs are dropped. The texts meet the verdicts by key only at the end.
    """
    keyed = docs.select(*DOCUMENT_COLUMNS, text_key(F.col("text")).alias("t_key"))
    kept = quality_rules(keyed, ["t_key"]).where("kept").select(F.col("doc_id").alias("k_id"), F.col("lang").alias("k_lang"), F.col("t_key").alias("k_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("t_key") == F.col("k_key")) & F.col("lang").eqNullSafe(F.col("k_lang"))
    return keyed.join(kept, same, "left_semi").select(*DOCUMENT_COLUMNS)
