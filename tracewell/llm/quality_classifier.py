"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed in pieces under both dictionaries. (bad - good) / (bad + good) of the compressed sizes says which
kind it resembles, whatever its length; a logistic curve fitted on labelled texts that the dictionaries have not seen
makes it a probability. Only the fit is on a sample (PER_CLASS texts and CLASS_BYTES bytes a label at most, chosen by
hash); every text is scored whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import over_batches, table, utf8

PER_CLASS, CLASS_BYTES = 3000, 8 << 20
PIECE, DICTIONARY_BYTES, LEVEL = 1024, 400_000, 3
#: Share of each label's sample that goes into the dictionaries; the rest fits the curve.
DICTIONARY_SHARE = 0.6
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)] or [b""]


def _dictionary(texts: list[bytes]) -> bytes:
    samples = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their last bytes serve as they are
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Classifier:
    """Two dictionaries and a curve. prior is the share of label 1; without both labels every score is the prior."""

    def __init__(self, good: list[bytes], bad: list[bytes], prior: float):
        self.prior, self.curve, self.dictionaries = prior, (0.0, 0.0), None
        if good and bad:
            cut = [max(1, math.ceil(DICTIONARY_SHARE * len(x))) for x in (good, bad)]
            self.dictionaries = _dictionary(good[: cut[0]]), _dictionary(bad[: cut[1]])
            rest = [x[n:] or x for x, n in zip((good, bad), cut, strict=True)]
            self.curve = self._fit(*[np.array([self.difference(t) for t in r]) for r in rest])

    def __getstate__(self):
        return self.prior, self.curve, self.dictionaries

    def __setstate__(self, state):
        self.prior, self.curve, self.dictionaries = state

    def _compressors(self):
        if not hasattr(self, "_made"):
            made = []
            for d in self.dictionaries:
                kind = zstandard.DICT_TYPE_FULLDICT if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                data = zstandard.ZstdCompressionDict(d, dict_type=kind)
                data.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False))
            self._made = made
        return self._made

    def difference(self, text: bytes) -> float:
        """From -1 to 1: above 0 the good dictionary does better."""
        good, bad = self._compressors()
        pieces = _pieces(text)
        g, b = sum(len(good.compress(p)) for p in pieces), sum(len(bad.compress(p)) for p in pieces)
        return (b - g) / (b + g)

    def _fit(self, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
        """Slope and intercept by Newton steps, each label weighing as it does among all labelled rows."""
        x = np.concatenate([good, bad])
        y = np.r_[np.ones(len(good)), np.zeros(len(bad))]
        w = np.r_[np.full(len(good), self.prior / len(good)), np.full(len(bad), (1 - self.prior) / len(bad))] * len(x)
        a = np.stack([x * 20, np.ones(len(x))], 1)
        beta = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 0.02 * np.eye(2), a.T @ (w * (y - p)) - 0.02 * beta)
            beta += step
            if np.abs(step).max() < 1e-9:
                break
        return float(beta[0] * 20), float(beta[1])

    def score(self, text: bytes) -> float:
        if self.dictionaries is None:
            return self.prior
        z = self.curve[0] * self.difference(text) + self.curve[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Classifier:
    """Fit on labelled rows that are not held out. Labels other than 0 and 1 and null ids are left aside; copies of a text count as often as they are labelled."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").alias("l_id"), F.col("quality").alias("label"), F.md5(F.concat_ws(":", F.lit("train"), F.col("doc_id").cast("string"))).alias("lot"))
    counts = dict(usable.groupBy("label").count().collect())
    if not counts:
        return Classifier([], [], 0.5)
    drawn = usable.where("label = 0").orderBy("lot").limit(per_class).union(usable.where("label = 1").orderBy("lot").limit(per_class))
    texts = docs.join(F.broadcast(drawn), docs["doc_id"] == drawn["l_id"]).select("label", "lot", utf8(F.col("text")).alias("text"))
    size = F.sum(F.length("text")).over(Window.partitionBy("label").orderBy("lot", "text"))
    rows = texts.withColumn("upto", size).where(F.col("upto") - F.length("text") < class_bytes).orderBy("label", "lot", "text").collect()
    kinds = [[bytes(r.text) for r in rows if r.label == k] for k in (1, 0)]
    return Classifier(*kinds, counts.get(1, 0) / sum(counts.values()))


def classify(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted. Null texts are scored as empty; an empty table gives no rows; equal texts have equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.score(t) for t in batch.column(2).to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), utf8(F.col("text")).alias("text"))
    return over_batches(rows, run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
