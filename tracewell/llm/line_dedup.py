"""Line dedup by content-defined chunks.

A rolling hash over the hashes of neighbouring lines decides after which line a chunk ends, so an inserted line moves
only the boundaries next to it. Chunks of two or more lines that occur again anywhere later in the corpus, in the order
of (doc_id, text hash, place), are removed there once their bytes have been compared.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import over_batches, store, table, text_key, utf8

#: A boundary follows one line in so many, on average; lines under the rolling hash; lines, not blank, that a chunk has at least.
SPACING, ROLL, LEAST_LINES = 3, 2, 2
#: Chunks with more occurrences than this are few enough to be broadcast: at most occurrences / HOT, and never more than MOST_HOT.
HOT, MOST_HOT = 1000, 1_000_000
_M = (1 << 64) - 1


def chunk_spans(lines: list[bytes]) -> list[tuple[int, int]]:
    """The chunks as ranges of lines. A chunk does not end before it has LEAST_LINES lines that are not blank, so only a text's last chunk may be shorter."""
    hashes, out, begin, full = [xxhash.xxh64_intdigest(x) for x in lines], [], 0, 0
    for i in range(len(lines)):
        full += bool(lines[i].split())
        if full < LEAST_LINES:
            continue
        roll = 0
        for h in hashes[max(0, i - ROLL + 1) : i + 1]:
            roll = (roll * 0x9E3779B97F4A7C15 + h) & _M
        if (roll * 0xD6E8FEB86659FD93 & _M) >> 33 & 0xFFFFFF < (1 << 24) // SPACING:
            out.append((begin, i + 1))
            begin, full = i + 1, 0
    return out + [(begin, len(lines))] * (begin < len(lines))


def _removable(lines: list[bytes]):
    """(number of the chunk, its bytes) of chunks that may be removed: enough lines that are not blank."""
    for n, (a, b) in enumerate(chunk_spans(lines)):
        if sum(1 for x in lines[a:b] if x.split()) >= LEAST_LINES:
            yield n, b"\n".join(lines[a:b])


def _hashes(chunk: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(chunk)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (h >> 64, h & _M))


def _chunks(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    rows = [(i, k, n, *_hashes(c)) for i, k, t in zip(*[c.to_pylist() for c in batch.columns], strict=True) for n, c in _removable(t.split(b"\n"))]
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "t_key", "chunk", "h1", "h2"])


def _bytes_of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    rows = []
    for text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        asked = {m["chunk"]: m for m in marks}
        rows += [(asked[n]["h1"], asked[n]["h2"], c) for n, c in _removable(text.split(b"\n")) if n in asked]
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["h1", "h2", "bytes"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with text rewritten and n_chunks, n_removed (chunks), n_removed_lines.

    The first occurrence of a chunk stays. Rows equal in doc_id and text count as one document and get the same result.
    Null doc_ids come last in the order. Null and empty texts pass unchanged. Where two different byte strings share a
    128-bit hash, neither is removed. Of further columns only those with the names of result columns are replaced.
    """
    made = ["n_chunks", "n_removed", "n_removed_lines"]
    kept = docs.drop(*made)
    names = kept.columns
    keyed = kept.select(F.struct(*[kept[c] for c in names]).alias("row"), kept["doc_id"].alias("doc_id"), text_key(kept["text"]).alias("t_key"))
    slim = kept.select("doc_id", text_key(F.col("text")).alias("t_key"), utf8(F.col("text")).alias("text"))
    chunks = store(over_batches(slim, _chunks, "doc_id long, t_key string, chunk int, h1 long, h2 long"), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t_key", "chunk")
    often = chunks.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where(F.col("first") != F.col("last"))
    often = store(often.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), "first", "n"), "repeated-chunks")
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = max(HOT, total // MOST_HOT)
    same = (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2"))
    hot = often.where(F.col("n") > bound)
    cool = chunks.join(F.broadcast(hot), same, "left_anti").join(often.where(F.col("n") <= bound), same)
    found = cool.select("doc_id", "t_key", "chunk", "h1", "h2", "first").union(chunks.join(F.broadcast(hot), same).select("doc_id", "t_key", "chunk", "h1", "h2", "first"))
    found = store(found.select("doc_id", "t_key", F.struct("chunk", "h1", "h2", (place != F.col("first")).alias("later")).alias("mark")), "chunk-marks")
    marks = found.groupBy(F.col("doc_id").alias("m_id"), F.col("t_key").alias("m_key")).agg(F.collect_set("mark").alias("marks"))
    marks = store(marks, "marks")  # a document's own chunks
    joined = store(keyed.join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("t_key") == F.col("m_key")), "left").select("row", "marks"), "marked")
    compared = over_batches(joined.where("marks is not null").select(utf8(F.col("row.text")).alias("text"), "marks"), _bytes_of, "h1 long, h2 long, bytes binary")
    clashes = compared.groupBy("h1", "h2", "bytes").agg(F.lit(1).alias("one")).groupBy("h1", "h2").count().where("count > 1")
    clashing = {(r.h1, r.h2) for r in clashes.limit(1_000_000).collect()}  # different bytes under one 128-bit hash
    if len(clashing) == 1_000_000:
        raise RuntimeError("the chunk hash is broken")
    at = names.index("text")

    def rewrite(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts, fields = [], [], batch.column(0).flatten()
        for text, marks in zip(fields[at].to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is None:
                texts.append(None)
                counts.append((0, 0, 0))
                continue
            lines = text.encode("utf-8", "surrogatepass").split(b"\n")
            spans = chunk_spans(lines)
            drop = {m["chunk"] for m in marks or [] if m["later"] and (m["h1"], m["h2"]) not in clashing}
            if drop:
                text = b"\n".join(x for n, (a, b) in enumerate(spans) if n not in drop for x in lines[a:b]).decode("utf-8", "surrogatepass")
            texts.append(text)
            counts.append((len(spans), len(drop), sum(spans[n][1] - spans[n][0] for n in drop)))
        cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(fields)]
        return pa.RecordBatch.from_arrays([*cols, *[pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]], [*names, *made])

    kinds = dict(kept.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], *[f"{c} long" for c in made]])
    return over_batches(joined, rewrite, schema, lambda b: b.column(0).field(at))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the multi-line chunks that occurred before. Odd rows as in deduplicated."""
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_chunks", "n_removed", "n_removed_lines")
