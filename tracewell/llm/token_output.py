"""Token-id output: documents in ascending doc_id order as raw ids, with a minimal perfect hash index over their keys.

File format (Parquet as the container, so that Spark's committer and any store that Spark reads will do):
`blocks` has rows (part, block, doc0, tok0, width, keys, ends, payload): ids little-endian in `width` bytes each, document i
of a block lies at ends[i-1]:ends[i] (ids), doc0 and tok0 count what the part holds before the block. `parts` has the ids of
each part. `index` has rows (bucket, sizes, bits, fingerprints, parts, blocks, offsets, copies, last_parts, last_blocks): a
cascade of bit arrays sends every key of a bucket to a slot of its own, and the slot's stored fingerprint tells strangers
apart. Payloads are not compressed and every block is a row group of its own, so a key's ids take one look into the index,
one row group, and one slice.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Callable
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import DOCUMENT_COLUMNS, fresh, kept_by_worker, own_dir, slices, store, table, utf8

END_ID = 2
BLOCK_BYTES, BLOCK_DOCS, BUCKET_KEYS = 2 << 20, 50_000, 20_000


class Memory:
    """Keys and the ids of each, in Arrow. With more than `most` keys all are forgotten but those of the last call."""

    def __init__(self, most: int):
        self.most, self.keys, self.ids = most, pa.array([], pa.binary()), pa.array([], pa.large_binary())

    def ids_of(self, asked: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """The ids of each key asked for; `learn` gives those of the keys that are not known."""
        coded = pa.chunked_array([self.keys, asked]).dictionary_encode()
        at, every = coded.chunk(coded.num_chunks - 1).indices, coded.chunk(coded.num_chunks - 1).dictionary
        if len(every) > len(self.keys):  # known keys come first, in their order
            self.ids = pa.concat_arrays([self.ids, learn(every.slice(len(self.keys)))])
            self.keys = every
        out = self.ids.take(at)
        if len(self.keys) > self.most:
            used = np.zeros(len(self.keys), bool)
            used[np.asarray(at)] = True
            self.keys, self.ids = self.keys.filter(pa.array(used)), self.ids.filter(pa.array(used))
        return out


#: The steps before the model that the shortcut below stands for; with any others texts are encoded whole.
_KNOWN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None,
}
#: Byte-level alphabet: printable characters of Latin-1 stand for themselves, the other bytes for 256, 257, ... in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + n for n, b in enumerate(x for x in range(256) if x not in _SHOWN)}
#: The code point that stands for each byte; a line end's stands for no other byte, so it can part pieces.
_SHOWN_AS = np.array([_BYTE_LEVEL.get(b, b) for b in range(256)], "<u4")
_BYTE = np.arange(256)
#: Latin-1 in lower case, and the kind of its characters there: letter, digit, other, line end.
_LOWER = np.where(((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 0xC0) & (_BYTE <= 0xDE) & (_BYTE != 0xD7)), _BYTE + 32, _BYTE).astype(np.uint8)
_KIND = np.select([_BYTE == 10, (_BYTE >= 48) & (_BYTE <= 57), ((_BYTE >= 97) & (_BYTE <= 122)) | ((_BYTE >= 0xDF) & (_BYTE != 0xF7))], [3, 1, 0], 2).astype(np.uint8)


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one, and where each begins (one more entry than rows)."""
    _, offsets, data = values.buffers()
    width = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    offsets = np.frombuffer(offsets, width)[values.offset : values.offset + len(values) + 1]
    flat = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def _spans(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of such bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])


def _joined(keys: pa.Array) -> np.ndarray:
    """The bytes of all keys, a line end after each."""
    flat, offsets = _flat(keys)
    own = np.ones(len(flat) + len(keys), bool)
    own[offsets[1:] + np.arange(len(keys))] = False
    out = np.full(len(own), 10, np.uint8)
    out[own] = flat
    return out


def _cut_elsewhere(b: np.ndarray) -> np.ndarray:
    """Where words (a line end after each) hold what _pieces does not cut as the tokenizer does: other characters than ASCII's and Latin-1's letters, what may begin a special token, an apostrophe before a letter."""
    then, before = np.append(b[1:], np.uint8(10)), np.append(np.uint8(10), b[:-1])
    lead = (b == 0xC3) & (then >= 0x80) & (then <= 0xBF) & (then != 0x97) & (then != 0xB7)
    fine = ((b > 32) & (b < 127)) | (b == 10) | lead | ((b >= 0x80) & (b <= 0xBF) & (before == 0xC3))
    return ~fine | ((b == 60) & (then == 124)) | ((b == 39) & (_KIND[_LOWER[then]] == 0) & (then < 128))


def _pieces(b: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokenizer's own split of words (a line end after each), lower-cased: the pieces in Latin-1, and where each word's begin (one more entry than words)."""
    wide = (b >= 0x80) & (b != 0xC3)
    low = _LOWER[np.where(wide, b + np.uint8(0x40), b)[b != 0xC3]]
    kind = _KIND[low]
    first = np.append(True, kind[1:] != kind[:-1]) | (kind == 1)
    inner = kind != 3
    starts, ends_word = np.flatnonzero(first & inner), np.flatnonzero(~inner)
    flat = low[inner]
    offsets = np.append(starts - np.searchsorted(ends_word, starts), len(flat)).astype(np.int32)  # line ends are left out
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return pieces, np.append(0, np.searchsorted(starts, ends_word))


class WordEncoder:
    """Ids of whole texts by way of their words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn. Every
    id comes from the tokenizers library; a bounded memory of words and of pieces spares it the repeats.
    """

    def __init__(self, path: str, most: int, most_pieces: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        self.by_word = all(steps.get(k) == v for k, v in _KNOWN_STEPS.items()) and not any(a["lstrip"] or a["rstrip"] for a in steps["added_tokens"])
        self.code = "H" if self.tokenizer.get_vocab_size() <= 0x10000 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.words, self.pieces = Memory(most), Memory(most_pieces)

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _new_pieces(self, new: pa.Array) -> pa.Array:
        utf8 = _joined(new).tobytes().decode("latin-1").encode()
        shown = _SHOWN_AS[np.frombuffer(utf8, np.uint8)].tobytes().decode("utf-32-le").split(chr(_BYTE_LEVEL[10]))
        flat, upto = [], [np.zeros(1, np.int64)]
        for i in range(0, len(new), 20_000):
            tokens = list(map(self.tokenizer.model.tokenize, shown[i : min(i + 20_000, len(new))]))
            upto.append(np.fromiter(map(len, tokens), np.int64, len(tokens)))
            flat.append(np.fromiter(map(attrgetter("id"), chain.from_iterable(tokens)), self.dtype, upto[-1].sum()))
        return _spans(np.concatenate(flat).view(np.uint8), self.dtype.itemsize * np.cumsum(np.concatenate(upto)))

    def _new_words(self, new: pa.Array) -> pa.Array:
        b = _joined(new)
        odd = np.unique(np.searchsorted(np.flatnonzero(b == 10), np.flatnonzero(_cut_elsewhere(b))))
        plain = new
        if len(odd):
            ours = np.ones(len(new), bool)
            ours[odd] = False
            plain = new.filter(pa.array(ours))
            b = _joined(plain)
        pieces, upto = _pieces(b)
        flat, offsets = _flat(self.pieces.ids_of(pieces, self._new_pieces)) if len(pieces) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        ids = _spans(flat, offsets[upto])
        if not len(odd):
            return ids
        at = np.empty(len(new), np.int64)
        at[ours], at[odd] = np.arange(len(plain)), len(plain) + np.arange(len(odd))
        return pa.concat_arrays([ids, pa.array(self._whole(new.take(pa.array(odd)).to_pylist()), pa.large_binary())]).take(pa.array(at))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a binary array without nulls, as bytes."""
        if not self.by_word:
            return self._whole(texts.to_pylist())
        if not len(texts):
            return []
        texts = pa.concat_arrays([texts])  # without an offset
        split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, *texts.buffers()[1:]]))
        coded = split.values.dictionary_encode()
        d = coded.dictionary
        words = pa.Array.from_buffers(pa.binary(), len(d), [None, *d.buffers()[1:]], offset=d.offset)
        flat, offsets = _flat(self.words.ids_of(words, self._new_words).take(coded.indices))
        raw, ends = memoryview(flat), offsets[np.asarray(split.offsets)].tolist()
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


_ENCODERS: dict[tuple[str, int], WordEncoder] = kept_by_worker()
#: Words that a worker remembers, some 40 bytes each; with fewer it asks the tokenizer again more often.
WORDS, FEWER_WORDS = 400_000, 150_000
#: Bytes of text that are encoded at a time, to a word remembered: all that is remembered is hashed again each time.
BYTES_A_WORD = 40


def encoder(path: str, words: int) -> WordEncoder:
    """The worker's own encoder; it lives until the worker turns to another operator."""
    if (path, words) not in _ENCODERS:
        _ENCODERS[path, words] = WordEncoder(path, words)
    return _ENCODERS[path, words]


#: Parquet settings under which a row group ends after each block.
_RAW = {"compression": "none", "parquet.block.size": "1", "parquet.enable.dictionary": "false", "parquet.block.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.page.row.count.limit": "1"}
_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc0", pa.int64()), ("tok0", pa.int64()), ("width", pa.int32()), ("keys", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())])


def _blocks(tokenizer_path: str, end_id: int, words: int):
    def run(batches):
        enc, part = encoder(tokenizer_path, words), TaskContext.get().partitionId()
        width, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
        keys, ends, chunks, held, block, doc0, tok0 = [], [], [], 0, 0, 0, 0

        def made():
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "doc0": doc0, "tok0": tok0, "width": width, "keys": keys, "ends": ends, "payload": b"".join(chunks)}], _BLOCK)

        for batch in slices(batches, most=BYTES_A_WORD * words, keep=_ENCODERS):
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                ids += end
                chunks.append(ids)
                held += len(ids)
                keys.append(key)
                ends.append(held // width)
                if held >= BLOCK_BYTES or len(keys) >= BLOCK_DOCS:
                    yield made()
                    block, doc0, tok0 = block + 1, doc0 + len(keys), tok0 + ends[-1]
                    keys, ends, chunks, held = [], [], [], 0
        if keys:
            yield made()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, words: int = WORDS) -> None:
    """Write the files. Null doc_ids come first; rows with one doc_id follow each other in input order; null texts are empty and get the end id alone."""
    ordered = docs.select("doc_id", utf8(F.col("text")).alias("text"), F.monotonically_increasing_id().alias("rid")).repartitionByRange("doc_id", "rid").sortWithinPartitions("doc_id", "rid")
    schema = "part int, block int, doc0 long, tok0 long, width int, keys array<long>, ends array<long>, payload binary"
    ordered.select("doc_id", "text").mapInArrow(_blocks(tokenizer_path, end_id, words), schema).write.options(**_RAW).parquet(f"{path}/blocks")
    spark = docs.sparkSession
    blocks = spark.read.parquet(f"{path}/blocks")
    heads = blocks.select("part", F.size("keys").alias("docs"), F.coalesce(F.element_at("ends", -1), F.lit(0)).alias("ids"))
    heads.groupBy("part").agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids")).coalesce(1).write.parquet(f"{path}/parts")
    _write_index(spark.read.parquet(f"{path}/blocks"), path)


# --- the index ---------------------------------------------------------------------------------------------------------

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
NULL_KEY = np.uint64(0x6E756C6C)


def key_hash(keys: list[int | None]) -> np.ndarray:
    """64 bits to a key; a bijection of the keys that are not null, so that different keys never share all bits."""
    h = np.array([NULL_KEY if k is None else np.uint64(k & 0xFFFFFFFFFFFFFFFF) for k in keys], np.uint64)
    return _mixed(h, 0)


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    h = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def build_mph(h: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(sizes, bits, slots): level by level a bit is set where exactly one of the keys left falls; the others go on. A key's slot is the number of set bits before its own."""
    sizes, levels, where = [], [], np.zeros(len(h), np.int64)
    left, base, level = np.arange(len(h)), 0, 1
    while len(left):
        size = max(64, 2 * len(left))
        pos = (_mixed(h[left], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(pos, minlength=size) == 1
        levels.append(alone)
        sizes.append(size)
        hit = alone[pos]
        where[left[hit]] = base + pos[hit]
        left, base, level = left[~hit], base + size, level + 1
        if level > 200:
            raise ValueError("two keys with the same hash")
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    return sizes, np.packbits(bits), (np.cumsum(bits) - 1)[where] if len(h) else where


def find_slots(sizes: list[int], bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The slot of each hash; -1 where no level has a bit for it."""
    flags = np.unpackbits(bits)[: sum(sizes)].astype(bool)
    rank, out = np.cumsum(flags) - 1, np.full(len(h), -1, np.int64)
    left, base = np.arange(len(h)), 0
    for level, size in enumerate(sizes, 1):
        at = base + (_mixed(h[left], level) % np.uint64(size)).astype(np.int64)
        hit = flags[at]
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return out


def _bucket(n: int):
    return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")


def _write_index(blocks: DataFrame, path: str) -> None:
    where = F.arrays_zip(F.col("keys").alias("key"), F.concat(F.array(F.lit(0).cast("long")), F.slice("ends", 1, F.size("ends") - 1)).alias("offset"))
    entries = blocks.select("part", "block", F.explode(where).alias("e")).select(F.col("e.key").alias("key"), F.struct("part", "block", F.col("e.offset").alias("offset")).alias("at"))
    firsts = store(entries.groupBy("key").agg(F.min("at").alias("at"), F.count("*").alias("copies"), F.max("at").alias("last")).select("key", "at.*", "copies", F.col("last.part").alias("last_part"), F.col("last.block").alias("last_block")), "index-keys")
    n = max(1, -(-firsts.count() // BUCKET_KEYS))

    def build(t: pa.Table) -> pa.Table:
        h = key_hash(t["key"].to_pylist())
        sizes, bits, slots = build_mph(h)

        def packed(values, dtype):
            out = np.zeros(len(slots), dtype)
            out[slots] = values
            return out.tobytes()

        col = lambda c: np.asarray(t[c])
        row = {"bucket": t["bucket"][0].as_py(), "sizes": sizes, "bits": bits.tobytes(), "fingerprints": packed((h >> np.uint64(32)).astype("<u4"), "<u4"), "parts": packed(col("part"), "<i4"), "blocks": packed(col("block"), "<i4"), "offsets": packed(col("offset"), "<i8"), "copies": packed(col("copies"), "<i8"), "last_parts": packed(col("last_part"), "<i4"), "last_blocks": packed(col("last_block"), "<i4")}
        return pa.Table.from_pylist([row], pa.schema([("bucket", pa.int32()), ("sizes", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("bits", "fingerprints", "parts", "blocks", "offsets", "copies", "last_parts", "last_blocks")]]))

    index = firsts.withColumn("bucket", _bucket(n)).groupBy("bucket").applyInArrow(build, "bucket int, sizes array<long>, bits binary, fingerprints binary, parts binary, blocks binary, offsets binary, copies binary, last_parts binary, last_blocks binary")
    index.withColumn("buckets", F.lit(n)).write.parquet(f"{path}/index")


def locate(keys: DataFrame, path: str) -> DataFrame:
    """key -> (part, block, offset, copies, last_part, last_block) through the index, for a DataFrame with a column `key` of different keys. Keys that the files lack give no row."""
    index = keys.sparkSession.read.parquet(f"{path}/index")
    head = index.select("buckets").first()
    n = head[0] if head else 1

    def look(wanted: pa.Table, idx: pa.Table) -> pa.Table:
        out = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("offset", pa.int64()), ("copies", pa.int64()), ("last_part", pa.int32()), ("last_block", pa.int32())])
        if not (idx.num_rows and wanted.num_rows):
            return out.empty_table()
        row = idx.slice(0, 1).to_pylist()[0]
        h = key_hash(wanted["key"].to_pylist())
        slots = find_slots(row["sizes"], np.frombuffer(row["bits"], np.uint8), h)
        ok = slots >= 0
        ok[ok] = np.frombuffer(row["fingerprints"], "<u4")[slots[ok]] == (h[ok] >> np.uint64(32)).astype("<u4")
        get = lambda c, d: pa.array(np.frombuffer(row[c], d)[slots[ok]])
        return pa.Table.from_arrays([wanted["key"].filter(pa.array(ok)).combine_chunks(), get("parts", "<i4"), get("blocks", "<i4"), get("offsets", "<i8"), get("copies", "<i8"), get("last_parts", "<i4"), get("last_blocks", "<i4")], schema=out)

    wanted = keys.select("key").withColumn("bucket", _bucket(n))
    return wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(look, "key long, part int, block int, offset long, copies long, last_part int, last_block int")


def read_tokens(spark, path: str, ids: bool = False) -> DataFrame:
    """Each document of the files: doc_id, part, block, offset, start, n_tokens, ids_crc32, and the ids themselves if asked for."""
    parts = spark.read.parquet(f"{path}/parts").orderBy("part").collect()  # a row to a write task
    base, at = {}, 0
    for p in parts:
        base[p.part], at = at, at + p.ids
    return _digested(spark.read.parquet(f"{path}/blocks"), base, ids)


def _digested(blocks: DataFrame, base: dict[int, int], ids: bool) -> DataFrame:
    """The documents of blocks; base has the ids before each part (start counts from the part where it has none)."""
    fields = [("doc_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("offset", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * ids
    schema = pa.schema(fields)

    def run(batches):
        fresh(_ENCODERS)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tokens = np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4")
                ends = np.array(row["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                raw = memoryview(tokens.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                cols = [pa.array(row["keys"], pa.int64()), pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["block"], np.int32)), pa.array(starts), pa.array(starts + (base.get(row["part"], 0) + row["tok0"])), pa.array(ends - starts), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = "doc_id long, part int, block int, offset long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return blocks.select("part", "block", "tok0", "width", "keys", "ends", "payload").mapInArrow(run, ddl)


#: Blocks that get() opens by name; with more it joins the places with the blocks' numbers.
MOST_NAMED = 2000


def get(keys: DataFrame, path: str) -> DataFrame:
    """Keyed access: doc_id, copy (from 0), ids of the documents whose keys are asked for (column `key`); only the blocks that hold one are opened.

    Keys asked for twice count once, strangers give no row, a null key is one like any other. With repeated doc_ids all
    copies come, wherever their run of blocks ends.
    """
    spark = keys.sparkSession
    places = store(locate(keys.select(F.col("key").cast("long").alias("key")).distinct(), path), "places")
    spans = places.select("part", "block", "last_part", "last_block").distinct()
    blocks = spark.read.parquet(f"{path}/blocks")
    few = spans.limit(MOST_NAMED + 1).collect()
    here = F.struct(F.col("part"), F.col("block"))
    if len(few) <= MOST_NAMED:
        named = F.lit(False)
        for r in few:
            one = (r.part, r.block) == (r.last_part, r.last_block)
            named = named | ((F.col("part") == r.part) & (F.col("block") == r.block) if one else F.col("part").between(r.part, r.last_part) & here.between(F.struct(F.lit(r.part), F.lit(r.block)), F.struct(F.lit(r.last_part), F.lit(r.last_block))))
        opened = blocks.where(named)
    else:
        heads = blocks.select("part", "block")  # no payload is read for this
        s = spans.select(*[F.col(c).alias(f"s_{c}") for c in spans.columns])
        s = s.withColumn("s_each", F.explode(F.sequence("s_part", "s_last_part")))
        asked = heads.join(s, (F.col("part") == F.col("s_each")) & here.between(F.struct("s_part", "s_block"), F.struct("s_last_part", "s_last_block")))
        opened = blocks.join(asked.select("part", "block").distinct(), ["part", "block"], "left_semi")
    read = _digested(opened, {}, True)
    wanted = places.select("key", "copies", F.struct("part", "block", "offset").alias("first"))
    at = F.struct(read["part"], read["block"], read["offset"])
    hit = read.join(wanted, read["doc_id"].eqNullSafe(wanted["key"]) & (wanted["first"] <= at))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(at)) - 1
    return hit.select("doc_id", nth.alias("copy"), "ids")


def tokenized(docs: DataFrame, tokenizer_path: str, path: str | None = None, ids: bool = False, words: int = WORDS) -> DataFrame:
    """Write the documents' ids and read them back through the index.

    One row per row of docs: doc_id, start, n_tokens, ids_crc32. Keys of docs go through the index to a place in the
    files; what lies there is read. With repeated doc_ids the index holds the first place and the number of copies, and
    the copies follow it. An empty table gives no rows. Only doc_id and text of docs are looked at.
    """
    spark = docs.sparkSession
    path = path or f"{own_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, words=words)
    keys = docs.select(F.col("doc_id").alias("key")).distinct()
    found = locate(keys, path).select("key", F.struct("part", "block", "offset").alias("place"), "copies")
    read = read_tokens(spark, path, ids)
    here = F.struct(read["part"], read["block"], read["offset"])
    same = read["doc_id"].eqNullSafe(found["key"]) & ((found["place"] == here) | ((found["copies"] > 1) & (found["place"] < here)))
    return read.join(found, same).select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids)


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_token_output(spark, sf_dir: str) -> DataFrame:
    """All documents as ids of the 49k word BPE, written and read back. Odd rows as in tokenized."""
    return tokenized(table(spark, sf_dir, "documents"), public_tokenizer())


def token_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the documents' ids with their place in the order of the files. Odd rows as in tokenized."""
    return tokenized(docs.select(*DOCUMENT_COLUMNS), public_tokenizer(), ids=True, words=FEWER_WORDS)  # beside what the other stages' workers hold
