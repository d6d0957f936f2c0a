"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments such that fingerprints within the limit of differing bits differ in two bits or fewer
of some segment: the Hamming balls of radius 1 around both segment values then share a key. Every fingerprint, known once
however many documents have it, enters the table under the keys of its balls; those that meet under a key have their
whole distance checked. A key met by very many is dealt out as pairs of blocks, so no task holds more than two blocks.

The query's contract asks for 64 bits over four-word shingles and 4 bits: two segments of 32. The pipeline's stage takes
five-word shingles and a similarity of 0.8. Sets with that Jaccard similarity make an angle of acos(8 / 9), which is 19.3
of 128 bits on average, so the stage links fingerprints of 128 bits at 20 or fewer; seven segments find all of these.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import DOCUMENT_COLUMNS, fresh, over_batches, store, table, text_key, utf8
from tracewell.llm.components import components

SEED = 42
#: A key with more fingerprints is dealt out in blocks of this size.
BLOCK = 8192
#: Runs of one key up to this length are compared by shifting, longer ones by spreading from a member.
SHORT = 24
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 15


@dataclass(frozen=True)
class Scheme:
    """Words to a shingle, 64-bit numbers to a fingerprint, the most differing bits of a link, and the segments: each a list of (number, lowest bit, bits)."""

    shingle: int
    numbers: int
    most: int
    segments: tuple[tuple[tuple[int, int, int], ...], ...]

    @property
    def names(self) -> list[str]:
        return [f"f{i}" for i in range(self.numbers)]


QUERY = Scheme(4, 1, 4, (((0, 0, 32),), ((0, 32, 32),)))
STAGE = Scheme(5, 2, 20, (*(((n, 18 * i, 18),) for n in (0, 1) for i in range(3)), ((0, 54, 10), (1, 54, 10))))


def fingerprint(text: bytes, scheme: Scheme = QUERY) -> tuple[int, ...]:
    """The fingerprint as signed 64-bit numbers. Shingles with repeats; fewer words: the whole sequence; no word: zeros."""
    words, k, size = text.lower().split(), scheme.shingle, 8 * scheme.numbers
    if not words:
        return (0,) * scheme.numbers
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if n > k:
        a, b = starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    else:
        a, b = [0], [len(joined)]
    hashed = xxhash.xxh64_digest if scheme.numbers == 1 else xxhash.xxh3_128_digest
    votes = np.zeros(8 * size, np.int64)
    for i in range(0, len(a), COUNTED):
        raw = b"".join([hashed(joined[x:y], SEED) for x, y in zip(a[i : i + COUNTED], b[i : i + COUNTED], strict=True)])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, size), axis=1).sum(0, dtype=np.int64)
    return tuple(np.packbits(2 * votes > len(a)).view(">i8").tolist())


def node_of(fps: np.ndarray) -> np.ndarray:
    """One number for each fingerprint (rows of 64-bit numbers): a single number stands for itself."""
    out = fps[:, 0].copy()
    for i in range(1, fps.shape[1]):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (out >> np.uint64(32))
        out = (out ^ fps[:, i]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, scheme: Scheme = QUERY) -> DataFrame:
    """doc_id, t_key (hash of the text), node, f0, ... Null texts count as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, scheme) for t in batch.column(2).to_pylist()], np.int64).reshape(-1, scheme.numbers).view(np.uint64)
        cols = [pa.array(node_of(fps)), *[pa.array(fps[:, i].view(np.int64)) for i in range(scheme.numbers)]]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "t_key", "node", *scheme.names])

    ddl = "doc_id long, t_key string, node long, " + ", ".join(f"{n} long" for n in scheme.names)
    return over_batches(docs.select("doc_id", text_key(F.col("text")).alias("t_key"), utf8(F.col("text")).alias("text")), run, ddl)


def _values(scheme: Scheme) -> list[tuple[Column, int, int]]:
    """(value, bits, tag) of each segment; the tag lies above all bits of a value."""
    out = []
    for s, parts in enumerate(scheme.segments):
        value, upto = F.lit(0).cast("long"), 0
        for n, low, bits in parts:
            part = F.shiftrightunsigned(f"f{n}", low).bitwiseAND(F.lit((1 << bits) - 1))
            value, upto = value.bitwiseOR(F.shiftleft(part, upto)), upto + bits
        out.append((value, upto, s << 40))
    return out


def _ball(value: Column, bits: int) -> Column:
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(bits)])
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def _keys(fps: DataFrame, scheme: Scheme) -> DataFrame:
    keys = [_ball(v.bitwiseOR(F.lit(tag)), bits) for v, bits, tag in _values(scheme)]
    return fps.select(F.explode(F.concat(*keys)).alias("key"), *scheme.names)


def _hot_keys(fps: DataFrame, scheme: Scheme, block: int) -> DataFrame:
    """key, blocks: the keys that more than `block` fingerprints meet under. Such a key lies within one bit of a segment value that over block / (bits + 1) share."""
    near = None
    for v, bits, tag in _values(scheme):
        often = fps.groupBy(v.bitwiseOR(F.lit(tag)).alias("value")).count().where(F.col("count") > block // (bits + 1))
        part = often.select(F.explode(_ball(F.col("value"), bits)).alias("key"))
        near = part if near is None else near.union(part)
    near = store(near.distinct(), "often")
    if near.isEmpty():
        return near.select("key", F.lit(0).alias("blocks"))
    counted = _keys(fps, scheme).join(near, "key", "left_semi").groupBy("key").count().where(F.col("count") > block)
    return store(counted.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hot-keys")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def linked(fps: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among different fingerprints: spread from a member over those not yet reached."""
    left, out = fps, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = _apart(left, x) <= most
            if near.any():
                got = left[near]
                out.append((np.repeat(x[None], len(got), 0), got))
                front.extend(got)
                left = left[~near]
    return out


def _links(scheme: Scheme):
    most = scheme.most

    def of(key: np.ndarray, fp: np.ndarray):
        """Links within runs of one key; the arrays are sorted by key."""
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[cut, len(key)])
        run = np.repeat(length, length)
        us, vs = [], []
        for d in range(1, SHORT):
            some = (run > d) & (run <= SHORT)
            k, f = key[some], fp[some]
            if len(k) <= d:
                break
            hit = np.flatnonzero(k[d:] == k[:-d])
            hit = hit[_apart(f[hit + d], f[hit]) <= most]
            us.append(f[hit])
            vs.append(f[hit + d])
        for at, n in zip(cut[length > SHORT].tolist(), length[length > SHORT].tolist(), strict=True):
            for u, v in linked(np.unique(fp[at : at + n], axis=0), most):
                us.append(u)
                vs.append(v)
        if not us or not sum(map(len, us)):
            return None
        uv = np.unique(np.stack([node_of(np.concatenate(us)), node_of(np.concatenate(vs))]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(uv[0]), pa.array(uv[1])], ["u", "v"])

    def run(batches):
        fresh()
        key, fp = np.zeros(0, np.int64), np.zeros((0, scheme.numbers), np.uint64)
        for b in batches:
            key = np.concatenate([key, np.asarray(b.column(0))])
            fp = np.concatenate([fp, np.stack([np.asarray(c).view(np.uint64) for c in b.columns[1:]], 1)])
            other = np.flatnonzero(key != key[-1]) if len(key) else key
            last = int(other[-1]) + 1 if len(other) else 0
            if last:  # the last run may go on in the next batch
                if (out := of(key[:last], fp[:last])) is not None:
                    yield out
                key, fp = key[last:], fp[last:]
        if len(key) and (out := of(key, fp)) is not None:
            yield out

    return run


def links(fps: DataFrame, scheme: Scheme = QUERY, block: int = BLOCK) -> DataFrame:
    """(u, v) among the nodes of different fingerprints (f0, ...): links whose components are those of all pairs within the scheme's distance."""
    hot = _hot_keys(fps, scheme, block)
    keyed = _keys(fps, scheme)
    if hot.count():
        own = F.pmod(F.xxhash64(*scheme.names), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
        cool = keyed.join(hot, "key", "left_anti").select("key", *scheme.names)
        dealt = keyed.join(hot, "key").select("key", *scheme.names, F.explode(pairs).alias("p"))
        dealt = dealt.select(F.xxhash64("key", "p").bitwiseOR(F.lit(1 << 50)).alias("key"), *scheme.names)
        keyed = cool.union(dealt)
    met = keyed.repartition("key").sortWithinPartitions("key")
    return store(met.mapInArrow(_links(scheme), "u long, v long"), "links")


def near_duplicates(docs: DataFrame, scheme: Scheme = QUERY) -> DataFrame:
    """doc_id, t_key, node, f0, ..., component_id: the smallest doc_id reachable over links, the document's own included.

    One row per row of docs. A null doc_id is never the smallest unless its component has no other, then component_id is
    null. Texts without a word have a fingerprint of zeros and are linked like any other. No rows give no rows.
    """
    rows = store(fingerprints(docs, scheme), "fingerprints")
    nodes = store(rows.groupBy(*dict.fromkeys(["node", *scheme.names])).agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select(*scheme.names), scheme)).select(F.col("node").alias("r_node"), "root")
    rooted = store(nodes.join(roots, F.col("node") == F.col("r_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = store(rooted.select("node", "root").join(ids, "root").select(F.col("node").alias("c_node"), "root", "component_id"), "component-ids")
    return rows.join(ids, F.col("node") == F.col("c_node")).select("doc_id", "t_key", "node", *scheme.names, "root", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and component. Null texts count as empty, equal rows get equal results, no rows give none."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, the one with the smallest (doc_id, text hash); of rows equal in both, one.

    A null doc_id comes last. Texts without a word are one component. No rows give none; further columns of docs go.
    """
    found = store(near_duplicates(docs, STAGE), "near-duplicates")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t_key")).alias("best")
    kept = found.groupBy("root").agg(best).select(F.col("best.doc_id").alias("k_id"), F.col("best.t_key").alias("k_key"))
    kept = store(kept, "kept")
    mine = docs.withColumn("t_key", text_key(F.col("text")))
    stay = mine.join(kept, mine["doc_id"].eqNullSafe(kept["k_id"]) & (mine["t_key"] == kept["k_key"]), "left_semi")
    again = found.join(kept, found["doc_id"].eqNullSafe(kept["k_id"]) & (found["t_key"] == kept["k_key"]), "left_semi").groupBy("doc_id", "t_key").count().where("count > 1")
    if not again.isEmpty():
        stay = stay.dropDuplicates(["doc_id", "t_key"])
    return stay.select(*DOCUMENT_COLUMNS)
