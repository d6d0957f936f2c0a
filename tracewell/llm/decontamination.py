"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and their white space runs become one space. A test item of m characters allows k = m * RATE edits
and is split into k + 1 pieces: wherever the item occurs with at most k edits, one piece occurs unchanged. An
Aho-Corasick automaton finds the pieces, and Myers' bit-parallel distance verifies the surroundings of each hit. An item
too short for any edit counts where it stands between spaces. Items go out in blocks of bounded size; a block takes one
pass over the documents and no shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import DOCUMENT_COLUMNS, slices, table, utf8

RATE = 0.05
#: Test items go out in blocks of so many characters (an automaton takes some 50 bytes a character); each block meets all documents.
BLOCK_CHARS = 4 << 20


def normalised(text: bytes) -> str:
    return " ".join(text.decode("utf-8", "replace").lower().split())


def item_blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """(item_id, normalised text) in blocks, in the order of item_id; null and blank items are left out."""
    block, size = [], 0
    for r in benchmark.select("item_id", utf8(F.col("text")).alias("text")).orderBy("item_id", "text").toLocalIterator():
        text = normalised(bytes(r.text))
        if not text:
            continue
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((r.item_id, text))
        size += len(text)
    if block:
        yield block


def myers(masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """Least distance of the pattern to any part of the text, and the first end where it is reached; None if above k."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, k + 1, -1
    left = len(text)
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
            if not best:
                break
        left -= 1
        if score - left > k and best > k:  # it can fall by one a character at most
            return None
    return (best, end) if best <= k else None


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        ids = defaultdict(list)
        for i, text in items:
            ids[text].append(i)
        self.items = [(text, int(len(text) * rate), own) for text, own in ids.items()]
        where = defaultdict(list)
        self.masks: list[dict[str, int]] = []
        for n, (text, k, _) in enumerate(self.items):
            cuts = [j * len(text) // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                where[text[a:b]].append((n, a))
            masks: dict[str, int] = defaultdict(int)
            for j, c in enumerate(text):
                masks[c] |= 1 << j
            self.masks.append(dict(masks))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def found(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item number, distance, end in the normalised text) of each item in the text: the least distance, and of equal ones the first."""
        if self.empty:
            return
        begins = defaultdict(set)
        for end, (size, at) in self.automaton.iter(text):
            for n, offset in at:
                if self.items[n][1] or self._apart(text, end + 1 - size, end + 1):
                    begins[n].add(end + 1 - size - offset)
        for n, all_begins in begins.items():
            pattern, k, _ = self.items[n]
            if not k:
                yield n, 0, min(all_begins) + len(pattern)
                continue
            best = None
            for a, b in self._merged(sorted(all_begins), k):
                low = max(0, a - k)
                got = myers(self.masks[n], len(pattern), text[low : b + len(pattern) + k], k)
                if got and (best is None or got[0] < best[0]):
                    best = got[0], low + got[1]
                    if not best[0]:
                        break
            if best:
                yield n, *best

    @staticmethod
    def _apart(text: str, a: int, b: int) -> bool:
        return (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")

    @staticmethod
    def _merged(begins: list[int], k: int) -> list[list[int]]:
        out = [[begins[0], begins[0]]]
        for b in begins[1:]:
            if b - out[-1][1] <= k:
                out[-1][1] = b
            else:
                out.append([b, b])
        return out


def matches(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end): one row for each document and test item that it holds within the item's edit budget.

    Null and empty texts hold none. Equal items are reported each, repeated rows each. Empty tables give no rows.
    """
    texts, share = docs.select("doc_id", utf8(F.col("text")).alias("text")), docs.sparkSession.sparkContext.broadcast
    out = None
    for block in item_blocks(benchmark, block_chars):
        part = texts.mapInArrow(_matching(share(block)), "doc_id long, item_id long, distance int, end long")
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, end long")


def _matching(block):
    def run(batches):
        m = Matcher(block.value)
        for b in slices(batches):
            rows = [(i, item, d, e) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, d, e in m.found(normalised(t)) for item in m.items[n][2]]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "end"])

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no test item. Null and empty texts hold none; empty tables remove nothing."""
    share = docs.sparkSession.sparkContext.broadcast
    for block in item_blocks(benchmark, block_chars):
        docs = docs.select(*[docs[c] for c in docs.columns], utf8(docs["text"])).mapInArrow(_clean(share(block)), docs.schema)
    return docs


def _clean(block):
    def run(batches):
        m = Matcher(block.value)
        for b in slices(batches, lambda x: x.column(x.num_columns - 1)):
            clean = [next(m.found(normalised(t)), None) is None for t in b.column(b.num_columns - 1).to_pylist()]
            if any(clean):
                kept = b.filter(pa.array(clean))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], kept.schema.names[:-1])

    return run


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item. Odd rows as in matches."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark item stay, null and empty texts and repeated rows among them; further columns of docs go."""
    return decontaminated(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))
