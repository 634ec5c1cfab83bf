"""Operator 3: benchmark decontamination by a prefix-filtered set join.

A window of an item (its `window` consecutive words, or the whole of a shorter item) is a set of positioned shingles. A document that holds the
window holds all its shingles, so the necessary prefix of each window, in the order of rarity in the documents, is its rarest shingle alone.
Prefix shingles are joined to the documents' shingles by hash; a match fixes the alignment, so bounds on position and length (the window must
lie inside the document's words) drop candidates before the words of the window are compared one by one, first by hash, then by their bytes.

The benchmark goes to executors in blocks of at most `block_words` words, each a pass over the documents, so what is broadcast has a fixed bound.

Defined results: null or empty text has no words and no hits; items without words have no windows; repeated items count by their item_id,
once each; null item_ids are left out. Rows of documents that repeat a doc_id are judged each by their own text. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, released, text_bytes
from .textscan import LOWER, NOT_ALNUM, Rolling, word_hashes, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())
WINDOW = 13
SHINGLE = 3
CHUNK = 1 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, salt long"


class Spelled:
    """The bytes of a text's words."""

    def __init__(self, raw: bytes, start: np.ndarray, end: np.ndarray):
        self.raw, self.start, self.end = raw, start, end

    def __getitem__(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]


class Block:
    """Some benchmark items' words (their hashes and bytes) and the shingles of their windows."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        self.window, self.shingle = window, shingle
        self.ids, self.spelled, rows = [], [], []
        for item, text in items:
            raw = " ".join(WORD.findall(text.translate(FOLD))).encode("utf-8")
            data = np.frombuffer(raw, np.uint8)
            start, end, _ = words(data, np.array([0, len(data)]), NOT_ALNUM)
            if len(start):
                self.ids.append(item)
                self.spelled.append(Spelled(raw, start, end))
                rows.append(word_hashes(data, start, end))
        self.words = rows
        #: Every shingle of every item that a window may choose, as (hash, item, place).
        found = [(h, i, p) for i, row in enumerate(rows) for p, h in enumerate(self.grams(row))]
        self.hashes = np.array(sorted({h for h, _, _ in found}), np.uint64)
        self.where: dict[int, list[tuple[int, int]]] = {}
        for h, i, p in found:
            self.where.setdefault(h, []).append((i, p))

    def grams(self, row: np.ndarray) -> list[int]:
        return Rolling(row).grams(min(self.shingle, len(row))).tolist()

    def prefixes(self, counts: dict[int, int]) -> dict[int, dict[int, list[tuple[int, int, int]]]]:
        """By shingle length: the rarest shingle of each window -> (item, its place, first window, last window)."""
        out: dict[int, dict[int, list]] = {}
        for i, row in enumerate(self.words):
            k, length = min(self.shingle, len(row)), min(self.window, len(row))
            grams = self.grams(row)
            cost = [(counts.get(h, 0), h) for h in grams]
            chosen: dict[int, list[int]] = {}
            for w in range(len(row) - length + 1):
                place = min(range(w, w + length - k + 1), key=lambda p: (cost[p], p))
                chosen.setdefault(place, []).append(w)
            for place, ws in chosen.items():
                out.setdefault(k, {}).setdefault(grams[place], []).append((i, place, ws[0], ws[-1]))
        return out


def _scan(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Spelled]]:
    """(first row, end row, word hashes, bounds of each row's words, the words) for slices of the batch."""
    data, offsets = text_bytes(batch.column(column))
    for i, j in chunks(offsets, CHUNK):
        part = LOWER[data[offsets[i] : offsets[j]]]
        start, end, bounds = words(part, offsets[i : j + 1] - offsets[i], NOT_ALNUM)
        yield i, j, word_hashes(part, start, end), bounds, Spelled(part.tobytes(), start, end)


def shingle_counts(docs: DataFrame, block: Block) -> dict[int, int]:
    """Occurrences in all documents of the block's shingles: at most as many rows as the block has shingles."""
    lengths = sorted({min(block.shingle, len(r)) for r in block.words})
    known = block.hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, hashes, _, _ in _scan(batch, 0):
                rolling = Rolling(hashes)
                for k in lengths:
                    grams = rolling.grams(k)
                    at = np.searchsorted(known, grams)
                    at[at == len(known)] = 0
                    total += np.bincount(at[known[at] == grams], minlength=len(known))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[hit].view(np.int64)), pa.array(total[hit])], names=["h", "n"])

    if not len(known):
        return {}
    rows = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    return {r["h"] % 2**64: r["n"] for r in rows}


def found(docs: DataFrame, block: Block, counts: dict[int, int], alone: bool) -> DataFrame:
    """doc_id, salt, n_words, hit (bytes of (first, end) int64 runs of hit words), items (those with occurring windows); of a block that is alone, the rows of RESULT at once."""
    tables = []
    for k, entries in sorted(block.prefixes(counts).items()):
        tables.append((k, np.array(sorted(entries), np.uint64), [entries[h] for h in sorted(entries)]))
    shared = docs.sparkSession.sparkContext.broadcast((tables, block.words, block.spelled, block.ids, block.window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        tables, item_words, spelled, ids, window = shared.value
        for batch in batches:
            n_words, hits, items, told = [], [], [], [[], [], [], []]
            for i, j, hashes, bounds, own in _scan(batch, 1):
                runs: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
                named: list[set[str]] = [set() for _ in range(j - i)]
                rolling = Rolling(hashes)
                for k, known, entries in tables:
                    grams = rolling.grams(k)
                    at = np.searchsorted(known, grams)
                    at[at == len(known)] = 0
                    for p in np.flatnonzero(known[at] == grams).tolist():
                        d = int(np.searchsorted(bounds, p, "right")) - 1
                        low, high = int(bounds[d]), int(bounds[d + 1])
                        for item, place, first, last in entries[at[p]]:
                            row = item_words[item]
                            length, zero = min(window, len(row)), p - place
                            # Bounds: the windows that lie inside this document.
                            first, last = max(first, low - zero), min(last, high - length - zero)
                            if first > last:
                                continue
                            same = row[first : last + length] == hashes[zero + first : zero + last + length]
                            whole = complete(same, length) + first
                            if len(whole):
                                for w in range(int(whole[0]), int(whole[-1]) + length):
                                    same[w - first] = same[w - first] and spelled[item][w] == own[zero + w]
                                whole = complete(same, length) + first
                            if len(whole):
                                named[d].add(ids[item])
                                runs[d] += [(zero + w - low, zero + w - low + length) for w in whole.tolist()]
                for d in range(j - i):
                    n_words.append(int(bounds[d + 1] - bounds[d]))
                    if alone:
                        for values, v in zip(told, verdict(runs[d], named[d], n_words[-1]), strict=True):
                            values.append(v)
                    else:
                        hits.append(np.array(merged(runs[d]), "<i8").tobytes())
                        items.append(sorted(named[d]))
            if alone:
                yield told_batch(batch.column(0), pa.array(n_words, pa.int64()), told, batch.column(2))
                continue
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "salt", "n_words", "hit", "items"])

    return docs.select("doc_id", "text", "salt").mapInArrow(run, RESULT if alone else "doc_id long, salt long, n_words long, hit binary, items array<string>")


def complete(same: np.ndarray, length: int) -> np.ndarray:
    """The places from which on `length` words in a row are the same."""
    return np.flatnonzero(np.convolve(same, np.ones(length, np.int32), "valid") == length)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def verdict(runs: list[tuple[int, int]], items: set[str], n_words: int, share: int = 20) -> tuple[int, int, str, bool]:
    """n_hit, n_items, items_sha256, contaminated."""
    n_hit = sum(b - a for a, b in merged(runs))
    return n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0 and share * n_hit >= n_words


def told_batch(doc_id: pa.Array, n_words: pa.Array, told: list[list], salt: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(v, t) for v, t in zip(told, (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
    return pa.RecordBatch.from_arrays([doc_id, n_words, *columns, salt], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "salt"])


def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, n_words, hits, items: lists over the blocks; salt)."""
    for batch in batches:
        told: list[list] = [[], [], [], []]
        for r in batch.to_pylist():
            runs = [tuple(x) for h in r["hits"] for x in np.frombuffer(h, "<i8").reshape(-1, 2).tolist()]
            for values, v in zip(told, verdict(runs, set(r["items"]), r["n_words"]), strict=True):
                values.append(v)
        yield told_batch(batch.column(0), batch.column(1), told, batch.column(4))


def blocks_of(benchmark: DataFrame, window: int, shingle: int, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks, read one partition at a time; items longer than a block stand alone."""
    items: list[tuple[str, str]] = []
    held = 0
    rows = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    for r in rows.toLocalIterator():
        n = len(r["text"]) // 2 + 1
        if items and held + n > block_words:
            yield Block(items, window, shingle)
            items, held = [], 0
        items.append((r["item_id"], r["text"]))
        held += n
    yield Block(items, window, shingle)


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = 500_000) -> DataFrame:
    """contamination() with salt, the text's xxhash64: rows that share a doc_id have each their own verdict."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("salt"))
    blocks = list(blocks_of(benchmark, window, shingle, block_words))
    parts = [found(docs, b, shingle_counts(docs, b), len(blocks) == 1) for b in blocks]
    if len(parts) == 1:
        return parts[0]
    # One pass a block over the same rows: put each row's parts together by its id and text; equal rows come back as often as they were.
    both = parts[0].withColumn("first", F.lit(1))
    for p in parts[1:]:
        both = both.union(p.withColumn("first", F.lit(0)))
    found_all = both.groupBy("doc_id", "salt", "n_words").agg(F.collect_list("hit").alias("hits"), F.flatten(F.collect_list("items")).alias("items"), F.sum("first").cast("int").alias("times"))
    rows = found_all.withColumn("time", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("doc_id", "n_words", "hits", "items", "salt")
    return rows.mapInArrow(verdicts, RESULT)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row per row of docs (doc_id, text)."""
    return judged(docs, benchmark, window, shingle, block_words).drop("salt")


def op3_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark)
