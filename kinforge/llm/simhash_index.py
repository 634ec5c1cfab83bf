"""Operator 8: SimHash near-duplicates by an inverted index over byte positions, with count filtering.

A 64-bit fingerprint is 8 bytes, each a token (position, value). Two fingerprints that differ in at most `max_bits` bits share at least
8 - max_bits of these tokens. The index posts each distinct fingerprint under combinations of `probe` positional bytes taken from its first
8 - (needed - probe) positions: a pair that shares `needed` bytes shares at least `probe` of them there. In each posting list the shared
bytes of a pair are tallied, pairs that reach the guaranteed minimum are kept and verified by their Hamming distance.

A list of k fingerprints costs k * k / 2 tallies, so lists longer than `list_limit` (a dense cluster: by chance three bytes are shared by one pair in
2 ** 24) are decided exactly in another way, linear in the list: two fingerprints differ in at most 2r bits just if some 64-bit value is within
r bits of both, so these are linked through all values near them. For 4 bits that is 1 + 64 + 2016 = 2,081 rows a fingerprint; going on with
count filtering over finer positions would take more, 70 combinations of four bytes times 70 of the other eight half bytes = 4,900 rows. Both ways
give the links of the definition, whatever the limit is.

Links run between distinct fingerprints; rows with the same fingerprint only share a node. Components come from star contraction.

Defined results: null or empty text has fingerprint zero, linked like any other; rows with a null doc_id get the component of their fingerprint and
don't name it unless all its rows are null (then component_id is null); repeated rows share a fingerprint; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_texts, written

UPPER = bytes(range(65, 91))
FOLD = bytes.maketrans(UPPER, UPPER.lower())


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included; none: 0."""
    words = text.translate(FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    ones, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, 65536):
        block = np.array(hashes[i : i + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle, seed) for t in row_texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def posted(fps: DataFrame, max_bits: int, probe: int) -> DataFrame:
    """(key, fp): each fingerprint under each combination of `probe` positional bytes that a linked pair may share."""
    needed = 8 - max_bits
    places = list(combinations(range(8 - (needed - probe)), probe))
    keys = []
    for n, chosen in enumerate(places):
        mask = sum(0xFF << (8 * (7 - p)) for p in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(n).alias("combo"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bytes")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.combo", "key.bytes", "fp")


def _stars(max_bits: int, needed: int):
    """Of each posting list: tally shared positional bytes, keep pairs with enough, verify, and emit each of the list's components as a star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            offsets = batch.column(0).offsets.to_numpy()
            values = batch.column(0).values.to_numpy().view(np.uint64)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                fps = np.unique(values[a:b])
                label = np.arange(len(fps))
                octets = fps.byteswap().view(np.uint8).reshape(-1, 8)
                for i in range(len(fps) - 1):
                    shared = (octets[i + 1 :] == octets[i]).sum(1)
                    near = np.flatnonzero(shared >= needed) + i + 1
                    near = near[np.bitwise_count(fps[near] ^ fps[i]) <= max_bits]
                    if len(near):
                        names = np.unique(label[np.append(near, i)])
                        if len(names) > 1:
                            label[np.isin(label, names)] = names[0]
                            left.append(fps[names[1:]])
                            right.append(np.full(len(names) - 1, fps[names[0]]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left).view(np.int64)), pa.array(np.concatenate(right).view(np.int64))], names=["a", "b"])

    return run


def _balls(radius: int):
    """(point, fp) for every 64-bit value within radius bits of each fingerprint."""
    flips = np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(all_fps), 128):
                fps = all_fps[i : i + 128]
                points = (fps[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64)), pa.array(np.repeat(fps, len(flips)).view(np.int64))], names=["point", "fp"])

    return run


def links(fps: DataFrame, max_bits: int = 4, probe: int = 3, list_limit: int = 4096) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of distinct fingerprints within max_bits."""
    needed = 8 - max_bits
    if not 0 < probe <= needed:
        raise ValueError("max_bits leaves too few shared bytes for this probe")
    if max_bits % 2:  # an odd bound: the two balls of radius r and r - 1 would be needed; tell them apart by parity
        raise ValueError("max_bits must be even")
    by_key = Window.partitionBy("combo", "bytes")
    some = written(posted(fps, max_bits, probe).withColumn("n", F.count(F.lit(1)).over(by_key)).filter("n > 1"), "postings")
    lists = some.filter(F.col("n") <= list_limit).groupBy("combo", "bytes").agg(F.collect_list("fp").alias("fps")).select("fps")
    stars = lists.mapInArrow(_stars(max_bits, needed), "a long, b long")
    radius = (max_bits + 1) // 2
    hot = some.filter(F.col("n") > list_limit).select("fp").distinct()
    points = hot.mapInArrow(_balls(radius), "point long, fp long")
    centres = points.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top")
    near = points.join(centres, "point").filter("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    return stars.union(near)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each edge-connected component, by alternating large and small stars."""
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        around = both(e)
        least = around.groupBy("a").agg(F.min("b").alias("m"))
        low = least.select("a", F.least("a", "m").alias("m"))
        return around.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        return down.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()

    signature = [F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))]
    edges = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = tuple(edges.agg(*signature).first())
    for _ in range(most_rounds if before[0] else 0):
        edges = written(small(large(edges)), "edges")
        now = tuple(edges.agg(*signature).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    if before[0]:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, max_bits: int = 4, shingle: int = 4, seed: int = 42, list_limit: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of docs."""
    prints = written(fingerprints(docs, shingle, seed), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select("fp"), max_bits, list_limit=list_limit))
    # Written, so that the join on root is of plain exchanges and a large component's rows can be split.
    rooted = written(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
