"""Shared flow of the exact repeat operators 1 and 2: find the regions of texts whose windows may repeat, and bring equal ones together.

Every window of a fixed length chooses an anchor inside itself by its contents alone (textscan.anchored), so equal windows choose equal anchors,
at equal offsets. A region is a run of windows with one anchor. Only regions whose anchor's hash occurs again can hold a repeated window; those
are grouped into classes of equal contents (told apart by XXH3-128 of the contents' bytes), and each class's bytes are fetched once, for its
first region. Classes that share an anchor meet in one task, where the operator's own method compares their bytes; a region that is not the
first of its class is decided by its class.

An anchor that more than `hot_classes` different classes share (a very common phrase with different neighbours) would gather without bound in a
task. Its classes are cut again, by one more anchor that each window chooses in another order of the grams, and these parts meet by both
anchors: the same method decides them, in more and smaller shards. What is still hot is cut once more, up to `LEVELS` times, and then into single
windows that meet by their own contents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_bytes, written
from .textscan import Rolling, anchored, covered_runs, mixed

#: Bytes scanned together, and units of a long text scanned at a time.
CHUNK, PIECE = 1 << 20, 1 << 20
HOT_CLASSES, LEVELS = 2000, 6
CLASS = ["h", "c0", "c1", "n"]
ANCHORS = "doc_id long, salt long, start int, n int, h long, c0 long, c1 long"


@dataclass
class Scan:
    """How an operator sees texts: a window is `length` units, an anchor `gram` of them.

    bytes_of(column) -> the texts' bytes as compared, and their n + 1 offsets. units(data, offsets) -> where each text's units begin (n + 1), the
    bytes that each unit goes from and to, and a function (a, b) -> the 64-bit hashes of units a to b.
    """

    units: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[int, int], np.ndarray]]]
    length: int
    gram: int
    bytes_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]] = text_bytes


@dataclass
class Rules:
    """An operator's decisions: decide(rows of a shard) -> for each row's windows, which are marked; always: the regions whose windows are all marked, of (times, first, doc_id, salt, start)."""

    decide: Callable[[list[dict]], list[np.ndarray]]
    always: Callable[[], object]
    shard_bytes: int
    hot_classes: int


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def digests(raw: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """XXH3-128 of raw[first:last], as two 64-bit values each."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]), "<i8").reshape(-1, 2)


def anchors(docs: DataFrame, scan: Scan, hashes_only: bool = False) -> DataFrame:
    """Each region of each document: its first window, number of windows, anchor hash, contents' digest (or the anchor hash alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, salts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = scan.bytes_of(batch.column(2))
            for i, j in chunks(offsets, CHUNK):
                part = data[offsets[i] : offsets[j]]
                raw = part.tobytes()
                bounds, low, high, units = scan.units(part, offsets[i : j + 1] - offsets[i])
                for p in range(0, int(bounds[-1]), PIECE):  # a longer text in pieces, whose windows start in [p, p + PIECE)
                    q = min(int(bounds[-1]), p + PIECE + scan.length - 1)
                    grams = Rolling(units(p, q)).grams(scan.gram)
                    doc, first, n, place = anchored(grams, np.clip(bounds, p, q) - p, scan.length, scan.gram)
                    if len(doc) and hashes_only:
                        yield pa.RecordBatch.from_arrays([_long(grams[place])], names=["h"])
                    elif len(doc):
                        first, hashes = first + p, grams[place]
                        c = digests(raw, low[first], high[first + n + scan.length - 2])
                        columns = [pa.array(ids[i + doc]), pa.array(salts[i + doc]), pa.array((first - bounds[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), _long(hashes), pa.array(c[:, 0]), pa.array(c[:, 1])]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "salt", "start", "n", "h", "c0", "c1"])

    return docs.select("doc_id", "salt", "text").mapInArrow(run, "h long" if hashes_only else ANCHORS)


def repeated_anchors(docs: DataFrame, scan: Scan) -> DataFrame:
    """The regions whose anchor hash occurs in another region too, written to the shared folder."""
    # Written, so that both sides of the join are plain exchanges and adaptive execution can split a hot anchor's rows.
    again = written(anchors(docs, scan, hashes_only=True).groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("h"), "again")
    return written(anchors(docs, scan).join(again, "h").select("doc_id", "salt", "start", *CLASS[3:], *CLASS[:3]), "regions")


def classes(regions: DataFrame) -> DataFrame:
    """(CLASS, times, first: the least (doc_id, salt, start)): the different contents of each anchor."""
    return regions.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "salt", "start")).alias("first"))


BODIES = {"h": pa.int64(), "c0": pa.int64(), "c1": pa.int64(), "n": pa.int32(), "times": pa.int64(), "doc_id": pa.int64(), "salt": pa.int64(), "start": pa.int32(), "body": pa.binary()}
BODIES_SQL = "h long, c0 long, c1 long, n int, times long, doc_id long, salt long, start int, body binary"


def fetched(docs: DataFrame, found: DataFrame, scan: Scan) -> DataFrame:
    """BODIES: each class with the place and the bytes of its first region."""
    wanted = found.select("first.doc_id", "first.salt", F.struct(F.col("first.start").alias("start"), *CLASS, "times").alias("r")).groupBy("doc_id", "salt").agg(F.collect_list("r").alias("rs"))
    once = docs.select("doc_id", "salt", "text").join(wanted, ["doc_id", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: tuple | None = None
        for batch in batches:
            data, offsets = scan.bytes_of(batch.column(2))
            ids, salts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists = batch.column(3)
            flat, at = lists.flatten(), lists.offsets.to_numpy()
            col = {name: flat.field(k).to_numpy(zero_copy_only=False) for k, name in enumerate(("start", *CLASS, "times"))}
            out: list[list] = [[] for _ in BODIES]
            size = 0
            for d in range(batch.num_rows):
                if (ids[d], salts[d]) == done:  # a repeated row: its text was fetched already
                    continue
                done = (ids[d], salts[d])
                text = data[offsets[d] : offsets[d + 1]]
                _, low, high, _ = scan.units(text, np.array([0, len(text)]))
                raw = text.tobytes()
                for k in range(int(at[d] - at[0]), int(at[d + 1] - at[0])):
                    start, n = int(col["start"][k]), int(col["n"][k])
                    body = raw[low[start] : high[start + n + scan.length - 2]]
                    size += len(body)
                    for values, v in zip(out, (col["h"][k], col["c0"][k], col["c1"][k], n, col["times"][k], ids[d], salts[d], start, body), strict=True):
                        values.append(v)
                    if size > 4 * CHUNK:
                        yield table_of(BODIES, out)
                        out, size = [[] for _ in BODIES], 0
            if out[0]:
                yield table_of(BODIES, out)

    # Rows of one (doc_id, salt) come from one task of the join, side by side.
    return once.sortWithinPartitions("doc_id", "salt").mapInArrow(run, BODIES_SQL)


def table_of(kinds: dict[str, pa.DataType], columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


MARKED = "h long, c0 long, c1 long, n int, marks binary"


def by_shard(bodies: DataFrame, rules: Rules) -> DataFrame:
    """MARKED: what the operator decides of groups of classes, all classes of an anchor together; marks: a bit for each window of the class's first region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def decided() -> pa.RecordBatch:
            marks = [np.packbits(m).tobytes() for m in rules.decide(held)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], BODIES[k]) for k in CLASS] + [pa.array(marks, pa.binary())], names=[*CLASS, "marks"])

        for batch in batches:
            for r in batch.to_pylist():
                if size > rules.shard_bytes and r["h"] != held[-1]["h"]:
                    yield decided()
                    held, size = [], 0
                held.append(r)
                size += len(r["body"])
        if held:
            yield decided()

    return bodies.select(*BODIES).repartition("h").sortWithinPartitions("h").mapInArrow(run, MARKED)


PARTS = {"ph": pa.int64(), "pc0": pa.int64(), "pc1": pa.int64(), "pn": pa.int32(), "at": pa.int32()} | BODIES
PARTS_SQL = "ph long, pc0 long, pc1 long, pn int, at int, " + BODIES_SQL


def cut_again(bodies: DataFrame, scan: Scan, level: int) -> DataFrame:
    """Each class's windows in parts that choose one more anchor each, by another order of the grams (at the last level: single windows): the class, the part's first window in it, and the part as a class."""
    seed = mixed(np.array([level], np.uint64))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in PARTS]
            size = 0
            for r in batch.to_pylist():
                data = np.frombuffer(r["body"], np.uint8)
                bounds, low, high, units = scan.units(data, np.array([0, len(data)]))
                if level >= LEVELS:
                    first, n = np.arange(r["n"]), np.ones(r["n"], np.int64)
                else:
                    grams = mixed(Rolling(units(0, int(bounds[-1]))).grams(scan.gram) ^ seed)
                    _, first, n, place = anchored(grams, bounds, scan.length, scan.gram)
                c = digests(r["body"], low[first], high[first + n + scan.length - 2])
                h = (c[:, 0] if level >= LEVELS else mixed(grams[place] + np.uint64(r["h"] % 2**64)).view(np.int64)).tolist()
                for k, (a, m) in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
                    body = r["body"][low[a] : high[a + m + scan.length - 2]]
                    size += len(body)
                    row = (r["h"], r["c0"], r["c1"], r["n"], a, h[k], int(c[k, 0]), int(c[k, 1]), m, r["times"], r["doc_id"], r["salt"], r["start"] + a, body)
                    for values, v in zip(out, row, strict=True):
                        values.append(v)
                    if size > 4 * CHUNK:
                        yield table_of(PARTS, out)
                        out, size = [[] for _ in PARTS], 0
            if out[0]:
                yield table_of(PARTS, out)

    return bodies.select(*BODIES).mapInArrow(run, PARTS_SQL)


def composed(parts: DataFrame) -> DataFrame:
    """MARKED, of rows (ph, pc0, pc1, pn, at, n, marks; null: all marked) of classes' parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for n, ps in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                bits = np.zeros(n, bool)
                for p in ps:
                    bits[p["at"] : p["at"] + p["n"]] = True if p["marks"] is None else np.unpackbits(np.frombuffer(p["marks"], np.uint8))[: p["n"]]
                marks.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(marks, pa.binary())], names=[*CLASS, "marks"])

    keys = [F.col(f"p{k}").alias(k) for k in CLASS]
    return parts.groupBy(*keys).agg(F.collect_list(F.struct("at", "n", "marks")).alias("ps")).mapInArrow(run, MARKED)


def told(bodies: DataFrame, marks: DataFrame) -> DataFrame:
    """(CLASS, times, first, marks) of each class."""
    return written(bodies.select(*CLASS, "times", F.struct("doc_id", "salt", "start").alias("first")).join(marks, CLASS, "left"), "told")


def decided(bodies: DataFrame, scan: Scan, rules: Rules, level: int = 0) -> DataFrame:
    """told() of BODIES (written): hot anchors' classes are cut again, all others go to their shards."""
    hot = written(bodies.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > rules.hot_classes).select("h"), "hot")
    if level >= LEVELS or hot.isEmpty():
        return told(bodies, by_shard(bodies, rules))
    marks = by_shard(bodies.join(hot, "h", "left_anti"), rules)
    parts = written(cut_again(bodies.join(hot, "h", "left_semi"), scan, level + 1), "parts")
    least = F.min(F.struct("doc_id", "salt", "start")).alias("f")
    made = parts.groupBy(*CLASS).agg(F.sum("times").alias("times"), least, F.any_value("body").alias("body"))
    deeper = decided(written(made.select(*CLASS, "times", "f.doc_id", "f.salt", "f.start", "body"), "bodies"), scan, rules, level + 1)
    each = parts.drop("times").join(deeper, CLASS).withColumn("marks", F.when(~rules.always(), F.coalesce("marks", F.lit(b""))))
    return told(bodies, marks.union(composed(each)))


def marked_windows(regions: DataFrame, known: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, salt, rs: list of (start, n, marks)) of each document with regions; marks null: all windows."""
    each = regions.join(known, CLASS).select("doc_id", "salt", "start", "n", F.when(~rules.always(), F.coalesce("marks", F.lit(b""))).alias("marks"))
    kept = each.filter(F.col("marks").isNull() | (F.ltrim(F.hex("marks"), F.lit("0")) != ""))
    return kept.groupBy("doc_id", "salt").agg(F.collect_list(F.struct("start", "n", "marks")).alias("rs"))


def repeats(docs: DataFrame, scan: Scan, rules: Rules) -> DataFrame:
    """marked_windows() of docs (doc_id, salt, text)."""
    found = repeated_anchors(docs, scan)
    bodies = written(fetched(docs, classes(found), scan), "bodies")
    return marked_windows(found, decided(bodies, scan, rules), rules)


def window_runs(rs: list[dict] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The covered runs of units (first, end) of a document's marked windows."""
    first, last = [], []
    for r in rs or ():
        if r["marks"] is None:
            first.append(np.array([r["start"]]))
            last.append(np.array([r["start"] + r["n"] - 1 + length]))
        else:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(r["marks"], np.uint8))[: r["n"]])
            if len(at):
                cut = np.flatnonzero(np.diff(at) > 1)
                first.append(r["start"] + at[np.concatenate(([0], cut + 1))])
                last.append(r["start"] + at[np.append(cut, len(at) - 1)] + length)
    return covered_runs(np.concatenate(first), np.concatenate(last)) if first else (np.zeros(0, np.int64), np.zeros(0, np.int64))
