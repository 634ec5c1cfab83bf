"""Operator 1: suffix-array dedup of repeated byte strings.

Removes each byte covered by a `length`-byte string that also starts anywhere else, in any document. The texts' regions that may repeat
(see regions) meet in shards; in each shard the suffixes at their window starts are sorted in two stages: suffixes smaller than their
successors are sorted directly, all others are induced from them by one scan over the buckets of first bytes; then the common prefixes of
neighbours are computed, and a window repeats where one reaches `length`, or where its region's contents occur more than once.

Defined results: null text is empty; a text shorter than `length` keeps all; rows equal in doc_id and text are repeats of each other;
rows that share a doc_id with different texts are documents of their own; null doc_ids stay null; other columns of docs are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import regions as R
from .common import keyed_text, shown_id
from .textscan import byte_units, kept_bytes

LENGTH, GRAM = 200, 32
SHARD_BYTES = 1_500_000


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix: is it smaller than its successor? The last is not."""
    step = np.zeros(len(text), np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1:] = -1
    # In a run of one byte, the first different byte after it decides.
    at = np.where(step != 0, np.arange(len(text)), len(text))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def two_stage_order(text: np.ndarray, needed: np.ndarray, depth: int) -> np.ndarray:
    """The needed suffixes in order of their first `depth` bytes at least (equal ones side by side).

    A needed suffix that is not smaller than its successor must have a needed successor, unless it is the last of the text.
    """
    n = len(text)
    small = smaller_than_next(text)
    direct = np.flatnonzero(needed & small)
    padded = np.zeros(n + depth, np.uint8)
    padded[:n] = text
    if len(direct):
        keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
        direct = direct[np.argsort(np.ascontiguousarray(keys).view(f"S{depth}").ravel(), kind="stable")]
    # Bucket of each first byte: induced suffixes first, then the directly sorted ones.
    sorted_first = text[direct]
    ends = np.searchsorted(sorted_first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and needed[n - 1]:
        induced[int(text[n - 1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        waves = []
        while len(wave):  # predecessors in the same bucket, one longer run of c at a time
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & needed[before]]
        bucket = np.concatenate([*waves, direct[ends[c] : ends[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[needed[before] & (text[before] > c)]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts) if len(before) else ():
            induced[int(text[part[0]])].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The length, up to `most` (a multiple of 8), of the common prefix of each suffix and the one after it in order."""
    padded = np.zeros(len(text) + most + 8, np.uint8)
    padded[: len(text)] = text
    words = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    lcp = np.zeros(max(0, len(order) - 1), np.int64)
    live, a, b = np.arange(len(lcp)), order[:-1], order[1:]
    for k in range(0, most, 8):
        differ = words[a + k] ^ words[b + k]
        same = differ == 0
        ends = ~same
        low = differ[ends]
        lcp[live[ends]] = k + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3)
        live, a, b = live[same], a[same], b[same]
        if not len(live):
            break
    lcp[live] = most
    return lcp


def repeated(bodies: list[bytes], windows: list[int], times: list[int], length: int) -> list[np.ndarray]:
    """For each body, which of its first windows starts a string that starts elsewhere too."""
    text = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    first = np.cumsum(sizes) - sizes
    counts = np.array(windows)
    window = np.zeros(len(text) + 1, np.int32)
    np.add.at(window, first, 1)
    np.add.at(window, first + counts, -1)
    window = np.cumsum(window[:-1]) > 0
    # A window start that is not smaller than its successor is induced through the run of suffixes up to the next smaller one.
    small = smaller_than_next(text)
    ahead = np.where(small, np.arange(len(text)), len(text) - 1)
    ahead = np.minimum.accumulate(ahead[::-1])[::-1]
    needed = np.zeros(len(text) + 1, np.int32)
    at = np.flatnonzero(window)
    np.add.at(needed, at, 1)
    np.add.at(needed, ahead[at] + 1, -1)
    needed = np.cumsum(needed[:-1]) > 0
    depth = -(-length // 8) * 8
    order = two_stage_order(text, needed, depth)
    order = order[window[order]]
    long = common_prefixes(text, order, depth) >= length
    hit = np.zeros(len(text), bool)
    hit[order[:-1][long]] = True
    hit[order[1:][long]] = True
    return [np.ones(n, bool) if t > 1 else hit[a : a + n] for a, n, t in zip(first.tolist(), windows, times, strict=True)]


class Shifted:
    """Where the i-th byte begins (0) or ends (1)."""

    def __init__(self, by: int):
        self.by = by

    def __getitem__(self, i):
        return i + self.by


def scan(length: int, gram: int) -> R.Scan:
    def units(data: np.ndarray, offsets: np.ndarray):
        return offsets, Shifted(0), Shifted(1), lambda a, b: byte_units(data[a:b])

    return R.Scan(units, length, gram)


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_classes: int = R.HOT_CLASSES, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]) of docs (doc_id, text)."""
    texts = keyed_text(docs)

    def decide(rows: list[dict]) -> list[np.ndarray]:
        return repeated([r["body"] for r in rows], [r["n"] for r in rows], [r["times"] for r in rows], length)

    told = R.repeats(texts, scan(length, gram), R.Rules(decide, lambda: F.col("times") > 1, SHARD_BYTES, hot_classes))
    extra = ", spans array<struct<start: long, end: long>>, kept binary" if keep_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, rs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                first, last = R.window_runs(rs, length)
                kept = kept_bytes(text, first, last)
                spans = [{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                for values, v in zip(out, (len(text), len(text) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), spans, kept), strict=True):
                    values.append(v)
            columns = [pa.array(v, t) for v, t in zip(out[:4], (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns += [pa.array(out[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out[5], pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    joined = texts.join(told, ["doc_id", "salt"], "left").select(shown_id(), "text", "rs")
    return joined.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}")


def op1_suffix(docs: DataFrame) -> DataFrame:
    return deduplicated(docs)
