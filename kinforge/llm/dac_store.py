"""Operator 4: token ids in directly addressable codes.

A segment holds the ids of whole documents. Each id is cut into chunks of `bits` bits, the lowest chunk in level 0, the next in level 1, and so on;
a level's continuation bitmap says which of its ids go on, and its rank directory (set bits before each block of 512) turns a place in one
level into the place in the next. Any id is read without decoding others. Segments are written in ascending doc_id order.

Segment bytes, little-endian: b"DAC1", u8 bits, u8 levels, u16 zero, u64 ids; then for each level u64 n, n chunks (u8 up to 8 bits, else u16),
bitmap of ceil(n / 8) bytes (lowest bit first), ceil(n / 512) u64 ranks (the last level has neither bitmap nor ranks).

Defined results: a null text counts as empty and gives the end id alone; null doc_ids sort first; rows of one doc_id follow the order of their texts' hashes, then texts.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, held, text_bytes, written
from .textscan import SPACE, WordTable, words

BLOCK = 512
#: Ids after which a segment is closed; a longer document has a segment of its own.
SEGMENT_IDS = 2_000_000
#: Bytes that a Python worker may remember words in, and bytes of text it looks up together; only speed depends on them.
MEMORY, SLICE = 96 << 20, 4 << 20


def pack(ids: np.ndarray, bits: int = 8) -> bytes:
    """A segment of ids below 2 ** 32."""
    kind, levels, rest = (np.uint8 if bits <= 8 else np.uint16), [], ids.astype(np.uint32)
    mask = np.uint32((1 << bits) - 1)
    while True:
        more = rest > mask
        levels.append(((rest & mask).astype(kind), more))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(bits)
    out = [struct.pack("<4sBBHQ", b"DAC1", bits, len(levels), 0, len(ids))]
    for k, (chunk, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
        if k + 1 < len(levels):
            counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64)
            out += [np.packbits(more, bitorder="little").tobytes(), (np.cumsum(counts) - counts).astype("<u8").tobytes()]
    return b"".join(out)


class Codes:
    """Random access to a segment's ids."""

    def __init__(self, data: bytes):
        magic, self.bits, n_levels, _, self.n = struct.unpack_from("<4sBBHQ", data)
        if magic != b"DAC1":
            raise ValueError("not a DAC segment")
        at, kind, self.levels = 16, (np.uint8 if self.bits <= 8 else np.dtype("<u2")), []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunk = np.frombuffer(data, kind, n, at + 8)
            at += 8 + chunk.nbytes
            bitmap = ranks = None
            if k + 1 < n_levels:
                bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
                at += bitmap.nbytes
                ranks = np.frombuffer(data, "<u8", -(-n // BLOCK), at)
                at += ranks.nbytes
            self.levels.append((chunk, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The id at place i: one chunk, one bit and one rank in each level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunk, bitmap, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            bits = bitmap[block * BLOCK // 8 : (i >> 3) + 1].copy()
            bits[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(bits).sum())
            shift += self.bits
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end: in each level the wanted chunks are neighbours, found by one rank."""
        out, at, where, shift = np.zeros(max(0, end - start), np.uint32), start, None, 0
        n = len(out)
        for chunk, bitmap, ranks in self.levels:
            part = chunk[at : at + n].astype(np.uint32) << np.uint32(shift)
            if where is None:
                out |= part
            else:
                out[where] |= part
            if bitmap is None or not n:
                break
            block = at // BLOCK
            first = block * BLOCK // 8
            bits = np.unpackbits(bitmap[first : -(-(at + n) // 8)], bitorder="little")
            lead = at - first * 8
            more = bits[lead : lead + n].astype(bool)
            at = int(ranks[block]) + int(bits[:lead].sum())
            where = np.flatnonzero(more) if where is None else where[more]
            n, shift = len(where), shift + self.bits
        return out


SEGMENTS = "part int, seq int, n_tokens long, doc_ids binary, known binary, doc_tokens binary, codes binary"


#: What a lower-cased word of printable ASCII is split into: the file's pattern, where letters, numbers and others are ASCII.
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """The library's ids of white-space-free words, as little-endian bytes.

    Pre-tokens never cross ASCII white space, so the ids of a text's words, one after another, are the text's. A word of printable ASCII
    without a special token's first character is split here and its pre-tokens go straight to the library's model (without a cache of its
    own); any other word takes the library's whole path.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only hold more memory
        from tokenizers import Tokenizer, models

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        size = max(self.whole.get_vocab_size(), end_id + 1)
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.codes = [self.kind(i).tobytes() for i in range(size)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [s["pattern"] for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if s["type"] == "Split"]
        self.plain = None
        # The short way is right for files of this kind only.
        if spec["model"]["type"] == "BPE" and steps == ["NFC", "Replace", "Lowercase"] and split == [{"Regex": PATTERN}]:
            given = {k: spec["model"][k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if spec["model"].get(k)}
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
            self.model = models.BPE(vocab=spec["model"]["vocab"], merges=merges, cache_capacity=0, **given)
            first = {t["content"][:1].lower() for t in spec["added_tokens"]} | {t["content"][:1].upper() for t in spec["added_tokens"]}
            self.plain = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in range(33, 127) if chr(c) not in first) + b"]{1,1024}").fullmatch

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        codes, pieces_of = self.codes, PLAIN_PIECES.findall
        out: list[bytes] = []
        for w in words:
            if self.plain and self.plain(w):
                tokenize, text = self.model.tokenize, w.decode("ascii").lower()
                if text.isalpha():
                    out.append(b"".join([codes[t.id] for t in tokenize(text)]))
                else:
                    out.append(b"".join([codes[t.id] for p in pieces_of(text) for t in tokenize(p)]))
            else:
                out.append(b"".join([codes[i] for i in self.whole.encode(w.decode("utf-8"), add_special_tokens=False).ids]))
        return np.split(np.frombuffer(b"".join(out), self.kind), np.cumsum([len(x) // self.kind().itemsize for x in out])[:-1])


@lru_cache(maxsize=1)
def word_encoder(path: str, end_id: int) -> WordEncoder:
    """A worker's encoder, kept from task to task."""
    return WordEncoder(path, end_id)


def write_segments(docs: DataFrame, path: str, end_id: int = 1, bits: int = 8, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """The segments of docs (doc_id, text) as a table in the shared folder, read again; path: of a tokenizers file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path, end_id)
        kind, table = encoder.kind, held(f"dac:{path}:{end_id}", lambda: WordTable(MEMORY, encoder.kind))
        part, seq = TaskContext.get().partitionId(), 0
        parts, ids, present, counts, size = [], [], [], [], 0

        def closed() -> pa.RecordBatch:
            packed = pack(np.concatenate(parts), bits)
            row = [part, seq, size, np.array(ids, "<i8").tobytes(), np.array(present, np.uint8).tobytes(), np.array(counts, "<i8").tobytes(), packed]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["part", "seq", "n_tokens", "doc_ids", "known", "doc_tokens", "codes"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets, SLICE):
                chunk = data[offsets[i] : offsets[j]]
                start, end, bounds = words(chunk, offsets[i : j + 1] - offsets[i], SPACE)
                # Pre-tokens never cross ASCII white space: the words' ids, one after another, are the text's.
                tokens, sizes = table.gathered(table.rows(chunk, start, end, encoder.encode))
                ends = np.concatenate(([0], np.cumsum(sizes)))[bounds[1:]]
                tokens = np.insert(tokens, ends, kind(end_id))
                upto = (ends + np.arange(1, j - i + 1)).tolist()
                for doc_id, a, b in zip(doc_ids[i:j], [0, *upto], upto):
                    if size and size + b - a > segment_ids:
                        yield closed()
                        seq, size = seq + 1, 0
                        parts, ids, present, counts = [], [], [], []
                    parts.append(tokens[a:b])
                    ids.append(doc_id or 0)
                    present.append(doc_id is not None)
                    counts.append(b - a)
                    size += b - a
        if ids:
            yield closed()

    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("order"))
    # The hash keeps rows of one doc_id (or of none) from meeting in one task.
    ordered = keyed.repartitionByRange("doc_id", "order").sortWithinPartitions("doc_id", "order", "text").select("doc_id", "text")
    return written(ordered.mapInArrow(run, SEGMENTS), "dac", {"parquet.block.size": 16 << 20})


def read_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, at, out = Codes(row["codes"]), 0, []
                counts = np.frombuffer(row["doc_tokens"], "<i8")
                starts = np.cumsum(counts) - counts
                for a, n in zip(starts.tolist(), counts.tolist(), strict=True):
                    out.append(zlib.crc32(codes.slice(a, a + n).astype("<u4").tobytes()))
                ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["known"], np.uint8) == 0)
                same = lambda v: pa.array(np.full(len(counts), v), pa.int32())
                yield pa.RecordBatch.from_arrays([same(row["part"]), same(row["seq"]), ids, pa.array(starts), pa.array(counts), pa.array(out, pa.int64())], names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])

    docs = segments.select("part", "seq", "doc_ids", "known", "doc_tokens", "codes").mapInArrow(run, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    # Running sums of the parts (a row for each task that wrote) and, within each part, of its segments.
    so_far = lambda column, window: F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", so_far("n", Window.orderBy("part")).alias("lead"))
    within = segments.select("part", "seq", so_far("n_tokens", Window.partitionBy("part").orderBy("seq")).alias("past"))
    before = within.join(parts, "part").select("part", "seq", (F.col("past") + F.col("lead")).alias("before"))
    return docs.join(before, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op4_dac(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the written segments."""
    return read_documents(write_segments(docs.select("doc_id", "text"), path))
