"""Operator 7: BPE encoding and decoding as a bounded-lookahead streaming transducer.

The symbols of a pre-token arrive one after another; the encoder holds those that are not stable yet, at most `lookahead` + BLOCK of them, and
emits the others' tokens. `lookahead` is computed from the merge list. Take two strings with the same first H symbols and apply the merges to both,
rule by rule in order of rank. Up to the first H symbols the two agree. A rule (a, b) can only disturb the part that agrees at its end: the
last token there, a, joins what follows in one string and not in the other, and the part loses a's symbols. What then follows the part begins with
a or with a token made of it, so the next rule that disturbs it, of a higher rank, has a right side with a on its left edge. So the most that can
ever be lost is the greatest sum of left sides' sizes along such chains of rules; a token that ends further than that before the end of
what was read is the same however the string goes on. This needs rules whose sides are made by lower ranks; other files are refused.

Pre-tokens shorter than the lookahead end before anything in them is stable; those of many words step together as arrays, and the worker
remembers each word's ids. A word above LONG characters is read in pieces, split only inside runs of plain letters. Decoding is
an incremental state machine, from ids to text.

Defined results: null or empty text gives no ids and the empty decoded text; ids depend only on the text, so repeated rows agree; a document of any
length is one row; docs' own columns named like the results keep their values where `encoded` keeps columns (the results then get a `_`).
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import chunks, free_name, held, text_bytes, trimmed
from .textscan import SPACE, WordTable, words

#: Bytes that a Python worker may remember words in, and bytes of text it looks up together; only speed depends on them.
MEMORY, SLICE = 32 << 20, 1 << 20
#: Symbols encoded at a time beyond the lookahead, and the characters of a word from which it is read in pieces.
BLOCK, LONG = 4096, 1 << 16
#: Pre-tokens up to this size step together and are remembered.
SHORT = 64


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


#: The pre-tokens of lower-cased printable ASCII under the one pattern that is supported, and that pattern.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = re.compile(r"[!-~]+")
#: Inside a run of these, before and after, a word may be cut: all are letters that no normalisation joins or changes but for case.
CUT = re.compile("[A-Za-z一-鿿]{4}(?=[A-Za-z一-鿿])")


class Transducer:
    """The encoder and decoder of one tokenizers file (BPE, byte-level, with an end-of-word suffix).

    Normalisation and pre-tokenisation of other than printable ASCII are the library's own, so its Unicode tables hold.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("unsupported tokenizer model")
        if [s["type"] for s in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("unsupported normalizer")
        if [s["pattern"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"] != [{"Regex": PATTERN}]:
            raise ValueError("unsupported pre-tokenizer")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[str, str], int] = {}
        for r, pair in enumerate(pairs):
            self.rank.setdefault(pair, r)
        self.alphabet = byte_alphabet()
        self.bytes_of = {c: b for b, c in enumerate(self.alphabet)}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.lookahead = self._lookahead(pairs)
        self.decimal = {i: str(i) for i in self.text_of}
        self.kind = np.uint16 if max(self.text_of, default=0) < 1 << 16 else np.uint32
        self._table = None

    def size(self, token: str) -> int:
        """How many symbols a token has."""
        return len(token) - len(self.end) if self.end and token.endswith(self.end) and len(token) > len(self.end) else len(token)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """The sufficient lookahead of the merge list (see above)."""
        made: dict[str, tuple[str, str]] = {}
        for a, b in pairs:
            if any(self.size(side) > 1 and side not in made for side in (a, b)) or a + b in made:
                raise ValueError("merges whose sides come later, or that make a token twice, have no bounded lookahead here")
            made[a + b] = (a, b)
        lost: dict[str, int] = {}  # by token: the most that rules seen so far (of higher rank) with it on the left edge of their right side lose
        most = 0
        for a, b in reversed(pairs):
            here = self.size(a) + lost.get(a, 0)
            most = max(most, here)
            edge: str | None = b
            while edge is not None:
                if here > lost.get(edge, 0):
                    lost[edge] = here
                edge = made[edge][0] if edge in made else None
        return most

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges applied by rank, leftmost first among equals; O(n log n) with a heap over a linked list."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank = self.rank
        if n <= 200:  # short runs: a scan for the least rank beats the heap
            none, text = len(rank), list(symbols)
            ranks = [rank.get(p, none) for p in zip(text, text[1:])]
            while (best := min(ranks)) != none:
                i = ranks.index(best)
                text[i] += text.pop(i + 1)
                del ranks[i]
                if not ranks:
                    break
                if i:
                    ranks[i - 1] = rank.get((text[i - 1], text[i]), none)
                if i < len(ranks):
                    ranks[i] = rank.get((text[i], text[i + 1]), none)
            return text
        text, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if text[i] is None or j >= n or (text[i], text[j]) != pair:
                continue
            text[i], text[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (text[i], text[after[i]])) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if (h := before[i]) >= 0 and (p := (text[h], text[i])) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return [t for t in text if t is not None]

    def ids(self, tokens: Iterable[str]) -> list[int]:
        return [i for i in map(self.vocab.get, tokens) if i is not None]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens, in the byte alphabet."""
        if text.isascii():
            if text.isalpha():
                return [text.lower()]
            if PRINTABLE.fullmatch(text):
                return ASCII_PIECES.findall(text.lower())
        return [p for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        run = Run(self)
        return run.push(piece) + run.close()

    def lockstep(self, pieces: Sequence[str]) -> list[list[int]]:
        """piece_ids of many short pre-tokens at once: all step together, each merging its pair of least rank, leftmost first."""
        if self._table is None:
            of = self.vocab
            merges = sorted((of[a] << 32 | of[b], r, of[a + b]) for (a, b), r in self.rank.items())
            self._table = tuple(np.array(c, np.int64) for c in zip(*merges))
            self._single = np.array([[of.get(c + e, -1) for c in map(chr, range(0x200))] for e in ("", self.end)], np.int64)
        keys, ranks, made = self._table
        data = np.frombuffer("".join(pieces).encode("utf-16-le"), "<u2").astype(np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        last = np.cumsum(size) - 1
        final = np.zeros(len(data), np.int64)
        final[last] = 1
        symbol = self._single[final, data]
        run = np.repeat(np.arange(len(pieces)), size)
        none = np.int64(len(ranks))

        def rank_at(i: np.ndarray) -> np.ndarray:
            """Rank of the pair at places i and i + 1 (none where they are of different runs)."""
            j = np.minimum(i + 1, len(symbol) - 1)
            pair = symbol[i] << 32 | symbol[j]
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            return np.where((i + 1 < len(symbol)) & (run[j] == run[i]) & (keys[at] == pair), ranks[at], none)

        out_symbol, out_place = [], []
        place = np.arange(len(data))
        rank = rank_at(np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            best = np.minimum.reduceat(rank, first)
            live = best < none
            if not live.all():  # stable runs leave
                gone = np.repeat(~live, np.diff(np.append(first, len(symbol))))
                out_symbol.append(symbol[gone])
                out_place.append(place[gone])
                symbol, run, place, rank = symbol[~gone], run[~gone], place[~gone], rank[~gone]
                continue
            here = np.flatnonzero(rank == np.repeat(best, np.diff(np.append(first, len(symbol)))))
            here = here[np.concatenate(([True], run[here[1:]] != run[here[:-1]]))]
            pair = symbol[here] << 32 | symbol[here + 1]
            symbol[here] = made[np.searchsorted(keys, pair)]
            keep = np.ones(len(symbol), bool)
            keep[here + 1] = False
            here = here - np.arange(len(here))
            symbol, run, place, rank = symbol[keep], run[keep], place[keep], rank[keep]
            rank[here] = rank_at(here)
            before = here[here > 0] - 1
            rank[before] = rank_at(before)
        order = np.argsort(np.concatenate(out_place))
        ids, place = np.concatenate(out_symbol)[order], np.concatenate(out_place)[order]
        cuts = np.searchsorted(place, last, "right").tolist()
        ids = ids.tolist()
        return [[i for i in ids[a:b] if i >= 0] for a, b in zip([0, *cuts[:-1]], cuts)]

    def stream(self, text: str, step: int = LONG) -> Iterator[list[int]]:
        """The ids of a text, in lists as they get stable. Text is taken about `step` characters at a time."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._streamed(text, at, m.start(), step)
            yield [self.added[m[0]]]
            at = m.end()
        yield from self._streamed(text, at, len(text), step)

    def _streamed(self, text: str, at: int, end: int, step: int) -> Iterator[list[int]]:
        run = None
        while at < end:
            found = CUT.search(text, min(at + step, end), end) if end - at > step else None
            upto = found.end() if found else end
            pieces = self.pieces(text[at:upto])
            for k, piece in enumerate(pieces):
                if run is None or k:  # else the run of letters that the cut divides goes on
                    if run is not None:
                        yield run.close()
                    run = Run(self)
                for i in range(0, len(piece), BLOCK):
                    if ready := run.push(piece[i : i + BLOCK]):
                        yield ready
            if not found and run is not None:
                yield run.close()
            at = upto

    def encode(self, text: str) -> list[int]:
        return [i for part in self.stream(text) for i in part]


class Run:
    """One pre-token on its way through the transducer: symbols go in, ids come out once no further symbol can change them."""

    def __init__(self, transducer: Transducer):
        self.t = transducer
        self.held: list[str] = []
        self.last = ""  # the last symbol: it gets the end-of-word suffix if no other follows

    def push(self, symbols: str) -> list[int]:
        if not symbols:
            return []
        self.held += self.last + symbols[:-1]
        self.last = symbols[-1]
        stable = len(self.held) - self.t.lookahead
        if stable < BLOCK:
            return []
        out, at = [], 0
        for token in self.t.merged(self.held):
            if at + self.t.size(token) > stable:
                break
            at += self.t.size(token)
            out.append(token)
        self.held = self.held[at:]
        return self.t.ids(out)

    def close(self) -> list[int]:
        tokens = self.t.merged([*self.held, self.last + self.t.end]) if self.last else []
        self.held, self.last = [], ""
        return self.t.ids(tokens)


class TextDecoder:
    """An incremental machine from ids to text: text comes out as soon as its bytes form characters.

    joined=True gives what a tokenizer without a decoder returns, the tokens with a space between (state: has one come yet?); joined=False
    turns the byte alphabet back to bytes and the end-of-word suffix to a space, decoding UTF-8 incrementally (bytes that form none become U+FFFD).
    """

    def __init__(self, transducer: Transducer, joined: bool = True):
        self.t, self.joined, self.first = transducer, joined, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, i: int) -> str:
        token = self.t.text_of.get(i)
        if token is None:
            return ""
        if self.joined:
            lead, self.first = ("" if self.first else " "), False
            return lead + token
        ends = bool(self.t.end) and token.endswith(self.t.end)
        body = token.removesuffix(self.t.end) if ends else token
        return self.utf8.decode(bytes(self.t.bytes_of[c] for c in body if c in self.t.bytes_of) + b" " * ends)

    def feed_all(self, ids: list[int]) -> str:
        """feed() of each id in turn."""
        if not (self.joined and ids and self.t.text_of.keys() >= set(ids)):
            return "".join(map(self.feed, ids))
        lead, self.first = ("" if self.first else " "), False
        return lead + " ".join([self.t.text_of[i] for i in ids])

    def finish(self) -> str:
        return "" if self.joined else self.utf8.decode(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


class Digests:
    """Number of ids, and SHA-256 of the decimal ids and of the decoded text, as both come out of the transducer."""

    def __init__(self, transducer: Transducer):
        self.decimal, self.decoder = transducer.decimal, TextDecoder(transducer)
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int]) -> None:
        """The next ids of the text."""
        if ids:
            self.ids.update((" " * (self.n > 0) + " ".join(map(self.decimal.__getitem__, ids))).encode())
            self.text.update(self.decoder.feed_all(ids).encode())
            self.n += len(ids)


def word_ids(t: Transducer, words: list[bytes]) -> list[np.ndarray]:
    """The ids of white-space-free words; pre-tokens never cross ASCII white space, so a text's are its words' one after another."""
    out: list[list[int]] = [[]] * len(words)
    for some in batched(enumerate(words), 20_000):
        split = []
        for k, w in some:
            text = w.decode("utf-8")
            if len(text) > LONG or t.special and t.special.search(text):
                out[k] = t.encode(text)
            else:
                split.append((k, t.pieces(text)))
        fresh = list({p for _, pieces in split for p in pieces})
        ids = {p: t.piece_ids(p) for p in fresh if len(p) > SHORT}
        for part in batched([p for p in fresh if len(p) <= SHORT], 8192):
            ids.update(zip(part, t.lockstep(part)))
        for k, pieces in split:
            out[k] = ids[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in ids[p]]
    sizes = np.fromiter(map(len, out), np.int64, len(out))
    return np.split(np.fromiter(chain.from_iterable(out), t.kind, int(sizes.sum())), np.cumsum(sizes)[:-1])


def encoded(docs: DataFrame, path: str, column: str = "text", keep_ids: bool = False) -> DataFrame:
    """docs with its columns and n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 (of the decoded text)[, ids]."""
    own = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": ArrayType(IntegerType())} if keep_ids else {})
    names = [free_name(docs.columns, n) for n in own]
    schema = StructType([*docs.schema.fields])
    for name, kind in zip(names, own.values(), strict=True):
        schema = schema.add(name, kind)
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        table = held(f"bpe:{path}", lambda: WordTable(MEMORY, t.kind))
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for i, j in chunks(offsets, SLICE):
                part = data[offsets[i] : offsets[j]]
                start, end, bounds = words(part, offsets[i : j + 1] - offsets[i], SPACE)
                ids, sizes = table.gathered(table.rows(part, start, end, lambda new: word_ids(t, new)))
                ends = np.concatenate(([0], np.cumsum(sizes)))[bounds]
                out: list[Digests] = []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    out.append(doc := Digests(t))
                    for k in range(a, b, BLOCK * 64):
                        doc.add(ids[k : min(b, k + BLOCK * 64)].tolist())
                columns = [pa.array([d.n for d in out], pa.int64()), pa.array([d.ids.hexdigest() for d in out], pa.string()), pa.array([d.text.hexdigest() for d in out], pa.string())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *columns], names=[*batch.schema.names, *names])
        trimmed()

    return docs.mapInArrow(run, schema)


def op7_bpe(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded(docs.select("doc_id", "text"), path).select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
