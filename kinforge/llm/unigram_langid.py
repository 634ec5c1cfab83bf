"""Operator 9: language ID by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public SentencePiece vocabulary, learned from labelled documents. A text's
likelihood sums over all ways to cut its words into pieces, by the forward algorithm; pieces never cross ASCII white space, so the text's
log-likelihood is the sum of its words', and a worker remembers words it has scored. Characters outside the vocabulary fall back to byte pieces.
Sums are rescaled, each language on its own, before they leave the range of floats, however long a word is.

Learning maximises the same likelihood: rounds of expected piece counts (forward and backward over all segmentations), from equal
probabilities on. It reads a bounded sample: `sample_per_lang` documents on average of each of the `max_langs` most frequent languages, those
whose hash is below the share that gives that many; languages beyond these are never predicted. Only text is used to predict.

Defined results: null text or text without a letter is `und` with score 0; with no labelled documents to learn from, every text is `und`.
A doc_id that is null counts as the empty text in the crc32 rule; ties go to the language first in order; repeated rows are judged alike.
identified(keep=True) keeps all columns; its own then get a `_` where docs has one of that name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, free_name, held, id_crc32, row_texts, text_bytes, trimmed, written
from .textscan import SPACE as SPACES
from .textscan import WordTable
from .textscan import words as text_words

SAMPLE_PER_LANG, MAX_LANGS, ROUNDS = 1000, 64, 2
#: Document hashes are taken modulo this; a language's share of it below which a document is in the sample follows from its count.
SCALE = 1 << 40
#: Added to each piece's expected count in each language.
SMOOTHING = 0.1
SPACE = "▁"
MULTIPLY = 0x9E3779B97F4A7C15
#: The log-likelihood, a character, of a word that a language can't make.
IMPOSSIBLE = -745.0
#: Bytes that a worker may remember words in, and the bytes of text it looks up together; only speed depends on them.
MEMORY, SLICE = 32 << 20, 1 << 20
#: Words up to this size step together; longer ones go one by one, by the same sums.
TOGETHER = 256


@lru_cache(maxsize=1)
def pieces(path: str) -> tuple[dict[str, int], list[int], int]:
    """The vocabulary: piece -> id, the ids of the 256 byte pieces, and the longest piece's length."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_byte(i)}
    fallback = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return ids, fallback, max(map(len, ids))


class Forward:
    """Log-likelihoods of words under each language's piece probabilities."""

    def __init__(self, path: str, log_probs: np.ndarray):
        self.path = path
        self.ids, fallback, self.longest = pieces(path)
        self.p = np.exp(log_probs)  # piece x language
        self.rows = [tuple(r) for r in self.p.tolist()]
        self.fallback = fallback
        self.n = log_probs.shape[1]

    def word(self, raw: bytes) -> tuple[float, ...]:
        """Natural logs, one for each language: the forward sum over all segmentations of the word."""
        text = SPACE + raw.decode("utf-8", "replace").lower()
        size, n, ids, rows = len(text), self.n, self.ids, self.rows
        ahead: list[list[float] | None] = [None] * (size + 1)
        ahead[0], shift = [1.0] * n, [0.0] * n
        for i in range(size):
            here = ahead[i]
            ahead[i] = None
            if min(here) < 1e-200:  # keep the sums in range, each language on its own: all its reachable values move together
                held = [k for k in range(i + 1, min(size, i + self.longest) + 1) if ahead[k]]
                for x in range(n):
                    scale = max([here[x], *(ahead[k][x] for k in held)])
                    if here[x] >= 1e-200 or not scale:
                        continue
                    shift[x] += math.log(scale)
                    here[x] /= scale
                    for k in held:
                        ahead[k][x] /= scale
            for j in range(i + 1, min(size, i + self.longest) + 1):
                piece = ids.get(text[i:j])
                if piece is not None:
                    step = rows[piece]
                elif j == i + 1:
                    step = self.bytes_of(text[i])
                else:
                    continue
                to = ahead[j]
                if to is None:
                    ahead[j] = [h * s for h, s in zip(here, step)]
                else:
                    for x in range(n):
                        to[x] += here[x] * step[x]
        return tuple(math.log(v) + s if v > 0 else IMPOSSIBLE * size for v, s in zip(ahead[size], shift, strict=True))

    def bytes_of(self, char: str) -> tuple[float, ...]:
        step = np.ones(self.n)
        for b in char.encode("utf-8"):
            step = step * self.p[self.fallback[b]]
        return tuple(step.tolist())

    def prepare(self) -> None:
        """Sorted hashes of all pieces' prefixes, with the piece each one is (-1: none), for words()."""
        self.known, self.piece = prefixes(self.path)

    def words(self, raws: list[bytes]) -> np.ndarray:
        """word() of many words at once: all places of all words step together, so a place costs a few array operations."""
        out = np.zeros((len(raws), self.n))
        texts = [SPACE + r.decode("utf-8", "replace").lower() for r in raws]
        together = [k for k, t in enumerate(texts) if len(t) <= TOGETHER]
        for k in (k for k, t in enumerate(texts) if len(t) > TOGETHER):
            out[k] = self.word(raws[k])
        if together:
            lattice = Lattice(self, [texts[k] for k in together])
            out[together] = lattice.forward()
        return out


class Lattice:
    """All segmentations of some words: node j of a word stands before its j-th character, an edge is a piece (or one character in bytes)."""

    def __init__(self, model: Forward, texts: list[str]):
        self.model, self.n = model, model.n
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.sizes = sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        left = np.repeat(first + sizes, sizes) - np.arange(len(flat))  # characters from each place to its word's end
        starts, hashes, edges = np.arange(len(flat)), np.zeros(len(flat), np.uint64), []
        for k in range(1, min(model.longest, int(sizes.max())) + 1):
            hashes = (hashes ^ flat[starts + k - 1]) * np.uint64(MULTIPLY) + np.uint64(k)
            at = np.searchsorted(model.known, hashes)
            at[at == len(model.known)] = 0
            alive = model.known[at] == hashes
            piece = np.where(alive, model.piece[at], -1)
            if k == 1:
                lone = np.flatnonzero(piece < 0)
            whole = piece >= 0
            edges.append((starts[whole], piece[whole]))
            keep = alive & (left[starts] > k)
            starts, hashes = starts[keep], hashes[keep]
        self.node = np.arange(len(flat)) + np.repeat(np.arange(len(texts)), sizes)
        self.begin, self.nodes = first + np.arange(len(texts)), len(flat) + len(texts)
        rank = np.arange(len(flat)) - np.repeat(first, sizes)
        places = np.arange(int(sizes.max()) + 1)
        self.chars = flat[lone].tolist()
        odd = {c: model.bytes_of(chr(c)) for c in set(self.chars)}
        #: For each length: start nodes in order of their place in the word, pieces, probabilities, and where each place begins.
        self.groups = []
        for k, (start, piece, p) in enumerate([(lone, None, np.array([odd[c] for c in self.chars]).reshape(len(lone), self.n)), *[(s, x, None) for s, x in edges]]):
            order = np.argsort(rank[start], kind="stable")
            start = start[order]
            self.groups.append((max(1, k), self.node[start], order if piece is None else piece[order], p[order] if piece is None else None, np.searchsorted(rank[start], places), piece is None))

    def step(self, group: tuple, a: int, b: int) -> np.ndarray:
        return group[3][a:b] if group[5] else self.model.p[group[2][a:b]]

    def scaled(self, values: np.ndarray, shift: np.ndarray, i: int) -> None:
        """Keeps the sums in range at place i: where one falls too low, all that the word has reached moves together, each language on its own."""
        live = np.flatnonzero(self.sizes > i)
        here = values[self.begin[live] + i]
        low = (here < 1e-200).any(axis=1)
        if not low.any():
            return
        live, here = live[low], here[low]
        reach = np.minimum(i + np.arange(self.model.longest + 1), self.sizes[live][:, None])  # the last node may come up again
        window = self.begin[live][:, None] + reach
        most = values[window].max(axis=1)
        factor = np.where((here < 1e-200) & (most > 0), most, 1.0)
        for k in range(window.shape[1]):
            fresh = np.ones(len(live), bool) if k == 0 else reach[:, k] != reach[:, k - 1]
            values[window[fresh, k]] /= factor[fresh]
        shift[live] += np.log(factor)

    def forward(self) -> np.ndarray:
        """Log-likelihoods, word x language."""
        ahead, shift = np.zeros((self.nodes, self.n)), np.zeros((len(self.sizes), self.n))
        ahead[self.begin] = 1.0
        for i in range(int(self.sizes.max())):
            self.scaled(ahead, shift, i)
            for group in self.groups:
                a, b = group[4][i], group[4][i + 1]
                if b > a:
                    here = group[1][a:b]
                    ahead[here + group[0]] += ahead[here] * self.step(group, a, b)
        last = ahead[self.begin + self.sizes]
        with np.errstate(divide="ignore"):
            return np.where(last > 0, np.log(last) + shift, IMPOSSIBLE * self.sizes[:, None])

    def expected(self, weights: np.ndarray, language: int) -> np.ndarray:
        """Expected piece counts of the words, each times its weight, under one language's probabilities; for words that stay in the range of floats."""
        ahead, behind = np.zeros(self.nodes), np.zeros(self.nodes)
        ahead[self.begin] = 1.0
        behind[self.begin + self.sizes] = 1.0
        prob = [(g[3] if g[5] else self.model.p[g[2]])[:, language] for g in self.groups]
        places = range(int(self.sizes.max()))
        for i in places:
            for g, p in zip(self.groups, prob, strict=True):
                a, b = g[4][i], g[4][i + 1]
                if b > a:
                    ahead[g[1][a:b] + g[0]] += ahead[g[1][a:b]] * p[a:b]
        for i in reversed(places):
            for g, p in zip(self.groups, prob, strict=True):
                a, b = g[4][i], g[4][i + 1]
                if b > a:
                    behind[g[1][a:b]] += behind[g[1][a:b] + g[0]] * p[a:b]
        total = ahead[self.begin + self.sizes]
        share = np.repeat(np.divide(weights, total, out=np.zeros(len(total)), where=total > 1e-280), self.sizes + 1)
        counts = np.zeros(len(self.model.p))
        for g, p in zip(self.groups, prob, strict=True):
            each = ahead[g[1]] * p * behind[g[1] + g[0]] * share[g[1]]
            if g[5]:
                for k, v in zip(g[2].tolist(), each.tolist()):
                    for byte in chr(self.chars[k]).encode("utf-8"):
                        counts[self.model.fallback[byte]] += v
            else:
                counts += np.bincount(g[2], each, len(counts))
        return counts


@lru_cache(maxsize=1)
def prefixes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all pieces' prefixes, and the piece each one is (-1: none)."""
    found: dict[int, int] = {}
    for piece, i in pieces(path)[0].items():
        h = 0
        for k, c in enumerate(piece, 1):
            h = ((h ^ ord(c)) * MULTIPLY + k) % (1 << 64)
            found[h] = i if k == len(piece) else found.get(h, -1)
    known = np.array(sorted(found), np.uint64)
    return known, np.array([found[h] for h in known.tolist()], np.int64)


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def learn(docs: DataFrame, path: str, sample_per_lang: int = SAMPLE_PER_LANG, max_langs: int = MAX_LANGS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and natural logs of piece probabilities (piece x language), from docs (doc_id, text, lang)."""
    order = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), "text"), F.lit(SCALE))
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", order.alias("h"))
    most = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not most:
        return [], np.zeros((1, 0))
    names = sorted(r["lang"] for r in most)
    shares = docs.sparkSession.createDataFrame([(r["lang"], -(-SCALE * min(r["n"], sample_per_lang) // r["n"])) for r in most], "lang string, share long")
    sample = written(labelled.join(F.broadcast(shares), "lang").filter("h < share").select("lang", "text"), "sample")  # broadcast: max_langs rows
    ids, fallback, _ = pieces(path)
    size = max([*ids.values(), *fallback]) + 1
    log_probs = np.full((size, len(names)), -math.log(size))
    for _ in range(rounds):
        model = docs.sparkSession.sparkContext.broadcast((names, log_probs))  # bounded: vocabulary x max_langs

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            names, log_probs = model.value
            forward = Forward(path, log_probs)
            forward.prepare()
            for batch in batches:
                words: dict[str, Counter] = {}
                for lang, text in zip(batch.column(0).to_pylist(), row_texts(batch.column(1)), strict=True):
                    words.setdefault(lang, Counter()).update(text.split())
                for lang, found in words.items():
                    counts = np.zeros(size)
                    spelled: Counter = Counter()
                    for w, n in found.items():
                        text = SPACE + w.decode("utf-8", "replace").lower()
                        for i in range(0, len(text), 48):  # a longer word is learned from in stretches
                            spelled[text[i : i + 48]] += n
                    each = list(spelled.items())
                    for i in range(0, len(each), 4096):
                        part = each[i : i + 4096]
                        counts += Lattice(forward, [t for t, _ in part]).expected(np.array([n for _, n in part], float), names.index(lang))
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "piece", "n"])

        rows = sample.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        table = np.full((size, len(names)), SMOOTHING)
        for r in rows:
            table[r["piece"], names.index(r["lang"])] += r["n"]
        log_probs = np.log(table / table.sum(0))
    return names, log_probs


@lru_cache(maxsize=1)
def forward_of(path: str, shape: tuple[int, ...], table: bytes) -> Forward:
    """A worker's model, kept from task to task."""
    made = Forward(path, np.frombuffer(table).reshape(shape))
    made.prepare()
    return made


def identified(docs: DataFrame, names: list[str], log_probs: np.ndarray, path: str, keep: bool = False) -> DataFrame:
    """doc_id (keep: all columns), lang_pred and score, the posterior of the predicted language under equal priors."""
    docs = docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    at = docs.columns.index("text")
    fields = [f for f in docs.schema.fields if keep or f.name == "doc_id"]
    own = [free_name([f.name for f in fields], n) for n in ("lang_pred", "score")]
    schema = StructType(fields).add(own[0], "string").add(own[1], "double")
    model = docs.sparkSession.sparkContext.broadcast((names, log_probs.shape, np.ascontiguousarray(log_probs).tobytes()))  # bounded: vocabulary x max_langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shape, table = model.value
        n = len(names)
        forward = forward_of(path, shape, table) if names else None
        known = held(f"langid:{path}:{xxhash.xxh3_128_hexdigest(table)}", lambda: WordTable(MEMORY, np.float64))
        together = max(64, 16384 // max(n, 4))

        def learned(words: list[bytes]) -> list[np.ndarray]:
            return [row for i in range(0, len(words), together) for row in forward.words(words[i : i + together])]

        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for i, j in chunks(offsets, SLICE):
                preds, scores = [], []
                part = data[offsets[i] : offsets[j]]
                start, end, bounds = text_words(part, offsets[i : j + 1] - offsets[i], SPACES)
                if forward:
                    rows = known.rows(part, start, end, learned)
                    each = known.values.reshape(-1, n)
                for d in range(j - i):
                    a, b = int(bounds[d]), int(bounds[d + 1])
                    if not (forward and a < b and has_letter(part[start[a] : end[b - 1]].tobytes())):
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    total = sum(each[rows[k : min(b, k + 65536)]].sum(0) for k in range(a, b, 65536))
                    best = int(total.argmax())
                    preds.append(names[best])
                    scores.append(float(1.0 / np.exp(np.maximum(total - total[best], -700)).sum()))
                columns = batch.slice(i, j - i).columns[: None if keep else 1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema.fields])
        trimmed()

    return docs.mapInArrow(run, schema)


def held_out():
    return id_crc32(F.col("doc_id")) % 3 == 1


def op9_langid(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    names, log_probs = learn(docs.select("doc_id", "text", "lang").filter(~held_out()), path)
    return identified(docs, names, log_probs, path).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
