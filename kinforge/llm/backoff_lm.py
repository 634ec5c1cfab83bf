"""Operator 6: LM scoring with a weighted backoff automaton.

States are the root (the empty context) and every context of up to order - 1 words seen in training. An arc of a state reads a word with the
smoothed log-probability of that word there and leads to the state of the longest known suffix; a state without an arc for a word follows its
failure arc to the state without the oldest word, paying that arc's weight. A text is read once, left to right.

Smoothing is Bayesian (a Dirichlet prior centred on the shorter context) above an absolutely discounted unigram level, in backoff form:
  p(w | u) = (c(uw) + prior * p(w | u')) / (c(u) + prior) on an arc, and prior / (c(u) + prior) on the failure arc of u,
with c(u) how often u goes on in training and a prior for each length of u. At the root, p(w) = (c(w) - d) / N, and all d * V / N that is
discounted goes to one class of unknown words, d = n1 / (n1 + 2 n2) from the counts of counts, so each state's distribution sums to one.

Scale: each task cuts its documents into batches of a bounded size and writes them, compressed. Each batch reports the distinct hashes of its
n-grams (training counts, and zero for those only to be scored) to shards of the hash space as sorted arrays; a shard adds them up and
answers each batch with the totals of just those, in the order asked. Words and pairs of words go at once; of longer n-grams, one length after
the other, a batch asks only for those whose first and last n - 1 words both occur in other batches too: all others occur in this batch alone,
and its own count is the total. In the end a batch builds the part of the
automaton that its texts can reach, and scores them. So nothing grows in one task or on the driver, whatever the ids are, and what is
gathered follows the corpus. n-grams are told apart by 64-bit hashes of their words' 64-bit hashes.

Defined results: a null or empty text has the end token alone; a null doc_id counts as the empty text in the crc32 rule; repeated rows each count
as a document; with no training documents, N = V = 0 and every token, the one unknown class, has probability 1; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_crc32, released, text_bytes, total_bytes, written
from .textscan import LOWER, SPACE, mixed, word_hashes, words

ORDER = 3
#: Of contexts of one word, two words and so on (the last holds for longer ones too); chosen on held-out documents, see the README.
PRIORS = (1000.0, 5.0)
BATCH_BYTES = 8_000_000
#: Up to this length a batch asks for all its n-grams, at once: fewer would not be worth another pass over the texts.
FREE = 2
CHUNK = 1 << 20
#: The end token's hash; no word's hash path leads here but by chance.
END = np.uint64(0xE2D0_5EED_0000_0001)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then its end), and where each text's tokens begin (n + 1)."""
    data, offsets = text_bytes(column)
    hashes, counts = [], []
    for i, j in chunks(offsets, CHUNK):
        part = LOWER[data[offsets[i] : offsets[j]]]
        start, end, bounds = words(part, offsets[i : j + 1] - offsets[i], SPACE)
        hashes.append(np.insert(word_hashes(part, start, end), bounds[1:], END))
        counts.append(np.diff(bounds) + 1)
    sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context's words and one more."""
    return mixed(context * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(0x632BE59BD9B4E019))


def ngrams(hashes: np.ndarray, bounds: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order: the places of the last token of each n-gram within a text, and its hash."""
    out, places, grams = [], np.arange(len(hashes)), hashes
    first = np.repeat(bounds[:-1], np.diff(bounds))
    for n in range(1, order + 1):
        if n > 1:
            keep = places - (n - 1) >= first[places]
            places = places[keep]
            # The first n - 1 words are the (n - 1)-gram that ends one place earlier.
            before = np.zeros(len(hashes), np.uint64)
            before[out[-1][0]] = out[-1][1]
            grams = longer(before[places - 1], hashes[places])
        out.append((places, grams))
    return out


def planes(values: np.ndarray) -> bytes:
    """Sorted 64-bit values byte plane by byte plane, highest first: the high planes compress well."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(">u8").astype(np.uint64)


def narrow(values: np.ndarray) -> bytes:
    """Small counts as bytes; a list with a larger one as 64-bit. The first byte tells which, the next eight how many bytes they are before compression: a shuffle's own is poor at lists of small numbers."""
    small = not len(values) or values.max() < 256
    raw = values.astype(np.uint8 if small else "<i8").tobytes()
    return (b"\1" if small else b"\10") + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def widened(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[9:], int.from_bytes(data[1:9], "little"), "zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8 if data[0] == 1 else "<i8").astype(np.int64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of each one's counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts[order], at)


class Level:
    """The distinct n-grams of a batch for one n: sorted hashes, training counts, the place of one occurrence; and which of them ends at each place (-1: none)."""

    def __init__(self, size: int, places: np.ndarray, grams: np.ndarray, in_train: np.ndarray):
        at = np.argsort(grams)
        ordered, where = grams[at], places[at]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(at) else np.zeros(0, bool)
        rank = np.cumsum(new, dtype=np.int32) - np.int32(1)
        first = np.flatnonzero(new)
        self.keys, self.place = ordered[first], where[first]
        self.counts = np.bincount(rank[in_train[where]], minlength=len(first)).astype(np.int64)
        self.entry = np.full(size, -1, np.int32)
        self.entry[where] = rank


class Texts:
    """A batch's documents: token hashes, where each text's tokens begin, and the levels 1..order of their n-grams, with totals as far as they are known."""

    def __init__(self, docs: pa.RecordBatch | pa.Table, order: int):
        self.train = docs.column("train").to_numpy().astype(bool)
        self.hashes, self.bounds = tokens(docs.column("text"))
        in_train = np.repeat(self.train, np.diff(self.bounds))
        self.levels = [Level(len(self.hashes), places, grams, in_train) for places, grams in ngrams(self.hashes, self.bounds, order)]
        self.totals: list[np.ndarray] = []
        self.shared: list[np.ndarray] = []  # whether another batch has the n-gram

    def around(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each n-gram (n > 1): its first and its last n - 1 words, as entries of the level below."""
        level, below = self.levels[n - 1], self.levels[n - 2]
        return below.entry[level.place - 1], below.entry[level.place]

    def asked(self, n: int) -> np.ndarray:
        """Which n-grams other batches may have too, by what is known of the level below."""
        if n <= FREE:
            return np.ones(len(self.levels[n - 1].keys), bool)
        first, last = self.around(n)
        return self.shared[n - 2][first] & self.shared[n - 2][last]

    def answered(self, answers: pa.Table) -> None:
        """Takes the answers for the levels that were asked for, one after another."""
        parts: dict[int, list] = {}
        for r in answers.select(["n", "shard", "totals"]).to_pylist():
            parts.setdefault(r["n"], []).append((r["shard"], r["totals"]))
        for n, level in enumerate(self.levels, 1):
            asked, total, shared = self.asked(n), level.counts.copy(), np.zeros(len(level.keys), bool)
            if asked.any():
                got = np.concatenate([widened(t) for _, t in sorted(parts[n])])
                total[asked], shared[asked] = got >> 1, got & 1 == 1
            self.totals.append(total)
            self.shared.append(shared)


def cut(values: np.ndarray, shards: int) -> np.ndarray:
    """Where the shards begin in sorted hashes: each shard is an equal range of the hash space."""
    edges = np.array([(s << 64) // shards for s in range(shards)], np.uint64)
    return np.append(np.searchsorted(values, edges), len(values))


REPORT = {"batch": pa.int64(), "n": pa.int32(), "shard": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
REPORT_SQL = "batch long, n int, shard int, keys binary, counts binary"


def report(batch: int, texts: Texts, n: int, shards: int) -> list[tuple]:
    """Rows of REPORT: the n-grams that a batch asks for, and its training counts, by shard."""
    asked = texts.asked(n)
    keys, counts = texts.levels[n - 1].keys[asked], texts.levels[n - 1].counts[asked]
    edges = cut(keys, shards).tolist()
    return [(batch, n, s, planes(keys[a:b]), narrow(counts[a:b])) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def columns_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds.values(), strict=True)]


def batched(batch_bytes: int):
    """Of documents (doc_id, text, train): a row for each batch of documents, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        part, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def closed() -> pa.RecordBatch:
            docs = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(docs)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "docs"])

        for batch in batches:
            offsets = text_bytes(batch.column(1))[1]
            for i, j in chunks(offsets, batch_bytes):
                if held and size + int(offsets[j] - offsets[i]) > batch_bytes:
                    yield closed()
                    held, size, made = [], 0, made + 1
                held.append(batch.slice(i, j - i))
                size += int(offsets[j] - offsets[i])
        if held:
            yield closed()

    return run


def unpacked(docs: bytes, order: int) -> tuple[pa.Table, Texts]:
    table = pa.ipc.open_stream(docs).read_all()
    return table, Texts(table, order)


def asking_first(order: int, shards: int):
    """Of batches: their reports for all lengths up to FREE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, docs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts = unpacked(docs.as_py(), min(order, FREE))[1]
                for n in range(1, min(order, FREE) + 1):
                    yield pa.RecordBatch.from_arrays(columns_of(report(number, texts, n, shards), REPORT), names=list(REPORT))

    return run


def asking(n: int, shards: int):
    """Of a batch and the answers to it for lengths below n: its reports for n."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = unpacked(docs.column("docs")[0].as_py(), n)[1]
        top, texts.levels = texts.levels, texts.levels[: n - 1]
        texts.answered(answers)
        texts.levels = top
        return pa.table(columns_of(report(docs.column("batch")[0].as_py(), texts, n, shards), REPORT), names=list(REPORT))

    return run


ANSWER = "batch long, n int, shard int, totals binary, stats array<long>"


def answers(table: pa.Table) -> pa.Table:
    """Of a shard's reports: for each batch's n-grams, in the order asked, twice the total, plus one if another batch has it; for n = 1 also N, V, n1, n2 of the shard's words (batch -1)."""
    rows: list[tuple] = []
    shard = table.column("shard")[0].as_py()
    for n in sorted(set(table.column("n").to_pylist())):
        some = table.filter(pc.equal(table.column("n"), n))
        batches, keys = some.column("batch").to_pylist(), [unplanes(k) for k in some.column("keys").to_pylist()]
        known, totals = added(flat := np.concatenate(keys), np.concatenate([widened(c) for c in some.column("counts").to_pylist()]))
        several = added(flat, np.ones(len(flat), np.int64))[1] > 1
        rows += [(b, n, shard, narrow(2 * totals[at := np.searchsorted(known, k)] + several[at]), None) for b, k in zip(batches, keys, strict=True)]
        if n == 1:
            rows.append((-1, 0, shard, None, [int(totals.sum()), int((totals > 0).sum()), int((totals == 1).sum()), int((totals == 2).sum())]))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["batch", "n", "shard", "totals", "stats"])


class Automaton:
    """The part of the backoff automaton that a batch's texts can reach.

    State 0 is the root; the context that is entry i of level n is state first[n] + i. lp[n][i] is the weight of the arc that reads the
    last word of entry i of level n + 1 (nan: no arc), `to[n][i]` the state it leads to; fail and back are each state's failure arc and its weight.
    """

    LANE = 256

    def __init__(self, texts: Texts, stats: tuple[int, int, int, int], priors: tuple[float, ...]):
        levels, totals = texts.levels, texts.totals
        self.entries, self.order = [level.entry for level in levels], len(levels)
        n_all, distinct, once, twice = stats
        discount = min(0.9, once / (once + 2 * twice)) if once else 0.5
        self.unknown = np.log10(discount * distinct / n_all) if n_all else 0.0
        sizes = [len(level.keys) for level in levels]
        self.first = [0, *(1 + np.concatenate(([0], np.cumsum(sizes)))[: self.order]).tolist()]
        states = 1 + sum(sizes[:-1])
        self.depth, self.fail, self.back = np.zeros(states, np.int8), np.zeros(states, np.int64), np.zeros(states)
        self.lp, self.to, shorter = [], [], None
        for n, (level, c) in enumerate(zip(levels, totals, strict=True), 1):
            prior = priors[min(n - 2, len(priors) - 1)] if n > 1 else 0.0
            with np.errstate(divide="ignore", invalid="ignore"):
                if n == 1:
                    p, suffix = np.where(c > 0, (c - discount) / max(1, n_all), np.nan), np.zeros(len(c), np.int64)
                else:
                    context, ending = texts.around(n)
                    p = np.where(c > 0, (c + prior * shorter[ending]) / (totals[n - 2][context] + prior), np.nan)
                    suffix = self.first[n - 1] + ending
            if n < self.order:
                after = priors[min(n - 1, len(priors) - 1)]
                ids = self.first[n] + np.arange(len(c))
                self.depth[ids], self.fail[ids], self.back[ids] = n, suffix, np.log10(after / (c + after))
                suffix = np.where(c > 0, ids, suffix)
            self.lp.append(np.log10(p))
            self.to.append(suffix)
            shorter = p

    def read(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of many walks, each reading the word at its place: the weights paid and the states reached. A state's arc for that word is the n-gram that ends there."""
        paid, reached, state = np.zeros(len(at)), np.zeros(len(at), np.int64), state.copy()
        todo = np.arange(len(at))
        for depth in range(self.order - 1, -1, -1):
            here = todo[self.depth[state[todo]] == depth] if depth else todo
            if not len(here):
                continue
            arc = self.entries[depth][at[here]]
            weight = self.lp[depth][arc]
            has = ~np.isnan(weight)
            paid[here[has]] += weight[has]
            reached[here[has]] = self.to[depth][arc[has]]
            lacks = here[~has]
            if depth:
                paid[lacks] += self.back[state[lacks]]
                state[lacks] = self.fail[state[lacks]]
                done = np.zeros(len(at), bool)
                done[here[has]] = True
                todo = todo[~done[todo]]
            else:
                paid[lacks] += self.unknown
        return paid, reached

    def scores(self, bounds: np.ndarray) -> np.ndarray:
        """Each text's log10 probability. Walks run side by side; a long text is cut into lanes, each brought to its first state by the words before it."""
        sizes = np.diff(bounds)
        lanes = -(-sizes // self.LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        start = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * self.LANE
        end = np.minimum(start + self.LANE, bounds[text + 1])
        state, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        for ago in range(self.order - 1, 0, -1):
            lead = np.flatnonzero(start - ago >= bounds[text])
            state[lead] = self.read(state[lead], start[lead] - ago)[1]
        order = np.argsort(start - end, kind="stable")
        start, end, state, text = start[order], end[order], state[order], text[order]
        for t in range(int((end - start).max()) if len(start) else 0):
            live = int(np.searchsorted(start - end, -t, "left"))
            paid, state[:live] = self.read(state[:live], start[:live] + t)
            total[:live] += paid
        return np.bincount(text, total, len(sizes))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scoring(order: int, stats: tuple[int, int, int, int], priors: tuple[float, ...]):
    """Of a batch's documents and the answers to it: the rows of SCORES."""

    def run(docs: pa.Table, answered: pa.Table) -> pa.Table:
        names = [f.strip().split()[0] for f in SCORES.split(",")]
        table, texts = unpacked(docs.column("docs")[0].as_py(), order)
        texts.answered(answered)
        n_all, distinct = stats[:2]
        count = texts.totals[0][texts.levels[0].entry]
        base = np.log10((count + 1) / (n_all + distinct + 1))
        sums = lambda v: np.add.reduceat(v, texts.bounds[:-1])  # noqa: E731  every text has its end token
        score = Automaton(texts, stats, priors).scores(texts.bounds)
        return pa.table([table.column("doc_id"), pa.array(~texts.train), pa.array(np.diff(texts.bounds)), pa.array(sums((count > 0).astype(np.int64))), pa.array(np.full(len(texts.train), n_all)), pa.array(sums(base)), pa.array(score)], names=names)

    return run


def scored(docs: DataFrame, train, order: int = ORDER, priors: tuple[float, ...] = PRIORS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The rows of SCORES for docs (doc_id, text), learning from those where the column `train` holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), train.alias("train"))
    shards = max(1, -(-total_bytes(rows) // batch_bytes))
    texts = written(rows.mapInArrow(batched(batch_bytes), "batch long, docs binary"), "batches", {"parquet.block.size": 16 << 20})
    reports = texts.mapInArrow(asking_first(order, shards), REPORT_SQL)
    back, parts = None, []
    for n in range(min(order, FREE), order + 1):
        if n > FREE:
            reports = texts.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(asking(n, shards), REPORT_SQL)
        parts.append(written(reports.groupBy("shard").applyInArrow(answers, ANSWER), "answers", release=True))
        some = parts[-1].filter("batch >= 0").select("batch", "n", "shard", "totals")
        back = some if back is None else back.union(some)
    stats = parts[0].filter("batch = -1").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).cast("long") for i in range(4)]).first()
    return texts.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(scoring(order, tuple(stats), tuple(priors)), SCORES)


def op6_backoff_lm(docs: DataFrame) -> DataFrame:
    return scored(docs, id_crc32(F.col("doc_id")) % 7 != 2)
