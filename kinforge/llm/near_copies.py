"""Near-duplicate documents by SimHash and exact similarity: one document of each group whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

SimHash alone can't tell 0.8 exactly (such texts mostly differ in 5 to 15 of 64 bits), so it goes first and an exact search completes it:
1. Operator 8's index links fingerprints of 5-word shingles that differ in at most 4 bits. Every linked pair is verified on the whole sets.
2. In one order of all shingles (rarest first, by a sample; any order gives the same result) two sets of similarity 4/5 share one of the first
   n - ceil(4n/5) + 1 shingles of each. These prefixes are posted, and sets of different groups that meet in a posting list are candidates if
   sizes, places, and parity bits of each set allow the similarity (bits that differ are a lower bound of the shingles that do). In a long list,
   candidates are first taken as links for as long as the list lasts, so that a group of copies yields about as many pairs as it has members.
   Every candidate is verified; the lists of groups in which one failed are searched again for all remaining pairs.
So links are exact and none is missed, and texts are only moved to verify a pair.

Defined results: words are apart by ASCII white space, ASCII case is folded; a text of up to 5 words is one shingle; null, empty and blank texts are one
group. Ids play no part: of each group the row of least doc_id stays (null ids last), then of least hash of all columns; of equal rows, one.
Shingles and texts are told apart by 64-bit hashes. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import chunks, free_name, released, text_bytes, trimmed, written
from .simhash_index import components, fingerprint, links
from .textscan import LOWER, SPACE, Rolling, mixed, word_hashes, words

SHINGLE, MAX_BITS = 5, 4
CHUNK = 1 << 20
#: Documents sampled for the order of shingles, and shingles told apart as common; only speed depends on them.
SAMPLE, COMMON = 20_000, 200_000
#: Rows of (node) or (id, hash) that may be broadcast; beyond that the join shuffles.
SENT = 1_000_000
#: Lists of up to so many nodes are compared pair by pair at once; in longer ones each node is first compared with so many others.
SMALL, BESIDE = 8, 8
PARITY = 512
#: Sets of more shingles than this, which so few bits tell little about, have as many parity bits for their pairs besides.
LARGE, WIDE = 600, 4096


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    data, offsets = text_bytes(column)
    for i, j in chunks(offsets, CHUNK):
        part = LOWER[data[offsets[i] : offsets[j]]]
        start, end, bounds = words(part, offsets[i : j + 1] - offsets[i], SPACE)
        rolling = Rolling(word_hashes(part, start, end))
        grams = rolling.grams(shingle)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= shingle:
                yield np.unique(grams[a : b - shingle + 1])
            else:
                yield rolling.of(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64)


def parity_bits(s: np.ndarray, parts: int = PARITY) -> bytes:
    """For each of so many (a power of 2) parts of the hash space, whether an odd number of the set's shingles is in it."""
    return np.packbits(np.bincount((s >> np.uint64(65 - parts.bit_length())).astype(np.int64), minlength=parts) & 1).tobytes()


def node_of(column: str = "text") -> Column:
    """Rows with the same text are one node."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def surveyed(texts: DataFrame) -> DataFrame:
    """(node, n, fp, bits, wide): the size of each node's set, its SimHash and its parity bits (wide: of large sets), of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            sizes, bits, wide = [], [], []
            for s in shingle_sets(batch.column(1)):
                sizes.append(len(s))
                bits.append(parity_bits(s))
                wide.append(parity_bits(s, WIDE) if len(s) > LARGE else None)
            fps = np.fromiter((fingerprint(t.as_py() or b"", SHINGLE) for t in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows).view(np.int64)
            columns = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(fps), pa.array(bits, pa.binary()), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "fp", "bits", "wide"])
        trimmed()

    return texts.mapInArrow(run, "node long, n int, fp long, bits binary, wide binary").dropDuplicates(["node"])


def common_shingles(texts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample of the nodes' sets, sorted, and how often."""
    share = 1 << 40 if total <= SAMPLE else (SAMPLE << 40) // total
    sample = texts.filter(F.pmod("node", F.lit(1 << 40)) < share).dropDuplicates(["node"]).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0)))
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 3")
    found = sorted((r["h"] % 2**64, r["n"]) for r in counts.orderBy(F.desc("n"), "h").limit(COMMON).collect())
    return np.array([h for h, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def posted(texts: DataFrame, known: np.ndarray, often: np.ndarray) -> DataFrame:
    """(token, node, place): the prefix shingles of each node; place: its set's size * 2 ** 32 + the shingle's place."""
    shared = texts.sparkSession.sparkContext.broadcast((known, often))  # COMMON shingles at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        seen: set[int] = set()
        for batch in batches:
            tokens, nodes, places = [], [], []
            for node, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                if node in seen or not len(s):
                    continue
                seen.add(node)
                n = len(s)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, often[at], 0), kind="stable")]
                tokens.append(s[: n + 1 + -4 * n // 5])
                nodes.append(np.full(len(tokens[-1]), node))
                places.append((n << 32) + np.arange(len(tokens[-1])))
            if tokens:
                columns = [np.concatenate(tokens).view(np.int64), np.concatenate(nodes), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "place"])
        trimmed()

    return texts.mapInArrow(run, "token long, node long, place long")


def small_side(df: DataFrame) -> DataFrame:
    """df, written; broadcast where its rows are few enough."""
    df = written(df, "side")
    return F.broadcast(df) if df.count() <= SENT else df


def likely(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that may be alike by the parity bits of large sets too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            keep = np.ones(batch.num_rows, bool)
            both = np.flatnonzero(np.array(batch.column(4).is_valid()) & np.array(batch.column(5).is_valid()))
            x, y = (np.frombuffer(b"".join(batch.column(c).take(pa.array(both)).to_pylist()), np.uint64).reshape(len(both), WIDE // 64) for c in (4, 5))
            keep[both] = 9 * (total[both] - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)) >= 8 * total[both]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    pairs = written(pairs, "likely")
    needed = small_side(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    info = written(info.join(needed, "node", "left_semi").select("node", "n", "wide"), "wide")
    one, two = info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa")), info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, alike) of the pairs of nodes: whether their whole sets have the similarity."""
    pairs = written(pairs, "pairs")
    needed = small_side(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    some = written(texts.join(needed, "node", "left_semi").dropDuplicates(["node"]), "texts")
    both = pairs.join(some.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(9 * common >= 4 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.bool_())], names=["a", "b", "alike"])

    return written(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, alike boolean"), "verified")


class Listed:
    """Posting lists in a row: token, node, n, place and label (group) of each entry, sorted by token, n and node, and the parity bits."""

    def __init__(self, table: np.ndarray, bits: np.ndarray):
        self.token, self.node, place, root = table
        self.n, self.pos = place >> 32, place & 0xFFFFFFFF
        self.bits = bits.view(np.uint64).reshape(len(self.token), PARITY // 64)
        self.label = np.unique(root, return_inverse=True)[1]

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the entries i and j (of one list) may be alike and are in different groups."""
        a, b = self.n[i], self.n[j]
        # The first shingle that a pair shares is one of those in its lists: from there on, enough must be left.
        ok = (self.label[i] != self.label[j]) & (9 * np.minimum(np.minimum(a, b), np.minimum(a - self.pos[i], b - self.pos[j])) >= 4 * (a + b))
        at = np.flatnonzero(ok)
        differ = np.bitwise_count(self.bits[i[at]] ^ self.bits[j[at]]).sum(1, dtype=np.int64)
        ok[at] = 9 * (a[at] + b[at] - differ) >= 8 * (a[at] + b[at])  # twice what is common is at most a + b - differ
        return ok

    def joined(self, i: int, j: int, low: int, high: int) -> None:
        part = self.label[low:high]
        part[part == self.label[j]] = self.label[i]

    def pairs(self, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates; every: all of them, else those that put together, as links, all that the lists would link."""
        cuts = np.flatnonzero(np.diff(self.token)) + 1
        first, last = np.concatenate(([0], cuts)), np.append(cuts, len(self.token))
        size = last - first
        small = np.repeat(size <= SMALL, size)
        for t in range(1, SMALL):
            i = np.flatnonzero(small[: len(self.token) - t] & (self.token[:-t] == self.token[t:])) if t < len(self.token) else np.zeros(0, np.int64)
            ok = i[self.possible(i, i + t)]
            yield ok, ok + t
        for low, high in zip(first[size > SMALL].tolist(), last[size > SMALL].tolist()):
            here = np.arange(low, high)
            if not every:
                order = low + np.argsort(mixed(self.node[here].view(np.uint64) ^ self.token[here].view(np.uint64)))
                for t in range(1, BESIDE + 1):
                    ok = self.possible(order[:-t], order[t:])
                    for i, j in zip(order[:-t][ok].tolist(), order[t:][ok].tolist()):
                        if self.label[i] != self.label[j]:
                            yield np.array([i]), np.array([j])
                            self.joined(i, j, low, high)
            labels, counts = np.unique(self.label[low:high], return_counts=True)
            main = labels[counts.argmax()]
            done = np.zeros(high - low, bool)
            for i in here[self.label[low:high] != main].tolist():  # whoever is not in the largest group, against all others
                done[i - low] = True
                others = here[~done]
                ok = others[self.possible(np.full(len(others), i), others)]
                if every:
                    yield np.full(len(ok), i), ok
                    continue
                for j in ok.tolist():
                    if self.label[i] != self.label[j]:
                        yield np.array([i]), np.array([j])
                        self.joined(i, j, low, high)


def candidates(lists: DataFrame, nodes: DataFrame, every: bool) -> DataFrame:
    """(a, b), a < b: pairs of nodes that may be alike, of lists (token, node, place) and nodes (node, root, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(tables: list[np.ndarray], bits: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            lists = Listed(np.concatenate(tables, axis=1), np.concatenate(bits))
            left, right = [], []
            for i, j in lists.pairs(every):
                left.append(lists.node[i])
                right.append(lists.node[j])
                if len(left) >= 4096:
                    yield pairs_of(left, right)
                    left, right = [], []
            if left:
                yield pairs_of(left, right)

        tables, bits = [], []
        for batch in batches:
            table = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:4]])
            raw = text_bytes(batch.column(4))[0].reshape(-1, PARITY // 8)
            if not len(raw):
                continue
            # The last list may go on in the next batch: all before it is complete.
            cut = len(raw) - int((table[0] == table[0, -1]).sum())
            if cut or tables and tables[-1][0, -1] != table[0, 0]:
                yield from found([*tables, table[:, :cut]], [*bits, raw[:cut]])
                tables, bits = [], []
            tables.append(table[:, cut:])
            bits.append(raw[cut:])
        if tables:
            yield from found(tables, bits)
        trimmed()

    rows = lists.join(nodes, "node").select("token", "node", "place", "root", "bits")
    return rows.repartition("token").sortWithinPartitions("token", "place", "node").mapInArrow(run, "a long, b long").distinct()


def pairs_of(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(left), np.concatenate(right)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def linked(docs: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a near copy; docs with text."""
    texts = docs.select(node_of().alias("node"), "text")
    info = written(surveyed(texts), "info")
    blank = info.filter("n = 0").agg(F.min("node").alias("b"))
    blanks = info.filter("n = 0").select(F.col("node").alias("a")).join(F.broadcast(blank), F.col("a") != F.col("b")).select("a", "b")
    # 1. By SimHash: texts of one fingerprint, and fingerprints that operator 8's index links.
    full = info.filter("n > 0")
    named = full.groupBy("fp").agg(F.min("node").alias("least"))
    same = full.join(named, "fp").filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    near = links(named.select("fp"), MAX_BITS).withColumnRenamed("a", "fa").withColumnRenamed("b", "fb")
    near = near.join(named.select(F.col("fp").alias("fa"), F.col("least").alias("a")), "fa").join(named.select(F.col("fp").alias("fb"), F.col("least").alias("b")), "fb")
    by_print = same.union(near.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    by_print = verified(likely(by_print, full), texts)
    edges = [blanks, by_print.filter("alike").select("a", "b")]
    found = components(edges[0].union(edges[1]))
    # 2. What SimHash leaves: sets of different groups that share a prefix shingle.
    by_token = Window.partitionBy("token")
    lists = posted(texts, *common_shingles(texts, info.count())).repartition("token").distinct()
    lists = written(lists.withColumn("held", F.count(F.lit(1)).over(by_token)).filter("held > 1").drop("held"), "lists")

    def nodes(found: DataFrame) -> DataFrame:
        return full.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "bits")

    tried = written(candidates(lists, nodes(found), every=False), "tried")
    sure = verified(likely(tried, full), texts)
    edges.append(sure.filter("alike").select("a", "b"))
    kept = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    after = components(kept.union(edges[-1]))
    failed = tried.join(edges[-1], ["a", "b"], "left_anti")
    if not failed.isEmpty():
        # A failed candidate had been taken as a link: search the groups that it had put together for all pairs.
        hoped = components(kept.union(tried.select("a", "b")))
        doubtful = failed.join(hoped, F.col("a") == F.col("node")).select("root").distinct()
        again = lists.join(small_side(hoped.join(doubtful, "root", "left_semi").select("node")), "node", "left_semi")
        more = verified(likely(candidates(again, nodes(after), every=True), full), texts).filter("alike").select("a", "b")
        after = components(after.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    return after


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group, columns as before."""
    hashed = [c.name for c in docs.schema.fields if not isinstance(c.dataType, MapType)]
    own = [free_name(docs.columns, n) for n in ("_id", "_hash", "_node")]
    keys = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(own[0]), F.xxhash64(*hashed).alias(own[1])]
    rows = docs.select(F.col("doc_id"), *keys, node_of().alias(own[2]))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(own[1]).alias("hash"), F.col(own[0]).alias("key"))
    each = written(rows.groupBy(own[2], *own[:2]).agg(F.min(rank).alias("rank"), F.count(F.lit(1)).alias("times")), "rows")
    best = each.groupBy(own[2]).agg(F.min("rank").alias("best"))
    rooted = best.join(linked(docs), F.col(own[2]) == F.col("node"), "left").select(F.coalesce("root", own[2]).alias("root"), "best", F.col(own[2]))
    top = written(rooted.groupBy("root").agg(F.min("best").alias("top")), "top")
    told = each.join(rooted.join(top, "root").select(own[2], "top"), own[2]).select(*own[:2], "times", ((F.col("top.hash") == F.col(own[1])) & (F.col("top.key") == F.col(own[0]))).alias("stays"))
    told = written(told, "told")
    gone = small_side(told.filter("not stays or times > 1").select(*own[:2]))
    held = docs.select("*", *keys)
    out = held.join(gone, own[:2], "left_anti").select(*docs.columns)
    equal = told.filter("stays and times > 1").select(*own[:2])
    if not equal.isEmpty():  # rows equal in all columns: one of them
        out = out.union(held.join(small_side(equal), own[:2], "left_semi").dropDuplicates(own[:2]).select(*docs.columns))
    return out
