"""The ten operators against brute force: random texts with repeats, and the odd cases (nulls, empty and long texts, ties, empty tables, extra columns)."""

import contextlib
import datetime
import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter
from math import log10
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinforge.llm import backoff_lm, bpe_transducer, common, dac_store, decontaminate, feistel_pii, hamming_search, phrase_dedup, simhash_index, suffix_dedup, textscan, unigram_langid
from kinforge.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BPE = vocabulary("word_bpe_49k.json")
ASCII_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def texts(seed=3, n=60):
    r = random.Random(seed)
    vocab = ["the", "of", "and", "Über", "naïve", "x", "don't", "a1", "日本", "re-do", "WORD"] + ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 9))) for _ in range(60)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 120))) for _ in range(n)]
    passage = " ".join(r.choice(vocab) for _ in range(55))
    out = []
    for i, t in enumerate(base):
        if i % 5 == 0:
            t = t + "\n" + passage + " " + r.choice(vocab)
        if i % 7 == 0 and i:
            t = base[i - 1]
        out.append(t)
    return out + [None, "", " \t\n", "same words " * 60, "x" * 700, "\x00nul \x1c sep", passage * 3]


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, t, ["en", "de", None][i % 3], "s", 0) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


def by_id(df):
    rows = df.collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_op1(docs):
    rows = [(t or "").encode() for t in texts()]
    seen = Counter(t[i : i + 200] for t in rows for i in range(len(t) - 199))
    got = by_id(suffix_dedup.op1_suffix(docs))
    hot = by_id(suffix_dedup.deduplicated(docs, hot_classes=1))
    assert sum(r["n_removed"] for r in got.values()) > 1000
    for i, t in enumerate(rows):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want = (len(t), int(gone.sum()), spans, sha(bytes(np.frombuffer(t, np.uint8)[~gone])))
        assert tuple(got[i])[1:] == want and tuple(hot[i])[1:] == want, i


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=120).map(lambda b: bytes(1 + x % 3 for x in b)))
def test_two_stage(data):
    text = np.frombuffer(data, np.uint8)
    order = suffix_dedup.two_stage_order(text, np.ones(len(text), bool), 128).tolist()
    assert [data[i:] for i in order] == sorted(data[i:] for i in range(len(data)))


def thue_morse(n):
    """Two words that polynomial hashes modulo 2 ** 64 cannot tell apart."""
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_look_alike_words(spark):
    x, y = thue_morse(1024)
    lead = " ".join(f"w{i}" for i in range(25))
    docs = table(spark, [f"{lead} {x}", f"{lead} {y}", x, y])
    assert [by_id(phrase_dedup.op2_phrases(docs))[i]["n_removed"] for i in range(4)] == [0, 25, 0, 0]
    got = by_id(decontaminate.op3_decontaminate(docs, spark.createDataFrame([(1, x)], "item_id long, text string")))
    assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) for i in range(4)] == [(1, 1, False), (0, 0, False), (1, 1, True), (0, 0, False)]
    assert [r["n_removed"] for _, r in sorted(by_id(suffix_dedup.op1_suffix(docs)).items())] == brute_1([f"{lead} {x}", f"{lead} {y}", x, y])
    known = by_id(backoff_lm.op6_backoff_lm(table(spark, [x, x, x, x, x, y, x, x, x, x])))
    trained = {x if i != 5 else y for i in range(10) if zlib.crc32(str(i).encode()) % 7 != 2}
    assert all(r["n_known"] == 1 + ((y if i == 5 else x) in trained) for i, r in known.items())


def brute_1(rows):
    """Bytes of each text that are covered by 200-byte strings that start elsewhere too."""
    rows = [(t or "").encode() for t in rows]
    seen = Counter(hash(t[i : i + 200]) for t in rows for i in range(len(t) - 199))
    out = []
    for t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[hash(t[k : k + 200])] > 1:
                gone[k : k + 200] = True
        out.append(int(gone.sum()))
    return out


def test_long_texts(spark):
    """Texts above a scan's chunk and piece."""
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(5000)]
    ws = [r.choice(vocab) for _ in range(1_150_000)]
    passage = ws[1_048_540:1_048_640]  # across a piece's border
    rows = [" ".join(ws[:220_000]) + " ", " ".join(ws[100_000:100_100]), " ".join(ws), " ".join(passage)]
    two = by_id(phrase_dedup.op2_phrases(table(spark, rows)))
    assert [two[i]["n_removed"] for i in range(4)] == [0, 100, 220_000, 100]
    one = by_id(suffix_dedup.op1_suffix(table(spark, rows[:2] + [rows[0][600_000:1_400_000]])))
    assert [one[i]["n_removed"] for i in range(3)] == brute_1(rows[:2] + [rows[0][600_000:1_400_000]])
    three = by_id(decontaminate.op3_decontaminate(table(spark, rows), spark.createDataFrame([("p", " ".join(passage))], "item_id string, text string")))
    assert [three[i]["n_hit"] for i in range(4)] == [0, 0, 100, 100]


def test_many_null_ids(spark):
    """Rows without an id are told apart by their texts alone."""
    r = random.Random(6)
    tail = " ".join(f"t{i}" for i in range(80))
    rows = [" ".join(r.choice("abcdefghijklmnop") * 3 + str(r.randrange(50)) for _ in range(12)) for _ in range(20_000)]
    rows[5] += " " + tail
    rows[777] += " " + tail
    docs = spark.createDataFrame([(None, t) for t in rows], "doc_id long, text string")
    one = suffix_dedup.op1_suffix(docs).filter("n_removed > 0").collect()
    two = phrase_dedup.op2_phrases(docs).filter("n_removed > 0").collect()
    assert len(one) == 2 and all(len(tail) < x["n_removed"] < len(tail) + 6 for x in one) and [x["n_removed"] for x in two] == [80]


def test_op2(docs):
    first, want = {}, {}
    for i, t in enumerate(texts()):
        ws = ASCII_SPACE.sub(" ", t or "").strip(" ").split(" ") if (t or "").strip(" \t\n\r\x0b\x0c") else []
        gone = np.zeros(len(ws), bool)
        for k in range(len(ws) - 19):
            if first.setdefault(tuple(ws[k : k + 20]), (i, k)) != (i, k):
                gone[k : k + 20] = True
        want[i] = (len(ws), int(gone.sum()), sha(" ".join(w for w, g in zip(ws, gone) if not g).encode()))
    assert sum(w[1] for w in want.values()) > 200
    for got in (phrase_dedup.op2_phrases(docs), phrase_dedup.deduplicated(docs, hot_classes=1)):
        assert {i: tuple(r)[1:] for i, r in by_id(got).items()} == want


@pytest.mark.parametrize("block_words", [500_000, 40])
def test_op3(spark, docs, block_words):
    rows = texts()
    items = [(1, " ".join(rows[2].split()[3:30])), (2, "WORD the"), (3, None), (4, "!!"), (5, rows[5][-200:]), (5, "a1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word, fold = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = by_id(decontaminate.contamination(docs, bench, block_words=block_words))
    for i, t in enumerate(rows):
        ws, hit, ids = word.findall((t or "").translate(fold)), set(), set()
        for item, text in items:
            iw = word.findall((text or "").translate(fold))
            size = min(13, len(iw))
            windows = {tuple(iw[k : k + size]) for k in range(len(iw) - size + 1)} if iw else set()
            for k in range(len(ws) - size + 1):
                if tuple(ws[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    ids.add(str(item))
        want = (len(ws), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit) and 20 * len(hit) >= len(ws))
        assert tuple(got[i])[1:] == want, i


def test_op4_and_op7(spark):
    rows = [*texts(), "<|endoftext|>a <|startoftext|", "naïve<|endoftext|>", "İ K Å e\u0301 'S it'S ''s", "\u1e9e\U0001fae8\u0378\U00031350", "a" * 2000]
    docs = table(spark, rows)
    model, want, start = Tokenizer.from_file(BPE), {}, 0
    for i, t in enumerate(rows):
        ids = model.encode(t or "", add_special_tokens=False).ids
        want[i] = (start, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        start += len(ids) + 1
    assert {i: tuple(r)[1:] for i, r in by_id(dac_store.op4_dac(docs, BPE)).items()} == want
    for i, r in by_id(bpe_transducer.op7_bpe(docs, BPE)).items():
        ids = model.encode(rows[i] or "", add_special_tokens=False).ids
        assert tuple(r)[1:] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(model.decode(ids, skip_special_tokens=False).encode())), i


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]) | st.sampled_from("  ''sStTéß日🎉\n\u0301한ㅏ"), max_size=60))
def test_transducer(text):
    t = bpe_transducer.transducer(BPE)
    model = Tokenizer.from_file(BPE) if not hasattr(t, "model") else t.model
    t.model = model
    ids = model.encode(text, add_special_tokens=False).ids
    assert t.encode(text) == ids == [i for part in t.stream(text, step=5) for i in part]
    machine = bpe_transducer.TextDecoder(t)
    assert "".join(map(machine.feed, ids)) + machine.finish() == model.decode(ids, skip_special_tokens=False)
    if "<|" not in text:
        pieces = t.pieces(text)
        assert (t.lockstep(pieces) if pieces else []) == [t.piece_ids(p) for p in pieces]


def test_lookahead(monkeypatch):
    """Tokens come out before a pre-token ends, they are the library's, and what is held stays within the lookahead and a block."""
    t, r, model = bpe_transducer.transducer(BPE), random.Random(11), Tokenizer.from_file(BPE)
    monkeypatch.setattr(bpe_transducer, "BLOCK", 40)
    assert 0 < t.lookahead < 1000
    for k in range(60):
        parts = r.sample(["a", "ae", "lo", "ha", "the", "e", "o", "in", "ing", "!", "日", "é", "1", "'s"], r.randint(1, 5))
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 3000)))
        assert [i for part in t.stream(text, step=r.choice([9, 100, 5000])) for i in part] == model.encode(text, add_special_tokens=False).ids, text[:60]
    run, early = bpe_transducer.Run(t), []
    for _ in range(500):
        early += run.push("ae" * 10)
        assert len(run.held) <= t.lookahead + 40 + 20
    assert len(early) > 2000 and early + run.close() == model.encode("ae" * 5000, add_special_tokens=False).ids


def test_op7_long_word(spark, monkeypatch):
    model = Tokenizer.from_file(BPE)
    rows = ["a" * 200_000, "word " + "日本" * 40_000 + " end", "x<|endoftext|>" * 6000]
    got = by_id(bpe_transducer.op7_bpe(table(spark, rows), BPE))
    for i, t in enumerate(rows):
        ids = model.encode(t, add_special_tokens=False).ids
        assert tuple(got[i])[1:] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(model.decode(ids, skip_special_tokens=False).encode())), i


@pytest.mark.parametrize("hashes", [None, 3])
def test_word_table(monkeypatch, hashes):
    """Values of words, whatever the table forgets, and whether or not its first hash tells words apart."""
    if hashes:
        whole = textscan.word_hashes
        monkeypatch.setattr(textscan, "word_hashes", lambda d, s, e, seed=1: whole(d, s, e, seed) % (8 if seed == 1 else 2**63))
    table, r, asked = textscan.WordTable(3000, np.uint16), random.Random(4), []

    def learn(new):
        asked.extend(new)
        return [np.frombuffer(w.upper(), np.uint8).astype(np.uint16) for w in new]

    for k in range(60):
        ws = [b"often", *(b"w%d" % r.randrange(k, k + 30) for _ in range(r.randrange(40)))]
        data = np.frombuffer(b" ".join(ws), np.uint8)
        start, end, _ = textscan.words(data, np.array([0, len(data)]), textscan.SPACE)
        values, sizes = table.gathered(table.rows(data, start, end, learn))
        assert bytes(values.astype(np.uint8)) == b"".join(ws).upper() and sizes.tolist() == [*map(len, ws)]
        assert table.values.nbytes + 32 * len(table.keys) < 3000 + 41 * 40
    assert asked.count(b"often") < 5 and (hashes is None or table.seed == 3)


def test_held():
    assert common.held("a", dict) is common.held("a", dict)
    common.held("b", dict)
    assert list(common._held) == ["b"]
    common.released()
    assert not common._held


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=1500), st.sampled_from([3, 8, 12]))
def test_dac(ids, bits):
    codes = dac_store.Codes(dac_store.pack(np.array(ids, np.uint32), bits))
    assert codes.slice(0, len(ids)).tolist() == ids and [codes[i] for i in range(0, len(ids), 7)] == ids[::7]
    assert codes.slice(len(ids) // 3, len(ids) // 2).tolist() == ids[len(ids) // 3 : len(ids) // 2]


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000])
def test_permutation(n):
    p = feistel_pii.Permutation(b"k", "t", n)
    moved = [p(i) for i in range(n)]
    assert sorted(moved) == list(range(n)) and all(a != i and p.undo(a) == i for i, a in enumerate(moved))


def test_op5(spark):
    values = ["4111 1111 1111 1111", "ann.b@mail.example.com", "10.20.30.40", "+1 (743) 555-3824", "123-45-6789", "2020-02-29", "GB82 WEST 1234 5698 7654 32", "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"]
    rows = [f'see {v} or "{v}" now' if i < 7 else f'token = "{v}" (secrets are quoted)' for i, v in enumerate(values)] + [None, "", "clean text with 3 numbers 1999 and 12345", "4111 1111 1111 1112", "999.1.1.1 2021-02-30"]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows)], "doc_id long, text string, pii string, kinds string")
    got = by_id(feistel_pii.op5_pii(docs, b"key"))
    for i, v in enumerate(values):
        assert v not in got[i]["text"] and got[i]["n_values"] >= 1, v
    assert [got[i]["text"] for i in range(len(values), len(rows))] == rows[len(values) :]
    p = feistel_pii.Pseudonyms(b"key")
    card = re.sub(r"\D", "", p.card("4111111111111111"))
    assert feistel_pii.luhn_digit(card[:-1]) == card[-1] and p.card("4111-1111-1111-1111").replace("-", "") == card
    day = p.date("2020-02-29")
    assert datetime.date.fromisoformat(day) and p.date("29.2.2020") == f"{int(day[8:])}.{int(day[5:7])}.{day[:4]}"
    assert p.iban(p.iban("GB82WEST12345698765432")) is not None
    assert p.email("Ab.1@x.org").lower() == p.email("aB.1@x.org").lower()


def test_op6(docs):
    rows, fold = texts(), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = re.compile(r"[^\x20\x09-\x0D]+")
    toks = [[*word.findall((t or "").translate(fold)), None] for t in rows]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(rows))]
    for order in (3, 2, 4):
        c = Counter()
        for t, used in zip(toks, train):
            for n in range(1, order + 1):
                c.update(tuple(t[k : k + n]) for k in range(len(t) - n + 1) if used)
        ones = {g[0]: v for g, v in c.items() if len(g) == 1}
        n_all, kinds = sum(ones.values()), len(ones)
        n1, n2 = (sum(v == k for v in ones.values()) for k in (1, 2))
        d = min(0.9, n1 / (n1 + 2 * n2))

        def p(g):
            if len(g) == 1:
                return (c[g] - d) / n_all if c[g] else d * kinds / n_all
            low, prior = p(g[1:]), backoff_lm.PRIORS[min(len(g) - 2, 1)]
            return (c[g] + prior * low) / (c[g[:-1]] + prior) if c[g[:-1]] else low

        assert abs(sum(p((w,)) for w in ones) + d * kinds / n_all - 1) < 1e-9
        got = by_id(backoff_lm.op6_backoff_lm(docs) if order == 3 else backoff_lm.scored(docs, backoff_lm.id_crc32(backoff_lm.F.col("doc_id")) % 7 != 2, order=order, batch_bytes=700))
        for i, t in enumerate(toks):
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train[i], len(t), sum(w in ones for w in t), n_all)
            assert r["base_score"] == pytest.approx(sum(log10((ones.get(w, 0) + 1) / (n_all + kinds + 1)) for w in t))
            assert r["score"] == pytest.approx(sum(log10(p(tuple(t[max(0, k - order + 1) : k + 1]))) for k in range(len(t)))), (order, i)


def shuffle_files(spark):
    """Bytes of each shuffle file that lies on this machine's local disk."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    sizes = {}
    for f in [f for d in dirs for f in Path(d.getPath()).glob("*/shuffle_*.data")]:
        with contextlib.suppress(FileNotFoundError):  # it may go meanwhile
            sizes[f.name] = f.stat().st_size
    return sizes


def test_op6_keeps_no_shuffle_of_written_tables(spark):
    r, key = random.Random(5), common.CLEANUP
    docs = table(spark, [" ".join(f"w{r.randrange(10**6)}" for _ in range(1000)) for _ in range(200)])
    for setting in ("true", "false"):
        spark.conf.set(key, setting)
        before = shuffle_files(spark)
        scored = backoff_lm.scored(docs, backoff_lm.F.lit(True), batch_bytes=100_000)
        assert spark.conf.get(key) == setting
        for _ in range(50):  # files go in the background
            left = sum(v for k, v in shuffle_files(spark).items() if k not in before)
            if left < 50_000:
                break
            time.sleep(0.1)
        assert left < 50_000, left  # sums of bytes and of counts only; the n-grams are megabytes
    spark.conf.unset(key)
    assert len(by_id(scored)) == 200


@pytest.mark.parametrize("values", [[], [0, 1, 255], [0, 256], [2**40, 0, 3]])
def test_op6_counts_are_compressed(values):
    assert backoff_lm.widened(backoff_lm.narrow(np.array(values, np.int64))).tolist() == values
    mostly_ones = np.append(np.ones(10_000, np.int64), values)
    assert backoff_lm.widened(backoff_lm.narrow(mostly_ones)).tolist() == mostly_ones.tolist() and len(backoff_lm.narrow(mostly_ones)) < 5000


def components(fps, ids, bits=4):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for i, x in enumerate(label):
        least[x] = min(least.get(x, ids[i]), ids[i])
    return {ids[i]: least[x] for i, x in enumerate(label)}


@pytest.mark.parametrize("limit", [4096, 1])
def test_op8(spark, limit):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(40)]
    for k in range(60):
        f = fps[r.randrange(len(fps))]
        for b in r.sample(range(64), r.randint(0, 7)):
            f ^= 1 << b
        fps.append(f)
    ids = list(range(len(fps)))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in set(fps)], "fp long")
    roots = {x["node"] % 2**64: x["root"] for x in simhash_index.components(simhash_index.links(nodes, list_limit=limit)).collect()}
    got = {}
    for i, f in enumerate(fps):
        got.setdefault(roots.get(f, f if f < 1 << 63 else f - (1 << 64)), set()).add(i)
    want = {}
    for i, c in components(fps, ids).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_op8_docs(docs):
    rows = texts()
    fps = [simhash_index.fingerprint((t or "").encode()) for t in rows]
    want = components(fps, list(range(len(rows))))
    got = by_id(simhash_index.op8_simhash(docs))
    assert {i: (int(r["fingerprint"], 16), r["component_id"]) for i, r in got.items()} == {i: (fps[i], want[i]) for i in want}
    assert fps[rows.index("")] == 0


def test_op9(spark):
    r = random.Random(2)
    vocab = {"en": "the of and to in that with from".split(), "de": "der die und das nicht mit auf für".split()}
    rows = [(i, " ".join(r.choice(vocab[l]) for _ in range(30)), l, "s") for i in range(80) for l in ["en" if i % 2 else "de"]] + [(100, None, "en", "s"), (101, "12 34 !!", "en", "s"), (102, "der die und", None, "s")]
    got = by_id(unigram_langid.op9_langid(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), vocabulary("piece_bpe_32k.model")))
    assert all(got[i]["lang_pred"] == l for i, _, l, _ in rows[:80]) and (got[100]["lang_pred"], got[101]["lang_pred"], got[102]["lang_pred"]) == ("und", "und", "de")
    assert all(0 <= x["score"] <= 1 and x["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items())


def test_forward():
    path = vocabulary("piece_bpe_32k.model")
    ids, _, _ = unigram_langid.pieces(path)
    table = np.log(np.random.default_rng(1).dirichlet(np.ones(32000), 3).T + 1e-9)
    f = unigram_langid.Forward(path, table)
    f.prepare()
    words = ["hello", "über", "日本x", "a", "nonsensewordthatisverylongindeedlongerthanthirtytwo"]
    got = f.words([w.encode() for w in words])
    for w, row in zip(words, got):
        text = "▁" + w
        sums = [np.ones(3)] + [np.zeros(3) for _ in text]
        for j in range(1, len(text) + 1):
            for i in range(j):
                if (p := ids.get(text[i:j])) is not None:
                    sums[j] = sums[j] + sums[i] * np.exp(table[p])
                elif j == i + 1:
                    sums[j] = sums[j] + sums[i] * np.array(f.bytes_of(text[i]))
        assert np.allclose(row, np.log(sums[-1])) and np.allclose(row, f.word(w.encode()))


def test_op10(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(30, 64))
    v = np.concatenate([base + r.normal(size=(30, 64)) * 0.4 for _ in range(10)])
    rows = [(i, [float(x) for x in row], 0) for i, row in enumerate(v)] + [(900, None, 0), (None, [1.0] * 64, 0), (901, [], 0), (5, [float(x) for x in v[5]], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, distance int")
    code = v > 0
    for got in (hamming_search.op10_search(table), hamming_search.nearest(table, block=1, slice_rows=64)):
        answers = {}
        for x in sorted(got.collect(), key=lambda x: (x["query_id"], x["rank"])):
            answers.setdefault(x["query_id"], []).append((x["distance"], x["neighbor_id"]))
        assert answers == {q: sorted((int((code[q] != code[i]).sum()), i) for i in range(300) if i != q)[:10] for q in (0, 100, 200)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    for got in (suffix_dedup.op1_suffix(none), phrase_dedup.op2_phrases(none), decontaminate.op3_decontaminate(none, bench), dac_store.op4_dac(none, BPE), feistel_pii.op5_pii(none, b"k"), backoff_lm.op6_backoff_lm(none), bpe_transducer.op7_bpe(none, BPE), simhash_index.op8_simhash(none), unigram_langid.op9_langid(none, vocabulary("piece_bpe_32k.model")), hamming_search.op10_search(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert got.collect() == []


def test_null_ids_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, long, "en", "s", 1), (7, long, "en", "s", 1), (7, long, None, None, None), (7, "other", "en", "s", 1), (None, None, None, None, None)], DOCS)
    one = suffix_dedup.op1_suffix(docs).collect()
    assert len(one) == 5 and sorted(r["n_removed"] for r in one) == [0, 0] + [len(long)] * 3
    two = phrase_dedup.op2_phrases(docs).collect()
    assert len(two) == 5 and sorted((r["doc_id"] or -1, r["n_removed"]) for r in two) == [(-1, 0), (-1, 0), (7, 0), (7, 60), (7, 60)]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    bench = spark.createDataFrame([(None, long), ("i", "other"), ("i", "other")], "item_id string, text string")
    three = decontaminate.op3_decontaminate(docs, bench).collect()
    assert sorted((*key(r), r["n_words"], r["n_hit"], r["n_items"]) for r in three) == [(False, 7, 1, 1, 1), (False, 7, 60, 0, 0), (False, 7, 60, 0, 0), (True, 0, 0, 0, 0), (True, 0, 60, 0, 0)]
    model = Tokenizer.from_file(BPE)
    sizes = [len(model.encode(t, add_special_tokens=False).ids) for t in (long, "other", "")]
    four = dac_store.op4_dac(docs, BPE).collect()
    assert sorted((*key(r), r["n_tokens"]) for r in four) == sorted([(True, 0, sizes[0] + 1), (False, 7, sizes[0] + 1), (False, 7, sizes[0] + 1), (False, 7, sizes[1] + 1), (True, 0, 1)])
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"] is None) for r in four)
    assert [a for a, _, _ in starts] == [0, *np.cumsum([n for _, n, _ in starts])[:-1].tolist()] and [x for _, _, x in starts] == [True, True, False, False, False]
    five = feistel_pii.op5_pii(docs, b"k").collect()
    assert sorted((*key(r), r["text"] or "", r["n_values"]) for r in five) == sorted([(True, 0, long, 0), (False, 7, long, 0), (False, 7, long, 0), (False, 7, "other", 0), (True, 0, "", 0)])
    six = backoff_lm.op6_backoff_lm(docs).collect()
    trained = [zlib.crc32(b"") % 7 != 2, zlib.crc32(b"7") % 7 != 2]
    assert sorted((*key(r), r["n_tokens"], r["held_out"]) for r in six) == sorted([(True, 0, 61, not trained[0]), (False, 7, 61, not trained[1]), (False, 7, 61, not trained[1]), (False, 7, 2, not trained[1]), (True, 0, 1, not trained[0])])
    seven = bpe_transducer.op7_bpe(docs, BPE).collect()
    assert sorted((*key(r), r["n_tokens"]) for r in seven) == sorted([(True, 0, sizes[0]), (False, 7, sizes[0]), (False, 7, sizes[0]), (False, 7, sizes[1]), (True, 0, 0)])
    eight = simhash_index.op8_simhash(docs).collect()
    assert sorted((*key(r), r["component_id"]) for r in eight if r["component_id"] is not None) == [(False, 7, 7), (False, 7, 7), (False, 7, 7), (True, 0, 7)] and len(eight) == 5
    nine = unigram_langid.op9_langid(docs, vocabulary("piece_bpe_32k.model")).collect()
    assert sorted((*key(r), r["held_out"]) for r in nine) == sorted([(k is None, k or 0, zlib.crc32(str(k or "").encode()) % 3 == 1) for k in (None, 7, 7, 7, None)])


def test_segments(spark):
    """Several segments a task, documents longer than one, and ids by chunks of other sizes."""
    rows = texts()
    model = Tokenizer.from_file(BPE)
    want, start = {}, 0
    for i, t in enumerate(rows):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for bits in (5, 12):
        segments = dac_store.write_segments(table(spark, rows), BPE, bits=bits, segment_ids=150)
        assert segments.count() > 20 and segments.groupBy("part").count().agg({"count": "max"}).first()[0] > 3
        assert {i: tuple(r)[1:] for i, r in by_id(dac_store.read_documents(segments)).items()} == want


def test_langid_brute_force(spark):
    """The whole query on a small table: learning by enumerated segmentations, then scores; ties go to the first language; many languages."""
    path = vocabulary("piece_bpe_32k.model")
    ids, fallback, _ = unigram_langid.pieces(path)
    rows = [(i, t, l) for i, (t, l) in enumerate([("ab cab", "x"), ("bad cab", "y"), ("ab cab", "x"), ("dab bad", "y"), ("cab", None), ("éa b", "x"), ("7 7", "y"), (None, "x"), ("ab bad ab", "y"), ("dab", "x")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(unigram_langid.op9_langid(docs, path))

    def segmentations(t):
        if not t:
            yield []
        for k in range(1, len(t) + 1):
            if (p := ids.get(t[:k])) is not None:
                yield from ([p, *r] for r in segmentations(t[k:]))
            elif k == 1:
                yield from ([*(fallback[b] for b in t[0].encode()), *r] for r in segmentations(t[1:]))

    size = max([*ids.values(), *fallback]) + 1
    p = {l: Counter() for l in "xy"}
    prob = lambda l, i: (p[l][i] + 0.1) / (sum(p[l].values()) + 0.1 * size) if p[l] else 1 / size
    for _ in range(unigram_langid.ROUNDS):
        counts = {l: Counter() for l in "xy"}
        for i, t, l in rows:
            if t and l and zlib.crc32(str(i).encode()) % 3 != 1:
                for w in t.split():
                    every = [(s, np.prod([prob(l, x) for x in s])) for s in segmentations("▁" + w)]
                    total = sum(v for _, v in every)
                    for s, v in every:
                        for x in s:
                            counts[l][x] += v / total
        p = counts
    for i, t, _ in rows:
        if not t or not any(map(str.isalpha, t)):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        ll = {l: sum(log10(sum(np.prod([prob(l, x) for x in s]) for s in segmentations("▁" + w))) for w in t.split()) for l in "xy"}
        best = max(sorted(ll), key=ll.get)
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(1 / sum(10 ** (v - ll[best]) for v in ll.values()), rel=1e-6), i
    same = spark.createDataFrame([(i, "one two", l) for i in range(12) for l in ("b", "a")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], round(r["score"], 9)) for r in unigram_langid.op9_langid(same, path).collect()} == {("a", 0.5)}
    dirty = spark.range(3000).selectExpr("id doc_id", "'some text here' text", "concat('l', id) lang").unionByName(docs.select((docs["doc_id"] + 9000).alias("doc_id"), "text", docs["lang"]))
    names, _ = unigram_langid.learn(dirty, path)
    assert len(names) == unigram_langid.MAX_LANGS and {"x", "y"} <= set(names)


def test_phones():
    p, found = feistel_pii.Pseudonyms(b"key"), ["+1 (017) 555-7713", "(073) 555-8658", "010-555-1234", "+1 555 123 4567", "555 123 4567", "1 055 123 4567", "(743) 555-3824"]
    for v in found:
        counts = Counter()
        new = p.replace(f"call {v} now", counts)
        assert v not in new and counts == {"phone": 1} and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", f"call {v} now"), v
    assert p.replace("+1 (017) 555-7713", Counter())[1:2] == "1" and len({re.sub(r"\D", "", p.phone(v))[-10:] for v in ("0175557713", "(017) 555-7713", "+1 017.555.7713")}) == 1


def test_more_formats():
    p = feistel_pii.Pseudonyms(b"key")
    for v, shape in (("2020/02/29", r"\d{4}/\d\d/\d\d"), ("3 March 1984", r"\d+ [A-Z][a-z]+ \d{4}"), ("March 3, 1984", r"[A-Z][a-z]+ \d+, \d{4}"), ("gb82west12345698765432", r"gb\d\d[a-z]{4}\d{14}"), ("2001:db8::8a2e:370:7334", r"[0-9a-f:]+"), ("192.168.001.010", r"(\d{3}\.){3}\d{3}"), ("ann@bücher.example", r"[a-z]{3}@bücher\.example"), ("api_key=a8f3Kd93jfk2LQ0x", r"api_key=\w{16}"), ("password: hunter2hunter2hunter2", r"password: \w{21}")):
        new = p.replace(f"see {v} here", Counter())
        assert v not in new and re.fullmatch(f"see {shape} here", new), (v, new)
    assert p.date("2020/02/29").replace("/", "-") == p.date("2020-02-29") and p.named("29 February 2020").split()[-1] == p.date("2020-02-29")[:4]
    for clean in ("at 12:30:45 today", "::1", "token: word", "31 February 2020", "ab12 some words that follow here", "5551234567"):
        assert p.replace(clean, Counter()) == clean
    with pytest.raises(ValueError):
        feistel_pii.pseudonymised(None, b"")


def test_op5_query_brute_force(spark):
    """The query's rows, value by value, from lists of what each text holds; equal values get equal pseudonyms in all documents."""
    r = random.Random(2)
    kinds = {"email": "u{}@mail.example", "ssn": "2{:02d}-45-6789", "date": "19{:02d}-07-14", "ip": "10.0.0.{}", "phone": "(743) 555-00{:02d}"}
    plans = [[(k := r.choice(sorted(kinds)), kinds[k].format(r.randrange(10, 30))) for _ in range(r.randrange(6))] for _ in range(60)] + [[], None]
    rows = [(i, None if plan is None else " ".join(["and", *(f"w{n} {v}, then" for n, (_, v) in enumerate(plan))])) for i, plan in enumerate(plans)]
    rows += [(3, rows[3][1]), (None, rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = feistel_pii.op5_pii(docs, b"key").collect()
    assert len(got) == len(rows)
    p, images = feistel_pii.Pseudonyms(b"key"), {}
    for row, (i, text) in zip(sorted(got, key=lambda x: (x["doc_id"] is None, x["doc_id"] or 0)), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))):
        plan = plans[4 if i is None else i] or []
        want = text
        for kind, v in plan:
            images.setdefault((kind, v), getattr(p, kind)(v))
        if text is not None:
            want = " ".join(["and", *(f"w{n} {images[kind, v]}, then" for n, (kind, v) in enumerate(plan))])
        counts = Counter(k for k, _ in plan)
        assert (row["doc_id"], row["text"], row["n_values"], row["kinds"]) == (i, want, len(plan), ",".join(f"{k}:{counts[k]}" for k in sorted(counts)))
    assert len(set(images.values())) == len(images) and all(x != v for (_, v), x in images.items())


def test_forward_long_words():
    """A language that falls twice as fast mustn't stop at a floor, whether a word is short or long."""
    path = vocabulary("piece_bpe_32k.model")
    table = np.full((len(unigram_langid.pieces(path)[0]) + 300, 2), -700.0)
    table[unigram_langid.pieces(path)[0]["z"]] = [-8, -16]
    table[unigram_langid.pieces(path)[0]["▁"]] = [-8, -16]
    f = unigram_langid.Forward(path, table)
    f.prepare()
    for n in (20, 31, 100, 500, 1000):
        got = f.words([b"z" * n])[0]
        assert np.allclose(got, [-8 * (n + 1), -16 * (n + 1)]) and np.allclose(got, f.word(b"z" * n)), n


def test_texts_above_a_slice(spark):
    """Ops 4, 6, 7, 8 and 9 on a text above their slices, beside short ones; and the session's tables go when told to."""
    r = random.Random(12)
    vocab = [("".join(r.choice("abcdeéß") for _ in range(r.randint(2, 9)))) + r.choice(["", "", ".", "!"]) for _ in range(3000)]
    rows = ["short text", " ".join(r.choice(vocab) for _ in range(260_000)), "short text", " ".join(vocab[:300])]
    assert len(rows[1].encode()) > 1_500_000
    docs, model, start = table(spark, rows), Tokenizer.from_file(BPE), 0
    four, seven = by_id(dac_store.op4_dac(docs, BPE)), by_id(bpe_transducer.op7_bpe(docs, BPE))
    for i, t in enumerate(rows):
        ids = model.encode(t, add_special_tokens=False).ids
        assert tuple(four[i])[1:] == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        assert tuple(seven[i])[1:] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(model.decode(ids, skip_special_tokens=False).encode()))
        start += len(ids) + 1
    six = by_id(backoff_lm.scored(docs, backoff_lm.F.lit(True), batch_bytes=100_000))
    assert [six[i]["n_tokens"] for i in range(4)] == [len(t.split()) + 1 for t in rows] and six[0]["score"] == six[2]["score"]
    eight = by_id(simhash_index.op8_simhash(docs))
    assert [int(eight[i]["fingerprint"], 16) for i in range(4)] == [simhash_index.fingerprint(t.encode()) for t in rows] and eight[2]["component_id"] == 0
    ws = rows[1].split()
    bits = np.zeros(64, int)
    for k in range(len(ws) - 3):
        h = xxhash.xxh64_intdigest(" ".join(ws[k : k + 4]).encode(), 42)
        bits += np.array([h >> b & 1 for b in range(64)])
    assert simhash_index.fingerprint(rows[1].encode()) == sum(1 << b for b in range(64) if 2 * bits[b] > len(ws) - 3)
    assert all(x["lang_pred"] in ("en", "de") for x in by_id(unigram_langid.op9_langid(docs, vocabulary("piece_bpe_32k.model"))).values())
    paths = list(spark._llm_written)
    assert common.discarded(spark) == len(paths) > 3 and not any(os.path.exists(p) for p in paths) and common.discarded(spark) == 0
