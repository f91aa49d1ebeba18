"""Exact, near and passage deduplication against brute force, with the awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from rowloom.llm import exact_dedup, minhash, suffix_dedup

SCHEMA = "doc_id long, text string, keep_id string, group_size string, _sha string"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa la mu nu xi omikron".split()) + str(rng.randint(0, 40)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [words(rng, n) for n in (3, 4, 5, 6, 40, 80, 200, 900)]
    out = [None, "", "  \t", "A b C d É", "a B c d É", "a b c d é", "x" * 3000]
    for w in base:
        for edits in (0, 0, 1, 2, 4, 9):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = f"edit{rng.randint(0, 999)}"
            out.append(" ".join(v))
            out.append("\n".join(v).upper())
    return out


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(spark, texts, keep):
    got = {r.doc_id: r for r in exact_dedup.content_runs(frame(spark, texts), keep=keep).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            best = min(ids) if keep == "min" else max(ids)
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest())


def test_exact_keeps_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(7, "a"), (7, "A"), (3, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.content_runs(df, keep="max").collect()
    assert sum(r.kept for r in got if r.text_sha256 == hashlib.sha256(b"a").hexdigest()) == 1
    assert [r.kept for r in got if r.text_sha256 == hashlib.sha256(b"b").hexdigest()] == [True]
    assert exact_dedup.content_runs(df.limit(0)).count() == 0


def sets_of(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("few", [64, 1])
def test_near(spark, texts, few, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK_SETS", 6)
    s = [sets_of(t) for t in texts]
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            n = len(s[i] & s[j])
            if s[i] and s[j] and 100 * n >= 85 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i in range(len(s)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s[i]), find(i), find(i) == i)


def test_near_takes_empty_tables_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (9, "a b c d e f g")], "doc_id long, text string")
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    got = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (4, 4, True), (4, 4, True), (9, 4, False)]


def test_pigeonhole_keys_meet_at_any_allowed_distance():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, minhash.SYMBOLS)
        b = a.copy()
        b[rng.choice(minhash.SYMBOLS, minhash.DISTANCE, replace=False)] ^= 1
        differ = (a != b).reshape(minhash.CHUNKS, -1).sum(1)
        assert differ.min() <= 1


def test_linked_pairs_equal_brute_force():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**40, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: 300 - k], rng.integers(0, 2**40, k).astype(np.uint64)))) for k in range(0, 60)]
    got = minhash.linked_pairs(sets, 85)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            n = len(np.intersect1d(x, y))
            assert i == j or got[i, j] == (100 * n >= 85 * (len(x) + len(y) - n))


def test_passages(spark):
    rng = random.Random(9)
    shared = " ".join(words(rng, 70))[:450]
    t = [None, "", "a" * 1000, "ab" * 400, "x" * 399, "x" * 400, "y" * 400, "y" * 400, shared, shared[20:440], "é" * 200 + "q", "é" * 200]
    t += [" ".join(words(rng, 20)) + shared + " ".join(words(rng, 30)) for _ in range(6)]
    t += [shared[:300] + " ".join(words(rng, 100)), "hello " * 90, "so hello " * 2 + "hello " * 66]
    raw = [(x or "").encode() for x in t]
    count = {}
    for b in raw:
        for p in range(len(b) - 399):
            count[b[p : p + 400]] = count.get(b[p : p + 400], 0) + 1
    got = {r.doc_id: r for r in suffix_dedup.repeated_passages(frame(spark, t)).collect()}
    assert len(got) == len(t)
    for i, b in enumerate(raw):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i


def test_passages_of_an_empty_table(spark):
    assert suffix_dedup.repeated_passages(frame(spark, ["a"]).limit(0)).count() == 0


def test_deep_shallow_sort_orders_rows_and_gives_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 60))
        sizes, group = rng.integers(0, 100, n), np.sort(rng.integers(0, 3, n))
        base, m = rng.integers(97, 99, 100), np.zeros((n, 100), np.uint8)
        for i in range(n):
            x = base.copy()
            k = int(rng.integers(0, 101))
            x[k:] = rng.integers(97, 99, 100 - k)
            m[i, : sizes[i]] = x[: sizes[i]]
        order, common = suffix_dedup.deep_shallow_sort(m, sizes, group)
        rows = [(group[i], m[i, : sizes[i]].tobytes()) for i in order]
        assert rows == sorted(rows)
        for (g, a), (h, b), c in zip(rows, rows[1:], common[1:], strict=False):
            k = 0
            while g == h and k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            assert c == k


def brute_passages(raw):
    count = {}
    for b in raw:
        for p in range(len(b) - 399):
            count[b[p : p + 400]] = count.get(b[p : p + 400], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        out.append((len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def test_passages_of_hot_anchors_are_split(spark, monkeypatch):
    rng = random.Random(12)
    shared = " ".join(words(rng, 130))[:800]
    t = [" ".join(words(rng, 12)) + shared + " ".join(words(rng, 12)) for _ in range(12)]
    # near the edges of the passage, few bytes on one side are common to few texts
    t += [" ".join(words(rng, 20)) + shared[k : k + 390 + k % 60] + " ".join(words(rng, 20)) for k in range(0, 380, 19)]
    t += [shared[:600], shared[:600], "hello " * 90, "so hello " * 2 + "hello " * 66, shared[100:500], None, ""]
    sizes = []
    plain = suffix_dedup.halved

    def spied(occurrences):
        settled, groups = plain(occurrences)
        whole = occurrences.groupBy("h").count().agg({"count": "max"}).first()[0]
        sizes.append((whole, max([r["count"] for g in groups for r in g.groupBy("h").count().collect()], default=0)))
        return settled, groups

    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "FEW", 3)
    monkeypatch.setattr(suffix_dedup, "halved", spied)
    got = {r.doc_id: r for r in suffix_dedup.repeated_passages(frame(spark, t)).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) for i in range(len(t))] == brute_passages([(x or "").encode() for x in t])
    # before, all occurrences of an anchor were sorted in one task
    assert sizes[0][0] > 12 and sizes[0][1] <= 3


def _content_reference(rows, keep):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(fold), []).append(i)
    return sorted((i, (max if keep == "max" else min)(g), len(g), i == (max if keep == "max" else min)(g)) for t, g in groups.items() for i in g)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_hot_texts_are_cut_into_pieces_and_merged_whole(spark, keep):
    rows = [(i, "The Same Text" if i % 3 else f"text {i}") for i in range(900)] + [(1000 + i, "the same text") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = exact_dedup.hot_texts(docs.selectExpr("sha2(lower(text), 256) AS _sha"), 20).collect()
    assert len(hot) == 1 and hot[0]["_pieces"] > 1  # so pieces of different salts do meet below
    got = exact_dedup.content_runs(docs, keep, least_hot=20).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == _content_reference(rows, keep)


def test_pieces_with_one_digest_and_different_texts_stay_apart(spark):
    heads = spark.createDataFrame([("d", 0, 1, "a", 5, 2), ("d", 1, 1, "a", 3, 4), ("d", 1, 2, "b", 1, 7)], "_sha string, _salt int, _run long, _norm string, _best long, _n long")
    got = sorted((r["_salt"], r["_run"], r["keep_id"], r["group_size"], r["_wins"]) for r in exact_dedup.merge_pieces(heads, "min").collect())
    assert got == [(0, 1, 3, 6, False), (1, 1, 3, 6, True), (1, 2, 1, 7, True)]
