"""The deduplication queries over a whole table against brute force."""

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest

from rowloom.llm import minhash, suffix_dedup

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_near_duplicates(spark, documents):
    def shingles(text):
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    same = {}
    for i, t in documents:
        same.setdefault(shingles(t), []).append(i)
    first = {min(ids): s for s, ids in same.items() if s}
    root, holders, links = {i: i for i in first}, {}, 0

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(first):
        shared = Counter()
        for g in first[i]:
            shared.update(holders.get(g, ()))
            holders.setdefault(g, []).append(i)
        for j, both in shared.items():
            if 100 * both >= 85 * (len(first[i]) + len(first[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
                links += 1
    want = {i: (len(s), top(min(ids)) if s else i) for s, ids in same.items() for i in ids}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.op4_minhash(spark, SF).collect()}
    assert got == want and any(len(ids) > 1 for ids in same.values())


def test_repeated_passages(spark, documents):
    raw = [(i, t.encode()) for i, t in documents]
    count = Counter(hash(b[p : p + 400]) for _, b in raw for p in range(len(b) - 399))
    want = {}
    for i, b in raw:
        gone = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - 399):
            if count[hash(b[p : p + 400])] > 1:
                gone[p] += 1
                gone[p + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        want[i] = (len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.op8_suffix_dedup(spark, SF).collect()}
    assert got == want and sum(v[1] > 0 for v in want.values()) > 100
