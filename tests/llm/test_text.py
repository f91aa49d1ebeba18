"""Tokens, personal data, media and mixing against brute force, round trips and libraries."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import bpe, media, mixing, pii, token_counts

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")


def texts():
    rng = random.Random(2)
    out = [None, "", " ", "a", "<|endoftext|>", "naïve façade — 東京 😀😀", "a" * 3000, "ab" * 400, " " * 900, "\n\t\r\x0b\x0c x"]
    out += ["".join(rng.choice("abc de\n1é😀'st") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    return out + [base64.b64encode(rng.randbytes(3000)).decode()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts())], "doc_id long, text string, n_tokens string")


def test_ids_equal_tiktoken_and_decode(docs):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(RANKS, "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_column(docs, RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts()):
        ids = np.array(want.encode_ordinary(t or ""), "<u4").tobytes()
        assert (bytes(got[i].ids), got[i].n_tokens) == (ids, len(ids) // 4)
        assert got[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_piece_counts_equal_greedy_matching(docs):
    pieces = {base64.b64decode(line.split()[0]) for line in open(RANKS, "rb")}
    longest = max(map(len, pieces))

    def greedy(word):
        n = at = 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces)
            n += 1
        return n

    got = {r.doc_id: r for r in token_counts.count_pieces(docs, RANKS).collect()}
    for i, t in enumerate(texts()):
        w = (t or "").encode().split()
        assert (got[i].n_words, got[i].n_pieces) == (len(w), sum(greedy(b" " + x) for x in w))


def test_automaton_counts_a_word_without_pieces_as_one():
    a = token_counts.Automaton([b" a", b" ab", b"b", b"bcd", b"c"])
    assert a.walk([b" abcd", b" abc", b" abcb", b" z", b" abz"]).tolist() == [1, 2, 3, 1, 1]  # greedy takes " ab" and "c", and no piece begins with "d"


def luhn(d):
    s = [int(c) for c in d[::-1]]
    return (sum(s[0::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t, re.ASCII) if ok(m[0])]
    return out


PERSONAL = [
    None, "", "é a.b@c.d.e, x@y a@b.c@d.e 😀 q@r.s%t@u.v", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 000001.2.3.255 1.2.3.256 7.7.7.99999999999999",
    "4417744280351547 4417 7442 8035 1547 4417-7442-8035-1548 4417744280351547 0", "+1 (377) 555-0271, +12, +1234567890123456 +1-2-3-4-5-6-7-8-9",
    "DE89 3704 0044 0532 0130 00 account, DE88370400440532013000", "my SSN is 123-45-6789; 123-45-6789", "social security 000-12-3456", "a" * 20000 + "@", "1" * 5000, "@" * 300,
]


def test_personal_data(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(PERSONAL)], "doc_id long, text string, spans int")
    got = {r.doc_id: [(s.kind, s.start, s.end, s.score) for s in r.spans] for r in pii.find_personal_data(df).collect()}
    for i, t in enumerate(PERSONAL):
        assert [s[:3] for s in got[i] if s[0] in pii.BASE] == base_spans(t or ""), t
    assert [s[0] for s in got[6]].count("iban") == 1
    assert [(s[0], s[1]) for s in got[7] if s[0] == "ssn"] == [("ssn", 10)]  # a context ends at the neighbouring match
    assert not [s for s in got[8] if s[0] == "ssn"]
    assert all(len(s) == 4 and 0 < s[3] <= 1 for v in got.values() for s in v)


def test_png_round_trip_and_damage():
    for raw in (b"", b"x", bytes(range(256)) * 9, b"\xff" * 576):
        p = media.payload(raw)
        assert len(p) % media.WIDTH == 0 and p and p.startswith(raw) and set(p[len(raw) :]) <= {255}
        assert media.from_png(media.to_png(p)).tobytes() == p
    with pytest.raises(ValueError):
        stored = bytearray(media.to_png(b"a" * 576))
        stored[60] ^= 1
        media.from_png(bytes(stored))


def test_sequences_keep_order_positions_and_captions(spark):
    html = '<p>one<br>two</p><figure><img src="sha256:x" alt="alt"><figcaption>cap</figcaption></figure><script>no</script>three<img src="u">'
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>open & <b>bold")], "page_id long, html string")
    got = {r.page_id: [(i.position, i.kind, i.text or i.ref, i.caption) for i in r["items"]] for r in media.sequences(df).collect()}
    assert got[1] == [(0, "text", "one", None), (1, "text", "two", None), (2, "media", "sha256:x", "cap"), (3, "text", "three", None), (4, "media", "u", "")]
    assert got[2] == [] and [x[2] for x in got[3]] == ["open & bold"]


def test_media_of_documents(spark):
    t = [None, "", "a<b>&c\nd", "a<b>&c\nd", "é" * 288, "z" * 5000]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    pages = media.sequences(media.pages_of(df))
    got = {r.doc_id: r for r in media.resolve(pages, media.inspect(media.store(df, "text"))).collect()}
    assert len(got) == len(t)
    for i, x in enumerate(t):
        p = media.payload((x or "").encode())
        assert (got[i].payload_sha256, got[i].payload_bytes, got[i].tail_crc32) == (hashlib.sha256(p).hexdigest(), len(p), zlib.crc32(p[-32:]))
    assert got[2].media_sha256 == got[3].media_sha256


def test_an_unknown_digest_resolves_to_nulls(spark):
    pages = media.sequences(spark.createDataFrame([(1, f'<img src="sha256:{"0" * 64}">')], "page_id long, html string"))
    known = media.inspect(media.store(spark.createDataFrame([("a",)], "raw string")))
    assert media.resolve(pages, known).first().payload_bytes is None


def test_mixing_follows_rates_and_is_repeatable(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "big").otherwise(F.when(F.col("id") % 2 == 0, "small")).alias("source"), F.lit(0).alias("mix_copy"))
    got = mixing.mix(df, weights={"big": 1.0, "small": 3.0}, rows=8000)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(n) == {"big", "small"} and abs(n["big"] - 2000) < 5 * 2000**0.5 and abs(n["small"] - 6000) < 5 * 6000**0.5
    per = Counter(r.doc_id for r in got.where("source = 'small'").collect())
    assert abs(np.mean([c == 0 for c in (per.get(i, 0) for i in range(2, 6000, 6))]) - np.exp(-6)) < 0.02
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(df.repartition(3), weights={"big": 1.0, "small": 3.0}, rows=8000).collect()))
    keys = [r.mix_key for r in got.collect()]
    assert keys == sorted(keys)


def test_mixing_takes_null_sources_and_empty_tables(spark):
    df = spark.createDataFrame([(i, None) for i in range(50)] + [(None, "a")], "doc_id long, source string")
    assert mixing.mix(df).where("source IS NULL").count() > 20
    assert mixing.mix(df.limit(0)).count() == 0


def test_account_numbers_before_capitals_and_digits(spark):
    from rowloom.llm import pii

    de, gb = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    texts = [f"{de} BIC COBADEFFXXX", f"{de} 2024-01-01", f"IBAN {gb} {de} A1", f"{de} end", f"{gb}77", "DE88 3704 0044 0532 0130 00 BIC", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [t[s.start : s.end] for s in r.spans if s.kind == "iban"] for r in pii.find_personal_data(df).collect() for t in [texts[r.doc_id] or ""]}
    assert [got[i] for i in range(len(texts))] == [[de], [de], [gb, de], [de], [], [], []]
