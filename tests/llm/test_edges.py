"""Empty tables, very long texts, repeated rows and clashing columns of the text operators."""

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from rowloom.llm import bpe, common, media, pii, token_counts

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")
LONG = "long words " * 200_000
ROWS = [(1, "one two"), (1, "one two"), (1, "three"), (None, "one"), (2, None), (3, ""), (4, LONG)]
#: Names that the operators themselves use, inside or in what they return.
CLASH = ["n_tokens", "ids", "_text", "items", "digest", "spans", "n_words", "score", "_salt", "_n", "html", "payload_bytes"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit("mine") for c in CLASH})


def test_token_counts(docs):
    got = token_counts.count_pieces(docs, RANKS)
    assert got.columns == ["doc_id", "n_words", "n_pieces"] and token_counts.count_pieces(docs.limit(0), RANKS).count() == 0
    rows = got.collect()
    assert sorted(r.n_words for r in rows) == sorted(len((t or "").split()) for _, t in ROWS)
    assert len({(r.n_words, r.n_pieces) for r in rows if r.doc_id == 1}) == 2


def test_one_very_long_word_takes_time_in_proportion():
    machine = token_counts.automaton(open(RANKS, "rb").read())
    word = bytes(random.Random(3).choices(b"abcdetsion", k=400_000))
    start = time.time()
    whole = machine.walk([b" " + word])[0]
    assert time.time() - start < 5
    assert whole == machine.walk([b" " + word] + [b" a"] * 100)[0]


def test_bpe(docs):
    got = bpe.encode_column(docs, RANKS, P.PATTERN)
    assert bpe.encode_column(docs.limit(0), RANKS, P.PATTERN).count() == 0
    rows = got.collect()
    assert sorted(r.decoded_sha256 for r in rows) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS)
    assert all(r["items"] == "mine" and r["n_words"] == "mine" for r in rows) and len([r for r in rows if r.doc_id == 1]) == 3


@pytest.mark.parametrize("size", [200, 257, 1000, bpe.MATRIX_WIDTH + 1])
def test_bpe_of_long_pieces_does_not_depend_on_the_form(size):
    vocab = bpe.vocabulary(open(RANKS, "rb").read(), P.PATTERN)
    for letters in (b"ab", b"x", b"abcdefghijklmnop"):
        piece = bytes(random.Random(size).choices(letters, k=size))
        assert vocab.merge_matrix([piece])[0].tolist() == vocab.merge_long(piece).tolist()


def test_personal_data(docs):
    got = pii.find_personal_data(docs)
    assert got.columns == ["doc_id", "spans"] and got.count() == len(ROWS)
    assert pii.find_personal_data(docs.limit(0)).count() == 0
    many = docs.sparkSession.createDataFrame([(1, "a@b.c " * 3000)], "doc_id long, text string")
    spans = pii.find_personal_data(many).first().spans
    assert [(s.start, s.end) for s in spans] == [(6 * k, 6 * k + 5) for k in range(3000)]


def test_media(docs):
    pages = media.sequences(media.pages_of(docs))
    got = media.resolve(pages, media.inspect(media.store(docs, "text")))
    want = sorted(hashlib.sha256(media.payload((t or "").encode())).hexdigest() for _, t in ROWS)
    assert sorted(r.payload_sha256 for r in got.collect()) == want
    empty = media.sequences(media.pages_of(docs.limit(0)))
    assert media.resolve(empty, media.inspect(media.store(docs.limit(0), "text"))).count() == 0


def test_media_of_pages_with_names_of_its_own(spark):
    df = spark.createDataFrame([(1, "<p>a", "i", 3), (1, "<p>a", "i", 3)], "page_id long, html string, items string, position int")
    got = media.sequences(df).collect()
    assert len(got) == 2 and all(r["items"][0].text == "a" and r.position == 3 for r in got)


def _png(width, rows):
    """A grey PNG by the format's description, chunk by chunk."""
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = width.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows), 1)) + chunk(b"IEND", b"")


def test_stored_form_and_feature_against_plain_python(spark):
    for text in ("", "abc", "é" * 700, "".join(map(chr, range(32, 127))) * 40):
        p = text.encode()
        p += b"\xff" * (576 - len(p) % 576 if len(p) % 576 or not p else 0)
        rows = [p[i : i + 576] for i in range(0, len(p), 576)]
        stored = _png(576, rows)
        r = media.inspect(media.store(spark.createDataFrame([(text,)], "raw string"))).first()
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        edges = [int(k * len(p) / 72) for k in range(73)]
        means = [sum(p[a:b]) * 256 // max(b - a, 1) for a, b in zip(edges, edges[1:], strict=False)]
        bits = "".join(str(int(means[9 * i + j + 1] > means[9 * i + j])) for i in range(8) for j in range(8))
        assert r.feature == f"576x{len(rows)} mean {sum(p) * 1000 // len(p)} dhash {int(bits, 2):016x}"


def test_salted_lookup_keeps_rows_and_deals_hot_keys_alike_each_time(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("key"), "id")
    lookup = spark.createDataFrame([(0, "hot"), (4500, "cold")], "key long, v string")
    got = common.salted_lookup(rows, lookup, "key").groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {"hot": 4000, "cold": 1, None: 999}
    assert "rand" not in common.salted_lookup(rows, lookup, "key")._jdf.queryExecution().toString()


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from rowloom.operators import durable

    class Context:
        master = "spark://somewhere:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        durable.checkpoint_folder(Session())
