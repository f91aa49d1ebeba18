"""Dense features of whole documents, as numpy over the bytes of Arrow columns, and labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.textkernel import column_bytes, hash_words, mix, passages, powers, word_hashes, words

_U = np.uint64


def classes(groups: dict[str, bytes]) -> tuple[list[str], np.ndarray]:
    """Names, and a table from byte to class (0: none)."""
    lut = np.zeros(256, np.uint8)
    for k, members in enumerate(groups.values(), 1):
        lut[list(members)] = k
    return list(groups), lut


BYTE_NAMES, BYTE_CLASS = classes(
    {
        "upper": bytes(range(0x41, 0x5B)),
        "lower": bytes(range(0x61, 0x7B)),
        "digit": bytes(range(0x30, 0x3A)),
        "blank": b" \t",
        "line": b"\n\r\x0b\x0c",
        "stop": b".,;:'\"-()",
        "shout": b"!?",
        "sign": b"#$%&*+/<=>@[\\]^_`{|}~",
        "high": bytes(range(0x80, 0x100)),
        "control": bytes([*range(9), *range(14, 32), 127]),
    }
)


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n) if len(rows) else np.zeros(n)


def distinct_share(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row over all its values, and the share of its most frequent value."""
    total = np.bincount(rows, minlength=n).astype(float) if len(rows) else np.zeros(n)
    if not len(rows):
        return np.ones(n), np.zeros(n)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    most = np.zeros(n)
    np.maximum.at(most, r[new], runs)
    at_least = np.maximum(total, 1)
    return np.where(total > 0, np.bincount(r[new], minlength=n) / at_least, 1.0), most / at_least


def quality_features(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of QUALITY_NAMES for each document of a passage."""
    n = len(at) - 1
    size = np.diff(at).astype(float)
    doc = np.repeat(np.arange(n), np.diff(at))
    cls = BYTE_CLASS[buf]
    counts = np.bincount(doc * 16 + cls, minlength=16 * n).reshape(n, 16)[:, 1 : len(BYTE_NAMES) + 1]
    shares = counts / np.maximum(size, 1)[:, None]
    spectrum = np.bincount(doc * 256 + buf, minlength=256 * n).reshape(n, 256) / np.maximum(size, 1)[:, None]
    entropy = -(spectrum * np.log2(np.where(spectrum > 0, spectrum, 1))).sum(1)
    starts, ends, row = words(buf, at)
    hashes = word_hashes(buf, starts, ends)
    length = (ends - starts).astype(float)
    n_words = np.bincount(row, minlength=n).astype(float) if len(row) else np.zeros(n)
    each = np.maximum(n_words, 1)
    mean = per_row(length, row, n) / each
    spread = np.sqrt(np.maximum(per_row(length**2, row, n) / each - mean**2, 0))
    upper = np.concatenate(([0], np.cumsum(cls == 1)))
    lower = np.concatenate(([0], np.cumsum(cls == 2)))
    sign = np.concatenate(([0], np.cumsum((cls == 8) | (cls == 7))))
    loud = ((upper[ends] - upper[starts]) > 0) & ((lower[ends] - lower[starts]) == 0)
    signed = (sign[ends] - sign[starts]) > 0
    bare = signed & ((sign[ends] - sign[starts]) == length)
    distinct, most = distinct_share(hashes, row, n)
    pair_row = row[:-1][row[:-1] == row[1:]] if len(row) else row
    at_pair = np.flatnonzero(row[:-1] == row[1:]) if len(row) else row
    again = hashes[at_pair] == hashes[at_pair + 1]
    pairs, _ = distinct_share(mix(hashes[at_pair] * _U(3) + hashes[at_pair + 1]), pair_row, n) if len(at_pair) else (np.ones(n), None)
    at_five = np.flatnonzero(row[:-4] == row[4:]) if len(row) > 4 else np.zeros(0, int)
    five = sum((hashes[at_five + k] * _U(2 * k + 3) for k in range(5)), _U(0)) if len(at_five) else np.zeros(0, np.uint64)
    fives, most_five = distinct_share(five, row[at_five], n) if len(at_five) else (np.ones(n), np.zeros(n))
    lines = counts[:, BYTE_NAMES.index("line")] + 1.0
    stops = counts[:, BYTE_NAMES.index("stop")] + 1.0
    rest = np.stack(
        [
            np.log1p(size), np.log1p(n_words), entropy, mean, spread, per_row(loud, row, n) / each, per_row(signed, row, n) / each,
            per_row(bare, row, n) / each, distinct, most, per_row(again, pair_row, n) / each, pairs, fives, most_five,
            distinct * np.log1p(n_words), np.log1p(n_words / lines), np.log1p(n_words / stops), per_row(length > 20, row, n) / each, per_row(length < 3, row, n) / each,
        ],
        1,
    )
    return np.concatenate([shares, rest], 1)


QUALITY_NAMES = [
    *(f"share_{n}" for n in BYTE_NAMES), "log_bytes", "log_words", "entropy", "word_mean", "word_spread", "loud_words", "signed_words",
    "bare_signs", "distinct_words", "top_word", "repeated_word", "distinct_pairs", "distinct_fives", "top_five", "distinct_by_log",
    "words_a_line", "words_a_stop", "long_words", "short_words",
]

#: Tokens of the toxicity features: letters and digits; digits stand for letters inside a word.
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Digits and signs that stand for letters.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_PLAIN = np.arange(256, dtype=np.uint8)
for _a, _b in _LEET.items():
    _PLAIN[ord(_a)] = ord(_b)
#: Lengths, in bytes, of the beginnings of words that may enter a lexicon beside whole words.
PREFIXES = (4, 5, 6, 7, 8)
#: Words that address a reader, in the languages of the corpus.
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie",
    "tu", "toi", "te", "vous", "votre", "vos", "ton", "ta", "tes", "ti", "usted", "ustedes", "vosotros", "tus",
)
NEAR_WORDS = 5


def tokens(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of letter-and-digit runs, and the passage with digits read as letters."""
    plain = np.where(_TOKEN[buf], _PLAIN[buf], 0x20).astype(np.uint8)
    return *words(plain, at), plain


def word_keys(plain: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hashes of whole tokens, and for each prefix length (tokens longer than it, hashes of their beginnings)."""
    whole = word_hashes(plain, starts, ends)
    begun = []
    for k in PREFIXES:
        longer = np.flatnonzero(ends - starts > k)
        begun.append((longer, word_hashes(plain, starts[longer], starts[longer] + k) ^ _U(k)))
    return whole, begun


class Lexicon:
    """Keys (hashes of words or beginnings) with weights; a bitmap answers most lookups."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.map = np.zeros(1 << 20, bool)
        self.map[keys >> _U(44)] = True

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        maybe = np.flatnonzero(self.map[keys >> _U(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == keys[maybe], self.weights[at], 0.0)
        return out


TOXIC_NAMES = [
    "log_tokens", "hits", "log_hits", "weight", "mean_weight", "top_weight", "hit_density", "strong_density", "strong_hits", "near_you", "near_you_density",
    "you_density", "upper_share", "loud_tokens", "shout_rate", "sign_rate", "stop_rate", "mixed_tokens", "drawn_out", "spaced_letters",
]


def toxic_features(buf: np.ndarray, at: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """A row of TOXIC_NAMES for each document of a passage."""
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1).astype(float)
    doc = np.repeat(np.arange(n), np.diff(at))
    cls = BYTE_CLASS[buf]
    counts = np.bincount(doc * 16 + cls, minlength=16 * n).reshape(n, 16)
    starts, ends, row, plain = tokens(buf, at)
    whole, begun = word_keys(plain, starts, ends)
    weight = lexicon.get(whole)
    for longer, keys in begun:
        weight[longer] = np.maximum(weight[longer], lexicon.get(keys))
    n_tokens = np.bincount(row, minlength=n).astype(float) if len(row) else np.zeros(n)
    each = np.maximum(n_tokens, 1)
    hit, strong = weight > 0, weight > 3
    hits, total = per_row(hit, row, n), per_row(weight, row, n)
    top = np.zeros(n)
    np.maximum.at(top, row, weight)
    you = np.isin(whole, hash_words(list(SECOND_PERSON)))
    close = np.zeros(len(row), bool)
    for k in range(1, NEAR_WORDS + 1):
        if len(row) > k:
            same = row[:-k] == row[k:]
            close[k:] |= same & you[:-k]
            close[:-k] |= same & you[k:]
    near = per_row(close & hit, row, n)
    upper = np.concatenate(([0], np.cumsum(cls == 1)))
    lower = np.concatenate(([0], np.cumsum((cls == 2) | (cls == 9))))
    digit = np.concatenate(([0], np.cumsum(cls == 3)))
    ups, lows, digs = upper[ends] - upper[starts], lower[ends] - lower[starts], digit[ends] - digit[starts]
    drawn = np.zeros(len(buf), bool)
    if len(buf) > 2:
        drawn[2:] = (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & _TOKEN[buf[2:]] & (doc[2:] == doc[:-2])
    lone = (ends - starts) == 1
    return np.stack(
        [
            np.log1p(n_tokens), hits, np.log1p(hits), total, total / np.maximum(hits, 1), top, hits / each, per_row(strong, row, n) / each, per_row(strong, row, n), near, near / each,
            per_row(you, row, n) / each, counts[:, 1] / size, per_row((ups > 1) & (lows == 0), row, n) / each, counts[:, 7] / size, counts[:, 8] / size,
            counts[:, 6] / size, per_row((digs > 0) & (ups + lows > 0), row, n) / each, per_row(drawn, doc, n) / size, per_row(lone, row, n) / each,
        ],
        1,
    )


def map_passages(docs: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]], schema: str) -> DataFrame:
    """docs' columns but the last, which is a text, and what kernel makes of each passage of the texts."""
    kept = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = column_bytes(batch.column(batch.num_columns - 1))
            for a, b in passages(at):
                columns = {c: batch.column(i).slice(a, b - a) for i, c in enumerate(kept)}
                columns |= kernel(buf[at[a] : at[b]], at[a : b + 1] - at[a])
                yield pa.RecordBatch.from_pydict(columns)

    old = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[:-1]]
    return docs.mapInArrow(run, ", ".join([*old, schema]))


def remainder(id_col: Column, of: int) -> Column:
    """crc32 of an identifier's text, modulo of; a null identifier counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, learn: Callable[[Column], Column], text: str, id_col: str) -> DataFrame:
    """(id, y, text) of at most bound labelled rows, of both labels in their proportion, picked by a hash.

    Rows where learn(id) does not hold are never read for their label. At most bound identifiers are
    broadcast. Of repeated labels of an identifier the largest counts. Rows of docs that share an
    identifier all come; what is gathered from them is bounded again.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    known = known.where(learn(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(bound)
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    return found.select("id", "y", "text")
