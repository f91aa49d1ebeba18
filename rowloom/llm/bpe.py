"""Byte-level BPE: texts to token ids by a file of ranks, and ids back to bytes.

Each distinct pre-token is merged once a partition. Pre-tokens of about one length form a padded
matrix of ids; in each round every unfinished row merges its leftmost pair of least rank, found
through a hashed pair table, and closes the gap. A pre-token too long for that keeps the same
order of merges in one dimension, where equal pairs that cannot affect each other merge together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.textkernel import column_bytes, passages
from rowloom.sources.tables import table

NONE = np.int32(2**31 - 1)
#: Longest pre-token, in bytes, of the matrices, whose time grows with its square: half a second here; distinct
#: pre-tokens that a worker remembers at most.
MATRIX_WIDTH, REMEMBERED = 8192, 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """An open-addressed table from pairs of ids to the rank of the token they form."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int | None = None):
        self.bits = bits or max(4, int(len(keys)).bit_length() + 2)
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        seen = self.keys[slot]
        found = np.where(seen == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            found[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return found


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.int64) << 32) | right.astype(np.int64)


class Vocabulary:
    """ranks: a file of lines "base64-token rank"; pattern: what cuts a text into pre-tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        self.rank = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line)}
        self.token = {r: t for t, r in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for t, r in self.rank.items():
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(r)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.known: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a pad (negative) forms none."""
        got = self.pairs.get(pair_keys(np.maximum(left, 0), np.maximum(right, 0)))
        got[(left < 0) | (right < 0)] = NONE
        return got

    def merge_rows(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max())
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        ids[np.arange(width + 1) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width)
        out = np.full((len(pieces), width + 1), -1, np.int32)
        rows = np.arange(len(pieces))
        while len(rows) and ranks.shape[1]:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                live = ~done
                ids, ranks, rows, at, best = ids[live], ranks[live], rows[live], at[live], best[live]
                if not len(rows):
                    break
            n, w = np.arange(len(rows)), ranks.shape[1]
            kept = np.ones((len(rows), w + 1), bool)  # the gap at the pair's right side closes
            kept[n, at + 1] = False
            ids = ids[kept].reshape(len(rows), w)
            ids[n, at] = best
            ranks = ranks[kept[:, 1:]].reshape(len(rows), w - 1)
            has = at < w - 1
            ranks[n[has], at[has]] = self._ranks(ids[n[has], at[has]], ids[n[has], at[has] + 1])
            has = at > 0
            ranks[n[has], at[has] - 1] = self._ranks(ids[n[has], at[has] - 1], ids[n[has], at[has]])
        out[rows, : ids.shape[1]] = ids
        there = out >= 0
        return out[there], there.sum(1)

    def merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        flat, counts = self.merge_rows(pieces)
        return np.split(flat, np.cumsum(counts)[:-1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self._ranks(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            if len(at) > 1:  # of touching pairs every second one merges, from the left
                run = np.concatenate(([0], np.flatnonzero(np.diff(at) != 1) + 1))
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            gone = np.zeros(len(ids), bool)
            gone[at + 1] = True
            merged = ids.copy()
            merged[at] = best
            left = np.where(at > 0, at - 1 - gone[np.maximum(at - 1, 0)], -1)
            before = self._ranks(np.where(left >= 0, merged[left], -1), np.full(len(at), best, np.int32))
            after = at + 2
            old = np.where(after < len(ids), ids[np.minimum(after, len(ids) - 1)], -1)
            early = np.flatnonzero((before < best) | (self._ranks(np.full(len(at), best, np.int32), old) < best))
            if len(early):  # a merge opens a pair of lower rank, which goes first
                at = at[: early[0] + 1]
                gone[:] = False
                gone[at + 1] = True
            ids[at] = best
            ids = ids[~gone]
            ranks = np.delete(ranks, at)
            now = at - np.arange(len(at))
            for touched in (now[now < len(ranks)], now[now > 0] - 1):
                ranks[touched] = self._ranks(ids[touched], ids[touched + 1])
        return ids

    def learn(self, pieces: list[str]) -> None:
        """Adds pre-tokens to those known, each with its ids as little-endian 32-bit integers."""
        rest: list[tuple[bytes, str]] = []
        for p in pieces:
            raw = p.encode()
            whole = self.rank.get(raw)
            if whole is not None:
                self.known[p] = whole.to_bytes(4, "little")
            elif len(raw) > MATRIX_WIDTH:
                self.known[p] = self.merge_long(raw).astype("<u4").tobytes()
            else:
                rest.append((raw, p))
        rest.sort(key=lambda x: len(x[0]))
        at = 0
        while at < len(rest):
            most = max(8, len(rest[at][0]) * 5 // 4)
            end = at
            while end < len(rest) and len(rest[end][0]) <= most and (end - at) * most < 400_000:
                end += 1
            flat, counts = self.merge_rows([r for r, _ in rest[at:end]])
            data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            self.known.update((p, data[a:b]) for (_, p), a, b in zip(rest[at:end], [0, *ends], ends, strict=False))
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(t) for t in texts]
        every = set().union(*cut) if cut else set()
        new = [p for p in every if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(every)
        self.learn(new)
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(ranks, pattern)
    return _loaded[key]


def encode_column(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """docs without text, plus n_tokens, ids (binary, little-endian 32-bit), ids_sha256, decoded_sha256.

    The decoded bytes come from the ids alone. A null or empty text has no ids; repeated rows are
    each encoded; columns of docs that have one of the new names are replaced. The ranks file
    (below 1 MB for the public vocabularies) is read on the driver and sent once to each executor.
    """
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    made = ["n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
    kept = docs.drop(*["n_tokens", "ids", "ids_sha256", "decoded_sha256"])
    others = [c for c in kept.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(sent.value, pattern)
        for batch in batches:
            column = batch.column(len(others))
            _, at = column_bytes(column)
            for a, b in passages(at):
                part = batch.slice(a, b - a)
                ids = vocab.encode([t or "" for t in column.slice(a, b - a).to_pylist()])
                columns = {n: part.column(i) for i, n in enumerate(others)}
                columns["n_tokens"] = pa.array([len(x) // 4 for x in ids], pa.int64())
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.binary())
                columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
                columns["decoded_sha256"] = pa.array([hashlib.sha256(vocab.decode(x)).hexdigest() for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    kinds = {"n_tokens": "long", "ids": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*others).schema] + [f"{n} {kinds[n]}" for n in made])
    return kept.select(*others, text).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
