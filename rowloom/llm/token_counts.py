"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie whose nodes have a failure link and the number of pieces that taking the
link closes. Walking a word touches each byte once, plus the links, and adds up counts; no piece is
built. Words of a batch walk together as numpy vectors, each distinct word once a partition; when few are
left, each walks on by itself, so that a word of any length takes time in proportion to it.

A word is a run of bytes other than space and 09-0D. Pieces that begin with a space begin words, the
others continue them: the word is walked with a space in front.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.bpe import PairTable
from rowloom.llm.textkernel import column_bytes, passages
from rowloom.sources.tables import table

#: Distinct words that a worker remembers at most.
REMEMBERED = 400_000
#: A round of numpy is worth its while for so many words.
TOGETHER = 64


class Automaton:
    """pieces: the vocabulary. A word that no sequence of pieces spells counts as one unknown piece."""

    def __init__(self, pieces: list[bytes]):
        children: dict[int, int] = {}
        parent, byte, depth, final = [0], [0], [0], [False]
        for piece in pieces:
            node = 0
            for c in piece:
                key = (node << 8) | c
                nxt = children.get(key)
                if nxt is None:
                    nxt = children[key] = len(parent)
                    parent.append(node)
                    byte.append(c)
                    depth.append(depth[node] + 1)
                    final.append(False)
                node = nxt
            final[node] = bool(node)
        fail, popped = [-1] * len(parent), [0] * len(parent)
        for node in sorted(range(1, len(parent)), key=depth.__getitem__):
            if final[node]:
                fail[node], popped[node] = 0, 1
                continue
            z, n, c = fail[parent[node]], popped[parent[node]], byte[node]
            while z >= 0 and ((z << 8) | c) not in children:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[node], popped[node] = children[(z << 8) | c], n
        self.goto = PairTable(np.fromiter(children.keys(), np.int64), np.fromiter(children.values(), np.int32))
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int64)
        self.links = children, fail, popped
        self.known: dict[bytes, int] = {}

    def walk_on(self, word: bytes, state: int = 0, count: int = 0) -> int:
        """Pieces of a word whose walk stands in state with count pieces closed; word: what is left of it."""
        children, fail, popped = self.links
        for c in word:
            while (to := children.get((state << 8) | c)) is None:
                if fail[state] < 0:
                    return 1
                count += popped[state]
                state = fail[state]
            state = to
        while state > 0:
            count += popped[state]
            state = fail[state]
        return count if state == 0 else 1

    def walk(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word, all words one byte at a time; the few longest walk on alone."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        buf = np.frombuffer(b"".join(words), np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        state, count, dead = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        live = len(words)
        for at in range(int(sizes[0]) if len(words) else 0):
            while sizes[live - 1] <= at:
                live -= 1
            if live < TOGETHER:
                break
            rows = np.flatnonzero(~dead[:live])
            c = buf[starts[rows] + at].astype(np.int64)
            while len(rows):
                nxt = self.goto.get((state[rows] << 8) | c)
                hit = nxt != 2**31 - 1
                state[rows[hit]] = nxt[hit]
                rows, c = rows[~hit], c[~hit]
                back = self.fail[state[rows]]
                dead[rows[back < 0]] = True
                rows, c, back = rows[back >= 0], c[back >= 0], back[back >= 0]
                count[rows] += self.popped[state[rows]]
                state[rows] = back
        else:
            at, live = 0, 0
        alone = {i: self.walk_on(words[order[i]][at:], int(state[i]), int(count[i])) for i in range(live) if not dead[i]}
        rows = live + np.flatnonzero(~dead[live:] & (state[live:] > 0))
        while len(rows):
            back = self.fail[state[rows]]
            dead[rows[back < 0]] = True
            rows, back = rows[back >= 0], back[back >= 0]
            count[rows] += self.popped[state[rows]]
            state[rows] = back
            rows = rows[back > 0]
        count[dead] = 1
        for i, n in alone.items():
            count[i] = n
        out = np.empty(len(words), np.int64)
        out[order] = count
        return out

    def count(self, text: bytes | list[bytes]) -> list[tuple[int, int]]:
        """(words, pieces) of each text."""
        cut = [t.split() for t in text]
        every = set().union(*cut) if cut else set()
        new = [w for w in every if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(every)
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            self.known.update(zip(some, self.walk([b" " + w for w in some]).tolist(), strict=True))
        return [(len(c), sum(map(self.known.__getitem__, c))) for c in cut]


_loaded: dict[str, Automaton] = {}


def automaton(ranks: bytes) -> Automaton:
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _loaded:
        _loaded[key] = Automaton([base64.b64decode(line.split()[0]) for line in ranks.splitlines() if line])
    return _loaded[key]


def count_pieces(docs: DataFrame, pieces_path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, n_words, n_pieces for each row of docs; pieces_path: lines "base64-piece number".

    A null or empty text has neither; a word of any length is walked whole; repeated rows are each
    counted; other columns are not read. The vocabulary file (below 1 MB for the public ones) is read
    on the driver and sent once to each executor.
    """
    with open(pieces_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(sent.value)
        for batch in batches:
            buf, at = column_bytes(batch.column(1))
            for a, b in passages(at):
                counts = machine.count([buf[at[i] : at[i + 1]].tobytes() for i in range(a, b)])
                n_words, n_pieces = ([c[k] for c in counts] for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n_pieces, pa.int64())],
                    [id_col, "n_words", "n_pieces"],
                )

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_pieces long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
