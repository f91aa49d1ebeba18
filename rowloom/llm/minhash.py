"""Near-duplicate groups: b-bit MinHash signatures, a multi-index Hamming join, exact confirmation.

A document's set is its distinct five-word shingles. Its signature has SYMBOLS minima of 16 bits
in CHUNKS chunks. Two signatures that differ in at most DISTANCE symbols have, by the pigeonhole
principle, a chunk with at most one wrong symbol: so a key for each chunk and each symbol left
out (the one error allowed) makes every such pair meet. At the similarity of 0.85 a pair differs
in 4.8 symbols on average; it meets nowhere with a probability of about 2e-8.

Documents of one set are one vertex. The sets of a key with few of them are paired; sets of keys with
many are compared in tiles of two blocks each, whose kernel keeps pairs to itself and gives out links
that connect what is connected. No member of a key is skipped. Every pair that meets is confirmed or
refused on its whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import connected_components, cut, partitions, salted_lookup, written
from rowloom.llm.textkernel import column_bytes, mix, passages, text_sets
from rowloom.sources.tables import table

WORDS, SYMBOLS, CHUNKS = 5, 32, 8
PER_CHUNK = SYMBOLS // CHUNKS
#: Signatures within this many symbols always meet.
DISTANCE = 2 * CHUNKS - 1
#: Keys of more sets than FEW are compared in tiles of blocks of at most about so many shingles and sets.
FEW, BLOCK_SHINGLES, BLOCK_SETS = 64, 400_000, 512
_seeds = np.random.default_rng(85).integers(1, 2**63, (2, SYMBOLS), dtype=np.uint64)
_TIMES, _PLUS = _seeds[0] * np.uint64(2) + np.uint64(1), _seeds[1]


def _signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of SYMBOLS 16-bit minima; rows without shingles get zeros."""
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), SYMBOLS), "<u2")
    some = np.flatnonzero(sizes)
    if len(some):
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(shingles * _TIMES[k] + _PLUS[k], offsets[some])
            out[some, k] = mix(least) & np.uint64(0xFFFF)
    return out


def _fingerprints(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, independent of its order."""
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(shingles ^ np.uint64(salt)), dtype=np.uint64)))
        out.append(mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def signatures(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, t, n, f1, f2, sig) for each row; t: the first 16 bytes of the text's SHA-256."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, shingles, offsets in text_sets(batch.column(2), WORDS):
                f1, f2 = _fingerprints(shingles, offsets)
                sig = [row.tobytes() for row in _signatures(shingles, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(f1), pa.array(f2), pa.array(sig, pa.binary())],
                    ["id", "t", "n", "f1", "f2", "sig"],
                )

    named = docs.select(F.col(id_col).alias("id"), _digest(F.col(text)).alias("t"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"id {kind}, t binary, n long, f1 long, f2 long, sig binary")


def _keys(sig: Column) -> Column:
    keys = []
    for c in range(CHUNKS):
        for out in range(PER_CHUNK):
            at = [2 * (c * PER_CHUNK + k) + 1 for k in range(PER_CHUNK) if k != out]
            keys.append(F.xxhash64(F.lit(c * PER_CHUNK + out), *[F.substring(sig, p, 2) for p in at]))
    return F.explode(F.array(*keys))


def similar(percent: int):
    """A kernel over (a, b, z_a, z_b): the rows whose sets have that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                sets = []
                for i in (2, 3):
                    # a pair's sides repeat: each text of a batch is unpacked and cut once
                    z = part.column(i).dictionary_encode()
                    whole = pa.array([press.decompress(x.as_py()) for x in z.dictionary], pa.binary()).cast(pa.large_string())
                    ((_, _, shingles, offsets),) = text_sets(whole, WORDS, 1 << 62)
                    sets.append((shingles, offsets, z.indices.to_pylist()))
                (s, p, u), (t, q, v) = sets
                linked = []
                for i, j in zip(u, v, strict=True):
                    x, y = s[p[i] : p[i + 1]], t[q[j] : q[j + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked)) for c in part.columns[:2]], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = 85) -> DataFrame:
    """id_col, n_shingles, component_id, kept for each row of docs; percent: 85 or more.

    component_id is the smallest identifier reachable over links of sets with that similarity; kept
    marks the row with that identifier. A document without words is linked with nothing and kept.
    Identifiers are integers or structs. Rows that share one are judged each by its own set: those
    of one set are kept together, those of different texts may differ in component. A null
    identifier has a null component and is kept. An empty table gives an empty result; other columns
    are not read.
    """
    if percent < 85:
        raise ValueError("the signature distances hold from a similarity of 85 % on")
    rows = cut(signatures(docs, text, id_col))
    # a set is known by its size and 128 bits of its content, and numbered c; one row (id, t) stands for its text
    sets = rows.where("n > 0 AND id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min(F.struct("id", "t")).alias("row"), F.first("sig").alias("sig"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("c"), "n", "f1", "f2", "row.id", "row.t", "sig"))
    sized = _met(sets.select("c", _keys(F.col("sig")).alias("key")))
    wanted = sized.select("c").distinct().join(sets.select("c", "id", "t"), "c")
    texts = written(packed(docs, text, id_col).join(wanted, ["id", "t"]).dropDuplicates(["id", "t", "c"]).select("c", "z"))
    few = sized.where(F.col("size") <= FEW)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, "key").where("x.c < y.c").select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()
    links = _linked(pairs, sets, texts, percent).unionByName(_tiled(sized.where(F.col("size") > FEW), sets, texts, percent))
    root = cut(connected_components(cut(links)).withColumnRenamed("v", "c"))
    least = root.join(sets.select("c", "id"), "c").groupBy("root").agg(F.min("id").alias("least"))
    linked = salted_lookup(root, least, "root").select("c", "least")
    named = sets.join(linked, "c", "left").select("n", "f1", "f2", F.coalesce("least", "id").alias("least"))
    return _answer(rows, named, id_col)


def _met(keys: DataFrame) -> DataFrame:
    """(key, c, size, hub) of the keys (c, key) that several sets have; hub: the first of them.

    Keys with more sets than a partition's even share, at most one for each partition, are broadcast;
    their rows stay where they are.
    """
    shared = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("hub")).where("size > 1"))
    total = shared.agg(F.sum("size")).first()[0] or 0
    hot = F.broadcast(shared.where(F.col("size") > max(1000, total // partitions(keys.sparkSession))))
    rest = keys.join(hot.select("key"), "key", "left_anti").join(shared, "key")
    return cut(rest.unionByName(keys.join(hot, "key").select(rest.columns)))


def _tiled(crowded: DataFrame, sets: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is connected among the sets of keys (key, c, size, hub) with many sets.

    Sets chained by such keys form a group, dealt to blocks of bounded size by a hash; each pair of
    blocks is a tile, whose kernel compares all its sets at once and gives out a spanning forest. A
    group's sets are sent once for each of its blocks, and no pair leaves a tile.
    """
    group = cut(connected_components(crowded.select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct()).select(F.col("v").alias("c"), F.col("root").alias("grp")))
    placed = group.join(sets.select("c", "n"), "c")
    size = placed.groupBy("grp").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"))
    dealt = salted_lookup(placed, size, "grp").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select(F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "c")
    sent = tiles.join(texts, "c").select("tile", "c", "z")
    return sent.repartition("tile").sortWithinPartitions("tile").mapInArrow(forests(percent), "a long, b long")


def linked_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The matrix, off its diagonal, of which sets have that similarity: frequent members by products, rare ones by pairs."""
    d = len(sets)
    size = np.array([len(x) for x in sets])
    _, name = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(d), size)
    times = np.bincount(name)
    both = np.zeros((d, d), np.float32)
    often = np.flatnonzero(times >= 32)
    column = np.full(len(times), -1)
    column[often] = np.arange(len(often))
    for a in range(0, len(often), 4096):
        dense = np.zeros((d, min(4096, len(often) - a)), np.float32)
        at = np.flatnonzero((column[name] >= a) & (column[name] < a + 4096))
        dense[owner[at], column[name[at]] - a] = 1
        both += dense @ dense.T
    rare = np.flatnonzero((times[name] > 1) & (times[name] < 32))
    rare = rare[np.argsort(name[rare], kind="stable")]
    n, o = name[rare], owner[rare]
    flat = both.ravel()
    for k in range(1, 32):  # members k places apart in the list of one shingle
        if len(n) <= k:
            break
        hit = n[k:] == n[:-k]
        i, j = o[:-k][hit], o[k:][hit]
        if not len(i):
            break
        flat += np.bincount(np.concatenate((i * d + j, j * d + i)), minlength=d * d).astype(np.float32)
    both = flat.reshape(d, d)
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a symmetric matrix."""
    new, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not new[start]:
            continue
        new[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            for to in np.flatnonzero(linked[at] & new).tolist():
                new[to] = False
                out.append((at, to))
                todo.append(to)
    return out


def forests(percent: int):
    """A kernel over (tile, c, z) sorted by tile: the links of each tile's spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()

        def work(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            names = t["c"].to_numpy()
            sets = []
            for z in t["z"]:
                whole = pa.array([press.decompress(z.as_py())], pa.binary()).cast(pa.large_string())
                ((_, _, shingles, _),) = text_sets(whole, WORDS, 1 << 62)
                sets.append(shingles)
            some = [i for i, x in enumerate(sets) if len(x)]
            forest = spanning(linked_pairs([sets[i] for i in some], percent)) if some else []
            names = names[some]
            return pa.RecordBatch.from_arrays([pa.array([int(names[i]) for i, _ in forest], pa.int64()), pa.array([int(names[j]) for _, j in forest], pa.int64())], ["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            tile = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tile[a] != last:
                    yield work(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
                    last = tile[a]
        if held:
            yield work(held)

    return run


def packed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, t, z): each text compressed, as texts move more than once."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            buf, at = column_bytes(batch.column(2))
            for a, b in passages(at):
                z = [press.compress(buf[at[i] : at[i + 1]].tobytes()) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(z, pa.binary())], ["id", "t", "z"])

    named = docs.select(F.col(id_col).alias("id"), _digest(F.col(text)).alias("t"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"id {kind}, t binary, z binary")


def _linked(pairs: DataFrame, sets: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose similarity holds, by whole sets, whatever their signatures; sizes rule out some first."""
    size = sets.select("c", "n")
    likely = (
        pairs.join(size.select(F.col("c").alias("a"), F.col("n").alias("n_a")), "a")
        .join(size.select(F.col("c").alias("b"), F.col("n").alias("n_b")), "b")
        .where((F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent))
        .select("a", "b")
    )
    whole = (
        cut(likely)
        .join(texts.select(F.col("c").alias("b"), F.col("z").alias("z_b")), "b")
        .join(texts.select(F.col("c").alias("a"), F.col("z").alias("z_a")), "a")
        .select("a", "b", "z_a", "z_b")
    )
    return cut(whole.mapInArrow(similar(percent), "a long, b long").distinct())


def _answer(rows: DataFrame, named: DataFrame, id_col: str) -> DataFrame:
    salts = 64
    mine = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    heads = mine.where("n > 0 AND id IS NOT NULL").groupBy("n", "f1", "f2", "salt").agg(F.lit(1).alias("_"))
    looked = heads.drop("_").join(named, ["n", "f1", "f2"])
    full = mine.join(looked, ["n", "f1", "f2", "salt"], "left").withColumn("component", F.coalesce("least", "id"))
    return full.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
