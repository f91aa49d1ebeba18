"""Removal of repeated passages: every byte covered by a LENGTH-byte string that starts elsewhere too.

Sorting all suffixes of a corpus would move each byte many times. Instead, every LENGTH-byte window
names an anchor inside it, the leftmost of its GRAM-byte strings with the least hash: equal windows
have equal anchors at equal places, and one anchor serves about 180 windows. Only anchors whose hash
occurs again send the bytes of their windows to the task of that hash. There the right and the
reversed left sides of an anchor's occurrences are sorted as suffixes by deep-shallow sorting: by
multikey quicksort up to SHALLOW bytes, then by a blind trie for each block that still ties. The
neighbours' common prefixes of both orders tell, for each way to lay a window over the anchor, which
occurrences agree on all of it.

An anchor with very many occurrences is found in a sample of the texts and dealt out (halved): the
lengths left of the anchor are halved again and again; for one part of them, only occurrences that
agree on the bytes common to all its windows stay together, and those that agree on all its bytes are
settled and go on as one. What is down to FEW occurrences is sorted in a task like any other.

Equal texts are one text with a count: if it has LENGTH bytes, all of it goes. Windows that repeat in
one text, as in runs of one word, are found there, so that only the first of them is sent.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import cut, salted_lookup, written
from rowloom.llm.textkernel import _CODES, column_bytes, mix, passages, powers
from rowloom.sources.tables import table

LENGTH, GRAM = 400, 32
REACH = LENGTH - GRAM
SHALLOW = 64
#: One text in SAMPLE is looked at for hot anchors: those with more than HOT occurrences, and more than a MOST-th of
#: all, so that at most MOST are sent to the tasks. They are split until a task sorts at most FEW at once.
SAMPLE, HOT, MOST, FEW = 64, 4096, 4_000_000, 1024


# --- deep-shallow sort ---------------------------------------------------------------------------


def multikey_quicksort(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows of 8-byte characters inside each group; the order, and for each place the first place of its block.

    Every open block is parted at once, around the median of three of its rows' characters at the block's
    depth, into the rows below, equal and above; the equal ones go on to the next character. A block is
    closed when it has one row or no character is left: then its rows are equal.
    """
    n, width = keys.shape
    order = np.argsort(group, kind="stable")
    g = group[order]
    fresh = np.ones(n, bool)
    fresh[1:] = g[1:] != g[:-1]
    block = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if n else np.zeros(0, np.int64)
    depth = np.zeros(n, np.int64)
    open_ = np.flatnonzero(np.bincount(block, minlength=n)[block] > 1) if n else block
    while len(open_):
        first, d = block[open_], depth[open_]
        c = keys[order[open_], d]
        head = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        size = np.diff(np.append(head, len(open_)))
        a, m, z = c[head], c[head + size // 2], c[head + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, m), np.minimum(np.maximum(a, m), z)), size)
        side = (c >= pivot).astype(np.int64) + (c > pivot)
        part = first * 3 + side
        by = np.argsort(part, kind="stable")
        part = part[by]
        order[open_] = order[open_[by]]
        new = np.concatenate(([True], part[1:] != part[:-1]))
        count = np.diff(np.append(np.flatnonzero(new), len(open_)))
        block[open_] = np.repeat(open_[new], count)
        depth[open_] = d[by] + (side[by] == 1)
        open_ = open_[(np.repeat(count, count) > 1) & (depth[open_] < width)]
    return order, block


def blind_trie(strings: list[bytes]) -> list[int]:
    """The order of strings of one length, by a trie whose inner nodes hold a depth and one byte for each branch.

    A string goes down by those bytes alone, is compared in full with the leaf it ends at, and branches off
    its path at the depth where the two part. Equal strings share a leaf.
    """
    width = len(strings[0])
    numbers = [int.from_bytes(s, "big") for s in strings]
    root: tuple | list = [0]
    for i in range(1, len(strings)):
        s, at, path = strings[i], root, []
        while type(at) is tuple:
            path.append(at)
            at = at[1].get(s[at[0]]) or next(iter(at[1].values()))
        differ = (numbers[i] ^ numbers[at[0]]).bit_length()
        if not differ:
            at.append(i)
            continue
        common = width - (differ + 7) // 8
        place = bisect_left(path, common, key=itemgetter(0))
        if place < len(path) and path[place][0] == common:
            path[place][1][s[common]] = [i]
            continue
        node = (common, {strings[at[0]][common]: path[place] if place < len(path) else at, s[common]: [i]})
        if place:
            depth, branches = path[place - 1]
            branches[s[depth]] = node
        else:
            root = node
    out, todo = [], [root]
    while todo:
        at = todo.pop()
        if type(at) is tuple:
            todo += [child for _, child in sorted(at[1].items(), reverse=True)]
        else:
            out += at
    return out


def deep_shallow_sort(matrix: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the rows of a byte matrix (zero-padded to lengths) inside each group.

    Returns the order and, for each place in it, the common prefix with the row before (0 for the
    first of a group), never longer than either row. Multikey quicksort orders the rows by their first
    SHALLOW bytes; each block of rows that agree on those is ordered by a blind trie of whole rows.
    """
    n, width = matrix.shape
    padded = np.zeros((n, SHALLOW), np.uint8)
    padded[:, : min(width, SHALLOW)] = matrix[:, :SHALLOW]
    order, block = multikey_quicksort(padded.view(">u8").astype(np.uint64), group)
    if n and width > SHALLOW:
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        for a, b in zip(first.tolist(), np.append(first[1:], n).tolist(), strict=True):
            if b - a > 1:
                rows = order[a:b]
                order[a:b] = rows[blind_trie([row.tobytes() for row in matrix[rows]])]
    common = np.zeros(n, int)
    for a in range(1, n, 8192):
        p, q = order[a - 1 : min(a + 8191, n - 1)], order[a : a + 8192]
        differs = matrix[p] != matrix[q]
        at = differs.argmax(1)
        at = np.where(differs[np.arange(len(at)), at], at, width)
        common[a : a + 8192] = np.where(group[p] == group[q], np.minimum(at, np.minimum(lengths[p], lengths[q])), 0)
    return order, common


# --- windows and anchors of a text ---------------------------------------------------------------


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The leftmost place of the least value in each run of width values."""
    n = len(values) - width + 1
    size = -(-len(values) // width) * width
    full = np.full(size, np.uint64(2**64 - 1))
    full[: len(values)] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1)  # least from the block's start
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1]  # least to the block's end
    least = np.minimum(behind.ravel()[:n], ahead.ravel()[width - 1 : width - 1 + n])
    # leftmost place of that value: of those to the right of the window's start, the next one
    place = np.arange(size)
    at_behind = np.where(full == behind.ravel(), place, size).reshape(-1, width)
    at_behind = np.minimum.accumulate(at_behind[:, ::-1], 1)[:, ::-1].ravel()  # nearest place, from here, of a suffix least
    steps = np.where(np.concatenate((np.ones((len(blocks), 1), bool), ahead[:, 1:] < ahead[:, :-1]), 1), place.reshape(-1, width), 0)
    at_ahead = np.maximum.accumulate(steps, 1).ravel()  # first place of the prefix least
    left = behind.ravel()[:n] == least
    return np.where(left, at_behind[:n], at_ahead[width - 1 : width - 1 + n])


class Windows:
    """The windows of one text: segments of successive windows with one anchor."""

    def __init__(self, text: np.ndarray):
        self.text = text
        n = len(text)
        self.repeated = np.zeros(0, np.int64)  # starts of windows that repeat inside the text
        if n < LENGTH:
            self.anchor = self.first = self.last = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[text] * up[:n], out=total[1:])
        grams = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
        place = _sliding_least(grams, REACH + 1)
        change = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        sent = None
        if len(change) > 6 * (n // REACH + 2):  # a text that repeats itself
            whole = mix((total[LENGTH:] - total[:-LENGTH]) * down[: n - LENGTH + 1])
            order = np.argsort(whole, kind="stable")
            near = np.flatnonzero(whole[order][1:] == whole[order][:-1])
            a, b = order[near], order[near + 1]
            same = np.concatenate([self._equal(a[i : i + 4096], b[i : i + 4096]) for i in range(0, len(a), 4096)]) if len(a) else np.zeros(0, bool)
            self.repeated = np.unique(np.concatenate((a[same], b[same])))
            sent = np.ones(len(place), bool)
            sent[b[same]] = False
            cuts = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (sent[1:] != sent[:-1]))))
            change = cuts[sent[cuts]]
            ends = np.append(cuts[1:], len(place))[sent[cuts]] - 1
        else:
            ends = np.append(change[1:], len(place)) - 1
        self.first, self.last, self.anchor = change, ends, place[change]
        self.hash = grams[self.anchor]

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = np.arange(LENGTH)
        return (self.text[a[:, None] + step] == self.text[b[:, None] + step]).all(1)


def shared_windows(left_order, left_common, right_order, right_common) -> list[tuple[np.ndarray, int, int]]:
    """For one anchor's occurrences: (rows, least, most) such that, for each number of bytes left of the
    anchor from least to most, every one of the rows has a window equal to another's."""
    g = len(left_order)
    cuts = np.unique(np.concatenate(([0], LENGTH - right_common[1:], left_common[1:] + 1)))
    cuts = cuts[(cuts >= 0) & (cuts <= REACH)]
    ends = np.append(cuts[1:] - 1, REACH)
    out = []
    right_class, left_class = np.empty(g, np.int64), np.empty(g, np.int64)
    for lo, hi in zip(cuts.tolist(), ends.tolist(), strict=True):
        apart = right_common < LENGTH - lo
        if apart[1:].all():
            continue
        right_class[right_order] = np.cumsum(apart)
        apart = left_common < lo
        left_class[left_order] = np.cumsum(apart) if lo else 0
        _, name, count = np.unique(right_class * (g + 1) + left_class, return_inverse=True, return_counts=True)
        rows = np.flatnonzero(count[name] > 1)
        if len(rows):
            out.append((rows, lo, hi))
    return out


def _kernel(group: np.ndarray, tid: list, anchor: np.ndarray, offset: np.ndarray, contexts: list[bytes]) -> tuple[list, list, list]:
    """Removed ranges (tid, from, to) of whole groups of occurrences."""
    n = len(contexts)
    size = np.fromiter(map(len, contexts), np.int64, n)
    right, left = np.zeros((n, LENGTH), np.uint8), np.zeros((n, REACH), np.uint8)
    for i, c in enumerate(contexts):
        b = np.frombuffer(c, np.uint8)
        o = offset[i]
        right[i, : size[i] - o] = b[o:]
        left[i, :o] = b[:o][::-1]
    ro, rc = deep_shallow_sort(right, size - offset, group)
    lo, lc = deep_shallow_sort(left, offset, group)
    first = np.flatnonzero(np.concatenate(([True], group[ro][1:] != group[ro][:-1])))
    last = np.append(first[1:], n)
    tids, starts, stops = [], [], []

    def add(rows, least, most):
        for i in rows:
            tids.append(tid[i])
            starts.append(int(anchor[i] - most))
            stops.append(int(anchor[i] - least + LENGTH))

    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a == 2:
            r, q = int(rc[a + 1]), int(lc[a + 1])
            if r + q >= LENGTH:
                add((ro[a], ro[a + 1]), LENGTH - r, q)
            continue
        base = int(ro[a:b].min())
        for rows, least, most in shared_windows(lo[a:b] - base, lc[a:b], ro[a:b] - base, rc[a:b]):
            add((rows + base).tolist(), least, most)
    return tids, starts, stops


# --- the distributed part ------------------------------------------------------------------------


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, text) to (tid, anchors, own): the distinct anchor hashes of a text and how often each names windows in
    it; and the ranges of the windows that repeat inside the text."""
    for batch in batches:
        buf, at = column_bytes(batch.column(1))
        for a, b in passages(at):
            hashes, times, lo, hi = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(a, b):
                w = Windows(buf[at[i] : at[i + 1]])
                h, k = np.unique(w.hash, return_counts=True)
                s, e = _spans(w.repeated, w.repeated + LENGTH)
                for column, values in ((hashes, h), (times, k), (lo, s), (hi, e)):
                    column.append(values)
            lists = []
            for names, parts in ((("h", "times"), (hashes, times)), (("lo", "hi"), (lo, hi))):
                ends = pa.array(np.cumsum([len(x) for x in parts[0]]), pa.int32())
                fields = [pa.array(np.concatenate(x).view(np.int64)) for x in parts]
                lists.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], ["tid", "anchors", "own"])


def _contexts(batches: Iterator[pa.RecordBatch], fixed: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(tid, text, hs) to (h, tid, anchor, offset, context): the bytes of the windows of the anchors in hs, or in fixed."""
    for batch in batches:
        buf, at = column_bytes(batch.column(1))
        wanted = batch.column(2) if fixed is None else None
        for a, b in passages(at):
            hashes, owners, anchors, offsets, contexts = [], [], [], [], []
            for i in range(a, b):
                text = buf[at[i] : at[i + 1]]
                w = Windows(text)
                again = np.flatnonzero(np.isin(w.hash.view(np.int64), np.asarray(wanted[i].values) if fixed is None else fixed))
                hashes.append(w.hash.view(np.int64)[again])
                owners.append(np.full(len(again), i))
                anchors.append(w.anchor[again])
                offsets.append(w.anchor[again] - w.first[again])
                raw = text.tobytes()
                contexts += [raw[f : e + LENGTH] for f, e in zip(w.first[again].tolist(), w.last[again].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(hashes)), batch.column(0).take(pa.array(np.concatenate(owners))),
                    pa.array(np.concatenate(anchors).astype(np.int64)), pa.array(np.concatenate(offsets).astype(np.int64)), pa.array(contexts, pa.binary()),
                ],
                ["h", "tid", "anchor", "offset", "context"],
            )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences sorted by h to removed ranges; whole groups at a time, many small ones together."""

    def work(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        h = t["h"].to_numpy()
        _, group = np.unique(h, return_inverse=True)
        many = np.bincount(group)[group] > 1
        t, group = t.filter(pa.array(many)), group[many]
        order = np.argsort(group, kind="stable")
        t, group = t.take(pa.array(order)), group[order]
        tids, starts, stops = ([], [], []) if not len(group) else _kernel(group, t["tid"].to_pylist(), t["anchor"].to_numpy(), t["offset"].to_numpy(), t["context"].to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], ["tid", "lo", "hi"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h = np.asarray(batch.column(0))
        cutoff = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
        if held and (cutoff or h[0] != np.asarray(held[-1].column(0))[-1]):
            # everything before the batch's last group is complete
            if cutoff:
                held.append(batch.slice(0, cutoff))
                batch = batch.slice(cutoff)
            if rows + cutoff >= 4000:
                yield work(held)
                held, rows = [], 0
            else:
                rows += cutoff
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield work(held)


def _spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges merged where they overlap or touch."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, text, copies, ranges) to the result columns of each distinct text."""
    for batch in batches:
        buf, at = column_bytes(batch.column(1))
        copies, ranges = batch.column(2).to_pylist(), batch.column(3)
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for i in range(batch.num_rows):
            text = buf[at[i] : at[i + 1]]
            n = len(text)
            if copies[i] > 1 and n >= LENGTH:
                s, e = np.array([0]), np.array([n])
            else:
                found = ranges[i].values
                known = [np.asarray(found.field(k)) if len(found) else np.zeros(0, np.int64) for k in ("lo", "hi")]
                s, e = _spans(*known)
            raw, place, rest = text.tobytes(), 0, hashlib.sha256()
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                rest.update(raw[place:a])
                place = b
            rest.update(raw[place:])
            for k, v in zip(out, (n, int((e - s).sum()), len(s), rest.hexdigest()), strict=True):
                out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["tid", *out])


ANCHORS = "tid binary, anchors array<struct<h:long,times:long>>, own array<struct<lo:long,hi:long>>"
OCCURRENCE = "h long, tid binary, anchor long, offset long, context binary"


def sorted_ranges(occurrences: DataFrame) -> DataFrame:
    """(tid, lo, hi): what the occurrences of each h remove, sorted in the task of h."""
    return occurrences.repartition("h").sortWithinPartitions("h").mapInArrow(_ranges, "tid binary, lo long, hi long")


def hot_anchors(rows: DataFrame) -> DataFrame:
    """(h): anchor hashes with very many occurrences in different texts, by a sample of the texts (tid, text)."""
    few = rows.where(F.pmod(F.xxhash64("tid"), F.lit(SAMPLE)) == 0).groupBy("tid").agg(F.first("text").alias("text"))
    counts = few.mapInArrow(_anchors, ANCHORS).select(F.inline("anchors")).groupBy("h").agg(F.sum("times").alias("times"))
    many = cut(counts.where(F.col("times") > HOT // SAMPLE))
    if many.isEmpty():
        return many.select("h")
    total = counts.agg(F.sum("times")).first()[0]
    return cut(many.where(F.col("times") > total // MOST).select("h"))


def _digest(data: Column, *parts: str) -> Column:
    name = F.concat_ws(":", *[F.col(p).cast("string") for p in parts], F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.encode(name, "utf-8"), data), 256), 1, 32))


def _part(rows: DataFrame, least: Column, most: Column) -> DataFrame:
    """Occurrences cut to the windows with least to most bytes left of the anchor; those without one go."""
    lo = F.greatest(least, F.col("offset") + LENGTH - F.length("context"))
    hi = F.least(most, F.col("offset"))
    cut_to = rows.select("h", "tid", "anchor", "offset", "context", least.alias("least"), most.alias("most"), lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    context = F.col("context").substr((F.col("offset") - F.col("hi") + 1).cast("int"), (F.col("hi") + LENGTH - F.col("lo")).cast("int"))
    return cut_to.select("h", "tid", "anchor", F.col("hi").cast("long").alias("offset"), context.alias("context"), "least", "most")


def halved(occurrences: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Removed ranges (tid, lo, hi) of occurrences (h, tid, anchor, offset, context) of hot anchors, and what is
    left to be sorted: groups, named by h, of at most FEW occurrences.

    A part's core is what all its windows share. Occurrences with different cores have no equal window in
    the part. Of those with equal bytes all windows are equal: each is settled, and one goes on for the
    others to meet. A part of one window is its core, so that at most ten rounds are needed.
    """
    settled, groups = [], []
    state = _part(occurrences, F.lit(0), F.lit(REACH))
    while True:
        core = F.col("context").substr((F.col("offset") - F.col("least") + 1).cast("int"), F.lit(LENGTH) + F.col("least") - F.col("most"))
        rows = cut(state.withColumn("core", _digest(core, "h", "least", "most")).withColumn("all", _digest(F.col("context"), "h", "least", "most", "offset")))
        if rows.isEmpty():
            return settled, groups
        one = F.struct("h", "tid", "anchor", "offset", "context", "least", "most", "core")
        heads = cut(rows.groupBy("all").agg(F.count(F.lit(1)).alias("n"), F.first(one).alias("one")))
        equal = salted_lookup(rows.select("all", "tid", "anchor", "offset", F.length("context").alias("size")), heads.where("n > 1").select("all", "n"), "all")
        start = F.col("anchor") - F.col("offset")
        settled.append(cut(equal.where("n IS NOT NULL").select("tid", start.alias("lo"), (start + F.col("size")).alias("hi"))))
        distinct = heads.select("one.*")
        met = cut(salted_lookup(distinct, distinct.groupBy("core").agg(F.count(F.lit(1)).alias("m")), "core").where("m > 1"))
        groups.append(met.where(F.col("m") <= FEW).select(F.xxhash64("core").alias("h"), "tid", "anchor", "offset", "context"))
        many = met.where(F.col("m") > FEW)
        middle = F.floor((F.col("least") + F.col("most")) / 2).cast("int")
        state = _part(many, F.col("least"), middle).unionByName(_part(many, middle + 1, F.col("most")))


def repeated_passages(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    Texts are judged as they are given, not by what is left of them; null counts as empty; texts below
    LENGTH bytes lose nothing; repeated rows count as elsewhere; other columns are not read. A text is
    named by the first 16 bytes of its SHA-256. A text's own ranges, which its length bounds, are all
    that is gathered by text; an anchor's occurrences are gathered by its hash, unless it is hot.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = rows.withColumn("tid", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    ids = cut(named.select("id", "tid"))
    hot = hot_anchors(named.select("tid", "text"))
    hot_hashes = np.array([r.h for r in hot.collect()], np.int64)  # at most MOST
    texts = named.groupBy("tid").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    measured = written(texts.mapInArrow(_anchors, ANCHORS).where("size(anchors) > 0 OR size(own) > 0"))
    anchors = measured.select("tid", F.inline("anchors"))
    if len(hot_hashes):
        anchors = anchors.join(F.broadcast(hot), "h", "left_anti")
    again = anchors.groupBy("h").agg(F.sum("times").alias("times")).where("times > 1").select("h")
    wanted = anchors.select("h", "tid").join(again, "h").groupBy("tid").agg(F.collect_list("h").alias("hs"))
    occurrences = texts.join(wanted, "tid").select("tid", "text", "hs").mapInArrow(_contexts, OCCURRENCE)
    ranges = sorted_ranges(occurrences).unionByName(measured.select("tid", F.inline("own")))
    if len(hot_hashes):
        found = named.select("tid", "text").mapInArrow(lambda batches: _contexts(batches, hot_hashes), OCCURRENCE)
        settled, groups = halved(found.dropDuplicates(["tid", "anchor", "offset"]))
        for part in [*settled, *map(sorted_ranges, groups)]:
            ranges = ranges.unionByName(part)
    by_text = ranges.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    none = F.array().cast("array<struct<lo:long,hi:long>>")
    done = texts.join(by_text, "tid", "left").select("tid", "text", "copies", F.coalesce("ranges", none).alias("ranges"))
    result = done.mapInArrow(_remove, "tid binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return salted_lookup(ids, cut(result), "tid").select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
