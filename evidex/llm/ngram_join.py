"""Jaccard join of documents on word n-grams by parity sketches.

Every document is the set of its distinct ``WORDS``-word shingles, as 64-bit hashes; equal
sets are one class.  Two sets of sizes a and b with similarity 0.8 or more differ in at most
(a + b) / 9 shingles.

* **Sketches.** A size band with upper size h allows d = 2h / 9 differences.  The shingles of
  a set are dealt by hash to more than d blocks and XOR-ed inside each: a block whose XOR
  differs holds a difference, so the differing blocks bound the symmetric difference from
  below and, by the pigeonhole principle, a pair that links agrees on blocks; as differences
  are dealt by hash, on more than a third of them, and on two of the first ``BLOCKS`` up to a
  chance below 1e-9.  Those are the keys, so a long text has no more of them than a short one.  A
  set takes part in its own band and, if a larger partner can reach it, in the next one.
  Sets up to ``SMALL`` shingles have too few shingles for blocks: there a block is one shingle,
  of the share that any partner must meet (a fifth and two more), the rarest of the table first: a
  line that many small texts hold is no key of theirs.
* **Stars.** Of each bucket of equal blocks, every set is compared with the one of the
  smallest document; that joins large groups of copies without listing their pairs.
* **The rest.** Buckets that still hold several components give the pairs between different
  components whose sizes and parity sketches allow a link.  A sketch has two to four
  parities a shingle, so that it tells large sets apart as well as small ones.  The sketches of a
  bucket are compared as arrays, about ``PART`` sets with as many others in a task.  A bucket of more than
  ``CROWD`` components is first split by a second agreeing block, which every linked pair has.
* **Verify.** Candidates are compared on their whole shingle sets.

Links inside a component that is already joined are not looked for, and nothing else is left
out: there is no cap on buckets, partners or text.  Hashes have 64 bits.

Defined results: null, empty and blank texts have an empty set and are linked with nothing;
a null doc_id counts as larger than any other and gets no class id of its own; repeated rows are answered each; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import staged, unused, whole_text
from evidex.llm.graph import components
from evidex.llm.subword import chunks

WORDS = 5
SMALL = 64
RATIO = 1.25
BLOCKS = 64  # blocks of a set that are keys; a linked pair agrees on each with a chance above 0.34
CROWD = 16_384
PART = 512  # sets of a bucket that are compared with as many others at a time
FEW = 16  # up to so many sets, a bucket's pairs are made together with those of others
SKETCHED = 256  # shingles of the smallest sketch
WORD_CACHE = 500_000
SEEN = 200_000
SENT = 1_000_000  # ids (16 bytes each) sent to every task at most; more are joined by a shuffle
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def _times(x: np.uint64, y: np.uint64) -> np.uint64:
    """The product modulo 2 ** 64."""
    return np.uint64(int(x) * int(y) & 0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _A
    x = (x ^ (x >> _S)) * _B
    return x ^ (x >> _S)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_known = _Hashes()


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    ``bytes.lower`` and ``bytes.split`` know exactly the letters A-Z and the white space
    0x20 and 0x09 to 0x0D.
    """
    if len(_known) > WORD_CACHE:
        _known.clear()
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    total = int(counts.sum())
    hashes = np.fromiter(map(_known.__getitem__, chain.from_iterable(words)), np.uint64, total)
    rolled = np.zeros(max(0, total - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled = _mix(rolled * _A + hashes[k : total - WORDS + 1 + k]) if len(rolled) else rolled
    ends = np.cumsum(counts)
    sets = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= WORDS:
            sets.append(np.unique(rolled[end - n : end - WORDS + 1]))
        elif n:
            value = np.uint64(n)
            for h in hashes[end - n : end]:
                value = _mix(np.array([_times(value, _B) ^ h]))[0]
            sets.append(np.array([value], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def class_id(shingles: np.ndarray) -> int:
    """The identity of a set, as a signed number."""
    parts = np.array([np.add.reduce(_mix(shingles ^ _B)), np.bitwise_xor.reduce(_mix(shingles + _A)), len(shingles)], np.uint64)
    return int(_mix(np.array([np.add.reduce(_mix(parts * _B + np.arange(3, dtype=np.uint64)))])).view(np.int64)[0])


def _bands(largest: int = 1 << 31) -> np.ndarray:
    """Upper sizes of the bands above ``SMALL``."""
    uppers = [int(SMALL * RATIO)]
    while uppers[-1] < largest:
        uppers.append(int(uppers[-1] * RATIO))
    return np.array(uppers)


UPPERS = _bands()


def blocks(upper: int) -> int:
    """More blocks than a linked pair of sets up to ``upper`` can differ in, with room for empty ones."""
    apart = 2 * upper // 9
    return apart + 4


def common(n: int) -> int:
    """How many shingles of a small set need not be keys: by any one order of all shingles, two sets that link share two before these."""
    return -(-4 * n // 5) - 2


def singles(shingles: np.ndarray) -> np.ndarray:
    """The keys of all shingles of a small set."""
    small = 4 <= len(shingles) <= SMALL
    return _mix(np.sort(_mix(shingles)) ^ _A).view(np.int64) if small else np.zeros(0, np.int64)


def signatures(shingles: np.ndarray) -> np.ndarray:
    """Bucket keys of a set, of which two sets that link share at least two; those of single shingles by hash order."""
    few = singles(shingles)
    return np.concatenate([few[: len(few) - common(len(few))] if len(few) else few, block_keys(shingles)])


def block_keys(shingles: np.ndarray) -> np.ndarray:
    """The bucket keys of a set that are blocks."""
    n, keys = len(shingles), []
    if n < 4:
        return np.zeros(0, np.int64)  # any difference is too much: only equal sets link
    own = int(np.searchsorted(UPPERS, n))
    for band in (own, own + 1):
        upper = int(UPPERS[band])
        lower = int(UPPERS[band - 1]) + 1 if band else SMALL + 1
        if 5 * n < 4 * lower or (n <= SMALL and band == 1):
            continue
        seed = np.uint64(upper)
        dealt = _mix(shingles ^ _times(seed, _B))
        block = (dealt % np.uint64(blocks(upper))).astype(np.int64)
        looked = np.flatnonzero(block < BLOCKS)
        if not len(looked):
            continue
        order = looked[np.argsort(block[looked].astype(np.uint16), kind="stable")]
        at = block[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        folded = np.bitwise_xor.reduceat(shingles[order], starts)
        keys.append(_mix(folded ^ _mix(_times(seed, _A) + at[starts].astype(np.uint64))))
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def level(size: int) -> int:
    """How often the sketch of a set of ``size`` is doubled: it has two to four parities a shingle."""
    return ((max(1, size) - 1) // SKETCHED).bit_length()


def sketch(shingles: np.ndarray) -> np.ndarray:
    """512 parities, doubled as often as the level says, as numbers of 64.

    The Hamming distance of two sketches is at most the symmetric difference.  One half XOR the
    other is the sketch of the level below.
    """
    bits = 512 << level(len(shingles))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


ROWS = "key bigint, node bigint, doc bigint, n bigint, w array<bigint>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with size and sketch for every document; one with the single shingles of a small set, without size; bucket keys with neither."""
    names, seen = ["key", "node", "doc", "n", "w"], set()
    for batch in batches:
        ids, start = batch.column("doc_id"), 0
        for run in chunks(batch.column("text").to_pylist()):
            sets = shingle_sets(run)
            docs, start = ids.slice(start, len(run)), start + len(run)
            nodes = np.array([class_id(s) for s in sets], np.int64)
            sketches = [sketch(s) for s in sets]
            marks = pa.array(np.concatenate(sketches))
            spread = _mix(docs.fill_null(-1).to_numpy().astype(np.int64).view(np.uint64)).view(np.int64)
            bounds = pa.array(np.append(0, np.cumsum([len(m) for m in sketches])), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread), pa.array(nodes), docs, pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(bounds, marks)], names
            )
            found, at, few = [], [], []
            for i, node in enumerate(nodes.tolist()):
                if node in seen:  # a copy in this task adds nothing
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                found.append(block_keys(sets[i]))
                at.append(i)
                if len(alone := singles(sets[i])):
                    few.append((i, alone))
            sizes = [len(f) for f in found]
            if sum(sizes):
                own = np.repeat(at, sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), pa.array(nodes[own]), docs.take(pa.array(own)), pa.nulls(len(own), pa.int64()),
                     pa.nulls(len(own), pa.list_(pa.int64()))], names,
                )
            if few:
                own = np.array([i for i, _ in few])
                bounds = pa.array(np.append(0, np.cumsum([len(alone) for _, alone in few])), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_mix(nodes[own].view(np.uint64)).view(np.int64)), pa.array(nodes[own]), docs.take(pa.array(own)), pa.nulls(len(own), pa.int64()),
                     pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([alone for _, alone in few])))], names,
                )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted, start = batch.column("node").to_pylist(), 0
        for run in chunks(batch.column("text").to_pylist()):
            sets = shingle_sets(run)
            rows = [(c, s.tobytes()) for w, s in zip(wanted[start : start + len(run)], sets) if (c := class_id(s)) == w or w is None]
            start += len(run)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= 80 * (len(x) + len(y) - common):
                kept.append(i)
        yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) of classes that link: those their sketches allow, by their whole shingle sets."""
    x, y = classes.select(F.col("node").alias("a"), "n", "w"), classes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("w").alias("v"))
    likely = staged(pairs.join(x, "a").join(y, "b").where(_may_link(F.col("n"), F.col("w"), F.col("m"), F.col("v"))).select("a", "b"), "likely")
    nodes = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b"))).distinct()
    wanted = staged(nodes.join(classes, "node").select("node", F.col("doc").alias("doc_id")), "wanted")
    few = wanted.count() <= SENT
    found = docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("node", "text")
    unnamed = docs.where("doc_id IS NULL").select(F.lit(None).cast("bigint").alias("node"), "text")
    sets = found.unionByName(unnamed).mapInArrow(_sets, "node bigint, shingles binary").join(nodes, "node", "left_semi")
    sets = staged(sets, "sets").dropDuplicates(["node"])
    both = likely.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    return staged(both.mapInArrow(_linked, "a bigint, b bigint"), "links")


def _halved(sketch: Column) -> Column:
    """The sketch of the level below."""
    half = (F.size(sketch) / 2).cast("int")
    return F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda p, q: p.bitwiseXOR(q))


def _may_link(n: Column, w: Column, m: Column, v: Column) -> Column:
    """Sizes and sketches allow similarity 0.8; sizes that do are one level apart at most."""
    x, y = F.when(F.size(w) > F.size(v), _halved(w)).otherwise(w), F.when(F.size(v) > F.size(w), _halved(v)).otherwise(v)
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, d: total + d)
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * apart <= n + m)


def _grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The same rows, cut between groups only; they come sorted by ``by``."""
    left: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        names = np.stack([table[c].to_numpy() for c in by])
        starts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1
        if left and any(left[0][c][0] != table[c][0] for c in by):
            yield pa.concat_tables(left)
            left = []
        if len(starts):
            yield pa.concat_tables([*left, table.slice(0, starts[-1])])
            left, table = [], table.slice(starts[-1])
        left.append(table)
    if left:
        yield pa.concat_tables(left)


def _folded(words: np.ndarray, size: int) -> np.ndarray:
    """Sketches, one a row, on the level that has ``size`` numbers."""
    while words.shape[1] > size:
        words = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]
    return words


class _Sketched:
    """Rows with their labels, sizes and sketches."""

    def __init__(self, table: pa.Table):
        self.label, self.n = table["label"].to_numpy(), table["n"].to_numpy()
        lists = table["w"].combine_chunks()
        self.bounds, self.words = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)  # bits are counted without a sign
        self.size = np.diff(self.bounds)
        self.low = np.zeros((len(self.size), 8), np.uint64, order="F")
        for size in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == size)
            self.low[at] = _folded(self.whole(at, size), 8)

    def whole(self, rows: np.ndarray, size: int) -> np.ndarray:
        return self.words[self.bounds[rows][:, None] + np.arange(size)]

    def ahead(self, start: int, stop: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row from ``start`` to ``stop`` and a later one before ``end`` that differ little in 512 parities."""
        apart = np.zeros((stop - start, end - start), np.int32)
        for word in self.low.T:
            apart += np.bitwise_count(word[start:stop, None] ^ word[None, start:end])
        n = self.n.astype(np.int32)
        x, y = np.nonzero(9 * apart <= n[start:stop, None] + n[None, start:end])
        return x[x < y] + start, y[x < y] + start

    def may_link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs have different labels, and sizes and sketches that allow a link: 512 parities first, then all."""
        n, m = self.n[x], self.n[y]
        at = np.flatnonzero((self.label[x] != self.label[y]) & (5 * n >= 4 * m) & (5 * m >= 4 * n))
        most = (n[at] + m[at]) // 9
        near = np.bitwise_count(self.low[x[at]] ^ self.low[y[at]]).sum(1, dtype=np.int64) <= most
        at, most = at[near], most[near]
        long, wide = self.size[x[at]], self.size[y[at]]
        kept = []
        for size, other in {*zip(long.tolist(), wide.tolist())}:
            some = np.flatnonzero((long == size) & (wide == other))
            for i in range(0, len(some), step := max(1, (1 << 19) // max(size, other))):
                part = some[i : i + step]
                p, q = (_folded(self.whole(r[at[part]], k), min(size, other)) for r, k in ((x, size), (y, other)))
                kept.append(at[part[np.bitwise_count(p ^ q).sum(1, dtype=np.int64) <= most[part]]])
        return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _pairs(rows: _Sketched, starts: np.ndarray, ends: np.ndarray, part: np.ndarray, crossed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group, a limited number at a time; of a ``crossed`` group those of different parts."""
    few = (ends - starts <= FEW) & ~crossed
    last = np.repeat(np.where(few, ends, 0), ends - starts)
    for step in range(1, FEW):
        at = np.flatnonzero(np.arange(len(last)) + step < last)
        yield at, at + step
    for start, end, cross in zip(starts[~few].tolist(), ends[~few].tolist(), crossed[~few].tolist()):
        for i in range(start, end, 64):
            x, y = rows.ahead(i, min(i + 64, end), end)
            other = part[x] != part[y] if cross else slice(None)
            yield x[other], y[other]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets of a group, which are the parts ``lo`` and ``hi`` of a bucket."""
    for table in _grouped(batches, ["key", "lo", "hi"]):
        by, part, node, rows = np.stack([table[c].to_numpy() for c in ("key", "lo", "hi")]), table["part"].to_numpy(), table["node"].to_numpy(), _Sketched(table)
        starts = np.flatnonzero(np.concatenate([[True], (by[:, 1:] != by[:, :-1]).any(0)]))
        for x, y in _pairs(rows, starts, np.append(starts[1:], len(node)), part, (by[1] != by[2])[starts]):
            kept = rows.may_link(x, y)
            if len(kept):
                a, b = np.sort(np.stack([node[x[kept]], node[y[kept]]]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _between(members: DataFrame) -> DataFrame:
    """Pairs of different components that share a key and whose sketches allow a link.

    A bucket is cut into parts by hash; every part, and every two parts, are a group of their own,
    so no task has to hold a large bucket.
    """
    parts = members.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    own = members.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    groups = each.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "label", "node", "n", "w")
    return groups.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_compared, "a bigint, b bigint")


def _rarest(small: DataFrame) -> DataFrame:
    """(``key``, ``node``, ``first``) of small sets: their single shingles but the most common ones of the table.

    Shingles of one set only come first in that order and need no bucket.
    """
    each = small.groupBy("node").agg(F.min("doc").alias("doc"), F.any_value("w").alias("w"))
    keys = each.select("node", "doc", F.size("w").alias("n"), F.explode("w").alias("key"))
    times = keys.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    shared = F.sort_array(F.collect_list(F.struct("times", "key")))
    lists = keys.join(times, "key").groupBy("node").agg(F.any_value("doc").alias("doc"), F.any_value("n").alias("n"), shared.alias("shared"))
    rare = F.slice("shared", F.lit(1), F.greatest(F.size("shared") - F.ceil(4 * F.col("n") / 5).cast("int") + 2, F.lit(0)))
    kept = staged(lists.select("node", "doc", F.explode(rare["key"]).alias("key")), "singles")
    firsts = kept.groupBy("key").agg(F.min_by("node", "doc").alias("first"), F.count("*").alias("sets")).where("sets > 1")
    return kept.join(firsts, "key").select("key", "node", "first")


def join(documents: DataFrame, text: str = "text") -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``) of every row of ``documents``."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    rows = docs.mapInArrow(_rows, ROWS).repartition("key")
    least, most = (F.expr(f"{f}(node) OVER (PARTITION BY key)").alias(f) for f in ("min", "max"))
    first = F.expr("min_by(node, doc) OVER (PARTITION BY key)").alias("first")
    useful = rows.select("*", least, most).where("w IS NOT NULL OR min <> max").select(*rows.columns, first)
    useful = staged(useful, "rows")
    info = useful.where("n IS NOT NULL").select("doc", "n", "node", "w")
    members = useful.where("w IS NULL").select("key", "node", "first").dropDuplicates(["key", "node"])
    members = members.union(_rarest(useful.where("n IS NULL AND w IS NOT NULL")))
    classes = info.where("n > 0").groupBy("node").agg(F.min("doc").alias("doc"), F.max("n").alias("n"), F.max("w").alias("w"))
    classes = staged(classes, "classes")
    stars = members.where("node <> first").groupBy("node", "first").agg(F.count("*").alias("shared")).where("shared > 1")
    stars = staged(stars.select(F.col("first").alias("a"), F.col("node").alias("b")), "stars")
    links = verified(stars, classes, docs)
    labels = components(links)
    joined = members.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    crowds = joined.groupBy("key", "label").agg(F.lit(1)).groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
    open_keys = staged(joined.join(crowds, "key").join(classes.drop("doc"), "node"), "open")
    crowded = open_keys.where(F.col("crowd") > CROWD).drop("crowd")
    other = crowded.select(F.col("key").alias("key_2"), F.col("node"))
    split = crowded.join(other, "node").where("key < key_2").withColumn("key", F.xxhash64("key", "key_2")).drop("key_2")
    columns = ["key", "node", "label", "n", "w"]
    pairs = _between(open_keys.where(F.col("crowd") <= CROWD).select(columns)).union(_between(split.select(columns))).distinct()
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = verified(staged(pairs.join(known, ["a", "b"], "left_anti"), "pairs"), classes, docs)
    labels = components(links.union(more))
    final = classes.select("node", "doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = final.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = final.join(smallest, "label").select("node", "component_id")
    return (
        info.join(named, "node", "left")
        .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))
    )


def one_of_each(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``documents`` that carry the smallest doc_id of their component, each doc_id once.

    Rows without doc_id stay; of rows with the same doc_id, those with equal text are one row.
    Texts are shuffled only where a doc_id repeats, or where the ids that stay are too many to
    send to every task.
    """
    found, times = join(documents, text), unused(documents, "_rows")
    kept = staged(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias(times)), "kept")
    few = kept.count() <= SENT
    stay = documents.join(F.broadcast(kept) if few else kept, "doc_id")
    again = stay.where(F.col(times) > 1).dropDuplicates(["doc_id", text])
    whole = stay.where(F.col(times) == 1).unionByName(again).drop(times).unionByName(documents.where("doc_id IS NULL"))
    return whole.select(*documents.columns)
