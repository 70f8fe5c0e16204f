"""Operator 11: MinHash near-duplicates with an LSH forest.

A text's distinct shingles give one signature of ``ORDERS`` x ``DEPTH`` MinHash
values. Each order sorts all signatures by a stretch of its own of ``DEPTH``
values, so texts with the longest common prefix are neighbours. Neighbours
that share ``LEAST`` values are candidates, and so are the members of a
region: a run of rows that share a prefix, cut at the least depth at which it
has ``REGION`` members or fewer. Full sets of shingles decide.

Texts with the same set are one entry. Candidates are verified in rounds, and
a later round leaves out what the links found so far already connect. The members of
a region meet in one place once, with 16 bits of each hash, which rules out
almost all pairs, so a large group of near copies does not cost all of them.

What may be missed: two sets at similarity s share ``LEAST`` values in an order
with probability s^LEAST, so with 32 orders a pair at 0.85 is no candidate in
5 of 10^11 cases. In a run of more than ``REGION`` sets the depth grows and the
chance falls. Those sets therefore go through another forest, with fresh
values, and again, as long as one finds a link that is new.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm.common import binary_rows, buckets_for, join_groups, slices_by_bytes, table, task_of, utf8_parts, written
from cohortwise.llm.components import components
from cohortwise.llm.fingerprints import _EMPTY, _densified, _mixed, shingle_hashes, word_hashes

SHINGLE = 5
#: Sorted orders, MinHash values of each, and values that neighbours share at least. ORDERS x DEPTH is a power of two.
ORDERS, DEPTH, LEAST = 32, 16, 4
#: Members of a region at most. A region is cut at the first depth from LEAST to DEPTH that leaves it so few.
REGION = 64
#: Neighbours in this many orders are verified first; regions then leave out what they connect.
FIRST = 2
#: Bytes of text at a time, rows whose signatures are made at a time, and rows of a sorted partition.
AT_ONCE, SIGNED, SORTED = 1 << 20, 2048, 1 << 20


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, hashes, ends) for runs of texts i to j: the distinct shingles' hashes of each, ascending, one text after the other."""
    data, off = utf8_parts(column)
    for i, j in slices_by_bytes(off, AT_ONCE):
        part, n = data[off[i]:off[j]], j - i
        spaced = np.full(len(part) + n, 0x20, np.uint8)  # a space after each text, so that no word runs on
        spaced[np.arange(len(part)) + np.repeat(np.arange(n), np.diff(off[i:j + 1]))] = part
        words, starts = word_hashes(spaced)
        of = np.searchsorted(off[i:j + 1] - off[i] + np.arange(n + 1), starts, side="right") - 1
        counts = np.bincount(of, minlength=n)
        last = np.cumsum(counts)
        if len(words) >= SHINGLE:
            h = shingle_hashes(words, SHINGLE)
            inside = of[:len(h)] == of[SHINGLE - 1:]
            h, at = h[inside], of[:len(h)][inside]
        else:
            h, at = np.empty(0, np.uint64), np.empty(0, np.int64)
        few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        if len(few):
            h = np.r_[h, np.array([shingle_hashes(words[last[k] - counts[k]:last[k]], SHINGLE)[0] for k in few], np.uint64)]
            at = np.r_[at, few]
        order = np.lexsort((h, at))
        h, at = h[order], at[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])] if len(h) else np.empty(0, bool)
        yield i, j, h[first], np.cumsum(np.bincount(at[first], minlength=n))


def _digests(hashes: np.ndarray, ends: np.ndarray) -> pa.Array:
    starts = np.r_[0, ends[:-1]]
    return pa.array([hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(starts, ends)], pa.binary())


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, signature, row) for every row of ``docs`` (doc_id, text), stored; digest tells sets apart, row tells rows apart."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("forest")
        for batch in batches:
            for i, j, h, ends in shingle_sets(batch.column(1)):
                for a in range(0, j - i, SIGNED):  # so many signatures at a time
                    b = min(a + SIGNED, j - i)
                    first = ends[a - 1] if a else 0
                    own, upto = h[first:ends[b - 1]], ends[a:b] - first
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + a, b - a), pa.array(np.diff(np.r_[0, upto]), pa.int64()), _digests(own, upto), binary_rows(signatures(own, upto))],
                                                     names=["doc_id", "n", "digest", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.mapInArrow(mark, f"doc_id {kind}, n bigint, digest binary, signature binary").withColumn("row", F.monotonically_increasing_id()), "marks")


def sets_of(docs: DataFrame, marks: DataFrame, ids: DataFrame) -> DataFrame:
    """(sid, n, shingles, shorts) of the rows of ``marks`` that ``ids`` (sid) names, made from the texts again and stored.

    Most sets have no neighbour, so they are not stored at first; a second
    reading of the texts in question costs less.
    """
    wanted = written(marks.select(F.col("row").alias("sid"), "doc_id", "digest").join(ids, "sid", "left_semi"), "wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("forest")
        for batch in batches:
            for _, _, h, ends in shingle_sets(batch.column(0)):
                starts = np.r_[0, ends[:-1]]
                yield pa.RecordBatch.from_arrays([_digests(h, ends), pa.array(ends - starts, pa.int64()), pa.array([h[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                                                  pa.array([shorts(h[a:b]).tobytes() for a, b in zip(starts, ends)], pa.binary())], names=["digest", "n", "shingles", "shorts"])

    named = wanted.select(F.col("doc_id").alias("__id")).distinct()
    texts = docs.join(named, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    found = texts.mapInArrow(read, "digest binary, n bigint, shingles binary, shorts binary").join(wanted.select("digest", "sid"), "digest")
    # a digest has one sid: by digest, as the join has dealt the rows, they are not shuffled again
    return written(found.dropDuplicates(["digest"]).select("sid", "n", "shingles", "shorts"), "sets")


def signatures(hashes: np.ndarray, ends: np.ndarray, forest: int = 0) -> np.ndarray:
    """(sets, ORDERS, DEPTH) MinHash values of 16 bits: one-permutation bins of sets, densified; other values for each ``forest``."""
    bins = ORDERS * DEPTH
    n = len(ends)
    at = np.repeat(np.arange(n), np.diff(np.r_[0, ends]))
    if forest:
        hashes = _mixed(hashes ^ _mixed(np.array([forest], np.uint64)))
        order = np.lexsort((hashes, at))
        hashes = hashes[order]
    cell = at * bins + (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, int)
    least = np.full((n, bins), _EMPTY)
    least.reshape(-1)[cell[first]] = hashes[first]
    return (_mixed(_densified(least)) & np.uint64(0xFFFF)).astype(">u2").reshape(n, ORDERS, DEPTH)


def signed(sets: DataFrame, forest: int) -> DataFrame:
    """(sid, n, signature) of ``sets`` (sid, n, shingles) with the values of another ``forest``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("forest")
        for whole in batches:
            for a in range(0, whole.num_rows, SIGNED):
                batch = whole.slice(a, SIGNED)
                raw, off = utf8_parts(batch.column(2))
                values = signatures(np.frombuffer(raw.tobytes(), np.uint64), off[1:] // 8, forest)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary_rows(values)], names=["sid", "n", "signature"])

    return sets.select("sid", "n", "shingles").mapInArrow(sign, "sid bigint, n bigint, signature binary")


def sorted_orders(entries: DataFrame, rows: int) -> DataFrame:
    """(key, sid, n) of ``entries`` (sid, n, signature; so many rows) in every order.

    key is the order's number and its values, bytewise; the rows are range-partitioned and sorted by it.
    """
    key = F.expr(f"transform(sequence(0, {ORDERS - 1}), o -> concat(unhex(lpad(hex(o), 2, '0')), substring(signature, o * {2 * DEPTH} + 1, {2 * DEPTH})))")
    each = entries.select(F.explode(key).alias("key"), "sid", "n")
    parts = buckets_for(entries.sparkSession, rows * ORDERS, SORTED)
    return each.repartitionByRange(parts, "key", "sid").sortWithinPartitions("key", "sid")


def regions(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each row's region and whether its run was cut deeper for it, by the values that each row shares with the one before it."""
    n = len(shared)
    start, deep = np.full(n, -1), np.zeros(n, bool)
    for depth in range(LEAST, DEPTH + 1):
        begins = np.flatnonzero(shared < depth)
        size = np.diff(np.r_[begins, n])
        own = np.repeat(begins, size)
        fits = (np.repeat(size, size) <= REGION) & (start < 0)
        start[fits] = own[fits]
        deep |= start < 0
    # runs that share a whole order are cut into equal stretches
    left = start < 0
    start[left] = (own + (np.arange(n) - own) // REGION * REGION)[left]
    return start, deep


def neighbours(orders: DataFrame) -> DataFrame:
    """(ord, sid, n, prev, prev_n, edge, region, deep) of every row with a neighbour in its order.

    prev is the row before it, where they share ``LEAST`` values, and edge tells
    that it lies in another region; region is null for a row alone in it; deep tells that the run was cut. A range's edge may part
    neighbours in one order; the other orders have theirs elsewhere.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("forest")
        held = list(batches)  # SORTED rows and more, as far as ranges are uneven
        if not sum(b.num_rows for b in held):
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        raw, _ = utf8_parts(whole.column(0))
        key = raw.reshape(whole.num_rows, 1 + 2 * DEPTH)
        sid, n = (whole.column(c).to_numpy() for c in (1, 2))
        differ = key[1:] != key[:-1]
        shared = np.r_[0, np.where(differ.any(1), np.maximum(differ.argmax(1) - 1, 0) // 2, DEPTH)]
        start, deep = regions(shared)
        size = np.bincount(start, minlength=len(start))[start]
        near = shared >= LEAST
        some = np.flatnonzero(near | deep | (size > 1))
        before = np.maximum(some - 1, 0)
        region = start[some].astype(np.int64) + (TaskContext.get().partitionId() << 32)
        yield pa.RecordBatch.from_arrays([
            pa.array(key[some, 0].astype(np.int32)), pa.array(sid[some]), pa.array(n[some]), pa.array(sid[before], mask=~near[some]),
            pa.array(n[before], mask=~near[some]), pa.array(start[some] == some), pa.array(region, mask=size[some] < 2), pa.array(deep[some])],
            names=["ord", "sid", "n", "prev", "prev_n", "edge", "region", "deep"])

    return written(orders.mapInArrow(walk, "ord int, sid bigint, n bigint, prev bigint, prev_n bigint, edge boolean, region bigint, deep boolean"), "neighbours")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; no other sets are shuffled."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    sets = written(sets.select("sid", "shingles").join(ids, "sid", "left_semi"), "asked")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("forest")
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                place = np.minimum(np.searchsorted(v, u), len(v) - 1)
                both = int((v[place] == u).sum())
                keep[k] = 100 * both >= percent * (len(u) + len(v) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    met = pairs.join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a")
    return written(met.select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint"), "links")


def _can_link(percent: int):
    """Whether sets of these sizes can be so similar at all."""
    return F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs that the links so far do not connect."""
    if roots is None:
        return pairs
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    met = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left")
    return met.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select(pairs.columns)


def _mixed_regions(near: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(region, sid, root) of the members of regions that the links so far leave in several classes, stored.

    A family of near copies is a region in most orders; of regions with the
    same members (told by their number and 128 bits of hashes) one is left.
    """
    rooted = near.filter("region is not null").select("region", "sid")
    if roots is None:
        rooted = rooted.withColumn("root", F.col("sid"))
    else:
        rooted = rooted.join(roots, rooted["sid"] == roots["node"], "left").select("region", "sid", F.coalesce("root", "sid").alias("root"))
    members = [F.count(F.lit(1)).alias("size"), *[F.bit_xor(F.xxhash64(F.lit(k), "sid")).alias(f"x{k}") for k in (1, 2)]]
    mixed = rooted.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high"), *members).filter("low < high")
    one = written(mixed.groupBy("size", "x1", "x2").agg(F.min("region").alias("region")).select("region"), "regions")
    return written(rooted.join(one, "region", "left_semi"), "members")


def shorts(hashes: np.ndarray) -> np.ndarray:
    """The distinct last 16 bits of a set's hashes: two sets share no more hashes than these, and those that either lost by this."""
    return np.unique(hashes.astype(np.uint16))


def region_candidates(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of members of one region (region, sid, root), of different classes, that may be linked.

    Each member comes once, with the last bits of its hashes only; an upper
    bound of the intersection rules out all but real links and a few more, which
    the caller verifies on full sets.
    """

    def pairs(rows: list[tuple[int, int, int, np.ndarray]]) -> Iterator[tuple[int, int]]:
        sid, root, size = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        kept = np.array([len(r[3]) for r in rows], np.int64)
        values, number = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
        m = np.zeros((len(rows), len(values)), np.float32)  # REGION x 65,536 at most
        m[np.repeat(np.arange(len(rows)), kept), number] = 1
        most = (m @ m.T).astype(np.int64) + np.minimum((size - kept)[:, None], (size - kept)[None])
        most = np.minimum(most, np.minimum(size[:, None], size[None]))
        close = (100 * most >= percent * (size[:, None] + size[None] - most)) & (root[:, None] != root[None])
        i, j = np.nonzero(np.triu(close, 1))
        return zip(np.minimum(sid[i], sid[j]).tolist(), np.maximum(sid[i], sid[j]).tolist())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("forest")
        held, own, out = [], None, []  # the members of one region
        for batch in batches:
            for region, sid, root, n, x in zip(*[batch.column(k).to_pylist() for k in range(4)], batch.column(4)):
                if region != own:
                    out += pairs(held) if held else []
                    held, own = [], region
                held.append((sid, root, n, np.frombuffer(x.as_buffer(), np.uint16)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
                out = []
        out += pairs(held) if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    spread = members.join(sets.select("sid", "n", "shorts"), "sid").select("region", "sid", "root", "n", "shorts")
    met = spread.repartition("region").sortWithinPartitions("region", "sid")
    return met.mapInArrow(search, "a bigint, b bigint").distinct()


class _Links:
    """Links found so far, and the classes that they make."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.roots: DataFrame | None = None
        self.links: DataFrame | None = None

    def add(self, *found: DataFrame) -> bool:
        """Takes in links (a, b); tells whether there were any."""
        new = found[0]
        for more in found[1:]:
            new = new.unionByName(more)
        if new.isEmpty():
            return False
        self.links = new if self.links is None else self.links.unionByName(new)
        self.roots = written(components(self.links, "a", "b"), "roots")
        return True

    def beside(self, near: DataFrame) -> DataFrame:
        """Links of the rows of ``near`` with the rows before them, where they are not connected yet."""
        pairs = near.filter("prev is not null").select(F.least("sid", "prev").alias("a"), F.greatest("sid", "prev").alias("b"), F.col("n").alias("a_n"), F.col("prev_n").alias("b_n"))
        fresh = _apart(pairs, self.roots).filter(_can_link(self.percent)).select("a", "b").distinct()
        return linked(fresh, self.sets, self.percent)

    def within(self, near: DataFrame) -> DataFrame:
        """Links in the regions of ``near`` that hold several classes."""
        return linked(region_candidates(_mixed_regions(near, self.roots), self.sets, self.percent), self.sets, self.percent)


def near_classes(df: DataFrame, id_col: str, text_col: str, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row: classes of texts that share most of their distinct 5-word shingles.

    Rows are linked where 100 * intersection >= percent * union of their sets;
    classes are the components of the links, named by their smallest id. A-Z is
    lowered, words are parted by ASCII white space, and fewer than five words
    are one shingle. Texts without words (null too) are linked with nothing.
    Rows with a null id belong to their class, whose name is null if no row of it
    has an id; ``kept`` marks the row that gives the name, or all rows of a class
    without one. Repeated rows are kept. An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = marked(docs)
    distinct = written(marks.filter("n > 0").groupBy("digest").agg(F.min("row").alias("sid"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "distinct")
    entries = marks.join(distinct.select(F.col("sid").alias("row")), "row", "left_semi").withColumnRenamed("row", "sid")
    near = neighbours(sorted_orders(entries, distinct.count()))
    sets = sets_of(docs, marks, near.select("sid").unionByName(near.select(F.col("prev").alias("sid")).filter("sid is not null")).distinct())
    found = _Links(sets, percent)
    forest = 0
    while True:
        if not forest:  # a large class is mostly connected by neighbours, and its regions are then left out
            found.add(found.beside(near.filter(F.col("ord") < FIRST)))
        new = found.add(found.within(near), found.beside(near.filter("edge")))
        dense = written(near.filter("deep").select("sid").distinct(), "dense")
        size = dense.count()
        if not size or forest and not new:
            break
        forest += 1
        found.sets = sets = written(sets.join(dense, "sid", "left_semi"), "sets")  # all that the further forests are about
        near = neighbours(sorted_orders(signed(sets, forest), size))
    roots = found.roots
    rooted = distinct.join(roots, distinct["sid"] == roots["node"], "left").select("digest", "first", "rows", F.coalesce("root", "sid").alias("root")) if roots is not None else distinct.withColumnRenamed("sid", "root")
    rooted = written(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    named = join_groups(rooted.select("digest", "rows", "root"), "root", names, "sets").select("digest", "rows", "component_id")
    rows = marks.select("doc_id", "n", "digest")
    out = join_groups(rows.filter("n > 0"), "digest", named, "rows").unionByName(rows.filter("n = 0").withColumn("component_id", F.col("doc_id")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate classes of all ``documents`` at 85 of 100 shared shingles."""
    return near_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"op11_forest": (op11_forest, None)}
