"""Operator 10: removal of repeated byte strings with suffix arrays.

Every string of ``length`` bytes that starts at two places, in one text or in
two, is found by a suffix array, and all bytes that such strings cover go.
The suffix array of a corpus is built in shards that have nothing in common:

* Each string has an *anchor*: of the ``GRAM``-byte strings in it the one with
  the least hash, the leftmost of equals. Equal strings have equal anchors, so
  strings of different anchors need not be compared, and those whose anchor
  occurs at one place only need not be sorted at all. Neighbouring strings of
  one anchor make a *run*; its text is the run's strings laid over each other.
* Runs with equal texts are one entry of the shard (whatever share of the
  corpus they make up); that they are several is enough to remove them.
* A shard holds the runs of many anchors, told by the anchor's hash, and is
  sorted in one task (``suffix_arrays``). The strings of an anchor with more text
  than a shard are counted instead, by a 128-bit digest of their bytes, with the
  copies folded in each task, so no task holds all copies of a string.

Texts that are equal as a whole are not compared: they go, if long enough.

Texts and anchors are told apart by 64-bit hashes (a clash of two texts' hashes
could hide a repeat; about one in 40 million for a million texts). That bytes are equal is
found on the bytes in a shard, and on BLAKE2b digests of 128 bits for large anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from cohortwise.llm.common import buckets_for, by_merge, shuffle_width, slices_by_bytes, table, task_of, utf8_parts, written
from cohortwise.llm.fingerprints import _MULTIPLIER, _U, _mixed, _powers
from cohortwise.llm.suffix_arrays import repeated_starts

GRAM = 32
#: Bytes of run texts that a shard holds.
SHARD_BYTES = 2 << 20
#: Few shards are made of little text: no more than one for so many bytes.
LEAST_SHARD = 1 << 16
#: Repeated anchors up to this number are broadcast (8 bytes each); more are joined by a shuffle.
FEW_ANCHORS = 2_000_000
#: Bytes of text searched for anchors at a time; a longer text is searched in overlapping pieces.
AT_ONCE = 1 << 20


def runs(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first, count, anchor, again) of all runs of the strings of ``length`` bytes in some texts.

    A run is ``count`` strings that start at ``first`` and the places after it
    (counted in the bytes of its text) and have an anchor of one hash; ``again``
    tells that this hash stands at several places in the run.
    """
    out = []
    n = len(off) - 1
    for i, j in slices_by_bytes(off, AT_ONCE):
        a, b = int(off[i]), int(off[j])
        if b - a > 2 * AT_ONCE:  # one long text
            for p in range(a, b - length + 1, AT_ONCE):
                piece = data[p:min(p + AT_ONCE + length - 1, b)]
                row, first, *rest = _runs_of(piece, np.array([0, len(piece)]), length)
                out.append((row + i, first + (p - a), *rest))
        else:
            row, *rest = _runs_of(data[a:b], off[i:j + 1] - a, length)
            out.append((row + i, *rest))
    if not out or not n:
        return _no_runs()
    return tuple(np.concatenate(x) for x in zip(*out))


def _no_runs() -> tuple[np.ndarray, ...]:
    return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, bool))


def _runs_of(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    none = _no_runs()
    gram = min(GRAM, length)
    if len(data) < length:
        return none
    up, down = _powers()
    with np.errstate(over="ignore"):
        sums = np.r_[_U(0), np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)])]
        h = _mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    # the place in the low bits: of equal hashes the leftmost is least
    least = (h & ~_U((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, span = 1, length - gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width:])
    at = (least & _U((1 << 24) - 1)).astype(np.int64)  # of the string that starts here
    sizes = np.diff(off)
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    if not len(row):
        return none
    counts = np.maximum(sizes - length + 1, 0)
    first_of_row = np.cumsum(counts) - counts
    place = np.arange(len(row)) - first_of_row[row] + off[row]
    at = at[place]
    anchor = h[at]
    edge = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[edge[1:], len(row)] - 1
    return row[edge], place[edge] - off[row[edge]], last - edge + 1, anchor[edge], at[last] != at[edge]


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(data.alias("data")).withColumn("text", F.xxhash64("data"))


def _anchor_table(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, text, first, again): the runs; a text that comes again in a task is not searched again."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("suffix")
        seen: set[int] = set()
        for batch in batches:
            ids = np.asarray(batch.column(1))
            fresh = [k for k, t in enumerate(ids.tolist()) if not (t in seen or seen.add(t))]
            part = batch.take(pa.array(fresh, pa.int64()))
            row, first, _, anchor, again = runs(*utf8_parts(part.column(0)), length)
            for i in range(0, len(row), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[s].view(np.int64)), pa.array(np.asarray(part.column(1))[row[s]]), pa.array(first[s]), pa.array(again[s])], names=["anchor", "text", "first", "again"])

    return texts.select("data", "text").mapInArrow(search, "anchor bigint, text bigint, first bigint, again boolean")


def _run_texts(texts: DataFrame, repeated: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """(anchor, text, first, count, run): the runs of repeated anchors with their bytes."""
    spark = texts.sparkSession
    schema = "anchor bigint, text bigint, first bigint, count bigint, run binary"

    def cut(batch: pa.RecordBatch, ids: np.ndarray, wanted) -> Iterator[pa.RecordBatch]:
        data, off = utf8_parts(batch.column(0))
        row, first, count, anchor, _ = runs(data, off, length)
        keep = wanted(anchor.view(np.int64), row)
        row, first, count, anchor = row[keep], first[keep], count[keep], anchor[keep]
        size = 0
        start = 0
        raw = data.tobytes()
        begin = off[row] + first
        end = begin + count + length - 1
        sizes = np.cumsum(end - begin)
        while start < len(row):
            stop = max(start + 1, int(np.searchsorted(sizes, size + (2 << 20), side="right")))
            s = slice(start, stop)
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor[s].view(np.int64)), pa.array(ids[row[s]]), pa.array(first[s]), pa.array(count[s]),
                pa.array([raw[x:y] for x, y in zip(begin[s].tolist(), end[s].tolist())], pa.binary())], names=["anchor", "text", "first", "count", "run"])
            size, start = int(sizes[stop - 1]), stop

    if repeated.count() <= FEW_ANCHORS:
        shared = spark.sparkContext.broadcast(np.sort(repeated.toArrow().column(0).to_numpy()))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task_of("suffix")
            known, seen = shared.value, set()

            def wanted(anchor, row):
                at = np.searchsorted(known, anchor)
                return (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == anchor) if len(known) else np.zeros(len(anchor), bool)

            for batch in batches:
                ids = np.asarray(batch.column(1))
                fresh = [k for k, t in enumerate(ids.tolist()) if not (t in seen or seen.add(t))]
                part = batch.take(pa.array(fresh, pa.int64()))
                yield from cut(part, np.asarray(part.column(1)), wanted)

        return texts.select("data", "text").mapInArrow(search, schema)

    # as many anchors as a text has, at most, in a row
    marks = anchors.join(by_merge(repeated), "anchor").groupBy("text").agg(F.collect_set("anchor").alias("marks"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [set(x) for x in batch.column(2).to_pylist()]
            yield from cut(batch, np.asarray(batch.column(1)), lambda anchor, row, lists=lists: np.array([a in lists[r] for a, r in zip(anchor.tolist(), row.tolist())], bool))

    return texts.join(by_merge(marks), "text").select("data", "text", "marks").mapInArrow(look_up, schema)


def _string_digests(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(run_id, shift, digest as two numbers) of every string of some runs (run_id, run), some 65,536 at a time."""
    ids, shifts, digests, held = [], [], [], 0
    for batch in batches:
        for run_id, run in zip(np.asarray(batch.column(0)).tolist(), batch.column(1)):
            whole = run.as_py()
            for a in range(0, len(whole) - length + 1, 1 << 16):
                b = min(a + (1 << 16), len(whole) - length + 1)
                ids.append(np.full(b - a, run_id, np.int64))
                shifts.append(np.arange(a, b))
                digests.append(b"".join([hashlib.blake2b(whole[k:k + length], digest_size=16).digest() for k in range(a, b)]))
                held += b - a
                if held >= 1 << 16:
                    yield np.concatenate(ids), np.concatenate(shifts), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    ids, shifts, digests, held = [], [], [], 0
    if held:
        yield np.concatenate(ids), np.concatenate(shifts), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _among(known: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which rows of ``digests`` are rows of ``known`` (sorted by the first number)."""
    at, end = (np.searchsorted(known[:, 0], digests[:, 0], side=side) for side in ("left", "right"))
    found = np.zeros(len(digests), bool)
    for k in range(int((end - at).max(initial=0))):
        found |= (at + k < end) & (known[np.minimum(at + k, len(known) - 1), 1] == digests[:, 1])
    return found


def _counted_strings(entries: DataFrame, length: int) -> DataFrame:
    """(run_id, a, b) as ``_sorted_shards`` gives them, for anchors with any amount of text.

    Strings are counted by their digest, folded in each task before anything is
    shuffled, so a string that very many runs share is a row for each task.
    """
    spark = entries.sparkSession
    runs_ = entries.select("run_id", "run")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("suffix")
        for _, _, d in _string_digests(batches, length):
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1])], names=["d0", "d1"])

    counts = runs_.mapInArrow(digests, "d0 bigint, d1 bigint").groupBy("d0", "d1").agg(F.count(F.lit(1)).alias("n"))
    again = written(counts.filter("n > 1").select("d0", "d1"), "strings")
    if again.count() <= FEW_ANCHORS:
        known = again.toArrow()
        known = np.stack([known.column(k).to_numpy() for k in (0, 1)], axis=1)
        shared = spark.sparkContext.broadcast(known[np.argsort(known[:, 0], kind="stable")])

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task_of("suffix")
            for ids, shift, d in _string_digests(batches, length):
                found = _among(shared.value, d)
                ids, shift = ids[found], shift[found]
                edge = np.flatnonzero(np.r_[True, (np.diff(ids) != 0) | (np.diff(shift) != 1)]) if len(ids) else np.empty(0, np.int64)
                last = np.r_[edge[1:], len(ids)] - 1 if len(edge) else edge
                yield pa.RecordBatch.from_arrays([pa.array(ids[edge]), pa.array(shift[edge]), pa.array(shift[last] + length)], names=["run_id", "a", "b"])

        return runs_.mapInArrow(look_up, "run_id bigint, a bigint, b bigint")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("suffix")
        for ids, shift, d in _string_digests(batches, length):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(shift), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["run_id", "shift", "d0", "d1"])

    # a frequent string's places are many rows of one key: sorted on disk, and split by AQE
    hit = runs_.mapInArrow(places, "run_id bigint, shift bigint, d0 bigint, d1 bigint").join(by_merge(again), ["d0", "d1"], "left_semi")
    island = F.col("shift") - F.row_number().over(Window.partitionBy("run_id").orderBy("shift"))
    return (hit.select("run_id", "shift", island.alias("island")).groupBy("run_id", "island")
            .agg(F.min("shift").alias("a"), (F.max("shift") + length).alias("b")).select("run_id", "a", "b"))


def _repeated_strings(entries: DataFrame, length: int) -> DataFrame:
    """(run_id, a, b): the strings of each entry, by ranges of their starts, that stand somewhere else too.

    ``entries`` holds run_id, anchor and run. Anchors with more text than a
    shard have their strings counted, the others are sorted in shards.
    """
    sizes = entries.groupBy("anchor").agg(F.sum(F.octet_length("run")).alias("bytes"))
    large = written(sizes.filter(F.col("bytes") > SHARD_BYTES), "large")
    n, in_large = large.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    total = (entries.agg(F.sum(F.octet_length("run"))).first()[0] or 0) - (in_large or 0)
    if not n:
        return _sorted_shards(entries, length, total)
    ids = large.select("anchor")
    return _sorted_shards(entries.join(ids, "anchor", "left_anti"), length, total).unionByName(_counted_strings(entries.join(ids, "anchor", "left_semi"), length))


def _sorted_shards(entries: DataFrame, length: int, total: int) -> DataFrame:
    """(run_id, a, b) as ``_repeated_strings`` gives them, for anchors with no more text than a shard; ``total`` bytes."""
    spark = entries.sparkSession
    shards = buckets_for(spark, total, SHARD_BYTES, least=min(shuffle_width(spark), total // LEAST_SHARD + 1))
    dealt = entries.select("run_id", F.pmod(F.col("anchor").bitwiseAND(F.lit((1 << 62) - 1)), F.lit(shards)).alias("shard"), "run")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
            which, place = repeated_starts([run for _, run in held], length)
            ids = np.array([r for r, _ in held], np.int64)
            edge = np.flatnonzero(np.r_[True, (np.diff(which) != 0) | (np.diff(place) != 1)]) if len(which) else np.empty(0, np.int64)
            last = np.r_[edge[1:], len(which)] - 1 if len(edge) else edge
            return pa.RecordBatch.from_arrays([pa.array(ids[which[edge]]), pa.array(place[edge]), pa.array(place[last] + length)], names=["run_id", "a", "b"])

        task_of("suffix")
        held, shard = [], None
        for batch in batches:
            for r, s, run in zip(np.asarray(batch.column(0)).tolist(), np.asarray(batch.column(1)).tolist(), batch.column(2).to_pylist()):
                if s != shard and held:
                    yield solved(held)
                    held = []
                shard = s
                held.append((r, run))
        if held:
            yield solved(held)

    return dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(sort, "run_id bigint, a bigint, b bigint")


def repeated_spans(docs: DataFrame, text_col: str, length: int = 200) -> DataFrame:
    """(text, spans): for each distinct text with any, the byte ranges that repeated strings of ``length`` cover.

    ``text`` is the hash of the whole text; ranges overlap and touch.
    """
    if length < 1:
        raise ValueError("strings have at least a byte")
    texts = _texts(docs, text_col)
    copies = texts.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("data")).alias("bytes")).filter((F.col("n") > 1) & (F.col("bytes") >= length))
    whole = copies.select("text", F.lit(0).cast("bigint").alias("a"), F.col("bytes").cast("bigint").alias("b"))
    anchors = _anchor_table(texts, length)
    places = anchors.groupBy("anchor").agg(F.min("text").alias("t0"), F.max("text").alias("t1"), F.min("first").alias("f0"), F.max("first").alias("f1"), F.bool_or("again").alias("again"))
    repeated = written(places.filter("t0 <> t1 or f0 <> f1 or again").select("anchor"), "anchors")
    found = written(_run_texts(texts, repeated, anchors, length).withColumn("run_id", F.xxhash64("anchor", "run")), "runs")
    entries = found.groupBy("run_id", "anchor", "run").agg(
        F.min("text").alias("t0"), F.max("text").alias("t1"), F.min("first").alias("f0"), F.max("first").alias("f1"), F.max("count").alias("count"))
    entries = written(entries.withColumn("several", F.expr("t0 <> t1 or f0 <> f1")).select("run_id", "anchor", "run", "several", "count"), "entries")
    found_again = _repeated_strings(entries, length)
    several = entries.filter("several").select("run_id", F.lit(0).cast("bigint").alias("a"), (F.col("count") + (length - 1)).alias("b"))
    hits = written(found_again.unionByName(several), "hits")
    spans = found.select("run_id", "text", "first").distinct().join(by_merge(hits), "run_id").select("text", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    return spans.unionByName(whole).groupBy("text").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges, in order, of ranges that overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 200, keep: tuple[str, ...] = ("kept",)) -> DataFrame:
    """``docs`` with what is left of each whole text, and counts of what went.

    Columns added (those of these names are replaced): n_bytes, n_removed,
    n_spans (maximal ranges removed), kept_sha256, and, if named in ``keep``,
    kept: the bytes that are left, in order, as text (a character that lost a
    byte goes whole) and removed: the ranges. Null texts are empty; an empty text
    loses nothing. Every row is kept. Rows with equal texts are copies of each
    other: they repeat each other whole. An empty table gives no rows.
    """
    added = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    if "kept" in keep:
        added["kept"] = pa.string()
    if "removed" in keep:
        added["removed"] = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    docs = docs.drop(*added)
    spans = written(repeated_spans(docs, text_col, length), "spans").withColumnsRenamed({"text": "__text", "spans": "__spans"})
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    others = [c for c in docs.columns if c != text_col or "text" in keep]
    joined = docs.withColumn("__data", data).withColumn("__hash", F.xxhash64("__data")).join(by_merge(spans), F.col("__hash") == F.col("__text"), "left").select(*others, "__data", "__spans")
    n = len(others)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices_by_bytes(utf8_parts(batch.column(n))[1], 8 * AT_ONCE):
                values = {k: [] for k in added}
                part = batch.slice(i, j - i)
                for whole, ranges in zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist()):
                    gone = _merged(ranges)
                    edges = [0, *(x for r in gone for x in r), len(whole)]
                    left = b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    row = {"n_bytes": len(whole), "n_removed": len(whole) - len(left), "n_spans": len(gone), "kept_sha256": hashlib.sha256(left).hexdigest(),
                           "kept": left.decode("utf-8", "ignore") if "kept" in keep else None, "removed": [{"a": a, "b": b} for a, b in gone]}
                    for k in added:
                        values[k].append(row[k])
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(values[k], t) for k, t in added.items())], names=[*others, *added])

    span = StructType().add("a", LongType()).add("b", LongType())
    kinds = {"n_bytes": LongType(), "n_removed": LongType(), "n_spans": LongType(), "kept_sha256": StringType(), "kept": StringType(), "removed": ArrayType(span)}
    schema = StructType([joined.schema[c] for c in others])
    for name in added:
        schema = schema.add(name, kinds[name])
    return joined.mapInArrow(apply, schema)


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = 200) -> DataFrame:
    """``docs`` with the repeated strings taken out of the texts; all other columns as they were."""
    # under names of their own, so that none clashes with those that remove_repeats adds
    plain = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    out = remove_repeats(docs.withColumnsRenamed(plain), plain[text_col], length, ("kept",))
    return out.select(*[F.col("kept" if c == text_col else plain[c]).alias(c) for c in docs.columns])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes in all ``documents``: what goes and what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, "text", 200, ()).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op10_suffix_dedup": (op10_suffix_dedup, None)}
