"""Operator 2: document fingerprints by one-permutation MinHash, densified and packed.

All shingle hashes of a text are thrown into ``BINS`` bins once, by their high
bits, and each bin keeps the least of its low bits. Empty bins are filled by
optimal densification: each empty bin draws bins, by a hash of its own number
and the draw's number, until it hits one that was not empty, and copies it.
Of each bin ``BITS`` low-order bits are stored. Two fingerprints agree in a
bin by chance with probability c = 2^-BITS, so the share of equal bins p gives
the likeness (p - c) / (1 - c).
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortwise.llm.common import buckets_for, slices_by_bytes, table, utf8_parts

#: Bins of a fingerprint (a power of two) and stored bits of each (4 or 8).
BINS, BITS = 512, 4
SHINGLE = 5
#: Ranges of the ids at most; a range may be larger than memory.
MOST_RANGES = 4096
#: Bytes of text hashed at a time; a longer text is hashed in pieces of its words.
AT_ONCE = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (two multiply-shift rounds)."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers, and those of its inverse modulo 2^64."""
    n = 4 * AT_ONCE + 1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[_U(1), np.full(n, _MULTIPLIER, np.uint64)])
        down = np.cumprod(np.r_[_U(1), np.full(n, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)])
    return up, down


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of some bytes: A-Z lowered, parted by ASCII white space."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True]))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    if len(data) > 4 * AT_ONCE:  # one huge stretch: cut it at words, a single word longer than that by hashing its bytes
        out_h, out_s, i = [], [], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + 2 * AT_ONCE, side="right")))
            a, b = int(starts[i]), int(ends[j - 1])
            if b - a > 4 * AT_ONCE:
                import hashlib

                h = np.array([int.from_bytes(hashlib.blake2b(_LOWER[data[a:b]].tobytes(), digest_size=8).digest(), "little")], np.uint64)
                out_s.append(np.array([a]))
            else:
                h, s = word_hashes(data[a:b])
                out_s.append(s + a)
            out_h.append(h)
            i = j
        return np.concatenate(out_h), np.concatenate(out_s)
    up, down = _powers()
    with np.errstate(over="ignore"):
        sums = np.r_[_U(0), np.cumsum((_LOWER[data].astype(np.uint64) + _U(1)) * up[: len(data)])]
        return _mixed((sums[ends] - sums[starts]) * down[starts]), starts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words (fewer words: one for them all; none: none)."""
    if not len(words):
        return words
    n = max(len(words) - size + 1, 1)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(min(size, len(words))):
            h = (h ^ words[k:k + n]) * _U(_MULTIPLIER)
            h ^= h >> _U(29)
    return _mixed(h)


@functools.lru_cache(maxsize=2)
def _draws(bins: int, most: int = 4096) -> np.ndarray:
    """The bin that each empty bin tries at each draw."""
    with np.errstate(over="ignore"):
        h = _mixed(np.arange(bins * most, dtype=np.uint64) * _U(_MULTIPLIER) + _U(12345))
    return (h >> _U(40)).astype(np.int64).reshape(most, bins) % bins


_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _densified(least: np.ndarray) -> np.ndarray:
    """``least`` (texts x bins) with its empty bins filled; a text without any shingle stays empty."""
    bins = least.shape[1]
    draws = _draws(bins)
    full = least != _EMPTY
    row, col = np.nonzero(~full & full.any(1)[:, None])
    source = least.copy()
    for k in range(len(draws)):
        if not len(row):
            return source
        drawn = draws[k][col]
        hit = full[row, drawn]
        source[row[hit], col[hit]] = least[row[hit], drawn[hit]]
        row, col = row[~hit], col[~hit]
    for r in np.unique(row):  # draws run out only for a text of a shingle or two: the next full bin in turn
        have = np.flatnonzero(full[r])
        c = col[row == r]
        source[r, c] = least[r, have[np.searchsorted(have, c) % len(have)]]
    return source


def _bins_of(words: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The least value in each bin for n texts: ``of`` tells each word's text, in order."""
    counts = np.bincount(of, minlength=n)
    ends = np.cumsum(counts)
    least = np.full((n, BINS), _EMPTY)
    # shingles that stay within one text; those of texts with fewer words are made one by one
    if len(words) >= SHINGLE:
        h = shingle_hashes(words, SHINGLE)
        at = of[: len(h)]
        inside = at == of[SHINGLE - 1:]
        h, at = h[inside], at[inside]
        order = np.lexsort((h, at))  # by text, then by bin (the high bits) and value
        h, at = h[order], at[order]
        bin_ = (h >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
        cell = at * BINS + bin_
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, int)
        least.reshape(-1)[cell[first]] = h[first]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        h = shingle_hashes(words[ends[i] - counts[i]: ends[i]], SHINGLE)[0]
        least[i, int(h >> _U(64 - BINS.bit_length() + 1))] = h
    return least


def _packed_bits(least: np.ndarray) -> np.ndarray:
    """BITS low-order bits of each bin, packed; all bins empty give zeros."""
    low = (_mixed(least) & _U((1 << BITS) - 1)).astype(np.uint8)
    if BITS == 4:
        low = (low[:, ::2] << 4) | low[:, 1::2]
    return low


def fingerprint_batch(column: pa.Array) -> list[str]:
    """The fingerprints of whole texts, as hexadecimal digits; a text without words (null too) has the empty string."""
    data, off = utf8_parts(column)
    out: list[str] = []
    for i, j in slices_by_bytes(off, AT_ONCE):
        part = data[off[i]:off[j]]
        n = j - i
        if n == 1:
            words, _ = word_hashes(part)
            least = np.full((1, BINS), _EMPTY)
            step = AT_ONCE // 4
            for a in range(0, max(len(words) - SHINGLE + 1, 1), step):  # pieces of its words, SHINGLE - 1 of them shared
                piece = words[a:a + step + SHINGLE - 1]
                least = np.minimum(least, _bins_of(piece, np.zeros(len(piece), np.int64), 1))
        else:
            # a space after each text, so that no word runs on
            spaced = np.full(len(part) + n, 0x20, np.uint8)
            shift = np.repeat(np.arange(n), np.diff(off[i:j + 1]))
            spaced[np.arange(len(part)) + shift] = part
            words, starts = word_hashes(spaced)
            of = np.searchsorted(off[i:j + 1] - off[i] + np.arange(n + 1), starts, side="right") - 1
            least = _bins_of(words, of, n)
        filled = (least != _EMPTY).any(1)
        bits = _packed_bits(_densified(least))
        out += [row.tobytes().hex() if f else "" for row, f in zip(bits, filled)]
    return out


def likeness(a: str | None, b: str | None) -> float:
    """The estimated share of common shingles, 0 to 1; two texts without words are alike, one is like no other."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    z = x ^ y
    same = (z == 0).sum() if BITS == 8 else ((z >> 4) == 0).sum() + ((z & 15) == 0).sum()
    c = 2.0 ** -BITS
    return float(min(max((same / BINS - c) / (1 - c), 0.0), 1.0))


def fingerprints(df: DataFrame, text_col: str, out_col: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each whole text; equal texts have equal fingerprints."""

    @F.pandas_udf("string")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprint_batch(pa.array(texts, pa.string(), from_pandas=True)), dtype=object)

    return df.withColumn(out_col, fingerprint(F.col(text_col)))


def followed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row (id, text) with ``next_text``, the text of the row after it in descending order of id.

    After the last row comes the first. Rows with a null id stand at the end,
    rows with one id follow each other by their texts. The order is cut into
    ranges of ids, each with a copy of the first row of the next range at its
    end (``last``; the caller drops it), so texts are shuffled once and no
    range need fit in memory. Sorted by (range, last, order) within partitions.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("id", F.lit(-(1 << 63))))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(buckets_for(spark, size, 4 << 20), MOST_RANGES)
    shares = [k / ranges for k in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx(F.col("key").cast("double"), shares or [0.5], 20 * ranges)).first()[0] or []  # ranges - 1 numbers
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    from pyspark.ml.feature import Bucketizer

    number = Bucketizer(splits=splits, inputCol="at", outputCol="range")
    rows = number.transform(rows.withColumn("at", F.col("key").cast("double"))).withColumn("range", F.col("range").cast("int")).drop("at")
    heads = sorted(rows.groupBy("range").agg(F.max("key").alias("key")).collect())  # a row for each range
    after = [(heads[i][0], heads[i - 1][1]) for i in range(len(heads))]  # the lowest range is followed by the highest
    ends = spark.createDataFrame(after, "range int, key bigint")
    first_of = rows.filter(F.col("key").isin([h[1] for h in heads])).groupBy("key").agg(F.min_by(F.struct("id", "text"), "text").alias("row"))
    copies = first_of.join(F.broadcast(ends), "key").select("row.id", "row.text", "key", "range", F.lit(True).alias("last"))
    every = rows.select("id", "text", "key", "range", F.lit(False).alias("last")).unionByName(copies)
    order = Window.partitionBy("range").orderBy("last", F.desc("key"), "text")
    return every.withColumn("next_text", F.lead("text").over(order))


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprints of every whole text, of its edited text, and their likeness; see ``followed`` for the order.

    The edited text has its last third (rounded down) replaced by as many first
    characters of the next row's text. Null texts are empty; every row is kept,
    repeated rows and rows with a null id too. An empty table gives no rows.
    """
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))"))
    rows = followed(df, id_col, text_col).select("id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"), "last")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))

    def compare(batches):
        held = None  # the row whose next one has not come yet
        for batch in batches:
            ids, n_chars, sha = batch.column(0), batch.column(1), batch.column(4)
            fps, edited_fps = fingerprint_batch(batch.column(2)), fingerprint_batch(batch.column(3))
            last = batch.column(5).to_pylist()
            rows_ = list(zip(ids.to_pylist(), n_chars.to_pylist(), sha.to_pylist(), fps, edited_fps, last))
            out = []
            for row in rows_:
                if held is not None and not held[5]:
                    out.append((*held[:5], likeness(held[3], held[4]), likeness(held[3], row[3])))
                held = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=_NAMES)

    # every partition ends with the copy that ends its last range, so nothing is left in `held`
    return rows.select("id", "n_chars", "text", "edited", "edited_sha256", "last").mapInArrow(compare, _SCHEMA).withColumnRenamed("id", id_col)


_SCHEMA = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_KINDS = [{"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in _SCHEMA.split(", ")]


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts."""
    return edited_pairs(table(spark, sf_dir, "documents"))


QUERIES = {"op2_fingerprints": (op2_fingerprints, None)}
