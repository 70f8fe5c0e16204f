"""Operator 5: packing token pieces into sequences with a linear grouping scheme.

Lengths are whole numbers up to the capacity, so the whole problem is a
histogram of at most ``capacity`` rows, whatever the size of the corpus. On
that histogram the driver

1. takes the large lengths (over a third of the capacity) in descending order, cuts them into
   groups of equal cardinality and rounds each length up to its group's largest;
2. solves the few-size problem: the linear program over bin configurations, by column generation;
3. substitutes the actual lengths for the rounded ones, configuration by configuration;
4. places what the rounding down of the program left over, then the small lengths, by best fit.

The result is a list of templates (lengths in a sequence, number of such
sequences), whose size depends on the capacity alone. Spark ranks the pieces
of each length and looks each rank up in that list; no piece is ever compared
with another.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortwise.llm.bpe import byte_characters, public_path
from cohortwise.llm.common import buckets_for, by_merge, holds_tables, slices_by_bytes, table, task_of, utf8_parts, written

#: Groups of the linear grouping.
GROUPS = 400
#: A length over capacity / LARGE_SHARE is large.
LARGE_SHARE = 3
#: Words after which a worker begins a new table of known ids (it keeps the last two).
KEPT_WORDS = 400_000
#: Bytes of text encoded at a time (a longer text stands alone).
AT_ONCE = 1 << 22


# ---- the plan, on the histogram ------------------------------------------------------------------


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration (count of each size) of the greatest worth that fits: a knapsack by number of items."""
    most = capacity // int(sizes.min())
    best, picks = np.zeros(capacity + 1), []
    for _ in range(most):
        options = np.full((len(sizes), capacity + 1), -1.0)
        for k, s in enumerate(sizes.tolist()):
            options[k, s:] = best[: capacity + 1 - s] + worth[k]
        pick = options.argmax(0)
        better = options[pick, np.arange(capacity + 1)]
        pick = np.where(better > best + 1e-12, pick, -1)
        best = np.maximum(best, better)
        picks.append(pick)
        if (pick < 0).all():
            break
    count, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            count[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(best[capacity]), count


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Least number of bins (a real number) for ``demand`` items of each size: columns and how often each is used.

    Column generation: start from bins of one size, price the dual values with
    a knapsack, bring in the best column until none has a reduced cost.
    """
    basis = np.diag((capacity // sizes).astype(float))
    used = demand / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = _best_configuration(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, used / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        used = np.maximum(np.linalg.solve(basis, demand), 0)
    return basis, used


@dataclass
class _Bins:
    """``count`` sequences that hold the same lengths."""

    lengths: tuple[int, ...]
    count: int


def _linear_grouping(counts: np.ndarray, capacity: int) -> tuple[list[_Bins], np.ndarray]:
    """Bins for the large lengths; the counts that are left."""
    left = counts.copy()
    large = np.flatnonzero(counts[:capacity] * (np.arange(capacity) > capacity // LARGE_SHARE))[::-1]
    bins = [_Bins((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    total = int(counts[large].sum())
    if not total:
        return bins, left
    # each group: its actual lengths in descending order, as [length, count]
    per_group = -(-total // GROUPS)
    groups: list[list[list[int]]] = [[]]
    room = per_group
    for length in large.tolist():
        n = int(counts[length])
        while n:
            if not room:
                groups.append([])
                room = per_group
            take = min(n, room)
            groups[-1].append([length, take])
            n, room = n - take, room - take
    by_size: dict[int, list[list[int]]] = {}
    for g in groups:  # groups rounded to the same size are one size
        by_size.setdefault(g[0][0], []).extend(g)
    sizes = np.array(list(by_size), np.int64)
    stock = list(by_size.values())
    demand = np.array([sum(n for _, n in s) for s in stock], float)
    basis, used = configurations(sizes, demand, capacity)
    at = [[0, 0] for _ in stock]  # (run, taken of it) of each size

    def take(k: int, n: int) -> list[list[int]]:
        """The next ``n`` actual lengths of size k, in runs; fewer if there are no more."""
        got = []
        while n and at[k][0] < len(stock[k]):
            length, have = stock[k][at[k][0]]
            m = min(n, have - at[k][1])
            got.append([length, m])
            left[length] -= m
            n -= m
            at[k][1] += m
            if at[k][1] == have:
                at[k] = [at[k][0] + 1, 0]
        if n:
            got.append([0, n])
        return got

    for c in range(len(sizes)):
        n = int(np.floor(used[c] + 1e-6))
        if not n:
            continue
        slots = [take(k, n) for k in range(len(sizes)) for _ in range(int(basis[k, c]))]
        ends = sorted({e for runs in slots for e in np.cumsum([m for _, m in runs]).tolist()})
        start = 0
        for end in ends:
            lengths = []
            for runs in slots:
                seen = 0
                for length, m in runs:
                    seen += m
                    if seen > start:
                        lengths.append(length)
                        break
            held = tuple(x for x in lengths if x)
            if held:
                bins.append(_Bins(held, end - start))
            start = end
    return bins, left


def _best_fit(bins: list[_Bins], left: np.ndarray, capacity: int) -> list[_Bins]:
    """Place the counts that are left, long ones first, each into the fullest sequence that has room."""
    by_gap: list[list[_Bins]] = [[] for _ in range(capacity + 1)]
    for b in bins:
        by_gap[capacity - sum(b.lengths)].append(b)
    for length in np.flatnonzero(left)[::-1].tolist():
        n, gap = int(left[length]), length
        while n:
            while gap <= capacity and not by_gap[gap]:
                gap += 1
            if gap > capacity:  # new sequences
                each = capacity // length
                full, rest = divmod(n, each)
                for count, m in ((full, each), (1, rest)):
                    if count and m:
                        by_gap[capacity - m * length].append(_Bins((length,) * m, count))
                break
            b = by_gap[gap].pop()
            each = gap // length
            full, rest = divmod(n, each)
            full = min(full, b.count)
            rest = rest if full < b.count else 0
            n -= full * each + rest
            if b.count > full + (rest > 0):
                by_gap[gap].append(_Bins(b.lengths, b.count - full - (rest > 0)))
            if full:
                by_gap[gap - each * length].append(_Bins(b.lengths + (length,) * each, full))
            if rest:
                by_gap[gap - rest * length].append(_Bins(b.lengths + (length,) * rest, 1))
    return [b for held in by_gap for b in held]


def plan(counts: np.ndarray, capacity: int) -> list[_Bins]:
    """Templates that hold ``counts[l]`` pieces of each length l (0 < l <= capacity)."""
    return _best_fit(*_linear_grouping(counts, capacity), capacity)


def lookup(bins: list[_Bins]) -> dict[str, np.ndarray]:
    """For the ranks of each length: intervals, each a run of sequences at one offset."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for b in bins:
        offset = 0
        for length in b.lengths:
            first = taken.get(length, 0)
            rows.append((length, first, base, offset))
            taken[length] = first + b.count
            offset += length
        base += b.count
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 44) + a[:, 1], "first": a[:, 1], "base": a[:, 2], "offset": a[:, 3]}


# ---- Spark ---------------------------------------------------------------------------------------


def pack(pieces: DataFrame, length_col: str, order_by: list[str], capacity: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity`` tokens, gapless from 0.

    Lengths run from 1 to ``capacity``. ``pieces`` is read more than once and
    should be a stored table. ``order_by`` spreads pieces of one length (any
    share of all rows may have it) over blocks, each ranked apart; repeated
    and null values there are fine, every row has a place of its own. Columns
    named sequence_id or offset are replaced. No rows give no rows.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy(length_col).count().collect():  # at most `capacity` rows
        if length is None or not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length}; lengths run from 1 to {capacity}")
        counts[length] = n
    where = spark.sparkContext.broadcast(lookup(plan(counts, capacity)))
    blocks = buckets_for(spark, int(counts.sum()), 1 << 16)
    blocked = pieces.withColumn("__block", F.pmod(F.xxhash64(*order_by), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(length_col).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocked.groupBy(length_col, "__block").agg(F.count(F.lit(1)).alias("__n")).select(
        length_col, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(length_col, "__block").orderBy(*order_by)
    ranked = (blocked.withColumn("__rank", F.row_number().over(inner) - 1)
              .join(by_merge(bases), [length_col, "__block"]).withColumn("__rank", F.col("__rank") + F.col("__base")))

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length, rank):
        import pandas as pd

        plan_ = where.value
        rank = rank.to_numpy(np.int64)
        i = np.searchsorted(plan_["key"], (length.to_numpy(np.int64) << 44) + rank, side="right") - 1
        return pd.DataFrame({"sequence_id": plan_["base"][i] + rank - plan_["first"][i], "offset": plan_["offset"][i]})

    placed = ranked.withColumn("__place", place(F.col(length_col), F.col("__rank")))
    return placed.select("*", "__place.*").drop("__place", "__rank", "__base", "__block")


class WordIds:
    """Ids of whole texts by a word-level vocabulary file: white space parts words for certain.

    The ids of a text are those of its words one after the other; each distinct
    word is encoded once. A word of plain Latin letters with marks behind it is
    looked up without them and in lower case, as the file's own rules part and
    lower it so.
    """

    plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)?\Z").match
    split = re.compile(r"[^ \t\n\r]+").findall
    odd_space = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]").search

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.chars = byte_characters()
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    def _cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.split(text) if self.odd_space(text) else text.split()

    def _plain_ids(self, word: str) -> bytes:
        """Ids of lower-case Latin letters, or of marks: one pre-token, which needs none of the file's rules before merging."""
        ids = self.words.get(word)
        if ids is None:
            ids = self.older_words.get(word)
            if ids is None:
                shown = word if word.isascii() else "".join(map(self.chars.__getitem__, word.encode()))
                ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            self.words[word] = ids
        return ids

    def _learn(self, fragments: set[str]) -> dict[str, bytes]:
        found, other = {}, []
        kept, older, plain, ids_of = self.kept, self.older, self.plain, self._plain_ids
        for f in fragments:
            ids = kept.get(f)
            if ids is None:
                ids = older.get(f)
                if ids is None:
                    m = plain(f)
                    if m is None:
                        other.append(f)
                        continue
                    ids = ids_of(m[1].lower())
                    if m[2]:
                        ids += ids_of(m[2])
                if len(f) <= 64:
                    kept[f] = ids
            found[f] = ids
        for f, e in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False)):
            found[f] = np.array(e.ids, "<u4").tobytes()
            if len(f) <= 64:
                kept[f] = found[f]
        if len(self.words) > KEPT_WORDS:
            self.older_words, self.words = self.words, {}
        if len(kept) > KEPT_WORDS:
            self.older, self.kept = kept, {}
        return found

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self._cut(t) for t in texts]
        ids = self._learn(set().union(*cut))
        return [np.frombuffer(b"".join(map(ids.__getitem__, words)), "<u4") for words in cut]


@holds_tables("packing")
@functools.lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, key_col: str, text_col: str, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The token pieces of every whole text: key, piece, start, length, ids_crc32 (and ``ids``, if asked for).

    A document is the ids of its text (null: none) and then ``end_id``; one of
    more than ``capacity`` ids is cut into pieces of that many, the last may be
    shorter. So every row has at least one piece, the empty text a piece of one id.
    """
    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("packing")
        words = word_ids(path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            column = batch.column(1)
            for i, j in slices_by_bytes(utf8_parts(column)[1], AT_ONCE):
                at, piece, start, length, crc, held = [], [], [], [], [], []
                for k, ids in enumerate(words.encode_many(column.slice(i, j - i).to_pylist())):
                    ids = np.concatenate([ids, end])
                    for a in range(0, len(ids), capacity):
                        part = ids[a:a + capacity]
                        at.append(i + k)
                        piece.append(a // capacity)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        held.append(part.astype(np.int64) if with_ids else None)
                cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["key", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(held, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(cut, f"key {kind}, {PIECES}" + (", ids array<bigint>" if with_ids else ""))
    return out.withColumnRenamed("key", key_col)


def packed(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack whole documents: their pieces with sequence_id and offset."""
    pieces = written(token_pieces(docs, key_col, text_col, path or public_path("word_bpe_49k.json"), capacity, with_ids=with_ids), "pieces")
    return pack(pieces, "length", [key_col, "piece", "ids_crc32"], capacity)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids (``packed(..., with_ids=True)``); at most a capacity each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": (op5_packing, None)}
