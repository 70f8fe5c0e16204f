"""Operator 12: vector codes, found on a lexicographic trie over distinct parts.

Vectors of integers are cut into equal parts. Parts are counted once each and
sorted, so that a walk over them in order is a depth-first traversal of the
trie of their components: a node holds, for every codebook entry, the squared
distance accumulated over its prefix, and all parts below share it. A leaf
takes the least of its row and adds its component values, weighted by its
count, to that entry's sums. The codebooks of the next round are those sums,
``PARTS`` x ``ENTRIES`` rows, whatever the size of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm.common import binary_rows, join_groups, table, task_of, utf8_parts, written

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Larger components count as this: squared distances then fit 64 bits for parts of up to 127 components.
MOST = 1 << 27
#: Parts walked at a time.
BLOCK = 8192

_ZERO = 1 << 31


class Walk:
    """A depth-first traversal of the trie of one position's parts, in blocks of rows.

    The path to the last row stays, with the distances accumulated at each of
    its nodes, so a block goes on where its first row leaves that path. Rows
    in sorted order share most; any other order gives the same distances.
    """

    def __init__(self, book: np.ndarray):
        self.book = book
        self.last: np.ndarray | None = None
        self.path = np.zeros((book.shape[1] + 1, len(book)), np.int64)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of the rows of ``x`` to every entry."""
        n, width = x.shape
        same = np.empty(n, np.int64)  # components shared with the row before
        for at, pair in ((slice(1, None), x[1:] != x[:-1]), (slice(0, 1), x[:1] != self.last if self.last is not None else np.ones((1, width), bool))):
            same[at] = np.where(pair.any(1), pair.argmax(1), width)
        held, node = self.path[:1], np.zeros(n, np.int64)
        for d in range(width):
            starts = np.flatnonzero(same <= d)
            step = x[starts, d][:, None] - self.book[:, d]
            found = held[node[starts]] + step * step
            shared = bool(same[0] > d)
            held = np.concatenate([self.path[d + 1:d + 2], found]) if shared else found
            node = np.cumsum(same <= d) - (0 if shared else 1)
            self.path[d + 1] = held[-1]
        self.last = x[-1].copy()
        return held[node]


def _encoded(x: np.ndarray) -> np.ndarray:
    """Integers as 4 bytes each whose bytewise order is that of the numbers."""
    return (x + _ZERO).astype(">u4")


def _decoded(column: pa.Array, width: int) -> np.ndarray:
    raw, _ = utf8_parts(column)
    return np.frombuffer(raw.tobytes(), ">u4").astype(np.int64).reshape(len(column), width) - _ZERO


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """((id, label, x), components of a part): the rows that take part, with floor(SCALE * component) as bytes.

    Rows whose vector is null or holds a null, a NaN or an infinity are left
    out. Shorter vectors end in zeros, as do all if ``PARTS`` does not divide
    the length; components beyond ``MOST`` count as that.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.filter(F.col(vector_col).isNotNull()).filter(fine).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    width = max(-(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // PARTS), 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("codes")
        for batch in batches:
            vectors = batch.column(2)
            off = np.asarray(vectors.offsets)
            sizes = np.diff(off)
            x = np.zeros((len(vectors), PARTS * width))
            x[np.arange(PARTS * width) < sizes[:, None]] = np.asarray(vectors.flatten(), float)
            x = np.clip(np.floor(np.clip(x, -MOST, MOST) * SCALE), -MOST, MOST).astype(np.int64)
            for i in range(0, len(x), BLOCK):
                part = batch.slice(i, BLOCK)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), binary_rows(_encoded(x[i:i + BLOCK]))], names=["id", "label", "x"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label")]
    return written(rows.mapInArrow(encode, f"{', '.join(kinds)}, x binary"), "vectors"), width


def distinct_parts(vectors: DataFrame, width: int) -> DataFrame:
    """(pos, part, n): every distinct part with its count, stored in lexicographic order."""
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.substring("x", p * (4 * width) + 1, F.lit(4 * width))))
    counted = vectors.select(cut.alias("pos", "part")).groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n"))
    return written(counted.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"), "parts")


def _sums(parts: DataFrame, books: np.ndarray) -> np.ndarray:
    """(position, entry, [count, component sums...]) of the parts assigned to each entry."""
    width = books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("codes")
        walks = [Walk(b) for b in books]
        total = np.zeros((*books.shape[:2], width + 1), np.int64)
        for batch in batches:
            pos, weight = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            x = _decoded(batch.column(1), width)
            for p in np.unique(pos):
                rows = np.flatnonzero(pos == p)
                for i in range(0, len(rows), BLOCK):
                    at = rows[i:i + BLOCK]
                    own = walks[p].distances(x[at]).argmin(1)  # the lower index on ties
                    np.add.at(total[p], own, np.column_stack([np.ones(len(at), np.int64), x[at]]) * weight[at][:, None])
        p, e, d = (a.ravel() for a in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(d, pa.int32()), pa.array(total.ravel(), pa.int64())], names=["p", "e", "d", "v"])

    sums = parts.mapInArrow(assign, "p int, e int, d int, v bigint").groupBy("p", "e", "d").agg(F.sum("v").alias("v"))
    out = np.zeros((*books.shape[:2], width + 1), np.int64)
    for p, e, d, v in sums.collect():  # one number for each of the codebooks'
        out[p, e, d] = v
    return out


def trained(vectors: DataFrame, width: int) -> np.ndarray:
    """The codebooks (PARTS, entries, width) after all rounds, from the vectors of the smallest ids (nulls last, then by vector)."""
    first = vectors.orderBy(F.asc_nulls_last("id"), "x").limit(ENTRIES).select("x").collect()  # ENTRIES rows
    if not first:
        return np.zeros((PARTS, 0, width), np.int64)
    seeds = np.stack([np.frombuffer(bytes(r.x), ">u4").astype(np.int64) - _ZERO for r in first])
    books = seeds.reshape(len(seeds), PARTS, width).transpose(1, 0, 2).copy()
    parts = distinct_parts(vectors, width)
    for _ in range(ROUNDS):
        sums = _sums(parts, books)
        used = sums[:, :, 0] > 0
        books[used] = sums[used][:, 1:] // sums[used][:, :1]
    return books


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every vector: its parts' entries, and its squared distance to them."""
    width = books.shape[2]
    kinds = [f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("id", "label")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("codes")
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                x = _decoded(part.column(2), PARTS * width)
                own, error = np.empty((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
                for p in range(PARTS):
                    y = x[:, p * width:(p + 1) * width]
                    order = np.lexsort(y.T[::-1])
                    distances = Walk(books[p]).distances(y[order])
                    best = distances.argmin(1)
                    own[order, p] = best
                    error[order] += distances[np.arange(len(best)), best]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes().hex() for r in own], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return vectors.mapInArrow(code, f"{', '.join(kinds)}, code string, error bigint")


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector that takes part; see ``integer_vectors``.

    Ties of distance go to the lower entry, an entry without parts stays as it
    is. With fewer than ``ENTRIES`` vectors the codebooks have as many entries
    as vectors. Repeated rows are kept and count as often; rows with a null id
    are kept. A table without such vectors gives no rows.
    """
    vectors, width = integer_vectors(df, id_col, vector_col, label_col)
    books = trained(vectors, width)
    if not books.shape[1]:
        kind = vectors.schema["id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"{id_col} {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = written(coded(vectors, books), "codes")
    totals = written(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "totals")
    return join_groups(rows, "label", totals, "rows").select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``: 8 parts, 16 entries, 6 rounds."""
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    distance = "list_sum([(p.part[i] - b.part[i]) * (p.part[i] - b.part[i]) for i in range(1, len(b.part) + 1)])"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"assigned{r} AS MATERIALIZED (SELECT p.id, p.pos, p.part, min({{'d': {distance}::BIGINT, 'e': b.entry}}) AS best FROM parts p JOIN book{r} b ON b.pos = p.pos GROUP BY p.id, p.pos, p.part)")
        if r < ROUNDS:
            steps.append(f"""sums{r} AS (SELECT pos, entry, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT pos, best.e AS entry, unnest(part) AS x, unnest(range(len(part))) AS i FROM assigned{r}) GROUP BY pos, entry, i),
means{r} AS (SELECT pos, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS part FROM sums{r} GROUP BY pos, entry),
book{r + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(m.part, b.part) AS part FROM book{r} b LEFT JOIN means{r} m ON m.pos = b.pos AND m.entry = b.entry)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER () AS id, [greatest(least(floor({SCALE} * x::DOUBLE), {MOST}), -{MOST})::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (
  SELECT id, pos, list_resize(v, {PARTS} * w, 0)[pos * w + 1:pos * w + w] AS part FROM kept, (SELECT unnest(range({PARTS})) AS pos), (SELECT greatest((max(len(v)) + {PARTS - 1}) // {PARTS}, 1) AS w FROM kept)),
seeds AS (SELECT id, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}),
book0 AS MATERIALIZED (SELECT p.pos, s.entry, p.part FROM parts p JOIN seeds s ON s.id = p.id),
{',\n'.join(steps)},
coded AS (SELECT id, string_agg(lpad(printf('%x', best.e), 2, '0'), '' ORDER BY pos) AS code, sum(best.d)::BIGINT AS error FROM assigned{ROUNDS} GROUP BY id),
sha AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY pos, entry, i)) AS h FROM (SELECT pos, entry, unnest(part) AS x, unnest(range(len(part))) AS i FROM book{ROUNDS}))
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, sha.h AS codebooks_sha256
FROM kept k JOIN coded c ON c.id = k.id CROSS JOIN sha
"""


QUERIES = {"op12_codes": (op12_codes, _sql())}
