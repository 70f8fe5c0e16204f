"""Operator 7: exact top-k by inner product with a pivot-distance index.

Vectors get one more component, sqrt(M^2 - |x|^2) (M the greatest norm; 0 for
queries), so that the greatest inner product is the least distance. Every
vector is keyed by its nearest pivot and its distance to it, and the vectors,
sorted by that key, are cut into *annuli*: blocks of at most ``BLOCK`` vectors
of one pivot between two distances. By the triangle inequality a query at
distance d from the pivot is at least max(d - outer, inner - d) away from all
of an annulus.

The search visits the annulus of the query's own key first, then wider rings,
and stops where the bound exceeds the distance of the k-th best found. All of
it runs on packed blocks of queries and vectors, joined on the pivot.

Equal vectors are one entry of the index with their smallest ids, which is all
that a top k can show of them; equal queries are one search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortwise.llm.common import shuffle_width, table, written

#: Vectors of an annulus and queries of a chunk, at most.
BLOCK, CHUNK = 4096, 1024
#: Pivots, and the rows of the sample that they are found on (by hash, so any order of the table gives the same).
PIVOTS, SAMPLE = 32, 4096
#: The rings, as shares of the distance that the k-th best allows.
RINGS = (0.0, 0.5, 1.0)
#: Products below this are exact in double precision.
EXACT = float(1 << 52)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = 64.0) -> DataFrame:
    """(id, v): floor(scale * x) of every component, as doubles; rows that take no part are left out.

    Those are rows whose id or vector is null, or whose vector holds a null, a
    NaN or an infinity. A row that is repeated counts once.
    """
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(F.lit(scale) * x).cast("double"))
    fine = F.forall(F.col(vector_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(fine).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).distinct()


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots by a few rounds of k-means from a farthest-first start."""
    picked = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(n, len(sample)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(1))
    pivots = sample[picked].copy()
    for _ in range(5):
        own = _distances(sample, pivots).argmin(1)
        for k in range(len(pivots)):
            if (own == k).any():
                pivots[k] = sample[own == k].mean(0)
    return pivots


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T), 0.0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column; missing components at the end are 0."""
    off = np.asarray(column.offsets)
    flat = np.asarray(column.values, float)
    lengths = np.diff(off)
    if (lengths == dim).all():
        return flat[off[0]:off[-1]].reshape(-1, dim)
    out = np.zeros((len(column), dim))
    for i, (a, b) in enumerate(zip(off, off[1:])):
        out[i, : b - a] = flat[a:b]
    return out


def _keyed(vectors: DataFrame, pivots: np.ndarray, dim: int, m2: float | None) -> DataFrame:
    """``vectors`` with the nearest pivot and the distance to it; ``m2`` is None for queries."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS rows

    @F.pandas_udf("struct<pivot: int, r: double>")
    def key(v):
        import pandas as pd

        x = _matrix(pa.array(v.tolist(), pa.list_(pa.float64())), dim)
        last = np.zeros(len(x)) if m2 is None else np.sqrt(np.maximum(m2 - (x * x).sum(1), 0.0))
        d = _distances(np.column_stack([x, last]), shared.value)
        own = d.argmin(1) if len(d) else np.zeros(0, int)
        return pd.DataFrame({"pivot": own.astype(np.int32), "r": d[np.arange(len(d)), own]})

    return vectors.withColumn("__key", key("v")).select("*", "__key.*").drop("__key")


def _packed(keyed: DataFrame, extra: str, most: int, rows: int, dim: int) -> DataFrame:
    """Runs of the keyed rows in the order (pivot, r), each of one pivot and at most ``most`` rows, packed.

    ``extra`` is an array<bigint> column whose values travel along.
    """
    parts = max(-(-rows // most), min(shuffle_width(keyed.sparkSession), -(-rows // 512)), 1)
    ordered = keyed.select("pivot", "r", "v", extra).repartitionByRange(parts, "pivot", "r").sortWithinPartitions("pivot", "r")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, r = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.flatnonzero(np.diff(pivot)) + 1
            for a, b in zip([0, *edges], [*edges, len(pivot)]):
                for i in range(a, b, most):
                    j = min(i + most, b)
                    ids = batch.column(3).slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(pivot[i])], pa.int32()), pa.array([float(r[i])]), pa.array([float(r[j - 1])]), pa.array([j - i], pa.int32()),
                        pa.array([_matrix(batch.column(2).slice(i, j - i), dim).tobytes()], pa.binary()),
                        pa.array([np.diff(np.asarray(ids.offsets)).astype(np.int64).tobytes()], pa.binary()),
                        pa.array([np.asarray(ids.flatten()).astype(np.int64).tobytes()], pa.binary())], names=["pivot", "inner", "outer", "n", "x", "counts", "ids"])

    return ordered.mapInArrow(pack, "pivot int, inner double, outer double, n int, x binary, counts binary, ids binary")


FOUND = "q bigint, score bigint, ids array<bigint>"


def _reach(m2: float, size, kth):
    """The distance within which an entry can score ``kth``, with room for rounding."""
    return np.sqrt(np.maximum(m2 + size - 2.0 * kth, 0.0)) * (1 + 1e-9) + 1e-6 * (1 + m2 ** 0.5)


def _visit(pairs: DataFrame, k: int, dim: int, m2: float) -> DataFrame:
    """The k best entries of each block for each query of the chunk that the bound allows."""
    exact = m2 < EXACT

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of the chunks that this task has met: the k-th best, and how far it reaches
        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(row["q_x"]).reshape(-1, dim)
                x = np.frombuffer(row["x"]).reshape(-1, dim)
                keys = np.frombuffer(row["q_ids"], np.int64)
                if row["chunk"] not in so_far:
                    so_far[row["chunk"]] = np.frombuffer(row["kth"], np.int64).copy(), np.frombuffer(row["reach"]).copy()
                floor_, reach = so_far[row["chunk"]]
                size = (q * q).sum(1)
                d = np.frombuffer(row["q_d"]).reshape(len(q), -1)[:, row["pivot"]]
                least = np.maximum(np.maximum(d - row["outer"], row["inner"] - d), 0.0)
                open_ = np.flatnonzero(least <= reach)
                ids = np.frombuffer(row["ids"], np.int64)
                ends = np.cumsum(np.frombuffer(row["counts"], np.int64))
                starts = np.r_[0, ends[:-1]]
                first = ids[starts]
                for a in range(0, len(open_), 256):
                    some = open_[a:a + 256]
                    s = np.rint(q[some] @ x.T).astype(np.int64) if exact else q[some].astype(np.int64) @ x.T.astype(np.int64)
                    out_q, out_s, out_i = [], [], []
                    for i, scores in zip(some.tolist(), s):
                        at = np.flatnonzero(scores >= floor_[i])
                        if len(at) > k:
                            edge = np.partition(scores[at], len(at) - k)[len(at) - k]
                            at = at[scores[at] >= edge]
                        at = at[np.lexsort((first[at], -scores[at]))][:k]
                        if len(at) == k and scores[at[-1]] > floor_[i]:  # no worse entry matters any more
                            floor_[i] = scores[at[-1]]
                            reach[i] = min(reach[i], _reach(m2, size[i], floor_[i]))
                        out_q += [int(keys[i])] * len(at)
                        out_s += scores[at].tolist()
                        out_i += [ids[starts[j]:ends[j]] for j in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_s, pa.int64()), pa.array(out_i, pa.list_(pa.int64()))], names=["q", "score", "ids"])

    return pairs.select("chunk", "q_x", "q_ids", "q_d", "reach", "kth", "pivot", "inner", "outer", "x", "counts", "ids").mapInArrow(search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]))
    return found.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def _chunks(queries: DataFrame, best: DataFrame | None, pivots: np.ndarray, dim: int, m2: float, k: int) -> DataFrame:
    """The chunks of queries with the distances to all pivots, and the k-th best score and reach so far."""
    if best is None:
        chunks = queries.select("*", F.lit(None).cast("array<struct<q:bigint,kth:bigint>>").alias("known"))
    else:
        # at most CHUNK rows for each chunk: the k-th best of its queries
        kth = best.groupBy("q").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        chunk_of = queries.select("chunk", F.explode("q_list").alias("q"))
        known = kth.join(chunk_of, "q").groupBy("chunk").agg(F.collect_list(F.struct("q", "kth")).alias("known"))
        chunks = queries.join(known, "chunk", "left")
    shared = queries.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(row["x"]).reshape(-1, dim)
                keys = np.frombuffer(row["ids"], np.int64)
                d = _distances(np.column_stack([q, np.zeros(len(q))]), shared.value)
                kth = np.full(len(q), np.iinfo(np.int64).min)
                reach = np.full(len(q), np.inf)
                if row["known"]:
                    by = {x["q"]: x["kth"] for x in row["known"]}
                    kth = np.array([by.get(i, np.iinfo(np.int64).min) for i in keys.tolist()], np.int64)
                    bounded = kth > np.iinfo(np.int64).min
                    reach = np.where(bounded, _reach(m2, (q * q).sum(1), np.where(bounded, kth, 0)), np.inf)
                home = d.argmin(1)
                spans = []
                for p in range(d.shape[1]):
                    own = d[home == p, p]
                    spans.append({"pivot": p, "near": float(d[:, p].min()), "far": float(d[:, p].max()),
                                  "own_near": float(own.min()) if len(own) else None, "own_far": float(own.max()) if len(own) else None})
                yield pa.RecordBatch.from_pylist([{
                    "chunk": row["chunk"], "q_x": row["x"], "q_ids": row["ids"], "q_d": d.tobytes(), "reach": reach.tobytes(), "kth": kth.tobytes(),
                    "most": float(min(reach.max(), 1e300)), "spans": spans}], schema=fields)

    span = pa.struct([("pivot", pa.int32()), *((c, pa.float64()) for c in ("near", "far", "own_near", "own_far"))])
    fields = pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("q_x", "q_ids", "q_d", "reach", "kth")), ("most", pa.float64()), ("spans", pa.list_(span))])
    return chunks.mapInArrow(measure, "chunk bigint, q_x binary, q_ids binary, q_d binary, reach binary, kth binary, most double, "
                             "spans array<struct<pivot: int, near: double, far: double, own_near: double, own_far: double>>")


def top_k(vectors: DataFrame, query_filter, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row (id, v) of ``vectors`` that ``query_filter`` names.

    Candidates are all rows whose id is not the query's; higher scores come
    first, equal scores by smaller id; fewer candidates than k give them all.
    Components missing at the end of a shorter vector count as 0. Rows with
    one id and several vectors are candidates each, and queries each (ranked
    together by score and id). An empty table, or no query, gives no rows.
    Scores must fit in 64 bits.
    """
    spark = vectors.sparkSession
    vectors = written(vectors, "vectors")
    asked = written(vectors.filter(query_filter).select("id", "v"), "asked")
    # as many entries more as the query itself may take
    own = asked.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    most = k + own
    facts = vectors.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m2"), F.count(F.lit(1)).alias("n")).first()
    dim, m2, n = max(facts["dim"] or 0, 1), facts["m2"] or 0.0, facts["n"]
    if not own or not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = vectors.withColumn("__n", first).filter(F.col("__n") <= most).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    searches = written(asked.groupBy("v").agg(F.count(F.lit(1)).alias("times")).select("v", F.monotonically_increasing_id().alias("q")), "searches")

    sample = vectors.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()  # SAMPLE rows at most
    at = _matrix(pa.array([r["v"] for r in sample], pa.list_(pa.float64())), dim)
    pivots = _pivots(np.column_stack([at, np.sqrt(np.maximum(m2 - (at * at).sum(1), 0.0))]), PIVOTS)

    blocks = written(_packed(_keyed(entries, pivots, dim, m2), "ids", BLOCK, n, dim).withColumn("block", F.monotonically_increasing_id()), "annuli")
    queries = _packed(_keyed(searches.select("v", F.array("q").alias("ids")), pivots, dim, None), "ids", CHUNK, searches.count(), dim)
    as_longs = F.udf(lambda b: np.frombuffer(b, np.int64).tolist(), "array<bigint>")
    queries = written(queries.withColumn("chunk", F.monotonically_increasing_id()).withColumn("q_list", as_longs("ids")), "chunks")

    best, visited = None, None
    for share in RINGS:
        chunks = _chunks(queries, best, pivots, dim, m2, most)
        spans = chunks.select("chunk", "most", F.inline("spans"))
        if share == 0.0:
            near, far, ring = F.col("own_near"), F.col("own_far"), F.lit(0.0)
        else:
            near, far, ring = F.col("near"), F.col("far"), F.col("most") * F.lit(share)
        summary = blocks.select("block", "pivot", "inner", "outer")
        span = spans.select("chunk", "pivot", near.alias("near"), far.alias("far"), ring.alias("ring"))
        open_ = (summary.join(span, "pivot").filter((F.col("outer") + F.col("ring") >= F.col("near")) & (F.col("inner") - F.col("ring") <= F.col("far")))
                 .select("chunk", "block"))
        if visited is not None:
            open_ = open_.join(visited, ["chunk", "block"], "left_anti")
        open_ = written(open_, "open")
        visited = open_ if visited is None else visited.unionByName(open_)
        # packed rows are never broadcast, however small their files are
        pairs = open_.join(chunks.drop("spans", "most").hint("merge"), "chunk").join(blocks.hint("merge"), "block")
        found = _visit(pairs, most, dim, m2)
        best = written(_best(found if best is None else best.unionByName(found), most), "best")

    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows = best.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("__n", F.row_number().over(ranked)).filter(F.col("__n") <= most).drop("__n")
    asked_q = asked.join(searches, "v").select(F.col("id").alias("query_id"), "q")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (asked_q.join(rows, "q").filter(F.col("query_id") != F.col("vec_id")).withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every embedding whose id is divisible by 20, among all others."""
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, F.col("id") % 20 == 0, 20)


ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op7_topk": (op7_topk, ORACLE_SQL)}
