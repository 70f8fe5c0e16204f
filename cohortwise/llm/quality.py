"""Operator 4: quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

One model for each language, over characters, trained on all trusted texts.
Every table of the model is keyed by (lang, n-gram): counts, continuation
counts and context sums are sharded by that key and joined shard by shard, and
so are the n-grams of the corpus with the probabilities.

An n-gram is a whole number: ORDER characters of 12 bits. Characters from
U+0FA0 on share 96 classes; others stand for themselves.

Documents are never joined with the model n-gram by n-gram where it can be
avoided: n-grams are Zipf distributed, so the ``HEAD`` most frequent ones (a
fixed number, broadcast) make up almost all of a text, and only the others go
through the sharded join as rows (document, n-gram, count).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortwise.llm.common import by_merge, slices_by_bytes, table, task_of, utf8_parts, written

ORDER = 4
_BITS = 12
#: The n-grams of a language that are broadcast, at most.
HEAD = 1 << 16
#: Trusted ids up to this number go to the tasks as whole numbers of 8 bytes each; more, and ids of other types, are joined by a shuffle.
FEW_IDS = 2_000_000
#: Bytes of text taken apart at a time; a longer text is taken in pieces.
AT_ONCE = 1 << 20
#: Steps of log-perplexity in which quantiles are found.
STEP = 1e-3
#: The mean over n characters is uncertain by about SPREAD / sqrt(n): a few characters can't condemn a text.
SPREAD = 3.0
#: Parts of the trusted documents, each scored by a model of the others for the threshold; 10 at most.
FOLDS = 3
#: Of the threshold's size, added to it.
MARGIN = 0.0


def _codes(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of texts i to j, and the text of each.

    Each text begins after ORDER - 1 line ends.
    """
    pad = "\n" * (ORDER - 1)
    joined = pad.join(["", *(x or "" for x in column.slice(i, j - i).to_pylist())])
    lengths = np.array(pc.fill_null(pc.utf8_length(column.slice(i, j - i)), 0), np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    points = np.where(points < 4000, points, 4000 + points % 96)
    code = points.copy()
    for k in range(1, ORDER):
        code[k:] |= points[:-k] << (_BITS * k)
    at = np.repeat(np.arange(j - i), lengths)
    return code[np.arange(len(at)) + (at + 1) * (ORDER - 1)], at + i


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number, values = pd.factorize(codes)
    return values, np.bincount(number, minlength=len(values))


def _shared_ids(docs: DataFrame, ids: DataFrame) -> Broadcast | None:
    """The ids of ``ids`` (doc_id) for all tasks, sorted, if they are whole numbers and ``FEW_IDS`` at most."""
    whole = {"tinyint", "smallint", "int", "bigint"}
    if not {d.schema["doc_id"].dataType.simpleString() for d in (docs, ids)} <= whole or ids.count() > FEW_IDS:
        return None
    found = ids.select(F.col("doc_id").cast("bigint")).toArrow().column(0).to_numpy()
    return docs.sparkSession.sparkContext.broadcast(np.sort(found))


def _of_ids(batch: pa.RecordBatch, column: int, ids: np.ndarray) -> pa.RecordBatch:
    """The rows whose id, in the ``column``, is one of the sorted ``ids``; a null is none."""
    if not len(ids):
        return batch.slice(0, 0)
    own = batch.column(column).cast(pa.int64())
    known = own.fill_null(0).to_numpy(zero_copy_only=False)
    same = ids[np.minimum(np.searchsorted(ids, known), len(ids) - 1)] == known
    return batch.filter(pc.and_(pa.array(same), own.is_valid()))


def gram_counts(docs: DataFrame, among: Broadcast | None = None) -> DataFrame:
    """(lang, gram, n): how often each n-gram occurs in the texts of each language; summed up in each task first.

    ``among``: only the texts with these ids (see ``_shared_ids``).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("quality")
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            number, values = pd.factorize(np.concatenate([v for v, _ in held[lang]]))
            return values, np.bincount(number, np.concatenate([n for _, n in held[lang]]), len(values)).astype(np.int64)

        for batch in batches:
            if among is not None:
                batch = _of_ids(batch, 2, among.value)
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                texts = batch.column(1).take(pa.array(np.flatnonzero(langs == lang)))
                for i, j in slices_by_bytes(utf8_parts(texts)[1], AT_ONCE):
                    held.setdefault(lang, []).append(_counted(_codes(texts, i, j)[0]))
                    if sum(len(v) for v, _ in held[lang]) > 1 << 21:
                        held[lang] = [merged(lang)]
        for lang in sorted(held):
            values, n = merged(lang)
            for a in range(0, len(values), 1 << 16):
                v, m = values[a:a + (1 << 16)], n[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v), pa.string()), pa.array(v, pa.int64()), pa.array(m, pa.int64())], names=["lang", "gram", "n"])

    return docs.select("lang", "text", *(["doc_id"] if among is not None else [])).mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): the discounts of modified Kneser-Ney from the counts of counts."""
    n = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in range(1, 5)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    # where a count of counts is 0 (a small corpus), half of the count is taken off
    parts = [F.when((F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0), F.greatest(F.least(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(k - 0.05)), F.lit(0.05))).otherwise(F.lit(k / 2)).alias(f"d{k}") for k in (1, 2, 3)]
    return counts.groupBy("lang").agg(*n).select("lang", *parts)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """The model: (lang, size, gram, kind, value).

    kind 'p': the interpolated log-probability of the last character of an
    n-gram of ``size`` characters after the others; kind 'b': the log of the
    weight that its characters, as a context, leave to the shorter context.
    ``counts`` holds lang, gram (ORDER characters) and n. The highest order uses the counts, each lower
    one the number of different characters before an n-gram.
    """
    by_size = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):
        mask = (1 << (_BITS * size)) - 1
        by_size[size] = written(by_size[size + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams{size}")
    # below one character: all characters that occur, and one for those that don't, are equally likely
    lower = by_size[1].groupBy("lang").agg((-F.log(F.count(F.lit(1)) + 1.0)).alias("value"))
    parts = [lower.select("lang", F.lit(0).alias("size"), F.lit(0).cast("bigint").alias("gram"), F.lit("p").alias("kind"), "value")]
    below = lower.select("lang", F.lit(0).cast("bigint").alias("tail"), F.exp("value").alias("p_below"))
    for size in range(1, ORDER + 1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << (_BITS * (size - 1))) - 1))
        # a row for each language: broadcast is bounded by their number
        off = by_size[size].join(F.broadcast(_discounts(by_size[size])), "lang")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        off = off.select("lang", "gram", "n", d.alias("d"), F.shiftright("gram", _BITS).alias("context"), tail.alias("tail"))
        contexts = off.groupBy("lang", "context").agg(F.sum("n").cast("double").alias("total"), F.sum("d").alias("left"))
        # below one character there is a row for each language, too
        p = (off.join(by_merge(contexts), ["lang", "context"]).join(by_merge(below) if size > 1 else F.broadcast(below), ["lang", "tail"])
             .withColumn("p", (F.col("n") - F.col("d") + F.col("left") * F.col("p_below")) / F.col("total")))
        p = written(p.select("lang", "gram", "p"), f"p{size}")
        parts.append(p.select("lang", F.lit(size).alias("size"), "gram", F.lit("p").alias("kind"), F.log("p").alias("value")))
        parts.append(contexts.select("lang", F.lit(size - 1).alias("size"), F.col("context").alias("gram"), F.lit("b").alias("kind"), F.log(F.col("left") / F.col("total")).alias("value")))
        below = p.select("lang", F.col("gram").alias("tail"), F.col("p").alias("p_below"))
    model = parts[0]
    for more in parts[1:]:
        model = model.unionByName(more)
    return model


def gram_scores(grams: DataFrame, model: DataFrame) -> DataFrame:
    """``grams`` (lang, gram, ...) with ``score``, the log-probability of the last character after the others.

    The longest end of the n-gram that the model knows gives the probability,
    and every longer context that it knows its weight. n-grams of a language
    without a model have no score.
    """
    parts = [F.struct(F.lit(0).alias("size"), F.lit(0).cast("bigint").alias("part"), F.lit("p").alias("kind"))]
    for size in range(1, ORDER + 1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << (_BITS * size)) - 1))
        parts.append(F.struct(F.lit(size).alias("size"), tail.alias("part"), F.lit("p").alias("kind")))
        parts.append(F.struct(F.lit(size - 1).alias("size"), F.shiftright(tail, _BITS).alias("part"), F.lit("b").alias("kind")))
    asked = grams.select("lang", "gram", F.inline(F.array(*parts)))
    found = asked.join(by_merge(model.withColumnRenamed("gram", "part")), ["lang", "size", "part", "kind"])
    best = found.groupBy("lang", "gram").agg(
        F.max(F.when(F.col("kind") == "p", F.struct("size", "value"))).alias("p"),
        F.collect_list(F.when(F.col("kind") == "b", F.struct("size", "value"))).alias("b"))  # ORDER at most
    # the order of a context is its size + 1: weights of orders above that of the probability count
    weight = F.aggregate(F.filter("b", lambda x: x["size"] >= F.col("p.size")), F.lit(0.0), lambda s, x: s + x["value"])
    scores = best.select("lang", "gram", (F.col("p.value") + weight).alias("score"))
    return grams.join(by_merge(scores), ["lang", "gram"])


def _head(scores: DataFrame) -> DataFrame:
    """The most frequent n-grams, ``HEAD`` at most: all whose count reaches the step that this number allows.

    Steps are sixteenths of a doubling, so their table has some hundred rows
    and no task sends the driver more than its share of the head.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = sorted(scores.groupBy(step.alias("step")).count().collect(), reverse=True)
    least, total = 1 << 30, 0
    for s, n in steps:
        if total + n > HEAD:
            break
        least, total = s, total + n
    return scores.filter(step >= least)


def log_perplexities(docs: DataFrame, scores: DataFrame, among: Broadcast | None = None) -> DataFrame:
    """(doc_id, lang, key, n, log_perplexity) for every row of ``docs`` (doc_id, lang, text, key), or those with the ids ``among`` (see ``_shared_ids``).

    ``scores`` holds every n-gram of the documents with its count ``n`` in the
    corpus. The log-perplexity is per character; it is null for a text without
    characters and for a language without scores. ``key`` tells rows apart; rows
    with the same key have the same language and text.
    """
    spark = docs.sparkSession
    ranked = _head(scores).select("lang", "gram", "score").toArrow().to_pandas()  # HEAD rows at most
    head = {lang: (part["gram"].to_numpy(np.int64), part["score"].to_numpy(float)) for lang, part in ranked.groupby("lang")}
    shared = spark.sparkContext.broadcast(head)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "lang", "key", "gram", "k", "n", "total"]
        task_of("quality")
        index = {lang: (pd.Index(grams), values) for lang, (grams, values) in shared.value.items()}

        def out(batch, rows, lang, gram, k, n, total):
            ids, keys = (batch.column(c).take(pa.array(rows)) for c in (0, 3))
            return pa.RecordBatch.from_arrays([ids, pa.array([lang] * len(rows), pa.string()), keys, pa.array(gram, pa.int64()), pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=names)

        for batch in batches:
            if among is not None:
                batch = _of_ids(batch, 0, among.value)
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                rows = np.flatnonzero(langs == lang)
                texts = batch.column(2).take(pa.array(rows))
                known_grams, values = index.get(lang, (None, None))
                for i, j in slices_by_bytes(utf8_parts(texts)[1], AT_ONCE):
                    codes, of = _codes(texts, i, j)
                    of = of - i
                    place = known_grams.get_indexer(codes) if known_grams is not None else np.full(len(codes), -1)
                    known = place >= 0
                    total = np.bincount(of[known], values[place[known]], j - i) if known.any() else np.zeros(j - i)
                    none = [None] * (j - i)
                    yield out(batch, rows[i:j], lang, none, none, np.bincount(of, minlength=j - i), total)
                    if not known.all():
                        rest = pd.DataFrame({"of": of[~known], "gram": codes[~known]}).value_counts(sort=False).reset_index()
                        m = len(rest)
                        yield out(batch, rows[i + rest["of"].to_numpy()], lang, rest["gram"].to_numpy(), rest["count"].to_numpy(), np.zeros(m, np.int64), np.zeros(m))

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(docs.select("doc_id", "lang", "text", "key").mapInArrow(look_up, f"doc_id {kind}, lang string, key bigint, gram bigint, k bigint, n bigint, total double"), "lookups")
    per_row = found.filter("gram is null")
    rest = (found.filter("gram is not null").join(by_merge(scores.select("lang", "gram", "score")), ["lang", "gram"])
            .select("key", F.lit(0).cast("bigint").alias("n"), (F.col("k") * F.col("score")).alias("total")))
    sums = per_row.select("key", "n", "total").unionByName(rest).groupBy("key").agg(F.sum("n").alias("all"), F.sum("total").alias("total"))
    # rows with the same key add up alike above and below the line
    scored = scores.select("lang").distinct().withColumn("known", F.lit(True))
    ratio = F.when(F.col("known") & (F.col("all") > 0), -F.col("total") / F.col("all"))
    return per_row.select("doc_id", "lang", "key", "n").join(by_merge(sums), "key").join(F.broadcast(scored), "lang", "left").select("doc_id", "lang", "key", "n", F.round(ratio, 9).alias("log_perplexity"))


def quantiles(rows: DataFrame, share: float) -> DataFrame:
    """(lang, value): the least value of ``low``, in steps of ``STEP``, that ``share`` of a language's rows don't exceed."""
    bins = rows.filter("low is not null").groupBy("lang", F.ceil(F.col("low") / F.lit(STEP)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))
    of = F.sum("n").over(Window.partitionBy("lang"))
    reached = bins.withColumn("up_to", up_to).withColumn("of", of).filter(F.col("up_to") >= F.col("of") * F.lit(share))
    return reached.groupBy("lang").agg((F.min("bin") * F.lit(STEP)).alias("value"))


def prepared(docs: DataFrame) -> DataFrame:
    lang, text = F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select("doc_id", lang, text, F.xxhash64("doc_id", F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit(""))).alias("key"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that every label calls good and none toxic."""
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and coalesce(t, 0) = 0").select("doc_id")


def _with_low(found: DataFrame) -> DataFrame:
    return found.withColumn("low", F.round(F.col("log_perplexity") - F.lit(SPREAD) / F.sqrt("n"), 9))


def _folded(trusted: DataFrame) -> DataFrame:
    """``trusted`` with the fold of each text as the last character of ``lang``; equal texts of a language share a fold."""
    fold = F.pmod(F.xxhash64("lang", "text"), F.lit(FOLDS)).cast("string")
    return trusted.withColumn("lang", F.concat("lang", fold))


def held_out(folded: DataFrame, counts: DataFrame, among: Broadcast | None = None) -> DataFrame:
    """(lang, low) of trusted documents, each scored by a model that has seen no text of its fold.

    ``folded`` comes from ``_folded`` (its rows with the ids ``among``, if given), ``counts`` are its n-grams. A fold that holds all of
    a language's texts has no model; its ``low`` is null.
    """
    base, fold = F.expr("left(lang, length(lang) - 1)"), F.expr("right(lang, 1)")
    for_others = F.explode(F.filter(F.array(*[F.lit(str(k)) for k in range(FOLDS)]), lambda k: k != fold))
    others = counts.select(base.alias("base"), for_others.alias("fold"), "gram", "n").groupBy(F.concat("base", "fold").alias("lang"), "gram").agg(F.sum("n").alias("n"))
    model = written(kneser_ney(written(others, "others")), "heldout")
    scores = written(gram_scores(counts, model), "heldscores")
    return _with_low(log_perplexities(folded, scores, among)).select(base.alias("lang"), "low")


def classify(docs: DataFrame, labels: DataFrame, share: float = 0.99, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, n_chars, log_perplexity, low, threshold, keep) for every row of ``docs`` (doc_id, lang, text).

    The model of a language is trained on all its trusted documents (see
    ``trusted_ids``). A document's ``low`` is its log-perplexity less what so
    few characters leave uncertain (``SPREAD`` / sqrt(n)). The threshold of a
    language is the ``share`` quantile of its trusted documents' ``low`` by models
    without their fold (``held_out``; by the model itself if all its trusted text is in one fold) and
    ``margin`` of its size more; a document whose ``low`` is above it is rejected. Documents in a language without trusted text and texts without
    characters have no perplexity and are kept. A null language is a language
    of its own, a null text is empty, a null id is kept as it is; repeated rows
    are kept, each with its verdict. Empty tables give no rows.
    """
    return _classified(docs, labels, share, margin).drop("key")


def _classified(docs: DataFrame, labels: DataFrame, share: float, margin: float) -> DataFrame:
    rows = prepared(docs)
    good = written(trusted_ids(labels), "trusted")
    among = _shared_ids(rows, good)
    folded = _folded(rows if among is not None else rows.join(by_merge(good), "doc_id", "left_semi"))
    by_fold = written(gram_counts(folded, among), "folds")
    counts = by_fold.groupBy(F.expr("left(lang, length(lang) - 1)").alias("lang"), "gram").agg(F.sum("n").alias("n"))
    model = written(kneser_ney(written(counts, f"grams{ORDER}")), "model")
    scores = written(gram_scores(gram_counts(rows), model), "scores")
    found = written(_with_low(log_perplexities(rows, scores)), "perplexities")
    own = quantiles(found.join(by_merge(good), "doc_id", "left_semi"), share).withColumnRenamed("value", "own")
    value = F.coalesce("value", "own")
    # a row for each language
    limits = (own.join(F.broadcast(quantiles(held_out(folded, by_fold, among), share)), "lang", "left")
              .select("lang", (value + F.abs(value) * F.lit(margin)).alias("threshold")))
    keep = F.coalesce(F.col("low") <= F.col("threshold"), F.lit(True))
    # a row for each language
    return found.join(F.broadcast(limits), "lang", "left").select("doc_id", "lang", F.col("n").alias("n_chars"), "log_perplexity", "low", "threshold", keep.alias("keep"), "key")


def kept_documents(docs: DataFrame, labels: DataFrame, share: float = 0.99, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns."""
    gone = _classified(docs, labels, share, margin).filter(~F.col("keep")).select(F.col("key").alias("__key")).distinct()
    key = F.xxhash64("doc_id", F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit("")))
    return docs.join(by_merge(gone), key == F.col("__key"), "left_anti")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all ``documents``, by models trained on the labelled good ones."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality": (op4_quality, None)}
