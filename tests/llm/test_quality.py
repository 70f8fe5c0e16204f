"""Operator 4: probabilities against a plain model, and its verdicts on held-out labels."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import cohortwise.llm.quality as quality
from cohortwise.llm.quality import ORDER, classify, gram_counts, gram_scores, kept_documents, kneser_ney

SF = "/root/testdata/sf0.01"


def plain_model(texts):
    """log p(last character | those before) of any n-gram (a string), by interpolated modified Kneser-Ney."""
    counts = {ORDER: Counter()}
    for t in texts:
        padded = "\n" * (ORDER - 1) + t
        counts[ORDER].update(padded[i:i + ORDER] for i in range(len(t)))
    for size in range(ORDER - 1, 0, -1):
        counts[size] = Counter(g[1:] for g in counts[size + 1])
    off = {}
    for size, c in counts.items():
        n = [0, *(sum(v == k for v in c.values()) for k in range(1, 5))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        off[size] = [0, *(max(min(k - (k + 1) * y * n[k + 1] / n[k], k - 0.05), 0.05) if n[k] and n[k + 1] else k / 2 for k in (1, 2, 3))]
    totals, left = Counter(), Counter()
    for size, c in counts.items():
        for g, v in c.items():
            totals[size, g[:-1]] += v
            left[size, g[:-1]] += off[size][min(v, 3)]

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        size, context = len(gram), gram[:-1]
        if not totals[size, context]:
            return p(gram[1:])
        v = counts[size][gram]
        return ((v - off[size][min(v, 3)] if v else 0) + left[size, context] * p(gram[1:])) / totals[size, context]
    return p


def test_probabilities(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd é漢") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    train = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    others = ["abcdxyz", "zz ab", "漢漢漢字"]
    grams = gram_counts(train.unionByName(spark.createDataFrame([("en", t) for t in others], train.schema)))
    model = kneser_ney(quality.written(gram_counts(train), "t"))
    got = gram_scores(grams, model).collect()
    p = plain_model(texts)

    def text(gram):
        parts = [(gram >> (12 * k)) & 4095 for k in range(ORDER - 1, -1, -1)]
        return "".join(map(chr, parts))
    fold = lambda t: "".join(c if ord(c) < 4000 else chr(4000 + ord(c) % 96) for c in t)
    p = plain_model([fold(t) for t in texts])
    assert len(got) == grams.count()
    for r in got:
        assert r.score == pytest.approx(math.log(p(text(r.gram))), abs=1e-9), text(r.gram)
    total = sum(p("ab" + "c" + x) for x in {c for t in texts for c in fold(t)})
    assert total == pytest.approx(1 - p("abc\x01"), abs=1e-9)


@pytest.mark.parametrize("head", [0, 50, 1 << 16])
def test_perplexity_by_head_and_shards(spark, monkeypatch, head):
    """The same from the broadcast head, from the sharded join, and from both; long texts in pieces."""
    monkeypatch.setattr(quality, "HEAD", head)
    monkeypatch.setattr(quality, "FEW_IDS", head)
    monkeypatch.setattr(quality, "AT_ONCE", 64)
    good = ["the cat sat on the mat", "a cat and a dog", "the dog sat", "on and on the mat " * 20]
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(10, "zebra qux ### the", "en"), (10, "zebra qux ### the", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id bigint, quality int, toxic int")
    p = plain_model(good)
    for r in classify(docs, labels).collect():
        t = dict((a, b) for a, b, _ in rows)[r.doc_id]
        padded = "\n" * (ORDER - 1) + t
        want = -sum(math.log(p(padded[i:i + ORDER])) for i in range(len(t))) / len(t)
        assert r.n_chars == len(t) and r.log_perplexity == pytest.approx(want, abs=1e-8)


def test_held_out_labels(spark):
    """Trained on four fifths of the labels, it tells junk from prose on the others."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = classify(docs, labels.filter("doc_id % 5 <> 0")).join(labels.filter("doc_id % 5 = 0"), "doc_id").collect()
    clean = [r.keep for r in found if r.quality == 1 and r.toxic == 0]
    junk = [r.keep for r in found if r.quality == 0]
    assert len(clean) > 30 and sum(clean) / len(clean) > 0.98
    assert len(junk) > 5 and sum(junk) / len(junk) < 0.4


def test_threshold_from_texts_the_model_has_not_seen(spark):
    """The quantile of trusted texts scored without their fold, and no margin on top."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    good = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 40))) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    fold = {r.doc_id: r.fold for r in docs.selectExpr("doc_id", f"pmod(xxhash64(lang, text), {quality.FOLDS}) AS fold").collect()}
    models = {f: plain_model([t for i, t in enumerate(good) if fold[i] != f]) for f in set(fold.values())}
    assert len(models) > 1

    def low(i, t):
        padded = "\n" * (ORDER - 1) + t
        return -sum(math.log(models[fold[i]](padded[k:k + ORDER])) for k in range(len(t))) / len(t) - quality.SPREAD / math.sqrt(len(t))
    want = sorted(math.ceil(low(i, t) / quality.STEP) * quality.STEP for i, t in enumerate(good))[math.ceil(0.9 * 30) - 1]
    got = {r.threshold for r in classify(docs, labels, share=0.9).collect()}
    assert len(got) == 1 and got.pop() == pytest.approx(want, abs=1e-9)


def test_nulls_empty_unknown_language_and_clashes(spark):
    rows = [(1, "a good text of some words", "en", 1), (2, None, "en", 2), (3, "", None, 3), (None, "#&%*!@ $$$$ ####", "en", 4), (None, "#&%*!@ $$$$ ####", "en", 4), (4, "text in no known language", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, key int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    got = sorted((r.doc_id or -1, r.keep, r.log_perplexity is None) for r in classify(docs, labels).collect())
    assert got == [(-1, False, False), (-1, False, False), (1, True, False), (2, True, True), (3, True, True), (4, True, True)]
    kept = kept_documents(docs, labels)
    assert kept.columns == docs.columns and sorted(r.key for r in kept.collect()) == [1, 2, 3, 5]
    assert classify(docs.limit(0), labels).count() == 0
    assert all(r.keep for r in classify(docs, labels.limit(0)).collect())


def test_only_a_row_for_each_language_is_broadcast(spark, monkeypatch):
    """Trusted ids and tables of n-grams are never collected and broadcast by a join, however small their files are."""
    import re

    plans = []
    kept = quality.written

    def seen(df, tag):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return kept(df, tag)
    monkeypatch.setattr(quality, "written", seen)
    docs = spark.createDataFrame([(i, f"some prose, number {i}", "en") for i in range(8)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id bigint, quality int, toxic int")
    plans.append(kept_documents(docs, labels)._jdf.queryExecution().sparkPlan().toString())
    by = [re.sub(r"#\d+L?", "", x) for p in plans for x in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", p)]
    assert by and set(by) <= {"lang", "lang, tail"}


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_trusted_ids_of_any_type(spark, kind):
    """Whole numbers are looked up, others joined; a null id is not trusted, and repeated rows count as often as they occur."""
    rows = [(i, f"a text that is number {i} of some", "en") for i in (1, 2, 2, 3, 9, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").withColumn("doc_id", F.col("doc_id").cast(kind))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (-4, 1, 0)], "doc_id int, quality int, toxic int").withColumn("doc_id", F.col("doc_id").cast(kind))
    ids = quality.trusted_ids(labels)
    among = quality._shared_ids(docs, ids)
    assert (among is None) == (kind == "string")
    got = {(r.lang, r.gram): r.n for r in gram_counts(docs if among else docs.join(ids, "doc_id", "left_semi"), among).collect()}
    want = {(r.lang, r.gram): r.n for r in gram_counts(docs.filter("doc_id in (1, 2)")).collect()}
    assert got == want and sum(got.values()) == sum(len(t) for i, t, _ in rows if i in (1, 2))
    none = spark.createDataFrame([], labels.schema)
    assert gram_counts(docs, quality._shared_ids(docs, quality.trusted_ids(none))).count() == 0 if among else True
