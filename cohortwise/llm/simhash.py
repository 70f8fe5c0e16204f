"""Operator 3: SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that, of two fingerprints within the
distance, one segment differs by one bit at most. Each segment is indexed as
it is and with each of its bits taken out; two fingerprints that agree in such
an entry are candidates, and the full distance decides. Components of the
links are the near-duplicate classes.

Everything after the fingerprints works on *distinct* fingerprints, so a group
of copies of any size is one entry. An entry of the index that many
fingerprints share is not paired off: its members are indexed again, on the
part of the fingerprint that the entry leaves open, until few share an entry
or few bits are open (see ``_links``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm.common import by_merge, table, task_of, written
from cohortwise.llm.components import components

#: Shingles whose bits are counted at a time.
AT_ONCE = 1 << 16


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), AT_ONCE):
        part = hashes[a:a + AT_ONCE]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles: 64 bits, unsigned; 0 if it has no word.

    A-Z is lowered, words are parted by the ASCII white space, shingles count
    as often as they occur, and fewer words than a shingle are one shingle. A
    bit is 1 if more than half of the shingles' XXH64 values have it.
    """
    words = text.lower().split()  # bytes: A-Z only, and exactly x20 and x09 to x0D
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: n - shingle + 1].tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64)
    return int(_BIT[_bit_counts(hashes) * 2 > len(hashes)].sum())


def fingerprints(df: DataFrame, text_col: str, out_col: str = "fp", shingle: int = 3) -> DataFrame:
    """``df`` with the fingerprint of each whole text (null: no words) as a signed 64-bit integer."""

    @F.pandas_udf("bigint")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        task_of("simhash")
        for texts in batches:
            yield pd.Series([np.int64(np.uint64(fingerprint(x.encode() if x else b"", shingle))) for x in texts], dtype="int64")

    return df.withColumn(out_col, simhash(F.col(text_col)))


#: An entry that more distinct fingerprints share is indexed again instead of paired off.
SHARED = 256


def _index(members: DataFrame, low: int, width: int) -> DataFrame:
    """One-wildcard entries on the two halves of the open bits [low, low + width) of each member.

    ``members`` holds fp and key (what is agreed on so far) and the open bits'
    place in ``low``; the entries' open bits are the other half's.
    """
    half = width // 2
    mask = (1 << half) - 1
    entries = []
    for side in (0, 1):
        at = F.col("low") + F.lit(side * half)
        segment = F.expr(f"shiftrightunsigned(fp, cast(low + {side * half} as int)) & {mask}L")
        # -1: the segment as it is; j: its bit j taken out
        variants = F.expr(f"transform(sequence(-1, {half - 1}), j -> struct(j as j, if(j < 0, __s, __s & ~shiftleft(1L, j)) as s))")
        other = F.col("low") + F.lit((1 - side) * half)
        entries.append(members.withColumn("__s", segment).withColumn("__v", F.explode(variants))
                       .select("fp", F.xxhash64("key", at, F.col("__v.j"), F.col("__v.s")).alias("key"), other.cast("int").alias("low")))
    return entries[0].unionByName(entries[1])


def _links(distinct_fps: DataFrame, most_bits: int) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints within ``most_bits`` (at most 3) bits.

    With two halves, one differs by one bit at most as long as the distance is
    3 at most; this holds for the open half again, so an entry shared by many
    is indexed once more on its open half: 32, 16, 8, then 4 bits stay open. At
    4 open bits an entry has at most 2^4 fingerprints for each choice of its
    wildcards (one bit each level), 256 in all, so the last level always ends.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("two segments with one wildcard find distances up to 3")
    spark = distinct_fps.sparkSession
    members = distinct_fps.select("fp", F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("low"))
    found, width = [], 64
    while width > 4:
        entries = _index(members, 0, width)
        width //= 2
        counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = written(entries.join(by_merge(counts), "key"), "entries")
        few = shared if width == 4 else shared.filter(F.col("n") <= SHARED)
        pairs = few.select("key", F.col("fp").alias("a")).join(by_merge(few.select("key", F.col("fp").alias("b"))), "key").filter(
            (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits))
        found.append(pairs.select("a", "b"))
        members = shared.filter(F.col("n") > SHARED).select("fp", "key", "low").distinct()
        if width == 4 or members.isEmpty():
            break
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def _classes(df: DataFrame, shingle: int, most_bits: int) -> DataFrame:
    """``df`` (id, text and more) without the text, with fp, root (the same for a class) and component_id."""
    more = [c for c in df.columns if c != "text"]
    rows = written(fingerprints(df, "text", "fp", shingle).select(*more, "fp"), "fingerprints")
    distinct_fps = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = written(components(_links(distinct_fps.select("fp"), most_bits), "a", "b"), "roots")
    rooted = distinct_fps.join(by_merge(roots), distinct_fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(by_merge(rooted.join(by_merge(smallest), "root").select("fp", "root", "component_id")), "fp")


def simhash_classes(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, most_bits: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for every row: the near-duplicate classes of the whole texts.

    Fingerprints within ``most_bits`` bits are linked, and classes are the
    components of the links; component_id is the smallest id of the class. A
    null text has no words; texts without words have fingerprint 0, which is
    linked like any other. Rows with a null id belong to their class, whose
    smallest id is that of the others (null if there are none). Repeated rows
    are kept. An empty table gives an empty table.
    """
    classes = _classes(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle, most_bits)
    return classes.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate classes of all ``documents``: 3-word shingles, 3 bits."""
    return simhash_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


def simhash_dedup(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, most_bits: int = 3) -> DataFrame:
    """The rows of ``df`` that stay, whole: one of each near-duplicate class.

    It is the row with the smallest id (a null id is larger than any other); of
    rows that share it, one that two hashes of all their columns choose.
    """
    marks = [F.xxhash64(F.lit(k), *df.columns) for k in (1, 2)]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), marks[0].alias("h1"), marks[1].alias("h2"))
    first = _classes(rows, shingle, most_bits).groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "h1", "h2")).alias("r"))
    stay = first.select(F.col("r.h1").alias("__h1"), F.col("r.h2").alias("__h2"))
    # the join leaves equal rows together, so dropping repeats needs no further shuffle
    marked = df.withColumn("__a", marks[0]).withColumn("__b", marks[1])
    kept = marked.join(by_merge(stay), (F.col("__a") == F.col("__h1")) & (F.col("__b") == F.col("__h2")), "left_semi")
    return kept.dropDuplicates(["__a", "__b"]).drop("__a", "__b")


QUERIES = {"op3_simhash": (op3_simhash, None)}
