"""Operator 13: a Merkle manifest of a table, by slot pivots.

The rows of a group become numbered leaves. At each level conditional
aggregates spread the children of a parent into ``FANOUT`` columns, one a
slot; the columns joined together are hashed into the parent, and joined
without a child's own slot they are that child's siblings. The roots of the
groups are the leaves of one more tree. Going down again, every child's path
is its siblings and its parent's path, so a level is joined with one an eighth
of its size, and no group's nodes are ever gathered in one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm.common import table, written
from cohortwise.operators.prefix import row_position

#: Children of a node at most.
FANOUT = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as the manifest hashes it: ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with pos (from 0 within the group) and n (rows of the group); ranges of rows are numbered, no group whole."""
    found = row_position(rows, [group], order)
    return found.withColumnRenamed("_before", "pos").withColumnRenamed("_group_total", "n")


def _slots(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(grp, pos, n, s0, s1, ...): a row for each parent, with its children's node and carried columns spread over the slots."""
    child = F.struct("node", *carried)
    slot = F.col("pos") % FANOUT
    spread = [F.max(F.when(slot == k, child)).alias(f"s{k}") for k in range(FANOUT)]
    parents = nodes.filter("n > 1").groupBy("grp", F.expr(f"pos div {FANOUT}").alias("pos")).agg(F.max("n").alias("n"), *spread)
    return parents.withColumn("n", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}"))


def _children(paths: DataFrame, carried: list[str]) -> DataFrame:
    """The children of slot rows that know their ``path``: each with its siblings put before it."""
    nodes = [F.col(f"s{k}.node") for k in range(FANOUT)]
    children = []
    for k in range(FANOUT):
        left, right = (F.concat_ws("", *part) if part else F.lit("") for part in (nodes[:k], nodes[k + 1:]))
        children.append(F.struct((F.col("pos") * FANOUT + k).alias("at"), nodes[k].alias("node"), F.struct(left.alias("left"), right.alias("right")).alias("own"),
                                 *[F.col(f"s{k}.{c}").alias(c) for c in carried]))
    rest = [c for c in paths.columns if c not in ("pos", "n", *[f"s{k}" for k in range(FANOUT)])]
    out = paths.select(*rest, "pos", F.inline(F.array(*children))).filter("node is not null")
    others = [c for c in rest if c not in ("grp", "path")]
    return out.select("grp", F.col("at").alias("pos"), "node", *carried, *others, F.concat(F.array("own"), "path").alias("path"))


def _climb(leaves: DataFrame, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(slot tables from the lowest level up, tops): tops has grp, node and level of what remains of each group."""
    nodes, pivots = leaves, []
    tops = [leaves.filter("n = 1").select("grp", "node", F.lit(0).alias("level"))]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        pivots.append(written(_slots(nodes, carried if not pivots else []), "slots"))
        nodes = pivots[-1].select("grp", "pos", "n", F.sha2(F.concat_ws("", *[F.col(f"s{k}.node") for k in range(FANOUT)]).cast("binary"), 256).alias("node"))
        tops.append(nodes.filter("n = 1").select("grp", "node", F.lit(len(pivots)).alias("level")))
        most = -(-most // FANOUT)
    every = tops[0]
    for more in tops[1:]:
        every = every.unionByName(more)
    return pivots, every


def _descend(pivots: list[DataFrame], tops: DataFrame, leaves: DataFrame, carried: list[str]) -> DataFrame:
    """Every leaf with its ``path`` and what ``tops`` (grp, level, path and more) says of its group."""
    more = [c for c in tops.columns if c not in ("grp", "level")]
    at = lambda k: tops.filter(F.col("level") == k).select("grp", F.lit(0).cast("bigint").alias("pos"), *more)
    known = at(len(pivots))
    for k in range(len(pivots) - 1, -1, -1):
        down = _children(pivots[k].join(known, ["grp", "pos"]), carried if k == 0 else [])
        if k == 0:
            alone = leaves.filter("n = 1").select("grp", "pos", "node", *carried).join(at(0), ["grp", "pos"])
            return down.unionByName(alone)
        known = down.drop("node").unionByName(at(k))
    return leaves.select("grp", "pos", "node", *carried).join(known, ["grp", "pos"])


_PATH = "array<struct<left: string, right: string>>"


def manifest(leaves: DataFrame) -> DataFrame:
    """The tree over ``leaves`` and a check of every leaf that is shown.

    ``leaves`` holds id, grp (a string, null too), leaf and shown, the leaf as
    it is found now. Returns id, leaf, subroot, root, path (siblings level by
    level up to the root, those left and right of the node), proof_sha256,
    folded_root (from ``shown`` and the path) and verified. The leaves of a
    group ascend by id (null first), then by leaf and shown; groups ascend
    bytewise, null first. Repeated rows are leaves of their own. No rows give none.
    """
    rows = leaves.select("id", F.coalesce(F.concat(F.lit("+"), F.col("grp")), F.lit("")).alias("grp"), F.col("leaf").alias("node"), "shown")
    numbered = written(_numbered(rows, "grp", [F.col("id"), F.col("node"), F.col("shown")]), "leaves")
    pivots, subroots = _climb(numbered, ["id", "shown"])
    subroots = written(subroots, "subroots")
    places = _numbered(subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("of"), "node", F.col("level").alias("height")), "grp", [F.col("of")])
    places = written(places, "places")
    top_pivots, top = _climb(places, ["of", "height"])
    top = top.select("grp", "level", F.col("node").alias("root"), F.array().cast(_PATH).alias("path"))
    tops = _descend(top_pivots, top, places, ["of", "height"])
    tops = written(tops.select(F.col("of").alias("grp"), F.col("height").alias("level"), F.col("node").alias("subroot"), "root", "path"), "tops")
    found = _descend(pivots, tops, numbered, ["id", "shown"])
    siblings = F.concat_ws("", F.transform("path", lambda x: F.concat(x["left"], x["right"])))
    folded = F.aggregate("path", F.col("shown"), lambda below, x: digest(x["left"], below, x["right"]))
    return (found.select("id", F.col("node").alias("leaf"), "subroot", "root", "path", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def leaf_digest(columns: list[Column]) -> Column:
    return digest(*[field(c) for c in columns])


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all ``documents``; where 3 divides the CRC-32 of an id, the text shown has its A-Z lowered."""
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    shown = F.when(crc % 3 == 0, leaf_digest([*columns[:-1], F.translate("text", _UPPER, _LOWER)]))
    leaf = leaf_digest(columns)
    leaves = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), leaf.alias("leaf"), shown.alias("shown")).withColumn("shown", F.coalesce("shown", "leaf"))
    found = manifest(leaves).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


# CRC-32 of a decimal text, bit by bit: reflected, polynomial 0xEDB88320
_CRC_SQL = """xor(list_reduce([ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT for i in range(1, strlen(doc_id::VARCHAR) + 1)],
  lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295)"""

SQL = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS grp, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_CRC_SQL} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf_sql('text')} END AS shown
  FROM documents),
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM docs),
levels AS (
  SELECT 0 AS level, grp, pos, n, leaf AS node FROM numbered
  UNION ALL
  SELECT max(level) + 1, grp, pos // {FANOUT}, max((n + {FANOUT - 1}) // {FANOUT}), sha256(string_agg(node, '' ORDER BY pos)) FROM levels WHERE n > 1 GROUP BY grp, pos // {FANOUT}),
low AS MATERIALIZED (SELECT * FROM levels),
subroots AS MATERIALIZED (SELECT grp, level, node, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
uppers AS (
  SELECT 0 AS level, pos, n, node FROM subroots
  UNION ALL
  SELECT max(level) + 1, pos // {FANOUT}, max((n + {FANOUT - 1}) // {FANOUT}), sha256(string_agg(node, '' ORDER BY pos)) FROM uppers WHERE n > 1 GROUP BY pos // {FANOUT}),
high AS MATERIALIZED (SELECT * FROM uppers),
root AS (SELECT node AS root FROM high WHERE n = 1),
siblings AS MATERIALIZED (
  SELECT a.grp, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM low a JOIN low b ON a.grp = b.grp AND a.level = b.level AND a.pos // {FANOUT} = b.pos // {FANOUT} WHERE a.n > 1 GROUP BY a.grp, a.level, a.pos),
upper_siblings AS MATERIALIZED (
  SELECT a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM high a JOIN high b ON a.level = b.level AND a.pos // {FANOUT} = b.pos // {FANOUT} WHERE a.n > 1 GROUP BY a.level, a.pos),
steps AS MATERIALIZED (
  SELECT d.grp, d.pos, s.level, s.l, s.r FROM numbered d JOIN siblings s ON s.grp = d.grp AND s.pos = d.pos // ({FANOUT} ** s.level)::BIGINT
  UNION ALL
  SELECT d.grp, d.pos, t.level + s.level, s.l, s.r FROM numbered d JOIN subroots t ON t.grp = d.grp JOIN upper_siblings s ON s.pos = t.pos // ({FANOUT} ** s.level)::BIGINT),
folds AS (
  SELECT grp, pos, -1::BIGINT AS level, shown AS node FROM numbered
  UNION ALL
  SELECT f.grp, f.pos, s.level, sha256(s.l || f.node || s.r) FROM folds f JOIN steps s ON s.grp = f.grp AND s.pos = f.pos AND s.level = f.level + 1),
folded AS (SELECT grp, pos, arg_max(node, level) AS folded_root FROM folds GROUP BY grp, pos),
proofs AS (SELECT grp, pos, string_agg(l || r, '' ORDER BY level) AS proof FROM steps GROUP BY grp, pos)
SELECT d.doc_id, d.leaf, t.node AS subroot, root.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.folded_root, f.folded_root = root.root AS verified
FROM numbered d JOIN subroots t ON t.grp = d.grp JOIN folded f ON f.grp = d.grp AND f.pos = d.pos
LEFT JOIN proofs p ON p.grp = d.grp AND p.pos = d.pos CROSS JOIN root
"""

QUERIES = {"op13_merkle": (op13_merkle, SQL)}
