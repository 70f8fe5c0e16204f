"""Validation with a reason, age reconciliation, two-key dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.text import address_key, days_since, is_blank

# Plausible interior size bounds (sqft).
SQFT_MIN_PLAUSIBLE = 200
SQFT_MAX_PLAUSIBLE = 20_000


def invalid_reason(df: DataFrame) -> Column:
    """First failing data-quality rule, or null."""
    price, lat, lon, sqft, addr = (F.col(c) for c in ("price", "lat", "lon", "sqft", "address"))
    return (F.when(price.isNull() | (price <= 0), F.lit("missing or zero price"))
            .when(lat.isNull() | lon.isNull(), F.lit("missing coordinates"))
            .when(~lat.between(-90, 90) | ~lon.between(-180, 180), F.lit("coordinates out of range"))
            .when(sqft.isNotNull() & ~sqft.between(SQFT_MIN_PLAUSIBLE, SQFT_MAX_PLAUSIBLE),
                  F.concat(F.lit("implausible sqft ("), sqft.cast("string"), F.lit(")")))
            .when(addr.isNull() | is_blank(addr), F.lit("missing address")))


def validate(df: DataFrame) -> DataFrame:
    return df.withColumn("invalid_reason", invalid_reason(df))


def reconcile_age(df: DataFrame, as_of: str, date_col: str = "list_date") -> DataFrame:
    """A parseable list date overrides the reported day count."""
    from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

    from cohortwise.functions.text import days_since_date

    dom = F.col("days_on_market") if "days_on_market" in df.columns else F.lit(None).cast("int")
    if isinstance(df.schema[date_col].dataType, (DateType, TimestampType, TimestampNTZType)):
        derived = days_since_date(F.col(date_col).cast("date"), as_of)   # already typed: no text parsing
    else:
        derived = days_since(F.col(date_col), as_of)
    return df.withColumn("days_on_market", F.coalesce(derived, dom.cast("int")))


def with_address_key(df: DataFrame, col: str = "address") -> DataFrame:
    from cohortwise.functions.text import add_address_key
    return df if "address_key" in df.columns else add_address_key(df, col, "address_key")


def _dedupe_keys(keyed: DataFrame, order_col: str) -> list[Column]:
    """The two parts of the dedupe key; a row with a blank address key is alone in its group."""
    own = F.concat(F.lit("\u0000"), F.col(order_col).cast("string"))
    return [F.when(F.col("address_key") == "", own).otherwise(F.col("address_key")).alias("_k"), F.coalesce(F.col("price"), F.lit(0)).alias("_p")]


def dedupe(valid: DataFrame, order_col: str = "seq") -> DataFrame:
    """C3 for unique ids: keep the first row (by ``order_col``, unique) per (address key, price).

    The winners are found on a narrow frame by a hash aggregate that combines
    map-side, so a key holding a third of all rows costs no more than any
    other; then the rows are semi-joined with them. Rows with a blank key never
    match anything.
    """
    keyed = with_address_key(valid)
    narrow = keyed.select(*_dedupe_keys(keyed, order_col), F.col(order_col).alias("_o"))
    first = narrow.groupBy("_k", "_p").agg(F.min("_o").alias("_o")).select("_o")
    return keyed.join(first.hint("merge"), keyed[order_col] == first["_o"], "left_semi")


def duplicates(valid: DataFrame, kept: DataFrame, order_col: str = "seq") -> DataFrame:
    """H2: valid rows that dedupe dropped (difference on the order column, which tells rows apart even where ids repeat)."""
    return valid.join(kept.select(order_col), order_col, "left_anti")


def dedupe_exact(valid: DataFrame, id_col: str = "listing_id", order_col: str = "seq") -> DataFrame:
    """C3 when ids repeat: the greedy rule exactly.

    Greedy rule (in ``order_col`` order, which must be unique): keep a row
    unless an already *kept* row has its id, or its (address key, price);
    dropped rows block nothing. Two chained windows get this wrong (rows
    (i1,k1), (i2,k1), (i2,k2) keep rows 1 and 3).

    Works in rounds over the undecided rows, of which only id, key and order
    are carried. A row that no earlier undecided row shares its id or key
    with is kept. A row with just one such rival stays if that one does not, so
    it hangs on it; along a chain of those the decision alternates, and
    ``_chain_parity`` finds every row's distance from the chain's head with a
    number of joins that grows with the logarithm of its length. Rows that
    share an id or key with a row just kept go. The earliest undecided row is
    always decided, so the rounds end. The whole rows are joined back once.

    All joins are merges: rows of a few packed numbers have far more bytes in
    memory than in a shuffle, by whose size they would be collected and broadcast.
    """
    keyed = with_address_key(valid)
    undecided = _pinned(keyed.select(F.col(id_col).alias("_i"), *_dedupe_keys(keyed, order_col), F.col(order_col).alias("_o")))
    kept = []
    while not undecided.isEmpty():
        ranked = _pinned(_rivals(undecided))
        heads = ranked.where("_n = 0")
        chained = _chain_parity(ranked.where("_n = 1").select("_o", F.col("_rival").alias("_to")), heads.select("_o"))
        even = chained.where("_even").select("_o")
        keep = _pinned(heads.select("_i", "_k", "_p", "_o").unionByName(ranked.join(even.hint("merge"), "_o", "left_semi").select("_i", "_k", "_p", "_o")))
        kept.append(keep.select("_o"))
        undecided = _pinned(undecided.join(keep.select("_i").hint("merge"), "_i", "left_anti").join(keep.select("_k", "_p").distinct().hint("merge"), ["_k", "_p"], "left_anti"))
    if not kept:
        return keyed
    winners = kept[0]
    for more in kept[1:]:
        winners = winners.unionByName(more)
    return keyed.join(winners.hint("merge"), keyed[order_col] == winners["_o"], "left_semi")


def _rivals(rows: DataFrame) -> DataFrame:
    """``rows`` with _n, the number of earlier rows of the same id or key (2: or more), and _rival, the only one if there is one.

    The first and second of each group are found by aggregates that combine
    map-side, not by sorting a group.
    """
    def first_two(df: DataFrame, by: list[str], tag: str) -> DataFrame:
        least = df.groupBy(*by).agg(F.min("_o").alias(f"_{tag}1"))
        known = df.join(least.hint("merge"), by)
        second = known.where(F.col("_o") != F.col(f"_{tag}1")).groupBy(*by).agg(F.min("_o").alias(f"_{tag}2"))
        return known.join(second.hint("merge"), by, "left")
    both = first_two(first_two(rows, ["_i"], "i"), ["_k", "_p"], "k")

    def place(tag: str) -> Column:
        return F.when(F.col("_o") == F.col(f"_{tag}1"), 0).when(F.col("_o") == F.col(f"_{tag}2"), 1).otherwise(2)
    i, k = place("i"), place("k")
    n = F.when((i == 1) & (k == 1) & (F.col("_i1") == F.col("_k1")), 1).otherwise(F.least(i + k, F.lit(2)))
    return both.select("_i", "_k", "_p", "_o", n.alias("_n"), F.when(i == 1, F.col("_i1")).otherwise(F.col("_k1")).alias("_rival"))


def _chain_parity(links: DataFrame, heads: DataFrame) -> DataFrame:
    """(_o, _even) of the rows of ``links`` (_o, _to) whose chain ends at one of ``heads``: whether an even number of links leads there.

    Pointer doubling: each pass replaces a row's pointer by its target's, so
    the passes grow with the logarithm of the longest chain. A row that
    reaches the end takes no further part, so the end is never a join key that
    a whole chain shares.
    """
    kinds = links.select(F.col("_o").alias("_to"), F.lit(False).alias("_end")).unionByName(heads.select(F.col("_o").alias("_to"), F.lit(True).alias("_end")))
    known = links.join(kinds.hint("merge"), "_to", "left")
    # _done: the pointer's target is not in links itself; _sure: it is a head
    table = _pinned(known.select("_o", "_to", F.coalesce(F.col("_end"), F.lit(True)).alias("_done"), F.coalesce("_end", F.lit(False)).alias("_sure"), F.lit(False).alias("_even")))
    while not table.where("not _done").isEmpty():
        target = table.select(F.col("_o").alias("_to"), F.col("_to").alias("_to2"), F.col("_done").alias("_done2"), F.col("_sure").alias("_sure2"), F.col("_even").alias("_even2"))
        moved = table.where("not _done").join(target.hint("merge"), "_to").select("_o", F.col("_to2").alias("_to"), F.col("_done2").alias("_done"), F.col("_sure2").alias("_sure"),
                                                                    (F.col("_even") == F.col("_even2")).alias("_even"))
        table = _pinned(table.where("_done").unionByName(moved))
    return table.where("_sure").select("_o", "_even")


def _pinned(df: DataFrame) -> DataFrame:
    from cohortwise.session import stored

    return stored(df)
