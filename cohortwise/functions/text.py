"""Bulk text normalisation: addresses, prices, rooms, areas, ages, dates, URLs.

Each helper is a Catalyst expression, so a whole listing table is normalised
inside one codegen'd projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for right results).
# Street-type words and their parcel-index abbreviations, in natural order.
STREET_TYPES: dict[str, str] = {
    "avenue": "av", "ave": "av",
    "bay": "ba",
    "boulevard": "bv", "blvd": "bv",
    "cape": "ca",
    "circle": "ci",
    "close": "cl",
    "common": "cm", "commons": "cm",
    "court": "co", "crt": "co", "ct": "co",
    "cove": "cv",
    "crescent": "cr", "cres": "cr",
    "drive": "dr",
    "gardens": "gd", "garden": "gd",
    "gate": "ga",
    "green": "gr",
    "grove": "gv",
    "heath": "he",
    "heights": "ht",
    "hill": "hl",
    "island": "is",
    "landing": "ld",
    "lane": "ln",
    "link": "li",
    "manor": "mr",
    "mews": "me",
    "mount": "mt",
    "parade": "pa",
    "park": "pk",
    "place": "pl",
    "point": "pt",
    "rise": "ri",
    "road": "rd",
    "square": "sq",
    "street": "st",
    "terrace": "tc",
    "trail": "tr",
    "view": "vw",
    "villas": "vi", "villa": "vi",
    "way": "wy",
}
QUADRANTS: dict[str, str] = {"southwest": "sw", "northwest": "nw", "southeast": "se", "northeast": "ne"}
QUADRANT_ABBREV = ("sw", "nw", "se", "ne")
UNIT_WORDS = ("unit", "apt", "suite", "ste")
PROVINCE_ABBREV = ("ab", "bc", "mb", "nb", "nl", "ns", "nt", "nu", "on", "pe", "qc", "sk", "yt")
# Age units in days.
AGE_UNITS: dict[str, float] = {"hour": 1 / 24, "day": 1.0, "week": 7.0, "month": 30.44, "year": 365.25}
SQFT_PER_ACRE = 43_560.0
SQFT_PER_M2 = 10.7639
POSTAL_PATTERN = r"[A-Z]\d[A-Z]\s*\d[A-Z]\d"
AGE_PATTERN = r"(?i)(\d+)\s*(hour|day|week|month|year)"
MESSAGE_PRICE_PATTERN = r"\$\s?([\d,]{6,12})"
MESSAGE_ROOM_PATTERNS = {"beds": r"(?i)(\d+(?:\s*\+\s*\d+)?)\s*(?:bed|bdrm|bedroom|chambre)",
                         "baths": r"(?i)(\d+(?:\.\d+)?)\s*(?:bath|bthrm|bathroom|salle)"}
MESSAGE_AREA_PATTERN = r"(?i)([\d,]{3,7})\s*(?:sq\.?\s?ft|sqft|square feet|pi\.?\s?ca)"
MLS_PATTERN = r"(?i)MLS[®\s#:]*([A-Z]?\d{6,9})"
# ---------------------------------------------------------------------------


# Ages beyond this many days name no date.
MAX_AGE_DAYS = 700_000


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in d.items() for v in kv])


def expansions() -> dict[str, str]:
    """Abbreviation -> its longest spelling in STREET_TYPES (first one on a tie)."""
    spellings: dict[str, list[str]] = {}
    for word, abbrev in STREET_TYPES.items():
        spellings.setdefault(abbrev, []).append(word)
    return {abbrev: max(words, key=len) for abbrev, words in spellings.items()}


# Regex class of exactly the characters Python's str.isspace() accepts (so
# split()/strip() agree with the reference): Java's \s, the Unicode separator
# category, and four control characters. A category test is far cheaper than
# listing the characters or using translate(). tests/test_text.py checks the
# equivalence over the whole BMP.
WS = r"\s\p{Z}\x1c-\x1f\x85"


def strip(text: Column) -> Column:
    """``str.strip()``: trim all whitespace at both ends."""
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def is_blank(text: Column) -> Column:
    return F.regexp_like(text, F.lit(f"^[{WS}]*$"))


def _squeeze(text: Column) -> Column:
    """``" ".join(text.split())``."""
    return F.btrim(F.regexp_replace(text, f"[{WS}]+", " "), F.lit(" "))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda binding), so a
    value used several times is not copied into the expression tree."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _alt(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def _key_text(address) -> Column:
    """Lower-case, '.', ',' and '#' to spaces, whitespace squeezed -- one regex pass."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(_c(address), F.lit(""))), f"[.,#{WS}]+", " "), F.lit(" "))


def address_key(address) -> Column:
    """Canonical key for the exact parcel join and for dedupe.

    Written as string and regex steps only (no array lambdas), so it stays in
    whole-stage codegen: lower-case, punctuation to spaces, squeeze; rejoin a
    split 's w' quadrant; drop a leading unit designator and its number when
    more words follow; abbreviate a spelled-out final quadrant; abbreviate
    only the street-type word (the one before the quadrant, else the last,
    never the first); upper-case.
    """
    t = _key_text(address)
    t = F.regexp_replace(t, r"(^| )([sn]) ([we])$", "$1$2$3")
    t = F.regexp_replace(t, rf"^(?:{_alt(UNIT_WORDS)}) [^ ]+ ", "")
    t = F.regexp_replace(t, rf"(^| )({_alt(QUADRANTS)})$", "$1#$2")
    for full, ab in QUADRANTS.items():
        t = F.regexp_replace(t, f"#{full}$", ab)
    quad = _alt(QUADRANT_ABBREV)
    pat = rf" ({_alt(STREET_TYPES)})((?: (?:{quad}))?)$"
    word = F.regexp_extract(t, pat, 1)
    whole = F.regexp_extract(t, pat, 0)
    abbreviated = F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(whole)), F.lit(" "),
                           F.element_at(_map(STREET_TYPES), word), F.regexp_extract(t, pat, 2))
    return F.upper(F.when(word == "", t).otherwise(abbreviated))


def _words(c: Column) -> Column:
    return F.when(c == "", F.lit(0)).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def add_address_key(df, src: str = "address", dst: str = "address_key"):
    """B11 as a DataFrame transform: same rule as ``address_key``, but each step is
    its own column (computed once) and uses token slicing and literal-map lookups
    instead of regex passes -- about 3x cheaper on the dedupe and join hot path."""
    qmap, smap = _map(QUADRANTS), _map(STREET_TYPES)
    df = df.withColumn("_ak0", _key_text(F.col(src)))
    a0 = F.col("_ak0")
    tail2 = F.substring_index(a0, " ", -2)
    df = df.withColumn("_ak1", F.when(tail2.isin("s w", "s e", "n w", "n e"),
                                      F.concat(F.substring(a0, F.lit(1), F.length(a0) - 3),
                                               F.translate(tail2, " ", ""))).otherwise(a0))
    a1 = F.col("_ak1")
    head2 = F.substring_index(a1, " ", 2)
    df = df.withColumn("_ak2", F.when(F.substring_index(a1, " ", 1).isin(*UNIT_WORDS) & (F.length(head2) < F.length(a1)),
                                      F.substring(a1, F.length(head2) + 2, 1 << 30)).otherwise(a1))
    a2 = F.col("_ak2")
    last2 = F.substring_index(a2, " ", -1)
    q = F.try_element_at(qmap, last2)
    df = df.withColumn("_ak3", F.when(q.isNotNull(), F.concat(F.substring(a2, F.lit(1), F.length(a2) - F.length(last2)), q))
                       .otherwise(a2))
    a3 = F.col("_ak3")
    last3 = F.substring_index(a3, " ", -1)
    is_quad = last3.isin(*QUADRANT_ABBREV)
    tok = F.when(is_quad, F.substring_index(F.substring_index(a3, " ", -2), " ", 1)).otherwise(last3)
    suffix = F.when(is_quad, F.concat(F.lit(" "), last3)).otherwise(F.lit(""))
    ok = F.when(is_quad, _words(a3) >= 3).otherwise(_words(a3) >= 2)
    df = df.withColumn("_ak4", tok).withColumn("_ak5", suffix).withColumn("_ak6", F.try_element_at(smap, F.col("_ak4")))
    out = F.when(ok & F.col("_ak6").isNotNull(),
                 F.concat(F.substring(a3, F.lit(1), F.length(a3) - F.length("_ak4") - F.length("_ak5")),
                          F.col("_ak6"), F.col("_ak5"))).otherwise(a3)
    return df.withColumn(dst, F.upper(out)).drop("_ak0", "_ak1", "_ak2", "_ak3", "_ak4", "_ak5", "_ak6")


def expand_street_type(address) -> Column:
    """B12 helper: expand the abbreviated street type (same position rule as B11)."""
    a = _c(address)
    words = F.split(_squeeze(a), " ")
    n = F.size(words)
    tail = F.when(F.lower(F.element_at(words, -1)).isin(*QUADRANT_ABBREV), n - 2).otherwise(n - 1)
    emap = _map(expansions())
    out = F.transform(words, lambda x, i: F.when((tail >= 1) & (i == tail),
                                                 F.coalesce(F.initcap(F.try_element_at(emap, F.lower(x))), x))
                      .otherwise(x))
    return F.when((a.isNull()) | (n < 2), a).otherwise(F.array_join(out, " "))


def geocode_candidates(address, locality) -> Column:
    """Ordered, distinct geocoder queries for one address."""
    loc = F.coalesce(_c(locality), F.lit(""))
    return F.array_distinct(F.array(F.concat_ws(", ", expand_street_type(address), loc),
                                    F.concat_ws(", ", _c(address), loc)))


def slug_address(slug, area: str = "") -> Column:
    """B9: '123-main-st-sw-city-ab' -> '123 Main St SW' (trailing place words dropped)."""
    import re

    drop = {"canada", *PROVINCE_ABBREV} | {w.lower() for w in re.split(r"[\s,]+", area) if w}
    parts = F.filter(F.split(F.coalesce(_c(slug), F.lit("")), "-"), lambda p: p != "")
    drop_arr = F.array(*[F.lit(w) for w in sorted(drop)])
    run = F.aggregate(F.reverse(parts), F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")),
                      lambda acc, x: F.struct(
                          F.when(acc["on"] & F.array_contains(drop_arr, F.lower(x)), acc["k"] + 1)
                          .otherwise(acc["k"]).alias("k"),
                          (acc["on"] & F.array_contains(drop_arr, F.lower(x))).alias("on")))
    kept = F.slice(parts, 1, F.size(parts) - run["k"])
    quads = [q.upper() for q in QUADRANT_ABBREV]
    words = F.transform(kept, lambda p: F.when(F.upper(p).isin(*quads), F.upper(p))
                        .otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))))
    return F.array_join(words, " ")


def parse_price(text) -> Column:
    """B1 (portal form): keep digits and dots, parse, truncate."""
    cleaned = F.regexp_replace(_c(text).cast("string"), r"[^0-9.]", "")
    return F.when(cleaned == "", F.lit(None).cast("bigint")).otherwise(
        cleaned.try_cast("double").try_cast("bigint"))


def message_price(window) -> Column:
    """B1 (message form): '$' then 6-12 digits/commas; zero means unknown."""
    g = F.regexp_extract(_c(window), MESSAGE_PRICE_PATTERN, 1)
    v = F.regexp_replace(g, ",", "").try_cast("bigint")
    return F.when((g == "") | (v == 0), F.lit(None).cast("bigint")).otherwise(v)


def sum_numbers(text) -> Column:
    """Sum of every number in the text ('3 + 1' -> 4.0); null when none."""
    nums = F.regexp_extract_all(F.coalesce(_c(text).cast("string"), F.lit("")), F.lit(r"\d+(?:\.\d+)?"), 0)
    return F.when(F.size(nums) == 0, F.lit(None).cast("double")).otherwise(
        F.aggregate(nums, F.lit(0.0), lambda acc, x: acc + x.cast("double")))


parse_rooms = sum_numbers


def message_rooms(window, kind: str) -> Column:
    """B2 (message form): numbers inside the matched beds/baths group only."""
    g = F.regexp_extract(_c(window), MESSAGE_ROOM_PATTERNS[kind], 1)
    return F.when(g == "", F.lit(None).cast("double")).otherwise(sum_numbers(g))


def parse_area(text) -> Column:
    """First number; acres and square metres converted; truncated to sqft."""
    t = _c(text).cast("string")
    g = F.regexp_extract(F.coalesce(t, F.lit("")), r"([\d,]+(?:\.\d+)?)", 1)
    num = F.regexp_replace(g, ",", "").try_cast("double")
    low = F.lower(t)
    scaled = (F.when(low.contains("acre"), num * SQFT_PER_ACRE)
              .when(low.contains("m2") | low.contains("sqm"), num * SQFT_PER_M2)
              .otherwise(num))
    return F.when(scaled > 0, scaled.try_cast("bigint")).otherwise(F.lit(None).cast("bigint"))


def message_sqft(window) -> Column:
    g = F.regexp_extract(_c(window), MESSAGE_AREA_PATTERN, 1)
    v = F.regexp_replace(g, ",", "").try_cast("bigint")
    return F.when((g == "") | (v == 0), F.lit(None).cast("bigint")).otherwise(v)


def parse_age(text) -> Column:
    """B4: 'N unit' -> whole days (half-even); a bare number is truncated."""
    t = strip(_c(text).cast("string"))
    m = F.regexp_extract(t, AGE_PATTERN, 0)
    count = F.regexp_extract(t, AGE_PATTERN, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(t, AGE_PATTERN, 2))
    factor = F.try_element_at(F.create_map(*[F.lit(v) for kv in AGE_UNITS.items() for v in kv]), unit)
    numeric = t.rlike(r"^-?\d+(\.\d+)?$")
    return (F.when(numeric, t.try_cast("double").try_cast("int"))
            .when(m != "", F.bround(count * factor, 0).try_cast("int"))
            .otherwise(F.lit(None).cast("int")))


_ISO = (r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?"
        r"(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$")


def iso_date(text) -> Column:
    """ISO date or timestamp (own calendar date, no zone shift); 'YYYYMMDD' too."""
    t = strip(_c(text).cast("string"))
    return (F.when(t.rlike(_ISO), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
            .when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd")))


def parse_date(text) -> Column:
    """B6 parser: ISO first, then y-m-d, m/d/Y and d/m/Y on the first ten characters."""
    t = strip(_c(text).cast("string"))
    head = F.substring(t, 1, 10)
    return F.coalesce(iso_date(t),
                      F.try_to_date(head, "yyyy-M-d"),
                      F.try_to_date(head, "M/d/yyyy"),
                      F.try_to_date(head, "d/M/yyyy"))


def days_since(date_or_text, as_of: str) -> Column:
    """Whole days from the date (or date text) to ``as_of``, floored at 0; null if unparseable."""
    return days_since_date(parse_date(_c(date_or_text).cast("string")), as_of)


def days_since_date(d, as_of: str) -> Column:
    delta = F.datediff(F.lit(as_of).cast("date"), _c(d))
    return F.when(delta < 0, F.lit(0)).otherwise(delta)


def list_date(fields: list, age_text, as_of: str) -> Column:
    """First field that parses (epoch digits, ISO), else as_of minus the age."""
    picks = []
    for f in fields:
        t = strip(_c(f).cast("string"))
        epoch = F.when(t.rlike(r"^\d{10,}$"),
                       F.to_date(F.timestamp_seconds(F.substring(t, 1, 10).cast("bigint"))))
        picks.append(F.when(t.isNotNull() & (t != ""), F.coalesce(epoch, iso_date(t))))
    # an age before the first year gives no date
    age = parse_age(age_text)
    fallback = F.date_sub(F.lit(as_of).cast("date"), F.when(F.abs(age) <= MAX_AGE_DAYS, age))
    return F.coalesce(*picks, fallback)


def split_address(text) -> Column:
    """struct(street, city, postal) from 'street, city, province postal|extra'."""
    first = F.split_part(F.coalesce(_c(text), F.lit("")), F.lit("|"), F.lit(1))
    parts = F.filter(F.transform(F.split(first, ","), lambda p: strip(p)),
                     lambda p: p != "")
    n = F.size(parts)
    postal = F.when(n > 2, F.regexp_extract(F.upper(F.element_at(parts, -1)), POSTAL_PATTERN, 0)).otherwise(F.lit(""))
    return F.struct(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")).alias("street"),
                    F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("city"),
                    postal.alias("postal_code"))


def abs_url(relative, base: str | Column) -> Column:
    """Prefix the base (a text, or a column) unless already absolute; blank stays blank."""
    r = strip(F.coalesce(_c(relative), F.lit("")))
    base = base if isinstance(base, Column) else F.lit(base)
    return (F.when(r == "", F.lit(""))
            .when(r.startswith("http"), r)
            .when(r.startswith("/"), F.concat(base, r))
            .otherwise(F.concat(base, F.lit("/"), r)))


def mls_id(window, link_id) -> Column:
    """MLS number in the window (upper-cased), else a prefixed link id."""
    g = F.regexp_extract(_c(window), MLS_PATTERN, 1)
    return F.when(g != "", F.upper(g)).otherwise(F.concat(F.lit("RCA"), _c(link_id)))
