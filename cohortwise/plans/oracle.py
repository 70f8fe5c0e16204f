"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each oracle is one SQL text over the driver's pre-registered tables: the
listing views are inlined as CTEs, followed by a brute-force rendering of
each stage (plain windows, a full distance product for radius counts), so the
oracle shares no plan shape with the Spark jobs it checks. Python ``round``
is reproduced with ``printf`` (it rounds the exact binary value half-even).
"""

from __future__ import annotations

from cohortwise.functions.text import QUADRANT_ABBREV, QUADRANTS, STREET_TYPES, UNIT_WORDS
from cohortwise.operators.enrich import CATEGORIES, WALK_WEIGHTS
from cohortwise.operators.explain import EM_DASH, MISSING_LABELS
from cohortwise.operators.score import COMPONENTS, FRESHNESS_WEIGHTS, LOCATION_WEIGHTS, VALUE_WEIGHTS
from cohortwise.sources.tables import AS_OF, VIEW_SQL


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(vals) -> str:
    return "(" + ", ".join(_q(v) for v in vals) + ")"


def _map(d: dict) -> str:
    return "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in d.items()) + "}"


def rnd(expr: str, places: int) -> str:
    return f"CAST(printf('%.{places}f', {expr}) AS DOUBLE)"


def fixed(expr: str, places: int = 0) -> str:
    return f"printf('%.{places}f', {expr})"


def grouped(expr: str, places: int = 0) -> str:
    return f"format('{{:,.{places}f}}', CAST({expr} AS DOUBLE))"


def general(expr: str) -> str:
    return (f"CASE WHEN {expr} = floor({expr}) THEN CAST(CAST(floor({expr}) AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({expr} AS VARCHAR) END")


def haversine(lat1, lon1, lat2, lon2) -> str:
    return (f"(2 * 6371.0088e0 * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) "
            f"+ cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))")


def address_key_sql(rel: str, col: str = "address") -> str:
    """Subquery adding ``address_key`` to ``rel`` (layered so each step is computed once)."""
    t = (f"trim(regexp_replace(regexp_replace(lower(coalesce({col}, '')), '[.,#]', ' ', 'g'), "
         r"'\s+', ' ', 'g'))")
    w0 = f"CASE WHEN _t = '' THEN []::VARCHAR[] ELSE string_split(_t, ' ') END"
    w1 = ("CASE WHEN len(_w0) >= 2 AND _w0[-2] IN ('s', 'n') AND _w0[-1] IN ('w', 'e') "
          "THEN list_concat(_w0[1:len(_w0) - 2], [_w0[-2] || _w0[-1]]) ELSE _w0 END")
    w2 = f"CASE WHEN len(_w1) > 2 AND _w1[1] IN {_in(UNIT_WORDS)} THEN _w1[3:] ELSE _w1 END"
    full = f"_w2[-1] IN {_in(QUADRANTS)}"
    tail = f"(CASE WHEN _w2[-1] IN {_in(list(QUADRANTS) + list(QUADRANT_ABBREV))} THEN len(_w2) - 1 ELSE len(_w2) END)"
    fin = (f"CASE WHEN len(_w2) = 0 THEN '' ELSE upper(array_to_string(list_transform(_w2, lambda x, i: "
           f"CASE WHEN {full} AND i = len(_w2) THEN {_map(QUADRANTS)}[x] "
           f"WHEN {tail} >= 2 AND i = {tail} THEN coalesce({_map(STREET_TYPES)}[x], x) ELSE x END), ' ')) END")
    return (f"(SELECT * EXCLUDE (_t, _w0, _w1, _w2), {fin} AS address_key FROM ("
            f"SELECT *, {w2} AS _w2 FROM (SELECT *, {w1} AS _w1 FROM (SELECT *, {w0} AS _w0 FROM ("
            f"SELECT *, {t} AS _t FROM {rel})))))")


def _criteria_reason() -> str:
    return f"""CASE
  WHEN price IS NOT NULL AND price < price_min THEN 'price $' || format('{{:,}}', price) || ' below minimum'
  WHEN price IS NOT NULL AND price > price_max THEN 'price $' || format('{{:,}}', price) || ' above maximum'
  WHEN beds IS NOT NULL AND beds < beds_min THEN {general('beds')} || ' beds below minimum ' || CAST(beds_min AS VARCHAR)
  WHEN baths IS NOT NULL AND baths < baths_min THEN {general('baths')} || ' baths below minimum ' || CAST(baths_min AS VARCHAR)
  WHEN days_on_market IS NOT NULL AND days_on_market > max_age_days THEN 'listed ' || CAST(days_on_market AS VARCHAR) || 'd ago, over ' || CAST(max_age_days AS VARCHAR) || 'd limit'
  WHEN _dist_raw IS NOT NULL AND _dist_raw > geo_bound_km THEN {fixed('_dist_raw', 1)} || ' km from CBD, beyond ' || {fixed('geo_bound_km', 1)} || ' km pre-filter bound'
END"""


def _walk() -> str:
    total = "0e0"
    for c, w, sat in WALK_WEIGHTS:
        total = f"({total} + {w!r}e0 * least(1e0, coalesce({c}_n, 0) / {float(sat)!r}e0))".replace("e0e0", "e0")
    anyc = "coalesce(" + ", ".join(f"{c}_n" for c in CATEGORIES) + ")"
    return f"CASE WHEN {anyc} IS NOT NULL THEN {rnd(total + ' * 100e0', 1)} END"


def _weighted(parts) -> tuple[str, str]:
    tot, used, allw = "0e0", "0e0", 0.0
    for name, w in parts:
        tot = f"({tot} + CASE WHEN p_{name} IS NOT NULL THEN p_{name} * {w!r} ELSE 0e0 END)"
        used = f"({used} + CASE WHEN p_{name} IS NOT NULL THEN {w!r} ELSE 0e0 END)"
        allw += w
    return (f"CASE WHEN {used} > 0 THEN {tot} / {used} END",
            f"CASE WHEN {used} > 0 THEN {used} / {allw!r} ELSE 0e0 END")


def _dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def _pct(c: str) -> str:
    v = f"c_{c}"
    n = f"count({v}) OVER (PARTITION BY search_id)"
    less = f"(rank() OVER (PARTITION BY search_id, {v} IS NULL ORDER BY {v}) - 1)"
    ties = f"count(*) OVER (PARTITION BY search_id, {v})"
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN {n} = 1 THEN 50e0 ELSE "
            f"{rnd(f'((({less} + {less} + {ties} - 1) / 2e0) / ({n} - 1)) * 100e0', 2)} END AS r_{c}")


def _chain() -> list[tuple[str, str]]:
    """The pipeline as ordered CTEs."""
    as_of = f"DATE '{AS_OF}'"
    cats = ", ".join(f"CASE WHEN a.has_{c} THEN CAST(coalesce(h.n_{c}, 0) AS INTEGER) END AS {c}_n" for c in CATEGORIES)
    has = ", ".join(f"bool_or(category = {_q(c)}) AS has_{c}" for c in CATEGORIES)
    hn = ", ".join(f"max(CASE WHEN category = {_q(c)} THEN n END) AS n_{c}" for c in CATEGORIES)
    v, v_cov = _weighted(VALUE_WEIGHTS)
    l, l_cov = _weighted(LOCATION_WEIGHTS)
    f, f_cov = _weighted(FRESHNESS_WEIGHTS)
    orient = ", ".join(
        (f"{rnd(f'100e0 - r_{c}', 2)} AS p_{c}" if inv else f"r_{c} AS p_{c}") for c, inv in COMPONENTS)
    wsum = "(w_value + w_location + w_freshness)"
    wv, wl, wf = (f"CASE WHEN {wsum} <= 0 THEN 1e0 / 3 ELSE {w} / {wsum} END" for w in ("w_value", "w_location", "w_freshness"))
    num = (f"((0e0 + CASE WHEN _sv IS NOT NULL THEN _sv * ({wv}) ELSE 0e0 END) + CASE WHEN _sl IS NOT NULL THEN _sl * ({wl}) ELSE 0e0 END)"
           f" + CASE WHEN _sf IS NOT NULL THEN _sf * ({wf}) ELSE 0e0 END")
    den = (f"((0e0 + CASE WHEN _sv IS NOT NULL THEN {wv} ELSE 0e0 END) + CASE WHEN _sl IS NOT NULL THEN {wl} ELSE 0e0 END)"
           f" + CASE WHEN _sf IS NOT NULL THEN {wf} ELSE 0e0 END")
    missing = "list_filter([" + ", ".join(f"CASE WHEN p_{c} IS NULL THEN {_q(c)} END" for c, _ in COMPONENTS) + "], lambda x: x IS NOT NULL)"
    amen_tot = "(" + " + ".join(["0e0"] + [f"coalesce({c}_n, 0)" for c in CATEGORIES]) + ")"
    anyc = "coalesce(" + ", ".join(f"{c}_n" for c in CATEGORIES) + ")"
    return [
        *[(name, text) for name, text in VIEW_SQL.items()],
        ("lst", "SELECT *, listing_id AS seq FROM v_listing"),
        ("val", """SELECT *, CASE
  WHEN price IS NULL OR price <= 0 THEN 'missing or zero price'
  WHEN lat IS NULL OR lon IS NULL THEN 'missing coordinates'
  WHEN NOT (lat BETWEEN -90 AND 90) OR NOT (lon BETWEEN -180 AND 180) THEN 'coordinates out of range'
  WHEN sqft IS NOT NULL AND NOT (sqft BETWEEN 200 AND 20000) THEN 'implausible sqft (' || CAST(sqft AS VARCHAR) || ')'
  WHEN address IS NULL OR trim(address) = '' THEN 'missing address' END AS invalid_reason FROM lst"""),
        ("valid", f"SELECT *, CAST(CASE WHEN date_diff('day', list_date, {as_of}) < 0 THEN 0 ELSE date_diff('day', list_date, {as_of}) END AS INTEGER) AS days_on_market FROM val WHERE invalid_reason IS NULL"),
        ("keyed", f"SELECT * FROM {address_key_sql('valid')}"),
        ("kept", "SELECT * FROM keyed QUALIFY address_key = '' OR row_number() OVER (PARTITION BY address_key, coalesce(price, 0) ORDER BY seq) = 1"),
        ("dups", "SELECT * FROM keyed WHERE listing_id NOT IN (SELECT listing_id FROM kept)"),
        ("srch", "SELECT *, max_commute_min / 60e0 * CASE WHEN commute_mode = 'driving' THEN 80e0 ELSE 40e0 END AS geo_bound_km FROM v_search"),
        ("rep0", f"SELECT k.*, s.*, CASE WHEN k.lat IS NOT NULL AND k.lon IS NOT NULL THEN {haversine('k.lat', 'k.lon', 's.anchor_lat', 's.anchor_lon')} END AS _dist_raw FROM kept k CROSS JOIN srch s WHERE s.search_id % 20 = 0"),
        ("rep", f"SELECT *, {_criteria_reason()} AS criteria_reason, {rnd('_dist_raw', 3)} AS distance_km FROM rep0"),
        ("scr0", f"SELECT k.*, s.*, CASE WHEN k.lat IS NOT NULL AND k.lon IS NOT NULL THEN {haversine('k.lat', 'k.lon', 's.anchor_lat', 's.anchor_lon')} END AS _dist_raw FROM kept k JOIN srch s ON k.price BETWEEN s.price_min AND s.price_max AND k.beds >= s.beds_min AND k.baths >= s.baths_min AND k.days_on_market <= s.max_age_days AND abs(k.lat - s.anchor_lat) <= s.geo_bound_km / 100e0"),
        ("passed", f"SELECT *, {rnd('_dist_raw', 3)} AS distance_km FROM scr0 WHERE ({_criteria_reason()}) IS NULL"),
        ("par", f"SELECT p.*, v.assessed_value, CASE WHEN p.price IS NOT NULL AND p.price <> 0 AND v.assessed_value > 0 THEN {rnd('p.price / v.assessed_value', 4)} END AS assessment_ratio FROM passed p LEFT JOIN v_parcel v ON v.address_key = p.address_key AND p.address_key <> ''"),
        ("pts", "SELECT DISTINCT lat, lon FROM passed WHERE lat IS NOT NULL AND lon IS NOT NULL"),
        ("hits", f"SELECT q.lat, q.lon, p.category, count(*) AS n FROM pts q JOIN v_poi p ON abs(q.lat - p.lat) < 1e-2 AND {haversine('q.lat', 'q.lon', 'p.lat', 'p.lon')} <= 1e0 GROUP BY ALL"),
        ("hitw", f"SELECT lat, lon, {hn} FROM hits GROUP BY lat, lon"),
        ("avail", f"SELECT {has} FROM v_poi"),
        ("rad", f"SELECT par.*, {cats} FROM par CROSS JOIN avail a LEFT JOIN hitw h ON h.lat = par.lat AND h.lon = par.lon"),
        ("walk", f"SELECT *, {_walk()} AS walk_proxy FROM rad"),
        ("rt", f"SELECT w.*, {rnd('r.seconds / 60e0', 1)} AS route_min FROM walk w LEFT JOIN v_route r ON w.commute_mode = 'driving' AND r.mode = w.commute_mode AND r.geo_y = CAST(floor(w.lat * 1000 + 5e-1) AS BIGINT) AND r.geo_x = CAST(floor(w.lon * 1000 + 5e-1) AS BIGINT) AND r.anchor_lat = w.anchor_lat AND r.anchor_lon = w.anchor_lon"),
        ("enr0", f"SELECT * EXCLUDE (route_min), coalesce(route_min, {rnd(haversine('lat', 'lon', 'anchor_lat', 'anchor_lon') + ' * 1.3e0 / CASE WHEN commute_mode = ' + _q('transit') + ' THEN 42e0 * 0.55e0 ELSE 42e0 END * 60e0', 1)}) AS commute_min, route_min IS NULL AS commute_estimated FROM rt"),
        ("enr", f"SELECT *, CASE WHEN commute_min > max_commute_min THEN {fixed('commute_min', 0)} || ' min commute exceeds ' || CAST(max_commute_min AS VARCHAR) || ' min limit' END AS commute_reason FROM enr0"),
        ("ana", "SELECT * FROM enr WHERE commute_reason IS NULL"),
        ("comp", f"SELECT *, CASE WHEN price IS NOT NULL AND price <> 0 AND sqft > 0 THEN {_dbl('price')} / {_dbl('sqft')} END AS c_price_per_sqft, assessment_ratio AS c_assessment_ratio, commute_min AS c_commute_min, walk_proxy AS c_walk_proxy, CASE WHEN {anyc} IS NOT NULL THEN {amen_tot} END AS c_amenities, {_dbl('days_on_market')} AS c_days_on_market FROM ana"),
        ("pr", "SELECT *, " + ", ".join(_pct(c) for c, _ in COMPONENTS) + " FROM comp"),
        ("po", f"SELECT *, {orient} FROM pr"),
        ("sub", f"SELECT *, {v} AS _sv, {l} AS _sl, {f} AS _sf, {rnd(f'({v_cov} + {l_cov} + {f_cov}) / 3e0 * 100', 1)} AS data_completeness, {missing} AS missing FROM po"),
        ("scored", f"SELECT * EXCLUDE (_sv, _sl, _sf), {rnd('_sv', 2)} AS score_value, {rnd('_sl', 2)} AS score_location, {rnd('_sf', 2)} AS score_freshness, CASE WHEN {den} > 0 THEN {rnd(f'({num}) / ({den})', 2)} ELSE 0e0 END AS score_total FROM sub"),
        ("ranked", "SELECT *, CAST(row_number() OVER (PARTITION BY search_id ORDER BY score_total DESC, seq) AS INTEGER) AS rank, CAST(count(*) OVER (PARTITION BY search_id) AS INTEGER) AS cohort_size FROM scored"),
    ]


def with_chain(select: str) -> str:
    ctes = ",\n".join(f"{name} AS (\n{text}\n)" for name, text in _chain())
    return f"WITH {ctes}\n{select}"


def _amenity_bits(pairs, as_double: bool) -> str:
    bits = []
    for label, col in pairs:
        n = f"CAST({col} AS DOUBLE)" if as_double else f"coalesce({col}, 0)"
        shown = fixed(n, 0) if as_double else f"CAST({n} AS VARCHAR)"
        bits.append(f"CASE WHEN {n} IS NOT NULL AND {n} <> 0 THEN {shown} || ' {label}' || "
                    f"CASE WHEN {n} <> 1 THEN 's' ELSE '' END END")
    return "list_filter([" + ", ".join(bits) + "], lambda x: x IS NOT NULL)"


def amenity_phrase_sql() -> str:
    arr = _amenity_bits((("school", "schools_n"), ("cafe", "cafes_n"), ("park", "parks_n"),
                         ("grocer", "groceries_n")), False)
    anyc = "coalesce(" + ", ".join(f"{c}_n" for c in CATEGORIES) + ")"
    return (f"CASE WHEN {anyc} IS NULL THEN 'no amenity data' WHEN len({arr}) = 0 THEN 'no amenities within 1 km' "
            f"ELSE array_to_string(({arr})[1:3], ', ') || ' within 1 km' END")


def explanation_sql() -> str:
    d = EM_DASH
    ppsf = ("CASE WHEN price IS NOT NULL AND price <> 0 AND sqft IS NOT NULL AND sqft <> 0 AND sqft > 0 "
            "THEN CAST(price AS DOUBLE) / CAST(sqft AS DOUBLE) END")
    b1 = (f"CASE WHEN ({ppsf}) IS NOT NULL AND p_price_per_sqft IS NOT NULL THEN '$' || {grouped(ppsf)} || "
          f"'/sqft, cheaper than ' || {fixed('p_price_per_sqft')} || '% of matches' END")
    delta = "((assessment_ratio - 1e0) * 100)"
    b2 = (f"CASE WHEN assessment_ratio IS NULL THEN NULL WHEN {delta} <= -1 THEN 'listed ' || {fixed(f'abs({delta})')} "
          f"|| '% below City assessed value' WHEN {delta} >= 1 THEN 'listed ' || {fixed(delta)} || "
          f"'% above City assessed value' ELSE 'listed essentially at City assessed value' END")
    vb = f"list_filter([{b1}, {b2}], lambda x: x IS NOT NULL)"
    value = (f"CASE WHEN score_value IS NULL THEN NULL WHEN len({vb}) = 0 THEN 'Value ' || {fixed('score_value')} || '.' "
             f"ELSE 'Value ' || {fixed('score_value')} || ' {d} ' || array_to_string({vb}, ', and ') || '.' END")
    am = _amenity_bits((("school", "schools_n"), ("cafe", "cafes_n"), ("park", "parks_n")), True)
    amen = f"CASE WHEN len({am}) > 0 THEN array_to_string({am}, ', ') || ' within 1 km' END"
    l1 = (f"CASE WHEN commute_min IS NOT NULL THEN {fixed('commute_min')} || ' min to downtown' || "
          f"CASE WHEN coalesce(commute_estimated, false) THEN ' (estimated)' ELSE '' END END")
    l3 = f"CASE WHEN walk_proxy IS NOT NULL THEN 'walk proxy ' || {fixed('walk_proxy')} || '/100' END"
    lb = f"list_filter([{l1}, {amen}, {l3}], lambda x: x IS NOT NULL)"
    loc = (f"CASE WHEN score_location IS NULL THEN NULL WHEN len({lb}) = 0 THEN 'Location ' || {fixed('score_location')} || '.' "
           f"ELSE 'Location ' || {fixed('score_location')} || ' {d} ' || array_to_string({lb}, ', ') || '.' END")
    dd = "CAST(days_on_market AS DOUBLE)"
    fh = f"'Freshness ' || {fixed('score_freshness')}"
    fresh = (f"CASE WHEN score_freshness IS NULL THEN NULL WHEN {dd} IS NULL THEN {fh} || '.' "
             f"WHEN {dd} <= 0 THEN {fh} || ' {d} listed today.' WHEN {dd} = 1 THEN {fh} || ' {d} listed yesterday.' "
             f"ELSE {fh} || ' {d} listed ' || {fixed(dd)} || ' days ago.' END")
    labels = "list_transform(missing, lambda m: coalesce(" + _map(dict(MISSING_LABELS)) + "[m], m))"
    gaps = (f"CASE WHEN len(missing) > 0 THEN 'Scored on ' || {fixed('data_completeness')} || "
            f"'% of available signals {d} ' || array_to_string({labels}, '; ') || '.' END")
    header = (f"'Ranked #' || CAST(rank AS VARCHAR) || ' of ' || CAST(cohort_size AS VARCHAR) || ' matches, scoring ' "
              f"|| {fixed('score_total')} || '/100.'")
    return f"concat_ws(' ', {header}, {value}, {loc}, {fresh}, {gaps})"


def report_sql() -> str:
    dash = EM_DASH

    def num(c):
        return f"CASE WHEN {c} IS NULL THEN '{dash}' ELSE {grouped(c)} END"
    ppsf = ("CASE WHEN price IS NOT NULL AND price <> 0 AND sqft IS NOT NULL AND sqft <> 0 "
            f"THEN '$' || {grouped('CAST(price AS DOUBLE) / CAST(sqft AS DOUBLE)')} ELSE '{dash}' END")
    commute = (f"CASE WHEN commute_min IS NULL THEN '{dash}' ELSE CASE WHEN coalesce(commute_estimated, false) "
               f"THEN '~' ELSE '' END || {fixed('commute_min')} || ' min' END")
    addr = "coalesce(address, '')"
    return (f"search_id, rank, listing_id, CASE WHEN length({addr}) <= 30 THEN {addr} ELSE substr({addr}, 1, 29) || '…' END AS address_display, "
            f"CASE WHEN price IS NULL THEN '{dash}' ELSE '$' || {grouped('price')} END AS price_display, "
            f"{num('beds')} || '/' || {num('baths')} AS bed_bath, {num('sqft')} AS sqft_display, {ppsf} AS ppsf_display, "
            f"{commute} AS commute_display, {num('score_total')} AS score_display, "
            f"{num('score_value')} || '/' || {num('score_location')} || '/' || {num('score_freshness')} AS vlf_display, "
            f"{num('data_completeness')} || '%' AS data_display")
