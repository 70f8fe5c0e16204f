"""What a missing signal does to a listing's scores, and which way each signal points."""

import pytest

from cohortwise.operators.score import COMPONENTS, score_cohorts

# Nine listings of one cohort: the k-th is the k-th best in every signal.
SIGNALS = {"price": lambda k: 200_000 + 25_000 * k, "sqft": lambda k: 1_000, "assessment_ratio": lambda k: 0.8 + 0.05 * k,
           "commute_min": lambda k: 6.0 + 3 * k, "walk_proxy": lambda k: 90.0 - 8 * k, "cafes_n": lambda k: 20 - k, "days_on_market": lambda k: 2 + 5 * k}
TYPES = {"price": "long", "sqft": "long", "assessment_ratio": "double", "commute_min": "double", "walk_proxy": "double", "cafes_n": "int", "days_on_market": "int"}
OTHER = ("schools_n", "parks_n", "groceries_n", "transit_n")


def scored(spark, change=(), weights=(1.0, 1.0, 1.0), n=9):
    """change: (listing, signal, value) to put in."""
    rows = [{**{s: f(k) for s, f in SIGNALS.items()}, "listing_id": k} for k in range(n)]
    for k, signal, value in change:
        rows[k][signal] = value
    names = [*SIGNALS, "listing_id"]
    schema = ", ".join(f"{c} {TYPES.get(c, 'int')}" for c in names)
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)
    df = df.selectExpr("1 as search_id", "*", *[f"0 as {c}" for c in OTHER], *[f"{w}D as {c}" for c, w in zip(("w_value", "w_location", "w_freshness"), weights)])
    return {r.listing_id: r for r in score_cohorts(df, ["search_id"]).collect()}


def test_better_in_everything_scores_higher(spark):
    got = scored(spark)
    totals = [got[k].score_total for k in range(9)]
    assert totals == sorted(totals, reverse=True) and totals[0] == 100.0 and totals[-1] == 0.0
    assert all(r.data_completeness == 100.0 and not list(r.missing) for r in got.values())


@pytest.mark.parametrize("signal,score", [("price", "score_value"), ("assessment_ratio", "score_value"), ("commute_min", "score_location"),
                                          ("walk_proxy", "score_location"), ("cafes_n", "score_location"), ("days_on_market", "score_freshness")])
def test_each_signal_moves_its_score_alone(spark, signal, score):
    """The worst listing is given the best value of one signal: only the score it belongs to rises."""
    before, after = scored(spark)[8], scored(spark, [(8, signal, SIGNALS[signal](-1))])[8]
    for s in ("score_value", "score_location", "score_freshness"):
        assert (after[s] > before[s]) == (s == score) and (s == score or after[s] == before[s])


@pytest.mark.parametrize("signal,name", [("sqft", "price_per_sqft"), ("assessment_ratio", "assessment_ratio"), ("commute_min", "commute_min"),
                                         ("walk_proxy", "walk_proxy"), ("days_on_market", "days_on_market")])
def test_an_unknown_signal_is_named_and_reweighted(spark, signal, name):
    """The middle listing does not know one signal: its scores come from the others, which all say 50."""
    r = scored(spark, [(4, signal, None)])[4]
    assert list(r.missing) == [name] and r.data_completeness < 100.0 and r[f"p_{name}"] is None
    for s in (r.score_value, r.score_location, r.score_freshness):
        assert s == 50.0 or (s is None and name == "days_on_market")
    assert r.score_total == 50.0


def test_no_signal_of_a_kind(spark):
    r = scored(spark, [(0, "sqft", None), (0, "assessment_ratio", None)])[0]
    assert r.score_value is None and r.score_total == 100.0      # from location and freshness
    alone = scored(spark, [(0, s, None) for s in SIGNALS])[0]
    assert alone.score_value is None and alone.score_freshness is None and len(alone.missing) >= len(COMPONENTS) - 1


@pytest.mark.parametrize("weights,first", [((9.0, 1.0, 1.0), 0), ((1.0, 9.0, 1.0), 1), ((1.0, 1.0, 9.0), 2)])
def test_weights_choose_the_first(spark, weights, first):
    """Three listings, each the best of one kind and the worst of the others."""
    best, worst = 0, 2
    change = []
    for k, signals in enumerate((("price", "assessment_ratio"), ("commute_min", "walk_proxy", "cafes_n"), ("days_on_market",))):
        for other in range(3):
            change += [(other, s, SIGNALS[s](best if other == k else worst)) for s in signals]
    got = scored(spark, change, weights, n=3)
    assert max(got.values(), key=lambda r: r.score_total).listing_id == first
