"""The listing pipeline as one lazy plan per stage.

source rows -> validate -> reconcile age -> dedupe -> criteria per search ->
parcel join, radius counts, walk proxy, travel time -> commute cut ->
percentile scores -> rank -> explanation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.operators import criteria as C
from cohortwise.operators import enrich as D
from cohortwise.operators import quality as Q
from cohortwise.operators.explain import explain
from cohortwise.operators.rank import assign_rank
from cohortwise.operators.score import score_cohorts
from cohortwise.session import stored
from cohortwise.sources.tables import AS_OF, Tables


# What the stages after dedupe, the reports and the sinks use of a listing.
KEPT_COLS = ("listing_id", "seq", "source", "url", "address", "address_key", "city", "price", "beds", "baths", "sqft", "property_type",
             "list_date", "days_on_market", "lat", "lon")

# What enrichment up to the commute cut reads of a survivor, and what the scores and the rank read.
CUT_COLS = ("search_id", "listing_id", "price", "address_key", "lat", "lon", "commute_mode", "anchor_lat", "anchor_lon", "max_commute_min")
SCORED_COLS = (*CUT_COLS, "seq", "sqft", "days_on_market", "w_value", "w_location", "w_freshness")


@dataclass
class Pipeline:
    t: Tables
    as_of: str = AS_OF
    # One row per listing id (true after the J1 upsert, as in the reference's flow)
    # allows the one-aggregate dedupe; otherwise the exact iterative form runs.
    unique_ids: bool = True
    # Any listing source (portal scan, messages, source union, synthetic rows) and
    # lookup tables; defaults are the fixture views of ``t``.
    source: DataFrame | None = None
    searches: DataFrame | None = None
    parcels: DataFrame | None = None
    pois: DataFrame | None = None
    routes: DataFrame | None = None
    # What the job reads of a survivor's columns (``CUT_COLS``, ``SCORED_COLS``), null: all.
    used: tuple[str, ...] | None = None
    _memo: dict = field(default_factory=dict)

    def _m(self, key, fn):
        if key not in self._memo:
            self._memo[key] = fn()
        return self._memo[key]

    def _search(self) -> DataFrame:
        """The searches, with defaults for the criteria that they leave unset."""
        return self._m("search", lambda: C.with_defaults(self.searches if self.searches is not None else self.t.v_search))

    def _parcels(self) -> DataFrame:
        return self.parcels if self.parcels is not None else self.t.v_parcel

    def _pois(self) -> DataFrame:
        return self.pois if self.pois is not None else self.t.v_poi

    def _routes(self) -> DataFrame:
        return self.routes if self.routes is not None else self.t.v_route

    def listings(self) -> DataFrame:
        """Source rows with the optional fields filled as nulls. Insertion order is
        ``seq`` when the source has it, else the columns that tell a source's own
        order (file and page of a payload, path and place of a message), else the
        listing id."""
        def build():
            df = self.source if self.source is not None else self.t.v_listing
            for c, typ in (("property_type", "string"), ("days_on_market", "int"), ("sqft", "bigint"),
                           ("beds", "double"), ("baths", "double")):
                if c not in df.columns:
                    df = df.withColumn(c, F.lit(None).cast(typ))
            if "seq" in df.columns:
                return df
            own = [c for c in ("path", "_file", "_page", "modificationTime", "_pos", "pos") if c in df.columns]
            return df.withColumn("seq", F.struct(*own, "listing_id") if own else F.col("listing_id"))
        return self._m("listings", build)

    def validated(self) -> DataFrame:
        return self._m("validated", lambda: Q.validate(self.listings()))

    def valid(self) -> DataFrame:
        return self._m("valid", lambda: Q.reconcile_age(
            self.validated().where(F.col("invalid_reason").isNull()), self.as_of))

    def kept(self) -> DataFrame:
        """Stage boundary: the deduplicated listings, with the columns that later stages use, are
        written once, so no stage goes through ingest and dedupe again."""
        def build():
            df = Q.dedupe(self.valid()) if self.unique_ids else Q.dedupe_exact(self.valid())
            used = [c for c in KEPT_COLS if c in df.columns]
            return stored(df.select(*used))
        return self._m("kept", build)

    def duplicates(self) -> DataFrame:
        return self._m("dups", lambda: Q.duplicates(self.valid(), self.kept()))

    def report(self, which: Column) -> DataFrame:
        """Every kept listing against the searches that ``which`` holds for, with its first failing reason."""
        return C.criteria_report(self.kept(), self._search().where(which))

    def reason_counts(self) -> DataFrame:
        """How many kept listings fail first at each rule of every search."""
        return self._m("reason_counts", lambda: C.reason_counts(self.kept(), self._once(), self._search()))

    def pass_counts(self) -> DataFrame:
        return self._m("pass_counts", lambda: C.pass_counts(self.kept(), self._once(), self._search()))

    def matches(self) -> DataFrame:
        """The filter stage's survivors as a plan, for jobs that read them once: only the columns that a job uses are dealt.

        Survivors come from an equi-join on the leaves of a k-d split that the
        searches' bounds reach, never from the listings x searches product;
        ``report`` gives the reasons for a stated set of searches.
        """
        return self._m("matches", lambda: C.criteria_pass_banded(self.kept(), self._search()))

    def passed(self) -> DataFrame:
        """Stage boundary: ``matches`` written once, with the columns in ``used`` (enrichment reads
        them from several branches and must not re-run ingest, dedupe and criteria)."""
        return self._m("passed", lambda: stored(self.matches().select(*self.used or "*")))

    def _once(self) -> DataFrame:
        """The survivors for a single reading."""
        return self._memo.get("passed", self.matches())

    def enriched(self) -> DataFrame:
        def build():
            df = D.parcel_join(self.passed(), self._parcels())
            df = D.radius_counts(df, self._pois())
            df = D.with_walk_proxy(df)
            df = D.commute(df, self._routes())
            return df.withColumn("commute_reason", C.commute_reason_col())
        return self._m("enriched", build)

    def analyzed(self) -> DataFrame:
        """Stage boundary: the analysed cohort is written once (a Parquet table in the
        session's shared checkpoint folder) so scoring and ranking, which read it
        several times, never recompute ingest, dedupe, criteria and enrichment."""
        def build():
            return stored(self.enriched().where(F.col("commute_reason").isNull()))
        return self._m("analyzed", build)

    def scored(self) -> DataFrame:
        return self._m("scored", lambda: score_cohorts(self.analyzed(), ["search_id"]))

    def ranked(self) -> DataFrame:
        """The scores are written once: the rank reads them for the order and again for the rows."""
        return self._m("ranked", lambda: assign_rank(stored(self.scored()), ["search_id"]))

    def explained(self) -> DataFrame:
        return self._m("explained", lambda: explain(self.ranked()))
