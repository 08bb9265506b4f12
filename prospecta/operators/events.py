"""Operators over filing events: ticker map, vehicle and scope, identity, snapshot."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospecta import fixed
from prospecta.functions import classify as c
from prospecta.functions import dates as d
from prospecta.functions import text as t
from prospecta.operators import relational as r

#: Rows of a ticker map or registry that may be broadcast; more are joined by shuffle.
DIMENSION_ROWS = 200_000


def small(dim: DataFrame, rows: int = DIMENSION_ROWS) -> DataFrame:
    """Broadcast if its size allows."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim


def with_order(events: DataFrame) -> DataFrame:
    """`ord`: the order in which the store gives events (date and acceptance falling, then event id)."""
    return events.withColumn("ord", F.struct(F.col("date").alias("d"), F.col("accepted_at").alias("a"), F.col("event_id").alias("e")))


def store_order() -> list[Column]:
    return [F.desc("date"), F.desc("accepted_at"), F.asc("event_id")]


def by_time(events: DataFrame) -> DataFrame:
    """Events as a search lists them: the latest first by event time, those of one time in store order."""
    return events.orderBy(F.desc(d.event_time(F.col("accepted_at"), F.col("date"))), *store_order())


def range_scan(events: DataFrame, start: str, end: str, ciks: list[str] | None = None) -> DataFrame:
    """Events of filing dates from start to end, both included, in store order. No filers gives none, None all."""
    found = events.filter(F.col("date").between(start, end))
    if ciks is not None:
        found = found.filter(F.col("cik").isin(*ciks) if ciks else F.lit(False))
    return found.orderBy(*store_order())


def enrich_from_map(events: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """Tickers that are missing come from the official map (cik, series_id, class_id, symbol); what the filing said stays.
    With a large map only events that lack a ticker are shuffled; rows of the map may repeat."""
    few = ticker_map.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS
    keys = {"_c": t.normalize_cik(F.col("cik")), "_s": t.key_text(F.col("series_id")), "_k": t.key_text(F.col("class_id"))}
    # The hash is what is sorted by: numbers padded with zeros begin alike.
    key, by = F.xxhash64(*keys), ["_h", *keys]
    dim = ticker_map.select(*[v.alias(k) for k, v in keys.items()], t.official_ticker(F.col("symbol")).alias("_t")).filter("_t <> ''").groupBy(*keys).agg(F.max("_t").alias("_t")).withColumn("_h", key)
    lacks = t.sanitize_ticker(F.col("ticker")) == "Not Listed"
    found = (events if few else events.filter(lacks)).withColumns(keys).withColumn("_h", key).join(F.broadcast(dim) if few else dim, by, "left")
    missing = F.col("_t").isNotNull() & (lacks if few else F.lit(True))
    found = found.withColumns({"ticker": F.when(missing, F.col("_t")).otherwise(F.col("ticker")), "ticker_source": F.when(missing, fixed.FROM_MAP).otherwise(F.col("ticker_source"))}).select(*events.columns)
    return found if few else events.filter(~lacks).unionAll(found)


def fill_tickers_from_later(events: DataFrame) -> DataFrame:
    """Rows without ids take the latest ticker of their filer and name."""
    present = t.sanitize_ticker(F.col("ticker")) != "Not Listed"
    name = t.normalize_name(F.col("etf_name"))
    order = [F.desc(d.event_time(F.col("accepted_at"), F.col("date"))), *store_order()]
    found = r.fill_from_later(events, [F.col("cik"), name], order, "ticker", present, ~c.has_any_id() & (name != ""))
    new = F.col("filled").isNotNull()
    return found.withColumns({"ticker": F.coalesce("filled", "ticker"), "ticker_source": F.when(new, fixed.FROM_LATER).otherwise(F.col("ticker_source"))}).drop("filled")


def normalize_vehicle_scope(events: DataFrame) -> DataFrame:
    """Vehicle anew (a stored one stays where nothing shows any), scope by ids; a class once seen by series stays so."""
    seen = c.row_vehicle()
    kept = F.when((seen == fixed.UNKNOWN) & F.col("vehicle").isin(fixed.ETF, fixed.MUTUAL_FUND), F.col("vehicle")).otherwise(seen)
    out = events.withColumn("vehicle", kept)
    scope = F.when(c.uses_series_identity(F.col("vehicle")), "series").when((F.trim("series_id") != "") & (F.trim("class_id") != ""), "class").when(F.trim("series_id") != "", "series").otherwise("name")
    out = out.withColumn("identity_scope", scope)
    keys = [t.normalize_cik(F.col("cik")), t.key_text(F.col("series_id")), t.key_text(F.col("class_id"))]
    out = r.any_in_group(out, keys, F.col("identity_scope") == "series", "_series")
    both = (F.trim("series_id") != "") & (F.trim("class_id") != "")
    return out.withColumn("identity_scope", F.when(both & F.col("_series"), "series").otherwise(F.col("identity_scope"))).drop("_series")


def with_identity(events: DataFrame) -> DataFrame:
    """`identity`: by series or class, else by the only one that the filer and name lead to, else by name."""
    own = c.known_identity(F.col("cik"), F.col("series_id"), F.col("class_id"), F.col("identity_scope"))
    keyed = events.withColumns({"_own": own, "_cik": t.normalize_cik(F.col("cik")), "_name": t.normalize_name(F.col("etf_name"))})
    bridge = r.unique_bridge(keyed.filter("_name <> ''"), ["_cik", "_name"], "_own").withColumnRenamed("_own", "_bridged")
    out = keyed.join(bridge, ["_cik", "_name"], "left")
    return out.withColumn("identity", F.coalesce("_own", "_bridged", c.name_identity(F.col("cik"), F.col("etf_name")))).drop("_own", "_bridged", "_cik")


def finalize(events: DataFrame, start: dt.date, end: dt.date, ticker_map: DataFrame | None = None) -> DataFrame:
    """Enrich, fill, normalize, then bound: rows after the end may still give tickers to rows within. A bound with a time of
    day leaves out the filings of a day that begins before it."""
    out = enrich_from_map(events, ticker_map) if ticker_map is not None else events
    out = normalize_vehicle_scope(fill_tickers_from_later(out))
    day = d.filing_date(F.col("date"))
    return out.filter(day.between(F.lit(str(start)).cast("timestamp"), F.lit(str(end)).cast("timestamp")))


def snapshot(events: DataFrame) -> DataFrame:
    """The latest row of each fund with its filing history. Rows whose name is blank are all kept and stay out of
    histories; they take their identity's history if it has one, else their own form."""
    rows = with_identity(normalize_vehicle_scope(events)).withColumn("_time", d.event_time(F.col("accepted_at"), F.col("date")))
    blank = F.col("_name") == ""
    priority = F.when(F.col("vehicle") == fixed.ETF, 3).when(F.col("vehicle") == fixed.MUTUAL_FUND, 2).otherwise(1)
    has_ticker = (t.sanitize_ticker(F.col("ticker")) != "Not Listed").cast("int")
    same = ((F.col("class_name") == F.col("series_name")) & (F.col("class_name") != "")).cast("int")
    clean = (~t.has_exchange_prefix(F.col("etf_name"))).cast("int")
    falling = F.struct(F.col("_time"), (-F.unix_date(F.try_to_date(F.col("date"), "yyyy-MM-dd"))).alias("_day"), F.col("event_id"))
    rows = rows.withColumn("_order", falling)
    # An event counts once in its fund's history: the first of its filing.
    again = F.row_number().over(Window.partitionBy("identity", blank, "accession_number").orderBy("_order")) > 1
    rows = rows.withColumn("_once", ~blank & ((F.trim("accession_number") == "") | ~again))
    effective = d.effective_for_history(F.col("designated_effective_date"), F.col("date"), F.col("effectiveness_days"))
    rows = r.least_before(rows, ["identity"], F.unix_micros("_time"), F.col("_once") & (F.upper("form") == "485BPOS"), effective, "_effective")
    order = [F.desc("_time"), F.desc(priority), F.desc(has_ticker), F.desc(same), F.desc(clean), *store_order()]
    latest = r.latest_by(rows, ["identity"], order, always=blank)
    past = rows.filter(~blank)
    history = r.history_by(past, ["identity"], ["_order"], "accession_number", "form", fixed.AMENDMENT_FORMS)
    form = F.upper("form")
    out = latest.join(history, "identity", "left").withColumns({
        "filing_event_count": F.coalesce("n_events", F.lit(1)), "amendment_count": F.coalesce("n_amendments", form.isin(*fixed.AMENDMENT_FORMS).cast("long")),
        "filing_form_history": F.coalesce("history", form), "prior_effective_485bpos": F.coalesce(F.col("_effective") <= d.filing_date(F.col("date")), F.lit(False))})
    return out.drop("n_events", "n_amendments", "history", "_time", "_name", "_order", "_once", "_effective", "identity")


def with_readiness(rows: DataFrame, today: dt.date, registry: DataFrame | None = None, search_start: dt.date | None = None) -> DataFrame:
    """Stage, effective date, readiness and flags. With a search start, funds known before are amendments of existing ones."""
    out = rows.withColumns({
        "filing_stage": c.filing_stage(F.col("form")),
        "earliest_auto_effective_date": d.earliest_effective(F.col("designated_effective_date"), F.col("date"), F.col("effectiveness_days")),
    })
    out = out.withColumn("launch_readiness", c.readiness(F.col("form"), F.col("filing_form_history"), F.col("vehicle"), F.col("earliest_auto_effective_date"), today))
    series, by = t.key_text(F.col("series_id")), Window.partitionBy(t.key_text(F.col("series_id")))
    sibling = F.bool_or(F.col("vehicle") == fixed.MUTUAL_FUND).over(by)
    out = out.withColumns({
        "etf_share_class": (F.col("vehicle") == fixed.ETF) & (series != "") & F.coalesce(sibling, F.lit(False)),
        "needs_ticker": c.needs_ticker(F.col("ticker"), F.col("ticker_source"), F.col("vehicle")),
    })
    if search_start is not None:
        known = F.lit(False)
        if registry is not None:
            dim = small(registry.select(t.key_text(F.col("series_id")).alias("_s"), F.col("first_filing_date").try_cast("date").alias("_first")).groupBy("_s").agg(F.min("_first").alias("_first")))
            out = out.join(dim, series == F.col("_s"), "left")
            known = F.coalesce(F.col("_first") < d.age_cutoff(F.lit(search_start)), F.lit(False))
        known = known | c.truthy(F.col("prior_effective_485bpos"))
        out = out.withColumn("launch_readiness", F.when(c.wants_series_age(F.col("launch_readiness"), F.col("form")) & known, fixed.EXISTING).otherwise(F.col("launch_readiness"))).drop("_s", "_first")
    return out.withColumn("days_to_readiness", F.datediff("earliest_auto_effective_date", F.lit(today)))


def series_wanting_age(rows: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Distinct series ids whose age decides readiness and is not registered."""
    series = t.key_text(F.col("series_id")).alias("series_id")
    wanted = rows.filter(c.wants_series_age(F.col("launch_readiness"), F.col("form"))).select(series).filter("series_id <> ''").distinct()
    return wanted if registry is None else r.unseen(wanted, registry.select(series), ["series_id"])


def identities_by_ticker(pairs: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """(name, ticker) pairs of a filer confirmed by the official map: one identity gives ids, several stay by name."""
    dim = ticker_map.select(t.normalize_cik(F.col("cik")).alias("cik"), t.official_ticker(F.col("symbol")).alias("ticker"), F.struct(t.key_text(F.col("series_id")).alias("series_id"), t.key_text(F.col("class_id")).alias("class_id")).alias("ids"))
    dim = dim.filter("ticker <> ''").groupBy("cik", "ticker").agg(F.collect_set("ids").alias("ids"))  # identities of one symbol
    own = pairs.withColumns({"cik": t.normalize_cik(F.col("cik")), "ticker": t.official_ticker(F.col("ticker")), "name": F.trim("name")}).filter("name <> ''")
    met = own.join(small(dim), ["cik", "ticker"])
    one = r.latest_by(met.filter(F.size("ids") == 1), ["filing", "ticker"], [t.has_exchange_prefix(F.col("name")).cast("int").asc(), F.asc("ord")])
    several = r.latest_by(met.filter(F.size("ids") > 1).withColumn("_key", t.normalize_name(F.col("name"))).filter("_key <> ''"), ["filing", "ticker", "_key"], [F.asc("ord")]).drop("_key")
    one = one.select("filing", "ord", "cik", "name", "ticker", F.get("ids", F.lit(0))["series_id"].alias("series_id"), F.get("ids", F.lit(0))["class_id"].alias("class_id"), F.lit("class").alias("identity_scope"))
    return one.unionByName(several.select("filing", "ord", "cik", "name", "ticker", F.lit("").alias("series_id"), F.lit("").alias("class_id"), F.lit("name").alias("identity_scope")))
