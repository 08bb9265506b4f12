"""The engine's operators over the driver's tables, with the SQL that says the same.

Orders stand for filings (customer: fund, order date: filing date, priority and status: form and ticker evidence), parts
for named funds, customers for filers. Dates are fixed literals.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta import fixed
from prospecta.functions import classify as c
from prospecta.functions import dates as d
from prospecta.functions import text as t
from prospecta.operators import events as e
from prospecta.operators import relational as r
from prospecta.plans import snapshot as s
from prospecta.schema import as_events
from prospecta.sources import parse

TODAY = dt.date(1998, 3, 1)
START, END = "1995-01-01", "1996-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores by their key. A table of few bytes is read as one or two splits, however long its rows take."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their date as text."""
    return table(spark, sf_dir, "orders").withColumn("day", F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"))


FORM = "CASE o_orderpriority WHEN '1-URGENT' THEN 'N-1A' WHEN '2-HIGH' THEN '485APOS' WHEN '3-MEDIUM' THEN '485APOS' ELSE '485BPOS' END"
DAYS = "CASE o_orderstatus WHEN 'F' THEN 60 WHEN 'O' THEN 75 END"
ORDERS = f"(SELECT *, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, {FORM} AS form, {DAYS} AS days FROM orders)"


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).withColumns({"form": F.expr(FORM), "days": F.expr(DAYS)})


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer by date, status and price, ties by key."""
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    rows = orders(spark, sf_dir)
    return r.latest_by(rows, ["o_custkey"], [F.desc("day"), F.desc(rank), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "day", "o_orderstatus")


def form_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings, amendments and ordered forms of each customer."""
    rows = filings(spark, sf_dir).withColumn("acc", F.col("o_orderkey").cast("string"))
    out = r.history_by(rows, ["o_custkey"], ["day", "o_orderkey"], "acc", "form", fixed.AMENDMENT_FORMS, {"any_initial": F.col("form") == "N-1A"})
    return out.select("o_custkey", "n_events", "n_amendments", "history", "any_initial")


def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without evidence take that of a later order of the customer."""
    rows = orders(spark, sf_dir)
    out = r.fill_from_later(rows, ["o_custkey"], [F.desc("day"), F.asc("o_orderkey")], "o_orderpriority", F.col("o_orderstatus") == "F", F.lit(True))
    return out.select("o_orderkey", F.coalesce("filled", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")), F.lit("")).alias("ticker"))


def prior_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a customer's latest order has an earlier amendment that was effective by then."""
    rows = filings(spark, sf_dir)
    effective = d.effective_for_history(F.lit(""), F.col("day"), F.col("days"))
    rows = r.least_before(rows, ["o_custkey"], F.unix_date(F.col("day").cast("date")).cast("long"), F.col("form") == "485BPOS", effective, "least")
    latest = r.latest_by(rows, ["o_custkey"], [F.desc("day"), F.asc("o_orderkey")])
    return latest.select("o_custkey", "o_orderkey", "day", F.coalesce(F.col("least") <= F.col("day").cast("timestamp"), F.lit(False)).alias("prior"))


def event_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot itself over orders as events: a customer is a fund, orders share accessions, some names are blank."""
    key, fund = F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    name = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise("Example ETF")
    rows = filings(spark, sf_dir).select(
        F.concat(F.lit("e"), key).alias("event_id"), F.concat_ws("-", fund, (F.col("o_orderkey") % 4).cast("string")).alias("accession_number"), fund.alias("cik"),
        F.lower("form").alias("form"), F.col("day").alias("date"), name.alias("etf_name"), F.lit("Example ETF").alias("class_name"), F.lit("Example ETF").alias("series_name"),
        F.concat(F.lit("S"), fund).alias("series_id"), F.concat(F.lit("C"), fund).alias("class_id"), F.col("days").alias("effectiveness_days"), F.lit("Not Listed").alias("ticker"))
    out = e.snapshot(as_events(rows))
    return out.select("event_id", "filing_event_count", "amendment_count", "filing_form_history", "prior_effective_485bpos")


def elections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effectiveness elections of cover windows made of orders."""
    mark = F.when(F.col("o_orderkey") % 3 == 0, "[ ]").otherwise("[X]")
    option = F.when(F.col("o_orderstatus") == "F", "60 days after filing").when(F.col("o_orderstatus") == "O", "75 days after filing").otherwise(
        F.concat(F.lit("on "), F.date_format(F.col("day").cast("date"), "M/d/yyyy"), F.lit(" pursuant to paragraph (b)")))
    rows = spread(orders(spark, sf_dir), "o_orderkey").withColumn("window", F.concat(F.lit("<tr><td>"), mark, F.lit("</td><td>"), option, F.lit("</td></tr>")))
    return rows.select("o_orderkey", parse.effectiveness_of("window").alias("e")).select("o_orderkey", F.col("e.basis").alias("basis"), F.coalesce("e.days", F.lit(-1)).alias("days"), F.col("e.designated").alias("designated"))


def table_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of filing indexes made of customers."""
    key = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    ticker = F.upper(F.substring("c_mktsegment", 1, 4))
    page = F.concat(F.lit('<table><tr><td class="seriesName">S'), key, F.lit('</td><td class="seriesCell">'), F.col("c_name"), F.lit(' Trust</td></tr><tr class="contractRow"><td>C'), key,
                    F.lit("</td><td></td><td>Class A</td><td>"), ticker, F.lit('</td></tr><tr class="contractRow"><td>none</td><td></td><td></td><td>X</td></tr></table>'))
    rows = spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.explode(parse.series_entries_of(page)).alias("e"))
    return rows.select("c_custkey", "e.class_name", "e.ticker", "e.series_id", "e.series_name", "e.class_id")


def alias_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and account signs that lead to one nation."""
    rows = table(spark, sf_dir, "customer").withColumn("alias", F.substring(F.col("c_name"), -3, 3))
    return r.unique_bridge(rows, ["c_mktsegment", "alias"], "c_nationkey")


def sibling_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders of customers that have a filled one too."""
    rows = orders(spark, sf_dir).withColumn("sid", F.col("o_custkey"))
    return r.any_in_group(rows, ["sid"], F.col("o_orderstatus") == "F", "sibling").select("o_orderkey", (F.col("sibling") & (F.col("o_orderstatus") == "O")).alias("flag"))


def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored orders topped up by later ones with an overlap, whose values win at the stored place."""
    rows = orders(spark, sf_dir).select("o_orderkey", "day", "o_orderstatus")
    stored = rows.filter(F.col("day") <= "1997-06-30").withColumns({"ord": F.col("o_orderkey"), "source": F.lit("stored")})
    live = rows.filter(F.col("day") >= "1997-06-27").withColumns({"ord": F.col("o_orderkey"), "source": F.lit("live")})
    return r.merge_by_key(stored, live, "o_orderkey").select("o_orderkey", "day", "source", F.col("place._side").alias("place"))


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order in the window."""
    window = orders(spark, sf_dir).filter(F.col("day").between(START, END))
    return r.unseen(table(spark, sf_dir, "customer").select("c_custkey"), window.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


def registry_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose first order is older than 18 months before the start."""
    first = orders(spark, sf_dir).groupBy("o_custkey").agg(F.min("day").alias("first_day"))
    return first.select("o_custkey", "first_day", (F.to_date("first_day") < d.age_cutoff(F.to_date(F.lit(START)))).alias("existing"))


def readiness_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage, effective date and readiness of every order as a filing."""
    rows = filings(spark, sf_dir).withColumn("effective", d.earliest_effective(F.lit(""), F.col("day"), F.col("days")))
    state = c.readiness(F.col("form"), F.col("form"), F.lit(fixed.ETF), F.col("effective"), TODAY)
    return rows.select("o_orderkey", c.filing_stage(F.col("form")).alias("stage"), F.date_format("effective", "yyyy-MM-dd").alias("effective"), state.alias("state"), F.coalesce(F.datediff("effective", F.lit(TODAY)), F.lit(0)).alias("days_left"))


def vehicle_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles of parts whose type's first word, cut to size, is the ticker."""
    rows = table(spark, sf_dir, "part").withColumn("ticker", F.substring(F.upper(F.regexp_replace("p_type", "[^A-Za-z]", "")), 1, 5))
    ticker = F.when(F.col("p_size") < 10, F.concat(F.substring("ticker", 1, 4), F.lit("X"))).when(F.col("p_size") < 30, F.substring("ticker", 1, 4)).otherwise(F.col("ticker"))
    name = F.when(F.col("p_size") % 7 == 0, F.concat(F.col("p_name"), F.lit(": Class A Shares"))).when(F.col("p_size") % 5 == 0, F.concat(F.col("p_name"), F.lit(" ETF"))).otherwise(F.col("p_name"))
    return rows.select("p_partkey", c.vehicle(ticker, name, F.lit(""), F.lit("")).alias("vehicle"))


def theme_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of part names, zero where none occurs."""
    rows = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 4 == 0, "Covered Call").when(F.col("p_size") % 4 == 1, "2x Bull").when(F.col("p_size") % 4 == 2, "Short Duration"), F.lit("Fund")).alias("etf_name"))
    return s.theme_counts(rows).select("place", "label", "count")


def top_filers(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = orders(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return r.top_counts(joined, F.col("c_name"), "Unknown filer", 8)


def brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.brief_counts(readiness_states(spark, sf_dir).withColumnRenamed("state", "launch_readiness"))


def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.hidden_counts(readiness_states(spark, sf_dir).withColumnRenamed("state", "launch_readiness"))


def ledger_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders not read yet or read by an older version."""
    rows = orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    ledger = rows.filter(F.col("o_custkey") % 3 > 0).select("o_orderkey", (F.col("o_custkey") % 3 + 13).alias("version"))
    return r.unseen(rows, ledger.filter(F.col("version") >= fixed.PARSER_VERSION), ["o_orderkey"])


def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, tickers and numbers of customers as the store compares them."""
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", t.normalize_name(F.concat(F.lit("<b>"), F.col("c_name"), F.lit("</b> &amp; co."))).alias("name"), t.normalize_cik(F.col("c_name")).alias("cik"), t.sanitize_ticker(F.substring("c_mktsegment", 1, 4)).alias("ticker"), t.theme_name(F.concat(F.col("c_mktsegment"), F.lit("-x/y"))).alias("theme_name"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readiness_states(spark, sf_dir).select(F.col("state").alias("launch_readiness"), F.when(F.col("o_orderkey") % 5 > 0, "AAAA").otherwise("Not Listed").alias("ticker"), (F.col("o_orderkey") % 100).cast("string").alias("filer"), (F.col("o_orderkey") % 7 == 0).alias("etf_share_class"), F.col("effective").alias("date"))
    return s.cards(rows)


def cover_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2,000 characters before to 8,000 after the first anchor, else the start of the text."""
    from prospecta.sources.documents import cover_window as window

    rows = table(spark, sf_dir, "documents")
    cut = window(F.col("text"), anchors=(" the of ", " la "))
    return rows.select("doc_id", F.length(cut).cast("long").alias("n"), F.md5(cut).alias("digest"))


def pair_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand matched by name with the brand's own pairs; a ticker is taken once."""
    part = table(spark, sf_dir, "part").withColumn("word", F.upper(F.split("p_name", " ")[0]))
    entries = part.filter("p_size > 25").select(F.col("p_brand").alias("filing"), F.col("p_partkey").alias("ord"), F.upper("p_name").alias("name"), F.lit("").alias("ticker"))
    pairs = part.filter("p_size <= 25").select(F.col("p_brand").alias("filing"), F.col("p_partkey").alias("ord"), F.col("word").alias("name"), F.concat(F.lit("T"), F.col("p_partkey")).alias("ticker"))
    return r.unique_matches(entries, pairs, "filing").select("ord", F.coalesce("proposed", F.lit("")).alias("proposed"))


QUERIES = {f.__name__: f for f in (
    latest_snapshot, form_history, forward_fill, prior_effective, event_snapshot, elections, table_entries, alias_bridge, sibling_flag, keyed_merge, unresolved, registry_age, readiness_states,
    vehicle_case, theme_histogram, top_filers, brief, hidden_states, ledger_skip, name_normalize, cards, cover_window, pair_match)}

STATES = f"""(SELECT o_orderkey, form, CASE form WHEN 'N-1A' THEN 'Initial filing' WHEN '485APOS' THEN 'Rule 485(a) amendment' ELSE 'Rule 485(b) amendment' END AS stage,
  strftime(eff, '%Y-%m-%d') AS effective, CAST(coalesce(date_diff('day', DATE '1998-03-01', eff), 0) AS INTEGER) AS days_left,
  CASE WHEN form = 'N-1A' THEN 'Initial review' WHEN eff IS NULL THEN 'Timing undetected' WHEN form = '485APOS' AND eff > DATE '1998-03-01' THEN 'Upcoming launch'
    WHEN form = '485APOS' AND date_diff('day', eff, DATE '1998-03-01') <= 30 THEN 'Recently launched' WHEN form = '485APOS' THEN 'Launched (stale)' ELSE 'Routine 485(b) update' END AS state
  FROM (SELECT *, CAST(CAST(day AS DATE) + days AS DATE) AS eff FROM {ORDERS}))"""
_THEME = "concat_ws(' ', p_name, CASE p_size % 4 WHEN 0 THEN 'Covered Call' WHEN 1 THEN '2x Bull' WHEN 2 THEN 'Short Duration' END, 'Fund')"


def _theme_sql() -> str:
    words = f"trim(regexp_replace(regexp_replace(lower({_THEME}), '[-/]', ' ', 'g'), '\\s+', ' ', 'g'))"
    rules = "".join(f" WHEN regexp_matches(w, '{t.any_word(terms)}') THEN '{label}'" for label, terms in fixed.THEME_TERMS)
    geared = "|".join(fixed.GEARED_WORDS)
    follow = "|".join(fixed.SHORT_FOLLOWERS)
    case = rf"""CASE WHEN NOT regexp_matches(w, '\blong\s+short\b') AND (regexp_matches(w, '\b[+-]?[0-9]+(?:\.[0-9]+)?x\b') OR regexp_matches(w, '\b(?:{geared})\b')
      OR (regexp_matches(w, '\bshort\b') AND NOT regexp_matches(w, '\bshort\s+(?:{follow})\b'))) THEN '{fixed.LEVERAGED}'{rules} ELSE '{fixed.OTHER}' END"""
    labels = ", ".join(f"({i}, '{x}')" for i, x in enumerate(fixed.THEMES))
    return f"SELECT CAST(place AS INTEGER) AS place, l.label, coalesce(n, 0) AS count FROM (VALUES {labels}) l(place, label) LEFT JOIN (SELECT {case} AS label, count(*) AS n FROM (SELECT {words} AS w FROM part) GROUP BY 1) c ON l.label = c.label"


def group_case(rows: str) -> str:
    """rows (a query that has a name) with the group and segment of the name."""
    def met(x: str) -> str:
        return f"starts_with(lower(name), '{x[1:]}')" if x.startswith("^") else f"contains(lower(name), '{x}')"

    rules = "".join(f" WHEN {' OR '.join(map(met, needles))} THEN '{group}'" for group, needles in fixed.GROUP_RULES)
    top, trusts = (", ".join(f"'{x}'" for x in names) for names in (fixed.TOP_GROUPS, fixed.SERIES_TRUST_GROUPS))
    return f"""SELECT *, CASE WHEN "group" IN ({top}) THEN 'Top 3' WHEN "group" IN ({trusts}) THEN 'Series Trusts' ELSE 'The Field' END AS segment
      FROM (SELECT *, CASE{rules} ELSE name END AS "group" FROM ({rows}))"""


ORACLES = {
    "latest_snapshot": f"""SELECT o_custkey, o_orderkey, day, o_orderstatus FROM {ORDERS} QUALIFY row_number() OVER (PARTITION BY o_custkey
      ORDER BY day DESC, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END DESC, o_orderkey) = 1""",
    "form_history": f"""SELECT o_custkey, count(*) AS n_events, count(*) FILTER (WHERE form <> 'N-1A') AS n_amendments,
      string_agg(form, ' -> ' ORDER BY day, o_orderkey) AS history, bool_or(form = 'N-1A') AS any_initial FROM {ORDERS} GROUP BY o_custkey""",
    "forward_fill": f"""SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE first_value(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END IGNORE NULLS)
      OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END, '') AS ticker FROM {ORDERS}""",
    "prior_effective": f"""WITH o AS (SELECT * FROM {ORDERS}), l AS (SELECT o_custkey, o_orderkey, day FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey) = 1)
      SELECT *, EXISTS (SELECT 1 FROM o h WHERE h.o_custkey = l.o_custkey AND h.form = '485BPOS' AND h.day < l.day AND CAST(h.day AS DATE) + h.days <= CAST(l.day AS DATE)) AS prior FROM l""",
    "event_snapshot": f"""WITH o AS (SELECT *, o_orderkey % 11 = 0 AS blank, 'e' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, o_orderkey % 4 AS acc FROM {ORDERS}),
      h AS (SELECT * FROM o WHERE NOT blank QUALIFY row_number() OVER (PARTITION BY o_custkey, acc ORDER BY day, id) = 1),
      g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE form IN ('485APOS', '485BPOS')) AS m, string_agg(form, ' -> ' ORDER BY day, id) AS forms FROM h GROUP BY o_custkey),
      l AS (SELECT * FROM o WHERE blank UNION ALL (SELECT * FROM o WHERE NOT blank QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, id) = 1))
      SELECT id AS event_id, coalesce(n, 1) AS filing_event_count, coalesce(m, CAST(form IN ('485APOS', '485BPOS') AS BIGINT)) AS amendment_count, coalesce(forms, form) AS filing_form_history,
        EXISTS (SELECT 1 FROM h WHERE h.o_custkey = l.o_custkey AND h.form = '485BPOS' AND h.day < l.day AND CAST(h.day AS DATE) + h.days <= CAST(l.day AS DATE)) AS prior_effective_485bpos
      FROM l LEFT JOIN g USING (o_custkey)""",
    "elections": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderstatus = 'F' THEN 'rule_485_a1_60_days' WHEN o_orderstatus = 'O' THEN 'rule_485_a2_75_days' ELSE 'rule_485_b_designated_date' END AS basis,
      CASE WHEN o_orderkey % 3 = 0 OR o_orderstatus NOT IN ('F', 'O') THEN -1 WHEN o_orderstatus = 'F' THEN 60 ELSE 75 END AS days,
      CASE WHEN o_orderkey % 3 > 0 AND o_orderstatus NOT IN ('F', 'O') THEN strftime(CAST(o_orderdate AS DATE), '%-m/%-d/%Y') ELSE '' END AS designated FROM orders""",
    "table_entries": """SELECT c_custkey, 'Class A' AS class_name, CASE WHEN regexp_full_match(t, '[A-Z]{2,5}') THEN t ELSE '' END AS ticker, 'S' || k AS series_id, c_name || ' Trust' AS series_name, 'C' || k AS class_id
      FROM (SELECT *, upper(c_mktsegment[1:4]) AS t, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS k FROM customer)""",
    "alias_bridge": "SELECT c_mktsegment, right(c_name, 3) AS alias, min(c_nationkey) AS c_nationkey FROM customer GROUP BY 1, 2 HAVING count(DISTINCT c_nationkey) = 1",
    "sibling_flag": "SELECT o_orderkey, bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AND o_orderstatus = 'O' AS flag FROM orders",
    "keyed_merge": f"""SELECT o_orderkey, day, CASE WHEN day >= '1997-06-27' THEN 'live' ELSE 'stored' END AS source, CAST(CASE WHEN day > '1997-06-30' THEN 1 ELSE 0 END AS INTEGER) AS place FROM {ORDERS}""",
    "unresolved": f"SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM {ORDERS} o WHERE o.o_custkey = c.c_custkey AND day BETWEEN '{START}' AND '{END}')",
    "registry_age": f"SELECT o_custkey, min(day) AS first_day, CAST(min(day) AS DATE) < CAST(DATE '{START}' - INTERVAL 18 MONTH AS DATE) AS existing FROM {ORDERS} GROUP BY o_custkey",
    "readiness_states": f"SELECT o_orderkey, stage, effective, state, days_left FROM {STATES}",
    "vehicle_case": r"""SELECT p_partkey, CASE WHEN regexp_full_match(tk, '[A-Z]{4}X') OR p_size % 7 = 0 THEN 'Mutual fund share class'
      WHEN p_size % 5 = 0 OR regexp_matches(upper(p_name), '\bETF\b') OR regexp_full_match(tk, '[A-Z]{1,4}') THEN 'ETF' ELSE 'Other / unknown' END AS vehicle
      FROM (SELECT *, CASE WHEN p_size < 10 THEN t[1:4] || 'X' WHEN p_size < 30 THEN t[1:4] ELSE t END AS tk FROM (SELECT *, upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g'))[1:5] AS t FROM part))""",
    "theme_histogram": _theme_sql(),
    "top_filers": "SELECT c_name AS name, count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name ORDER BY 2 DESC, 1 LIMIT 8",
    "brief": f"SELECT count(*) AS total, count(*) FILTER (WHERE state = 'Upcoming launch') AS upcoming, count(*) FILTER (WHERE state = 'Initial review') AS initial_review FROM {STATES}",
    "hidden_states": f"SELECT state AS launch_readiness, count(*) AS count FROM {STATES} WHERE state NOT IN ('Upcoming launch', 'Initial review') GROUP BY state",
    "ledger_skip": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 3 <> 2",
    "name_normalize": r"""SELECT c_custkey, trim(regexp_replace(upper(c_name || ' & co.'), '[^A-Z0-9]+', ' ', 'g')) AS name,
      CASE WHEN length(n) = 0 OR length(n) >= 10 THEN n ELSE lpad(n, 10, '0') END AS cik, CASE WHEN regexp_full_match(upper(c_mktsegment[1:4]), '[A-Z]{2,5}') THEN upper(c_mktsegment[1:4]) ELSE 'Not Listed' END AS ticker,
      lower(c_mktsegment) || ' x y' AS theme_name FROM (SELECT *, regexp_replace(c_name, '[^0-9]', '', 'g') AS n FROM customer)""",
    "cards": f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey % 5 > 0) AS listed, count(DISTINCT o_orderkey % 100) AS filers,
      count(*) FILTER (WHERE state = 'Upcoming launch') AS upcoming, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS share_classes, max(effective) AS latest FROM {STATES}""",
    "cover_window": """SELECT doc_id, CAST(length(c) AS BIGINT) AS n, md5(c) AS digest FROM (SELECT doc_id, CASE WHEN p > 0 THEN substr(text, greatest(1, p - 2000), p + 8000 - greatest(1, p - 2000)) ELSE left(text, 120000) END AS c
      FROM (SELECT doc_id, text, CASE WHEN instr(s, ' the of ') > 0 THEN instr(s, ' the of ') ELSE instr(s, ' la ') END AS p FROM (SELECT doc_id, text, lower(left(text, 1000000)) AS s FROM documents)))""",
    "pair_match": """WITH part2 AS (SELECT *, upper(split_part(p_name, ' ', 1)) AS word FROM part),
      e AS (SELECT p_brand AS f, p_partkey AS ord, upper(p_name) AS name FROM part2 WHERE p_size > 25),
      p AS (SELECT p_brand AS f, word, min(p_partkey) AS place, 'T' || max(p_partkey) AS tk FROM part2 WHERE p_size <= 25 AND word <> '' GROUP BY 1, 2),
      m AS (SELECT e.f, ord, tk FROM e JOIN p ON e.f = p.f AND (contains(name, word) OR contains(word, name)) WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY e.f, ord ORDER BY name <> word, place) = 1),
      u AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY f, tk) = 1)
      SELECT e.ord, coalesce(tk, '') AS proposed FROM e LEFT JOIN u ON e.f = u.f AND e.ord = u.ord""",
}
