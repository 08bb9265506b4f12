"""From filings and their documents to events, for many filers in one plan.

Each document is parsed once; its facts are stored and moved, by address, to the filings that refer to it. Which
facts count is then a matter of columns: the index page gives the classes, the primary document fills what they lack, and
up to two supporting documents what is still unknown. A filing's rows are its classes (and pairs that the official map
confirms), else its name-ticker pairs, else one row. They are listed in the filing's own row until all else is known, so
that rows of classes are not joined again; kinds of documents, pairs and errors that do not occur cost no join.
A filer with an unreadable document has no rows and a failed status.

Defined results: a document that is missing or blank gives no facts; a filing without any name gives no row; repeated
addresses count once; empty tables give empty results; further columns of filings and documents are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospecta import fixed
from prospecta.functions import classify as c
from prospecta.functions import text as t
from prospecta.operators import events as e
from prospecta.operators import relational as r
from prospecta.schema import EVENT_FIELDS, NOT_LISTED, as_events
from prospecta.sources.documents import cover_window
from prospecta.sources.extract import FACTS, NO_NAME, facts_of
from prospecta.sources.feeds import supporting_links
from prospecta.sources.parse import ENTRIES

FILING = ("accession_number", "cik", "form", "date", "accepted_at", "link", "primary_link", "filer")
INDEX, PRIMARY, FIRST, SECOND = "index", "primary", "first", "second"
SUPPORTING = (FIRST, SECOND)
ROLES = (INDEX, PRIMARY, *SUPPORTING)
#: Supporting documents of this ending are read less far.
VIEWER_SUFFIX, VIEWER_CHARS = "_htm.xml", 120_000
#: What an entry of an index page holds, and besides with an official map: the ticker as filed, and whether the ticker is the map's.
ENTRY, OFFICIAL = tuple(ENTRIES.elementType.names), ("filed", "mapped")


def at(role: str) -> str:
    """The column of the address of a filing's document."""
    return f"{role}_url"


@dataclass(frozen=True)
class Assembled:
    """Events, and for each filer cik, filer, status, row_count and error_summary."""

    events: DataFrame
    statuses: DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df computed once: a checkpoint in the cluster's shared folder, or where the session names none, kept by the executors."""
    context = df.sparkSession.sparkContext
    return df.checkpoint() if context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") else df.persist()


def stored(df: DataFrame) -> DataFrame:
    """df computed once, as columns in the cluster's shared folder: a checkpoint computes its last stage twice and keeps whole rows."""
    context = df.sparkSession.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/prospecta/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def document_facts(documents: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """url, facts and whether there is text, for each document (url, text, perhaps error) that has an address; if given, of
    wanted urls alone."""
    text = t.text(F.col("text"))
    if wanted is not None:  # dealt to all cores: few bytes of text take long to read
        session = documents.sparkSession
        tasks = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
        documents = documents.repartition(tasks, "url").join(wanted.select("url").distinct(), "url", "left_semi")
    chars = F.when(F.col("url").endswith(VIEWER_SUFFIX), VIEWER_CHARS).otherwise(fixed.IDENTITY_CHARS)
    others = [F.max(x).alias(x) for x in documents.columns if x == "error"]
    known = documents.filter("url is not null").groupBy("url").agg(F.max("text").alias("text"), *others) if _repeats(documents) else documents.filter("url is not null")
    facts = facts_of(F.substring(text, F.lit(1), chars), cover_window(text))
    if "error" in documents.columns:  # what could not be read is an error of the document
        facts = facts.withField("error", F.coalesce(F.nullif("error", F.lit("")), facts.error))
    return known.select("url", (F.trim(text) != "").alias("has_text"), facts.alias("facts"))


def _repeats(documents: DataFrame) -> bool:
    """Whether an address is there twice: only then are texts grouped, which moves them."""
    return not documents.filter("url is not null").groupBy("url").count().filter("count > 1").isEmpty()


def index_links(documents: DataFrame, base: str) -> DataFrame:
    """link and more, for documents that as index pages would name others: the first of these, one more than a filing asks for."""
    links = supporting_links(F.substring(t.text(F.col("text")), 1, fixed.INDEX_CHARS), base, most=len(SUPPORTING) + 1)
    return documents.select(F.col("url").alias("link"), links.alias("more")).filter("link is not null and size(more) > 0").groupBy("link").agg(F.max("more").alias("more"))


def addressed(filings: DataFrame, links: DataFrame | None) -> DataFrame:
    """Filings with the addresses of their documents, by role (null where there is none)."""
    whole = F.col("accession_number").isNotNull() & F.col("cik").isNotNull()
    out = filings.withColumns({at(INDEX): F.when(whole, F.col("link")), at(PRIMARY): F.when(whole, F.nullif(t.text(F.col("primary_link")), F.lit("")))})
    if links is None:
        return out.withColumns({at(role): F.lit(None).cast("string") for role in SUPPORTING})
    others = F.array_except("more", F.array(t.text(F.col("primary_link"))))
    return out.join(links, "link", "left").withColumns({at(role): F.when(whole, F.get(others, F.lit(i))) for i, role in enumerate(SUPPORTING)}).drop("more")


def references(filings: DataFrame, documents: DataFrame, base: str) -> DataFrame:
    """accession_number, cik, role and url of the documents that each filing may need."""
    return _named(addressed(filings, _some(index_links(documents, base))))


def _named(filings: DataFrame) -> DataFrame:
    each = F.array(*[F.struct(F.lit(role).alias("role"), F.col(at(role)).alias("url")) for role in ROLES])
    return filings.select("accession_number", "cik", F.inline(each)).filter("url is not null")


def _some(df: DataFrame) -> DataFrame | None:
    """df, or nothing if it has no rows."""
    return None if df.isEmpty() else df


def with_documents(filings: DataFrame, facts: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Filings with the facts of their documents of these roles (null where there is none)."""
    for role in roles:
        filings = filings.join(facts.select(F.col("url").alias(at(role)), F.struct("has_text", "facts").alias(role)), at(role), "left")
    return filings


def without_documents(filings: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Filings with no facts of documents of these roles."""
    none = F.lit(None).cast(T.StructType([T.StructField("has_text", T.BooleanType()), T.StructField("facts", FACTS)]))
    return filings.withColumns({role: none for role in roles}) if roles else filings


def _fact(role: str, name: str, when: Column | None = None) -> Column:
    """A text fact of a document, blank without one."""
    value = F.coalesce(F.col(f"{role}.facts.{name}"), F.lit(NO_NAME if name == "fund_name" else ""))
    return value if when is None else F.when(when, value).otherwise(NO_NAME if name == "fund_name" else "")


def _pairs(role: str, when: Column) -> Column:
    none = F.array().cast(FACTS["pairs"].dataType)
    return F.coalesce(F.when(when, F.col(f"{role}.facts.pairs")), none)


def with_entries(filings: DataFrame, ticker_map: DataFrame | None) -> DataFrame:
    """Filings with `entries`: the classes of their index pages, with the ticker at filing and, if there is a map, the official one where
    the filing gave none."""
    out = filings.withColumn("entries", F.col(f"{INDEX}.facts.entries"))
    if ticker_map is None:
        return out
    key = ["accession_number", "cik"]
    rows = e.enrich_from_map(class_rows(out, key).withColumns({"filed": F.col("ticker"), "ticker_source": F.lit("")}), ticker_map)
    mapped = rows.withColumn("mapped", F.col("ticker_source") == fixed.FROM_MAP)
    each = mapped.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", *ENTRY, *OFFICIAL))).alias("entries"))
    return out.drop("entries").join(each, key, "left")


def class_rows(filings: DataFrame, kept: Sequence[str], explode: Callable[[str], Column] = F.posexplode) -> DataFrame:
    """A row for each of a filing's entries: `kept` of its columns, ord and the entry's own."""
    rows = filings.select(*kept, explode("entries").alias("ord", "x"))
    return rows.select(*kept, "ord", *[F.col(f"x.{name}") for name in rows.schema["x"].dataType.names if name != "ord"])


def shown_name(class_name: Column, series_name: Column) -> Column:
    """A class's name, or for share classes that of the series."""
    return F.when((series_name != "") & t.is_share_class_name(class_name), series_name).otherwise(class_name)


def resolved(filings: DataFrame, has_map: bool, filers: Sequence[tuple[str, str]] = fixed.FILERS, roles: Sequence[str] = ROLES) -> DataFrame:
    """Filings with what their documents (of `roles`), asked in order, say: ticker, name, filer, pairs, listing and election. Filers that
    are listed (cik, name) are shown by that name."""
    some = F.coalesce(F.size("entries") > 0, F.lit(False))
    out = filings.withColumns({
        "n_entries": F.when(some, F.size("entries")).otherwise(0), "no_ticker": some & F.exists("entries", lambda x: x.ticker == ""), "no_name": some & F.exists("entries", lambda x: x.class_name == "")})
    none = F.col("n_entries") == 0
    filer = F.coalesce(F.nullif(_fact(INDEX, "registrant"), F.lit("")), t.text(F.col("filer")))
    out = out.withColumn("filer_0", filer)
    wanted = none | (F.col("filer_0") == "") | F.col("no_ticker") | F.col("no_name")
    confirm = ~none & F.lit(has_map)
    out = out.withColumn("loaded", F.coalesce(F.col(f"{PRIMARY}.has_text"), F.lit(False)) & (wanted | confirm | F.col("form").isin(*fixed.AMENDMENT_FORMS)))
    out = out.withColumn("use_primary", F.col("loaded") & (wanted | confirm))

    use, say = F.col("use_primary"), F.coalesce(F.col(f"{INDEX}.has_text"), F.lit(False))
    out = out.withColumn("asked", F.struct(
        _fact(PRIMARY, "fund_ticker", use).alias("ticker"), _fact(PRIMARY, "fund_name", use).alias("name"), F.coalesce(F.nullif("filer_0", F.lit("")), _fact(PRIMARY, "registrant", use)).alias("filer"),
        _pairs(PRIMARY, use).alias("pairs"), F.coalesce(F.col(f"{INDEX}.facts.error"), F.when(F.col("loaded"), F.col(f"{PRIMARY}.facts.error"))).alias("error")))
    lacking = F.when(none, ~_whole(F.col("asked"))).otherwise((F.col("asked.filer") == "") | F.col("no_ticker"))
    more = F.filter(F.array(*SUPPORTING), lambda d: d.isNotNull() & say & lacking)
    state = F.aggregate(more, F.struct(F.col("asked"), F.lit(False).alias("stop")), lambda s, d: F.when(s.stop, s).otherwise(_told(s.asked, d.facts))).asked
    out = out.withColumns({
        "asked": state if set(roles) & set(SUPPORTING) else F.col("asked"), "lacking": say & lacking, "exchange_listed": F.col("loaded") & F.coalesce(F.col(f"{PRIMARY}.facts.exchange_listed"), F.lit(False)),
        "election": F.when(F.col("loaded"), F.col(f"{PRIMARY}.facts.election")).otherwise(F.col(f"{INDEX}.facts.election"))})
    shared = [cik for cik, _ in filers if cik in fixed.TIDAL_FILERS]
    configured = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in dict(filers).items() for x in pair]), F.col("cik")), F.lit("")) if filers else F.lit("")
    return out.select(
        "accession_number", "cik", "form", "date", "accepted_at", "link", "n_entries", "entries", t.filer_label(F.col("cik"), configured, F.col("asked.filer"), shared).alias("shown_filer"),
        "exchange_listed", "election", "asked.pairs", "asked.error", "lacking",
        F.col("asked.ticker").alias("fund_ticker"), F.col("asked.name").alias("fund_name"), _fact(INDEX, "fund_name").alias("index_name"), _fact(INDEX, "fund_ticker").alias("index_ticker"))


def _whole(asked: Column) -> Column:
    return (asked.ticker != "") & (asked["name"] != NO_NAME) & (asked.filer != "")


def _told(asked: Column, facts: Column) -> Column:
    """What is known after one more supporting document, and whether to stop there: only gaps are filled, pairs are added."""
    ticker, filer = (F.when(old != "", old).otherwise(F.coalesce(new, F.lit(""))) for old, new in ((asked.ticker, facts.fund_ticker), (asked.filer, facts.registrant)))
    name = F.when(asked["name"] != NO_NAME, asked["name"]).otherwise(F.coalesce(facts.fund_name, F.lit(NO_NAME)))
    new = F.struct(ticker.alias("ticker"), name.alias("name"), filer.alias("filer"), F.concat(asked.pairs, facts.pairs).alias("pairs"), F.coalesce(asked.error, facts.error).alias("error"))
    return F.struct(new.alias("asked"), _whole(new).alias("stop"))


def _proposed(filings: DataFrame, pairs: DataFrame) -> DataFrame:
    """accession_number, cik, ord and the ticker that a class takes from the pairs of its name."""
    # A filing is an accession of a filer: co-registrants file under one number.
    key = ["accession_number", "cik"]
    named = class_rows(filings, key).select(*key, "ord", t.normalize_name(shown_name(F.col("class_name"), F.col("series_name"))).alias("name"), "ticker")
    return r.unique_matches(named, pairs.withColumn("name", t.normalize_name(F.col("name"))), key).select(*key, "ord", "proposed").filter("proposed is not null")


def _rows(filings: DataFrame, has_map: bool, pairs: DataFrame | None) -> DataFrame:
    """A row for each class: tickers proposed by pairs of its name, a sole class also takes the filing's ticker. Filings without
    classes: a row for each pair, else one of what the documents, and last the index page, say."""
    name = F.when(F.col("fund_name") != NO_NAME, F.col("fund_name")).otherwise(F.col("index_name"))
    alone = F.array(F.struct(name.alias("name"), F.coalesce(F.nullif("fund_ticker", F.lit("")), "index_ticker").alias("ticker")))
    blank, none = F.lit(""), F.col("n_entries") == 0

    def entry(pair: Column) -> Column:
        own = {"ord": F.lit(-1), "class_name": pair["name"], "filed": pair.ticker, "mapped": F.lit(False), "ticker": pair.ticker, "shown": pair["name"]}
        return F.struct(*[own.get(x, blank).alias(x) for x in (("ord", *ENTRY, *OFFICIAL, "shown") if has_map else (*ENTRY, "shown"))])

    # Names are told in the list: as a column, the guards on them would have their patterns searched many times over. No list is empty;
    # an inner explode would make each list once more to see that.
    classes = F.transform("entries", lambda x: x.withField("shown", shown_name(x.class_name, x.series_name)))
    each = filings.withColumn("entries", F.when(~none, classes).otherwise(F.transform(F.when(F.size("pairs") > 0, F.col("pairs")).otherwise(alone), entry)))
    rows = class_rows(each, [x for x in filings.columns if x not in ("entries", "pairs")], F.posexplode_outer)
    if not has_map:
        rows = rows.withColumns({"filed": F.col("ticker"), "mapped": F.lit(False)})
    if pairs is not None:
        rows = rows.join(_proposed(filings, pairs), ["accession_number", "cik", "ord"], "left").withColumn("ticker", F.when((F.col("ticker") == "") & ~none, F.coalesce("proposed", blank)).otherwise(F.col("ticker"))).drop("proposed")
    own = F.when((F.col("n_entries") == 1) & (F.col("ticker") == ""), F.col("fund_ticker")).otherwise(F.col("ticker"))
    at_filing = F.when(t.is_mutual_fund_ticker(F.col("filed")), F.upper(F.trim("filed"))).otherwise(t.sanitize_ticker(F.col("filed")))
    rows = rows.withColumns({"own": own, "found": t.sanitize_ticker(own), "at_filing": at_filing})
    said = ~F.col("mapped") & (F.col("found") != NOT_LISTED)
    return rows.withColumns({
        "kind": F.when(none, "named").otherwise("class"), "identity_scope": F.when(none, "name").otherwise("class"),
        "ticker": F.when(F.col("mapped"), t.official_ticker(F.col("own"))).otherwise(F.col("found")), "ticker_at_filing": F.when(said, F.col("found")).otherwise(F.col("at_filing")),
        "ticker_source": F.when(F.col("mapped"), fixed.FROM_MAP).when(said | (F.col("at_filing") != NOT_LISTED), fixed.FROM_FILING).otherwise(fixed.FROM_NONE),
        "etf_name": F.when(none, F.col("shown")).otherwise(F.coalesce(F.nullif("shown", blank), "fund_name"))}).drop("ord", "own", "found", "at_filing", "shown", "filed", "mapped", "n_entries", "fund_ticker", "fund_name", "index_name", "index_ticker")


def _confirmed_rows(entries: DataFrame, pairs: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """Rows for pairs that the official map confirms, unless their identity is a class of the filing already."""
    found = e.identities_by_ticker(pairs.withColumn("filing", F.struct("accession_number", "cik")), ticker_map)
    found = found.withColumns({"accession_number": F.col("filing.accession_number"), "cik": F.col("filing.cik")})
    own = entries.filter("series_id <> '' and class_id <> ''").select("accession_number", "cik", t.key_text(F.col("series_id")).alias("series_id"), t.key_text(F.col("class_id")).alias("class_id"))
    ids = ["accession_number", "cik", "series_id", "class_id"]
    new = found.join(own.distinct(), ids, "left_anti")
    return new.select(
        "accession_number", "cik", F.lit("confirmed").alias("kind"), "ticker", F.col("ticker").alias("ticker_at_filing"), F.lit(fixed.FROM_FILING).alias("ticker_source"), F.col("name").alias("etf_name"),
        F.col("name").alias("class_name"), "series_id", F.when(F.col("identity_scope") == "class", F.col("name")).otherwise("").alias("series_name"), "class_id", "identity_scope")


def _about(filings: DataFrame) -> DataFrame:
    """Rows with their filing's filer and election as events have them."""
    return filings.withColumns({
        "filer": F.col("shown_filer"), "effectiveness_basis": F.coalesce("election.basis", F.lit("")), "effectiveness_days": F.col("election.days"),
        "designated_effective_date": F.coalesce("election.designated", F.lit("")), "effectiveness_label": F.coalesce("election.label", F.lit(""))}).drop("shown_filer", "election", "error", "lacking")


def guarded(rows: DataFrame) -> DataFrame:
    """Rows that may become events: with a name, no share class without a series, and a fund by name unless a class."""
    name, upper = F.trim("etf_name"), F.upper("etf_name")
    guards = ((name != "") & (F.upper(name) != NO_NAME), ~((F.col("series_id") == "") & t.is_share_class_name(F.col("class_name"))), (F.col("kind") == "class") | upper.contains("ETF") | upper.contains("FUND"))
    return rows.filter(reduce(lambda a, b: a & b, guards))


def assemble(filings: DataFrame, documents: DataFrame, base: str, ticker_map: DataFrame | None = None, more: Callable[[DataFrame], DataFrame] | None = None,
             filers: Sequence[tuple[str, str]] = fixed.FILERS) -> Assembled:
    """Events of filings (FILING, one row each; `filer` is the submissions' name) from documents (url, text, perhaps error).
    `more`, if given, reads the supporting documents (url) of filings that still lack something after the others. `filers`
    (cik, name) are shown by those names."""
    own, key = filings.select(*FILING).dropDuplicates(["accession_number", "cik"]), ["accession_number", "cik"]
    has_map = ticker_map is not None and not ticker_map.isEmpty()
    ticker_map = ticker_map if has_map else None
    links = _some(index_links(documents, base))
    links = stored(links) if links is not None else None
    asked = addressed(filings.select(*FILING), links)
    primary = [PRIMARY] if not asked.filter(F.col(at(PRIMARY)).isNotNull()).isEmpty() else []
    roles = [INDEX, *primary, *(SUPPORTING if links is not None else ())]
    facts = stored(document_facts(documents, _named(asked)))  # documents are parsed once, whatever is asked of them
    own = addressed(own, links)
    held = without_documents(with_documents(own, facts, roles), [x for x in ROLES if x not in roles])
    known = resolved(with_entries(held, ticker_map), has_map, filers, roles)
    errors = [facts]
    if more is not None and links is not None:
        supporting = own.join(known.filter("lacking").select(*key), key, "left_semi")
        found = settled(more(_named(supporting).filter(F.col("role").isin(*SUPPORTING)).select("url").distinct()))
        late = stored(document_facts(found))
        held = with_documents(held.drop(*SUPPORTING), late, SUPPORTING)
        known, errors = resolved(with_entries(held, ticker_map), has_map, filers, roles), [facts, late]
    pairs = None
    if len(roles) > 1 or has_map:  # more than one thing is asked of filings
        known = stored(known)
    if len(roles) > 1:  # pairs are of other documents than the index page
        pairs = known.select(*key, F.posexplode("pairs").alias("ord", "pair")).select(*key, "ord", "pair.*")
    rows = _about(_rows(known, has_map, pairs))
    if pairs is not None and has_map:
        of_classes = pairs.join(known.filter("n_entries > 0").select(*key), key, "left_semi")
        about = _about(known.drop("entries", "pairs", "n_entries", "fund_ticker", "fund_name", "index_name", "index_ticker"))
        rows = rows.unionByName(_confirmed_rows(class_rows(known, key), of_classes, ticker_map).join(about, key))
    if any(not x.filter("facts.error is not null").isEmpty() for x in errors):
        rows = rows.join(known.filter("error is not null").select("cik").distinct(), "cik", "left_anti")
    events = guarded(rows).withColumn("cik", t.normalize_cik(F.col("cik")))
    events = events.withColumn("vehicle", c.row_vehicle(F.col("exchange_listed")))
    events = events.withColumns({
        "identity_scope": F.when(c.uses_series_identity(F.col("vehicle")), "series").otherwise(F.col("identity_scope")),
        "event_id": t.event_id(F.col("accession_number"), F.col("class_id"), F.col("series_id"), F.col("etf_name"))})
    events = as_events(events.drop("kind", "exchange_listed")).select(*EVENT_FIELDS)
    n = events.groupBy("cik").agg(F.count(F.lit(1)).alias("row_count"))
    each = known.groupBy(t.normalize_cik(F.col("cik")).alias("cik")).agg(F.max("shown_filer").alias("filer"), F.coalesce(F.min("error"), F.lit("")).alias("error_summary"))
    statuses = each.join(n, "cik", "left").select("cik", "filer", F.when(F.col("error_summary") == "", "success").otherwise("failed").alias("status"), F.coalesce("row_count", F.lit(0)).alias("row_count"), "error_summary")
    return Assembled(events, statuses)
