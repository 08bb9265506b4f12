"""Reusable table operators: latest row by key, ordered history, forward fill, bridges, merges, top counts.

Each takes its key and order columns by name, so the same transform runs on filing events and on any other table. Ties
are broken by an order column that the caller carries (`ord`), never by input order, so that results do not depend on
partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in names]


def latest_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], always: Column | None = None) -> DataFrame:
    """The first row of each key by `order`; rows for which `always` holds are all kept. Spark limits the window's groups
    to one row before the shuffle."""
    ranked = df if always is None else df.filter(~always)
    out = ranked.withColumn("_nth", F.row_number().over(Window.partitionBy(*cols(keys)).orderBy(*order))).filter("_nth = 1").drop("_nth")
    return out if always is None else out.unionByName(df.filter(always))


def history_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], accession: str, form: str, amendments: Sequence[str], conditions: dict[str, Column] | None = None) -> DataFrame:
    """For each key: n_events (filings, by distinct non-blank accession; blank ones count each), n_amendments and history
    (forms in order, in upper case, joined by arrows). One row of a filing counts, its first in order. `conditions` adds bool_or's."""
    blank = F.coalesce(F.trim(F.col(accession)), F.lit("")) == ""
    first = F.row_number().over(Window.partitionBy(*keys, accession).orderBy(*order))
    once = df.withColumn("_once", blank | (first == 1))
    kind = F.upper(F.col(form))
    step = F.when(F.col("_once"), F.struct(*order, kind.alias("_form")))
    forms = F.filter(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["_form"]), lambda x: x != "")
    return once.groupBy(*keys).agg(
        F.count_if(F.col("_once")).alias("n_events"), F.count_if(F.col("_once") & kind.isin(*amendments)).alias("n_amendments"),
        F.array_join(forms, " -> ").alias("history"), *[F.bool_or(c).alias(name) for name, c in (conditions or {}).items()])


def fill_from_later(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], value: str, present: Column, eligible: Column) -> DataFrame:
    """filled: for eligible rows without a value, the latest value of the key among rows at or before them in `order`
    (descending time); null where there is none."""
    window = Window.partitionBy(*cols(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.first(F.when(eligible & present, F.col(value)), ignorenulls=True).over(window)
    return df.withColumn("filled", F.when(eligible & ~present, seen))


def unique_bridge(df: DataFrame, alias: Sequence[str], identity: str) -> DataFrame:
    """alias columns and identity, for aliases that lead to exactly one identity."""
    found = df.filter(F.col(identity).isNotNull()).groupBy(*alias).agg(F.min(identity).alias("_low"), F.max(identity).alias("_high"))
    return found.filter(F.col("_low") == F.col("_high")).select(*alias, F.col("_low").alias(identity))


def any_in_group(df: DataFrame, keys: Sequence[str | Column], condition: Column, name: str) -> DataFrame:
    """Whether any row of the key meets the condition, on every row."""
    return df.withColumn(name, F.coalesce(F.bool_or(condition).over(Window.partitionBy(*cols(keys))), F.lit(False)))


def least_before(df: DataFrame, keys: Sequence[str | Column], order: Column, eligible: Column, value: Column, name: str) -> DataFrame:
    """df with `name`: the least value of the key's eligible rows that come strictly before the row by `order` (a number);
    null if there is none. Rows are judged one by one, so rows of equal order or id do not share their answer."""
    window = Window.partitionBy(*cols(keys)).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.min(F.when(eligible, value)).over(window))


def merge_by_key(stored: DataFrame, live: DataFrame, key: str, ord_: str = "ord") -> DataFrame:
    """Stored and live rows, one for each key: the live row's values at the stored row's place; later rows of a side win;
    rows without a key are all kept, last. Adds `place`."""
    both = stored.withColumn("_side", F.lit(0)).unionByName(live.withColumn("_side", F.lit(1)))
    blank = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    keyed = both.filter(~blank)
    by = Window.partitionBy(key)
    last = keyed.withColumn("_nth", F.row_number().over(by.orderBy(F.desc("_side"), F.desc(ord_))))
    placed = last.withColumn("place", F.min(F.struct("_side", F.col(ord_).alias("at"))).over(by)).filter("_nth = 1").drop("_nth")
    rest = both.filter(blank).withColumn("place", F.struct((F.col("_side") + 2).alias("_side"), F.col(ord_).alias("at")))
    return placed.unionByName(rest).drop("_side")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], ord_: str) -> DataFrame:
    """Old rows replaced or joined by new ones; of new rows with equal keys the last by `ord_` stays."""
    last = new.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ord_)))).filter("_nth = 1").drop("_nth", ord_)
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def unseen(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among `seen`."""
    return df.join(seen.select(*keys), list(keys), "left_anti")


def top_counts(df: DataFrame, value: Column, fallback: str, k: int = 8) -> DataFrame:
    """name and count: the most frequent values, ties by name; blank values are the fallback."""
    name = F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(fallback)).alias("name")
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "name").limit(k)


def zero_filled(df: DataFrame, value: Column, labels: Sequence[str]) -> DataFrame:
    """place, label and count for each label in order, zero where none occurs."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "place int, label string")
    counts = df.filter(value.isin(*labels)).groupBy(value.alias("label")).agg(F.count(F.lit(1)).alias("count"))
    return dim.join(F.broadcast(counts), "label", "left").select("place", "label", F.coalesce("count", F.lit(0)).alias("count"))


def unique_matches(entries: DataFrame, pairs: DataFrame, scope: str | Sequence[str]) -> DataFrame:
    """entries with `proposed`: a ticker by name from the pairs of the same scope (a filing: one or more columns).

    entries: scope, ord, name, ticker; pairs: scope, ord, name, ticker (names normalized). Of pairs with one name the
    last ticker counts, at the first place. An equal name goes first, else the first pair whose name holds the entry's
    or is held by it. A ticker proposed twice in a scope, or in its table already, is not taken.
    """
    scope = [scope] if isinstance(scope, str) else [*scope]
    by_name = pairs.filter("name <> ''").groupBy(*scope, "name").agg(F.min("ord").alias("place"), F.max_by("ticker", "ord").alias("pair_ticker"))
    open_ = entries.filter("ticker = '' and name <> ''").select(*scope, "ord", "name")
    p = by_name.withColumnRenamed("name", "pair_name")
    near = F.col("name") == F.col("pair_name")
    held = F.col("pair_name").contains(F.col("name")) | F.col("name").contains(F.col("pair_name"))
    met = open_.join(p, scope).filter(near | held)
    first = met.groupBy(*scope, "ord").agg(F.min_by("pair_ticker", F.struct(~near, F.col("place"))).alias("proposed"))
    once = first.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*scope, "proposed"))).filter("_n = 1").drop("_n")
    taken = entries.filter("ticker <> ''").select(*scope, F.col("ticker").alias("proposed")).distinct()
    return entries.join(once.join(taken, [*scope, "proposed"], "left_anti"), [*scope, "ord"], "left")
