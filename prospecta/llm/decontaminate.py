"""Benchmark decontamination by a hash set of normalised test n-grams.

Texts are lower-cased in A-Z and cut into words; a window is `n` consecutive words of an item, an item of fewer words
is one window of its length. The windows' hashes, and the hashes of their first two words as a cheap first look, are
sets in the plan of the scan, up to SET_LIMIT windows; every training window is looked up as its document is read, and
only hits leave the row. For larger benchmarks the hashes of all training windows are joined with the benchmark's
instead. Hits are then verified word by word, and what is inside a verified window is marked for removal.

Only DataFrame functions are used. Windows that occur in many items carry their list of items, so hits do not
multiply; a passage in a third of all documents is a hit of each such row, in no common group.

Defined results: a null or empty text has no words; a document without words is clean; repeated rows (also of one
doc_id) are judged each; an empty benchmark or table gives no hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.llm.common import docs_only, lower_ascii, numbered

#: Fixed value: what separates words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of the benchmark up to which the set is part of the plan (8 bytes each), and up to which they are broadcast.
SET_LIMIT, BROADCAST_LIMIT = 20_000, 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


def _hash(at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col("words"), at + j) for j in range(k)])


def _window(at: Column, k: int) -> Column:
    return F.concat_ws(" ", *[F.get(F.col("words"), at + j) for j in range(k)])


def _starts(k: int) -> Column:
    """0 to the last start of a window of k words; empty if there is none."""
    return F.when(F.size("words") >= k, F.sequence(F.lit(0), F.size("words") - k)).otherwise(F.array().cast("array<int>"))


def windows_of(benchmark: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """window, k, hash, head (hash of its first two words) and items (sorted strings) for each distinct window."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("k", F.least(F.size("words"), F.lit(n)))
    each = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("k"))))

    def by_k(make) -> Column:
        return F.coalesce(*[F.when(F.col("k") == k, make(F.col("at"), k)) for k in range(1, n + 1)])

    each = each.select("item", "k", by_k(_window).alias("window"), by_k(_hash).alias("hash"), by_k(lambda at, k: _hash(at, min(k, 2))).alias("head"))
    return each.groupBy("window", "k", "hash", "head").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _in(value: Column, keys: list[int]) -> Column:
    """Whether a hash is in the set: a table with a byte for each slot, as one literal of the plan.

    Eight slots a key or more; a hash that only shares a slot does not survive the verification.
    """
    slots = 1 << max(6, (8 * len(keys) - 1).bit_length())
    table = bytearray(slots)
    for key in keys:
        table[key % slots] = 1
    return F.substring(F.lit(bytes(table)), (F.pmod(value, F.lit(slots)) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")


def _looked_up(k: int, heads: list[int], hashes: list[int]) -> Column:
    """The windows of k words whose hash is in the set; the hash of two words comes first."""
    at = F.filter(_starts(k), lambda i: _in(_hash(i, min(k, 2)), heads) & _in(_hash(i, k), hashes))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(k).alias("k"), _window(i, k).alias("window")))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, set_limit: int = SET_LIMIT, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, spans array<struct<at, k>> in words, items (sorted strings)."""
    wins = windows_of(benchmark, n)
    n_windows = wins.count()
    # The row number tells rows of equal doc_id apart.
    rows = docs_only(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    if n_windows <= set_limit:
        keys = wins.select("k", "hash", "head").collect()  # at most set_limit rows
        found = []
        for k in sorted({x.k for x in keys}):
            own = [x for x in keys if x.k == k]
            heads, hashes = sorted({x["head"] for x in own}), sorted({x["hash"] for x in own})
            found.append(_looked_up(k, heads, hashes))
        none = F.array().cast("array<struct<at:int,k:int,window:string>>")
        hits = rows.select("row", "doc_id", F.size("words").alias("n_words"), (reduce(F.concat, found) if found else none).alias("hits"))
        each = hits.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit"))
        each = each.select("row", "doc_id", "n_words", "hit.at", "hit.k", "hit.window")
    else:
        lengths = [x.k for x in wins.select("k").distinct().collect()]  # at most n rows
        parts = [rows.filter(F.size("words") >= k).select("row", "doc_id", "words", F.explode(_starts(k)).alias("at")).select(
            "row", "doc_id", F.size("words").alias("n_words"), "at", F.lit(k).alias("k"), _hash(F.col("at"), k).alias("hash"), _window(F.col("at"), k).alias("window"))
            for k in lengths]
        some = reduce(DataFrame.unionByName, parts).join(wins.select("hash").distinct(), "hash", "left_semi").drop("hash")
        each = some.unionByName(rows.select("row", "doc_id", F.size("words").alias("n_words")), allowMissingColumns=True)
    wins = wins.select("window", "k", "items")
    wins = F.broadcast(wins) if n_windows <= broadcast_limit else wins
    return each.join(wins, ["window", "k"], "left").groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("at", "k")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).drop("row")


def covered(spans: Column) -> Column:
    """Words inside the union of sorted spans."""
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc.end, s["at"] + s.k).alias("end"), (acc.n + F.greatest(F.lit(0), s["at"] + s.k - F.greatest(acc.end, s["at"]))).alias("n")),
        lambda acc: acc.n,
    )


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (comma-joined) and contaminated for each row of docs."""
    found = scan(docs, benchmark, n)
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.array_join("items", ",").alias("items"), (F.size("spans") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of docs, all columns, that have no hit. Each row is judged by its own text: one of equal or null doc_id with a
    hit takes no other row with it."""
    rows, number = numbered(docs)
    bad = report(rows.select(F.col(number).alias("doc_id"), "text"), benchmark, n).filter("contaminated").select(F.col("doc_id").alias(number))
    return rows.join(bad, number, "left_anti").select(*[F.col(f"`{x}`") for x in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id and the words outside hits, joined by spaces, for documents with a hit; doc_id must be unique."""
    found = scan(docs, benchmark, n).filter(F.size("spans") > 0).select("doc_id", "spans")
    both = docs_only(docs).join(found, "doc_id").select("doc_id", words(F.col("text")).alias("words"), "spans")
    inside = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s.k - 1))))
    keep = F.array_except(F.sequence(F.lit(0), F.size("words") - 1), inside)
    return both.select("doc_id", F.array_join(F.transform(keep, lambda i: F.get(F.col("words"), i)), " ").alias("text"))
