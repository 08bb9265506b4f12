"""Line dedup by an exact set-similarity join over all lines of all documents.

A line is the set of its tokens, word shingles of `k` words; with k = 1 the set of its words. Lines with equal sets are
one class (digest of the set), however short: all but its first line, in the order of (doc_id, line), are removed, and
the first stands for them. Of the classes, two with 100 |A and B| >= percent |A or B| are matched: tokens are ordered by
rarity, then by hash, and a pair shares one of its rarest tokens (prefix filter); such pairs are tested by size (length
filter), by what can still follow a shared token in both (positional filter) and by parities of hashed kinds of tokens
(sets that differ in d tokens differ in d of the 128 parities at most), then by their full sets. A line that matches any
earlier line is removed. Sets so small that one token more or less is below `percent` have matches in their own class
alone.

Rarity comes from counts of all documents' tokens in COUNT_SLOTS hashed slots: a table of fixed size in the plan. It only
decides how much is compared: frequent words stand out of any slot's noise, and among the others any order gives the same
result.

So that a group of near lines does not become all its pairs, lines are verified in two rounds: first against one line,
the earliest of the lists that most of its rare tokens agree on; only lines that are left then meet the earlier lines of
their lists. No list or partner is capped.

Only DataFrame functions are used. Tokens are 64-bit hashes. Only digests, rare tokens, and the texts of lines that
are verified, are moved; a bit table of at most MARK_WORDS rows (broadcast) keeps most other texts where they are.

A document's row is its doc_id where those are unique, from 0 and below MOST_ROWS, which no other split of the table into
tasks changes; else the documents are sorted by doc_id (null first) and text, numbered without gaps and written once. A
line's id is one number of its row and its line.

Defined results: a null or empty text is one line without words; lines of fewer than `k` words (with k = 1: without
words) are kept and match nothing; repeated rows are documents of their own, the later a copy; rows of one doc_id are
ordered by text; null doc_ids come first; a text of any length is one row of which only lines are held together; an
empty table gives an empty result; other columns are ignored (the text form keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from prospecta.llm.common import bucketed, release, written

#: Fixed value: what separates words inside a line.
BETWEEN = r"[\x20\x09-\x0D]+"
#: The same as characters; a space, one of those that end no line, and what must be made a space before splitting.
BLANKS = "\t\x0b\x0c\r"
#: Slots of the token counts, which are an array in the plan.
COUNT_SLOTS = 1 << 16
#: Words of 64 bits of each table that marks what is verified.
MARK_WORDS = 1 << 17
HASH_BITS = 56
#: Bits of a line's number in its id; the rest is the row's, so ids are ordered as (row, line).
LINE_BITS = 31
#: Rows from 0 to this are used as they are.
MOST_ROWS = 1 << 32
#: Lists are made in so many turns: what one has exchanged is let go before the next, so it does not lie on disk at once.
LIST_PARTS = 2


def numbered(docs: DataFrame) -> DataFrame:
    """row (a number in the order of doc_id, from 0 and below MOST_ROWS), text and doc (all columns of docs) of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*docs.columns).alias("doc"))
    if rows.groupBy("row").count().filter(F.col("row").isNull() | (F.col("count") > 1) | ~F.col("row").between(0, MOST_ROWS - 1)).isEmpty():
        return rows
    # Numbers by task have gaps between the tasks, which are closed by how many rows the tasks before have.
    ordered = written(rows.orderBy(F.asc_nulls_first("row"), "text").withColumn("at", F.monotonically_increasing_id()).drop("row"), "numbered")
    task = F.shiftright("at", 33)
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row for each task
    row = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("task", task).join(F.broadcast(starts), "task").select(row.alias("row"), "text", "doc")


def moved(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: joined by exchange at every size, as the driver would otherwise hold one table
    more for each join of a small input."""
    return side.hint("merge")


def row_of(line: Column) -> Column:
    """The row of a line's id."""
    return F.shiftright(line, LINE_BITS)


def lines_of(rows: DataFrame) -> DataFrame:
    """id and text of all lines."""
    lines = rows.select("row", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select(F.shiftleft("row", LINE_BITS).bitwiseOR(F.col("line").cast("long")).alias("id"), "text")


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value computed once: a function binds it, and no rewriting of the plan can repeat it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _spaced(text: Column) -> Column:
    """text with a space for each of BLANKS. Translating goes letter by letter, so only texts that have some are translated."""
    odd = text.contains(BLANKS[0]) | text.contains(BLANKS[1]) | text.contains(BLANKS[2]) | text.contains(BLANKS[3])
    return F.when(odd, F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(text)


def words_of(text: Column) -> Column:
    """Words of a line. A split at one space needs no pattern, so other blanks are made spaces first where there are any."""
    return F.array_remove(F.split(_spaced(text), " "), "")


def tokens_of(text: Column, k: int) -> Column:
    """Distinct hash of each word; of each shingle of k words, by the hash of its words' hashes."""
    if k == 1:
        hashes = F.transform(F.split(_spaced(text), " "), lambda w: F.xxhash64(w))
        return F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))  # what is between two blanks is no word

    def grams(hashes: Column) -> Column:
        starts = F.when(F.size(hashes) >= k, F.sequence(F.lit(0), F.size(hashes) - k)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])))

    return _bound(F.transform(words_of(text), lambda w: F.xxhash64(w)), grams)


def _place(token: Column) -> Column:
    """Slot of a token (its hash)."""
    return token.bitwiseAND(F.lit(COUNT_SLOTS - 1)).cast("int")


def _slot(word: Column) -> Column:
    return _place(F.xxhash64(word))


def _levels(rows: DataFrame, k: int) -> Column:
    """Below 128 for each slot of tokens: the logarithm of the tokens' count over all documents. An array literal. Words are
    counted as often as they occur, with no set made for it."""
    if k == 1:  # split line by line, as short arrays are made faster than long ones
        words = lines_of(rows).select(F.explode(F.split(_spaced(F.col("text")), " ")).alias("word")).filter("word <> ''")
        slots = words.select(_slot(F.col("word")).alias("slot"))
    else:
        slots = lines_of(rows).select(F.explode(tokens_of(F.col("text"), k)).alias("token")).select(_place(F.col("token")).alias("slot"))
    counts = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    levels = [0] * COUNT_SLOTS
    for slot, n in counts.toPandas().itertuples(index=False):  # COUNT_SLOTS rows at most
        levels[slot] = min(127, int(4 * math.log2(n)))
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")


def _sets(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Written id, n, digest, parities and rare (the rarest tokens, if other sets can match; 32 bits are enough, as all
    that share one are tested) of all lines."""
    levels, mask = _levels(rows, k), F.lit((1 << HASH_BITS) - 1)

    def ranked(token: Column) -> Column:
        level = F.coalesce(F.get(levels, _place(token)), F.lit(0).cast("long"))  # never null, which sorts much faster
        return F.shiftleft(level, HASH_BITS).bitwiseOR(token.bitwiseAND(mask))

    def folded(bits: list[int], own: Column) -> Column:
        """The bits of all tokens' kinds, by their last 7 bits, XORed."""
        table = F.array(*[F.lit(x).cast("long") for x in bits])
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(F.get(table, t.bitwiseAND(F.lit(127)).cast("int"))))

    signed = [(1 << i) - (i == 63) * (1 << 64) for i in range(64)]
    n, own = F.col("n"), F.col("own")
    length = n - F.ceil(n * percent / 100).cast("int") + 1
    rare = F.when(100 * n >= percent * (n + 1), F.transform(F.slice(own, F.lit(1), length), lambda t: F.hash(t)))
    # Each step uses the one before more than once, so it is made once; sets and sorting stay outside of functions of elements, which are slow.
    tokens = lines_of(rows).select("id", tokens_of(F.col("text"), k).alias("tokens"))
    sorted_tokens = tokens.select("id", F.size("tokens").alias("n"), F.sort_array(F.transform("tokens", ranked)).alias("own"))
    sets = sorted_tokens.select("id", "n", F.xxhash64("own").alias("digest"), folded(signed * 2, own).alias("parity"), folded([0] * 64 + signed, own).alias("odd"), rare.alias("rare"))
    return written(sets, "sets", ["id", "digest", "parity", "odd"])


def _copies(sets: DataFrame) -> DataFrame:
    """Written id of lines whose set an earlier line has. Both sides are exchanged by digest, so the cluster can split a
    line that is very common."""
    key = ["digest", "parity", "n"]
    several = sets.groupBy(*key).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    several = written(several.select(*key, "first"), "classes")
    return written(sets.select(*key, "id").join(moved(several), key).filter("id <> first").select("id"), "copies")


def _may_match(a: Callable[[str], Column], b: Callable[[str], Column], percent: int) -> Column:
    """Length, parity and positional filters. `odd` has the parities of the kinds of odd number, `parity` all, folded."""
    n_a, n_b = a("n"), b("n")
    needed = percent * (n_a + n_b)
    odd, even = a("odd").bitwiseXOR(b("odd")), a("parity").bitwiseXOR(b("parity")).bitwiseXOR(a("odd")).bitwiseXOR(b("odd"))
    near = (100 + percent) * (F.bit_count(odd) + F.bit_count(even)) <= (100 - percent) * (n_a + n_b)
    follow = ((100 + percent) * (n_a - a("pos")) >= needed) & ((100 + percent) * (n_b - b("pos")) >= needed)
    return (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a) & follow & near


def _flagged(table: DataFrame, keys: DataFrame, flag: str, how: str = "left") -> DataFrame:
    """table with a flag: whether a row's key may be in keys (all columns of keys are the key). Nothing of the table is moved.
    A key has a bit in each of two tables, so few others have both. Joined how: inner, some rows that are not in keys are left out."""
    seen, on = table, F.lit(True)
    for i in (0, 1):
        slot = F.pmod(F.xxhash64(F.lit(i), *keys.columns), F.lit(64 * MARK_WORDS))
        word, bit = F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")
        words = keys.groupBy(word.alias(f"__word{i}")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(f"__bits{i}"))
        seen = seen.withColumn(f"__word{i}", word).join(F.broadcast(words), f"__word{i}", how)  # MARK_WORDS rows at most
        on = on & F.coalesce(F.getbit(f"__bits{i}", bit) == 1, F.lit(False))
    return seen.select(*table.columns, on.alias(flag))


def _marked(table: DataFrame, keys: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of table whose key may be in keys: most others go without being moved. Not inside: the rest, whose key is not in keys."""
    seen = _flagged(table, keys, "__may", "inner" if inside else "left")
    return seen.filter("__may" if inside else "not __may").select(*table.columns)


def _without(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of table whose key is not in keys; only those of which the bit table is not sure are moved."""
    # An outer join, as Spark would move an anti join below the bit table's.
    known = keys.withColumn("__known", F.lit(True))
    unsure = _marked(table, keys).join(moved(known), keys.columns, "left").filter("__known is null").select(*table.columns)
    return _marked(table, keys, inside=False).unionAll(unsure)


def _verified(rows: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """id of the later line of each pair (a, b) of ids that has the similarity."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    lines = _marked(lines_of(_marked(rows.select("row", "text"), ids.select(row_of(F.col("id")).alias("row")))), ids)
    own = lines.join(moved(ids), "id")

    def side(x: str) -> DataFrame:
        return own.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))

    both = pairs.join(moved(side("a")), "a").join(moved(side("b")), "b")

    def alike(sets: Column) -> Column:
        a, b = F.get(sets, F.lit(0)), F.get(sets, F.lit(1))
        return _bound(F.size(F.array_intersect(a, b)), lambda common: 100 * common >= percent * (F.size(a) + F.size(b) - common))

    same = both.filter(_bound(F.array(tokens_of(F.col("text_a"), k), tokens_of(F.col("text_b"), k)), alike))
    return same.select(F.greatest("a", "b").alias("id")).distinct()


def removed_lines(rows: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """id of every line of numbered rows with an earlier match; sets as _sets makes them."""
    sets = sets.filter("n > 0")
    copies = _copies(sets)
    release(rows.sparkSession)
    some = sets.filter("rare is not null").select("id", "n", "parity", "odd", "rare")
    alone = _without(some, copies)
    own = ("id", "n", "pos", "parity", "odd")

    def entries_of(lines: DataFrame) -> DataFrame:
        return lines.select("id", "n", "parity", "odd", F.posexplode("rare").alias("pos", "entry"))

    group = Window.partitionBy("entry")  # by the entry alone, an int, which is sorted several times faster than two columns
    led = (F.col("id") != F.col("id_lead")) & _may_match(F.col, lambda x: F.col(f"{x}_lead"), percent)

    def lists(part: int) -> DataFrame:
        some = entries_of(alone).filter(F.pmod("entry", F.lit(LIST_PARTS)) == part)
        # Column by column: a struct would be made of each row, and sorted with it.
        some = some.select("entry", *own, *[F.min_by(x, "id").over(group).alias(f"{x}_lead") for x in own], F.count(F.lit(1)).over(group).alias("many"))
        return some.filter("many > 1").select("entry", *own, F.when(led, F.col("id_lead")).alias("lead"))

    entries = bucketed((lists(part) for part in range(LIST_PARTS)), "entries", "entry")
    votes = entries.filter("lead is not null").groupBy("id", "lead").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("id").agg(F.max(F.struct("votes", "lead")).alias("best"))
    first = written(best.select(F.col("id").alias("a"), F.col("best.lead").alias("b")), "first")
    out = written(_verified(rows, first, k, percent), "removed")
    release(rows.sparkSession)
    # Each line that is left meets the earlier lines of its lists. Of a pair, the smaller set shares a token within a shorter
    # prefix (it has 2 t / (1 + t) of itself in common), so only such entries are met with all others; of equal sets both do.
    # Most lines that are not left are told by the bit table, where the entries lie; the entries of those of which it is not
    # sure are made anew and meet the earlier lines.
    known = out.withColumn("known", F.lit(True))
    unsure = _without(_marked(some, out).join(moved(known), "id", "left").filter("known is null").drop("known"), copies)
    unsure = written(entries_of(unsure), "unsure")

    def side(x: str, some: DataFrame) -> DataFrame:
        return some.select(*[F.col(y).alias(f"{y}_{x}") for y in some.columns])

    def short(x: str) -> Column:
        n = F.col(f"n_{x}")
        return F.col(f"pos_{x}") <= n - F.ceil(n * 2 * percent / (100 + percent))

    def met(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
        near = _may_match(lambda x: F.col(f"{x}_a"), lambda x: F.col(f"{x}_b"), percent)
        return a.join(b, (F.col("entry_a") == F.col("entry_b")) & near & on).select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b"))

    n_a, n_b, id_a, id_b = (F.col(x) for x in ("n_a", "n_b", "id_a", "id_b"))
    flagged = _flagged(entries.select("entry", *own), out, "gone")
    smaller = (n_a < n_b) | ((n_a == n_b) & (id_a < id_b) & F.col("short_b"))
    left = ~F.when(id_a < id_b, F.col("gone_b")).otherwise(F.col("gone_a"))
    pairs = met(side("a", flagged).filter(short("a")), side("b", flagged).withColumn("short_b", short("b")), smaller & left)
    others = side("b", _marked(entries.select("entry", *own), unsure.select("entry")))
    near = (id_a > id_b) & ((n_a > n_b) | short("a")) & ((n_a < n_b) | short("b"))
    pairs = pairs.unionAll(met(side("a", unsure.select("entry", *own)), others, near)).distinct()
    tested = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    second = written(pairs.join(moved(tested), ["a", "b"], "left_anti"), "second")
    near_lines = out.unionAll(_verified(rows, second, k, percent)).distinct()
    return copies.unionAll(near_lines)


def _by_row(rows: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    lines = removed_lines(rows, sets, percent, k).select(row_of(F.col("id")).alias("row"), F.col("id").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int").alias("line"))
    return lines.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("removed_lines"))  # a text's lines


def dedup_report(docs: DataFrame, percent: int = 80, k: int = 1) -> DataFrame:
    """doc_id, n_lines, n_removed and removed_lines (sorted line numbers from 0) for each row of docs."""
    rows = numbered(docs)
    sets = _sets(rows, k, percent)
    counted = sets.groupBy(row_of(F.col("id")).alias("row")).agg(F.count(F.lit(1)).alias("n_lines"))
    none = F.array().cast("array<int>")
    known = rows.select("row", F.col("doc.doc_id").alias("doc_id")).join(moved(counted), "row")
    return known.join(moved(_by_row(rows, sets, percent, k)), "row", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed_lines", none).alias("removed_lines"))


def without_repeated_lines(docs: DataFrame, percent: int = 80, k: int = 1, drop_emptied: bool = False) -> DataFrame:
    """docs, all columns, with the removed lines cut from the text. Texts of which no line is left are empty; drop_emptied
    drops texts that lost lines and have no word left."""
    rows = numbered(docs)
    joined = rows.select("row", "doc").join(moved(_by_row(rows, _sets(rows, k, percent), percent, k)), "row", "left")
    kept = F.filter(F.split("doc.text", "\n"), lambda x, i: ~F.array_contains("removed_lines", i))
    if drop_emptied:
        joined = joined.filter(F.col("removed_lines").isNull() | F.exists(kept, lambda x: F.size(words_of(x)) > 0))
    text = F.when(F.col("removed_lines").isNull(), F.col("doc.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(x) if x == "text" else F.col("doc").getField(x).alias(x) for x in docs.columns])
