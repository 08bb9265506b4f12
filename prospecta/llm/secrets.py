"""Secret scans with corpus-wide ownership frequency.

Base kinds are found by patterns in every whole text. Candidates are the base matches and all long mixed tokens. Their
hashes are aggregated over the whole corpus by distinct owners and repositories (one row for each hash, owner and
repository first, so that a value in a third of all rows is summed before it is moved); a value of at most `max_owners`
owners that looks live (letters, digits, enough different characters) is an owner-specific credential, one of more is
a widely copied example. The verdict is by owners alone: an owner may use a value in many repositories of their own. The
number of repositories (pairs of owner and repository) is returned by row: `most_repositories`, the most that any live-looking
owner-specific value of the row is in, 0 without one. Owner-specific long tokens are added to the spans as kind `owned`; base spans stay.

Only DataFrame functions are used. Positions come from the pieces between matches: split() and regexp_extract_all()
walk the same leftmost matches. Texts are read once; what is moved has spans and hashes alone.

Defined results: a null or empty text has no spans; a null owner or repository is one of its own; repeated rows are
reported each and count once by owner; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.llm.common import BLOCK, block_starts, bound, written

#: Kinds in the order of the digest, their patterns, and how long a match (or its group) must be.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
#: Long mixed tokens, candidates of kind `owned`.
LONG = r"[A-Za-z0-9+/_=-]{20,}"
#: Owners that a value may have and still be specific, and the different characters of a live-looking one.
MAX_OWNERS, LEAST_DISTINCT = 2, 8
KINDS = ("assign", "access", "hex", "owned")
SPAN = "struct<start:bigint,order:int,end:bigint,value:string>"


def _block(pieces: Column, at: Column, order: int) -> Column:
    """array<SPAN> of the matches in a block that begins at a place."""
    return F.aggregate(
        pieces, F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda acc, x: F.struct((acc.at + x.n).alias("at"), F.array_append(acc.out, F.struct(
            (acc.at + F.length(x.p)).alias("start"), F.lit(order).alias("order"), (acc.at + x.n).alias("end"), x.m.alias("value"))).alias("out")),
        lambda acc: acc.out)


def _matches(text: Column, pattern: str, order: int, maybe: Column) -> Column:
    """array<SPAN> of all matches in code points; `maybe` is a cheap test that all texts with a match pass."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m"), (F.length(p) + F.length(m)).alias("n")))
    spans = bound(both, lambda all_: bound(block_starts(all_), lambda starts: F.flatten(F.transform(starts, lambda at, i: _block(F.slice(all_, i * BLOCK + 1, BLOCK), at, order)))))
    return F.when(maybe & text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _value(span: Column) -> Column:
    """What of a match is the credential: the assigned value, else all of it."""
    return F.when(span.order == 0, F.regexp_extract(span.value, ASSIGN, 2)).otherwise(span.value)


def _live(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT)


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """row, doc_id, owner, repository, base and long array<SPAN, value hashed>; texts are dropped here."""
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.coalesce(text, F.lit("")).alias("text"))
    assign = F.filter(_matches(text, ASSIGN, 0, text.contains("=") | text.contains(":")), lambda s: F.length(_value(s)) >= ASSIGN_CHARS)
    access = F.filter(_matches(text, ACCESS, 1, text.contains("AKIA")), lambda s: F.length(s.value) >= ACCESS_CHARS)
    base = F.array_sort(F.concat(assign, access, _matches(text, HEX, 2, F.lit(True))))
    long = F.filter(_matches(text, LONG, 3, F.lit(True)), lambda s: _live(s.value))

    def hashed(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.order.alias("order"), s.end.alias("end"), F.sha2(_value(s), 256).alias("hash"), _live(_value(s)).alias("live")))

    return rows.select("row", "doc_id", "owner", "repository", hashed(base).alias("base"), hashed(long).alias("long"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories and n for each candidate value of the corpus."""
    each = found.select("owner", "repository", F.explode(F.concat("base", "long")).alias("s"))
    pairs = each.groupBy("s.hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owner = F.struct(F.col("owner"))  # a null owner counts as one
    return pairs.groupBy("hash").agg(F.countDistinct(owner).alias("n_owners"), F.count(F.lit(1)).alias("n_repositories"), F.sum("n").alias("n"))


def scan(docs: DataFrame, owner: Column, repository: Column, max_owners: int = MAX_OWNERS) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in digest order), n_specific, n_copied and most_repositories for
    each row."""
    found = written(candidates(docs, owner, repository), "secrets")
    corpus = written(ownership(found), "ownership")
    # Both sides are exchanged by hash, so the cluster can split a value that is in very many rows.
    each = found.select("row", F.explode(F.concat("base", "long")).alias("s")).select("row", "s.*")
    judged = each.join(corpus.select("hash", "n_repositories", (F.col("n_owners") <= max_owners).alias("specific")), "hash")
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("order") == 3) & F.col("specific"), F.struct("start", "order", "end"))).alias("owned"),
        F.count_distinct(F.when(F.col("specific") & F.col("live"), F.col("hash"))).alias("n_specific"),
        F.count_distinct(F.when(~F.col("specific"), F.col("hash"))).alias("n_copied"),
        F.max(F.when(F.col("specific") & F.col("live"), F.col("n_repositories"))).alias("most_repositories"),
    )
    all_rows = found.select("row", "doc_id", F.transform("base", lambda s: F.struct(s.start.alias("start"), s.order.alias("order"), s.end.alias("end"))).alias("base"))
    joined = all_rows.join(by_row, "row", "left")

    def named(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s.order + 1).alias("kind"), s.start.alias("start"), s.end.alias("end")))

    return joined.select(
        "doc_id", named(F.col("base")).alias("base"),
        named(F.array_sort(F.concat("base", F.coalesce("owned", F.array().cast("array<struct<start:bigint,order:int,end:bigint>>"))))).alias("spans"),
        F.coalesce("n_specific", F.lit(0)).alias("n_specific"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("most_repositories", F.lit(0)).cast("long").alias("most_repositories"))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
