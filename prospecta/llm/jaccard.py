"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles, as 64-bit hashes. Equal sets are one class (digest of the set) with the
least doc_id as its representative; only representatives are compared. The shingles of a set are ordered by rarity, by
a sketch of corpus-wide counts in 2 ** SKETCH_BITS buckets (its size does not depend on the corpus) and the hash. With
size s and at least o = ceil(t s) shingles in common with any partner, two linked sets share l of their first
s - o + l shingles. Each document takes the l that makes its estimated cost least (entries to scan, by the sketch, and
candidates to verify, which need l shared entries): a costly document reads a longer prefix and needs more matches.
Of a pair, the smaller set must show its shared entries in a shorter prefix yet, and what follows the prefixes bounds what
the pair can still have in common: it is verified if it shares as many entries as its overlap needs beyond the longer
rest.

So that a group of near copies does not become all its pairs, candidates come in two rounds. First, each document is
verified against one partner: lists are led by the document that shares most of its entries (in a group of near copies
the original has the fewest of its own), and the partner is what leads most of the document's lists; trees of verified
links are contracted. Then pairs that share entries but are in different trees are counted in full and verified, and
linked trees are joined. No list, candidate or partner is capped; all links between different sets are found up to the
connection that they make. Documents that share much but are not alike enough (variants of one text) would be all pairs of
a list: so each set has the parities of SIGNATURE_WORDS * 64 kinds of its shingles, and pairs that differ in more parities
than alike sets can are left out where the lists meet.

Defined results: a null or empty text, or one without words, has no shingles and is its own component; a text of fewer
words than a shingle is one shingle; repeated rows link as copies; rows of one doc_id are documents of their own, each
with its component; rows without doc_id link with nothing and have a null component; a text of any length is one set in
one task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prospecta.llm.common import docs_only, mixed, slices, strings, words_of, written
from prospecta.llm.components import components, roots
from prospecta.llm.marks import marked, marks, maybe

#: Buckets of the shingle counts, and counts in one row of a partial sketch.
SKETCH_BITS, SKETCH_ROW = 20, 1 << 14
#: Most matches that a prefix may ask for, and the cost of verifying a candidate by shingle against an entry's.
MOST_MATCHES, VERIFY_COST = 8, 0.05
#: Matches that the smaller set's short prefix is lengthened for, at most.
SHORT_MATCHES = 2
#: Words of 64 parities in a signature: at this size it tells variants of up to some 1,000 shingles apart.
SIGNATURE_WORDS = 8
SIGNATURE = [f"s{i}" for i in range(SIGNATURE_WORDS)]
#: Partners of one document that are verified in one group.
GROUP = 256


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    codes, counts, distinct = words_of(pc.ascii_lower(texts))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in strings(distinct)), np.uint64, len(distinct))
    words, edges = hashes[codes], np.concatenate([[0], np.cumsum(counts)])

    def combined(parts: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(parts[0]), len(parts), np.uint64)
        for part in parts:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + part)
        return h

    n = len(words)
    grams = combined([words[j:n - k + 1 + j] for j in range(k)]) if n >= k else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        else:
            out.append(combined([words[i:i + 1] for i in range(a, b)]) if b > a else np.zeros(0, np.uint64))
    return out


def least_common(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def signatures(sets: list[np.ndarray]) -> list[pa.Array]:
    """Columns SIGNATURE of some sets: whether each kind of shingle is in a set an odd number of times."""
    kinds = 64 * SIGNATURE_WORDS
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = (np.concatenate([*sets, np.zeros(0, np.uint64)]) % np.uint64(kinds)).astype(np.int64)
    odd = np.bincount(of * kinds + flat, minlength=len(sets) * kinds).astype(np.uint8) & 1
    words = np.packbits(odd.reshape(len(sets), SIGNATURE_WORDS, 64), axis=2).view(np.int64).reshape(len(sets), SIGNATURE_WORDS)
    return [pa.array(np.ascontiguousarray(words[:, i])) for i in range(SIGNATURE_WORDS)]


def _classes(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Written (doc_id, n, digest, signature) of all documents, and written partial sketches (block, counts)."""
    longs = ", ".join(f"{x} long" for x in SIGNATURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        seen: set[bytes] = set()
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), k)
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            new = [x for x, d in zip(sets, digests, strict=True) if d not in seen]
            if len(seen) < 1 << 18:
                seen.update(digests)
            if new:
                counts += np.bincount((np.concatenate(new) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            none = pa.nulls(len(sets), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(digests, pa.binary()), none, pa.nulls(len(sets), pa.binary()), *signatures(sets)],
                names=["doc_id", "n", "digest", "block", "counts", *SIGNATURE])
        rows = [(i, counts[i * SKETCH_ROW:(i + 1) * SKETCH_ROW]) for i in range(len(counts) // SKETCH_ROW)]
        rows = [(i, x.astype("<u4").tobytes()) for i, x in rows if x.any()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary()),
                 pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary()), *[pa.nulls(len(rows), pa.int64())] * SIGNATURE_WORDS],
                names=["doc_id", "n", "digest", "block", "counts", *SIGNATURE])

    both = written(docs.mapInArrow(run, f"doc_id long, n long, digest binary, block int, counts binary, {longs}"), "sets")
    return both.filter("block is null").select("doc_id", "n", "digest", *SIGNATURE), both.filter("block is not null").select("block", "counts")


def _sketch(parts: DataFrame) -> np.ndarray:
    """The sum of all partial sketches: 2 ** SKETCH_BITS counts, whatever the input's size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(raw, "<u4").astype(np.int64)
                total[block] = total[block] + own if block in total else own
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in parts.repartition("block").mapInArrow(add, "block int, counts binary").collect():
        out[row.block * SKETCH_ROW:(row.block + 1) * SKETCH_ROW] += np.frombuffer(row.counts, "<i8")
    return out


def prefix(own: np.ndarray, counts: np.ndarray, load: float, percent: int) -> tuple[np.ndarray, int]:
    """(the rarest shingles of a set, as many as its cheapest number of matches asks for; that number)."""
    size = len(own)
    least = least_common(size, percent)
    most = min(MOST_MATCHES, least)
    seen = counts[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((own, seen))[:size - least + most]
    entries = np.cumsum(np.maximum(seen[order] - load, 0.0))[size - least:]
    matches = np.arange(1, most + 1)
    best = int(np.argmin(entries + entries / matches * (VERIFY_COST * size))) + 1
    return own[order[:size - least + best]], best


def _prefixes(docs: DataFrame, counts: np.ndarray, k: int, percent: int, copies: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, n, matches and entries of the first document of each class. Documents outside the bit table of copies are
    first for sure, and nothing of them is moved; the others are asked for among the classes."""
    spark = docs.sparkSession
    shared, load, table = spark.sparkContext.broadcast(counts.astype(np.uint32)), float(counts.mean()), marks(copies)

    def some(batches: Iterator[pa.RecordBatch], unsure: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, own = _with_id(batch)
            yield batch.filter(pa.array(maybe(table, own) == unsure))

    def run(batches: Iterator[pa.RecordBatch], unsure: bool) -> Iterator[pa.RecordBatch]:
        seen = shared.value.astype(np.int64)
        for batch in slices(some(batches, unsure)):
            sets = shingle_sets(batch.column("text"), k)
            found = [prefix(x, seen, load, percent) if len(x) else (x, 1) for x in sets]
            offsets = pa.array(np.cumsum([0, *(len(x) for x, _ in found)]), pa.int32())
            flat = pa.array(np.concatenate([x for x, _ in found]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(map(len, sets)), pa.int32()), pa.array([m for _, m in found], pa.int32()), pa.ListArray.from_arrays(offsets, flat)],
                names=["doc_id", "n", "matches", "entries"])

    sure, unsure = (docs.mapInArrow(partial(run, unsure=x), "doc_id long, n int, matches int, entries array<long>") for x in (False, True))
    return sure.unionAll(unsure.join(classes.select(F.col("first").alias("doc_id")), "doc_id", "left_semi"))


def _with_id(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    batch = batch.filter(pc.is_valid(batch.column("doc_id")))
    return batch, np.asarray(batch.column("doc_id"))


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the similarity. A document a meets its partners in groups of GROUP,
    sorted so that it comes first; a task holds two sets at a time."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    salted = pairs.join(written(sizes, "sizes"), "a").select("a", "b", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("salt"))
    asked = written(salted, "asked")
    wanted = asked.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("side")).unionAll(
        asked.select(F.col("a").alias("doc_id"), "a", "salt", F.lit(0).alias("side")).distinct())
    texts = marked(docs, wanted.select("doc_id"), _with_id)
    rows = texts.join(wanted, "doc_id").repartition("a", "salt").sortWithinPartitions("a", "salt", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, None
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), k)
            a, b = [], []
            columns = [batch.column(x).to_pylist() for x in ("a", "salt", "side", "doc_id")]
            for own, group, salt, side, doc in zip(sets, *columns, strict=True):
                if side == 0:
                    key, first = (group, salt), own
                elif key == (group, salt):
                    common = len(np.intersect1d(first, own, assume_unique=True))
                    if 100 * common >= percent * (len(first) + len(own) - common):
                        a.append(group)
                        b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _links(docs: DataFrame, postings: DataFrame, sets: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the trees of the first round, and verified pairs between trees."""
    close = 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")
    led = postings.filter((F.col("doc_id") != F.col("lead.doc_id")) & close)
    leads = led.groupBy("doc_id", F.col("lead.doc_id").alias("lead")).agg(F.count(F.lit(1)).alias("shared"))
    first = written(leads.groupBy("doc_id").agg(F.max(F.struct("shared", (-F.col("lead")).alias("lead"))).alias("best")).select((-F.col("best.lead")).alias("a"), F.col("doc_id").alias("b")), "first")
    trees = roots(verified(docs, first, k, percent).select(F.col("b").alias("node"), F.col("a").alias("parent")))
    placed = written(postings.join(trees.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("entry", "doc_id", "n", "matches", "short", F.coalesce("root", "doc_id").alias("tree")), "placed")
    mixed_lists = placed.groupBy("entry").agg(F.min("tree").alias("low"), F.max("tree").alias("high")).filter("low < high").select("entry")
    signed = sets.select("doc_id", *SIGNATURE)
    open_ = written(placed.join(mixed_lists, "entry", "left_semi").join(signed, "doc_id"), "open")

    def side(x: str, rows: DataFrame) -> DataFrame:
        return rows.select("entry", F.col("doc_id").alias(x), *[F.col(y).alias(f"{y}_{x}") for y in ("tree", "n", "matches", *SIGNATURE)])

    met = side("a", open_.filter("short")).join(side("b", open_), "entry")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    least = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    unlike = sum((F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in SIGNATURE[1:]), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
    met = met.filter((F.col("tree_a") != F.col("tree_b")) & smaller & (100 * F.col("n_a") >= percent * F.col("n_b")) & (unlike <= F.col("n_a") + F.col("n_b") - 2 * least))
    counted = met.groupBy("a", "b", "n_a", "n_b", "matches_a", "matches_b").agg(F.count(F.lit(1)).alias("shared"))
    # What follows the prefixes: of the smaller set's short one, of the larger set's long one.
    rest = F.greatest(F.ceil(F.col("n_a") * 2 * percent / (100 + percent)) - F.least("matches_a", F.lit(SHORT_MATCHES)), F.ceil(F.col("n_b") * percent / 100) - F.col("matches_b"))
    pairs = counted.filter(F.col("shared") >= least - rest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return trees, verified(docs, written(pairs.join(tested, ["a", "b"], "left_anti"), "second"), k, percent)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every document; links are pairs with
    100 |A and B| >= percent |A or B|."""
    docs = docs_only(docs)
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _components(docs, k, percent)
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    own = written(_components(rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text").filter("doc_id is not null"), k, percent), "by-row")
    known = rows.select(F.col("row"), F.col("doc_id").alias("id")).join(own.withColumnRenamed("doc_id", "row"), "row")
    least = known.groupBy("component_id").agg(F.min("id").alias("least"))
    none = _components(rows.filter("doc_id is null").select("doc_id", "text"), k, percent)
    return known.join(least, "component_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id")).unionAll(none)


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    all_sets, parts = _classes(docs, k)
    classes = written(all_sets.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first")), "classes")
    copies = all_sets.filter("n > 0 and doc_id is not null").select("doc_id").join(classes.select(F.col("first").alias("doc_id")), "doc_id", "left_anti")
    first = _prefixes(docs, _sketch(parts), k, percent, copies, classes)
    # Of a pair, the smaller set shares its entries within a shorter prefix: it has 2 t / (1 + t) of itself in common.
    short = F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + F.least("matches", F.lit(SHORT_MATCHES))
    by_entry = first.select(F.posexplode("entries").alias("pos", "entry"), "doc_id", "n", "matches")
    by_entry = by_entry.withColumn("short", F.col("pos") < short).drop("pos")
    own = Window.partitionBy("entry")
    lead = F.first(F.struct("doc_id", "n")).over(own.orderBy(F.desc("score"), "doc_id"))
    several = by_entry.withColumn("many", F.count(F.lit(1)).over(own)).filter("many > 1").drop("many")
    scored = written(several, "several").withColumn("score", F.count(F.lit(1)).over(Window.partitionBy("doc_id")) / F.col("n"))
    postings = scored.withColumn("lead", lead).drop("score")
    trees, pairs = _links(docs, written(postings, "postings"), all_sets, k, percent)
    pairs = written(pairs, "links")
    up = trees.select("node", "root")
    if not pairs.isEmpty():
        def top(side: str) -> DataFrame:
            return up.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        between = pairs.join(top("a"), "a", "left").join(top("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        higher = written(components(between), "components")
        lifted = up.join(higher.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
        up = lifted.unionAll(higher.join(up, "node", "left_anti"))
    least = up.groupBy("root").agg(F.least(F.min("node"), F.first("root")).alias("least"))
    up = up.join(least, "root").select("node", F.col("least").alias("root")).unionAll(least.select(F.col("root").alias("node"), F.col("least").alias("root"))).distinct()
    labelled = written(classes.join(up.withColumnRenamed("node", "first"), "first", "left").select("digest", F.coalesce("root", "first").alias("component")), "labelled")
    return all_sets.join(labelled, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
