"""Cross-tokenizer alignment: token groups and links of two vocabularies over the same bytes, and how usual each link is.

The alignment is relational. Tokens of both vocabularies are posexploded, windowed sums of their lengths give byte ends,
the two sides meet by text and end (one grouping by text and end is that equi-join, of rows that already lie together), the
running count of ends that both have numbers the groups, and tokens of a group are linked where their bytes overlap.

It is done once for each distinct chunk of the corpus: a chunk is what lies between places where both
vocabularies always cut (single spaces, which go with what follows, and line ends and a full stop or comma after a letter). A document is then a list of
chunk codes; its groups are those of its chunks in order, its links their links. Tasks make blocks of at most BLOCK_BYTES of text, each with its own codes. A
block's distinct chunks are exchanged by their text, encoded and aligned once for all blocks, and the links go back to every block that has the chunk: packed, a row for
each block that a task has met. No text is moved, and what a block gets back is bounded by its size. Documents that hold a link are counted block by block, then over the corpus; the counts go
back to the blocks. Nothing is gathered by id, pair or document, and one grouping key is never more than a block.

Vocabulary A is byte-level BPE (a tokenizers .json file, special strings as plain text), B a sentencepiece .model with byte
fallback whose pieces have no space but in front (else no cut is safe, and an error is raised).

Defined results: a null or empty text, and one whose tokens do not spell space + text, has no tokens: zeros and ''; repeated
rows are documents each; a null doc_id is kept; links of equal count at the top of an A id are all best; a text longer than a block
is a block; an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospecta.llm.common import docs_only, release, slices, strings, written
from prospecta.llm.merges import byte_letters

if TYPE_CHECKING:
    import sentencepiece

BLOCK_BYTES = 8 << 20
#: Tasks that blocks and chunks are dealt to at most; beyond, a task has more of them, and sorts spill.
MOST_PARTS = 20_000
#: Characters that are no white space by any of the vocabularies; a space between two of them is a cut.
SOLID = r"[!-~\p{L}\p{N}]"
CUT = regex.compile(rf"(?<={SOLID}) (?={SOLID})")
#: Begins a chunk that has no space before it.
JOIN = "\x01"
#: Texts with a space that is no cut, or with JOIN; the others are split at every space.
AWKWARD = r"\A | \z|[^!-~\p{L}\p{N}] | [^!-~\p{L}\p{N}]|\x01"
#: Finer cuts: before a full stop or comma that ends a word, and around a line end.
FINER = ((r"(\p{L})([.,])([ \n])", rf"\1 {JOIN}\2\3"), (rf"({SOLID})\n({SOLID})", f"\\1 {JOIN}\n {JOIN}\\2"))
#: A token in one number: side (0 A, 1 B), id, bytes.
ID_BITS, LENGTH_BITS = 17, 8
#: Chunks that are encoded at once: the libraries' answers are many times their size.
BATCH = 1 << 12
#: Words whose links are sorted at once.
SLICE_WORDS = 1 << 17
#: Distinct chunks of blocks to a task that meets them by their text, and those that it packs at once.
PART_CHUNKS, PACK_ROWS = 1 << 18, 1 << 17
#: Marks of a link in its number: A's token is met for the first time, B's is; both: a group begins.
NEW_A, NEW_B = 62, 61
BLOCK_ROWS = "block long, ord int, doc_id long, codes binary, code int, chunk string"
PACKED_ROWS = "block long, codes binary, sizes binary, marks binary, a binary, b binary"
PIECE_ROWS = ("block long, ord int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, "
              "pair int, a int, b int, n long")


def pieces_of(b: sentencepiece.SentencePieceProcessor) -> list[str]:
    """B's pieces, which must not go on after a space."""
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if any("▁" in x.lstrip("▁") for x in pieces):
        raise ValueError("pieces go on after a space")
    return pieces


def safe_finer(path_b: str) -> bool:
    """Whether finer cuts are safe: no piece goes across one."""
    import sentencepiece

    return not any("\n" in x or regex.search(r"\p{L}[.,]", x) for x in pieces_of(sentencepiece.SentencePieceProcessor(model_file=path_b)))


class Tokenizers:
    """Tokens of chunks by both vocabularies, packed."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocab = self.a.get_vocab(with_added_tokens=False)
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes_a[i] = bytes(byte[x] for x in entry) if all(x in byte for x in entry) else entry.encode()
        pieces = pieces_of(self.b)
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        if max(map(len, self.bytes_a + self.bytes_b)) >> LENGTH_BITS or max(len(self.bytes_a), len(self.bytes_b)) >> ID_BITS:
            raise ValueError("tokens are too long or too many to be packed")
        self.packed_a = [i << LENGTH_BITS | len(x) for i, x in enumerate(self.bytes_a)]
        self.packed_b = [1 << (ID_BITS + LENGTH_BITS) | i << LENGTH_BITS | len(x) for i, x in enumerate(self.bytes_b)]

    def tokens(self, chunks: list[str]) -> list[list[int] | None]:
        """Packed tokens of each chunk with what stands before it, A's then B's; None where either does not spell it."""
        whole = [x[1:] if x.startswith(JOIN) else " " + x for x in chunks]
        of_a = self.a.encode_batch_fast(whole, add_special_tokens=False)
        # B puts a space before any text: after a line end, two tokens of their own, a chunk has none.
        of_b = self.b.encode(["\n" + x[1:] if x.startswith(JOIN) else x for x in chunks], num_threads=1)
        out = []
        for chunk, text, a, b in zip(chunks, whole, of_a, of_b, strict=True):
            want, a, b = text.encode(), a.ids, b[2:] if chunk.startswith(JOIN) else b
            right = b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b))
            out.append([*map(self.packed_a.__getitem__, a), *map(self.packed_b.__getitem__, b)] if right else None)
        return out


def planes(values: np.ndarray) -> bytes:
    """Numbers as int32, first all low bytes: they compress better so. What is exchanged is compressed here, as a shuffle's own codec gains little."""
    data = values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unplaned(data: bytes) -> np.ndarray:
    whole = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(whole, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of at most BLOCK_BYTES of text, or of one longer text."""
    held, size = [], 0
    for batch in slices(batches, BLOCK_BYTES):
        own = int(pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0)
        if held and size + own > BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.Table.from_batches(held)


def chunked(texts: pa.Array, finer: bool = True) -> tuple[list[np.ndarray], pa.Array]:
    """(codes of each text's chunks, distinct chunks, the most usual first)."""
    texts = texts.cast(pa.large_string())
    awkward = np.asarray(pc.match_substring_regex(texts, AWKWARD)).astype(bool)
    full = np.asarray(pc.binary_length(texts)) > 0
    plain, rest = np.flatnonzero(full & ~awkward), np.flatnonzero(full & awkward)
    cut = texts.take(pa.array(plain))
    for pattern, with_marks in FINER if finer else ():
        cut = pc.replace_substring_regex(cut, pattern, with_marks)
    split = pc.split_pattern(cut, " ")
    # A text that begins with JOIN itself has its space before it, as a part of the chunk.
    own = [CUT.split(f"{JOIN} {x}" if x.startswith(JOIN) else x) for x in strings(texts.take(pa.array(rest)))]
    sizes = np.zeros(len(texts), np.int64)
    sizes[plain] = np.asarray(pc.list_value_length(split))
    sizes[rest] = list(map(len, own))
    coded = pa.concat_arrays([split.flatten(), pa.array([x for chunks in own for x in chunks], pa.large_string())]).dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64)
    order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = np.cumsum(np.concatenate([[0], sizes[plain], sizes[rest]]))
    out = [np.zeros(0, np.int64)] * len(texts)
    for j, i in enumerate([*plain.tolist(), *rest.tolist()]):
        out[i] = rank[codes[at[j]:at[j + 1]]]
    return out, coded.dictionary.take(pa.array(order))


def blocks(docs: DataFrame, path_b: str) -> DataFrame:
    """Columns BLOCK_ROWS: documents with the codes of their chunks, and the chunk of each code of the block."""
    schema = pa.schema([("block", pa.int64()), ("ord", pa.int32()), ("doc_id", pa.int64()), ("codes", pa.binary()), ("code", pa.int32()), ("chunk", pa.string())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finer, part = safe_finer(path_b), TaskContext.get().partitionId()
        for number, table in enumerate(_gathered(batches)):
            codes, chunks = chunked(table.column("text").combine_chunks(), finer)
            block, n = part << 31 | number, table.num_rows

            def columns(n: int, **own: pa.Array) -> pa.RecordBatch:
                own["block"] = pa.array(np.full(n, block), pa.int64())  # noqa: B023
                return pa.RecordBatch.from_arrays([own[x.name] if x.name in own else pa.nulls(n, x.type) for x in schema], schema=schema)

            yield columns(n, ord=pa.array(np.arange(n), pa.int32()), doc_id=table.column("doc_id").combine_chunks(), codes=pa.array([planes(x) for x in codes], pa.binary()))
            for at in range(0, len(chunks), BATCH):
                some = chunks.slice(at, BATCH)
                yield columns(len(some), code=pa.array(np.arange(at, at + len(some)), pa.int32()), chunk=some.cast(pa.string()))
            pa.default_memory_pool().release_unused()  # what a block took is the executor's again

    return docs_only(docs).mapInArrow(make, BLOCK_ROWS)


def encoded(chunks: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """chunk and its packed tokens, of chunks that both vocabularies spell."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(path_a, path_b)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.column("chunk").slice(at, BATCH)
                tokens = pa.array(tokenizers.tokens(strings(some)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([some, tokens], names=["chunk", "tokens"]).filter(pc.is_valid(tokens))
        pa.default_memory_pool().release_unused()

    return chunks.mapInArrow(encode, "chunk string, tokens array<int>")


def aligned(tokens: DataFrame) -> DataFrame:
    """chunk and its links in order (array of A id * 2^32 + B id, with the marks NEW_A and NEW_B) from chunk, tokens, wherever
    rows of a chunk lie together."""
    text = ["hash", "chunk"]  # sorting is by the hash, chunks of one hash are told apart
    token = F.col("token")
    each = tokens.select(F.xxhash64("chunk").alias("hash"), "chunk", F.posexplode("tokens").alias("pos", "token"))
    so_far = Window.partitionBy(*text, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("side", F.shiftright(token, ID_BITS + LENGTH_BITS)).select(
        *text, "side", "token", F.sum(token.bitwiseAND((1 << LENGTH_BITS) - 1)).over(so_far).cast("int").alias("end"))
    # Tokens of a side end at different places, so a place has at most one of each.
    met = each.groupBy(*text, "end").agg(*(F.max(F.when(F.col("side") == i, token)).alias(x) for i, x in enumerate("ab")))
    earlier = Window.partitionBy(*text).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    numbered = met.select(*text, "end", "a", "b", F.coalesce(F.sum(cut.cast("int")).over(earlier), F.lit(0)).cast("int").alias("group"))

    def number(token: Column) -> Column:
        return F.shiftright(token, LENGTH_BITS).bitwiseAND((1 << ID_BITS) - 1)

    def side(name: str) -> Column:
        begin = F.col("end") - F.col(name).bitwiseAND((1 << LENGTH_BITS) - 1)
        return F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("end", begin.alias("begin"), number(F.col(name)).alias("id"))))).alias(name)

    def link(x: Column, y: Column) -> Column:
        marks = F.when(y.begin <= x.begin, F.lit(1 << NEW_A)).otherwise(F.lit(0)) + F.when(x.begin <= y.begin, F.lit(1 << NEW_B)).otherwise(F.lit(0))
        return F.shiftleft(x.id.cast("long"), 32) + y.id + marks

    groups = numbered.groupBy(*text, "group").agg(side("a"), side("b"))
    links = F.flatten(F.transform("a", lambda x: F.transform(F.filter("b", lambda y: (y.begin < x.end) & (x.begin < y.end)), lambda y: link(x, y))))
    inner = F.array_sort(F.collect_list(F.struct("group", "links")))
    return groups.select(*text, "group", links.alias("links")).groupBy(*text).agg(inner.alias("g")).select("chunk", F.flatten(F.transform("g", lambda x: x.links)).alias("links"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns PACKED_ROWS of block, code, links: those of a block in one row, at most PACK_ROWS at once."""
    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        block, code = np.asarray(table.column("block")), np.asarray(table.column("code")).astype(np.int64)
        order = np.lexsort((code, block))
        block, code, listed = block[order], code[order], table.column("links").combine_chunks().take(pa.array(order))
        sizes, links = np.asarray(pc.list_value_length(listed)).astype(np.int64), np.asarray(listed.flatten()).astype(np.int64)
        ends, first, out = np.concatenate([[0], np.cumsum(sizes)]), np.flatnonzero(np.diff(block, prepend=block[0] - 1)).tolist(), []
        for i, j in zip(first, [*first[1:], len(block)], strict=True):
            own = links[ends[i]:ends[j]]
            marks = (own >> NEW_B).astype(np.uint8)
            out.append((block[i], planes(np.diff(code[i:j], prepend=0)), planes(sizes[i:j]), planes(marks), planes(own[marks >= 2] >> 32 & (1 << ID_BITS) - 1), planes(own[marks & 1 == 1] & (1 << ID_BITS) - 1)))
        kinds = [pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "codes", "sizes", "marks", "a", "b"])

    held, n = [], 0
    for batch in batches:
        if n and n + batch.num_rows > PACK_ROWS:
            yield rows(held)
            held, n = [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if n:
        yield rows(held)
    pa.default_memory_pool().release_unused()


def _unpacked(packed: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code and number of links of each chunk; marks, A id and B id of each link) of a block's packed rows."""
    def numbers(name: str, then: Callable[[np.ndarray], np.ndarray] = np.asarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(then(unplaned(x)) for x in packed.column(name).to_pylist())]).astype(np.int64)

    codes = numbers("codes", np.cumsum)
    marks = numbers("marks").astype(np.uint8)
    # A token's links follow one another: a link's token is the last that was new.
    a, b = (numbers(name)[np.cumsum(new) - 1] for name, new in (("a", marks >= 2), ("b", marks & 1 == 1)))
    return codes, numbers("sizes"), marks, a, b


def _group_texts(starts: np.ndarray, marks: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[str]:
    """`a1,a2|b1;a3|b2` of each chunk, given where its links start; every chunk has some."""
    begins = np.flatnonzero(marks == 3)

    def side(ids: np.ndarray, new: np.ndarray) -> pa.Array:
        at = np.concatenate([np.cumsum(new)[begins] - 1, [int(new.sum())]])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids[new]).cast(pa.string())), ",")

    groups = pc.binary_join_element_wise(side(a, marks >= 2), side(b, marks & 1 == 1), "|")
    at = np.concatenate([np.searchsorted(begins, starts), [len(begins)]])
    return strings(pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), groups), ";"))


def _composed(docs: pa.Table, packed: pa.Table) -> pa.Table:
    """Columns PIECE_ROWS of a block: its documents with their link pairs, and its pairs with the number of documents."""
    schema = pa.schema([("block", pa.int64()), ("ord", pa.int32()), ("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
                        ("pairs", pa.binary()), ("times", pa.binary()), ("pair", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
    if not docs.num_rows:
        return schema.empty_table()
    own = [unplaned(x) for x in docs.column("codes").to_pylist()]
    most = max((int(x.max()) for x in own if len(x)), default=-1) + 1
    where, lengths, marks, of_a, of_b = _unpacked(packed)
    most = max(most, int(where.max()) + 1 if len(where) else 0)
    known = np.zeros(most, bool)
    known[where] = True
    sums, first = np.zeros((4, most), np.int64), np.cumsum(lengths) - lengths
    for k, new in enumerate((marks >= 2, marks & 1 == 1, marks == 3, marks >= 0)):
        sums[k, where] = np.add.reduceat(new.astype(np.int64), first) if len(where) else 0
    groups = np.empty(most, object)
    groups[where] = _group_texts(first, marks, of_a, of_b)
    groups = groups.tolist()
    pairs, of_link = np.unique(of_a << 32 | of_b, return_inverse=True)
    starts = np.zeros(most, np.int64)
    starts[where] = first
    right = np.array([len(x) > 0 and bool(known[x].all()) for x in own])
    empty = planes(np.zeros(0, np.int64))
    held, times, counts = [empty] * len(own), [empty] * len(own), np.zeros(len(pairs), np.int64)
    totals, digests = np.zeros((4, len(own)), np.int64), [""] * len(own)
    todo, at = np.flatnonzero(right).tolist(), 0
    while at < len(todo):
        some, words = [], 0
        while at < len(todo) and (not some or words + len(own[todo[at]]) <= SLICE_WORDS):
            some.append(todo[at])
            words += len(own[todo[at]])
            at += 1
        codes = np.concatenate([own[i] for i in some])
        sizes = np.array([len(own[i]) for i in some])
        first = np.cumsum(sizes) - sizes
        totals[:, some] = np.add.reduceat(sums[:, codes], first, axis=1)
        n = sums[3, codes]
        links = of_link[np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        keys = np.sort(np.repeat(np.repeat(np.arange(len(some)), sizes), n) << 32 | links)
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        distinct, times_ = keys[edge], np.diff(np.concatenate([edge, [len(keys)]]))
        counts += np.bincount(distinct & 0xFFFFFFFF, minlength=len(pairs))
        bounds = np.searchsorted(distinct, np.arange(len(some) + 1) << 32).tolist()
        for k, i in enumerate(some):
            held[i] = planes(np.diff(distinct[bounds[k]:bounds[k + 1]] & 0xFFFFFFFF, prepend=0))
            times[i] = planes(times_[bounds[k]:bounds[k + 1]])
            digests[i] = hashlib.sha256(";".join(map(groups.__getitem__, own[i].tolist())).encode()).hexdigest()
    pa.default_memory_pool().release_unused()
    n, m, block = len(own), len(pairs), docs.column("block")[0].as_py()

    def column(name: str, of_docs, of_pairs) -> pa.Array:
        kind = schema.field(name).type
        return pa.concat_arrays([pa.nulls(n, kind) if of_docs is None else pa.array(of_docs, kind), pa.nulls(m, kind) if of_pairs is None else pa.array(of_pairs, kind)])

    return pa.Table.from_arrays([
        column("block", np.full(n, block), np.full(m, block)), column("ord", np.asarray(docs.column("ord")), None), column("doc_id", docs.column("doc_id").to_pylist(), None),
        *(column(name, totals[k], None) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))), column("groups_sha256", digests, None),
        column("pairs", held, None), column("times", times, None), column("pair", None, np.arange(m)), column("a", None, pairs >> 32), column("b", None, pairs & 0xFFFFFFFF), column("n", None, counts)],
        schema=schema)


def _weighed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The result's columns of a block's documents, given the corpus-wide count of its pairs and whether it is the best of A's id."""
    where = np.asarray(pairs.column("pair")).astype(np.int64)
    count, best = np.zeros(int(where.max()) + 1 if len(where) else 0, np.int64), np.zeros(int(where.max()) + 1 if len(where) else 0, np.int64)
    count[where], best[where] = np.asarray(pairs.column("count")), np.asarray(pairs.column("best")).astype(np.int64)
    n_best, count_sum = [], []
    for held, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
        own, times_ = np.cumsum(unplaned(held)), unplaned(times).astype(np.int64)
        n_best.append(int((best[own] * times_).sum()))
        count_sum.append(int((count[own] * times_).sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", docs.column("groups_sha256"))


def _pieces(table: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Written PIECE_ROWS of a table of BLOCK_ROWS."""
    sizes = table.agg(F.count("code").alias("chunks"), F.count_if(F.col("ord") == 0).alias("blocks")).first()
    parts = min(MOST_PARTS, max(8, sizes.chunks // PART_CHUNKS + 1))
    # Exchanged once: the distinct chunks are grouped, and the links met, where the chunks of all blocks lie by their text.
    met = table.filter("chunk is not null").select("block", "code", "chunk").repartition(parts, "chunk")
    distinct = met.groupBy("chunk").agg(F.min("block").alias("block"), F.min("code").alias("code"))
    links = aligned(encoded(distinct, path_a, path_b).repartition(parts, "chunk"))
    packed = met.join(links.hint("shuffle_hash"), "chunk").select("block", "code", "links").mapInArrow(_packed, PACKED_ROWS)
    parts = min(MOST_PARTS, max(8, sizes.blocks // 2))
    documents = table.filter("codes is not null").select("block", "ord", "doc_id", "codes").repartition(parts, "block")
    return written(documents.groupBy("block").cogroup(packed.repartition(parts, "block").groupBy("block")).applyInArrow(_composed, PIECE_ROWS), "pieces")


def align(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; a, b, count, best of every id pair)."""
    pieces = _pieces(written(blocks(docs, path_b), "blocks"), path_a, path_b)
    release(docs.sparkSession)
    pairs = pieces.filter("pair is not null").select("block", "pair", "a", "b", "n")
    counts = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "counts")
    stats = counts.join(counts.groupBy("a").agg(F.max("count").alias("most")), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    known = pairs.join(stats, ["a", "b"]).select("block", "pair", "count", "best")
    found = pieces.filter("ord is not null").select(F.col("block").alias("of_block"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    out = found.groupBy("of_block").cogroup(known.groupBy("block")).applyInArrow(
        _weighed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out, stats
