"""Alignment, personal data and the prefix trie against brute force or their SQL, and on the cases that their docstrings define."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import uuid
import zlib

import duckdb
import public_tokenizers
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from prospecta.llm import alignment, pii, q_pii, q_trie, trie

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, row long, block long, code int, n long"
TURNS = "conv_id long, turn long, role string, text string, pos long, name string, depth long"


def documents(spark, rows):
    return spark.createDataFrame([(i, x, "en", "s", 1, 2, 3, 4) for i, x in rows], DOCS).repartition(3)


# Alignment


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_, b_ = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = dict(zip([*map(chr, plain), *map(chr, range(0x100, 0x200))], [*plain, *(x for x in range(256) if x not in plain)]))

    def spans(tokens):
        at = 0
        for i, data in tokens:
            yield i, at, at + len(data)
            at += len(data)

    found, held = [], collections.Counter()
    for doc, text in rows:
        a, b = [], []
        if text:
            a = [(i, bytes(letters[c] for c in a_.id_to_token(i))) for i in a_.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if b_.is_byte(i) else p.replace("▁", " ").encode()) for i in b_.encode(text) for p in [b_.id_to_piece(i)]]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a, b = [], []
        a, b = list(spans(a)), list(spans(b))
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = [",".join(str(i) for i, _, e in a if s < e <= t) + "|" + ",".join(str(i) for i, _, e in b if s < e <= t) for s, t in zip([0, *ends], ends)]
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        held.update(set(links))
        found.append((doc, len(a), len(b), len(groups), links, ";".join(groups)))
    most = collections.defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return collections.Counter(
        (doc, n_a, n_b, n_g, len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if n_a else "")
        for doc, n_a, n_b, n_g, links, g in found)


ODD_TEXTS = [
    None, "", " ", "  a  b ", "\n", "x" * 3000, "▁ a", "a▁b", "<s> </s> <|endoftext|> hi", "a  b  c", "a ́b", "日本 語 です。", "\x00 a \x01", "tab\t b", "a \n b",
    "a  \n  b", "the. ,the", "﻿a b", "it's 's a", "one\ntwo\nthree.\nfour", "a.\n", "\n\nx", "end.", "a,\nb", "1.\n2", "é.\né, ñ", "naïve.\x01", ". . .", "a\n b", "a \nb"]


def test_alignment(spark):
    rnd = random.Random(5)
    words = "the of and Éa straße token.ize hello, world! x1 2024 ((a)) naïve 你好 's don't foo_bar http://a.b/c?d=e".split()
    rows = [(i, "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\n", "  ", ". ", ", ", ".\n"]) for _ in range(rnd.randint(1, 60)))) for i in range(60)]
    rows += [(100 + i, x) for i, x in enumerate(ODD_TEXTS)] + [(None, "null id"), (3, "again"), (3, "again"), rows[0]]
    got = alignment.align(documents(spark, rows), A, B)[0]
    assert collections.Counter(tuple(x) for x in got.collect()) == brute_alignment(rows)


def test_alignment_of_long_texts_and_small_blocks(spark, monkeypatch):
    """More blocks do not change a row; a text longer than a block is one."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 300)
    monkeypatch.setattr(alignment, "SLICE_WORDS", 7)
    rows = [(i, f"alpha beta {i % 5} gamma.\nDelta " * (i % 9)) for i in range(40)]
    batches = [alignment.pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [x for _, x in rows]})]
    assert len(list(alignment._gathered(iter(batches)))) > 5
    docs, pairs = alignment.align(documents(spark, rows), A, B)
    assert collections.Counter(tuple(x) for x in docs.collect()) == brute_alignment(rows)
    assert pairs.filter("best").count() <= pairs.count()


def test_alignment_of_a_text_of_a_megabyte(spark):
    row = alignment.align(documents(spark, [(1, "some words of a long text. " * 40_000), (2, "y" * 100_000)]), A, B)[0].filter("doc_id = 1").first()
    assert row.n_a == row.n_groups and row.n_a >= 7 * 40_000 and len(row.groups_sha256) == 64


def test_chunks_are_encoded_once_for_all_blocks(spark, tmp_path, monkeypatch):
    """Blocks share their chunks: each is encoded once, however many blocks have it, and every block gets its links."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 100)
    monkeypatch.setattr(alignment, "PACK_ROWS", 5)
    rows = [(i, f"alpha beta naïve gamma{i % 3} " * 3) for i in range(30)]
    met, tokens = tmp_path / "met", alignment.Tokenizers.tokens
    met.mkdir()

    def noted(self, chunks):
        (met / uuid.uuid4().hex).write_text("\t".join(chunks))
        return tokens(self, chunks)

    monkeypatch.setattr(alignment.Tokenizers, "tokens", noted)
    cloudpickle.register_pickle_by_value(alignment)
    try:
        got = alignment.align(documents(spark, rows), A, B)[0].collect()
    finally:
        cloudpickle.unregister_pickle_by_value(alignment)
    seen = [x for path in met.iterdir() for x in path.read_text().split("\t")]
    assert sorted(seen) == sorted(set(seen)) and {"beta", "naïve", "gamma0", "gamma1", "gamma2"} <= set(seen)
    assert collections.Counter(tuple(x) for x in got) == brute_alignment(rows)


def test_alignment_of_texts_that_begin_with_a_control_character(spark):
    rows = list(enumerate(["\x01abc", "\x01 a b", "\x01", "a \x01b c", "\x01\x01x y"]))
    assert collections.Counter(tuple(x) for x in alignment.align(documents(spark, rows), A, B)[0].collect()) == brute_alignment(rows)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(documents(spark, []), A, B)[0].count() == 0


def test_pieces_that_go_on_after_a_space_are_refused(monkeypatch):
    import sentencepiece

    class Odd(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b" if i == 500 else super().id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError, match="after a space"):
        alignment.Tokenizers(A, B)


# Personal data


@pytest.mark.parametrize("text, want", [
    ("a.b@c.de_f@g.hi x", [(0, 0, 8), (8, 0, 15)]),
    ("a@b c@d.e.", [(4, 0, 9)]),
    ("@a.b a@@b.c", []),
    ("1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.1", [(0, 1, 7), (8, 1, 15), (26, 1, 33)]),
    ("0000000255.00.1.2", [(0, 1, 17)]),
    ("4111 1111-1111 1111, 4111 1111 1111 1112", [(0, 2, 19)]),
    ("4111  1111 1111 1111", []),
    ("+1 (555) 555-0100 +12 +123456789012345678", [(0, 3, 17)]),
    ("é +1 555 555 0100.", [(2, 3, 17)]),
    ("", []),
])
def test_base_spans(text, want):
    assert [(a, k, b) for a, k, b, _ in pii.base_spans(text)] == want


def test_long_runs_are_scanned_in_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "+1" + "(" * 200_000, "1 " * 100_000, "a@b." * 60_000):
        pii.base_spans(text)


def private_rows():
    """Mentions that recur with telling terms, copies, and clean documents."""
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(120):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 90)))
        if i % 8 == 0:
            text += f" Falkenberg asks john.doe@mail.example.com about zanzibar{i % 3} and 4111 1111 1111 1111"
        if i % 8 == 1:
            text = f"call +1 555 555 0100 {text} zanzibar1 {rnd.choice(words)} 10.0.0.{i % 2}"
        rows.append((i, text))
    rows += [(200 + i, "only copies tell Kowalski of kow@alski.org here") for i in range(9)] + [(300, None), (301, ""), (302, "x" * 70_000), (303, "a" * 400 + "@b.cd ÜBER " * 300)]
    return rows


def test_personal_data_equals_its_sql(spark, tmp_path):
    documents(spark, private_rows()).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = q_pii.op12_pii(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(q_pii.SQL)
    assert sorted(tuple(x) for x in got) == sorted(want.project(", ".join(got[0].__fields__)).fetchall())
    by = {x.doc_id: x.spans for x in got}
    assert any("term:" in x for x in by.values()), "some terms disclose"
    assert all("term:" not in by[200 + i] for i in range(9)), "copies of one text are one text"
    assert all(by[i] == "" for i in range(120) if i % 8 > 1), "clean documents stay clean"


def test_sanitised_texts(spark):
    rows = private_rows()
    texts = dict(rows)
    out = {x.doc_id: x.text for x in pii.sanitise(documents(spark, rows)).collect()}
    assert out[0].endswith("<card>") and "<email>" in out[0] and "Falkenberg" not in out[0]
    assert all(out[i] == texts[i] for i in range(120) if i % 8 > 1) and out[300] == ""
    assert out[200] == "only copies tell Kowalski of <email> here"
    assert [pii._instead(x, 4, 0.92) for x in ("abc1", "Name", "word")] == ["<number>", "<name>", "<word>"]


def test_personal_data_of_odd_rows(spark):
    assert pii.scan(documents(spark, [])).count() == 0
    odd = [(None, "a@b.cd"), (None, None), (1, "a@b.cd"), (1, "a@b.cd")]
    assert sorted((x.doc_id or 0, len(x.base), len(x.spans)) for x in pii.scan(documents(spark, odd)).collect()) == [(0, 0, 0), (0, 1, 1), (1, 1, 1), (1, 1, 1)]


# Prefix trie


def conversations(spark, rows):
    return spark.createDataFrame([(*x, 1, "n", 2) for x in rows], TURNS).repartition(4)


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len([w for w in node[-1][1].replace("\x0b", " ").split() if w]) if node else 0)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, rows):
    turns = trie.numbered_turns(conversations(spark, rows)).cache()
    return sorted((tuple(x) for x in trie.prefix_trie(*trie.shared_openings(turns)).collect()), key=str)


def talk(seed: int, n: int):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(n * 2), n):
        for i in range(rnd.choice([1, 1, 2, 3, 4, 7, 8, 9])):
            rows.append((c, None if i == 0 and c % 3 == 0 else i, rnd.choice(["user", "assistant", None]), rnd.choice(["hi there", "", None, "a b  c\n d", "ok"])))
    return rows


def test_trie(spark):
    rows = talk(1, 60)
    rows += [(500, i, "user", "same") for i in range(70)] + [(501, i, "user", "same") for i in range(66)]
    rows += [(None, 1, "user", "x"), (600, 1, "user", "twice"), (600, 1, "user", "twice"), (-7, 0, "a", "b")]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_equals_its_sql(spark, tmp_path):
    rows = talk(2, 50)
    conversations(spark, rows).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = q_trie.op13_prefix_trie(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted((tuple(x) for x in got), key=str) == sorted(con.sql(q_trie.SQL).project(", ".join(got[0].__fields__)).fetchall(), key=str) == brute_trie(rows)


def test_trie_of_odd_tables(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []
    turnless = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 5) if zlib.crc32(str(c).encode()) % 4 > 0]
    assert trie_of(spark, turnless) == brute_trie(turnless)


def test_a_long_conversation_over_many_partitions(spark):
    """Positions of a conversation that a sort spreads over partitions, and prefixes of thousands of turns."""
    rows = [(40, i, "user", f"t{i % 7}") for i in range(3000)] + [(41, i, "user", f"t{i % 7}") for i in range(2500)]
    found = trie.numbered_turns(conversations(spark, rows)).filter("conv_id = 40").orderBy("pos").select("pos").collect()
    assert [x.pos for x in found] == list(range(3000))
    got = trie_of(spark, rows)
    assert len(got) == 3001 and max(x[1] for x in got) == 3000 and [x for x in got if x[1] == 2500][0][3] == 2


def test_prefix_names_are_equal_where_prefixes_are(spark):
    rows = talk(4, 30)
    turns = trie.numbered_turns(conversations(spark, rows)).cache()
    of = collections.defaultdict(list)
    for x in turns.orderBy("conv_id", "pos").collect():
        of[x.conv_id].append(bytes(x.turn))
    keys = {(x.conv_id, x.depth): tuple(x.key) for x in trie.prefixes(turns).collect()}
    for (c, d), (e, f) in itertools.combinations(keys, 2):
        if d == f:
            assert (keys[c, d] == keys[e, f]) == (of[c][:d] == of[e][:f])
    assert turns.agg(F.sum("words")).first()[0] == sum(len((x[3] or "").split()) for x in rows)
