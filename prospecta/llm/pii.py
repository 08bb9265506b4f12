"""Personal data by patterns, and the terms that give it away, by corpus co-occurrence.

Protected entities are the values that the patterns find. A term (a run of four or more letters, digits and underscores) near a
mention of an entity is a candidate. Over all documents, with N documents, n_e that hold the entity, n_t that hold the term
and n_et that have the term within WINDOW terms of a mention, the term's disclosure is its pointwise mutual information with the
entity as a share of the entity's own information: log(N n_et / (n_e n_t)) / log(N / n_e). It is 1 where every document
with the term has the entity beside it. Of at least LEAST_TEXTS different texts, a term at GENERALISE_AT or above is
generalised to its kind, at REMOVE_AT or above removed, where it stands near a mention of that entity: a document protects the entities
it names, so texts without any are left alone. Entities and terms of fewer texts tell nothing and keep their words.

Candidates are at most 2 * WINDOW for each mention, never all pairs of a document. Texts are not moved: what is shuffled are
mentions, candidates near them, and counts of terms summed by task first.

Defined results: a null or empty text has no spans; repeated rows are reported each and are one text to LEAST_TEXTS; a null
doc_id is kept; an entity that all documents hold has no information and no terms; a span of several entities is taken once,
by its highest disclosure; very long texts are scanned whole, in linear time; an empty table gives an empty result;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import bisect
import collections
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.llm.common import docs_only, slices, strings, written

KINDS = ("email", "ip", "card", "phone", "term")
#: What the base kinds look like, and how many digits they have. A look behind keeps long runs from being tried at each place.
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL_HERE, EMAIL_NEXT = re.compile(rf"{LOCAL}+@{DOMAIN}"), re.compile(rf"(?<!{LOCAL}){LOCAL}+@{DOMAIN}")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, LARGEST_PART = (12, 19), (9, 15), 255
#: Cheap tests that all texts with a match pass.
MAYBE = (r"@[A-Za-z0-9-]+\.", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9](?:[ -]?[0-9]){11}", r"\+[0-9]")
TERM = re.compile(r"\w{4,}")
WINDOW, LEAST_TEXTS, GENERALISE_AT, REMOVE_AT = 25, 3, 0.9, 0.97
#: Different terms that a worker counts before it hands its counts on.
KEPT = 1 << 18


def _luhn(digits: str) -> bool:
    doubled = [int(x) * 2 for x in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        # Right after a match the next may begin inside a run; elsewhere only where a run begins.
        found = (EMAIL_HERE.match(text, at) if at else None) or EMAIL_NEXT.search(text, at)
        if not found:
            return
        at = found.end()
        yield found.span()


def base_spans(text: str, maybe: tuple[bool, ...] = (True,) * 4) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in order, in code points; the value is the same for all ways of writing it."""
    out = []
    if maybe[0]:
        out += [(a, 0, b, text[a:b].lower()) for a, b in _emails(text)]
    if maybe[1]:
        for m in IP.finditer(text):
            parts = [x.lstrip("0") or "0" for x in m.group().split(".")]
            if all(len(x) <= 3 and int(x) <= LARGEST_PART for x in parts):
                out.append((m.start(), 1, m.end(), ".".join(parts)))
    for kind, pattern, least, most in ((2, CARD, *CARD_DIGITS), (3, PHONE, *PHONE_DIGITS)):
        if maybe[kind]:
            for m in pattern.finditer(text):
                digits = re.sub("[^0-9]", "", m.group())
                if least <= len(digits) <= most and (kind == 3 or _luhn(digits)):
                    out.append((m.start(), kind, m.end(), digits))
    return sorted(out)


def near_terms(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the terms nearest to each mention, on both sides, outside all mentions."""
    covered, last = [], 0
    for start, _, end, _ in spans:  # the union of the spans, for overlapping kinds
        if covered and start < last:
            covered[-1][1] = last = max(last, end)
        else:
            covered.append([start, end])
            last = end
    starts = [a for a, _ in covered]

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b) - 1
        return i < 0 or covered[i][1] <= a

    terms = [(m.start(), m.end(), m.group().lower()) for m in TERM.finditer(text) if free(m.start(), m.end())]
    at, out = [a for a, _, _ in terms], []
    for start, kind, end, value in spans:
        entity = hashlib.md5(f"{KINDS[kind]}:{value}".encode("utf-8", "surrogatepass")).hexdigest()
        before, after = bisect.bisect_left(at, start), bisect.bisect_left(at, end)
        out += [(entity, term, a, b) for a, b, term in terms[max(0, before - WINDOW):before] + terms[after:after + WINDOW]]
    return out


FOUND = ("row long, doc_id long, text_hash binary, base array<struct<start:bigint,kind:int,end:bigint>>, entities array<string>, "
         "near array<struct<entity:string,term:string,start:bigint,end:bigint>>")
BASE_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
NEAR_TYPE = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def findings(rows: DataFrame) -> DataFrame:
    """Columns FOUND of rows (row, doc_id, text); the text stays behind."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = batch.column("text")
            maybe = np.array([np.asarray(pc.match_substring_regex(text, x)) for x in MAYBE]).reshape(4, -1)
            base: list[list] = [[] for _ in range(batch.num_rows)]
            near, entities, hashes = [[] for _ in base], [[] for _ in base], [None for _ in base]
            for i in np.flatnonzero(maybe.any(axis=0)).tolist():
                own = text[i].as_py()
                spans = base_spans(own, tuple(maybe[:, i].tolist()))
                if spans:
                    base[i] = [{"start": a, "kind": k, "end": b} for a, k, b, _ in spans]
                    entities[i] = sorted({hashlib.md5(f"{KINDS[k]}:{v}".encode()).hexdigest() for _, k, _, v in spans})
                    near[i] = [dict(zip(("entity", "term", "start", "end"), x, strict=True)) for x in near_terms(own, spans)]
                    hashes[i] = hashlib.md5(own.encode("utf-8", "surrogatepass")).digest()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(hashes, pa.binary()), pa.array(base, BASE_TYPE), pa.array(entities, pa.list_(pa.string())), pa.array(near, NEAR_TYPE)],
                names=["row", "doc_id", "text_hash", "base", "entities", "near"])

    return rows.mapInArrow(find, FOUND)


def term_counts(docs: DataFrame) -> DataFrame:
    """term and n, a count of documents with it; a term has a row for each task (or more), to be summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: collections.Counter[str] = collections.Counter()

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "n"])
            seen.clear()
            return out

        for rows in slices(batches):
            for text in strings(rows.column("text")):
                seen.update(set(map(str.lower, TERM.findall(text))))
            if len(seen) > KEPT:
                yield batch()
        yield batch()

    return docs_only(docs).select("text").mapInArrow(count, "term string, n long")


def disclosures(found: DataFrame, counts: DataFrame, n_docs: int, least_texts: int = LEAST_TEXTS, threshold: float = GENERALISE_AT) -> DataFrame:
    """entity, term, disclosure of the pairs at or above the threshold, from findings and term counts."""
    texts = F.count_distinct("text_hash")
    entities = found.select("text_hash", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), texts.alias("texts"))
    told = entities.filter(F.col("texts") >= least_texts).select("entity", "n_e")
    each = found.select("text_hash", F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(x.entity.alias("entity"), x.term.alias("term"))))).alias("p"))
    each = each.select("text_hash", "p.entity", "p.term").join(told.select("entity"), "entity", "left_semi")
    pairs = written(each.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"), texts.alias("texts")).filter(F.col("texts") >= least_texts), "pairs")
    of_term = counts.join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_t"))
    # The logarithm of a ratio of products, each below the square of the documents: doubles keep them.
    n = F.lit(float(n_docs))
    share = F.log(F.col("n_et") * n / (F.col("n_e").cast("double") * F.col("n_t"))) / F.log(n / F.col("n_e"))
    return pairs.join(told, "entity").join(of_term, "term").filter(F.col("n_e") < n_docs).select("entity", "term", F.round(share, 9).alias("disclosure")).filter(F.col("disclosure") >= threshold)


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, base and spans (arrays of start, kind, end and, in spans, disclosure; in order) of every row."""
    return _scan(_numbered(docs))


def _numbered(docs: DataFrame) -> DataFrame:
    return docs_only(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


def _scan(rows: DataFrame) -> DataFrame:
    found = written(findings(rows), "findings")
    told = written(disclosures(found, written(term_counts(rows), "terms"), found.count()), "disclosures")
    each = found.select("row", F.explode("near").alias("x")).select("row", "x.*").join(told, ["entity", "term"])
    added = each.groupBy("row", "start", "end").agg(F.max("disclosure").alias("disclosure")).groupBy("row").agg(
        F.collect_list(F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end", "disclosure")).alias("added"))
    base = F.transform("base", lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"), F.lit(None).cast("double").alias("disclosure")))
    spans = F.array_sort(F.concat(base, F.coalesce("added", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,disclosure:double>>"))))
    return found.select("row", "doc_id", "base").join(added, "row", "left").select("row", "doc_id", "base", spans.alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row: personal data named by kind, terms that disclose it generalised or removed. Of
    overlapping spans the first counts, and what of a later one sticks out goes with it."""
    rows = written(_numbered(docs), "numbered")
    spans = _scan(rows).select("row", "spans")

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, spans_ in zip(strings(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                parts, at = [], 0
                for s in spans_ or ():
                    a, b = s["start"], s["end"]
                    if a >= at:
                        parts += [text[at:a], _instead(text[a:b], s["kind"], s["disclosure"])]
                    at = max(at, b)
                out.append("".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.join(spans, "row").select("doc_id", "text", "spans").mapInArrow(replaced, "doc_id long, text string")


def _instead(value: str, kind: int, disclosure: float | None) -> str:
    if disclosure is None:
        return f"<{KINDS[kind]}>"
    if disclosure >= REMOVE_AT:
        return ""
    return "<number>" if any(x.isdigit() for x in value) else "<name>" if value[0].isupper() else "<word>"
