"""Counts of line dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospecta.llm import line_dedup


def test_words_of_all_documents_are_counted(spark):
    texts = [f"a{i % 64}\nb\tc  b" for i in range(256)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    words = spark.createDataFrame([(w,) for w in ("a0", "a63", "b", "c")], "word string")
    levels = line_dedup._levels(rows, 1)
    got = {x.word: x.level for x in words.select("word", F.get(levels, line_dedup._slot(F.col("word"))).alias("level")).collect()}
    assert got == {"a0": 8, "a63": 8, "b": 36, "c": 32}


def test_lists_are_made_in_turns(spark, monkeypatch):
    """Each turn makes lists of its own; all together they are those of one turn."""
    texts = ["\n".join(f"{' '.join(f'w{(i * 7 + j) % 50}' for j in range(12))} x{i % 5}" for j in range(2)) for i in range(30)]
    docs = spark.createDataFrame([*enumerate(texts), *((100 + i, f"{x} y{i}") for i, x in enumerate(texts))], "doc_id long, text string")
    made, write = [], line_dedup.bucketed

    def noted(parts, name, key):
        parts = list(parts)
        made.append([{x.entry for x in df.select("entry").distinct().collect()} for df in parts])
        return write(parts, name, key)

    monkeypatch.setattr(line_dedup, "bucketed", noted)
    found = sorted(line_dedup.dedup_report(docs).collect())
    monkeypatch.setattr(line_dedup, "LIST_PARTS", 1)
    assert found == sorted(line_dedup.dedup_report(docs).collect())
    turns, (whole,) = made
    assert len(turns) == 2 and all(turns) and not turns[0] & turns[1] and turns[0] | turns[1] == whole
