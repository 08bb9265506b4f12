"""Ids of lines in line dedup: one number for row and line, ordered as they are."""

from __future__ import annotations

from prospecta.llm import line_dedup


def test_rows_are_numbered_without_gaps(spark):
    """Ids that no line id has room for (null, repeated, below 0, 2^32 or more) are replaced by 0, 1, ... in their order."""
    ids = [None, -5, 7, 7, 1 << 32, (1 << 63) - 1, 3, None]
    docs = spark.createDataFrame([(x, f"t{i}") for i, x in enumerate(ids)], "doc_id long, text string").repartition(4)
    rows = [(x.row, x.doc.doc_id, x.text) for x in line_dedup.numbered(docs).orderBy("row").collect()]
    assert rows == [(0, None, "t0"), (1, None, "t7"), (2, -5, "t1"), (3, 3, "t6"), (4, 7, "t2"), (5, 7, "t3"), (6, 1 << 32, "t4"), (7, (1 << 63) - 1, "t5")]
    lines = line_dedup.lines_of(line_dedup.numbered(docs.filter("doc_id = 3"))).collect()
    assert [(x.id, x.text) for x in lines] == [(3 << line_dedup.LINE_BITS, "t6")]


def test_lines_of_odd_ids_match_earlier_ones(spark):
    """The earlier of two lines stays, whatever the ids; a near line of a smaller and of a larger set matches, lists or not."""
    base = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(-5, f"a b\n{base} x"), ((1 << 40), base), ((1 << 32) - 1, f"b  a\nq\n{base} x y"), (None, "b a a\n\nq r s t")], "doc_id long, text string")
    found = {x.doc_id: (x.n_lines, x.removed_lines) for x in line_dedup.dedup_report(docs).collect()}
    assert found == {None: (3, []), -5: (2, [0]), (1 << 32) - 1: (3, [0, 2]), 1 << 40: (1, [0])}


def test_sets_of_all_lines(spark):
    """A line without words has an empty set, what lies between two blanks is no word, and lines are counted from the sets."""
    rows = line_dedup.numbered(spark.createDataFrame([(1, "a b\tc  a\n \nd")], "doc_id long, text string"))
    sets = line_dedup._sets(rows, 1, 80)
    assert [(x.id - (1 << line_dedup.LINE_BITS), x.n) for x in sets.orderBy("id").collect()] == [(0, 3), (1, 0), (2, 1)]
