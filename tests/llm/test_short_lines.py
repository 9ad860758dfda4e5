"""Copies of texts with one or two lines, where they are asked for."""

from tillbook.llm import lines


def test_short_copies_are_removed_where_asked_for(spark):
    rows = [(1, "one long line"), (2, "one long line\n \n"), (3, "a\n\nb"), (4, "a\nb"), (5, "a"),
            (6, "b\na"), (7, None), (8, ""), (9, ""), (10, "a\nb\nc"), (11, "a\nb\nc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id: r.n_removed for r in lines.repeated_lines_removed(docs, short=True).collect()}
    assert gone == {1: 0, 2: 1, 3: 0, 4: 2, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0, 10: 0, 11: 3}
    # The registered query is the three-line method of its SQL twin.
    gone = {r.doc_id: r.n_removed for r in lines.repeated_lines_removed(docs).collect()}
    assert {i: n for i, n in gone.items() if n} == {11: 3}
