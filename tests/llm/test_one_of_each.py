"""Copies with null and repeated ids."""

from driftline.llm import jaccard

TEXT = " ".join(f"w{i}" for i in range(40))


def test_one_row_of_each_class(spark):
    other = " ".join(f"u{i}" for i in range(40))
    rows = [(1, TEXT, "a"), (1, TEXT, "b"), (None, TEXT, "c"), (5, TEXT + " more", "d"), (5, other, "e"), (7, None, "f"), (7, "", "g")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    names = sorted(r.source for r in got)
    assert len(names) == 4 and names[0] in "ab" and names[1:] == ["e", "f", "g"]
