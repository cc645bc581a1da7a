"""Equal lines below the length from which edited lines are compared."""

from tickerloom.llm import line_dedup

DOCS = [
    (1, "Read more here\n\na b c d e f g h\nEnd"),
    (2, "Read  more here\n\na b c d e f g x\nRead more there"),
    (3, "End\n\nEnd\nown"),
]


def kept(spark, rules):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in line_dedup.dedup_lines(docs, rules=rules).collect()}


def test_equal_short_lines_go_where_asked(spark):
    got = kept(spark, line_dedup.LineRules())
    assert got == {1: (0, DOCS[0][1]), 2: (2, "\nRead more there"), 3: (2, "\nown")}
    assert kept(spark, line_dedup.LineRules(equal_words=8)) == {1: (0, DOCS[0][1]), 2: (1, "Read  more here\n\nRead more there"), 3: (0, DOCS[2][1])}
