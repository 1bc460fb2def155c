"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, names that clash."""

LONG = " ".join(f"word{k % 977} et{k % 31}" for k in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog, again and again, until night."), (2, "The quick brown fox jumps over the lazy dog, again and again, until night."), (2, "The quick brown fox jumps over the lazy dog, again and again, until night."),
    (3, "The quick  brown fox\tjumps over the lazy dog, again and again,\nuntil night. "), (4, None), (5, ""), (6, " \t\n"), (7, "Ünïcödé ﬁne 漢字かな 🙂🙂 don't we'll ١٢٣ ½   x"), (8, "!!! ... ???"), (9, LONG), (10, LONG + " "), (None, "a row without id"), (None, None), (12, "\x00\x1f control \x7f"), (13, "I'M YOU'RE it's 12345 a's"), (14, "one"),
]
CLASH = "band long, node string, root string, sha string, _n int, _keep long, _id long, _text string, c0 string, id string, name string, spans string"


def awkward(spark, rows=TEXTS):
    """(doc_id, text) with columns named as operators name their own."""
    names = CLASH.split(", ")
    return spark.createDataFrame([(*r, *[None if k % 2 else (1 if "string" not in n else "x") for k, n in enumerate(names)]) for r in rows], f"doc_id long, text string, {CLASH}")


def empty(spark):
    return awkward(spark).limit(0)
