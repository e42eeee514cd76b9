"""Small documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

TEXTS = [
    None, "", "   \n\t ", "one", "one two", "one two three",
    "the same words stand here twice and so they do " * 8, "the same words stand here twice and so they do " * 8,
    "a clean line of plain words that goes on for a while without any repeat of what it said\n" * 1 + " ".join(f"word{i}" for i in range(80)),
    " ".join(f"long{i % 977}" for i in range(60_000)), "Ünïcödé straße ÀÉ 日本語   x́ <|endoftext|> don't",
    "### $$$ &&& *** |||", "A\nA\nA\nB", "tie tie tie", "tie tie tie",
]


def documents(spark):
    """Rows 6 and 7 have equal texts; the last two rows are equal in all columns; one id is null, one source is null."""
    rows = [(None if i == 3 else (14 if i >= 13 else i), t, None if i == 4 else "src%d" % (i % 3), i, "x", 1.5) for i, t in enumerate(TEXTS)]
    rows[13] = rows[14]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, slot string, score double").repartition(3, "n_words")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_words int, slot string, score double")
