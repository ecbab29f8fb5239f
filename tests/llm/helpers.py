
#: Nulls in any column, empty and blank texts, ties, repeated rows and a long text; a column of a clashing name.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1),
    (2, "", "en", "a", 2),
    (3, None, "de", None, 3),
    (4, "  \n\t ", None, "b", 4),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund am Fluss", "de", "b", 5),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund am Fluss", "de", "b", 5),
    (6, "The quick brown fox jumps over the lazy dog near the river bank", "en", "c", 6),
    (None, "no id at all here in this row of words", "en", "c", 7),
    (8, "wort " * 30_000, "de", "a", 8),
    (9, "　ça va\u0085bien \U0001f600 <|end|> </s>", "fr", "d", 9),
]
DDL = "doc_id long, text string, lang string, source string, size long"


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, DDL)


def empty(spark):
    return spark.createDataFrame([], DDL)


__all__ = ["DDL", "ROWS", "documents", "empty"]
