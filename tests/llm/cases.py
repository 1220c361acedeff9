"""Documents with what tends to go wrong: nulls, empty and long texts, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 55),
    (2, "alpha BETA gamma\tdelta epsilon zeta eta theta iota kappa", "en", "a", 55),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "uno dos", "es", None, 7),
    (5, "uno dos", "es", None, 7),
    (None, "no id here at all, it seems", None, "b", 26),
    (6, "Ünïcode — “quotes” <|endoftext|>  two  spaces\n\nÉté 漢字 😀 don't I'll 123,456", "fr", "c", 70),
    (7, "word " * 30_000, "de", "a", 150_000),
    (8, "x" * 20_000, "de", "a", 20_000),
    (9, "   \n\t ", "en", "b", 6),
    (10, " a b　 c\u0085 d\x0b\x0ce", "en", "c", 11),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")
