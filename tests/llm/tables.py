"""Small tables with every odd row that operators must bear."""

WORDS = "the quick brown fox jumps over a lazy dog while seven small birds sing above the old green river bank".split()


def prose(seed, count=40):
    return " ".join(WORDS[(seed * 7 + k * (seed % 5 + 1)) % len(WORDS)] + str((seed * k) % 11) for k in range(count)) + "."


#: (doc_id, text, lang, source, n_chars, length, key)
DOCUMENTS = [
    (1, prose(1), "en", "a", 10, "x", None),
    (2, prose(1), "en", "a", 10, "y", 1),
    (3, prose(2), None, None, None, None, None),
    (3, prose(2), None, None, None, None, None),
    (4, None, "en", "a", 0, "z", 2),
    (5, "", "de", None, 0, "z", 2),
    (6, "   \n\t ", "de", "b", 6, "z", 2),
    (7, "one two", "de", "b", 7, "z", 2),
    (8, "ONE two", "de", "b", 7, "z", 2),
    (None, prose(3), "fr", "b", 7, "z", 2),
    (None, None, None, None, None, None, None),
    (9, "long " + "wörd x " * 30_000, "fr", "b", 7, "z", 2),
    (10, "!" * 70, "fr", "b", 7, "z", 2),
    (11, prose(4, 100), "en", "a", 10, "x", None),
    (12, prose(4, 100).replace("fox", "cat", 1), "en", "a", 10, "x", None),
    (13, "<|endoftext|> 12345 😀", "en", "a", 10, "x", None),
]
EMPTY: list = []
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string, key long"


def documents(spark, rows=None):
    return spark.createDataFrame(DOCUMENTS if rows is None else rows, SCHEMA)
