"""Small documents with every awkward case, and brute-force counterparts."""

LONG = " ".join(f"word{i}" for i in range(3000))


def nasty_documents(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns named like internals."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 1, 0.5, "x"),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 1, 0.5, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "s", 0, 0.1, "y"),
        (None, "no id here but some text for all", "en", "s", 3, 0.1, "z"),
        (None, None, None, None, None, None, None),
        (4, LONG, "en", "s", len(LONG), 0.2, "w"),
        (5, "  \n\t ", "fr", "s", 5, 0.2, "w"),
        (6, "### 123 $$$", "fr", "s", 11, 0.2, "w"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, rank string")


def empty_documents(spark):
    return nasty_documents(spark).where("1 = 0")
