import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows, with a further column."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x") for r in rows]
        return spark.createDataFrame(full, DOC + ", size string").repartition(2)
    return make


#: Nulls, empty and white texts, ties, repeated rows, odd characters.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, "one"), (None, "one two three four five six"), (6, "a\x00b é İ Ω 日本 <|endoftext|> 'll"),
       (7, "\n".join(["same line here"] * 30)), (8, "word " * 5000), (9, "x" * 20000)]
