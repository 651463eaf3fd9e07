import re

import pytest

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture
def docs(spark):
    """A maker of document tables from (doc_id, text) pairs or full rows."""

    def make(rows, schema=DOCS):
        full = [r if len(r) != 2 else (*r, "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def sample():
    """(doc_id, text) of the smallest document table, with rows that the operators must stand."""
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
    odd = [(10_001, None), (10_002, ""), (10_003, " \t\n "), (10_004, "one"), (10_005, rows[0][1]), (10_006, rows[0][1]), (None, rows[1][1]), (10_007, "é日本 \x85\xa0x <|endoftext|> y"), (10_008, "word " * 3000)]
    return rows + odd + [odd[3]]
