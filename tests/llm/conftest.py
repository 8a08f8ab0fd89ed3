import os
import sys

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def prose():
    """Different texts of made-up words, by number and length."""
    def make(seed, n=60):
        out, x = [], seed * 7919 + 13
        for i in range(n):
            x = (x * 1103515245 + 12345) % (1 << 31)
            out.append("".join("bcdfglmnrstv"[(x >> s) % 12] + "aeiou"[(x >> (s + 3)) % 5] for s in (4, 9, 14)[: 1 + x % 3]))
        return " ".join(out)
    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls in any column, empty and blank texts, repeated rows, ties and a very long text."""
    long = " ".join(prose(500 + i, 400) for i in range(60))
    return [
        (1, prose(1), "en", "a", 10), (1, prose(1), "en", "a", 10), (2, prose(1), "en", "b", None), (3, None, "en", "a", 0),
        (4, "", None, None, 0), (5, " \t\n ", "de", "", 4), (None, prose(6), "en", "a", 5), (None, prose(7), None, "a", 5),
        (None, None, None, None, None), (8, prose(8) + "\n" + prose(9), "fr", "c", 1), (9, long, "en", "a", 1),
        (10, "x" * 20_000, "en", "c", 1), (11, "é" * 30 + "\n" + "É" * 30, "fr", None, 1), (1, prose(12), "en", "a", 2),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with further columns that operators use as names of their own."""
    from pyspark.sql import functions as F
    names = ["tkey", "row", "size", "score", "kept_text", "n_words", "key", "held_out", "Fp", "target", "text_", "new", "n"]
    return odd.select(*odd.columns, *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def table_dir(tmp_path_factory):
    """Write frames as tables of a folder, the form the queries read."""
    def write(**tables):
        at = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{at}/{name}.parquet")
        return str(at)
    return write
