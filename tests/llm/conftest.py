import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "a b c d", "one two three four five", "É" * 40, "x" * 50_000, ("w%d " * 3) % (1, 2, 3), "line\nline\nline"]


@pytest.fixture(scope="session")
def table(spark):
    """documents from (doc_id, text[, lang, source]), with a column of a clashing name."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, COLUMNS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumn("score", F.lit("clash")).withColumn("component", F.lit(1)).withColumn("key", F.lit("k"))
        return df

    return make


@pytest.fixture(scope="session")
def odd(table):
    return table([(i, t) for i, t in enumerate(ODD)] + [(2, " ")])


@pytest.fixture(scope="session")
def empty(table):
    return table([])
