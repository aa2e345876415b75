import pytest

TABLES = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with a clashing
    extra column, over several partitions."""
    from sluice.session import ship_package
    ship_package(spark)

    def run(rows, extra="n_words string"):
        full = []
        for r in rows:
            r = tuple(r) + ("en", "src0")[len(r) - 2:] if len(r) < 4 else tuple(r)
            full.append(r[:4] + (len(r[1]) if r[1] is not None else None, "x"))
        df = spark.createDataFrame(full, f"{DOCS}, {extra}")
        return df.repartition(3) if full else df
    return run
