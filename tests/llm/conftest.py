import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source) rows, with clashing extra columns."""

    def make(rows):
        full = [(*r, "en", "src0")[:4] if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        from pyspark.sql import functions as F

        return df.withColumns({"kept": F.lit("x"), "keep_id": F.lit(1), "n": F.lit(2), "_id": F.lit("y"), "_key": F.lit("z"), "_gone": F.lit(0), "_hash": F.lit(0), "_none": F.lit(0), "_text": F.lit(3.0), "length": F.lit(9), "key": F.lit("k")})

    return make
