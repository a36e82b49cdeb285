"""Small document tables with the awkward cases in them."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """NULLs in every column, empty and long texts, repeated rows, ties, and columns with names the operators use."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, long, None, "a", len(long)), (4, "one two three four five", "en", "b", 23),
        (4, "one two three four five", "en", "b", 23), (5, "one two three four five", "xx", "b", 23), (None, "lost words here", "de", "a", 15),
        (None, None, None, None, None), (6, "\n \n\t\n", "fr", "c", 5), (7, "é" * 300, "fr", "c", 300),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("row", "size", "position", "words", "fp", "h1", "lines", "kept", "stratum", "length", "name"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def nothing(spark):
    return spark.createDataFrame([], DOCS)
