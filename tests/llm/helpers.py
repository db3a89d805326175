"""Small tables for the tests of docsift.llm."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, first=0):
    rows = [(first + i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
