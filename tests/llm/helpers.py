from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, *more):
    """A documents table of (doc_id, text[, lang, source]) with columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in ("words", "key", "label", "digest", "component", "rep", "text_hash", "anchor", "spans", "score", *more):
        df = df.withColumn(name, F.lit("x"))
    return df
