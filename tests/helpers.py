from datetime import datetime, timezone

from pyspark.sql import functions as F


def evaluate(spark, expression, values, kind="string"):
    """Values of a column expression over one input column ``x``, in input order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def utc(*parts):
    """A naive datetime as the session hands it out (its time zone is UTC)."""
    moment = datetime(*parts, tzinfo=timezone.utc)
    return moment.astimezone().replace(tzinfo=None)


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, html string")
