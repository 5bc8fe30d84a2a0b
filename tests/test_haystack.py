"""The text that an event is searched in, of very many issues."""

import time

from pyspark.sql import functions as F

from parley.operators import analytics


def test_haystack_of_many_issues(spark):
    """Issues are told apart in proportion to their number; an issue of the meeting and its documents stands once."""
    issue = F.transform(F.sequence(F.lit(1), F.lit(60000)), lambda i: F.struct(F.concat(F.lit("N"), i).alias("native_id"), F.lit("x").alias("status")))
    doc = F.struct(F.lit("T").alias("title"), issue.alias("issues"), F.array(F.struct(F.lit("P").alias("name"), F.lit("O").alias("entity"))).alias("stakeholders"))
    feed = spark.range(1).select(F.lit("m").alias("title"), F.lit("c").alias("committee"), F.lit("r").alias("rto"), issue.alias("issues"), F.array(doc).alias("documents"))
    began = time.time()
    hay = feed.select(analytics.haystack(feed).alias("h")).first()["h"]
    assert hay == "m c r " + " ".join(f"N{i}" for i in range(1, 60001)) + " P O T"
    assert time.time() - began < 20
