"""Heads trained with pyspark.ml."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import heads
from brindle.plans.registry import query
from brindle.session import table


@query()
def train_head(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("y"), F.expr("pmod(xxhash64(vec_id), 3)").cast("int").alias("fold"))
    model = heads.train(e, "embedding", "y", "fold")
    return heads.evaluate(model, e, "embedding", "y")
