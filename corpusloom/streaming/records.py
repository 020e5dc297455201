"""The record log as a stream: appended files are read once, and the latest record of each key is kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import collection, latest, upsert


def follow(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str, keys: list[str], seq: str = "seq"):
    """Start a query that takes in all files that are there (and ends); run it again to take in what was added since.

    Each batch is reduced to its last record by key, and only replaces older ones. Since the table is keyed, a batch that runs
    again after a failure changes nothing.
    """

    def take(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        new = latest(batch, keys, seq)
        if (old := collection(session, table)) is not None:
            newer = old.select(*keys, seq).withColumnRenamed(seq, "__seen")
            new = new.join(newer, keys, "left").filter(f"__seen is null or {seq} >= __seen").drop("__seen")
        if not new.isEmpty():
            key = "__key"
            from pyspark.sql import functions as F

            upsert(session, table, new.withColumn(key, F.to_json(F.struct(*keys))), key)

    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
