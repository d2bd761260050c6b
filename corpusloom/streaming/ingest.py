"""Structured Streaming ingest of candidate paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.sources.corpora import PARAGRAPHS


def deduplicated_stream(spark: SparkSession, source: str, kept: str, state: str, trigger: str = "1 second") -> StreamingQuery:
    """Append the texts of arriving record files to the table ``kept``, each text once.

    Every micro-batch is deduplicated in itself and against what is kept, so the streaming state holds no texts and a restart goes on from ``state``.
    A batch that is replayed after a failure finds its rows kept already.
    """

    def keep(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        rows = batch.where("text is not null").withColumn("text_hash", F.sha2("text", 256)).dropDuplicates(["text_hash"])
        path = session._jvm.org.apache.hadoop.fs.Path(kept)
        if path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path):
            rows = rows.join(session.read.parquet(kept).select("text_hash"), "text_hash", "left_anti")
        rows.write.mode("append").parquet(kept)

    stream = spark.readStream.schema(PARAGRAPHS).json(source)
    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(processingTime=trigger).start()
