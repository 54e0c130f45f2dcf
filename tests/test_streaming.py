import os
import tempfile

from lexiflow.streaming.ingest import document_stream, stream_counts


def test_stream_counts_match_batch(spark):
    src = tempfile.mkdtemp(prefix="lexiflow-stream-src-")
    spark.createDataFrame([(1, "This is a text."), (2, "This is another one.")],
                          "doc_id long, text string").write.mode("append").parquet(src)
    stream = stream_counts(document_stream(spark, src, "doc_id long, text string"))
    q = stream.writeStream.format("memory").queryName("lexiflow_counts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT doc_id, term, n FROM lexiflow_counts").collect())
    assert got == [(1, "a", 1), (1, "is", 1), (1, "text", 1), (1, "this", 1),
                   (2, "another", 1), (2, "is", 1), (2, "one", 1), (2, "this", 1)]
    assert os.path.isdir(src)
