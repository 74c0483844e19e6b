"""How many parts the rows of a large join are dealt out to."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Fixed value: bytes of files behind the rows of one part; about 350,000 edges of the test tables, and fewer of a published graph.
BYTES_OF_PART = 4 << 20


def parts(*frames: DataFrame) -> int:
    """One for every ``BYTES_OF_PART`` of the files that the rows come from, each file once; the session's own number at least.

    So what a task holds doesn't grow with the tables, whatever number is set and however few tasks the planner would
    make of it.  Rows that come from no files (local ones, checkpoints) are dealt out by the session's number.
    """
    spark = frames[0].sparkSession
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for name in {name for df in frames for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        found += path.getFileSystem(conf).getFileStatus(path).getLen()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found // BYTES_OF_PART))
