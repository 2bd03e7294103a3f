"""Pick files of a day, rule-based and neural."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import origin_time, parse_time

RULE_BASED = "net_sta string, sta_ot string, tp string, ts string, s_amp double, p_snr double, fd double, amp_ratio double, a12 double, a13 double"
NEURAL = "net_sta string, tp string, ts string, s_amp double, p_prob double, s_prob double"


def _times(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({f"{n}_us": parse_time(F.col(n)) for n in names}).drop(*names)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    got = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return got is not None and len(got) > 0


def read_picks(spark: SparkSession, path: str) -> DataFrame:
    """Rule-based picks of files `<date>.pick` (a path or glob); no file, no rows. The columns are given, so nothing is inferred."""
    if not _exists(spark, path):
        return _times(spark.createDataFrame([], RULE_BASED), "sta_ot", "tp", "ts")
    return _times(spark.read.schema(RULE_BASED).csv(path), "sta_ot", "tp", "ts")


def read_neural_picks(spark: SparkSession, path: str, vp: float = 6.0, vs: float = 3.45) -> DataFrame:
    """Neural picks; the origin time comes from these velocities (the reader's own defaults). A missing file is an error."""
    got = _times(spark.read.schema(NEURAL).csv(path), "tp", "ts")
    return got.withColumn("sta_ot_us", origin_time(F.col("tp_us"), F.col("ts_us"), vp, vs))
