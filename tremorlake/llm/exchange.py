"""Shared plumbing: scratch tables in the cluster's shared folder, dealt partitions, bounded filters."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Arrow data in a batch sent to Python.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or set as checkpoint folder.

    Where neither is, a temporary folder that is set for the session, but on one machine
    (local master, as in tests) alone: on a cluster executors would not share it.
    """
    sc = spark.sparkContext
    got = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        there = sc._jsc.sc().getCheckpointDir()
        if there.isDefined():
            return there.get()
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = os.path.join(tempfile.gettempdir(), f"tremorlake-shared-{os.getpid()}")
        sc.setCheckpointDir(got)
    return got


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that Python workers get, which bounds their memory for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def parts(spark: SparkSession) -> int:
    """Partitions to deal to: spark.sql.shuffle.partitions, which a user sizes by the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Written tables of one query under the shared folder.

    save() cuts lineage as checkpoint() does, but columnar and compressed, and lets Spark
    drop the shuffle files behind it; a lost executor costs a reread only.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = prepare(spark)
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        del df
        self.spark.sparkContext._jvm.System.gc()
        return out

    def _delete(self, where: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *saved: DataFrame) -> None:
        """Removes saved tables that nothing reads any more."""
        for df in saved:
            self._delete(df._scratch)

    def keep_only(self, *saved: DataFrame) -> None:
        """Removes all tables but these (or those that these, marked with _scratch, read)."""
        kept = {df._scratch for df in saved}
        for i in range(self.n):
            if f"{self.root}/{i}" not in kept:
                self._delete(f"{self.root}/{i}")


def deal(df: DataFrame, n: int, by: str = "bucket") -> DataFrame:
    """Rows to partition number `by`, below n."""
    return df.repartitionById(n, F.col(by).cast("int"))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def split_by(bucket: np.ndarray, n: int, *columns: np.ndarray) -> list[tuple[int, list[np.ndarray]]]:
    """(bucket, its part of each column) of buckets that have rows."""
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    return [(b, [c[at[b] : at[b + 1]] for c in columns]) for b in range(n) if at[b + 1] > at[b]]


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], type=pa.binary())


def together(column: list[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype)


class Bloom:
    """A filter of 64-bit hashes with a fixed number of bits: 2 probes, never a false negative.

    It is broadcast; its size is set by BITS alone, not by the data. When overfull it
    lets more pass, and results stay the same.
    """

    BITS = 1 << 25

    @staticmethod
    def probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = h.astype(np.uint64, copy=False)
        mask = np.uint64(Bloom.BITS - 1)
        return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)

    @staticmethod
    def build(df: DataFrame, column: str) -> bytes:
        """The packed bits of a long column, merged on executors slice by slice."""
        spark, width = df.sparkSession, Bloom.BITS // 8 // 64

        def local(batches):
            bits = np.zeros(Bloom.BITS, dtype=bool)
            for b in batches:
                for p in Bloom.probes(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                    bits[p] = True
            packed = np.packbits(bits)
            if packed.any():
                yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), binary(list(packed.reshape(64, width)))], names=["bucket", "bits"])

        def merge(batches):
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    a = out.setdefault(k, np.zeros(width, dtype=np.uint8))
                    a |= np.frombuffer(v, dtype=np.uint8)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), binary(list(out.values()))], names=["bucket", "bits"])

        schema = "bucket int, bits binary"
        n = min(64, parts(spark))
        got = deal(df.select(column).mapInArrow(local, schema).withColumn("to", F.col("bucket") % n), n, "to").select("bucket", "bits").mapInArrow(merge, schema).collect()
        whole = np.zeros((64, width), dtype=np.uint8)
        for r in got:
            whole[r["bucket"]] = np.frombuffer(r["bits"], dtype=np.uint8)
        return whole.tobytes()

    def __init__(self, packed: bytes):
        self.bits = np.frombuffer(packed, dtype=np.uint8)

    def __contains__(self, _):
        raise TypeError("use has()")

    def has(self, h: np.ndarray) -> np.ndarray:
        p, q = self.probes(h)
        test = lambda x: (self.bits[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1
        return (test(p) & test(q)).astype(bool)
