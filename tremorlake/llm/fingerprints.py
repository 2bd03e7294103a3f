"""Document fingerprints: MinHash signatures over word shingles, banded near-duplicate search.

A signature holds, for each of `permutations` universal hash functions
h(x) = (a x + b) mod 2**64, its top 32 bits' least value over the text's distinct k-word
shingles, computed in vectorised numpy; two signatures agree in a place with the
probability of the sets' Jaccard similarity. Bands of signature rows are joined in Spark,
and candidates are verified by the Jaccard similarity of the sets themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import Bloom, Scratch, deal, parts, prepare, signed
from .jaccard_join import join_regions, needed_sets, sets_of
from .textkernel import U64, Words, buffers, mix, slices

SEED = 11
EMPTY = np.uint32(0xFFFFFFFF)
#: Shingles that are hashed at a time, which keeps the work in the CPU's cache.
CHUNK = 1 << 13


def coefficients(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(SEED)
    return g.integers(0, 2**63, permutations, dtype=np.uint64) * U64(2) + U64(1), g.integers(0, 2**63, permutations, dtype=np.uint64) * U64(2)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and bounds of each text, in order, repeats kept; with fewer than k words, the whole sequence."""
    w = Words(data, offsets, lower=True)
    n = len(w.hashes)
    hi = np.minimum(np.arange(n) + k, np.repeat(w.bounds[1:], w.counts))
    first = np.arange(n) == np.repeat(w.bounds[:-1], w.counts)
    take = (hi - np.arange(n) == k) | first
    h = w.spans(np.flatnonzero(take), hi[take])
    return h, np.concatenate([[0], np.cumsum(take)])[w.bounds]


def signatures(h: np.ndarray, bounds: np.ndarray, permutations: int) -> np.ndarray:
    """uint32 (texts, permutations) of the shingle hashes of each text; all ones for a text without words."""
    a, b = coefficients(permutations)
    out = np.full((len(bounds) - 1, permutations), EMPTY)
    buf = np.empty(CHUNK, dtype=np.uint64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for lo in range(0, len(h), CHUNK):
        part = h[lo : lo + CHUNK]
        own = text[lo : lo + CHUNK]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        rows = own[start]
        low = np.empty((permutations, len(start)), dtype=np.uint64)
        x = buf[: len(part)]
        for j in range(permutations):
            np.multiply(part, a[j], out=x)
            np.add(x, b[j], out=x)
            np.minimum.reduceat(x, start, out=low[j])
        out[rows] = np.minimum(out[rows], (low >> U64(32)).astype(np.uint32).T)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal places of two rows of signatures."""
    return (x == y).mean(axis=1)


def signature_table(docs: DataFrame, k: int = 5, permutations: int = 128) -> DataFrame:
    """(doc_id, signature): big-endian uint32 values as binary, of each row of docs."""
    prepare(docs.sparkSession)

    def scan(batches):
        for rows, data, offsets in slices(batches, "text"):
            sig = signatures(*shingles(data, offsets, k), permutations)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in sig.astype(">u4")], pa.binary())], names=["doc_id", "signature"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, signature binary")


def _longs(values: list[int | None]) -> Column:
    """An array of these, which the optimizer folds to one literal."""
    return F.transform(F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ","), lambda x: x.try_cast("long"))


def _rank(edges: list[int], x: Column) -> Column:
    """Number of edges (ascending) that are x or more, by bisection."""
    array = _longs(edges)
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi"))

    def step(s, _):
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        open_, below = s["lo"] < s["hi"], F.get(array, mid) < x
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"))

    return F.lit(len(edges)) - F.aggregate(F.sequence(F.lit(1), F.lit(len(edges).bit_length())), start, step, lambda s: s["lo"])


def _next_rows(docs: DataFrame, n: int) -> DataFrame:
    """Rows (bucket, tail, doc_id, text) in buckets of consecutive doc_ids, descending; tail: the first row of the next bucket, given once more.

    Buckets are cut at quantiles of doc_id; a doc_id is never split, so bucket edges are
    decided by ids alone, before any text moves. A row finds its bucket by bisection in one
    array literal of edges.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    cuts = sorted({int(x) for x in ids.select(F.col("id").cast("double")).approxQuantile("id", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    # bucket 0 has the largest ids
    bucket = _rank(cuts, F.col("id")) if cuts else F.lit(0)
    heads = sorted(map(tuple, ids.select(bucket.alias("bucket"), "id").groupBy("bucket").agg(F.max("id")).collect()))  # one row a bucket
    number, head, before = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1), [None] * (len(cuts) + 1)
    for i, (b, first) in enumerate(heads):
        number[b], head[b], before[b] = i, first, (i - 1) % len(heads)  # the first document follows the last one
    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "doc_id", "text")
    at = lambda values: F.get(_longs(values), F.col("b")).cast("long")
    own = rows.select(bucket.alias("b"), "id", "doc_id", "text").select(at(number).cast("int").alias("bucket"), "id", "doc_id", "text", F.when(at(head) == F.col("id"), at(before).cast("int")).alias("extra"))
    both = F.when(F.col("extra").isNull(), F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("tail")))).otherwise(F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("tail")), F.struct(F.col("extra").alias("to"), F.lit(True).alias("tail"))))
    out = own.select(F.explode(both).alias("x"), "id", "doc_id", "text").select(F.col("x.to").alias("bucket"), F.col("x.tail").alias("tail"), "id", "doc_id", "text")
    return deal(out, max(1, len(heads))).sortWithinPartitions("tail", F.desc("id"), F.desc_nulls_last("text"))


def edited_fingerprints(docs: DataFrame, k: int = 5, permutations: int = 128) -> DataFrame:
    """The fingerprint of each text, of its edited text, and their likeness to each other and to the next document's.

    Order: doc_id descending, rows with equal doc_id by text descending, null doc_id last;
    the first follows the last (a single row follows itself). Edited: the last
    floor(n_chars / 3) code points give way to as many first ones of the next text (or
    all of it). Null texts are empty; texts without words have equal fingerprints.
    """
    prepare(docs.sparkSession)
    n = parts(docs.sparkSession)

    def run(batches):
        held: pa.RecordBatch | None = None

        def work(rows: pa.RecordBatch, following: str):
            texts = [x or "" for x in rows.column(4).to_pylist()]
            nexts = texts[1:] + [following]
            cut = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(texts, nexts, strict=True)]
            sides = []
            for side in (texts + [following], cut):
                data, offsets = buffers(pa.array(side, pa.large_string()))
                got, i = [], 0
                while i < len(side):
                    j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (2 << 20), side="right")) - 1)
                    got.append(signatures(*shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k), permutations))
                    i = j
                sides.append(np.concatenate(got))
            own, edited = sides[0][:-1], sides[1]
            hexes = lambda s: pa.array([x.tobytes().hex() for x in s.astype(">u4")])
            return pa.RecordBatch.from_arrays(
                [rows.column(3), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in cut]), hexes(own), hexes(edited), pa.array(likeness(own, edited)), pa.array(likeness(own, sides[0][1:]))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        def singles():
            for b in batches:
                for rows, _, _ in slices(iter([b]), "text"):
                    yield rows

        for rows in singles():
            tails = rows.column(1).to_numpy(zero_copy_only=False)
            own = int((~tails).sum())
            if held is not None:
                yield work(held, rows.column(4)[0].as_py() or "")
                held = None
            if own == rows.num_rows:
                held = rows
            else:  # of rows that share the next bucket's first doc_id, the first in order is next
                if own:
                    yield work(rows.slice(0, own), rows.column(4)[own].as_py() or "")
                return

    return _next_rows(docs, n).select("bucket", "tail", "id", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 3, den: int = 4, permutations: int = 128, bands: int = 32, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, class_id): documents joined by verified links of Jaccard similarity num/den or more among band candidates.

    Rows with equal sets are one candidate. Documents that share a band key are a region,
    and regions with the same members are one; in them join_regions compares pivots with
    members and goes on with those that the triangle inequality leaves open, so a group of
    g copies costs g comparisons, not g squared, and no candidate pair that could join
    classes is left out. With 32 bands of 4 rows a pair of similarity 0.75 meets with
    probability above 0.999. Texts without words are classes of their own; class_id is the
    smallest doc_id (null rows lend none).
    """
    scratch, rows = scratch or Scratch(docs.sparkSession, "minhash"), permutations // bands

    def scan(batches):
        for part, h, bounds, n, fp in sets_of(batches, "text", k):
            sig = signatures(h, bounds, permutations)
            keys = np.zeros((len(sig), bands), dtype=np.uint64)
            for i in range(bands):
                x = np.full(len(sig), i + 1, dtype=np.uint64)
                for j in range(rows):
                    x = mix(x + sig[:, i * rows + j].astype(np.uint64))
                keys[:, i] = x
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * bands, pa.int32()), pa.array(signed(keys.ravel())))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed(fp)), pa.array(n, pa.int32()), flat], names=["doc_id", "fp", "n", "keys"])

    every = scratch.save(docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, fp long, n int, keys array<long>"))
    one = scratch.save(every.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("keys").alias("keys")))
    meet = one.select("fp", "n", F.explode("keys").alias("rid"))
    held = meet.groupBy("rid").agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(fp))").alias("who")).where("m > 1")
    regions = scratch.save(held.groupBy("m", "who").agg(F.min("rid").alias("rid")).select("rid"))
    shared = docs.sparkSession.sparkContext.broadcast(Bloom.build(regions, "rid"))  # Bloom.BITS / 8 bytes

    def members(batches):
        bloom = Bloom(shared.value)
        for b in batches:
            keys = b.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.flatnonzero(bloom.has(keys))
            of = pa.array(at // bands)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys[at])), b.column(0).take(of), b.column(1).take(of), pa.array(np.zeros(len(at), dtype=np.int32))], names=["rid", "fp", "n", "place"])

    near = scratch.save(one.select("fp", "n", "keys").mapInArrow(members, "rid long, fp long, n int, place int").join(regions, "rid", "left_semi"))
    scratch.drop(one, regions)
    sets = scratch.save(needed_sets(docs, k, Bloom.build(near, "fp")))
    _, roots = join_regions(near, sets, scratch, num, den)
    named = every.select("doc_id", "fp", "n").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "fp")))
    class_id = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = scratch.save(named.join(class_id, "root", "left").select("doc_id", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("class_id")))
    scratch.keep_only(out)
    return out
