"""Best-fit packing of documents' tokens into sequences of a fixed length.

Bulk-synchronous best-fit, by classes of falling length (size/2 and more, then down to
size/3, size/4, ...). A round range-sorts the documents of a class together with the gaps
of open sequences; a gap of g tokens offers g // hi places that hold any document of the
class (lo, hi] and one place of what is left, g % hi. Each task sweeps its range: a
document goes to the successor place, the least one that holds it, and where several want
one place the largest document has it (documents are opening and places closing brackets
of the sorted order; partners are the matching ones). What a range leaves over is matched
with what the ranges below leave by ranks, for which one count a range goes to the driver.
Documents that no gap takes open new sequences, gaps are updated, and the round repeats
until the class is empty. A length that a third of all documents share is cut by
document number, so no range is hot. The tables of a round hold numbers alone, not texts.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import Scratch

#: The published split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_TEXT = ("<|endoftext|>", 50256)
#: Pieces of texts that a worker remembers, so a copy that follows is not encoded again.
REMEMBERED = 20_000
#: Classes: documents of more than size / (next divisor) and at most size / divisor tokens.
DIVISORS = (1, 2, 3, 4, 5, 7, 10, 16, 32, 128, 1024)
#: Rows (40 bytes) of a range, about.
RANGE = 50_000
#: A round opens all sequences that are needed once this share of the sequences would be enough.
LAST = 0.002


@lru_cache(maxsize=2)
def encoder(path: str):
    """Text -> uint32 ids, as tokenizers gives them for the vocabulary in path (a tokenizers file, or the same vocabulary as ranks, which is faster; texts that tiktoken refuses go by the tokenizers file beside it)."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={END_TEXT[0]: END_TEXT[1]})

        def encode(text):
            try:
                return own.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # the pattern's stack ends at a million white-space characters in a row
                return encoder(path.removesuffix(".tiktoken") + ".json")(text)

        return encode
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_remembered: dict = {}
_held: list[int] = []


def _cut(text: str, path: str, size: int, end: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc) of a text's ids and the end id; the first piece takes what is over."""
    key = (path, size, end, hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
    if key in _remembered:
        return _remembered[key]
    ids = np.append(encoder(path)(text), np.uint32(end)).astype("<u4")
    first = len(ids) if len(ids) <= size else len(ids) % size or size
    at = [0, *range(first, len(ids) + 1, size)]
    out = [(i, s, e - s, zlib.crc32(ids[s:e].data)) for i, (s, e) in enumerate(zip(at, at[1:], strict=False))]
    if len(out) < REMEMBERED // 10:
        if sum(_held) + len(out) > REMEMBERED:
            _remembered.clear()
            _held.clear()
        _remembered[key] = out
        _held.append(len(out))
    return out


def pieces(docs: DataFrame, vocabulary: str, size: int = 1024, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row of docs (doc_id, text); a null text is empty and has the end id alone."""

    def scan(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            rows = [(i, *x) for i, t in zip(ids, texts, strict=True) for x in _cut(t.as_py() or "", vocabulary, size, end)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.int64()) for j in (2, 3, 4))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, piece int, start long, length long, ids_crc32 long")


def partners(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, places): matching brackets of a sorted order; place[i] tells whether i is a place (closing) or a document."""
    depth = np.cumsum(np.where(place, -1, 1))
    level = depth + place
    order = np.lexsort((np.arange(len(place)), level))
    a, b = order[:-1], order[1:]
    pair = (level[a] == level[b]) & ~place[a] & place[b]
    return a[pair], b[pair]


ITEM, PLACE, WHOLE, MATCHED = range(4)
SWEPT = "pid int, what int, ord long, key long, size long, seq long"


def _sweep(rows: DataFrame, n: int, hi: int) -> DataFrame:
    """rows (size, what, least, key) in ranges by size; pid: a range; ord: place among what it leaves over.

    Left over are documents (ITEM), places (PLACE) and the many-fold places of gaps (WHOLE;
    size: how many, ord: those of the range before it); MATCHED has a document's sequence.
    """

    def run(batches):
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        size, what, least, key = (np.concatenate(c) for c in zip(*got, strict=True))
        pid = TaskContext.get().partitionId()
        unit = np.flatnonzero(what != WHOLE)
        doc, place = (unit[x] for x in partners(what[unit] == PLACE))
        left = np.ones(len(what), dtype=bool)
        left[doc] = left[place] = False
        many = np.flatnonzero(what == WHOLE)
        size[many] = least[many] // hi
        out = [(MATCHED, doc, np.arange(len(doc)), size[doc], key[place])]
        for kind in (ITEM, PLACE):
            at = np.flatnonzero(left & (what == kind))
            out.append((kind, at, np.arange(len(at)), size[at], key[at]))
        out.append((WHOLE, many, np.cumsum(size[many]) - size[many], size[many], key[many]))
        for kind, at, order, sizes, seq in out:
            for i in range(0, len(at), 50_000):
                j = slice(i, i + 50_000)
                m = len(at[j])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, pid, dtype=np.int32)), pa.array(np.full(m, kind, dtype=np.int32)), pa.array(order[j]), pa.array(key[at[j]]), pa.array(sizes[j]), pa.array(seq[j])], names=["pid", "what", "ord", "key", "size", "seq"])

    return rows.select("size", "what", "least", "key").repartitionByRange(n, "size", "what", "least", "key").sortWithinPartitions("size", "what", "least", "key").mapInArrow(run, SWEPT)


def settle(left: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, int]:
    """Goals of the documents that ranges leave over, from (pid, documents, places, many-fold places) of each range, ascending.

    Rows (pid, from, to, goal, number): document ord of [from, to) has number + to - 1 - ord in
    goal: a range's places (pid) or, for -1, those that no single place takes, by falling
    length. Also the number of these. A few entries a range, whatever the documents.
    """
    stack: list[tuple[int, int, int]] = []
    out = []
    for pid, docs, places, _ in left:
        at = 0
        while at < places and stack:
            p, lo, hi = stack.pop()
            take = min(places - at, hi - lo)
            out.append((p, hi - take, hi, pid, at))
            at += take
            if hi - take > lo:
                stack.append((p, lo, hi - take))
        if docs:
            stack.append((pid, 0, docs))
    rank = 0
    while stack:
        p, lo, hi = stack.pop()
        out.append((p, lo, hi, -1, rank))
        rank += hi - lo
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5), rank


def _goals(swept: DataFrame, table: np.ndarray, before: dict[int, int], wanted: int) -> DataFrame:
    """(side, goal, number, key, size): documents (side 0) and places (side 1) that are left over, so that partners share goal and number."""

    def run(batches):
        for b in batches:
            pid, what, order, key, size, seq = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns)
            out = []
            at = np.flatnonzero(what == ITEM)
            if len(at):
                index = (table[:, 0] << 40) + table[:, 1]
                row = table[np.searchsorted(index, (pid[at] << 40) + order[at], side="right") - 1]
                out.append((0, row[:, 3], row[:, 4] + row[:, 2] - 1 - order[at], key[at], size[at]))
            at = np.flatnonzero(what == PLACE)
            if len(at):
                out.append((1, pid[at], order[at], key[at], size[at]))
            at = np.flatnonzero(what == WHOLE)
            if len(at):
                first = order[at] + np.array([before[p] for p in pid[at].tolist()], dtype=np.int64)
                times = np.clip(wanted - first, 0, size[at])
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                out.append((1, np.full(len(nth), -1, dtype=np.int64), np.repeat(first, times) + nth, np.repeat(seq[at], times), np.zeros(len(nth), dtype=np.int64)))
            for side, *columns in out:
                for i in range(0, len(columns[0]), 50_000):
                    part = [pa.array(c[i : i + 50_000]) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), side, dtype=np.int32)), *part], names=["side", "goal", "number", "key", "size"])

    return swept.where(f"what <> {MATCHED}").mapInArrow(run, "side int, goal long, number long, key long, size long")


def assign(items: DataFrame, size: int, scratch: Scratch) -> list[DataFrame]:
    """Tables (id, length, seq) that together give each of items (id, length <= size) a sequence; lengths of a sequence sum to size at most."""
    spark = items.sparkSession
    bounds = sorted({size // d for d in DIVISORS} | {0}, reverse=True)
    held = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # `size` rows at most
    # two documents over half the size never share a sequence: each opens its own
    half = bounds[1]
    alone = items.where(F.col("length") > half).select("id", "length", (-1 - F.col("id")).alias("seq"))
    done, opened = [alone], sum(m for x, m in held.items() if x > half)
    gaps = alone.select("seq", (size - F.col("length")).alias("gap")).where("gap > 0")
    saved, first = None, 0
    for hi, lo in zip(bounds[1:], bounds[2:], strict=False):
        if not any(lo < x <= hi for x in held):
            continue
        left = items.where((F.col("length") > lo) & (F.col("length") <= hi)).select("id", "length")
        own = {x: m for x, m in held.items() if lo < x <= hi}
        rows, whole = sum(own.values()), sum(x * m for x, m in own.items())
        while True:
            usable = gaps.where(F.col("gap") > lo).agg(F.sum("gap").alias("s")).first()["s"] or 0
            docs = left.select(F.col("length").alias("size"), F.lit(ITEM).alias("what"), F.lit(0).cast("long").alias("least"), F.col("id").alias("key"))
            open_ = gaps.where(F.col("gap") > lo)
            one = open_.select((F.col("gap") % hi).alias("size"), F.lit(PLACE).alias("what"), F.col("gap").alias("least"), F.col("seq").alias("key")).where(F.col("size") > lo)
            many = open_.where(F.col("gap") >= hi).select(F.lit(hi).cast("long").alias("size"), F.lit(WHOLE).alias("what"), F.col("gap").alias("least"), F.col("seq").alias("key"))
            swept = scratch.save(_sweep(docs.union(one).union(many), 1 + (rows + opened) // RANGE, hi))
            counts: dict[int, list[int]] = {}
            volume = 0
            for r in swept.where(f"what <> {MATCHED}").groupBy("pid", "what").agg(F.count("*").alias("m"), F.sum("size").alias("s")).collect():  # 3 rows a range
                counts.setdefault(r["pid"], [0, 0, 0])[r["what"]] = r["s"] if r["what"] == WHOLE else r["m"]
                volume += r["s"] if r["what"] == ITEM else 0
            table, rank = settle([(p, *counts[p]) for p in sorted(counts)])
            before, places = {}, 0
            for p in sorted(counts):
                before[p], places = places, places + counts[p][WHOLE]
            # what is left opens sequences of size // hi documents each: as many as its tokens need beyond the gaps, or all
            each, wanting = size // hi, max(0, rank - places)
            fresh = -(-wanting // each)
            rest = volume * wanting / max(1, rank)
            room = usable - (whole - rest) if 10 * (rows - wanting) >= rows else 0.0
            fewest = math.ceil(max(0.0, rest - max(0.0, room)) / size)
            if fresh - fewest > LAST * (opened + fresh):
                fresh = fewest
            goals = _goals(swept, table, before, rank)
            here = goals.where("side = 0")
            there = goals.where("side = 1").select("goal", "number", F.col("key").alias("place"))
            new = F.col("number") - F.lit(places)
            seq = F.coalesce("place", F.when((F.col("goal") == -1) & (new >= 0) & (new < fresh * each), F.lit(first) + F.floor(new / each)))
            met = here.join(there, ["goal", "number"], "left").select(F.col("key").alias("id"), F.col("size").alias("length"), seq.cast("long").alias("seq"))
            placed = scratch.save(swept.where(f"what = {MATCHED}").select(F.col("key").alias("id"), F.col("size").alias("length"), "seq").union(met))
            scratch.drop(swept)
            done.append(placed.where("seq is not null"))
            more = spark.range(first, first + fresh, 1, 1 + fresh // RANGE).select(F.col("id").alias("seq"), F.lit(size).cast("long").alias("gap"))
            taken = placed.where("seq is not null").select("seq", (-F.col("length")).alias("gap"))
            gaps = scratch.save(gaps.union(more).union(taken).groupBy("seq").agg(F.sum("gap").alias("gap")).where("gap > 0"))
            if saved is not None:
                scratch.drop(saved)
            saved = gaps
            first, opened = first + fresh, opened + fresh
            if wanting <= fresh * each:
                break
            left = placed.where("seq is null").select("id", "length")
            hi, whole, rows = left.agg(F.max("length"), F.sum("length"), F.count("*")).first()
    if saved is not None:
        scratch.drop(saved)
    return done


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row of docs.

    Repeated rows are packed each; null texts are empty; the order of rows does not
    matter. No document is dropped, and only those over `size` are cut.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    every = scratch.save(pieces(docs, vocabulary, size, end).withColumn("id", F.monotonically_increasing_id()))
    done = assign(every.select("id", "length"), size, scratch)
    where = done[0]
    for x in done[1:]:
        where = where.union(x)
    of = Window.partitionBy("seq").orderBy(F.desc("length"), "id")  # a sequence has `size` pieces at most
    placed = every.join(where.select("id", "seq"), "id").withColumn("offset", F.sum("length").over(of) - F.col("length"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")
