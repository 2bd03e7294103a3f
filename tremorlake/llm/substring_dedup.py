"""Substring dedup: drop words covered by a window of words that also starts earlier in the corpus.

Difference-cover anchors: with D a difference cover modulo v, two equal windows of w
words have, at some shift below v, places that are both in D modulo v; so hashing the
(w - v + 1)-word anchors at those places alone finds every repeated window (for w = 20:
v = 13, D = {0, 1, 3, 9}, anchors of 8 words, at 4 of 13 places). Anchors seen at two
places mark their documents; only windows that hold a marked anchor are then extended to
their full length, hashed, and judged by their first place. Whole copies of a document
count once: the copy with the smallest doc_id stands for them, the others lose all words.
Each map task sends one entry for a hash, so a passage in a third of all documents costs
a reducer one entry per task, not per document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Bloom, Scratch, binary, deal, parts, signed, split_by, together
from .textkernel import U64, Words, mix, slices

#: Difference covers: modulus -> residues whose differences give every residue.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
FLUSH = 1 << 20
LAST_ID = 2**63 - 1
ANCHOR = np.dtype([("h", "<u8"), ("fp", "<u8"), ("pos", "<i4"), ("many", "<i4")])
PLACE = np.dtype([("fp", "<u8"), ("pos", "<i4")])
WINDOW = np.dtype([("h", "<u8"), ("id", "<i8"), ("key", "<u8"), ("pos", "<i4")])


def cover(window: int) -> tuple[int, tuple[int, ...], int]:
    """(modulus, residues, anchor length): the largest cover whose anchors have a third of the window or more."""
    v = max(v for v in COVERS if window - v + 1 >= max(1, window // 3))
    return v, COVERS[v], window - v + 1


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(0).fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _key(fp: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(fp + mix(ids.view(np.uint64)))


def _text_fp(words: Words) -> np.ndarray:
    return words.spans(words.bounds[:-1], words.bounds[1:])


def _places(words: Words) -> np.ndarray:
    return np.arange(len(words.hashes)) - words.bounds[:-1][words.text_of_word()]


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, key, n_words, sha) of each row; fp: of its words in order; sha: of all words joined."""

    def scan(batches):
        for rows, data, offsets in slices(batches, "text"):
            w = Words(data, offsets)
            fp, raw = _text_fp(w), data.tobytes()
            sha = []
            for i in range(rows.num_rows):
                lo, hi = w.bounds[i], w.bounds[i + 1]
                sha.append(hashlib.sha256(b" ".join(raw[s:e] for s, e in zip(w.starts[lo:hi].tolist(), w.ends[lo:hi].tolist(), strict=True))).digest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(signed(fp)), pa.array(signed(_key(fp, _ids(rows)))), pa.array(w.counts.astype(np.int64)), pa.array(sha, pa.binary())], names=["doc_id", "fp", "key", "n_words", "sha"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, fp long, key long, n_words long, sha binary")


def _marks(docs: DataFrame, window: int) -> DataFrame:
    """(fp, places): places of anchors that stand at two places, as int32."""
    n_parts = parts(docs.sparkSession)
    v, residues, length = cover(window)
    chosen = np.isin(np.arange(v), residues)

    def pack(kind, to, a):
        out = split_by(to, n_parts, a)
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([kind] * len(out), pa.int32()), binary([x[0] for _, x in out])], names=["bucket", "kind", "data"])

    def home(fp):
        return ((mix(fp) >> U64(8)) % U64(n_parts)).astype(np.int64)

    def places(a):
        out = np.zeros(len(a), dtype=PLACE)
        out["fp"], out["pos"] = a["fp"], a["pos"]
        return out

    def runs(a):
        """Sorted without repeated places; where each hash begins; how many places it has."""
        a = a[np.lexsort((a["pos"], a["fp"], a["h"]))]
        new = np.ones(len(a), dtype=bool)
        new[1:] = a["h"][1:] != a["h"][:-1]
        again = np.zeros(len(a), dtype=bool)
        again[1:] = ~new[1:] & (a["fp"][1:] == a["fp"][:-1]) & (a["pos"][1:] == a["pos"][:-1])
        many = np.maximum.reduceat(a["many"], np.flatnonzero(new)) if len(a) else np.zeros(0, np.int32)
        a, new = a[~again], new[~again]
        start = np.flatnonzero(new)
        return a, start, np.diff(np.append(start, len(a))), many

    def emit(batches):
        seen, held, size = np.zeros(0, dtype=np.uint64), [], 0

        def flush():
            a, start, n, _ = runs(np.concatenate(held))
            twice = np.repeat(n > 1, n)
            one = a[start]
            one["many"] = n > 1
            yield pack(0, ((mix(one["h"]) >> U64(8)) % U64(n_parts)).astype(np.int64), one)
            if twice.any():
                marked = places(a[twice])
                yield pack(1, home(marked["fp"]), marked)

        for _, data, offsets in slices(batches, "text"):
            w = Words(data, offsets)
            fp = _text_fp(w)
            first = np.zeros(len(fp), dtype=bool)
            first[np.unique(fp, return_index=True)[1]] = True
            first &= (w.counts >= window) & ~np.isin(fp, seen)
            seen = np.concatenate([seen, fp[first]])
            h, whole = w.windows(length)
            pos, of = _places(w), w.text_of_word()
            take = whole & chosen[pos % v] & first[of]
            a = np.zeros(int(take.sum()), dtype=ANCHOR)
            a["h"], a["fp"], a["pos"] = h[take], fp[of[take]], pos[take]
            held.append(a)
            size += len(a)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def meet(batches):
        got = []
        for b in batches:
            for kind, bucket, data in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if kind:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "data"])
                else:
                    got.append(np.frombuffer(data, dtype=ANCHOR))
        if got:
            a, start, n, many = runs(np.concatenate(got))
            marked = places(a[np.repeat((n > 1) | (many > 0), n)])
            out = split_by(home(marked["fp"]), n_parts, marked)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), binary([x[0] for _, x in out])], names=["bucket", "data"])

    def gather(batches):
        got = [together(b.column(1).to_pylist(), PLACE) for b in batches]
        if got:
            a = np.unique(np.concatenate(got))
            start = np.flatnonzero(np.append(True, a["fp"][1:] != a["fp"][:-1])) if len(a) else np.zeros(0, dtype=np.int64)
            for i in range(0, len(start), 5000):
                lo = start[i : i + 5001]
                ends = np.append(lo[1:], len(a))[: len(lo[:5000])]
                yield pa.RecordBatch.from_arrays([pa.array(signed(a["fp"][lo[:5000]].copy())), binary([a["pos"][s:e] for s, e in zip(lo[:5000], ends, strict=True)])], names=["fp", "places"])

    sent = docs.select("doc_id", "text").mapInArrow(emit, "bucket int, kind int, data binary")
    met = deal(sent, n_parts).mapInArrow(meet, "bucket int, data binary")
    return deal(met, n_parts).mapInArrow(gather, "fp long, places binary")


def _with_text(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows of docs whose key is in notes (key, places), dealt so that notes and texts of a key meet: notes first."""
    spark, n_parts = docs.sparkSession, parts(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Bloom.build(notes, "key"))  # Bloom.BITS / 8 bytes

    def pick(batches):
        has = Bloom(shared.value).has
        for rows, data, offsets in slices(batches, "text"):
            key = _key(_text_fp(Words(data, offsets)), _ids(rows))
            at = np.flatnonzero(has(key))
            if len(at):
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(((mix(key[at]) >> U64(8)) % U64(n_parts)).astype(np.int32)), pa.array([1] * m, pa.int32()), pa.array(signed(key[at])), pa.array(_ids(rows)[at]), rows.column(1).take(pa.array(at)), pa.nulls(m, pa.binary())], names=names)

    def note(batches):
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            m = len(key)
            yield pa.RecordBatch.from_arrays([pa.array(((mix(key) >> U64(8)) % U64(n_parts)).astype(np.int32)), pa.array([0] * m, pa.int32()), b.column(0), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), b.column(1)], names=names)

    names = ["bucket", "kind", "key", "id", "text", "places"]
    schema = "bucket int, kind int, key long, id long, text string, places binary"
    both = notes.select("key", "places").mapInArrow(note, schema).union(docs.select("doc_id", "text").mapInArrow(pick, schema))
    return deal(both, n_parts).sortWithinPartitions("kind")


def _met(batches):
    """(ids, keys, words, places) slices of the texts whose key has notes; places: a list by text."""
    notes: dict[int, bytes] = {}
    for b in batches:
        kinds = b.column(1).to_numpy(zero_copy_only=False)
        keys = b.column(2).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(kinds == 0):
            k = int(keys[i])
            notes[k] = notes.get(k, b"") + b.column(5)[i].as_py()
        at = [i for i in np.flatnonzero(kinds == 1) if int(keys[i]) in notes]
        if at:
            own = b.take(pa.array(at))
            for rows, data, offsets in slices(iter([own]), "text"):
                k = rows.column(2).to_numpy(zero_copy_only=False)
                yield rows.column(3).to_numpy(zero_copy_only=False), k.view(np.uint64), Words(data, offsets), [np.frombuffer(notes[int(x)], dtype=np.int32) for x in k]


def _repeats(docs: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """(key, places): starts of windows that also start earlier."""
    n_parts = parts(docs.sparkSession)
    length = cover(window)[2]

    def split(a):
        """First places of each hash, and the later ones."""
        a = a[np.lexsort((a["pos"], a["key"], a["id"], a["h"]))]
        new = np.ones(len(a), dtype=bool)
        new[1:] = a["h"][1:] != a["h"][:-1]
        start = np.flatnonzero(new)
        lead = np.repeat(start, np.diff(np.append(start, len(a))))
        same = (a["id"] == a["id"][lead]) & (a["key"] == a["key"][lead]) & (a["pos"] == a["pos"][lead])
        return a[new], a[~same]

    def pack(kind, to, data):
        out = split_by(to, n_parts, data)
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([kind] * len(out), pa.int32()), binary([x[0] for _, x in out])], names=["bucket", "kind", "data"])

    def late(a):
        out = np.zeros(len(a), dtype=PLACE)
        out["fp"], out["pos"] = a["key"], a["pos"]
        return out

    def home(key):
        return ((mix(key) >> U64(8)) % U64(n_parts)).astype(np.int64)

    def emit(batches):
        held, size = [], 0

        def flush():
            first, rest = split(np.concatenate(held))
            yield pack(0, ((mix(first["h"]) >> U64(8)) % U64(n_parts)).astype(np.int64), first)
            if len(rest):
                r = late(rest)
                yield pack(1, home(r["fp"]), r)

        for ids, keys, w, places in _met(batches):
            h, whole = w.windows(window)
            change = np.zeros(len(h) + 1, dtype=np.int32)
            n = [len(p) for p in places]
            base = np.repeat(w.bounds[:-1], n)
            p = base + np.concatenate(places)
            np.add.at(change, np.maximum(p - (window - length), base), 1)
            np.add.at(change, p + 1, -1)
            take = whole & (np.cumsum(change)[:-1] > 0)
            of = w.text_of_word()
            a = np.zeros(int(take.sum()), dtype=WINDOW)
            a["h"], a["id"], a["key"], a["pos"] = h[take], ids[of[take]], keys[of[take]], _places(w)[take]
            held.append(a)
            size += len(a)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def meet(batches):
        got = []
        for b in batches:
            for bucket, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if kind:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "data"])
                else:
                    got.append(np.frombuffer(data, dtype=WINDOW))
        if got:
            rest = late(split(np.concatenate(got))[1])
            out = split_by(home(rest["fp"]), n_parts, rest)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), binary([x[0] for _, x in out])], names=["bucket", "data"])

    def gather(batches):
        got = [together(b.column(1).to_pylist(), PLACE) for b in batches]
        if got:
            a = np.unique(np.concatenate(got))
            start = np.flatnonzero(np.append(True, a["fp"][1:] != a["fp"][:-1])) if len(a) else np.zeros(0, dtype=np.int64)
            ends = np.append(start[1:], len(a))
            for i in range(0, len(start), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(signed(a["fp"][start[i : i + 5000]].copy())), binary([a["pos"][s:e] for s, e in zip(start[i : i + 5000], ends[i : i + 5000], strict=True)])], names=["key", "places"])

    sent = _with_text(docs, marks).mapInArrow(emit, "bucket int, kind int, data binary")
    met = deal(sent, n_parts).mapInArrow(meet, "bucket int, data binary")
    return deal(met, n_parts).mapInArrow(gather, "key long, places binary")


def _kept(docs: DataFrame, repeats: DataFrame, window: int) -> DataFrame:
    """(key, removed, kept): word numbers lo:hi that go (int32 pairs) and the words that stay, joined by spaces."""

    def cut(batches):
        for _, keys, w, places in _met(batches):
            raw, out = w.data.tobytes(), []
            for i, (k, p) in enumerate(zip(keys, places, strict=True)):
                lo, hi = int(w.bounds[i]), int(w.bounds[i + 1])
                change = np.zeros(hi - lo + 1, dtype=np.int32)
                np.add.at(change, p, 1)
                np.add.at(change, p + window, -1)
                gone = np.cumsum(change)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                stay = lo + np.flatnonzero(~gone)
                out.append((k, edge.astype(np.int32).tobytes(), b" ".join(raw[s:e] for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist(), strict=True)), int(gone.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(np.array([x[0] for x in out], dtype=np.uint64).view(np.int64)), pa.array([x[1] for x in out], pa.binary()), pa.array([hashlib.sha256(x[2]).digest() for x in out], pa.binary()), pa.array([x[3] for x in out], pa.int64())], names=["key", "removed", "kept_sha", "n_removed"])

    return _with_text(docs, repeats).mapInArrow(cut, "key long, removed binary, kept_sha binary, n_removed long")


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (word numbers lo, hi of each removed run, as little-endian int32) of each row.

    Null and empty texts have no words. Rows with the same words and doc_id are one
    document given twice and get the same result; rows with a null doc_id come last, and
    rows that share a doc_id with other words are ordered among themselves by a hash.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    every = scratch.save(_documents(docs))
    marks = _marks(docs, window)
    order = F.coalesce("doc_id", F.lit(LAST_ID))
    lead = every.where(F.col("n_words") >= window).groupBy("fp").agg(F.min(F.struct(order.alias("id"), "key")).alias("lead")).select("fp", "lead.key")
    noted = scratch.save(marks.join(lead, "fp").select("key", "places"))
    repeats = scratch.save(_repeats(docs, noted, window))
    cut = scratch.save(_kept(docs, repeats, window).dropDuplicates(["key"]))
    scratch.drop(noted, repeats)
    nothing = hashlib.sha256(b"").hexdigest()
    own = every.join(lead.select("fp", F.col("key").alias("lead")), "fp", "left").join(cut, "key", "left")
    copy = (F.col("n_words") >= window) & (F.col("key") != F.col("lead"))
    return own.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
        F.when(copy, F.unhex(F.concat(F.lit("00000000"), *[F.lpad(F.hex(F.shiftright("n_words", s).bitwiseAND(255)), 2, "0") for s in (0, 8, 16, 24)]))).otherwise(F.coalesce("removed", F.lit(b""))).alias("removed"),
    )
