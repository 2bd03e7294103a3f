"""N-gram Jaccard join: exact self-join of documents in the Jaccard metric space.

Shingle sets are points; d(x, y) = 1 - |x & y| / |x | y| is a metric. The space is cut
into regions, one per shingle that could be the rarest shared one of a linked pair: two
sets within radius r share one of the first n - ceil((1 - r) n) + 1 shingles of each, in
any fixed order, here by corpus frequency class, so regions hold few strangers. Regions
are then joined recursively. A pivot (the member with the smallest share of rarer
shingles, which copies stand around) is compared with all members; members that its ball
of radius r or any other region joins are one component, whose inner pairs need no look.
Of what is left in a region, a member goes on only where the triangle inequality lets it
link to a member of another component (d(z, p) within r of d(x, p)); with 16**k pivots in
round k, which leave the region once compared, rounds stay few. So a group of g copies
takes g comparisons, not g squared, and no link that joins components is missed. Equal
sets are one point.

Postings of very frequent shingles are salted on their way, and regions are held as rows,
so no task holds a whole hot region.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .exchange import Bloom, Scratch, binary, deal, parts, signed, split_by, together
from .textkernel import U64, Words, blobs, mix, shingle_sets, slices, unblob

#: Cells of the frequency sketch; it only orders shingles, results do not depend on it.
CELLS = 1 << 22
PARTS_OF_SKETCH = 64
#: Members that one piece of a hot region has, about.
PIECE = 4096
#: Shingles that a map task gathers before it sends them.
FLUSH = 1 << 18
#: Pairs of a round up to which the ids of their sets are broadcast (16 bytes a pair), so that other sets are not shuffled.
FEW = 50_000


def sets_of(batches, column, k):
    for rows, data, offsets in slices(batches, column):
        h, bounds = shingle_sets(Words(data, offsets, lower=True), k)
        n = np.diff(bounds)
        sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(mix(h ^ U64(0x5BD1E995)), out=sums[1:])
        fp = mix((sums[bounds[1:]] - sums[bounds[:-1]]) + n.astype(np.uint64))
        fp[n == 0] = 0
        yield rows, h, bounds, n, fp


def _points(docs: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, bytes]:
    """(doc_id, n_shingles, fp) of each document, and the frequency class of each sketch cell."""
    spark, n_parts = docs.sparkSession, parts(docs.sparkSession)
    width = CELLS // PARTS_OF_SKETCH

    def scan(batches):
        cells, seen = np.zeros(CELLS, dtype=np.uint32), False
        for rows, h, _, n, fp in sets_of(batches, "text", k):
            cells += np.bincount((h & U64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
            seen = seen or len(h) > 0
            m = rows.num_rows
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(signed(fp)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if seen:
            small = np.minimum(cells, 255).astype(np.uint8).reshape(PARTS_OF_SKETCH, width)
            m = PARTS_OF_SKETCH
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(range(m), pa.int32()), binary(list(small))], names=names)

    names = ["doc_id", "n_shingles", "fp", "slice", "cells"]
    both = scratch.save(docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_shingles long, fp long, slice int, cells binary"))

    def merge(batches):
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for s, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = out.setdefault(s, np.zeros(width, dtype=np.uint64))
                a += np.frombuffer(v, dtype=np.uint8)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), binary([np.floor(4 * np.log2(1.0 + a)).astype(np.uint8) for a in out.values()])], names=["slice", "classes"])

    n = min(PARTS_OF_SKETCH, n_parts)
    cells = both.where("slice is not null").select("slice", "cells").withColumn("to", F.col("slice") % n)
    classes = np.zeros((PARTS_OF_SKETCH, width), dtype=np.uint8)
    for r in deal(cells, n, "to").select("slice", "cells").mapInArrow(merge, "slice int, classes binary").collect():  # CELLS bytes in all
        classes[r["slice"]] = np.frombuffer(r["classes"], dtype=np.uint8)
    points = both.where("slice is null").select("doc_id", "n_shingles", "fp")
    points._scratch = both._scratch
    return points, classes.tobytes()


def _regions(docs: DataFrame, k: int, num: int, den: int, classes: bytes) -> DataFrame:
    """(rid, fp, n, place): members of each region, and the place of its shingle in their order; regions with the same members are one."""
    spark, n_parts = docs.sparkSession, parts(docs.sparkSession)
    shared = spark.sparkContext.broadcast(classes)  # CELLS bytes
    posting = np.dtype([("h", "<u8"), ("fp", "<u8"), ("n", "<i4"), ("place", "<i4"), ("hot", "<u2")])

    def salts(p):
        return np.where(p["hot"] > 0, (p["fp"] >> U64(17)) % np.maximum(p["hot"], 1).astype(np.uint64) + U64(1), U64(0))

    def emit(batches):
        table, seen, held, size = np.frombuffer(shared.value, dtype=np.uint8), np.zeros(0, dtype=np.uint64), [], 0

        def flush():
            p = np.concatenate(held)
            to = ((mix(p["h"] + salts(p)) >> U64(8)) % U64(n_parts)).astype(np.int64)
            out = split_by(to, n_parts, p)
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), binary([a[0] for _, a in out])], names=["bucket", "postings"])

        for _, h, bounds, n, fp in sets_of(batches, "text", k):
            first = np.zeros(len(fp), dtype=bool)
            first[np.unique(fp, return_index=True)[1]] = True
            first &= (n > 0) & ~np.isin(fp, seen)
            seen = np.concatenate([seen, fp[first]])
            of = np.repeat(np.arange(len(n)), n)
            cls = table[(h & U64(CELLS - 1)).astype(np.int64)]
            order = np.lexsort((h, cls, of))
            place = np.arange(len(h)) - bounds[:-1][of]
            take = (place < n[of] - -(-num * n[of] // den) + 1) & first[of]
            p = np.zeros(int(take.sum()), dtype=posting)
            at = order[take]
            p["h"], p["fp"], p["n"] = h[at], fp[of[at]], n[of[at]]
            count = np.exp2(cls[at] / 4.0)
            p["hot"] = np.where(count >= PIECE, np.minimum(np.ceil(count / PIECE), 65535), 0)
            p["place"] = place[take]
            held.append(p)
            size += len(p)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def meet(batches):
        got = [together(b.column(1).to_pylist(), posting) for b in batches]
        p = np.concatenate(got) if got else np.zeros(0, dtype=posting)
        salt = salts(p)
        p, salt = (x[np.lexsort((p["fp"], salt, p["h"]))] for x in (p, salt))
        if not len(p):
            return
        new = np.ones(len(p), dtype=bool)
        new[1:] = (p["h"][1:] != p["h"][:-1]) | (salt[1:] != salt[:-1])
        same = np.zeros(len(p), dtype=bool)
        same[1:] = ~new[1:] & (p["fp"][1:] == p["fp"][:-1])
        p, salt, new = p[~same], salt[~same], new[~same]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(p)))
        hot = p["hot"][start] > 0
        rid = np.where(hot, p["h"][start], np.add.reduceat(mix(p["fp"]), start) + size.astype(np.uint64))
        rid = mix(rid + hot.astype(np.uint64))
        want = hot | (size >= 2)
        start, size, hot, rid, salt = start[want], size[want], hot[want], rid[want], salt[start[want]]
        # of regions with the same members, the one whose shingle comes first in all of them
        key, at = np.where(hot, mix(rid + salt), rid), np.lexsort((p["place"][start], np.where(hot, mix(rid + salt), rid)))
        one = at[np.append(True, key[at][1:] != key[at][:-1])] if len(at) else at
        member = np.zeros(len(p), dtype=MEMBER)
        for c in MEMBER.names:
            member[c] = p[c]
        to = ((rid >> U64(8)) % U64(n_parts)).astype(np.int64)
        for b in np.unique(to[one]):
            mine = one[to[one] == b]
            rows = np.concatenate([member[s : s + m] for s, m in zip(start[mine], size[mine], strict=True)])
            head = np.zeros(len(mine), dtype=HEAD)
            head["rid"], head["piece"], head["size"] = rid[mine], np.where(hot[mine], salt[mine].astype(np.int64), 0), size[mine]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), binary([head]), binary([rows])], names=["bucket", "heads", "members"])

    def unique(batches):
        out = []

        def flush():
            rows = np.concatenate([r for _, r in out])
            rid = np.repeat(np.array([r for r, _ in out], dtype=np.uint64), [len(r) for _, r in out])
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(rid)), pa.array(signed(rows["fp"].copy())), pa.array(rows["n"].copy()), pa.array(rows["place"].copy())], names=["rid", "fp", "n", "place"])

        heads, members = [], []
        for batch in batches:
            heads += batch.column(1).to_pylist()
            members += batch.column(2).to_pylist()
        head, member = together(heads, HEAD), together(members, MEMBER)
        if not len(head):
            return
        start = np.cumsum(head["size"]) - head["size"]
        order = np.lexsort((member["place"][start], head["piece"], head["rid"]))
        key = head[order][["rid", "piece"]]
        for i in order[np.append(True, key[1:] != key[:-1])]:
            rows = member[start[i] : start[i] + head["size"][i]]
            if not head["piece"][i]:
                rows = rows[_feasible(rows, num, den)]
            if len(rows):
                out.append((head["rid"][i], rows))
            if sum(len(r) for _, r in out) >= 20_000:
                yield flush()
        if out:
            yield flush()

    postings = docs.select("doc_id", "text").mapInArrow(emit, "bucket int, postings binary")
    met = deal(postings, n_parts).mapInArrow(meet, "bucket int, heads binary, members binary")
    return deal(met, n_parts).mapInArrow(unique, "rid long, fp long, n int, place int")


MEMBER = np.dtype([("fp", "<u8"), ("n", "<i4"), ("place", "<i4")])
HEAD = np.dtype([("rid", "<u8"), ("piece", "<i4"), ("size", "<i4")])


def _slack(n, place, num: int, den: int):
    """Three times (num) the largest partner that a member can have: a link needs num (n + m) / (num + den) shared shingles, and from the region's shingle on only n - place are left."""
    return (num + den) * (n - place) - num * n


def _feasible(rows: np.ndarray, num: int, den: int) -> np.ndarray:
    """Members that sizes and places allow a link with another one: num m <= slack(x) and num n <= slack(y)."""
    n, slack = rows["n"].astype(np.int64), _slack(rows["n"].astype(np.int64), rows["place"].astype(np.int64), num, den)
    order = np.argsort(n, kind="stable")
    # the two largest slacks among the smallest members
    top = np.full((2, len(rows) + 1), -1, dtype=np.int64)
    owner = np.full(len(rows) + 1, -1, dtype=np.int64)
    for i, j in enumerate(order):
        best, second, who = top[0, i], top[1, i], owner[i]
        if slack[j] > best:
            best, second, who = slack[j], best, j
        else:
            second = max(second, slack[j])
        top[0, i + 1], top[1, i + 1], owner[i + 1] = best, second, who
    reach = np.searchsorted(n[order], slack // num, side="right")
    other = np.where(owner[reach] == np.arange(len(rows)), top[1, reach], top[0, reach])
    return other >= num * n


def _pairs(members: DataFrame, m: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rid, fp, pivot) rows of each region's m pivots with members of other components that sizes and places allow a link.

    A pair is left out of a region where its shingle cannot be the first one they share;
    the region of the first one has it.
    """
    own = members.withColumn("slack", _slack(F.col("n"), F.col("place"), num, den))
    if m == 1:
        score = F.struct((F.col("place") / F.col("n")).alias("s"), "fp", "n", "root", "slack")
        pivots = own.groupBy("rid").agg(F.min(score).alias("p")).select("rid", F.col("p.fp").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.root").alias("proot"), F.col("p.slack").alias("pslack"))
    else:
        rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.col("place") / F.col("n"), "fp"))
        pivots = own.withColumn("rk", rank).where(F.col("rk") <= m).select("rid", F.col("fp").alias("pivot"), F.col("n").alias("pn"), F.col("root").alias("proot"), F.col("slack").alias("pslack"))
    allowed = (F.col("root") != F.col("proot")) & (den * F.least("n", "pn") >= num * F.greatest("n", "pn")) & (num * F.col("pn") <= F.col("slack")) & (num * F.col("n") <= F.col("pslack"))
    return pivots, own.alias("x").join(pivots.alias("p"), (F.col("x.rid") == F.col("p.rid")) & allowed).select("x.rid", "fp", "pivot")


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("fp", "pivot").alias("a"), F.greatest("fp", "pivot").alias("b")).distinct()


#: Bytes of a hash in a set that is sent: 48 bits, so a pair of sets of 300 is misjudged with probability below 1e-9.
SENT = 6


def _narrow(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return blobs(np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - SENT :]).reshape(-1), bounds * SENT)


def _wide(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, bounds = unblob(column, np.uint8)
    h = np.zeros((len(raw) // SENT, 8), dtype=np.uint8)
    h[:, 8 - SENT :] = raw.reshape(-1, SENT)
    return h.reshape(-1).view("<u8"), bounds // SENT


def _measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, total): sizes of the intersection and union of each pair."""

    def count(batches):
        for b in batches:
            (x, xb), (y, yb) = _wide(b.column(2)), _wide(b.column(3))
            nx, ny = np.diff(xb), np.diff(yb)
            # equal hashes within a pair stand next to each other once sorted by (pair, hash)
            row = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
            h = np.concatenate([x, y])
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            hit = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
            both = np.bincount(row[1:][hit], minlength=len(nx)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(both), pa.array(nx + ny - both)], names=["a", "b", "both", "total"])

    left = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("fp").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(count, "a long, b long, both long, total long")


def _open(members: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """Members (rid, fp, n, place, d0) with their component now, but for those that the triangle inequality rules out.

    d0: distance to the region's first pivot (null: not known). A member stays where some
    member of another component is within r of its own distance.
    """
    own = members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("rid", "fp", "n", "place", "d0", F.coalesce("root", "fp").alias("root"))
    lo, hi = F.coalesce("d0", F.lit(0.0)), F.coalesce("d0", F.lit(1.0))
    groups = own.groupBy("rid", "root").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    edge = groups.groupBy("rid").agg(F.min(F.struct("lo", "root")).alias("least"), F.max(F.struct("hi", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    # the least and the largest distance outside the root that has the extreme one
    second = groups.join(edge, "rid").groupBy("rid").agg(F.min(F.when(F.col("root") != F.col("least.root"), F.col("lo"))).alias("lo2"), F.max(F.when(F.col("root") != F.col("most.root"), F.col("hi"))).alias("hi2"))
    both = edge.join(second, "rid")
    least = F.when(F.col("root") == F.col("least.root"), F.col("lo2")).otherwise(F.col("least.lo"))
    most = F.when(F.col("root") == F.col("most.root"), F.col("hi2")).otherwise(F.col("most.hi"))
    r = 1 - num / den + 1e-9
    return own.join(both, "rid").where((hi >= least - r) & (lo <= most + r)).select("rid", "fp", "n", "place", "d0", "root")


def needed_sets(docs: DataFrame, k: int, bloom: bytes) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(bloom)  # Bloom.BITS / 8 bytes

    def emit(batches):
        has, seen = Bloom(shared.value).has, np.zeros(0, dtype=np.uint64)
        for _, h, bounds, n, fp in sets_of(batches, "text", k):
            first = np.zeros(len(fp), dtype=bool)
            first[np.unique(fp, return_index=True)[1]] = True
            first &= (n > 0) & ~np.isin(fp, seen)
            first[first] = has(fp[first])
            seen = np.concatenate([seen, fp[first]])
            keep = np.flatnonzero(first)
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(signed(fp[keep])), _narrow(h[np.repeat(first, n)], np.concatenate([[0], np.cumsum(n[keep])]))], names=["fp", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(emit, "fp long, hashes binary").groupBy("fp").agg(F.first("hashes").alias("hashes"))


def join_regions(members: DataFrame, sets: DataFrame, scratch: Scratch, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(links, roots) of the members (rid, fp, n, place) of regions, whose sets are in sets (fp, hashes).

    links (a, b, both, total) are enough to join exactly those members that links of
    similarity num/den or more inside regions join; roots (node, root): their components.
    members is a saved table, which is dropped after its round.
    """
    table = members
    members = members.withColumn("d0", F.lit(None).cast("double")).withColumn("root", F.col("fp"))
    links, roots, m = None, None, 1
    while True:
        pivots, pairs = _pairs(members, m, num, den)
        wanted = scratch.save(_distinct(pairs))
        own = sets
        if wanted.count() <= FEW:
            ids = wanted.select(F.col("a").alias("fp")).union(wanted.select("b")).distinct()
            own = sets.join(F.broadcast(ids), "fp", "left_semi")
        measured = scratch.save(_measure(wanted, own))
        scratch.drop(wanted)
        near = measured.where(den * F.col("both") >= num * F.col("total"))
        links = near if links is None else links.unionByName(near)
        roots = components(links.select("a", "b"), scratch)
        rest = members.join(pivots.select("rid", F.col("pivot").alias("fp")), ["rid", "fp"], "left_anti")
        if m == 1:
            far = measured.select("a", "b", (1 - F.col("both") / F.col("total")).alias("d0"))
            near_pivot = pairs.withColumn("a", F.least("fp", "pivot")).withColumn("b", F.greatest("fp", "pivot")).join(far, ["a", "b"]).select("rid", "fp", "d0")
            rest = rest.drop("d0").join(near_pivot, ["rid", "fp"], "left")
        left = rest.select("rid", "fp", "n", "place", "d0")
        members, m = scratch.save(_open(left, roots, num, den)), m * 16
        scratch.drop(table)
        table = members
        if members.isEmpty():
            return links, roots


def jaccard_links(docs: DataFrame, scratch: Scratch, k: int = 5, num: int = 3, den: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, links, roots): points has doc_id, n_shingles and fp (equal sets, equal fp; 0 for none) of each document; links and roots as join_regions gives them."""
    points, classes = _points(docs, k, scratch)
    members = scratch.save(_regions(docs, k, num, den, classes))
    sets = scratch.save(needed_sets(docs, k, Bloom.build(members, "fp")))
    return points, *join_regions(members, sets, scratch, num, den)


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text): the smallest doc_id reachable by links.

    Lower-cased A-Z; words are runs other than space and \\t-\\r; a set has the distinct
    k-word shingles, with fewer words the whole sequence. Null and empty texts, and texts
    without words, have no shingles, link with nothing and are components of their own.
    Repeated rows stay repeated; rows with a null doc_id take part in links but lend no id
    (alone, their component_id is null). Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    points, _, roots = jaccard_links(docs, scratch, k, num, den)
    scratch.keep_only(points, roots)
    named = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "fp")))
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
