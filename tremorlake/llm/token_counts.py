"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a slice of texts are put in a trie, level by level; the best
forward score of a prefix, max over its last pieces of score(prefix without it) +
score(piece), is computed once for each trie node, so pre-tokens with a prefix in common
share its work; the piece count of the best path is stored at terminal nodes. A worker
keeps the counts of pre-tokens it has seen, up to a bound. All of it is numpy over the
bytes; nothing is shuffled.

Pre-tokens: a word (run without space, \\t-\\r) with the one space before it, if any; what
remains of white space, by runs.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import prepare
from .textkernel import ByteSums, Words, slices

#: A pre-token longer than this (bytes) shares no prefix with others worth a node a level: it is a branch of its own, with the same scores.
TRIE_DEPTH = 64
#: Places of a long branch whose pieces are looked up at a time.
BLOCK = 1 << 14
#: Pre-tokens whose count a worker keeps.
KEPT = 2_000_000


def scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Unigram log-probabilities from a public vocabulary's ranks: Zipf's law, 1 / (rank + 1), normalised."""
    total = float(np.log(np.sum(1.0 / (np.arange(max(ranks.values()) + 1) + 1))))
    return {p: float(-np.log(r + 1.0) - total) for p, r in ranks.items()}


class Model:
    """The pieces of a vocabulary file (base64 piece and rank a line) with their scores, by length and hash."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.scores = scores({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.by_length = {}
        for n in sorted({len(p) for p in self.scores}):
            own = [p for p in self.scores if len(p) == n]
            at = np.arange(len(own)) * n
            h = ByteSums(np.frombuffer(b"".join(own), dtype=np.uint8)).spans(at, at + n)
            order = np.argsort(h)
            self.by_length[n] = h[order], np.array([self.scores[p] for p in own])[order]
        self.seen = np.zeros(0, dtype=np.uint64)
        self.counts = np.zeros(0, dtype=np.int64)

    def count_one(self, sums: ByteSums, lo: int, hi: int) -> int:
        """Pieces of the best segmentation of lo:hi, a trie of one branch; among equals, the longest last piece.

        The pieces that end at each place are found for all places of a block at once, so
        the steps in order are those of pieces that are there.
        """
        best, count = [0.0] + [-np.inf] * (hi - lo), [0] * (hi - lo + 1)
        for first in range(lo + 1, hi + 1, BLOCK):
            ends = np.arange(first, min(first + BLOCK, hi + 1))
            found = []
            for n, (hashes, values) in self.by_length.items():
                own = ends[ends - n >= lo]
                h = sums.spans(own - n, own)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == h)
                found.append((own[hit] - lo, np.full(len(hit), n), values[at[hit]]))
            end, size, value = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((-size, end))
            for e, n, v in zip(end[order].tolist(), size[order].tolist(), value[order].tolist(), strict=True):
                if best[e - n] + v > best[e]:
                    best[e], count[e] = best[e - n] + v, count[e - n] + 1
        return count[-1]

    def count_trie(self, sums: ByteSums, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Pieces of each of the distinct pre-tokens lo:hi, none longer than TRIE_DEPTH."""
        order = np.argsort(-(hi - lo), kind="stable")  # those that reach a depth are a prefix of this order
        lo, size = lo[order], (hi - lo)[order]
        nodes = np.zeros((int(size[0]) + 1, len(lo)), dtype=np.int32) if len(lo) else np.zeros((1, 0), dtype=np.int32)
        score, count, made = [np.zeros(1)], [np.zeros(1, dtype=np.int64)], 1
        all_score, all_count = np.zeros(1), np.zeros(1, dtype=np.int64)
        for depth in range(1, len(nodes)):
            m = int(np.searchsorted(-size, -depth, side="right"))
            _, lead, own = np.unique(sums.spans(lo[:m], lo[:m] + depth), return_index=True, return_inverse=True)
            nodes[depth, :m] = made + own
            best, pieces = np.full(len(lead), -np.inf), np.zeros(len(lead), dtype=np.int64)
            end = lo[lead] + depth
            for n in sorted((n for n in self.by_length if n <= depth), reverse=True):
                hashes, values = self.by_length[n]
                h = sums.spans(end - n, end)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == h)
                before = nodes[depth - n, lead[hit]]
                s = all_score[before] + values[at[hit]]
                better = s > best[hit]
                best[hit[better]], pieces[hit[better]] = s[better], all_count[before[better]] + 1
            score.append(best)
            count.append(pieces)
            all_score, all_count = np.concatenate([all_score, best]), np.concatenate([all_count, pieces])
            made += len(lead)
        out = np.zeros(len(lo), dtype=np.int64)
        out[order] = all_count[nodes[size, np.arange(len(lo))]]
        return out

    def count(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Pieces of each pre-token lo:hi of data."""
        sums = ByteSums(data)
        h, lead, own = np.unique(sums.spans(lo, hi), return_index=True, return_inverse=True)
        if len(self.seen) > KEPT:
            self.seen, self.counts = self.seen[:0], self.counts[:0]
        at = np.minimum(np.searchsorted(self.seen, h), max(0, len(self.seen) - 1))
        known = self.seen[at] == h if len(self.seen) else np.zeros(len(h), dtype=bool)
        out = np.zeros(len(h), dtype=np.int64)
        out[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        a, b = lo[lead[new]], hi[lead[new]]
        short = b - a <= TRIE_DEPTH
        out[new[short]] = self.count_trie(sums, a[short], b[short])
        for i, s, e in zip(new[~short], a[~short].tolist(), b[~short].tolist(), strict=True):
            out[i] = self.count_one(sums, s, e)
        if len(new):
            seen = np.concatenate([self.seen, h[new]])
            order = np.argsort(seen, kind="stable")
            self.seen, self.counts = seen[order], np.concatenate([self.counts, out[new]])[order]
        return out[own]


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the pre-tokens of all texts, in order."""
    w = Words(data, offsets)
    begins = offsets[:-1]
    lead = np.zeros(len(data) + 1, dtype=bool)
    lead[begins] = True
    spaced = ~lead[w.starts] & (data[np.maximum(w.starts - 1, 0)] == 0x20)
    starts = w.starts - spaced
    # white space: from a word's end (or a text's start) to the next pre-token's start (or the text's end)
    from_ = np.concatenate([begins, w.ends])
    order = np.argsort(from_, kind="stable")
    to = np.concatenate([starts, offsets[1:]])
    to.sort(kind="stable")
    from_ = from_[order]
    gap = to > from_
    lo, hi = np.concatenate([starts, from_[gap]]), np.concatenate([w.ends, to[gap]])
    order = np.argsort(lo, kind="stable")
    return lo[order], hi[order]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each row of docs (doc_id, text); null and empty texts have 0. Repeated rows stay repeated."""
    prepare(docs.sparkSession)

    def scan(batches):
        m = model(vocabulary)
        for rows, data, offsets in slices(batches, "text"):
            lo, hi = pretokens(data, offsets)
            bounds = np.searchsorted(lo, offsets)
            total = np.concatenate([[0], np.cumsum(m.count(data, lo, hi))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array(np.diff(total[bounds]))], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_pretokens long, n_tokens long")
