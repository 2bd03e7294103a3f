import random
import re

import numpy as np
import public_tokenizers as P

from tremorlake.llm.token_counts import model, pretokens, token_counts

VOCAB = P.path("byte_bpe_50k.tiktoken")
SPLIT = re.compile(r"\x20?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+(?=\x20[^\x20\x09-\x0D])|[\x20\x09-\x0D]+")


def plain(m, text):
    """Pieces of the best segmentation by dynamic programming over all earlier places; among equals, the longest last piece."""
    best, count, longest = [0.0] + [-np.inf] * len(text), [0] * (len(text) + 1), max(map(len, m.scores))
    for end in range(1, len(text) + 1):
        for n in range(min(longest, end), 0, -1):
            s = m.scores.get(text[end - n : end])
            if s is not None and best[end - n] + s > best[end]:
                best[end], count[end] = best[end - n] + s, count[end - n] + 1
    return count[-1]


def texts():
    rnd = random.Random(9)
    out = ["", " ", "a", " a", "a ", "  a", "\n a\n\nb  c\t d ", "é ñandú  \n", "x" * 300, "ab" * 500 + " c", "日本語の文を" * 900, "z" * 40_000 + "\n" * 40_000]
    for _ in range(80):
        out.append("".join(rnd.choice(["the", "ing", " ", " ", "\n", "é", "tion", "12", ".", "ß", "q"]) for _ in range(rnd.randint(1, 200))))
    return out


def test_pretokens_match_the_pattern():
    for t in texts():
        data = np.frombuffer(t.encode(), dtype=np.uint8)
        lo, hi = pretokens(data, np.array([0, len(data)]))
        assert [t.encode()[a:b].decode() for a, b in zip(lo, hi)] == SPLIT.findall(t)


def test_counts_match_plain_dynamic_programming(spark):
    rows = list(enumerate(texts())) + [(900, None), (None, "the end"), (3, texts()[30])]
    m = model(VOCAB)
    want = sorted(((i, len(SPLIT.findall(t or "")), sum(plain(m, p.encode()) for p in SPLIT.findall(t or ""))) for i, t in rows), key=str)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    assert sorted(map(tuple, token_counts(df, VOCAB).collect()), key=str) == want
    assert token_counts(df.limit(0), VOCAB).collect() == []


def test_best_segmentation_by_enumeration():
    m = model(VOCAB)

    def all_ways(b):
        if not b:
            yield ()
        for n in range(1, len(b) + 1):
            if b[:n] in m.scores:
                for rest in all_ways(b[n:]):
                    yield (b[:n], *rest)

    for t in (b" within", b"erheth", b"tionly", b" abcabc"):
        best = max(sum(m.scores[p] for p in way) for way in all_ways(t))
        assert plain(m, t) in {len(w) for w in all_ways(t) if abs(sum(m.scores[p] for p in w) - best) < 1e-9}


def test_long_pretokens_by_blocks(monkeypatch):
    import tremorlake.llm.token_counts as module

    m, rnd = model(VOCAB), random.Random(4)
    for size in (1, 63, 64, 65, 200, 999):
        text = "".join(rnd.choice(["the", "ing", "é", "tion", "12", "q"]) for _ in range(size)).encode()[:size]
        data = np.frombuffer(text, dtype=np.uint8)
        for block in (7, 64, 1 << 14):
            monkeypatch.setattr(module, "BLOCK", block)
            assert m.count_one(module.ByteSums(data), 0, size) == plain(m, text)
