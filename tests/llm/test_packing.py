import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tremorlake.llm.exchange import Scratch
from tremorlake.llm.packing import assign, encoder, pack, partners, settle

FAST = P.path("byte_bpe_50k.tiktoken")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.integers(1, 7))
def test_ranges_together_match_as_one_stack(places, width):
    """partners() within ranges and settle() between them join each place with the latest free document before it."""
    want, stack = {}, []
    for i, x in enumerate(places):
        if not x:
            stack.append(i)
        elif stack:
            want[i] = stack.pop()
    got, left, rows = {}, [], {}
    for pid, lo in enumerate(range(0, len(places), width)):
        own = np.array(places[lo : lo + width], dtype=bool)
        doc, place = partners(own)
        got |= {lo + int(p): lo + int(d) for d, p in zip(doc, place, strict=True)}
        rest = np.setdiff1d(np.arange(len(own)), np.concatenate([doc, place]))
        rows[pid] = [[lo + int(i) for i in rest if not own[i]], [lo + int(i) for i in rest if own[i]]]
        left.append((pid, len(rows[pid][0]), len(rows[pid][1]), 0))
    table, rank = settle(left)
    ranked = {}
    for pid, lo, hi, goal, number in table.tolist():
        for o in range(lo, hi):
            doc, to = rows[pid][0][o], number + hi - 1 - o
            if goal >= 0:
                got[rows[goal][1][to]] = doc
            else:
                ranked[to] = doc
    assert got == want
    assert [ranked[r] for r in range(rank)] == stack[::-1]


def best_fit_decreasing(lengths, size):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            gaps.append(size - length)
        else:
            gaps.remove(fit)
            gaps.append(fit - length)
    return len(gaps)


@pytest.mark.parametrize("kind", ["mixed", "one length", "short"])
def test_assign_is_whole_and_close_to_best_fit_decreasing(spark, tmp_path, kind):
    rnd = random.Random(kind)
    lengths = {"mixed": [rnd.choice([rnd.randint(1, 64), rnd.randint(1, 1024)]) for _ in range(3000)], "one length": [300] * 900 + [rnd.randint(1, 1024) for _ in range(900)], "short": [rnd.randint(1, 30) for _ in range(6000)]}[kind]
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, length long").repartition(5)
    got = {}
    for x in assign(df, 1024, Scratch(spark, "test")):
        for r in x.collect():
            assert r["id"] not in got and r["length"] == lengths[r["id"]]
            got[r["id"]] = r["seq"]
    used = {}
    for i, n in enumerate(lengths):
        used[got[i]] = used.get(got[i], 0) + n
    assert max(used.values()) <= 1024
    assert len(used) <= 1.02 * best_fit_decreasing(lengths, 1024) + 6


def test_encoders_agree():
    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in ("", " a  b\n\n c  d 12345 é'll don't", "x<|endoftext|> y <|endoftext|>", "日本語 \t\r\n  end  "):
        assert encoder(FAST)(t).tolist() == slow.encode(t, add_special_tokens=False).ids == encoder(P.path("byte_bpe_50k.json"))(t).tolist()


def test_long_white_space(spark):
    text = "a" + " " * 1_000_001 + "b" + "\n" * 2_000_000 + "c"
    want = [*Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 2]
    got = pack(spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string"), FAST).where("doc_id = 1").orderBy("piece").collect()
    assert sum(r["length"] for r in got) == len(want)
    for r in got:
        assert zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) == r["ids_crc32"]


def test_pack(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["the", "ofx", "é", "12", "\n"]) for _ in range(rnd.choice([0, 1, 30, 400, 3000])))) for i in range(80)]
    rows += [(900, None), (901, ""), (5, rows[5][1]), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = pack(df, FAST).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, [*encoder(FAST)(t or "").tolist(), 2])
    seqs, by_doc = {}, {}
    for r in got:
        a = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(a, dtype="<u4").tobytes()) == r["ids_crc32"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for s in seqs.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 1024
    for i, ps in by_doc.items():
        if i == 5:
            continue
        ps.sort()
        assert [p[0] for p in ps] == list(range(len(ps))) and sum(p[2] for p in ps) == len(ids[i])
        assert len(ps) == 1 or all(p[2] == 1024 for p in ps[1:])
    assert sum(len(p) for p in by_doc.values()) == len(got)
    total = sum(len(ids[i]) for i, _ in rows)
    assert len(seqs) <= 1.1 * total / 1024


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string, part int"), FAST).collect() == []


def test_clashing_columns_and_a_very_long_text(spark):
    text = "ab é " * 200_000
    names = "doc_id long, text string, id long, seq string, length string, piece string, offset int, what int"
    got = pack(spark.createDataFrame([(1, text, 5, "x", "y", "z", 3, 1), (2, "a", 5, "x", "y", "z", 3, 1)], names), FAST).collect()
    want = len(encoder(FAST)(text)) + 1
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == want
    assert got[0].__fields__ == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
