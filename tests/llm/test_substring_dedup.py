import hashlib
import random
import re

import pytest

from tremorlake.llm.substring_dedup import COVERS, cover, substring_dedup


def brute(rows, k=20):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    seen, out = set(), []
    for i in sorted(words):
        w, gone = words[i], set()
        for s in range(len(w) - k + 1):
            x = tuple(w[s : s + k])
            if x in seen:
                gone.update(range(s, s + k))
            seen.add(x)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("v", COVERS)
def test_covers(v):
    assert {(a - b) % v for a in COVERS[v] for b in COVERS[v]} == set(range(v))


def test_anchor_length():
    assert cover(20) == (13, (0, 1, 3, 9), 8)


def test_matches_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abÉcd ") for _ in range(rnd.randint(1, 5)))
    passages = [[word() for _ in range(n)] for n in (20, 25, 60, 21)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rnd.randint(0, 5)):
            w += [word() for _ in range(rnd.randint(0, 30))]
            if rnd.random() < 0.5:
                p = rnd.choice(passages)
                w += p[rnd.randint(0, 3) :]
        rows.append((i * 7, rnd.choice([" ", "\n", " \t"]).join(w)))
    rows += [(2000 + i, rows[i][1]) for i in range(20)] + [(3000, None), (3001, ""), (3002, "x"), (3003, "tick " * 5000), (3004, "tick " * 30)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, substring_dedup(df).drop("removed").collect()))
    assert got == brute(rows)


def test_no_repeats_empty_table_repeated_rows_and_clashing_columns(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string, key int")).collect() == []
    t = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, t, 5), (1, t, 6), (None, t, 7)], "doc_id long, text string, fp int")
    got = sorted(map(tuple, substring_dedup(df).select("doc_id", "n_words", "n_removed", "removed").collect()), key=str)
    assert [x[:3] for x in got] == [(1, 25, 0), (1, 25, 0), (None, 25, 25)]
    assert bytes(got[2][3]) == (0).to_bytes(4, "little") + (25).to_bytes(4, "little")
