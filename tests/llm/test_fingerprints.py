import hashlib
import random

from tests.llm.test_jaccard_join import corpus, sets
from tremorlake.llm.fingerprints import edited_fingerprints, near_duplicates, signature_table


def test_edited(spark):
    rows = corpus(seed=2, groups=20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in edited_fingerprints(df).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    by_text = {}
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        cut = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(cut.encode()).hexdigest()
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        a, b = sets(t), sets(cut)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r["near_edited"] - true) < 0.25
        if t == cut:
            assert r["fingerprint"] == r["edited_fingerprint"] and r["near_edited"] == 1


def test_one_row_empty_table_and_repeated_ids(spark):
    one = spark.createDataFrame([(5, "abcdef", 1)], "doc_id long, text string, id int")
    r = edited_fingerprints(one).collect()[0]
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert edited_fingerprints(one.limit(0)).collect() == []
    many = spark.createDataFrame([(5, "aaa bbb"), (5, "aaa bbb"), (None, None), (None, "x y z")], "doc_id long, text string")
    assert len(edited_fingerprints(many).collect()) == 4
    assert signature_table(many).count() == 4


def test_near_duplicates(spark):
    rnd = random.Random(8)
    base = [[f"w{rnd.randrange(10**6)}" for _ in range(120)] for _ in range(12)]
    rows = []
    for i, b in enumerate(base):
        for j in range(5):
            c = list(b)
            c[rnd.randrange(120)] = "edit"
            rows.append((i * 10 + j, " ".join(c)))
    rows += [(900, ""), (901, None), (902, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = dict(map(tuple, near_duplicates(df).collect()))
    assert got == {i: (i // 10 * 10 if i < 900 else i) for i, _ in rows}


def test_near_duplicates_with_a_common_passage(spark):
    rnd = random.Random(12)
    own = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    passage, rows = own(150), []
    for i in range(60):  # pairs of similarity 0.81; strangers 0.72
        both = own(10)
        rows += [(2 * i + j, " ".join(passage + both + own(18))) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert dict(map(tuple, near_duplicates(df).collect())) == {i: i // 2 * 2 for i, _ in rows}


def test_buckets_by_bisection(spark):
    from pyspark.sql import functions as F

    from tremorlake.llm.fingerprints import _rank

    edges = [-(2**63), -5, 0, 3, 10, 2**62]
    for m in range(1, len(edges) + 1):
        rows = spark.createDataFrame([(x + d,) for x in edges[1:5] for d in (-1, 0, 1)] + [(-(2**63),), (2**63 - 1,)], "x long")
        for r in rows.select("x", _rank(edges[:m], F.col("x")).alias("n")).collect():
            assert r["n"] == sum(e >= r["x"] for e in edges[:m])
