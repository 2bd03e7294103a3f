import random

import numpy as np

from tremorlake.llm.toxicity import GRADES, Sparse, fit, fit_ordinal, score


def rows(n, seed):
    rnd = random.Random(seed)
    docs, labels = [], []
    bad = ["vile", "rotten", "nasty", "foul"]
    for i in range(n):
        w = [f"w{rnd.randrange(300)}" for _ in range(rnd.randint(5, 60))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(rnd.randint(1, 6)):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad) + rnd.choice(["", "!", ","]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_thresholds_are_ordered_and_severity_follows_the_score():
    g = np.random.default_rng(0)
    x = g.normal(size=(3000, 4))
    y = np.digitize(x @ [2, -1, 0, 0] + g.logistic(size=3000), [-1, 0.5, 2])
    row, col = np.divmod(np.arange(12000), 4)
    w, theta = fit_ordinal(Sparse(row, col, x.ravel(), x.shape), y, GRADES)
    assert np.all(np.diff(theta) > 0)
    assert np.allclose(w, [2, -1, 0, 0], atol=0.25) and np.allclose(theta, [-1, 0.5, 2], atol=0.25)


def test_held_out_accuracy(spark):
    docs, labels = rows(3000, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = fit(df, lab.where("doc_id < 2000"))
    got = {r["doc_id"]: r for r in score(df, m).collect()}
    held = [(bool(t), got[i]["toxic"]) for i, _, t in labels if i >= 2000]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    sev = [got[i]["expected_severity"] for i, _, t in labels if t]
    assert np.mean(sev) > 1 and all(0 <= r["expected_severity"] <= GRADES - 1 for r in got.values())
    assert all(r["grade"] > 0 for r in got.values() if r["toxic"])


def test_nulls_empty_tables_and_clashing_columns(spark):
    docs, labels = rows(300, 2)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(None, None, None), (7000, "", None), (7001, "vile " * 9000, "y")], "doc_id long, text string, toxic string")
    lab = spark.createDataFrame([*labels, (None, None, None), (3, None, None), (4, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = score(df, fit(df, lab)).collect()
    assert len(got) == 303 and {r["toxic"] for r in got if r["doc_id"] in (None, 7000)} == {False}
    assert score(df, fit(df, lab.limit(0))).where("toxic").count() == 0
    assert score(df.limit(0), fit(df.limit(0), lab)).count() == 0
