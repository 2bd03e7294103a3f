import random
import re

import pytest
from pyspark.sql import functions as F

from tremorlake.llm import decontamination as D
from tremorlake.llm.decontamination import leaks

ITEMS = [
    (1, "Alice bought 12 apples for 30 cents and then Robert gave Alice another 5 apples how many apples are left"),
    (2, "thnd erli onwh asti quen dolo marfi renta silu bopa keri lumo. Then saro fila topu nime."),
    (3, "a train travels 60 km in 2 hours and returns at 40 km per hour what is the mean speed"),
    (4, "seven short words stand in this item"),
    (5, None),
    (6, ""),
]


def filler(rnd, n):
    return " ".join("".join(rnd.choice("bcdfgaeiou") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def test_leaks(spark):
    rnd = random.Random(12)
    f = lambda n=40: filler(rnd, n)
    docs = {
        10: f() + " " + ITEMS[0][1] + " " + f(),
        11: f() + ". And Maria bought 77 apples for 9 cents and then Peter gave Maria another 8 apples how many apples are left " + f(3),
        12: f() + " now Maria bought 77 apples for 9 cents and then Peter gave Susan another 8 apples how many apples are left " + f(),
        13: ITEMS[1][1],
        14: f(13) + "\n" + ITEMS[1][1].lower() + "\n" + f(),
        15: f() + " the train travels 85 mi in 3 hours and returns at 17 mi per hour what is the mean speed",
        16: f(500),
        17: f(11) + " seven short words stand in this item " + f(),
        18: f() + " thnd erli onwh asti quen dolo " + f(),
        19: "",
        20: None,
        21: "word " * 30000,
    }
    rows = [(i, t, "x") for i, t in docs.items()] + [(None, ITEMS[0][1], "x"), (13, ITEMS[1][1], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    bench = spark.createDataFrame([(*x, 1) for x in ITEMS] + [(None, ITEMS[0][1], 1)], "item_id long, text string, at int")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(df, bench).collect()}
    # 12 has Maria and Susan where the item has Alice twice
    assert set(got) == {(10, 1), (11, 1), (13, 2), (14, 2), (15, 3), (17, 4)}
    assert got[(11, 1)]["n_slots"] >= 3


def test_inconsistent_slots(spark):
    bench = spark.createDataFrame([(1, "when Anna met Berta she gave Anna the book of Berta and took it to Clara then")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so when Xenia met Yolanda she gave Xenia the book of Yolanda and took it to Zora then"), (2, "so when Xenia met Yolanda she gave Zora the book of Wilma and took it to Yolanda then")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in leaks(docs, bench).collect()] == [(1, 1)]


def test_empty_tables_and_native_plan(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert leaks(docs.limit(0), bench).collect() == [] and leaks(docs, bench.limit(0)).collect() == []
    df = leaks(docs, bench)
    assert [tuple(r)[:2] for r in df.collect()] == [(1, 1)]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_short_items_at_every_place(spark):
    words = "seven short words stand in this item then come three more".split()
    sizes = (1, 2, 5, 6, 7, 8, 9, 10, 11)
    bench = spark.createDataFrame([(n, " ".join(words[:n]) + "\n") for n in sizes] + [(99, " - ")], "item_id long, text string")
    rnd = random.Random(3)
    docs = [(n * 10 + k, filler(rnd, 12 + k) + " " + " ".join(words[:n]) + " " + filler(rnd, 12)) for n in sizes for k in range(3)]
    # nine words of a longer item, and all but the last word of a short one
    long = spark.createDataFrame([(1, ITEMS[1][1])], "item_id long, text string")
    part = [(k, filler(rnd, 12 + k) + " " + " ".join(ITEMS[1][1].split()[2:11]) + " " + filler(rnd, 12)) for k in range(3)]
    got = {tuple(r)[:2] for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(m * 10 + k, n) for m in sizes for n in sizes for k in range(3) if min(n, 9) <= m}
    assert {r["doc_id"] for r in leaks(spark.createDataFrame(part, "doc_id long, text string"), long).collect()} == {0, 1, 2}


def template_by_hand(t):
    """(template words, raw words) of a text, from the definition."""
    raw = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if any(c.isalnum() for c in w)]
    out = []
    for w in raw:
        core = re.sub(r"^[^\w]+|[^\w]+$", "", w)
        if re.fullmatch(r"\d[\d.,/:]*", core):
            out.append("#")
        elif out and out[-1] == "#" and w == core and core.lower() in D.UNITS:
            out.append("%")
        elif core[:1].isupper() and core[1:2].islower() and core.lower() not in D.PLAIN:
            out.append("@")
        else:
            out.append(core.lower())
    return out, raw


def leaks_by_hand(docs, items, window=6, least=9):
    found = set()
    for i, text in items:
        it, ir = template_by_hand(text)
        width = min(len(it), window)
        for d, doc in docs if it else []:
            dt, dr = template_by_hand(doc)
            lines = {}
            for a in range(len(it) - width + 1):
                for b in range(len(dt) - width + 1):
                    x, y = it[a : a + width], dt[b : b + width]
                    holders = [k for k in range(width) if x[k] in "#@%"]
                    if x != y or (len(holders) == width and ir[a : a + width] != dr[b : b + width]):
                        continue
                    u, v = [ir[a + k] for k in holders], [dr[b + k] for k in holders]
                    if [u.index(z) for z in u] == [v.index(z) for z in v]:
                        lines.setdefault(b - a, []).append((a, set(zip(u, v, strict=True))))
            for hits in lines.values():
                words = {a + k for a, _ in hits for k in range(width)}
                pairs = set().union(*(p for _, p in hits))
                if len(words) >= min(len(it), least) and len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
                    found.add((d, i))
    return found


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", broadcast)
    rnd = random.Random(21)
    word = lambda: rnd.choice(["apples", "gave", "then", "Alice", "Robert", "Maria", "12", "7", "3.5", "km", "kg", "walks", "to", "the", "The", "river", "-", "red,", "end."])
    items = [(i, " ".join(word() for _ in range(rnd.choice([4, 7, 14, 20])))) for i in range(12)]
    names = {"Alice": "Xenia", "Robert": "Yorick", "Maria": "Zora", "12": "99", "7": "41"}
    docs = []
    for d in range(150):
        i = rnd.randrange(12)
        part = items[i][1].split()
        kind = rnd.randrange(4)
        if kind == 1:
            part = [names.get(w, w) for w in part]
        elif kind == 2:
            part = [rnd.choice(list(names.values())) if w in names else w for w in part]
        elif kind == 3:
            part = part[rnd.randrange(4) :][: rnd.randint(4, 12)]
        docs.append((d, " ".join([word() for _ in range(rnd.randrange(9))] + part + [word() for _ in range(9)])))
    docs += [(d, docs[d][1]) for d in range(20)]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    want = leaks_by_hand(docs, items)
    assert len(want) > 30
    assert {tuple(r)[:2] for r in got.collect()} == want


def test_templates_have_as_many_words(spark):
    rnd = random.Random(5)
    bits = ["a", "Bé", "12", "-", "...", "%", "#", "\ue000", "é", " ", "  ", "\n", "\t", "'", "½", "İ", "5 km", "$3"]
    rows = [("".join(rnd.choice(bits) for _ in range(rnd.randrange(30))),) for _ in range(500)]
    df = D._template(spark.createDataFrame(rows, "text string").select(D._cleaned(F.col("text")).alias("t")))
    assert df.where(F.size("raw") != F.size("tpl")).count() == 0


def test_placeholders_alone_and_literal_signs(spark):
    bench = spark.createDataFrame([(1, "1 2 3 4 5 6 7 8 9 10"), (2, "we put # and @ and % into the list of the words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x 1 2 3 4 5 6 7 8 9 10 y"), (2, "x 11 12 13 14 15 16 17 18 19 20 y"), (3, "so we put 7 and Bob and % into the list of the words")], "doc_id long, text string")
    assert {tuple(r)[:2] for r in leaks(docs, bench).collect()} == {(1, 1)}
