import random

from tremorlake.llm.jaccard_join import jaccard_components


def sets(text, k=5):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows):
    ids, s = [r[0] for r in rows], [sets(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    comp = {}
    for i in range(len(rows)):
        comp[find(i)] = min(comp.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], len(s[i]), comp[find(i)]) for i in range(len(rows)))


def corpus(seed=1, groups=25):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeÉxyz") for _ in range(rnd.randint(2, 6)))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(3, 80))]
        if rnd.random() < 0.4:
            base = base[:10] + passage + base[10:]
        for _ in range(rnd.choice([1, 1, 2, 3, 12])):
            c = list(base)
            for _ in range(rnd.randint(0, 5)):
                c[rnd.randrange(len(c))] = word()
            out.append(" ".join(c) if rnd.random() < 0.7 else "\n".join(c).upper().replace("É", "é") if rnd.random() < 0.2 else " ".join(c))
    out += ["", "   ", None, "one two", "One TWO", "same same same same same same same"] + [out[0]] * 4 + ["long " * 20000]
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


def test_matches_brute_force(spark):
    rows = corpus()
    rows += [(500000 + i, t) for i, (_, t) in enumerate(corpus(seed=7))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).repartition(5)
    got = sorted(map(tuple, jaccard_components(df).collect()))
    assert got == brute(rows)


def test_group_where_the_first_pivot_is_far_from_most(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        c = list(base)
        for j in rnd.sample(range(60), 3):
            c[j] = f"x{i}_{j}"
        rows.append((i, " ".join(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard_components(df).collect())) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp long, root string")
    assert jaccard_components(df).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 2)], "doc_id long, text string, root int")
    assert sorted(map(tuple, jaccard_components(df).collect()), key=str) == [(4, 2, 4), (4, 2, 4), (None, 2, 4)]
