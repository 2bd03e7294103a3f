import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_jaccard_join import brute  # noqa: E402
from tests.llm.test_secret_scan import base  # noqa: E402
from tremorlake.llm.packing import encoder  # noqa: E402
from tremorlake.llm.queries import vocabulary  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rnd = random.Random(21)
    words = lambda n: " ".join("".join(rnd.choice("bcdfgaeiou") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    bench = [(i, words(16)) for i in range(4)]
    texts, labels, kinds = [], [], {}
    for i in range(400):
        t, kind = words(rnd.randint(5, 60)), "clean"
        if i % 5 == 0:
            t, kind = t + " vilescum rottenfool" * rnd.randint(1, 3), "toxic"
        elif i % 17 == 1 and texts:
            t, kind = texts[-1][1] + " more", "copy"
        elif i % 13 == 2:
            t, kind = t + " " + bench[i % 4][1], "leak"
        elif i % 11 == 3:
            t, kind = t + " password = hunter2hunter2 x", "secret"
        texts.append((i, t, "en", "s", len(t)))
        kinds[i] = kind
        if i < 300:
            labels.append((i, 1, int(kind == "toxic")))
    texts += [(900, None, "en", None, 0), (901, "", None, "s", 0), (902, texts[1][1], "en", "t", 1), (902, texts[1][1], "en", "t", 1), (None, "no id here", "en", "s", 1)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(texts, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), texts, bench, kinds


def test_stages(spark, data):
    d, texts, bench, kinds = data
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), COLUMNS)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        seen.append([tuple(r) for r in docs.collect()])
    toxic, near, leak, secret = seen
    # a copy of a toxic text is toxic too
    bad = {i for i, t, *_ in texts if t and "vilescum" in t}
    assert {r[0] for r in toxic} == {t[0] for t in texts} - bad
    comp = {i: c for i, _, c in brute([(i, t) for i, t, *_ in toxic if i is not None])}
    assert sorted((r[0] for r in near), key=str) == sorted({i for i, c in comp.items() if i == c} | {None}, key=str)
    held = {r[0] for r in near if any(b in (r[1] or "") for _, b in bench)}
    assert held and {r[0] for r in leak} == {r[0] for r in near} - held
    assert {r[0] for r in secret} == {r[0] for r in leak}
    before = {r[0]: r[1] for r in leak}
    for i, t, *_, n in secret:
        assert not base(t) and (t is None) == (before[i] is None)
        if not base(before[i]):
            assert t == before[i]
        else:
            assert "<secret>" in t and n == len(t)


def test_run_packs_what_is_left(spark, data):
    d, *_ = data
    got = pipeline.run(spark, d).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 1024
    assert pipeline.ORACLE_SQL is None and len(encoder(vocabulary())("x")) == 1
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
