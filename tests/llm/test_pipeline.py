import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from barflow.llm.common import read  # noqa: E402
from barflow.llm.decontaminate import contamination  # noqa: E402
from barflow.llm.similar import one_of_each, similarity  # noqa: E402
from barflow.llm.toxicity import toxicity_scores  # noqa: E402

SMALL = "/root/testdata/sf0.01"
SCHEMA = "text string, doc_id long, lang string, node long, key long, row string, d long"


def test_one_of_each_group(spark):
    rnd = random.Random(2)
    v = [f"w{i}" for i in range(3000)]
    docs, group = [], {}
    for g in range(60):
        base = rnd.choices(v, k=rnd.choice([100, 300, 800]))
        for c in range(rnd.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2]) if c else 0):
                w[rnd.randrange(len(w))] = rnd.choice(v)
            group[len(docs)] = g
            docs.append((" ".join(w), len(docs)))
    extra = [(None, 900), ("", 901), (docs[0][0].upper(), None), docs[1], docs[1], ("one two", 902), ("One  two", 903)]
    df = spark.createDataFrame([(t, d, "en", 1, 2, "r", 3) for t, d in docs + extra], SCHEMA)
    out = one_of_each(df)
    assert out.columns == df.columns
    kept = [r.doc_id for r in out.collect()]
    firsts = {g: min(d for d, h in group.items() if h == g) for g in group.values()}
    assert sorted(kept) == sorted([*firsts.values(), 900, 902])
    assert one_of_each(df.limit(0)).count() == 0


def test_similarity():
    assert similarity("a b c d e f", "A b  c d e f", 5) == 1 and similarity("", "", 5) == 1 and similarity("a", "b", 5) == 0


def test_stages(spark):
    docs = read(spark, SMALL, "documents")
    names = docs.columns
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == names
        path = corpus_pipeline.shared_folder(spark, name)
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        now = [r.doc_id for r in kept.select("doc_id").collect()]
        assert len(now) == len(set(now)) and set(now) <= seen
        if name == "toxicity":
            assert {r.doc_id for r in toxicity_scores(docs, read(spark, SMALL, "labels")).where("rejected").collect()} == seen - set(now)
        if name == "line_dedup":
            assert set(now) == seen
        if name == "decontamination":
            assert {r.doc_id for r in contamination(docs, read(spark, SMALL, "benchmark")).where("contaminated").collect()} == seen - set(now)
            assert contamination(kept, read(spark, SMALL, "benchmark")).where("contaminated").count() == 0
        docs, seen = kept, set(now)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == seen
    assert max(r.offset + r.length for r in packed) <= 2048


def test_toxicity_separates(spark):
    labels = {r.doc_id: r.toxic for r in read(spark, SMALL, "labels").collect()}
    scored = toxicity_scores(read(spark, SMALL, "documents"), read(spark, SMALL, "labels")).where("doc_id is not null").collect()
    right = [r.rejected == bool(labels[r.doc_id]) for r in scored if r.doc_id in labels]
    assert sum(right) > 0.97 * len(right)


def test_stages_on_odd_rows(spark, tmp_path):
    passage = " ".join(f"b{i}" for i in range(20))
    fine = lambda k: " ".join(f"w{(k * 131 + i * i) % 977}" for i in range(60))
    spark.createDataFrame([(i, 1, int(i % 2)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (None, "x"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, ("you vile wretch " if i % 2 else "") + fine(i)) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "long " * 100_000), (103, passage), (104, fine(200)), (104, fine(200)), (105, fine(200) + " tail"), (None, fine(300)), (106, "you vile wretch " + fine(400))]
    schema = "doc_id long, text string, lang string, source string, n_chars int, key string, row string, piece_no int, rejected int"
    docs = spark.createDataFrame([(d, t, "en", None, None, "k", "r", 1, 2) for d, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names
        path = corpus_pipeline.shared_folder(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    kept = [r.doc_id for r in docs.collect()]
    # 101 is empty as 100 is, 105 nearly 104; what the classifier makes of 102, one word repeated, is left open
    assert set(kept) - {102} == {*range(0, 40, 2), 100, 104, None} and len(kept) == len(set(kept))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept)
