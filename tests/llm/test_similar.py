import random

from barflow.llm.similar import one_of_each, similarity


def kept(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return sorted(r.doc_id for r in one_of_each(df).collect())


def brute_force(docs):
    label = list(range(len(docs)))
    sets = [set(zip(*(d.split()[k:] for k in range(5)))) for d in docs]
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.5 * len(sets[i]) and label[i] != label[j] and similarity(docs[i], docs[j], 5) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return sorted(set(label))


def test_appended_and_truncated_copies(spark):
    rnd = random.Random(4)
    v = [f"w{i}" for i in range(4000)]
    docs = []
    for g in range(120):
        base = rnd.choices(v, k=rnd.choice([80, 300, 1000]))
        extra = rnd.choices(v, k=int(len(base) * rnd.uniform(0.08, 0.27)))
        at = rnd.randrange(len(base))
        docs += [" ".join(w) for w in (base, [base + extra, base[: -len(extra)], base[:at] + extra + base[at:]][g % 3])]
    want = brute_force(docs)
    assert 120 < len(want) < 200  # some copies are below 0.8
    assert kept(spark, docs) == want


def test_copies_among_unrelated_texts_of_the_same_words(spark):
    rnd = random.Random(5)
    v = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(60):
        base = rnd.choices(v, k=3000)
        copy = list(base)
        for at in rnd.sample(range(len(copy)), 20):
            copy[at] = rnd.choice(v)
        docs += [" ".join(base), " ".join(copy)]
    assert kept(spark, docs) == list(range(0, 120, 2))


def test_chain_whose_hub_is_not_similar_to_all(spark):
    rnd = random.Random(6)
    v = [f"w{i}" for i in range(3000)]
    base = rnd.choices(v, k=400)
    chain = [" ".join(base[at : at + 250]) for at in range(0, 150, 15)]
    apart = [" ".join(base[:160] + rnd.choices(v, k=60)) for _ in range(8)]
    assert kept(spark, chain + apart) == brute_force(chain + apart)


def test_recall_near_the_threshold_in_a_large_group(spark):
    rnd = random.Random(8)
    v = [f"w{i}" for i in range(5000)]
    base = rnd.choices(v, k=240)
    docs = []
    for _ in range(350):  # 1 to 6 changed words of 240: similarities of 0.78 to 0.96 with the base, less among each other
        w = list(base)
        for at in rnd.sample(range(len(w)), rnd.randrange(1, 7)):
            w[at] = rnd.choice(v)
        docs.append(" ".join(w))
    want = brute_force(docs)
    for parts in (1, 7):
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(parts)
        assert sorted(r.doc_id for r in one_of_each(df).collect()) == want


def test_very_long_texts(spark):
    rnd = random.Random(9)
    long = [rnd.choice("abcdefghij") + str(rnd.randrange(9000)) for _ in range(150_000)]
    near = list(long)
    for at in range(0, len(near), 400):
        near[at] = "changed"
    far = [w if i % 8 else "changed" for i, w in enumerate(long)]
    assert kept(spark, [" ".join(x) for x in (long, near, far)]) == [0, 2]


def test_family_below_the_threshold_and_a_shingle_in_every_text(spark, monkeypatch):
    """Texts of 8 of 12 passages and one template passage in all: nearly all pairs share rare shingles, few are similar; small chunks."""
    rnd = random.Random(10)
    v = [f"w{i}" for i in range(3000)]
    template = rnd.choices(v, k=40)
    passages = [rnd.choices(v, k=30) for _ in range(12)]
    docs = []
    for _ in range(90):
        docs.append(" ".join(template + sum((passages[i] for i in sorted(rnd.sample(range(12), 8))), [])))
    docs += [" ".join(template + rnd.choices(v, k=rnd.randrange(4, 60))) for _ in range(40)]
    docs += [d + " tail of its own" for d in docs[:30]]
    want = brute_force(docs)
    assert 60 < len(want) < 130
    for chunk in (256, 5):
        monkeypatch.setattr("barflow.llm.similar.CHUNK", chunk)
        assert kept(spark, docs) == want
    monkeypatch.setattr("barflow.llm.similar.BUCKET_BYTES", 16)  # more bits of the hashes
    assert kept(spark, docs) == want


def test_open_pairs_are_rows_only_where_they_share_enough(spark):
    """As many candidate pairs as pairs that share enough lists, however many shingles they share."""
    from barflow.llm import similar

    rnd = random.Random(11)
    v = [f"w{i}" for i in range(3000)]
    passages = [rnd.choices(v, k=40) for _ in range(12)]
    docs = [" ".join(sum((passages[i] for i in sorted(rnd.sample(range(12), 8))), [])) for _ in range(100)]
    named = spark.createDataFrame([(similar._node(d) - (1 << 63), d) for d in set(docs)], "node long, text string")
    lists = similar.rare_lists(named, 5, 0.8)
    labels = spark.createDataFrame([], "node long, root long")
    got = similar.open_pairs(lists, labels, 0.8).collect()
    sets = {r.node: {x.h: (x.n, x.l, x.p) for x in lists.where(f"node = {r.node}").collect()} for r in named.select("node").limit(12).collect()}
    pairs = {(r.a, r.b) for r in got}
    assert len(pairs) == len(got)
    for a in sets:
        for b in sets:
            if a < b:
                common = [(sets[a][h], sets[b][h]) for h in sets[a].keys() & sets[b].keys()]
                can = [1 for (n, _, p), (m, _, q) in common if min(p, q) + min(n - p, m - q) >= 0.8 / 1.8 * (n + m) - 1e-6 and min(n, m) >= 0.8 * max(n, m) - 1e-6]
                assert ((a, b) in pairs) == bool(can and len(can) >= min(common[0][0][1], common[0][1][1]))


def test_fingerprints_link_near_copies_before_shared_shingles_do(spark, monkeypatch):
    """Copies with a few changed words are one group by SimHash and the exact check alone; other texts of like fingerprints are not."""
    from barflow.llm import similar

    rnd = random.Random(12)
    v = [f"w{i}" for i in range(5000)]
    docs = []
    for _ in range(20):
        base = rnd.choices(v, k=1500)
        docs += [" ".join(base), " ".join(base[:700] + ["changed"] + base[701:])]
    want = brute_force(docs)
    assert want == list(range(0, 40, 2)) and kept(spark, docs) == want
    none = lambda *_, **__: spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(similar, "hub_pairs", none)
    monkeypatch.setattr(similar, "open_pairs", none)
    assert kept(spark, docs) == want
    assert similar.print_pairs(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "node long, text string")).count() == 20
    monkeypatch.setattr(similar, "similarity", lambda *_: 0.0)
    assert kept(spark, docs) == list(range(40))


def test_sketches_leave_out_pairs_of_a_family_below_the_threshold(spark):
    """A family of nearly similar texts: no similar pair is lost, and of the others few become rows."""
    from barflow.llm import similar

    rnd = random.Random(13)
    v = [f"w{i}" for i in range(5000)]
    base = rnd.choices(v, k=200)
    docs = []
    for k in range(80):  # 5 to 8 changed words of 200: similarities of about 0.45 to 0.7, some pairs of copies above
        w = list(docs[k - 1].split() if k % 20 == 1 else base)
        for at in rnd.sample(range(len(w)), 1 if k % 20 == 1 else rnd.randrange(5, 9)):
            w[at] = rnd.choice(v)
        docs.append(" ".join(w))
    of = {similar._node(d) - (1 << 63): d for d in docs}
    named = spark.createDataFrame(list(of.items()), "node long, text string")
    lists, labels = similar.rare_lists(named, 5, 0.8), spark.createDataFrame([], "node long, root long")
    all_, few = ({(r.a, r.b) for r in similar.open_pairs(lists, labels, 0.8, sketched=s).collect()} for s in (None, similar.sketches(named, 5)))
    near = {(a, b) for a in of for b in of if a < b and similar.similarity(of[a], of[b], 5) >= 0.8}
    assert len(near) >= 4 and near <= few <= all_ and len(few) < len(near) + (len(all_) - len(near)) / 10
    assert kept(spark, docs) == brute_force(docs)
