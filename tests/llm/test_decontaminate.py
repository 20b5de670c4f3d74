import hashlib
import random
import re

from barflow.llm import decontaminate as D

SCHEMA = "text string, doc_id long, key long, items string, hits string"
ITEMS = "text string, item_id long, window int"


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    windows = [(i, w[k : k + 13]) for t, i in items if i is not None for w in [words(t)] for k in range(max(1, len(w) - 12) if w else 0)]
    out = []
    for t, d in docs:
        w, hit, found = words(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    found.add(i)
        names = ",".join(sorted(map(str, found)))
        out.append((str(d), len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def data():
    rnd = random.Random(5)
    v = [f"w{i}" for i in range(30)] + ["ñu", "Été", "A1"]
    items = [(" ".join(rnd.choices(v, k=rnd.choice([1, 3, 12, 13, 14, 40]))), i) for i in range(12)]
    items += [("", 50), (None, 51), ("!!", 52), ("w1 w2 null item", None), (items[3][0], 53)]
    docs = []
    for i in range(150):
        w = rnd.choices([*v, "zz", "Q"], k=rnd.choice([0, 5, 80, 400]))
        if i % 3 == 0 and w:
            p = rnd.choice(items[:12])[0].split()
            at = rnd.randrange(len(w))
            w[at:at] = p[rnd.randrange(len(p)) :] if i % 2 else p
        docs.append((rnd.choice([" ", ", ", "-\n"]).join(w).upper() if i % 5 == 0 else " ".join(w), i))
    return [*docs, (None, 900), ("", 901), ("no id w1", None), docs[0], docs[3], docs[3], ("w1 " * 30000, 902)], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = data()
    df = spark.createDataFrame([(t, d, 1, "x", "y") for t, d in docs], SCHEMA)
    bench = spark.createDataFrame([(t, i, 3) for t, i in items], ITEMS)
    want = brute(docs, items)
    for size, shard, blocks in ((16 << 20, 1 << 20, 4), (400, 500, 2), (400, 1 << 20, 100)):
        monkeypatch.setattr(D, "BLOCKS", blocks)
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        monkeypatch.setattr(D, "SHARD_WORDS", shard)
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.contamination(df, bench).collect())
        assert got == want
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if not w[-1])


def test_empty_tables(spark):
    docs, items = data()
    df = spark.createDataFrame([(t, d, 1, "x", "y") for t, d in docs], SCHEMA)
    bench = spark.createDataFrame([(t, i, 3) for t, i in items], ITEMS)
    assert D.contamination(df.limit(0), bench).count() == 0
    assert D.contamination(df, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_longest_matches(spark):
    docs = [("x b c d e x", 4), ("b c d", 2), ("b c d e", 3)]
    got = {(r.item_id, r.item_word): (r.n_words, r.doc_id, r.doc_word) for r in D.longest_matches(spark.createDataFrame([(t, d, 1, "x", "y") for t, d in docs], SCHEMA), spark.createDataFrame([("a b c d e f", 7, 3)], ITEMS)).collect()}
    assert (7, 0) not in got and (7, 5) not in got
    assert [got[7, k][0] for k in range(1, 5)] == [4, 3, 2, 1]


def test_longest_matches_beyond_the_window(spark, monkeypatch):
    rnd = random.Random(7)
    v = [f"w{i}" for i in range(6)]
    items = [(" ".join(rnd.choices(v, k=60)), i) for i in range(3)]
    docs = [(" ".join([*rnd.choices(v, k=20), *items[i % 3][0].split()[i : i + rnd.choice([3, 14, 45])], *rnd.choices(v, k=20)]), 100 - i) for i in range(12)]

    def brute_match(words_, k):
        found = []
        for t, d in docs:
            w = t.split()
            for p in range(len(w)):
                n = 0
                while p + n < len(w) and k + n < len(words_) and w[p + n] == words_[k + n]:
                    n += 1
                if n:
                    found.append((-n, d, p))
        return min(found, default=None)

    want = {(i, k): m for t, i in items for w in [t.split()] for k in range(len(w)) if (m := brute_match(w, k))}
    df, bench = spark.createDataFrame([(t, d, 1, "x", "y") for t, d in docs], SCHEMA), spark.createDataFrame([(t, i, 3) for t, i in items], ITEMS)
    for size, shard in ((16 << 20, 1 << 20), (200, 100)):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        monkeypatch.setattr(D, "SHARD_WORDS", shard)
        got = {(r.item_id, r.item_word): (-r.n_words, r.doc_id, r.doc_word) for r in D.longest_matches(df, bench).collect()}
        assert {k: m[0] for k, m in got.items()} == {k: m[0] for k, m in want.items()}
        assert {k: m for k, m in got.items() if -m[0] >= 13} == {k: m for k, m in want.items() if -m[0] >= 13}
    assert min(m[0] for m in want.values()) < -30
