import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.llm import language_id
from barflow.llm.language_id import language_mixtures, mixture, ngrams, shares
from barflow.llm.queries import op13_language_id

SCHEMA = "languages string, doc_id long, lang string, text string, score int, held_out string"
ALPHABETS = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "жзийклмн"}


def words(rnd, lang, n):
    return " ".join("".join(rnd.choice(ALPHABETS[lang]) for _ in range(rnd.randrange(2, 8))) for _ in range(n))


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op13_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 10_000
    mine = [r for r in got if r.held_out]
    assert {held_out(r.doc_id) for r in mine} == {True} and len(mine) > 1500
    assert np.mean([r.lang == r.lang_pred for r in mine]) > 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_predictions_take_no_labels_of_the_held_out_fold(spark):
    rnd = random.Random(1)
    rows = [("x", i, lang, words(rnd, lang, 30), 0, "") for i in range(200) for lang in [rnd.choice(["aa", "bb"])]]
    wrong = [(*r[:2], "cc" if held_out(r[1]) else r[2], *r[3:]) for r in rows]
    a, b = (sorted(language_mixtures(spark.createDataFrame(x, SCHEMA)).collect()) for x in (rows, wrong))
    assert a == b and {r.lang_pred for r in a} == {"aa", "bb"}
    truth = {r[1]: r[2] for r in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in a)


def test_mixed_documents(spark):
    rnd = random.Random(2)
    rows = [("x", i, lang, words(rnd, lang, 60), 0, "") for i in range(300) for lang in [rnd.choice(list(ALPHABETS))]]
    asked = [("x", 1000 + i, None, words(rnd, a, 150) + " " + words(rnd, b, 50), 0, "") for i, (a, b) in enumerate((a, b) for a in ALPHABETS for b in ALPHABETS if a != b)]
    got = {r.doc_id: r for r in language_mixtures(spark.createDataFrame(rows + asked, SCHEMA)).where("doc_id >= 1000").collect()}
    for i, (a, b) in enumerate((a, b) for a in ALPHABETS for b in ALPHABETS if a != b):
        r = got[1000 + i]
        assert [x.lang for x in r.languages] == [a, b] and r.lang_pred == a
        assert abs(r.languages[0].share - 0.75) < 0.06 and abs(r.score - r.languages[0].share) < 1e-6
    single = language_mixtures(spark.createDataFrame(rows, SCHEMA)).collect()
    assert np.mean([len(r.languages) == 1 for r in single]) > 0.97


def test_odd_rows(spark):
    rnd = random.Random(3)
    taught = [("x", i, "aa", words(rnd, "aa", 20), 0, "") for i in range(40)] + [("x", i, "bb", words(rnd, "bb", 20), 0, "") for i in range(40, 80)]
    odd = [("x", 100, "aa", None, 0, ""), ("x", 101, "bb", "", 0, ""), ("x", 102, None, "12 34 !?\n", 0, ""), ("x", None, "aa", words(rnd, "aa", 9), 0, ""), ("x", 103, None, words(rnd, "bb", 400_000), 0, ""), ("x", 104, "dd", None, 0, ""), ("x", 104, "dd", "...", 0, ""), taught[3], taught[3], ("x", 105, None, "\U00020000字Ωß", 0, "")]
    got = language_mixtures(spark.createDataFrame(taught + odd, SCHEMA)).collect()
    assert len(got) == len(taught + odd)
    of = {r.doc_id: r for r in got}
    assert all((of[i].lang_pred, of[i].score) == ("und", 0.0) for i in (100, 101, 102, 104))
    assert of[None].lang_pred == "aa" and of[103].lang_pred == "bb" and of[105].lang_pred in ("aa", "bb")
    assert sum(r == of[3] for r in got) == 3
    # no language at all, and no rows
    untaught = language_mixtures(spark.createDataFrame([("x", i, None, "abc", 0, "") for i in range(9)], SCHEMA)).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}
    assert language_mixtures(spark.createDataFrame([], SCHEMA)).count() == 0
    one = language_mixtures(spark.createDataFrame(taught + odd, SCHEMA), most_languages=1).where("lang_pred <> 'und'").collect()
    assert len({r.lang_pred for r in one}) == 1


def test_counts_are_of_all_texts(spark):
    rnd = random.Random(4)
    rows = [("x", i, lang, words(rnd, lang, 10), 0, "") for i in range(60) for lang in ["aa", "cc"]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {(r.lang, r.bucket): r.n for r in language_id.language_counts(df, ["aa", "cc"]).collect()}
    for lang in ("aa", "cc"):
        want = sum(ngrams(r[3]) for r in rows if r[2] == lang)
        assert {b: n for (x, b), n in got.items() if x == lang} == {int(b): int(want[b]) for b in np.flatnonzero(want)}


@pytest.mark.parametrize("seed", range(4))
def test_shares_are_the_best_of_a_grid(seed):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(np.ones(40), 2).T
    true = rng.uniform(0.1, 0.9)
    n = rng.multinomial(4000, p @ [true, 1 - true]).astype(float)
    w, likelihood = shares(n, p, np.array([0.5, 0.5]))
    grid = np.linspace(0.001, 0.999, 999)
    values = [n @ np.log(p @ [g, 1 - g]) for g in grid]
    assert likelihood >= max(values) - 1 and abs(w[0] - grid[int(np.argmax(values))]) < 0.02


def test_sets_are_chosen_by_penalised_likelihood():
    rng = np.random.default_rng(7)
    p = rng.dirichlet(np.ones(60), 4).T
    for true in ([1, 0, 0, 0], [0, 0.5, 0, 0.5], [0.4, 0.3, 0.3, 0]):
        n = rng.multinomial(9000, p @ true).astype(float)
        chosen, _ = mixture(n, p)
        assert set(chosen) == {i for i, t in enumerate(true) if t}
        assert abs(sum(chosen.values()) - 1) < 1e-9


def test_ngrams():
    assert ngrams("") is None and ngrams(" 12\t.") is None
    assert (ngrams("Ab, c") == ngrams("  ab 7 C ")).all()
    assert ngrams("abc").sum() == 3  # " ab", "abc", "bc "
