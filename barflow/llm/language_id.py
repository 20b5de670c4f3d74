"""Languages of documents by mixture inference over letter n-grams.

Each language of the labelled training folds is a distribution over hashed n-grams of three letters,
counted by Spark over all of its texts and mixed with the mean of all languages, so n-grams that no
language has favour none.  A document is a mixture: expectation-maximisation finds the share of each
language from its n-grams' likelihoods.  Languages enter in order of their shares as long as the
penalised likelihood grows: n-grams overlap, so a third of the log-likelihood counts, less half a log of
the n-grams' number for each language.  The prediction is the largest share of the chosen set; its score
is that share times the posterior of the best single language among all, which is low only for texts too
short to tell.

A text that is null or has no letter is `und` with score 0, and so is every text where no language was
learned.  Null languages and null texts teach nothing; a null doc_id counts as crc32("") for the fold.
Very long texts are read whole.  Repeated rows each give a row and each count.  Ties go to the
language whose name comes first.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import each_batch
from barflow.llm.quality import fold

ORDER = 3
BUCKETS = 1 << 14  # of hashed n-grams; the table broadcast has BUCKETS x languages numbers
MOST_LANGUAGES = 200  # that are learned, those with most documents first
SHARED = 0.02  # weight of the mean of all languages in each
STEPS = 40  # of expectation-maximisation, at most
STILL = 1e-4  # change of shares at which it stops
UNKNOWN = "und"

#: Code points of the basic plane that are letters; those beyond count as letters.
_LETTER = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def ngrams(text: str) -> np.ndarray | None:
    """Counts of the whole text's n-grams by bucket, lower case, all else than letters one blank; None if it has no letter."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.ones(len(a), bool)
    low = a < 1 << 16
    letter[low] = _LETTER[a[low]]
    if not letter.any():
        return None
    a = np.concatenate(([32], np.where(letter, a, 32), [32])).astype(np.uint32)
    blank = a == 32
    a = a[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
    h = np.zeros(len(a) - ORDER + 1, np.uint32)
    for i, f in enumerate(_FACTORS):
        h = (h ^ (a[i : len(h) + i] * np.uint32(f))) * np.uint32(0x27D4EB2F)
    return np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)


def language_counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, bucket, n) summed over all texts of these languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                found = ngrams(text)
                if found is not None:
                    held[lang] = held[lang] + found if lang in held else found
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])

    taught = docs.where(F.col("lang").isin(languages) & F.col("text").isNotNull())
    return taught.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages, BUCKETS x languages probabilities) from frame (text, lang)."""
    several = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    languages = sorted(r["lang"] for r in several)
    table = np.zeros((BUCKETS, len(languages)))
    if languages:
        found = language_counts(docs, languages).toArrow()
        place = {x: i for i, x in enumerate(languages)}
        column = np.fromiter((place[x] for x in found.column("lang").to_pylist()), np.int64, found.num_rows)
        table[found.column("bucket").to_numpy(), column] = found.column("n").to_numpy()
    taught = table.sum(0) > 0
    languages, table = [x for x, t in zip(languages, taught) if t], table[:, taught]
    return languages, shared(table)


def shared(counts: np.ndarray) -> np.ndarray:
    """Each column's probabilities, SHARED of them the mean of all columns and of a count one everywhere."""
    if not counts.shape[1]:
        return counts
    p = counts / counts.sum(0)
    mean = p.mean(1) + 1 / counts.sum()
    return (1 - SHARED) * p + SHARED * (mean / mean.sum())[:, None]


def shares(n: np.ndarray, p: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """(shares, log-likelihood) of the mixture of p's columns after expectation-maximisation from start."""
    w, total = start, n.sum()
    for _ in range(STEPS):
        new = w * ((n / (p @ w)) @ p) / total
        moved = np.abs(new - w).max()
        w = new
        if moved < STILL:
            break
    return w, float(n @ np.log(p @ w))


def mixture(n: np.ndarray, p: np.ndarray) -> tuple[dict[int, float], float]:
    """(share of each chosen column, posterior of the best single one) for n-gram counts n with probabilities p."""
    size = p.shape[1]
    single = n @ np.log(p)
    posterior = 1 / np.exp((single - single.max()) / ORDER).sum()
    best = int(single.argmax())
    if size == 1:
        return {0: 1.0}, 1.0
    penalty = 0.5 * np.log(max(n.sum() / ORDER, 2.0))
    every, _ = shares(n, p, np.full(size, 1 / size))
    order = [best, *(i for i in np.argsort(-every, kind="stable").tolist() if i != best)]
    chosen, value = {best: 1.0}, single[best] / ORDER
    for k in range(2, size + 1):
        if every[order[k - 1]] * n.sum() < 1:
            break
        of = order[:k]
        start = every[of] + 1e-3
        w, likelihood = shares(n, p[:, of], start / start.sum())
        if likelihood / ORDER - (k - 1) * penalty <= value:
            break
        chosen, value = dict(zip(of, w.tolist())), likelihood / ORDER - (k - 1) * penalty
    return chosen, float(posterior)


def language_mixtures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages array of (lang, share), largest first) per document; fold 0 teaches nothing."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held = fold(F.col("doc_id")) == 0
    languages, table = learn(known.where(~held).select("text", "lang"), most_languages)
    model = docs.sparkSession.sparkContext.broadcast(table)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p = model.value
        predicted, score, parts = [], [], []
        for text in b.column("text").to_pylist():
            n = ngrams(text) if text and languages else None
            if n is None:
                predicted.append(UNKNOWN)
                score.append(0.0)
                parts.append([])
                continue
            at = np.flatnonzero(n)
            chosen, posterior = mixture(n[at].astype(float), p[at])
            ranked = sorted(chosen.items(), key=lambda x: (-x[1], x[0]))
            predicted.append(languages[ranked[0][0]])
            score.append(min(1.0, ranked[0][1] * posterior))
            parts.append([{"lang": languages[i], "share": s} for i, s in ranked])
        of = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(predicted, pa.string()), pa.array(score, pa.float64()), pa.array(parts, of)], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    return each_batch(known.select("doc_id", "text", held.alias("held_out")), run, "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang string, share double>>")
