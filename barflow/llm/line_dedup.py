"""Removal of lines that spread over many sites, with DataFrame functions only.

A line's sites are counted by HyperLogLog sketches that merge by aggregation, also before the shuffle;
a line whose estimate is near the threshold is counted exactly.  Lines that reach the threshold go
from every document but the first that has them (least doc_id, then position), so that no text is lost
entirely.  The few spread lines meet their occurrences by broadcast while their number is small; beyond
that occurrences are salted by how often the most frequent line occurs, so no task gets a line whole.

Only lines of at least min_chars characters count; a null site is a site of its own.  Nulls: a
null text has no lines and stays null; a null doc_id comes first.  Texts of very many lines are rebuilt
in time that grows with their length.  Rows that repeat in full are treated alike.  All columns,
whatever their names, are handed on.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import written

MIN_SITES = 10
MIN_CHARS = 20
NEAR = 0.5  # estimates within this share of the threshold are counted exactly
LG_K = 10  # a sketch's relative error is about 1.04 / sqrt(2 ** LG_K), 3 %
SMALL = 100_000  # spread lines of some 40 bytes up to which they are broadcast
OCCURRENCES = 1_000_000  # of one line in a task, about, beyond that


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    each = rows.select("id", "key", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length("line") >= min_chars)
    return each.select("id", "key", "site", "pos", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g"))


def of_lines(lines: DataFrame, few: DataFrame, small: int = SMALL, occurrences: int = OCCURRENCES) -> DataFrame:
    """The occurrences of the lines in few (h, g, n: how often they occur, ...)."""
    size = few.agg(F.count("*").alias("lines"), F.max("n").alias("most")).first()
    if size["lines"] <= small:
        return lines.join(F.broadcast(few.drop("n")), ["h", "g"])
    salts = -(-size["most"] // occurrences)
    salted = few.drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("id", "pos", "key"), F.lit(salts)).cast("int")).join(salted, ["h", "g", "salt"]).drop("salt")


def spread_lines(lines: DataFrame, min_sites: int, small: int = SMALL, occurrences: int = OCCURRENCES) -> DataFrame:
    """(h, g, first, n): the lines on at least min_sites sites, where they come first and how often they occur."""
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K)))
    sketched = lines.groupBy("h", "g").agg(sketch.alias("sites"), F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n"))
    likely = written(sketched.where(F.col("sites") >= (1 - NEAR) * min_sites), "sketched")
    near = likely.where(F.col("sites") <= (1 + NEAR) * min_sites).select("h", "g", "n")
    exact = of_lines(lines, near, small, occurrences).groupBy("h", "g", "site").agg(F.lit(1)).groupBy("h", "g").agg(F.count("*").alias("exact"))
    return likely.join(exact, ["h", "g"], "left").where(F.coalesce("exact", "sites") >= min_sites).select("h", "g", "first", "n")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text", counts: bool = False, small: int = SMALL, occurrences: int = OCCURRENCES) -> DataFrame:
    """docs with the text that is left; with counts, (n_lines, n_removed) follow as two more columns."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.col(f"row.`{text_col}`")
    rows = rows.select("row", F.col(f"row.`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(f"row.`{site_col}`").cast("string")), F.lit("")).alias("site"))
    rows = rows.select("row", "id", "site", F.xxhash64(text, "site").alias("key"))
    lines = _lines(rows.select("id", "key", "site", text.alias("text")), min_chars)
    spread = written(spread_lines(lines, min_sites, small, occurrences), "spread")
    hit = of_lines(lines, spread, small, occurrences).where(~F.struct("id", "pos").eqNullSafe(F.col("first")))
    at = F.array_sort(F.collect_set("pos")).alias("at")
    # one byte a line up to the last that goes: x where it goes
    marks = F.transform("at", lambda p, i: F.concat(F.repeat(F.lit("."), p - F.coalesce(F.get("at", i - 1), F.lit(-1)) - 1), F.lit("x")))
    cut = hit.groupBy(F.col("id").alias("of"), F.col("key").alias("k")).agg(at).select("of", "k", F.size("at").alias("gone"), F.array_join(marks, "").cast("binary").alias("marks"))
    joined = rows.join(cut, rows.id.eqNullSafe(F.col("of")) & (rows.key == F.col("k")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: F.substring("marks", i + 1, F.lit(1)) != F.lit("x").cast("binary")), "\n")
    out = [(F.when(F.col("gone").isNull(), text).otherwise(kept) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    more = [n_lines.alias("n_lines"), F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed")] if counts else []
    return joined.select(*out, *more)
