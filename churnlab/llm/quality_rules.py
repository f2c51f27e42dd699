"""Quality rules: per-document counts and cross-document line frequency.

Base rules fail documents with fewer than 10 words, or with more than a fifth
of their words in repeated 5-word windows.  The line rule then:

1. normalises every line (lower case, one space between words) and hashes it;
2. counts, per host, the distinct documents that hold the line, a document
   being a distinct text, so that exact copies do not make their own lines
   boilerplate;
3. removes lines in more than ``min_docs`` documents and more than
   ``max_share`` of the host's documents;
4. rejects documents left with fewer than ``min_words`` words or less than
   ``min_left`` of their words.

Only built-in functions run.  Lines are counted before the shuffle, keyed by
(host, line), so a host with a third of all rows is spread over its lines.

A null text has no words and fails; a null host counts as the host ``''``.
Repeated rows give repeated results.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import WHITE, WHITE_RUN, WORD, let, words
from .store import bounded, stored

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_DOCS = 5
MAX_SHARE = 0.01
MIN_LEFT = 0.3


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def repeated_words(word_array: Column, k: int = WINDOW) -> Column:
    """Words that lie in a ``k``-word window found twice or more."""
    def covered(windows: Column) -> Column:
        def positions(pairs: Column) -> Column:
            same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
            twice = F.transform(pairs, lambda p, i: F.when(
                F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), p["i"]))
            return F.sort_array(F.filter(twice, lambda p: p.isNotNull()))
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-k).alias("last"))
        return F.aggregate(let(pairs, positions), start, lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(k), p - acc["last"])).cast("long").alias("n"), p.alias("last")), lambda acc: acc["n"])

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")) \
            .otherwise(covered(windows))

    def of_hashes(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - k)
        made = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
        return let(made, of_windows)

    return F.when(F.size(word_array) <= k, F.lit(0).cast("long")) \
        .otherwise(let(F.transform(word_array, lambda w: F.xxhash64(w)), of_hashes))


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts and ``base_failed``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = _lines(F.col(text_col))
    counted = docs.withColumn("_words", words(F.col(text_col))).withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
    }).drop("_words")
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def line_table(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc, host, text_hash, at, line, n): every line with a word, hashed after normalising."""
    keyed = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(host_col), F.lit("")).alias("host"),
                        F.xxhash64(text_col).alias("text_hash"),
                        F.posexplode(_lines(F.col(text_col))).alias("at", "raw"))
    bare = F.lower(F.btrim("raw", F.lit(WHITE)))
    return keyed.select("doc", "host", "text_hash", "at", F.split(bare, WHITE_RUN).alias("w")) \
        .select("doc", "host", "text_hash", "at", F.xxhash64("w").alias("line"), F.size("w").alias("n"))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line, n_docs) above the limits."""
    per_line = lines.select("host", "line", "text_hash").distinct() \
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    per_host = lines.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    return per_line.join(per_host, "host").where(F.col("n_docs") > max_share * F.col("host_docs")) \
        .select("host", "line", "n_docs")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """(doc_id, n_words, ..., base_failed, removed_words, kept) of every row."""
    lines = line_table(docs, id_col, text_col, host_col)
    frequent = bounded(stored(frequent_lines(lines, min_docs, max_share).select("host", "line")), 500_000)
    key = ["doc", "host", "text_hash"]
    removed = lines.join(frequent, ["host", "line"]) \
        .groupBy(*key, "at").agg(F.max("n").alias("n")).groupBy(*key).agg(F.sum("n").alias("removed_words"))
    base = base_rules(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                                  F.coalesce(F.col(host_col), F.lit("")).alias("host"),
                                  F.xxhash64(text_col).alias("text_hash"))).drop("text")
    same = base["doc_id"].eqNullSafe(removed["doc"]) & (base["host"] == removed["host"]) \
        & (base["text_hash"] == removed["text_hash"])
    gone = F.coalesce(F.col("removed_words"), F.lit(0)).cast("long")
    left = F.col("n_words") - gone
    return base.join(removed, same, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        gone.alias("removed_words"),
        (~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_left * F.col("n_words"))).alias("kept"))


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                           min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """``docs`` with the lines above the limits taken out of their texts."""
    lines = line_table(docs, id_col, text_col, host_col)
    frequent = bounded(stored(frequent_lines(lines, min_docs, max_share).select("host", "line")), 500_000)
    out = lines.join(frequent, ["host", "line"]).groupBy("text_hash", "host").agg(F.collect_set("line").alias("_out")) \
        .withColumnRenamed("text_hash", "_th").withColumnRenamed("host", "_host")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.coalesce(F.array_contains(
        "_out", F.xxhash64(F.split(F.lower(F.btrim(x, F.lit(WHITE))), WHITE_RUN))), F.lit(False))), "\n")
    return docs.join(out, (F.xxhash64(docs[text_col]) == out["_th"])
                     & (F.coalesce(docs[host_col], F.lit("")) == out["_host"]), "left") \
        .select(*[kept.alias(c) if c == text_col else docs[c] for c in docs.columns])


def oracle_sql(min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> str:
    """``quality_rules`` of ``documents`` for DuckDB, which compares texts where Spark compares hashes."""
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls
  FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
five AS (
  SELECT doc_id, i, [w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p] AS g
  FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM five WHERE g[5] IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(5) r(j) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.host, d.text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered c USING (doc_id)),
raw AS (SELECT doc_id, host, text, unnest(ls) AS l FROM d),
lines AS (SELECT doc_id, host, text, regexp_extract_all(lower(l), '{word}') AS l FROM raw),
hosts AS (SELECT host, count(DISTINCT text) AS n FROM lines GROUP BY host),
often AS (
  SELECT l.host, l.l FROM (SELECT host, l, count(DISTINCT text) AS n FROM lines GROUP BY host, l) l
  JOIN hosts h USING (host) WHERE l.n > {min_docs} AND l.n > {max_share} * h.n),
gone AS (SELECT doc_id, sum(len(l))::BIGINT AS n FROM lines JOIN often USING (host, l) GROUP BY doc_id),
judged AS (
  SELECT b.*, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
         coalesce(g.n, 0)::BIGINT AS removed_words
  FROM base b LEFT JOIN gone g USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
       (NOT base_failed AND n_words - removed_words >= {MIN_WORDS}
        AND n_words - removed_words >= {min_left} * n_words) AS kept
FROM judged"""
