"""Line dedup: an exact set-similarity join of lines, and removal of later matches.

A line (text between ``\\n``, with at least one word) is the set of its 5-word
shingles, lower-cased; a line of one to four words is one token.  Lines match
when their Jaccard similarity is at least ``percent`` / 100.  Lines are ordered
by document id, then line number, and a line is removed if it matches an
earlier line of the input.  The steps:

1. Lines of equal text collapse to their first; all others are removed.
2. Tokens are counted over all lines in a sketch of fixed size, which orders
   each line's tokens by rarity (then by hash).  The sketch only orders tokens,
   so its size affects speed, not rows.
3. Prefix filter: two matching lines share one of their ``n - ceil(t n) + 1``
   rarest tokens, so only those are shuffled.
4. Star round: a line is compared with the first line of each of its tokens,
   after the length filter and the positional filter (what can still be shared
   before and after a common token must suffice).
5. Lines without a match so far are compared with all earlier lines that share a
   prefix token and pass the filters.  A large group of near copies is thus
   settled by the star round, and its pairs are not listed.
6. Candidates are verified on their whole token sets.

Only built-in functions run.  Tokens whose sketch count passes ``hot_rows`` are
salted in step 4.  Null and empty texts stay as they are.  A row without an id is a
document of its own, behind all others (in no defined order among themselves).  A row
repeated whole counts as one document.  Other columns are kept
by ``without_repeated_lines`` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import WHITE, WHITE_RUN, WORD, let
from .store import BROADCAST_ROWS, UNNAMED, bounded, stored, with_ids, without_made_ids

PERCENT = 75
SHINGLE = 5
BUCKETS = 1 << 16
HOT_ROWS = 1_000_000
SALTS = 32
#: A token is a rarity rank (12 bits) above 51 bits of hash.
HASH_BITS = 51
_DOC, _REMOVED = "__line_doc", "__line_removed"


#: Line numbers that may be broadcast with their documents (32 MB).
BROADCAST_LINES = 8_000_000


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, at, line): the lines with a word."""
    return _bare(docs.select("doc", F.posexplode(F.split("text", "\n")).alias("at", "line")))


def _bare(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").rlike(WORD)).select("doc", "at", F.lower(F.btrim("line", F.lit(WHITE))).alias("line"))


def _lines_without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The lines with a word that are not in ``gone`` (doc, at), which is stored.

    Beyond what can be broadcast row by row, the line numbers go to their documents as one
    array each, so documents and not lines are joined, and texts stay where they are while
    the arrays are few enough to broadcast.
    """
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return _lines(docs).join(F.broadcast(gone), ["doc", "at"], "left_anti")
    per_doc = stored(gone.groupBy("doc").agg(F.collect_set("at").alias("gone")))
    total = per_doc.agg(F.sum(F.size("gone")), F.count(F.lit(1))).first()
    side = F.broadcast(per_doc) if (total[0] or 0) + 16 * total[1] <= BROADCAST_LINES else per_doc
    rows = docs.join(side, "doc", "left").select("doc", "gone", F.split("text", "\n").alias("lines"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.when(F.col("gone").isNull(), every).otherwise(F.array_except(every, "gone"))
    pairs = let(F.col("lines"), lambda x: F.transform(kept, lambda i: F.struct(i.alias("at"), F.get(x, i).alias("line"))))
    return _bare(rows.select("doc", F.inline(pairs)))


def _word_hashes(line: Column) -> Column:
    return F.transform(F.split(line, WHITE_RUN), lambda w: F.xxhash64(w))


def _shingle(h: Column, i: Column, k: int) -> Column:
    """The hash of ``k`` words from place ``i``; a shorter line ends in nulls, which the hash skips."""
    return F.xxhash64(*[F.get(h, i + j) for j in range(k)])


def _places(h: Column, k: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0)))


def rarity_ranks(lines: DataFrame, k: int = SHINGLE, buckets: int = BUCKETS) -> DataFrame:
    """One row with an array: the rarity rank (0 to 4095) of each hash bucket, from counts over all lines."""
    hashed = lines.select(_word_hashes(F.col("line")).alias("h"))
    counted = hashed.select("h", F.explode(_places(F.col("h"), k)).alias("i")) \
        .groupBy(F.pmod(_shingle(F.col("h"), F.col("i"), k), F.lit(buckets)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = lines.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counted, "b", "left")
    rank = F.least(F.lit(4095), F.floor(F.log2(F.coalesce("n", F.lit(0)) + 1) * 64)).cast("int")
    return stored(every.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", rank.alias("r")))), lambda x: x["r"]).alias("ranks")))


def _tokens(lines: DataFrame, ranks: DataFrame, k: int, buckets: int) -> DataFrame:
    """(doc, at, tokens): sorted distinct tokens, the rarest first."""
    mask = (1 << HASH_BITS) - 1
    def token(h: Column) -> Column:
        rank = F.get(F.col("ranks"), F.pmod(h, F.lit(buckets)).cast("int")).cast("long")
        return F.shiftleft(rank, HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit(mask)))
    # a subquery with one row puts the array beside each line
    shingles = let(_word_hashes(F.col("line")), lambda h: F.transform(_places(h, k), lambda i: _shingle(h, i, k)))
    return lines.withColumn("ranks", ranks.scalar()) \
        .select("doc", "at", F.sort_array(F.array_distinct(F.transform(shingles, token))).alias("tokens"))


def _needed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of matching sets of these sizes."""
    return F.ceil((a + b) * percent / (100 + percent))


def _may_match(percent: int) -> Column:
    """Length, prefix and positional filter of a row (n, pos) against (m, qos), sharing the token there.

    Sets that share ``c`` tokens meet in the first n - c + 1 of one and m - c + 1
    of the other, so with the overlap that this pair of sizes needs, the prefixes
    get shorter than those made for all sizes.
    """
    n, pos, m, qos = (F.col(c) for c in ("n", "pos", "m", "qos"))
    needed = _needed(n, m, percent)
    reach = F.least(pos, qos) + 1 + F.least(n - pos - 1, m - qos - 1)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (pos <= n - needed) & (qos <= m - needed) & (reach >= needed)


def _verified(pairs: DataFrame, lines_of: DataFrame, ranks: DataFrame, k: int, buckets: int, percent: int) -> DataFrame:
    """The pairs (doc, at, d, a) whose whole token sets match."""
    ends = stored(pairs.select("doc", "at").union(pairs.select("d", "a")).distinct())
    ids = stored(ends.select("doc").distinct())
    lines = _lines(lines_of.join(bounded(ids), "doc", "left_semi")).join(bounded(ends), ["doc", "at"], "left_semi")
    sets = _tokens(lines, ranks, k, buckets)
    other = sets.select(F.col("doc").alias("d"), F.col("at").alias("a"), F.col("tokens").alias("others"))
    shared = F.size(F.array_intersect("tokens", "others"))
    return pairs.join(sets, ["doc", "at"]).join(other, ["d", "a"]) \
        .where(100 * shared >= percent * (F.size("tokens") + F.size("others") - shared)).select("doc", "at", "d", "a")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = SHINGLE,
                   buckets: int = BUCKETS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc, at) of every removed line; ``at`` counts all lines of the text from 0."""
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    lines = _lines(base)

    # equal texts
    keyed = stored(lines.select("doc", "at", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2")))
    first = keyed.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("first"), F.max(F.struct("doc", "at")).alias("last")) \
        .where("first != last").select("h1", "h2", "first")
    copies = stored(keyed.join(first, ["h1", "h2"]).where(F.struct("doc", "at") != F.col("first")).select("doc", "at").distinct())
    once = _lines_without(base, copies)

    # prefixes
    ranks = rarity_ranks(once, k, buckets)
    sets = _tokens(once, ranks, k, buckets).select("doc", "at", "tokens", F.size("tokens").alias("n"))
    prefix = F.slice("tokens", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    rows = sets.select("doc", "at", "n", F.posexplode(prefix).alias("pos", "token"))
    hot = F.shiftright("token", HASH_BITS) >= F.floor(F.log2(F.lit(hot_rows)) * 64)
    salted = rows.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("doc", "at"), F.lit(SALTS))).otherwise(F.lit(0)))
    same = Window.partitionBy("token", "salt")
    led = salted.withColumns({"lead": F.min(F.struct("doc", "at", "n", "pos")).over(same), "met": F.count(F.lit(1)).over(same)})
    shared = stored(led.where((F.col("met") > 1) | hot).select("doc", "at", "n", "pos", "token", "lead"))

    # star round, then the lines it leaves against all earlier ones
    star = shared.select("doc", "at", "n", "pos", F.col("lead.doc").alias("d"), F.col("lead.at").alias("a"),
                         F.col("lead.n").alias("m"), F.col("lead.pos").alias("qos")) \
        .where((F.struct("d", "a") < F.struct("doc", "at")) & _may_match(percent)).select("doc", "at", "d", "a").distinct()
    star = stored(star)
    gone = stored(_verified(star, base, ranks, k, buckets, percent).select("doc", "at").distinct())
    open_rows = shared.drop("lead").join(bounded(gone), ["doc", "at"], "left_anti")
    earlier = shared.select(F.col("doc").alias("d"), F.col("at").alias("a"), F.col("n").alias("m"), F.col("pos").alias("qos"), "token")
    rest = open_rows.join(earlier, "token") \
        .where((F.struct("d", "a") < F.struct("doc", "at")) & _may_match(percent)).select("doc", "at", "d", "a").distinct() \
        .join(star, ["doc", "at", "d", "a"], "left_anti")
    late = _verified(stored(rest), base, ranks, k, buckets, percent).select("doc", "at").distinct()
    return copies.union(gone).union(late)


def _per_document(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(doc, removed): line numbers in order."""
    return stored(repeated_lines(docs, id_col, text_col, **options).groupBy("doc").agg(F.sort_array(F.collect_set("at")).alias("removed")))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every row; ``removed`` lists line numbers."""
    docs = with_ids(docs, id_col)
    found = _per_document(docs, id_col, text_col, **options)
    shown = F.when(F.col(UNNAMED).isNull(), F.col("doc_id")) if UNNAMED in docs.columns else F.col("doc_id")
    n = F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))), F.lit(0)).cast("long")
    made = [UNNAMED] if UNNAMED in docs.columns else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *made) \
        .select("doc_id", *made, F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n).alias("n_lines"))
    return rows.join(found, rows["doc_id"] == found["doc"], "left").select(
        shown.alias("doc_id"), "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts; documents that lose all their words go."""
    named = with_ids(docs, id_col)
    found = _per_document(named, id_col, text_col, **options).select(F.col("doc").alias(_DOC), F.col("removed").alias(_REMOVED))
    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(_REMOVED))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col(_REMOVED).isNull(), F.col(text_col)).otherwise(let(F.split(F.col(text_col), "\n"), kept))
    joined = named.join(found, named[id_col] == found[_DOC], "left") \
        .select(*[text.alias(c) if c == text_col else named[c] for c in named.columns], _REMOVED)
    return without_made_ids(joined.where(F.col(_REMOVED).isNull() | F.col(text_col).rlike(WORD)), docs, id_col)
