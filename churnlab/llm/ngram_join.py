"""N-gram Jaccard join by a token-group matrix.

Documents are sets of 5-word shingles.  Two documents link when their Jaccard
similarity is at least ``percent`` / 100.  The steps:

1. A sketch of fixed size counts all documents' shingles; it only orders
   shingles (rarest first, then by hash), so its size affects speed, not rows.
2. Equal sets become one class.  Classes that share a band of min-hashes are
   compared with the band's most central member (the one whose shingles are the
   most common), and the links found make the **groups**.
3. The **matrix** holds (shingle, group) for the union of the groups' shingles,
   restricted to each member's prefix: the ``n - ceil(t n) + 1`` rarest shingles.
4. Every document probes the matrix with its own prefix.  The number of shared
   shingles bounds its overlap with any member of a group: at most that number
   plus the longer of the two rests.  Groups that cannot reach the overlap that
   the similarity needs stay closed.
5. Qualifying groups are **opened**: first their central member is compared,
   then, where that does not already join the two groups, every member.

Step 3 to 5 find every link between different groups whatever step 2 missed,
since two linked sets always share a prefix shingle.  A group of copies costs
one row per copy and shingle; pairs inside a group are never made.

Null texts and texts without words have no shingles and link with nothing.  A
row repeated whole keeps all its rows, with one result; ids are otherwise
unique.  A row with a null id takes the component of a document with the same
set, or null.  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import bounded, stored, without_rows
from .words import mix, shingle_sets

PERCENT = 75
SHINGLE = 5
SKETCH_BITS = 18
BANDS, BAND_ROWS = 6, 2
#: Shingles of the documents that are compared as one pack when a group is opened.
PACK = 100_000
_U = np.uint64
_PERM = (mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=_U) + _U(977)) | _U(1))
_SHIFT = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=_U) + _U(31337))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def rarity_sketch(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE,
                  bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of distinct (document, shingle) pairs over 2**bits hash buckets, over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                np.add.at(total, (s >> _U(64 - bits)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def prefix_size(n, percent: int = PERCENT):
    """Shingles of a set of ``n`` that must meet any linked set: n - ceil(t n) + 1."""
    return n - (n * percent + 99) // 100 + 1


def _signatures(docs: DataFrame, k: int, sketch) -> DataFrame:
    """doc_id, n, two set hashes, min-hash bands, and how common the shingles are on average."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        shift = _U(64 - int(np.log2(len(counts))))
        for batch in batches:
            n, one, two, common, bands, sizes = [], [], [], [], [], []
            with np.errstate(over="ignore"):
                for _, s in shingle_sets(batch.column(1), k):
                    n.append(len(s))
                    one.append(s.sum(dtype=_U))
                    two.append(mix(s).sum(dtype=_U))
                    if not len(s):
                        common.append(0.0)
                        sizes.append(0)
                        continue
                    common.append(float(counts[(s >> shift).astype(np.int64)].mean()))
                    low = np.array([(s * p + q).min() for p, q in zip(_PERM, _SHIFT, strict=True)], dtype=_U)
                    key = low.reshape(BANDS, BAND_ROWS)
                    total = mix(np.arange(BANDS, dtype=_U))
                    for j in range(BAND_ROWS):
                        total = mix(total ^ key[:, j])
                    bands.append(total)
                    sizes.append(BANDS)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            flat = np.concatenate(bands) if bands else np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int32()), pa.array(_signed(np.array(one, _U))),
                pa.array(_signed(np.array(two, _U))), pa.array(common, pa.float64()),
                pa.ListArray.from_arrays(offsets, pa.array(_signed(flat)))],
                names=["doc_id", "n", "one", "two", "common", "bands"])

    return docs.mapInArrow(run, "doc_id long, n int, one long, two long, common double, bands array<long>")


def _prefix_rows(docs: DataFrame, k: int, percent: int, sketch) -> DataFrame:
    """(token, doc_id, grp, n) for the prefix of every document of ``docs`` (doc_id, text, grp)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        shift = _U(64 - int(np.log2(len(counts))))
        for batch in batches:
            ids, groups = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            kept, rows, n, made = [], [], [], 0
            def out():
                size = np.array([len(x) for x in kept])
                token = np.concatenate(kept)
                at = np.array(rows)
                return pa.RecordBatch.from_arrays([
                    pa.array(_signed(token)), pa.array(np.repeat(ids[at], size)),
                    pa.array(np.repeat(groups[at], size)), pa.array(np.repeat(np.array(n, np.int32), size))],
                    names=["token", "doc_id", "grp", "n"])
            for i, s in shingle_sets(batch.column(1), k):
                if len(s):
                    order = np.argsort(counts[(s >> shift).astype(np.int64)], kind="stable")
                    kept.append(s[order[:prefix_size(len(s), percent)]])
                    rows.append(i)
                    n.append(len(s))
                    made += len(kept[-1])
                    if made > 100_000:
                        yield out()
                        kept, rows, n, made = [], [], [], 0
            if kept:
                yield out()

    return docs.select("doc_id", "text", "grp").mapInArrow(run, "token long, doc_id long, grp long, n int")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the listed documents only, so that no other text is shuffled."""
    return docs.select("doc_id", "text").join(bounded(stored(ids.distinct())), "doc_id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of document ids whose whole shingle sets reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = shingle_sets(batch.column(2), k)
            right = shingle_sets(batch.column(3), k)
            keep = []
            for (_, x), (_, y) in zip(left, right, strict=True):
                both = len(x) + len(y)
                lower, upper = sorted((len(x), len(y)))
                if not lower or 100 * lower < percent * upper:
                    keep.append(False)
                    continue
                z = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((z[1:] == z[:-1]).sum())
                keep.append(100 * shared >= percent * (both - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]) \
                .filter(pa.array(keep, pa.bool_()))

    texts = _texts_of(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    full = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(run, "a long, b long")


def _packs(members: DataFrame, sizes: DataFrame, docs: DataFrame, shingles: int) -> DataFrame:
    """(other, sets): the members' texts in packs of about ``shingles`` shingles."""
    sized = members.join(sizes, "doc_id")
    total = sized.groupBy("other").agg(F.ceil(F.sum("n") / shingles).alias("packs"))
    pack = F.pmod(F.xxhash64("doc_id"), F.col("packs")).alias("pack")
    return sized.join(total, "other").select("other", pack, "doc_id") \
        .join(_texts_of(docs, members.select("doc_id")), "doc_id") \
        .groupBy("other", "pack").agg(F.collect_list(F.struct("doc_id", "text")).alias("sets")).select("other", "sets")


def _opened(asking: DataFrame, members: DataFrame, sizes: DataFrame, docs: DataFrame, k: int, percent: int,
            shingles: int = PACK) -> DataFrame:
    """Links (a, b) of the ``asking`` documents (other, doc_id) with ``members`` of the groups they ask.

    Both sides meet in packs; a document's first link into a pack is enough, as
    all members of a group are joined already.
    """
    asked = members.join(asking.select("other").distinct(), "other", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for i in range(batch.num_rows):
                (left_ids, left), (right_ids, right) = (_pack_sets(batch.column(c)[i].values, k) for c in (0, 1))
                size = np.array([len(x) for x in right])
                every, owner = np.concatenate(right), np.repeat(np.arange(len(right)), size)
                order = np.argsort(every, kind="stable")
                every, owner = every[order], owner[order]
                for a, own in zip(left_ids, left, strict=True):
                    low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
                    hits = np.flatnonzero(high > low)
                    if not len(hits):
                        continue
                    width = high[hits] - low[hits]
                    at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low[hits], width)
                    shared = np.bincount(owner[at], minlength=len(right))
                    linked = np.flatnonzero((100 * shared >= percent * (len(own) + size - shared)) & (right_ids != a))
                    if len(linked):
                        links.append((int(a), int(right_ids[linked[0]])))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], names=["a", "b"])

    left = _packs(asking, sizes, docs, shingles).withColumnRenamed("sets", "asking")
    met = left.join(_packs(asked, sizes, docs, shingles), "other").select("asking", "sets")
    return met.mapInArrow(run, "a long, b long")


def _pack_sets(rows: pa.StructArray, k: int):
    return rows.field(0).to_numpy(zero_copy_only=False), [s for _, s in shingle_sets(rows.field(1), k)]


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                     percent: int = PERCENT, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row.

    ``class_id`` is the smallest id with the same set, ``component_id`` the
    smallest id reachable by links (its own where it has none).
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = spark.sparkContext.broadcast(rarity_sketch(base, "doc_id", "text", k, sketch_bits))
    signed = stored(_signatures(base, k, sketch))

    # classes of equal sets
    alike = signed.where("n > 0 and doc_id is not null").groupBy("one", "two", "n") \
        .agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    several = alike.where("copies > 1").select("one", "two", "n", "class_id")
    member = stored(signed.drop("bands").join(several, ["one", "two", "n"], "left")
                    .select("doc_id", "n", "common", F.coalesce("class_id", "doc_id").alias("class_id")))
    copies = stored(member.where("class_id != doc_id").select("doc_id").distinct())
    reps = base.where("doc_id is not null").join(bounded(copies), "doc_id", "left_anti")

    # groups: links with the most central member of each band
    banded = signed.where("doc_id is not null").join(bounded(copies), "doc_id", "left_anti") \
        .select("doc_id", "common", F.posexplode("bands").alias("band", "bucket"))
    centre = banded.groupBy("band", "bucket") \
        .agg(F.max(F.struct("common", (-F.col("doc_id")).alias("id"))).alias("top"), F.count(F.lit(1)).alias("c")) \
        .where("c > 1").select("band", "bucket", (-F.col("top.id")).alias("b"))
    star = stored(banded.join(centre, ["band", "bucket"]).select(F.col("doc_id").alias("a"), "b")
                  .where("a != b").distinct())
    links = stored(verified(star, reps, k, percent))
    grouped = components(links)
    sizes = member.where("class_id = doc_id").select("doc_id", "n", "common")
    groups = stored(sizes.join(grouped.withColumnRenamed("id", "doc_id"), "doc_id"))
    shapes = stored(groups.groupBy(F.col("component").alias("grp")).agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"),
        (-F.max(F.struct("common", (-F.col("doc_id")).alias("id")))["id"]).alias("centre")))

    # the matrix, probed by every class
    tagged = reps.join(bounded(groups.select("doc_id", F.col("component").alias("grp"))), "doc_id", "left") \
        .select("doc_id", "text", F.coalesce("grp", "doc_id").alias("grp"))
    probes = _prefix_rows(tagged, k, percent, sketch)
    matrix = probes.groupBy("token", "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi")) \
        .withColumnRenamed("grp", "other")
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    met = probes.join(matrix, "token").where(
        (F.col("grp") != F.col("other")) & (100 * n >= percent * lo) & (100 * hi >= percent * n)) \
        .groupBy("doc_id", "grp", "other", "n").agg(
            F.count(F.lit(1)).alias("shared"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # members can be as small as t n and as large as n / t; the bound is lowest at an end of the range
    low = F.greatest(lo.cast("long"), F.ceil(n * percent / 100))
    high = F.least(hi.cast("long"), F.floor(n * 100 / percent))
    def needed(m):
        rest = F.greatest(n - F.expr(_prefix_sql("n", percent)), m - _prefix(m, percent))
        return F.ceil((n + m) * percent / (100 + percent)) - rest
    opened = stored(met.where(F.col("shared") >= F.least(needed(low), needed(high)))
                    .select("doc_id", "grp", "other"))

    # opening: the central member first, then all members where that leaves two groups apart
    asked = opened.join(bounded(shapes.select(F.col("grp").alias("other"), "centre")), "other", "left") \
        .select(F.col("doc_id").alias("a"), F.coalesce("centre", "other").alias("b"))
    ordered = asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(links.union(verified(stored(ordered), reps, k, percent)))
    joined = components(links)
    labels = bounded(joined)
    mine, its = labels.select(F.col("id").alias("doc_id"), F.col("component").alias("c1")), \
        labels.select(F.col("id").alias("other"), F.col("component").alias("c2"))
    apart = opened.join(mine, "doc_id", "left").join(its, "other", "left") \
        .where(F.coalesce("c1", "doc_id") != F.coalesce("c2", "other")) \
        .join(shapes.select(F.col("grp").alias("other"), "centre"), "other")
    found = stored(_opened(apart.select("other", "doc_id"), groups.select(F.col("component").alias("other"), "doc_id"),
                           sizes.select("doc_id", "n"), reps, k, percent))
    if found.limit(1).count():
        joined = components(links.union(found))

    final = joined.withColumnRenamed("id", "class_id")
    return member.join(final, "class_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component", "class_id").alias("component_id"), "class_id")


def _prefix(m, percent: int):
    return m - F.ceil(m * percent / 100) + 1


def _prefix_sql(name: str, percent: int) -> str:
    return f"{name} - ceil({name} * {percent} / 100) + 1"


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose component holds a smaller id; rows without an id come after all others."""
    return without_rows(docs, id_col, lambda named: ngram_components(named, id_col, text_col).where("component_id < doc_id"))
