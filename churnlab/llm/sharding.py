"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size:
``(offset + j * skip) mod size`` for j = 0, 1, ..., with offset and skip from
its name.  The shards take turns; at its turn a shard claims its first free
preferred slot, until the table is full.  A document's key hashes to a slot,
and a broadcast join on the slot gives the shard in constant time.  Shards own
equal shares to within one slot, and adding or removing one moves few others.

A null key is placed as the empty text; equal keys land on one shard, so
repeated rows stay together.  ``slot`` and ``shard`` replace columns of the
same names.  The table has a fixed size, whatever the number of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import key60

SIZE = 6421
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))
MAX_SIZE = 1 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str] = SHARDS, size: int = SIZE) -> list[int]:
    """The index of the owning shard for each slot."""
    if not 2 <= size <= MAX_SIZE or any(size % p == 0 for p in range(2, int(size ** 0.5) + 1)):
        raise ValueError(f"size must be a prime up to {MAX_SIZE}")
    if not 1 <= len(set(shards)) == len(shards) <= size:
        raise ValueError("shards must be distinct, at least one and at most one a slot")
    place = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while owner[place[i]] >= 0:
            place[i] = (place[i] + skip[i]) % size
        owner[place[i]] = i
    return owner


def table_frame(spark: SparkSession, shards: Sequence[str] = SHARDS, size: int = SIZE) -> DataFrame:
    """(slot, shard) rows of the lookup table."""
    owners = ",".join(map(str, lookup_table(shards, size)))
    names = F.array(*map(F.lit, shards))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner")) \
        .select(F.col("slot").cast("long").alias("slot"), F.get(names, F.col("owner").cast("int")).alias("shard"))


def place(df: DataFrame, key_col: str, shards: Sequence[str] = SHARDS, size: int = SIZE) -> DataFrame:
    """``df`` with the slot and shard of each row's key."""
    key = F.coalesce(df[key_col].cast("string"), F.lit(""))
    keyed = df.select(*[df[c] for c in df.columns if c not in ("slot", "shard")],
                      F.pmod(key60(key), F.lit(size)).alias("slot"))
    return keyed.join(F.broadcast(table_frame(df.sparkSession, shards, size)), "slot", "left")


def oracle_sql(shards: Sequence[str] = SHARDS, size: int = SIZE) -> str:
    """The same placement of ``documents`` by ``doc_id`` for DuckDB."""
    names = ", ".join(f"'{s}'" for s in shards)
    n = len(shards)
    return f"""
WITH RECURSIVE shards AS (SELECT unnest([{names}]) AS shard),
pref AS (SELECT list(('0x' || substr(md5('offset:' || shard), 1, 15))::BIGINT % {size} ORDER BY shard) AS offs,
                list(('0x' || substr(md5('skip:' || shard), 1, 15))::BIGINT % {size - 1} + 1 ORDER BY shard) AS skips
         FROM shards),
fill AS (
  SELECT 0 AS turn, -1::BIGINT AS slot, []::BIGINT[] AS taken FROM pref
  UNION ALL
  SELECT turn + 1, s, list_append(taken, s) FROM (
    SELECT turn, taken, list_filter(
      list_transform(range(0, {size}), lambda j: (offs[turn % {n} + 1] + j * skips[turn % {n} + 1]) % {size}),
      lambda s: NOT list_contains(taken, s))[1] AS s
    FROM fill, pref WHERE turn < {size})
),
owners AS (SELECT slot, ([{names}])[(turn - 1) % {n} + 1] AS shard FROM fill WHERE turn > 0)
SELECT d.doc_id, d.slot, o.shard FROM (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {size} AS slot FROM documents) d
JOIN owners o USING (slot)"""
