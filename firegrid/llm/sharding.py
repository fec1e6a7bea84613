"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in blocks (by hash). One draw of exact block-to-shard counts fixes how many rows each block sends to each
shard; each block permutes its rows and deals them out by these counts; each shard permutes what it got.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows that one block or one part of a shard has about.
BLOCK_ROWS = 200_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    total = good + bad
    mean, sd = n * good / total, math.sqrt(max(1.0, n * good / total * bad / total * (total - n) / max(1, total - 1)))
    low, high = max(0, n - bad, int(mean - 14 * sd)), min(n, good, int(mean + 14 * sd) + 1)
    k = np.arange(low, high, dtype=np.float64)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(step)))
    p = np.exp(logs - logs.max())
    return low + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), "right").clip(0, len(p) - 1))


def communication_matrix(counts: list[int], targets: list[int], seed: int) -> np.ndarray:
    """Rows block p sends to shard s, drawn as a uniform shuffle would: row sums are counts, column sums targets."""
    rng, left = np.random.default_rng(seed), list(targets)
    out = np.zeros((len(counts), len(targets)), np.int64)
    for p, n in enumerate(counts):
        rest, pool = n, sum(left)
        for s, have in enumerate(left):
            pool -= have
            out[p, s] = got = _hypergeometric(rng, have, pool, rest)
            left[s] -= got
            rest -= got
    return out


def shard_rows(rows: DataFrame, keys: list[str], n_shards: int = 24, seed: int = 11) -> DataFrame:
    """rows with `shard` (0 to n_shards-1; sizes at most one apart) and `slot` (gapless from 0 within the shard).

    keys: columns that tell rows apart; equal rows are interchangeable, nulls count as values. An empty table gives an
    empty result. What goes to the driver and back is one count for each block and shard.
    """
    spark, n = rows.sparkSession, rows.count()
    blocks = max(64, n // BLOCK_ROWS + 1)
    parts = max(8, n // n_shards // BLOCK_ROWS + 1)
    base = stored(rows.withColumns({"_h": F.xxhash64(F.lit(seed), *keys), "_g": F.xxhash64(F.lit(seed + 1), *keys)}).withColumn("_block", F.pmod(F.col("_h"), F.lit(blocks)).cast("int")), "shard-rows")
    counts = {r["_block"]: r["n"] for r in base.groupBy("_block").agg(F.count("*").alias("n")).collect()}
    order = sorted(counts)
    matrix = communication_matrix([counts[b] for b in order], [n // n_shards + (s < n % n_shards) for s in range(n_shards)], seed)
    deal = spark.createDataFrame([(b, [int(x) for x in np.cumsum(m)]) for b, m in zip(order, matrix, strict=True)], "_block int, _ends array<long>")
    local = Window.partitionBy("_block").orderBy("_h", *keys)
    dealt = (
        base.withColumn("_rank", F.row_number().over(local) - 1)
        .join(F.broadcast(deal), "_block")  # at most rows / BLOCK_ROWS lists of n_shards numbers
        .withColumn("shard", F.expr("size(filter(_ends, x -> x <= _rank))").cast("int"))
        .withColumn("_part", F.pmod(F.shiftrightunsigned("_g", 1), F.lit(parts)).cast("int"))
        .drop("_block", "_ends", "_rank", "_h")
    )
    dealt = stored(dealt, "shard-dealt")
    sizes = dealt.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    offsets = sizes.select("shard", "_part", (F.sum("n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("n")).alias("_from"))
    again = Window.partitionBy("shard", "_part").orderBy("_g", *keys)
    return (
        dealt.withColumn("_at", F.row_number().over(again) - 1)
        .join(offsets, ["shard", "_part"])
        .withColumn("slot", F.col("_from") + F.col("_at"))
        .drop("_part", "_g", "_at", "_from")
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: int = 11) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, law `rows`, shard, slot and grown_shard (null under this law).

    Null texts have size 8 and the checksum of the empty text. Repeated rows and ties are dealt like any rows.
    """
    base = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32")
    )
    out = shard_rows(base, ["doc_id", "text_crc32", "size"], n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
