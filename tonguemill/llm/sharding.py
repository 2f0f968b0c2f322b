"""Uniform shuffle into shards of exact size, by a hypergeometric communication
matrix.

Entry (p, j) of the matrix says how many rows of input block p go to shard j.
Its rows are drawn jointly multivariate-hypergeometric, which is how a uniformly
random permutation of all rows would split them; column sums are the shard sizes.
No task needs the whole matrix: the blocks are the leaves of a binary tree
whose nodes split the remaining shard capacities by a draw seeded with the node,
so every task finds the same splits and walks only to its own rows. It keeps the nodes on its way,
so the way from the root, O(shards * log(blocks)), is walked once a task and not once a block. Within a block the row's
counts are dealt in random order (local permutation), rows move once (exchange),
and each shard is ordered by a random key (second permutation).

A block is :data:`BLOCK` neighbouring rows of a Parquet file, told by the file's path and
the rows' numbers in it. That doesn't depend on how a job cuts files into partitions, so executors may be
lost or regained between counting and dealing. The only thing sent to the tasks is the row
count of each file. Input that isn't a plain scan of Parquet files is first written to the shared folder.

Nulls and odd input: rows are dealt whatever they hold: nulls, empty and very long texts, and equal
rows one by one; ties of the random key within a shard go by no fixed rule; an
empty table gives no rows; input columns pass, those named ``shard`` or ``pos`` too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import fresh, quoted, session_of, table, written

ROWS_PER_SHARD = 4096
SEED = 20260105
BLOCK, DEAL = 1 << 16, 1 << 20
_BIG = 900_000_000  # numpy's generator takes populations up to 10**9


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric draw, for populations of any size.

    Beyond numpy's range: ratio of uniforms about the mode (Stadlober 1989),
    with log-factorials from ``lgamma``.
    """
    if good == 0 or n == 0:
        return 0
    if bad == 0:
        return n
    if good + bad <= _BIG:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if high - low == 0:
        return low
    mean = n * good / total
    var = mean * (bad / total) * (total - n) / max(1, total - 1)
    lf = lambda x: math.lgamma(x + 1)
    log_p = lambda k: -(lf(k) + lf(good - k) + lf(n - k) + lf(bad - n + k))
    mode = min(max(int((n + 1) * (good + 1) / (total + 2)), low), high)
    top = log_p(mode)
    width = 1.7155277699214135 * math.sqrt(var + 0.5) + 0.8989161620588988
    while True:
        u, v = rng.random(), rng.random()
        if u == 0.0:
            continue
        x = mean + 0.5 + width * (v - 0.5) / u
        k = math.floor(x)
        if low <= k <= high and 2 * math.log(u) <= log_p(k) - top:
            return k


def split(rng: np.random.Generator, capacity: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric: how ``n`` draws fall on the capacities. Beyond numpy's
    range, halves of the capacities are drawn until they are within it."""
    total = int(capacity.sum())
    if total <= _BIG:
        return rng.multivariate_hypergeometric(capacity, n, method="marginals")
    if len(capacity) == 1:
        return np.array([n], capacity.dtype)
    middle = len(capacity) // 2
    good = int(capacity[:middle].sum())
    left = _draw(rng, good, total - good, n)
    return np.concatenate([split(rng, capacity[:middle], left), split(rng, capacity[middle:], n - left)])


def capacities(rows: int, shards: int) -> np.ndarray:
    return rows // shards + (np.arange(shards) < rows % shards).astype(np.int64)


class Matrix:
    """Rows of the communication matrix. A node of at most :data:`DEAL` rows deals its blocks
    at once, by a permutation of its columns, which is the same draw. The nodes of the last walk are
    kept, without their empty columns, so neighbouring blocks share their way."""

    def __init__(self, counts: np.ndarray, shards: int, seed: int):
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.shards, self.seed = shards, seed
        self.way: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        self.dealt: tuple[int, int, np.ndarray] = (0, 0, np.zeros(0, np.int32))

    def _random(self, *node: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(np.random.SeedSequence([self.seed, *node])))

    def labels(self, p: int) -> np.ndarray:
        """The shard of each row of block ``p``: its row of the matrix, in random order."""
        if not self.dealt[0] <= p < self.dealt[1]:
            while self.way and not self.way[-1][0] <= p < self.way[-1][1]:
                self.way.pop()
            if not self.way:
                self.way.append((0, len(self.before) - 1, np.arange(self.shards, dtype=np.int32), capacities(int(self.before[-1]), self.shards)))
            while True:
                left, right, at, have = self.way[-1]
                if right - left == 1 or self.before[right] - self.before[left] <= DEAL:
                    break
                mid = (left + right) // 2
                part = split(self._random(left, right), have, int(self.before[mid] - self.before[left]))
                left, right, part = (left, mid, part) if p < mid else (mid, right, have - part)
                on = part > 0
                self.way.append((left, right, at[on], part[on]))
            self.dealt = (left, right, self._random(left, right, 1).permutation(np.repeat(at, have)))
        begin = self.before[self.dealt[0]]
        return self.dealt[2][self.before[p] - begin : self.before[p + 1] - begin]


def matrix_row(counts: np.ndarray, shards: int, p: int, seed: int) -> np.ndarray:
    """Row ``p`` of the communication matrix."""
    return np.bincount(Matrix(counts, shards, seed).labels(p), minlength=shards)


def _plain_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is a scan of Parquet files that leaves no row out."""
    node = docs._jdf.queryExecution().optimizedPlan()
    while node.nodeName() == "Project":
        node = node.child()
    plain = node.nodeName() == "LogicalRelation" and "_metadata" not in docs.columns
    return plain and "FileScan parquet" in docs._jdf.queryExecution().executedPlan().toString()


def uniform_shards(docs: DataFrame, rows_per_shard: int = ROWS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` and ``pos`` (place in the shard, from 0) as its last columns. All
    shards hold the same number of rows, up to one. Where docs has a column of such a name
    it keeps it, and the new one's name ends in ``_``."""
    spark = session_of(docs)
    if not _plain_scan(docs):
        docs = written(docs, "shard-input")
    found = sorted((r.f, r.n) for r in docs.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect())
    counts = np.array([min(BLOCK, n - i) for _, n in found for i in range(0, n, BLOCK)], np.int64)
    first = dict(zip((f for f, _ in found), np.cumsum([0, *(-(-n // BLOCK) for _, n in found)]).tolist()))
    rows = int(counts.sum())
    shards = max(1, -(-rows // rows_per_shard))
    sent = spark.sparkContext.broadcast((counts, first))

    @F.pandas_udf("struct<shard int, key bigint>")
    def deal(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        counts, first = sent.value
        have: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        matrix = Matrix(counts, shards, seed)

        def dealt(p: int) -> tuple[np.ndarray, np.ndarray]:
            if p not in have:
                if len(have) > 3:
                    have.clear()
                rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, 1 << 40, p])))
                have[p] = matrix.labels(p), rng.integers(0, 1 << 62, counts[p])
            return have[p]

        for path, number in parts:
            at = number.to_numpy()
            which = path.map(first).to_numpy(np.int64) + at // BLOCK
            shard, key = np.empty(len(at), np.int32), np.empty(len(at), np.int64)
            for p in np.unique(which):
                mine = which == p
                labels, keys = dealt(int(p))
                shard[mine], key[mine] = labels[at[mine] % BLOCK], keys[at[mine] % BLOCK]
            yield pd.DataFrame({"shard": shard, "key": key})

    columns = docs.columns
    label, place = fresh(columns, "shard", "pos")
    drawn, key = fresh([*columns, label, place], "__tm_deal", "__tm_key")
    dealt = docs.withColumn(drawn, deal(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    dealt = dealt.select(*quoted(columns), F.col(drawn)["shard"].alias(label), F.col(drawn)["key"].alias(key))
    order = Window.partitionBy(label).orderBy(key)
    return dealt.select(*quoted([*columns, label]), (F.row_number().over(order) - 1).alias(place))


def query(spark, sf_dir: str) -> DataFrame:
    return uniform_shards(table(spark, sf_dir, "documents"))
