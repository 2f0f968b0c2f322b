"""Building the labeled dataset: ordered dedup, splits, caps, augmentation.

Rows are (lang, text, _src, _pos): order has a meaning here and is kept in columns,
so that results don't depend on partitioning. Random picks go by a hash of the content.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import augment as au
from ..functions import text as tx

SHORT = 19


def stamp(sources: list[DataFrame]) -> DataFrame:
    """All sources in one table; ``_src`` is the place in the list. ``_pos`` must tell
    the rows of a source apart and order them."""
    return reduce(DataFrame.unionByName, [s.select("lang", "text", F.lit(i).alias("_src"), "_pos") for i, s in enumerate(sources)])


def dedup_first(rows: DataFrame) -> DataFrame:
    """One row of each (lang, text), the first by (_src, _pos). Aggregates before the
    shuffle, so repeated rows don't travel."""
    return rows.groupBy("lang", "text").agg(F.min(F.struct("_src", "_pos")).alias("o")).select("lang", "text", "o._src", "o._pos")


def unique_counts(deduped: DataFrame) -> DataFrame:
    """New rows that each source brought."""
    return deduped.groupBy("_src").agg(F.count(F.lit(1)).alias("n"))


def with_split(rows: DataFrame) -> DataFrame:
    return rows.withColumn("split", tx.crc32_split("lang", "text"))


def order_key(seed: int, *cols: str) -> Column:
    """A pseudo-random order by content that any engine can repeat."""
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[F.col(c) for c in cols]))


def cap(rows: DataFrame, n: int, seed: int = 42, by: tuple[str, ...] = ("split", "lang")) -> DataFrame:
    """At most ``n`` rows of each group, picked by hash. Ranks within hash slices first,
    so that a hot group is not sorted in one place."""
    r = rows.withColumn("__k", order_key(seed, "lang", "text"))
    sliced = Window.partitionBy(*by, F.substring("__k", 1, 2)).orderBy("__k", *[c for c in ("lang", "text") if c in rows.columns])
    r = r.withColumn("__r", F.row_number().over(sliced)).where(F.col("__r") <= n)
    whole = Window.partitionBy(*by).orderBy("__k", "lang", "text")
    return r.withColumn("__r", F.row_number().over(whole)).where(F.col("__r") <= n).drop("__k", "__r")


def cap_stratified(rows: DataFrame, n: int, short_floor: float, seed: int = 42, by: tuple[str, ...] = ("split", "lang")) -> DataFrame:
    """At most ``n`` rows of each group with a share of short ones (up to 19 characters).

    Short rows get min(their number, int(n * short_floor)) places, long ones the
    rest, and short ones what long ones leave. Groups within the cap stay whole.
    """
    if short_floor <= 0:
        return cap(rows, n, seed, by)
    # one pass: tasks keep the first n of each group and count all, so what is ranked is small
    key = [F.col(f"`{c}`").alias(f"__by{i}") for i, c in enumerate(by)]
    r = rows.select(*key, (F.length("text") <= SHORT).alias("__short"), order_key(seed, "lang", "text").alias("__k"), F.col("lang").alias("__lang"), F.col("text").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"))
    r = r.withColumn("__n", F.lit(None).cast("bigint"))
    first = r.mapInArrow(_first_of_groups(len(by), n), T.StructType([T.StructField(f.name, f.dataType) for f in r.schema]))
    same = [f"__by{i}" for i in range(len(by))]
    total, strata = Window.partitionBy(*same), Window.partitionBy(*same, "__short")
    first = first.withColumns({"__s": F.sum(F.when(F.col("__short"), F.col("__n"))).over(total), "__l": F.sum(F.when(~F.col("__short"), F.col("__n"))).over(total)}).fillna(0, ["__s", "__l"]).where("__k is not null")
    first = first.withColumn("__r", F.row_number().over(strata.orderBy("__k", "__lang", "__text")))
    want = F.least(F.col("__s"), F.lit(int(n * short_floor)))
    places = F.when(F.col("__short"), want + F.greatest(F.lit(0), F.lit(n) - want - F.col("__l"))).otherwise(F.least(F.lit(n) - want, F.col("__l")))
    return first.where((F.col("__s") + F.col("__l") <= n) | (F.col("__r") <= places)).select("__row.*")


def _first_of_groups(n_by: int, n: int):
    """mapInArrow over (by..., short, k, lang, text, row, n): the ``n`` first rows of each group by k, lang and text, and
    a row with the number of all of them, where k is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, list] = {}  # number of rows, the greatest key that counts, rows

        def cut(g: list) -> None:
            t = pa.Table.from_batches(g[2])
            t = t.take(pc.sort_indices(t.select(["__k", "__lang", "__text"]), [(c, "ascending") for c in ("__k", "__lang", "__text")])[:n])
            g[2] = t.combine_chunks().to_batches()
            if t.num_rows == n:
                g[1] = t["__k"][n - 1].as_py()

        schema = None
        for b in batches:
            schema = b.schema
            code, names = np.zeros(b.num_rows, np.int64), [()]
            for i in range(n_by + 1):
                d = b.column(i).dictionary_encode()
                values = [*d.dictionary.to_pylist(), None]
                code = code * len(values) + pc.fill_null(d.indices, len(values) - 1).to_numpy(zero_copy_only=False)
                names = [(*x, v) for x in names for v in values]
            for c in np.unique(code).tolist():
                g = groups.setdefault(names[c], [0, None, []])
                mine = b.filter(pa.array(code == c))
                g[0] += mine.num_rows
                if g[1] is not None:
                    mine = mine.filter(pc.less_equal(mine.column("__k"), g[1]))
                if mine.num_rows:
                    g[2].append(mine)
                    if sum(x.num_rows for x in g[2]) > 4 * n + 10_000:
                        cut(g)
        for name, g in groups.items():
            cut(g)
            yield from g[2]
            columns = [pa.array([v], f.type) for v, f in zip(name, schema)] + [pa.nulls(1, f.type) for f in list(schema)[n_by + 1 : -1]] + [pa.array([g[0]], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def balanced_sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each language."""
    return cap(rows, n, seed, ("lang",))


def shuffled(rows: DataFrame, seed: int = 42) -> DataFrame:
    """All rows in a pseudo-random order."""
    return rows.orderBy(order_key(seed, "lang", "text"), "lang", "text")


def augmented(rows: DataFrame, wild: float, short: float, seed: int = 42) -> DataFrame:
    """``rows`` (lang, text, split, _src, _pos) with noised and shortened copies in the
    split of their original; never in test, and never equal to a row there is.
    Of equal copies the first by split, place and kind stays."""

    @F.arrow_udf("array<struct<kind int, text string>>")
    def copies(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))
        for langs, texts in parts:
            out = []
            for lang, t in zip(langs.to_pylist(), texts.to_pylist()):
                new = []
                rng = au.stream(seed, "w", lang, t)
                if rng.random() < wild:
                    new.append({"kind": 0, "text": au.wildify(t, rng)})
                rng = au.stream(seed, "s", lang, t)
                if rng.random() < short and (x := au.shorten(t, rng)) is not None:
                    new.append({"kind": 1, "text": x})
                out.append(new)
            yield pa.array(out, kind)

    base = rows.select("lang", "text", "split", "_src", "_pos")
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    made = base.where("split <> 'test'").select("lang", "split", "_src", "_pos", F.explode(copies(F.col("lang"), F.col("text"))).alias("c")).select("lang", F.col("c.text").alias("text"), "split", "_src", "_pos", F.col("c.kind").alias("kind"))
    made = made.groupBy("lang", "text").agg(F.min(F.struct(rank.alias("r"), F.col("_src"), F.col("_pos"), F.col("kind"), F.col("split"))).alias("o")).select("lang", "text", "o.split", "o._src", "o._pos", "o.kind")
    made = made.join(base.select("lang", "text"), ["lang", "text"], "left_anti")
    return base.withColumn("kind", F.lit(-1)).unionByName(made)


def exclude(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without those whose key stands in ``other``."""
    return rows.join(other.select(*on).distinct(), on, "left_anti")


def build(sources: list[DataFrame], cap_per_lang: int | None = None, wild: float = 0.0, short: float = 0.0, short_floor: float = 0.0, seed: int = 42) -> DataFrame:
    """The whole mix: (lang, text, split) from stamped sources."""
    rows = with_split(dedup_first(stamp(sources)))
    if wild or short:
        rows = augmented(rows, wild, short, seed)
    if cap_per_lang:
        rows = cap_stratified(rows, cap_per_lang, short_floor, seed)
    return rows.select("lang", "text", "split")
