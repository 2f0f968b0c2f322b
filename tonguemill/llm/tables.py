"""Reading the input tables; the shared folder for cut lineage is in :mod:`operators.stored`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import ready, session_of, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one or two numbers that may be broadcast: about 60 MB as a hash table.
SENT_KEYS = 2_000_000


def sent_if_small(keys: DataFrame) -> DataFrame:
    """``keys``, a written table of narrow rows, marked for broadcast if it has at most
    :data:`SENT_KEYS` rows; beyond that the join shuffles."""
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """``wanted`` as names that aren't among ``columns``, whatever the case of letters: each
    with as many ``_`` at its end as that takes."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(names: list[str]) -> list:
    """Columns by their exact names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]
