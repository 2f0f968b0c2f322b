"""Source registry, option parsing, and the cache of built sources.

A source is a function (spark, **options) -> DataFrame (lang, text, _pos). ``_pos``
orders the rows of a source; for files it follows their order.
"""

from __future__ import annotations

import ast
import contextlib
import hashlib
import inspect
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        SOURCES[name] = f
        return f

    return add


def coerce(value: str):
    """A Python literal if it is one, else the text itself."""
    with contextlib.suppress(ValueError, SyntaxError):
        return ast.literal_eval(value)
    return value


def parse_spec(spec: str) -> tuple[str, dict]:
    """'name:k=v,k=v' -> (name, options)."""
    name, _, rest = spec.partition(":")
    options = {}
    for part in filter(None, rest.split(",")):
        k, eq, v = part.partition("=")
        if not eq:
            raise ValueError(f"{part!r} in {spec!r} is no option")
        options[k.strip()] = coerce(v.strip())
    return name.strip(), options


def create(spark: SparkSession, name: str, options: dict) -> DataFrame:
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(sorted(SOURCES))}")
    known = inspect.signature(SOURCES[name]).parameters
    wrong = set(options) - set(known)
    if wrong:
        raise ValueError(f"{name} has no option {', '.join(sorted(wrong))}")
    return SOURCES[name](spark, **options)


def full_options(name: str, options: dict) -> dict:
    """With the defaults of those that aren't given."""
    p = inspect.signature(SOURCES[name]).parameters
    return {k: v.default for k, v in p.items() if k != "spark" and v.default is not inspect.Parameter.empty} | options


def slug(name: str, options: dict) -> str:
    raw = json.dumps(full_options(name, options), sort_keys=True, default=str)
    return f"{name}-{hashlib.sha1(raw.encode()).hexdigest()[:10]}"


def _file(spark: SparkSession, path: str):
    """A file's system and address, wherever it is: on this machine or shared."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cached(spark: SparkSession, spec: str, cache_dir: str) -> DataFrame:
    """The source of ``spec``, from its cache or written through to it. The options
    beside the data are written last: without them, or with others, it is built again."""
    name, options = parse_spec(spec)
    at = f"{cache_dir.rstrip('/')}/{slug(name, options)}"
    fs, side = _file(spark, at + ".options.json")
    want = json.loads(json.dumps(full_options(name, options), default=str))
    if fs.exists(side):
        stream = fs.open(side)
        have = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if json.loads(have) == want:
            return spark.read.parquet(at)
        fs.delete(side, False)
    create(spark, name, options).write.mode("overwrite").parquet(at)
    out = fs.create(side, True)
    out.write(bytearray(json.dumps(want).encode()))
    out.close()
    return spark.read.parquet(at)


#: Bits of ``_pos`` for the place in a file; those above number the files by path.
_PLACE_BITS = 43


def plain_path(path: str) -> str:
    """One spelling of a file's address, as readers differ in theirs."""
    return re.sub(r"^(\w+):/*", r"\1:/", unquote(path))


def positioned(df: DataFrame) -> DataFrame:
    """With ``_pos``, in the order of files by path and of rows within them, however the scan is
    cut and packed into tasks: the first byte of a row's split and its number in it (for Parquet its
    number in the file). ``df`` reads files; of other tables the rows are numbered as they come."""
    files = sorted(map(plain_path, df.inputFiles()))
    if not files or "_metadata" in df.columns:
        return df.withColumn("_pos", F.monotonically_increasing_id())
    sent = df.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(files)})

    @F.arrow_udf("bigint")
    def place(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, n = None, 0
        for paths, starts in parts:
            keys = list(zip(paths.to_pylist(), starts.to_pylist()))
            out = np.empty(len(keys), np.int64)
            for i, key in enumerate(keys):
                n = n + 1 if key == last else 0
                last = key
                out[i] = (sent.value[plain_path(key[0])] << _PLACE_BITS) + key[1] + n
            yield pa.array(out)

    @F.arrow_udf("bigint")
    def number(paths: pa.Array, rows: pa.Array) -> pa.Array:
        file = np.array([sent.value[plain_path(f)] for f in paths.to_pylist()], np.int64)
        return pa.array((file << _PLACE_BITS) + rows.to_numpy(zero_copy_only=False))

    m = F.col("_metadata")
    try:
        return df.withColumn("_pos", number(m["file_path"], m["row_index"]))
    except AnalysisException:  # rows of text, CSV and JSON have no number in their file
        return df.withColumn("_pos", place(m["file_path"], m["file_block_start"]))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by ``_pos``, which then counts from 0."""
    return df.orderBy("_pos").limit(n).withColumn("_pos", (F.row_number().over(Window.orderBy("_pos")) - 1).cast("bigint"))
