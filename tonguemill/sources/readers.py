"""Readers. Local or mounted files; nothing is downloaded. Gates are native filters, so
they run in the scan's stage and simple ones are pushed into it."""

from __future__ import annotations

import csv
import io
import random
import tarfile
import zipfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import augment
from ..functions import text as tx
from ..functions.langs import ALL, CODES, lookup
from ..operators import mix
from .registry import first_rows, plain_path, positioned, source

_ALIASES = {"oss": ["os"], "mon": ["khk"], "mhr": ["mari"]}
_CYRILLIC_ONLY = ("srp", "uzn")


def gates(df: DataFrame, min_chars: int = 0, max_chars: int = 0, cyr: float = 0.0, truncate: bool = False, flatten: bool = True, drop_cjk: bool = False) -> DataFrame:
    """Flatten, then length, then script. Over ``max_chars`` (0: no limit) a row is
    dropped or, with ``truncate``, cut."""
    df = df.where("text is not null")
    if flatten:
        df = df.withColumn("text", tx.flatten("text"))
    df = df.where(F.length("text") >= min_chars)
    if max_chars and truncate:
        df = df.withColumn("text", F.substring("text", 1, max_chars))
    elif max_chars:
        df = df.where(F.length("text") <= max_chars)
    if cyr:
        df = df.where(tx.cyrillic_ratio("text") >= cyr)
    if drop_cjk:
        df = df.where(~F.col("text").rlike(r"[\x{4E00}-\x{9FFF}]"))
    return df


def _out(df: DataFrame, lang: str, limit: int = 0) -> DataFrame:
    df = df.select(F.lit(lang).alias("lang"), "text", "_pos")
    return df.orderBy("_pos").limit(limit) if limit else df


def _table(spark: SparkSession, path: str, files: str | None = None) -> DataFrame:
    """Parquet, JSON lines or CSV, by the extension."""
    at = f"{path}/{files}" if files else path
    kind = at.lower().rstrip("/").removesuffix(".gz").removesuffix(".zst").rpartition(".")[2]
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.json(at)
    if kind in ("csv", "tsv"):
        return spark.read.csv(at, header=True, multiLine=True, quote='"', escape='"', sep="\t" if kind == "tsv" else ",")
    return spark.read.parquet(at)


def windows(df: DataFrame, per_doc: int, seed: int) -> DataFrame:
    """Pieces of documents (text, _pos, and ``lang`` where there is one). Each document has its own
    random stream, seeded by its content."""

    @F.arrow_udf("array<string>")
    def cut(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([augment.windows_from_doc(t or "", augment.stream(seed, "d", "", t or ""), per_doc) for t in texts.to_pylist()], pa.list_(pa.string()))

    keep = [c for c in ("lang",) if c in df.columns]
    return df.select(*keep, "_pos", F.posexplode(cut(F.col("text"))).alias("i", "text")).select(*keep, "text", (F.col("_pos") * 1000 + F.col("i")).alias("_pos"))


@source("hf")
def documents(spark: SparkSession, path: str, lang: str, column: str = "text", files: str | None = None, docs: int = 600, per_doc: int = 4, seed: int = 42, raw: bool = False, min_chars: int = 20, max_chars: int = 0, where: str | None = None, cyr: float = 0.0, drop_cjk: bool = False) -> DataFrame:
    """A table of documents: windows of the first ``docs``, or the rows as they are (``raw``)."""
    df = _table(spark, path, files)
    if where:
        k, _, v = where.partition("=")
        df = df.where(F.col(k).cast("string") == v)
    df = positioned(df.select(F.col(column).cast("string").alias("text")))
    if raw:
        return _out(gates(df, min_chars, max_chars, cyr, truncate=True, drop_cjk=drop_cjk), lang, docs)
    return _out(windows(first_rows(df, docs), per_doc, seed), lang)


@source("fineweb2")
def web_corpus(spark: SparkSession, path: str, docs_per_lang: int = 600, per_doc: int = 4, seed: int = 42, langs: str | None = None) -> DataFrame:
    """A folder with one sub-folder of Parquet for each language (``lang=xxx``)."""
    df = spark.read.parquet(path)
    if langs:
        df = df.where(F.col("lang").isin(langs.split("+")))
    from pyspark.sql import Window

    df = positioned(df.select("lang", "text"))
    df = df.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("_pos"))).where(F.col("r") <= docs_per_lang)
    known = F.create_map(*[F.lit(x) for i, c in enumerate(CODES) for x in (c, i)])
    # places differ between languages, too
    return windows(df.select("lang", "text", (F.col("r") * 64 + F.coalesce(known[F.col("lang")], F.lit(63))).alias("_pos")), per_doc, seed).select("lang", "text", "_pos")


def tatoeba_tables(spark: SparkSession, sentences: str, max_per_lang: int = 2000, min_chars: int = 20, train_per_lang: int = 8000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(evaluation, training) of an ``id, lang, text`` dump. The evaluation pick goes first
    and training leaves it out; picks go by hash."""
    known = {c: c for c in CODES[:26]} | {a: c for c, xs in _ALIASES.items() for a in xs}
    code = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    raw = spark.read.csv(sentences, sep="\t", schema="id string, code string, text string", quote='"', escape='"')
    df = raw.select(code[F.col("code")].alias("lang"), "text").where(F.col("lang").isNotNull() & (F.length("text") >= min_chars))
    df = df.where(~F.col("lang").isin(*_CYRILLIC_ONLY) | tx.is_cyrillic("text")).withColumn("text", tx.flatten("text"))
    test = mix.cap(df, max_per_lang, seed, ("lang",))
    rest = mix.exclude(df, test, ["lang", "text"])
    rest = rest.where(~F.col("lang").isin(CODES[:21]) | tx.is_cyrillic("text"))
    return test, mix.cap(rest, train_per_lang, seed, ("lang",))


@source("tatoeba")
def tatoeba(spark: SparkSession, sentences: str, max_per_lang: int = 2000, min_chars: int = 20, train_per_lang: int = 8000, seed: int = 42) -> DataFrame:
    return positioned(tatoeba_tables(spark, sentences, max_per_lang, min_chars, train_per_lang, seed)[1])


def _archive_rows(spark: SparkSession, path: str, read, schema: str) -> DataFrame:
    """Rows that ``read`` finds in the bytes of each archive, with ``_pos`` in the order of archives by
    path and of rows in them. An archive is a task; files of up to 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    number = {plain_path(f): i for i, f in enumerate(sorted(files.inputFiles()))}
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for at, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, n = read(content.as_py()), number[plain_path(at)] << 43
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in zip(*part)), pa.array(range(n, n + len(part)), pa.int64())], [*names, "_pos"])
                    n += len(part)

    return files.select("path", "content").mapInArrow(run, schema + ", _pos bigint")


def tar_sentences(content: bytes) -> Iterator[tuple[str]]:
    """The lines of an archive's file of sentences."""
    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
        inner = next(m for m in tar if m.name.endswith("-sentences.txt"))
        for line in io.TextIOWrapper(tar.extractfile(inner), "utf-8", newline="\n"):
            yield (line.rstrip("\r\n"),)


def zip_reviews(content: bytes) -> Iterator[tuple[str | None, str | None]]:
    """(custom_id, text) of the CSV in an archive; an empty text is none."""
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
        for row in csv.DictReader(io.TextIOWrapper(f, "utf-8", newline="")):
            yield row.get("custom_id"), row.get("text") or None


@source("leipzig")
def leipzig(spark: SparkSession, path: str, lang: str, limit: int = 999_999, min_chars: int = 20, cyr: float = 0.0) -> DataFrame:
    """``id<TAB>sentence`` lines, unpacked or in a tar archive."""
    packed = path.endswith((".tar.gz", ".tgz", ".tar"))
    lines = _archive_rows(spark, path, tar_sentences, "value string") if packed else positioned(spark.read.text(path))
    df = lines.select(F.split("value", "\t", 2)[1].alias("text"), "_pos")
    return _out(gates(df, min_chars, cyr=cyr), lang, limit)


@source("opus")
def bitext_side(spark: SparkSession, path: str, lang: str, limit: int = 999_999, min_chars: int = 20) -> DataFrame:
    """One side of a bitext: a line is a sentence."""
    return _out(gates(positioned(spark.read.text(path)).withColumnRenamed("value", "text"), min_chars), lang, limit)


@source("csv")
def csv_column(spark: SparkSession, path: str, column: str, lang: str, min_chars: int = 20, max_chars: int = 0) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return _out(gates(positioned(df.select(F.col(column).alias("text"))), min_chars, max_chars), lang)


@source("jsonl")
def labeled_json(spark: SparkSession, path: str, min_chars: int = 20) -> DataFrame:
    """Rows that have their label; texts aren't flattened."""
    df = positioned(spark.read.schema("lang string, text string").json(path))
    return gates(df, min_chars, flatten=False).where(F.col("lang").isin(CODES)).select("lang", "text", "_pos")


@source("ukr_tweets")
def labeled_tweets(spark: SparkSession, path: str, lang: str = "ukr", twitter_lang: str = "uk", limit: int = 400_000, min_chars: int = 20, max_chars: int = 0, cyr: float = 0.5) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').where(F.col("lang") == twitter_lang)
    return _out(gates(positioned(df.select("text")), min_chars, max_chars, cyr), lang, limit)


@source("mn_social")
def social(spark: SparkSession, path: str, lang: str = "mon", limit: int = 400_000, min_chars: int = 20, max_chars: int = 0) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return _out(gates(positioned(df.select(F.col("text_raw").alias("text"))), min_chars, max_chars), lang, limit)


@source("kazsandra")
def reviews(spark: SparkSession, path: str, lang: str = "kaz", limit: int = 400_000, min_chars: int = 20, max_chars: int = 0, cyr: float = 0.5) -> DataFrame:
    """The first row with a text of each ``custom_id``, before all gates; of CSV files, plain or zipped."""
    if path.endswith(".zip"):
        df = _archive_rows(spark, path, zip_reviews, "custom_id string, text string")
    else:
        df = positioned(spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').select("custom_id", "text"))
    df = df.where("text is not null")
    first = df.groupBy("custom_id").agg(F.min(F.struct("_pos", "text")).alias("x")).select("x.text", "x._pos")
    return _out(gates(first, min_chars, max_chars, cyr), lang, limit)


def _per_book(df: DataFrame, keep: int, seed: int) -> DataFrame:
    """(doc, sentences) -> up to ``keep`` sentences of each, by a seeded order."""

    @F.arrow_udf("array<string>")
    def pick(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, lists in parts:
            out = []
            for i, s in zip(ids.to_pylist(), lists.to_pylist()):
                random.Random(f"{seed}:{i}").shuffle(s)
                out.append(s[:keep])
            yield pa.array(out, pa.list_(pa.string()))

    picked = df.where(F.size("s") > 0).select("_pos", pick(F.col("_pos"), F.col("s")).alias("s"))
    return picked.select(F.posexplode("s").alias("i", "text"), "_pos").select("text", (F.col("_pos") * 100_000 + F.col("i")).alias("_pos"))


@source("gutenberg")
def books(spark: SparkSession, path: str, langs: str = "ru", max_books: int = 80, per_book: int = 4000, min_chars: int = 20, max_chars: int = 200, seed: int = 42, banned: str = "война и мир|war and peace|guerre et paix") -> DataFrame:
    """Books (title, text) without licence frames: sentences, a seeded pick of each book."""
    lang = next(x.iso3 for x in ALL if x.iso1 == langs)
    df = positioned(_table(spark, path).select("title", "text")).where(~F.coalesce(F.lower("title"), F.lit("")).rlike(banned))
    df = first_rows(df, max_books)
    t = F.regexp_replace(F.regexp_replace("text", r"(?s)^.*?\*\*\* ?START OF[^\n]*\n", ""), r"(?s)\*\*\* ?END OF.*$", "")
    return _out(_per_book(df.select("_pos", tx.sentences(t, min_chars, max_chars).alias("s")), per_book, seed), lang)


@source("wikisource")
def wiki_pages(spark: SparkSession, path: str, lang: str = "rus", docs: int = 150_000, per_doc: int = 40, banned: str = "война и мир|war and peace", min_chars: int = 20, max_chars: int = 200, seed: int = 42) -> DataFrame:
    """Pages (title, text): sentences that aren't navigation, a seeded pick of each page."""
    df = first_rows(positioned(_table(spark, path).select("title", "text")), docs).where(~F.coalesce(F.lower("title"), F.lit("")).rlike(banned))
    s = F.filter(tx.sentences(F.coalesce("text", F.lit("")), min_chars, max_chars), lambda x: ~tx.is_boilerplate(x))
    return _out(_per_book(df.select("_pos", s.alias("s")), per_doc, seed), lang)


@source("diverse")
def diverse(spark: SparkSession, path: str, lang: str, budget: int = 14_000, min_gain: int = 2, min_df: int = 2, expose_top: int = 15_000, min_exposures: int = 3, min_bands: int = 3, min_chars: int = 20, max_chars: int = 200, max_candidates: int = 1_500_000, seed: int = 42) -> DataFrame:
    """Sentences of a pool (text) that cover its vocabulary."""
    from ..operators.select import lemmatized, select_coverage

    pool = positioned(_table(spark, path).select("text")).where(F.length("text").between(min_chars, max_chars)).orderBy("_pos").limit(max_candidates)
    pool = lemmatized(pool.select(F.col("_pos").alias("row_id"), "text", F.lit(lang).alias("lang")), lang)
    got = select_coverage(pool, budget=budget, min_gain=min_gain, min_df=min_df, expose_top=expose_top, min_exposures=min_exposures, min_bands=min_bands, min_chars=min_chars, max_chars=max_chars, seed=seed)
    return got.select("lang", "text", F.col("rank").cast("bigint").alias("_pos"))


# -- other readers


def _coded(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t", 2)
    return lines.where(F.instr("value", "\t") > 0).select(parts[0].alias("code"), parts[1].alias("text"))


def eval_tsv(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(rows (lang, text), skipped lines). The code is trimmed, in any case; the text is
    what follows the first tab. Lines without a tab or with an unknown code are skipped."""
    lines = spark.read.text(list(paths))
    code = F.lower(F.trim(F.split("value", "\t", 2)[0]))
    good = (F.instr("value", "\t") > 0) & code.isin(CODES)
    return _coded(lines.where(good)).select(F.lower(F.trim("code")).alias("lang"), "text"), lines.where(~good)


def strict_tsv(spark: SparkSession, *paths: str) -> DataFrame:
    """(lang, text) of lines whose code is exactly one of ours."""
    return _coded(spark.read.text(list(paths))).where(F.col("code").isin(CODES)).withColumnRenamed("code", "lang")


def plain_documents(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """(text): a file is a document, trimmed; or a line is, blank ones too."""
    df = spark.read.text(path, wholetext=not by_line).withColumnRenamed("value", "text")
    return df if by_line else df.withColumn("text", F.trim(F.regexp_replace("text", rf"^[{tx.SPACE}]+|[{tx.SPACE}]+$", "")))


def markdown_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): trimmed lines that aren't blank or headings."""
    t = F.regexp_replace("value", rf"^[{tx.SPACE}]+|[{tx.SPACE}]+$", "")
    return spark.read.text(path).select(t.alias("text")).where((F.col("text") != "") & ~F.col("text").startswith("#"))


def read_split(spark: SparkSession, directory: str, split: str) -> DataFrame:
    """A split of a written dataset: Parquet, or JSON lines where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{directory}/split={split}").select("lang", "text")
    except AnalysisException:
        return spark.read.schema("lang string, text string").json(f"{directory}/{split}.jsonl")


def display_name(lang: Column) -> Column:
    return F.coalesce(lookup(lang, "name"), F.lit("Undetermined"))
