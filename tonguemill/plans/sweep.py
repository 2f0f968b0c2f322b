"""A sweep over documents: lines, sentences, detection, histogram."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import line_sentences
from ..operators.detect import _slices, detect
from ..operators.metrics import histogram
from ..operators.model import Model


def sentence_rows(docs: DataFrame, key: str, min_chars: int = 20) -> DataFrame:
    """(key, sentence_no, text) of sentences with a letter and ``min_chars`` characters."""

    @F.arrow_udf("array<string>")
    def split(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.concat_arrays([pa.array([], pa.list_(pa.string())), *[pa.array([line_sentences(t, min_chars) for t in piece.to_pylist()], pa.list_(pa.string())) for piece in _slices(texts)]])

    s = docs.select(key, F.posexplode(split(F.col("text"))).alias("sentence_no", "text"))
    return s.where((F.length("text") >= min_chars) & F.col("text").rlike(r"\p{IsAlphabetic}"))


def sweep(docs: DataFrame, m: Model, key: str, min_chars: int = 20) -> DataFrame:
    """(lang, n, n_uncertain) over the sentences of all documents."""
    return histogram(detect(sentence_rows(docs, key, min_chars), m))


def register_table_functions(spark) -> None:
    """SQL table functions ``sentences(text)`` and ``fragments(text, n)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="sentence_no int, sentence string")
    class Sentences:
        def eval(self, text: str):
            yield from enumerate(line_sentences(text))

    @udtf(returnType="fragment string")
    class Fragments:
        def eval(self, text: str, n: int):
            w = [x for x in (text or "").split() if any(c.isalpha() for c in x)]
            for i in range(len(w) - n + 1):
                yield (" ".join(w[i : i + n]),)

    spark.udtf.register("sentences", Sentences)
    spark.udtf.register("fragments", Fragments)
