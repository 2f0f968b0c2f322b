"""Sinks: datasets with a manifest, evaluation files, detections, errors, cards."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .registry import parse_spec


SPLITS = "train val test".split()


def write_dataset(rows: DataFrame, out: str, fmt: str = "parquet") -> dict[str, int]:
    """(lang, text, split) by split; returns the rows of each."""
    if fmt == "parquet":
        rows.select("lang", "text", "split").write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(out)
        back = rows.sparkSession.read.parquet(out)
        return {r["split"]: r["n"] for r in back.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    if fmt != "jsonl":
        raise ValueError(f"unknown format {fmt!r}")
    counts = {}
    for split in SPLITS:
        part = rows.where(F.col("split") == split).select("lang", "text")
        part.write.mode("overwrite").json(f"{out}/{split}.jsonl")
        counts[split] = rows.sparkSession.read.schema("lang string, text string").json(f"{out}/{split}.jsonl").count()
    return counts


def write_manifest(out: str, argv: list[str], specs: list[str], splits: dict[str, int], fmt: str = "parquet", **knobs) -> dict:
    m = {"argv": argv, **knobs, "format": fmt, "splits": splits, "sources": [list(parse_spec(s)) for s in specs]}
    os.makedirs(out, exist_ok=True)
    with open(os.path.join(out, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump(m, f, ensure_ascii=False, indent=1)
    return m


def replay(argv: list) -> list:
    """``argv`` with ``--from-manifest FILE`` replaced by the recorded arguments, but for
    the recorded ``--out``; what else is given now comes after them and wins."""
    if "--from-manifest" not in argv:
        return list(argv)
    i = argv.index("--from-manifest")
    with open(argv[i + 1], encoding="utf-8") as f:
        old = json.load(f).get("argv", [])
    kept, skip = [], False
    for a in old:
        if skip:
            skip = False
        elif a == "--out":
            skip = True
        elif not a.startswith("--out="):
            kept.append(a)
    return kept + argv[:i] + argv[i + 2 :]


def write_eval_tsv(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("\t", "lang", tx.flatten("text")).alias("value")).write.mode("overwrite").text(path)


def write_detections(detected: DataFrame, path: str, as_json: bool = False) -> None:
    from ..operators.detect import detection_line

    detected.select(detection_line(F.col("lang_detected"), F.col("confidence"), F.col("is_uncertain"), as_json).alias("value")).write.mode("overwrite").text(path)


def write_errors(errors: DataFrame, path: str) -> None:
    """Tab-separated, one folder for each language."""
    errors.select("gold", F.concat_ws("\t", "gold", "pred", "conf", "flag", "text").alias("value")).write.mode("overwrite").partitionBy("gold").text(path)


def write_cleaned(kept: DataFrame, dropped: DataFrame, out: str) -> None:
    """Kept and dropped rows side by side, in new folders."""
    kept.write.mode("overwrite").parquet(f"{out}/kept")
    dropped.write.mode("overwrite").parquet(f"{out}/dropped")


def dataset_card(manifest: dict) -> str:
    """A README for a dataset, from its manifest; keys that older ones lack may be absent."""
    lines = ["# Dataset card", "", f"Seed {manifest.get('seed', 'unknown')}; cap per language {manifest.get('cap_per_lang', 'none')}.", ""]
    for split, n in (manifest.get("splits") or {}).items():
        lines.append(f"- {split}: {n:,} rows")
    lines += ["", "| source | options |", "| --- | --- |"]
    for name, options in manifest.get("sources", []):
        shown = [f"{k}={v}" for k, v in options.items()]
        lines.append("| " + name + " | " + " ".join(shown) + " |")
    return "\n".join(lines) + "\n"
