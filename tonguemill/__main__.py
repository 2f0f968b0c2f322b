"""Command line: ``python -m tonguemill COMMAND ...``"""

from __future__ import annotations

import argparse
import json
import sys
import time

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import features, hashing, langs
from .functions import text as tx
from .operators import hygiene, metrics, mix, model, train
from .operators.detect import Words, detect, detect_batch, detection_line, judge
from .sources import readers, sinks
from .sources.registry import SOURCES, cached, create, parse_spec


def _spark() -> SparkSession:
    return SparkSession.builder.appName("tonguemill").getOrCreate()


def _predictions(spark, args):
    rows, skipped = readers.eval_tsv(spark, *args.files)
    d = detect(rows, model.load(args.model))
    return d.select(F.col("lang").alias("gold"), F.col("lang_detected").alias("pred"), "confidence", "is_uncertain", "text"), skipped


def cmd_detect(spark, args):
    m = model.load(args.model)
    if args.input != "-":
        d = detect(readers.plain_documents(spark, args.input, args.lines), m)
        for r in d.select(detection_line(F.col("lang_detected"), F.col("confidence"), F.col("is_uncertain"), args.json).alias("x")).toLocalIterator():
            print(r.x)
        return
    text = sys.stdin.read()
    docs, known = text.splitlines() if args.lines else [text.strip()], Words(m, m.doubled())
    for i in range(0, len(docs), args.batch):
        for d in detect_batch(docs[i : i + args.batch], m, args.batch, known):
            code = d["lang"] or "und"
            name = langs.BY_CODE[code].name if d["lang"] else "Undetermined"
            print(json.dumps({"lang": code, "name": name, "confidence": d["confidence"], "uncertain": d["is_uncertain"]}, ensure_ascii=False) if args.json else code)


def cmd_eval(spark, args):
    p, skipped = _predictions(spark, args)
    p = p.cache()
    print(f"skipped lines: {skipped.count()}")
    metrics.accuracy(p).show()
    metrics.accuracy(p, "gold").orderBy("gold").show(30)


def cmd_assess(spark, args):
    p, _ = _predictions(spark, args)
    p = p.cache()
    metrics.prf(p).orderBy("f1").show(30)
    metrics.by_length(p).orderBy("bucket").show()
    metrics.top_confusions(p).show()
    rows = p.select(F.col("gold").alias("lang"), "text")
    m = model.load(args.model)
    metrics.ladder(rows, lambda d: detect(d, m).withColumnRenamed("lang_detected", "pred")).orderBy("n", "gold").show(200)
    if args.dump_errors:
        sinks.write_errors(metrics.error_dump(p.withColumn("_pos", F.monotonically_increasing_id()), args.dump_per_lang), args.dump_errors)


def cmd_fetch(spark, args):
    for spec in args.source:
        print(spec, cached(spark, spec, args.cache).count())


def cmd_mix(spark, args):
    if args.list:
        print("\n".join(sorted(SOURCES)))
        return
    sources = [cached(spark, s, args.cache) if args.cache else create(spark, *parse_spec(s)) for s in args.source]
    rows = mix.build(sources, args.cap_per_lang or None, args.wild_augment, args.short_augment, args.short_floor, args.seed)
    splits = sinks.write_dataset(rows, args.out, args.format)
    sinks.write_manifest(args.out, args.argv, args.source, splits, args.format, seed=args.seed, cap_per_lang=args.cap_per_lang, wild_augment=args.wild_augment, short_augment=args.short_augment, short_floor=args.short_floor)
    print(json.dumps(splits))


def cmd_train(spark, args):
    tr, val = (readers.read_split(spark, args.data, s) for s in ("train", "val"))
    m = train.train_logistic(tr, args.log2_d, args.per_lang_cap) if args.trainer == "logistic" else train.train_counts(tr, args.log2_d)
    train.calibrate(val, m)
    print(json.dumps(train.export(m, args.out, val, args.store, args.quant_max_drop)))


def cmd_quantize(spark, args):
    print(json.dumps(model.convert(args.model, args.out, args.store)))


def cmd_clean(spark, args):
    m = model.load(args.model)
    rows = spark.read.parquet(args.data)
    j = judge(spark, m)
    rows = rows.withColumn("j", j).select("lang", "text", "j.pred", "j.conf").withColumns({"latin_top": F.lit(None).cast("string"), "latin_p": F.lit(None).cast("double")})
    kept, dropped = hygiene.clean(rows, args.conf, args.only_lang or None)
    if args.dry_run:
        print(dropped.count())
    else:
        sinks.write_cleaned(kept.select("lang", "text"), dropped, args.out)


def cmd_hard_negatives(spark, args):
    rows = spark.read.parquet(args.data).withColumn("j", judge(spark, model.load(args.model))).select("lang", "text", F.col("lang").alias("source"), "j.pred", "j.conf")
    hygiene.hard_negatives(rows, args.conf, args.per_lang).write.mode("overwrite").parquet(args.out)


def cmd_short_verify(spark, args):
    kept, dropped = hygiene.short_verify(spark.read.parquet(args.data), args.judge, args.min_agree)
    sinks.write_cleaned(kept, dropped, args.out)


def cmd_referee(spark, args):
    rows = hygiene.referee(spark.read.parquet(args.data), spark.read.parquet(args.train), args.judge, args.per_lang)
    sinks.write_eval_tsv(rows, args.out)


def cmd_card(spark, args):
    with open(args.manifest, encoding="utf-8") as f:
        print(sinks.dataset_card(json.load(f)))


def _labels(spark, path: str, aliases: str):
    """(text, pred) of a table of another tool's answers (text, label): our codes, where the label
    is one's or its alias; and the codes that occur."""
    known = {l: c for c, ls in langs.LABEL_ALIASES[aliases].items() for l in ls} | {c: c for c in langs.CODES}
    rows = spark.read.csv(path, sep="\t", schema="text string, label string", quote="").withColumn("label", F.regexp_replace("label", "^__label__", ""))
    table = spark.createDataFrame(list(known.items()), "label string, pred string")
    rows = rows.join(F.broadcast(table), "label", "left").groupBy("text").agg(F.max("pred").alias("pred")).cache()
    return rows, {r.pred for r in rows.select("pred").distinct().collect() if r.pred}


def cmd_eval_fasttext(spark, args):
    """Another identifier's answers, stored as a table, scored like ours."""
    told, codes = _labels(spark, args.predictions, args.labels)
    print(f"covers {len(codes)}/{len(langs.CODES)} of our languages; left out: {sorted(set(langs.CODES) - codes)}")
    rows = readers.strict_tsv(spark, *args.files).where(F.col("lang").isin(sorted(codes))).cache()
    answer = lambda d: d.join(told, "text", "left")
    if not args.skip_ladder:
        rungs = metrics.ladder(rows, answer).groupBy("n").agg(F.sum("ok").alias("ok"), F.sum("n_rows").alias("t")).collect()
        for n, name in ((1, "word"), (2, "pair"), (3, "triple")):
            for r in rungs:
                if r.n == n:
                    print(f"{name}: {r.ok / r.t:.2%}  (n = {r.t})")
    p = answer(rows).withColumnRenamed("lang", "gold")
    for r in metrics.accuracy(p).collect():
        print(f"text: {r.accuracy:.2%}  (n = {r.n})")
    metrics.by_length(p).orderBy("bucket").show()
    metrics.accuracy(p, "gold").orderBy("accuracy", "gold").show(30)


def cmd_lid_bench(spark, args):
    """Our model beside other tools' stored answers, on the same rows."""
    rows, _ = readers.eval_tsv(spark, *args.files)
    rows = (mix.balanced_sample(rows, args.rows_per_lang, args.seed) if args.rows_per_lang else rows).cache()
    n, m = rows.count(), model.load(args.model)
    print(f"{n} rows")
    began = time.perf_counter()
    ours = detect(rows, m).select(F.col("lang").alias("gold"), F.col("lang_detected").alias("pred"), "text").cache()
    ours.count()
    print(f"tonguemill: {(time.perf_counter() - began) / max(n, 1) * 1e6:.1f} µs/sample")
    tools = {"tonguemill": (ours, set(langs.CODES))}
    for spec in args.tool:
        name, _, path = spec.partition("=")
        told, codes = _labels(spark, path, args.labels)
        tools[name] = rows.withColumnRenamed("lang", "gold").join(told, "text", "left").select("gold", "pred", "text"), codes
    for name, (p, codes) in tools.items():
        shown = [("all", p)] + ([(f"length {b}", p.where(tx.length_bucket("text") == b)) for b in range(3)] if args.by_length else [])
        for what, part in shown:
            r = metrics.coverage(part, sorted(codes)).first()
            if r.n:
                print(f"{name:<20} {what:<9} supported {(r.ok_supported or 0) / max(r.n_supported, 1):.2%}  all {r.ok / r.n:.2%}  (n = {r.n})")
        if args.per_lang:
            print(name, ", ".join(f"{r.gold} {r.accuracy:.1%} ({r.n})" if r.gold in codes else f"{r.gold} -" for r in metrics.accuracy(p, "gold").orderBy("gold").collect()))


def cmd_bench(spark, args):
    """Time of detection alone: the median of some runs over all rows, and text by text."""
    m = model.load(args.model)
    rows = readers.eval_tsv(spark, *args.files)[0].cache()
    n, took = max(rows.count(), 1), []
    for _ in range(args.repeats):
        began = time.perf_counter()
        detect(rows, m).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    print(f"bulk: {sorted(took)[len(took) // 2] / n * 1e6:.1f} µs/sample ({n} rows, median of {args.repeats})")
    if args.single:
        known, began = Words(m, m.doubled()), time.perf_counter()
        for r in rows.toLocalIterator():
            detect_batch([r.text], m, known=known)
        print(f"single: {(time.perf_counter() - began) / n * 1e6:.1f} µs/sample")


#: Texts whose keys are written down, so that another program can be held against them.
PARITY_TEXTS = ("Ein Satz in gewöhnlicher Schrift.", "Короткое предложение для проверки", "Қазақ тілінде жазылған сөйлем", "Phrase accentuée, déjà vue", "mixed слова hier и там", "я", "...?!", "see www.example.org now", "mail a.b@example.net", "@someone said", "42 3.14 99px", "#tag #метка", "и т.д. U.N.", "HTTPS://EXAMPLE.ORG/A?b=1", "RT @x: https://e.org 2x #ok да")


def cmd_gen_fixtures(spark, args):
    cases = []
    seeds = [(t, h, d, hashing.SEED) for t in PARITY_TEXTS for h in hashing.HASHES for d in (12, 17)] + [(PARITY_TEXTS[1], "fmix32", 17, 12345)]
    for text, which, log2_d, seed in seeds:
        b, neg, _ = features.bucket_tokens(pa.array([text]), log2_d, which, seed)
        cases.append({"text": text, "hash": which, "seed": seed, "n_min": 1, "n_max": 5, "log2_d": log2_d, "keys": [str(k) for k in features.token_keys(text)], "buckets": b.tolist(), "negative": neg.astype(int).tolist()})
    with open(args.out, "w", encoding="utf-8") as f:
        json.dump({"cases": cases}, f, ensure_ascii=False)
    print(f"{len(cases)} cases")


#: Command -> (function, options): a value is the default, a type alone is required (or
#: repeated, for list); names without dashes in front are positional.
COMMANDS = {
    "detect": (cmd_detect, {"model": str, "*input": str, "lines": False, "json": False, "batch": 1024}),
    "eval": (cmd_eval, {"model": str, "*files": list}),
    "assess": (cmd_assess, {"model": str, "*files": list, "dump_errors": None, "dump_per_lang": 50}),
    "fetch": (cmd_fetch, {"source": list, "cache": "cache"}),
    "mix": (cmd_mix, {"out": None, "source": list, "seed": 42, "cap_per_lang": 0, "wild_augment": 0.0, "short_augment": 0.0, "short_floor": 0.0, "format": "parquet", "cache": None, "list": False}),
    "train": (cmd_train, {"data": str, "out": str, "log2_d": 14, "per_lang_cap": 50_000, "store": "f16", "quant_max_drop": 0.2, "trainer": "logistic"}),
    "quantize": (cmd_quantize, {"model": str, "out": str, "store": str}),
    "clean": (cmd_clean, {"model": str, "data": str, "out": None, "conf": 0.995, "only_lang": list, "dry_run": False}),
    "hard-negatives": (cmd_hard_negatives, {"model": str, "data": str, "out": str, "conf": 0.98, "per_lang": 4_000}),
    "short-verify": (cmd_short_verify, {"data": str, "out": str, "judge": list, "min_agree": 2}),
    "referee": (cmd_referee, {"data": str, "train": str, "out": str, "judge": list, "per_lang": 500}),
    "card": (cmd_card, {"*manifest": str}),
    "eval-fasttext": (cmd_eval_fasttext, {"predictions": str, "*files": list, "labels": "lid176", "skip_ladder": False}),
    "lid-bench": (cmd_lid_bench, {"model": str, "*files": list, "tool": list, "labels": "lid176", "rows_per_lang": 500, "seed": 42, "per_lang": False, "by_length": False}),
    "bench": (cmd_bench, {"model": str, "*files": list, "repeats": 5, "single": False}),
    "gen-fixtures": (cmd_gen_fixtures, {"out": str}),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tonguemill")
    sub = p.add_subparsers(dest="command", required=True)
    for command, (run, options) in COMMANDS.items():
        c = sub.add_parser(command)
        c.set_defaults(run=run)
        for name, value in options.items():
            flag = "--" + name.replace("_", "-")
            if name.startswith("*"):
                c.add_argument(name[1:], **({"nargs": "+"} if value is list else {}))
            elif value is list:
                c.add_argument(flag, action="append", default=[])
            elif value is False:
                c.add_argument(flag, action="store_true")
            elif value is str:
                c.add_argument(flag, required=True)
            else:
                c.add_argument(flag, default=value, type=str if value is None else type(value))
    return p


def main(argv: list | None = None) -> int:
    argv = sinks.replay(sys.argv[1:] if argv is None else argv)
    args = parser().parse_args(argv)
    args.argv = argv
    args.run(_spark(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
