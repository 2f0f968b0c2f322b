import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonguemill.functions import augment, langs
from tonguemill.functions import text as tx
from tonguemill.operators import detect as dt
from tonguemill.operators import hygiene, metrics, mix, model, select, train
from tonguemill.sources import readers, registry, sinks


def tiny(theta=0.3):
    p = np.zeros((4097, 30))
    p[0, 0], p[0, 21] = 5, -5
    return model.Model(p, np.zeros(30), 12, theta, n_max=3)


def noisy(seed=1):
    rng = np.random.default_rng(seed)
    return model.Model(rng.normal(0, 8, (4097, 30)), rng.normal(0, 0.1, 30), 12, 0.4)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "text string").select(expr.alias("x")).first().x


# -- text


def test_native_text_functions(spark):
    assert one(spark, "RT: @nick привет https://x.y/z www.a.b мир", tx.judge_text("text")) == "привет мир"
    assert one(spark, "љубав", tx.serbian_latin("text")) == "ljubav"
    assert one(spark, "a  b\x1cc\n", tx.flatten("text")) == "a b c"
    assert one(spark, "один two 3 ...", tx.word_tokens("text")) == ["один", "two"]
    assert one(spark, "a b c", tx.fragments("text", 2)) == ["a b", "b c"] and one(spark, "a", tx.fragments("text", 3)) == []
    assert one(spark, None, tx.words("text")) == []
    assert one(spark, "ыa", tx.cyrillic_ratio("text")) == 0.5 and one(spark, "1", tx.cyrillic_ratio("text")) == 0.0
    assert one(spark, "| x", tx.is_boilerplate("text")) and not one(spark, "x", tx.is_boilerplate("text"))
    for lang, t, want in (("ukr", "її", True), ("rus", "мы", True), ("rus", "мы її", False), ("bel", "воўк", True), ("ukr", "мама", False)):
        assert spark.createDataFrame([(lang, t)], "lang string, text string").select(tx.certified("lang", "text").alias("x")).first().x is want


def test_native_route_equals_python(spark):
    from tonguemill.functions.scripts import route

    texts = ["Привет", "Hello", "Привіт hello мир", "こ世", "北京", "नम", "مر", "1", "ab вг", "ab 北京", "a مر", "", "вг 北京"]
    r = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tx.route("text").alias("r")).collect()
    assert [x.r.direct_lang or x.r.route for x in r] == [route(x.text) for x in r]


def test_native_word_classes_and_counts(spark):
    from tests.test_features import TEXTS
    from tonguemill.functions import features as fx

    words = "https://t.co/3 HTTP://E.COM/P www.g.ru t.co test@mail.ru a@b @ @x 2020 3.5.2 COVID19 т.е. миллион2020 U.S.A. тест@пример.ру".split()
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.classify_word("w").alias("c")).collect():
        assert r.c == fx.classify_word(r.w), r.w
    plain = [t for t in TEXTS if "Σ" not in t]
    for r in spark.createDataFrame([(t,) for t in plain], "text string").select("text", tx.token_count("text").alias("n")).collect():
        assert r.n == len(fx.token_keys(r.text)), r.text


def test_languages(spark):
    assert len(langs.ALL) == 30 and langs.parse_lang("KAZ").name == "Kazakh"
    assert [x.iso3 for x in langs.ALL if x.iso1 is None] == "sah tyv udm mhr kpv".split()
    assert langs.BY_CODE["mon"].nllb == "khk_Cyrl" and langs.BY_CODE["mhr"].nllb == "mari_Cyrl"
    assert langs.BY_CODE["deu"].name_in("rus") == "Немецкий" and langs.BY_CODE["deu"].name_in("fra") == "German"
    assert {g: sum(x.group == g for x in langs.ALL) for g in langs.COLUMN_RANGE} == {g: b - a for g, (a, b) in langs.COLUMN_RANGE.items()}
    with pytest.raises(langs.UnknownLang):
        langs.parse_lang("xxx")


# -- models


def test_numbers():
    e = {0: 0, 0x38: 1, 0x3C: 1.5, 0x40: 2, 0x7E: 448, 1: 2**-9, 8: 2**-6}
    assert all(model.e4m3_to_f32(k) == v for k, v in e.items()) and math.isnan(model.e4m3_to_f32(0x7F))
    assert [float(model.f16_to_f32(x)) for x in (0x3C00, 0x3800, 0xC000, 0x7BFF, 1)] == [1, 0.5, -2, 65504, 2**-24]
    t = model.e4m3_table()
    finite = np.flatnonzero(~np.isnan(t))
    assert (model.e4m3_to_f32(model.f32_to_e4m3(t[finite])) == t[finite]).all()


@pytest.mark.parametrize("store", model.STORES)
def test_store_round_trip(tmp_path, store):
    m = tiny()
    d = model.save(m, str(tmp_path / "m"), store)
    back = model.load(str(tmp_path / "m"))
    assert np.abs(back.p - m.p).max() < 1e-2 and (back.p[-1] == 0).all() and back.theta == 0.3
    assert d["bytes"] <= d["f16_bytes"] * 1.5
    model.convert(str(tmp_path / "m"), str(tmp_path / "n"), "int8-col")
    assert abs(model.load(str(tmp_path / "n")).p[0, 0] - 5) < 1e-2


@pytest.mark.parametrize("change", [{"version": 2}, {"lexical": False}, {"languages": langs.CODES[::-1]}, {"quant": {"dtype": "int4", "scheme": "row"}}, {"hash": "xx"}, {"log2_d": 0}])
def test_bad_metadata(tmp_path, change):
    model.save(tiny(), str(tmp_path / "m"))
    f = tmp_path / "m" / "model.json"
    f.write_text(json.dumps(json.loads(f.read_text()) | change))
    with pytest.raises(model.MetadataError):
        model.load(str(tmp_path / "m"))


def test_bad_shapes():
    with pytest.raises(model.ShapeMismatch):
        model.Model(np.zeros((5, 30)), np.zeros(30), 12)


def test_hub_refs():
    assert model.parse_hub_ref("model") is None and model.parse_hub_ref("hf:o/r") == ("o/r", None)
    assert model.parse_hub_ref("hf:o/r/v") == ("o/r", "v")
    assert [model.parse_hub_ref(x) for x in ("hf:o", "hf:a/b/c/d", "hf:a/b/")] == [None] * 3


def test_detection_routes(spark):
    d = dt.detect(spark.createDataFrame([(t,) for t in ("Привет, как дела?", "Hello there", "こんにちは", "12345", None)], "text string"), tiny()).collect()
    assert d[0].lang_detected is not None and d[2].lang_detected == "jpn" and d[2].confidence == 1.0 and not d[2].is_uncertain
    for r in d[3:]:
        assert r.lang_detected is None and r.confidence == 0.0 and r.is_uncertain
    latin = dt.detect(spark.createDataFrame([("Hello world",)] * 3, "text string"), noisy(), restrict_to_group=True).collect()
    assert all(r.lang_detected in langs.CODES[21:26] for r in latin)


def test_long_document_is_the_sum_of_its_tokens():
    m, t = noisy(), "Привет, как дела? Это длинный документ для проверки накопления. " * 120
    sums, n = dt.text_sums(pa.array([t, "", "a"]), m, m.doubled().astype(np.float64))
    ids, off = dt.features.signed_ids(pa.array([t]), 12)
    assert n[0] == len(ids) and n[1] == 0
    chunks = [m.doubled()[ids[i : i + 16]].astype(np.float64).sum(0) for i in range(0, len(ids), 16)]
    assert np.allclose(sums[0], np.sum(chunks, 0), atol=1e-6)


def test_join_form_equals_function_form(spark):
    rows = spark.createDataFrame([(1, "Привет мир"), (2, "hello #world 2020"), (3, "x " * 400)], "id int, text string")
    p = np.random.default_rng(2).integers(-127, 128, (4097, 30)).astype(float)
    m = model.Model(p, np.zeros(30), 12)
    got = {r.id: (r.n_tokens, list(r.sums)) for r in dt.scores_by_join(rows, m, "id").collect()}
    sums, n = dt.text_sums(pa.array([r.text for r in rows.orderBy("id").collect()]), m, m.doubled().astype(np.int64))
    assert got == {i + 1: (int(n[i]), [float(x) for x in sums[i]]) for i in range(3)}


def test_judge_and_lines(spark):
    rows = spark.createDataFrame([("a",), ("привет мир как дела",), (None,)], "text string")
    v = [r.j.pred for r in rows.select(dt.judge(spark, noisy()).alias("j")).collect()]
    assert v[0] is None and v[1] is not None and v[2] is None
    assert [r.v is None for r in rows.select(dt.votes(spark, noisy()).alias("v")).collect()] == [False, False, True]
    d = spark.createDataFrame([("kaz", 0.5, False), (None, 0.0, True)], "l string, c float, u boolean")
    assert [r.x for r in d.select(dt.detection_line(F.col("l"), F.col("c"), F.col("u")).alias("x")).collect()] == ["kaz", "und"]
    got = [json.loads(r.x) for r in d.select(dt.detection_line(F.col("l"), F.col("c"), F.col("u"), True).alias("x")).collect()]
    assert got[0]["name"] == "Kazakh" and got[1] == {"lang": "und", "name": "Undetermined", "confidence": 0.0, "uncertain": True}


def test_sql_functions(spark):
    dt.register(spark, noisy())
    r = spark.sql("select route_script('Привет') r, classify_word('t.co') c, size(token_keys('ab')) k, size(feature_buckets('abc')) b, detect_language('こん') d").first()
    assert (r.r, r.c, r.k, r.b, r.d) == ("cyrillic", "url", 11, 16, "jpn")
    from tonguemill.plans.sweep import register_table_functions

    register_table_functions(spark)
    assert spark.sql("select * from sentences('One two. Three four!')").count() == 2
    assert spark.sql("select * from fragments('a b c', 2)").count() == 2


def test_training(spark, tmp_path):
    rng = random.Random(1)
    vocab = {"rus": "мы рыба это выход", "ukr": "їжа ґанок єдина місто", "eng": "the house and water"}
    rows = spark.createDataFrame([(l, " ".join(rng.choice(v.split()) for _ in range(4))) for l, v in vocab.items() for _ in range(40)], "lang string, text string")
    for m in (train.train_counts(rows, 10), train.train_logistic(rows, 10, iterations=15)):
        assert train.table_accuracy(rows, m) > 0.95
        train.calibrate(rows, m)
        assert 0 < m.theta <= 1
        assert train.export(m, str(tmp_path / "e"), rows, "int8-col")["accuracy_stored"] > 0.9
    assert 0.5 < train.hash_spread(rows, 6) < 2


# -- mix


def test_first_source_wins(spark):
    a = spark.createDataFrame([("eng", "x", 5), ("eng", "y", 6)], "lang string, text string, _pos bigint")
    b = spark.createDataFrame([("eng", "x", 1), ("eng", "z", 2)], "lang string, text string, _pos bigint")
    for n in (1, 5):
        d = mix.dedup_first(mix.stamp([a.repartition(n), b.repartition(n)]))
        assert {(r.text, r._src) for r in d.collect()} == {("x", 0), ("y", 0), ("z", 1)}
    assert {r._src: r.n for r in mix.unique_counts(d).collect()} == {0: 2, 1: 1}


def test_split_is_crc32(spark):
    import zlib

    for r in mix.with_split(spark.createDataFrame([("eng", f"text {i}é") for i in range(50)], "lang string, text string")).collect():
        h = zlib.crc32(f"{r.lang}\0{r.text}".encode()) % 10
        assert r.split == ("train" if h < 8 else "val" if h == 8 else "test")


@pytest.mark.parametrize("short,long", [(0, 0), (0, 30), (3, 30), (20, 5), (4, 5), (30, 0)])
def test_stratified_cap(spark, short, long):
    rows = [("train", "eng", f"s{i}") for i in range(short)] + [("train", "eng", f"long text number {i:05d} here") for i in range(long)]
    d = spark.createDataFrame(rows, "split string, lang string, text string")
    got = mix.cap_stratified(d, 10, 0.5).collect()
    assert len(got) == min(10, short + long)
    if short + long > 10:
        want = min(short, 5)
        want += max(0, 10 - want - long)
        assert sum(len(r.text) <= 19 for r in got) == want
    assert mix.cap(d, 10).count() == min(10, short + long)
    assert sorted(mix.cap(d, 10).collect()) == sorted(mix.cap(d.repartition(7), 10).collect())


def test_augmentation(spark):
    rows = spark.createDataFrame([("rus", f"Привет мир номер {i} как дела", s, 0, i) for i in range(30) for s in ("train", "test")], "lang string, text string, split string, _src int, _pos bigint")
    a = mix.augmented(rows, 0.5, 0.5).collect()
    b = mix.augmented(rows.repartition(5), 0.5, 0.5).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    new = [r for r in a if r.kind >= 0]
    assert new and all(r.split != "test" for r in new) and len({(r.lang, r.text) for r in new}) == len(new)
    rng = augment.stream(1, "w", "rus", "х")
    assert isinstance(augment.wildify("Привет мир", rng), str) and augment.shorten("один", rng) is None and augment.wildify("", rng) == ""
    w = augment.windows_from_doc("First line of text here.\nSecond line.", random.Random(1), 20)
    assert all(20 <= len(x) <= 200 for x in w) and augment.windows_from_doc("", rng, 5) == []


# -- verdicts


def test_hygiene(spark):
    rows = [("rus", "мама", "ukr", 0.999, "en", 0.1), ("tgk", "мама", "uzn", 0.999, None, None), ("tgk", "мама", "uzn", 0.9, None, None), ("tgk", "мама", None, 0.999, None, None), ("rus", "hello world", "rus", 0.9, "en", 0.95), ("rus", "hello world", "ukr", 0.999, "en", 0.95)]
    d = spark.createDataFrame(rows, "lang string, text string, pred string, conf double, latin_top string, latin_p double")
    kept, dropped = hygiene.clean(d)
    assert sorted((r.lang, r.pred, r.text) for r in dropped.collect()) == [("rus", "rus", "hello world"), ("tgk", "uzn", "мама")]
    assert kept.count() + dropped.count() == len(rows)
    hard = hygiene.hard_negatives(d.withColumn("source", F.lit("s")), 0.98).collect()
    assert [r.lang for r in hard] == ["tgk"]


def test_votes(spark):
    d = spark.createDataFrame([("rus", "a b", "rus", "rus", None), ("rus", "a b", "rus", None, None), ("rus", "a", "rus", None, None), ("rus", "a b", "rus", "kaz", None), ("rus", "a b", "ukr", "rus", None)], "lang string, text string, a string, b string, c string")
    kept, dropped = hygiene.short_verify(d, ["a", "b", "c"])
    assert kept.count() == 1 and dropped.count() == 4
    votes = [hygiene.vote(F.col(x), F.col("lang")) for x in "ab"]
    assert [r.x for r in d.select(hygiene.referee_accepts(votes, F.col("text")).alias("x")).collect()] == [True, True, False, False, True]
    assert hygiene.referee(d, d.where("text = 'a'"), ["a", "b"]).where("text = 'a'").count() == 0


# -- metrics


def test_metrics(spark):
    d = spark.createDataFrame([("a", "a", "x"), ("a", "b", "xx"), ("b", None, "x" * 30), ("c", "a", "x" * 200)], "gold string, pred string, text string")
    p = {r.lang: r for r in metrics.prf(d).collect()}
    assert p["a"].precision == 0.5 and p["a"].recall == 0.5 and p["a"].f1 == 0.5
    assert p["b"].n_und == 1 and p["b"].gold_total == 0 and p["b"].recall is None and p["b"].f1 is None
    assert metrics.accuracy(d).first().ok == 1 and [r.n for r in metrics.by_length(d).orderBy("bucket").collect()] == [2, 1, 1]
    assert [(r.gold, r.pred) for r in metrics.top_confusions(d).collect()] == [("a", "b"), ("c", "a")]


# -- selection


def test_stem_clusters(spark):
    v = spark.createDataFrame([(w,) for w in "бала баласы баласында баласындағы қала ба".split()], "token string")
    got = {r.token: r.lemma for r in select.stem_clusters(v).collect()}
    assert {got[w] for w in "бала баласы баласында баласындағы".split()} == {"бала"} and got["қала"] == "қала" and got["ба"] == "ба"
    rows = spark.createDataFrame([(1, "Баласы бала"), (2, "")], "row_id int, text string")
    assert {r.row_id: r.lemmas for r in select.lemmatized(rows, "tat").collect()} == {1: ["бала", "бала"], 2: []}
    assert select.normalizer_id("eng") == "identity"


def test_coverage_selection(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(2, 9) for _ in range(rng.randint(3, 12))) for _ in range(300)]
    lem = [t.split() for t in texts]
    for budget in (0, 5, 50, 1000):
        c = select.Coverage(budget=budget)
        got = c.select(texts, lem)
        assert len(got) == len(set(got)) == min(budget, 300) and got == c.select(texts, lem)
    few = select.Coverage(budget=60).select(texts, lem)
    assert len({x for i in few for x in lem[i]}) >= 0.9 * len({x for i in random.Random(1).sample(range(300), 60) for x in lem[i]})
    pool = spark.createDataFrame([("a", i, t, l) for i, (t, l) in enumerate(zip(texts, lem))] + [("b", 1, "x y", ["x", "y"])], "lang string, row_id bigint, text string, lemmas array<string>")
    out = select.select_coverage(pool, budget=50).collect()
    assert sum(r.lang == "a" for r in out) == 50 and sum(r.lang == "b" for r in out) == 1


# -- sources and sinks


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    make = lambda spec: [(r.lang, r.text) for r in registry.create(spark, *registry.parse_spec(spec)).orderBy("_pos").collect()]
    tsv = put("e.tsv", "rus\tпривет\t«x»\nXXX\ty\nno tab\n ENG \thi\n")
    good, bad = readers.eval_tsv(spark, tsv)
    assert {(r.lang, r.text) for r in good.collect()} == {("rus", "привет\t«x»"), ("eng", "hi")} and bad.count() == 2
    assert [r.lang for r in readers.strict_tsv(spark, tsv).collect()] == ["rus"]
    long = "слово " * 10
    csv = put("t.csv", f'text,lang,custom_id,text_raw\n"{long}\nмного",uk,1,a\n"{long}",ru,2,b\n"{long}2",uk,1,"{long}"\n')
    assert make(f"ukr_tweets:path={csv}") == [("ukr", f"{long}много"), ("ukr", f"{long}2")]
    assert len(make(f"kazsandra:path={csv}")) == 2 and make(f"mn_social:path={csv}") == [("mon", long.strip())]
    assert len(make(f"csv:path={csv},column=text,lang=ukr,max_chars=60")) == 1
    assert make(f"leipzig:path={put('l.txt', f'1{chr(9)}{long}')},lang=rus") == [("rus", long.strip())]
    assert make(f"opus:path={put('o.txt', long)},lang=rus") == [("rus", long.strip())]
    js = put("j.jsonl", "\n".join(json.dumps({"lang": l, "text": long + "\n x"}) for l in ("rus", "zzz")))
    assert make(f"jsonl:path={js}") == [("rus", long + "\n x")]
    assert len(make(f"hf:path={js},lang=rus,raw=True,max_chars=25,where=lang=rus")) == 1
    assert all(20 <= len(t) <= 200 for _, t in make(f"hf:path={js},lang=rus"))
    tat = put("s.tsv", "\n".join(f"{i}\t{c}\t{long}{i}" for i, c in enumerate(["rus"] * 6 + ["khk", "srp", "zzz"])))
    test, tr = readers.tatoeba_tables(spark, tat, 2, 20, 3)
    assert {r.lang: r.n for r in test.groupBy("lang").agg(F.count("*").alias("n")).collect()} == {"rus": 2, "mon": 1, "srp": 1} and tr.count() == 3
    assert not {r.text for r in test.collect()} & {r.text for r in tr.collect()}
    body = "Первое предложение здесь стоит. Второе предложение тоже стоит здесь!"
    books = put("b.jsonl", "\n".join(json.dumps({"title": t, "text": f"head\n*** START OF x\n{body}\n*** END OF x\ntail which is long enough."}) for t in ("Книга", "Война и мир")))
    assert sorted(t for _, t in make(f"gutenberg:path={books}")) == ["Второе предложение тоже стоит здесь!", "Первое предложение здесь стоит."]
    assert len(make(f"wikisource:path={books}")) == 3
    assert len(make(f"diverse:path={js},lang=rus,budget=1")) == 1
    md = put("m.md", "# h\n\n text \n")
    assert [r.text for r in readers.markdown_lines(spark, md).collect()] == ["text"]
    assert readers.plain_documents(spark, md).first().text == "# h\n\n text" and readers.plain_documents(spark, md, True).count() == 3
    with pytest.raises(ValueError):
        registry.create(spark, "nothing", {})
    with pytest.raises(ValueError):
        registry.create(spark, "opus", {"wrong": 1})
    cache = str(tmp_path / "cache")
    first = registry.cached(spark, f"jsonl:path={js}", cache).count()
    assert first == registry.cached(spark, f"jsonl:path={js}", cache).count() == 1


def test_dataset(spark, tmp_path):
    src = spark.createDataFrame([("eng", f"some text {i}", i) for i in range(100)], "lang string, text string, _pos bigint")
    rows = mix.build([src], cap_per_lang=40, wild=0.2, short=0.2, short_floor=0.1)
    for fmt in ("parquet", "jsonl"):
        out = str(tmp_path / fmt)
        n = sinks.write_dataset(rows, out, fmt)
        assert readers.read_split(spark, out, "train").count() == n["train"] == 40
        m = sinks.write_manifest(out, ["mix", "--out", out, "--seed", "1"], ["jsonl:path=x"], n, fmt, seed=1)
        assert sinks.replay(["--from-manifest", f"{out}/manifest.json", "--seed", "2"]) == ["mix", "--seed", "1", "--seed", "2"]
        assert "jsonl" in sinks.dataset_card(m)
    assert "unknown" in sinks.dataset_card({})
    sinks.write_eval_tsv(rows, str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).count() == rows.count()
    sinks.write_detections(dt.detect(rows, noisy()), str(tmp_path / "d"))
    kept = rows.where("lang = 'eng'")
    sinks.write_cleaned(kept, rows.where("lang <> 'eng'"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c/kept")).count() == rows.count()


def test_stream(spark, tmp_path):
    from tonguemill.streaming.detect import start_histogram, text_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("こんにちは\n12345\nこん\n", encoding="utf-8")
    q = start_histogram(text_stream(spark, str(tmp_path / "in")), noisy(), "langs_seen", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert {r.lang: r.n for r in spark.table("langs_seen").collect()} == {"jpn": 2, "und": 1}


# -- larger tables


def test_keys_for_the_spread_travel_in_packed_pieces(monkeypatch):
    monkeypatch.setattr(train, "HELD_KEYS", 5000)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(200)) for _ in range(40)] + [None, "", "one"]
    monkeypatch.setattr(dt, "BATCH_BYTES", 4000)
    got = list(train.packed_keys(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    assert len(got) > 3 and all(sum(len(k) for k in b.column(1).to_pylist()) < 8 * 25_000 for b in got)
    with np.errstate(over="ignore"):
        keys = [np.frombuffer(k, np.uint64) for b in got for k in b.column(1).to_pylist()]
        assert set((np.concatenate(keys) * train._BACK).tolist()) == set(train.features.text_keys(pa.array(texts))[0].tolist())
    assert all((k >> np.uint64(52) == part).all() for b in got for part, k in zip(b.column(0).to_pylist(), (np.frombuffer(k, np.uint64) for k in b.column(1).to_pylist())))


def test_spread_of_all_hashes_by_brute_force(spark):
    rows = spark.createDataFrame([("kot pies kot",), ("dom kot",), (None,), ("",)], "text string").repartition(3)
    keys = np.unique(train.features.text_keys(pa.array(["kot pies kot", "dom kot"]))[0])
    for w, got in train.hash_spreads(rows, 6).items():
        o = np.bincount(train.features.hashing.buckets(keys, 6, w)[0], minlength=64)
        assert got == pytest.approx(((o**2).sum() / (o.sum() / 64) - o.sum()) / 63, rel=1e-12)
    assert set(train.hash_spreads(rows.limit(0), 6).values()) == {0.0}


@pytest.mark.parametrize("options", [{"budget": 5}, {"budget": 40, "expose_top": 30}, {"budget": 30, "min_gain": 3, "min_df": 4}])
def test_distributed_coverage_takes_what_one_process_takes(spark, monkeypatch, options):
    rng = random.Random(5)
    pool = []
    for lang, n, letters in (("a", 400, "abcdefghijklmnop"), (None, 150, "xyz"), ("b", 1, "q")):
        for i in range(n):
            w = [rng.choice(letters) * rng.randint(1, 7) + rng.choice("st ").strip() for _ in range(rng.choice([0, 3, 6, 12, 45]))]
            pool.append((lang, rng.randrange(-(1 << 62), 1 << 62), " ".join(w), w))
    want = set()
    for lang in {r[0] for r in pool}:
        mine = sorted((r for r in pool if r[0] == lang), key=lambda r: r[1])
        want |= {(lang, mine[i][1], mine[i][2], k) for k, i in enumerate(select.Coverage(**options).select([r[2] for r in mine], [r[3] for r in mine]))}
    rows = spark.createDataFrame(pool, "lang string, row_id bigint, text string, lemmas array<string>").repartition(5)
    plan = select.select_coverage(rows, **options)
    assert {tuple(r) for r in plan.collect()} == want
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()  # no language is held by one task as a whole


def brute_runs(texts, k):
    lists = [[w for w in (t or "").split(" ") if any(c.isalpha() for c in w)] for t in texts]
    return [(i, " ".join(w[j : j + k])) for i, w in enumerate(lists) for j in range(len(w) - k + 1)]


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("collide", [False, True])
def test_runs_are_counted_by_ranges(monkeypatch, k, collide):
    from collections import Counter

    from tonguemill.functions import fragments

    monkeypatch.setattr(fragments, "HELD_RUNS", 200)
    monkeypatch.setattr(fragments, "PIECE_BYTES", 400)
    if collide:
        monkeypatch.setattr(fragments, "_hash", lambda words: np.zeros(len(words), np.uint64))
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ein", "zwei", "3", "...", "été", "x" * 30, "б"]) for _ in range(rng.randint(0, 30))) for _ in range(120)] + [None, "", "a a a a"]
    langs_ = [rng.choice(["de", None, "", "a\nb", "1"]) for _ in texts]
    sent = list(fragments.packed_runs(k)(iter([pa.RecordBatch.from_arrays([pa.array(langs_, pa.string()), pa.array(texts)], ["lang", "text"])])))
    assert len(sent) > 2  # never all at once
    back = pa.Table.from_batches(sent).sort_by("part").combine_chunks().to_batches()
    got = Counter()
    for b in fragments._counted("lang")(iter(back)):
        for lang, run, n in zip(*(b.column(c).to_pylist() for c in range(3))):
            assert (lang, run) not in got
            got[lang, run] = n
    assert got == Counter((langs_[i], run) for i, run in brute_runs(texts, k))


def test_ladder_tells_no_fragments_apart_by_a_shuffle(spark):
    rows = spark.createDataFrame([("deu", "ein haus ein haus"), (None, "x y"), ("fra", None)], "lang string, text string")
    out = metrics.ladder(rows, lambda d: d.withColumn("pred", F.when(F.col("text").contains("haus"), "deu")))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # before: one for all fragments as well
    assert {(r.n, r.gold, r.ok, r.n_rows) for r in out.collect()} == {(0, "deu", 1, 1), (0, None, 1, 1), (0, "fra", 0, 1), (1, "deu", 2, 4), (1, None, 2, 2), (2, "deu", 3, 3), (2, None, 1, 1), (3, "deu", 2, 2)}


def test_stratified_cap_reads_its_rows_once(spark):
    rng = random.Random(6)
    data = [(lang, split, "".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 40)))) for lang, n in (("a", 300), ("b", 5), (None, 90)) for split in ("train", "test") for _ in range(n)]
    data = list(dict.fromkeys(data))
    d = spark.createDataFrame(data, "lang string, split string, text string").repartition(4)
    got = mix.cap_stratified(d, 20, 0.3, seed=7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan ExistingRDD") == 1
    import hashlib

    key = lambda r: hashlib.md5("\x1f".join(["7", *[x for x in (r[0], r[2]) if x is not None]]).encode()).hexdigest()
    want = set()
    for g in {(r[0], r[1]) for r in data}:
        mine = sorted((r for r in data if (r[0], r[1]) == g), key=key)
        short, long = ([r for r in mine if (len(r[2]) <= 19) == s] for s in (True, False))
        s = min(len(short), 6)
        want |= set(mine) if len(mine) <= 20 else {*short[: s + max(0, 20 - s - len(long))], *long[: 20 - s]}
    assert {tuple(r) for r in got.collect()} == want and got.columns == d.columns


def test_letters_are_counted_in_pieces(monkeypatch):
    from tonguemill.functions import scripts

    monkeypatch.setattr(scripts, "PIECE_BYTES", 64)
    seen = []
    piece = scripts._count_piece
    monkeypatch.setattr(scripts, "_count_piece", lambda t, *a: (seen.append((len(t), t.nbytes)), piece(t, *a)))
    rng = random.Random(8)
    texts = ["".join(rng.choice("aZé ßжЎ漢かアकع9😀ſ") for _ in range(n)) for n in (0, 1, 5, 40, 700, 3, 2000, 9)] + [None]
    texts = pa.array([*texts, *texts[:4] * 20]).slice(1)
    got = scripts.letter_counts(texts)
    assert got.tolist() == [[scripts.count(t or "", s) for s in scripts._ORDER] for t in texts.to_pylist()]
    assert len(seen) > 10
    own = scripts.kinds("a-z", r"éß\x{0416}-\x{0436}")
    assert scripts.letter_counts(texts, own, 2).tolist() == [[sum("a" <= c <= "z" for c in t or ""), sum(c in "éß" or "Ж" <= c <= "ж" for c in t or "")] for t in texts.to_pylist()]


def test_letter_columns_keep_null(spark):
    from tonguemill.functions import scripts

    rows = spark.createDataFrame([("aé",), (None,), ("",)], "text string").select(scripts.letters("text", first="a", second="é").alias("n"), scripts.route_column("text").alias("r"))
    assert [(r.n and tuple(r.n), tuple(r.r)) for r in rows.collect()] == [((1, 1), ("latin", None)), (None, ("unknown", None)), ((0, 0), ("unknown", None))]


def test_token_numbers_are_the_native_ones(spark):
    texts = ["a bc def #x # @me you@x.de www.a.b 12 3.4 İstanbul ΟΔΟΣ x.y x\x1cy", None, "", "   ", "#", "é" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(tx.token_count("text").alias("a"), dt.token_numbers("text").alias("b"))
    assert all(r.a == r.b for r in rows.collect())


def test_hygiene_verdicts_come_of_one_pass(spark, sf):
    from tonguemill.plans.queries import QUERIES

    assert QUERIES["hygiene"](spark, sf)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


@pytest.mark.parametrize("name", ["script_counts", "token_count", "scripted_routes", "scripted_letters"])
def test_letters_and_tokens_use_no_regular_expressions(spark, sf, name):
    from tonguemill.plans.queries import QUERIES

    assert "regexp" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().lower()


def test_detection_looks_at_a_piece_at_a_time(monkeypatch):
    m = noisy()
    rng = random.Random(9)
    texts = pa.array([" ".join("".join(rng.choice("abcdeжзи") for _ in range(rng.randint(1, 8))) for _ in range(20)) for _ in range(60)] + [None, "", "漢字"])
    want = dt._detected(texts, m, dt.Words(m, m.doubled()), False)
    monkeypatch.setattr(dt, "BATCH_BYTES", 600)
    monkeypatch.setattr(dt, "WORDS_AT_ONCE", 7)
    sizes, routes, table = [], dt.scripts.routes, dt.features.word_table
    monkeypatch.setattr(dt.scripts, "routes", lambda t: (sizes.append(len(t)), routes(t))[1])
    monkeypatch.setattr(dt.features, "word_table", lambda w, *a: (sizes.append(len(w)), table(w, *a))[1])
    known = dt.Words(m, m.doubled())
    got = dt._detected(texts, m, known, False)
    assert max(sizes) < 20 and all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(got, want))
    monkeypatch.setattr(dt, "KNOWN", 50)
    few = dt.Words(m, m.doubled())
    assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(dt._detected(texts, m, few, False), want)) and few.sums.shape[1] < 2000
