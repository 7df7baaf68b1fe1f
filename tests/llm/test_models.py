"""op2, op4, op7, op8 and the pipeline: oracle, held-out accuracy, planted cases."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import langid, mixing, quality, toxicity
from tessella.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def auc(y, s):
    _, inverse, count = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    p = y == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_op2_oracle(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(ORACLES["op2_mix_sources"]).df()
    got = QUERIES["op2_mix_sources"](spark, SF).toPandas()
    key = ["doc_id", "mix_copy"]
    columns = sorted(want.columns)
    assert got.sort_values(key)[columns].reset_index(drop=True).equals(want.sort_values(key)[columns].reset_index(drop=True))


def test_op2_weights(spark, monkeypatch):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    weights = {"hot": 1.0, "s0": 1.0, "s1": 40.0}
    monkeypatch.setattr(mixing, "PIECE", 2.0)  # rates above it are sums of draws
    got = {r["source"]: r["n"] for r in mixing.mix(docs, weights).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(weights.values())
    assert set(got) == set(weights)
    for s, w in weights.items():
        assert got[s] == pytest.approx(40_000 * w / total, rel=0.1)
    one = Counter(map(tuple, mixing.replicate(docs, mixing.source_rates(docs, weights)).select("doc_id", "mix_copy").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    two = Counter(map(tuple, mixing.replicate(docs, mixing.source_rates(docs, weights)).select("doc_id", "mix_copy").collect()))
    assert one == two


def test_op2_is_poisson(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("s").alias("source"))
    counts = [r["n"] for r in mixing.mix(docs, target_chars=20_000 * 3 * 2.5).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()]
    n = np.array(counts + [0] * (20_000 - len(counts)))
    assert n.mean() == pytest.approx(2.5, abs=0.05) and n.var() == pytest.approx(2.5, abs=0.1)


def test_op2_cases(docs, empty, clashing, rows):
    assert mixing.mix(empty).count() == 0
    assert set(mixing.mix(docs).columns) == {"doc_id", "text", "lang", "source", "n_chars", "mix_rate", "mix_copy", "mix_order"}
    a = mixing.mix(clashing)
    assert a.columns.count("mix_copy") == 1 and a.columns.count("mix_rate") == 1
    assert a.count() == mixing.mix(docs).count()


def test_op2_null_and_repeated_ids(spark):
    """Rows without an id, or with one id, draw each for themselves and spread over the partitions."""
    docs = spark.range(20_000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 2 * 7 + F.when(F.col("id") % 5 == 1, F.col("id")).otherwise(0)).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs, {"a": 1.0, "b": 3.0})
    n = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert n["b"] / n["a"] == pytest.approx(3, rel=0.05)
    places = got.where("doc_id IS NULL").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("mix_order").alias("places")).first()
    assert places["n"] > 3000 and places["places"] == places["n"]
    counts = got.where("doc_id = 7").groupBy("text").count().collect()
    assert len({r["count"] for r in counts}) > 1


def test_op2_equal_rows_without_id(spark):
    """Rows that are equal in all draw each for themselves: their counts follow the Poisson distribution and their copies spread."""
    docs = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one line that the whole crawl holds").alias("text"), F.lit("a").alias("source"), F.lit(1).alias("_at"), F.lit(2).alias("_cut"))
    docs = docs.unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("other "), F.col("id").cast("string")).alias("text"), F.lit("b").alias("source"), F.lit(1).alias("_at"), F.lit(2).alias("_cut")))
    rates = mixing.source_rates(docs, {"a": 1.0, "b": 1.0}).collect()
    rate = {r["source"]: r["rate"] for r in rates}["a"]
    got = mixing.mix(docs, {"a": 1.0, "b": 1.0}).where("source = 'a'")
    n = got.count()
    assert n == pytest.approx(6000 * rate, rel=0.05)
    assert got.select("mix_order").distinct().count() == n
    first = got.where("mix_copy = 0").count() / 6000
    assert first == pytest.approx(1 - np.exp(-rate), abs=0.03)
    assert got.select(F.pmod(F.hash("mix_order"), F.lit(8)).alias("p")).distinct().count() == 8


def test_op4_needs_a_letter(spark):
    """Marks, digits and signs alone are no language, whatever marks a language uses; a letter with marks is."""
    d = langid.learn(table(spark, "documents"))
    texts = ["\u0301\u0300 12", "\u0301", "\u064e\u064f .", "1 2 3 \U0001f642", "_-!", "e\u0301", "日"]
    got = [r["lang_pred"] for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), d).orderBy("doc_id").collect()]
    assert got[:5] == ["und"] * 5 and "und" not in got[5:]


def test_op4(spark):
    got = QUERIES["op4_language_id"](spark, SF).join(table(spark, "documents"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang == held.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all() and got.accepted.mean() >= 0.97
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out, strict=True))


def test_op4_cases(spark, docs, empty, clashing, rows):
    d = langid.learn(table(spark, "documents"))
    got = langid.identify(docs, d).collect()
    assert len(got) == len(rows)
    bare = [t for _, t, *_ in rows if t is None or not any(c.isalpha() for c in t)]
    assert sum(r["lang_pred"] == "und" for r in got) == len(bare)
    assert langid.identify(empty, d).count() == 0 and langid.learn(empty) == {}
    assert all(r["lang_pred"] == "und" for r in langid.identify(docs, {}).collect())
    assert set(langid.keep_identified(clashing, d).columns) == set(clashing.columns)


def test_op4_by_hand(spark):
    """Judgements against plain coding of every text with every dictionary."""
    import regex
    import zstandard as z

    d = langid.learn(table(spark, "documents"))
    how = {k: z.ZstdCompressionParameters.from_level(langid.LEVEL, dict_size=len(v), source_size=langid.PIECE, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False) for k, v in d.items()}
    texts = [r["text"] for r in table(spark, "documents").limit(150).collect()] + ["The", "x y", "ein ein ein", "123", None, "zqx wvk jjh"]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), d).orderBy("doc_id").collect()
    for text, r in zip(texts, got, strict=True):
        words = regex.findall(r"[\p{L}\p{M}]+", (text or "").lower())
        words = [w for i, w in enumerate(words) if i == 0 or w != words[i - 1]]
        raw = " ".join(words).encode()
        if not raw:
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
            continue
        size = {}
        for lang, content in d.items():
            coder = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how[lang])
            size[lang] = sum(len(coder.compress(raw[i : i + langid.PIECE])) for i in range(0, len(raw), langid.PIECE))
        order = sorted(size, key=size.get)  # ties: the language with more training documents comes first in d
        assert r["lang_pred"] == order[0]
        margin = (size[order[1]] - size[order[0]]) / size[order[1]]
        assert r["margin"] == pytest.approx(margin) and r["accepted"] == (margin >= langid.MARGIN)


def test_op4_ties_and_margins():
    same = {"aa": b"the same words in both " * 50, "bb": b"the same words in both " * 50}
    lang, score, margin = langid.Coder(same).judge(b"the same words")
    assert lang == "aa" and margin == 0.0 and score == pytest.approx(0.5)


def test_quality_forward_is_a_convolution():
    """Against filters over embedded bytes, chunk by chunk."""
    rng = np.random.default_rng(3)
    p = quality.initial(rng)
    p["fb"], p["b1"] = rng.normal(0, 0.3, quality.FILTERS), rng.normal(0, 0.3, quality.HIDDEN)
    tables = np.einsum("se,jef->jsf", p["e"], p["f"]).astype(np.float32)
    model = quality.Model(tables, p["fb"].astype(np.float32), p["w1"], p["b1"], p["w2"], 0.25)
    texts = [b"", b"short", bytes(rng.integers(0, 256, 31).tolist()), bytes(rng.integers(0, 256, 32).tolist()), bytes(rng.integers(32, 127, 333).tolist()), "Größe und naïveté. ".encode() * 20]
    joined, _ = quality.padded(texts)
    at = 0
    for text, got in zip(texts, quality.forward(model, texts), strict=True):
        halves = max(1, -(-len(text) // quality.HALF))
        code = joined[at : at + halves * quality.HALF + quality.WIDTH]  # a filter at the end of a text sees what follows in the batch
        at += halves * quality.HALF
        emb = p["e"][code]
        conv = np.array([np.einsum("je,jef->f", emb[i : i + quality.WIDTH], p["f"]) for i in range(0, halves * quality.HALF, quality.STRIDE)]) + p["fb"]
        each = quality.HALF // quality.STRIDE
        chunks = [conv[each * i : each * (i + 2)] for i in range(max(1, halves - 1))]
        unit = np.array([np.tanh(np.maximum(c.max(axis=0), 0) @ p["w1"] + p["b1"]) for c in chunks])
        z = np.concatenate([unit.mean(axis=0), unit.max(axis=0)]) @ p["w2"] + 0.25
        assert got == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-3, abs=1e-4)


def test_quality_gradients():
    """Derivatives against differences."""
    rng = np.random.default_rng(4)
    p = {k: v.astype(float) for k, v in quality.initial(rng).items()}
    texts = [bytes(rng.integers(97, 123, n).tolist()) for n in (5, 64, 200, 330)]
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])
    _, g = quality.gradients(p, texts, y, weight)
    for k in ("f", "e", "fb", "w1", "b1", "w2", "b2"):
        order = np.argsort(-np.abs(g[k]).ravel())[:4]
        for i in order.tolist():
            here = np.unravel_index(i, p[k].shape)
            was, side = p[k][here], []
            for step in (1e-4, -1e-4):
                p[k][here] = was + step
                side.append(quality.gradients(p, texts, y, weight)[0])
            p[k][here] = was
            assert (side[0] - side[1]) / 2e-4 == pytest.approx(g[k][here], rel=0.05, abs=1e-4)


def test_toxicity_is_a_noisy_or():
    """Scores against a loop over sentences and words."""
    import math
    import re

    from tessella.llm.textkernel import Scan

    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["badword", "awful", "damnit"]
    say = lambda bad: " ".join(rng.choice(vocabulary[:60], 6)) + (f" {rng.choice(vocabulary[60:])}" if bad else "") + rng.choice([".", "!", "?", "\n"])
    sample = [(" ".join(say(i % 2 and j == 2) for j in range(5)), i % 2) for i in range(300)]
    model = toxicity.train(sample, {0: 150, 1: 150})
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    texts = [t for t, _ in sample[:60]] + ["", "\n \n", "x", "a b. c d!", "é badword, ü. w1 w2? damnit! (awful)"]
    got, spans = toxicity.score(model, [t.encode() for t in texts])
    for text, p, found in zip(texts, got, spans, strict=True):
        instances, want = {}, []
        # a sentence ends at a word that ends in . ! ?, and at a line break
        pieces, now = [], []
        for m in re.finditer(r"[^\x20\x09-\x0D]+|\n", text):
            if m.group() == "\n":
                if now:
                    pieces.append(now)
                    now = []
                continue
            now.append(m)
            if m.group()[-1] in ".!?":
                pieces.append(now)
                now = []
        if now:
            pieces.append(now)
        for words in pieces:
            held = [k for m in words for k in toxicity.features(Scan([m.group().encode()])).ravel().tolist() if k in weights]
            z = model.bias + sum(weights[k] for k in held)
            instances[tuple(sorted(held))] = math.log1p(math.exp(z))
            if z >= 0:
                want.append((words[0].start(), words[-1].end()))
        assert p == pytest.approx(1 - math.exp(-sum(instances.values())), abs=1e-9)
        assert [x[:2] for x in found] == want


@pytest.mark.parametrize("module,label,threshold,least", [(quality, "quality", 0.3, 0.95), (toxicity, "toxic", 0.5, 0.85)])
def test_classifiers(spark, module, label, threshold, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    model = module.learn(docs, labels)
    got = module.classify(docs.join(labels.select("doc_id"), "doc_id"), model).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert held.score.between(0, 1).all() and ((held.score >= threshold).astype(int) == held.predicted).all()
    assert auc(held[label].to_numpy(), held.score.to_numpy()) >= least
    assert (held.predicted == held[label]).mean() >= 0.95
    clean = held[held[label] == (0 if label == "toxic" else 1)]
    assert (clean.predicted == clean[label]).mean() >= 0.98


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_cases(spark, docs, empty, clashing, rows, module):
    labels = spark.createDataFrame([(r[0], i % 2, i % 2) for i, r in enumerate(rows)] + [(None, 1, 1), (10**9, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = module.learn(clashing, labels)
    got = module.classify(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert module.classify(empty, model).count() == 0
    assert module.classify(clashing, model).columns == module.classify(docs, model).columns
    assert sorted(r["score"] for r in module.classify(clashing, model).collect()) == sorted(r["score"] for r in got)
    none = module.learn(docs, labels.limit(0))
    assert len({r["score"] for r in module.classify(docs, none).collect()}) == 1


def test_offending_sentences():
    clean = "The sky is blue today. We walk home.\nAll is well."
    sample = [(clean + f" Note {i}.", 0) for i in range(40)] + [(clean + f" You are an awful badword{i % 2}! Bye {i}.", 1) for i in range(40)]
    model = toxicity.train(sample, {0: 40, 1: 40})
    text = "Good morning. É you awful badword1, go.\nThe sky is blue."
    p, spans = toxicity.score(model, [text.encode(), clean.encode(), b""])
    assert p[0] > 0.5 > p[1] and p[2] == 0
    assert [text[a:b] for a, b, _ in spans[0]] == ["É you awful badword1, go."] and not spans[1]


def test_toxicity_does_not_grow_with_length():
    clean = "The sky is blue today. We walk home.\nAll is well."
    sample = [(clean + f" Note {i}.", 0) for i in range(40)] + [(clean + f" You are an awful badword{i % 2}! Bye {i}.", 1) for i in range(40)]
    model = toxicity.train(sample, {0: 40, 1: 40})
    p, _ = toxicity.score(model, [("All is well. " * 20_000).encode(), ("All is well. " * 20_000 + "You are an awful badword1!").encode()])
    assert p[0] < 0.5 < p[1]


def test_toxicity_repeated_evidence():
    """A weakly weighted sentence that clean documents hold too adds nothing by repetition, in training as in scores."""
    sample = [("All is well." + " Some mildly words." * (i % 4 == 0), 0) for i in range(80)] + [("All is well. Some mildly words. You awful badword!", 1) for _ in range(80)]
    model = toxicity.train(sample, {0: 80, 1: 80})
    p, _ = toxicity.score(model, [("Some mildly words. " * 20_000).encode(), b"All is well. You awful badword!"])
    assert p[0] < 0.5 < p[1]


def test_toxicity_reads_whole_texts(spark):
    filler = "The sky is blue today. We walk home.\n" * 300
    rows = [(i, filler + (f"You are an awful badword{i % 3}!" if i % 2 else "All is well.")) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    p, _ = toxicity.score(model, [t.encode() for _, t in rows], spans=False)
    assert ((p >= 0.5) == np.array([i % 2 == 1 for i, _ in rows])).all()


def test_pipeline(spark):
    docs = table(spark, "documents")
    columns = docs.columns
    numbers = [n for n, _ in corpus_pipeline.STAGES]
    assert numbers == ["toxicity", "language", "near_duplicates", "mixing", "packing"]
    toxic = {r["doc_id"] for r in table(spark, "labels").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == columns
        before_ids, ids = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (docs, after))
        assert ids <= before_ids
        if name == "toxicity":
            dropped = before_ids - ids
            assert dropped and len(dropped & toxic) >= 0.6 * len(toxic)
        if name in ("toxicity", "language"):
            assert len(ids) >= 0.85 * len(before_ids)
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_stages_on_empty_tables(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_stages_on_ties(spark, tmp_path):
    """Equal texts, ids and sources: nothing clean goes but copies."""
    text = [r["text"] for r in table(spark, "documents").where("lang = 'en' AND n_chars > 300").orderBy("doc_id").limit(3).collect()]
    rows = [(i % 2, text[i % 3], "en", "s", 5) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).count() == 30
    kept = corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path)).collect()
    assert sorted(r["text"] for r in kept) == sorted(text) and {r["doc_id"] for r in kept} == {0}
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert sum(r["piece"] == 0 for r in packed) == 30


def test_pipeline_on_odd_documents(spark, clashing, tmp_path):
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out
