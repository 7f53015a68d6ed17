"""Trained operators by held-out accuracy, the registered queries and the pipeline."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postflow.llm import byte_cnn, language_id, queries

SMALL = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


# ---- op9 ----

def test_chunks_change_no_score(monkeypatch):
    net, r = byte_cnn.Net.fresh(1), np.random.default_rng(1)
    texts = ["", "a", "é" * 7, *("".join(chr(c) for c in r.integers(32, 300, n)) for n in (11, 12, 13, 63, 64, 65, 150, 1001))]
    whole = [byte_cnn.score(net, t) for t in texts]
    for chunk in (14, 32, 100):
        monkeypatch.setattr(byte_cnn, "CHUNK", chunk)
        assert np.allclose([byte_cnn.score(net, t) for t in texts], whole)
    plain = []
    for t in texts:
        data = byte_cnn.padded(np.frombuffer(t.encode(), np.uint8))
        best = [max(float(net.embedding[data[k:k + 12]].reshape(-1) @ net.filters[:, f]) for k in range(0, len(data) - 11, byte_cnn.STRIDE)) for f in range(byte_cnn.FILTERS)]
        plain.append(1 / (1 + np.exp(-(np.maximum(np.array(best) + net.bias, 0) @ net.out + net.out_bias))))
    assert np.allclose(plain, whole, atol=1e-5)


def test_gradients_equal_finite_differences(monkeypatch):
    """Against a loss written out over all windows of whole texts, each longer than a chunk or shorter than a window."""
    monkeypatch.setattr(byte_cnn, "CHUNK", 40)
    r = np.random.default_rng(4)
    net = byte_cnn.Net.fresh(3)
    for k, v in vars(net).items():
        setattr(net, k, np.asarray(v, np.float64) if k != "out_bias" else 0.1)
    net.bias = r.normal(0, 0.3, byte_cnn.FILTERS)
    texts = [r.integers(0, 256, n).astype(np.uint8) for n in (0, 5, 30, 41, 90, 300)]
    labels, weight = np.array([0, 1, 1, 0, 1, 0.0]), np.array([1, 2, 1, 3, 1, 1.5])

    def loss():
        total = byte_cnn.DECAY / 2 * float(net.out @ net.out)
        for t, y, w in zip(texts, labels, weight):
            data = byte_cnn.padded(t)
            tops = np.max([net.embedding[data[k:k + 12]].reshape(-1) @ net.filters for k in range(0, len(data) - 11, byte_cnn.STRIDE)], 0)
            p = 1 / (1 + np.exp(-(np.maximum(tops + net.bias, 0) @ net.out + net.out_bias)))
            total -= w * np.log(p if y else 1 - p) / len(texts)
        return total

    found = byte_cnn.gradients(net, texts, labels, weight)
    for name in ("embedding", "filters", "bias", "out"):
        values, got = getattr(net, name), found[name]
        for at in [tuple(r.integers(0, n) for n in values.shape) for _ in range(25)]:
            kept, values[at] = values[at], values[at] + 1e-6
            more = loss()
            values[at] = kept - 1e-6
            slope, values[at] = (more - loss()) / 2e-6, kept
            assert got[at] == pytest.approx(slope, abs=2e-5)


def test_the_sample_keeps_whole_texts_within_its_bound(spark, monkeypatch):
    monkeypatch.setattr(byte_cnn, "PER_CLASS_BYTES", 1_000)
    docs = spark.createDataFrame([(k, "ä" * (200 if k % 3 else 900)) for k in range(60)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    rows = byte_cnn.sample(docs, labels, 50).collect()
    for kind in (0, 1):
        sizes = [len(r["text"].encode()) for r in rows if r["quality"] == kind]
        assert sizes and set(sizes) <= {400, 1800} and (sum(sizes) <= 1_000 or len(sizes) == 1)


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = byte_cnn.report(docs, labels).join(labels, "doc_id").collect()
    late = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in late]) >= 0.93


def test_classifier_odd_rows(spark, docs, clashing, none):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 0), (9, 0, 1), (8, None, 0), (None, 1, 0), (5, 1, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    assert byte_cnn.report(docs, labels).count() == byte_cnn.report(clashing, labels).count() == docs.count()
    assert {r["score"] for r in byte_cnn.report(docs, labels.where("1 = 0")).collect()} == {0.5}
    assert {r["score"] for r in byte_cnn.report(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert byte_cnn.report(none, labels).count() == 0 and byte_cnn.keep(clashing, labels).columns == clashing.columns


# ---- op10 ----

def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = language_id.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    late = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in late]) >= 0.98


def test_counts_equal_a_plain_count(monkeypatch):
    monkeypatch.setattr(language_id, "PART", 50)

    def plain(text):
        text, total = re.sub(r"\d+", "0", re.sub(r"\s+", " ", f" {text.lower()} ")), {}
        for k in range(len(text)):
            code = 0
            for n in (1, 2, 3):
                if k + n <= len(text):
                    code = (code * 0x01000193 % 2**32) ^ ord(text[k + n - 1])
                    bucket = ((code + n) * 0x9E3779B1 % 2**32) >> 17
                    total[bucket] = total.get(bucket, 0) + 1
        return total

    for text in ("", "a", "Grüße 12 345!", "x y" * 30, "lang " * 2000):
        at, n = language_id.counts(text)
        assert dict(zip(at.tolist(), n.tolist())) == plain(text)


def test_temperature_calibrates():
    r = np.random.default_rng(2)
    z = r.normal(size=(4000, 3)) * 2
    labels = np.array([r.choice(3, p=p) for p in language_id._softmax(z)])
    assert language_id.temperature(z * 4, labels) == pytest.approx(4, rel=0.15)


def test_training_equals_a_dense_plain_regression(monkeypatch):
    monkeypatch.setattr(language_id, "BUCKETS", 7)
    r = np.random.default_rng(5)
    rows = []
    for _ in range(30):
        at = np.sort(r.choice(7, r.integers(1, 5), replace=False))
        rows.append((at, r.normal(1, 0.5, len(at))))
    labels = r.integers(0, 3, 30)
    weight, bias = language_id.train(rows, labels, 3, epochs=2, alpha=0.4, beta=0.8, l1=0.5, l2=0.01, seed=6)
    z, n = [[0.0] * 3 for _ in range(8)], [[0.0] * 3 for _ in range(8)]

    def plain(i, k):
        l1 = 0.5 if i < 7 else 0.0
        if abs(z[i][k]) <= l1:
            return 0.0
        return -(z[i][k] - (l1 if z[i][k] > 0 else -l1)) / ((0.8 + n[i][k] ** 0.5) / 0.4 + 0.01)

    order = np.random.default_rng(6)
    for _ in range(2):
        for row in order.permutation(30):
            x = np.zeros(8)
            x[rows[row][0]], x[7] = rows[row][1], 1
            w = [[plain(i, k) for k in range(3)] for i in range(8)]
            e = np.exp([sum(x[i] * w[i][k] for i in range(8)) for k in range(3)])
            for i in range(8):
                for k in range(3):
                    g = x[i] * (e[k] / e.sum() - (labels[row] == k))
                    z[i][k] += g - ((n[i][k] + g * g) ** 0.5 - n[i][k] ** 0.5) / 0.4 * w[i][k]
                    n[i][k] += g * g
    assert np.allclose(weight, [[plain(i, k) for k in range(3)] for i in range(7)]) and np.allclose(bias, [plain(7, k) for k in range(3)])
    assert (weight == 0).any()  # the elastic net leaves some out


def test_many_languages_and_repeated_ids(spark):
    """More values of lang than any bound on them before; one id on many rows is one text of the sample."""
    rows = [(k, f"text {k} of {chr(97 + k % 26) * 4}", f"l{k % 600}") for k in range(1_300)] + [(5_000, "the same row", "l0")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.languages) > 500 and model.weight.shape[1] == len(model.languages)
    assert model.predict("text 7 of hhhh")[0] in model.languages


def test_language_odd_rows(docs, clashing, none):
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.report(docs).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (10, "und")} <= got
    assert language_id.report(clashing).count() == docs.count() and language_id.report(none).count() == 0
    assert {r["lang_pred"] for r in language_id.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r["lang_pred"] for r in language_id.report(docs.withColumn("lang", F.lit("aa"))).collect()} == {"aa", "und"}


# ---- queries and pipeline ----

def test_all_queries_are_registered():
    import __spark_entry__ as entry

    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())


def test_pipeline_equals_its_parts_in_plain_python(spark):
    """run() against a plain version of every stage's decision on the smallest tables."""
    import corpus_pipeline as p
    import tiktoken  # noqa: F401
    from postflow.llm import quality_rules, secret_scan, simhash
    from postflow.llm.encoders import byte_encoder

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    text = {r["doc_id"]: r for r in docs.collect()}
    stay = {r["doc_id"] for r in quality_rules.report(docs).where("kept").collect()}
    net = byte_cnn.fit(docs, labels)
    assert not isinstance(net, float)
    stay = {i for i in stay if byte_cnn.score(net, text[i]["text"]) >= 0.3}
    prints = {i: simhash.fingerprint(text[i]["text"]) for i in stay}
    words = {i: text[i]["text"].lower().split() for i in stay}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    group = {i: i for i in stay}
    for a in sorted(stay):
        for b in sorted(i for i in stay if i < a):
            alike = bool(sets[a]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
            if alike or (prints[a] ^ prints[b]).bit_count() <= 3:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    stay = sorted(set(group.values()))
    plain, want = byte_encoder(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern()), {}
    for i in stay:
        out, end = [], 0
        for start, rule, stop in secret_scan.spans_of([text[i]["text"]], secret_scan.RULES)[0]:
            if start >= end:
                out += [text[i]["text"][end:start], f"[{secret_scan.RULES[rule].kind}]"]
            end = max(end, stop)
        want[i] = [*plain.plain("".join(out) + text[i]["text"][end:]), 2]
    got = {}
    for r in sorted(p.run(spark, path).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == want and [n for n, _ in p.STAGES] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "secret_scan", "best_fit_packing"]


def test_stages_keep_the_columns_of_documents(spark, clashing, none):
    import corpus_pipeline as p

    for _, stage in p.STAGES[:-1]:
        assert stage(spark, clashing, SMALL).columns == clashing.columns
        assert stage(spark, none, SMALL).count() == 0
