"""Language-model scores, importance resampling and fill-in-the-middle against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postflow.llm import fill_middle, importance_resampling as ir, interpolated_lm as lm
from postflow.llm.tables import packed, unpacked

SMALL = "/root/testdata/sf0.01"


def any_order(rows):
    return sorted(map(tuple, rows), key=repr)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ---- op11 ----

def plain_scores(rows, learned, deleted, order, rounds=lm.ROUNDS):
    """{row: (n_tokens, n_known, N, base, score)} with dictionaries and loops."""
    texts = [[w for w in re.split(r"[\x20\x09-\x0D]+", lower(t or "")) if w] + [" "] for t in rows]

    def counts(chosen):
        total, starts = [Counter() for _ in range(order)], 0
        for k in chosen:
            starts += 1
            padded = [None] * (order - 1) + texts[k]
            for j in range(order - 1, len(padded)):
                for n in range(order):
                    total[n][tuple(padded[j - n:j + 1])] += 1
        return total, starts

    def grams(k):
        padded = [None] * (order - 1) + texts[k]
        return [tuple(padded[j - order + 1:j + 1]) for j in range(order - 1, len(padded))]

    def parts(gram, table, tokens, starts):
        """[(estimate, class)] from order 1 up."""
        out = []
        for n in range(order):
            g = gram[order - 1 - n:]
            context = tokens if not n else starts if g[-2] is None else table[n - 1][g[:-1]]
            out.append((table[n][g] / context if context else 0.0, int(context).bit_length()))
        return out

    whole, starts = counts([k for k in range(len(rows)) if learned[k]])
    rest, rest_starts = counts([k for k in range(len(rows)) if learned[k] and not deleted[k]])
    tokens, distinct = sum(whole[0].values()), len(whole[0])
    uniform, weights = 1 / (distinct + 1), {}
    weight = lambda n, c: 0.0 if not c else weights.get((n, c), weights.get(n, lm.START))
    rest_tokens = sum(rest[0].values())
    late = Counter(g for k in range(len(rows)) if deleted[k] for g in grams(k))
    for _ in range(rounds):
        taken, reached = defaultdict(float), defaultdict(float)
        for gram, many in late.items():
            ps, ps_of = parts(gram, rest, rest_tokens, rest_starts), [uniform]
            for n, (f, c) in enumerate(ps):
                ps_of.append(weight(n, c) * f + (1 - weight(n, c)) * ps_of[-1])
            stay = many / ps_of[-1]
            for n in reversed(range(order)):
                f, c = ps[n]
                for key in ((n, c), n):
                    taken[key] += stay * weight(n, c) * f
                    reached[key] += stay * ps_of[n + 1]
                stay *= 1 - weight(n, c)
        if not late:
            break
        new = {k: min(max(taken[k] / reached[k], 1e-4), 1 - 1e-4) for k in reached if reached[k] > 1e-9}
        moved = max(abs(new[k] - weights.get(k, lm.START)) for k in new if isinstance(k, tuple) and k[1])
        weights = new
        if moved < lm.SETTLED:
            break
    out = []
    for k, text in enumerate(texts):
        score = 0.0
        for gram in grams(k):
            p = uniform
            for n, (f, c) in enumerate(parts(gram, whole, tokens, starts)):
                p = weight(n, c) * f + (1 - weight(n, c)) * p
            score += math.log10(p)
        known = [whole[0][(w,)] for w in text]
        out.append((len(text), sum(c > 0 for c in known), tokens, sum(math.log10((c + 1) / (tokens + distinct + 1)) for c in known), score))
    return out


def lm_rows(spark, docs):
    base = docs.withColumn("learned", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2)
    base = base.withColumn("learned", F.coalesce("learned", F.lit(True)))
    return base.withColumn("deleted", F.col("learned") & (F.pmod(F.xxhash64("doc_id"), F.lit(lm.DELETED)) == 0)).collect()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_a_plain_model(spark, docs, order, monkeypatch):
    r, words = random.Random(order), [f"w{k}" for k in range(30)]
    texts = [" ".join(r.choice(words[:3 + k % 28]) for _ in range(r.randint(0, 60))).title() for k in range(120)]
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(more).repartition(4)
    monkeypatch.setattr(lm, "RANGE", 20_000)
    monkeypatch.setattr(lm, "DELETED", 4)
    rows = lm_rows(spark, table)
    assert sum(x["deleted"] for x in rows) > 3
    want = plain_scores([x["text"] for x in rows], [x["learned"] for x in rows], [x["deleted"] for x in rows], order)
    want = sorted(((x["doc_id"], not x["learned"], *w) for x, w in zip(rows, want)), key=repr)
    got = sorted((tuple(x) for x in lm.report(table, order).collect()), key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9)


def test_small_blocks_change_no_score(docs, monkeypatch):
    learned = F.lit(True)
    whole = any_order(lm.fit_and_score(docs, learned).collect())
    monkeypatch.setattr(lm, "RANGE", 500)
    monkeypatch.setattr(lm.block, "__defaults__", (40,))
    assert np.allclose([x[1:] for x in any_order(lm.fit_and_score(docs, learned).collect())], [x[1:] for x in whole])


def test_interpolation_beats_the_base_score_on_held_out_texts(spark):
    rows = [x for x in lm.report(spark.read.parquet(f"{SMALL}/documents.parquet")).collect() if x["held_out"]]
    assert sum(x["score"] for x in rows) > sum(x["base_score"] for x in rows)


def test_expectation_maximisation_never_loses_likelihood():
    r = np.random.default_rng(3)
    f, c, n = r.random((2, 500)) * (r.random((2, 500)) < 0.7), r.integers(0, 5, (2, 500)).astype(np.uint8), r.integers(1, 9, 500).astype(float)
    f[c == 0] = 0
    weights, before = lm._held(np.full((2, lm.CONTEXTS), 0.5)), -np.inf
    for _ in range(20):
        now = float(n @ np.log(lm.mixed(f, c, weights, 0.01)[-1]))
        assert now >= before - 1e-9
        weights, before = lm.renewed(lm.expected(f, c, n, weights, 0.01)), now


def test_packed_numbers_come_back():
    for values in ([], [0], [255], [256, 1], [2**32, 7], [2**64 - 1, 0]):
        a = np.array(values, np.uint64)
        assert unpacked(packed(a), len(a)).tolist() == values


def test_lm_odd_rows(docs, clashing, none):
    assert lm.report(none).count() == 0
    assert any_order(lm.report(clashing).collect()) == any_order(lm.report(docs).collect())
    blank = lm.report(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert {x["n_tokens"] for x in blank} == {1} and len(blank) == docs.count()
    unlearned = lm.fit_and_score(docs, F.lit(False)).collect()
    assert {(x["n_known"], x["train_tokens"], x["base_score"], x["score"]) for x in unlearned} == {(0, 0, 0.0, 0.0)}


# ---- op12 ----

def plain_resample(rows, target, run=1, buckets=10_000, pct=10, least=20):
    def bag(text):
        words = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))]
        return len(words), [zlib.crc32(" ".join(words[k:k + n]).encode()) % buckets for n in range(1, run + 1) for k in range(len(words) - n + 1)]
    source = Counter(b for _, t in rows for b in bag(t)[1])
    aim = Counter(b for t in target for b in bag(t)[1])
    s_all, t_all = sum(source.values()), sum(aim.values())
    out = []
    for i, t in rows:
        n, found = bag(t)
        each = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in found]
        weight = sum(each) // len(each) if each else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[-1] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for place, x in enumerate(able[:pct * len(able) // 100]):
        x[4] = place + 1
    return [tuple(x[:5]) for x in out]


@pytest.mark.parametrize("pct, left", [(10, 4096), (50, 1), (100, 3), (0, 1)])
def test_resampling_equals_a_plain_draw(spark, docs, rows, pct, left):
    r = random.Random(4)
    each = [" ".join(r.choice(("Ant bee", "cat_dog", "é9")) for _ in range(r.randint(5, 40))) for _ in range(100)]
    more = [(2000 + k // 3, each[k // 3]) for k in range(300)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(5)
    target = spark.createDataFrame([("ant ant CAT",), (None,), ("",)], "text string")
    want = plain_resample([(i, t) for i, t, *_ in rows] + more, ["ant ant CAT"], pct=pct)
    gain = ir.gains(ir.bucket_counts(table), ir.bucket_counts(target))
    got = ir.drawn(ir.scored(table, gain), pct, left=left).select("doc_id", "n_features", "weight", "score", "rank")
    assert any_order(got.collect()) == any_order(want)
    if pct == 10:
        assert any_order(ir.report(table, target).collect()) == any_order(want)


def test_runs_of_several_words(spark):
    rows = [(k, "one two Three, four " * (k + 5)) for k in range(20)]
    table, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("two three",)], "text string")
    want = plain_resample(rows, ["two three"], run=3, buckets=97, pct=30)
    gain = ir.gains(ir.bucket_counts(table, 3, 97), ir.bucket_counts(target, 3, 97))
    assert any_order(ir.drawn(ir.scored(table, gain, 3), 30).drop("n_words").collect()) == any_order(want)
    kept = ir.resample(table, target, pct=30, run=3, buckets=97)
    assert {x["doc_id"] for x in kept.collect()} == {w[0] for w in want if w[4]} and kept.columns == table.columns


@pytest.mark.parametrize("seed", range(4))
def test_cutoff_is_the_key_of_its_rank(spark, seed):
    r = random.Random(seed)
    keys = [(r.randint(0, 3) if seed % 2 else r.randint(-9**9, 9**9), r.randint(0, 1), r.randint(0, 5), k) for k in range(700)]
    table = spark.createDataFrame(keys, "_down long, _last long, _id long, _row long").repartitionByRange(6, "_down").cache()
    for k in (1, 2, 350, 699, 700):
        assert ir.cutoff(table, k, left=1) == sorted(keys)[k - 1]


def test_medians_of_medians_settle_a_quarter():
    r = random.Random(9)
    parts = [sorted((r.random(),) for _ in range(r.randint(1, 60))) for _ in range(30)]
    pivot = ir.weighted_median([p[(len(p) - 1) // 2] for p in parts], [len(p) for p in parts])
    every = sorted(x for p in parts for x in p)
    assert len(every) / 4 - 30 <= every.index(pivot) <= 3 * len(every) / 4 + 30


def test_resampling_odd_rows(spark, docs, clashing, none):
    target = spark.createDataFrame([("quick fox",)], "text string")
    assert any_order(ir.report(clashing, target).collect()) == any_order(ir.report(docs, target).collect())
    assert ir.report(none, target).count() == 0 and ir.report(docs, target.where("1 = 0")).count() == docs.count()
    assert ir.resample(clashing, target, pct=50).columns == clashing.columns
    nothing = ir.report(docs.withColumn("text", F.lit("")), target).collect()
    assert {(x["n_features"], x["weight"], x["rank"]) for x in nothing} == {(0, 0, None)}


# ---- op13 ----

def plain_middle(i, text):
    h = hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def test_middles_equal_a_plain_cut(spark, docs, rows, clashing):
    r = random.Random(5)
    more = [(3000 + k, "".join(r.choice("ab<>PSM\n é日😀") for _ in range(r.randint(0, 30)))) for k in range(400)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in [(i, t) for i, t, *_ in rows] + more:
        n, form, pre, mid, out = plain_middle(i, t or "")
        want.append((i, n, form, pre, mid, sha(out), sha(t or "")))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert any_order(fill_middle.report(table).collect()) == any_order(want)
    assert any_order(fill_middle.report(clashing).collect()) == any_order(fill_middle.report(docs).collect())


def test_any_unit_and_restoration():
    text = "one two\nthree  four <x> five"
    for unit in (fill_middle.CODE_POINT, r"\s*\S+\s*", r"(?s:.{1,5})", r"\X"):
        forms = set()
        for i in range(60):
            m = fill_middle.transform(text, str(i), unit)
            forms.add(m.form)
            assert fill_middle.restore(m.output, m.form) == text
        assert forms == {"plain", "psm", "spm"}
    assert fill_middle.transform("a b c", "7", r"\s*\S+").n == 3
    with pytest.raises(ValueError):
        fill_middle.transform("a b ", "7", r"\w ?\d")


def test_long_texts_and_empty_tables(docs, none, clashing):
    m = fill_middle.transform("x" * 3_000_000, "11")
    assert m.n == 3_000_000 and fill_middle.restore(m.output, m.form) == "x" * 3_000_000
    assert fill_middle.report(none).count() == 0
    out = fill_middle.fill_in_middle(clashing)
    assert out.columns == clashing.columns and out.count() == docs.count()
