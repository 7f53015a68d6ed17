"""Encoders, section counts, chunked encoding, packing and id files against plain versions."""

import hashlib
import json
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from postflow.llm import byte_bpe, packing, queries, token_counts, token_files
from postflow.llm.encoders import ID, byte_encoder, word_encoder


def texts_of(rows):
    return [(i, t or "") for i, t, *_ in rows]


def sha(data):
    return hashlib.sha256(data).hexdigest()


# ---- encoders ----

def test_every_entry_of_the_word_vocabulary_encodes_to_itself(word_file):
    """By which ranks and merge lists give the same ids (see WordEncoder)."""
    from tokenizers import models

    with open(word_file) as f:
        model = json.load(f)["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    inner = models.BPE(vocab=model["vocab"], merges=merges)
    ending = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix="</w>")
    for entry, rank in model["vocab"].items():
        if entry.startswith("<|"):
            continue
        marked = entry.endswith("</w>") and entry != "</w>"
        found = (ending if marked else inner).tokenize(entry.removesuffix("</w>") if marked else entry)
        assert [t.id for t in found] == [rank], entry


def test_word_encoder_equals_the_library(word_file):
    encoder, r = word_encoder(word_file), random.Random(1)
    for _ in range(3000):
        text = "".join(chr(r.choice([r.randint(1, 0x24F), r.randint(32, 126), r.randint(97, 122), 32])) for _ in range(r.randint(0, 40)))
        assert encoder.encode(text) == encoder.whole(text), text
    for text in ("日本語 ΑΣ ́e", "a\0b", "", "   ", "<|endoftext|> x", "don't We'LL"):
        assert encoder.encode(text) == encoder.whole(text)


MARKED = ["a <|endoftext|> b", "x<|endoftext|>y", "<|startoftext|>", "<|endoftext|><|endoftext|>", "A <|EndOfText|> don't  \n <|endoftext|>\n", "日本語 <|startoftext|> É", "none"]


def test_added_tokens_as_the_untouched_library(spark, byte_file, pattern, monkeypatch):
    """op6 and op7 as registered, next to a tokenizer with default settings."""
    from tokenizers import Tokenizer

    texts = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: texts)
    for query, name, end in ((queries.op6_packing, "byte_bpe_50k.json", 2), (queries.op7_token_files, "word_bpe_49k.json", 1)):
        library = Tokenizer.from_file(queries.vocabulary(name))
        want = {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, end], ID).tobytes()) for i, t in enumerate(MARKED)}
        assert {r["doc_id"]: r["ids_crc32"] for r in query(spark, "").collect()} == want
    assert np.frombuffer(byte_encoder(byte_file, pattern).encode(MARKED[0]), ID).tolist()[:3] == [64, 1279, 91]  # op1 and op3 keep text


# ---- op1 ----

def test_sections_hold_all_tokens(docs, rows, byte_file, pattern):
    out = token_counts.section_tokens(docs, byte_file, pattern).toPandas()
    plain = byte_encoder(byte_file, pattern).plain
    assert out["n_tokens"].sum() == sum(len(plain(t)) for _, t in texts_of(rows)) == pytest.approx(out["token_share"].sum())
    assert len(out) == sum(t.count("\n") + 1 for _, t in texts_of(rows))


def test_attribution_equals_a_plain_count(byte_file, pattern):
    encoder, r = byte_encoder(byte_file, pattern), random.Random(2)
    for _ in range(200):
        text = "".join(r.choice("ab é日\n .,😀") for _ in range(r.randint(0, 60)))
        cuts = sorted({r.randint(0, len(text)) for _ in range(6)})
        spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if r.random() < 0.8]
        a, b = token_counts.token_spans(text, encoder)
        owned, crossing, share = token_counts.attribute((a, b), (np.array([s for s, _ in spans], int), np.array([e for _, e in spans], int)))
        want = np.zeros(len(spans)), np.zeros(len(spans)), np.zeros(len(spans))
        for s, e in zip(a.tolist(), b.tolist()):
            held = [max(0, min(e, y) - max(s, x)) for x, y in spans]
            for k, h in enumerate(held):
                want[1][k] += 0 < h < e - s
                want[2][k] += h / (e - s)
            if any(held):
                want[0][held.index(max(held))] += 1
        assert (owned == want[0]).all() and (crossing == want[1]).all() and np.allclose(share, want[2])


def test_a_token_over_a_border_goes_to_the_larger_part_and_to_the_first_on_a_tie():
    tokens = np.array([0, 4]), np.array([4, 7])
    owned, crossing, share = token_counts.attribute(tokens, (np.array([0, 2, 5]), np.array([2, 5, 9])))
    assert owned.tolist() == [1, 0, 1] and crossing.tolist() == [1, 2, 1] and np.allclose(share, [0.5, 0.5 + 1 / 3, 2 / 3])


# ---- op3 ----

@pytest.mark.parametrize("chunk, overlap", [(32_768, 1_024), (257, 40), (64, 8)])
def test_chunked_ids_equal_the_whole(spark, docs, rows, byte_file, pattern, chunk, overlap):
    got = byte_bpe.report(docs, byte_file, pattern, chunk, overlap).collect()
    plain = byte_encoder(byte_file, pattern).plain
    want = [(i, len(ids := plain(t)), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, t in texts_of(rows)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_stitching_any_text(byte_file, pattern):
    encoder, r = byte_encoder(byte_file, pattern), random.Random(3)
    for n in range(300):
        text = "".join(r.choice(["a", " ", "\n", "'", "re", "'ll", "1", ".", "é", "  ", "x" * 30]) for _ in range(r.randint(1, 80)))
        c, o = 24, r.randint(4, 11)
        chunks = [(s, text[s:s + c + o], byte_bpe.borders(text[s:s + c + o], s, s + c >= len(text), pattern)) for s in range(0, len(text), c)]
        pieces = byte_bpe.stitch(chunks, pattern)
        assert "".join(pieces) == text
        assert b"".join(map(encoder.encode, pieces)) == encoder.encode(text), repr(text)


def test_decoding_gives_the_text_back(docs, rows, byte_file, pattern):
    data = byte_bpe.decode(byte_bpe.encode(docs, byte_file, pattern), byte_file, pattern).collect()
    assert sorted(bytes(r["data"]) for r in data) == sorted(t.encode() for _, t in texts_of(rows))


# ---- op6 ----

def held(out, capacity):
    for _, x in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert x["offset"].tolist() == [0, *x["length"].cumsum().tolist()[:-1]] and x["length"].sum() <= capacity


@pytest.mark.parametrize("capacity", [1024, 50, 1])
def test_packing(docs, rows, byte_file, pattern, capacity):
    found = packing.report(docs, byte_file, pattern, capacity=capacity, with_ids=True).collect()
    out = pd.DataFrame(found, columns=found[0].__fields__)
    held(out, capacity)
    plain, want = byte_encoder(byte_file, pattern).plain, []
    for i, t in texts_of(rows):
        ids = np.array([*plain(t), 2], ID)
        stops = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
        for k, stop in enumerate(stops):
            start = stops[k - 1] if k else 0
            want.append((i, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(want, key=repr)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in found)


def test_best_fit_equals_placing_one_by_one():
    r = random.Random(4)
    for _ in range(60):
        sizes = {n: r.randint(1, 9) for n in r.sample(range(1, 33), 12)}
        plan = packing.best_fit(sizes, 32)
        bins, placed = {}, 0
        for length, first, count, each, sequence, offset in plan:
            for k in range(count):
                bins.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
                placed += 1
        assert placed == sum(sizes.values())
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 32
        gaps = []
        for n in sorted(sizes, reverse=True):
            for _ in range(sizes[n]):
                fit = min((g for g in gaps if g >= n), default=None)
                if fit is None:
                    gaps.append(32 - n)
                else:
                    gaps[gaps.index(fit)] = fit - n
        assert len(bins) == len(gaps)


# ---- op7 ----

@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 24, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(ID)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (token_files.unpack(data, 1001, bits) == ids).all()


def test_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 100)
    path, r = str(tmp_path / "x" / "a.ids"), np.random.default_rng(5)
    texts = [r.integers(0, 5000, n).astype(ID) for n in (0, 1, 99, 1, 450, 0, 3)]
    w = token_files.Writer(path, 13)
    for k, ids in enumerate(texts):
        w.add(None if k == 2 else k * 10**15, ids)
    w.close()
    f, all_ids = token_files.Reader(path), np.concatenate(texts)
    assert f.null.tolist() == [False, False, True] + [False] * 4 and f.doc_ids[3] == 3 * 10**15
    for a, b in [(0, 0), (0, 554), (99, 101), (100, 200), (553, 554), (250, 420)]:
        assert (f.ids(a, b) == all_ids[a:b]).all()
    assert f.bits == 13 and len(f.offsets) == 6


def test_files_in_order(docs, rows, word_file):
    got = [tuple(r) for r in token_files.report(docs, word_file).collect()]
    encoder, start, want = word_encoder(word_file), 0, []
    for i, t in sorted(texts_of(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = encoder.whole(t) + np.array([1], ID).tobytes()
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(got, key=lambda x: x[1]) == want


def test_empty_and_clashing(docs, clashing, none, byte_file, word_file, pattern):
    assert token_counts.section_tokens(none, byte_file, pattern).count() == 0
    assert byte_bpe.report(none, byte_file, pattern).count() == 0
    assert packing.report(none, byte_file, pattern).count() == 0
    assert token_files.report(none, word_file).count() == 0
    n = docs.count()
    assert byte_bpe.report(clashing, byte_file, pattern).count() == n
    assert token_files.report(clashing, word_file).count() == n
    assert packing.report(clashing, byte_file, pattern).where("piece = 0").count() == n
