"""The trie of words against the tokenizers library, and hard negatives against all pairs."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lakesight.llm import hard_negatives as negatives, trie_bpe

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def own(path):
    with open(path, "rb") as file:
        return trie_bpe.TrieCodec(file.read())


def odd_texts():
    rng = random.Random(12)
    texts = [
        "a<|endoftext|>b<|endoftext|>", "<|endo", "  \n\n  x", "a" * 5000, " " * 3000 + "x", "-" * 700, "héé" * 300, "😀é" * 120,
        "中文字" * 20 + " 12３ ", "don't I'LL we'll 's", "՘՘a \x1cc\x85d", "", "x" * 30_000, "\U0003fc3d a", "the theme thermal",
    ]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD7FF), rng.randrange(0x10000, 0x10FFFF)])) for _ in range(40)) for _ in range(300)]
    return texts + ["".join(rng.choice("aab-  \n.") for _ in range(rng.randrange(60))) for _ in range(300)]


def check(own, library, texts):
    for data, text, want in zip(own.encode_batch(texts), texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = list(trie_bpe.unpacked(data))
        assert ids == want.ids
        assert own.decode(data) == library.decode(ids, skip_special_tokens=False)


def test_ids_of_odd_texts(own, library):
    check(own, library, odd_texts())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeinrst ''\n.")), max_size=40), max_size=4))
def test_ids_of_any_text(own, library, texts):
    check(own, library, texts)


def test_any_bytes_decode_as_the_library_does(own, library):
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(12))]
        assert own.decode(trie_bpe.packed(trie_bpe.array("I", ids))) == library.decode(ids, skip_special_tokens=False)


def test_prefixes_are_shared_and_tables_start_anew(path, library, monkeypatch):
    with open(path, "rb") as file:
        content = file.read()
    codec = trie_bpe.TrieCodec(content)
    codec.encode_batch(["thermal thermals"])
    assert len(codec.trie.last) == 1 + len("thermal") + len(" thermals")
    codec.encode_batch([" thermalx"])
    assert len(codec.trie.last) == 1 + len("thermal") + len(" thermals") + 1
    monkeypatch.setattr(trie_bpe, "MOST_NODES", 50)
    monkeypatch.setattr(trie_bpe, "MOST_WORDS", 9)
    monkeypatch.setattr(trie_bpe, "MOST_PAIRS", 5)
    monkeypatch.setattr(trie_bpe, "LONG_WORD", 6)
    for text in odd_texts()[::7]:
        check(codec, library, [text])


def test_other_tokenizers_are_refused(path):
    with open(path, "rb") as file:
        spec = json.load(file)
    spec["model"]["byte_fallback"] = True
    with pytest.raises(ValueError, match="not supported"):
        trie_bpe.TrieCodec(json.dumps(spec).encode())


def test_round_trip_of_a_table(spark, path, library):
    texts = [None, *odd_texts()[:40]]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2
    table = spark.createDataFrame(rows, DOCS).repartition(3)
    clashing = table.select("*", *[F.lit("x").alias(c) for c in ("ids", "_text", "n_tokens", "decoded")])

    def sha(data):
        return hashlib.sha256(data).hexdigest()

    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha((text or "").encode())))
    found = trie_bpe.round_trip(clashing, path).select("doc_id", *trie_bpe.DIGESTS).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    decoded = trie_bpe.decode(trie_bpe.encode(clashing, path), path).select("text", "decoded").collect()
    assert len(decoded) == len(rows) and all(r["decoded"] == (r["text"] or "") for r in decoded)
    empty = spark.createDataFrame([], DOCS)
    assert trie_bpe.round_trip(empty, path).collect() == [] and trie_bpe.encode(empty, path).collect() == []


# hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def all_pairs(rows):
    kept = set()
    for number, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if number is not None and number % 7 == 0 else label
        kept.add((number, label, tuple(max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in vector)))

    def order(row):
        return -row[0], row[1] is None, row[1] or 0

    out = []
    for anchor, label, own in kept:
        if anchor is None or anchor % 100:
            continue
        scores = [(max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(own, v, strict=True)))), i, other) for i, other, v in kept if len(v) == len(own)]
        for p, positive, _ in sorted((s for s in scores if s[2] == label and s[1] != anchor), key=order)[:5]:
            near = sorted((s for s in scores if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:10]
            out += [(anchor, positive, i, n, p, score) for i, (score, n, _) in enumerate(near, 1)]
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x or 0) for x in r])


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(13)
    rows = []
    for i in range(500):
        size = 64 if rng.random() < 0.9 else rng.choice([0, 3, 17])
        rows.append((i if rng.random() < 0.98 else None, [rng.choice([0.0, rng.gauss(0, 0.2), 0.25]) for _ in range(size)], rng.choice([0, 1, 1, 2, None])))
    rows += [(100, None, 1), (200, [float("nan")] * 64, 1), (300, [None] + [0.1] * 63, 1), (400, [1e30] + [0.1] * 63, 1)]
    rows += [(401, [1e12] * 64, 1), (402, [1e12] * 64, 2), (-700, [0.25] * 64, 3), (0, [0.0] * 64, 1), *rows[:20]]
    return [(n, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for n, v, label in rows]


@pytest.mark.parametrize(("stride", "anchors", "numbers"), [(8192, 128, 4_000_000), (40, 3, 900)])
def test_hard_negatives_equal_all_pairs(spark, vectors, stride, anchors, numbers, monkeypatch):
    monkeypatch.setattr(negatives, "STRIDE", stride)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "PART_NUMBERS", numbers)
    table = spark.createDataFrame(vectors, VECTORS).repartition(3).withColumns({c: F.lit("x") for c in ("_key", "_part", "rank", "score")})
    assert in_order(negatives.hard_negatives(table).collect()) == in_order(all_pairs(vectors))


def test_bounds_hold_and_settle_smooth_vectors():
    rng = np.random.default_rng(4)
    level = rng.integers(-300, 300, (200, 4))
    values = np.repeat(level, 16, axis=1) + rng.integers(-3, 4, (200, 64))
    rows = negatives.Part(np.arange(200), np.arange(200), np.zeros(200), values)
    exact = values @ values.T
    for depth in range(len(negatives.SEGMENTS)):
        low, high = rows.bounds(rows, depth, slice(0, 200))
        assert (low <= exact).all() and (exact <= high).all()
    # Where segments are nearly level, the coarsest bounds leave few pairs open.
    tenth = np.sort(exact, axis=1)[:, -10].astype(float)
    assert (rows.bounds(rows, 0, slice(0, 200))[1] >= tenth[:, None]).mean() < 0.08
    wanted = np.ones_like(exact, dtype=bool)
    scores = rows.scored(rows, wanted, tenth, np.full(200, np.inf), slice(0, 200))
    assert (np.where(exact >= tenth[:, None], scores == exact, True)).all()


def test_hard_negatives_of_an_empty_table(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
