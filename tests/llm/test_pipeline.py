"""The pipeline's stages against brute force, and its queries by name."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lakesight.llm import bpe, language, pipeline
from tests.llm.test_operators import SCHEMA, WORDS, fixture_rows, plain_fingerprint, reached, tokenizer


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(fixture_rows(), SCHEMA).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path, pattern = tokenizer()
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        result = stage(spark, docs, folder)
        after = result.collect()
        if name != "encode":
            assert result.columns == docs.columns
        rows = Counter(map(tuple, after)) if name != "encode" else None
        if name == "language":
            network = language.fit(docs)
            texts = [r for r in before if any(c.isalpha() for c in r.text or "")]
            scores = network.probabilities([r.text.encode() for r in texts]).max(axis=1)
            told = [network.labels[i] for i in network.probabilities([r.text.encode() for r in texts]).argmax(axis=1)]
            right = {}
            for r, label, s in zip(texts, told, scores):
                if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.lang == label:
                    right.setdefault(label, []).append(s)
            # Of so few documents the low quantile is the least score.
            every = sum(right.values(), [])
            together = min(every) * len(every) / (len(every) + pipeline.PRIOR)
            least = {k: min(min(v), (len(v) * min(v) + pipeline.PRIOR * together) / (len(v) + pipeline.PRIOR)) for k, v in right.items()}
            assert rows == Counter(tuple(r) for r, label, s in zip(texts, told, scores) if s >= least.get(label, 0.0))
        elif name == "exact dedup":
            groups = {}
            for r in before:
                groups.setdefault("".join(r.text.split()), []).append(r)
            assert len(after) == len(groups)
            for r in after:
                group = groups["".join(r.text.split())]
                assert tuple(r) == tuple(min(group, key=lambda g: (-len(g.text), g.doc_id is None, g.doc_id or 0)))
        elif name == "near dedup":
            keys = sorted({plain_fingerprint(r.text) for r in before})
            root = reached(keys, lambda a, b: (a ^ b).bit_count() <= 4)
            least = {}
            for r in before:
                if r.doc_id is not None:
                    k = root[plain_fingerprint(r.text)]
                    least[k] = min(least.get(k, r.doc_id), r.doc_id)
            assert rows == Counter(tuple(r) for r in before if least.get(root[plain_fingerprint(r.text)]) == r.doc_id)
        elif name == "mix":
            assert set(rows) <= set(map(tuple, before)) and max(rows.values()) <= 2
            words = sum(len(r.text.split()) for r in before)
            assert abs(sum(len(r.text.split()) for r in after) - 1.5 * words) < 0.1 * words
        else:
            codec = bpe.codec(open(path, "rb").read(), pattern)
            expected = Counter((r.doc_id, tuple(codec.encode(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in before)
            assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in after) == expected
        docs = corpus_pipeline.materialize(result, "test")


def test_noise_has_no_clear_language(spark):
    rng = random.Random(6)
    words = {**WORDS, "fr": "le la les des que pour dans avec être cœur"}
    langs = sorted(words)
    rows = [(i, " ".join(rng.choice(words[langs[i % 3]].split()) + rng.choice(["", "er", "on"]) for _ in range(40)), langs[i % 3], "s", 0) for i in range(2_400)]
    noise = [(10_000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789#$%&()=  ") for _ in range(250)), None, "s", 0) for i in range(60)]
    left = Counter("noise" if r.lang is None else r.lang for r in corpus_pipeline.known_language(spark, spark.createDataFrame(rows + noise, SCHEMA), "").collect())
    assert left["noise"] <= 6
    assert all(left[lang] >= 0.98 * 800 for lang in langs)


def test_one_of_each_group_of_near_copies(spark, tmp_path):
    words = [f"word{i}" for i in range(400)]
    near = [" ".join([*words, f"end{i}"]) for i in range(4)]
    keys = [plain_fingerprint(t) for t in near]
    other = " ".join(f"other{i * i}" for i in range(300))
    assert len(set(reached(sorted(set(keys)), lambda a, b: (a ^ b).bit_count() <= 4).values())) == 1
    for n, ids in enumerate(([None] * 4, [7] * 4, [None, 9, 9, 7])):
        path = str(tmp_path / f"docs{n}")
        spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip([*ids, 8], [*near, other])], SCHEMA).write.parquet(path)
        left = corpus_pipeline.near_copies(spark, spark.read.parquet(path), "").collect()
        assert sorted(r.text == other for r in left) == [False, True]
        assert {r.doc_id for r in left if r.text != other} == {min((i for i in ids if i is not None), default=None)}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_all_queries_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_bounds_move_smoothly_with_the_number_of_documents(spark):
    def bound(n):
        held = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 3 == 1][:n]
        rows = [(i, "en", "en", 0.5 + 0.4 * k / n) for k, i in enumerate(held)]
        return pipeline.least_scores(spark.createDataFrame(rows, "doc_id long, lang string, lang_pred string, score double"))["en"]

    steps = [bound(n) for n in (1, 20, 199, 200, 201)]
    assert steps == sorted(steps) and steps[-1] - steps[-3] < 0.01 and steps[0] < 0.1
    assert pipeline.least_scores(spark.createDataFrame([], "doc_id long, lang string, lang_pred string, score double")) == {}
