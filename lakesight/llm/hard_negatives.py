"""Hard negatives: for an anchor and its nearest rows of the same label, the near rows of other labels.

Each vector is cut into segments; of every segment its mean and its deviation (the length of
what is left without the mean) are stored. The inner product over a segment is its length
times the product of the means, give or take at most the product of the deviations. The sum
over the segments bounds the score of a pair. Pairs that the bounds of long segments do not
settle are bounded again by halves of them, and only what is left is scored exactly.

Vectors are dealt into parts that fit a task. Every anchor is copied to every part and passes
it in a stream, keeping its best rows there; the parts' lists are then merged. Memory is that
of one part and one batch of anchors, whatever the number of either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lakesight.llm.common import bounded_batches
from lakesight.session import materialize

#: Lengths of segments, from coarse to fine; each is a multiple of the next.
SEGMENTS = (16, 8, 4)
#: Numbers in a part at most (rows · (components + summaries)), rows scored at once, and anchors in a batch.
PART_NUMBERS, STRIDE, ANCHORS = 4_000_000, 8192, 128
#: Above this share of pairs that the bounds leave open, whole columns are scored instead of single pairs.
DENSE = 0.05
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these hundredths of the positive's.
LEAST, MOST = 30, 90
#: Inner products below this are exact in floating point.
EXACT = float(1 << 52)
LARGEST = (1 << 63) - 1
COMPONENTS = 256.0


def quantised(vector: Column) -> Column:
    """Whole components: floor(256 · x), beyond the range of a long its end."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * COMPONENTS))


def prepared(vectors: DataFrame) -> DataFrame:
    """(_key, vec_id, label, _values): the rows that take part, fully repeated ones once.

    Left out are rows with a null label or vector and those with a null or non-finite component.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("long")
    rows = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        quantised(F.col("embedding")).alias("_values"),
    )
    return materialize(rows.distinct().withColumn("_key", F.monotonically_increasing_id()), "vectors")


def summary(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of segments: means times the root of the length, and deviations; the last segment may be short."""
    out = []
    for length in SEGMENTS:
        cuts = range(0, values.shape[1], length)
        parts = [values[:, i : i + length] for i in cuts]
        means = np.stack([p.mean(axis=1) for p in parts], axis=1) if parts else np.zeros((len(values), 0))
        deviations = [np.sqrt(((p - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(parts, means.T, strict=True)]
        roots = np.sqrt([p.shape[1] for p in parts])
        out.append((means * roots, np.stack(deviations, axis=1) if parts else means))
    return out


class Part:
    """Vectors of one part and one length, in order of vec_id (null last), with their segment summaries."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
        order = np.lexsort((keys, ids))
        self.keys, self.ids, self.labels = keys[order], ids[order], labels[order]
        self.values = values[order]
        self.floats = self.values.astype(np.float64)
        self.largest = float(np.abs(self.floats).max(initial=0))
        self.summaries = summary(self.floats)

    def bounds(self, anchors: "Part", level: int, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score of each anchor and row, widened by what rounding may take."""
        means, deviations = self.summaries[level]
        own_means, own_deviations = anchors.summaries[level]
        middle = own_means @ means[at].T
        spread = own_deviations @ deviations[at].T
        room = spread + 1e-9 * (np.abs(own_means) @ np.abs(means[at]).T + spread) + 1e-6
        return middle - room, middle + room

    def scores(self, anchors: "Part", open_pairs: np.ndarray, at: slice) -> np.ndarray:
        """Exact scores of the open pairs; others are the least number."""
        out = np.full(open_pairs.shape, -LARGEST - 1, dtype=np.int64)
        rows, columns = np.nonzero(open_pairs)
        if not len(rows):
            return out
        if anchors.largest * self.largest * self.values.shape[1] >= EXACT:
            values = self.values[at]
            for r, c in zip(rows, columns, strict=True):
                score = sum(int(x) * int(y) for x, y in zip(anchors.values[r], values[c], strict=True))
                out[r, c] = max(-LARGEST, min(LARGEST, score))
        elif len(rows) > DENSE * open_pairs.size:
            used = np.flatnonzero(open_pairs.any(axis=0))
            found = np.rint(anchors.floats @ self.floats[at][used].T).astype(np.int64)
            out[:, used] = np.where(open_pairs[:, used], found, -LARGEST - 1)
        else:
            found = np.einsum("ij,ij->i", anchors.floats[rows], self.floats[at][columns])
            out[rows, columns] = np.rint(found).astype(np.int64)
        return out

    def scored(self, anchors: "Part", wanted: np.ndarray, least: np.ndarray, most: np.ndarray, at: slice) -> np.ndarray:
        """Exact scores of those wanted pairs that may lie between the anchors' limits."""
        for level in range(len(SEGMENTS)):
            if not wanted.any():
                break
            low, high = self.bounds(anchors, level, at)
            wanted = wanted & (high >= least[:, None]) & (low <= most[:, None])
        return self.scores(anchors, wanted, at)


class Best:
    """The first k rows of each list: higher scores first, then smaller vec_id (null last), then key."""

    def __init__(self, lists: int, k: int) -> None:
        self.k = k
        self.found = [np.empty(0, dtype=np.int64) for _ in range(4)]  # list, score, id, key
        self.worst = np.full(lists, -LARGEST - 1, dtype=np.int64)

    def add(self, scores: np.ndarray, open_pairs: np.ndarray, part: Part, at: slice, lists: np.ndarray) -> None:
        """Rows of ``scores`` belong to ``lists``; only open pairs not below the list's worst score are looked at."""
        take = open_pairs & (scores >= self.worst[lists][:, None])
        if scores.shape[1] > self.k:
            shown = np.where(take, scores, -LARGEST - 1)
            kth = np.partition(shown, -self.k, axis=1)[:, -self.k]
            take &= scores >= kth[:, None]
        rows, columns = np.nonzero(take)
        new = (lists[rows], scores[rows, columns], part.ids[at][columns], part.keys[at][columns])
        lists_, scores_, ids, keys = (np.concatenate(x) for x in zip(self.found, new, strict=True))
        order = np.lexsort((keys, ids, -scores_, lists_))
        lists_, scores_, ids, keys = lists_[order], scores_[order], ids[order], keys[order]
        first = np.flatnonzero(np.r_[True, lists_[1:] != lists_[:-1]]) if len(lists_) else np.empty(0, dtype=np.int64)
        place = np.arange(len(lists_)) - np.repeat(first, np.diff(np.r_[first, len(lists_)]))
        kept = place < self.k
        self.found = [x[kept] for x in (lists_, scores_, ids, keys)]
        full = place == self.k - 1
        self.worst[lists_[full]] = scores_[full]


NULL_ID = LARGEST
PAIR = "part int, _anchor long, _positive int, _key long, vec_id long, score long"


def _read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    ids = batch.column("vec_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = batch.column("_values")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = {"key": batch.column("_key").to_numpy(zero_copy_only=False), "id": ids, "label": batch.column("label").to_numpy(zero_copy_only=False), "length": lengths, "flat": flat}
    out["start"] = np.r_[0, np.cumsum(lengths)]
    return out


def _by_length(rows: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, Part]]:
    """(length, positions, vectors) of the rows of each number of components."""
    for length in np.unique(rows["length"]):
        at = np.flatnonzero(rows["length"] == length)
        values = rows["flat"][rows["start"][at][:, None] + np.arange(length)].reshape(len(at), length)
        yield int(length), at, Part(rows["key"][at], rows["id"][at], rows["label"][at], values)


def _streamed(batches: Iterator[pa.RecordBatch], meet) -> Iterator[pa.RecordBatch]:
    """Rows of a part come first, anchors behind them: ``meet`` gets the part's vectors and each batch of anchors."""
    part, collected, vectors = None, [], None
    for batch in batches:
        edges = [0]
        parts, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_part", "_kind"))
        edges += [int(i) + 1 for i in np.flatnonzero((parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1]))] + [len(parts)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            piece = batch.slice(a, b - a)
            if parts[a] != part:
                part, collected, vectors = parts[a], [], None
            if kinds[a] == 0:
                collected.append(_read(piece))
                continue
            if vectors is None:
                vectors = {}
                if collected:
                    whole = {k: np.concatenate([c[k] for c in collected]) for k in ("key", "id", "label", "length", "flat")}
                    whole["start"] = np.r_[0, np.cumsum(whole["length"])]
                    vectors = {length: p for length, _, p in _by_length(whole)}
                collected = []
            for at in range(0, piece.num_rows, ANCHORS):
                yield from meet(int(part), vectors, piece.slice(at, ANCHORS))


def _pairs(part: int, anchors: np.ndarray, positives: np.ndarray, best: Best) -> pa.RecordBatch:
    lists, scores, ids, keys = best.found
    arrays = [
        pa.array(np.full(len(lists), part, dtype=np.int32)), pa.array(anchors[lists]), pa.array(positives[lists].astype(np.int32)), pa.array(keys),
        pa.array(ids, mask=ids == NULL_ID), pa.array(scores),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["part", "_anchor", "_positive", "_key", "vec_id", "score"])


def _strides(n: int) -> Iterator[slice]:
    return (slice(i, min(i + STRIDE, n)) for i in range(0, n, STRIDE))


def nearest_same(k: int):
    """The first k other rows of an anchor's label in a part."""

    def meet(part: int, vectors: dict[int, Part], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for length, _, anchors in _by_length(_read(batch)):
            rows = vectors.get(length)
            if rows is None:
                continue
            best, lists = Best(len(anchors.keys), k), np.arange(len(anchors.keys))
            for at in _strides(len(rows.keys)):
                other = (anchors.ids[:, None] != rows.ids[at]) & (anchors.labels[:, None] == rows.labels[at])
                unlimited = np.full(len(lists), np.inf)
                worst = best.worst.astype(np.float64)
                scores = rows.scored(anchors, other, worst - np.abs(worst) * 1e-12, unlimited, at)
                best.add(scores, scores > -LARGEST - 1, rows, at, lists)
            yield _pairs(part, anchors.keys, np.zeros(len(lists)), best)

    return meet


def nearest_other(k: int, low: int, high: int):
    """For each of an anchor's positives the first k rows of other labels in a part whose scores are within its limits."""

    def meet(part: int, vectors: dict[int, Part], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        everything = batch.column("_scores").to_pylist()
        for length, positions, anchors in _by_length(_read(batch)):
            rows = vectors.get(length)
            if rows is None:
                continue
            # The anchors were put in order of their ids: their positives by key.
            keys = batch.column("_key").to_pylist()
            positive = {keys[i]: everything[i] for i in positions}
            of = [positive[int(key)] for key in anchors.keys]
            owner = np.array([i for i, scores in enumerate(of) for _ in scores], dtype=np.int64)
            rank = np.array([j for scores in of for j in range(len(scores))], dtype=np.int64)
            # Whole-number limits: low · p <= 100 · n <= high · p.
            least = np.array([-(-low * p // 100) for scores in of for p in scores], dtype=np.int64)
            most = np.array([high * p // 100 for scores in of for p in scores], dtype=np.int64)
            best = Best(len(owner), k)
            for at in _strides(len(rows.keys)):
                other = anchors.labels[:, None] != rows.labels[at]
                floor = np.maximum(least, best.worst)
                feasible = floor <= most
                from_ = np.full(len(of), np.inf)
                to = np.full(len(of), -np.inf)
                np.minimum.at(from_, owner[feasible], floor[feasible].astype(np.float64))
                np.maximum.at(to, owner[feasible], most[feasible].astype(np.float64))
                # Limits of numbers beyond 2^53 are rounded: the bounds get room for that, exact limits follow.
                scores = rows.scored(anchors, other, from_ - np.abs(from_) * 1e-12, to + np.abs(to) * 1e-12, at)
                for j in range(int(rank.max(initial=-1)) + 1):
                    lists = np.flatnonzero((rank == j) & feasible)
                    if len(lists):
                        own = scores[owner[lists]]
                        fits = (own >= least[lists][:, None]) & (own <= most[lists][:, None]) & (own > -LARGEST - 1)
                        best.add(own, fits, rows, at, lists)
            yield _pairs(part, anchors.keys[owner], rank, best)

    return meet


def _part_count(spark: SparkSession, vectors: DataFrame) -> int:
    """Parts so small that one fits a task, and at least one for each core."""
    numbers = vectors.agg(F.sum(F.size("_values") * 2 + 8)).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-numbers // PART_NUMBERS))


def _met(vectors: DataFrame, anchors: DataFrame, parts: int, meet) -> DataFrame:
    """Every anchor meets every part; what it takes along (_scores) comes with it."""
    own = vectors.select(F.pmod(F.xxhash64("_key"), F.lit(parts)).cast("int").alias("_part"), F.lit(0).alias("_kind"), "_key", "vec_id", "label", "_values",
                         F.lit(None).cast("array<long>").alias("_scores"))
    copied = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(int(parts) - 1))).alias("_part"), F.lit(1).alias("_kind"), "_key", "vec_id", "label", "_values", "_scores")
    dealt = own.unionByName(copied).repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", "_kind")
    return dealt.mapInArrow(lambda batches: _streamed(batches, meet), PAIR)


def _first(rows: DataFrame, by: list[str], k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "_key")
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows of vec_id, embedding and label.

    Rows with a null label or vector, or with a null or non-finite component, take no part;
    fully repeated rows count once. Anchors are the rows whose vec_id is divisible by ``every``;
    an anchor's own vec_id is none of its positives. A null vec_id is no anchor and comes last
    among equals. Vectors of another number of components than the anchor's are no partners;
    scores beyond the range of a long count as its end. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = prepared(vectors)
    parts = _part_count(spark, rows)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    same = _met(rows, anchors.withColumn("_scores", F.lit(None).cast("array<long>")), parts, nearest_same(positives))
    chosen = materialize(
        _first(same, ["_anchor"], positives, "_rank").select("_anchor", F.col("_key").alias("_of"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "_rank"),
        "positives")
    lists = chosen.groupBy("_anchor").agg(F.sort_array(F.collect_list(F.struct("_rank", "positive_score"))).alias("_list"))
    asked = anchors.join(lists, F.col("_key") == F.col("_anchor")).withColumn("_scores", F.col("_list")["positive_score"])
    other = _met(rows, asked, parts, nearest_other(negatives, least, most))
    found = _first(other, ["_anchor", "_positive"], negatives, "rank").select(
        F.col("_anchor").alias("_a"), (F.col("_positive") + 1).alias("_p"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("_key").alias("_k"), F.col("vec_id").alias("anchor_id"))
    return (
        found.join(chosen, (F.col("_a") == F.col("_anchor")) & (F.col("_p") == F.col("_rank")))
        .join(ids, F.col("_a") == F.col("_k"))
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


def op13_hard_negatives(spark, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    return hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label"))
