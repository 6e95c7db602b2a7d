"""Byte-level BPE encoding and decoding.

The merges are compiled into a finite-state transducer over bytes. A reader that goes from
left to right has to follow every token that may have begun: the transducer's state is that
set, determinised when a text first needs it, and named by its longest member, of which the
others are ends. Reading a byte also settles which token ends there; tokens are emitted once
all beginnings that are still alive agree on them, and as no token is longer than the longest
of the vocabulary, the lookahead is bounded.

Which token ends at a position follows from a property of BPE: the encoding of a text is the
only sequence of tokens in which every two neighbours, put together, encode to themselves.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakesight.llm.common import bounded_batches, documents, whole, without

#: Steps, checked token pairs and remembered words a worker keeps; each table is started anew beyond.
MOST_STEPS, MOST_PAIRS, MOST_WORDS = 400_000, 500_000, 300_000
#: Bytes read before the first look at what is certain.
LOOKAHEAD = 256
#: Texts of more characters are cut into words one by one.
LONG_TEXT = 2_000_000
OUTPUT = ["ids", "decoded"]


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from a file of base64 tokens and numbers."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines.splitlines() if line)}


class Transducer:
    """Encodes byte strings by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.sizes = {r: len(t) for t, r in ranks.items()}
        self.size = max(self.tokens, default=0) + 1
        self.prefixes = {t[:i] for t in ranks for i in range(len(t) + 1)}
        self.fits: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.numbers = {b"": 0}
        #: Of each state, the live bytes: the longest end of the text read so far that begins a token.
        self.live = [b""]
        #: Of each state, the tokens that may end here with their lengths, longest first.
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        #: state · 256 + byte → state, as far as texts have needed it.
        self.steps: dict[int, int] = {}

    def merged(self, text: bytes) -> list[int]:
        """BPE by its definition: the lowest-ranked pair is merged first, the leftmost of equals."""
        parts = [text[i : i + 1] for i in range(len(text))]
        rank = self.ranks.get
        while len(parts) > 1:
            pairs = [rank(a + b, self.size) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(pairs)
            if least == self.size:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def neighbours(self, left: int, right: int) -> bool:
        """The two tokens, put together, encode to themselves; without a left one (-1), the right one does."""
        if len(self.fits) >= MOST_PAIRS:
            self.fits.clear()
        both = [right] if left < 0 else [left, right]
        known = self.fits[left * self.size + right] = self.merged(b"".join(map(self.tokens.__getitem__, both))) == both
        return known

    def step(self, state: int, byte: int) -> int:
        """Determinise one step: all token beginnings alive after the byte are ends of the longest one."""
        live = self.live[state] + bytes([byte])
        while live not in self.prefixes:
            live = live[1:]
        if live not in self.numbers:
            self.numbers[live] = len(self.live)
            self.live.append(live)
            ends = ((self.ranks.get(live[i:]), len(live) - i) for i in range(len(live)))
            self.ends.append(tuple((t, n) for t, n in ends if t is not None))
        self.steps[state << 8 | byte] = self.numbers[live]
        return self.numbers[live]

    def stream(self, text: bytes) -> Iterator[list[int]]:
        """Tokens as they become certain.

        ``last`` has the token that ends at each position. Once there is enough of it, the
        chains of tokens that lead to the live starts are followed back to where they meet:
        whatever comes next, the text up to there is encoded as it is now.
        """
        if len(self.steps) >= MOST_STEPS:
            self._reset()
        steps, ends, fits, sizes, width = self.steps, self.ends, self.fits, self.sizes, self.size
        state, last, at = 0, [-1], 0
        for byte in text:
            known = steps.get(state << 8 | byte)
            state = self.step(state, byte) if known is None else known
            at += 1
            for token, size in ends[state]:
                before = last[at - size]
                fit = fits.get(before * width + token)
                if self.neighbours(before, token) if fit is None else fit:
                    last.append(token)
                    break
            if at >= LOOKAHEAD:
                chains = [self._back(last, at - i) for i in range(len(self.live[state]) + 1) if i <= at]
                meet = max(set.intersection(*[{p for p, _ in c} for c in chains]))
                certain = [t for p, t in reversed(chains[0]) if 0 < p <= meet]
                if certain:
                    yield certain
                    last, at = [certain[-1], *last[meet + 1 :]], at - meet
        yield [t for p, t in reversed(self._back(last, at)) if p]

    def _back(self, last: list[int], at: int) -> list[tuple[int, int]]:
        """(position, token ending there) from a position back to the first."""
        out = [(at, last[at])]
        while at:
            at -= self.sizes[last[at]]
            out.append((at, last[at]))
        return out

    def encode(self, text: bytes) -> list[int]:
        out: list[int] = []
        if len(text) >= LOOKAHEAD:
            for certain in self.stream(text):
                out += certain
            return out
        # A short text needs no look at what is certain before its end.
        if len(self.steps) >= MOST_STEPS:
            self._reset()
        step_of, fit_of, ends, sizes, width = self.steps.get, self.fits.get, self.ends, self.sizes, self.size
        state, last = 0, [-1]
        for at, byte in enumerate(text, 1):
            known = step_of(state << 8 | byte)
            state = self.step(state, byte) if known is None else known
            for token, size in ends[state]:
                before = last[at - size]
                fit = fit_of(before * width + token)
                if self.neighbours(before, token) if fit is None else fit:
                    last.append(token)
                    break
        at = len(text)
        while at:
            token = last[at]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out


def _class(kind: str, last: int) -> str:
    return "".join(f"\\U{c:08x}" for c in range(last) if regex.match(kind, chr(c)))


class Splitter:
    """Cuts a text into the matches of a pattern.

    For texts of Latin letters and common punctuation the pattern's Unicode classes are
    written out over those characters, which the standard library matches faster.
    """

    LATIN = 0x250

    def __init__(self, pattern: str) -> None:
        self.full = regex.compile(pattern)
        fast = pattern
        for name in (r"\p{L}", r"\p{N}"):
            fast = fast.replace(f"[{name}]", name).replace(name + "+", f"[{_class(name, self.LATIN)}]+").replace(name, _class(name, self.LATIN))
        blanks = "".join(f"\\U{c:08x}" for c in range(0x2070) if regex.match(r"\s", chr(c)))
        fast = fast.replace(r"[^\s", f"[^{blanks}").replace(r"\S", f"[^{blanks}]").replace(r"\s+", f"[{blanks}]+")
        self.fast = re.compile(fast)
        self.other = re.compile(f"[^\\x00-\\U{self.LATIN - 1:08x}\\u2000-\\u206f]")

    def __call__(self, text: str) -> Iterable[str]:
        chosen = self.full if self.other.search(text) else self.fast
        if len(text) > LONG_TEXT:
            return (m.group() for m in chosen.finditer(text))
        return chosen.findall(text)


class Codec:
    """Texts to token numbers and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer = Transducer(ranks)
        self.split = Splitter(pattern)
        #: Words met once lately, and words met again.
        self.fresh: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        words, out = self.words, []
        for word in self.split(text):
            out += words.get(word) or self._word(word)
        return out

    def _word(self, word: str) -> list[int]:
        ids = self.fresh.pop(word, None)
        if ids is not None:
            if len(self.words) >= MOST_WORDS:
                self.words.clear()
            self.words[word] = ids
            return ids
        ids = self.transducer.encode(word.encode("utf-8", "replace"))
        if len(self.fresh) >= MOST_WORDS:
            self.fresh.clear()
        if len(word) < 64:
            self.fresh[word] = ids
        return ids

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.transducer.tokens.__getitem__, ids))

    def decode(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
        """Text piece by piece; bytes of a character that is not complete wait for the next piece."""
        stream, rest = Utf8Stream(), iter(ids)
        while piece := self.decode_bytes(islice(rest, chunk)):
            yield stream.feed(piece)
        yield stream.end()


class Utf8Stream:
    """An incremental UTF-8 reader: its state is the lead byte's length and the bytes seen of it."""

    def __init__(self) -> None:
        self.tail = b""

    @staticmethod
    def length(lead: int) -> int:
        """Bytes of the character that a lead byte begins; 0 for a continuation byte."""
        return 1 if lead < 0x80 else 0 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4

    def feed(self, piece: bytes) -> str:
        data = self.tail + piece
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            need = self.length(data[-back])
            if need:
                if need > back:
                    cut = len(data) - back
                break
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.tail = self.tail.decode("utf-8", "replace"), b""
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(lines: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary file's content, built once in each worker."""
    key = (hashlib.sha256(lines).hexdigest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(lines), pattern)
    return _codecs[key]


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The content of a rank file of the driver, under a megabyte for 50,000 tokens."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All rows of ``docs`` with ``ids``: the token numbers of the text; none for a null or empty one.

    Repeated rows are encoded alike; an empty table gives an empty table. An input column
    ``ids`` is replaced. Characters that UTF-8 cannot carry become question marks.
    """
    bounded_batches(docs.sparkSession)
    lines = vocabulary(docs.sparkSession, path)
    docs = without(docs, "ids", "_text")
    source = docs.withColumn("_text", whole("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(lines.value, pattern)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column("_text").to_pylist()]
            kept = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ids, pa.list_(pa.int32()))], [*kept.schema.names, "ids"])

    return source.mapInArrow(run, docs.withColumn("ids", F.array().cast("array<int>")).schema)


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """All rows with ``decoded``: the text of their ``ids``; empty for null or no ids."""
    lines = vocabulary(rows.sparkSession, path)
    rows = without(rows, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(lines.value, pattern)
        for batch in batches:
            texts = ["".join(own.decode(ids or ())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, rows.withColumn("decoded", F.lit("")).schema)


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Rows without their text, with n_tokens, ids_sha256 and decoded_sha256, and on request the ids.

    Encoding and decoding follow each other in one task, so that ids which are not asked for
    never leave it. Nulls, empty texts and clashing names are treated as by ``encode``.
    """
    bounded_batches(docs.sparkSession)
    lines = vocabulary(docs.sparkSession, path)
    digests = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    source = without(docs, *digests, "_text").withColumn("_text", whole("text")).drop("text")
    added = {"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit(""), "ids": F.array().cast("array<int>")}
    schema = source.drop("_text").withColumns({c: added[c] for c in digests}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(lines.value, pattern)
        printed = [str(i) for i in range(max(own.transducer.tokens, default=-1) + 1)]
        for batch in batches:
            counts, of_ids, of_text, numbers = [], [], [], []
            for text in batch.column("_text").to_pylist():
                ids = own.encode(text)
                counts.append(len(ids))
                if with_ids:
                    numbers.append(pa.array(ids, pa.int32()))
                of_ids.append(hashlib.sha256(" ".join(map(printed.__getitem__, ids)).encode()).hexdigest())
                hashed = hashlib.sha256()
                for piece in own.decode(ids):
                    hashed.update(piece.encode())
                of_text.append(hashed.hexdigest())
            kept = batch.drop_columns(["_text"])
            columns = [*kept.columns, pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            if with_ids:
                ends = pa.array([0, *accumulate(counts)], pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(numbers or [pa.array([], pa.int32())])))
            yield pa.RecordBatch.from_arrays(columns, [*kept.schema.names, *digests])

    return source.mapInArrow(run, schema)


def op5_byte_bpe(spark, folder: str) -> DataFrame:
    """Token digests of all documents."""
    import public_tokenizers

    return round_trip(
        documents(spark, folder).select("doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    )
