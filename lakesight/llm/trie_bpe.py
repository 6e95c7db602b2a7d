"""BPE encoding and decoding over a trie of words.

The distinct words of a batch of texts are put into a trie in depth-first order. Each node
is a prefix of words and keeps the last token of that prefix's encoding; a word's encoding
is read by going back from its node, token by token. Words that begin alike share the nodes
of what they have in common, so it is computed once, also for later batches of the worker.

The last token of a prefix follows from those before it: of the tokens that end there, it is
the only one whose left neighbour, the last token of what precedes it, does not merge into
it differently. Two tokens are such neighbours if the merges, applied to both together, give
just these two.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakesight.llm.bpe import Splitter
from lakesight.llm.common import bounded_batches, documents, whole, without

#: Nodes, checked token pairs and remembered words a worker keeps; each table is started anew beyond.
MOST_NODES, MOST_PAIRS, MOST_WORDS = 2_000_000, 500_000, 400_000
#: Longer words get arrays of their own instead of nodes, so that one text cannot fill the trie.
LONG_WORD = 256
#: Token numbers are written as little-endian unsigned integers of this many bytes.
WIDTH = 4
#: A rank after all others.
NEVER = 1 << 60
DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]

# The parts of a tokenizer file that this operator understands, with the settings it needs.
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
         "byte_fallback": False, "ignore_merges": False}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False}
# Fixed value: the split of a byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _needs(found: dict | None, wanted: dict, what: str) -> None:
    odd = {k: (found or {}).get(k) for k, v in wanted.items() if (found or {}).get(k, v) != v}
    if found is None or odd:
        raise ValueError(f"{what} is not supported: {odd or found}")


class Words:
    """Encodings of words by a trie whose nodes keep last tokens."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.ids = tokens
        self.bytes = {i: t for t, i in tokens.items()}
        self.size = max(self.bytes, default=0) + 1
        self.lengths = {i: len(t) for i, t in self.bytes.items()}
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        #: Tokens spelled backwards: node · 256 + byte → node, and the token that a node completes.
        self.back: dict[int, int] = {}
        self.complete: list[int] = [-1]
        for token, number in tokens.items():
            node = 0
            for byte in reversed(token):
                after = self.back.get(node << 8 | byte)
                if after is None:
                    after = self.back[node << 8 | byte] = len(self.complete)
                    self.complete.append(-1)
                node = after
            self.complete[node] = number
        self.fits: dict[int, bool] = {}
        self.grown: dict[int, tuple | None] = {}
        self.clear()

    def clear(self) -> None:
        #: node · 256 + byte → node; of each node the last token of its prefix and the node where that token begins.
        self.below: dict[int, int] = {}
        self.last, self.start = array("i", [-1]), array("i", [0])
        self.path, self.word = [0], b""

    def merged(self, text: bytes) -> tuple[list[bytes], list[tuple[int, bytes]], list[tuple[int, bytes]]]:
        """BPE by its definition: the pair of the lowest rank is merged first, the leftmost of equals.

        Besides the parts left in the end, the first and the last part over time: (rank of the merge that made it, part).
        """
        parts = [text[i : i + 1] for i in range(len(text))]
        first, final = [(-1, parts[0])], [(-1, parts[-1])]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(pair, NEVER), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if i == 0:
                first.append((rank, parts[0]))
            if i == len(parts) - 1:
                final.append((rank, parts[-1]))
        return parts, first, final

    def edges(self, token: int) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]] | None:
        """How a token's two ends grow: (part, rank of the merge that swallows it); None if the merges do not make the token."""
        if token not in self.grown:
            parts, *ends = self.merged(self.bytes[token])
            steps = [[(part, after[0]) for (_, part), after in zip(e, [*e[1:], (NEVER, b"")], strict=True)] for e in ends]
            self.grown[token] = tuple(steps) if len(parts) == 1 else None
        return self.grown[token]

    def neighbours(self, left: int, right: int) -> bool:
        """The merges leave the two tokens as they are; without a left one (-1), the right one alone.

        Until something merges across the border, each token is made as it is alone. So only
        the parts at the border are followed through time: it is crossed when the rank of the
        two comes before the merges that swallow either, at equal rank the leftmost place first.
        """
        if len(self.fits) >= MOST_PAIRS:
            self.fits.clear()
        own = self.edges(right)
        others = None if left < 0 else self.edges(left)
        fit = own is not None and (left < 0 or others is not None)
        if fit and others is not None:
            a, b, i, j = others[1], own[0], 0, 0
            while True:
                (x, until_x), (y, until_y) = a[i], b[j]
                rank = self.ranks.get((x, y), NEVER)
                if rank < until_x and rank <= until_y and rank != NEVER:
                    fit = False
                    break
                if until_x == until_y == NEVER:
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
        self.fits[left * self.size + right] = fit
        return fit

    def last_token(self, word: bytes, end: int, last, path) -> int:
        """The token that ends the encoding of ``word[:end]``; ``last[path[i]]`` is that of ``word[:i]``."""
        back, complete, ends, node, at = self.back, self.complete, [], 0, end
        while at:
            at -= 1
            node = back.get(node << 8 | word[at])
            if node is None:
                break
            token = complete[node]
            if token >= 0:
                ends.append((token, at))
        fits, size = self.fits, self.size
        for token, at in reversed(ends):
            before = last[path[at]]
            fit = fits.get(before * size + token)
            if self.neighbours(before, token) if fit is None else fit:
                return token
        raise ValueError("the vocabulary lacks single bytes")

    def insert(self, word: bytes) -> int:
        """The node of a word. New nodes get their last tokens on the way down; in sorted order that is a depth-first walk."""
        path, before = self.path, self.word
        depth, limit = 0, min(len(word), len(before))
        while depth < limit and word[depth] == before[depth]:
            depth += 1
        del path[depth + 1 :]
        self.word, below, last, start, lengths = word, self.below, self.last, self.start, self.lengths
        node = path[depth]
        for end in range(depth + 1, len(word) + 1):
            key = node << 8 | word[end - 1]
            node = below.get(key)
            if node is None:
                token = self.last_token(word, end, last, path)
                node = below[key] = len(last)
                last.append(token)
                start.append(path[end - lengths[token]])
            path.append(node)
        return node

    def encode(self, word: bytes) -> bytes:
        """The token numbers of a word, packed."""
        if len(word) > LONG_WORD:
            return self.encode_long(word)
        if len(self.last) >= MOST_NODES:
            self.clear()
        node, ids = self.insert(word), array("I")
        while node:
            ids.append(self.last[node])
            node = self.start[node]
        return packed(ids[::-1])

    def encode_long(self, word: bytes) -> bytes:
        last = array("i", [-1])
        for end in range(1, len(word) + 1):
            last.append(self.last_token(word, end, last, range(end)))
        end, ids = len(word), array("I")
        while end:
            ids.append(last[end])
            end -= self.lengths[last[end]]
        return packed(ids[::-1])


def packed(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def unpacked(data: bytes) -> array:
    import sys

    ids = array("I")
    ids.frombytes(data)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


class TrieCodec:
    """Texts to packed token numbers and back, by the content of a tokenizer file."""

    def __init__(self, content: bytes) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model = spec["model"]
        _needs(model, MODEL, "this model")
        _needs(spec.get("pre_tokenizer"), BYTE_LEVEL, "this pre-tokenizer")
        if spec.get("normalizer") is not None:
            raise ValueError("normalizers are not supported")
        letters = byte_letters()
        spelled = lambda token: bytes(letters[c] for c in token)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for a in spec["added_tokens"]:
            _needs(a, ADDED, f"added token {a['content']!r}")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocabulary = {spelled(t): i for t, i in model["vocab"].items() if t not in self.added}
        self.trie = Words(vocabulary, [(spelled(a), spelled(b)) for a, b in merges])
        #: Of added tokens that match at one place the longest counts.
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.latin = Splitter(PATTERN)
        self.pre_tokenizer = Tokenizer.from_str(content.decode()).pre_tokenizer
        self.known: dict[str, bytes] = {}
        self.spelled = self.trie.bytes | {i: t.encode() for t, i in self.added.items()}

    def split(self, text: str) -> Iterable[str]:
        """Words of a text. Beyond Latin letters the classes of characters are those of the tokenizers library's own tables."""
        if self.latin.other.search(text):
            return (text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text))
        return self.latin(text)

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at added tokens: (piece, whether it is one)."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed token numbers of each text; all words that are new are inserted first, in sorted order."""
        cut = [[(p if special else list(self.split(p)), special) for p, special in self.pieces(t)] for t in texts]
        known = self.known
        new = {w for text in cut for words, special in text if not special for w in words if w not in known}
        if len(known) + len(new) > MOST_WORDS:
            known.clear()
            new = {w for text in cut for words, special in text if not special for w in words}
        for raw, word in sorted((w.encode("utf-8", "replace"), w) for w in new):
            known[word] = self.trie.encode(raw)
        added = {t: packed(array("I", [i])) for t, i in self.added.items()}
        return [b"".join(added[w] if special else b"".join(map(known.__getitem__, w)) for w, special in text) for text in cut]

    def decode(self, data: bytes) -> str:
        """The text of packed token numbers; bytes that form no character become U+FFFD."""
        return b"".join(map(self.spelled.__getitem__, unpacked(data))).decode("utf-8", "replace")


_codecs: dict[str, TrieCodec] = {}


def codec(content: bytes) -> TrieCodec:
    """The codec of a tokenizer file's content, built once in each worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = TrieCodec(content)
    return _codecs[key]


def tokenizer_file(spark: SparkSession, path: str) -> Broadcast:
    """The content of a tokenizer file of the driver, a few megabytes for 50,000 tokens."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """All rows of ``docs`` with ``ids``: the token numbers of the text; none for a null or empty one.

    Added tokens that a text spells out are taken as such, as the library does by default.
    Repeated rows are encoded alike; an empty table gives an empty table. Input columns
    named ``ids`` or ``_text`` are left out.
    """
    bounded_batches(docs.sparkSession)
    content = tokenizer_file(docs.sparkSession, path)
    docs = without(docs, "ids", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value)
        for batch in batches:
            ids = [pa.array(unpacked(d), pa.int64()) for d in own.encode_batch(batch.column("_text").to_pylist())]
            kept = batch.drop_columns(["_text"])
            values = pa.array([i.tolist() for i in ids], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, values], [*kept.schema.names, "ids"])

    return docs.withColumn("_text", whole("text")).mapInArrow(run, docs.withColumn("ids", F.array().cast("array<long>")).schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """All rows with ``decoded``: the text of their ``ids``, added tokens included; empty for null or no ids."""
    bounded_batches(rows.sparkSession)
    content = tokenizer_file(rows.sparkSession, path)
    rows = without(rows, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value)
        for batch in batches:
            texts = [own.decode(packed(array("I", ids or ()))) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, rows.withColumn("decoded", F.lit("")).schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Rows without their text, with n_tokens and digests of the packed token numbers and of the decoded text.

    Encoding and decoding follow each other in one task, so that token numbers never leave
    it. Nulls, empty texts, repeated rows and clashing names are treated as by ``encode``.
    """
    bounded_batches(docs.sparkSession)
    content = tokenizer_file(docs.sparkSession, path)
    source = without(docs, *DIGESTS, "_text").withColumn("_text", whole("text")).drop("text")
    schema = source.drop("_text").withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            ids = own.encode_batch(batch.column("_text").to_pylist())
            kept = batch.drop_columns(["_text"])
            columns = [
                pa.array([len(d) // WIDTH for d in ids], pa.int64()),
                pa.array(map(sha, ids), pa.string()),
                pa.array([sha(own.decode(d).encode()) for d in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, *DIGESTS])

    return source.mapInArrow(run, schema)


def op12_trie_bpe(spark, folder: str) -> DataFrame:
    """Token digests of all documents."""
    import public_tokenizers

    return round_trip(documents(spark, folder).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
