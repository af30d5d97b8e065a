"""Operator 2: BPE encoding and decoding with an existing vocabulary, by a contiguous rank array."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import pick, pieces

CACHED_WORDS = 120_000
SHORT = 256
#: In these ranges the letter, number, space and case classes are the same in all Unicode versions since 6.
_ODD = re.compile("[^\x00-ʯΑ-ΡΣ-ωЀ-ӿ‐-‧€]")
_PLAIN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
FIELDS = {
    "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}
_DDL = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible, else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file; merges are its own, the file's library only normalises rare scripts."""

    def __init__(self, model: str) -> None:
        spec = json.loads(model)
        self._model = model
        self._library = None
        self.end = spec["model"]["end_of_word_suffix"]
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.pairs[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self._split = regex.compile(_PLAIN).findall
        self._letters = byte_letters()
        self._table = {b: c for b, c in enumerate(self._letters)}
        self.words: dict[str, tuple[bytes, str]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Repeatedly join the adjacent pair of least rank, the leftmost first."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        none = 1 << 30
        pairs = self.pairs
        parts = list(ids)
        ranks = [pairs.get(p, (none, 0))[0] for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i] = pairs[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = pairs.get((parts[i], parts[i + 1]), (none, 0))[0]
            if i:
                ranks[i - 1] = pairs.get((parts[i - 1], parts[i]), (none, 0))[0]
        return parts

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same order of merges by a queue and a linked list: a scan per merge would be quadratic in a long word."""
        parts, n = list(ids), len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        queue = [(p[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (p := self.pairs.get((parts[i], parts[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.pairs[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (p := self.pairs.get((parts[left], parts[right]))):
                    heapq.heappush(queue, (p[0], left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def word(self, letters: str) -> tuple[bytes, str]:
        """Packed ids and decoded text of one word in byte letters."""
        symbols = [*letters[:-1], letters[-1] + self.end]
        ids = self.merge([self.vocab[s] for s in symbols])
        return array("I", ids).tobytes(), " ".join(self.names[i] for i in ids)

    def _known(self, word: str) -> tuple[bytes, str]:
        found = self.words.get(word)
        if found is None:
            found = self.words[word] = self.word(word.encode().decode("latin-1").translate(self._table))
        return found

    def part(self, text: str) -> list[tuple[bytes, str]]:
        """Words of a stretch without special tokens."""
        if not text.isascii() and _ODD.search(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_str(self._model)
            normal = self._library.normalizer.normalize_str(text)
            return [self.word(w) for w, _ in self._library.pre_tokenizer.pre_tokenize_str(normal) if w]
        plain = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return [*map(self._known, self._split(plain.lower()))]

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Packed ids (unsigned 32-bit, little-endian) and the decoded text; null counts as empty."""
        if not text:
            return b"", ""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        out: list[tuple[bytes, str]] = []
        for i, stretch in enumerate(self._special.split(text) if "<|" in text else [text]):
            if i % 2:
                out.append((array("I", [self.specials[stretch]]).tobytes(), stretch))
            elif stretch:
                out += self.part(stretch)
        return b"".join([a for a, _ in out]), " ".join([b for _, b in out])

    def decode(self, ids: Sequence[int]) -> str:
        """The vocabulary's strings, joined by a blank, as a file without a decoder asks for."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_made: dict[str, WordBpe] = {}


def engine(model: str) -> WordBpe:
    if model not in _made:
        _made.clear()
        _made[model] = WordBpe(model)
    return _made[model]


def bpe(docs: DataFrame, path: str, outputs: Sequence[str] = ("n_tokens", "ids", "decoded"), doc_id: str = "doc_id",
        text: str = "text") -> DataFrame:
    """Encode each whole text with the vocabulary file at ``path`` and decode the ids again; one row per row.

    ``outputs`` are among n_tokens, ids, decoded, ids_sha256 and decoded_sha256 (lowercase hex of the ids as
    little-endian unsigned 32-bit integers, and of the decoded text in UTF-8). Strings of special tokens in a text
    become those tokens, as in the file's library. A null or empty text has no tokens and decodes to the empty text;
    a null id is kept; repeated rows are encoded alike; an empty table gives an empty one; other columns are ignored.
    The work is one map without a shuffle; the vocabulary file (under 2 MB) is broadcast, words are cached per worker
    up to a fixed number.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    wanted = list(outputs)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = engine(model.value)
        for batch in batches:
            for some in pieces(batch, "t"):
                rows: dict[str, list] = {name: [] for name in wanted}
                for value in some.column("t").to_pylist():
                    packed, decoded = coder.encode(value)
                    made = {
                        "n_tokens": lambda: len(packed) // 4, "ids": lambda: array("I", packed),
                        "decoded": lambda: decoded, "ids_sha256": lambda: hashlib.sha256(packed).hexdigest(),
                        "decoded_sha256": lambda: hashlib.sha256(decoded.encode()).hexdigest(),
                    }
                    for name in wanted:
                        rows[name].append(made[name]())
                columns = [pa.array(rows[name], type=FIELDS[name]) for name in wanted]
                yield pa.RecordBatch.from_arrays([some.column("d"), *columns], [doc_id, *wanted])

    schema = ", ".join([f"`{doc_id}` {kind}", *[f"{name} {_DDL[name]}" for name in wanted]])
    return pick(docs, d=doc_id, t=text).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the decoded text of a column of ids; null ids give null, ids outside the vocabulary are skipped."""
    with open(path, encoding="utf-8") as file:
        model = encoded.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def text(column):
        coder = engine(model.value)
        return column.map(lambda x: None if x is None else coder.decode(x))

    return encoded.withColumn(out, text(F.col(ids)))
