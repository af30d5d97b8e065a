"""Operator 13: SentencePiece encoding and decoding with an existing merge model, by a table over prefixes.

Every prefix of a stretch has one segmentation, so one last token. A token that ends a prefix, as an automaton over the
vocabulary finds it, is that last token if it stays whole by itself and is compatible with the last token of the
prefix before it: merging the two strings from their characters gives the two tokens again. Merges are local, so a
sequence whose neighbours are all compatible is the segmentation. The table is filled left to right in one pass;
ids are then recovered from its end backwards.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import pick, pieces

SPACE = "▁"
CACHED_STRETCHES = 300_000
CACHED_PAIRS = 1_000_000
CACHED_LENGTH = 64
FIELDS = {
    "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}
_DDL = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


class PieceCoder:
    """Encoder and decoder of one model file; the library only reads the file's pieces and scores."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = [i for i in range(own.get_piece_size())
                 if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))]
        self.begin, self.end = own.bos_id(), own.eos_id()
        self.names = {i: own.id_to_piece(i) for i in plain}
        self.ids = {p: i for i, p in self.names.items()}
        self.scores = {p: own.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = {i: b for b, i in enumerate(self.byte_ids)}
        self.unknown, self.surface = own.unk_id(), own.decode([own.unk_id()])
        self._pairs: dict[tuple[str, str], bool] = {}
        self._known: dict[str, tuple[bytes, str]] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self._split: dict[str, tuple[str, str]] = {}
        for p in self.ids:
            if len(p) > 1 and self.merged(p) == [p]:
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self._edges: dict[tuple[str, int], list[tuple[str, float, float]] | None] = {}
        # Certain boundaries: around a character of no longer piece, and before a blank if none stands inside a piece.
        inner = sorted({c for p in self.ids if len(p) > 1 for c in p} - {SPACE})
        some = "[" + "".join(map(re.escape, inner)) + "]"
        free = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        joined = f"{SPACE}*{some}+|{SPACE}+" if free else f"(?:{SPACE}|{some})+"
        self.stretches = re.compile(f"{joined}|.", re.DOTALL).findall

    def merged(self, text: str) -> list[str]:
        """Merge adjacent parts of best joint score, the leftmost first, from single characters on; for short strings."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            if len(parts) == 2:
                self._split[text] = parts[0], parts[1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: str, side: int) -> list[tuple[str, float, float]] | None:
        """(part, score that made it, score that consumed it) of the parts that once stood at an edge of the token
        (side 0: left, 1: right); None if its merges did not go down in score, so that scores don't tell their order."""
        if (token, side) in self._edges:
            return self._edges[token, side]
        out, part, death, falling = [], token, -math.inf, True
        while True:
            birth = self.scores[part] if len(part) > 1 else math.inf
            out.append((part, birth, death))
            if len(part) == 1:
                break
            falling &= self._falls(part)
            death, part = birth, self._split[part][side]
        if len(self._edges) > CACHED_PAIRS:
            self._edges.clear()
        found = self._edges[token, side] = out if falling else None
        return found

    def _falls(self, token: str) -> bool:
        return len(token) == 1 or all(
            (len(part) == 1 or self.scores[part] >= self.scores[token]) and self._falls(part) for part in self._split[token])

    def compatible(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border of the two tokens."""
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) > CACHED_PAIRS:
                self._pairs.clear()
            found = self._pairs[left, right] = self._apart(left, right)
        return found

    def _apart(self, left: str, right: str) -> bool:
        """Two edge parts merge across the border if they stand there at the same time and their score beats those
        that consume them; of equal scores the left merge is first."""
        ours, theirs = self.edge(left, 1), self.edge(right, 0)
        if ours is None or theirs is None:
            return self.merged(left + right) == [left, right]
        scores = self.scores
        for a, born_a, dead_a in ours:
            for b, born_b, dead_b in theirs:
                score = scores.get(a + b)
                if score is not None and score > dead_a and score >= dead_b and born_b > dead_a and born_a >= dead_b:
                    return False
        return True

    def tokens(self, stretch: str) -> list[str]:
        """Segmentation of a stretch by its prefix table; a character outside the vocabulary is a token by itself."""
        n = len(stretch)
        if n == 1:
            return [stretch]
        # A prefix has exactly one last token, so where no longer token fits it is the single character.
        last = [1] * (n + 1)
        settled, pairs = 0, self._pairs
        for end, size in self.automaton.iter(stretch):
            if end < settled:
                continue
            begin = end + 1 - size
            if begin:
                both = stretch[begin - last[begin]:begin], stretch[begin:end + 1]
                fits = pairs.get(both)
                if not (self.compatible(*both) if fits is None else fits):
                    continue
            last[end + 1], settled = size, end + 1
        out, at = [], n
        while at:
            out.append(stretch[at - last[at]:at])
            at -= last[at]
        return out[::-1]

    def _stretch(self, stretch: str) -> tuple[bytes, str]:
        """Packed ids and decoded text of a stretch."""
        tokens = self.tokens(stretch)
        try:
            ids = [self.ids[t] for t in tokens]
        except KeyError:
            ids = self._ids(tokens)
            return array("I", ids).tobytes(), self._text(ids)
        return array("I", ids).tobytes(), "".join([self.names[i] for i in ids]).replace(SPACE, " ")

    def _ids(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        for token in tokens:
            found = self.ids.get(token)
            out += [found] if found is not None else [self.byte_ids[b] for b in token.encode("utf-8", "surrogatepass")]
        return out

    def _text(self, ids: Sequence[int]) -> str:
        """Pieces as text, bytes in a row read as UTF-8, each byte that fits nowhere as a replacement mark."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(readable(bytes(held)))
                held.clear()
            name = self.names.get(i)
            if name is not None:
                out.append(name.replace(SPACE, " "))
            elif i == self.unknown:
                out.append(self.surface)
        if held:
            out.append(readable(bytes(held)))
        return "".join(out)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Packed ids (unsigned 32-bit, little-endian) with begin and end, and the decoded text; null counts as empty."""
        head, tail = array("I", [self.begin]).tobytes(), array("I", [self.end]).tobytes()
        if not text:
            return head + tail, ""
        if len(self._known) > CACHED_STRETCHES:
            self._known.clear()
        known, packed, read = self._known, [head], []
        for stretch in self.stretches(SPACE + text.replace(" ", SPACE)):
            found = known.get(stretch)
            if found is None:
                found = self._stretch(stretch)
                if len(stretch) <= CACHED_LENGTH:
                    known[stretch] = found
            packed.append(found[0])
            read.append(found[1])
        packed.append(tail)
        # The first blank is the one that encoding put before the text.
        return b"".join(packed), "".join(read)[1:]

    def decode(self, ids: Sequence[int]) -> str:
        """Text of any ids; one blank at the begin is dropped, control ids give nothing."""
        first = next((i for i in ids if i in self.names or i in self.bytes or i == self.unknown), None)
        text = self._text(ids)
        return text[1:] if self.names.get(first, "").startswith(SPACE) else text


def readable(data: bytes) -> str:
    """UTF-8 with one replacement mark for each byte that belongs to no character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at:at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_made: dict[bytes, PieceCoder] = {}


def engine(model: bytes) -> PieceCoder:
    if model not in _made:
        _made.clear()
        _made[model] = PieceCoder(model)
    return _made[model]


def encode_pieces(docs: DataFrame, path: str, outputs: Sequence[str] = ("n_tokens", "ids", "decoded"),
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text with the model file at ``path`` and decode the ids again; one row per row.

    The model must be of the merge type with bytes for unknown characters, an identity normaliser and a blank put
    before the text. Ids start with the begin id and stop with the end id. ``outputs`` are among n_tokens, ids, decoded,
    ids_sha256 and decoded_sha256 (lowercase hex of the ids as little-endian unsigned 32-bit integers, and of the
    decoded text in UTF-8). A null or empty text has begin and end only and decodes to the empty text; a null id is
    kept; repeated rows are encoded alike; an empty table gives an empty one; other columns are ignored. The work is
    one map without a shuffle, linear in the text; the model file (under 1 MB) is broadcast, short stretches between
    certain boundaries are cached per worker up to a fixed number.
    """
    spark = docs.sparkSession
    with open(path, "rb") as file:
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


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the decoded text of a column of ids; null ids give null, ids outside the vocabulary are skipped."""
    with open(path, "rb") as file:
        model = encoded.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def read(column):
        coder = engine(model.value)
        return column.map(lambda x: None if x is None else coder.decode(x))

    return encoded.withColumn(out, read(F.col(ids)))
