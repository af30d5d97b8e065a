import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from stowline.llm.pieces import PieceCoder, decode_pieces, encode_pieces, readable
from tests.llm.data import SF_DIR, docs_frame, table_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    with open(PATH, "rb") as file:
        return PieceCoder(file.read())


def by_library(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return ids, library.decode(ids)


def unpacked(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_texts_agree_with_library(library, coder):
    rng = random.Random(5)
    pools = ["abcdeghinorstu ", "aé́ßΣİ 's", "▁ \n\t\r", "12 ab'll\x1c\x85\xa0 ", "日本語かな한국 a", "😀👍🏽 z‍", "ⅣⅫ①½ a�",
             "<s></s><unk><0x41>", "ththeherin  er"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    names = [library.id_to_piece(i) for i in range(259, 8000)]
    texts += ["".join(rng.choice(names) for _ in range(25)) for _ in range(500)]
    texts += ["a" * 5000, "ab" * 400, " " * 100, "\n" * 40, "-" * 3000, "the" * 1000, "", " ", "a\x00b"]
    for text in texts:
        packed, decoded = coder.encode(text)
        ids, want = by_library(library, text)
        assert unpacked(packed) == ids, repr(text)
        assert decoded == want and coder.decode(ids) == want


def test_any_ids_are_decoded_as_in_library(library, coder):
    rng = random.Random(6)
    for _ in range(2000):
        ids = [rng.randrange(300 if rng.random() < 0.5 else 32_000) for _ in range(rng.randint(0, 12))]
        assert coder.decode(ids) == library.decode(ids), ids
    assert readable(b"a\xe6\x97\xa5\xe6b\xff") == "a日�b�"


def test_compatibility_by_edges_equals_merging(coder):
    rng = random.Random(7)
    names = sorted(n for n in coder.ids if len(n) > 1 and coder.merged(n) == [n])
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(5000)]
    cut = [(a, b) for n in rng.sample(names, 1500) for i in range(1, len(n)) if (a := n[:i]) in coder.ids and (b := n[i:]) in coder.ids]
    for a, b in pairs + [p for p in cut if all(coder.merged(x) == [x] for x in p)]:
        assert coder.compatible(a, b) == (coder.merged(a + b) == [a, b]), (a, b)


def test_whole_table(spark, library):
    from stowline.llm.queries import QUERIES

    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_sentencepiece"](spark, SF_DIR).collect()}
    for doc_id, text in table_rows("documents", "doc_id, text"):
        ids, decoded = by_library(library, text)
        assert got.pop(doc_id) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                                   hashlib.sha256(decoded.encode()).hexdigest())
    assert not got


def test_edges(spark, library):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "x"), (4, "word " * 50_000), (5, "w" * 100_000)]
    out = encode_pieces(docs_frame(spark, rows), PATH)
    got = sorted(((r.doc_id, r.n_tokens, r.decoded) for r in out.collect()), key=str)
    want = sorted(((d, len(by_library(library, t)[0]), by_library(library, t)[1]) for d, t in rows), key=str)
    assert got == want
    assert all(r.decoded == r.again for r in decode_pieces(out, PATH, out="again").collect())
    assert encode_pieces(docs_frame(spark, []), PATH).count() == 0
