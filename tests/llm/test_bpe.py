import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stowline.llm.bpe import WordBpe, bpe, decode_ids
from tests.llm.data import SF_DIR, docs_frame, table_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def by_library(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_words_agree_with_library(library):
    coder = WordBpe(open(PATH, encoding="utf-8").read())
    rng = random.Random(5)
    pools = ["abcde '", "aé́ßΣİ 's", "<|endoftext|>x ", "12 ab'll\x1c\x85\xa0 ", "日本語かな한국 a", "😀👍🏽 z‍", "ⅣⅫ①½ a"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 400, "-" * 3000, "<|endoftext|><|startoftext|>", "<|endoftext", " ", "don't WE'LL"]
    for text in texts:
        packed, decoded = coder.encode(text)
        ids, want = by_library(library, text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids, repr(text)
        assert decoded == want and coder.decode(ids) == want


def test_whole_table(spark, library):
    from stowline.llm.queries import QUERIES

    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op2_bpe"](spark, SF_DIR).collect()}
    for doc_id, text in table_rows("documents", "doc_id, text"):
        ids, decoded = by_library(library, text)
        assert got.pop(doc_id) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                                   hashlib.sha256(decoded.encode()).hexdigest())
    assert not got


def test_edges(spark, library):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "x"), (4, "word " * 50_000)]
    out = bpe(docs_frame(spark, rows), PATH, ("n_tokens", "ids", "decoded"))
    got = sorted(((r.doc_id, r.n_tokens, r.decoded) for r in out.collect()), key=str)
    want = sorted(((d, len(by_library(library, t)[0]), by_library(library, t)[1]) for d, t in rows), key=str)
    assert got == want
    assert all(r.decoded == r.again for r in decode_ids(out, PATH, out="again").collect())
    assert bpe(docs_frame(spark, []), PATH).count() == 0
