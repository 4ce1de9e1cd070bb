import random
from hashlib import sha256

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tidemark.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["", "A b.\nC d", "a  b \n\n c\t", " x\n y ", "it's <|endoftext|><|endoftext|> ok", "é ß 🙂　\x85 \x1c1", "a" * 5000, "ab" * 300, None, "\n", " "]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(open(PATH, encoding="utf-8").read())


def test_same_ids_as_the_library_on_random_texts(vocabulary):
    rnd = random.Random(5)
    parts = ["aaaa", "the", "ing", " ", "\n", "'s", "é", "<|endoftext|>", "123", "==", "  ", "\t", "　", "\x85", "🙂", "'", "ll"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(rnd.choice("abcdetnhio") for _ in range(rnd.randint(1, 50))) for _ in range(2000)]
    for text in texts:
        joined, packed = vocabulary.encode(text)
        assert joined == ",".join(map(str, library(text)))
        assert vocabulary.decode(np.frombuffer(packed, "<u4")).decode() == text


def test_white_space_of_every_kind_next_to_separators(vocabulary):
    for c in [c for c in map(chr, range(0x3001)) if c.isspace()]:
        for text in (f"a{c} b", f"a {c}b", f"{c}\n{c}", f"a\n{c} x", f" {c} \n"):
            assert vocabulary.encode(text)[0] == ",".join(map(str, library(text)))


def test_digests_encode_and_decode(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], None)], "doc_id long, text string, ids string")
    got = bpe.digests(docs, PATH).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = TEXTS[r["doc_id"]] or ""
        ids = library(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == sha256(text.encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
