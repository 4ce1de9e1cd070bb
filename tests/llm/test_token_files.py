import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tidemark.llm import token_files  # noqa: E402

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def made():
    rnd = random.Random(8)
    parts = ["the", "The ", "É", "é", "é", " ", "\n", "  ", "\t", "\x1c", "\x85", "'s", "<|endoftext|>", "123", "ß", "İ", "Σ", "ing", ",", "　", "́"]
    docs = [(i * 5 - 100, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 80))), "x", 1) for i in range(200)]
    docs += [(7, None, "x", 1), (8, "", "x", 1), (9, "ab cd " * 3000, "x", 1), (11, "same", "x", 1), (11, "same", "x", 1)]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_round_trip_equals_the_library(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", block)
    docs = made()
    out = str(tmp_path / "tokens")
    token_files.write_tokens(spark.createDataFrame(docs, "doc_id long, text string, ids string, task int").repartition(5), PATH, out)
    got = {(r["start"], r["doc_id"]): r for r in token_files.read_digests(spark, out).collect()}
    assert len(got) == len(docs)
    at = 0
    for doc_id, text, *_ in sorted(docs, key=lambda r: r[0]):
        want = ids_of(text)
        r = got[at, doc_id]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    back = {r["start"]: r["ids"] for r in token_files.read_tokens(spark, out).collect()}
    assert sum(map(len, back.values())) == at


def test_grammar_round_trip_and_random_access():
    rnd = np.random.default_rng(3)
    for vocabulary, n in ((10, 5000), (49408, 5000), (70000, 3000), (10, 0)):
        ids = [rnd.integers(0, min(vocabulary, 12), rnd.integers(0, 400)) for _ in range(n // 200)] + [np.zeros(501, int), np.zeros(0, int)]
        block = token_files.Block(token_files.packed([*range(len(ids) - 1), None], ids, vocabulary))
        assert block.doc_ids[-1] is None
        assert np.array_equal(block.ids(), np.concatenate(ids))
        for i, own in enumerate(ids):
            assert np.array_equal(block.ids(i), own)
        assert len(block.rules) and len(block.symbols) < sum(map(len, ids))
        for i, (a, b) in enumerate(block.rules.tolist()):
            assert block.lengths[i] == block.length[a] + block.length[b]


def test_empty_table_and_null_id(spark, tmp_path):
    out = str(tmp_path / "none")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH, out)
    assert token_files.read_digests(spark, out).collect() == []
    out = str(tmp_path / "null")
    token_files.write_tokens(spark.createDataFrame([(None, "a"), (1, "b")], "doc_id long, text string"), PATH, out)
    assert [(r["doc_id"], r["start"]) for r in sorted(token_files.read_digests(spark, out).collect(), key=lambda r: r["start"])] == [(None, 0), (1, 2)]


def test_added_tokens_in_other_spellings(spark):
    rnd = random.Random(3)
    words = token_files.Words(open(PATH, encoding="utf-8").read())
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "<|", "|>", "<", "Ab", "ENDOFTEXT", "x,", "It's", "!?", "9", " ", " ", "\n", "É"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, text


def greedy(ids, vocabulary):
    """Symbols and rules of exact Re-Pair: the most frequent pair is replaced, one at a time, until none is frequent."""
    symbols, rules = list(ids), 0
    while True:
        counts, at = {}, 0
        while at < len(symbols) - 1:
            pair = symbols[at], symbols[at + 1]
            counts[pair] = counts.get(pair, 0) + 1
            at += 2 if pair[0] == pair[1] and at + 2 < len(symbols) and symbols[at + 2] == pair[0] else 1
        pair, n = max(counts.items(), key=lambda x: x[1], default=(None, 0))
        if n < token_files.LEAST_COUNT:
            return len(symbols), rules
        out, at = [], 0
        while at < len(symbols):
            if symbols[at : at + 2] == list(pair):
                out.append(vocabulary + rules)
                at += 2
            else:
                out.append(symbols[at])
                at += 1
        symbols, rules = out, rules + 1


def test_as_small_as_exact_replacement():
    rnd = random.Random(4)
    phrases = [[rnd.randrange(400) for _ in range(rnd.randint(2, 9))] for _ in range(60)]
    ids = [x for _ in range(2500) for x in (rnd.choice(phrases) if rnd.random() < 0.8 else [rnd.randrange(400)])]
    symbols, ends, rules = token_files.compress(np.array(ids), np.array([len(ids)]), 400)
    n, r = greedy(ids, 400)
    assert ends[-1] == len(symbols) and 2 * len(symbols) + 12 * len(rules) < 1.2 * (2 * n + 12 * r)


def test_every_latin_character_in_every_place():
    words = token_files.Words(open(PATH, encoding="utf-8").read())
    texts = []
    for c in map(chr, [*range(1, 0x370), 0x1E9E, 0x212B, 0x3C2]):
        texts += [f"{c}", f"ab{c}", f"AB{c},", f"{c}é.", f"x {c}{c} y", f"a{c}b's"]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, ascii(text)


def test_only_words_that_end_in_marks_are_matched(monkeypatch):
    seen = []
    monkeypatch.setattr(token_files.pc, "extract_regex", lambda words, pattern, f=token_files.pc.extract_regex: (seen.extend(words.to_pylist()), f(words, pattern))[1])
    words = token_files.Words(open(PATH, encoding="utf-8").read())
    texts = ["One, two. three", "...", "four!? FIVE", None, "", "a.b é."]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert [*ids.tolist(), 1] == ids_of(text)
    assert sorted(seen) == sorted(["one,", "two.", "...", "four!?", "é."])
