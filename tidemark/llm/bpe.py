"""Byte-level BPE encoding by backtracking over longest token matches, and decoding with an offset table.

The encoder never replays merges. An Aho-Corasick automaton over all tokens gives the longest token at each place of a
pre-token; tokens are taken greedily from the left, and a token is accepted only if it is compatible with the one before
it, that is, if the two stay apart when their joint bytes are merged. Where no token fits, the last one is taken back and
the next shorter one tried; a place that failed once is never tried again, so the work is linear. Any token sequence whose
neighbours are all compatible is the one that the merges give.

Compatibility is decided from the ranks at which the tokens along the touching edges come into being, and is kept in a
table. Pre-tokens repeat, so their ids are kept too, in two generations of bounded size.

Added tokens that stand in the text become their own ids first, as the file asks. Null text counts as an empty one, with
no ids. Texts of any length are encoded whole. Repeated rows are encoded each for itself; empty tables give empty
results. Only the named columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import worker_state

#: the pattern of the byte-level pre-tokenizer, a fixed value
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 200_000
FOREVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file, ready to encode and decode."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.raw = [b""] * size
        for token, i in vocab.items():
            self.raw[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            self.raw[i] = token.encode()
        self.blob = np.frombuffer(b"".join(self.raw), np.uint8)
        self.length = np.array([len(t) for t in self.raw], np.int64)
        self.offset = np.cumsum(self.length) - self.length

        self.rank, self.left, self.right, self.pair = {}, {}, {}, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, ab = vocab[a], vocab[b], vocab[a + b]
            self.pair[a, b] = rank
            if ab not in self.rank:
                self.rank[ab], self.left[ab], self.right[ab] = rank, a, b

        self.automaton = ahocorasick.Automaton()
        by_bytes = {self.raw[i].decode("latin-1"): i for i in vocab.values()}
        for token, i in by_bytes.items():
            self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for token, i in by_bytes.items():
            self.shorter[i] = next((by_bytes[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in by_bytes), -1)
        self.sizes = [len(t) for t in self.raw]
        self.added = added
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.split = regex.compile(PATTERN).findall
        self.apart: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}
        self.spaced: dict[str, tuple[str, bytes]] = {}
        self.bare: dict[str, tuple[str, bytes]] = {}

    def edge(self, token: int, half: dict[int, int]) -> list[tuple[int, int, int]]:
        """(token, rank that makes it, rank that merges it away) along one edge, from the whole token inwards."""
        found, ends = [], FOREVER
        while True:
            made = self.rank.get(token, -1)
            found.append((token, made, ends))
            if token not in half:
                return found
            token, ends = half[token], made

    def compatible(self, a: int, b: int) -> bool:
        """Whether a stays before b: no two pieces along the seam exist at the same time and merge before either is
        merged within its own token. Of two equal merges that overlap the left one comes first."""
        known = self.apart.get((a, b))
        if known is None:
            known = True
            seam = self.edge(b, self.left)
            for x, made_x, ends_x in self.edge(a, self.right):
                for y, made_y, ends_y in seam:
                    rank = self.pair.get((x, y))
                    if rank is not None and made_x < rank and made_y < rank and rank < ends_x and rank <= ends_y:
                        known = False
            if len(self.apart) > 2 * CACHE:
                self.apart.clear()
            self.apart[a, b] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, its bytes given as Latin-1 text."""
        n = len(piece)
        longest, width = [-1] * (n + 1), [0] * n
        for end, (token, size) in self.automaton.iter(piece):
            start = end + 1 - size
            if size > width[start]:
                longest[start], width[start] = token, size
        out: list[int] = []
        sizes, shorter, apart = self.sizes, self.shorter, self.apart
        failed = bytearray(n + 1)
        at, token = 0, longest[0]
        while token >= 0:
            end = at + sizes[token]
            if not failed[end] and (not out or (apart[out[-1], token] if (out[-1], token) in apart else self.compatible(out[-1], token))):
                out.append(token)
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0 and out:
                # nothing fits here: take the last token back and go on with a shorter one in its place
                failed[at] = 1
                at -= sizes[out[-1]]
                token = shorter[out.pop()]
        return out

    def lookup(self, piece: str) -> tuple[str, bytes]:
        """The ids of a pre-token, as decimal text and as little-endian 32-bit integers."""
        found = self.older.get(piece)
        if found is None:
            ids = self.encode_piece(piece.encode().decode("latin-1"))
            found = (",".join(map(str, ids)), np.array(ids, "<u4").tobytes())
        if len(self.known) >= CACHE:
            self.older, self.known = self.known, {}
        if len(piece) <= 64:
            self.known[piece] = found
        return found

    def word(self, word: str, spaced: bool) -> tuple[str, bytes] | None:
        """The ids of a word between single separators, with the space before it if spaced; None if the word is empty or
        has white space at an end, for then its pre-tokens depend on its neighbours."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        parts = [self.known.get(p) or self.lookup(p) for p in self.split(" " + word if spaced else word)]
        found = ",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])
        words = self.spaced if spaced else self.bare
        if len(words) >= CACHE:
            words.clear()
        if len(word) <= 64:
            words[word] = found
        return found

    def encode_span(self, text: str) -> list[tuple[str, bytes]]:
        """Ids of the parts of a text without added tokens. A single space starts a pre-token and a single newline is
        one, so words between them are looked up whole; any other white space has the pattern applied to all the text."""
        parts: list[tuple[str, bytes] | None] = []
        newline = self.lookup("\n")
        for i, line in enumerate(text.split("\n")):
            if i:
                parts.append(newline)
            words = line.split(" ")
            parts.append(self.bare.get(words[0]) or self.word(words[0], False))
            if parts[-1] is None:
                break
            spaced, word = self.spaced.get, self.word
            parts += [spaced(w) or word(w, True) for w in words[1:]]
        if None in parts:
            return [self.known.get(p) or self.lookup(p) for p in self.split(text)]
        return parts

    def encode(self, text: str) -> tuple[str, bytes]:
        """Ids of a text, as decimal text joined by commas and as little-endian 32-bit integers."""
        if self.cut is None or not any(t in text for t in self.added):
            parts = self.encode_span(text)
        else:
            parts = []
            for i, span in enumerate(self.cut.split(text)):
                if i % 2:
                    parts.append((str(self.added[span]), np.array([self.added[span]], "<u4").tobytes()))
                elif span:
                    parts += self.encode_span(span)
        return ",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids: each one's place in the joint table of tokens is its offset."""
        if not len(ids):
            return b""
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.offset[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.blob[places].tobytes()


def loaded(text: str) -> Vocabulary:
    """The vocabulary of a file's text, built once in a worker."""
    return worker_state(f"bpe {hash(text)}", lambda: Vocabulary(text))


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, row, schema: str, types: list[pa.DataType]) -> DataFrame:
    """row(vocabulary, text) -> values of the columns after doc_id."""
    with open(path, encoding="utf-8") as f:  # a vocabulary file is a few MB, whatever the size of docs
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(spec.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = [row(vocabulary, t.as_py() or "") for t in batch["text"]]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id long, {schema}")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of every whole text."""

    def row(vocabulary: Vocabulary, text: str):
        ids = np.frombuffer(vocabulary.encode(text)[1], "<u4").astype(np.int32)
        return len(ids), ids

    return _mapped(docs, path, id_col, text_col, row, "n_tokens long, ids array<int>", [pa.int64(), pa.list_(pa.int32())])


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of the ids (null ids: no text); bytes that are no UTF-8 become U+FFFD."""

    def row(vocabulary: Vocabulary, ids: list[int] | str):
        return (vocabulary.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace"),)

    return _mapped(tokens, path, id_col, ids_col, row, "text string", [pa.string()])


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids and of the text that decoding them gives."""

    def row(vocabulary: Vocabulary, text: str):
        joined, packed = vocabulary.encode(text)
        back = vocabulary.decode(np.frombuffer(packed, "<u4")).decode("utf-8", "replace")
        return len(packed) // 4, sha256(joined.encode()).hexdigest(), sha256(back.encode()).hexdigest()

    return _mapped(docs, path, id_col, text_col, row, "n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()])
