"""Token ids in grammar-compressed binary blocks, written in ascending doc_id order and read back at random.

Documents are dealt out by ranges of doc_id and sorted; each task tokenizes its own and cuts them into blocks of about
BLOCK_TOKENS ids (a longer document is a block of its own). A block is a shard of its own grammar: Re-Pair replaces the
most frequent pairs of neighbouring symbols by nonterminals, many pairs in a round, until no pair occurs LEAST_COUNT times
or 16 bits name no further symbol. Pairs never cross documents, so any document can be decoded alone.

The files are Parquet, one row for each block: task, start_in_task (ids of the task before the block), n_docs, n_tokens
and `payload`. All numbers in a payload are little-endian:

  "RPB1", u32 symbol width in bytes, u32 vocabulary size v, u32 rules r, u32 documents d, u32 symbols s
  r x (u32 left, u32 right)   nonterminal v + i stands for left, right; each may be an id or an earlier nonterminal
  r x u32                     ids in the expansion of each nonterminal
  d x i64 doc_id, d x u8 whether doc_id is null, (d + 1) x u32 symbol offset, d x u32 ids of the document
  s x symbol                  u16 if all symbols fit, else u32

A word's ids are those the tokenizers library gives it; single spaces and newlines always part pre-tokens of a
white-space-dropping vocabulary, so texts are split there, equal words are encoded once, and only words that a bounded
cache doesn't hold go to the library.

Null text counts as an empty one, and a document always ends with the end id. Null ids come first; documents with equal
ids are ordered by the hash of the text, and repeated rows are written each for itself. Empty tables give files without
blocks. Only the named columns are read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, worker_state

MAGIC = b"RPB1"
BLOCK_TOKENS = 1 << 20
RULES_A_ROUND = 8000
LEAST_COUNT = 8  # a rule takes 12 bytes in the file, and each pair that it replaces saves 2
CELLS = 1 << 18
LATIN = "\u0250"  # below it nothing is composed, and letters are letters to every version of Unicode
PLAIN = r"^[\x{00}-\x{12F}\x{131}-\x{24F}]*$"  # of these each has one lower-case form, one character long
#: a word that ends in marks behind a letter or digit
MARKS = ".,;:!?|%$&#*"
CORE = r"(?s)^(?P<core>.*[\p{L}\p{N}])(?P<tail>[.,;:!?|%$&#*]+)$"
CACHE = 1_000_000  # about 200 bytes each
PIECE = 8 << 20  # bytes of text that are encoded together
BLOCKS = "task int, start_in_task long, n_docs int, n_tokens long, payload binary"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte above 127 and below the vocabulary's: printable ones for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


class Words:
    """A tokenizer whose ids of word pieces are kept, numbered. Made once in a worker."""

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        rules = json.loads(spec)
        steps = (rules.get("normalizer") or {}).get("normalizers", [])
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        # lower-casing, and letters apart from marks
        self.lowers = any(x["type"] == "Lowercase" for x in steps) and any(r"|[^\s\p{L}\p{N}]+" in str(x.get("pattern", {}).get("Regex")) for x in splits)
        # a word of letters is one pre-token, so the model's ids of it are the tokenizer's
        self.direct = self.lowers and any(x["type"] == "ByteLevel" and not x.get("add_prefix_space") for x in splits)
        self.letters = byte_letters()
        decoder = self.tokenizer.get_added_tokens_decoder()
        first = sorted({re.escape(t.content[0]) for t in decoder.values()})
        self.begins = "|".join(first)
        self.mark, self.mark_id = next(((t.content, i) for i, t in decoder.items() if t.special), (None, None))
        self.clear()

    def clear(self) -> None:
        """Forgets all pieces but the empty one, which has number 0."""
        self.number: dict[str, int] = {"": 0}
        self.begin, self.count = np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.ids = np.zeros(0, np.int32)

    def joined(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of words, many in a call: a special token stands between them, so their pre-tokens never meet."""
        found: dict[str, list[int]] = {}
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids
            cuts = [i for i, x in enumerate(ids) if x == self.mark_id]
            if len(cuts) == len(part) - 1:
                found.update((w, ids[i:j]) for w, i, j in zip(part, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True))
        return found

    def encode_new(self, words: list[str]) -> list[list[int]]:
        """Ids of words. Lower-case words of Latin letters go to the library's model, their bytes spelled in its letters;
        others go through the whole tokenizer."""
        model, letters = self.tokenizer.model.tokenize, self.letters
        out: list = [None] * len(words)
        if self.direct:
            for i, w in enumerate(words):
                if w.isalpha() and w.islower():
                    if w.isascii():
                        out[i] = [t.id for t in model(w)]
                    elif max(w) < LATIN:
                        out[i] = [t.id for t in model("".join([letters[b] for b in w.encode()]))]
        rest = [w for w, ids in zip(words, out, strict=True) if ids is None]
        found: dict[str, list[int]] = {}
        if self.mark is not None:
            begins = re.compile(self.begins).search
            found = self.joined([w for w in rest if not begins(w)])
            rest = [w for w in rest if w not in found]
        found.update((w, e.ids) for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return [found[w] if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each of these words, which differ; new ones are encoded and numbered."""
        names = words.to_pylist()
        get = self.number.get
        out = np.fromiter((get(w, -1) for w in names), np.int64, len(names))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [names[i] for i in missing.tolist()]
            ids = self.encode_new(new)
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            out[missing] = np.arange(len(self.begin), len(self.begin) + len(new))
            self.number.update(zip(new, out[missing].tolist(), strict=True))
            self.begin = np.concatenate((self.begin, (len(self.ids) + np.cumsum(count) - count).astype(np.int32)))
            self.count = np.concatenate((self.count, count.astype(np.int32)))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))))
        return out

    def parted(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each word as a piece and marks behind it, whose ids together are the word's: marks behind a letter or digit are a
        pre-token of their own, and case makes no difference among Latin letters. A word that holds the beginning of an added token is left
        as it is, for those come before lower-casing."""
        none = pa.scalar("", pa.string())
        if not self.lowers:
            return words, pc.if_else(pc.is_valid(words), none, words)
        plain = pc.match_substring_regex(words, PLAIN)
        if self.begins:
            plain = pc.and_(plain, pc.invert(pc.match_substring_regex(words, self.begins)))
        low = pc.if_else(plain, pc.utf8_lower(words), words)
        # the pattern is slow, so only words that end in marks are matched
        marked = pc.and_(plain, pc.invert(pc.equal(pc.utf8_rtrim(low, characters=MARKS), low)))
        ending = low.filter(marked)
        found = pc.extract_regex(ending, CORE)
        both = pc.is_valid(found)
        core, tail = pc.if_else(both, pc.struct_field(found, "core"), ending), pc.if_else(both, pc.struct_field(found, "tail"), none)
        return pc.replace_with_mask(low, marked, core), pc.replace_with_mask(pc.if_else(pc.is_valid(low), none, low), marked, tail)

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.number) > CACHE:
            self.clear()
        given = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(given.fill_null(""), "\n", " "), " ")
        ends = 2 * np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        coded = split.flatten().dictionary_encode()
        pair = pa.concat_arrays(self.parted(coded.dictionary)).dictionary_encode()
        number = self.numbers(pair.dictionary).astype(np.int32)[pair.indices.to_numpy()]
        words, n = coded.indices.to_numpy(), len(coded.dictionary)
        sequence = np.stack((number[:n][words], number[n:][words]), axis=1).ravel()
        count = self.count[sequence]
        stops = np.cumsum(count, dtype=np.int64)
        held = np.flatnonzero(count)
        ids = self.ids[np.repeat((self.begin[sequence[held]] - (stops - count)[held]), count[held]) + np.arange(stops[-1] if len(stops) else 0)]
        return np.split(ids, np.concatenate(([0], stops))[ends][:-1]) if len(ends) else []


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, document ends among them, rules) of ids that are cut into documents at `ends`."""
    most = max(0, (1 << 16) - vocabulary) if vocabulary < 1 << 16 else 1 << 16
    rules: list[np.ndarray] = []
    n_rules = 0
    symbols = ids.astype(np.uint32)
    while len(symbols) > 1 and n_rules < most:
        left, right = symbols[:-1], symbols[1:]
        cell = ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(14)).astype(np.intp)
        inner = ends[(ends > 0) & (ends < len(symbols))] - 1
        cell[inner] = CELLS  # a pair across documents
        counts = np.bincount(cell, minlength=CELLS + 1)
        counts[CELLS] = 0
        take = min(RULES_A_ROUND, most - n_rules)
        top = np.flatnonzero(counts >= LEAST_COUNT)
        if len(top) > take:
            top = top[np.argpartition(counts[top], len(top) - take)[len(top) - take :]]
        if not len(top):
            break
        rule = np.full(CELLS + 1, -1, np.int32)
        rule[top] = np.arange(len(top))
        which = rule.take(cell)
        at = np.flatnonzero(which >= 0)
        which = which[at]
        place = np.zeros(len(top), np.int64)
        place[which] = at  # some pair of each cell; the others of the cell stay as they are
        made = np.stack((symbols[place], symbols[place + 1]), axis=1)
        same = (left[at] == made[which, 0]) & (right[at] == made[which, 1])
        at, which = at[same], which[same]
        # of pairs that overlap in a row, every other one is replaced, from the left
        begins = np.concatenate(([True], np.diff(at) > 1)) if len(at) else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        keep = (np.arange(len(at)) - first) % 2 == 0
        at, which = at[keep], which[keep]
        # a rule that others have left too few pairs isn't worth its room
        often = np.bincount(which, minlength=len(made)) >= LEAST_COUNT
        if not often.any():
            break
        keep = often[which]
        at, which, made = at[keep], (np.cumsum(often) - 1)[which[keep]], made[often]
        symbols = symbols.copy()
        symbols[at] = vocabulary + n_rules + which
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols = symbols[stays]
        ends = ends - np.searchsorted(at, ends)
        rules.append(made)
        n_rules += len(made)
    return symbols, ends, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def packed(doc_ids: list[int | None], ids: list[np.ndarray], vocabulary: int) -> bytes:
    """The payload of a block."""
    sizes = np.array([len(x) for x in ids], np.int64)
    symbols, ends, rules = compress(np.concatenate(ids), np.cumsum(sizes), vocabulary)
    lengths: list[int] = []
    for a, b in rules.tolist():
        lengths.append((lengths[a - vocabulary] if a >= vocabulary else 1) + (lengths[b - vocabulary] if b >= vocabulary else 1))
    width = 2 if vocabulary + len(rules) <= 1 << 16 else 4
    return b"".join(
        (
            MAGIC,
            struct.pack("<5I", width, vocabulary, len(rules), len(ids), len(symbols)),
            rules.astype("<u4").tobytes(),
            np.array(lengths, "<u4").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.concatenate(([0], ends)).astype("<u4").tobytes(),
            sizes.astype("<u4").tobytes(),
            symbols.astype(f"<u{width}").tobytes(),
        )
    )


class Block:
    """A payload, ready to give the ids of any of its documents."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token block")
        width, self.vocabulary, r, d, s = struct.unpack_from("<5I", payload, 4)
        at = 24

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, n, at)
            at += found.nbytes
            return found

        self.rules = read("<u4", 2 * r).reshape(r, 2)
        self.lengths = read("<u4", r)
        doc_ids, null = read("<i8", d), read("u1", d)
        self.doc_ids = [None if none else i for i, none in zip(doc_ids.tolist(), null.tolist(), strict=True)]
        self.offsets, self.sizes = read("<u4", d + 1).astype(np.int64), read("<u4", d).astype(np.int64)
        self.symbols = read(f"<u{width}", s)
        # the expansions of all nonterminals, one after the other, behind the ids, which expand to themselves
        self.length = np.concatenate((np.ones(self.vocabulary, np.int64), self.lengths.astype(np.int64)))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.empty(int(self.length.sum()), np.uint32)
        self.flat[: self.vocabulary] = np.arange(self.vocabulary)
        for i, (a, b) in enumerate(self.rules.tolist(), self.vocabulary):
            to, n = self.start[i], self.length[a]
            self.flat[to : to + n] = self.flat[self.start[a] : self.start[a] + n]
            self.flat[to + n : to + n + self.length[b]] = self.flat[self.start[b] : self.start[b] + self.length[b]]

    def ids(self, i: int | None = None) -> np.ndarray:
        """The ids of the document, or of all."""
        held = self.symbols if i is None else self.symbols[self.offsets[i] : self.offsets[i + 1]]
        if not len(held):
            return np.zeros(0, np.uint32)
        sizes = self.length[held]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.start[held] - (ends - sizes), sizes) + np.arange(ends[-1])]


def _words(spec: str) -> Words:
    return worker_state(f"words {hash(spec)}", lambda: Words(spec))


def write_tokens(docs: DataFrame, vocabulary_path: str, out: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every whole text, each with end_id appended, in ascending doc_id order to the folder `out`."""
    with open(vocabulary_path, encoding="utf-8") as f:  # a few MB
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(spec.value)
        task, start = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal doc_ids, ids, held, start
            row = [task], [start], [len(ids)], [held], [packed(doc_ids, ids, words.size)]
            start, doc_ids, ids, held = start + held, [], [], 0
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        tail = np.array([end_id], np.int32)
        for batch in pieces(batches, "text", PIECE):
            for doc_id, own in zip(batch["doc_id"].to_pylist(), words.encode(batch["text"]), strict=True):
                if held and held + len(own) >= BLOCK_TOKENS:
                    yield block()
                doc_ids.append(doc_id)
                ids.append(np.concatenate((own, tail)))
                held += len(own) + 1
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "h")
    dealt.select("doc_id", "text").mapInArrow(run, BLOCKS).write.parquet(out)


def _read(spark: SparkSession, path: str, document, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """document(ids) -> values of the columns after doc_id, start and n_tokens."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # one row for each task that wrote, so a few thousand at most
    totals = sorted((r["task"], r["n"]) for r in blocks.groupBy("task").agg(F.sum("n_tokens").alias("n")).collect())
    before, at = {}, 0
    for task, n in totals:
        before[task] = at
        at += n
    names = ["doc_id", "start", "n_tokens", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, start, payload in zip(batch["task"].to_pylist(), batch["start_in_task"].to_pylist(), batch["payload"], strict=True):
                block = Block(payload.as_py())
                ids = block.ids()
                ends = np.cumsum(block.sizes)
                rows = [document(ids[b - n : b]) for b, n in zip(ends.tolist(), block.sizes.tolist(), strict=True)]
                own = [pa.array(block.doc_ids, pa.int64()), pa.array(before[task] + start + ends - block.sizes), pa.array(block.sizes)]
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(own + made, names=names)

    return blocks.select("task", "start_in_task", "payload").mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (array) from the files."""
    return _read(spark, path, lambda ids: (ids.astype(np.int32),), "ids array<int>", [pa.list_(pa.int32())])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers, from the files."""
    return _read(spark, path, lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),), "ids_crc32 long", [pa.int64()])
