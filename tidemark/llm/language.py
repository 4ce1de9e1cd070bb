"""Language ID by compression: the language whose dictionary makes a text smallest.

fit() takes a bounded sample of the labelled texts of each language (`sample` texts; of a text longer than `piece` code
points a piece of that length, at a place picked by the hash of the id; `size` bytes in all, pieces that do not fit left
out) and uses it as a raw-content zstandard dictionary. Sample and model stay this small whatever the corpus, and at most
`most_languages` languages are learned, those with most labelled texts.
identify() cuts every whole text into chunks, compresses each with each dictionary and adds up the sizes, so that long
texts do not become their own dictionaries. Texts are lower-cased first, and everything in ASCII but letters becomes a
space. Where the two smallest sizes are within RECHECK of each other, the text is compressed again at a level that finds
shorter matches; a tie that remains goes to the language with more labelled texts. `margin` is the gap between the two
smallest sizes over the larger of them, and a text is rejected if it is `und` or its margin is below `least_margin`.

Null texts and texts without a letter (Unicode categories L*) are `und` with score 0. Labels that are null, and labelled texts without a letter,
teach nothing; without any label all texts are `und`. Repeated rows are judged each for itself. Empty tables give empty
results. Only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import worker_state

UND = "und"
LETTER = regex.compile(r"\p{L}")
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
CHUNK = 2048
LEVEL, FINE_LEVEL = 3, 19
RECHECK = 0.02
#: weight of a byte of difference in the score
BYTE_WEIGHT = 0.5
SCORE_COLUMNS = "lang_pred string, score double, margin double, rejected boolean"


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(FOLD).split())


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, the one with most labelled texts first."""

    dictionaries: dict[str, bytes]


def fit(
    docs: DataFrame,
    teaches: Column,
    text_col: str = "text",
    label_col: str = "lang",
    id_col: str = "doc_id",
    sample: int = 400,
    piece: int = 1000,
    size: int = 128 << 10,
    most_languages: int = 1000,
) -> Model:
    """Learns from rows with a label for which `teaches` holds; the sample of a language is picked by the hash of the id."""
    rows = docs.filter(teaches & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    text, id_ = F.col(text_col), F.col(id_col)
    place = F.pmod(F.xxhash64(id_, F.lit(7)), F.greatest(F.length(text) - piece, F.lit(0)) + 1) + 1
    rows = rows.select(F.col(label_col).cast("string").alias("lang"), text.substr(place.cast("int"), F.lit(piece)).alias("text"), F.xxhash64(id_, F.lit(5)).alias("h"))
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return Model({})
    # a share of each language that gives about twice the sample, so the driver gets 2 x sample pieces a language
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 2 * sample / n) * (1 << 20)))))
    picked = rows.filter(F.pmod("h", F.lit(1 << 20)) < F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0))).collect()
    dictionaries = {}
    for lang in sorted(counts, key=lambda k: (-counts[k], k)):
        own = sorted((r for r in picked if r["lang"] == lang and LETTER.search(r["text"])), key=lambda r: (r["h"], r["text"]))
        chosen, room = [], size
        for text_ in list(dict.fromkeys(folded(r["text"]) for r in own))[:sample]:
            if len(text_) < room:
                chosen.append(text_)
                room -= len(text_) + 1
        if chosen:
            dictionaries[lang] = b" ".join(chosen)
    return Model(dictionaries)


def _compressors(model: Model, level: int) -> dict[str, zstandard.ZstdCompressor]:
    made = {}
    for lang, raw in model.dictionaries.items():
        content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        made[lang] = zstandard.ZstdCompressor(dict_data=content, level=level, write_content_size=False, write_dict_id=False, write_checksum=False)
    return made


class Judge:
    """A model with its compressors; made once in a worker."""

    def __init__(self, model: Model, least_margin: float):
        self.order = {lang: i for i, lang in enumerate(model.dictionaries)}
        self.quick, self.fine, self.least_margin = _compressors(model, LEVEL), _compressors(model, FINE_LEVEL), least_margin

    def sizes(self, text: bytes, compressors: dict[str, zstandard.ZstdCompressor]) -> list[tuple[int, int, str]]:
        chunks = [text[at : at + CHUNK] for at in range(0, len(text), CHUNK)]
        return sorted((sum(len(c.compress(x)) for x in chunks), self.order[lang], lang) for lang, c in compressors.items())

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        if not self.order or not text or not LETTER.search(text):
            return UND, 0.0, 0.0, True
        raw = folded(text) or text.encode()
        found = self.sizes(raw, self.quick)
        if len(found) == 1:
            return found[0][2], 1.0, 1.0, False
        if found[1][0] - found[0][0] < RECHECK * found[1][0]:
            found = self.sizes(raw, self.fine)
        margin = (found[1][0] - found[0][0]) / max(found[1][0], 1)
        score = 1 / sum(2.0 ** (-BYTE_WEIGHT * min(n - found[0][0], 2000)) for n, _, _ in found)
        return found[0][2], score, margin, margin < self.least_margin


def identify(docs: DataFrame, model: Model, least_margin: float = 0.002, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (default: all), and lang_pred, score, margin and rejected; carried columns of these
    names are left out (see kept, which returns the columns of docs alone)."""
    names = [c.split()[0] for c in SCORE_COLUMNS.split(", ")]
    carried = [c for c in (docs.columns if carry is None else carry) if c not in names]
    return _judged(docs, carried, names, model, least_margin, text_col)


def kept(docs: DataFrame, model: Model, least_margin: float = 0.002, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with all their columns and no others."""
    names = [f"_judged_{i}_{uuid.uuid4().hex[:8]}" for i in range(4)]
    return _judged(docs, docs.columns, names, model, least_margin, text_col).filter(~F.col(names[3])).select(*(F.col(f"`{c}`") for c in docs.columns))


def _judged(docs: DataFrame, carried: list[str], names: list[str], model: Model, least_margin: float, text_col: str) -> DataFrame:
    # columns go by number through the workers, so they may have any names
    numbers = [f"c{i}" for i in range(len(carried))]
    own = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(carried, numbers, strict=True)), F.col(text_col).alias("text"))
    schema = own.drop("text").schema
    for i, part in enumerate(SCORE_COLUMNS.split(", ")):
        schema = schema.add(f"s{i}", part.split()[1])
    broadcast, key = docs.sparkSession.sparkContext.broadcast(model), f"language {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = worker_state(key, lambda: Judge(broadcast.value, least_margin))
        for batch in batches:
            rows = [judge(t.as_py()) for t in batch["text"]]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in numbers), *made], names=schema.names)

    return own.mapInArrow(run, schema).toDF(*carried, *names)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is held out from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
