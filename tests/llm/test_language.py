import zlib

from pyspark.sql import functions as F

from tidemark.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, score string"
WORDS = {"en": "the house and this that with from have where would".split(), "de": "der und nicht eine werden schon über zwischen haben ist".split(), "fr": "le être avec dans pour quelle même où nous était".split()}


def made(n):
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        w = WORDS[lang]
        rows.append((i, " ".join(w[(i * 7 + k * k) % 10] for k in range(30)) + ".", lang if i % 5 else None, "s", "x"))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = made(240) + [(1000, None, "en", "s", "x"), (1001, "", "de", "s", "x"), (1002, "123 !!", "fr", "s", "x"), (1003, "ÉÉ", None, None, None)] + made(3)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(docs, ~language.held_out())
    assert set(model.dictionaries) == set(WORDS)
    got = language.identify(docs.withColumn("held_out", language.held_out()), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] < 1000:
            assert r["lang_pred"] == list(WORDS)[r["doc_id"] % 3] and not r["rejected"]
        elif r["doc_id"] < 1003:
            assert r["lang_pred"] == language.UND and r["rejected"]
        else:
            assert r["lang_pred"] in WORDS


def test_learning_is_bounded(spark):
    model = language.fit(spark.createDataFrame(made(90), SCHEMA), F.lit(True), sample=5, piece=50, size=120)
    assert all(len(d) <= 120 for d in model.dictionaries.values())


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)
    model = language.fit(docs, F.lit(True))
    assert language.identify(docs, model).collect()[0]["lang_pred"] == language.UND
    assert language.identify(docs.limit(0), model).collect() == []


def test_only_letters_make_a_language(spark):
    rows = [(1, "½ ² ① Ⅷ", "en", "s", "x"), (2, "ª", "en", "s", "x")] + made(30)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs.filter("doc_id < 3 AND text IN ('½ ² ① Ⅷ', 'ª')"), language.fit(docs, F.lit(True))).collect()}
    assert got[1] == language.UND and got[2] != language.UND


def test_dictionaries_and_choice_against_plain_compression(spark):
    import zstandard

    docs = spark.createDataFrame(made(60), SCHEMA)
    model = language.fit(docs, F.lit(True))
    for r in language.identify(docs, model).collect():
        raw = language.folded(r["text"])
        sizes = {}
        for lang, content in model.dictionaries.items():
            level = language.LEVEL
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = len(zstandard.ZstdCompressor(dict_data=held, level=level, write_content_size=False, write_dict_id=False).compress(raw))
        least = sorted(sizes.values())
        if least[1] - least[0] > language.RECHECK * least[1]:
            assert r["lang_pred"] == min(sizes, key=sizes.get)
            assert abs(r["margin"] - (least[1] - least[0]) / least[1]) < 1e-9


def test_long_texts_teach_from_all_over(spark):
    text = " ".join(["aaaa"] * 400 + ["bbbb"] * 400)
    docs = spark.createDataFrame([(i, text, "xx", "s", "x") for i in range(40)], SCHEMA)
    content = language.fit(docs, F.lit(True), piece=200).dictionaries["xx"]
    assert b"aaaa" in content and b"bbbb" in content


def test_kept_rows_have_the_columns_they_came_with(spark):
    names = ["doc_id", "text", "lang", "rejected", "margin", "lang_pred", "a.b"]
    docs = spark.createDataFrame([(1, WORDS["en"][0] + " house that would have", "en", "r", "m", "l", "d"), (2, "12", "en", "r", "m", "l", "d")], names)
    got = language.kept(docs, language.fit(spark.createDataFrame(made(60), SCHEMA), F.lit(True)))
    assert got.columns == names and [tuple(r)[3:] for r in got.collect()] == [("r", "m", "l", "d")]
