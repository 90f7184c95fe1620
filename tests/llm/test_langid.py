"""Languages: held-out accuracy on the given documents, compressed sizes, odd texts."""

import zstandard
import numpy as np
from pyspark.sql import functions as F

from ledgerwatch.llm import langid
from ledgerwatch.llm.common import held_out, table
from ledgerwatch.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, score double, found string"
EN = "the cat sat on the mat and then the dog came in with that thing "
DE = "der hund und die katze sind nicht im haus und das ist schade "


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "f") for r in rows], SCHEMA)


def trained(spark):
    return [(i, (EN if i % 2 else DE) * 3, "en" if i % 2 else "de") for i in range(40)]


def judged(spark, docs, model):
    return [tuple(r.j) for r in docs.select(langid.identify(model, "text").alias("j")).collect()]


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES["op9_language_id"](spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    right = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    assert got.count() == docs.count()
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_learns_outside_the_held_out_fold_only(spark):
    docs = rows_of(spark, trained(spark))
    changed = docs.withColumn("text", F.when(held_out("doc_id"), F.lit("zzz zzz")).otherwise(F.col("text")))
    changed = changed.withColumn("lang", F.when(held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    assert langid.fit(docs) == langid.fit(changed)


def test_smallest_size_wins(spark):
    model = langid.fit(rows_of(spark, trained(spark)))
    assert model.langs == ("de", "en")
    text = langid.letters(EN * 2)
    plain = []
    for content in model.dictionaries:
        params = zstandard.ZstdCompressionParameters.from_level(
            langid.LEVEL, source_size=langid.BLOCK, dict_size=len(content), min_match=3, write_content_size=False
        )
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        plain.append(len(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress(4 * text if len(text) < 256 else text)))
    assert model.sizes(EN * 2).tolist() == plain
    assert judged(spark, rows_of(spark, [(1, EN, None), (2, DE, None)]), model) == [
        ("en", *judged(spark, rows_of(spark, [(1, EN, None)]), model)[0][1:]),
        ("de", *judged(spark, rows_of(spark, [(2, DE, None)]), model)[0][1:]),
    ]


def test_odd_texts(spark):
    model = langid.fit(rows_of(spark, trained(spark)))
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (None, EN * 5_000, None), (5, EN, "de"), (5, EN, "de"), (6, "\ud83d", None)]
    rows[-1] = (6, "😀", None)
    got = judged(spark, rows_of(spark, rows), model)
    assert [g[0] for g in got] == ["und", "und", "und", "en", "en", "en", "und"]
    assert got[4] == got[5] and [g[2] for g in got] == [True, True, True, False, False, False, True]
    assert judged(spark, rows_of(spark, [(1, "qx", None)]), model)[0][2]  # no language gains anything


def test_nothing_to_learn_from(spark):
    empty = rows_of(spark, [])
    model = langid.fit(empty)
    assert judged(spark, empty, model) == []
    assert judged(spark, rows_of(spark, [(1, EN, None)]), model) == [("und", 0.0, True)]
    one = langid.fit(rows_of(spark, [(i, EN, "en") for i in range(9)]))
    assert judged(spark, rows_of(spark, [(1, DE, None)]), one)[0][0] == "en"


def test_null_keys_and_langs_teach_nothing(spark):
    rows = [(None, DE, "de"), (1, DE, None), (2, DE, "und"), (3, "123", "de"), *[(i, EN, "en") for i in range(10, 20)]]
    assert langid.fit(rows_of(spark, rows)).langs == ("en",)


def test_a_language_with_one_short_text_costs_the_others_nothing(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = docs.where(~held_out("doc_id")).agg(F.max("doc_id").alias("n")).first().n
    stray = "qirmiz zolaq bupoj tyvek fu nar"
    model = langid.fit(docs.withColumn("lang", F.when(F.col("doc_id") == learned, "xx").otherwise(F.col("lang"))).withColumn("text", F.when(F.col("doc_id") == learned, stray).otherwise(F.col("text"))))
    assert "xx" in model.langs and min(map(len, model.dictionaries)) > 20_000
    found = docs.where(held_out("doc_id")).select("lang", langid.identify(model, "text").alias("found"))
    assert found.agg(F.avg((F.col("lang") == F.col("found.lang")).cast("int"))).first()[0] >= 0.98
    assert model.judge(stray)[0] == "xx"


def test_languages_never_learned_are_rejected(spark):
    """By a margin that nearly all held-out rows pass."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    assert model.min_margin > 0
    for text in (FINNISH, POLISH, RUSSIAN, "zqx wvk jjpq xkcd vbnm qwrt plkj hgfd zxcv mnbq wrtp"):
        assert model.judge(text)[2], (text, model.sizes(text), model.min_margin)
    held = docs.where(held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    kept, right, n = held.select("lang", langid.identify(model, "text").alias("f")).agg(F.count_if(~F.col("f.rejected")), F.count_if(F.col("f.lang") == F.col("lang")), F.count("*")).first()
    assert kept >= 0.985 * n and right >= 0.98 * n


def test_margin_is_the_share_that_unused_texts_lose(spark):
    """Recomputed by a loop: with all unused texts calibrated on, the margin is their quantile."""
    docs = rows_of(spark, trained(spark))
    model = langid.fit(docs, per_lang=5, piece_chars=80, calibrate=10**6, loss=0.1)
    places = docs.where(~held_out("doc_id")).select("lang", "text", F.xxhash64(F.lit(9), "doc_id", "text").alias("h")).where(r"lang is not null and text rlike '\\p{L}'").collect()
    margins = []
    for lang in model.langs:
        for r in sorted((r for r in places if r.lang == lang), key=lambda r: r.h)[5:]:
            sizes = model.sizes(r.text)
            if model.langs[int(np.argmin(sizes))] == lang:
                first, second = sorted(sizes)[:2]
                margins.append((second - first) / first)
    assert margins and abs(model.min_margin - np.quantile(margins, 0.1)) < 1e-12


def test_words_of_all_learned_texts_count(spark, monkeypatch):
    """A word in most texts of a language, each with a long tail of its own, is in the dictionary, the commonest last."""
    monkeypatch.setattr(langid, "DICTIONARY", 600)
    words = ["alpha", "beta", "gamma"]
    own = [(i, " ".join([w for j, w in enumerate(words) if i % (j + 1) == 0] + [f"x{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}" for k in range(20)]), "aa") for i in range(400)]
    other = [(1000 + i, DE, "de") for i in range(30)]
    model = langid.fit(rows_of(spark, own + other))
    held = model.dictionaries[0].split()
    assert model.langs == ("aa", "de") and held[-1] == b"alpha" and held[-2] == b"beta" and held[-3] == b"gamma"
    assert b"hund" in model.dictionaries[1]


FINNISH = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
RUSSIAN = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью."
