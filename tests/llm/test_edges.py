"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from argentic.llm import decontamination, language_id, language_model, mixing, quality_classifier, quality_rules, secrets, sharding, simhash, substrings

EXTRA = "size long, h long, t string, copies int, shard string, score string, spans string, fp long, ws string, word string, n long, run long, key long, held boolean, hash string, target string, rate_ string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \t\n", "a", "a", "word " * 30000, "ünï 😀 x" * 60, "ünï 😀 x" * 60, "secret=" + "a" * 50, "\n\n", "Z" * 3000]
    rows = [(k if k != 4 else 3, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "s", None) for k, t in enumerate(texts)]
    rows += [(None, "no id", "en", None, 5), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *[None] * len(EXTRA.split(","))) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 0, 0), (None, 1, None), (7, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "word word word"), (2, None), (3, ""), (4, "word " * 9)], "item_id long, text string")


def operators(spark, labels, items):
    one_each = {
        "shards": sharding.shard_documents, "shard rows": sharding.shard_rows, "counts": mixing.mix_counts, "near": simhash.near_duplicates, "groups": simhash.similar_groups,
        "repeats": substrings.repeat_digest, "kept": substrings.remove_repeats, "rules": quality_rules.judge, "secrets": secrets.digest,
        "scores": lambda d: language_model.score_documents(d, F.col("doc_id") % 2 == 0), "quality": lambda d: quality_classifier.classify(d, labels), "languages": language_id.identify,
    }
    any_number = {"mix": mixing.mix_documents, "one of each": simhash.keep_one, "items": lambda d: decontamination.find_items(d, items), "clean": lambda d: decontamination.clean_documents(d, items)}
    return one_each, any_number


@pytest.mark.parametrize("name", ["shards", "shard rows", "counts", "near", "groups", "repeats", "kept", "rules", "secrets", "scores", "quality", "languages"])
def test_a_row_for_each(spark, odd, labels, items, name):
    run = operators(spark, labels, items)[0][name]
    assert run(odd).count() == odd.count()
    assert run(odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["mix", "one of each", "items", "clean"])
def test_other_operators(spark, odd, labels, items, name):
    run = operators(spark, labels, items)[1][name]
    rows = run(odd).collect()
    assert run(odd.limit(0)).count() == 0
    if name == "one of each":  # blank texts are one group, copies another
        assert len(rows) == 13 - 4 - 1 - 1
    if name == "clean":
        assert {r["doc_id"] for r in rows} == {0, 1, 2, 3, 6, 7, 8, 9, 10, None}


def test_defined_results(odd):
    rules = {(r["doc_id"], r["n_words"]) for r in quality_rules.judge(odd).collect()}
    assert {(0, 0), (1, 0), (5, 30000), (None, 2)} <= rules
    assert {r["lang_pred"] for r in language_id.identify(odd).filter("doc_id in (0, 1, 2, 9)").collect()} == {"und"}
    blank = simhash.near_duplicates(odd).filter("doc_id in (0, 1, 2, 9)").collect()
    assert {(r["fp"], r["component_id"]) for r in blank} == {(0, 0)}


def test_without_labels_items_or_languages(spark, odd, labels, items):
    assert {r["score"] for r in quality_classifier.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert decontamination.find_items(odd, items.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_clean_texts_stay_beside_contaminated_ones_of_their_id(spark, items):
    texts = [(None, "word word word"), (None, "clean one"), (None, None), (7, "word word word"), (7, "clean two"), (8, "clean three")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {tuple(r) for r in decontamination.clean_documents(docs, items).collect()} == {(None, "clean one"), (None, None), (7, "clean two"), (8, "clean three")}
