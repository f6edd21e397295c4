"""Every operator on nulls, empty and long texts, repeated rows, clashing column names and an empty table."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hitledger.llm import decontamination, html_text, language, line_dedup, pieces, quality, sharding, simhash, token_counts, toxicity

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "no such passage anywhere in the texts"), (2, None), (None, ""), (3, "日本語 🙂 ünï")], "item_id bigint, text string")


@pytest.fixture(scope="module")
def operators(items):
    known = language.train({"en": ["the and of that is"] * 3, "de": ["der die und das ist"] * 3})
    toxic = toxicity.train([("idiot bad", 1)] * 1 + [(f"idiot {i}", 1) for i in range(9)] + [(f"fine the {i}", 0) for i in range(90)], [("idiot", 1), ("fine", 0)] * 5, 0.1)
    same = {
        "token counts": lambda d: token_counts.count_tokens(d, WORDS),
        "sharding": lambda d: sharding.assign(d, shard_bytes=20_000),
        "toxicity": lambda d: toxicity.score(d, toxic),
        "line dedup": lambda d: line_dedup.drop_common_lines(d, min_docs=3, counts=True),
        "first lines": lambda d: line_dedup.drop_common_lines(d, min_docs=2, keep_first=True),
        "extraction": lambda d: html_text.extract(d, source="text", name="main"),
        "quality": lambda d: quality.assess(d),
        "pieces": lambda d: pieces.encode(d, PIECES, check=True),
        "simhash": lambda d: simhash.cluster(d),
        "language": lambda d: language.predict(d, known),
    }
    fewer = {
        "good ones": lambda d: quality.keep_good(d),
        "one of each": lambda d: simhash.keep_one(d),
        "clean of items": lambda d: decontamination.drop_contaminated(d, items),
        "identified": lambda d: language.keep_identified(d, known),
    }
    return same, fewer


def test_all_rows_come_back(operators, odd_documents):
    for name, run in operators[0].items():
        got = run(odd_documents).collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd_documents.collect()), name
        assert len({str(sorted(r.asDict().items())) for r in got if r.doc_id == 1}) <= 1 or name == "first lines", name  # equal rows, equal results


def test_own_columns_stay(operators, odd_documents):
    for name, run in [*operators[0].items(), *operators[1].items()]:
        if name != "simhash":
            got = run(odd_documents)
            assert set(odd_documents.columns) <= set(got.columns), name
            assert {r.source for r in got.select("source").collect()} <= {"a", "b", None}, name
            assert got.select("h1").distinct().collect()[0][0].startswith("own"), name


def test_filters_return_input_rows(operators, odd_documents):
    before = Counter(str(r) for r in odd_documents.collect())
    for name, run in operators[1].items():
        got = Counter(str(r) for r in run(odd_documents).collect())
        assert got and all(before[k] >= n for k, n in got.items()), name


def test_empty_table(operators, odd_documents):
    for name, run in [*operators[0].items(), *operators[1].items()]:
        assert run(odd_documents.filter("doc_id < 0")).count() == 0, name


def test_items(items, odd_documents):
    found = decontamination.find_items(odd_documents, items).collect()
    assert [(r.doc_id, r.item_id, r.edits, r.start, r.end) for r in found] == [(9, 3, 0, 0, 9)]
    assert decontamination.find_items(odd_documents, items.filter("item_id = 2")).count() == 0
    assert decontamination.find_items(odd_documents.filter("doc_id < 0"), items).count() == 0


def test_models_without_labels(spark, odd_documents):
    assert language.fit(odd_documents, odd_documents.doc_id < 0).weights is None
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(odd_documents, labels, F.col("id") % 2 == 0, F.col("id") % 2 == 1)
    assert model.score("anything") == 0.0
    assert language.predict(odd_documents, language.LanguageModel()).filter("lang_pred <> 'und' or score <> 0").count() == 0
