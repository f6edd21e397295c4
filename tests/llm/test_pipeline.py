"""The pipeline against a plain version of its stages in memory."""

from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from hitledger.llm import decontamination
from hitledger.llm.queries import language_model
from hitledger.llm.texts import BATCH_BYTES

FOLDER = "/root/testdata/sf0.001"


def key(line):
    return line.encode().strip(b" \t\n\v\f\r").lower()


def shingles(text):
    """The different runs of five words, letters of ASCII lower-cased."""
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).dtypes == docs.dtypes


def test_stages_send_bounded_batches(spark):
    """Ten thousand long texts never meet in one batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    long = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 700).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(name)
        stage(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
        found = [r.n for r in long.mapInArrow(sizes, "n bigint").collect()]
        assert len(found) > 1 and max(found) <= BATCH_BYTES + (1 << 16)


def test_run(spark):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in source.collect()}
    learned = language_model(source).judge([t or "" for t in texts.values()])[2]
    docs = {d: t for (d, t), kept in zip(texts.items(), learned) if kept}

    holders = defaultdict(list)  # in the order in which documents arrive: batch, then id as text
    batch = {r.doc_id: r.b for r in source.select("doc_id", F.pmod(F.xxhash64(F.lit(1), F.col("doc_id").cast("string"), "text", F.lit(False), F.lit(False)), F.lit(4)).alias("b")).collect()}
    for d, t in docs.items():
        for k in {key(x) for x in t.split("\n")}:
            holders[k].append((batch[d], str(d)))
    for d, t in docs.items():
        docs[d] = "\n".join(x for x in t.split("\n") if not key(x) or len(holders[key(x)]) < 10 or min(holders[key(x)])[1] == str(d))

    grams = {d: shingles(t) for d, t in docs.items()}
    root = {d: d for d in docs}
    changed = True
    while changed:
        changed = False
        for a in sorted(docs):
            for b in docs:
                if root[b] > root[a] and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
                    root[b], changed = root[a], True
    docs = {d: t for d, t in docs.items() if root[d] == d}

    items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    index = decontamination.PieceIndex(list(enumerate(items)), decontamination.EDIT_SHARE)
    docs = {d: t for d, t in docs.items() if not any(i in decontamination.normal(t) for i in items) and not index.hit(t)}

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert sorted(got) == sorted(docs) and len(docs) < len(texts)
    for d, t in docs.items():
        assert got[d].token_ids == library.encode(t) and got[d].n_tokens == len(got[d].token_ids) and got[d].n_chars == len(t)
