import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm.hyperminhash import near_duplicates
from sparkloom.llm.packing import pack
from sparkloom.llm.quality_rules import judged
from sparkloom.llm.toxicity import classify

from .test_hyperminhash import brute
from .test_quality_rules import counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A corpus of clean, toxic, short and copied documents, with labels for the first part."""
    r = random.Random(4)
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels = [], []
    for i in range(400):
        words = [f"word{r.randrange(4000)}" for _ in range(r.choice([60, 120]))]
        toxic = i % 8 == 0
        if toxic:
            words[5:7] = ["nasty", "awful"]
        if i % 10 == 3:
            words = words[:20]
        text = " ".join(words)
        docs.append((i, text, "en", "src0", len(text)))
        if i < 250:
            labels.append((i, int(i % 10 != 3), int(toxic)))
    for k in range(30):  # exact and near copies of clean documents
        text = docs[301 + 2 * k][1]
        docs.append((400 + k, text if k % 2 else " ".join(text.split()[:-1] + ["other"]), "en", "src1", len(text)))
    docs.append((1000, None, None, None, None))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_does_what_its_operator_says(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejects = [
        lambda d: {x.doc_id for x in classify(spark, d, labels).where("is_toxic").collect()},
        lambda d: {x.doc_id for x in judged(spark, d, labels).where("not kept").collect()},
        lambda d: {x.doc_id for x in near_duplicates(spark, d).where("not kept").collect()},
    ]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 3:
            assert out.columns == COLUMNS
            gone = rejects[k](docs)
            assert gone and {x.doc_id for x in out.collect()} == {x.doc_id for x in docs.collect()} - gone
        else:
            assert {tuple(x) for x in out.collect()} == {tuple(x) for x in pack(spark, docs).collect()}
        docs = out


def test_stages_equal_brute_force(spark, sf_dir, tmp_path):
    """Quality, near-duplicates and packing against plain Python, each on what the stage before has kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {x.doc_id: x.text for x in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before = {x.doc_id for x in docs.collect()}
        after = {x.doc_id for x in out.collect()}
        if k == 1:  # no threshold has a bad document to catch that the base rule leaves
            assert after == {i for i in before if not counts(texts[i])[-1]}
        elif k == 2:
            assert after == {i for i, _, _, kept in brute([(i, texts[i]) for i in sorted(before)], 5) if kept}
        elif k == 3:
            encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
            sizes = {i: len(encode(texts[i], add_special_tokens=False).ids) + 1 for i in before}
            rows = out.collect()
            assert {i: sum(x.length for x in rows if x.doc_id == i) for i in before} == sizes
            assert len({x.sequence_id for x in rows}) <= 1.02 * -(-sum(sizes.values()) // 1024) + 1
        docs = out


def test_planted_cases(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {x.doc_id for x in rows}
    clean = {i for i in range(400) if i % 8 and i % 10 != 3}
    assert not any(i % 8 == 0 or i % 10 == 3 for i in ids if i < 400) and 1000 not in ids
    assert len(clean - ids) <= 2
    assert not any(400 + k in ids for k in range(30) if (301 + 2 * k) in ids)
