import hashlib

import public_tokenizers
from helpers import SF, odd_docs
from sentencepiece import SentencePieceProcessor

import __spark_entry__ as E
import corpus_pipeline as C
from ledgerlens.llm import classifier, mixing, quality_rules, simhash
from ledgerlens.session import materialize


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names and all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 11))


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, at = docs.columns, docs
    kept = [at]
    for _, stage in C.STAGES:
        at = materialize(stage(spark, at, SF), "test-stage")
        kept.append(at)
    assert all(x.columns == columns for x in kept[:5])
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in kept]
    assert ids[1] == {r.doc_id for r in quality_rules.apply_rules(docs).collect() if r.kept} and ids[1] < ids[0]
    model = classifier.fit(docs, labels)
    assert ids[2] == {r.doc_id for r in classifier.score(kept[1], model).collect() if r.predicted}
    assert ids[3] == {r.component_id for r in simhash.near_duplicates(kept[2]).collect()} and ids[3] < ids[2]
    assert ids[4] == {r.doc_id for r in mixing.sample(kept[3], mix=C.MIX).collect() if r.sampled}
    texts = {r.doc_id: r.text for r in docs.collect()}
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert ids[5] == ids[4]
    for r in kept[5].collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    base = {r.doc_id for r in quality_rules.apply_rules(docs).collect() if r.base_failed}
    assert len((good - base) & ids[2]) >= 0.97 * len(good - base)
    whole = C.run(spark, SF)
    assert {r.doc_id for r in whole.collect()} == ids[5]


def test_odd_rows_pass_every_stage(spark):
    docs = odd_docs(spark)
    for _, stage in C.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert C.STAGES[4][1](spark, docs, SF).count() == docs.count()
