"""The pipeline's stages against the operators' decisions, and the contract of its columns."""

import corpus_pipeline
from threadlens.llm import bpe, decontam, pii, simhash
from threadlens.llm import toxicity as T

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(d.columns == docs.columns for d in seen[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    toxic = {r.doc_id for r in T.score(docs, T.fit(docs, labels)).where("predicted = 1").collect()}
    assert ids[1] == ids[0] - toxic
    near = simhash.near_duplicates(seen[1])
    assert ids[2] == {r.component_id for r in near.collect()}
    hit = {r.doc_id for r in decontam.contamination(seen[2], bench).where("n_hit > 0").collect()}
    assert ids[3] == ids[2] - hit and ids[4] == ids[5] == ids[3]
    assert pii.detect(seen[4]).agg({"n_email": "sum"}).first()[0] == 0
    tokens = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in seen[5].collect()}
    assert tokens == {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in bpe.encode(seen[4]).collect()}
    whole = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == tokens


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if set(docs.columns) <= set(out.columns) else docs


def test_awkward_documents(spark):
    """Nulls, empty texts, repeated rows and columns named as the operators' own pass every stage."""
    extra = ["base", "added", "h", "fp", "kept", "c0", "row", "predicted", "n_hit", "root"]
    rows = [(1, None), (2, ""), (None, "a text without an id that is clean"), (3, "mail me at x.y@z.org now"), (3, "mail me at x.y@z.org now"),
            (4, "long clean words " * 5000), (5, "é 日本 🙂")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0 if t is None else len(t), *([7] * len(extra))) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"`{c}` int" for c in extra))
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        seen = stage(spark, seen, SF).cache()
        assert seen.columns == docs.columns, name
        assert all(r[c] == 7 for r in seen.select(*extra).collect() for c in extra)
    # A null and an empty text are alike, and so are the repeated rows.
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in seen.collect()), key=repr)
    assert [g[0] for g in got] == [1, 3, 4, 5, None]
    assert [g for g in got if g[0] == 3] == [(3, "mail me at [EMAIL] now", 22)]
    last = corpus_pipeline.STAGES[4][1](spark, seen, SF)
    assert {r.doc_id: r.n_tokens for r in last.collect()}[1] == 0
