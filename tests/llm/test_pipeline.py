import corpus_pipeline as cp
from tidemark.llm import decontam, packing, pii, toxicity

from tests.llm.test_lshforest import brute
from tests.llm.test_pii import plain_terms


def test_run_against_plain_python(spark, tmp_path):
    """Every stage again without Spark, on a small fixture that holds a case for each."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    extra = spark.createDataFrame([(900_000, None, "en", "x", 0), (900_001, "", "en", "x", 0), (900_002, "write to some.body@mail.example or +1 202 555 0147 now", "en", "x", 0)], docs.schema)
    own = docs.unionByName(extra)
    own.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for r in cp.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, list(r.ids)))

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    scorer = toxicity.Scorer(model)
    rows = [(d, t) for d, t in rows if scorer.scores([t or ""])[0] < 0.5]
    keep = {root for _, root, _ in brute(rows)}
    rows = [(d, t) for d, t in rows if d in keep]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    index = decontam.Index(items, decontam.Params())
    hits = decontam.leaks(index, decontam.Codes(index.terms), [t or "" for _, t in rows])
    rows = [r for r, h in zip(rows, hits) if not h]
    assert set(got) == {d for d, _ in rows}
    encoder = packing.Encoder(packing.tokenizer_files()[0], None)
    terms = plain_terms([t or "" for _, t in rows])
    for d, t in rows:
        base, text = pii.base_spans(t or ""), t or ""
        taken = [(a, b) for _, a, b in base]
        more = [("term", *m.span()) for m in pii.TERM.finditer(text) if m.group().lower() in terms and not any(a < m.end() and m.start() < b for a, b in taken)]
        whole = [i for _, ids in sorted(got[d]) for i in ids]
        assert whole == [*encoder.encode(pii.redacted(text, base + more)), 1]
    assert b"some.body" not in str(got[900_002]).encode() and len(got[900_000]) == 1


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    for _, stage in cp.STAGES[2:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
