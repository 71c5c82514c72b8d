from foliant.llm import packing, quality, secrets


def test_pipeline_stages_on_a_fixture(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "secrets", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit_outside_fold(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = dict(zip(rows, quality.predict([r.text for r in rows.values()], model), strict=True))
    good = stages["quality"](spark, docs, sf)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= 0.7}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (rows[i].text or "").encode().lower().split()) else set() for i, s in scores.items() if s >= 0.7}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if comp[a] != comp[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    one = stages["near_copies"](spark, good, sf)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(comp.values())
    clean = stages["secrets"](spark, one, sf)
    assert clean.columns == docs.columns
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secrets.scan_secrets(one).collect()}
    want = {}
    for i in set(comp.values()):
        text, out, at = rows[i].text, "", 0
        for a, b in spans[i]:
            if a >= at:
                out += text[at:a] + secrets.MARK
            at = max(at, b)
        want[i] = out + text[at:] if spans[i] else text
    got = {r.doc_id: r for r in clean.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == (len(r.text) if spans[i] else rows[i].n_chars) for i, r in got.items())
    import public_tokenizers

    bpe = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, sf).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {i: len(bpe.whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in want.items()}
