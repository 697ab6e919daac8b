import re

import __spark_entry__
import corpus_pipeline
from tessera.llm import decontaminate, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_step_by_step(spark, tmp_path):
    """Each stage against a brute-force version on its own input."""
    from test_simhash import brute_components, brute_fp
    from test_secrets_chat import brute

    docs = queries.read(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    bench = [(r.item_id, decontaminate.words(r.text)) for r in queries.read(spark, SF, "benchmark").collect()]

    def step(name, before):
        path = f"{tmp_path}/{name}"
        stages[name](spark, before, SF).write.parquet(path)
        return spark.read.parquet(path)

    a = step("toxicity", docs)
    assert a.columns == columns
    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, queries.read(spark, SF, "labels")).collect()}
    assert sorted(r.doc_id for r in a.collect()) == sorted(i for i, p in predicted.items() if p == 0)
    assert len(predicted) > a.count()

    b = step("simhash_near_dedup", a)
    rows = a.collect()
    comp = brute_components({brute_fp(r.text) for r in rows})
    low = {}
    for r in rows:
        c = comp[brute_fp(r.text)]
        low[c] = min(low.get(c, r.doc_id), r.doc_id)
    assert b.columns == columns and sorted(r.doc_id for r in b.collect()) == sorted(low.values())

    c = step("benchmark_decontamination", b)
    kept = {r.doc_id for r in c.collect()}
    for r in b.collect():
        w = " ".join(decontaminate.words(r.text))
        if any(len(x) >= 5 and " ".join(x) in w for _, x in bench):
            assert r.doc_id not in kept
        elif not any(" ".join(x[k : k + 5]) in w for _, x in bench for k in range(len(x) - 4)):
            assert r.doc_id in kept

    d = step("secret_scan", c)
    before, after = {r.doc_id: r for r in c.collect()}, {r.doc_id: r for r in d.collect()}
    assert d.columns == columns and set(before) == set(after)
    for i, r in after.items():
        found = brute(before[i].text)
        assert ("[SECRET]" in r.text) >= bool(found)
        assert not brute(r.text)
        if not found and not re.search(r"[A-Za-z0-9+/_=-]{20,}", before[i].text):
            assert r.text == before[i].text

    e = step("best_fit_packing", d)
    assert {r.doc_id for r in e.select("doc_id").distinct().collect()} == set(after)


def test_registered_and_run(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5
    whole = corpus_pipeline.run(spark, SF)
    sizes = whole.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in sizes) <= 2048


def test_run_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text, clashing columns; then no rows at all."""
    word = lambda i: " ".join(f"w{(i * 31 + k * k) % 997}x{k}" for k in range(60))
    rows = [(i, word(i) + (" blargword" if i % 5 == 0 else " gentle"), "z", 1) for i in range(200)]
    item = "one two three four five six seven eight nine ten"
    odd = [(None, word(900) + " gentle", "z", 2), (300, None, "z", 3), (301, "", "z", 4), (302, word(1), "z", 5), (302, word(1), "z", 5), (303, "pad " * 50_000 + item, "z", 6), (304, "key token=abcdef123456 " + word(901), "z", 7), (305, word(902) + " " + "long " * 20_000, "z", 8)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, `__text` string, `row` int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(200)] + [(None, 1, 1), (7, None, 1)], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([(1, item), (None, None)], "item_id long, text string")
    for name, t in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        t.write.parquet(f"{tmp_path}/a/{name}.parquet")
        t.limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    ids = {r.doc_id for r in got}
    assert not any(i is not None and i < 200 and i % 5 == 0 for i in ids) and {1, 2, 3, 4, 304, 305, None} <= ids and 303 not in ids
    assert len(ids & {300, 301}) == 1 and len(ids & {302}) <= 1
    by_seq = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and r.length <= 2048
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for m in by_seq.values():
        ends = [0]
        for at, n in sorted(m):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 2048
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_toxicity_held_out(spark):
    got = toxicity.toxicity(queries.read(spark, "/root/testdata/sf0.01", "documents"), queries.read(spark, "/root/testdata/sf0.01", "labels"))
    rows = got.join(queries.read(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93
