import random

import corpus_pipeline as P


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, documents, tmp_path):
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(500)]
    clean = [" ".join(random.choice(vocabulary) for _ in range(60)) + "." for _ in range(120)]
    junk = [" ".join(random.choice(("###", "$$$!", "BUY%%")) for _ in range(60)) for _ in range(40)]
    copies = [c.replace(" ", "\n") for c in clean[:10]]
    near = [c + " tail" for c in clean[10:20]]
    texts = clean + junk + copies + near
    docs = documents(*texts)
    docs = docs.unionByName(docs.filter("doc_id = 3"))
    labels = [(i, 1, 0) for i in range(1, 121)] + [(i, 0, 0) for i in range(121, 161)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept, seen = docs, []
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        seen.append({r.doc_id for r in kept.collect()})
    assert seen[0] == set(range(1, 121)) | set(range(161, 181))
    assert seen[1] == set(range(1, 121)) | set(range(171, 181)) and seen[2] == set(range(1, 121))
    assert kept.count() == 120
    pieces = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == seen[2]
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_pipeline_awkward(spark, awkward, none, tmp_path):
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    from pyspark.sql import functions as F

    awkward = awkward.withColumns({c: F.lit("clash") for c in ("_id", "_digest", "digest", "predicted", "group_size")})
    seen = []
    docs = awkward
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == awkward.columns
        seen.append(sorted((r.doc_id or 0 for r in docs.collect())))
    # Without labels of low quality nothing is rejected; equal texts (1 and 2; 4 and both rows of 5) leave one; 7 is near 6.
    assert seen == [[0, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10], [0, 1, 3, 4, 6, 7, 8, 9, 10], [0, 1, 3, 4, 6, 8, 9, 10]]
    assert {r.doc_id or 0 for r in P.packing(spark, docs, str(tmp_path)).collect()} == set(seen[-1])
    docs = none
    for _, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_stages_decide_by_row(spark, documents, tmp_path):
    """Repeated and null ids with different texts: no distinct text goes with another one's row."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(3, "A"), (5, "A"), (5, "B"), (None, "A"), (None, "C"), (None, "D"), (None, "D"), (6, "E x"), (6, "E\n x"), (6, "F"), (8, "F"), (9, None), (9, "G")]
    kept = P.exact(spark, documents(*rows), str(tmp_path)).collect()
    seen = sorted(((r.doc_id, " ".join((r.text or "").split())) for r in kept), key=str)
    assert seen == sorted([(3, "A"), (5, "B"), (None, "C"), (None, "D"), (6, "E x"), (6, "F"), (9, ""), (9, "G")], key=str)
    again = P.exact(spark, documents(*reversed(rows)).repartition(7), str(tmp_path)).collect()
    assert {tuple(r) for r in kept} == {tuple(r) for r in again}
    one, other, third = (" ".join(f"{w}{i * i % 97}" for i in range(80)) for w in "xyz")
    rows = [(1, one), (2, other), (2, one + " tail"), (None, other + " tail"), (None, third), (4, third + " tail")]
    kept = P.near(spark, documents(*rows), str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(1, one), (2, other), (4, third + " tail")}


def test_quality_decides_by_row(spark, documents, tmp_path):
    random.seed(3)
    clean = [" ".join(f"w{random.randrange(500)}" for _ in range(60)) + "." for _ in range(120)]
    junk = [" ".join(random.choice(("###", "$$$!", "BUY%%")) for _ in range(60)) for _ in range(40)]
    labels = [(i, 1, 0) for i in range(1, 121)] + [(i, 0, 0) for i in range(121, 161)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good, bad = clean[0] + " more", junk[0] + " ###"
    docs = documents(*clean, *junk).unionByName(documents((900, good), (900, bad), (None, good), (None, bad)))
    kept = P.quality(spark, docs, str(tmp_path)).filter("doc_id IS NULL OR doc_id = 900").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("900", good), ("None", good)]
