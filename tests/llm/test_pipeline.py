import corpus_pipeline
from helpers import texts_of

from factlake.llm import lines, packing, quality, secrets, simhash
from factlake.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing",
    ]
    docs = table(spark, SF, "documents")
    rules = quality.fit(docs, table(spark, SF, "labels"))
    scanner = secrets.Scanner()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = dict(texts_of(docs)), dict(texts_of(out.withColumn("text", out[out.columns[1]].cast("string"))))
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            judged = quality.judged(docs, rules, "c_", "k_").where("k_")
            assert set(after) == {r["doc_id"] for r in judged.collect()} and len(after) < len(before)
        elif k == 1:
            gone = {
                (r["doc_id"], r["line_no"]) for r in lines.line_groups(docs).collect() if not r["kept"]
            }
            assert after == {
                d: "\n".join(x for j, x in enumerate(t.split("\n")) if (d, j) not in gone)
                for d, t in before.items()
            }
        elif k == 2:
            found = simhash.near_duplicates(docs).collect()
            assert set(after) == {r["component_id"] for r in found}
        elif k == 3:
            assert set(after) == set(before)
            assert not any(scanner.spans(t.encode()) for t in after.values())
            assert all(before[d] == t for d, t in after.items() if not scanner.spans(before[d].encode()))
        else:
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(before)
            assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= packing.CAPACITY
        docs = out


def test_empty_documents(spark, none, tmp_path):
    table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_documents(spark, odd, tmp_path):
    """Short, null and empty texts go, everything else comes out once and whole."""
    table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = {r["doc_id"] for r in pieces}
    words = {d: len(t.split()) for d, t in texts_of(odd)}
    assert found <= {d for d, n in words.items() if n >= 20 or d is None} and found
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, rows in by_doc.items():
        rows.sort(key=lambda r: (r["start"], r["piece"]))
        if doc is not None:  # rows without an id may be several documents
            assert [r["piece"] for r in rows] == list(range(len(rows)))
            assert [r["start"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))]
    taken = {}
    for r in pieces:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in taken.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= packing.CAPACITY
