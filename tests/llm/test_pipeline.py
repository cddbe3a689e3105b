"""The pipeline's stages against their operators' own results and plain Python, on a small table."""

import zlib

import numpy as np
from pyspark.sql.functions import lit
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quern.llm import decontaminate, mixing, quality_rules
from quern.llm.common import materialise, table
from quern.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for _, stage in cp.STAGES[:-1]:
        kept.append(materialise(stage(spark, kept[-1], SF)))
        assert kept[-1].columns == columns
    rows = [{r.doc_id: r for r in d.collect()} for d in kept]
    scores = quality_rules.scored_documents(docs, table(spark, SF, "labels"))
    assert set(rows[1]) == {r.doc_id for r in scores.filter("score >= 0.3").collect()}
    texts = {}
    for d, r in sorted(rows[1].items()):
        texts.setdefault(r.text, []).append(d)
    first = {ids[0] for ids in texts.values()}
    assert set(rows[2]) <= first and len(rows[2]) > 0.8 * len(first)
    found = decontaminate.contaminated_documents(kept[2], table(spark, SF, "benchmark"))
    assert set(rows[3]) == {r.doc_id for r in found.filter("not contaminated").collect()}
    taken = {r.doc_id: r.taken for r in mixing.mixed_documents(kept[3]).collect()}
    times = {}
    for r in kept[4].collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) == {d for d, n in taken.items() if n}
    tok, at, want = Tokenizer.from_file(vocabulary()), 0, []
    for r in sorted(kept[4].collect(), key=lambda r: r.doc_id):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, cp.STAGES[-1][1](spark, kept[4], SF).collect())) == want
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == want


def test_edges(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing column names, and empty tables."""
    good = " ".join(f"Sentence {i} has some plain words." for i in range(30))
    rows = [(1, good, "en", "a", 5, "x"), (2, good, None, None, None, None), (3, good.replace("Sentence 3 ", "Line 3 "), "en", "b", 1, "y"), (4, None, None, "a", None, "z"), (5, "", "en", "a", 0, "z"), (6, "long words here " * 40_000, "en", "b", 9, "z"), (None, "no id but text", "en", "c", 3, "z"), (7, "of a benchmark item that has more than ten words in it", "en", "a", 3, "z"), (7, "of a benchmark item that has more than ten words in it", "en", "a", 3, "z"), (1 << 62, "a large id", "en", None, 3, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string").withColumns({"fp": lit(1), "_g": lit(2), "pattern": lit("p"), "start": lit(0)})
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 8)] + [(None, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i1", "This is the text of a benchmark item that has more than ten words in it"), (None, "x"), ("i2", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = docs
    ids = []
    for _, stage in cp.STAGES[:-1]:
        kept = materialise(stage(spark, kept, folder))
        assert kept.columns == docs.columns
        ids.append(sorted({str(r.doc_id) for r in kept.collect()}))
    every = sorted({str(r[0]) for r in rows})
    assert ids[0] == every  # all labels say good
    assert ids[1] == sorted(set(every) - {"2", "3", "5"})  # copies of 1, and 5 is as empty as 4
    assert ids[2] == sorted(set(ids[1]) - {"7"})
    assert set(ids[3]) <= set(ids[2])
    out = cp.run(spark, folder).collect()
    assert {str(r.doc_id) for r in out} <= set(ids[2]) and all(r.n_tokens >= 1 for r in out)
    assert cp.STAGES[-1][1](spark, kept, folder).count() == kept.count()
    docs.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{folder}/none/{name}.parquet")
    assert cp.run(spark, f"{folder}/none").count() == 0
