"""The corpus pipeline: stage by stage against what each must keep."""

from collections import Counter

import corpus_pipeline
from plantloom.llm.common import stored

from .brute import ODD_SCHEMA, WORD, components, jaccard_links, odd_rows, sets_of


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "mix", "pack"]
    rows = {r.doc_id: r for r in docs.collect()}
    kept, ids = docs, []
    for name, stage in corpus_pipeline.STAGES:
        kept = stored(stage(spark, kept, sf), f"test-{name}")
        ids.append([r.doc_id for r in kept.select("doc_id").collect()])
        if name != "pack":
            assert kept.columns == docs.columns
    assert set(ids[0]) == {i for i, r in rows.items() if any(map(str.isalpha, r.text or ""))}
    order = sorted(ids[0])
    links = jaccard_links([sets_of(rows[i].text) for i in order], 0.8)
    comp = components(len(order), links)
    first = {}
    for i, c in zip(order, comp, strict=True):
        first.setdefault(c, i)
    assert sorted(ids[1]) == sorted(first.values())
    assert set(ids[2]) <= set(ids[1]) and max(Counter(ids[2]).values()) <= 3
    size = {i: len(WORD.findall(rows[i].text)) for i in ids[1]}
    assert abs(sum(size[i] for i in ids[2]) - sum(size.values())) <= 20 * max(size.values())
    assert set(ids[3]) == set(ids[2])


def test_odd_documents(spark, tmp_path):
    df = spark.createDataFrame(odd_rows(), ODD_SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
