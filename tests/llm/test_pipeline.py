import os

import corpus_pipeline
from tallyweave.llm import jaccard_join, quality, toxicity
from tallyweave.llm.shared import read

from test_jaccard import brute as brute_components
from test_lines import brute as brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "line_dedup", "ngram_jaccard", "packing"]
    docs = read(spark, SF, "documents")
    labels = read(spark, SF, "labels")
    steps = [docs]
    for _, f in corpus_pipeline.STAGES:
        steps.append(f(spark, steps[-1], SF).persist())
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:-1]]
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 1").collect()}
    assert set(rows[1]) == set(rows[0]) - toxic
    good = {r.doc_id for r in quality.score(steps[1], quality.train(steps[1], labels)).where("predicted = 1").collect()}
    assert set(rows[2]) == good < set(rows[1])
    lines = {r[0]: r for r in brute_lines([(i, r.text) for i, r in rows[2].items()], 1, 2, 20)}
    for i, r in rows[2].items():
        _, text, _, removed = lines[i]
        if removed and not text.strip():
            assert i not in rows[3]
        else:
            assert rows[3][i].text == text and rows[3][i].n_chars == (len(text) if removed else r.n_chars)
    components = brute_components([(i, r.text) for i, r in rows[3].items()])
    assert set(rows[4]) == {i for i, _, c in components if i == c}
    assert {r.doc_id for r in steps[5].collect()} == set(rows[4])
    whole = corpus_pipeline.run(spark, SF).collect()
    # Rows may lie in other tasks, so sequences may differ; documents and their ids don't.
    assert {(r.doc_id, r.doc_tokens) for r in whole} == {(r.doc_id, r.doc_tokens) for r in steps[5].collect()}


def test_near_copies_go_once(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(4, text, "en", "a", 1), (2, text + " end", "en", "a", 1), (9, "other words here", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [2, 9]
    assert {r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {2, 9}


ODD = "text string, doc_id long, component_id int, n_chars int, score string, doc long, row long, lang string"


def odd_rows():
    good = "The quiet river ran past the old stone mill while the miller counted his sacks of grain ."
    rows = [(f"{good} {k}\nA shared last line of this page here", k) for k in range(6)]
    rows += [(None, 50), ("", 51), (" \n\t", 52), (good, None), (None, None), (good + " 0\nA shared last line of this page here", 0), ("quite other words " * 4, 3), ("word " * 60_000, 60)]
    return [(t, i, 1, len(t or ""), "x", 9, 9, "en") for t, i in rows]


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert near.schema == docs.schema
    got = sorted(((r.doc_id, r.text) for r in near.collect()), key=str)
    rows = [(r[1], r[0]) for r in odd_rows()]
    roots = {i: root for i, _, root in brute_components(rows)}
    assert got == sorted({(i, t) for i, t in rows if i is not None and roots[i] == i} | {(i, t) for i, t in rows if i is None}, key=str)
    kept = corpus_pipeline.drop_lines(spark, docs, SF)
    assert kept.schema == docs.schema
    want = sorted(((i, t) for i, t, _, removed in brute_lines(rows, 1, 2, 20) if not removed or t.strip()), key=str)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in packed.where("start = 0").collect()) == sorted(-1 if i is None else i for i, _ in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).collect() == []


def test_whole_run_over_odd_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), ODD)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(6)] + [(None, 1, 1), (60, None, 7)], "doc_id long, quality int, toxic int")
    for name, some in (("odd", "true"), ("empty", "false")):
        docs.where(some).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.where(some).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(rows) == (name == "odd")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    left = [n.split("-")[0] for n in set(os.listdir(folder)) - before]
    assert left == ["ngram_jaccard"]  # what the last stage reads
