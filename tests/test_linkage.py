"""Blocking, decisions, evaluation, validation, sinks and the stream on small tables, and what must hold on any."""

import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import blocking, decide, evaluate, features, profile, validate
from tallyweave.operators.records import normalised
from tallyweave.plans import linkage, model
from tallyweave.sources import tables
from tallyweave.sources.fixture import entities, true_pairs
from tallyweave.streaming import candidates as stream

SF = "/root/testdata/sf0.001"


def people(spark, rows):
    full = [(f"S{src}-{k}", src, k, n, a, c) for k, (src, n, a, c) in enumerate(rows)]
    return spark.createDataFrame(full, "entity_id string, src int, ord long, business_name string, business_address string, country string")


ROWS = [
    (1, "Alpha Brandy Ltd", "12 Main St, Austin TX 78701", "US"),
    (2, "Brandy Alpha", "12 Main St, Austin TX 78701", "US"),
    (3, "Alpha Brandy Inc", "99 Other St, Dallas TX 75001", "US"),
    (2, "Alpha Brandy", "12 Main St", "France"),
    (1, None, None, None),
    (2, "", "", ""),
]


def test_tiers(spark):
    records = normalised(people(spark, ROWS))
    pairs = {(r.s1_id, r.cand_id): r.score for r in blocking.candidate_pairs(records).collect()}
    assert pairs == {("S1-0", "S2-1"): 85, ("S1-0", "S3-2"): 100}
    all_tiers = tuple(blocking.TIERS)
    hits = blocking.tier_hits(blocking.key_table(records.where("src = 1"), all_tiers), blocking.key_table(records.where("src <> 1"), all_tiers, True))
    by_pair = {}
    for r in hits.distinct().collect():
        by_pair.setdefault(r.cand_id, set()).add(r.tier)
    assert {"fingerprint", "brand", "num_street", "num_word"} <= by_pair["S2-1"] and "exact" not in by_pair["S2-1"]
    assert {"exact", "slug", "w12", "first_last", "first_token", "prefix3", "bigram"} <= by_pair["S3-2"]
    assert "S2-3" not in by_pair and "S2-5" not in by_pair


def test_limit_prunes_common_keys(spark):
    rows = [(1, "same name", "", "US")] * 5 + [(2, "same name", "", "US")]
    records = normalised(people(spark, rows))
    assert blocking.candidate_pairs(records, ("exact",), 5).count() == 5
    assert blocking.candidate_pairs(records, ("exact",), 4).count() == 0


def test_first_pairs_are_the_best_of_all(spark):
    """Of crowded keys only the first candidates are joined, and an anchor's best are those of all pairs."""
    rows = [(1 + k % 3, "abcd efgh " + ("ijkl" if k % 4 else "mnop") + " qrst" * (k % 5 == 0), f"{k % 3} High St", "US") for k in range(90)]
    records = normalised(people(spark, rows))
    for k in (1, 3):
        want = sorted(map(tuple, blocking.top_k(blocking.candidate_pairs(records), k).collect()))
        found = blocking.first_pairs(records, k)
        assert sorted(map(tuple, blocking.top_k(found, k).select("s1_id", "cand_id", "src", "score").collect())) == want and len(want) == 60 * k
        assert found.count() < blocking.candidate_pairs(records).count()
    ordered = records.withColumn("ord", -F.col("ord"))
    all_pairs = blocking.candidate_pairs(ordered).join(ordered.select(F.col("entity_id").alias("cand_id"), "ord"), "cand_id")
    want = blocking.first_come(all_pairs, 2, ("s1_id", "src")).select("s1_id", "cand_id").collect()
    assert sorted(blocking.first_come(blocking.first_pairs(ordered, 2, order="ord"), 2, ("s1_id", "src")).select("s1_id", "cand_id").collect()) == sorted(want)


def test_alike_records_are_joined_as_one(spark):
    """Pairs of groups of copies, across chunks, rows with one id, and the limit, as pairs of single records have them; the join meets groups only."""
    rows = [(1 + k % 3, ("abcd efgh", "ijkl abcd efgh")[k % 2], "", "US") for k in range(60)]
    records = normalised(people(spark, rows))
    odd = records.unionByName(records.where("ord = 1").withColumn("name", F.lit("other")).withColumn("words", F.array(F.lit("other"), F.lit("abcd"))))
    for table, limit in ((records, None), (odd, None), (records, 11), (odd, 19)):
        hits = blocking.tier_hits(blocking.pruned(blocking.key_table(table.where("src = 1")), limit), blocking.key_table(table.where("src <> 1"), probe=True))
        want = hits.groupBy("s1_id", "cand_id", "src").agg(F.max("score")).collect()
        for chunk in (1000, 3):
            blocking.CHUNK = chunk
            try:
                got = blocking.candidate_pairs(table, limit=limit).collect()
            finally:
                blocking.CHUNK = 1000
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert blocking._alike(records.where("src <> 1"), ("exact",), True).count() == 4


def test_top_k_is_stable(spark):
    pairs = spark.createDataFrame([("s", f"c{k}", 2, 50 + k % 3) for k in range(9)], "s1_id string, cand_id string, src int, score int")
    got = [r.cand_id for r in blocking.top_k(pairs.repartition(5), 4).orderBy("cand_id").collect()]
    assert got == ["c1", "c2", "c5", "c8"]


def test_decisions(spark):
    rows = [("a", "x", 2, 0.9, False, True), ("a", "y", 2, 0.7, False, False), ("a", "z", 3, 0.55, True, False), ("b", "x", 2, 0.87, False, True), ("b", "w", 2, 0.62, False, False), ("b", "v", 2, 0.61, False, False)]
    pairs = spark.createDataFrame(rows, "s1_id string, cand_id string, src int, prob double, exact_brand boolean, has_conflict boolean")
    kept = {(r.s1_id, r.cand_id) for r in decide.two_tier(pairs, 0.6, 0.75).collect()}
    # x passes with its conflict, y is second and below 0.75, z is eased as an exact brand; b's x is refused, w becomes first.
    assert kept == {("a", "x"), ("a", "z"), ("b", "w")}
    assert {(r.s1_id, r.cand_id) for r in decide.by_rank(pairs, (0.6, 0.75), 2).collect()} == {("a", "x"), ("b", "x")}
    won = decide.one_to_one(pairs.withColumn("claim", F.lit(1.0)))
    assert {r.cand_id: r.s1_id for r in won.collect()}["x"] == "a"
    assert [tuple(r) for r in decide.conflicts(pairs).collect()] == [("x", 2, 1)]


def test_measures(spark):
    anchors = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "s1_id string")
    truth = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4")], "s1_id string, cand_id string")
    found = spark.createDataFrame([("a", "1"), ("a", "9"), ("c", "4"), ("d", "5")], "s1_id string, cand_id string")
    per = evaluate.entity_scores(anchors, truth, found)
    assert {r.s1_id: round(r.f05, 6) for r in per.collect()} == {"a": 0.5, "b": 0.0, "c": 1.0, "d": 0.0, "e": 1.0}
    m = evaluate.summary(per).first()
    assert (round(m.macro_f05, 6), m.total_tp, m.total_fp, m.total_fn, m.singletons, m.predicted_singletons, m.false_on_singletons, m.right_singletons) == (0.5, 2, 2, 2, 2, 2, 1, 1)
    assert round(evaluate.macro_f05_union(truth, found).first().macro_f05, 6) == 0.375
    assert [tuple(r) for r in evaluate.missed_pairs(truth, found).orderBy("cand_id").collect()] == [("a", "2"), ("b", "3")]
    empty = found.where("false")
    assert evaluate.summary(evaluate.counts(anchors, truth, empty)).first().macro_f05 == 0.4
    swept = evaluate.threshold_sweep(anchors, truth, found.withColumn("prob", F.lit(0.5)), [0.4, 0.6]).orderBy("threshold").collect()
    assert [round(r.macro_f05, 6) for r in swept] == [0.5, 0.4]


def test_contract(spark):
    own = people(spark, [(1, "a", "", ""), (1, "b", "", ""), (2, "c", "", ""), (3, "d", "", "")])
    matches = spark.createDataFrame([("S1-0", "S2-2,S2-2,S9-9"), ("S1-0", ""), ("S1-7", None)], "source1_entity_id string, matched_entity_ids string")
    listed = spark.createDataFrame([("S1-0", "S3-3"), ("S1-0", "")], "source1_entity_id string, candidate_entity_ids string")
    got = {(r.rule, r.s1_id, r.id) for r in validate.issues(own, matches, listed).collect()}
    assert got == {("duplicate_anchor", "S1-0", None), ("unknown_anchor", "S1-7", None), ("repeated_match", "S1-0", "S2-2"), ("unknown_match", "S1-0", "S9-9"), ("missing_anchor", "S1-1", None), ("duplicate_candidate_row", "S1-0", None), ("match_not_candidate", "S1-0", "S2-2"), ("match_not_candidate", "S1-0", "S9-9")}
    with pytest.raises(ValueError, match="matched_entity_ids"):
        validate.issues(own, matches.drop("matched_entity_ids"))


def test_whole_plan_holds_its_contract(spark):
    own = entities(spark, SF).persist()
    pairs, matches = linkage.link(own, linkage.Settings(limit=10, primary=0.4, secondary=0.5))
    anchors = own.where("src = 1").select(F.col("entity_id").alias("s1_id"))
    rows = tables.id_lists(anchors, matches, "matched_entity_ids")
    assert rows.count() == anchors.count()
    assert validate.issues(own, rows, tables.id_lists(anchors, pairs, "candidate_entity_ids")).count() == 0
    assert matches.groupBy("cand_id").count().where("count > 1").count() == 0
    assert pairs.groupBy("s1_id", "src").count().where("count > 10").count() == 0
    m = evaluate.summary(evaluate.counts(anchors, true_pairs(spark, SF), matches)).first()
    assert 0 <= m.macro_f05 <= 1
    assert profile.match_distribution(anchors, matches).agg(F.sum("anchors")).first()[0] == anchors.count()


def test_files(spark, tmp_path):
    raw = tmp_path / "s.tsv"
    raw.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "quoted" name\t\tUS\n', encoding="utf-8")
    row = tables.read_tsv(spark, str(raw)).first()
    assert row.business_name == 'A "quoted" name' and not row.business_address and row.country == "US"
    truth = tmp_path / "t.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2,\nS1-2\t\n", encoding="utf-8")
    anchors, pairs = tables.read_truth(spark, str(truth))
    assert anchors.count() == 2 and sorted(r.cand_id for r in pairs.collect()) == ["S2-1", "S3-2"]
    tables.write_matches(anchors, pairs, str(tmp_path / "out"))
    back = {r.source1_entity_id: r.matched_entity_ids for r in tables.read_tsv(spark, str(tmp_path / "out"), tables.TRUTH).collect()}
    assert back["S1-1"] == "S2-1,S3-2" and not back["S1-2"]
    tables.log_experiment(spark, {"experiment_id": "e1", "macro_f05": 0.5}, str(tmp_path / "log"))
    tables.log_experiment(spark, {"experiment_id": "e2"}, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2
    tables.write_metrics(anchors, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_model(spark, tmp_path):
    records = normalised(entities(spark, "/root/testdata/sf0.01"))
    pairs = features.with_records(linkage.candidates(records, linkage.Settings(limit=10)), records)
    labelled = evaluate.labelled(features.features43(pairs), true_pairs(spark, "/root/testdata/sf0.01")).persist()
    fitted = model.fit(labelled, trees=3, early_stop=True)
    model.save(fitted, {"primary": 0.6}, str(tmp_path / "m"), spark)
    loaded, thresholds = model.load(str(tmp_path / "m"), spark)
    got = model.scored(loaded, labelled).agg(F.min("prob"), F.max("prob")).first()
    assert 0 <= got[0] <= got[1] <= 1 and thresholds == {"primary": 0.6}
    assert len(model.importances(fitted)) == 43 and model.hard_negatives(labelled).where("label = 1").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    own = entities(spark, SF)
    own.where("src <> 1").repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.watch(source, own, "watched", str(tmp_path / "cp"), k=3, limit=10).awaitTermination()
    want = linkage.candidates(normalised(own), linkage.Settings(limit=10, per_source=3))
    assert sorted(map(tuple, stream.current(spark, "watched").collect())) == sorted(map(tuple, want.collect()))


def test_queries_use_the_plans_own_limits(spark):
    from tallyweave import queries

    own = entities(spark, SF)
    want = {(r.s1_id, r.cand_id) for r in linkage.link(own)[1].collect()}
    assert {(r.s1_id, r.cand_id) for r in queries.link_production(spark, SF).collect()} == want != set()
    assert queries.QUERIES["features18_jaro"](spark, SF).count() == linkage.candidates(normalised(own)).count() > 0


def test_true_pairs_by_brute_force(spark, tmp_path):
    texts = ["a b c d e f g h", "x " * 300 + "end", "A b c d e f g h", "a b c d e f g z", "x " * 300 + "end here", "too short", "", None, "one two three four five", "p q r s t u v w x y z", "P q r s t u v w x y z and more of it here"]
    texts += [" ".join(f"w{(k * j) % 13}" for j in range(40)) for k in range(30)] + [" ".join(f"w{(k * j) % 13}" for j in range(44)) for k in range(31)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def shingles(t):
        words = (t or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    sets = [shingles(t) for t in texts]
    name = lambda i: f"S{i % 3 + 1}-{i}"
    want = {(name(x), name(y)) for x in range(0, len(texts), 3) for y in range(len(texts)) if y % 3 and sets[x] and 2 * len(sets[x] & sets[y]) >= len(sets[x] | sets[y])}
    assert {(r.s1_id, r.cand_id) for r in true_pairs(spark, str(tmp_path)).collect()} == want and len(want) > 20


def test_scripts_are_spelled_in_records(spark):
    own = people(spark, [(1, "Москва Банк", "ул. Ленина 5", "US"), (2, "Moskva Bank Ltd", "", "US"), (3, "शर्मा प्राइवेट", "", "India"), (2, "カメラ", "", "US")])
    names = {r.entity_id: r.name for r in normalised(own).collect()}
    assert names == {"S1-0": "moskva bank", "S2-1": "moskva bank", "S3-2": "shrma", "S2-3": "kamera"}
    assert [(r.s1_id, r.cand_id) for r in blocking.candidate_pairs(normalised(own), ("exact",)).collect()] == [("S1-0", "S2-1")]


def test_table_helpers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 3, "only")], "id string, ord int, v string")
    assert {tuple(r) for r in tables.keep_first(rows, ["id"], ["ord"]).collect()} == {("a", 1, "first"), ("b", 3, "only")}
    later = spark.createDataFrame([("b", 9, "new"), ("c", 1, "more")], rows.schema)
    assert {(r.id, r.v) for r in tables.merged(rows, later, ["id"]).collect()} == {("a", "late"), ("a", "first"), ("b", "new"), ("c", "more")}
    assert [r.v for r in tables.head(rows, ["ord"], 2).collect()] == ["first", "late"]
    assert tables.having_ids(rows, later.select("id"), "id").count() == 1
    anchors = spark.createDataFrame([(f"s{k}", 99 - k) for k in range(100)], "s1_id string, ord long").repartition(7)
    pairs = spark.createDataFrame([("s5", "c2"), ("s5", "c1")], "s1_id string, cand_id string")
    tables.write_matches(anchors, pairs, f"{tmp_path}/m")
    written = [line.split("\t") for f in sorted((tmp_path / "m").glob("part-*")) for line in f.read_text().splitlines() if not line.startswith("source1")]
    assert [w[0] for w in written] == [f"s{k}" for k in range(99, -1, -1)] and dict(written)["s5"] == "c1,c2"
    assert tables.missing_files(spark, [f"{tmp_path}/m", f"{tmp_path}/none"]) == [f"{tmp_path}/none"]
    made = []
    for _ in range(2):
        got = tables.cached(spark, f"{tmp_path}/cache", lambda: made.append(1) or rows)
        assert got.count() == 3
    assert made == [1]
    for n in (3, 50):  # the saved choice stays
        assert {r.s1_id for r in tables.validation_ids(spark, anchors, n, f"{tmp_path}/ids").collect()} == {"s99", "s98", "s97"}
    report = spark.createDataFrame([(5, 10, 2.25, 0.5, 0.98765), (10, 20, 4.0, 1.0, 1.0)], "top_k int, candidate_count long, avg_candidates_per_entity double, pair_recall double, entity_coverage double")
    tables.write_blocking(report, f"{tmp_path}/b", "rules 100% and TF-IDF")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/b").orderBy("pair_recall").collect()] == [("rules 100% and TF-IDF, K=10", "10", "20", "4.0", "100.00%", "100.00%"), ("rules 100% and TF-IDF, K=5", "5", "10", "2.3", "50.00%", "98.77%")]


def test_post_hoc(spark):
    records = spark.createDataFrame([("a", "same name", "one road", "5"), ("b", "same name", "one road", "6"), ("x", "same name", "one road", "6"), ("z", "far", "off", "")], "entity_id string, name string, addr string, street_num string")
    rows = [("a", "x", 1), ("b", "x", 2), ("b", "y", 3), ("a", "y", 4), ("lost", "z", 5), ("b", "z", 6), ("b", "alone", 7)]
    matches = spark.createDataFrame(rows, "s1_id string, cand_id string, ord int")
    # x goes by its number, y has no record and goes to its first claim; of z's claims the unknown anchor has 0, b less or as little.
    got = {r.cand_id: r.s1_id for r in decide.post_hoc(matches, records).collect()}
    assert got["x"] == "b" and got["y"] == "b" and got["alone"] == "b" and got["z"] in ("b", "lost") and len(got) == 4
    tied = spark.createDataFrame([("q", "x", 2), ("p", "x", 3), ("r", "x", 1)], matches.schema)
    assert [r.s1_id for r in decide.post_hoc(tied, records).collect()] == ["r"]


def test_folds_and_hard_negatives(spark):
    spread = model.fold_spread(spark, [0.5, 0.7]).first()
    assert (spread.folds, round(spread["mean"], 6), round(spread["std"], 6)) == (2, 0.6, 0.1)
    rows = [(f"s{k}", f"c{k}", k % 2, 0.9 if k % 4 < 2 else 0.3, float(k % 2)) for k in range(80)]
    labelled = spark.createDataFrame(rows, "s1_id string, cand_id string, label int, jw_name double, f double")
    assert {r.s1_id for r in model.hard_negatives(labelled).collect()} == {f"s{k}" for k in range(0, 80, 4)}
    anchors, truth = labelled.select("s1_id"), labelled.where("label = 1").select("s1_id", "cand_id")
    scores = model.cross_validated(labelled, anchors, truth, folds=2, features=["f", "jw_name"], trees=2)
    assert scores == [1.0, 1.0]


def test_cosine_by_brute_force(spark):
    import math

    own = people(spark, [(1, "alpha beta", "", "US"), (2, "alpha betas", "", "US"), (3, "gamma", "", "US"), (2, None, "", "US")])
    records = normalised(own)
    vectors, names = {}, {r.entity_id: r.words for r in records.collect()}
    for i, words in names.items():
        counts = {}
        for w in (f" {x} " for x in words):
            for n in (2, 3, 4):
                for g in [w[k : k + n] for k in range(len(w) - n + 1)] if len(w) >= n else [w]:
                    counts[g] = counts.get(g, 0) + 1
        vectors[i] = counts
    df = {g: sum(g in v for v in vectors.values()) for v in vectors.values() for g in v}
    for v in vectors.values():
        for g in v:
            v[g] *= math.log((1 + len(vectors)) / (1 + df[g])) + 1
        size = math.sqrt(sum(x * x for x in v.values()))
        for g in v:
            v[g] /= size
    pairs = spark.createDataFrame([("S1-0", f"S{s}-{k}") for s, k in ((2, 1), (3, 2), (2, 3))], "s1_id string, cand_id string")
    got = {r.cand_id: r.c for r in blocking.with_cosine(pairs, records, "words", "c").collect()}
    for cand, value in got.items():
        assert value == pytest.approx(sum(w * vectors[cand].get(g, 0) for g, w in vectors["S1-0"].items()))
    assert got["S2-3"] == 0


def test_commands(spark, tmp_path, monkeypatch):
    from tallyweave.plans import commands

    own = entities(spark, "/root/testdata/sf0.001").collect()
    truth = {}
    for r in true_pairs(spark, "/root/testdata/sf0.001").collect():
        truth.setdefault(r.s1_id, []).append(r.cand_id)
    for kind in ("train", "test"):
        folder = tmp_path / kind
        folder.mkdir()
        for n in (1, 2, 3):
            rows = [r for r in own if r.src == n]
            folder.joinpath(f"{kind}_source{n}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"{r.entity_id}\t{r.business_name}\t{r.business_address}\t{r.country}\n" for r in rows))
    (tmp_path / "train" / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{r.entity_id}\t{','.join(truth.get(r.entity_id, []))}\n" for r in own if r.src == 1))
    out = f"{tmp_path}/out"
    metrics = commands.train(spark, f"{tmp_path}/train", out, 0.4, trees=2, depth=2)
    assert 0 <= metrics["macro_f05"] <= 1 and spark.read.json(f"{out}/metrics").count() == 1
    assert commands.main(["infer", "--test-dir", f"{tmp_path}/test", "--output-dir", out, "--model-path", f"{out}/model", "--threshold", "0.3"]) == 0
    files = ["--matching", f"{out}/matching_results.tsv", "--candidate", f"{out}/candidate_pairs.tsv", "--test-dir", f"{tmp_path}/test"]
    assert commands.main(["validate", *files]) == 0
    written = [line.split("\t")[0] for f in sorted((tmp_path / "out" / "matching_results.tsv").glob("part-*")) for line in f.read_text().splitlines()]
    assert [w for w in written if w != "source1_entity_id"] == [r.entity_id for r in own if r.src == 1]
    assert commands.main(["validate", *files[:4], "--test-dir", f"{tmp_path}/none"]) == 1
    assert commands.check(spark, f"{out}/candidate_pairs.tsv", f"{out}/candidate_pairs.tsv", f"{tmp_path}/test") == ["missing column: matched_entity_ids"]


def shuffled(spark, job):
    """What a job returns, and how many bytes it wrote to shuffles."""

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        executors = sc.statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = written()
    found = job()
    return found, written() - before


def test_true_pairs_shuffle_little(spark):
    """Below 3 times the input; it was 3.5 times when each shingle was a row, twice."""
    sf = "/root/testdata/sf0.01"
    _, wrote = shuffled(spark, lambda: true_pairs(spark, sf).count())
    assert wrote < 3 * os.path.getsize(f"{sf}/documents.parquet")


def test_true_pairs_of_many_documents_shuffle_less_than_their_hashes(spark, tmp_path):
    """Unlike documents send a part of their shingles, of four bytes each; it was all of them, of six bytes and more (1.6 MB)."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(600)]
    for k in range(0, 60, 3):  # anchors and, with half of their words, candidates
        texts[k + 1] = " ".join(texts[k].split()[:290] + texts[k + 1].split()[290:])
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found, wrote = shuffled(spark, lambda: true_pairs(spark, str(tmp_path)).collect())
    assert {(r.s1_id, r.cand_id) for r in found} == {(f"S1-{k}", f"S2-{k + 1}") for k in range(0, 60, 3)}
    assert wrote < 600 * 396 * 5
    plan = true_pairs(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow gather") == plan.count("Filter isnotnull(n#") == 6  # so that one shuffle serves them all


def test_blocking_by_k_keeps_a_row_for_each_pair(spark):
    anchors = spark.createDataFrame([(f"a{k}",) for k in range(40)], "s1_id string")
    rules = [(f"a{k}", f"c{j}") for k in range(0, 40, 2) for j in range(k % 5)]
    ranked = [(f"a{k}", f"c{j}", j - k % 3 + 1) for k in range(0, 40, 3) for j in range(k % 3, 50)]
    truth = [(f"a{k}", f"c{j}") for k in range(0, 40, 5) for j in (0, 7, 30)] + [("a1", "c1"), ("a1", "c1"), ("other", "c1")]
    make = lambda rows, names: spark.createDataFrame(rows, names).repartition(8)
    tables_ = make(truth, "s1_id string, cand_id string"), make(rules, "s1_id string, cand_id string"), make(ranked, "s1_id string, cand_id string, rank int")
    ks = [5, 10, 20, 30, 50]
    got = {r.top_k: r for r in evaluate.blocking_by_k(anchors, *tables_, ks).collect()}
    for k in ks:
        pred = {*rules, *((a, c) for a, c, r in ranked if r <= k)}
        true = {t for t in truth if t[0] != "other"}
        hit = {a for a, _ in pred & true}
        covered = sum(f"a{j}" in hit or f"a{j}" not in {a for a, _ in true} for j in range(40))
        assert got[k].candidate_count == len(pred) and got[k].avg_candidates_per_entity == pytest.approx(len(pred) / 40)
        assert got[k].pair_recall == pytest.approx(len(pred & true) / len(true)) and got[k].entity_coverage == pytest.approx(covered / 40)
    plan = evaluate.blocking_by_k(anchors, *tables_, ks)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("Generate explode") == 1


def brute_tfidf(rows, low, high, min_df, max_df, least, k, fit_on_anchors):
    def grams(words):
        found = Counter()
        for w in words:
            w = f" {w} "
            for n in range(low, high + 1):
                found.update([w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else [w])
        return found

    tf, src, n, df = defaultdict(Counter), {}, Counter(), Counter()
    for i, s, country, words in rows:
        src[i] = s
        tf[i].update({(country, g): c for g, c in grams(words).items()})
        n[country] += fit_on_anchors or s != 1
    for i, own in tf.items():
        df.update({x: 1 for x in own} if fit_on_anchors or src[i] != 1 else {})
    idf = {x: math.log((1 + n[x[0]]) / (1 + c)) + 1 for x, c in df.items() if min_df <= c <= max_df * n[x[0]]}
    vectors = {i: {x: c * idf[x] for x, c in own.items() if x in idf} for i, own in tf.items()}
    found = set()
    for a, va in vectors.items():
        if src[a] == 1:
            size = lambda v: math.sqrt(sum(w * w for w in v.values()))
            scores = [(round(sum(w * vb.get(x, 0.0) for x, w in va.items()) / ((size(va) * size(vb)) or 1.0), 6), b) for b, vb in vectors.items() if src[b] != 1]
            found |= {(a, b, c) for c, b in sorted((x for x in scores if x[0] >= least), key=lambda x: (-x[0], x[1]))[:k]}
    return found


@pytest.mark.parametrize("options", [(2, 4, 1, 1.0, 0.3, 4, True), (3, 5, 2, 0.6, 0.05, 3, False)])
def test_tfidf_by_brute_force(spark, monkeypatch, options):
    """Small blocks, names of many candidates, words that come twice, ids that stand in two rows or two countries, and names without words."""
    monkeypatch.setattr(blocking, "ANCHORS", 3, raising=False)
    monkeypatch.setattr(blocking, "CANDIDATES", 4, raising=False)
    r = random.Random(11)
    words = ["".join(r.choices("abcd", k=r.randrange(1, 6))) for _ in range(14)]
    rows = [(f"S{s}-{i}", s, r.choice(["US", "INDIA", ""]), r.choices(words, k=r.randrange(0, 5))) for i in range(60) for s in [r.randrange(1, 4)]]
    rows += [(f"S2-{100 + i}", 2, "US", ["abc", "da"]) for i in range(9)] + [("S1-200", 1, "US", ["da", "abc"]), ("S1-201", 1, "US", ["abc", "abc", "da"])]
    rows += [("S1-300", 1, "US", ["abc"]), ("S1-300", 1, "INDIA", ["da", "b"]), ("S2-301", 2, "US", ["abc", "b"]), ("S2-301", 2, "INDIA", ["da"])]
    records = spark.createDataFrame(rows, "entity_id string, src int, country string, words array<string>").repartition(3)
    got = {(x.s1_id, x.cand_id, x.cosine) for x in blocking.tfidf_pairs(records, *options).collect()}
    assert got == brute_tfidf(rows, *options) and len(got) > 30


def test_tfidf_shuffles_no_pairs(spark):
    """Less than the input; the join of posting lists shuffled many times as much."""
    sf = "/root/testdata/sf0.01"
    records = normalised(entities(spark, sf))
    _, wrote = shuffled(spark, lambda: blocking.tfidf_pairs(records).count())
    assert wrote < os.path.getsize(f"{sf}/documents.parquet")


def test_cosines_shuffle_no_vectors(spark):
    """Pairs carry both sides' words: a tenth of the input or so; their vectors were many times as much."""
    sf = "/root/testdata/sf0.01"
    records = normalised(entities(spark, sf))
    pairs = linkage.candidates(records).select("s1_id", "cand_id").localCheckpoint()
    _, wrote = shuffled(spark, lambda: blocking.with_cosine(pairs, records, "addr_words", "c").agg({"c": "sum"}).first())
    assert wrote < 1_000_000


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_library_features_read_whole_addresses(spark, tmp_path):
    """Addresses that differ after their first 100 characters only; their edit similarity was 1.  The query's SQL says the same."""
    import duckdb

    from tallyweave import queries

    same = " ".join(f"{'abcdefgh'[k] * 4}{'street' * 5}" for k in range(4))
    ends = ["north gate", "south gate", "n", "of quite another quarter" * 20, "north gate"]
    own = people(spark, [(1 if not k else 2, "Alpha Brandy", f"{same} {end}", "US") for k, end in enumerate(ends)])
    records = normalised(own)
    addr = {r.entity_id: r.addr for r in records.collect()}
    assert len({a[:100] for a in addr.values()}) == 1
    pairs = spark.createDataFrame([("S1-0", f"S2-{k}") for k in range(1, 5)], "s1_id string, cand_id string")
    got = {r.cand_id: r.address_levenshtein for r in features.library_features(features.with_records(pairs, records)).collect()}
    assert got == {c: pytest.approx(1 - edits(addr["S1-0"], addr[c]) / max(len(addr["S1-0"]), len(addr[c]))) for c in got}
    assert got["S2-4"] == 1 and len(got) == 4 and max(got[f"S2-{k}"] for k in (1, 2, 3)) < 1

    texts = [f"alpha brandy gamma delta five six {same} {end}" for end in ends]
    own = [(t, len(t)) for t in texts] + [(texts[0], len(texts[0]) + 97)]
    rows = [(3 * k + (k > 0), t, "en", "web", n) for k, (t, n) in enumerate(own)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.cand_id: r.address_levenshtein for r in queries.QUERIES["features_library"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    said = duck.sql(f"select cand_id, address_levenshtein from ({queries.ORACLES['features_library']})").fetchall()
    assert dict(said) == pytest.approx(found) and len(found) == 5
    addr = {r.entity_id: r.addr for r in normalised(entities(spark, str(tmp_path))).collect()}
    assert found == {c: pytest.approx(1 - edits(addr["S1-0"], addr[c]) / max(len(addr["S1-0"]), len(addr[c])), abs=1e-6) for c in found}


def test_library_pairs_by_one_join_a_side(spark):
    """The same as both cosines joined to the pairs, of ids that several rows share as well."""
    rows = [(1, "alpha beta gamma", "12 main st austin", "US"), (2, "alpha betas", "main street 5", "US"), (2, "", "", "US"), (3, "gamma  delta", None, "US")]
    records = normalised(people(spark, rows).union(people(spark, [(1, "beta zeta", "", "France"), (2, "", "main", "US"), (2, None, "7 side st", "US")])))
    pairs = spark.createDataFrame([("S1-0", f"S{s}-{k}") for s, k in ((2, 1), (2, 2), (3, 3))], "s1_id string, cand_id string")
    names = ["s1_id", "cand_id", "a_name", "b_name", "a_addr", "b_addr", "a_words", "b_words", "a_addr_words", "b_addr_words", "a_country", "b_country", "name_cosine", "address_cosine"]

    def told(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())

    joined = blocking.with_cosine(blocking.with_cosine(features.with_records(pairs, records), records, "words", "name_cosine"), records, "addr_words", "address_cosine")
    got = told(features.library_pairs(pairs, records))
    assert got == told(joined) and len(got) == 10
    assert len({r[-2] for r in got}) > 2 and len({r[-1] for r in got}) > 1
