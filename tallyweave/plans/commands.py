"""The commands: train on labelled sources, infer matches with a saved model, validate result files."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import evaluate, features, validate
from tallyweave.operators.records import normalised
from tallyweave.plans import linkage, model
from tallyweave.sources import tables

GRID = [0.50, 0.60, 0.70, 0.80, 0.90], [0.60, 0.75, 0.85, 0.95]  # primary and secondary thresholds that training tries


def sources(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """entity_id, src, ord and the text columns of the three files ``<kind>_source<n>.tsv``; ord follows the files' order."""
    one = (tables.read_tsv(spark, f"{folder.rstrip('/')}/{kind}_source{n}.tsv").withColumns({"src": F.lit(n), "ord": F.monotonically_increasing_id()}) for n in (1, 2, 3))
    return tables.keep_first(reduce(DataFrame.unionByName, one), ["entity_id"], ["src", "ord"])


def _featured(entities: DataFrame, settings: linkage.Settings) -> tuple[DataFrame, DataFrame]:
    records = normalised(entities, settings.rules)
    pairs = linkage.candidates(records, settings)
    return pairs, features.features43(features.rule_score(features.with_records(pairs, records)).drop("prob"))


def train(spark: SparkSession, train_dir: str, output_dir: str, val_frac: float = 0.2, cv: bool = False, **options) -> dict[str, float]:
    """Fits the classifier on the anchors outside the validation split, chooses thresholds on that split, and saves model, thresholds, metrics and candidates."""
    settings = linkage.Settings()
    entities = sources(spark, train_dir, "train")
    _, truth = tables.read_truth(spark, f"{train_dir.rstrip('/')}/train_ground_truth.tsv")
    anchors = entities.where("src = 1").select(F.col("entity_id").alias("s1_id"), "ord")
    pairs, featured = _featured(entities, settings)
    # Features are used by the fit, the grid and the folds, so they are written once.
    labelled = tables.cached(spark, f"{output_dir.rstrip('/')}/pairs", lambda: evaluate.labelled(featured, truth).select("s1_id", "cand_id", "src", "score", "label", "exact_brand", "has_conflict", *features.FS43))
    aside = model.in_split(share=val_frac)
    fitted = model.fit(labelled.where(~aside), **options)
    scored = model.scored(fitted, labelled.where(aside))
    best = model.two_tier_grid(anchors.where(aside), truth.where(aside), scored, *GRID).orderBy(F.col("macro_f05").desc(), "setting").first()
    primary, secondary = map(float, best["setting"].split("/"))
    thresholds = {"primary": primary, "secondary": secondary}
    model.save(fitted, thresholds, f"{output_dir.rstrip('/')}/model", spark)
    metrics = {"macro_f05": best["macro_f05"], "pair_precision": best["pair_precision"], "pair_recall": best["pair_recall"], **thresholds}
    if cv:
        scores = model.cross_validated(labelled, anchors, truth, threshold=primary, **options)
        spread = model.fold_spread(spark, scores).first()
        metrics |= {"cv_mean": spread["mean"], "cv_std": spread["std"]}
    tables.write_metrics(spark.createDataFrame([tuple(metrics.values())], list(metrics)), f"{output_dir.rstrip('/')}/metrics")
    tables.write_candidates(anchors, pairs, f"{output_dir.rstrip('/')}/train_candidate_pairs.tsv")
    return metrics


def infer(spark: SparkSession, test_dir: str, output_dir: str, model_path: str, threshold: float | None = None) -> dict[str, int]:
    """Writes matching_results.tsv and candidate_pairs.tsv of the test sources; ``threshold`` takes the place of the saved first one."""
    fitted, saved = model.load(model_path, spark)
    primary = saved["primary"] if threshold is None else threshold
    settings = linkage.Settings(primary=primary, secondary=max(primary, saved["secondary"]))
    entities = sources(spark, test_dir, "test")
    anchors = entities.where("src = 1").select(F.col("entity_id").alias("s1_id"), "ord")
    pairs, matches = linkage.link(entities, settings, lambda p: model.scored(fitted, features.features43(features.rule_score(p).drop("prob"))))
    tables.write_matches(anchors, matches, f"{output_dir.rstrip('/')}/matching_results.tsv")
    tables.write_candidates(anchors, pairs, f"{output_dir.rstrip('/')}/candidate_pairs.tsv")
    rows = tables.read_tsv(spark, f"{output_dir.rstrip('/')}/matching_results.tsv", tables.TRUTH)
    found = rows.agg(F.count(F.lit(1)).alias("anchors"), F.count_if(F.coalesce("matched_entity_ids", F.lit("")) != "").alias("matched")).first()
    return {"anchors": found["anchors"], "matched": found["matched"], "singletons": found["anchors"] - found["matched"]}


def check(spark: SparkSession, matching: str, candidate: str, test_dir: str) -> list[str]:
    """What is wrong with the result files, one line for each issue: missing files, then missing columns, then broken rules."""
    files = [f"{test_dir.rstrip('/')}/test_source{n}.tsv" for n in (1, 2, 3)] + [matching, candidate]
    if lost := tables.missing_files(spark, files):
        return [f"not found: {path}" for path in lost]
    rows, listed = (spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path) for path in (matching, candidate))
    if lost := validate.missing_columns(rows, listed):
        return [f"missing column: {name}" for name in lost]
    found = validate.issues(sources(spark, test_dir, "test"), rows, listed)
    return [f"{r.rule}: {r.s1_id}" + (f", {r.id}" if r.id else "") for r in found.orderBy("rule", "s1_id", "id").toLocalIterator()]


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tallyweave")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("train")
    one.add_argument("--train-dir", required=True)
    one.add_argument("--output-dir", default="output")
    one.add_argument("--val-frac", type=float, default=0.2)
    one.add_argument("--cv", action="store_true")
    one = commands.add_parser("infer")
    one.add_argument("--test-dir", required=True)
    one.add_argument("--output-dir", default="output")
    one.add_argument("--model-path", default="output/model")
    one.add_argument("--threshold", type=float)
    one = commands.add_parser("validate")
    one.add_argument("--matching", required=True)
    one.add_argument("--candidate", required=True)
    one.add_argument("--test-dir", required=True)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tallyweave").getOrCreate()
    if given.command == "train":
        print(train(spark, given.train_dir, given.output_dir, given.val_frac, given.cv))
    elif given.command == "infer":
        print(infer(spark, given.test_dir, given.output_dir, given.model_path, given.threshold))
    else:
        issues = check(spark, given.matching, given.candidate, given.test_dir)
        print("\n".join(issues) if issues else "the files are valid")
        return 1 if issues else 0
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
