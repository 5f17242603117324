"""Search over parameters, out-of-fold stacking, and confirmation on blocks held back.

Models are compared on counts that Spark aggregates; the driver only loops over trials.
Teachers that differ in rounds alone share one fit, of which shorter ones are prefixes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fp32 import first_winner, softmax
from ..plans.options import trials as expand_trials
from ..plans import storage
from ..plans.storage import cut
from . import evaluation, scoring, training

CANDIDATES = "ord int, kind string, errors long, bytes long"
NODE_BYTES = 16
MOST_MODELS = 1 << 12


def size_of(trees: DataFrame) -> int:
    return NODE_BYTES * trees.count()


def errors_of(scored: DataFrame, label: str, predicted: str) -> int:
    return scored.agg(F.count_if(F.col(predicted) != F.col(label)).alias("n")).first()["n"]


def fits(rows: DataFrame, features: list[str], label: str, classes: int, plans: list[dict[str, Any]]) -> list[tuple[DataFrame, list[float]]]:
    """A model for each plan; plans equal but for ``rounds`` are prefixes of the longest."""
    longest: dict[tuple, int] = {}
    key = lambda p: tuple(sorted((k, v) for k, v in p.items() if k != "rounds"))
    for p in plans:
        longest[key(p)] = max(longest.get(key(p), 0), p["rounds"])
    made = {k: training.train(rows, features, label, classes, dict(k) | {"rounds": n}) for k, n in longest.items()}
    out = []
    for p in plans:
        trees, bias = made[key(p)]
        out.append((training.prefix(trees, p["rounds"], classes), bias))
    return out


def search(fit: DataFrame, valid: DataFrame, features: list[str], label: str, classes: int, base: dict[str, Any], overlays: list[dict[str, Any]]) -> tuple[DataFrame, list[tuple[DataFrame, list[float]]]]:
    """Candidates (ord, kind, errors, bytes) of all trials, and their models."""
    plans = expand_trials(base, overlays, classes)
    models = fits(fit, features, label, classes, plans)
    scored = valid
    for i, (trees, bias) in enumerate(models):
        scored = scoring.classify(scored, trees, features, bias, name=f"c{i}")
    # one pass over the validation rows counts the errors of all trials
    counts = scored.agg(*(F.count_if(F.col(f"c{i}") != F.col(label)).alias(f"c{i}") for i in range(len(models)))).first()
    rows = [(i, "trial", counts[f"c{i}"], size_of(trees)) for i, (trees, _) in enumerate(models)]
    return fit.sparkSession.createDataFrame(rows, CANDIDATES), models


def respond(rows: DataFrame, trees: DataFrame, features: list[str], bias: list[float], teacher: int, id_col: str) -> DataFrame:
    """(row_id, teacher, class, p) of one teacher."""
    p = softmax(F.col("margins"))
    return scoring.margins(rows, trees, features, bias).select(F.col(id_col).alias("row_id"), F.lit(teacher).alias("teacher"), F.posexplode(p).alias("class", "p"))


def out_of_fold(rows: DataFrame, features: list[str], label: str, classes: int, plans: list[dict[str, Any]], folds: int, seed: int, id_col: str) -> DataFrame:
    """Responses of every teacher on every row, by a model that was not fitted on the row's fold.

    ``id_col`` must be a dense ordinal.  A missing or repeated response is an error.
    """
    fold = evaluation.fold_of(F.col(id_col), folds, seed)
    parts = []
    for k in range(folds):
        models = fits(rows.where(fold != k), features, label, classes, plans)
        held = rows.where(fold == k)
        parts += [respond(held, trees, features, bias, t, id_col) for t, (trees, bias) in enumerate(models)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = cut(out, "responses")
    wrong = evaluation.coverage_audit(out, rows.select(F.col(id_col).alias("row_id")), len(plans), classes).limit(1).collect()
    if wrong:
        raise ValueError(f"incomplete responses: {wrong}")
    return out


def widen(responses: DataFrame, teachers: int, classes: int) -> tuple[DataFrame, list[str]]:
    """One row for each row_id, a float column for each teacher and class, teacher by teacher."""
    names = [f"t{t}_{k}" for t in range(teachers) for k in range(classes)]
    picks = [F.max(F.when((F.col("teacher") == t) & (F.col("class") == k), F.col("p"))).cast("float").alias(f"t{t}_{k}") for t in range(teachers) for k in range(classes)]
    return responses.groupBy("row_id").agg(*picks), names


class Stopped(Exception):
    """A study stopped after its out-of-fold responses, which its folder keeps."""


Model = tuple[DataFrame, list[float]]


def kept_models(spark: SparkSession, folder: str | None, stage: str, plan: dict[str, Any], make: Callable[[], list[Model]]) -> list[Model]:
    """The models of a stage in a study's folder, fitted and saved there if they are missing."""
    if folder is None:
        return make()

    def table() -> DataFrame:
        parts = [trees.select(F.lit(i).alias("model"), F.array(*(F.lit(float(b)) for b in bias)).alias("bias"), "*") for i, (trees, bias) in enumerate(make())]
        return reduce(DataFrame.unionByName, parts)

    found = storage.kept(spark, folder, stage, plan, table)
    facts = storage.bounded(found.select("model", "bias").distinct(), MOST_MODELS, "models of a stage")
    return [(found.where(F.col("model") == r["model"]).drop("model", "bias"), list(r["bias"])) for r in sorted(facts, key=lambda r: r["model"])]


def combine(
    fit: DataFrame, valid: DataFrame, features: list[str], label: str, classes: int, plans: list[dict[str, Any]], meta: list[dict[str, Any]], folds: int = 2, seed: int = 0, id_col: str = "row_id",
    folder: str | None = None, stop_after_responses: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Candidates of a stacking study, and the validation rows with every candidate's class.

    Candidates are the teachers fitted on all of ``fit``, then for each meta plan a model on the
    teachers' out-of-fold responses.  A combination's size counts each distinct teacher once.

    With a ``folder`` every stage is kept there once it is whole: the responses, the teachers, each meta model, the scored
    rows and the candidates.  A later call of the same plan goes on after the last whole stage, and one of
    another plan is refused.  A study may stop once the responses are kept (``Stopped``).
    """
    spark = fit.sparkSession
    identity = {"plans": plans, "folds": folds, "seed": seed, "features": features, "classes": classes, "rows": storage.content_id(fit.select(id_col, label, *features)) if folder else None}
    responses = storage.kept(spark, folder, "responses", identity, lambda: out_of_fold(fit, features, label, classes, plans, folds, seed, id_col))
    if stop_after_responses:
        raise Stopped(f"{len(plans)} teachers have answered")
    teachers = kept_models(spark, folder, "teachers", identity, lambda: fits(fit, features, label, classes, plans))
    sizes = [size_of(t) for t, _ in teachers]
    scored = valid
    for i, (trees, bias) in enumerate(teachers):
        scored = scoring.classify(scored, trees, features, bias, name=f"c{i}")
    oof, names = widen(responses, len(plans), classes)
    inner = oof.join(fit.select(F.col(id_col).alias("row_id"), label), "row_id")
    answers = None
    for t, (trees, bias) in enumerate(teachers):
        own = respond(valid, trees, features, bias, t, id_col)
        answers = own if answers is None else answers.unionByName(own)
    outer, _ = widen(answers, len(plans), classes)
    kinds = ["teacher"] * len(plans)
    for j, plan in enumerate(meta):
        [(trees, bias)] = kept_models(spark, folder, f"meta-{j}", identity | {"meta": plan}, lambda p=plan: [training.train(inner, names, label, classes, p)])
        column = f"c{len(plans) + j}"
        judged = scoring.margins(outer, trees, names, bias).select("row_id", first_winner(F.col("margins")).alias(column))
        scored = scored.join(judged.withColumnRenamed("row_id", id_col), id_col)
        sizes.append(sum(sizes[: len(plans)]) + size_of(trees))
        kinds.append("combination")
    last = identity | {"all_meta": meta, "valid": storage.content_id(valid) if folder else None}
    scored = storage.kept(spark, folder, "scored", last, lambda made=scored: made) if folder else cut(scored, "scored")

    def candidates() -> DataFrame:
        counts = scored.agg(*(F.count_if(F.col(f"c{i}") != F.col(label)).alias(f"c{i}") for i in range(len(kinds)))).first()
        return spark.createDataFrame([(i, kind, counts[f"c{i}"], sizes[i]) for i, kind in enumerate(kinds)], CANDIDATES)

    return storage.kept(spark, folder, "candidates", last, candidates).orderBy("ord"), scored


def confirm(scored: DataFrame, candidates: DataFrame, baseline: int, label: str, blocks: int, id_col: str) -> DataFrame:
    """Gates of the winning candidate against the baseline on blocks of held-back rows."""
    best = evaluation.winner(candidates).first()["ord"]
    block = evaluation.block_of(F.col(id_col), scored.count(), blocks)
    return evaluation.gates_by_block(scored, block, f"c{best}", f"c{baseline}", label)


def cached_model(models: DataFrame, wanted: DataFrame) -> DataFrame:
    """(want, model, rounds) of the shortest stored model that covers each wanted plan, the first if several.

    ``models`` has (model, ord, plan, rounds), ``wanted`` (want, plan, rounds); ``plan`` is the
    identity of all parameters but the rounds.
    """
    place = F.struct(F.col("ord").isNull(), "ord", "model")
    first = models.where("plan IS NOT NULL AND rounds IS NOT NULL").groupBy("plan", "rounds").agg(F.min(place).alias("_place"))
    # the nearest stored rounds at or above each wanted number; a plan's rows here are its different rounds
    stored = first.select("plan", "rounds", F.col("rounds").alias("_rounds"))
    asked = wanted.select("plan", "rounds").distinct().withColumn("_rounds", F.lit(None).cast(models.schema["rounds"].dataType))
    nearest = F.last("_rounds", ignorenulls=True).over(Window.partitionBy("plan").orderBy(F.desc("rounds")))
    both = stored.unionByName(asked).select("plan", "rounds", nearest.alias("_rounds")).distinct()
    at = first.select("plan", F.col("rounds").alias("_rounds"), "_place")
    fits_ = wanted.join(both.join(at, ["plan", "_rounds"]), ["plan", "rounds"], "left")
    best = fits_.groupBy("want").agg(F.min(F.struct(F.col("_rounds").isNull(), F.col("_rounds").alias("rounds"), "_place")).alias("m"))
    return best.select("want", "m._place.model", "m.rounds")


def import_columns(responses: DataFrame, donor: DataFrame, own: DataFrame) -> DataFrame:
    """Responses of a finished study under the numbers of this one.

    ``donor`` and ``own`` have (teacher, declaration); only equal declarations match, and a
    declaration that either side has twice is an error.
    """
    for side in (donor, own):
        if not side.groupBy("declaration").count().where("count > 1").isEmpty():
            raise ValueError("a teacher is declared twice")
    match = donor.join(own.select(F.col("teacher").alias("_own"), "declaration"), "declaration").select("teacher", "_own")
    return responses.join(match, "teacher").select("row_id", F.col("_own").alias("teacher"), "class", "p")


def bundle_bytes(parts: DataFrame) -> DataFrame:
    """(bundle, bytes): sizes of bundles (bundle, model, bytes); a model used twice counts once."""
    return parts.dropDuplicates(["bundle", "model"]).groupBy("bundle").agg(F.sum("bytes").alias("bytes"))


def overlap(a: DataFrame, b: DataFrame, columns: list[str]) -> int:
    """How many distinct rows two tables share; holdouts must share none with what was fitted."""
    return a.select(*columns).intersect(b.select(*columns)).count()


def refit(rows: DataFrame, features: list[str], label: str, classes: int, plans: list[dict[str, Any]], meta: tuple[DataFrame, list[float]], scored: DataFrame, id_col: str = "row_id") -> DataFrame:
    """``scored`` rows by a frozen meta model over teachers fitted again on all of ``rows``."""
    teachers = fits(rows, features, label, classes, plans)
    answers = None
    for t, (trees, bias) in enumerate(teachers):
        own = respond(scored, trees, features, bias, t, id_col)
        answers = own if answers is None else answers.unionByName(own)
    wide, names = widen(answers, len(plans), classes)
    judged = scoring.classify(wide, meta[0], names, meta[1]).select(F.col("row_id").alias("_row"), "class")
    return scored.join(judged, F.col(id_col) == F.col("_row")).drop("_row")


class Rows:
    """A table with a role.  Only FIT rows may be fitted, only VALID and HOLDOUT rows may choose."""

    def __init__(self, df: DataFrame, role: str) -> None:
        if role not in ("FIT", "VALID", "HOLDOUT", "TEST"):
            raise ValueError("unknown role")
        self.df, self.role = df, role

    def to_fit(self) -> DataFrame:
        if self.role != "FIT":
            raise ValueError(f"{self.role} rows must not be fitted")
        return self.df

    def to_choose(self) -> DataFrame:
        if self.role not in ("VALID", "HOLDOUT"):
            raise ValueError(f"{self.role} rows must not choose a model")
        return self.df


class Holdouts:
    """Contents that were used to confirm a model before; each may be used once."""

    def __init__(self, spent: set[str] | None = None) -> None:
        self.spent = set(spent or ())

    def spend(self, rows: Rows, content: str) -> DataFrame:
        if content in self.spent:
            raise ValueError("this holdout was used before")
        self.spent.add(content)
        return rows.to_choose()


def final_test(spark: SparkSession, path: str, plan: dict[str, Any], test: Rows, classify: Callable[[DataFrame], DataFrame], label: str) -> dict[str, Any]:
    """Accuracy on TEST rows, counted once: later calls with the plan return the saved receipt unread."""
    if test.role != "TEST":
        raise ValueError("only TEST rows are a final test")
    try:
        return storage.load(spark, path, plan)[1]["result"]
    except AnalysisException:
        pass
    counts = classify(test.df).agg(F.count("*").alias("rows"), F.count_if(F.col("class") != F.col(label)).alias("errors"))
    row = counts.first()
    result = {"rows": row["rows"], "errors": row["errors"]}
    storage.save(spark.createDataFrame([(row["rows"], row["errors"])], "rows long, errors long"), path, plan, result=result)
    return result
