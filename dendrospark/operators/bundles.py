"""Bundles: a study's chosen models, in one table with a manifest, checked when they are read.

A bundle holds the trees of its teachers and, for a combination, of a meta model over the teachers'
probabilities.  Its identity is the content of that table; a teacher used twice is stored once.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fp32 import first_winner
from ..functions.models import TREES
from ..plans import storage
from . import evaluation, scoring, study

META = "meta"


@dataclass
class Bundle:
    """Teachers in their order, with repeats, and the meta model; a single teacher has none."""

    features: list[str]
    classes: int
    teachers: list[str]
    models: dict[str, tuple[DataFrame, list[float]]]

    def identity(self) -> dict[str, Any]:
        return {"features": self.features, "classes": self.classes, "teachers": self.teachers, "bias": {k: [float(b) for b in bias] for k, (_, bias) in self.models.items()}}


def save(bundle: Bundle, path: str) -> None:
    """Writes the bundle to a folder that must not exist yet."""
    missing = set(bundle.teachers) - set(bundle.models)
    if missing or not bundle.teachers or (len(bundle.teachers) > 1) != (META in bundle.models):
        raise ValueError("every teacher needs a model, and several need a meta model")
    table = None
    for name, (trees, _) in bundle.models.items():
        own = trees.select(F.lit(name).alias("model"), *(x.split()[0] for x in TREES.split(", ")))
        table = own if table is None else table.unionByName(own)
    storage.save(table, path, {"bundle": bundle.identity()}, content=storage.content_id(table))


def load(spark: SparkSession, path: str) -> Bundle:
    """A saved bundle; content other than was written, or trees that are not sound, are errors."""
    table, manifest = storage.load(spark, path)
    facts = manifest["plan"]["bundle"]
    if storage.content_id(table) != manifest["content"]:
        raise ValueError("the bundle is not as it was written")
    named = {r["model"] for r in table.select("model").distinct().collect()}
    if named != set(facts["bias"]) or not set(facts["teachers"]) <= named:
        raise ValueError("the bundle's models are not those it declares")
    classes, width = facts["classes"], len(facts["features"])
    inputs = F.when(F.col("model") == META, len(facts["teachers"]) * classes).otherwise(width)
    split = F.col("feature") >= 0
    fine = F.when(split, (F.col("feature") < inputs) & (F.col("left") > F.col("node")) & (F.col("right") > F.col("node")) & ~F.isnan("cut")).otherwise(F.col("value").isNotNull() & (F.abs("value") < float("inf")))
    if not table.where(~F.coalesce(fine, F.lit(False)) | (F.col("channel") < 0) | (F.col("channel") >= classes)).isEmpty():
        raise ValueError("a node of the bundle is not sound")
    if any(len(b) != classes for b in facts["bias"].values()):
        raise ValueError("the bundle's bias differs from its classes")
    return Bundle(facts["features"], classes, facts["teachers"], {k: (table.where(F.col("model") == k).drop("model"), b) for k, b in facts["bias"].items()})


def classify(bundle: Bundle, rows: DataFrame, id_col: str, name: str = "class") -> DataFrame:
    """``rows`` with the bundle's class.  Distinct teachers are scored once, however often they are used."""
    if len(bundle.teachers) == 1:
        trees, bias = bundle.models[bundle.teachers[0]]
        return scoring.classify(rows, trees, bundle.features, bias, name=name)
    answers = None
    for i, teacher in enumerate(dict.fromkeys(bundle.teachers)):
        trees, bias = bundle.models[teacher]
        uses = F.array(*(F.lit(t) for t, x in enumerate(bundle.teachers) if x == teacher))
        own = study.respond(rows, trees, bundle.features, bias, i, id_col).withColumn("teacher", F.explode(uses))
        answers = own if answers is None else answers.unionByName(own)
    wide, names = study.widen(answers, len(bundle.teachers), bundle.classes)
    trees, bias = bundle.models[META]
    judged = scoring.margins(wide, trees, names, bias).select(F.col("row_id").alias("_row"), first_winner(F.col("margins")).alias(name))
    return rows.join(judged, F.col(id_col) == F.col("_row")).drop("_row")


def evaluate(bundle: Bundle, rows: DataFrame, label: str, role: str, id_col: str) -> DataFrame:
    """(role, rows, errors, accuracy) of the bundle on labelled rows of each role."""
    return evaluation.accuracy_by_role(classify(bundle, rows, id_col), label, "class", role)


def retained(bundle: Bundle, valid: DataFrame, label: str, errors: int, id_col: str) -> DataFrame:
    """The baseline of a new study: a bundle of an earlier one, which must make the errors it made then."""
    scored = classify(bundle, valid, id_col)
    found = study.errors_of(scored, label, "class")
    if found != errors:
        raise ValueError(f"the retained bundle makes {found} errors, not {errors}")
    return scored


def fork(responses: DataFrame, donor: DataFrame, own: DataFrame, winner: list[str]) -> DataFrame:
    """Responses of a finished study that a new one takes over; a new study that cannot name the donor's winner is refused.

    ``donor`` and ``own`` have (teacher, declaration), ``winner`` the declarations of its teachers.
    """
    kept = {r["declaration"] for r in own.where(F.col("declaration").isin(winner)).select("declaration").distinct().collect()}
    if kept != set(winner):
        raise ValueError("the new study would lose the donor's winner")
    return study.import_columns(responses, donor, own)
