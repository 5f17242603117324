"""Boosted-tree models in their JSON form, as tables of tree nodes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fp32 import bits

TREE = "struct<id:int,tree_param:struct<num_nodes:string,size_leaf_vector:string>,categories:array<int>,split_type:array<int>,left_children:array<int>,right_children:array<int>,split_indices:array<int>,split_conditions:array<float>,default_left:array<string>>"
MODEL = f"version array<int>, learner struct<learner_model_param:struct<num_feature:string,num_class:string,num_target:string,base_score:string>,objective:struct<name:string>,gradient_booster:struct<name:string,model:struct<gbtree_model_param:struct<num_trees:string>,tree_info:array<int>,iteration_indptr:array<int>,trees:array<{TREE}>>>>"
VERSION = [3, 4, 1]  #: the model format that is read (fixed value)


def read_booster(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Any]]:
    """(trees, facts) of one model file; facts are features, classes, bias, objective, trees.

    Only scalar numeric gbtree models with a class objective are read.  Every node array must have
    the declared length, children must come after their parent, be two different nodes and be
    reached once; cuts must not be NaN and leaf values must be finite.
    """
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json("value", MODEL, {"mode": "FAILFAST", "allowNonNumericNumbers": "true"}).alias("d")).select("d.*")
    head = doc.select("version", "learner.learner_model_param.*", F.col("learner.objective.name").alias("objective"), F.col("learner.gradient_booster.name").alias("booster"), F.col("learner.gradient_booster.model.gbtree_model_param.num_trees").alias("num_trees"), F.size("learner.gradient_booster.model.trees").alias("stored"), F.col("learner.gradient_booster.model.tree_info").alias("channels"), F.col("learner.gradient_booster.model.iteration_indptr").alias("turns")).first()

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"model: {what}")

    number = lambda v: int(v) if v is not None and v.isdigit() else -1
    features, classes, count = number(head["num_feature"]), number(head["num_class"]), number(head["num_trees"])
    need(head["version"] == VERSION, "another format version")
    need(head["booster"] == "gbtree" and head["objective"] in ("multi:softprob", "multi:softmax"), "no scalar class model")
    need(features >= 1 and 2 <= classes <= 1024, "extents out of range")
    need(head["num_target"] in (None, "1"), "several targets")
    need(count == head["stored"] == len(head["channels"]) > 0, "tree count differs")
    need(all(0 <= c < classes for c in head["channels"]), "tree channel out of range")
    turns = head["turns"] or []
    need(len(turns) >= 2 and turns[0] == 0 and turns[-1] == count and turns == sorted(turns), "round offsets do not cover the trees")
    bias = [float(v) for v in (head["base_score"] or "").strip("[] ").split(",") if v.strip()]
    bias = bias * classes if len(bias) == 1 else bias
    need(len(bias) == classes and all(abs(b) < float("inf") for b in bias), "bias differs")

    trees = doc.select(F.posexplode("learner.gradient_booster.model.trees").alias("tree", "t"), F.col("learner.gradient_booster.model.tree_info").alias("channels"))
    n = F.size("t.left_children")
    arrays = ("right_children", "split_indices", "split_conditions", "default_left", "split_type")
    sound = (F.col("t.id") == F.col("tree")) & (n > 0) & (n == F.col("t.tree_param.num_nodes").cast("int")) & F.col("t.tree_param.size_leaf_vector").isin("0", "1") & (F.size("t.categories") == 0) & F.forall("t.split_type", lambda s: s == 0)
    for a in arrays:
        sound = sound & (F.size(f"t.{a}") == n)
    need(trees.where(~F.coalesce(sound, F.lit(False))).isEmpty(), "a tree's arrays are not sound")
    zipped = F.arrays_zip(*(F.col(f"t.{a}").alias(a) for a in ("left_children", "right_children", "split_indices", "split_conditions", "default_left")))
    flat = trees.select("tree", F.get("channels", F.col("tree")).alias("channel"), n.alias("n"), F.posexplode(zipped).alias("node", "x"))
    inner = F.col("x.left_children") >= 0
    side = F.col("x.default_left").isin("true", "1")
    rows = flat.select(
        "tree", "channel", "node", F.when(inner, F.col("x.split_indices")).otherwise(-1).alias("feature"), F.when(inner, F.col("x.split_conditions")).alias("cut"),
        F.when(inner, bits(F.coalesce("x.split_conditions", F.lit(0.0)))).alias("cut_bits"), F.when(inner, side).alias("default_left"),
        F.when(inner, F.col("x.left_children")).otherwise(-1).alias("left"), F.when(inner, F.col("x.right_children")).otherwise(-1).alias("right"), F.when(~inner, F.col("x.split_conditions")).alias("value"), "n",
    )
    split = F.col("feature") >= 0
    ordered = (F.col("left") > F.col("node")) & (F.col("right") > F.col("node")) & (F.col("left") != F.col("right")) & (F.col("left") < F.col("n")) & (F.col("right") < F.col("n")) & (F.col("feature") < features) & ~F.isnan("cut")
    fine = F.when(split, ordered).otherwise((F.col("feature") == -1) & (F.abs("value") < float("inf")) & ~F.isnan("value"))
    need(rows.where(~F.coalesce(fine, F.lit(False))).isEmpty(), "a node is not sound")
    reached = rows.where(split).select("tree", F.explode(F.array("left", "right")).alias("node")).groupBy("tree", "node").count()
    stray = rows.where("node > 0").select("tree", "node").join(reached.where("count = 1"), ["tree", "node"], "left_anti")
    need(stray.isEmpty() and reached.where("count > 1").isEmpty(), "a node is reached twice or never")
    facts = {"features": features, "classes": classes, "bias": bias, "objective": head["objective"], "trees": count}
    return rows.drop("n"), facts
