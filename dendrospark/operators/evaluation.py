"""Counts that decide between models, folds and blocks of rows, and audits of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut
from .ordered import running_least, sliding
from .regions import meet

FEW = 64  #: leaves of a tree whose boxes are all compared


def accuracy_by_role(scored: DataFrame, label: str = "label", predicted: str = "class", role: str = "role") -> DataFrame:
    """(role, rows, errors, accuracy)."""
    wrong = F.count_if(F.col(label) != F.col(predicted))
    return scored.groupBy(role).agg(F.count("*").alias("rows"), wrong.alias("errors"), ((F.count("*") - wrong) / F.count("*")).alias("accuracy"))


def confusion(scored: DataFrame, classes: int, label: str = "label", predicted: str = "class", most_cells: int = 1 << 20) -> DataFrame:
    """(label, predicted, rows) for every pair of classes, zeros included."""
    if classes * classes > most_cells:
        raise ValueError("the confusion matrix has too many cells")
    spark = scored.sparkSession
    every = spark.range(classes * classes).select(F.floor(F.col("id") / classes).cast("int").alias("label"), (F.col("id") % classes).cast("int").alias("predicted"))
    seen = scored.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return every.join(F.broadcast(seen), ["label", "predicted"], "left").select("label", "predicted", F.coalesce("n", F.lit(0)).alias("rows"))


def mismatches(left: DataFrame, right: DataFrame, id_col: str, column: str = "class") -> DataFrame:
    """(id, expected, actual) of rows whose classes differ, or that only one side has."""
    a = left.select(id_col, F.col(column).alias("expected"))
    b = right.select(id_col, F.col(column).alias("actual"))
    return a.join(b, id_col, "full").where(~F.col("expected").eqNullSafe(F.col("actual")))


def gate(scored: DataFrame, candidate: str, baseline: str, label: str = "label") -> DataFrame:
    """One row: both models' errors, and whether the candidate has strictly fewer."""
    a, b = F.count_if(F.col(candidate) != F.col(label)), F.count_if(F.col(baseline) != F.col(label))
    return scored.agg(F.count("*").alias("rows"), a.alias("candidate_errors"), b.alias("baseline_errors"), (a < b).alias("accepted"))


def fold_of(row: Column, folds: int, seed: int) -> Column:
    """A row's fold, by its dense ordinal, rotated by the seed."""
    return F.pmod(F.pmod(row, F.lit(folds)) + seed % folds, F.lit(folds)).cast("int")


def block_of(row: Column, rows: int, blocks: int) -> Column:
    """The block of a row when ``rows`` are cut into contiguous blocks, larger ones first."""
    if not 1 <= blocks <= rows:
        raise ValueError("there must be a row for every block")
    size, extra = divmod(rows, blocks)
    edge = extra * (size + 1)
    return F.when(row < edge, F.floor(row / (size + 1))).otherwise(extra + F.floor((row - edge) / size)).cast("int")


def stated_block_of(row: Column, sizes: list[int], rows: int) -> Column:
    """The block of a row by stated sizes, which must be positive and add up to ``rows``."""
    if any(s < 1 for s in sizes) or sum(sizes) != rows:
        raise ValueError("block sizes must be positive and add up")
    out, end = F.lit(len(sizes) - 1), rows
    for k in range(len(sizes) - 1, 0, -1):
        end -= sizes[k]
        out = F.when(row < end, F.lit(k - 1)).otherwise(out)
    return out.cast("int")


def gates_by_block(scored: DataFrame, block: Column, candidate: str, baseline: str, label: str = "label") -> DataFrame:
    """(level, offset, rows, candidate_errors, baseline_errors, accepted) up to the first refusal.

    A block counts only while all before it were passed; a tie is a refusal.
    """
    a, b = F.count_if(F.col(candidate) != F.col(label)), F.count_if(F.col(baseline) != F.col(label))
    per = scored.groupBy(block.alias("level")).agg(F.count("*").alias("rows"), a.alias("candidate_errors"), b.alias("baseline_errors"))
    order = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("accepted", F.col("candidate_errors") < F.col("baseline_errors"))
    per = per.withColumn("offset", F.coalesce(F.sum("rows").over(order), F.lit(0))).withColumn("open", F.coalesce(F.min(F.col("accepted").cast("int")).over(order), F.lit(1)))
    return per.where("open = 1").select("level", "offset", "rows", "candidate_errors", "baseline_errors", "accepted")


def incumbents(candidates: DataFrame) -> DataFrame:
    """(ord, errors, bytes, best_ord, became_incumbent): the best so far by errors, size and order."""
    best = running_least(candidates, "ord", F.struct("errors", "bytes", "ord"))
    return best.select("ord", "errors", "bytes", F.col("_least.ord").alias("best_ord"), (F.col("_least.ord") == F.col("ord")).alias("became_incumbent"))


def winner(candidates: DataFrame) -> DataFrame:
    """The candidate with the fewest errors, then bytes, then the first."""
    return candidates.orderBy("errors", "bytes", "ord").limit(1)


def coverage_audit(responses: DataFrame, rows: DataFrame, teachers: int, classes: int, tolerance: float = 1e-3) -> DataFrame:
    """(row_id, teacher, problem) of responses that are missing, repeated or no probabilities.

    ``responses`` has (row_id, teacher, class, p); every row needs every teacher once.
    """
    per = responses.groupBy("row_id", "teacher").agg(F.count("*").alias("n"), F.countDistinct("class").alias("k"), F.sum("p").alias("total"), F.min("p").alias("low"), F.max("p").alias("high"))
    expected = rows.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(teachers - 1))).alias("teacher"))
    both = expected.join(per, ["row_id", "teacher"], "full")
    sound = (F.col("n") == classes) & (F.col("k") == classes) & (F.col("low") >= 0) & (F.col("high") <= 1) & (F.abs(F.col("total") - 1) <= tolerance)
    kind = F.when(F.col("n").isNull(), "missing").when(F.col("n") != classes, "repeated").when(~F.coalesce(sound, F.lit(False)), "not a distribution")
    known = rows.select(F.col("row_id"), F.lit(1).alias("known"))
    extra = per.join(known, "row_id", "left_anti").select("row_id", "teacher", F.lit("unknown row").alias("problem"))
    return both.join(known, "row_id").select("row_id", "teacher", kind.alias("problem")).where("problem IS NOT NULL").unionByName(extra)


def throughput(progress: DataFrame, steps: int = 4) -> DataFrame:
    """``progress`` (step, work, seconds; steps differ) with the rate over the last ``steps`` steps."""
    w = Window.partitionBy("_chunk").orderBy("_place").rowsBetween(1 - steps, 0)
    rated = sliding(progress, "step", steps).withColumn("rate", F.sum("work").over(w) / F.sum("seconds").over(w))
    return rated.where("NOT _copy").drop("_place", "_chunk", "_copy")


def tree_conflicts(boxes: DataFrame) -> DataFrame:
    """(tree, a, b): pairs of leaf boxes of one tree that overlap on every axis; none in a partition.

    ``boxes`` has (tree, leaf, lo, hi) with arrays of first and last bin by feature.  Trees of up to ``FEW`` leaves
    compare all of them.  Boxes of larger trees meet on the axis on which they begin at most places, so those apart
    there are never compared.
    """
    begins = boxes.select(F.posexplode("lo").alias("axis", "at")).groupBy("axis").agg(F.count_distinct("at").alias("n"))
    best = begins.orderBy(F.desc("n"), "axis").first()
    sizes = boxes.groupBy("tree").agg((F.count("*") <= FEW).alias("few"))
    own = cut(boxes.join(sizes, "tree").select("tree", "leaf", "lo", "hi", F.transform("lo", lambda x: F.lit(0)).alias("sides"), "few"), "boxes")
    met = meet(own, own, ["tree"], best["axis"] if best else 0, F.col("few"))
    return met.where("leaf < _leaf").select("tree", F.col("leaf").alias("a"), F.col("_leaf").alias("b"))
