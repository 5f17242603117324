"""Feature tables from CSV, JSON rows and dense binary files, checked on the way in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fp32 import or_missing, parse_feature
from ..plans.storage import identity, load, save


def read_csv(spark: SparkSession, path: str, target: str | int | None = None, header: str = "auto") -> tuple[DataFrame, list[str]]:
    """(rows, features): float features, and ``label_text`` if a target is named, by name, position or ``last``.

    Quoted fields may hold separators, line breaks and doubled quotes.  Ragged rows are an error,
    and so is a feature that is neither a finite decimal nor a missing word.  With ``auto`` the
    first row is a header if the target names it or one of its features is not a number.
    """
    options = {"multiLine": True, "quote": '"', "escape": '"', "mode": "FAILFAST", "header": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw = spark.read.options(**options).csv(path)
    columns = raw.columns
    top = raw.first()
    if top is None:
        raise ValueError("the file has no records")
    first = [None if v is None else v.strip() for v in top]
    at = None
    named = isinstance(target, str) and target != "last"
    if named and target in first:
        at = first.index(target)
    elif target == "last":
        at = len(columns) - 1
    elif isinstance(target, int) or (named and str(target).isdigit()):
        at = int(target)
    if target is not None and (at is None or not 0 <= at < len(columns)):
        raise ValueError("the target must be a column name, a position or last")
    by_name = named and target in first
    if header not in ("auto", "yes", "no") or (header == "no" and by_name):
        raise ValueError("header must be auto, yes or no, and a named target needs a header")
    features = [i for i in range(len(columns)) if i != at]
    probe = spark.createDataFrame([tuple(v if v is not None else "" for v in first)], ", ".join(f"`{c}` string" for c in columns))
    numeric = probe.select(*(parse_feature(F.col(columns[i])).isNotNull().alias(str(i)) for i in features)).first()
    has_header = header == "yes" or by_name or (header == "auto" and not all(numeric))
    names = [first[i] if has_header else f"feature_{i}" for i in features]
    body = raw
    if has_header:
        # the header is the first record of the first file, told apart by its text
        same = [F.trim(F.col(c)).eqNullSafe(F.lit(v)) for c, v in zip(columns, first, strict=True)]
        is_top = same[0]
        for s in same[1:]:
            is_top = is_top & s
        body = raw.where(~is_top)
    out = []
    for name, i in zip(names, features, strict=True):
        text = F.coalesce(F.col(columns[i]), F.lit(""))
        value = parse_feature(text)
        out.append(F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"column {i + 1}: no finite number: "), text)).cast("float")).otherwise(value).alias(name))
    if at is not None:
        label = F.trim(F.coalesce(F.col(columns[at]), F.lit("")))
        out.append(F.when(label == "", F.raise_error(F.lit("empty target")).cast("string")).otherwise(label).alias("label_text"))
    return body.select(*out), names


def first_seen_labels(rows: DataFrame, label: str, order: str) -> DataFrame:
    """(label, class): classes count up in the order in which labels first appear."""
    first = rows.groupBy(F.col(label).alias("label")).agg(F.min(order).alias("at"))
    return first.select("label", (F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("class"))


def apply_labels(rows: DataFrame, label: str, mapping: DataFrame, out: str = "label") -> DataFrame:
    """``rows`` with the class of their label; unknown labels and repeated map entries are errors."""
    if not mapping.groupBy("label").count().where("count > 1").isEmpty():
        raise ValueError("a label is mapped twice")
    side = mapping.select(F.col("label").alias("_label"), F.col("class").alias("_class"))
    joined = rows.join(side, F.col(label) == F.col("_label"), "left")
    known = F.when(F.col("_class").isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(label), F.lit("null")))).cast("int")).otherwise(F.col("_class"))
    return joined.select(*(c for c in rows.columns if c != out), known.alias(out))


def read_json_rows(spark: SparkSession, path: str, features: int) -> DataFrame:
    """(row, x0, x1, ...) of documents {"rows": [[...], ...]}; null is missing, widths are checked."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", "rows array<array<float>>", {"mode": "FAILFAST"}).alias("d"))
    rows = parsed.select(F.posexplode("d.rows").alias("row", "x"))
    wide = F.when(F.size("x") != features, F.raise_error(F.lit("a row has another width")).cast("array<float>")).otherwise(F.col("x"))
    return rows.select("row", wide.alias("x")).select("row", *(or_missing(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(features)))


def read_dense(spark: SparkSession, path: str, rows: int, features: int, stride: int | None = None, sha256: str | None = None) -> DataFrame:
    """(row_id, x0, ...) of little-endian FP32 rows with ``stride`` words; extent and hash are checked.

    Files are binary blobs; a dataset of many files has its rows in the order of their names.
    """
    stride = stride or features
    if stride < features:
        raise ValueError("the stride is shorter than a row")
    blobs = spark.read.format("binaryFile").load(path)
    facts = blobs.agg(F.sum("length").alias("bytes"), F.count("*").alias("files"), F.max(F.sha2("content", 256)).alias("sha")).first()
    if facts["bytes"] != rows * stride * 4:
        raise ValueError("the file has another extent")
    if sha256 is not None and (facts["files"] != 1 or facts["sha"] != sha256):
        raise ValueError("the file has another hash")
    starts = blobs.select("path", (F.col("length") / (4 * stride)).cast("long").alias("n")).withColumn("start", F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)))
    joined = blobs.select("path", "content").join(starts.select("path", F.coalesce("start", F.lit(0)).alias("start")), "path")
    names = [f"x{i}" for i in range(features)]

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start, content in zip(part["start"], part["content"], strict=True):
                x = np.frombuffer(content, "<f4").reshape(-1, stride)[:, :features]
                for at in range(0, len(x), 65_536):
                    out = pd.DataFrame(x[at : at + 65_536], columns=names)
                    out.insert(0, "row_id", np.arange(start + at, start + at + len(out)))
                    yield out

    return joined.mapInPandas(spread, "row_id long, " + ", ".join(f"{n} float" for n in names))


def read_images(spark: SparkSession, path: str, rows: int, size: int, multiplier: int = 17, offset: int = 1337) -> DataFrame:
    """(row_id, source_row, x0, ...) of byte images behind a 16-byte header, in a fixed permuted order.

    Row r of the result is image (multiplier * r + offset) mod rows of the file.
    """
    blobs = spark.read.format("binaryFile").load(path).select("content")
    names = [f"x{i}" for i in range(size)]

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                head = np.frombuffer(content, ">u4", 4)
                if head[0] != 0x803 or head[1] != rows or head[2] * head[3] != size or len(content) != 16 + rows * size:
                    raise ValueError("not an image file of this extent")
                x = np.frombuffer(content, np.uint8, rows * size, 16).reshape(rows, size)
                for at in range(0, rows, 16_384):
                    own = np.arange(at, min(at + 16_384, rows))
                    source = (multiplier * own + offset) % rows
                    out = pd.DataFrame(x[source].astype(np.float32), columns=names)
                    out.insert(0, "source_row", source)
                    out.insert(0, "row_id", own)
                    yield out

    return blobs.mapInPandas(spread, "row_id long, source_row long, " + ", ".join(f"{n} float" for n in names))


def retained_csv(spark: SparkSession, path: str, folder: str, **options: str | int | None) -> tuple[DataFrame, list[str]]:
    """``read_csv`` kept as Parquet in ``folder`` under the files' contents and the options; equal input is parsed once."""
    files = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("sha")).orderBy("sha", "length").collect()
    plan = {"files": [[r["length"], r["sha"]] for r in files], "options": {k: v for k, v in sorted(options.items()) if v is not None}}
    kept = f"{folder.rstrip('/')}/{identity(plan)}"
    try:
        rows, manifest = load(spark, kept, plan)
    except AnalysisException:
        rows, names = read_csv(spark, path, **options)
        save(rows, kept, plan, features=names)
        rows, manifest = load(spark, kept, plan)
    return rows, manifest["features"]
