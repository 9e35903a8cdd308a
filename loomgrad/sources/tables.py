"""Strict reading of labelled CSV and writing of predictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomgrad.functions.vectors import is_finite
from loomgrad.operators.validate import check_threshold
from loomgrad.session import delete_path, materialise_with_release, path_exists

#: A number as the reader takes it: no suffixes, no names of infinities, no space around it.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _parsed(delimiter: str, n_columns: int, has_header: bool):
    """Lines (value, file, block, id) as (id, features, target, problem, file, block, line).

    A header is the first line of a file's first block, wherever the block is read. ``line`` is a bad line's text.
    """

    def problems(lines: pa.Array, values: pa.ListArray, numbers: pa.Array) -> np.ndarray:
        """Why each line is refused; '' if it isn't."""
        count = pc.list_value_length(values).to_numpy()
        owner = np.repeat(np.arange(len(lines)), count)
        odd, large = np.zeros(len(lines), dtype=bool), np.zeros(len(lines), dtype=bool)
        odd[owner[~pc.match_substring_regex(values.flatten(), NUMBER).to_numpy(zero_copy_only=False)]] = True
        large[owner[~np.isfinite(numbers)]] = True
        last = pc.equal(values.flatten(), "").to_numpy(zero_copy_only=False)[np.cumsum(count) - 1]
        blank = pc.equal(pc.utf8_trim_whitespace(lines), "").to_numpy(zero_copy_only=False)
        wrong = np.array([f"{k} values instead of {n_columns}" for k in count.tolist()], dtype=object) if (count != n_columns).any() else ""
        checks = [blank, last, count != n_columns, odd, large]
        reasons = ["a blank line", "a trailing delimiter or an empty last value", wrong, "a value that isn't a number", "a value out of range"]
        return np.select(checks, [np.broadcast_to(np.array(r, dtype=object), len(lines)) for r in reasons], "")

    def to_numbers(values: pa.Array) -> np.ndarray:
        good = pc.match_substring_regex(values, NUMBER)
        # The cast takes no sign '+'.
        return pc.if_else(good, pc.replace_substring_regex(values, r"^\+", ""), "0").cast(pa.float64()).to_numpy(zero_copy_only=False)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if has_header and batch.num_rows:
                places = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
                data = [not (now != then and now[1] == 0) for then, now in zip([before, *places], places, strict=False)]
                before = places[-1]
                batch = batch.filter(pa.array(data))
            if not batch.num_rows:
                continue
            lines = pc.replace_substring_regex(batch.column(0), r"\r$", "")
            values = pc.split_pattern(lines, delimiter)
            numbers = to_numbers(values.flatten())
            problem = problems(lines, values, numbers)
            good = problem == ""
            table = np.zeros((batch.num_rows, n_columns))
            if good.any():
                table[good] = numbers[np.repeat(good, pc.list_value_length(values).to_numpy())].reshape(-1, n_columns)
            features = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * (n_columns - 1), pa.int32()), pa.array(table[:, :-1].ravel()))
            bad = pa.array(~good)
            shown = pc.if_else(bad, pc.utf8_slice_codeunits(lines, 0, 80), None)
            columns = [batch.column(3), features, pa.array(table[:, -1]), pc.if_else(bad, pa.array(problem.tolist()), None), batch.column(1), batch.column(2), shown]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "features", "target", "problem", "file", "block", "line"])

    return parse


def read_labelled_csv(spark: SparkSession, path: str, delimiter: str = ",", has_header: bool = True) -> DataFrame:
    """id, features, target from delimited numbers; the last column is the target.

    Refused with ValueError, the line's number and text: no data rows, a header or data with fewer than two
    columns, blank lines, trailing delimiters, empty or non-numeric or non-finite values, lines with
    another number of values than the first. CRLF is fine; there is no quoting. ``id`` is a stable
    number of the line's place in the files, as read by this call's partitions.

    The files are read once: lines are parsed and checked on their way into a Parquet table, and what is wrong
    is counted along with that. Only then is the table returned; a refused one is deleted.
    """
    if len(delimiter) != 1 or delimiter in "\r\n":
        raise ValueError("the delimiter is one character")
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )
    head = lines.limit(2).collect()  # of the first partition only
    if not head:
        raise ValueError(f"{path} has no samples")
    first = head[-1] if has_header and head[-1]["file"] == head[0]["file"] else head[0]
    n_columns = first["value"].removesuffix("\r").count(delimiter) + 1
    if n_columns < 2:
        raise ValueError(f"{path}: at least one feature and a target are needed")
    parsed = lines.mapInArrow(
        _parsed(delimiter, n_columns, has_header), "id long, features array<double>, target double, problem string, file string, block long, line string"
    )
    seen = Observation()
    bad = F.when(F.col("problem").isNotNull(), F.struct("file", "block", "id", "problem", "line"))
    watched = parsed.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("problem").alias("bad"), F.min(bad).alias("first"))
    stored, release = materialise_with_release(watched.select("id", "features", "target"))
    if not seen.get["rows"] or seen.get["bad"]:
        release()
    if not seen.get["rows"]:
        raise ValueError(f"{path} has no samples")
    if seen.get["bad"]:
        first = seen.get["first"]
        before = (F.col("block") < first["block"]) | ((F.col("block") == first["block"]) & (F.col("id") <= first["id"]))
        number = lines.filter((F.col("file") == first["file"]) & before).count()
        raise ValueError(f"{first['file']}: {seen.get['bad']} bad lines; line {number} has {first['problem']}: {first['line']!r}")
    return stored


def regression_output(scored: DataFrame) -> DataFrame:
    """expected, predicted, error (predicted - expected)."""
    return scored.select(
        F.col("target").alias("expected"), F.col("prediction").alias("predicted"), (F.col("prediction") - F.col("target")).alias("error")
    )


def classification_output(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """expected, probability, predicted, correct; both classes are taken at ``threshold``, as 1 and 0."""
    t = F.lit(check_threshold(threshold))
    expected, predicted = F.col("target") >= t, F.col("probability") >= t
    return scored.select(
        expected.cast("int").alias("expected"),
        "probability",
        predicted.cast("int").alias("predicted"),
        (expected == predicted).cast("int").alias("correct"),
    )


_NOT_FINITE = "predictions and errors must be finite"


def _write(rows: DataFrame, checked: list[str], path: str, file_format: str) -> None:
    """One evaluation of ``rows``: a value that isn't finite fails the write, which then publishes nothing."""
    if file_format not in ("csv", "parquet"):
        raise ValueError(f"unknown format {file_format!r}")
    wrong = F.raise_error(F.lit(_NOT_FINITE))
    sure = rows.withColumns({c: F.when(is_finite(F.col(c)), F.col(c)).otherwise(wrong.cast("double")) for c in checked})
    seen = Observation()
    writer = sure.observe(seen, F.count(F.lit(1)).alias("rows")).write
    new = not path_exists(rows.sparkSession, path)
    try:
        writer.option("header", True).csv(path) if file_format == "csv" else writer.parquet(path)
    except Exception as failed:
        if new:
            delete_path(rows.sparkSession, path)
        if _NOT_FINITE in str(failed):
            raise ValueError(_NOT_FINITE) from failed
        raise
    if not seen.get["rows"]:
        delete_path(rows.sparkSession, path)
        raise ValueError("there is nothing to write")


def write_regression(scored: DataFrame, path: str, file_format: str = "csv") -> None:
    """A directory of part files with :func:`regression_output`; empty or non-finite output is an error."""
    _write(regression_output(scored), ["predicted", "error"], path, file_format)


def write_classification(scored: DataFrame, path: str, threshold: float = 0.5, file_format: str = "csv") -> None:
    _write(classification_output(scored, threshold), ["probability"], path, file_format)
