"""Exact-size splits and folds whose result depends on ids and the seed, never on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrad.operators.ranking import rank_in_groups


def order_key(seed: int, epoch: int | None = None, id_col: str = "id") -> Column:
    """The shuffle order: md5 of id, seed and, for an epoch's own order, its number."""
    tail = f":{seed}" if epoch is None else f":{seed}:{epoch}"
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(tail)))


def rank_digits(n: int) -> int:
    """Hex digits of a key that cut ``n`` rows into buckets of about a million rows at most, and at least a few."""
    return max(1, math.ceil(math.log(max(n, 1) / 1_000_000, 16)))


def _ranked(df: DataFrame, keys: list[str], seed: int, id_col: str, n: int) -> DataFrame:
    """Buckets are the first hex digits, as many as give about a million rows a bucket of a group of ``n`` rows.

    They lead the order, so ranks equal a plain row_number whatever their number.
    """
    keyed = df.withColumn("_lg_key", order_key(seed, id_col=id_col))
    return rank_in_groups(keyed, keys, F.substring("_lg_key", 1, max(3, rank_digits(n))), [F.col("_lg_key"), F.col(id_col)], "_lg_rank").drop("_lg_key")


#: Rows with a common prefix that are few enough to be read, and counts that a pass returns at most, about.
FEW_ROWS, COUNTS = 1000, 1 << 18
#: Strata whose borders the driver looks for; more are ranked.
STRATA = 10_000


def _borders(keyed: DataFrame, wanted: dict[int, int], largest: int) -> dict[int, tuple[str, object]]:
    """stratum -> (key, id) of its k-th row in the order of (key, id); ``keyed`` has stratum, key and id.

    ``largest``: rows of the largest stratum.

    Counts of leading hex digits tell which rows begin like the wanted one, and the next pass tells those
    apart, until they are few. Only counts and these few rows reach the driver. Rows that share an id stay
    together: if the border lies among them, the id is None and they are above it.
    """
    spark, found, rest, known = keyed.sparkSession, {}, {s: ("", k) for s, k in wanted.items()}, 0
    few: dict[int, tuple[str, int]] = {}
    while rest:
        digits = max(1, min(4, math.ceil(math.log(largest / max(FEW_ROWS, 1), 16)), math.floor(math.log(COUNTS / len(rest), 16))))
        open_ones = spark.createDataFrame([(s, p) for s, (p, _) in rest.items()], "s int, prefix string")
        inside = keyed.join(F.broadcast(open_ones), F.col("stratum") == F.col("s")).filter(F.startswith("key", "prefix"))
        part = F.substring("key", known + 1, digits).alias("part")
        parts: dict[int, list] = {}
        for r in inside.groupBy("stratum", part).agg(F.count(F.lit(1)).alias("n")).collect():
            parts.setdefault(r["stratum"], []).append((r["part"], r["n"]))
        known, largest = known + digits, 1
        for s, (prefix, k) in list(rest.items()):
            for part, n in sorted(parts[s]):
                if k <= n:
                    break
                k -= n
            rest[s] = (prefix + part, k)
            if n <= FEW_ROWS:
                few[s] = rest.pop(s)
            elif known >= 32:  # one key, so one id
                found[s] = (rest.pop(s)[0], None)
            else:
                largest = max(largest, n)
    if few:
        last = spark.createDataFrame([(s, p) for s, (p, _) in few.items()], "s int, prefix string")
        rows: dict[int, list] = {}
        for r in keyed.join(F.broadcast(last), F.col("stratum") == F.col("s")).filter(F.startswith("key", "prefix")).select("stratum", "key", "id").collect():
            rows.setdefault(r["stratum"], []).append((r["key"], r["id"]))
        for s, (_, k) in few.items():
            mine = sorted(rows[s], key=lambda r: (r[0], r[1] is not None, r[1]))
            key, row_id = mine[k - 1]
            found[s] = (key, None if k < len(mine) and mine[k] == mine[k - 1] else row_id)
    return found


def _check_ratio(ratio: float) -> float:
    if not math.isfinite(ratio) or not 0.0 < ratio < 1.0:
        raise ValueError("the training ratio must lie between 0 and 1, both excluded")
    return float(ratio)


def train_test_split(df: DataFrame, training_ratio: float = 0.8, seed: int = 42, id_col: str = "id") -> DataFrame:
    """``df`` with ``split``: exactly floor(n * ratio) rows are 'train', the others 'test'.

    Rows are taken in the order of (md5(id:seed), id); a null id comes first. The last training row is found
    by counts over ids, so rows aren't moved. An empty table or an empty side is an error. Ids should be
    unique: rows that share one stay together, in the test rows if the border lies among them.
    """
    ratio = _check_ratio(training_ratio)
    n = df.count()
    n_train = math.floor(n * ratio)
    if not 0 < n_train < n:
        raise ValueError(f"{n} rows cannot be split at {ratio}: a side is empty")
    key = F.coalesce(order_key(seed, id_col=id_col), F.lit(""))
    border = _borders(df.select(F.lit(0).alias("stratum"), key.alias("key"), F.col(id_col).alias("id")), {0: n_train}, n)[0]
    return df.withColumn("split", _side(key, F.col(id_col), *(F.lit(v) for v in border)))


def _side(key: Column, row_id: Column, border_key: Column, border_id: Column) -> Column:
    """'train' up to the border, 'test' above it. A null id has the empty key, which sorts first."""
    at_border = (key == border_key) & F.coalesce(row_id <= border_id, F.lit(False))
    return F.when((key < border_key) | at_border, "train").otherwise("test")


def _strata(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(F.col(target).alias("_lg_target")).agg(F.count(F.lit(1)).alias("_lg_n"))


def stratified_split(df: DataFrame, training_ratio: float = 0.8, seed: int = 42, id_col: str = "id", target: str = "target") -> DataFrame:
    """As :func:`train_test_split` inside each distinct target. A stratum with an empty side is an error.

    The borders of up to STRATA strata are found by counts and broadcast; with more strata rows are ranked.
    """
    ratio = _check_ratio(training_ratio)
    size = F.floor(F.col("_lg_n").cast("double") * F.lit(ratio))
    strata = _strata(df, target).withColumn("_lg_train", size)
    facts = strata.agg(F.count(F.lit(1)), F.count_if((F.col("_lg_train") < 1) | (F.col("_lg_train") >= F.col("_lg_n"))), F.max("_lg_n")).first()
    if not facts[0] or facts[1]:
        raise ValueError(f"{facts[1]} of {facts[0]} strata would have an empty side")
    if facts[0] > STRATA:
        joined = _ranked(df, [target], seed, id_col, facts[2]).join(strata, F.col(target).eqNullSafe(F.col("_lg_target")))
        split = F.when(F.col("_lg_rank") < F.col("_lg_train"), "train").otherwise("test")
        return joined.withColumn("split", split).drop("_lg_rank", "_lg_target", "_lg_n", "_lg_train")
    spark, kinds = df.sparkSession, {f.name: f.dataType.simpleString() for f in df.schema.fields}
    found = [(i, r["_lg_target"], r["_lg_train"]) for i, r in enumerate(strata.collect())]
    numbered = F.broadcast(spark.createDataFrame([(i, t) for i, t, _ in found], f"stratum int, _lg_target {kinds[target]}"))
    key = F.coalesce(order_key(seed, id_col=id_col), F.lit(""))
    keyed = df.select(F.col(target).alias("_lg_of"), key.alias("key"), F.col(id_col).alias("id")).join(numbered, F.col("_lg_of").eqNullSafe(F.col("_lg_target")))
    borders = _borders(keyed.select("stratum", "key", "id"), {i: k for i, _, k in found}, facts[2])
    table = spark.createDataFrame(
        [(t, *borders[i]) for i, t, _ in found], f"_lg_target {kinds[target]}, _lg_key string, _lg_id {kinds[id_col]}"
    )
    joined = df.join(F.broadcast(table), F.col(target).eqNullSafe(F.col("_lg_target")))
    return joined.withColumn("split", _side(key, F.col(id_col), F.col("_lg_key"), F.col("_lg_id"))).drop("_lg_target", "_lg_key", "_lg_id")


def stratified_kfold(df: DataFrame, folds: int = 5, seed: int = 42, id_col: str = "id", target: str = "target") -> DataFrame:
    """``df`` with ``fold``: rows are dealt round-robin, strata in ascending order, each in shuffled order.

    The deal goes on from one stratum to the next, so fold = (rows in lower strata + rank) mod folds.
    Fewer than two folds, an empty table or a stratum smaller than ``folds`` is an error.
    """
    if folds < 2:
        raise ValueError("at least two folds are needed")
    strata = _strata(df, target)
    facts = strata.agg(F.count(F.lit(1)), F.min("_lg_n"), F.max("_lg_n")).first()
    if not facts[0] or facts[1] < folds:
        raise ValueError(f"every stratum needs at least {folds} rows")
    lower = Window.orderBy("_lg_target").rowsBetween(Window.unboundedPreceding, -1)  # one row per stratum
    offsets = strata.select("_lg_target", F.coalesce(F.sum("_lg_n").over(lower), F.lit(0)).alias("_lg_lower"))
    joined = _ranked(df, [target], seed, id_col, facts[2]).join(offsets, F.col(target).eqNullSafe(F.col("_lg_target")))
    fold = F.pmod(F.col("_lg_lower") + F.col("_lg_rank"), F.lit(folds)).cast("int")
    return joined.withColumn("fold", fold).drop("_lg_rank", "_lg_target", "_lg_lower")


def train_of(df: DataFrame, fold: int) -> DataFrame:
    """Training rows when ``fold`` is held out."""
    return df.filter(F.col("fold") != fold)


def test_of(df: DataFrame, fold: int) -> DataFrame:
    return df.filter(F.col("fold") == fold)


def training_views(df: DataFrame, folds: int) -> DataFrame:
    """Each row once per fold that trains on it, marked ``eval_fold``: folds - 1 copies of the rows."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    return df.withColumn("eval_fold", F.explode(others))
