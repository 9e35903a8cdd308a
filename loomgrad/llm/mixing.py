"""Mixing to target weights: iterative proportional fitting of token marginals (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrad.llm.common import WHITE_SPACE_CLASS, fresh_name, read_table
from loomgrad.session import cut_lineage, materialise

MARGINS = ("source", "language", "topic")
NO_VALUE = "(none)"
#: Exponent of the observed token shares that makes the default targets: 1 keeps them, 0 evens them out.
TEMPERATURE = 0.7
SWEEPS = 8
#: Share of the tokens of a corpus that the pipeline's mixture keeps.
KEPT_SHARE = 0.6
SEED = 17
#: Cell tables up to this many rows are kept in one partition, so that sweeps need no exchange.
ONE_PARTITION_CELLS = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WHITE_SPACE_CLASS.replace("[", "[^") + "+")).cast("long")


def style_topic(text: Column) -> Column:
    """A topic from the layout of a text, for tables that have no topic column."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text.contains("|"), "tabular")
        .when(F.regexp_like(text, F.lit("[#$%&*]{3}")), "noisy")
        .when(text.contains("!!"), "loud")
        .otherwise("prose")
    )


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def _targets(cells: DataFrame, margin: str, wanted: Mapping[str, float] | None, temperature: float) -> DataFrame:
    """(margin, target): positive shares that sum to 1 over the values that hold tokens."""
    seen = cells.groupBy(margin).agg(F.sum("cell_tokens").alias("t")).filter("t > 0")
    if wanted is not None:
        listed = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in wanted.items()], f"{margin} string, v double")
        seen = seen.join(listed, margin).filter("v > 0")
    else:
        seen = seen.withColumn("v", F.pow(F.col("t").cast("double"), F.lit(float(temperature))))
    whole = seen.agg(F.sum("v")).first()[0] or 1.0
    return seen.select(margin, (F.col("v") / F.lit(float(whole))).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int, one_partition: bool) -> DataFrame:
    """``cells`` (one row per combination of margins, with ``w``) with ``w`` fitted to the target shares.

    Each sweep scales the cells of every source to its target, then of every language, then of every
    topic. A small table in one partition does all sweeps as windows of a single job. A large one
    aggregates the sums, joins them back and checkpoints each step, so no margin value, which may
    hold most cells, is gathered in a task.
    """
    for margin, target in targets.items():
        cells = cells.join(target.withColumnRenamed("target", f"target_{margin}"), margin, "left")
    if one_partition:
        cells = cut_lineage(cells.coalesce(1)).coalesce(1)
    for margin in [m for _ in range(sweeps) for m in targets]:
        if one_partition:
            cells = cells.withColumn("margin_sum", F.sum("w").over(Window.partitionBy(margin)))
        else:
            sums = cells.groupBy(margin).agg(F.sum("w").alias("margin_sum"))
            cells = cells.join(sums, margin)
        factor = F.when(F.col("margin_sum") > 0, F.coalesce(f"target_{margin}", F.lit(0.0)) / F.col("margin_sum")).otherwise(0.0)
        cells = cells.withColumn("w", F.col("w") * factor).drop("margin_sum")
        if not one_partition:
            cells = cut_lineage(cells)
    return cut_lineage(cells)


def capped_total(fitted: DataFrame, kept_share: float) -> float | None:
    """The c at which the cells' min(tokens, c * w) sum to that share of all tokens; None: every cell is whole.

    Cells that c fills are taken whole and c is solved for the others, until no further cell fills: c only
    grows, and each round is one aggregate.
    """
    wanted = kept_share * float(fitted.agg(F.sum("cell_tokens")).first()[0] or 0)
    c, n_full = 0.0, -1
    while True:
        full = F.col("cell_tokens") <= F.col("w") * F.lit(c)
        live = fitted.filter("w > 0 AND cell_tokens > 0")
        count, whole, rest = live.agg(F.count_if(full), F.sum(F.when(full, F.col("cell_tokens"))), F.sum(F.when(~full, F.col("w")))).first()
        if not rest:
            return None
        if count == n_full:
            return c
        c, n_full = max(c, (wanted - float(whole or 0)) / float(rest)), count


def cell_probabilities(
    rows: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    temperature: float = TEMPERATURE,
    sweeps: int = SWEEPS,
    kept_share: float | None = None,
) -> DataFrame:
    """One row per combination of source, language and topic: its tokens, fitted share and probability.

    ``rows`` has the margins (not null) and ``tokens``. ``targets`` gives weights per margin value;
    a margin that isn't given takes the observed token shares to the power ``temperature``. The
    probability of a cell is the largest total times its share over its tokens: the total at which
    no probability exceeds 1, so expected tokens meet the fitted shares exactly. Values without a
    positive weight, and cells without tokens, get probability 0.

    With ``kept_share`` the total is that share of all tokens instead, so that no rare cell can set it:
    cells that hold too little are taken whole, the others are scaled up, and ``unmet_tokens`` is what
    the fitted share of a cell would ask beyond its tokens.
    """
    cells = rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("cell_tokens"))
    cells = cut_lineage(cells)
    one_partition = cells.count() <= ONE_PARTITION_CELLS
    wanted = {m: _targets(cells, m, (targets or {}).get(m), temperature) for m in MARGINS}
    fitted = rake(cells.withColumn("w", F.col("cell_tokens").cast("double")), wanted, sweeps, one_partition)
    w_sum, least = fitted.agg(F.sum("w"), F.min(F.when(F.col("w") > 0, F.col("cell_tokens") / F.col("w")))).first()
    share = (F.col("w") / F.lit(float(w_sum or 1.0))).alias("share")
    if kept_share is not None:
        total = capped_total(fitted, kept_share)
        part = F.lit(1.0) if total is None else F.least(F.lit(1.0), F.col("w") * F.lit(total) / F.col("cell_tokens"))
        wanted = F.lit(kept_share * float(fitted.agg(F.sum("cell_tokens")).first()[0] or 0))
        return fitted.select(
            *MARGINS,
            "cell_tokens",
            share,
            F.when((F.col("w") > 0) & (F.col("cell_tokens") > 0), part).otherwise(0.0).alias("probability"),
            F.greatest(F.lit(0.0), share * wanted - F.col("cell_tokens")).alias("unmet_tokens"),
        )
    return fitted.select(
        *MARGINS,
        "cell_tokens",
        share,
        F.when(F.col("cell_tokens") > 0, F.least(F.lit(1.0), F.col("w") * F.lit(float(least or 0.0)) / F.col("cell_tokens")))
        .otherwise(0.0)
        .alias("probability"),
    )


def _join_cells(rows: DataFrame, cells: DataFrame, names: list[str]) -> DataFrame:
    """A cell table of checked size is broadcast, so that texts stay where they are; a larger one is joined."""
    return rows.join(F.broadcast(cells) if cells.count() <= ONE_PARTITION_CELLS else cells, names)


def _margin(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NO_VALUE))


def mixture(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    temperature: float = TEMPERATURE,
    sweeps: int = SWEEPS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    language_col: str = "lang",
    topic: Column | None = None,
) -> DataFrame:
    """doc_id, source, language, topic, tokens, probability and ``sampled`` of every row of ``docs``.

    Tokens are white-space words. A row is sampled when a hash of its id and the seed falls below the
    probability of its cell. Null margins are a value of their own, ``(none)``; null text has no
    tokens. Rows with one id are sampled together. Other columns are ignored. No rows in, none out.
    Texts are read once and never shuffled; cells come from a partial aggregation.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        _margin(F.col(source_col)).alias("source"),
        _margin(F.col(language_col)).alias("language"),
        _margin(style_topic(F.col(text_col)) if topic is None else topic).alias("topic"),
        word_count(F.col(text_col)).alias("tokens"),
    )
    rows = materialise(rows)
    cells = cell_probabilities(rows, targets, temperature, sweeps).drop("cell_tokens", "share")
    return _join_cells(rows, cells, list(MARGINS)).select(
        "doc_id", *MARGINS, "tokens", "probability", (uniform(F.col("doc_id"), seed) < F.col("probability")).alias("sampled")
    )


def sample_to_targets(
    docs: DataFrame, temperature: float = TEMPERATURE, id_col: str = "doc_id", kept_share: float = KEPT_SHARE
) -> DataFrame:
    """The sampled rows of ``docs``; all columns stay.

    About ``kept_share`` of the tokens stay, whatever the rarest cell holds. Null margins are a value of
    their own. Rows with one id, and rows without an id but with one text, are sampled together. Null and
    empty texts hold no tokens and go. No rows in, no rows out.
    """
    names = {m: fresh_name(docs, f"_mix_{m}") for m in MARGINS}
    keyed = docs.withColumns(
        {
            names["source"]: _margin(F.col("source")),
            names["language"]: _margin(F.col("lang")),
            names["topic"]: _margin(style_topic(F.col("text"))),
        }
    )
    rows = keyed.select(*(F.col(names[m]).alias(m) for m in MARGINS), word_count(F.col("text")).alias("tokens"))
    cells = cell_probabilities(rows, temperature=temperature, kept_share=kept_share)
    chance = fresh_name(docs, "_mix_probability")
    cells = cells.select(*(F.col(m).alias(names[m]) for m in MARGINS), F.col("probability").alias(chance))
    own = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return _join_cells(keyed, cells, list(names.values())).filter(uniform(own, SEED) < F.col(chance)).select(*docs.columns)


def op8_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read_table(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 9))


def raking_sql(documents: str, temperature: float = TEMPERATURE, sweeps: int = SWEEPS, seed: int = SEED) -> str:
    """DuckDB CTEs that end in ``mixed``: the rows of :func:`mixture` for the relation ``documents``."""
    steps = []
    last = "mix_w0"
    for i in range(sweeps):
        for margin in MARGINS:
            name = f"mix_w{i + 1}_{margin}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT c.source, c.language, c.topic, c.cell_tokens, "
                f"CASE WHEN s.margin_sum > 0 THEN c.w * (t.target / s.margin_sum) ELSE 0.0 END AS w FROM {last} c "
                f"JOIN (SELECT {margin}, sum(w) AS margin_sum FROM {last} GROUP BY 1) s ON s.{margin} = c.{margin} "
                f"JOIN mix_t_{margin} t ON t.{margin} = c.{margin})"
            )
            last = name
    targets = ",\n".join(
        f"mix_t_{m} AS MATERIALIZED (SELECT {m}, v / sum(v) OVER () AS target FROM "
        f"(SELECT {m}, pow(sum(cell_tokens)::DOUBLE, {float(temperature)}::DOUBLE) AS v FROM mix_cells GROUP BY 1 HAVING sum(cell_tokens) > 0))"
        for m in MARGINS
    )
    return rf"""
mix_rows AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '{NO_VALUE}') AS source, coalesce(lang, '{NO_VALUE}') AS language,
         CASE WHEN contains(coalesce(text, ''), '|') THEN 'tabular'
              WHEN regexp_matches(coalesce(text, ''), '[#$%&*]{{3}}') THEN 'noisy'
              WHEN contains(coalesce(text, ''), '!!') THEN 'loud' ELSE 'prose' END AS topic,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM {documents}),
mix_cells AS MATERIALIZED (
  SELECT source, language, topic, sum(tokens)::BIGINT AS cell_tokens FROM mix_rows GROUP BY 1, 2, 3),
{targets},
mix_w0 AS MATERIALIZED (SELECT *, cell_tokens::DOUBLE AS w FROM mix_cells),
{",".join(steps)},
mix_least AS MATERIALIZED (SELECT min(cell_tokens / w) FILTER (w > 0) AS least FROM {last}),
mix_p AS MATERIALIZED (
  SELECT source, language, topic,
         CASE WHEN cell_tokens > 0 THEN least(1.0::DOUBLE, w * least / cell_tokens) ELSE 0.0 END AS probability
  FROM {last}, mix_least),
mixed AS MATERIALIZED (
  SELECT r.*, p.probability,
         ('0x' || substr(md5(coalesce(r.doc_id::VARCHAR, '') || ':{seed}'), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 < p.probability AS sampled
  FROM mix_rows r JOIN mix_p p USING (source, language, topic))"""


OP8_SQL = f"""
WITH {raking_sql("documents")}
SELECT doc_id, source, language, topic, tokens, round(probability, 9) AS probability, sampled FROM mixed
"""
