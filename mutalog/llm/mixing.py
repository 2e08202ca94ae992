"""Mixing sources to target weights by iterative proportional fitting, with native expressions only.

Documents fall into cells (source, language, topic). The token weights of the
cells are raked to the three target marginals in turn, until no marginal is off
by more than a tolerance; the ratio of a cell's raked weight to its tokens, scaled to the rate and
clipped at 1, is the probability with which each of its documents stays. The
draw is a hash of the id, so it is the same in every run.

Targets are the tokens of a category to the power `temperature` (1 keeps the
corpus as it is, 0 makes categories equal), or a table of shares.

Defined results: a null category is a category; a null text has no tokens and
follows its cell; documents without an id draw by their text; rows that repeat
id and cell get one decision; a column of the caller that has the name of an
added one goes on as <name>_input; an empty table gives no rows.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutalog.llm.shared import apart, text_of, written

MARGINS = ("source", "lang", "topic")
#: The first marker that a text contains names its topic. Fixed values.
TOPICS = {"web": ("http://", "https://", "www."), "legal": ("Licensed under", "Copyright", "license"), "contact": ("@",), "table": (" | ",)}
RUNS = r"\p{L}+|\p{N}+|[^ \t\n\x0B\f\r\p{L}\p{N}]+"
#: Cells that one task rakes without a shuffle, and that may be broadcast; more are raked and joined by shuffles.
CELLS = 20_000
#: Largest deviation of a marginal from its target, relative to it; sweeps between two looks at it, most sweeps, and least progress of a round.
TOLERANCE, ROUND, MOST_SWEEPS, SLOW = 1e-9, 8, 200, 0.05


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, marks in reversed(TOPICS.items()):
        found = F.lit(False)
        for m in marks:
            found = found | F.contains(text, F.lit(m))
        out = F.when(found, name).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Runs of letters, of digits and of other visible characters, each a pre-token of byte-level vocabularies."""
    return F.regexp_count(text, F.lit(RUNS)).cast("long")


def described(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with topic and n_tokens."""
    return apart(df, "topic", "n_tokens").withColumns({"topic": topic_of(text_of(text_col)), "n_tokens": tokens_of(text_of(text_col))})


def with_targets(cells: DataFrame, temperature: float, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells (one row per cell, with tokens) with __t_<margin>, the share that the category of each margin should have.

    targets: by margin, a table of category and share; a margin without one gets tokens ** temperature.
    """
    for m in MARGINS:
        if targets and m in targets:
            t = targets[m].select(F.col(m).alias("__k"), F.col("share").alias(f"__t_{m}"))
        else:
            powers = cells.groupBy(F.col(m).alias("__k")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temperature)).alias("x"))
            t = powers.select("__k", (F.col("x") / F.lit(powers.agg(F.sum("x")).first()[0])).alias(f"__t_{m}"))
        cells = cells.join(t, F.col(m).eqNullSafe(F.col("__k")), "left").drop("__k").fillna(0.0, [f"__t_{m}"])
    return cells


def _with_sum(cells: DataFrame, m: str, few: bool) -> DataFrame:
    """cells with __have, the weight of all cells of the row's category: by a window in the one partition of few cells, else by a grouped sum."""
    if few:
        return cells.withColumn("__have", F.sum("weight").over(Window.partitionBy(m)))
    sums = written(cells.groupBy(F.col(m).alias("__k")).agg(F.sum("weight").alias("__have")))
    return cells.join(sums, F.col(m).eqNullSafe(F.col("__k"))).drop("__k")


def rake(cells: DataFrame, temperature: float, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE, most: int = MOST_SWEEPS) -> DataFrame:
    """cells with weight, raked to the targets in turn until no margin is off by more than tolerance, relative to its target.

    Sweeps are made in rounds of ROUND; after each the table is written and its
    largest deviation read. Targets that can't all be met (a category without
    tokens, a sum that isn't 1) end with a warning: after `most` sweeps, or once
    a round takes less than SLOW off the deviation.
    """
    cells = written(with_targets(cells, temperature, targets))
    few = cells.count() <= CELLS
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    worst = float("inf")
    for _ in range(max(1, most // ROUND)):
        cells = cells.coalesce(1) if few else cells
        for _ in range(ROUND):
            cells = cells if few else written(cells)
            for m in MARGINS:
                have, aim = F.col("__have"), F.col(f"__t_{m}") * F.lit(total)
                cells = _with_sum(cells, m, few).withColumn("weight", F.when(have > 0, F.col("weight") * aim / have).otherwise(0.0)).drop("__have")
        off = []
        for m in MARGINS:
            have, aim = F.col("__have"), F.col(f"__t_{m}") * F.lit(total)
            cells = _with_sum(cells, m, few).withColumn(f"__off_{m}", F.when(aim > 0, F.abs(have / aim - 1)).otherwise(0.0)).drop("__have")
            off.append(f"__off_{m}")
        made = written(cells)
        before, worst = worst, made.agg(F.max(F.greatest(*off))).first()[0] or 0.0
        cells = made.drop(*off)
        if worst <= tolerance or worst > (1 - SLOW) * before:
            break
    if worst > tolerance:
        warnings.warn(f"the marginals are still off by {worst:.3g} of their targets: they can't all be met", stacklevel=2)
    return cells.drop(*(f"__t_{m}" for m in MARGINS))


def marginals(cells: DataFrame, temperature: float, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """margin, category, target, share: what rake() aimed at and what the weights of its cells have."""
    aims, total = with_targets(cells, temperature, targets), F.sum("weight")
    whole = cells.agg(total).first()[0] or 0.0
    parts = [aims.groupBy(F.lit(m).alias("margin"), F.col(m).cast("string").alias("category")).agg(F.first(f"__t_{m}").alias("target"), F.when(F.lit(whole) > 0, total / F.lit(whole)).alias("share")) for m in MARGINS]
    return reduce(DataFrame.unionByName, parts)


def probabilities(cells: DataFrame, rate: float) -> DataFrame:
    """cells with p = min(1, c * weight / tokens), where c makes the expected tokens rate * all.

    c grows from the unclipped solution: what it clips counts in full, the rest
    shares what is left, until nothing new is clipped. Each round is one sum
    over the cells, so no task orders them.
    """
    f = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    total, c, before = float(cells.agg(F.sum("tokens")).first()[0] or 0), 0.0, -1
    while c is not None:
        over = F.lit(c) * f > 1
        n, clipped, rest = cells.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.lit(0.0))).first()
        if n == before:
            break
        before, c = n, (rate * total - clipped) / rest if rest > 0 else None
    p = F.lit(1.0) if c is None else F.least(F.lit(1.0), F.lit(c) * f)
    return cells.withColumn("p", F.when(F.col("tokens") > 0, p).otherwise(1.0))


def draw(id_col: str, text_col: str, seed: int) -> Column:
    """A number in [0, 1) from the id."""
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(text_of(text_col).cast("binary")))
    return F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def with_probabilities(df: DataFrame, temperature: float = 0.7, rate: float = 0.5, targets: dict[str, DataFrame] | None = None, text_col: str = "text") -> DataFrame:
    """df with topic, n_tokens, weight (raked tokens of the row's cell) and p."""
    rows = described(apart(df, "weight", "p", *(f"__{m}" for m in MARGINS)), text_col)
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    made = written(probabilities(rake(cells, temperature, targets), rate))
    few = made.count() <= CELLS
    made = made.select(*(F.col(m).alias(f"__{m}") for m in MARGINS), "weight", "p")
    same = [F.col(m).eqNullSafe(F.col(f"__{m}")) for m in MARGINS]
    return rows.join(F.broadcast(made) if few else made, same[0] & same[1] & same[2]).drop(*(f"__{m}" for m in MARGINS))


def mix(df: DataFrame, temperature: float = 0.7, rate: float = 0.5, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """with_probabilities() and kept, the decision of the draw."""
    return with_probabilities(apart(df, "kept"), temperature, rate, targets, text_col).withColumn("kept", draw(id_col, text_col, seed) < F.col("p"))
