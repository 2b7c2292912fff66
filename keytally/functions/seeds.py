"""Seed tables: one row of random 31-bit numbers per sketch row.

A table is drawn from Python's seeded generator while the plan is written, so every run of
a plan, and the SQL it is checked against, sees the same numbers. Its size is set by the
sketch's shape alone and never by the data; it enters a plan as an exploded literal array.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SEED_ROWS = 100_000
SEED_COLUMNS = ("sa", "sb", "sc", "sd", "ha", "hb", "hc", "hd")


@dataclass(frozen=True)
class SeedTable:
    """Rows of (run, row, col, four sign seeds, four bucket seeds)."""

    rows: tuple[tuple[int, ...], ...]

    columns = ("run", "row", "col", *SEED_COLUMNS)

    @property
    def depth(self) -> int:
        return len({r[1] for r in self.rows})

    def literal(self, only: tuple[str, ...] | None = None) -> Column:
        """The table as a constant array of structs."""
        names = self.columns if only is None else only
        pick = [(n, self.columns.index(n)) for n in names]
        rows = (
            "named_struct("
            + ", ".join(f"'{n}', {r[i]}{'L' if n in SEED_COLUMNS else ''}" for n, i in pick)
            + ")"
            for r in dict.fromkeys(self.rows)
        )
        return F.expr(f"array({', '.join(rows)})")

    def attach(self, df: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
        """Every row of ``df`` once per seed row, with the seeds as columns."""
        return df.select("*", F.explode(self.literal(only)).alias("_s")).select(
            *df.columns, "_s.*"
        )

    def attach_run(self, df: DataFrame, run: str, only: tuple[str, ...] | None = None) -> DataFrame:
        """Every row of ``df`` once per seed row of the run that its column ``run`` names."""
        names = self.columns if only is None else only
        own = F.filter(self.literal(tuple(dict.fromkeys(("run", *names)))), lambda s: s.run == F.col(run))
        rest = [c for c in df.columns if c not in names]
        return df.select(*rest, F.explode(own).alias("_s")).select(
            *rest, *[F.col(f"_s.{n}").alias(n) for n in names]
        )

    def frame(self, spark: SparkSession) -> DataFrame:
        """The table itself as a small DataFrame."""
        return spark.range(1).select(F.explode(self.literal()).alias("_s")).select("_s.*")

    def values_sql(self) -> str:
        """The table as a VALUES list for the SQL the results are checked against."""
        body = ", ".join("(" + ", ".join(map(str, r)) + ")" for r in self.rows)
        return f"(VALUES {body}) s({', '.join(self.columns)})"


def seed_table(rows: int, cols: int = 1, runs: int = 1, seed: int = 2024) -> SeedTable:
    """``runs`` x ``rows`` x ``cols`` rows of independent seeds."""
    if min(rows, cols, runs) < 1:
        raise ValueError("rows, cols and runs must be positive")
    if rows * cols * runs > MAX_SEED_ROWS:
        raise ValueError(f"a sketch of more than {MAX_SEED_ROWS} seed rows is not supported")
    rng = random.Random(seed)
    return SeedTable(
        tuple(
            (run, row, col, *[rng.randrange(1, 2**31 - 1) for _ in SEED_COLUMNS])
            for run in range(runs)
            for row in range(rows)
            for col in range(cols)
        )
    )


def draw_seeds(n: int, seed: int, bits: int = 31) -> tuple[int, ...]:
    """``n`` independent seeds of the given width."""
    rng = random.Random(seed)
    return tuple(rng.randrange(1, 2**bits - 1) for _ in range(n))
