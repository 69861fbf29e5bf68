"""Which column plays which part: target, key, features. One table carries all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Roles:
    """The target by name, else the last column; features are the rest."""

    target: str | None = None
    key: str | None = None

    def target_of(self, df: DataFrame) -> str:
        return self.target or df.columns[-1]

    def features_of(self, df: DataFrame) -> list[str]:
        skip = {self.target_of(df), self.key}
        return [c for c in df.columns if c not in skip]

    def mark(self, df: DataFrame) -> DataFrame:
        """The table with its target column named ``target``."""
        return df.withColumnRenamed(self.target_of(df), "target")
