"""A store of numbered step results as tables, their intersections, a readable dump, and evidence per question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.traversal import intersection


class Steps:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.names = spark, folder, []

    def store(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes rows (with id) as the next step and returns them as a table that SQL can name."""
        path = f"{self.folder}/step={len(self.names) + 1:03d}"
        rows.write.mode("overwrite").parquet(path)
        self.names.append(name)
        table = self.spark.read.parquet(path)
        table.createOrReplaceTempView(f"step_{len(self.names)}")
        return table

    def get(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/step={number:03d}")

    def common(self, numbers: list[int]) -> DataFrame:
        return intersection([self.get(n) for n in numbers])

    def counts(self) -> DataFrame:
        parts = [self.get(i + 1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(i + 1).cast("long").alias("step"), F.lit(name).alias("name"), "n") for i, name in enumerate(self.names)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def markdown(self, rows: int = 5) -> str:
        """A heading and the first rows of each step; longer steps stay in their tables."""
        lines = []
        for i, name in enumerate(self.names):
            got = self.get(i + 1).orderBy("id").limit(rows + 1).collect()
            lines += [f"## Step {i + 1}: {name}", *(f"- {r.asDict()}" for r in got[:rows]), *(["- ..."] if len(got) > rows else [])]
        return "\n".join(lines)

    def reset(self) -> None:
        for i in range(len(self.names)):
            self.spark.catalog.dropTempView(f"step_{i + 1}")
        self.names = []


def write_evidence(rows: DataFrame, folder: str, question: int) -> None:
    rows.write.mode("overwrite").json(f"{folder}/question={question}")
