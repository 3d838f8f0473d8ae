"""A table function over partitions of a table, whose schema follows from its arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..session import ship

class Funnel:
    """How far the rows of a key come in a list of steps, in order: each step's first time after that of the step before.

    Argument: a table of key, time, tie and kind, in this order, partitioned by the key and in order of time and tie; then the steps, with
    commas between. Result: the key, the number of steps reached, and a time for each step, named as the step. A partition's state
    is one time a step, whatever its rows.
    """

    def __init__(self):
        self.key, self.times = None, []

    @staticmethod
    def analyze(rows: AnalyzeArgument, steps: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) != 4:
            raise ValueError("the first argument is a table of key, time, tie and kind")
        if not steps.isConstantExpression or not steps.value:
            raise ValueError("steps are a constant text")
        key, time, tie, _ = rows.dataType.fields
        names = steps.value.split(",")
        if len(set(names)) < len(names):
            raise ValueError(f"steps repeat: {steps.value}")
        schema = T.StructType([T.StructField(key.name, key.dataType), T.StructField("reached", T.IntegerType())])
        for n in names:
            schema = schema.add(n, time.dataType)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.name)], orderBy=[OrderingColumn(time.name), OrderingColumn(tie.name)])

    def eval(self, row, steps: str):
        self.key, at, _, kind = row
        self.steps = steps.split(",")
        if len(self.times) < len(self.steps) and kind == self.steps[len(self.times)] and at is not None:
            self.times.append(at)

    def terminate(self):
        yield (self.key, len(self.times), *self.times, *[None] * (len(self.steps) - len(self.times)))


def funnel(df: DataFrame, key: str, time: str, tie: str, kind: str, steps: list[str]) -> DataFrame:
    """key, reached and a time for each step, for each key of df (null keys are one). Ties of time go by the column tie; null times reach nothing."""
    spark: SparkSession = df.sparkSession
    ship(spark)
    spark.udtf.register("millrace_funnel", F.udtf(Funnel))
    rows = df.select(key, time, tie, kind)
    return spark.sql("SELECT * FROM millrace_funnel(TABLE({rows}), :steps)", args={"steps": ",".join(steps)}, rows=rows)
