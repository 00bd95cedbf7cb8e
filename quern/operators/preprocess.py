"""A pyspark.ml estimator that fills gaps and numbers classes, and its model, which can be saved and loaded."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import tabular as B
from quern.operators.lineage import cut

#: Classes of a column that are broadcast; columns with more are joined by shuffle.
FEW = 100_000


class _Columns(Params):
    numerical: Param = Param(Params._dummy(), "numerical", "columns whose gaps are filled with a median", typeConverter=TypeConverters.toListString)
    categorical: Param = Param(Params._dummy(), "categorical", "columns whose classes become numbers", typeConverter=TypeConverters.toListString)

    def __init__(self, numerical: list[str] | None = None, categorical: list[str] | None = None) -> None:
        super().__init__()
        self._setDefault(numerical=[], categorical=[])
        self._set(**{k: v for k, v in (("numerical", numerical), ("categorical", categorical)) if v is not None})

    def _present(self, df: DataFrame) -> tuple[list[str], list[str]]:
        return tuple([c for c in self.getOrDefault(p) if c in df.columns] for p in (self.numerical, self.categorical))


def _number(c: str) -> Column:
    """The column as a double; no number counts as null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


class TabularPreprocessor(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the exact median of each numerical column with gaps, and the sorted classes of each categorical one.

    Null is the class Unknown. Columns that the table lacks are passed over.
    """

    def _fit(self, df: DataFrame) -> TabularPreprocessorModel:
        numbers, names = self._present(df)
        medians: dict[str, float] = {}
        if numbers:
            found = df.agg(*[F.median(_number(c)).alias(f"m{i}") for i, c in enumerate(numbers)], *[F.count_if(_number(c).isNull()).alias(f"n{i}") for i, c in enumerate(numbers)]).first()
            medians = {c: found[f"m{i}"] for i, c in enumerate(numbers) if found[f"n{i}"] and found[f"m{i}"] is not None}
        classes = df.sparkSession.createDataFrame([], "column string, value string, code long")
        for c in names:
            classes = classes.unionByName(B.label_codes(df, c).select(F.lit(c).alias("column"), "value", "code"))
        return TabularPreprocessorModel(self.getOrDefault(self.numerical), self.getOrDefault(self.categorical), medians, cut(classes))


class TabularPreprocessorModel(_Columns, Model, MLReadable, MLWritable):
    """Fills and numbers as learned: a gap in a column that had none takes 0, a class that was not seen takes number 0."""

    def __init__(self, numerical: list[str] | None = None, categorical: list[str] | None = None, medians: dict[str, float] | None = None, classes: DataFrame | None = None) -> None:
        super().__init__(numerical, categorical)
        self.medians, self.classes = medians or {}, classes

    def _transform(self, df: DataFrame) -> DataFrame:
        numbers, names = self._present(df)
        out = df.withColumns({c: F.coalesce(_number(c), F.lit(self.medians.get(c, 0.0))) for c in numbers})
        sizes = {r["column"]: r["count"] for r in self.classes.groupBy("column").count().collect()}  # a row a column
        for c in names:
            if c not in sizes:
                continue
            known = self.classes.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            value = F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
            out = out.join(F.broadcast(known) if sizes[c] <= FEW else known, value == F.col("_value"), "left").withColumn(c, F.coalesce("_code", F.lit(0))).drop("_value", "_code")
        return out.select(*df.columns)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: TabularPreprocessorModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"medians": self.model.medians})
        self.model.classes.write.parquet(f"{path}/classes")


class _ModelReader(MLReader):
    def load(self, path: str) -> TabularPreprocessorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TabularPreprocessorModel(medians=metadata["medians"], classes=self.sparkSession.read.parquet(f"{path}/classes"))
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
