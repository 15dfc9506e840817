"""Median imputation as a pipeline stage that is fitted exactly and saved with the pipeline."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvengine.functions.scalars import finite
from cvengine.operators.order import CELL_ROWS, column_quantiles


class _MedianParams(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Numeric input columns and, one for each, the names of the filled copies."""

    def _named(self, inputs, outputs):
        if inputs is not None:
            self._set(inputCols=list(inputs), outputCols=list(outputs))


class MedianImputer(Estimator, _MedianParams):
    """Learns the exact median of each input column; NULL, NaN and infinite cells do not count.

    All medians come from the same passes (``order.column_quantiles``), whatever the number of columns. A column without
    a usable value is filled with 0.
    """

    cellRows = Param(Params._dummy(), "cellRows", "rows that one task may sort", typeConverter=TypeConverters.toInt)

    def __init__(self, inputCols=None, outputCols=None, cellRows: int = CELL_ROWS):
        super().__init__()
        self._setDefault(cellRows=CELL_ROWS)
        self._set(cellRows=cellRows)
        self._named(inputCols, outputCols)

    def _fit(self, dataset: DataFrame) -> MedianModel:
        names = self.getInputCols()
        usable = dataset.select(*[finite(F.col(c)).alias(c) for c in names])
        found = column_quantiles(usable, names, [(1, 2)], self.getOrDefault(self.cellRows))
        model = MedianModel(names, self.getOutputCols(), [0.0 if found[c][0] is None else found[c][0] for c in names])
        return self._copyValues(model)


class MedianModel(Model, _MedianParams):
    """Adds the filled copies: doubles, with the learned median for each missing or non-finite cell."""

    medians = Param(Params._dummy(), "medians", "the median of each input column", typeConverter=TypeConverters.toListFloat)

    def __init__(self, inputCols=None, outputCols=None, medians=None):
        super().__init__()
        self._named(inputCols, outputCols)
        if medians is not None:
            self._set(medians=list(medians))

    def getMedians(self) -> list[float]:
        return self.getOrDefault(self.medians)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = zip(self.getInputCols(), self.getOutputCols(), self.getMedians())
        return dataset.withColumns({out: F.coalesce(finite(F.col(c)), F.lit(median)) for c, out, median in filled})
