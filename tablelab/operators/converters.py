"""Column droppers as ML transformers, so they fit into any ``Pipeline`` and are saved with it."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable

from tablelab.operators.dataset import drop_by_index, remove_columns


class ColumnDropperByName(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Drop columns by name."""

    columnNames = Param(
        Params._dummy(), "columnNames", "columns to drop", TypeConverters.toListString
    )

    @keyword_only
    def __init__(self, *, columnNames=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        return remove_columns(dataset, self.getOrDefault(self.columnNames))


class ColumnDropperByIndex(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Drop one 0-based column position (``first``) or the inclusive range ``first``..``last``."""

    first = Param(Params._dummy(), "first", "first position to drop", TypeConverters.toInt)
    last = Param(Params._dummy(), "last", "last position to drop", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, first=None, last=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset):
        start = self.getOrDefault(self.first)
        if self.isSet(self.last):
            return drop_by_index(dataset, (start, self.getOrDefault(self.last)))
        return drop_by_index(dataset, start)
