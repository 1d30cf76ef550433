"""The fitted encoders as pipeline stages: Estimator/Model pairs that work in a Pipeline or a CrossValidator and persist with it.

What a model learned is one JSON parameter, so the default readers and writers hold it; the target
encoder's levels are a table beside it, so there may be any number of them.
"""

from __future__ import annotations

import json
import weakref

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCol, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.operators import encoders, woe


class _Stage(Params, DefaultParamsReadable, DefaultParamsWritable):
    """Parameters that several stages share."""

    def _given(self, values: dict):
        return self._set(**{k: v for k, v in values.items() if v is not None})


class _Learned(Model, _Stage):
    state = Param(Params._dummy(), "state", "what was learned, as JSON", TypeConverters.toString)

    @property
    def learned(self):
        return json.loads(self.getOrDefault(self.state))

    def _from(self, estimator: Params, learned):
        """The estimator's parameters and what it learned."""
        for p in estimator.params:
            if self.hasParam(p.name) and estimator.isDefined(p):
                self._set(**{p.name: estimator.getOrDefault(p)})
        return self._set(state=json.dumps(learned))


class _Columns(HasInputCols, HasOutputCols):
    def pairs(self) -> list[tuple[str, str]]:
        """(input, output); without outputs the inputs are replaced."""
        ins = self.getInputCols()
        return list(zip(ins, self.getOutputCols() if self.isDefined(self.outputCols) else ins, strict=True))


# ---------------------------------------------------------------- caps
class ClipperModel(_Learned, _Columns):
    def _transform(self, df: DataFrame) -> DataFrame:
        caps = self.learned
        return df.withColumns({o: encoders.clip(F.col(i).cast("double"), caps.get(i)) for i, o in self.pairs()})


class Clipper(Estimator, _Stage, _Columns):
    """Values outside two quantiles of the training rows become these quantiles; NULL stays NULL."""
    lower = Param(Params._dummy(), "lower", "share below the lower cap", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "share below the upper cap", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, lower=None, upper=None):
        super().__init__()
        self._setDefault(lower=0.001, upper=0.999)
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> ClipperModel:
        caps = encoders.fit_clipper(df, self.getInputCols(), self.getOrDefault(self.lower), self.getOrDefault(self.upper))
        return ClipperModel()._from(self, caps)


# ---------------------------------------------------------------- medians
class MedianFillerModel(_Learned, _Columns):
    def _transform(self, df: DataFrame) -> DataFrame:
        fill = self.learned
        flags = {f"{o}_missing": F.isnull(i).cast("double") for i, o in self.pairs() if fill[i][1]}
        filled = {o: F.coalesce(F.col(i).cast("double"), F.lit(float(fill[i][0]))) for i, o in self.pairs()}
        return df.withColumns({**flags, **filled})


class MedianFiller(Estimator, _Stage, _Columns):
    """NULL becomes the median; a column that had NULLs in training gets ``<output>_missing``."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> MedianFillerModel:
        return MedianFillerModel()._from(self, encoders.fit_imputer(df, self.getInputCols()))


# ---------------------------------------------------------------- weight of evidence
class WoeEncoderModel(_Learned, HasInputCols, HasOutputCol, HasLabelCol):
    def _transform(self, df: DataFrame) -> DataFrame:
        columns = woe.woe_columns(self.learned)
        names = {f"_w{i}": e for i, e in enumerate(columns.values())}
        work = VectorAssembler(inputCols=list(names), outputCol=self.getOutputCol()).transform(df.withColumns(names))
        return work.drop(*names)


class WoeEncoder(Estimator, _Stage, HasInputCols, HasOutputCol, HasLabelCol):
    """A vector of the weights of evidence of the columns with enough information value."""
    minIv = Param(Params._dummy(), "minIv", "least information value", TypeConverters.toFloat)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "most columns", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, labelCol=None, minIv=None, maxFeatures=None):
        super().__init__()
        self._setDefault(minIv=0.02, maxFeatures=30, outputCol="features")
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> WoeEncoderModel:
        types = dict(df.dtypes)
        text = [c for c in self.getInputCols() if types[c] == "string"]
        rules = woe.fit_woe(df, self.getLabelCol(), [c for c in self.getInputCols() if c not in text], text,
                            self.getOrDefault(self.minIv), self.getOrDefault(self.maxFeatures))
        return WoeEncoderModel()._from(self, rules)


# ---------------------------------------------------------------- target means
class _WithTables(DefaultParamsWriter):
    """Copies the level tables into the stage's folder."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        for c, (table, _) in self.instance.learned.items():
            encoders.df_at(self.sparkSession, table).write.parquet(f"{path}/levels/{c}")


class _FromTables(DefaultParamsReader):
    def load(self, path: str):
        stage = super().load(path)
        return stage._set(state=json.dumps({c: (f"{path}/levels/{c}", default) for c, (_, default) in stage.learned.items()}))


class TargetEncoderModel(_Learned, _Columns, HasLabelCol):
    key = Param(Params._dummy(), "key", "column that deals rows to folds", TypeConverters.toString)
    smoothing = Param(Params._dummy(), "smoothing", "rows of the overall mean added to a level", TypeConverters.toFloat)
    trained_on = None

    def write(self):
        return _WithTables(self)

    @classmethod
    def read(cls):
        return _FromTables(cls)

    def _transform(self, df: DataFrame) -> DataFrame:
        learned = self.learned
        if self.trained_on is not None and self.trained_on() is df:
            # the rows it was fitted on, as a pipeline passes them on: means over the other folds
            out = encoders.cross_fitted(df, self.getOrDefault(self.key), self.getLabelCol(), list(learned), self.getOrDefault(self.smoothing))
            return out.select(*df.columns, *[F.col(f"{i}_crossed").alias(o) for i, o in self.pairs()])
        out = encoders.looked_up(df, {c: path for c, (path, _) in learned.items()}, "_mean")
        return out.select(*df.columns, *[F.coalesce(F.col(f"{i}_mean"), F.lit(float(learned[i][1]))).alias(o) for i, o in self.pairs()])


class TargetEncoder(Estimator, _Stage, _Columns, HasLabelCol):
    """Label mean per level, shrunk to the overall mean. The rows it is fitted on get the mean over the other folds."""
    key = Param(Params._dummy(), "key", "column that deals rows to folds", TypeConverters.toString)
    smoothing = Param(Params._dummy(), "smoothing", "rows of the overall mean added to a level", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, labelCol=None, key=None, smoothing=None):
        super().__init__()
        self._setDefault(smoothing=10.0, key="id")
        self._given(self._input_kwargs)

    def _fit(self, df: DataFrame) -> TargetEncoderModel:
        label, learned = self.getLabelCol(), {}
        overall = float(df.agg(F.avg(label)).first()[0] or 0.0)
        for c in self.getInputCols():
            table = encoders.target_means(df, c, label, self.getOrDefault(self.smoothing))
            learned[c] = (encoders.path_of(table.select(F.col(c).cast("string").alias("level"), F.col("mean").alias("value")), "means"), overall)
        model = TargetEncoderModel()._from(self, learned)
        model.trained_on = weakref.ref(df)
        return model
