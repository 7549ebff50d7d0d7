"""Training and prediction as stages of pyspark.ml: use in Pipeline, CrossValidator and stored pipelines."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsReadable, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from gradloom.dataset import Dataset
from gradloom.model import BoostedModel
from gradloom.params import TrainingParams
from gradloom.plans.boost import train

#: Stage parameters and the training parameters that they set.
SETTINGS = {
    "objective": ("objective", TypeConverters.toString), "numClass": ("num_class", TypeConverters.toInt), "booster": ("booster", TypeConverters.toString), "treeMethod": ("tree_method", TypeConverters.toString), "growPolicy": ("grow_policy", TypeConverters.toString),
    "eta": ("eta", TypeConverters.toFloat), "gamma": ("gamma", TypeConverters.toFloat), "alpha": ("alpha", TypeConverters.toFloat), "regLambda": ("reg_lambda", TypeConverters.toFloat), "minChildWeight": ("min_child_weight", TypeConverters.toFloat), "maxDepth": ("max_depth", TypeConverters.toInt),
    "maxLeaves": ("max_leaves", TypeConverters.toInt), "maxBin": ("max_bin", TypeConverters.toInt), "subsample": ("subsample", TypeConverters.toFloat), "colsampleByTree": ("colsample_bytree", TypeConverters.toFloat), "seed": ("seed", TypeConverters.toInt),
}


class _Columns(HasLabelCol, HasPredictionCol):
    featuresCols = Param(Params._dummy(), "featuresCols", "the columns of features, in order", TypeConverters.toListString)


class Boosting(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Trains a model of `rounds` rounds on rows with featuresCols, labelCol and rowIdCol; its other parameters are those of SETTINGS, unset ones by TrainingParams."""

    rowIdCol = Param(Params._dummy(), "rowIdCol", "a whole number that tells rows apart", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "rounds of boosting", TypeConverters.toInt)
    backend = Param(Params._dummy(), "backend", "what searches splits", TypeConverters.toString)

    def __init__(self, **values: object) -> None:
        super().__init__()
        self._setDefault(rowIdCol="row_id", rounds=10, backend="auto", labelCol="label", predictionCol="prediction")
        self._set(**values)

    def _fit(self, dataset: DataFrame) -> BoostingModel:
        own = {field: self.getOrDefault(name) for name, (field, _) in SETTINGS.items() if self.isSet(name)}
        data = Dataset.of(dataset, self.getOrDefault("featuresCols"), self.getOrDefault("rowIdCol"), label=self.getOrDefault("labelCol"))
        model = train(TrainingParams(**own), data, self.getOrDefault("rounds"), backend=self.getOrDefault("backend")).model
        return self._copyValues(BoostingModel(model))


for _name, (_field, _kind) in SETTINGS.items():
    setattr(Boosting, _name, Param(Params._dummy(), _name, f"the training parameter {_field}", _kind))


class BoostingModel(Model, _Columns, MLReadable, MLWritable):
    """Adds predictionCol to rows with featuresCols."""

    def __init__(self, booster: BoostedModel | None = None) -> None:
        super().__init__()
        self.booster = booster
        self._setDefault(labelCol="label", predictionCol="prediction")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        data = Dataset(dataset, tuple(self.getOrDefault("featuresCols")), dataset.columns[0])
        return self.booster.predict(data, tuple(dataset.columns), self.getOrDefault("predictionCol"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: BoostingModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc)
        self.instance.booster.write_table(self.sparkSession, f"{path}/booster")


class _Reader(MLReader):
    def load(self, path: str) -> BoostingModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        model = BoostingModel(BoostedModel.read_table(self.sparkSession, f"{path}/booster"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
