"""Stages of pyspark.ml."""

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from gradloom.dataset import Dataset
from gradloom.estimator import Boosting, BoostingModel
from gradloom.params import TrainingParams
from gradloom.plans import boost


def test_stage_in_pipelines(spark, tmp_path):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.random((300, 2)).astype(np.float32), columns=["a", "b"]).assign(row_id=range(300))
    pdf["y"] = 2.0 * pdf["a"] - pdf["b"] ** 2
    df = spark.createDataFrame(pdf)
    stage = Boosting(featuresCols=["a", "b"], labelCol="y", rounds=4, maxDepth=2, eta=0.5)
    stage.write().overwrite().save(str(tmp_path / "stage"))
    again = Boosting.load(str(tmp_path / "stage"))
    assert again.getOrDefault("maxDepth") == 2 and again.getOrDefault("featuresCols") == ["a", "b"]
    fitted = Pipeline(stages=[again]).fit(df)
    got = fitted.transform(df).toPandas().sort_values("row_id")
    assert list(got.columns) == [*pdf.columns, "prediction"]
    d = Dataset(df, ("a", "b"), label="y")
    want = boost.train(TrainingParams(max_depth=2, eta=0.5), d, 4).model.predict(d).toPandas().sort_values("row_id")
    np.testing.assert_allclose(got["prediction"], want["prediction"], atol=1e-6)
    fitted.write().overwrite().save(str(tmp_path / "fitted"))
    back = PipelineModel.load(str(tmp_path / "fitted"))
    assert isinstance(back.stages[0], BoostingModel)
    np.testing.assert_allclose(back.transform(df).toPandas().sort_values("row_id")["prediction"], want["prediction"], atol=1e-6)
    grid = ParamGridBuilder().addGrid(stage.rounds, [1, 6]).build()
    best = CrossValidator(estimator=stage, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="y"), numFolds=2, seed=1).fit(df)
    assert best.avgMetrics[1] < best.avgMetrics[0] and best.bestModel.booster.rounds == 6
