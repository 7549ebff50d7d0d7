"""Cross-validation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradloom.dataset import Dataset
from gradloom.errors import InvalidParameter
from gradloom.operators.trees import fold_of
from gradloom.params import TrainingParams
from gradloom.plans.boost import train


def aggregate(history: DataFrame) -> DataFrame:
    """(metric, iteration, test_mean, test_std) of (fold, metric, iteration, value); the deviation is the population's."""
    return history.groupBy("metric", "iteration").agg(F.avg("value").alias("test_mean"), F.stddev_pop("value").alias("test_std"))


def cross_validate(spark: SparkSession, params: TrainingParams, data: Dataset, rounds: int, folds: int = 5, seed: int = 0, parallelism: int = 4) -> DataFrame:
    """aggregate() of each fold's score under a model of the others. With queries, a query's rows share a fold.

    parallelism: models that are trained at once, each with its own binned rows stored; their jobs fill each other's gaps. The scores don't depend on it.
    """
    if folds < 2:
        raise InvalidParameter("cross-validation needs at least 2 folds")
    if parallelism < 1:
        raise InvalidParameter("parallelism must be at least 1")
    fold = fold_of(F.col(data.qid or data.row_id).cast("long"), folds, seed)

    def scores(k: int) -> list[tuple[int, str, int, float]]:
        got = train(params, data.select_rows(fold != k), rounds, [("test", data.select_rows(fold == k))])
        return [(k, m, i, v) for i, _, m, v in got.history]

    with ThreadPoolExecutor(min(folds, parallelism)) as pool:
        history = [r for own in pool.map(inheritable_thread_target(spark)(scores), range(folds)) for r in own]
    return aggregate(spark.createDataFrame(history, "fold int, metric string, iteration int, value double"))
