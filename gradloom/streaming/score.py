"""Predictions over a stream: prediction is a narrow projection, so a streaming frame takes it as it is."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from gradloom.dataset import Dataset, present
from gradloom.model import BoostedModel


def score_stream(stream: DataFrame, model: BoostedModel, features: list[str], row_id: str, name: str = "prediction") -> DataFrame:
    """(row_id, prediction) for each row of a streaming frame; no state is kept, late rows are scored like others."""
    rest = [c for c in stream.columns if c not in features]
    frame = stream.select(*rest, *[present(stream[f]).alias(f) for f in features])
    return model.predict(replace(Dataset(frame, tuple(features), row_id)), name=name)
