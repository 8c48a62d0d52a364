"""Small documents next to a model: parameters and metadata as one-row JSON tables."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from fillgauge.session import replace_path
from fillgauge.sources.generations import commit, current


def write_json(spark: SparkSession, payload: dict[str, Any], path: str) -> None:
    text = json.dumps(payload, sort_keys=True)
    held = spark.createDataFrame([(text,)], "value string").coalesce(1)
    replace_path(spark, path, held.write.text)


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    """The document at ``path``; ``FileNotFoundError`` if there is none."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except (AnalysisException, Py4JJavaError) as exc:
        raise FileNotFoundError(f"nothing stored at {path}") from exc
    if row is None:
        raise FileNotFoundError(f"nothing stored at {path}")
    return json.loads(row["value"])


def params_path(folder: str, prefix: str) -> str:
    return f"{folder}/model/{prefix}_params"


def meta_path(folder: str, prefix: str) -> str:
    return f"{folder}/model/{prefix}_meta"


def model_root(folder: str, prefix: str) -> str:
    """Where the generations of a model and its parameters lie."""
    return f"{folder}/model/{prefix}"


def save_best_params(spark: SparkSession, payload: dict[str, Any], folder: str, prefix: str = "GBM") -> None:
    """Parameters for later training; a stored model stays as it is, with the parameters it was trained by."""
    root, own = model_root(folder, prefix), f"params-{uuid.uuid4().hex}"
    write_json(spark, payload, f"{root}/{own}")
    commit(spark, root, lambda before: {"model": (before or {}).get("model"), "params": own})


def load_best_params(spark: SparkSession, folder: str, prefix: str = "GBM") -> dict[str, Any]:
    """The parameters committed last, with a model or alone."""
    manifest = current(spark, model_root(folder, prefix))
    path = params_path(folder, prefix) if manifest is None else f"{model_root(folder, prefix)}/{manifest['params']}"
    return read_json(spark, path)
