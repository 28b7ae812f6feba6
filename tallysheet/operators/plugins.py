"""Recognition engines and detectors as plug-ins.

An engine is a function from a grey image to (text, confidence). Engines run on
the executors over Arrow batches; an engine that raises gives an error row and
the others go on. Everything after recognition is ordinary DataFrame work.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from importlib.util import find_spec

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.functions.text import strip
from tallysheet.schemas import OCR_RESULTS
from tallysheet.sources.shared import is_written, shared_folder, written

Engine = Callable[[np.ndarray], tuple[str, float]]


@dataclass
class Registry:
    """Engines by name, with priority, the packages they need, and capabilities."""

    engines: dict[str, dict] = field(default_factory=dict)

    def register(self, name: str, engine: Engine, priority: int = 999, needs: tuple[str, ...] = (), **capabilities) -> None:
        self.engines[name] = {"engine": engine, "priority": priority, "needs": needs, "capabilities": capabilities}

    def available(self) -> list[str]:
        """Engines whose packages can be found."""
        return [n for n, e in self.engines.items() if all(find_spec(p) for p in e["needs"])]

    def describe(self, name: str) -> dict:
        """What is known of an engine; empty for an unknown one."""
        e = self.engines.get(name)
        return {"priority": e["priority"], "needs": list(e["needs"]), "available": name in self.available(), **e["capabilities"]} if e else {}

    def sound(self, result: object) -> bool:
        """Whether a result is a text and a confidence."""
        text, confidence = result
        return isinstance(text, str) and 0 <= confidence <= 1

    def self_test(self, image: np.ndarray | None = None) -> dict[str, str]:
        """``ok`` or the error of each available engine on a blank image."""
        out = {}
        for name in self.available():
            try:
                result = self.engines[name]["engine"](np.full((8, 8), 255) if image is None else image)
                out[name] = "ok" if self.sound(result) else "no such result"
            except Exception as e:  # noqa: BLE001  an engine may raise anything
                out[name] = str(e)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """The registry as a relation, one row for each engine."""
        usable = set(self.available())
        rows = [(n, n in usable, e["priority"], None, k) for k, (n, e) in enumerate(self.engines.items())]
        return spark.createDataFrame(rows, "engine_name string, enabled boolean, priority int, timeout int, config_pos int")

    def recognise(self, images: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Every image through every engine: one row for each, in the schema of results.

        Each task runs all engines on its batch of images, so images are read
        and sent to Python once, whatever the number of engines.
        """
        chosen = [(k, n, self.engines[n]["engine"]) for k, n in enumerate(names or self.available())]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for image_id, h, w, pixels in zip(f["image_id"], f["height"], f["width"], f["pixels"], strict=True):
                    for pos, name, engine in chosen:
                        start = time.perf_counter()
                        try:
                            text, confidence = engine(np.asarray(pixels).reshape(h, w))
                            rows.append((image_id, name, pos, text, float(confidence), time.perf_counter() - start, None))
                        except Exception as e:  # noqa: BLE001
                            rows.append((image_id, name, pos, "", 0.0, time.perf_counter() - start, str(e) or type(e).__name__))
                yield pd.DataFrame(rows, columns=OCR_RESULTS.names)

        return images.select("image_id", "height", "width", "pixels").mapInPandas(run, OCR_RESULTS)


def cascade(engines: Registry | Callable[[str, DataFrame], DataFrame], images: DataFrame, order: list[str], enough: float = 0.9, folder: str | None = None) -> DataFrame:
    """O7, U3 with its savings: engines run in waves, each on the images that no engine before was confident about.

    ``engines`` is a registry, or gives the results of an engine for some images.
    Each wave is written to ``folder`` (by default a new one among the shared
    folders) and read from there by all later ones, so an image meets an engine
    once; a run that died goes on after its last whole wave if it is given the
    same folder. Failed and blank results don't end the search.
    """
    spark = images.sparkSession
    run = (lambda name, left: engines.recognise(left, [name])) if isinstance(engines, Registry) else engines
    folder = (folder or shared_folder(spark)).rstrip("/")
    left, waves = images, []
    for k, name in enumerate(order):
        path = f"{folder}/wave-{k}"
        wave = run(name, left)
        found = spark.read.schema(wave.schema).parquet(path) if is_written(spark, path) else written(wave, path)
        waves.append(found)
        sure = found.where(F.col("error_message").isNull() & (strip(F.col("text")) != "") & (F.col("confidence") >= enough)).select("image_id").distinct()
        left = left.join(sure, "image_id", "left_anti")
    return reduce(DataFrame.unionByName, waves) if waves else spark.createDataFrame([], OCR_RESULTS)
