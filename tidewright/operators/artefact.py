"""Verified model artefacts (UDF-02): a file goes to the executors with the job, and no worker uses it unproven.

The driver ships the file by Spark's own file distribution.  A worker reads its copy, compares its SHA-256 with the one
that the caller froze, and only then loads it, once for all batches and tasks that the worker gets; an accumulator
counts loads.  Another digest ends the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Models of this Python worker, by digest.
_LOADED: dict[str, object] = {}


class WrongDigest(RuntimeError):
    """An artefact is not the one that was agreed."""


def digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


@dataclass
class Artefact:
    """A shipped file: its name with the executors, the SHA-256 it must have, and the accumulator of loads."""

    name: str
    sha256: str
    loads: object

    def load(self, read: Callable[[bytes], object]) -> object:
        """In a worker: the model that ``read`` makes of the verified bytes."""
        if self.sha256 not in _LOADED:
            with open(SparkFiles.get(self.name), "rb") as file:  # the executor's own copy, brought by Spark
                content = file.read()
            found = digest(content)
            if found != self.sha256:
                raise WrongDigest(f"{self.name} has the digest {found} instead of {self.sha256}")
            _LOADED[self.sha256] = read(content)
            self.loads.add(1)
        return _LOADED[self.sha256]


def ship(spark: SparkSession, path: str, sha256: str) -> Artefact:
    """Sends the file at ``path`` (any file system that Spark reads) to the executors.

    A file's name is its identity with them: a name that was shipped before with other content is an error of Spark's.
    """
    context = spark.sparkContext
    context.addFile(path)
    return Artefact(path.rstrip("/").rsplit("/", 1)[-1], sha256, context.accumulator(0))


def score(features: DataFrame, columns: list[str], artefact: Artefact, read: Callable[[bytes], object], passthrough: list[str]) -> DataFrame:
    """``prediction`` of the artefact's model (predict(frame)) beside the passed columns, by Arrow batches and without a shuffle.

    A task without rows loads nothing.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.select(*passthrough).schema) + ", prediction double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[passthrough].copy()
            out["prediction"] = artefact.load(read).predict(frame[columns]) if len(frame) else []
            yield out

    return features.select(*dict.fromkeys([*passthrough, *columns])).mapInPandas(run, schema)
