"""Control of runs on the driver: cancelling with clean-up, tries with growing pauses, checks of paths."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import SparkSession

Result = TypeVar("Result")


class Termination:
    """A run that can be ended: `end` cancels the Spark jobs started inside it and calls what was registered, the last first,
    once, whatever one of them raises."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.ended = spark, f"run-{uuid.uuid4().hex}", False
        self._after: list[Callable[[], object]] = []

    def register(self, f: Callable[[], object]) -> None:
        if not callable(f):
            raise TypeError("what is registered must be callable")
        self._after.append(f)

    def __enter__(self) -> Termination:
        self.spark.addTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.spark.removeTag(self.tag)
        self._clean()

    def end(self) -> None:
        if not self.ended:
            self.ended = True
            self.spark.interruptTag(self.tag)
            self._clean()

    def _clean(self) -> None:
        while self._after:
            try:
                self._after.pop()()
            except Exception:
                logging.getLogger(__name__).exception("clean-up failed")


def retried(f: Callable[[], Result], tries: int = 3, pause: float = 1.0, factor: float = 2.0, errors: type[Exception] | tuple = Exception, sleep=time.sleep) -> Result:
    """f(), tried again after pause, pause * factor, ... seconds; the last error is raised. Spark tries tasks again by itself."""
    for k in range(max(tries, 1)):
        try:
            return f()
        except errors:
            if k + 1 >= tries:
                raise
            sleep(pause * factor**k)
    raise AssertionError


def valid_file(path: str | Path, extensions: tuple[str, ...] = ()) -> bool:
    """Whether path is a file with one of the extensions (lower-case, with the dot; none for any)."""
    at = Path(path)
    return at.is_file() and (not extensions or at.suffix.lower() in extensions)


def valid_folder(path: str | Path, create: bool = False) -> bool:
    """Whether path is a folder; with create it is made, with those above it, if it is not there."""
    at = Path(path)
    if create and not at.exists():
        at.mkdir(parents=True, exist_ok=True)
    return at.is_dir()
