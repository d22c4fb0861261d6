"""Outputs that are replaced whole or not at all.

A writer fills a folder beside the output, named so that readers of the folder above pass
over it. Only when the job has succeeded do the folders change places: the output is
renamed to a spare, the new folder to the output, the spare deleted. A job that fails, or
reads the output it is about to replace, leaves it as it was.

Between the two renames lies an instant in which a driver can die. The spare then holds
the old rows, and ``standing`` finds them: readers of this package ask it for the folder,
and the next writer puts the spare back. One writer at a time may replace an output. On a
store without renames of folders the second rename copies, and a table format serves better.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_NEW, _SPARE = ".new", ".spare"


class _Place:
    """An output path, the folders beside it, and the file system that holds them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        at = self.Path(path)
        self.files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.at = self.files.makeQualified(at)
        self.name, self.above = self.at.getName(), self.at.getParent()

    def beside(self, run: str, kind: str):
        return self.Path(self.above, f".{self.name}.{run}{kind}")

    def exists(self) -> bool:
        return self.files.exists(self.at)

    def spares(self) -> list:
        """Earlier outputs that a dead driver left, the youngest last."""
        if not self.files.exists(self.above):
            return []
        found = [
            s for s in self.files.listStatus(self.above)
            if s.getPath().getName().startswith(f".{self.name}.") and s.getPath().getName().endswith(_SPARE)
        ]
        return [s.getPath() for s in sorted(found, key=lambda s: s.getModificationTime())]

    def move(self, source, target) -> None:
        try:
            done = self.files.rename(source, target)
        except Py4JJavaError as error:
            raise OSError(f"Cannot rename {source} to {target}") from error
        if not done:
            raise OSError(f"Cannot rename {source} to {target}")

    def delete(self, path) -> None:
        self.files.delete(path, True)


def standing(spark: SparkSession, path: str) -> str:
    """Where the rows of an output are: ``path``, or what a dead driver moved aside."""
    if any(c in path for c in "*?[{"):
        return path
    place = _Place(spark, path)
    if place.exists():
        return path
    spares = place.spares()
    return spares[-1].toString() if spares else path


@contextmanager
def replacing(spark: SparkSession, path: str) -> Iterator[str]:
    """The folder (or file) to write; it takes the place of ``path`` when the block ends well.

        with replacing(spark, path) as target:
            df.write.parquet(target)
    """
    place = _Place(spark, path)
    spares = place.spares()
    if spares and not place.exists():
        place.move(spares.pop(), place.at)
    for left in spares:
        place.delete(left)
    run = uuid.uuid4().hex
    new, spare = place.beside(run, _NEW), place.beside(run, _SPARE)
    try:
        yield new.toString()
        _swap(place, new, spare)
    except BaseException:
        place.delete(new)
        raise


def _swap(place: _Place, new, spare) -> None:
    had = place.exists()
    if had:
        place.move(place.at, spare)
    try:
        place.move(new, place.at)
    except BaseException:
        if had:
            place.move(spare, place.at)
        raise
    if had:
        place.delete(spare)
