"""Versions of a model as transactions over a commit log.

A commit names all versions with their scores and those that are kept. Of two writers of one version
the first wins. A folder is deleted only when no commit that is retained names its version, so a reader
that holds on to such a commit finds all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.commits import CommitLog, Conflict
from . import incremental as I

SCHEMA = "version long, val_score double"


class VersionLog:
    def __init__(self, spark: SparkSession, out: str, keep_commits: int = 1) -> None:
        self._spark, self._log, self._keep = spark, CommitLog(spark, out), keep_commits

    def _frame(self, versions: dict[str, float]) -> DataFrame:
        return self._spark.createDataFrame([(int(v), float(s)) for v, s in versions.items()], SCHEMA)

    def pin(self) -> tuple[int, list[int]]:
        """The newest commit and the versions that it keeps."""
        at = self._log.latest()
        return at, [] if at < 0 else sorted(int(v) for v in self._log.read(at)["kept"])

    def table(self) -> DataFrame:
        """All versions ever recorded since the last restart: ``version, val_score``."""
        at = self._log.latest()
        return self._frame({} if at < 0 else self._log.read(at)["versions"])

    def record(self, version: int, score: float, keep_last: int, restart: bool = False) -> DataFrame:
        """Record a version, delete what no retained commit keeps, and return the kept versions with the reason.

        Raises :class:`Conflict` if the version has been recorded; ``restart`` begins a new list.
        """
        while True:
            at = self._log.latest()
            versions = {} if at < 0 or restart else dict(self._log.read(at)["versions"])
            if str(version) in versions:
                raise Conflict(f"version {version} of {self._log.root} is recorded")
            versions[str(version)] = float(score)
            kept = I.retained_versions(self._frame(versions), keep_last)
            names = [r["version"] for r in kept.collect()]  # at most keep_last + 1
            try:
                self._log.commit(at + 1, {"versions": versions, "kept": names})
            except Conflict:
                continue  # another version came first; look at the list again
            self._sweep()
            return kept

    def _sweep(self) -> None:
        self._log.forget(self._keep)
        commits = [self._log.read(n) for n in self._log.numbers()]
        named = {f"v{v}" for c in commits for v in c["kept"]}
        known = {f"v{v}" for c in commits for v in c["versions"]}
        for folder in self._log.folders("."):
            # folders of versions that are not recorded yet belong to their writers
            if folder in known and folder not in named:
                self._log.delete(folder)
