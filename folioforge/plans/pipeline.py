"""Stages with dependencies: what to run again, in which order, with results kept as tables; cancellation by tag."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """A function of the tables of its needs, by name."""

    name: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()


@dataclass
class Pipeline:
    """Stages by name; tables are written below `root`, and a stage whose table is there isn't run again unless asked for."""

    spark: SparkSession
    root: str
    stages: dict[str, Stage] = field(default_factory=dict)
    ran: list[str] = field(default_factory=list)

    def add(self, name: str, run: Callable[..., DataFrame], *needs: str) -> None:
        for n in needs:
            if n not in self.stages:
                raise ValueError(f"{name} needs {n}, which isn't there")
        self.stages[name] = Stage(name, run, needs)

    def order(self, wanted: str) -> list[str]:
        """The stages that `wanted` rests on, and itself, each after its needs."""
        out: list[str] = []

        def visit(name: str) -> None:
            for n in self.stages[name].needs:
                visit(n)
            if name not in out:
                out.append(name)

        visit(wanted)
        return out

    def dependents(self, changed: str) -> set[str]:
        """The stages whose tables are out of date once `changed` has run again."""
        out: set[str] = set()
        for s in self.stages.values():  # needs come before what needs them
            if changed in s.needs or out & set(s.needs):
                out.add(s.name)
        return out

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def done(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name) + "/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def table(self, wanted: str, force: bool = False, tag: str | None = None) -> DataFrame:
        """The table of a stage. What it rests on is run if it isn't there; with `force` the stage itself runs again, and what rests on it is forgotten.

        With a tag, the jobs can be cancelled from another thread: spark.sparkContext.cancelJobsWithTag(tag).
        """
        sc = self.spark.sparkContext
        if tag:
            sc.addJobTag(tag)
        try:
            for name in self.order(wanted):
                if self.done(name) and not (force and name == wanted):
                    continue
                stage = self.stages[name]
                made = stage.run(*(self.spark.read.parquet(self.path(n)) for n in stage.needs))
                made.write.mode("overwrite").parquet(self.path(name))
                self.ran.append(name)
                for d in self.dependents(name):
                    self.forget(d)
        finally:
            if tag:
                sc.removeJobTag(tag)
        return self.spark.read.parquet(self.path(wanted))

    def forget(self, name: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
