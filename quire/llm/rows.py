"""Row numbers that stay the same each time a table is read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire import scratch

#: The steps of a plan whose rows come in the same partitions and the same order each time it runs.
_STEADY = {"FileSourceScanExec", "ColumnarToRowExec", "WholeStageCodegenExec", "InputAdapter", "ProjectExec", "FilterExec"}


def _steps(plan) -> set[str]:
    """The kinds of a physical plan's steps; its text holds places and columns besides, such as the InMemoryFileIndex of every scan."""
    children = plan.children()
    return {plan.getClass().getSimpleName()}.union(*(_steps(children.apply(i)) for i in range(children.size())))


def steady(docs: DataFrame) -> DataFrame:
    """``docs`` itself where it is a plain scan of files, else its rows written to the shared folder, so that row numbers tell the same rows apart in every job."""
    return docs if _steps(docs._jdf.queryExecution().executedPlan()) <= _STEADY else scratch.materialize(docs, "rows")
