"""A plan as text, without the vectors that its literals hold, and with what its execution measured."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

_VECTOR = re.compile(r"\[-?\d[-+.\deE, ]{40,}\]")


def elided(text: str) -> str:
    """``text`` with each literal of many numbers named by how many they are."""
    return _VECTOR.sub(lambda m: f"[{m[0].count(',') + 1} numbers]", text)


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What ``explain`` prints, vectors elided: the plan before it runs."""
    kind = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return elided(df._jdf.queryExecution().explainString(kind))


@dataclass(frozen=True)
class Step:
    """One operator of a finished plan.

    ``rows`` it passed on and, for a filter, ``removed`` ones; null where Spark counts none.
    ``metrics`` are Spark's own, times in milliseconds.
    """

    depth: int
    name: str
    text: str
    rows: int | None
    removed: int | None
    metrics: dict[str, int] = field(hash=False)


def _metrics(node) -> dict[str, int]:
    out, each = {}, node.metrics().iterator()
    while each.hasNext():
        pair = each.next()
        value, kind = pair._2().value(), pair._2().metricType()
        if value > 0 or pair._1() == "numOutputRows":
            out[pair._1()] = value // 1_000_000 if kind == "nsTiming" else value
    return out


def _walk(node, depth: int) -> Iterator[tuple[int, object]]:
    """Operators from the top, stages and generated code opened, so that every level is one that was planned."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _walk(node.executedPlan(), depth)
    elif name.endswith("QueryStageExec"):
        yield from _walk(node.plan(), depth)
    elif name in ("WholeStageCodegenExec", "InputAdapter"):
        yield from _walk(node.child(), depth)
    else:
        yield depth, node
        children = node.children()
        for k in range(children.size()):
            yield from _walk(children.apply(k), depth + 1)


def measured(df: DataFrame) -> list[Step]:
    """Run ``df`` to its end and return what each operator of the plan that ran, after adaptive replanning, measured.

    Rows are read to the driver and thrown away, so give it a result that fits there.
    """
    df.collect()
    nodes = list(_walk(df._jdf.queryExecution().executedPlan(), 0))
    found = [(depth, node, _metrics(node)) for depth, node in nodes]
    out = []
    for k, (depth, node, metrics) in enumerate(found):
        rows, removed = metrics.get("numOutputRows"), None
        if node.nodeName() == "Filter" and rows is not None:
            # what it read is what the next counting operator passed on, if only operators that keep rows lie between
            at = next((j for j in range(k + 1, len(found)) if found[j][1].nodeName() not in ("Project", "ColumnarToRow")), k)
            removed = found[at][2]["numOutputRows"] - rows if "numOutputRows" in found[at][2] and at > k else None
        out.append(Step(depth, node.nodeName(), elided(node.simpleString(400)), rows, removed, metrics))
    return out


def measured_text(df: DataFrame) -> str:
    """``measured`` as lines: the operator, its rows, those a filter removed, and its times."""
    lines = []
    for s in measured(df):
        counts = [f"{s.rows} rows"] if s.rows is not None else []
        counts += [f"{s.removed} removed"] if s.removed is not None else []
        counts += [f"{k} {v} ms" for k, v in sorted(s.metrics.items()) if k.lower().endswith("time")]
        lines.append("  " * s.depth + s.name + (f" ({', '.join(counts)})" if counts else ""))
    return "\n".join(lines)
