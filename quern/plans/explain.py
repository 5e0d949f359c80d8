"""Views of a query: its syntax as a graph, its Spark SQL, its Catalyst plans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quern.sql import syntax as S


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What ``df.explain(mode)`` prints."""
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


STAGES = {"resolved": "analyzed", "logical": "optimizedPlan", "physical": "executedPlan"}


def plan_dot(df: DataFrame, stage: str = "physical") -> str:
    """A plan of Catalyst in the DOT language: ``resolved``, ``logical`` or ``physical``.

    A node per operator with what it does; subqueries hang on by dashed lines. Adaptive
    plans are drawn as they are before the first stage has run.
    """
    if stage not in STAGES:
        raise ValueError(f"stage must be one of {', '.join(STAGES)}")
    lines = [f"digraph {stage} {{", '  node [shape="box"];']
    numbers = iter(range(1_000_000))

    def members(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def add(node) -> int:
        at, name = next(numbers), node.nodeName()
        label = node.simpleString(1000).replace("\\", "\\\\").replace('"', "'")
        lines.append(f'  n{at} [label="{label[:300]}"];')
        below, inner = members(node.children()), members(node.innerChildren())
        if name == "AdaptiveSparkPlan":
            below, inner = [node.initialPlan()], []
        for child, style in (*((c, "") for c in below), *((c, ' [style="dashed"]') for c in inner)):
            lines.append(f"  n{at} -> n{add(child)}{style};")
        return at

    add(getattr(df._jdf.queryExecution(), STAGES[stage])())
    return "\n".join([*lines, "}"])


def syntax_dot(query: S.Query) -> str:
    """The syntax tree in the DOT language, a node per operator or clause."""
    lines = ["digraph query {", '  node [shape="box"];']

    def add(node: object) -> int | None:
        if not hasattr(node, "__dataclass_fields__"):
            return None
        at = len(lines)
        plain = [f"{f}={getattr(node, f)}" for f in node.__dataclass_fields__ if isinstance(getattr(node, f), (str, int, bool)) and getattr(node, f) is not False]
        label = " ".join([type(node).__name__, *plain]).replace('"', "'")
        lines.append(f'  n{at} [label="{label}"];')
        for f in node.__dataclass_fields__:
            children = [getattr(node, f)]
            while children:
                child = children.pop(0)
                if isinstance(child, tuple):
                    children = [*child, *children]
                elif (to := add(child)) is not None:
                    lines.append(f'  n{at} -> n{to} [label="{f}"];')
        return at

    add(query)
    return "\n".join([*lines, "}"])
