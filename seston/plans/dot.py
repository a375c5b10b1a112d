"""A plan's graph as DOT text."""

from __future__ import annotations

from typing import Any

from seston.plans.pipeline import Pipeline, predecessors


def to_dot(pipeline: Pipeline, path: str | None = None, rankdir: str = "TB") -> str:
    """Nodes as boxes, nested pipelines as clusters, an edge from each node to those that use its Variables; steps stand in their order."""
    lines = ["strict digraph {", f"  rankdir={rankdir};"]
    edges: list[str] = []
    seen: list[Any] = []

    def quote(text: str) -> str:
        return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'

    def visit(step: Any, depth: int) -> None:
        pad = "  " * depth
        if isinstance(step, Pipeline):
            lines.append(f"{pad}subgraph cluster_{step.id} {{")
            lines.append(f"{pad}  label={quote(step.get_label())};")
            for child in step.children:
                visit(child, depth + 1)
            lines.append(f"{pad}}}")
            return
        lines.append(f"{pad}n{step.id} [label={quote(step.get_label())}, shape=rect];")
        if seen:
            edges.append(f"  n{seen[-1].id} -> n{step.id} [style=invis];")
        seen.append(step)
        edges.extend(f"  n{p.id} -> n{step.id};" for p in predecessors(step.inputs()) if p is not step)

    for child in pipeline.children:
        visit(child, 1)
    text = "\n".join([*lines, *edges, "}"]) + "\n"
    if path is not None:
        with open(path, "w") as f:
            f.write(text)
    return text
