"""Tools over the registered queries: definitions with a schema for the arguments, and calls whose answers fit a budget."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon import registry
from quillon.functions import payload


@dataclass(frozen=True)
class Tool:
    """A named query that may be filtered by equality on some of its columns."""

    name: str
    query: str
    about: str
    filters: tuple[str, ...] = ()

    def definition(self) -> dict:
        """Name, description and the JSON schema of the arguments."""
        fields = {f: {"type": ["string", "number", "boolean"]} for f in self.filters}
        limits = {"limit": {"type": "integer", "minimum": 1, "maximum": 5000}, "budget": {"type": "integer", "minimum": payload.LEAST_BUDGET}}
        return {"name": self.name, "description": self.about, "inputSchema": {"type": "object", "properties": fields | limits, "additionalProperties": False}}

    def call(self, spark: SparkSession, sf_dir: str, arguments: dict) -> dict:
        """The rows that the arguments ask for, trimmed to the budget, with what was cut."""
        if broken := payload.check(arguments, self.definition()["inputSchema"]):
            raise ValueError("; ".join(broken))
        limit, budget = arguments.get("limit", 50), arguments.get("budget", 20_000)
        df = registry.QUERIES[self.query](spark, sf_dir)
        for f in self.filters:
            if f in arguments:
                df = df.where(F.col(f).cast("string") == str(arguments[f]))
        rows = [json.loads(r["j"]) for r in df.limit(limit + 1).select(F.to_json(F.struct("*")).alias("j")).collect()]
        answer, cuts = payload.trim({"data": rows[:limit], "contract": {"query": self.query, "truncated": len(rows) > limit}}, budget)
        return answer | {"cuts": [{"path": p, "held": h, "kept": k} for p, (h, k) in sorted(cuts.items())]}


TOOLS = (
    Tool("assertions", "evidence_level", "How well each assertion is supported, and why", ("assertion_id", "level")),
    Tool("conflicts", "conflicted", "Assertions whose evidence disagrees or is missing", ("assertion_id",)),
    Tool("answer", "headline_answer", "The best strain of each tier", ("tier",)),
    Tool("search", "search_entities", "Ranked search over all kinds of entities", ("kind",)),
    Tool("routes", "route_enumerate", "Routes by strategy, with their scores", ("strategy", "cycle_size")),
    Tool("comparability", "comparability_class", "Class and standing of each context", ("standing",)),
    Tool("compare", "compare_verdict", "Whether subjects may be compared", ("verdict",)),
    Tool("bounds", "bound_check", "Yields against their theoretical maximum", ("verdict",)),
    Tool("steps", "step_verdict", "What contrasts say of each step", ("verdict",)),
    Tool("coverage", "coverage_state", "What is populated and what waits", ("entity",)),
    Tool("absences", "absences", "What is known to be missing", ("kind",)),
)


def by_name(tools: tuple[Tool, ...] = TOOLS) -> dict[str, Tool]:
    """Tools by name; a name that stands twice is an error."""
    out = {t.name: t for t in tools}
    if len(out) != len(tools):
        raise ValueError("two tools have one name")
    return out
