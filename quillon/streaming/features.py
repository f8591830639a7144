"""Streaming twins of feature reading and of the line service."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def flush_genes(features: DataFrame, reach: int, late: int = 0) -> DataFrame:
    """(seqid, owner, start, end, features) of genes from a stream of lines (seqid, line, owner, start, end), each as soon as
    its sequence's lines have gone `reach` bases beyond it.

    Lines are applied by their number, in whatever order they come: a sequence's lines wait in a list until a line `late`
    numbers further on has been seen, so those that come up to that much late still take their place; with 0, what
    comes together is sorted. State is the waiting lines and the open genes; the position in the sequence is the
    watermark. A line without an owner, which closes all features before it, gives out all that is open, and the lines
    that wait before it with it. A feature of a gene that was given out opens it anew.
    """
    state = "owner array<string>, start array<long>, end array<long>, n array<long>, line array<long>, next_owner array<string>, next_start array<long>, next_end array<long>, seen long"

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        *old, seen = held.get if held.exists else ([], [], [], [], [], [], [], [], -1)
        genes = {o: [s, e, n] for o, s, e, n in zip(*old[:4])}
        waiting = list(zip(*old[4:8]))
        for pdf in batches:
            owners = [None if pd.isna(o) else o for o in pdf["owner"]]
            waiting += zip(pdf["line"].tolist(), owners, pdf["start"].fillna(-1).astype(int).tolist(), pdf["end"].fillna(-1).astype(int).tolist())
        waiting.sort(key=lambda x: x[0])
        seen = max([seen, *(x[0] for x in waiting)])
        ripe = [x for x in waiting if x[0] <= seen - late]
        waiting = waiting[len(ripe) :]
        rows: list[tuple] = []
        at = 0
        for _, owner, start, end in ripe:
            if owner is None:
                rows += [(key[0], o, *g) for o, g in genes.items()]
                genes = {}
                continue
            gone = [o for o, g in genes.items() if g[1] + reach < start and o != owner]
            rows += [(key[0], o, *genes.pop(o)) for o in gone]
            gene = genes.setdefault(owner, [start, end, 0])
            gene[:] = [min(gene[0], start), max(gene[1], end), gene[2] + 1]
            at = max(at, start)
        rows += [(key[0], o, *genes.pop(o)) for o in [o for o, g in genes.items() if g[1] + reach < at]]
        if genes or waiting or late:
            lines = [list(c) for c in zip(*waiting)] if waiting else [[], [], [], []]
            held.update((list(genes), *([g[i] for g in genes.values()] for i in range(3)), *lines, seen))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(sorted(rows), columns=["seqid", "owner", "start", "end", "features"])

    out = "seqid string, owner string, start long, end long, features long"
    return features.groupBy("seqid").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def answer(line: str, tools: dict[str, Callable[[dict], object]]) -> str | None:
    """One line of a JSON-RPC stream: the answer, or None for a notification. Errors are answers with codes."""

    def reply(i: object, **rest: object) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": i, **rest}, default=str)

    try:
        message = json.loads(line)
    except ValueError:
        return reply(None, error={"code": -32700, "message": "no JSON"})
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return reply(message.get("id") if isinstance(message, dict) else None, error={"code": -32600, "message": "no request"})
    if "id" not in message:
        return None
    name, i = message["method"], message["id"]
    if name == "tools/list":
        return reply(i, result={"tools": sorted(tools)})
    call = message.get("params") or {}
    tool = tools.get(call.get("name", "")) if name == "tools/call" else None
    if tool is None:
        return reply(i, error={"code": -32601, "message": f"no method {name}" if name != "tools/call" else f"no tool {call.get('name')}"})
    try:
        return reply(i, result=tool(call.get("arguments") or {}))
    except (ValueError, KeyError, TypeError) as e:
        return reply(i, error={"code": -32602, "message": str(e)})


def serve(lines: DataFrame, tools: dict[str, Callable[[dict], object]]) -> DataFrame:
    """Answers (value) to a stream or table of request lines (value), on the executors; tools are plain functions."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else answer(x, tools))

    return lines.select(run("value").alias("value")).where("value IS NOT NULL")
