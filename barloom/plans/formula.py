"""Factor formulas: a small JSON tree becomes one Column, checked before anything runs.

Nodes: {"field": name}, {"const": number}, {"op": "+", "args": [a, b]}, {"call": name, "args": [...], "n": rows}.
Only past rows can be reached: there is no call that looks ahead, and lags are positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import windows as w

FIELDS = ("open", "high", "low", "close", "volume")
BINARY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": w.ratio,
    ">": lambda a, b: (a > b).cast("double"), "<": lambda a, b: (a < b).cast("double"),
}
UNARY = {"abs": F.abs, "sign": F.signum, "tanh": F.tanh, "log": lambda a: F.when(a > 0, F.log(a)), "neg": lambda a: -a}
ROLLING = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum}
MOST_DEPTH, MOST_NODES = 32, 128


def check(node: dict, depth: int = 1) -> int:
    """The number of nodes of a tree; raises ValueError for whatever is not allowed."""
    if not isinstance(node, dict) or depth > MOST_DEPTH:
        raise ValueError("too deep, or not a node")
    if "field" in node:
        if set(node) != {"field"} or node["field"] not in FIELDS:
            raise ValueError(f"unknown field: {node}")
        return 1
    if "const" in node:
        if set(node) != {"const"} or isinstance(node["const"], bool) or not isinstance(node["const"], (int, float)):
            raise ValueError(f"not a number: {node}")
        return 1
    args = node.get("args", [])
    if "op" in node:
        if set(node) != {"op", "args"} or node["op"] not in BINARY or len(args) != 2:
            raise ValueError(f"unknown operation: {node.get('op')}")
    elif "call" in node:
        name, n = node["call"], node.get("n")
        if name in UNARY:
            good = len(args) == 1 and set(node) == {"call", "args"}
        elif name in ROLLING or name in ("lag", "rank"):
            good = len(args) == 1 and (name == "rank" or isinstance(n, int) and not isinstance(n, bool) and n > 0) and set(node) <= {"call", "args", "n"}
        else:
            good = False
        if not good:
            raise ValueError(f"unknown call, or it looks ahead: {name}({n})")
    else:
        raise ValueError(f"unknown node: {sorted(node)}")
    total = 1 + sum(check(a, depth + 1) for a in args)
    if total > MOST_NODES:
        raise ValueError("too many nodes")
    return total


def evaluate(bars: DataFrame, tree: dict, out: str = "value") -> DataFrame:
    """Bars with the formula's value. Windows inside windows become steps of one plan; equal subtrees are worked out once."""
    check(tree)
    steps: list[tuple[str, Column]] = []
    names: dict[str, str] = {}

    def build(node: dict) -> Column:
        if "field" in node:
            return F.col(node["field"])
        if "const" in node:
            return F.lit(float(node["const"]))
        args = [build(a) for a in node["args"]]
        if "op" in node:
            return BINARY[node["op"]](*args)
        if node["call"] in UNARY:
            return UNARY[node["call"]](args[0])
        key = repr(node)
        if key not in names:
            inner, names[key] = f"f{len(steps)}_", f"f{len(steps) + 1}_"
            steps.append((inner, args[0]))
            x = F.col(inner)
            value = w.percent_rank(x) if node["call"] == "rank" else w.lag(x, node["n"]) if node["call"] == "lag" else w.rolling(ROLLING[node["call"]], x, node["n"])
            steps.append((names[key], value))
        return F.col(names[key])

    final = build(tree)
    df = bars
    for name, column in steps:
        df = df.withColumn(name, column)
    return df.withColumn(out, final).drop(*[n for n, _ in steps])
