"""Genealogies as Newick text with migration and divergence comments, to and from edge tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..ship import ship

EDGES = "node int, parent int, name string, type string, time double, pop_from int, pop_to int"


def parse(text: str) -> list[dict]:
    """Edges of one tree: a row a node. ``[&M from to:length]`` after a node is a migration above it, ``[&D ...]`` a
    divergence; each becomes a node with one child. Times count back from the tips, the youngest at 0."""
    tokens = re.findall(r"\[&[MDR][^\]]*\]|\[[^\]]*\]|[(),;]|:\s*[-+0-9.eE]+|[^\s(),:;\[\]]+", text)
    nodes: list[dict] = []
    stack: list[list[int]] = [[]]

    def add(kind, children, name=None, a=None, b=None):
        nodes.append({"node": len(nodes), "parent": None, "name": name, "type": kind, "length": 0.0, "pop_from": a, "pop_to": b})
        for c in children:
            nodes[c]["parent"] = len(nodes) - 1
        return len(nodes) - 1

    before = ""
    for t in tokens:
        before, last = t, before
        if t == "(":
            stack.append([])
        elif t == ")":
            children = stack.pop()
            stack[-1].append(add("i", children))
        elif t in ",;":
            continue
        elif t.startswith(":"):
            if stack[-1]:
                nodes[stack[-1][-1]]["length"] += float(t[1:])
        elif m := re.match(r"\[&([MD])\s+(\d+)\s+(\d+)\s*:\s*([-+0-9.eE]+)", t):
            child = stack[-1].pop()
            stack[-1].append(add("m" if m[1] == "M" else "d", [child], None, int(m[2]), int(m[3])))
            nodes[stack[-1][-1]]["length"] = float(m[4])
        elif t.startswith("["):
            continue
        elif last == ")":  # the name or support of an inner node
            if not re.match(r"\d", t):
                nodes[stack[-1][-1]]["name"] = t
        else:
            stack[-1].append(add("t", [], t))
    depth = [0.0] * len(nodes)
    for n in reversed(nodes):  # parents come after their children
        if n["parent"] is not None:
            depth[n["node"]] = depth[n["parent"]] + n["length"]
    far = max(depth, default=0.0)
    return [{**{k: n[k] for k in ("node", "parent", "name", "type", "pop_from", "pop_to")}, "time": far - depth[n["node"]]} for n in nodes]


def write(edges: list[dict]) -> str:
    """Newick text of the edges of one tree."""
    children: dict[int | None, list[dict]] = {}
    for e in edges:
        children.setdefault(None if e["parent"] is None or pd.isna(e["parent"]) else int(e["parent"]), []).append(e)
    time = {e["node"]: e["time"] for e in edges}

    done: dict[int, str] = {}
    below = lambda e: sorted(children.get(e["node"], []), key=lambda x: x["node"])
    root = children[None][0]
    order, open_ = [], [root]
    while open_:  # parents before their children
        order.append(open_.pop())
        open_ += below(order[-1])
    for e in reversed(order):
        length = "" if e["parent"] is None or pd.isna(e["parent"]) else f"{time[int(e['parent'])] - e['time']:.10g}"
        own = [done.pop(x["node"]) for x in below(e)]
        if e["type"] in "md":
            done[e["node"]] = f"{own[0]} [&{e['type'].upper()} {int(e['pop_from'])} {int(e['pop_to'])}:{length}]"
        else:
            inner = f"({','.join(own)})" if own else e["name"]
            done[e["node"]] = f"{inner}:{length}" if length else inner
    return done[root["node"]] + ";"


def edges_of_trees(trees: DataFrame) -> DataFrame:
    """(tree, text) -> edge rows of every tree."""
    ship(trees.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"tree": k, **e} for k, t in zip(b["tree"], b["text"], strict=True) for e in parse(t)]
            d = pd.DataFrame(rows, columns=["tree", "node", "parent", "name", "type", "time", "pop_from", "pop_to"])
            yield d.astype({"parent": "Int32", "pop_from": "Int32", "pop_to": "Int32"})

    return trees.mapInPandas(run, f"tree long, {EDGES}")


def trees_of_edges(edges: DataFrame) -> DataFrame:
    """Edge rows -> (tree, text); a tree is one group."""
    ship(edges.sparkSession)

    def one(d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": [d["tree"].iloc[0]], "text": [write(d.to_dict("records"))]})

    return edges.groupBy("tree").applyInPandas(one, "tree long, text string")
