"""Newick text to a table of nodes and back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "node int, parent int, depth int, name string, weight double, is_leaf boolean"


def parse(text: str) -> list[tuple]:
    """Rows (node, parent, depth, name, weight, is_leaf) in preorder from root 0; a root's parent and a missing weight are None.

    Errors: no data, no closing semicolon, unbalanced brackets, a weight that is no number.
    """
    text = text.strip()
    if not text:
        raise ValueError("no data")
    if not text.endswith(";"):
        raise ValueError("not terminated")
    rows: list[list] = [[0, None, 0, "", None, True]]
    now, label, open_ = 0, [], 0

    def close_label() -> None:
        name, colon, weight = "".join(label).strip().partition(":")
        rows[now][3] = name.strip()
        if colon:
            rows[now][4] = float(weight)
        label.clear()

    def child(of: int) -> int:
        rows.append([len(rows), of, rows[of][2] + 1, "", None, True])
        rows[of][5] = False
        return len(rows) - 1

    for c in text[:-1]:
        if c == "(":
            if "".join(label).strip() or not rows[now][5]:
                raise ValueError("unparsed text before (")
            label.clear()
            open_ += 1
            now = child(now)
        elif c in ",)":
            if not open_:
                raise ValueError(f"unexpected {c}")
            close_label()
            now = rows[now][1]
            if c == ",":
                now = child(now)
            else:
                open_ -= 1
        else:
            label.append(c)
    if open_:
        raise ValueError("expected )")
    close_label()
    return [tuple(r) for r in rows]


def nodes(texts: DataFrame) -> DataFrame:
    """tree_id and the node columns for each row (tree_id, text)."""
    kinds = [x.split() for x in NODES.split(", ")]

    @F.pandas_udf("array<struct<" + ",".join(f"{n}:{k}" for n, k in kinds) + ">>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [dict(zip((n for n, _ in kinds), r, strict=True)) for r in parse(t)])

    return texts.select("tree_id", F.inline(run("text")))


def text(nodes: DataFrame) -> DataFrame:
    """tree_id, text from (tree_id, node, parent, name, weight); children in order of their numbers.

    A tree's text is one value, so a tree is one group; trees run apart.
    """

    def run(table: pd.DataFrame) -> pd.DataFrame:
        kids: dict[int, list[int]] = {}
        label, root = {}, None
        for node, parent, name, weight in zip(table["node"], table["parent"], table["name"], table["weight"], strict=True):
            tail = "" if pd.isna(weight) else f":{weight:g}"
            label[node] = (name if isinstance(name, str) else "") + tail
            if pd.isna(parent):
                root = node
            else:
                kids.setdefault(int(parent), []).append(node)
        out, todo = [], [(root, False)]
        while todo:
            node, done = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif done or node not in kids:
                out.append((")" if done else "") + label[node])
            else:
                out.append("(")
                todo.append((node, True))
                mine = sorted(kids[node])
                for k, child in reversed(list(enumerate(mine))):
                    todo.append((child, False))
                    if k:
                        todo.append((",", False))
        return pd.DataFrame({"tree_id": [table["tree_id"].iloc[0]], "text": ["".join(out) + ";"]})

    kind = nodes.schema["tree_id"].dataType.simpleString()
    columns = nodes.select("tree_id", "node", "parent", "name", F.col("weight").cast("double"))
    return columns.groupBy("tree_id").applyInPandas(run, f"tree_id {kind}, text string")
