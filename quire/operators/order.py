"""Reading order as a tournament: every pair of a page's elements has one edge, and where these make no cycle the order is that of in-degrees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quire.checkpoints import cut
from quire.functions import geometry as geo

from .layout import PAGE


def before(a: str = "a_", b: str = "b_") -> Column:
    """Whether the earlier row ``a`` is read before ``b``: by zone, then down a column, along a row, and by the last resorts."""
    x, y = geo.box(a), geo.box(b)
    (ax, ay), (bx, by) = geo.centre(x), geo.centre(y)
    pa, pb = F.col(f"{a}priority"), F.col(f"{b}priority")
    return (
        F.when(pa != pb, pa < pb)
        .when((geo.horizontal_overlap(x, y) > 0.3) & (F.abs(ay - by) > 5), ay < by)
        .when((geo.vertical_overlap(x, y) > 0.3) & (F.abs(ax - bx) > 5), ax < bx)
        .when(x.y2 < y.y1, F.lit(True))
        .when(F.abs(x.y1 - y.y1) < geo.height(x) * 0.5, ax < bx)
        .otherwise(ay < by)
    )


def _numbered(elements: DataFrame, by: list[str]) -> DataFrame:
    order = W.partitionBy(*by).orderBy("page_number", "seq") if "page_number" not in by else W.partitionBy(*by).orderBy("seq")
    priority = F.col("zone_priority") if "zone_priority" in elements.columns else F.lit(5)
    return elements.withColumn("idx", F.row_number().over(order) - 1).withColumn("priority", priority)


def edges(elements: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(page, src, dst) over row numbers, one for each pair."""
    by = by or PAGE
    rows = _numbered(elements, by)
    side = lambda p: rows.select(*by, *[F.col(c).alias(p + c) for c in ("idx", "priority", "x1", "y1", "x2", "y2")])
    pairs = side("a_").join(side("b_"), by).where("a_idx < b_idx").withColumn("ahead", before())
    return pairs.select(*by, F.when(F.col("ahead"), F.col("a_idx")).otherwise(F.col("b_idx")).alias("src"), F.when(F.col("ahead"), F.col("b_idx")).otherwise(F.col("a_idx")).alias("dst"))


def in_degrees(elements: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The numbered rows with how many others are read before each, and whether the page's edges have a cycle."""
    by = by or PAGE
    rows = _numbered(elements, by)
    counted = edges(elements, by).groupBy(*by, F.col("dst").alias("idx")).agg(F.count("*").alias("n"))
    out = rows.join(counted, [*by, "idx"], "left").withColumn("in_degree", F.coalesce("n", F.lit(0)).cast("int")).drop("n")
    # Of a tournament's in-degrees, only those without a cycle are 0, 1, 2, ...
    per = W.partitionBy(*by)
    return out.withColumn("same", F.count("*").over(W.partitionBy(*by, "in_degree"))).withColumn("cyclic", F.max("same").over(per) > 1).drop("same")


def has_cycles(elements: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or PAGE
    return in_degrees(elements, by).groupBy(*by).agg(F.max("cyclic").alias("cyclic"))


def _untangled(rows: pd.DataFrame) -> pd.DataFrame:
    """One cyclic page: of each cycle that is found the edge whose upper side rises most is dropped, then the topological order, ties by place."""
    rows = rows.sort_values("idx").reset_index(drop=True)
    n, y = len(rows), rows[["x1", "y1", "x2", "y2"]].to_numpy()
    after = [set() for _ in range(n)]
    for s, below in enumerate(rows["below"]):
        after[s].update(int(d) for d in below)

    def cycle() -> list[int] | None:
        state = [0] * n
        for root in range(n):
            if state[root]:
                continue
            path, todo = [root], [iter(sorted(after[root]))]
            state[root] = 1
            while path:
                nxt = next(todo[-1], None)
                if nxt is None:
                    state[path.pop()] = 2
                    todo.pop()
                elif state[nxt] == 1:
                    return path[path.index(nxt) :]
                elif not state[nxt]:
                    state[nxt] = 1
                    path.append(nxt)
                    todo.append(iter(sorted(after[nxt])))
        return None

    while found := cycle():
        s, d = max(zip(found, found[1:] + found[:1]), key=lambda e: y[e[0], 1] - y[e[1], 1])
        after[s].discard(d)
    waits = [0] * n
    for s in range(n):
        for d in after[s]:
            waits[d] += 1
    place = lambda i: (y[i, 1], y[i, 0])  # noqa: E731  # of equals the one that was free first
    ready, order = sorted((i for i in range(n) if not waits[i]), key=place), []
    while ready:
        i = ready.pop(0)
        order.append(i)
        fresh = []
        for d in sorted(after[i]):
            waits[d] -= 1
            if not waits[d]:
                fresh.append(d)
        ready = sorted(ready + fresh, key=place)
    rank = {i: r for r, i in enumerate(order)}
    rows["read_idx"] = [rank[i] for i in range(n)]
    return rows


def reading_order(elements: DataFrame, compat: str = "page") -> DataFrame:
    """``elements`` with read_idx from 0 within each page, or with ``compat="document"`` within each document at once.

    Pages without a cycle, nearly all, are ranked by in-degree; only the others are gathered and untangled one by one.
    """
    by = PAGE if compat == "page" else PAGE[:1]
    columns = elements.columns
    rows = cut(in_degrees(elements, by))
    plain = rows.where(~F.col("cyclic")).select(*columns, F.col("in_degree").alias("read_idx"))
    knots = rows.where("cyclic")
    below = edges(knots.select(columns), by).groupBy(*by, F.col("src").alias("idx")).agg(F.collect_list("dst").alias("below"))
    gathered = knots.join(below, [*by, "idx"], "left").select(*columns, "idx", F.coalesce("below", F.array().cast("array<int>")).alias("below"))
    schema = T.StructType([*gathered.schema.fields, T.StructField("read_idx", T.IntegerType())])
    untangled = gathered.groupBy(*by).applyInPandas(_untangled, schema).select(*columns, "read_idx")
    return plain.unionByName(untangled)


def document_order(ordered: DataFrame) -> DataFrame:
    """``ordered`` with doc_idx: pages one after another."""
    return ordered.withColumn("doc_idx", F.row_number().over(W.partitionBy(PAGE[0]).orderBy("page_number", "read_idx")) - 1)
