"""Adapters for whole tables: a graph parser over sentences, and a lookup service over queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (nodes as (id, label), edges as (parent, role, child), alignments as (node, token), root), or None
Graph = tuple[list[tuple[str, str]], list[tuple[str, str, str]], list[tuple[str, int]], str] | None

#: Sentences that the parser gets at once: their graphs take many times their memory.
SENTENCES = 128


def parse_graphs(sentences: DataFrame, load: Callable[[], Callable[[list[list[str]]], list[Graph]]]) -> dict[str, DataFrame]:
    """Tables nodes, edges, alignments and graphs from (graph_id, tokens), by a parser that each worker loads once.

    A sentence for which the parser gives None or no node has no graph.
    """
    kind = "graph_id string, root string, nodes array<struct<id:string,label:string>>, edges array<struct<p:string,r:string,c:string>>, aligned array<struct<n:string,t:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = load()
        for df in batches:
            for k in range(0, len(df), SENTENCES):
                rows, some = [], df.iloc[k : k + SENTENCES]
                for g, found in zip(some["graph_id"], parser([list(t) for t in some["tokens"]]), strict=True):
                    if found and found[0]:
                        n, e, a, root = found
                        rows.append((g, root, [{"id": i, "label": x} for i, x in n], [{"p": p, "r": r, "c": c} for p, r, c in e], [{"n": i, "t": t} for i, t in a]))
                yield pd.DataFrame(rows, columns=["graph_id", "root", "nodes", "edges", "aligned"])

    g = sentences.select("graph_id", "tokens").mapInPandas(run, kind)
    part = lambda c: g.select("graph_id", F.posexplode(c).alias("ord", "x"))
    return {
        "graphs": g.select("graph_id", "root"),
        "nodes": part("nodes").select("graph_id", F.col("x.id").alias("node_id"), "ord", F.col("x.label").alias("label")),
        "edges": part("edges").select("graph_id", "ord", F.col("x.p").alias("parent"), F.col("x.r").alias("role"), F.col("x.c").alias("child")),
        "alignments": part("aligned").select("graph_id", "ord", F.col("x.n").alias("node_id"), F.col("x.t").alias("token_idx")),
    }


def fetch_candidates(queries: DataFrame, load: Callable[[], Callable[[str, int], list[dict]]], size: int = 20) -> DataFrame:
    """(query, ord, qnode, label, alias, description, score) from a service, by a client that each worker loads once.

    A query with a slash isn't sent. Whatever the client raises counts as no candidates, so that one failed request costs
    one query. A missing label or description is an empty text.
    """
    kind = "query string, ord int, qnode string, label array<string>, alias array<string>, description array<string>, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        for df in batches:
            rows = []
            for q in df["query"]:
                try:
                    found = ask(q, size)
                except Exception:  # noqa: BLE001  a request may fail in any way
                    found = []
                rows += [(q, k, f.get("qnode"), f.get("label") or [""], f.get("alias") or [], f.get("description") or [""], f.get("score")) for k, f in enumerate(found)]
            yield pd.DataFrame(rows, columns=["query", "ord", "qnode", "label", "alias", "description", "score"])

    return queries.select("query").distinct().where(~F.col("query").contains("/")).mapInPandas(run, kind)
