"""What a claim says: its events with their nodes and arguments, and the node of a mention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from .amr import labelled_arguments
from .claims import truthy_score


def roles_of(overlay_arguments: DataFrame, master_roles: DataFrame) -> DataFrame:
    """(qnode, role, text_role) from overlay arguments (qnode, ord, name) and master roles (qnode, ord, key).

    Of equal roles of a node the last one; where both tables know a node the overlay decides.
    """
    a = overlay_arguments.select("qnode", "ord", N.overlay_role(F.col("name")).alias("r")).where("r.role <> ''")
    b = master_roles.select("qnode", "ord", N.master_role(F.col("key")).alias("r"))
    last = lambda df: df.groupBy("qnode", F.col("r.role").alias("role")).agg(F.max_by("r.text_role", "ord").alias("text_role"))
    return last(a).unionByName(last(b.join(a.select("qnode").distinct(), "qnode", "left_anti")))


def roles_of_candidates(candidates: DataFrame, roles: DataFrame) -> DataFrame:
    """Roles of nodes that came from a lookup, through the overlay's key DWD_ and the node; nodes without any are left out."""
    keyed = roles.withColumn("key", F.concat(F.lit("DWD_"), F.col("qnode"))).drop("qnode")
    return candidates.withColumn("key", F.concat(F.lit("DWD_"), F.col("qnode"))).join(keyed, "key").drop("key")


def first_nodes(nodes: DataFrame) -> DataFrame:
    """(graph_id, label, node_id): the first node of each roleset label."""
    return nodes.where(T.is_roleset(F.col("label"))).groupBy("graph_id", "label").agg(F.min_by("node_id", "ord").alias("node_id"))


def mention_labels(mentions: DataFrame, nodes: DataFrame, tokens: DataFrame, alignments: DataFrame) -> DataFrame:
    """(m_id, label): of the last node, in order, whose aligned tokens hold the mention's last word that is no stop word."""
    words = F.filter(F.split("text", " "), lambda w: ~w.isin(T.STOP_WORDS))
    m = mentions.select("m_id", "graph_id", F.get(F.reverse(words), F.lit(0)).alias("word")).where("word IS NOT NULL")
    t = alignments.join(tokens.withColumnRenamed("idx", "token_idx"), ["graph_id", "token_idx"]).select("graph_id", "node_id", F.col("token").alias("word")).distinct()
    j = m.join(t, ["graph_id", "word"]).join(nodes.select("graph_id", "node_id", "label", F.col("ord").alias("n_ord")), ["graph_id", "node_id"])
    return j.groupBy("m_id").agg(F.regexp_replace(F.max_by("label", "n_ord"), '^"|"$', "").alias("label"))


def claim_events(nodes: DataFrame, edges: DataFrame, strings: DataFrame, chosen: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (graph_id, ord, pb, qnode, text, confidence) and their arguments (graph_id, event, role, text).

    chosen: (pb, qnode, score). Every node with a roleset label that has a chosen node is an event; equal labels of a graph
    all stand at the label's first node, whose clipped text is the event's. Events without any text are left out. Arguments
    are those that the node's roles allow.
    """
    pb = nodes.where(T.is_roleset(F.col("label"))).select("graph_id", "ord", F.col("label").alias("pb"))
    first = first_nodes(nodes).withColumnRenamed("label", "pb")
    text = F.array_join(T.clip(F.split(F.coalesce("text", F.lit("")), " ")), " ")
    e = pb.join(first, ["graph_id", "pb"]).join(chosen, "pb").join(strings, ["graph_id", "node_id"], "left").withColumn("text", text).where("text <> ''")
    events = e.select("graph_id", "ord", "pb", "node_id", "qnode", "text", truthy_score(F.col("score")).alias("confidence"))
    where = events.select("graph_id", F.col("node_id").alias("event"), "qnode").distinct()
    allowed = where.join(roles, "qnode").select("graph_id", "event", "role").distinct()
    return events, labelled_arguments(nodes, edges, strings, where.select("graph_id", "event").distinct(), allowed)


def best_option(options: DataFrame) -> DataFrame:
    """(query, qnode, score) by linking score; only scores over 0, ties in order."""
    return options.where("score > 0").groupBy("query").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "qnode")).alias("b")).select("query", "b.qnode", "b.score")


def qnode_records(picked: DataFrame, options: DataFrame) -> DataFrame:
    """Records (query, qnode, name, description, confidence) of picked nodes; the first label and description count."""
    o = options.groupBy("query", "qnode").agg(F.min_by(F.struct("label", "description", "score"), "ord").alias("o"))
    return picked.join(o, ["query", "qnode"]).select("query", "qnode", F.get("o.label", F.lit(0)).alias("name"), F.get("o.description", F.lit(0)).alias("description"), truthy_score(F.col("o.score")).alias("confidence"))


def usable_mentions(mentions: DataFrame) -> DataFrame:
    return mentions.where(N.is_valid_mention(F.col("span_start"), F.col("span_stop")))
