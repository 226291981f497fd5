"""Semantic graphs made from conversations: a graph for each conversation, whose node ids are those of every other graph.

A turn gives two nodes, one of them an event or a thing by the length of its text, and two edges; its first words are the
graph's tokens. The same tables as SQL are for comparing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a turn that are tokens of its graph.
WIDTH = 4
EVENT_LABELS = ["say-01", "keep-01", "prevent-01", "person"]
THING_LABELS = ["country", "run-away-02", "name"]
ROLES = [":ARG0", ":time", ":ARG1-of", ":mod", ":name", ":ARG1", ":location-of"]
NEXT_ROLES = [":ARG1", ":ARG0", ":direction"]


def graph_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """nodes, edges, tokens, alignments and graphs; a null or empty text is one empty word."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.coalesce("text", F.lit(""))
    t = c.select(F.concat(F.lit("g"), F.col("conv_id").cast("string")).alias("graph_id"), F.col("turn").cast("int").alias("t"), F.char_length(text).alias("n"), F.slice(F.split(text, " "), 1, WIDTH).alias("w"))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    node = lambda k: F.concat(F.lit("n"), k.cast("string"))
    event, thing, after = node(2 * F.col("t")), node(2 * F.col("t") + 1), node(2 * F.col("t") + 2)
    last = t.groupBy("graph_id").agg(F.max("t").alias("last"))
    role = pick(ROLES, F.floor(F.col("n") / 4))
    turned = role.endswith("-of")
    two = F.array(
        F.struct((2 * F.col("t")).alias("ord"), F.when(turned, thing).otherwise(event).alias("parent"), role.alias("role"), F.when(turned, event).otherwise(thing).alias("child")),
        F.struct((2 * F.col("t") + 1).alias("ord"), event.alias("parent"), pick(NEXT_ROLES, F.floor(F.col("n") / 20)).alias("role"), after.alias("child")),
    )
    return {
        "nodes": t.select("graph_id", F.explode(F.array(F.struct(event.alias("node_id"), (2 * F.col("t")).alias("ord"), pick(EVENT_LABELS, F.col("n")).alias("label")), F.struct(thing.alias("node_id"), (2 * F.col("t") + 1).alias("ord"), pick(THING_LABELS, F.col("n")).alias("label")))).alias("x")).select("graph_id", "x.*"),
        "edges": t.join(last, "graph_id").select("graph_id", F.explode(F.when(F.col("t") < F.col("last"), two).otherwise(F.slice(two, 1, 1))).alias("x")).select("graph_id", "x.*"),
        "tokens": t.select("graph_id", F.posexplode("w").alias("i", "token"), "t").select("graph_id", (WIDTH * F.col("t") + F.col("i")).alias("idx"), "token"),
        "alignments": t.select("graph_id", "t", F.posexplode("w").alias("i", "token")).select("graph_id", (WIDTH * F.col("t") + F.col("i")).alias("ord"), F.when(F.col("i") == 0, event).otherwise(thing).alias("node_id"), (WIDTH * F.col("t") + F.col("i")).alias("token_idx")),
        "graphs": t.select("graph_id").distinct().withColumn("root", F.lit("n0")),
    }


def _pick(values: list[str], k: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{k} % {len(values)} + 1]"


#: The same tables, for SQL that begins with WITH.
SQL = f"""tt AS (SELECT 'g' || conv_id AS graph_id, turn::INT AS t, length(coalesce(text, '')) AS n, string_split(coalesce(text, ''), ' ')[1:{WIDTH}] AS w, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
nodes AS (SELECT graph_id, 'n' || (2 * t) AS node_id, 2 * t AS ord, {_pick(EVENT_LABELS, 'n')} AS label FROM tt UNION ALL SELECT graph_id, 'n' || (2 * t + 1), 2 * t + 1, {_pick(THING_LABELS, 'n')} FROM tt),
er AS (SELECT *, {_pick(ROLES, '(n // 4)')} AS role FROM tt),
edges AS (SELECT graph_id, 2 * t AS ord, 'n' || CASE WHEN role LIKE '%-of' THEN 2 * t + 1 ELSE 2 * t END AS parent, role, 'n' || CASE WHEN role LIKE '%-of' THEN 2 * t ELSE 2 * t + 1 END AS child FROM er
  UNION ALL SELECT graph_id, 2 * t + 1, 'n' || (2 * t), {_pick(NEXT_ROLES, '(n // 20)')}, 'n' || (2 * t + 2) FROM tt WHERE t < last),
tw AS (SELECT graph_id, t, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS i FROM tt),
tokens AS (SELECT graph_id, ({WIDTH} * t + i)::INT AS idx, token FROM tw),
aligned AS (SELECT graph_id, {WIDTH} * t + i AS ord, 'n' || CASE WHEN i = 0 THEN 2 * t ELSE 2 * t + 1 END AS node_id, {WIDTH} * t + i AS token_idx FROM tw),
graphs AS (SELECT DISTINCT graph_id, 'n0' AS root FROM tt),
st AS (SELECT a.graph_id, a.node_id, string_agg(token, ' ' ORDER BY ord) AS text FROM aligned a JOIN tokens t ON t.graph_id = a.graph_id AND t.idx = a.token_idx WHERE NOT contains('!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', token) AND token <> '<ROOT>' GROUP BY 1, 2)"""


def sql_clip(words: str, stops: str) -> str:
    """SQL for words, a list, without stop words and punctuation at either end, joined by blanks."""
    kept = f"list_filter(range(1, len({words}) + 1), lambda i: lower(({words})[i]) NOT IN {stops} AND NOT contains('!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ({words})[i]))"
    return f"CASE WHEN len({kept}) = 0 THEN '' ELSE array_to_string(({words})[list_min({kept}):list_max({kept})], ' ') END"
