"""Queries over semantic graphs, triples, their merge, and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocabulary import TYPE, System, iri
from ..operators import aif, amr, analysis
from ..operators import graph as G
from ..session import shared_dir
from ..sources import turtle
from . import talk
from .corpus import _STOPS
from .fixture import Fixture, with_fixtures

ORACLE: dict[str, str] = {}

# g1: "officials say that Vitamin D prevents bad flu ." with a person's name; g2: a cycle; g3: government; g4: date
NODES = Fixture(
    "nodes", "graph_id string, node_id string, ord int, label string",
    [
        ("g1", "s", 0, "say-01"), ("g1", "p", 1, "person"), ("g1", "n", 2, "name"), ("g1", "v", 3, "prevent-01"), ("g1", "d", 4, "vitamin"), ("g1", "f", 5, "flu"), ("g1", "b", 6, "bad"), ("g1", "r", 7, "far"),
        ("g2", "a", 0, "hold-01"), ("g2", "b", 1, "keep-01"), ("g2", "c", 2, "thing"), ("g3", "g", 0, "government-organization"), ("g3", "c", 1, "country"), ("g3", "n", 2, "name"), ("g3", "m", 3, "make-01"),
        ("g4", "t", 0, "date-entity"), ("g4", "y", 1, "start-01"), ("g4", "z", 2, "virus"),
    ],
)
EDGES = Fixture(
    "edges", "graph_id string, ord int, parent string, role string, child string",
    [
        ("g1", 0, "s", ":ARG0", "p"), ("g1", 1, "p", ":name", "n"), ("g1", 2, "s", ":ARG1", "v"), ("g1", 3, "v", ":ARG0", "d"), ("g1", 4, "v", ":ARG1", "f"), ("g1", 5, "f", ":mod", "b"), ("g1", 6, "f", ":mod", "r"), ("g1", 7, "d", ":ARG1-of", "v"),
        ("g2", 0, "a", ":ARG1", "b"), ("g2", 1, "b", ":ARG1", "a"), ("g2", 2, "b", ":ARG2", "c"), ("g3", 0, "m", ":ARG0", "g"), ("g3", 1, "g", ":ARG1-of", "c"), ("g3", 2, "c", ":name", "n"), ("g4", 0, "y", ":time", "t"), ("g4", 1, "y", ":ARG1", "z"),
    ],
)
TOKENS = Fixture(
    "tokens", "graph_id string, idx int, token string",
    [("g1", i, t) for i, t in enumerate("far away Ann Lee said vitamin prevents the bad flu . <ROOT>".split())] + [("g2", i, t) for i, t in enumerate("we hold and keep things".split())] + [("g3", i, t) for i, t in enumerate("the government of New Land made it".split())] + [("g4", i, t) for i, t in enumerate("the virus started in May 2020".split())],
)
ALIGNED = Fixture(
    "aligned", "graph_id string, ord int, node_id string, token_idx int",
    [
        ("g1", 0, "s", 4), ("g1", 1, "n", 2), ("g1", 2, "n", 3), ("g1", 3, "v", 6), ("g1", 4, "d", 5), ("g1", 5, "f", 9), ("g1", 6, "b", 8), ("g1", 7, "r", 0), ("g1", 8, "f", 10), ("g1", 9, "s", 11),
        ("g2", 0, "a", 1), ("g2", 1, "b", 3), ("g2", 2, "c", 4), ("g3", 0, "g", 1), ("g3", 1, "n", 3), ("g3", 2, "n", 4), ("g3", 3, "m", 5), ("g4", 0, "t", 4), ("g4", 1, "t", 5), ("g4", 2, "y", 2), ("g4", 3, "z", 1),
    ],
)
GRAPHS = Fixture("graphs", "graph_id string, root string", [("g1", "v"), ("g2", "a"), ("g3", "m"), ("g4", "y")])
CLAIMS = Fixture("cl", "graph_id string, template string", [("g1", "X prevents flu"), ("g2", "it is X"), ("g3", "Government-X made it"), ("g4", "it began on date-X")])
_T = with_fixtures(NODES, EDGES, TOKENS, ALIGNED)
_STRINGS = "st AS (SELECT a.graph_id, a.node_id, string_agg(token, ' ' ORDER BY ord, token_idx) AS text FROM aligned a JOIN tokens t ON t.graph_id = a.graph_id AND t.idx = a.token_idx WHERE token NOT IN ('.', '<ROOT>') GROUP BY 1, 2)"


def _tables(spark):
    n, e, t, a = (f.df(spark) for f in (NODES, EDGES, TOKENS, ALIGNED))
    return n, e, t, amr.node_strings(t, a)


def _talk(spark, sf_dir):
    g = talk.graph_tables(spark, sf_dir)
    return g["nodes"], g["edges"], g["tokens"], amr.node_strings(g["tokens"], g["alignments"])


def node_strings(spark, sf_dir):
    return _talk(spark, sf_dir)[3]


def full_names(spark, sf_dir):
    n, e, t, s = _talk(spark, sf_dir)
    return amr.full_names(e, s)


def node_description(spark, sf_dir):
    return amr.descriptions(*_tables(spark)).drop("mods")


def token_places(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    t = c.select(F.concat_ws("-", "conv_id", "turn").alias("graph_id"), F.posexplode(F.split("text", " ")).alias("idx", "token"))
    return amr.token_places(t)


ORACLE["node_strings"] = f"WITH {talk.SQL} SELECT * FROM st"
ORACLE["full_names"] = f"WITH {talk.SQL} SELECT e.graph_id, parent AS node_id, coalesce(string_agg(text, ' ' ORDER BY ord), '') AS name FROM edges e LEFT JOIN st ON st.graph_id = e.graph_id AND st.node_id = child WHERE role = ':name' GROUP BY 1, 2"
ORACLE["token_places"] = "WITH t AS (SELECT conv_id || '-' || turn AS graph_id, string_split(text, ' ') AS w FROM conversations), u AS (SELECT graph_id, generate_subscripts(w, 1) - 1 AS idx, unnest(w) AS token FROM t) SELECT graph_id, token, max(idx)::INT AS idx FROM u GROUP BY 1, 2"
_PLACES = "pl AS (SELECT graph_id, token, max(idx) AS idx FROM tokens GROUP BY 1, 2)"
_FIRSTS = "fe AS (SELECT graph_id, parent, role, arg_min(child, ord) AS child FROM edges GROUP BY 1, 2, 3)"
#: Words around a node: its own, and those of the children that count; for rolesets those of the described child.
_DESCR = f"""{_STRINGS}, {_PLACES}, {_FIRSTS},
m AS (SELECT graph_id, parent, child, 0 AS k FROM edges WHERE role = ':mod' UNION ALL SELECT graph_id, parent, child, 0 FROM fe WHERE role IN (':consist-of', ':ARG1-of') UNION ALL SELECT graph_id, parent, child, 1 FROM fe WHERE role = ':op1'),
mt AS (SELECT m.graph_id, m.parent AS node_id, k, st.text FROM m JOIN st ON st.graph_id = m.graph_id AND st.node_id = m.child),
mk AS (SELECT graph_id, node_id, min(k) AS k FROM mt GROUP BY 1, 2),
nd AS (SELECT st.*, regexp_matches(label, '^[a-z, -]*-[0-9]{{2}}') AS roleset FROM st JOIN nodes USING (graph_id, node_id)),
w0 AS (SELECT graph_id, node_id, unnest(string_split(text, ' ')) AS token FROM nd
  UNION SELECT mt.graph_id, mt.node_id, unnest(string_split(mt.text, ' ')) FROM mt JOIN mk USING (graph_id, node_id, k) JOIN nd USING (graph_id, node_id) WHERE NOT roleset)"""


def _assembled(words: str, name: str) -> str:
    """SQL that puts a node's words in order, takes A of "A and B", and drops words out of step with the focus."""
    return f"""{name}_p AS (SELECT graph_id, node_id, token, idx, row_number() OVER (PARTITION BY graph_id, node_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY graph_id, node_id) AS n FROM {words} JOIN pl USING (graph_id, token)),
{name}_f AS (SELECT nd.graph_id, nd.node_id, p.idx AS f_idx, p.i AS f_i FROM nd JOIN {name}_p p ON p.graph_id = nd.graph_id AND p.node_id = nd.node_id AND p.token = string_split(nd.text, ' ')[1]),
{name}_and AS (SELECT graph_id, node_id, bool_or(n = 3 AND i = 1 AND token = 'and') AS two FROM {name}_p GROUP BY 1, 2),
{name} AS (SELECT p.graph_id, p.node_id, string_agg(token, ' ' ORDER BY i) FILTER (WHERE CASE WHEN two THEN i = 0 ELSE abs(idx - f_idx) = abs(i - f_i) END) AS description FROM {name}_p p JOIN {name}_f USING (graph_id, node_id) JOIN {name}_and USING (graph_id, node_id) GROUP BY 1, 2)"""


#: In the tables above the only cycles are of two rolesets.
_LOOP = "EXISTS (SELECT 1 FROM fe z WHERE z.graph_id = fe.graph_id AND z.parent = fe.child AND z.child = fe.parent AND z.role = ':ARG1')"


def _level(k: int) -> str:
    return f"""w{k} AS (SELECT w.* FROM w0 w UNION SELECT nd.graph_id, nd.node_id, unnest(string_split(d.description, ' ')) FROM nd JOIN fe ON fe.graph_id = nd.graph_id AND fe.parent = nd.node_id AND fe.role = ':ARG1' AND NOT {_LOOP} JOIN d{k - 1} d ON d.graph_id = nd.graph_id AND d.node_id = fe.child WHERE roleset),
{_assembled(f"w{k}", f"d{k}")}"""


ORACLE["node_description"] = f"{_T}, {_DESCR}, {_assembled('w0', 'd0')}, {_level(1)}, {_level(2)}, {_level(3)} SELECT * FROM d3"

_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in _STOPS) + ")"


def labelled_args(spark, sf_dir):
    """Arguments of events in the graphs of conversations; which roles an event allows depends on its graph."""
    n, e, t, s = _talk(spark, sf_dir)
    events = n.where("ord % 2 = 0").select("graph_id", F.col("node_id").alias("event"))
    even = F.substring("graph_id", -1, 1).isin("0", "2", "4", "6", "8")
    roles = F.when(even, F.array(F.lit("A0"), F.lit("time"))).otherwise(F.array(F.lit("A1"), F.lit("loc"), F.lit("dir")))
    return amr.labelled_arguments(n, e, s, events, events.select("graph_id", "event", F.explode(roles).alias("role")))


ORACLE["labelled_args"] = f"""WITH {talk.SQL}, evn AS (SELECT graph_id, node_id AS event FROM nodes WHERE ord % 2 = 0),
allowed AS (SELECT graph_id, event, unnest(CASE WHEN right(graph_id, 1)::INT % 2 = 0 THEN ['A0', 'time'] ELSE ['A1', 'loc', 'dir'] END) AS role FROM evn),
a0 AS (SELECT e.graph_id, event, ord, replace(replace(replace(role, ':', ''), '-of', ''), 'ARG', 'A') AS role, CASE WHEN role LIKE '%-of' THEN parent ELSE child END AS node_id FROM edges e JOIN evn USING (graph_id)
  WHERE ((role NOT LIKE '%-of' AND parent = event) OR (role LIKE '%-of' AND child = event)) AND regexp_matches(role, 'ARG|time|location|direction')),
a AS (SELECT graph_id, event, ord, CASE WHEN role IN ('location', 'direction') THEN role[1:3] ELSE role END AS role, node_id FROM a0),
b AS (SELECT a.*, string_split(coalesce(st.text, ''), ' ') AS w, label FROM a JOIN allowed USING (graph_id, event, role) JOIN nodes USING (graph_id, node_id) LEFT JOIN st USING (graph_id, node_id)),
c AS (SELECT *, {talk.sql_clip('w', _STOP_SQL)} AS clipped FROM b)
SELECT graph_id, event, role, arg_max(CASE WHEN clipped <> '' THEN clipped ELSE regexp_replace(label, '-[^-]*$', '') END, ord) AS text FROM c GROUP BY 1, 2, 3"""

ROLES = Fixture("roles", "role string, label string", [(":ARG1-of", "have-name-91"), (":location", "say-01"), (":direction", "date-entity"), (":time", "x-y-01-z"), (":mod", "Say-01"), (":ARG0", "say-1"), (":op1", "run-02")])


def framenet_role(spark, sf_dir):
    return ROLES.df(spark).select("role", "label", T.framenet_role(F.col("role")).alias("frame"), T.is_argument_role(F.col("role")).alias("valid"), T.is_roleset(F.col("label")).alias("roleset"), T.roleset_text(F.col("label")).alias("words"), T.label_without_sense(F.col("label")).alias("bare"))


ORACLE["framenet_role"] = f"""{with_fixtures(ROLES)}, b AS (SELECT *, replace(replace(role, ':', ''), '-of', '') AS r FROM roles)
SELECT role, label, CASE WHEN r LIKE 'ARG%' THEN replace(r, 'ARG', 'A') WHEN r IN ('location', 'direction') THEN r[:3] ELSE r END AS frame, regexp_matches(role, 'ARG|time|location|direction') AS valid,
regexp_matches(label, '^[a-z, -]*-[0-9]{{2}}') AS roleset, replace(regexp_replace(label, '-[^-]*$', ''), '-', ' ') AS words, regexp_replace(label, '-[0-9]*', '', 'g') AS bare FROM b"""

VERBS = Fixture("sayers", "verb string", [("say",), ("keep",)])
WORDS = Fixture("cwords", "graph_id string, i int, lemma string", [("g1", 0, "flu"), ("g1", 1, "prevent"), ("g2", 0, "thing"), ("g3", 0, "make")])
POS = Fixture("postags", "graph_id string, token string, pos string", [("g1", "Lee", "PROPN"), ("g1", "said", "VERB")])


def claimer_nodes(spark, sf_dir):
    n, e, t, s = _tables(spark)
    return amr.claim_nodes(n, e, WORDS.df(spark), VERBS.df(spark))


def claimers(spark, sf_dir):
    n, e, t, s = _tables(spark)
    return amr.claimers(n, e, t, s, amr.claim_nodes(n, e, WORDS.df(spark), VERBS.df(spark)), POS.df(spark))


ORACLE["claimer_nodes"] = f"""{with_fixtures(NODES, EDGES, VERBS, WORDS).replace('WITH ', 'WITH RECURSIVE ', 1)}, stm AS (SELECT graph_id, node_id, ord FROM nodes JOIN sayers ON verb = regexp_replace(label, '-[^-]*$', '')),
wd AS (SELECT w.graph_id, i, n.ord AS n_ord, n.node_id AS start FROM cwords w JOIN nodes n ON n.graph_id = w.graph_id AND lemma = regexp_replace(label, '-[0-9]*', '', 'g')),
up(graph_id, start, node_id, path) AS (SELECT DISTINCT graph_id, start, start, [0][1:0] FROM wd UNION ALL SELECT u.graph_id, u.start, e.parent, list_append(u.path, e.ord) FROM up u JOIN edges e ON e.graph_id = u.graph_id AND e.child = u.node_id
  WHERE len(u.path) < 6 AND (len(u.path) = 0 OR NOT EXISTS (SELECT 1 FROM stm z WHERE z.graph_id = u.graph_id AND z.node_id = u.node_id))),
ab AS (SELECT graph_id, start, arg_min(node_id, path) AS node FROM up JOIN stm USING (graph_id, node_id) WHERE len(path) > 0 GROUP BY 1, 2),
bw AS (SELECT graph_id, arg_min(node, (i, n_ord)) AS node FROM wd JOIN ab USING (graph_id, start) GROUP BY 1)
SELECT f.graph_id, coalesce(bw.node, f.first) AS node_id FROM (SELECT graph_id, arg_min(node_id, ord) AS first FROM stm GROUP BY 1) f LEFT JOIN bw USING (graph_id)"""
ORACLE["claimers"] = f"""{with_fixtures(NODES, EDGES, TOKENS, ALIGNED)}, {_STRINGS} SELECT 'g1' AS graph_id, text AS claimer FROM st WHERE graph_id = 'g1' AND node_id = 'n'"""


def claimer_ancestor(spark, sf_dir):
    """Nations below their region below the root: the first ancestor that is a region named with an A."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    node = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    e = n.select(F.lit("w").alias("graph_id"), node("r", "n_regionkey").alias("parent"), node("n", "n_nationkey").alias("child"), F.col("n_nationkey").alias("ord")).unionByName(r.select(F.lit("w").alias("graph_id"), F.lit("top").alias("parent"), node("r", "r_regionkey").alias("child"), F.lit(99).alias("ord")))
    wanted = r.where("r_name LIKE 'A%'").select(F.lit("w").alias("graph_id"), node("r", "r_regionkey").alias("node_id"))
    return amr.first_above(e, wanted, n.select(F.lit("w").alias("graph_id"), node("n", "n_nationkey").alias("start"))).drop("graph_id")


ORACLE["claimer_ancestor"] = "SELECT 'n' || n_nationkey AS start, 'r' || r_regionkey AS node_id, 1 AS steps FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'"


def xvar_domain(spark, sf_dir):
    n, e, t, s = _tables(spark)
    return amr.open_variables(CLAIMS.df(spark), GRAPHS.df(spark), n, e, t, s)


NER = Fixture("ner", "graph_id string, ent_type string", [("g1", "PERSON"), ("g3", "NORP"), ("g4", "DATE")])


def xvar_general(spark, sf_dir):
    n, e, t, s = _tables(spark)
    return amr.general_variables(CLAIMS.df(spark), n, e, t, s, NER.df(spark))


_RULES = f"""ed AS (SELECT e.*, p.label AS pl, c.label AS chl FROM edges e JOIN nodes p ON p.graph_id = e.graph_id AND p.node_id = e.parent JOIN nodes c ON c.graph_id = e.graph_id AND c.node_id = e.child),
nm AS (SELECT e.graph_id, parent AS node_id, nullif(string_agg(text, ' ' ORDER BY ord), '') AS name FROM edges e JOIN st ON st.graph_id = e.graph_id AND st.node_id = child WHERE role = ':name' GROUP BY 1, 2)"""
ORACLE["xvar_domain"] = f"""{with_fixtures(NODES, EDGES, TOKENS, ALIGNED, GRAPHS, CLAIMS)}, {_DESCR}, {_assembled('w0', 'd0')}, {_level(1)}, {_level(2)}, {_level(3)}, {_RULES},
h AS (SELECT graph_id, 3 AS prio, 0 AS ord, root AS node_id FROM cl JOIN graphs USING (graph_id) WHERE template LIKE '%is X'
  UNION ALL SELECT graph_id, 7, n.ord, node_id FROM cl JOIN nodes n USING (graph_id) WHERE template LIKE '%date-X%' AND label = 'date-entity'
  UNION ALL SELECT graph_id, 6, ord, child FROM cl JOIN ed USING (graph_id) WHERE template LIKE '%Government-X%' AND pl = 'government-organization'
  UNION ALL SELECT graph_id, 11, ord, child FROM cl JOIN ed USING (graph_id) JOIN graphs USING (graph_id) WHERE template LIKE 'X%' AND parent = root AND role = ':ARG0'
  UNION ALL SELECT graph_id, 12, ord, child FROM cl JOIN ed USING (graph_id) JOIN graphs USING (graph_id) WHERE template LIKE '%X' AND parent = root AND role = ':ARG1'),
b AS (SELECT graph_id, prio, node_id FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY prio, ord) AS k FROM h) WHERE k = 1)
SELECT graph_id, prio, CASE WHEN prio = 6 THEN name || ' government' WHEN prio IN (11, 12) THEN coalesce(name, description) ELSE description END AS x_text FROM b LEFT JOIN nm USING (graph_id, node_id) LEFT JOIN d3 USING (graph_id, node_id)"""
ORACLE["xvar_general"] = f"""{with_fixtures(NODES, EDGES, TOKENS, ALIGNED, NER, CLAIMS)}, {_DESCR}, {_assembled('w0', 'd0')}, {_level(1)}, {_level(2)}, {_level(3)}, {_RULES},
k AS (SELECT cl.graph_id, coalesce(bool_or(ent_type = 'NORP'), false) AS norp, coalesce(bool_or(ent_type IN ('PERSON', 'ORG')), false) AS per FROM cl LEFT JOIN ner USING (graph_id) GROUP BY 1),
h AS (SELECT graph_id, ord, CASE WHEN norp AND (pl = 'government-organization' OR (role = ':ARG0' AND chl IN ('city', 'state', 'country', 'continent'))) THEN 1 WHEN NOT norp AND per AND chl = 'person' THEN 2
  WHEN role IN (':location', ':source') OR chl IN ('city', 'state', 'country', 'continent') THEN 3 WHEN pl = 'date-entity' THEN 4 END AS prio, CASE WHEN pl = 'date-entity' THEN parent ELSE child END AS node_id FROM ed JOIN k USING (graph_id)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY prio, ord) AS n FROM h WHERE prio IS NOT NULL) WHERE n = 1)
SELECT graph_id, prio, coalesce(name, description) AS x_text FROM b LEFT JOIN nm USING (graph_id, node_id) LEFT JOIN d3 USING (graph_id, node_id) WHERE coalesce(name, description, '') <> ''"""


def _full(rows: list[tuple[str, str, str, str]]) -> list[tuple[str, str, str, str]]:
    """Triples with short names of the ontology written out."""
    return [(g, s, TYPE if p == "a" else iri(p), iri(o)) for g, s, p, o in rows]


def _span(g, s, j, a, b, conf=None):
    out = [(g, s, "aida:justifiedBy", j), (g, j, "a", "aida:TextJustification"), (g, j, "aida:startOffset", str(a)), (g, j, "aida:endOffsetInclusive", str(b)), (g, j, "aida:source", f"doc_{g}")]
    return out + ([(g, j, "aida:confidence", j + "c"), (g, j + "c", "aida:confidenceValue", conf)] if conf else [])


def _cluster(g, claim, cluster, ent, kind):
    return [(g, claim, "aida:claimSemantics", cluster), (g, cluster, "a", "aida:SameAsCluster"), (g, cluster, "aida:prototype", ent), (g, ent, "a", kind)]


FIRST = Fixture(
    "fst", "graph_id string, s string, p string, o string",
    _full([
        ("d1", "u/c1", "a", "aida:Claim"),
        *_cluster("d1", "u/c1", "k/clusters/events/1", "k/events/e1", "aida:Event"), *_span("d1", "k/events/e1", "j1", 10, 15, "0.5"), ("d1", "k/events/e1", "aida:informativeJustification", "j1i"),
        *_cluster("d1", "u/c1", "k/clusters/entity/2", "k/entities/e2", "aida:Entity"), *_span("d1", "k/entities/e2", "j2", 30, 34),
        *_cluster("d1", "u/c1", "k/clusters/events/3", "k/events/e3", "aida:Event"), *_span("d1", "k/events/e3", "j3", 70, 75), ("d1", "k/events/e3", "near", "e4"), ("d1", "e4", "near", "k/events/e3"), ("d1", "k/events/e3", "aida:informativeJustification", "j3i"),
        *_cluster("d1", "u/c1", "k/clusters/entity/4", "k/entities/e5", "aida:Entity"), *_span("d1", "k/entities/e5", "j5", 50, 55),
        ("d1", "s1", "a", "rdf:Statement"), ("d1", "s1", "a", "aida:ArgumentStatement"), ("d1", "s1", "rdf:subject", "k/events/e1"), ("d1", "s1", "rdf:object", "k/entities/e2"),
        ("d1", "s2", "a", "rdf:Statement"), ("d1", "s2", "rdf:subject", "k/entities/e2"), ("d1", "s2", "rdf:object", "Q1"), ("d1", "s3", "a", "rdf:Statement"), ("d1", "s3", "rdf:subject", "k/events/e3"), ("d1", "s3", "rdf:object", "k/entities/e2"),
        ("d1", "s4", "a", "aida:ArgumentStatement"), ("d1", "s4", "rdf:subject", "k/events/e1"), ("d1", "s5", "a", "rdf:Statement"), ("d1", "s5", "rdf:subject", "k/events/e9"),
        ("d2", "u/c9", "a", "aida:Claim"), ("d2", "u/c9", "aida:claimSemantics", "k/clusters/events/9"), ("d9", "x", "a", "aida:Claim"), ("d3", "u/c5", "a", "aida:Claim"), ("d3", "u/c5", "aida:claimSemantics", "k/clusters/events/8"),
    ]),
)
SECOND = Fixture(
    "snd", "graph_id string, s string, p string, o string",
    _full([
        ("d1", "v#c1", "a", "aida:Claim"), ("d1", "v#c1", "aida:claimSemantics", "old"), ("d1", "v#c1", "aida:associatedKEs", "old"), ("d1", "v#c1", "aida:justifiedBy", "cj"), ("d1", "cj", "a", "aida:TextJustification"), ("d1", "cj", "aida:sourceDocument", "DOC1"),
        ("d1", "m/events/7", "a", "aida:Event"), *_span("d1", "m/events/7", "w1", 10, 16), ("d1", "m/events/6", "a", "aida:Event"), *_span("d1", "m/events/6", "w6", 9, 14), ("d1", "m/entities/8", "a", "aida:Entity"), *_span("d1", "m/entities/8", "w2", 29, 34),
        ("d1", "m/events/9", "a", "aida:Event"), *_span("d1", "m/events/9", "w9", 50, 55), ("d1", "other", "a", "aida:Relation"), *_span("d1", "other", "w3", 70, 75),
        ("d2", "v#c9", "a", "aida:Claim"), ("d3", "v/c5", "a", "aida:Claim"), ("d3", "v/c5", "aida:claimSemantics", "z"), ("d4", "v#c7", "a", "aida:Claim"), ("d4", "v#c7", "aida:claimSemantics", "y"),
    ]),
)
_TR = with_fixtures(FIRST, SECOND)


def _q(short: str) -> str:
    return f"'{TYPE if short == 'a' else iri(short)}'"


def bgp_spans(spark, sf_dir):
    return G.spans_of(FIRST.df(spark))


def bgp_typed_spans(spark, sf_dir):
    return G.spans_of(FIRST.df(spark), ["aida:Event"]).drop("confidence")


def bgp_semijoin(spark, sf_dir):
    s = FIRST.df(spark)
    return G.objects(s, "rdf:subject", "about").join(G.of_type(s, "aida:Event").withColumnRenamed("s", "about"), ["graph_id", "about"], "left_semi")


def graph_documents(spark, sf_dir):
    return G.document_of(FIRST.df(spark))


def _bgp(t: str, more: str = "") -> str:
    return f"""SELECT a.graph_id, a.s, b.o::INT AS start, c.o::INT AS stop, d.o AS source, v.o AS confidence FROM {t} a JOIN {t} b ON b.graph_id = a.graph_id AND b.s = a.o AND b.p = {_q('aida:startOffset')} JOIN {t} c ON c.graph_id = a.graph_id AND c.s = a.o AND c.p = {_q('aida:endOffsetInclusive')}
JOIN {t} d ON d.graph_id = a.graph_id AND d.s = a.o AND d.p = {_q('aida:source')} LEFT JOIN {t} e ON e.graph_id = a.graph_id AND e.s = a.o AND e.p = {_q('aida:confidence')} LEFT JOIN {t} v ON v.graph_id = a.graph_id AND v.s = e.o AND v.p = {_q('aida:confidenceValue')} WHERE a.p = {_q('aida:justifiedBy')} {more}"""


def _is(t: str, subject: str, *kinds: str) -> str:
    return f"EXISTS (SELECT 1 FROM {t} ty WHERE ty.graph_id = {subject.split('.')[0]}.graph_id AND ty.s = {subject} AND ty.p = {_q('a')} AND ty.o IN ({', '.join(_q(k) for k in kinds)}))"


ORACLE["bgp_spans"] = f"{_TR} {_bgp('fst')}"
ORACLE["bgp_typed_spans"] = f"{_TR}, x AS ({_bgp('fst')}) SELECT graph_id, s, start, stop, source FROM x WHERE {_is('fst', 'x.s', 'aida:Event')}"
ORACLE["bgp_semijoin"] = f"{_TR} SELECT a.graph_id, a.s, a.o AS about FROM fst a WHERE a.p = {_q('rdf:subject')} AND {_is('fst', 'a.o', 'aida:Event')}"
ORACLE["graph_documents"] = f"{_TR} SELECT t.graph_id, min(d.o) AS doc FROM fst t JOIN fst d ON d.graph_id = t.graph_id AND d.s = t.s AND d.p = {_q('aida:source')} WHERE t.p = {_q('a')} AND t.o = {_q('aida:TextJustification')} GROUP BY 1"
NEW = Fixture("ins", "graph_id string, s string, p string, o string", _full([("d1", "v#c1", "aida:associatedKEs", "k1"), ("d2", "v#c9", "aida:associatedKEs", "k2"), ("d3", "v/c5", "aida:claimSemantics", "z")]))
MAP = Fixture("mp", "graph_id string, old string, new string", [("d1", "k/entities/e2", "m/entities/8"), ("d1", "k/events/e1", "m/events/7"), ("d2", "k/entities/e2", "no")])


def graph_insert(spark, sf_dir):
    return G.insert_where(SECOND.df(spark), NEW.df(spark), "aida:claimSemantics")


def graph_replace(spark, sf_dir):
    return G.replace_values(FIRST.df(spark), MAP.df(spark), "rdf:object")


def reachable_copy(spark, sf_dir):
    s = FIRST.df(spark)
    return G.reachable(s, G.objects(s, "aida:claimSemantics", "start").select("graph_id", "start"))


def graph_merge(spark, sf_dir):
    return G.merge_stores(FIRST.df(spark), SECOND.df(spark))


def _reach(t: str) -> str:
    return f"r(graph_id, start, s, k) AS (SELECT DISTINCT graph_id, o, o, 0 FROM {t} WHERE p = {_q('aida:claimSemantics')} UNION ALL SELECT r.graph_id, r.start, f.o, k + 1 FROM r JOIN {t} f ON f.graph_id = r.graph_id AND f.s = r.s WHERE k < 7 AND EXISTS (SELECT 1 FROM {t} z WHERE z.graph_id = f.graph_id AND z.s = f.o))"


def _merged(a: str, b: str) -> str:
    """Tables up to ``mg``, the merge of two tables of triples."""
    both = f"({_q('aida:justifiedBy')}, {_q('aida:informativeJustification')})"
    return f"""{_reach(a)}, x AS (SELECT graph_id, s, arg_min(start, (start, stop)) AS m_start, arg_min(stop, (start, stop)) AS m_stop FROM ({_bgp(a)}) GROUP BY 1, 2), y AS (SELECT DISTINCT graph_id, s, start, stop FROM ({_bgp(b)}) z WHERE {_is(b, 'z.s', 'aida:Entity', 'aida:Event')}),
cl AS (SELECT DISTINCT t.graph_id, u.s AS claim, k.o AS cluster FROM {a} t JOIN {b} u ON u.graph_id = t.graph_id AND u.p = {_q('a')} AND u.o = {_q('aida:Claim')} AND string_split(u.s, '#')[-1] = string_split(t.s, '/')[-1] JOIN {a} k ON k.graph_id = t.graph_id AND k.s = t.s AND k.p = {_q('aida:claimSemantics')} WHERE t.p = {_q('a')} AND t.o = {_q('aida:Claim')}),
en AS (SELECT cl.graph_id, cluster, min(f.o) AS ent FROM cl JOIN {a} f ON f.graph_id = cl.graph_id AND f.s = cluster AND (contains(f.o, 'events') OR contains(f.o, 'entities')) GROUP BY 1, 2),
pr(k, ds, de) AS (VALUES (1, -1, -1), (2, -1, 0), (3, -1, 1), (5, 0, 0), (6, 0, 1), (7, 1, -1), (8, 1, 0), (9, 1, 1)),
nr AS (SELECT en.*, y.s AS found, k FROM en JOIN x ON x.graph_id = en.graph_id AND x.s = ent CROSS JOIN pr JOIN y ON y.graph_id = en.graph_id AND y.start = m_start + ds AND y.stop = m_stop + de
  UNION ALL SELECT en.*, y.s, 4 FROM en JOIN x ON x.graph_id = en.graph_id AND x.s = ent JOIN y ON y.graph_id = en.graph_id AND y.start = m_start AND y.stop = m_start - 1),
hit AS (SELECT graph_id, cluster, ent, found FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, cluster ORDER BY k, found DESC) AS n FROM nr) WHERE n = 1 AND ((contains(cluster, 'entity') AND contains(found, 'entities')) OR (contains(cluster, 'event') AND contains(found, 'events')))),
lk AS (SELECT cl.graph_id, claim AS s, q.p, cluster AS o FROM cl CROSS JOIN (VALUES ({_q('aida:claimSemantics')}), ({_q('aida:associatedKEs')})) q(p) WHERE EXISTS (SELECT 1 FROM {b} z WHERE z.graph_id = cl.graph_id AND z.s = cl.claim AND z.p = q.p)),
bd AS (SELECT f.graph_id, f.s, f.p, f.o FROM {a} f JOIN hit ON hit.graph_id = f.graph_id AND hit.cluster = f.s WHERE f.p <> {_q('aida:prototype')} UNION ALL SELECT graph_id, cluster, {_q('aida:prototype')}, found FROM hit),
pt AS (SELECT DISTINCT r.graph_id, cl.claim, r.s FROM r JOIN cl ON cl.graph_id = r.graph_id AND cl.cluster = r.start WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.graph_id = r.graph_id AND hit.cluster = r.start)),
cp AS (SELECT f.graph_id, f.s, f.p, f.o, pt.claim FROM {a} f JOIN pt ON pt.graph_id = f.graph_id AND pt.s = f.s),
dc AS (SELECT t.graph_id, t.s AS claim, min(d.o) AS doc FROM {b} t JOIN {b} d ON d.graph_id = t.graph_id AND d.s = t.o AND d.p = {_q('aida:sourceDocument')} WHERE t.p = {_q('aida:justifiedBy')} GROUP BY 1, 2),
dg AS (SELECT d.graph_id, min(d.o) AS doc FROM {b} d WHERE d.p = {_q('aida:sourceDocument')} AND {_is(b, 'd.s', 'aida:TextJustification')} GROUP BY 1),
ju AS (SELECT cp.graph_id, cp.o AS s, {_q('aida:sourceDocument')} AS p, coalesce(dc.doc, dg.doc) AS o FROM cp LEFT JOIN dc ON dc.graph_id = cp.graph_id AND dc.claim = cp.claim LEFT JOIN dg ON dg.graph_id = cp.graph_id WHERE cp.p IN {both}),
al AS (SELECT graph_id, s, p, o FROM {b} UNION SELECT * FROM lk UNION SELECT * FROM bd UNION SELECT graph_id, s, p, o FROM cp UNION SELECT * FROM ju WHERE o IS NOT NULL),
sm AS (SELECT f.graph_id, f.s, f.p, coalesce(found, f.o) AS o FROM {a} f LEFT JOIN hit ON hit.graph_id = f.graph_id AND hit.ent = f.o WHERE {_is(a, 'f.s', 'rdf:Statement')}),
mg AS (SELECT * FROM al UNION SELECT sm.* FROM sm WHERE EXISTS (SELECT 1 FROM sm w WHERE w.graph_id = sm.graph_id AND w.s = sm.s AND w.p = {_q('rdf:subject')} AND {_is('al', 'w.o', 'aida:Event')}))"""


_TRR = _TR.replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE["graph_insert"] = f"{with_fixtures(SECOND, NEW)} SELECT * FROM snd UNION SELECT i.* FROM ins i WHERE EXISTS (SELECT 1 FROM snd t WHERE t.graph_id = i.graph_id AND t.s = i.s AND t.p = {_q('aida:claimSemantics')})"
ORACLE["graph_replace"] = f"{with_fixtures(FIRST, MAP)} SELECT DISTINCT f.graph_id, s, p, CASE WHEN p = {_q('rdf:object')} AND mp.new IS NOT NULL THEN mp.new ELSE o END AS o FROM fst f LEFT JOIN mp ON mp.graph_id = f.graph_id AND mp.old = f.o"
ORACLE["reachable_copy"] = f"{_TRR}, {_reach('fst')} SELECT DISTINCT graph_id, start, s FROM r"
ORACLE["graph_merge"] = f"{_TRR}, {_merged('fst', 'snd')} SELECT * FROM mg"

_NODE = ["id string", "text string", "start int", "stop int", "conf double", "ent string"]
_SLOTS = ["xt", "xi", "ct", "ci"]
_NONE = (None,) * 6
A_CLAIMS = Fixture(
    "acl", "claim_id string, doc_id string, claim_text string, start int, stop int, topic string, subtopic string, template string, location string, " + ", ".join(f"{s}_{c}" for s in _SLOTS for c in _NODE),
    [
        ("c1", "D1.rsd", 'it  spreads "fast"', 0, 9, "T", "S", "X spreads", None, "Q7", "it there", 0, 1, 0.5, None, None, "no", None, None, None, None, "Q5", "human", 20, 22, None, "E7 PER", "Q77", "Ann", 20, 22, 0.25, None),
        ("c2", "D1.rsd", "no event", 20, 27, "T", "S2", "Z", None, *_NONE, *_NONE, *_NONE, *_NONE),
        ("c3", "D2", "masks work", 5, 14, "T2", "S", "X works", "Rome", *_NONE, *_NONE, *_NONE, "Q9", "Bob", 1, 2, 0.5, None),
        ("c0", "D1.rsd", "later claim", 40, 50, None, "S", "Y", None, "Q7", "it", None, None, None, None, *_NONE, *_NONE, *_NONE),
    ],
)
A_EVENTS = Fixture(
    "aev", "claim_id string, doc_id string, ord int, event_id string, qnode_id string, span_start int, span_stop int, text string, confidence double",
    [("c3", "D2", 0, "x3", "Q30", 6, 9, "work hard", None), ("c1", "D1.rsd", 0, "x1", "Q10", 3, 9, "spreads", 0.5), ("c1", "D1.rsd", 1, "x2", "Q11", 3, 9, "spread", 0.25), ("c2", "D1.rsd", 0, "x4", None, 1, 2, "none", 1.0), ("c0", "D1.rsd", 0, "x5", "Q12", 41, 44, "later", 0.0)],
)
A_ARGS = Fixture(
    "aar", "event_id string, ord int, role string, " + ", ".join(f"{s}_{c}" for s in ("t", "i") for c in _NODE),
    [
        ("x1", 0, "A0", "Q1", "it", 0, 1, 0.5, None, "Q2", "It", 0, 1, 0.25, "E2 LOC"), ("x1", 1, "A1", *_NONE, "Q3", "them", 4, 6, None, None), ("x1", 2, "A2", "Q8", "placeless", None, None, None, None, *_NONE),
        ("x3", 0, "A0", "Q4", "face masks", 5, 9, None, None, None, "none", 5, 9, None, None), ("x4", 0, "A0", "Q5", "no", 1, 1, None, None, *_NONE), ("x2", 0, "loc", "Q6", "home", 7, 9, 1.0, None, *_NONE),
    ],
)


def _node(prefix: str):
    parts = [F.col(f"{prefix}_{c.split()[0]}").alias(n.split(":")[0]) for c, n in zip(_NODE, aif.NODE[7:-1].split(","), strict=True)]
    known = F.coalesce(*[F.col(f"{prefix}_{c.split()[0]}").cast("string") for c in _NODE]).isNotNull()
    return F.when(known, F.struct(*parts))


def _claim_tables(spark):
    c = A_CLAIMS.df(spark).withColumns({"x_type": _node("xt"), "x_identity": _node("xi"), "claimer_type": _node("ct"), "claimer_identity": _node("ci")})
    a = A_ARGS.df(spark).withColumns({"type": _node("t"), "identity": _node("i")}).select("event_id", "ord", "role", "type", "identity")
    return c, A_EVENTS.df(spark), a


def aif_triples(spark, sf_dir):
    return aif.claim_triples(*_claim_tables(spark), System())


def aif_serial_ids(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("D"), F.col("source")).alias("doc_id"), F.col("doc_id").cast("string").alias("claim_id"), F.lit(0).alias("ord"))
    return aif.event_ids(d)


def nil_ids(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", T.nil_id(F.coalesce("text", F.lit(""))).alias("nil"))


def author_default(spark, sf_dir):
    c = aif.with_author(_claim_tables(spark)[0])
    return c.select("claim_id", "by_author", F.col("claimer_type.qnode_id").alias("claimer_type"), F.col("claimer_type.text").alias("claimer_text"), F.col("claimer_identity.qnode_id").alias("claimer_identity"))


_NIL = "'NIL' || lpad((('0x' || substr(md5({t}), 1, 8))::BIGINT % 10000000)::VARCHAR, 7, '0')"
ORACLE["aif_serial_ids"] = "SELECT 'D' || source AS doc_id, doc_id::VARCHAR AS claim_id, 0 AS ord, 'EN_Event_' || lpad((row_number() OVER (ORDER BY 'D' || source, doc_id::VARCHAR, 0) - 1)::VARCHAR, 6, '0') AS event_name FROM documents"
ORACLE["nil_ids"] = f"SELECT doc_id, {_NIL.format(t='text')} AS nil FROM documents"
_HAS = lambda s: "coalesce(" + ", ".join(f"{s}_{c.split()[0]}::VARCHAR" for c in _NODE) + ") IS NOT NULL"
ORACLE["author_default"] = f"{with_fixtures(A_CLAIMS)} SELECT claim_id, NOT ({_HAS('ct')}) AS by_author, CASE WHEN {_HAS('ct')} THEN ct_id ELSE 'Q5' END AS claimer_type, CASE WHEN {_HAS('ct')} THEN ct_text ELSE 'human' END AS claimer_text, CASE WHEN {_HAS('ct')} THEN ci_id END AS claimer_identity FROM acl"


def _rows(table: str, *triples: tuple[str, str, str, str]) -> str:
    """SELECTs of (subject, predicate, object, kind of object) over a table with the graph g."""
    types = {"str": ("literal", f"{_q('xsd:string')}"), "int": ("literal", f"{_q('xsd:int')}"), "double": ("literal", f"{_q('xsd:double')}"), "iri": ("iri", "NULL"), "blank": ("bnode", "NULL")}
    return "\nUNION ALL ".join(f"SELECT g AS graph_id, {s} AS s, {_q(p)} AS p, ({o})::VARCHAR AS o, '{types[k][0]}' AS o_kind, {types[k][1]} AS o_type FROM {table}" for s, p, o, k in triples)


def _b(s: str, what: str) -> str:
    return f"('_:b' || substr(md5({s} || '|{what}'), 1, 16))"


def _kind(s: str, *kinds: str):
    return [*[(s, "a", f"CASE WHEN {s} IS NOT NULL THEN {_q(k)} END", "iri") for k in kinds], (s, "aida:system", "'urn:claims'", "iri")]


def _sure(s: str, c: str):
    b = _b(s, "confidence")
    return [(s, "aida:confidence", b, "blank"), *_kind(b, "aida:Confidence"), (b, "aida:confidenceValue", f"format('{{:.2E}}', coalesce(nullif({c}, 0), 1))", "double")]


def _private(s: str, text: str):
    b = f"CASE WHEN {text} IS NOT NULL THEN {_b(s, 'private')} END"
    return [(s, "aida:privateData", b, "blank"), *_kind(b, "aida:PrivateData"), (b, "aida:jsonContent", text, "str")]


def _at(s: str, start: str, stop: str, c: str):
    return [*_kind(s, "aida:TextJustification"), *_sure(s, c), (s, "aida:startOffset", start, "int"), (s, "aida:endOffsetInclusive", stop, "int"), (s, "aida:source", "g", "str")]


def _entity(ent: str, d: str, linked: str, path: str):
    j = f"CASE WHEN {d}start IS NOT NULL AND {d}stop IS NOT NULL THEN 'urn:claims/' || g || '/{path} || '/' || {d}start || '/' || {d}stop END"
    k = f"CASE WHEN {linked} THEN {_b(ent, 'link')} END"
    return [*_kind(ent, "aida:Entity"), (ent, "aida:justifiedBy", j, "iri"), (ent, "aida:link", k, "blank"), *_kind(k, "aida:LinkAssertion"), (k, "aida:linkTarget", f"{d}id", "str"), *_sure(k, f"{d}conf"), *_private(ent, f"{d}ent"), *_at(j, f"{d}start", f"{d}stop", f"{d}conf")]


def _slot(name: str, part: str, prop: str):
    told = "'{qnode_id:' || d_id || ',text:' || d_text || '}'"
    told = f"CASE WHEN d_id IS NULL THEN '{{text:' || d_text || '}}' ELSE {told} END"
    me = f"('https://www.caci.com/claim-example#claim_' || g || '_' || claim_id || '_{part}')"
    return _rows(f"s{name[0]}", (f"uri", f"aida:{prop}", me, "iri"), ("uri", "aida:associatedKEs", "cluster", "iri"), *_kind("cluster", "aida:SameAsCluster"), ("cluster", "aida:prototype", "ent", "iri"), *_kind(me, "aida:ClaimComponent"), (me, "aida:componentName", "d_text", "str"), (me, "aida:componentType", "k_id", "str"),
        (me, "aida:componentIdentity", f"CASE WHEN linked THEN d_id ELSE {_NIL.format(t='k_text')} END", "str"), (me, "aida:componentKE", "ent", "iri"), *_private(me, told), *_entity("ent", "d_", "linked", f"{name}/entityjustification/0'"))


_COLS = [c.split()[0] for c in _NODE]
_PICK = lambda a, b: ", ".join(f"CASE WHEN {a}_id IS NOT NULL THEN {a}_{c} ELSE {b}_{c} END AS d_{c}" for c in _COLS)
_EVENT, _EVTOLD = "('urn:claims/events/own/' || g || '/' || nm)", "'{qnode_id:' || qnode_id || ',text:' || text || '}'"
_ECLUSTER, _EAT = "('urn:claims/clusters/own/events/' || g || '/' || nm)", "|| '/' || g || '/' || span_start || '/' || span_stop)"
_EINF, _EJUST = f"('urn:claims/assertions/own/event_informative_justification/' || nm {_EAT}", f"('urn:claims/assertions/own/eventjustification/' || nm {_EAT}"
_ETYPE = "('urn:claims/assertions/own/eventtype/' || g || '/' || nm || '/' || replace(text, ' ', '_') || '/EventType-' || qnode_id)"
_ENT, _ACLUSTER = "('urn:claims/entities/own/' || g || '/' || an)", "('urn:claims/clusters/own/entity/' || g || '/' || an)"
_AARG = "('urn:claims/assertions/own/eventarg/' || g || '/' || nm || '/' || replace(text, ' ', '_') || '.' || role || '/EventArgument-' || d_id)"
_ATYPE = "CASE WHEN t_id IS NOT NULL THEN 'urn:claims/assertions/own/entitytype/' || g || '/' || an || '/' || replace(t_text, ' ', '_') || '/' || t_id END"
_JUST = "('urn:claims/claims/justifications/' || g || '/' || start || '/' || stop)"
_LOC = f"CASE WHEN location IS NOT NULL THEN '{iri('aida:')}' || location END"
_AIF = f"""e0 AS (SELECT *, regexp_replace(doc_id, '\\.[^.]*$', '') AS g FROM aev WHERE qnode_id IS NOT NULL AND span_start IS NOT NULL AND text <> 'Unspecified'),
e AS (SELECT *, 'EN_Event_' || lpad((row_number() OVER (ORDER BY doc_id, claim_id, ord) - 1)::VARCHAR, 6, '0') AS nm, 'urn:claims/' || g || '/claim_id/' || claim_id AS uri FROM e0),
ar AS (SELECT aar.*, e.* EXCLUDE (event_id, ord), e.ord AS e_ord, row_number() OVER (PARTITION BY claim_id ORDER BY e.ord, aar.ord) - 1 AS k FROM aar JOIN e USING (event_id) WHERE CASE WHEN t_id IS NOT NULL OR t_text IS NOT NULL THEN t_id IS NOT NULL AND t_start IS NOT NULL ELSE i_id IS NOT NULL AND i_start IS NOT NULL END),
c0 AS (SELECT acl.* EXCLUDE ({', '.join(f'ct_{c}, ci_{c}' for c in _COLS)}), NOT ({_HAS('ct')}) AS author, {', '.join(f"CASE WHEN {_HAS('ct')} THEN ct_{c} ELSE {v} END AS ct_{c}" for c, v in zip(_COLS, ["'Q5'", "'human'", "0", "0", "1.0", "NULL"], strict=True))},
  {', '.join(f"CASE WHEN {_HAS('ct')} THEN ci_{c} END AS ci_{c}" for c in _COLS)}, regexp_replace(doc_id, '\\.[^.]*$', '') AS g, ({_HAS('xt')})::INT AS has_x, (SELECT count(*) FROM ar WHERE ar.claim_id = acl.claim_id) AS n_args FROM acl WHERE claim_id IN (SELECT claim_id FROM e)),
c AS (SELECT *, 'urn:claims/' || g || '/claim_id/' || claim_id AS uri, 1 + coalesce(sum(n_args + has_x + 1) OVER (ORDER BY doc_id, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c0),
sx AS (SELECT g, uri, claim_id, xi_id IS NOT NULL AS linked, xt_id AS k_id, xt_text AS k_text, 'urn:claims/clusters/own/entity/' || g || '/' || claim_id || '/x_variable/' || (base + n_args)::INT AS cluster, 'urn:claims/' || g || '/claim/' || claim_id || '/x_variable/entity/' || (base + n_args)::INT AS ent, {_PICK('xi', 'xt')} FROM c WHERE has_x = 1),
sc AS (SELECT g, uri, claim_id, ci_id IS NOT NULL AS linked, ct_id AS k_id, ct_text AS k_text, CASE WHEN author THEN 'urn:claims/clusters/own/entity/' || g || '/EN_Entity_EDL_ENG_0000000' ELSE 'urn:claims/clusters/own/entity/' || g || '/' || claim_id || '/claimer/' || (base + n_args + has_x)::INT END AS cluster,
  CASE WHEN author THEN 'urn:claims/entities/own/' || g || '/EN_Entity_EDL_ENG_0000000' ELSE 'urn:claims/' || g || '/claim/' || claim_id || '/claimer/entity/' || (base + n_args + has_x)::INT END AS ent, {_PICK('ci', 'ct')} FROM c),
a AS (SELECT ar.*, 'EN_Entity_EDL_ENG_' || lpad((base + k)::INT::VARCHAR, 7, '0') AS an, {_PICK('i', 't')} FROM ar JOIN c USING (claim_id)),
aif AS (SELECT DISTINCT * FROM (
{_rows('c', ("'urn:claims'", 'a', _q('aida:System'), 'iri'), *_kind('uri', 'aida:Claim'), ('uri', 'aida:sourceDocument', 'doc_id', 'str'), ('uri', 'aida:claimId', 'claim_id', 'str'), ('uri', 'aida:topic', 'topic', 'str'), ('uri', 'aida:subtopic', 'subtopic', 'str'), ('uri', 'aida:claimTemplate', 'template', 'str'), ('uri', 'aida:naturalLanguageDescription', "replace(regexp_replace(claim_text, ' +', ' ', 'g'), chr(34), '')", 'str'), ('uri', 'aida:claimLocation', _LOC, 'iri'), *_kind(_LOC, 'aida:ClaimComponent'), (_LOC, 'aida:componentName', 'location', 'str'), ('uri', 'aida:justifiedBy', _JUST, 'iri'), *_at(_JUST, 'start', 'stop', '1.0'))}
UNION ALL {_slot('x_variable', 'X', 'xVariable')}
UNION ALL {_slot('claimer', 'claimer', 'claimer')}
UNION ALL {_rows('e', ('uri', 'aida:claimSemantics', _ECLUSTER, 'iri'), ('uri', 'aida:associatedKEs', _ECLUSTER, 'iri'), *_kind(_ECLUSTER, 'aida:SameAsCluster'), (_ECLUSTER, 'aida:prototype', _EVENT, 'iri'), *_kind(_EVENT, 'aida:Event'), *_sure(_EVENT, 'confidence'), *_private(_EVENT, _EVTOLD), (_EVENT, 'aida:informativeJustification', _EINF, 'iri'), *_at(_EINF, 'span_start', 'span_stop', 'confidence'), *_private(_EINF, _EVTOLD), (_EVENT, 'aida:justifiedBy', _EJUST, 'iri'), *_at(_EJUST, 'span_start', 'span_stop', 'confidence'), *_private(_EJUST, _EVTOLD), *_kind(_ETYPE, 'rdf:Statement', 'aida:TypeStatement'), (_ETYPE, 'rdf:subject', _EVENT, 'iri'), (_ETYPE, 'rdf:predicate', _q('a'), 'iri'), (_ETYPE, 'rdf:object', 'qnode_id', 'str'))}
UNION ALL {_rows('a', ('uri', 'aida:claimSemantics', _ACLUSTER, 'iri'), ('uri', 'aida:associatedKEs', _ACLUSTER, 'iri'), *_kind(_ACLUSTER, 'aida:SameAsCluster'), (_ACLUSTER, 'aida:prototype', _ENT, 'iri'), *_entity(_ENT, 'd_', 'i_id IS NOT NULL', "' || role || '/entityjustification/' || an"), *_kind(_AARG, 'rdf:Statement', 'aida:ArgumentStatement'), (_AARG, 'rdf:subject', _EVENT, 'iri'), (_AARG, 'rdf:predicate', 'role', 'str'), (_AARG, 'rdf:object', _ENT, 'iri'), *_kind(_ATYPE, 'rdf:Statement', 'aida:TypeStatement'), (_ATYPE, 'rdf:subject', _ENT, 'iri'), (_ATYPE, 'rdf:predicate', _q('a'), 'iri'), (_ATYPE, 'rdf:object', 't_id', 'str'))}
) WHERE s IS NOT NULL AND o IS NOT NULL)"""
_AT = with_fixtures(A_CLAIMS, A_EVENTS, A_ARGS)
ORACLE["aif_triples"] = f"{_AT}, {_AIF} SELECT * FROM aif"

#: Another system's graphs of the same documents.
OTHERS = Fixture(
    "oth", "graph_id string, s string, p string, o string",
    _full([
        ("D1", "http://o/x#c1", "a", "aida:Claim"), ("D1", "http://o/x#c1", "aida:claimSemantics", "http://o/clusters/1"), ("D1", "http://o/x#c1", "aida:associatedKEs", "http://o/clusters/1"), ("D1", "http://o/x#c1", "aida:justifiedBy", "http://o/j"), ("D1", "http://o/j", "a", "aida:TextJustification"), ("D1", "http://o/j", "aida:sourceDocument", "D1"),
        ("D1", "http://o/events/1", "a", "aida:Event"), *_span("D1", "http://o/events/1", "http://o/w1", 3, 10), ("D1", "http://o/entities/2", "a", "aida:Entity"), *_span("D1", "http://o/entities/2", "http://o/w2", 1, 2), ("D2", "http://o/x#c3", "a", "aida:Claim"), ("D2", "http://o/x#c3", "aida:claimSemantics", "http://o/z"),
    ]),
)


def _written_claims(spark):
    path = f"{shared_dir(spark)}/claims-ttl-{uuid.uuid4().hex}"
    turtle.write_turtle(aif_triples(spark, ""), path)
    return turtle.read_turtle(spark, path)


def aif_merge(spark, sf_dir):
    """Claims to triples, to Turtle files, and back, merged with another system's graphs."""
    return G.merge_stores(_written_claims(spark).select("graph_id", "s", "p", "o"), OTHERS.df(spark))


ORACLE["aif_merge"] = f"{_AT.replace('WITH ', 'WITH RECURSIVE ', 1)}, {OTHERS.sql()}, {_AIF}, {_merged('aif', 'oth')} SELECT * FROM mg"


def slot_ratios(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    c = e.select(F.when(F.col("event_type") != "click", F.col("user_id")).alias("x"), F.when(k % 2 == 0, k).alias("x_identity"), F.when(k % 3 == 0, k).alias("x_type"), F.when(F.col("event_type") == "nothing", 1).alias("claimer"), k.alias("claimer_identity"), k.alias("claimer_type"))
    return analysis.slot_ratios(c, ["x", "claimer"], ["identity", "type"])


ORACLE["slot_ratios"] = """WITH c AS (SELECT CASE WHEN event_type <> 'click' THEN user_id END AS x, json_extract_string(props, '$.k')::INT AS k, CASE WHEN event_type = 'nothing' THEN 1 END AS w FROM events)
SELECT count(*) AS n_claims, round(count(x)::DOUBLE / count(*), 6) AS x_share, round(count(*) FILTER (WHERE x IS NOT NULL AND k % 2 = 0)::DOUBLE / nullif(count(x), 0), 6) AS x_identity_share, round(count(*) FILTER (WHERE x IS NOT NULL AND k % 3 = 0)::DOUBLE / nullif(count(x), 0), 6) AS x_type_share,
round(count(w)::DOUBLE / count(*), 6) AS claimer_share, round(count(*) FILTER (WHERE w IS NOT NULL)::DOUBLE / nullif(count(w), 0), 6) AS claimer_identity_share, round(count(*) FILTER (WHERE w IS NOT NULL)::DOUBLE / nullif(count(w), 0), 6) AS claimer_type_share FROM c"""


def entity_histogram(spark, sf_dir):
    """Events as slots: those that aren't clicks have an entity, their user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return analysis.entity_histogram(e.select(F.when(F.col("event_type") != "click", F.col("user_id")).alias("ent_id")))


ORACLE["entity_histogram"] = """WITH h AS (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1), t AS (SELECT count(*) AS n_slots FROM events)
SELECT n_slots, count(*) AS n_entities, count(*) FILTER (WHERE n > 1) AS n_repeated, sum(n)::BIGINT AS n_mentions, max(n) AS most, round(sum(n)::DOUBLE / n_slots, 6) AS mention_share FROM h, t GROUP BY n_slots"""


def overlap_counts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), (F.col("turn") % 3).alias("start"), F.char_length("text").alias("stop"), F.substring("text", 1, 3).alias("sentence"), "role")
    return analysis.overlap_counts(c.where("role = 'user'"), c.where("role <> 'user'"))


ORACLE["overlap_counts"] = """WITH c AS (SELECT conv_id, turn % 3 AS a, length(text) AS b, text[:3] AS s, role FROM conversations)
SELECT (SELECT count(*) FROM c x JOIN c y ON x.conv_id = y.conv_id AND x.a = y.a AND x.b = y.b WHERE x.role = 'user' AND y.role <> 'user') AS same_span, (SELECT count(*) FROM c x JOIN c y ON x.conv_id = y.conv_id AND x.s = y.s WHERE x.role = 'user' AND y.role <> 'user') AS same_sentence"""


def topic_counts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.groupBy(F.col("lang").alias("topic"), F.col("source").alias("subtopic")).agg(F.count("*").alias("n"))


ORACLE["topic_counts"] = "SELECT lang AS topic, source AS subtopic, count(*) AS n FROM documents GROUP BY 1, 2"


def merge_report(spark, sf_dir):
    return analysis.merge_report(G.merge_stores(FIRST.df(spark), SECOND.df(spark)), "k/clusters")


def merge_totals(spark, sf_dir):
    a, b = FIRST.df(spark), SECOND.df(spark)
    return analysis.merge_totals(a, b, G.merge_stores(a, b), "k/clusters")


_ADDED = f"ad AS (SELECT s AS claim, o AS uri, CASE WHEN contains(o, 'events') THEN 1 ELSE 0 END AS ev FROM mg WHERE p = {_q('aida:claimSemantics')} AND contains(o, 'k/clusters') AND {_is('mg', 'mg.s', 'aida:Claim')})"
ORACLE["merge_report"] = f"{_TRR}, {_merged('fst', 'snd')}, {_ADDED} SELECT claim, coalesce(string_agg(uri, ' ' ORDER BY uri) FILTER (WHERE ev = 1), '') AS events, coalesce(string_agg(uri, ' ' ORDER BY uri) FILTER (WHERE ev = 0), '') AS entities FROM ad GROUP BY 1"
ORACLE["merge_totals"] = f"{_TRR}, {_merged('fst', 'snd')}, {_ADDED} SELECT (SELECT count(*) FROM mg WHERE p = {_q('a')} AND o = {_q('aida:Claim')}) AS n_claims, count(DISTINCT claim) AS n_modified, sum(ev)::BIGINT AS n_events, sum(1 - ev)::BIGINT AS n_entities, (SELECT count(*) FROM hit) AS n_replaced FROM ad"


def qnode_accuracy(spark, sf_dir):
    q = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("qnode"), F.col("quality").alias("good"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("qnode"), "lang")
    return analysis.qnode_accuracy(d, q, "lang")


ORACLE["qnode_accuracy"] = "SELECT lang, count(*) AS n_judged, round(avg(quality), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1"

QUERIES = {n: globals()[n] for n in ORACLE}
