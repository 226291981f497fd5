"""Queries over events, their nodes and arguments, and adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import adapters, names as N
from ..operators import aif, amr, semantics as S
from ..session import small_batches
from . import talk, workflow
from .fixture import Fixture, with_fixtures
from .graphs import _STOP_SQL, ALIGNED, NODES, TOKENS, _talk
from .linking import CANDIDATES

ORACLE: dict[str, str] = {}

NAMES = Fixture("nm", "c string, k string, a string", [("human_being_Q5", "A0-he-she", "A0_x_agent"), ("None", "A1", "AM_loc_at_place"), ("+food_Q2", "AM-loc", "mnr_how_x"), ("Q7", "", "Ax_A3"), ("a+b_c_Q9", "A2-z", "_x_y")])


def role_names(spark, sf_dir):
    d = NAMES.df(spark)
    return d.select("c", "k", "a", N.constraint(F.col("c")).alias("x"), N.master_role(F.col("k")).alias("m"), N.overlay_role(F.col("a")).alias("o")).select(
        "c", "k", "a", F.col("x.name").alias("c_name"), F.col("x.wd_node").alias("c_node"), F.col("m.role").alias("m_role"), F.col("m.text_role").alias("m_text"), F.col("o.role").alias("o_role"), F.col("o.text_role").alias("o_text"),
    )


ORACLE["role_names"] = f"""{with_fixtures(NAMES)}, p AS (SELECT *, string_split(c, '_') AS cs, string_split(k, '-') AS ks, string_split(a, '_') AS xs FROM nm)
SELECT c, k, a, CASE WHEN c <> 'None' THEN replace(array_to_string(cs[1:len(cs) - 1], '_'), '+', '') END AS c_name, CASE WHEN c <> 'None' THEN cs[-1] END AS c_node, ks[1] AS m_role, array_to_string(ks[2:], '-') AS m_text,
CASE WHEN xs[1] IN ('AM', 'Ax', 'mnr') THEN xs[2] ELSE xs[1] END AS o_role, array_to_string(xs[3:], '-') AS o_text FROM p"""

OVER_ARGS = Fixture("oargs", "qnode string, ord int, name string", [("Q1", 0, "A0_x_agent"), ("Q1", 1, "AM_loc_at_place"), ("Q1", 2, "A0_y_who_acts"), ("Q3", 0, "_x")])
MASTER_ROLES = Fixture("mroles", "qnode string, ord int, key string", [("Q1", 0, "A1-what"), ("Q2", 0, "A0-who"), ("Q2", 1, "A1-it-that"), ("Q3", 0, "A1")])


def node_roles(spark, sf_dir):
    return S.roles_of(OVER_ARGS.df(spark), MASTER_ROLES.df(spark))


_ROLES = """oa AS (SELECT qnode, ord, string_split(name, '_') AS x FROM oargs), ob AS (SELECT qnode, ord, CASE WHEN x[1] IN ('AM', 'Ax', 'mnr') THEN x[2] ELSE x[1] END AS role, array_to_string(x[3:], '-') AS t FROM oa),
oc AS (SELECT * FROM ob WHERE role <> ''), md AS (SELECT qnode, ord, string_split(key, '-')[1] AS role, array_to_string(string_split(key, '-')[2:], '-') AS t FROM mroles WHERE qnode NOT IN (SELECT qnode FROM oc)),
rl AS (SELECT qnode, role, arg_max(t, ord) AS text_role FROM (SELECT * FROM oc UNION ALL SELECT * FROM md) GROUP BY 1, 2)"""
ORACLE["node_roles"] = f"{with_fixtures(OVER_ARGS, MASTER_ROLES)}, {_ROLES} SELECT * FROM rl"


def candidate_roles(spark, sf_dir):
    c = CANDIDATES.df(spark).select("query", "qnode")
    return S.roles_of_candidates(c, S.roles_of(OVER_ARGS.df(spark), MASTER_ROLES.df(spark)))


ORACLE["candidate_roles"] = f"{with_fixtures(OVER_ARGS, MASTER_ROLES, CANDIDATES)}, {_ROLES} SELECT query, cand.qnode, role, text_role FROM cand JOIN rl ON rl.qnode = cand.qnode"

MENTS = Fixture("mts", "m_id int, graph_id string, text string", [(1, "g1", "the bad flu"), (2, "g1", "Ann Lee said"), (3, "g1", "of the"), (4, "g3", "New Land"), (5, "g9", "flu"), (6, "g2", "things and")])


def mention_labels(spark, sf_dir):
    n, t, a = NODES.df(spark), TOKENS.df(spark), ALIGNED.df(spark)
    return S.mention_labels(MENTS.df(spark), n, t, a)


ORACLE["mention_labels"] = f"""{with_fixtures(NODES, TOKENS, ALIGNED, MENTS)}, w AS (SELECT m_id, graph_id, list_filter(string_split(text, ' '), lambda x: x NOT IN ('the', 'of', 'and'))[-1] AS word FROM mts)
SELECT m_id, label FROM (SELECT m_id, label, row_number() OVER (PARTITION BY m_id ORDER BY n.ord DESC) AS k FROM w JOIN tokens t ON t.graph_id = w.graph_id AND t.token = w.word JOIN aligned a ON a.graph_id = t.graph_id AND a.token_idx = t.idx JOIN nodes n ON n.graph_id = a.graph_id AND n.node_id = a.node_id) WHERE k = 1"""

CHOSEN = Fixture("chosen", "pb string, qnode string, score double", [("say-01", "Q1", 0.0), ("prevent-01", "Q2", 0.4), ("keep-01", "Q3", None), ("start-01", "Q4", 0.9)])


def claim_events(spark, sf_dir):
    n, e, t, s = _talk(spark, sf_dir)
    return S.claim_events(n, e, s, CHOSEN.df(spark), S.roles_of(OVER_ARGS.df(spark), MASTER_ROLES.df(spark)))[0]


def claim_event_arguments(spark, sf_dir):
    n, e, t, s = _talk(spark, sf_dir)
    return S.claim_events(n, e, s, CHOSEN.df(spark), S.roles_of(OVER_ARGS.df(spark), MASTER_ROLES.df(spark)))[1]


#: Equal labels of a graph all stand at its first node of that label.
_EV = f"""WITH {talk.SQL}, {with_fixtures(CHOSEN, OVER_ARGS, MASTER_ROLES).removeprefix("WITH ")},
pb AS (SELECT graph_id, ord, label, arg_min(node_id, ord) OVER (PARTITION BY graph_id, label) AS first FROM nodes WHERE regexp_matches(label, '^[a-z, -]*-[0-9]{{2}}')),
et AS (SELECT pb.graph_id, pb.ord, label AS pb, first AS node_id, qnode, score, string_split(coalesce(st.text, ''), ' ') AS w FROM pb JOIN chosen ON pb = label LEFT JOIN st ON st.graph_id = pb.graph_id AND st.node_id = first),
ev AS (SELECT graph_id, ord, pb, node_id, qnode, {talk.sql_clip("w", _STOP_SQL)} AS text, CASE WHEN coalesce(score, 0) = 0 THEN 1.0::DOUBLE ELSE score END AS confidence FROM et)"""
ORACLE["claim_events"] = f"{_EV} SELECT * FROM ev WHERE text <> ''"
ORACLE["claim_event_arguments"] = f"""{_EV}, {_ROLES}, es AS (SELECT DISTINCT graph_id, node_id, qnode FROM ev WHERE text <> ''),
a AS (SELECT e.graph_id, es.node_id AS event, e.ord, qnode, replace(replace(replace(role, ':', ''), '-of', ''), 'ARG', 'A') AS role, CASE WHEN role LIKE '%-of' THEN parent ELSE child END AS node_id FROM edges e JOIN es ON es.graph_id = e.graph_id AND ((role NOT LIKE '%-of' AND parent = es.node_id) OR (role LIKE '%-of' AND child = es.node_id)) WHERE regexp_matches(role, 'ARG|time|location|direction')),
b AS (SELECT a.graph_id, event, a.role, a.ord, label, string_split(coalesce(st.text, ''), ' ') AS w FROM a JOIN rl ON rl.qnode = a.qnode AND rl.role = CASE WHEN a.role IN ('location', 'direction') THEN a.role[1:3] ELSE a.role END JOIN nodes n ON n.graph_id = a.graph_id AND n.node_id = a.node_id LEFT JOIN st ON st.graph_id = a.graph_id AND st.node_id = a.node_id),
c AS (SELECT *, {talk.sql_clip("w", _STOP_SQL)} AS clipped FROM b)
SELECT graph_id, event, CASE WHEN role IN ('location', 'direction') THEN role[1:3] ELSE role END AS role, arg_max(CASE WHEN clipped <> '' THEN clipped ELSE regexp_replace(label, '-[^-]*$', '') END, ord) AS text FROM c GROUP BY 1, 2, 3"""


def best_options(spark, sf_dir):
    c = CANDIDATES.df(spark)
    return S.qnode_records(S.best_option(c).select("query", "qnode"), c)


ORACLE["best_options"] = f"{with_fixtures(CANDIDATES)} SELECT query, qnode, label[1] AS name, description[1] AS description, score AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS k FROM cand WHERE score > 0) WHERE k = 1"


def _chain():
    """A parser that makes each word a node below the one before."""

    def parse(sentences):
        return [([(f"n{i}", w) for i, w in enumerate(s)], [(f"n{i}", ":mod", f"n{i + 1}") for i in range(len(s) - 1)], [(f"n{i}", i) for i in range(len(s))], "n0") if s else None for s in sentences]

    return parse


def parser_adapter(spark, sf_dir):
    """Node texts of graphs from the parser adapter: each word of each turn."""
    c = small_batches(spark).read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws("-", "conv_id", "turn").alias("graph_id"), F.filter(F.split("text", " "), lambda w: w != "").alias("tokens"))
    t = adapters.parse_graphs(c, _chain)
    tokens = c.select("graph_id", F.posexplode("tokens").alias("idx", "token"))
    return amr.node_strings(tokens, t["alignments"])


ORACLE["parser_adapter"] = """WITH t AS (SELECT conv_id || '-' || turn AS graph_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM conversations), u AS (SELECT graph_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS text FROM t)
SELECT graph_id, 'n' || i AS node_id, text FROM u WHERE NOT contains('!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', text)"""


def lookup_adapter(spark, sf_dir):
    def load():
        def ask(query, size):
            if query == "virus":
                raise TimeoutError
            return [{"qnode": "Q1", "label": [query], "score": 0.5}, {"qnode": "Q2"}][:size]

        return ask

    q = spark.createDataFrame([("mask",), ("mask",), ("virus",), ("and/or",)], "query string")
    return adapters.fetch_candidates(q, load).select("query", "ord", "qnode", F.get("label", F.lit(0)).alias("name"), "score")


ORACLE["lookup_adapter"] = "SELECT * FROM (VALUES ('mask', 0, 'Q1', 'mask', 0.5::DOUBLE), ('mask', 1, 'Q2', '', NULL)) v(query, ord, qnode, name, score)"

_SIDE = "{s}_text string, {s}_start int, {s}_stop int, {s}_id string, {s}_name string"
L_CLAIMS = Fixture(
    "lcl", "claim_id string, doc_id string, " + ", ".join(_SIDE.format(s=s) for s in ("x", "claimer")),
    [
        ("c1", "D1.rsd", "it", 3, 4, "Q1", "thing", "Ann", 10, 12, "Q2", "name"), ("c2", "D1", "Rome", 20, 23, None, None, None, None, None, None, None), ("c3", "D2.a.b", "x", 3, 4, "Q3", "letter", "Bob", 30, 32, "Q4", "bob"),
        ("c4", "D2", None, None, None, None, None, "nowhere", None, None, "Q5", "human"), ("c5", "D3", "it", 3, 4, "Q6", "thing", "Eve", 1, 3, "Q7", "eve"),
    ],
)
L_ARGS = Fixture("lar", "event_id string, claim_id string, role string, ord int, id string, name string, start int, stop int", [("c1/e", "c1", "A0", 0, "Q11", "arg", 10, 12), ("c1/e", "c1", "A1", 0, "Q12", "lone", 50, 52), ("c3/e", "c3", "A0", 0, None, None, None, None), ("c5/e", "c5", "loc", 0, "Q13", "town", 1, 3)])
L_EDL = Fixture(
    "led", "ord int, ent_id string, doc_id string, start int, stop int, ent_type string, ent_link string, type_link string",
    [(0, ":E1", "D1", 10, 12, "PER.Writer", "Q18", None), (1, ":E2", "D1", 20, 23, "LOC", None, "Q50"), (2, ":E3", "D2", 30, 32, "ORG.Club", None, None), (3, ":E4", "D2", 3, 4, "XX", "Q404", "Q405"), (4, ":E5", "D3.x", 1, 3, "GPE.City", "Q60", "Q61"), (5, ":E6", "D3", 3, 5, "PER", None, None)],
)
L_KNOWN = Fixture("lkn", "qnode string, name string", [("Q18", "Ann Lee"), ("Q50", "city"), ("Q60", "Rome"), ("Q61", "town")])


def claim_linking(spark, sf_dir):
    """Open variables, claimers and arguments matched with entities."""
    part = lambda a, b, c, d: F.when(F.col(a).isNotNull(), F.struct(F.col(a).alias("qnode_id"), F.col(b).alias("text"), F.col(c).alias("start"), F.col(d).alias("stop"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("entity")))
    none = F.lit(None).cast(aif.NODE)
    c = L_CLAIMS.df(spark).withColumns({f"{s}_type": part(f"{s}_id", f"{s}_name", f"{s}_start", f"{s}_stop") for s in ("x", "claimer")} | {f"{s}_identity": none for s in ("x", "claimer")})
    a = L_ARGS.df(spark).withColumns({"type": part("id", "name", "start", "stop"), "identity": none})
    claims, args = workflow.link_claims(c, a.select("event_id", "claim_id", "role", "ord", "type", "identity"), L_EDL.df(spark), L_KNOWN.df(spark))
    out = lambda df, slot, t, i: df.select("claim_id", slot.alias("slot"), *[F.col(f"{t}.{f}").alias(f"type_{f}") for f in ("qnode_id", "text", "start")], *[F.col(f"{i}.{f}").alias(f"identity_{f}") for f in ("qnode_id", "text", "start", "confidence")], F.col(f"{i}.entity").isNotNull().alias("entity"))
    return out(claims, F.lit("x"), "x_type", "x_identity").unionByName(out(claims, F.lit("claimer"), "claimer_type", "claimer_identity")).unionByName(out(args, F.concat_ws("/", F.lit("argument"), "role"), "type", "identity"))


ORACLE["claim_linking"] = f"""{with_fixtures(L_CLAIMS, L_ARGS, L_EDL, L_KNOWN)}, kinds(k, q, n) AS (VALUES ('PER', 'Q5', 'human'), ('LOC', 'Q2221906', 'geographic location'), ('ORG', 'Q43229', 'organization'), ('GPE', 'Q52110228', 'geopolitical group')),
sl AS (SELECT claim_id, doc_id, 'x' AS slot, x_text IS NOT NULL AS had, x_start AS a, x_stop AS b, x_id AS q, x_name AS n FROM lcl UNION ALL SELECT claim_id, doc_id, 'claimer', claimer_text IS NOT NULL, claimer_start, claimer_stop, claimer_id, claimer_name FROM lcl
  UNION ALL SELECT claim_id, doc_id, 'argument/' || role, id IS NOT NULL, start, stop, id, name FROM lar JOIN lcl USING (claim_id))
SELECT claim_id, slot, CASE WHEN ent_id IS NULL THEN sl_q WHEN type_link IS NOT NULL THEN CASE WHEN type_name IS NOT NULL THEN type_link END ELSE kq END AS type_qnode_id, CASE WHEN ent_id IS NULL THEN sl_n WHEN type_link IS NOT NULL THEN type_name ELSE kn END AS type_text,
  CASE WHEN ent_id IS NULL THEN CASE WHEN sl_q IS NOT NULL THEN a END WHEN type_link IS NOT NULL AND type_name IS NOT NULL AND sl_q IS NOT NULL THEN a END AS type_start,
  CASE WHEN ent_id IS NOT NULL THEN CASE WHEN ent_link IS NOT NULL THEN CASE WHEN link_name IS NOT NULL THEN ent_link END ELSE sl_q END END AS identity_qnode_id, CASE WHEN ent_id IS NOT NULL THEN CASE WHEN ent_link IS NOT NULL THEN link_name WHEN sl_q IS NOT NULL THEN sl_n END END AS identity_text,
  CASE WHEN ent_id IS NOT NULL AND sl_q IS NOT NULL AND (ent_link IS NULL OR link_name IS NOT NULL) THEN a END AS identity_start, CASE WHEN ent_id IS NOT NULL AND ent_link IS NULL AND sl_q IS NOT NULL THEN 0.5::DOUBLE END AS identity_confidence,
  ent_id IS NOT NULL AND CASE WHEN ent_link IS NOT NULL THEN link_name IS NOT NULL ELSE sl_q IS NOT NULL END AS entity
FROM (SELECT m.claim_id, slot, a, m.q AS sl_q, m.n AS sl_n, ent_id, ent_type, ent_link, type_link, link_name, type_name, kinds.q AS kq, kinds.n AS kn FROM (SELECT sl.*, e.ent_id, e.ent_type, e.ent_link, e.type_link, w.name AS link_name, t.name AS type_name FROM sl LEFT JOIN led e ON had AND string_split(e.doc_id, '.')[1] = string_split(sl.doc_id, '.')[1] AND e.start = a AND e.stop = b LEFT JOIN lkn w ON w.qnode = ent_link LEFT JOIN lkn t ON t.qnode = type_link) m LEFT JOIN kinds ON k = string_split(ent_type, '.')[1])"""

QUERIES = {n: globals()[n] for n in ORACLE}
