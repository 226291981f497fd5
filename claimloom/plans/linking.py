"""Queries over external entity tables, spans, candidates and knowledge-base nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates as K
from ..operators import claims as C
from ..operators import disambiguate as D
from ..operators import edl as E
from ..operators import qnodes as Q
from ..operators import spans as S
from .fixture import Fixture, with_fixtures

ORACLE: dict[str, str] = {}

LINES = Fixture(
    "lines", "ord int, line string",
    list(enumerate([
        ":E1\ttype\thttps://onto#LOC.Region", ":E1\tcanonical_mention\t\"South Land\"\tDOC1:10-19\t1.0", ":E1\tmention\t\"South Land\"\tDOC1:10-19\t0.9", ":E1\tlink\tNIL0001", ":E1\tlink\tQ18", ":E1\ttypelink\tQ5107",
        ":E2\ttype\thttps://onto#PER.Writer 12", ":E2\ttype\tnothing", ":E2\tmention\t\"Ann\"\tDOC1:30-32\t1.0", ":E2\tnominal_mention\t\"writer\"\tDOC2:5-10\t0.5", ":E9\tmention\t\"nobody\"\tDOC2:20-25\t1.0",
        ":E3\tlink\tNIL2", ":E3\tmention\t\"South Land coast\"\tDOC1:10-25\t1.0", "broken\tline", ":E2\tmention\t\"writer\"\tDOC2:5-10\t0.7", ":E1\tlink\tQ19",
    ])),
)
_F = "f AS (SELECT ord, string_split(line, chr(9)) AS f FROM lines)"
_ENT = _F + """,
v AS (SELECT ord, f[1] AS ent_id, CASE WHEN f[2] = 'type' THEN nullif(regexp_extract(f[3], '#(\\S+)', 1), '') END AS t, CASE WHEN f[2] = 'link' AND f[3] LIKE 'Q%' THEN f[3] END AS l, CASE WHEN f[2] = 'typelink' AND f[3] LIKE 'Q%' THEN f[3] END AS tl FROM f WHERE len(f) = 3),
ents AS (SELECT ent_id, arg_max(t, ord) FILTER (WHERE t IS NOT NULL) AS ent_type, arg_max(l, ord) FILTER (WHERE l IS NOT NULL) AS ent_link, arg_max(tl, ord) FILTER (WHERE tl IS NOT NULL) AS type_link FROM v GROUP BY 1),
raw AS (SELECT ord, f[1] AS ent_id, f[2] AS mention_type, trim(f[3], '"') AS text, string_split(f[4], ':')[1] AS doc_id, string_split(string_split(f[4], ':')[2], '-') AS p, f[5]::DOUBLE AS confidence FROM f WHERE len(f) = 5),
ments AS (SELECT * FROM (SELECT doc_id, p[1]::INT AS start, p[2]::INT AS stop, text, mention_type, ent_id, confidence, ord, row_number() OVER (PARTITION BY doc_id, p ORDER BY ord DESC) AS k FROM raw) WHERE k = 1)"""


def _fields(spark):
    return E.split_lines(LINES.df(spark))


def edl_entity_pivot(spark, sf_dir):
    return E.entities(_fields(spark))


def edl_mentions(spark, sf_dir):
    return E.mentions(_fields(spark)).drop("ord")


def edl_mention_entity(spark, sf_dir):
    return E.with_entities(E.mentions(_fields(spark)), E.entities(_fields(spark)))[0].drop("ord", "confidence")


def edl_orphans(spark, sf_dir):
    return E.with_entities(E.mentions(_fields(spark)), E.entities(_fields(spark)))[1].select("ent_id", "doc_id", "text")


ORACLE["edl_entity_pivot"] = f"{with_fixtures(LINES)}, {_ENT} SELECT * FROM ents"
ORACLE["edl_mentions"] = f"{with_fixtures(LINES)}, {_ENT} SELECT doc_id, start, stop, text, mention_type, ent_id, confidence FROM ments"
ORACLE["edl_mention_entity"] = f"{with_fixtures(LINES)}, {_ENT} SELECT doc_id, start, stop, text, mention_type, ent_id, ent_type, ent_link, type_link FROM ments JOIN ents USING (ent_id)"
ORACLE["edl_orphans"] = f"{with_fixtures(LINES)}, {_ENT} SELECT ent_id, doc_id, text FROM ments ANTI JOIN ents USING (ent_id)"


def edl_mention_last_wins(spark, sf_dir):
    """Events as mentions: of each user's equal positions the last one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id", (F.col("event_id") % 50).alias("start")).agg(F.max_by("event_type", "event_id").alias("mention_type"), F.max("event_id").alias("ord"))


ORACLE["edl_mention_last_wins"] = "SELECT user_id, event_id % 50 AS start, arg_max(event_type, event_id) AS mention_type, max(event_id) AS ord FROM events GROUP BY 1, 2"


def _event_spans(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = (F.col("event_id") * 7 % 3000).cast("long")
    m = e.where("event_type = 'click'").select(F.col("event_id").alias("m_id"), F.col("user_id").alias("doc"), start.alias("m_start"), (start + 40 * (F.col("event_id") % 40)).alias("m_stop"))
    s = e.where("event_type <> 'click'").select(F.col("event_id").alias("s_id"), F.col("user_id").alias("doc"), start.alias("s_start"), (start + F.col("event_id") % 9).alias("s_stop"))
    return m, s


_SPANS = """WITH m AS (SELECT event_id AS m_id, user_id AS doc, event_id * 7 % 3000 AS m_start, event_id * 7 % 3000 + 40 * (event_id % 40) AS m_stop FROM events WHERE event_type = 'click'),
s AS (SELECT event_id AS s_id, user_id AS doc, event_id * 7 % 3000 AS s_start, event_id * 7 % 3000 + event_id % 9 AS s_stop FROM events WHERE event_type <> 'click'),
e AS (SELECT m_id, min(s_id) AS s_id FROM m JOIN s ON m.doc = s.doc AND m_start = s_start AND m_stop = s_stop GROUP BY 1),
c AS (SELECT m_id, min(s_id) AS s_id FROM m JOIN s ON m.doc = s.doc AND m_start <= s_start AND m_stop >= s_stop GROUP BY 1)"""


def _equal_spans(spark, sf_dir):
    """Events of a group of users as short spans, of which many are equal."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = (F.col("event_id") * 7 % 300).cast("long")
    cols = lambda k, n: [F.col("event_id").alias(f"{k}_id"), (F.col("user_id") % 50).alias("doc"), start.alias(f"{k}_start"), (start + F.col("event_id") % n).alias(f"{k}_stop")]
    return e.where("event_type = 'click'").select(*cols("m", 4)), e.where("event_type <> 'click'").select(*cols("s", 9))


def span_exact(spark, sf_dir):
    return S.exact_spans(*_equal_spans(spark, sf_dir))


def span_contains_first(spark, sf_dir):
    return S.contained_spans(*_event_spans(spark, sf_dir))


def span_link(spark, sf_dir):
    return S.linked_spans(*_event_spans(spark, sf_dir))


ORACLE["span_exact"] = """SELECT m.event_id AS m_id, min(s.event_id) AS s_id FROM events m JOIN events s ON m.user_id % 50 = s.user_id % 50 AND m.event_id * 7 % 300 = s.event_id * 7 % 300 AND m.event_id % 4 = s.event_id % 9
WHERE m.event_type = 'click' AND s.event_type <> 'click' GROUP BY 1"""
ORACLE["span_contains_first"] = f"{_SPANS} SELECT * FROM c"
ORACLE["span_link"] = f"{_SPANS} SELECT m.m_id, coalesce(e.s_id, c.s_id) AS s_id, CASE WHEN e.s_id IS NOT NULL THEN 'exact' WHEN c.s_id IS NOT NULL THEN 'contained' END AS how FROM m LEFT JOIN e USING (m_id) LEFT JOIN c USING (m_id)"

NEAR_M = Fixture("near_m", "m_id int, doc string, m_start int, m_stop int", [(i, "d", 10 * i, 10 * i + 5) for i in range(1, 13)])
NEAR_S = Fixture(
    "near_s", "s_id int, doc string, s_start int, s_stop int",
    [(k, "d", 10 * i + a, 10 * i + 5 + b) for k, (i, a, b) in enumerate([(1, 0, 0), (2, -1, 0), (3, 0, 1), (4, 0, -1), (5, 1, 0), (6, 1, 1), (7, -1, -1), (8, 1, -1), (9, -1, 1), (10, 0, 0), (10, 0, 0), (10, 1, 1), (11, 2, 0), (12, 0, 0), (12, -1, -1), (1, 1, 0)])] + [(90, "d", 40, 39), (91, "x", 120, 125)],
)
_NEAR = f"""{with_fixtures(NEAR_M, NEAR_S)}, t AS (SELECT (ds + 1) * 3 + de + 1 AS probe, ds, de, CASE WHEN ds = 0 AND de = -1 THEN 1 ELSE 0 END AS odd FROM range(-1, 2) a(ds), range(-1, 2) b(de)),
j AS (SELECT m_id, s_id, probe FROM near_m m CROSS JOIN t JOIN near_s s ON m.doc = s.doc AND s_start = m_start + ds AND s_stop = CASE WHEN odd = 1 AND {{strict}} THEN m_start ELSE m_stop END + de)
SELECT m_id, s_id, probe FROM (SELECT *, row_number() OVER (PARTITION BY m_id ORDER BY probe, s_id DESC) AS k FROM j) WHERE k = 1"""


def span_fuzzy(spark, sf_dir):
    return S.near_spans(NEAR_M.df(spark), NEAR_S.df(spark))


def span_fuzzy_symmetric(spark, sf_dir):
    return S.near_spans(NEAR_M.df(spark), NEAR_S.df(spark), symmetric=True)


ORACLE["span_fuzzy"] = _NEAR.replace("{strict}", "true")
ORACLE["span_fuzzy_symmetric"] = _NEAR.replace("{strict}", "false")

KINDS = Fixture("kinds", "cluster string, found string", [("s/entity/1", "x/entities/2"), ("s/events/1", "x/events/2"), ("s/entity/1", "x/events/2"), ("s/events/3", "x/entities/1"), ("s/other", "x/entities/1")])


def kind_agreement(spark, sf_dir):
    from ..operators.graph import kinds_agree

    return KINDS.df(spark).select("cluster", "found", kinds_agree(F.col("cluster"), F.col("found")).alias("agree"))


ORACLE["kind_agreement"] = f"{with_fixtures(KINDS)} SELECT cluster, found, (contains(cluster, 'entity') AND contains(found, 'entities')) OR (contains(cluster, 'event') AND contains(found, 'events')) AS agree FROM kinds"

SLOTS = Fixture(
    "slots", "slot_id int, old_type string, s_id int, ent_type string, ent_link string, type_link string",
    [(1, "Q1", 5, "PER.Writer", "Q18", "Q5107"), (2, "Q2", 6, "LOC", None, None), (3, "Q3", None, None, None, None), (4, None, 7, "XYZ", "Q404", "Q405"), (5, "Q5", 8, None, None, "Q5107"), (6, "Q6", 9, "GPE.City.Big", "Q18", None)],
)
KNOWN = Fixture("known", "qnode string, name string", [("Q18", "South Land"), ("Q5107", "continent")])
_TYPES = "types(k, q) AS (VALUES " + ", ".join(f"('{k}', '{q}')" for k, (q, _) in E.TYPE_QNODES.items()) + ")"


def type_promotion(spark, sf_dir):
    return E.promote(SLOTS.df(spark), KNOWN.df(spark))


ORACLE["type_promotion"] = f"""{with_fixtures(SLOTS, KNOWN)}, {_TYPES} SELECT slot_id, CASE WHEN s_id IS NULL THEN NULL WHEN ent_link IS NOT NULL THEN a.qnode ELSE old_type END AS identity_qnode,
CASE WHEN s_id IS NULL THEN old_type WHEN type_link IS NOT NULL THEN b.qnode ELSE types.q END AS type_qnode
FROM slots LEFT JOIN known a ON a.qnode = ent_link LEFT JOIN known b ON b.qnode = type_link LEFT JOIN types ON types.k = string_split(ent_type, '.')[1]"""

CANDIDATES = Fixture(
    "cand", "query string, ord int, qnode string, label array<string>, alias array<string>, description array<string>, score double",
    [
        ("virus", 0, "Q1", ["virus"], [], ["agent"], 0.9), ("virus", 1, "Q2", ["computer virus"], [], ["program"], 0.4), ("virus", 2, "P3", ["virus type"], [], ["property"], 0.9), ("virus", 3, "Q4", ["Virus"], [], ["film"], 0.3),
        ("virus", 4, "Q5", ["germ"], ["small virus"], ["thing"], 0.4), ("virus", 5, "Q6", ["virus"], [], ["agent"], 0.95), ("virus", 6, "Q7", ["virus x"], [], None, 0.5), ("virus", 7, "Q8", ["virus y"], [], ["tiny"], 0.005),
        ("mask", 0, "Q9", ["mask"], None, ["cover"], 0.5), ("mask", 1, "Q10", ["face mask"], ["mask"], ["cover"], 0.5), ("mask", 2, "Q11", [""], [""], [""], 0.2), ("mask", 3, "Q12", ["a mask"], [], ["b"], 0.49), ("mask", 4, "Q13", ["c mask"], [], ["d"], 0.48),
    ],
)
_CAND = with_fixtures(CANDIDATES)
_KEEP = "coalesce(contains(label[1], query) OR len(list_filter(coalesce(alias, []), lambda a: contains(a, query))) > 0, false) AND description[1] IS NOT NULL AND qnode LIKE 'Q%'"


def candidate_filter(spark, sf_dir):
    return K.filtered(CANDIDATES.df(spark)).select("query", "qnode")


def candidate_dedup(spark, sf_dir):
    return K.deduplicated(CANDIDATES.df(spark)).select("query", "qnode")


def candidate_topk(spark, sf_dir):
    return K.top_k(K.deduplicated(K.filtered(CANDIDATES.df(spark)))).select("query", "qnode", "rank", "score")


def candidate_topk_scale(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    scored = l.select(F.col("l_partkey").alias("query"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.col("l_discount").alias("score"))
    return K.top_k(scored)


_DEDUP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, coalesce(label[1], ''), coalesce(description[1], '') ORDER BY ord) AS k FROM {t}) WHERE k = 1"
ORACLE["candidate_filter"] = f"{_CAND} SELECT query, qnode FROM cand WHERE {_KEEP}"
ORACLE["candidate_dedup"] = f"{_CAND} SELECT query, qnode FROM ({_DEDUP.format(t='cand')})"
ORACLE["candidate_topk"] = f"{_CAND}, f AS (SELECT * FROM cand WHERE {_KEEP}), d AS ({_DEDUP.format(t='f')}) SELECT query, qnode, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord) AS rank FROM d) WHERE rank <= 3 AND score >= 0.01"
ORACLE["candidate_topk_scale"] = "SELECT query, ord, score, rank::INT AS rank FROM (SELECT l_partkey AS query, l_orderkey * 8 + l_linenumber AS ord, l_discount AS score, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_orderkey * 8 + l_linenumber) AS rank FROM lineitem) WHERE rank <= 3 AND score >= 0.01"

OPTIONS = Fixture("opts", "query string, list string, ord int, qnode string", [("a", "options", 0, "Q1"), ("a", "options", 1, "Q1"), ("a", "other", 0, "Q1"), ("a", "other", 1, "Q2"), ("b", "other", 1, "Q4"), ("b", "other", 0, "Q3"), ("c", "all", 5, "Q7"), ("c", "all", 3, "Q8")])


def options_exclude(spark, sf_dir):
    o = OPTIONS.df(spark)
    return K.exclude_options(o.where("list = 'options'"), o.where("list = 'other'"))


def options_pick(spark, sf_dir):
    return K.pick(OPTIONS.df(spark))


ORACLE["options_exclude"] = f"{with_fixtures(OPTIONS)}, a AS (SELECT DISTINCT query, qnode FROM opts WHERE list = 'options') SELECT query, qnode, 'options' AS list FROM a UNION ALL SELECT DISTINCT query, qnode, 'other' FROM opts o WHERE list = 'other' AND NOT EXISTS (SELECT 1 FROM a WHERE a.query = o.query AND a.qnode = o.qnode)"
ORACLE["options_pick"] = f"{with_fixtures(OPTIONS)} SELECT query, qnode FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE list WHEN 'options' THEN 0 WHEN 'other' THEN 1 ELSE 2 END, ord) AS k FROM opts) WHERE k = 1"

WORDS = Fixture("q", "word string", [("running",), ("runs",), ("transmit",), ("dog cat",), ("xy",), ("cured",), ("curing",), ("generously",), ("flies",), ("happiness",), ("unknowns",)])
STEMS = Fixture("stems", "stem string, words array<string>", [("run", ["run", "running", "ran"]), ("runn", ["runnel"]), ("transmi", ["transmission"]), ("cure", ["cure", "curing"]), ("dog c", ["pets"]), ("fli", ["fly", "flies"]), ("happi", ["happy"]), ("generous", ["generosity"]), ("unkno", ["unknowable"]), ("x", ["no"])])


def stem_expand(spark, sf_dir):
    return D.with_same_stem(WORDS.df(spark), STEMS.df(spark))


#: The stems were worked out by hand from the algorithm's description.
ORACLE["stem_expand"] = f"""{with_fixtures(WORDS, STEMS)}, b(word, s) AS (VALUES ('running', 'run'), ('runs', 'run'), ('transmit', 'transmit'), ('dog cat', 'dog cat'), ('xy', 'xy'), ('cured', 'cure'), ('curing', 'cure'), ('generously', 'generous'), ('flies', 'fli'), ('happiness', 'happi'), ('unknowns', 'unknown')),
t AS (SELECT word, 0 AS k, s FROM b UNION ALL SELECT word, 1, s[:-2] FROM b WHERE length(s) > 4 UNION ALL SELECT word, 2, s[:-3] FROM b WHERE length(s) > 4),
h AS (SELECT word, words, row_number() OVER (PARTITION BY word ORDER BY k) AS n FROM t JOIN stems ON stem = s) SELECT word, (generate_subscripts(words, 1) - 1)::INT AS k, unnest(words) AS form FROM h WHERE n = 1"""

VTOKENS = Fixture("vtok", "query string, lemma string, pos string", [("a", "spread", "VERB"), ("a", "virus", "NOUN"), ("a", "cure", "NOUN"), ("b", "cure", "NOUN"), ("b", "cure", "VERB"), ("c", "old", "ADJ")])
VERBS = Fixture("verbs", "forms array<string>", [(["cure", "cured"],), (["spread"],)])


def verb_lemmas(spark, sf_dir):
    return K.verb_lemmas(VTOKENS.df(spark), VERBS.df(spark)).withColumn("participle", K.participle(F.col("lemma")))


ORACLE["verb_lemmas"] = f"""{with_fixtures(VTOKENS, VERBS)}, f AS (SELECT DISTINCT unnest(forms) AS form FROM verbs),
u AS (SELECT query, lemma, 1.0::DOUBLE AS weight FROM vtok WHERE pos = 'VERB' UNION ALL SELECT query, lemma, 0.9::DOUBLE FROM vtok WHERE pos <> 'VERB' AND lemma IN (SELECT form FROM f))
SELECT query, lemma, max(weight) AS weight, CASE lemma WHEN 'cure' THEN 'curing' WHEN 'spread' THEN 'spreading' END AS participle FROM u GROUP BY 1, 2"""

CACHE = Fixture("cache", "cache_key string, ord int, qnode string", [("face_mask", 0, "Q1"), ("face_mask", 1, "Q2"), ("virus", 0, "Q3")])
CQUERY = Fixture("cq", "query string", [("face mask",), ("virus",), ("and/or",), ("new one",), ("virus",)])


def cache_lookup(spark, sf_dir):
    hits, misses = K.lookup(CQUERY.df(spark), CACHE.df(spark))
    return hits.unionByName(misses.select("query", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("qnode")))


ORACLE["cache_lookup"] = f"{with_fixtures(CQUERY, CACHE)} SELECT query, ord, qnode FROM (SELECT DISTINCT query FROM cq WHERE NOT contains(query, '/')) LEFT JOIN cache ON cache_key = replace(query, ' ', '_')"

D_QUERIES = Fixture("dq", "query string, context string", [("spread_quickly", "it spreads"), ("face mask", ""), ("cure", "a cure is near"), ("big/unknown", None), ("masks", "masks work"), ("nothing", "x")])
D_TOKENS = Fixture(
    "dt", "query string, ord int, text string, lemma string, pos string",
    [("spread_quickly", 0, "spread", "spread", "VERB"), ("spread_quickly", 1, "quickly", "quickly", "ADV"), ("face mask", 0, "face", "face", "NOUN"), ("face mask", 1, "mask", "mask", "NOUN"), ("cure", 0, "cure", "cure", "NOUN"), ("big/unknown", 0, "big", "big", "ADJ"), ("big/unknown", 1, "unknown", "unknown", "ADJ"), ("masks", 0, "masks", "mask", "NOUN"), ("nothing", 0, "nothing", "nothing", "PRON")],
)
D_VERBS = Fixture("dv", "form string", [("cure",), ("Face",), ("spread",)])
D_STEMS = Fixture("ds", "stem string, words array<string>", [("spread", ["spreads", "spreading"]), ("mask", ["masked"]), ("cure", ["cured"])])
D_CACHE = Fixture(
    "dc", "cache_key string, ord int, qnode string, label array<string>, alias array<string>, description array<string>, score double",
    [
        ("spread", 0, "Q1", ["spread"], [], ["it grows"], 0.1), ("spread", 1, "Q2", ["spread"], [], ["butter"], 0.1), ("spreading", 0, "Q3", ["spreading"], [], ["it spreads"], 0.1), ("spreads", 0, "Q1", ["spread"], [], ["it grows"], 0.1),
        ("face", 0, "Q9", ["face"], [], ["front"], 0.1), ("mask", 0, "Q4", ["mask"], [], ["masks work"], 0.1), ("mask", 1, "Q5", ["mask"], None, None, 0.1), ("masked", 0, "Q6", ["masked"], [], ["man"], 0.1), ("cure", 0, "Q7", ["cure"], [], ["a cure"], 0.1), ("curing", 0, "Q8", ["curing"], [], ["meat"], 0.1),
        ("big", 0, "Q10", ["big"], [], ["size"], 0.1), ("unknown", 0, "Q11", ["unknown"], [], [""], 0.1),
    ],
)
D_LISTED = Fixture("dl", "ord int, qnode string, label array<string>, description array<string>", [(0, "Q7", ["cure"], ["a cure"]), (1, "Q20", ["near"], ["a place"]), (2, "Q21", ["far"], [""])])


def _shared_words(a, b):
    """A score that SQL can follow: the share of the first text's words that the second one has, over 10 for each word more."""
    x, y = F.array_distinct(F.split(F.lower(a), "[ :]+")), F.array_distinct(F.split(F.lower(b), "[ :]+"))
    return F.size(F.array_intersect(x, y)).cast("double") / F.size(x)


def _disambiguated(spark, kind: str):
    q, t, c, s, few = (f.df(spark) for f in (D_QUERIES, D_TOKENS, D_CACHE, D_STEMS, D_LISTED))
    if kind == "verbs":
        return D.disambiguated_verbs(q, t, D_VERBS.df(spark), c, _shared_words, s, 2, few)
    return D.disambiguated_names(q, t, c, _shared_words, s, 2, few)


def verb_disambiguation(spark, sf_dir):
    return _disambiguated(spark, "verbs")


def name_disambiguation(spark, sf_dir):
    return _disambiguated(spark, "names")


def combined_options(spark, sf_dir):
    return D.combined(_disambiguated(spark, "names"), _disambiguated(spark, "verbs"))


def chosen_options(spark, sf_dir):
    return D.chosen_option(D.combined(_disambiguated(spark, "names"), _disambiguated(spark, "verbs")))


def _options_sql(name: str, requests: str, tail: str = "") -> str:
    """Tables up to {name}_o, from requests (query, plc, request)."""
    words = lambda x: f"list_distinct(regexp_split_to_array(lower({x}), '[ :]+'))"
    said = "CASE WHEN coalesce(context, '') <> '' THEN context ELSE replace(replace(query, '/', ' '), '_', ' ') END"
    score = f"(len(list_intersect({words('said')}, {words('name || CASE WHEN def <> chr(0)[:0] THEN chr(58) || chr(32) || def ELSE chr(0)[:0] END')})))::DOUBLE / len({words('said')})".replace("chr(0)[:0]", "''")
    return f"""{requests},
{name}_c AS (SELECT r.query, r.plc, c.ord AS co, request, qnode, coalesce(label[1], '') AS name, coalesce(description[1], '') AS def FROM {name}_r r JOIN dc c ON cache_key = replace(request, ' ', '_') AND NOT contains(request, '/')),
{tail}{name}_p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY plc, co) - 1 AS pos FROM {name}_c{'2' if tail else ''}),
{name}_s AS (SELECT p.*, {said} AS said, row_number() OVER (PARTITION BY p.query, name, def ORDER BY pos) AS f FROM {name}_p p JOIN dq USING (query)),
{name}_x AS (SELECT *, CASE WHEN f = 1 THEN {score} END AS score FROM {name}_s),
{name}_t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos) - 1 AS k FROM {name}_x WHERE f = 1) WHERE k < 2 AND score >= 0.01),
{name}_l AS (SELECT query, qnode, label[1] AS name, coalesce(description[1], '') AS def, ord AS pos, {said} AS said FROM dq CROSS JOIN dl),
{name}_m AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos) - 1 AS k FROM (SELECT *, {score} AS score FROM {name}_l)),
{name}_o AS (SELECT query, 'options' AS list, k AS ord, qnode, name, def AS definition, score, request AS from_query FROM {name}_t UNION ALL SELECT query, 'all', pos, qnode, name, def, score, request FROM {name}_x
  UNION ALL SELECT query, 'other', k, qnode, name, def, score, NULL FROM {name}_m m WHERE k < 2 AND score >= 0.01 AND NOT EXISTS (SELECT 1 FROM {name}_t t WHERE t.query = m.query AND t.qnode = m.qnode))"""


_VERBS_SQL = _options_sql("v", """v_w AS (SELECT query, ord, lemma, CASE WHEN pos = 'VERB' THEN 0 ELSE 1 END AS part FROM dt WHERE pos = 'VERB' OR lower(text) IN (SELECT lower(form) FROM dv) OR lower(lemma) IN (SELECT lower(form) FROM dv)),
v_g(lemma, ing) AS (VALUES ('spread', 'spreading'), ('cure', 'curing'), ('face', 'facing')),
v_r AS (SELECT query, part * 10000 + ord * 100 AS plc, lemma AS request FROM v_w UNION ALL SELECT query, part * 10000 + ord * 100 + 10, ing FROM v_w JOIN v_g USING (lemma) UNION ALL SELECT query, part * 10000 + ord * 100 + 20 + u.i, u.w FROM v_w JOIN (SELECT stem, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM ds) u ON u.stem = lemma)""")
_NAMES_SQL = _options_sql("n", """n_q AS (SELECT query, replace(replace(query, '/', ' '), '_', ' ') AS clean FROM dq),
n_r AS (SELECT query, 0 AS plc, clean AS request FROM n_q UNION ALL SELECT query, 1, lemma FROM n_q JOIN dt USING (query) WHERE ord = 0 AND NOT contains(clean, ' ') AND lemma <> clean
  UNION ALL SELECT query, 2 + u.i, u.w FROM n_q JOIN (VALUES ('masks', 'mask'), ('cure', 'cure')) z(word, st) ON word = clean JOIN (SELECT stem, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM ds) u ON u.stem = st)""",
    """n_c2 AS (SELECT * FROM n_c UNION ALL SELECT t.query, t.ord, c.ord, lemma, qnode, coalesce(label[1], ''), coalesce(description[1], '') FROM dt t JOIN dc c ON cache_key = replace(lemma, ' ', '_') WHERE t.query NOT IN (SELECT query FROM n_c)),
""")  # fmt: skip
_DIS = with_fixtures(D_QUERIES, D_TOKENS, D_VERBS, D_STEMS, D_CACHE, D_LISTED)
_BOTH = f"{_DIS}, {_VERBS_SQL}, {_NAMES_SQL}, bo AS (SELECT query, list, (row_number() OVER (PARTITION BY query, list ORDER BY part, ord) - 1)::INT AS ord, qnode, name, definition, score, from_query FROM (SELECT *, 0 AS part FROM n_o UNION ALL SELECT *, 1 FROM v_o))"
ORACLE["verb_disambiguation"] = f"{_DIS}, {_VERBS_SQL} SELECT query, list, ord::INT AS ord, qnode, name, definition, score, from_query FROM v_o"
ORACLE["name_disambiguation"] = f"{_DIS}, {_NAMES_SQL} SELECT query, list, ord::INT AS ord, qnode, name, definition, score, from_query FROM n_o"
ORACLE["combined_options"] = f"{_BOTH} SELECT * FROM bo"
ORACLE["chosen_options"] = f"{_BOTH} SELECT query, qnode, name, definition, CASE WHEN list = 'all' THEN score ELSE 1.0 END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE list WHEN 'options' THEN 0 WHEN 'other' THEN 1 ELSE 2 END, CASE WHEN list = 'all' THEN -score ELSE 0 END, ord) AS n FROM bo WHERE list <> 'all' OR score > 0) WHERE n = 1"

MASTER = Fixture(
    "master", "ord int, id string, name string, definition string, pb string, parent string",
    [(0, "Q1", "spread_Q1", "a", "spread.01", "x_Q2"), (1, "Q2", "move_Q2", "b", "spread.01", None), (2, "Q3", "grow_Q3", "c", "spread.01", "y_Q2"), (3, "Q4", "x_Q4", "", "spread.01", None), (4, "Q5", "heal_Q5", "d", "cure.01", None), (5, "Q6", "run_Q6", "e", "run.02", None), (6, "Q7", "jog_Q7", "f", "run.02", "r_Q6"), (7, "Q8", "dash_Q8", "g", "run.02", "j_Q7"), (8, "Q9", "eat_Q9", "h", "eat.01", None), (9, "Q10", "dine_Q10", "i", "eat.01", None), (10, "Q11", "aa_Q11", "j", "loop.01", "b_Q12"), (11, "Q12", "bb_Q12", "k", "loop.01", "a_Q11")],
)
OVERLAY = Fixture(
    "overlay", "ord int, qnode string, name string, description string, pb_roleset string, other_rolesets array<string>",
    [(0, "Q1", "Spread", "a", "spread.01", ["move.01", "spread_01"]), (1, "Q2", "Move", "b", "move.01", []), (2, "Q1", "Spread", "c", "spread.01", None), (3, "Q3", "Go", None, "go.02", []), (4, "Q4", "Go", "d", None, ["go.02"]), (5, "Q5", "move", "e", "", ["transmit.01"]), (6, "Q2", "move", "f", "move.01", [])],
)
SIMILAR = Fixture("sim", "text string, name string, score double", [("spread", "grow", 0.4), ("spread", "move", 0.4), ("spread", "spread", 0.9), ("eat", "dine", 0.7), ("eat", "eat", -0.2), ("run", "dash", 0.5), ("loop", "bb", 0.3)])
_MASTER = "m AS (SELECT replace(pb, '.', '-') AS pb, ord, id AS qnode, regexp_replace(name, '_Q[0-9]+$', '') AS name FROM master WHERE definition <> '')"
_OVER = """o AS (SELECT ord, 0 AS k, translate(pb_roleset, '._', '--') AS pb, qnode, name FROM overlay WHERE description <> '' UNION ALL SELECT ord, 1, translate(p, '._', '--'), qnode, name FROM (SELECT *, unnest(other_rolesets) AS p FROM overlay WHERE description <> '')),
x AS (SELECT pb, qnode, name, ord FROM (SELECT *, row_number() OVER (PARTITION BY pb, qnode ORDER BY ord, k) AS n FROM o WHERE pb <> '') WHERE n = 1)"""
_SIM = """SELECT pb, qnode FROM (SELECT c.pb, c.qnode, row_number() OVER (PARTITION BY c.pb ORDER BY greatest(coalesce(score, 0), 0) DESC, c.ord) AS k FROM {t} c LEFT JOIN sim ON sim.name = c.name AND sim.text = replace(regexp_replace(c.pb, '-[^-]*$', ''), '-', ' ')) WHERE k = 1"""


def pb_group(spark, sf_dir):
    return Q.master_by_roleset(MASTER.df(spark))


def overlay_fanout(spark, sf_dir):
    return Q.overlay_by_roleset(OVERLAY.df(spark))


def entity_names(spark, sf_dir):
    return Q.entity_names(OVERLAY.df(spark))


def overlay_choice(spark, sf_dir):
    return Q.choose(Q.overlay_by_roleset(OVERLAY.df(spark)), SIMILAR.df(spark))


def _parents(spark):
    return MASTER.df(spark).where("parent IS NOT NULL").select(F.col("id").alias("qnode"), F.element_at(F.split("parent", "_"), -1).alias("parent"))


def most_general(spark, sf_dir):
    return Q.most_general(Q.master_by_roleset(MASTER.df(spark)), _parents(spark))


def master_choice(spark, sf_dir):
    m = Q.master_by_roleset(MASTER.df(spark))
    return Q.choose(m, SIMILAR.df(spark), Q.most_general(m, _parents(spark)))


_GENERAL = """r AS (SELECT a.pb, a.qnode, b.qnode AS parent FROM m a JOIN (SELECT id, string_split(parent, '_')[-1] AS parent FROM master) p ON p.id = a.qnode JOIN m b ON b.pb = a.pb AND b.qnode = p.parent AND b.qnode <> a.qnode),
t AS (SELECT pb, min(parent) AS root FROM r WHERE NOT EXISTS (SELECT 1 FROM r z WHERE z.pb = r.pb AND z.qnode = r.parent) GROUP BY 1), e AS (SELECT pb, min(qnode) AS exact FROM m WHERE name = regexp_replace(pb, '-[0-9]+$', '') GROUP BY 1),
g AS (SELECT coalesce(t.pb, e.pb) AS pb, coalesce(exact, root) AS qnode FROM t FULL JOIN e ON t.pb = e.pb)"""
ORACLE["pb_group"] = f"{with_fixtures(MASTER)}, {_MASTER} SELECT * FROM m"
ORACLE["overlay_fanout"] = f"{with_fixtures(OVERLAY)}, {_OVER} SELECT * FROM x"
ORACLE["entity_names"] = f"{with_fixtures(OVERLAY)}, s AS (SELECT lower(name) AS name, qnode, min(ord) AS seen FROM overlay WHERE description <> '' GROUP BY 1, 2) SELECT name, arg_max(qnode, seen) AS qnode FROM s GROUP BY 1"
ORACLE["overlay_choice"] = f"{with_fixtures(OVERLAY, SIMILAR)}, {_OVER} {_SIM.format(t='x')}"
ORACLE["most_general"] = f"{with_fixtures(MASTER)}, {_MASTER}, {_GENERAL} SELECT pb, qnode FROM g"
ORACLE["master_choice"] = f"{with_fixtures(MASTER, SIMILAR)}, {_MASTER}, {_GENERAL}, s AS ({_SIM.format(t='m')}), n AS (SELECT pb, count(DISTINCT qnode) AS n, arg_min(qnode, ord) AS sole FROM m GROUP BY 1) SELECT n.pb, CASE WHEN n = 1 THEN sole ELSE coalesce(g.qnode, s.qnode) END AS qnode FROM n JOIN s USING (pb) LEFT JOIN g USING (pb)"

MENTIONS = Fixture("ment", "m_id int, text string", [(1, "spread"), (2, "the big Virus"), (3, "unknown words"), (4, "mask"), (5, "Virus mask")])
STAGE1 = Fixture("st1", "query string, qnode string", [("spread", "Q1")])
STAGE2 = Fixture("st2", "query string, qnode string", [("virus", "Q2"), ("big", "Q9"), ("spread", "Q8")])
STAGE3 = Fixture("st3", "query string, qnode string", [("mask", "Q3"), ("Virus", "Q4"), ("the big Virus", "Q5")])


def mention_cascade(spark, sf_dir):
    return Q.cascade(Q.mention_queries(MENTIONS.df(spark)), STAGE1.df(spark), STAGE2.df(spark), STAGE3.df(spark))


ORACLE["mention_cascade"] = f"""{with_fixtures(MENTIONS, STAGE1, STAGE2, STAGE3)}, w AS (SELECT m_id, text, list_reverse(string_split(text, ' ')) AS w FROM ment),
l AS (SELECT m_id, CASE WHEN len(w) > 1 THEN list_concat([text], w) ELSE [text] END AS l FROM w), p AS (SELECT m_id, generate_subscripts(l, 1) AS i, unnest(l) AS q FROM l),
a AS (SELECT m_id, 2 * i AS ord, lower(q) AS query FROM p UNION ALL SELECT m_id, 2 * i + 1, q FROM p),
k AS (SELECT *, 0 AS stage FROM st1 UNION ALL SELECT *, 1 FROM st2 UNION ALL SELECT *, 2 FROM st3)
SELECT m_id, qnode, stage FROM (SELECT m_id, qnode, stage, row_number() OVER (PARTITION BY m_id ORDER BY stage, ord) AS n FROM a JOIN k USING (query)) WHERE n = 1"""

PARTS = Fixture("parts", "claim_id string, ord int, topic string, place string, srl string", [("a", 1, "t1", None, "s1"), ("a", 2, None, "p2", "s2"), ("a", 3, "t3", None, None), ("b", 1, None, None, None), ("b", 2, None, "x", "s9")])


def dataset_merge(spark, sf_dir):
    return C.merge_claims(PARTS.df(spark), "claim_id", "ord", ["topic", "place"], ["srl"])


ORACLE["dataset_merge"] = f"{with_fixtures(PARTS)} SELECT claim_id, arg_max(topic, ord) FILTER (WHERE topic IS NOT NULL) AS topic, arg_max(place, ord) FILTER (WHERE place IS NOT NULL) AS place, arg_min(srl, ord) FILTER (WHERE srl IS NOT NULL) AS srl FROM parts GROUP BY 1"

TAGS = Fixture("tags", "claim_id string, kind string, tag string, i int, word string", [("a", "template", "ARG0", 0, "this"), ("a", "template", "ARG1", 1, "virus"), ("a", "claim", "ARG0", 1, "D"), ("a", "claim", "ARG0", 0, "vitamin"), ("a", "claim", "ARG1", 2, "flu"), ("b", "template", "ARG1", 0, "this"), ("b", "claim", "ARG0", 0, "it"), ("c", "template", "ARG1", 0, "This"), ("c", "template", "ARG2", 2, "this"), ("c", "claim", "ARG1", 5, "Rome"), ("c", "claim", "ARG2", 1, "Oslo")])


def srl_concat(spark, sf_dir):
    return C.join_arguments(TAGS.df(spark), "claim_id", "kind")


def srl_fallback(spark, sf_dir):
    t = C.join_arguments(TAGS.df(spark), "claim_id", "kind")
    return C.variable_from_roles(t.where("kind = 'template'").drop("kind"), t.where("kind = 'claim'").drop("kind"))


_TAGS = f"{with_fixtures(TAGS)}, g AS (SELECT claim_id, kind, tag, string_agg(word, ' ' ORDER BY i) AS words FROM tags GROUP BY 1, 2, 3)"
ORACLE["srl_concat"] = f"{_TAGS} SELECT * FROM g"
ORACLE["srl_fallback"] = f"{_TAGS}, t AS (SELECT claim_id, min(tag) AS tag FROM g WHERE kind = 'template' AND lower(words) = 'this' GROUP BY 1) SELECT claim_id, tag, words AS x_text FROM t JOIN g USING (claim_id, tag) WHERE kind = 'claim'"

TEMPLATES = Fixture("tmpl", "template string", [("X cures COVID-19",), ("it began in X",), ("X-rays help X X",), ("none",)])


def parser_template(spark, sf_dir):
    return TEMPLATES.df(spark).select("template", T.template_for_parser(F.col("template")).alias("sentence"))


ORACLE["parser_template"] = f"{with_fixtures(TEMPLATES)} SELECT template, array_to_string(list_transform(string_split(template, ' '), lambda t: CASE WHEN t = 'X' THEN 'this' ELSE t END), ' ') AS sentence FROM tmpl"

EVENTS = Fixture("evs", "event_id int, qnode_id string, span_start int, span_stop int, text string", [(1, "Q1", 0, 5, "spread"), (2, None, 0, 5, "x"), (3, "Q2", None, None, "y"), (4, "Q3", 1, 2, "Unspecified"), (5, "Q4", 1, 1, "z")])


def valid_semantics(spark, sf_dir):
    return C.valid_semantics(EVENTS.df(spark))


ORACLE["valid_semantics"] = f"{with_fixtures(EVENTS)} SELECT * FROM evs WHERE qnode_id IS NOT NULL AND span_start IS NOT NULL AND span_stop IS NOT NULL AND text <> 'Unspecified'"

QUERIES = {n: globals()[n] for n in ORACLE}
