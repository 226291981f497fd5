"""Semantic graphs as tables: texts of nodes, names, descriptions, arguments, speakers and open variables.

Tables: nodes(graph_id, node_id, ord, label), edges(graph_id, ord, parent, role, child), tokens(graph_id, idx, token),
alignments(graph_id, ord, node_id, token_idx), graphs(graph_id, root). All joins are equi joins on the graph and a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import Stash
from .graph import closure

#: Labels of places (fixed values).
PLACES = ["city", "state", "country", "continent"]
#: (label of the parent, role) that a treatment stands at (fixed values).
TREATMENT = [("treat-03", ":ARG1"), ("treat-03", ":ARG3"), ("shorten-01", ":ARG0"), ("prevent-01", ":ARG0"), ("approve-01", ":ARG1")]


def node_strings(tokens: DataFrame, alignments: DataFrame) -> DataFrame:
    """(graph_id, node_id, text): aligned tokens in the order of the alignments, without punctuation and <ROOT>."""
    t = alignments.join(tokens, (alignments.graph_id == tokens.graph_id) & (alignments.token_idx == tokens.idx)).select(alignments.graph_id, "node_id", "ord", "token_idx", "token")
    t = t.where(~F.lit(T.PUNCTUATION).contains(F.col("token")) & (F.col("token") != "<ROOT>"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("ord", "token_idx", "token"))), lambda x: x["token"])
    return t.groupBy("graph_id", "node_id").agg(F.array_join(words, " ").alias("text"))


def token_places(tokens: DataFrame) -> DataFrame:
    """(graph_id, token, idx): of equal tokens the last place."""
    return tokens.groupBy("graph_id", "token").agg(F.max("idx").alias("idx"))


def full_names(edges: DataFrame, strings: DataFrame) -> DataFrame:
    """(graph_id, node_id, name): texts of the node's :name children; the empty text if none of them is aligned."""
    n = edges.where("role = ':name'").select("graph_id", F.col("parent").alias("node_id"), "ord", F.col("child").alias("c"))
    s = strings.select(F.col("graph_id").alias("g"), F.col("node_id").alias("n"), "text")
    j = n.join(s, (F.col("graph_id") == F.col("g")) & (F.col("c") == F.col("n")), "left")
    words = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"].isNotNull()), lambda x: x["text"])
    return j.groupBy("graph_id", "node_id").agg(F.array_join(words, " ").alias("name"))


def _first(edges: DataFrame, role: str) -> DataFrame:
    """The first child of each node by a role."""
    return edges.where(F.col("role") == role).groupBy("graph_id", "parent").agg(F.min_by("child", "ord").alias("child"))


def _assemble(parts: Column, focus: Column, with_focus: bool) -> Column:
    """Words by their place; of "A and B" only A; words that aren't as far from the focus as in the sentence go.

    parts: array of (idx, token); focus: (idx, token) of the focus' first word.
    """
    ordered = F.array_sort(F.array_distinct(F.filter(parts, lambda p: p["idx"].isNotNull())))

    def trim(ps: Column) -> Column:
        words = F.transform(ps, lambda p: p["token"])
        place = F.array_position(words, focus["token"]) - 1
        near = F.filter(F.transform(ps, lambda p, i: F.struct(p["token"].alias("t"), (F.abs(p["idx"] - focus["idx"]) == F.abs(i - place)).alias("ok"))), lambda x: x["ok"])
        two = (F.size(ps) == 3) & (F.get(words, F.lit(1)) == "and")
        kept = near if with_focus else F.transform(ps, lambda p: F.struct(p["token"].alias("t"), F.lit(True).alias("ok")))
        return F.when(two, F.get(words, F.lit(0))).when(F.size(ps) > 1, F.array_join(F.transform(kept, lambda x: x["t"]), " ")).otherwise(F.array_join(words, " "))

    return F.element_at(F.transform(F.array(ordered), trim), 1)


def descriptions(nodes: DataFrame, edges: DataFrame, tokens: DataFrame, strings: DataFrame) -> DataFrame:
    """(graph_id, node_id, description, mods) for nodes with an aligned text.

    A node's words go with those of its :mod children, of the first :consist-of and the first :ARG1-of child, and of the
    first :op1 child if there were none; a roleset's words go with the description of its first :ARG1 child, however deep.
    A roleset on a cycle of such children has its own words only. mods: the same without the node's own words.
    """
    label = nodes.select("graph_id", "node_id", "label")
    base = strings.join(label, ["graph_id", "node_id"]).withColumn("roleset", T.is_roleset(F.col("label")))
    mods = edges.where("role = ':mod'").select("graph_id", "parent", "child").withColumn("k", F.lit(0))
    for k, role in enumerate((":consist-of", ":ARG1-of", ":op1")):
        mods = mods.unionByName(_first(edges, role).withColumn("k", F.lit(0 if k < 2 else 1)))
    child_text = strings.select(F.col("graph_id").alias("g"), F.col("node_id").alias("n"), F.col("text").alias("c_text"))
    parts = mods.join(child_text, (F.col("graph_id") == F.col("g")) & (F.col("child") == F.col("n"))).select("graph_id", F.col("parent").alias("node_id"), "k", "c_text")
    parts = parts.groupBy("graph_id", "node_id").agg(F.collect_list(F.when(F.col("k") == 0, F.col("c_text"))).alias("m"), F.collect_list(F.when(F.col("k") == 1, F.col("c_text"))).alias("o"))
    places = token_places(tokens).groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "idx"))).alias("place"))
    b = base.join(parts, ["graph_id", "node_id"], "left").join(places, "graph_id")
    none = F.array().cast("array<string>")
    b = b.withColumn("words", F.when(F.col("roleset"), none).when(F.size(F.coalesce("m", none)) > 0, F.col("m")).otherwise(F.coalesce("o", none)))

    def text(extra: Column, focus: bool) -> Column:
        place = lambda t: F.struct(F.element_at("place", t).alias("idx"), t.alias("token"))
        split = lambda a: F.flatten(F.transform(a, lambda x: F.split(x, " ")))
        own = F.concat(extra, F.array("text")) if focus else extra
        return _assemble(F.transform(split(own), place), place(F.element_at(F.split("text", " "), 1)), focus)

    both = lambda df, extra: df.select("graph_id", "node_id", text(extra, True).alias("description"), text(extra, False).alias("mods"))
    # rolesets wait for the description of their child; nodes without an aligned text have none
    stash = Stash(nodes.sparkSession)
    b = stash(b)
    inner = _first(edges, ":ARG1").join(b.select("graph_id", F.col("node_id").alias("child")), ["graph_id", "child"], "left_semi")
    waits = stash(b.where("roleset").select("graph_id", "node_id").join(inner.withColumnRenamed("parent", "node_id"), ["graph_id", "node_id"]))
    last = done = stash(both(b.join(waits, ["graph_id", "node_id"], "left_anti"), F.col("words")))
    while True:
        known = last.select("graph_id", F.col("node_id").alias("child"), F.col("description").alias("d"))
        last = stash(both(b.join(waits, ["graph_id", "node_id"]).join(known, ["graph_id", "child"]), _some("d")))
        if last.isEmpty():
            # what still waits leads to a cycle; those on one are done with their own words
            left = stash(waits.join(done, ["graph_id", "node_id"], "left_anti"))
            if left.isEmpty():
                return done
            chain = left.select("graph_id", F.col("node_id").alias("a"), F.col("child").alias("b"))
            after = closure(chain, chain.select("graph_id", F.col("b").alias("start"))).select("graph_id", F.col("start").alias("child"), F.col("s").alias("node_id"))
            loops = left.join(after, ["graph_id", "child", "node_id"], "left_semi").select("graph_id", "node_id")
            last = stash(both(b.join(loops, ["graph_id", "node_id"], "left_semi"), none))
            waits = stash(left.join(loops, ["graph_id", "node_id"], "left_anti"))
        done = stash(done.unionByName(last))


def _some(name: str) -> Column:
    """The text as a list; an empty list for none."""
    return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.array(name)).otherwise(F.array().cast("array<string>"))


def labelled_arguments(nodes: DataFrame, edges: DataFrame, strings: DataFrame, events: DataFrame, allowed: DataFrame) -> DataFrame:
    """(graph_id, event, role, text): arguments of event nodes whose role ``allowed`` (graph_id, event, role) has.

    Node ids may repeat in other graphs. The clipped text of the node counts, else its label without sense if anything of it is left after clipping; of equal
    roles the last edge.
    """
    ev = events.select("graph_id", "event")
    out = edges.join(ev, (edges.graph_id == ev.graph_id) & (((F.col("parent") == F.col("event")) & ~F.col("role").endswith("-of")) | ((F.col("child") == F.col("event")) & F.col("role").endswith("-of")))).select(edges.graph_id, "event", "ord", "role", F.when(F.col("role").endswith("-of"), F.col("parent")).otherwise(F.col("child")).alias("node_id"))
    out = out.where(T.is_argument_role(F.col("role"))).withColumn("role", T.framenet_role(F.col("role"))).join(allowed, ["graph_id", "event", "role"], "left_semi")
    out = out.join(nodes.select("graph_id", "node_id", "label"), ["graph_id", "node_id"]).join(strings, ["graph_id", "node_id"], "left")
    clipped = lambda c: F.array_join(T.clip(F.split(F.coalesce(c, F.lit("")), " ")), " ")
    text = F.when(clipped(F.col("text")) != "", clipped(F.col("text"))).when(clipped(F.col("label")) != "", F.regexp_replace("label", "-[^-]*$", ""))
    return out.withColumn("t", text).where("t IS NOT NULL").groupBy("graph_id", "event", "role").agg(F.max_by("t", "ord").alias("text"))


def first_above(edges: DataFrame, wanted: DataFrame, starts: DataFrame) -> DataFrame:
    """(graph_id, start, node_id, steps): the wanted node that a walk up from the start meets first, depth first, parents in
    the order of their edges; a walk goes no further up from a wanted node, and ends on cycles.

    That node ends the first path in the order of edge numbers. Each round keeps for each node the first path to it, until
    no path improves.
    """
    stash = Stash(edges.sparkSession)
    up = stash(edges.select("graph_id", F.col("child").alias("node_id"), F.col("parent").alias("p"), "ord"))
    wanted = stash(wanted.select("graph_id", F.col("node_id").alias("p")).distinct().withColumn("hit", F.lit(True)))
    front = starts.select("graph_id", "start", F.col("start").alias("node_id"), F.array().cast("array<int>").alias("path"))
    best = None
    while True:
        new = front.join(up, ["graph_id", "node_id"]).select("graph_id", "start", F.col("p").alias("node_id"), F.concat("path", F.array(F.col("ord").cast("int"))).alias("path"))
        new = new.groupBy("graph_id", "start", "node_id").agg(F.min("path").alias("path"))
        if best is not None:
            was = best.select("graph_id", "start", "node_id", F.col("path").alias("was"))
            new = new.join(was, ["graph_id", "start", "node_id"], "left").where("was IS NULL OR path < was").drop("was")
        new = stash(new)
        if new.isEmpty():
            break
        both = new if best is None else best.unionByName(new)
        best = stash(both.groupBy("graph_id", "start", "node_id").agg(F.min("path").alias("path")))
        front = new.join(wanted.withColumnRenamed("p", "node_id"), ["graph_id", "node_id"], "left_anti")
    if best is None:
        best = new
    hits = best.join(wanted.withColumnRenamed("p", "node_id"), ["graph_id", "node_id"], "left_semi")
    first = hits.groupBy("graph_id", "start").agg(F.min_by("node_id", "path").alias("node_id"), F.min("path").alias("path"))
    return first.select("graph_id", "start", "node_id", F.size("path").alias("steps"))


def claim_nodes(nodes: DataFrame, edges: DataFrame, claim_tokens: DataFrame, verbs: DataFrame) -> DataFrame:
    """(graph_id, node_id): the statement node met first above the first claim word (graph_id, i, lemma) that has one, else the first
    statement node of the graph. Statement nodes: label before its sense is one of the verbs.
    """
    statement = nodes.join(verbs, F.regexp_replace("label", "-[^-]*$", "") == F.col("verb"), "left_semi")
    word = claim_tokens.join(nodes, (claim_tokens.graph_id == nodes.graph_id) & (F.col("lemma") == T.label_without_sense(F.col("label")))).select(claim_tokens.graph_id, "i", F.col("ord").alias("n_ord"), F.col("node_id").alias("start"))
    above = first_above(edges, statement.select("graph_id", "node_id"), word.select("graph_id", "start").distinct())
    by_word = word.join(above, ["graph_id", "start"]).groupBy("graph_id").agg(F.min_by("node_id", F.struct("i", "n_ord")).alias("node"))
    first = statement.groupBy("graph_id").agg(F.min_by("node_id", "ord").alias("first"))
    return first.join(by_word, "graph_id", "left").select("graph_id", F.coalesce("node", "first").alias("node_id"))


def claimers(nodes: DataFrame, edges: DataFrame, tokens: DataFrame, strings: DataFrame, heads: DataFrame, pos: DataFrame) -> DataFrame:
    """(graph_id, claimer): the first :ARG0 of the claim node: a person's or organization's name, else its description;
    a verb at its end goes if other words are left, and stop words at both ends.
    """
    arg = heads.join(_first(edges, ":ARG0").withColumnRenamed("parent", "node_id"), ["graph_id", "node_id"]).select("graph_id", F.col("child").alias("node_id"))
    arg = arg.join(nodes.select("graph_id", "node_id", "label"), ["graph_id", "node_id"])
    arg = arg.join(full_names(edges, strings), ["graph_id", "node_id"], "left").join(descriptions(nodes, edges, tokens, strings), ["graph_id", "node_id"], "left")
    arg = arg.withColumn("text", F.when(F.col("label").isin("person", "organization"), F.col("name")).otherwise(F.col("description")))
    arg = arg.withColumn("w", F.split("text", " ")).withColumn("tail", F.element_at("w", -1))
    tag = pos.select(F.col("graph_id").alias("g"), F.col("token").alias("tok"), "pos").where(F.col("pos").isin("VERB", "AUX")).distinct()
    j = arg.join(tag, (F.col("graph_id") == F.col("g")) & (F.col("tail") == F.col("tok")), "left")
    bare = F.when((F.size("w") >= 2) & F.col("tok").isNotNull(), F.slice("w", 1, F.size("w") - 1)).otherwise(F.col("w"))
    return j.withColumn("claimer", F.array_join(T.clip(bare), " ")).where("claimer <> ''").select("graph_id", "claimer").distinct()


def open_variables(claims: DataFrame, graphs: DataFrame, nodes: DataFrame, edges: DataFrame, tokens: DataFrame, strings: DataFrame) -> DataFrame:
    """(graph_id, prio, x_text): what stands for X in the claim's template, by the first rule that finds an edge.

    claims: (graph_id, template). Each rule is a test of the template, a test of an edge and a way to the text: the name of
    a node, its description, its description without its own words, its label. A rule whose template fits but that finds
    no edge leaves the claim to later rules; rule 3 always decides.
    """
    lab = nodes.select("graph_id", "node_id", "label")
    p = lab.select(F.col("graph_id").alias("pg"), F.col("node_id").alias("parent"), F.col("label").alias("p_label"))
    c = lab.select(F.col("graph_id").alias("cg"), F.col("node_id").alias("child"), F.col("label").alias("c_label"))
    e = edges.withColumnRenamed("graph_id", "eg")
    e = e.join(p, (F.col("eg") == F.col("pg")) & (e.parent == p.parent)).drop(p.parent).join(c, (F.col("eg") == F.col("cg")) & (e.child == c.child)).drop(c.child)
    g = claims.join(graphs, "graph_id").withColumn("gov", F.lit(False)).drop("gov")
    has_gov = tokens.where("token = 'government'").select("graph_id").distinct().withColumn("gov", F.lit(True))
    g = g.join(has_gov, "graph_id", "left")
    t, root = F.col("template"), F.col("root")
    # what templates say and which edges answer to it: the words and labels are fixed values, like PLACES and TREATMENT
    place = F.col("c_label").isin(PLACES)
    grand = edges.select(F.col("graph_id").alias("gg"), F.col("parent").alias("gp"), F.col("child").alias("gc")).join(lab.select(F.col("graph_id").alias("lg"), F.col("node_id").alias("ln"), F.col("label").alias("g_label")), (F.col("gg") == F.col("lg")) & (F.col("gc") == F.col("ln"))).where(F.col("g_label").isin(PLACES)).groupBy("gg", "gp").agg(F.max("gc").alias("g_place"))
    e = e.join(grand, (F.col("eg") == F.col("gg")) & (F.col("child") == F.col("gp")), "left")
    edge = g.join(e, F.col("graph_id") == F.col("eg"))
    agent = F.when(t == "X cures COVID-19", ":ARG3").otherwise(":ARG0")
    gov = F.col("p_label") == "government-organization"
    treatment = F.lit(False)
    for label, role in TREATMENT:
        treatment = treatment | ((F.col("p_label") == label) & (F.col("role") == role))
    rules = [
        (1, t.rlike("(facility|location|place)-X"), F.col("role").isin(":location", ":source") | place, F.col("child"), "name"),
        (2, t.contains("person-X"), F.col("c_label") == "person", F.col("child"), "person"),
        (4, t.startswith("X was the target"), (F.col("p_label") == "target-01") & (F.col("role") == ":ARG1"), F.col("child"), "name or mods"),
        (5, t.contains("X negative effect"), F.col("p_label") == "affect-01", F.col("parent"), "mods"),
        (6, t.contains("Government-X"), gov | ((F.col("role") == ":ARG0") & place), F.when(gov & ~place, F.col("g_place")).otherwise(F.col("child")), "government"),
        (8, t.contains("Treatment-X") | t.contains("effective treatment"), treatment, F.col("child"), "description"),
        (9, t.contains("medication X"), (F.col("p_label") == "safe-01") & (F.col("role") == ":ARG1"), F.col("child"), "description"),
        (10, t.contains("Animal-X"), (F.col("parent") == root) & (F.col("role") == ":ARG1"), F.col("child"), "description"),
        (11, t.startswith("X"), (F.col("parent") == root) & (F.col("role") == agent), F.col("child"), "name"),
        (12, t.endswith("X"), (F.col("parent") == root) & (F.col("role") == ":ARG1"), F.col("child"), "name"),
    ]
    hit = F.array(*[F.when(a & b, F.struct(F.lit(k).alias("prio"), F.col("ord").alias("ord"), n.alias("node_id"), F.lit(how).alias("how"), (F.coalesce(F.col("gov"), F.lit(False)) & gov).alias("gov"))) for k, a, b, n, how in rules])
    found = edge.select("graph_id", F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("h")).select("graph_id", "h.*")
    rooted = g.where(t.endswith("is X")).select("graph_id", F.lit(3).alias("prio"), F.lit(0).alias("ord"), root.alias("node_id"), F.lit("description").alias("how"), F.lit(False).alias("gov"))
    dated = g.where(t.contains("date-X")).join(nodes.where("label = 'date-entity'"), "graph_id").select("graph_id", F.lit(7).alias("prio"), "ord", "node_id", F.lit("description").alias("how"), F.lit(False).alias("gov"))
    best = found.unionByName(rooted).unionByName(dated).groupBy("graph_id").agg(F.min(F.struct("prio", "ord", "node_id", "how", "gov")).alias("b")).select("graph_id", "b.*")
    names = full_names(edges, strings)
    j = best.join(names, ["graph_id", "node_id"], "left").join(descriptions(nodes, edges, tokens, strings), ["graph_id", "node_id"], "left")
    name = F.when(F.col("name") != "", F.col("name"))
    text = (
        F.when(F.col("how") == "name", F.coalesce(name, "description"))
        .when(F.col("how") == "person", F.coalesce(name, F.lit("person")))
        .when(F.col("how") == "name or mods", F.coalesce(name, "mods"))
        .when(F.col("how") == "mods", F.col("mods"))
        .when(F.col("how") == "government", F.when(F.col("gov") & name.isNotNull(), F.concat(name, F.lit(" government"))).otherwise(F.col("name")))
        .otherwise(F.col("description"))
    )
    return j.select("graph_id", "prio", text.alias("x_text")).where("coalesce(x_text, '') <> ''")


def general_variables(claims: DataFrame, nodes: DataFrame, edges: DataFrame, tokens: DataFrame, strings: DataFrame, ents: DataFrame) -> DataFrame:
    """(graph_id, x_text) without domain templates, led by the named entities of the claim (graph_id, ent_type).

    A nationality leads to a government's or place's name, a person or organization to a person's name, anything else to a
    place by role or label, or to a date.
    """
    kind = ents.groupBy("graph_id").agg(F.max(F.col("ent_type") == "NORP").alias("norp"), F.max(F.col("ent_type").isin("PERSON", "ORG")).alias("person"))
    lab = nodes.select("graph_id", "node_id", "label")
    c = lab.select("graph_id", F.col("node_id").alias("child"), F.col("label").alias("c_label"))
    p = lab.select("graph_id", F.col("node_id").alias("parent"), F.col("label").alias("p_label"))
    e = edges.join(c, ["graph_id", "child"]).join(p, ["graph_id", "parent"]).join(claims.select("graph_id"), "graph_id").join(kind, "graph_id", "left").na.fill(False, ["norp", "person"])
    place = F.col("c_label").isin(PLACES)
    rule = (
        F.when(F.col("norp") & ((F.col("p_label") == "government-organization") | ((F.col("role") == ":ARG0") & place)), F.struct(F.lit(1).alias("prio"), F.col("child").alias("node_id")))
        .when(~F.col("norp") & F.col("person") & (F.col("c_label") == "person"), F.struct(F.lit(2).alias("prio"), F.col("child").alias("node_id")))
        .when(F.col("role").isin(":location", ":source") | place, F.struct(F.lit(3).alias("prio"), F.col("child").alias("node_id")))
        .when(F.col("p_label") == "date-entity", F.struct(F.lit(4).alias("prio"), F.col("parent").alias("node_id")))
    )
    best = e.withColumn("r", rule).where("r IS NOT NULL").groupBy("graph_id").agg(F.min(F.struct("r.prio", "ord", "r.node_id")).alias("b")).select("graph_id", "b.prio", "b.node_id")
    j = best.join(full_names(edges, strings), ["graph_id", "node_id"], "left").join(descriptions(nodes, edges, tokens, strings), ["graph_id", "node_id"], "left")
    return j.select("graph_id", "prio", F.coalesce(F.when(F.col("name") != "", F.col("name")), "description").alias("x_text")).where("coalesce(x_text, '') <> ''")


def graphs_by_tokens(claims: DataFrame, graphs: DataFrame, text: str) -> DataFrame:
    """Claims with the graph whose tokens are the claim's text; a claim without one stays, its graph's columns null."""
    return claims.join(graphs.withColumnRenamed("token_text", "__t"), F.col(text) == F.col("__t"), "left").drop("__t")
