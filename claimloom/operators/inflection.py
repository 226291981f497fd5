"""Lemmas and inflected forms by edit rules that are learned from pairs, with a lexicon of what the rules get wrong.

A pair of a form and its lemma is an edit: what falls from the end of one and what the other has there. For every ending of
a word, up to its whole, the edit that most pairs with that ending have is its rule; the longest ending that has a rule
decides, if the word ends in what falls. The same pairs read the other way give the rules from lemmas to forms, so one table
runs in both directions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stash

#: Letters of an ending, the word's beginning counting as one.
LONGEST = 5
#: Rules and exceptions that an inflector may hold: it goes to every task.
MOST_RULES = 2_000_000
BEGIN = "^"

#: English verbs whose participles show when a letter falls, changes or doubles (lemma and form), in the alphabet's order.
ENGLISH_PARTICIPLES = (
    "abandon abandoning,accept accepting,add adding,admit admitting,agree agreeing,allow allowing,answer answering,ask asking,be being,beat beating,begin beginning,believe believing,belie belying,benefit benefiting,bet betting,bite biting,"
    "boil boiling,bring bringing,buy buying,call calling,cancel canceling,carry carrying,catch catching,claim claiming,close closing,commit committing,control controlling,cook cooking,cry crying,cut cutting,deny denying,develop developing,"
    "die dying,dig digging,do doing,draw drawing,drop dropping,dye dyeing,eat eating,edit editing,enter entering,fail failing,feed feeding,feel feeling,fit fitting,fix fixing,forget forgetting,free freeing,get getting,give giving,go going,"
    "grin grinning,happen happening,have having,help helping,hit hitting,hop hopping,hope hoping,infect infecting,infer inferring,keep keeping,kill killing,let letting,lie lying,limit limiting,listen listening,live living,lose losing,"
    "make making,mimic mimicking,mix mixing,move moving,occur occurring,offer offering,open opening,order ordering,panic panicking,pay paying,picnic picnicking,plan planning,play playing,prefer preferring,prevent preventing,put putting,"
    "quit quitting,rain raining,read reading,refer referring,rob robbing,row rowing,run running,say saying,see seeing,seem seeming,set setting,show showing,singe singeing,sit sitting,spread spreading,stand standing,start starting,stop stopping,"
    "swim swimming,take taking,tell telling,think thinking,tie tying,traffic trafficking,travel traveling,treat treating,try trying,turn turning,untie untying,use using,vie vying,visit visiting,wait waiting,want wanting,win winning,work working,write writing"
).split(",")


def endings(word: str, longest: int = LONGEST) -> list[str]:
    """Endings from the longest to the empty one; the beginning of the word is marked."""
    w = BEGIN + word
    return [w[len(w) - k :] for k in range(min(longest, len(w)), 0, -1)] + [""]


class Inflector:
    """rules: (direction, kind) to ending to (what falls, what comes instead); exceptions: to word to word."""

    def __init__(self, rules: dict[tuple[str, str], dict[str, tuple[str, str]]], exceptions: dict[tuple[str, str], dict[str, str]], longest: int = LONGEST):
        self.rules, self.exceptions, self.longest = rules, exceptions, longest

    def turn(self, direction: str, kind: str, word: str) -> str:
        key = (direction, kind)
        known = self.exceptions.get(key, {}).get(word)
        if known is not None:
            return known
        rules = self.rules.get(key, {})
        for e in endings(word, self.longest):
            if e in rules and word.endswith(rules[e][0]):
                fall, put = rules[e]
                return word[: len(word) - len(fall)] + put
        return word

    def lemma(self, kind: str, form: str) -> str:
        """The lemma of a form; a kind that was never seen leaves it as it is."""
        return self.turn("lemma", kind, form)

    def form(self, kind: str, lemma: str) -> str:
        return self.turn("form", kind, lemma)

    def column(self, direction: str, kind: Column | str, word: Column) -> Column:
        """Either direction over columns; null for null."""

        @F.pandas_udf("string")
        def run(words: pd.Series, kinds: pd.Series) -> pd.Series:
            known: dict[tuple[str, str], str] = {}

            def one(w, k):
                if w is None or k is None:
                    return None if w is None else w
                if (w, k) not in known:
                    known[w, k] = self.turn(direction, k, w)
                return known[w, k]

            return pd.Series([one(w, k) for w, k in zip(words, kinds, strict=True)], dtype=object)

        return run(word, F.lit(kind) if isinstance(kind, str) else kind)


def directed(pairs: DataFrame) -> DataFrame:
    """(direction, kind, word, other, n) from (kind, form, lemma, n), both ways; pairs without a word or lemma are left out."""
    p = pairs.where("form <> '' AND lemma <> ''").groupBy("kind", "form", "lemma").agg(F.sum("n").alias("n"))
    way = lambda name, a, b: p.select(F.lit(name).alias("direction"), F.coalesce("kind", F.lit("")).alias("kind"), F.col(a).alias("word"), F.col(b).alias("other"), "n")
    return way("lemma", "form", "lemma").unionByName(way("form", "lemma", "form"))


def edit_counts(pairs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(direction, kind, ending, fall, put, n): how many pairs with this ending have this edit, from (kind, form, lemma, n)."""
    d = directed(pairs)
    size = F.least(F.char_length("word"), F.char_length("other"))
    # letters that both begin with
    same = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda acc, k: F.when((acc == k - 1) & (F.substr("word", k, F.lit(1)) == F.substr("other", k, F.lit(1))), k).otherwise(acc))
    d = d.withColumn("same", same).withColumn("marked", F.concat(F.lit(BEGIN), F.col("word")))
    ends = F.transform(F.sequence(F.lit(0), F.least(F.lit(longest), F.char_length("marked"))), lambda k: F.when(k == 0, F.lit("")).otherwise(F.substr("marked", F.char_length("marked") - k + 1)))
    rows = d.select("direction", "kind", F.explode(ends).alias("ending"), F.substr("word", F.col("same") + 1).alias("fall"), F.substr("other", F.col("same") + 1).alias("put"), "n")
    return rows.groupBy("direction", "kind", "ending", "fall", "put").agg(F.sum("n").alias("n"))


def best_edits(counts: DataFrame) -> DataFrame:
    """(direction, kind, ending, fall, put): each ending's edit of most pairs; ties: the one that takes least, then by what it puts and takes."""
    return counts.groupBy("direction", "kind", "ending").agg(F.max_by(F.struct("fall", "put"), F.struct(F.col("n"), -F.char_length("fall"), "put", "fall")).alias("e")).select("direction", "kind", "ending", "e.*")


def learn_inflector(pairs: DataFrame, longest: int = LONGEST) -> Inflector:
    """An inflector from (kind, form, lemma, n), such as ("VBG", "lying", "lie", 12).

    An ending whose edit is that of the next shorter ending with a rule is left out. Words that the rules get wrong are
    exceptions: of several forms or lemmas the one of most occurrences. More than MOST_RULES of both raise an error.
    """
    stash = Stash(pairs.sparkSession)
    best = stash(best_edits(edit_counts(pairs, longest)))
    shorter = best.alias("s")
    up = best.select("direction", "kind", F.substr("ending", F.lit(2)).alias("short"), "ending", "fall", "put").where("ending <> ''")
    told = up.join(shorter, (up.direction == F.col("s.direction")) & (up.kind == F.col("s.kind")) & (up.short == F.col("s.ending")) & (up.fall == F.col("s.fall")) & (up.put == F.col("s.put")), "left_anti")
    # every ending of a known word has a rule, so the next shorter one is always there to compare with
    kept = told.select("direction", "kind", "ending", "fall", "put").unionByName(best.where("ending = ''"))
    rules: dict = defaultdict(dict)
    for r in _held(kept):
        rules[r.direction, r.kind][r.ending] = (r.fall, r.put)
    tool = Inflector(dict(rules), {}, longest)
    one = directed(pairs).groupBy("direction", "kind", "word").agg(F.max_by("other", F.struct(F.col("n"), F.col("other"))).alias("other"))

    def wrong(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df[[tool.turn(d, k, w) != o for d, k, w, o in zip(df["direction"], df["kind"], df["word"], df["other"], strict=True)]]

    exceptions: dict = defaultdict(dict)
    for r in _held(one.mapInPandas(wrong, one.schema)):
        exceptions[r.direction, r.kind][r.word] = r.other
    return Inflector(tool.rules, dict(exceptions), longest)


def _held(rows: DataFrame) -> list:
    out = rows.limit(MOST_RULES + 1).collect()
    if len(out) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules or exceptions")
    return out


def english_participles(spark) -> Inflector:
    """The participles of English verbs (kind VBG), from the pairs above."""
    return learn_inflector(spark.createDataFrame([("VBG", *p.split(" ")[::-1], 1) for p in ENGLISH_PARTICIPLES], "kind string, form string, lemma string, n long"))


def lemma_counts(docs: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """(kind, form, lemma, n) for words of (text) that another word of the corpus is the lemma of.

    kinds: name to the endings of form and lemma, such as {"VBG": ("ing", "e")}; a stem of two letters at least is before them.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    made = [F.when(F.col("form").endswith(a) & (F.char_length("form") > len(a) + 1), F.struct(F.lit(k).alias("kind"), F.concat(F.left("form", F.char_length("form") - len(a)), F.lit(b)).alias("lemma"))) for k, (a, b) in kinds.items()]
    pairs = words.select("form", "n", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x")).select("x.kind", "form", "x.lemma", "n")
    return pairs.join(words.select(F.col("form").alias("lemma")), "lemma", "left_semi").select("kind", "form", "lemma", "n")
