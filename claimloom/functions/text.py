"""Text expressions: tokens, clipping, names of roles and rolesets, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The common English stop-word list, in its own order, and "like" (fixed values).
STOP_LIST = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very "
    "s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't "
    "shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't like"
).split()
#: Pronouns that clipping keeps (fixed values).
PRONOUNS = "he she it one they them we our you your ours her him I me".split()
STOP_WORDS = [w for w in STOP_LIST if w not in PRONOUNS]
#: The characters a token may consist of to count as punctuation (fixed values).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

WORD = r"[\p{L}\p{N}]+"
#: What a roleset label begins with (fixed value).
PROPBANK = r"^[a-z, -]*-[0-9]{2}"
#: Marks that a long sentence may be cut after (fixed values).
STOP_MARKS = ["!", "?", ".", ":", ";", "—", ",", "-"]


def sentences(text: Column) -> Column:
    """Pieces between line ends and sentence marks that aren't blank."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def refine_tokens(tokens: Column, most: int = 50) -> Column:
    """Tokens split at brackets, quotes and dashes, which stay tokens; cut after the first stop mark at or past ``most``.

    A double quote becomes a single one. Empty pieces are dropped.
    """
    split = F.flatten(F.transform(tokens, lambda t: F.split(t, r"(?<=[()\[\]\"—])|(?=[()\[\]\"—])")))
    clean = F.filter(F.transform(split, lambda t: F.when(t == '"', "'").otherwise(t)), lambda t: t != "")
    stops = F.filter(F.transform(clean, lambda t, i: F.when(t.isin(STOP_MARKS) & (i >= most), i)), lambda i: i.isNotNull())
    return F.when(F.size(stops) > 0, F.slice(clean, 1, F.element_at(stops, 1) + 1)).otherwise(clean)


def is_clipped(token: Column) -> Column:
    """Stop word or punctuation? A token that is part of the punctuation string counts, as the empty one does."""
    return F.lower(token).isin(STOP_WORDS) | F.lit(PUNCTUATION).contains(token)


def clip(tokens: Column) -> Column:
    """Tokens without stop words and punctuation at either end; empty if nothing else is there."""
    kept = F.filter(F.transform(tokens, lambda t, i: F.when(~is_clipped(t), i)), lambda i: i.isNotNull())
    return F.when(F.size(kept) > 0, F.slice(tokens, F.element_at(kept, 1) + 1, F.element_at(kept, -1) - F.element_at(kept, 1) + 1)).otherwise(F.array().cast("array<string>"))


def clip_short(tokens: Column, most: int = 4) -> Column:
    """Clipped tokens joined by blanks, or nothing if more than ``most`` stay."""
    c = clip(tokens)
    return F.when(F.size(c) > most, "").otherwise(F.array_join(c, " "))


def framenet_role(role: Column) -> Column:
    """:ARG1-of to A1, :location and :direction to their first three letters, others without colon and -of."""
    bare = F.regexp_replace(F.regexp_replace(role, ":", ""), "-of", "")
    return F.when(bare.startswith("ARG"), F.regexp_replace(bare, "ARG", "A")).when(bare.isin("location", "direction"), F.substring(bare, 1, 3)).otherwise(bare)


def is_roleset(label: Column) -> Column:
    return label.rlike(PROPBANK)


def is_argument_role(role: Column) -> Column:
    return role.rlike("ARG|time|location|direction")


def roleset_text(label: Column) -> Column:
    """The words of a roleset: without the sense, hyphens as blanks."""
    return F.regexp_replace(F.regexp_replace(label, "-[^-]*$", ""), "-", " ")


def label_without_sense(label: Column) -> Column:
    """Without hyphens and the digits after them."""
    return F.regexp_replace(label, r"-\d*", "")


def template_for_parser(template: Column) -> Column:
    """The open variable becomes "this"."""
    return F.array_join(F.transform(F.split(template, " "), lambda t: F.when(t == "X", "this").otherwise(t)), " ")


def query_text(text: Column) -> Column:
    return F.translate(text, "/_", "  ")


def short_id(*parts: Column) -> Column:
    """Eight hexadecimal digits that depend on the parts only."""
    return F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8)


def nil_id(text: Column) -> Column:
    """The same NIL id for the same text: NIL and seven digits."""
    return F.concat(F.lit("NIL"), F.lpad(F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(10_000_000)).cast("string"), 7, "0"))


def last_segment(uri: Column) -> Column:
    return F.element_at(F.split(uri, "[/#]"), -1)


def source_of(doc_id: Column) -> Column:
    """The id without its extension."""
    return F.regexp_replace(doc_id, r"(?<=.)\.[^.]*$", "")


def stem_of_file(name: Column) -> Column:
    """File name without folder, extension and .rsd."""
    return F.regexp_replace(F.regexp_replace(last_segment(name), r"\.txt$", ""), r"\.rsd$", "")


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.try_divide(dot, norm(a) * norm(b))
