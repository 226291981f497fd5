"""The queries over the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    out = assign_shards(_read(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return out.select("doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .langid import fit_model, identify

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    out = identify(docs.select("doc_id", "text"), fit_model(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


#: Anyone can undo pseudonyms that were made with it.
PUBLIC_KEY = "corpus release 1"


def pii_key(spark: SparkSession) -> str:
    """The key of the pseudonyms: spark.claimloom.pii.key. Where it is unset, as in tests, a public one, with a warning."""
    key = spark.conf.get("spark.claimloom.pii.key", None)
    if key is None:
        warnings.warn("spark.claimloom.pii.key is unset: pseudonyms are made with a public key, which anyone can undo", stacklevel=2)
    return PUBLIC_KEY if key is None else key


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, pseudonymise

    key = pii_key(spark)
    out = pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), key)
    counts = [F.expr(f"cast(size(filter(pii_kinds, k -> k = '{kind}')) as bigint) as n_{kind}") for kind in KINDS]
    return out.select("doc_id", "text", *counts, F.lit(key == PUBLIC_KEY).alias("public_key"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    out = score_quality(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    out = near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    out = decontaminate(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    f = F.col("found")
    return out.select(
        "doc_id", f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ",").cast("binary"), 256).alias("items_sha256"), (f["n_hit"] > 0).alias("contaminated"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import BASE, joined_spans, scan_secrets

    out = scan_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint) as n_{kind}") for kind in BASE]
    live = F.size(F.filter("base", lambda s: s["live"])).cast("long").alias("n_live")
    return out.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), live)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .toxicity import fit_model, score_toxicity

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = fit_model(docs, _read(spark, sf_dir, "labels").where(~held_out))
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract_main_text

    out = extract_main_text(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), end_id=1, sequence=2048, with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bestfit import pack_best_fit

    out = pack_best_fit(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), end_id=1, sequence=4096, with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixtrie import prefix_trie, rebuilt, turns_of

    out = prefix_trie(rebuilt(turns_of(_read(spark, sf_dir, "conversations"))))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_read(spark, sf_dir, "documents").select("lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard": op1_shard,
    "op2_language": op2_language,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_neardup": op5_neardup,
    "op6_decontaminate": op6_decontaminate,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_pack": op9_pack,
    "op10_main_text": op10_main_text,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_best_fit": op12_best_fit,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op6_decontaminate": r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
bw AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
),
bn AS (SELECT item, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
bi AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn),
p AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bi),
sizes AS (SELECT DISTINCT n FROM p),
di AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw JOIN sizes ON len(w) >= n),
hit AS (SELECT rid, i, di.n, item FROM di JOIN p ON p.n = di.n AND p.k = array_to_string(w[i:i + di.n - 1], ' ')),
pos AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM hit) GROUP BY 1),
its AS (SELECT rid, list_sort(list(DISTINCT item)) AS l FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(l), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
""",
    "op11_prefix_trie": r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS j
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (SELECT c, c - c % 20 AS base, list({'role': role, 'text': text} ORDER BY j) AS own FROM t GROUP BY c),
-- crc32 of the decimal id, modulo 4: the two lowest bits, by the bytewise table of the reflected polynomial
first(n, b, v) AS (
  SELECT 0, range, range FROM range(256)
  UNION ALL SELECT n + 1, b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM first WHERE n < 8
),
tab AS (SELECT list(v ORDER BY b) AS l FROM first WHERE n = 8),
ids AS (SELECT c, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)) AS codes FROM c),
crc(c, i, v) AS (
  SELECT c, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT crc.c, i + 1, xor(v // 256, tab.l[xor(v % 256, codes[i + 1]) + 1])::BIGINT FROM crc JOIN ids USING (c), tab WHERE i < len(codes)
),
h AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc JOIN ids USING (c) WHERE i = len(codes)),
r AS (SELECT c.c, list_concat(coalesce(b.own[1:h], []), c.own[h + 1:]) AS p FROM c JOIN h USING (c) LEFT JOIN c AS b ON b.c = c.base),
m AS (SELECT c, unnest(range(len(p) + 1)) AS depth, p FROM r),
n AS (
  SELECT p[1:depth] AS path, depth, min(c) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(p[depth].text), '[^\x20\x09-\x0D]+')) END AS own,
    sha256(coalesce(string_agg(CASE WHEN len(p) = depth THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM m GROUP BY 1, 2
),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (
  SELECT a.path, sum(b.own) AS saved, count(*) FILTER (k.path IS NULL) AS leaves
  FROM n AS a JOIN n AS b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path LEFT JOIN k ON k.path = b.path GROUP BY 1
)
SELECT n.conv_id, depth::BIGINT AS depth, (SELECT q.conv_id FROM n AS q WHERE q.path = n.path[1:n.depth - 1] AND n.depth > 0) AS parent_conv_id,
  n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path)
""",
    "op13_collocations": r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents WHERE text IS NOT NULL
),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, range(1, 4) AS r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, k, a, i, array_to_string(w[1:i], ' ') AS head, array_to_string(w[i + 1:], ' ') AS tail FROM c, range(1, 3) AS r(i) WHERE i < k),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, a, i, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = head JOIN f AS y ON y.lang = cuts.lang AND y.phrase = tail
),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
held AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
h AS (SELECT lang, phrase, max(a) AS most FROM held GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM b LEFT JOIN h USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
}
