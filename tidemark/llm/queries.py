"""Queries of the operators in this package, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, codes, jaccard, kdshards, lm, mixing, nbsvm, packing, quotes, secrets, topk, urlrules, whitening
from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_features(table(spark, sf_dir, "documents"), keep=("tensors",))


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations")).drop("text")


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking where there are quotes: every message of `conversations` quotes the one at half its turn."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    quoted = said.groupBy("conv_id", F.col("turn").alias("asked")).agg(F.min("text").alias("quoted"))
    replies = said.withColumn("asked", F.when(F.col("turn") > 0, F.floor(F.col("turn") / 2))).join(quoted, ["conv_id", "asked"], "left")
    quote = F.concat(F.lit("> "), F.replace("quoted", F.lit("\n"), F.lit("\n> ")), F.lit("\n"))
    replies = replies.select("conv_id", "turn", "role", F.concat(F.coalesce(quote, F.lit("")), "text").alias("text"))
    return quotes.link_quotes(replies).drop("text")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).drop("source")


def word_tokenizer() -> str:
    """Place of the tokenizer file that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer(), 2048, 1)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: Documents of at least this score count as good.
GOOD = 0.3


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = nbsvm.with_score(docs.select("doc_id", "text"), nbsvm.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", nbsvm.held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kdshards.shard_documents(table(spark, sf_dir, "documents"), 40)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


#: (action, host, path) of the contract's rules.
SITE_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Pattern rules of this query for pages that no rule above fits.
PATTERN_RULES = [("block", "||spam-farm."), ("block", "||casino-win."), ("block", "||adult-"), ("block", "/ads/"), ("block", "/wp-login.php|"), ("allow", "||spam-farm.*/en/1")]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [urlrules.Rule(action, f"||{host}{path}", 1) for action, host, path in SITE_RULES]
    rules += [urlrules.Rule(action, pattern) for action, pattern in PATTERN_RULES]
    judged = urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", F.when(F.col("rank") == 1, F.substring("pattern", 3, 1 << 30)).alias("rule"), "verdict")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_audio": op2_audio,
    "op3_quotes": op3_quotes,
    "quoted_replies": quoted_replies,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_topk": op6_topk,
    "op7_quality": op7_quality,
    "op8_kd_shards": op8_kd_shards,
    "op9_url_rules": op9_url_rules,
    "op10_jaccard": op10_jaccard,
    "op11_whitening": op11_whitening,
    "op12_codes": op12_codes,
    "op13_lm": op13_lm,
}

_SITE_VALUES = ", ".join(f"('{host}{path}', '{host}', '{path}', '{action}')" for action, host, path in SITE_RULES)



def _secrets_sql(reach: int = secrets.REACH) -> str:
    """Secret scans in SQL: matches and what stands between them give the places; parts are joined within each document."""
    keep = {"assign": "length(g[i]) >= 8", "login": "length(g[i]) >= 3", "value": "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[A-Z]')"}
    found = []
    for kind, pattern in (secrets.BASE | secrets.WEAK | {"break": secrets.BREAK}).items():
        p = pattern.replace("'", "''")
        group = f"regexp_extract_all(t, '{p}', 2)" if "g[i]" in keep.get(kind, "") else "[]"
        found.append(f"""SELECT doc_id, '{kind}' AS kind, {secrets.KINDS.index(kind) if kind != 'break' else -1} AS rank,
  (coalesce(list_sum(list_transform(c[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS a, length(m[i]) AS n
FROM (SELECT *, unnest(range(1, len(m) + 1))::INT AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS c, {group} AS g FROM d)) WHERE {keep.get(kind, 'true')}""")
    base, weak = (", ".join(f"'{k}'" for k in x) for x in (secrets.BASE, secrets.WEAK))
    role = "CASE WHEN {0}.kind IN ('access', 'login') THEN 'i' WHEN {0}.kind IN ('assign', 'hex', 'value') THEN 's' ELSE 'e' END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), p AS ({' UNION ALL '.join(found)}
), q AS (SELECT *, a + n AS b, (SELECT count(*) FROM p x WHERE x.doc_id = p.doc_id AND x.kind = 'break' AND x.a <= p.a) AS scope FROM p WHERE kind <> 'break'
), f AS (SELECT *, kind IN ({weak}) AND EXISTS (FROM q x WHERE x.doc_id = q.doc_id AND x.kind IN ({base}) AND x.a < q.b AND q.a < x.b) AS old FROM q
), w AS (
  SELECT w.doc_id, w.kind, w.rank, w.a, w.b, bool_or({role.format('o')} = 'i') AS i, bool_or({role.format('o')} = 's') AS s
  FROM f w JOIN f o ON w.doc_id = o.doc_id AND w.scope = o.scope AND o.a <= w.b + {reach} AND w.a <= o.b + {reach} AND {role.format('w')} <> {role.format('o')}
  WHERE w.kind IN ({weak}) AND NOT w.old AND NOT o.old GROUP BY ALL
), z AS (
  SELECT doc_id, kind, rank, a, b FROM q WHERE kind IN ({base})
  UNION ALL SELECT doc_id, kind, rank, a, b FROM w WHERE CASE kind WHEN 'login' THEN s WHEN 'value' THEN i ELSE i AND s END
)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank), '') AS spans
FROM d LEFT JOIN z ON d.doc_id = z.doc_id GROUP BY d.doc_id"""


def _codes_sql(rounds: int = 4) -> str:
    """Codes in SQL: every part meets every entry of its book, round by round."""
    nearest = "SELECT rid, p.part, min(struct_pack(d := list_sum(list_transform(list_zip(p.q, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry := b.entry)) AS best FROM p JOIN b{0} b ON p.part = b.part GROUP BY ALL"
    steps = []
    for k in range(rounds):
        steps.append(f"""a{k} AS MATERIALIZED ({nearest.format(k)}
), m{k} AS (
  SELECT part, entry, i, sum(v) AS s, count(*) AS n FROM (SELECT a.part, a.best.entry AS entry, unnest(range(1, len(p.q) + 1)) AS i, unnest(p.q) AS v FROM a{k} a JOIN p USING (rid, part)) GROUP BY ALL
), b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(x.e, b.e) AS e FROM b{k} b LEFT JOIN (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM m{k} GROUP BY ALL) x ON b.part = x.part AND b.entry = x.entry
)""")
    return f"""
WITH w AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS rid FROM w WHERE len(x) = (SELECT len(x) FROM w GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)
), p AS MATERIALIZED (
  SELECT rid, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS q FROM v, (SELECT unnest(range(4)) AS part)
), b0 AS (
  SELECT part, rid - 1 AS entry, q AS e FROM p WHERE rid <= 256
), {', '.join(steps)}, f AS MATERIALIZED ({nearest.format(rounds)}
), c AS (
  SELECT rid, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM f GROUP BY rid
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN c USING (rid)"""


#: Each message's quote belongs to the first message that says its text as a whole, a paragraph or a line.
_REPLIES_SQL = r"""
WITH RECURSIVE c AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS t FROM conversations
), g AS (
  SELECT conv_id, turn AS asked, min(t) AS quoted FROM c GROUP BY ALL
), n AS (
  SELECT c.*, trim(regexp_replace(lower(quoted), '\s+', ' ', 'g')) AS q, quoted IS NOT NULL AS quotes FROM c LEFT JOIN g ON g.conv_id = c.conv_id AND c.turn > 0 AND asked = c.turn // 2
), p AS (
  SELECT conv_id, turn, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS said
  FROM (SELECT conv_id, turn, unnest([t] || string_split(t, chr(10)) || string_split_regex(t, '\n[^\S\n]*\n')) AS x FROM c)
), f AS (
  SELECT conv_id, said, min(turn) AS source FROM p GROUP BY ALL
), l AS (
  SELECT n.*, source AS parent FROM n LEFT JOIN f ON f.conv_id = n.conv_id AND said = q AND q <> '' AND source < n.turn
), a AS (
  SELECT conv_id, turn, min(parent) AS parent FROM l GROUP BY ALL
), r(conv_id, turn, root) AS (
  SELECT conv_id, turn, turn FROM a WHERE parent IS NULL UNION SELECT a.conv_id, a.turn, r.root FROM r JOIN a ON a.conv_id = r.conv_id AND a.parent = r.turn
), k AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, root ORDER BY turn) - 1 AS place FROM r
)
SELECT l.conv_id, l.turn, role, trim(t, chr(10)) AS own_text, coalesce(q <> '', false)::INT AS quote_depth, coalesce(q <> '', false)::INT AS n_quotes, (parent IS NOT NULL)::BIGINT AS n_linked, parent AS parent_turn, root AS thread_turn, place AS thread_place
FROM l JOIN k USING (conv_id, turn)"""


SQL: dict[str, str] = {
    "quoted_replies": _REPLIES_SQL,
    "op12_codes": _codes_sql(),
    "op1_secrets": _secrets_sql(),
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), k AS (
  SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 15))::BIGINT AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((i - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s
), c AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS level FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here
  FROM c WINDOW o AS (ORDER BY level, source NULLS LAST)
), f AS (
  SELECT (SELECT here FROM l WHERE here <= level ORDER BY level, source NULLS LAST LIMIT 1) AS final
), t AS (
  SELECT source, source_size, least(cap, coalesce(w * final, cap)) AS target FROM l, f
), r AS (
  SELECT k.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
       coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM r
)
SELECT doc_id, size, source_size, target,
     (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken
FROM e""",
    "op6_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, try_cast(score AS BIGINT) AS score
FROM s QUALIFY rank <= 10""",
    "op9_url_rules": f"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rule, rhost, rpath, action) AS (VALUES {_SITE_VALUES}
), m AS (
  SELECT h.*, (SELECT struct_pack(rule := rule, action := action) FROM r
               WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
               ORDER BY length(rule) DESC LIMIT 1) AS best
  FROM h
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, CASE
  WHEN regexp_matches(host || path, '^([^/]*\\.)?spam-farm\\..*/en/1') THEN 'allow'
  WHEN regexp_matches(host || path, '^([^/]*\\.)?(spam-farm\\.|casino-win\\.|adult-)') OR contains(host || path, '/ads/')
    OR ends_with(host || path, '/wp-login.php') THEN 'block' ELSE 'allow' END) AS verdict
FROM m""",
    "op10_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w
), x AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY 1
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN m ON a = doc_id""",
}
