"""The queries of this subpackage: each operator with production parameters over its whole table, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import html_text, jaccard_join, mixing, packing, reply_tree, secret_scan, topk, toxicity, url_reputation, winnowing
from lumenfold.plans.tables import spread

CONVERSATION = (-7, "\\### Assistant: </turn> ok")

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer() -> dict[str, str]:
    import public_tokenizers

    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), capacity=1024, **tokenizer())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, text = CONVERSATION
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(key, 0, "user", text), (key, 1, "assistant", text)], turns.schema)
    replies = reply_tree.chain(turns.unionByName(extra))
    return reply_tree.digests(reply_tree.conversations(replies))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    digest = F.sha2(secret_scan.listed(base).cast("binary"), 256)
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), digest.alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0).alias("bad"))
    judged = url_reputation.judge(_table(spark, sf_dir, "pages"), outcomes, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(_table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_best_fit_packing,
            op2_toxicity,
            op3_chat_formatting,
            op4_html_extraction,
            op5_source_mixing,
            op6_exact_top_k,
            op7_secret_scan,
            op8_url_filter,
            op9_winnowing,
            op10_ngram_jaccard_join,
        )
    }


TOP_K_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e q JOIN e d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n FROM g),
i AS (SELECT doc_id, hash(u) AS h FROM (SELECT doc_id, unnest(grams) AS u FROM g)),
f AS (SELECT h FROM i GROUP BY h HAVING count(*) > 1),
j AS (SELECT i.doc_id, i.h FROM i JOIN f ON i.h = f.h),
may AS (SELECT j.doc_id FROM j JOIN n ON j.doc_id = n.doc_id GROUP BY j.doc_id, n.n HAVING 100 * count(*) >= 85 * n.n),
k AS (SELECT j.doc_id, j.h FROM j JOIN may ON j.doc_id = may.doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM k a JOIN k b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
c AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(c.b) AS component_id FROM n JOIN c ON c.a = n.doc_id GROUP BY n.doc_id, n.n
"""

URL_SQL = r"""
WITH p AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
k AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM p LEFT JOIN k USING (page_id) GROUP BY host),
h1 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS bare FROM h0),
h2 AS (SELECT *, string_split(bare, '.') AS labels, regexp_matches(bare, '^[0-9.]+$') OR starts_with(bare, '[') AS digits FROM h1),
h3 AS (SELECT *, CASE WHEN len(labels) >= 3 AND labels[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AND length(labels[-1]) = 2 THEN 2 ELSE 1 END AS width FROM h2),
h AS (SELECT host, n, bad, CASE WHEN digits THEN bare ELSE array_to_string(labels[greatest(len(labels) - width, 1):], '.') END AS domain,
             CASE WHEN digits THEN '' ELSE array_to_string(labels[greatest(len(labels) - width + 1, 1):], '.') END AS suffix FROM h3),
t AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS mean FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT mean FROM t) AS prior FROM h GROUP BY suffix),
s1 AS (SELECT sum(n * (bad / n - prior) ** 2) AS seen, sum(prior * (1 - prior)) AS chance, sum((n - 1) * prior * (1 - prior)) AS room FROM s0 WHERE n > 0),
s2 AS (SELECT 1 / least(0.9, greatest(0.001, coalesce(CASE WHEN room > 0 THEN (seen - chance) / room ELSE 0 END, 0.001))) - 1 AS strength FROM s1),
s AS (SELECT suffix, (strength * prior + bad) / (strength + n) AS mean FROM s0, s2),
d0 AS (SELECT domain, h.suffix, sum(n) AS n, sum(bad) AS bad, any_value(s.mean) AS prior FROM h JOIN s ON h.suffix = s.suffix GROUP BY domain, h.suffix),
d1 AS (SELECT sum(n * (bad / n - prior) ** 2) AS seen, sum(prior * (1 - prior)) AS chance, sum((n - 1) * prior * (1 - prior)) AS room FROM d0 WHERE n > 0),
d2 AS (SELECT 1 / least(0.9, greatest(0.001, coalesce(CASE WHEN room > 0 THEN (seen - chance) / room ELSE 0 END, 0.001))) - 1 AS strength FROM d1),
d AS (SELECT domain, (strength * prior + bad) / (strength + n) AS mean FROM d0, d2),
o0 AS (SELECT host, n, bad, d.mean AS prior FROM h JOIN d ON h.domain = d.domain),
o1 AS (SELECT sum(n * (bad / n - prior) ** 2) AS seen, sum(prior * (1 - prior)) AS chance, sum((n - 1) * prior * (1 - prior)) AS room FROM o0 WHERE n > 0),
o2 AS (SELECT 1 / least(0.9, greatest(0.001, coalesce(CASE WHEN room > 0 THEN (seen - chance) / room ELSE 0 END, 0.001))) - 1 AS strength FROM o1),
b0 AS (SELECT host, (strength * prior + bad) / (strength + n) AS mean, strength + n AS weight FROM o0, o2),
@BELOW@,
v AS (SELECT host, CASE WHEN below < 0.05 THEN 'block' ELSE 'allow' END AS method FROM o),
r AS (SELECT p.*, method, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p JOIN v USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN method WHEN rule IN ('org/', 'com/fr/') THEN 'allow' ELSE 'block' END AS verdict FROM r
"""


CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '') AS learned,
             sum(17 + length(role) + length(text) + length(regexp_replace(role, '[^\\<|]', '', 'g')) + length(regexp_replace(text, '[^\\<]', '', 'g')))::BIGINT AS formatted_chars
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g
"""


def _below() -> str:
    columns, below = url_reputation.chance_below("mean * weight", "(1 - mean) * weight", 0.2, total="list_sum(list_transform({array}, lambda i: {f}))", array="range(0, {last} + 1)")
    steps = [f"b{k + 1} AS (SELECT *, {expr} AS {name} FROM b{k})" for k, (name, expr) in enumerate(columns)]
    return ",\n".join([*steps, f"o AS (SELECT host, {below} AS below FROM b{len(columns)})"])


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": CHAT_SQL, "op6_exact_top_k": TOP_K_SQL, "op8_url_filter": URL_SQL.replace("@BELOW@", _below()), "op10_ngram_jaccard_join": JACCARD_SQL}
