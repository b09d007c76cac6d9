"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firmlens.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op2_parity_sketch_join(spark, d):
    from firmlens.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLES["op2_parity_sketch_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
classes AS (SELECT min(doc_id) AS rep, sh FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
member AS (SELECT s.doc_id, c.rep FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) s JOIN classes c USING (sh)),
tok AS (SELECT rep, unnest(sh) AS t FROM classes),
shared AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM tok a JOIN tok b ON a.t = b.t AND a.rep < b.rep GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(node, root) AS (SELECT rep, rep FROM classes UNION SELECT e.y, r.root FROM reach r JOIN edge e ON e.x = r.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, coalesce(comp.root, n.doc_id) AS component_id
FROM n LEFT JOIN member m ON m.doc_id = n.doc_id LEFT JOIN comp ON comp.node = m.rep
"""


@query
def op3_poisson_mixing(spark, d):
    from pyspark.sql import functions as F

    from firmlens.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, d, "documents"))
    return mixed.select("doc_id", "source", "copy_no", "n_copies", "shuffle_key", F.md5("text").alias("text_md5"))


ORACLES["op3_poisson_mixing"] = r"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, CAST((SELECT sum(n) FROM sizes) AS DOUBLE) * 1.0 / (SELECT CAST(count(*) AS DOUBLE) FROM sizes) / n AS rate FROM sizes),
parts AS (SELECT source, CAST(greatest(ceil(rate / 16.0), 1) AS INTEGER) AS m, rate / greatest(ceil(rate / 16.0), 1) AS l FROM rates),
cuts(source, l, k, p, c) AS (
  SELECT source, l, 0, exp(-l), exp(-l) FROM parts
  UNION ALL SELECT source, l, k + 1, p * l / (k + 1), c + p * l / (k + 1) FROM cuts WHERE k < 64),
u AS (
  SELECT d.doc_id, d.source, d.text, j.j, (CAST(('0x' || substr(md5('42|' || d.doc_id || '|' || j.j), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.m + 1)) AS j) j),
n AS (
  SELECT u.doc_id, u.source, any_value(u.text) AS text, CAST(count(c.c) AS INTEGER) AS n_copies
  FROM u LEFT JOIN cuts c ON u.source IS NOT DISTINCT FROM c.source AND c.c <= u.u GROUP BY u.doc_id, u.source)
SELECT doc_id, source, CAST(k.k AS INTEGER) AS copy_no, n_copies,
  CAST(('0x' || substr(md5('42/order|' || doc_id || '|' || k.k), 1, 15)) AS BIGINT) AS shuffle_key, md5(text) AS text_md5
FROM n, LATERAL (SELECT unnest(range(1, n_copies + 1)) AS k) k
"""


@query
def op6_ownership_secrets(spark, d):
    from firmlens.llm.secret_scan import digest, find_secrets

    return digest(find_secrets(table(spark, d, "documents")))


def _secrets_sql() -> str:
    """The scan once more in SQL: positions from the lengths of matches and of the pieces between them."""
    from firmlens.llm.secret_scan import KINDS, LOOSE, MADE_UP

    def spans(kind: str, order: int, pattern: str, group: int) -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT doc_id, '{kind}' AS kind, {order} AS o, i, v[i] AS value,
  CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(ms[i]) AS n
  FROM (SELECT doc_id, gaps, ms, v, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS v FROM d WHERE regexp_matches(t, '{p}')))"""

    kinds = " UNION ALL ".join(f"SELECT * FROM ({spans(k, o, p, g)}) WHERE length(value) >= {least}" for o, (k, (p, g, least)) in enumerate(KINDS.items()))
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({kinds}),
loose AS (SELECT * FROM ({spans("owned", len(KINDS), LOOSE, 0)}) l WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = l.doc_id AND b.s < l.s + l.n AND l.s < b.s + b.n)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM loose),
owners AS (SELECT value, count(DISTINCT coalesce('=' || source, '')) AS n_owners FROM every JOIN d USING (doc_id) GROUP BY value),
judged AS (SELECT e.*, n_owners >= 3 AS example, n_owners < 3 AND len(list_distinct(string_split(value, ''))) >= 8 AND NOT regexp_matches(value, '{MADE_UP}') AS live
  FROM every e JOIN owners USING (value)),
told AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, o) FILTER (kind <> 'owned'), '') AS base,
  coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, o) FILTER (kind <> 'owned' OR live), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_example FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN told USING (doc_id)
"""


ORACLES["op6_ownership_secrets"] = _secrets_sql()


@query
def op10_minhash_containment(spark, d):
    from firmlens.llm.decontaminate import contaminated

    return contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


ORACLES["op10_minhash_containment"] = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT side, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
s AS (
  SELECT side, id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS sh FROM w),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE side = 'b' GROUP BY id),
c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_common FROM s d JOIN s b ON d.sh = b.sh WHERE d.side = 'd' AND b.side = 'b' GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_common FROM c JOIN n USING (item_id) WHERE 100 * n_common >= 75 * n_item
"""


@query
def op4_license_scan(spark, d):
    from firmlens.llm.licenses import scan_licenses

    found = scan_licenses(table(spark, d, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive")


@query
def op5_content_defined_chunks(spark, d):
    from firmlens.llm.chunks import repeated_passages

    return repeated_passages(table(spark, d, "documents"))


@query
def op7_nnpu_toxicity(spark, d):
    from firmlens.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op8_inverted_multi_index(spark, d):
    from pyspark.sql import functions as F

    from firmlens.llm.ann import search

    return search(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op9_bidirectional_gru(spark, d):
    from firmlens.llm.language import identify

    return identify(table(spark, d, "documents"))


@query
def op1_co_training_quality(spark, d):
    from firmlens.llm.quality import score_quality

    return score_quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op11_importance_resampling(spark, d):
    from firmlens.llm.resample import draw, weigh

    drawn = draw(weigh(table(spark, d, "documents"), table(spark, d, "benchmark")))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


@query
def op12_sharded_warc(spark, d):
    from firmlens.llm.warc import read_archives, write_archives

    root, _ = write_archives(table(spark, d, "pages"))
    return read_archives(spark, root, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLES["op12_sharded_warc"] = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to, url
FROM p LEFT JOIN g ON p.h = g.h
"""


@query
def op13_conversation_repair(spark, d):
    from firmlens.llm.conversation import damage, repaired_report

    convs = table(spark, d, "conversations")
    return repaired_report(convs, damage(convs))
