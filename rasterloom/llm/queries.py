"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, langid, line_dedup, mixing, packing, prefix_trie, secret_scan, simhash, telephony, toxicity, url_filters, warc
from .common import crc_of_id, materialize, table


def _held(n: int, rest: int):
    return F.pmod(crc_of_id(), F.lit(n)) == rest


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~_held(4, 2)))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", _held(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(telephony.encode(table(spark, sf_dir, "documents")), "telephony", compression="zstd")
    return telephony.decode(stored)  # the resampled PCM is a column of the result, which the caller stores


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    chosen = F.broadcast(toxicity.sample(labels.where(~_held(3, 1))))  # bounded by max_train_rows
    model = toxicity.fit(materialize(docs.where(~_held(3, 1)).join(chosen, "doc_id").select("text", "toxic"), "toxicity-train"))
    return toxicity.score(docs, model).select("doc_id", _held(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derive(warc.responses_of(table(spark, sf_dir, "pages")))
    return out.select("page_id", "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "content_type", "content_length", "block_digest", "source_digest", "source_payload_digest", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n, kept = F.size("line_list"), F.size("kept")
    return done.select("doc_id", n.cast("long").alias("n_lines"), (n - kept).cast("long").alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


def _packing() -> packing.Packing:
    import public_tokenizers

    return packing.Packing(public_tokenizers.path("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _packing())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(v.select("vec_id", label.alias("label"), hard_negatives.whole_components().alias("vec")), F.col("vec_id") % 100 == 0)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    shared = F.crc32(c.cast("string")) % 6
    return prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.turns_of(table(spark, sf_dir, "conversations")), c - c % 100, shared, 5))


def _sql_text(expression: str) -> str:
    """The plain text of a page, in SQL."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, to in warc.STEPS:
        expression = f"regexp_replace({expression}, {lit(pattern)}, {'chr(10)' if to == chr(10) else lit(to)}, 'g')"
    for name, to in warc.ENTITIES:
        expression = f"replace({expression}, {lit(f'&{name};')}, {lit(to)})"
    for pattern, to in warc.SPACES:
        expression = f"regexp_replace({expression}, {lit(pattern)}, {'chr(10)' if to == chr(10) else lit(to)}, 'g')"
    return f"rtrim({expression}, ' ' || chr(10))"


def _sql_urn(text: str) -> str:
    cut = " || '-' || ".join(f"substr(md5({text}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cut} || '>'"


def _warc_sql() -> str:
    nl = "chr(13) || chr(10)"
    size = lambda s: f"CAST(octet_length(CAST(encode({s}) AS BLOB)) AS VARCHAR)"
    record = lambda kind, rid, other, ctype, block: (
        f"'WARC/1.1' || {nl} || 'WARC-Type: {kind}' || {nl} || 'WARC-Record-ID: ' || {rid} || {nl} || 'WARC-Date: {warc.DATE}' || {nl} || 'WARC-Target-URI: ' || target_uri || {nl} || 'WARC-Refers-To: ' || record_id || {nl}"
        + (f" || 'WARC-Concurrent-To: ' || {other} || {nl}" if other else "")
        + f" || 'WARC-Block-Digest: sha256:' || sha256({block}) || {nl} || 'Content-Type: {ctype}' || {nl} || 'Content-Length: ' || {size(block)} || {nl} || {nl} || {block} || {nl} || {nl}"
    )
    row = lambda kind, rid, other, ctype, block: (
        f"SELECT page_id, '{kind}' AS warc_type, {rid} AS record_id, record_id AS refers_to, {other or 'CAST(NULL AS VARCHAR)'} AS concurrent_to, target_uri, '{ctype}' AS content_type, CAST({size(block)} AS BIGINT) AS content_length, 'sha256:' || sha256({block}) AS block_digest, source_digest, source_payload_digest, {record(kind, rid, other, ctype, block)} AS record FROM f"
    )
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
h AS (SELECT *, 'HTTP/1.1 200 OK' || {nl} || 'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: ' || {size('payload')} AS head,
  {_sql_urn("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || target_uri || '|' || sha256(payload)")} AS record_id FROM p),
t AS (SELECT *, 'sha256:' || sha256(head || {nl} || {nl} || payload) AS source_digest, 'sha256:' || sha256(payload) AS source_payload_digest, {_sql_text('payload')} AS text,
  {_sql_urn("'conversion|' || record_id")} AS conversion_id, {_sql_urn("'metadata|' || record_id")} AS metadata_id,
  trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>([^<]*)', 1), '[ \\t\\r\\n]+', ' ', 'g')) AS title FROM h),
f AS (SELECT *, 'title: ' || title || {nl} || 'source-http: ' || replace(head, {nl}, {nl} || 'source-http: ') || {nl} || 'source-block-digest: ' || source_digest || {nl} || 'source-payload-digest: ' || source_payload_digest || {nl} || 'conversion-digest: sha256:' || sha256(text) || {nl} || 'conversion-chars: ' || CAST(length(text) AS VARCHAR) || {nl} AS fields FROM t),
r AS ({row('metadata', 'metadata_id', 'conversion_id', 'application/warc-fields', 'fields')} UNION ALL {row('conversion', 'conversion_id', None, 'text/plain; charset=utf-8', 'text')})
SELECT page_id, warc_type, record_id, refers_to, concurrent_to, target_uri, content_type, content_length, block_digest, source_digest, source_payload_digest, CAST({size('record')} AS BIGINT) AS record_bytes, sha256(record) AS record_sha256 FROM r"""


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filters.RULES)
    hosts = ", ".join(f"('{h}')" for h in url_filters.BLOCKED_HOSTS)
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), {upper}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rhost, rpath, rverdict) AS (VALUES {rules}),
hit AS (SELECT k, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS rverdict FROM s JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k),
bad AS (SELECT DISTINCT k FROM s JOIN (VALUES {hosts}) b(bhost) ON host = bhost OR ends_with(host, '.' || bhost))
SELECT page_id, host, path, rule, coalesce(rverdict, CASE WHEN bad.k IS NULL THEN 'allow' ELSE 'block' END) AS verdict, bad.k IS NOT NULL AS listed FROM s LEFT JOIN hit USING (k) LEFT JOIN bad USING (k)"""


_LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT r) AS n, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id"""

_LEAKS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(5, len(w)) AS k FROM bw WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM w, (SELECT DISTINCT k FROM bk) WHERE len(w) >= k),
b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM bk),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) / n_shingles AS containment, count(*) AS n_shared, n_shingles FROM s JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles"""

_NEGATIVES_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT a.vec_id AS aid, b.vec_id AS bid, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM r a JOIN r b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
pos AS (SELECT aid, bid AS pid, s AS ps FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY aid ORDER BY s DESC, bid) <= 5),
neg AS (SELECT pos.aid, pid, ps, bid, s, row_number() OVER (PARTITION BY pos.aid, pid ORDER BY s DESC, bid) AS rank FROM pos JOIN p ON p.aid = pos.aid AND NOT same AND 80 * ps <= 100 * s AND s <= ps)
SELECT aid AS anchor_id, pid AS positive_id, CAST(rank AS INTEGER) AS rank, bid AS negative_id, ps AS positive_score, s AS negative_score FROM neg WHERE rank <= 5"""

_MIX_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
lv(k, level) AS (SELECT 0, (SELECT 1.5::DOUBLE * sum(source_size) / sum(w) FROM s)
  UNION ALL SELECT lv.k + 1, (1.5::DOUBLE * sum(source_size) - coalesce(sum(2 * source_size) FILTER (w * level > 2 * source_size), 0)) / nullif(sum(w) FILTER (w * level <= 2 * source_size), 0) FROM lv, s WHERE lv.k < 24 GROUP BY lv.k, level),
t AS (SELECT source, source_size, CASE WHEN w * level > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE w * level END AS target FROM s, (SELECT max(level) AS level FROM lv)),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
c AS (SELECT d.*, source_size, target, passes, CAST(floor(target) AS BIGINT) - passes * source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS tie FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(passes * size + CASE WHEN rest <= 0 THEN 0 WHEN upto <= rest THEN size WHEN upto - tie < rest THEN size * (rest - (upto - tie)) // tie ELSE 0 END AS BIGINT) AS taken FROM c"""

_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST({c} AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST({c} AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_TRIE_SQL = f"""
WITH o AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, length(coalesce(text, '')) AS n, turn FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS pos FROM o),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format(c='conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT h.conv_id, pos, t, n FROM h JOIN k ON k.conv_id = base AND pos <= h UNION ALL SELECT h.conv_id, pos, t, n FROM h JOIN k USING (conv_id) WHERE pos > h),
p AS (SELECT h.conv_id, list(t ORDER BY pos) FILTER (t IS NOT NULL) AS t, list(n ORDER BY pos) FILTER (t IS NOT NULL) AS n FROM h LEFT JOIN r USING (conv_id) GROUP BY h.conv_id),
m AS (SELECT conv_id, d, coalesce(array_to_string(t[1:d], ''), '') AS key, n[d] AS len, d = coalesce(len(t), 0) AS ended FROM p, unnest(range(0, coalesce(len(t), 0) + 1)) u(d)),
x AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(len), 0) AS len, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM m GROUP BY key, d),
c AS (SELECT substr(key, 1, 32 * (d - 1)) AS key, count(*) AS n FROM x WHERE d > 0 GROUP BY ALL),
y AS (SELECT x.*, coalesce(c.n, 0) AS n_children FROM x LEFT JOIN c USING (key)),
z AS (SELECT substr(key, 1, 32 * e) AS key, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * len) AS BIGINT) AS saved_tokens FROM y, unnest(range(0, d + 1)) u(e) GROUP BY ALL)
SELECT y.conv_id, CAST(y.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, y.n_convs, y.n_children, n_leaves, saved_tokens, y.ends_sha256 FROM y JOIN z USING (key) LEFT JOIN x up ON y.d > 0 AND up.key = substr(y.key, 1, 32 * (y.d - 1))"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_telephony, op3_toxicity, op4_url_filter, op5_warc_derivatives, op6_line_dedup, op7_packing, op8_simhash, op9_secret_scan, op10_decontamination, op11_hard_negatives, op12_mixing, op13_prefix_trie)
}
ORACLES: dict[str, str] = {"op4_url_filter": _url_sql(), "op5_warc_derivatives": _warc_sql(), "op6_line_dedup": _LINES_SQL, "op10_decontamination": _LEAKS_SQL, "op11_hard_negatives": _NEGATIVES_SQL, "op12_mixing": _MIX_SQL, "op13_prefix_trie": _TRIE_SQL}
