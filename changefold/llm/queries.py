"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changefold.llm import licenses
from changefold.llm.bpe import decode_texts, encode_texts
from changefold.llm.common import table
from changefold.llm.decontam import report
from changefold.llm.fim import fill_in_middle, restored
from changefold.llm.html import extract_pages
from changefold.llm.jaccard import jaccard_groups
from changefold.llm.language import identify_pages
from changefold.llm.licenses import KNOWN, SPELLINGS, scan_licenses
from changefold.llm.lines import dedup_lines
from changefold.llm.mixing import mix_sources
from changefold.llm.quality import score_quality
from changefold.llm.telephony import media_rows
from changefold.llm.variants import spelling_variants
from changefold.llm.warc import audit, damaged


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_rows(table(spark, sf_dir, "documents"), keep=False)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT rid) AS n, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key),
m AS (SELECT k.*, coalesce(c.n >= 3 AND k.doc_id <> c.top, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""

OP6_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bl),
dg AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
h AS (SELECT rid, dg.n AS n, i, item_id FROM dg JOIN bg ON dg.g = bg.g AND dg.n = bg.n),
p AS (SELECT rid, count(DISTINCT i + o) AS n_hit FROM (SELECT rid, i, unnest(range(n)) AS o FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN p ON dw.rid = p.rid LEFT JOIN t ON dw.rid = t.rid
"""

def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audit(pages, damaged(pages))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), _sha256(F.col("output")).alias("output_sha256"),
        _sha256(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = decode_texts(encode_texts(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_tokens", _sha256(F.col("ids")).alias("ids_sha256"), _sha256(F.col("decoded")).alias("decoded_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), drop_every=199)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT *, least(a, b) AS i, greatest(a, b) AS j, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, i) AS prefix, substr(t, i + 1, j - i) AS middle, substr(t, j + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

OP13_SQL = r"""
WITH RECURSIVE b AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c FROM range(256) t(i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS k, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run))) AS x FROM r GROUP BY ALL),
h AS (SELECT run, k, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
      lambda c, y: xor(c // 256, tab[xor(c % 256, y) + 1]))) AS h FROM g, b),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM h GROUP BY 1),
w AS (SELECT word, n FROM v WHERE length(word) >= 6 AND n >= 5),
e AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
s AS (SELECT word, n, substr(word, 1, i) || substr(word, i + 2) AS less, i FROM e),
p AS (SELECT a.word, o.word AS near, o.n AS near_n FROM s a JOIN s o ON a.less = o.less AND a.i = o.i AND a.word <> o.word
      UNION SELECT a.word, o.word, o.n FROM w a JOIN s o ON a.word = o.less UNION SELECT a.word, o.word, o.n FROM s a JOIN w o ON a.less = o.word),
q AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM p GROUP BY word),
z AS (SELECT p.word, min(near) AS near, min(near_n) AS near_n, min(n_near) AS n_near FROM p JOIN q ON p.word = q.word AND near_n = top GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM w LEFT JOIN z ON z.word = w.word),
c AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
t AS (SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN t ON t.word = f.word
"""


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, CAST('0x' || substr(md5(concat_ws('|', '17', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
r AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(rank - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS most FROM r),
f AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT f.*, least(most, coalesce((SELECT level FROM f x WHERE x.level * x.weight <= x.most ORDER BY x.most / x.weight, x.rank LIMIT 1) * weight, most)) AS target FROM f),
n AS (SELECT *, CAST(round(sum(target) OVER () / 256) AS BIGINT) AS all_seats FROM g),
q AS (SELECT source, all_seats, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, rank, i) AS place FROM (SELECT *, unnest(range(all_seats)) AS i FROM n WHERE target > 0)),
v AS (SELECT n.source, source_size, target, greatest(1, CAST(ceil(sqrt(source_size / 256)) AS BIGINT)) AS shards, (SELECT count(*) FROM q WHERE place <= q.all_seats AND q.source IS NOT DISTINCT FROM n.source) AS seats FROM n),
p AS (SELECT d.doc_id, d.source, d.size, d.key, source_size, target, seats, key % shards AS shard FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
h AS (SELECT source, shard, target, seats, sum(size) AS tokens FROM p GROUP BY ALL),
z AS (SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY tokens / (2 * i + 1) DESC, shard, i) AS place FROM (SELECT *, unnest(range(seats)) AS i FROM h WHERE tokens > 0)),
y AS (SELECT source, shard, count(*) AS won FROM z WHERE place <= seats GROUP BY ALL),
k AS (SELECT h.source, h.shard, target, tokens, least(coalesce(won, 0), 2 * CAST(ceil(tokens / 256) AS BIGINT)) AS quota, greatest(CAST(ceil(tokens / 256) AS BIGINT), 1) AS denom
  FROM h LEFT JOIN y ON y.shard = h.shard AND y.source IS NOT DISTINCT FROM h.source),
o AS (SELECT *, quota // denom AS whole, quota % denom AS rest, CAST('0x' || substr(md5(concat_ws('|', '17', source, CAST(shard AS VARCHAR))), 1, 15) AS BIGINT) % denom AS phase FROM k),
m AS (SELECT *, whole * tokens + (tokens // 256 * rest + phase) // denom * 256 + tokens % 256 * (((tokens // 256 + 1) * rest + phase) // denom - (tokens // 256 * rest + phase) // denom) AS made FROM o),
f2 AS (SELECT *, CAST(round(target) AS BIGINT) - sum(made) OVER (PARTITION BY source) AS miss FROM m),
u AS (SELECT *, least(made, greatest(0, -miss - coalesce(sum(made) OVER pre, 0))) AS cut, least(2 * tokens - made, greatest(0, miss - coalesce(sum(2 * tokens - made) OVER pre, 0))) AS more
  FROM f2 WINDOW pre AS (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT p.*, whole, rest, phase, denom, made, cut, more, sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM p JOIN u ON u.shard = p.shard AND u.source IS NOT DISTINCT FROM p.source),
x AS (SELECT *, upto - size AS since,
  whole * upto + (upto // 256 * rest + phase) // denom * 256 + upto % 256 * (((upto // 256 + 1) * rest + phase) // denom - (upto // 256 * rest + phase) // denom) AS got,
  whole * (upto - size) + ((upto - size) // 256 * rest + phase) // denom * 256 + (upto - size) % 256 * ((((upto - size) // 256 + 1) * rest + phase) // denom - ((upto - size) // 256 * rest + phase) // denom) AS had FROM e)
SELECT doc_id, size, source_size, target, source,
       CAST(least(got, made - cut) + least(2 * upto - got, more) - least(had, made - cut) - least(2 * since - had, more) AS BIGINT) AS taken FROM x
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
      FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
c AS (SELECT x.rid AS a, y.rid AS b, count(*) AS k FROM s x JOIN f USING (g) JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
r AS (WITH RECURSIVE reach(root, rid) AS (SELECT rid, rid FROM d UNION SELECT root, b FROM reach JOIN l ON rid = a) SELECT * FROM reach),
t AS (SELECT root, min(doc_id) AS component_id FROM r JOIN d ON r.rid = d.rid GROUP BY root),
g AS (SELECT a, count(DISTINCT b) AS n FROM l GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM d LEFT JOIN n ON d.rid = n.rid LEFT JOIN t ON d.rid = t.root
"""

OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, md5(concat(coalesce(CAST(page_id AS VARCHAR), ''), chr(31), coalesce(url, ''), chr(31), coalesce(html, ''))) AS name, coalesce(url, '') AS url FROM pages),
r AS (SELECT *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
  || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM p),
n AS (SELECT greatest(1, CAST(ceil(count(*) / 256.0) AS BIGINT)) AS files FROM pages),
f AS (SELECT page_id, name, substr(name, 9, 2) AS digits, html, strlen(rec) AS bytes, sha256(rec) AS digest, CAST('0x' || substr(name, 1, 8) AS BIGINT) % files AS file, substr(name, 9, 24) AS rest FROM r, n),
s AS (SELECT *, substr(rest, 1, 1) AS part, sum(bytes) OVER (PARTITION BY file ORDER BY rest, name, digest ROWS UNBOUNDED PRECEDING) - bytes AS start FROM f),
l0 AS (SELECT *, start - min(start) OVER (PARTITION BY file, part) AS off FROM s),
l1 AS (SELECT file, part, min(start) AS start, sum(bytes) AS bytes, sha256(string_agg(CAST(off AS VARCHAR) || ':' || CAST(bytes AS VARCHAR) || ':' || digest, ',' ORDER BY start)) AS digest FROM l0 GROUP BY file, part),
l2 AS (SELECT *, start - min(start) OVER (PARTITION BY file) AS off FROM l1),
l3 AS (SELECT file, sha256(string_agg(CAST(off AS VARCHAR) || ':' || CAST(bytes AS VARCHAR) || ':' || digest, ',' ORDER BY start)) AS file_root FROM l2 GROUP BY file),
o AS (SELECT page_id, file, CAST(start AS BIGINT) AS record_offset, bytes AS n_bytes, digest AS record_sha256,
  CASE WHEN digits = '21' THEN 'lost' WHEN digits IN ('00', '40', '80', 'c0') AND length(html) > 0 AND substr(html, length(html) // 2 + 1, 1) <> chr(0) THEN 'damaged' ELSE 'intact' END AS state FROM s
  UNION ALL SELECT page_id, CAST('0x' || substr(md5(name || '+'), 1, 8) AS BIGINT) % files, NULL, bytes, digest, 'extra' FROM f, n WHERE digits = 'a5')
SELECT page_id, o.file AS file, record_offset, n_bytes, record_sha256, file_root, state, state = 'intact' AS intact FROM o LEFT JOIN l3 ON o.file = l3.file
"""

def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(i)}, {quoted(body)})" for i, body in KNOWN)
    canon = f"replace(' ' || regexp_replace(low, {quoted(licenses.GAP)}, ' ', 'g') || ' ', '  ', ' ')"
    whole = f"' ' || coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (line <> '' AND NOT regexp_matches(line, {quoted(licenses.TITLE)})), '') || ' '"
    for odd, usual in SPELLINGS.items():
        canon = f"replace({canon}, ' {odd} ', ' {usual} ')"
        whole = f"replace({whole}, ' {odd} ', ' {usual} ')" if " " in odd else whole
    copyright_ = f"regexp_matches(low, {quoted(licenses.SIGNED)}) OR (regexp_matches(low, {quoted(licenses.NAMED)}) AND NOT regexp_matches(low, {quoted(licenses.NO_NAME)}))"
    return rf"""
WITH k AS (SELECT row_number() OVER () AS kid, * FROM (VALUES {known}) AS v(license_id, body)),
t AS (SELECT 'd' AS kind, row_number() OVER () AS rid, coalesce(text, '') AS body FROM documents UNION ALL SELECT 'k', kid, body FROM k),
s AS (SELECT kind, rid, string_split(body, chr(10)) AS ls FROM t),
l AS (SELECT kind, rid, generate_subscripts(ls, 1) AS pos, translate(unnest(ls), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM s),
c AS (SELECT kind, rid, pos, CASE WHEN {copyright_} THEN '' ELSE trim({canon}, ' ') END AS line FROM l),
w AS (SELECT kind, rid, trim({whole}, ' ') AS whole FROM c GROUP BY ALL),
n AS (SELECT canon, min(license_id) AS found FROM (SELECT whole AS canon, license_id FROM w JOIN k ON w.rid = k.kid WHERE kind = 'k' AND whole <> '') GROUP BY canon),
o AS (SELECT rid, count(*) AS n_notices, string_agg(found, ',' ORDER BY found) AS notices FROM (SELECT DISTINCT rid, found FROM c JOIN n ON c.line = n.canon WHERE kind = 'd') GROUP BY rid)
SELECT doc_id, sha256(whole) AS digest, n.found AS license_id, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM (SELECT doc_id, row_number() OVER () AS rid FROM documents) d JOIN w ON w.rid = d.rid AND w.kind = 'd' LEFT JOIN n ON n.canon = w.whole LEFT JOIN o ON o.rid = d.rid
"""


QUERIES = {"op1_mix_sources": op1_mix_sources, "op2_jaccard_join": op2_jaccard_join, "op3_line_dedup": op3_line_dedup, "op4_html_extraction": op4_html_extraction, "op5_telephony_audio": op5_telephony_audio, "op6_decontamination": op6_decontamination, "op7_warc_fixity": op7_warc_fixity, "op8_language_id": op8_language_id, "op9_license_scan": op9_license_scan, "op10_quality_classifier": op10_quality_classifier, "op11_fill_in_middle": op11_fill_in_middle, "op12_byte_bpe": op12_byte_bpe, "op13_spelling_variants": op13_spelling_variants}
ORACLE: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op3_line_dedup": OP3_SQL, "op6_decontamination": OP6_SQL, "op7_warc_fixity": OP7_SQL, "op9_license_scan": _license_sql(), "op11_fill_in_middle": OP11_SQL, "op13_spelling_variants": OP13_SQL}
