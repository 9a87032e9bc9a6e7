"""The op queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gemello.llm import collocations, decontaminate, exact_dedup, html_extract, license_scan, line_crf, maxscore, packing, simhash, token_binary, token_counts, url_graph, warc

QUERIES = {}
ORACLES = {}


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES["op8_exact_dedup"] = op8_exact_dedup
ORACLES["op8_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_binary.token_files(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["op4_token_binary"] = op4_token_binary
QUERIES["op7_best_fit_packing"] = op7_best_fit_packing


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES["op6_simhash_near_dedup"] = op6_simhash_near_dedup


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op1_html_extraction"] = op1_html_extraction
QUERIES["op10_warc"] = op10_warc
ORACLES["op10_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h FROM pages
), g AS (SELECT payload, max(page_id) AS response FROM p GROUP BY payload),
b AS (SELECT DISTINCT h, CAST(CAST(from_hex(h) AS BIT) AS VARCHAR) AS bits FROM p),
e AS (
  SELECT h, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS digest FROM b
)
SELECT page_id, octet_length(payload) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN g USING (payload) JOIN e USING (h)
"""


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.scored(docs, field).select(
        "doc_id", line_crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= line_crf.THRESHOLD).cast("int").alias("predicted")
    )


QUERIES["op9_quality_classifier"] = op9_quality_classifier


#: The rules of the query, as (host, path, allow).
URL_RULES = [
    url_graph.Rule(*r)
    for r in (("com", "/en/", False), ("example.com", "/en/7", True), ("net", "/de/", True), ("example.net", "/de/8", False), ("org", "/es/", False))
]


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_sections(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES).drop("trust", "distrust")


QUERIES["op2_benchmark_decontamination"] = op2_benchmark_decontamination
QUERIES["op3_token_counts"] = op3_token_counts
QUERIES["op5_url_filter"] = op5_url_filter


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES["op13_license_scan"] = op13_license_scan
ORACLES["op13_license_scan"] = """
WITH t(template, label, base, text) AS (VALUES %s),
tw AS (SELECT template, label, base, regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM t),
tk AS (SELECT *, CASE WHEN len(words) >= 4 THEN 4 ELSE 2 END AS k FROM tw),
tg AS (SELECT template, k, p AS tpos, array_to_string(list_slice(words, p + 1, p + k), ' ') AS gram FROM (SELECT *, unnest(range(len(words) - k + 1)) AS p FROM tk)),
d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
),
place AS (SELECT row, unnest(range(len(words))) AS pos, unnest(words) AS w FROM d),
seq AS (SELECT row, pos, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM place WINDOW o AS (PARTITION BY row ORDER BY pos)),
g AS (
  SELECT row, pos, 2 AS k, w || ' ' || w2 AS gram FROM seq WHERE w2 IS NOT NULL UNION ALL
  SELECT row, pos, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM seq WHERE w4 IS NOT NULL
),
hits AS (SELECT row, template, k, tpos, pos, pos - tpos AS diagonal FROM g JOIN tg USING (k, gram)),
step AS (SELECT *, tpos - lag(tpos) OVER (PARTITION BY row, template, diagonal ORDER BY tpos) AS step FROM hits),
votes AS (SELECT row, template, k, diagonal, min(pos) AS first, max(pos) AS last, sum(least(k, coalesce(step, k))) AS covered FROM step GROUP BY ALL),
gaps AS (
  SELECT v.*, len(words) AS words, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) > least(4, len(words) // 3) THEN 1 ELSE 0 END AS far
  FROM votes v JOIN tk USING (template)
),
runs AS (SELECT *, sum(far) OVER (PARTITION BY row, template ORDER BY diagonal) AS run FROM gaps),
merged AS (
  SELECT row, template, k, words, run, min(first) AS first, max(last) + k AS last, max(covered) AS one, count(*) FILTER (covered = words) AS exact,
    min(diagonal) FILTER (covered = words) AS low, max(diagonal) FILTER (covered = words) AS high
  FROM runs GROUP BY row, template, k, words, run
),
places AS (SELECT DISTINCT row, template, run, tpos FROM hits JOIN runs USING (row, template, diagonal)),
steps AS (SELECT *, tpos - lag(tpos) OVER (PARTITION BY row, template, run ORDER BY tpos) AS step FROM places),
whole AS (SELECT row, template, run, sum(least(k, coalesce(step, k))) AS covered FROM steps JOIN tk USING (template) GROUP BY row, template, run),
spans AS (
  SELECT m.*, greatest(one, CASE WHEN last - first <= 2 * words THEN covered ELSE one END) AS most FROM merged m JOIN whole USING (row, template, run)
),
good AS (SELECT * FROM spans JOIN t USING (template) WHERE CASE WHEN base THEN exact > 0 ELSE (words - most) * 10 <= words END),
found AS (
  SELECT row, sum(exact) FILTER (base) AS n_base, min(low) FILTER (base) AS first_word, max(high) FILTER (base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
    max(CASE WHEN base THEN 1.0::DOUBLE ELSE most::DOUBLE / words END) AS score
  FROM good GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN found USING (row)
""" % ", ".join(f"({i}, '{t.label}', {t.base}, '{t.text}')" for i, t in enumerate([*license_scan.BASE, *license_scan.NOTICES]))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = maxscore.build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return maxscore.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES["op11_lexical_search"] = op11_lexical_search
ORACLES["op11_lexical_search"] = """
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // l AS m FROM n, s),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, docs),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
),
q AS (SELECT item_id, term, count(*) AS r FROM i GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES["op12_collocations"] = op12_collocations
ORACLES["op12_collocations"] = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
sizes AS (SELECT lang, w, k FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
g AS (SELECT lang, k, w, unnest(range(len(w) - k + 1)) AS pos FROM sizes),
f AS (SELECT lang, k AS words, array_to_string(list_slice(w, pos + 1, pos + k), ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 30),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, words), ' ') AS tail
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c)
),
s AS (
  SELECT cuts.*, h.f AS l, t.f AS r, ((2000000::HUGEINT * a) // (h.f + t.f))::BIGINT AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail
),
least AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, a, w, words, unnest(range(2, words)) AS m FROM c),
places AS (SELECT *, unnest(range(words - m + 1)) AS pos FROM parts),
covering AS (SELECT lang, array_to_string(list_slice(w, pos + 1, pos + m), ' ') AS phrase, max(a) AS most FROM places GROUP BY ALL),
kept AS (SELECT least.* FROM least LEFT JOIN covering USING (lang, phrase) WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
