"""One query for each operator over its whole table, with production parameters; SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm import chat_format, decontamination, hard_negatives, html_extraction, mixing, near_dedup, packing, quality_classifier, quality_rules, sharding, spelling_variants, substring_dedup, token_counts

#: A public vocabulary file with byte fallback.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in 24 shards: 3 regions of 4 racks of 2 shards."""
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), sharding.HashTree.uniform(3, 4, 2))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it contains."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document; the longest repeat, by which some are rejected, stays with the operator."""
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).drop("longest_repeat")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, with its place in training in the first pass over its source, and in the second one."""
    docs = _table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", "text"), mixing.words_in(F.col("text")))
    columns = ("size", "source_size", "target", "taken", "again", *(F.round(c, 9).alias(c) for c in ("position", "position_again")))
    return mixed.select("row.doc_id", *columns).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: The tool that conversations are calls of: name, field, kind, required.
REPLY = [("reply", "after", "STRING", False), ("reply", "text", "STRING", True), ("reply", "turn", "BIGINT", True)]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every message of conversations but the results that are linked, which are in the row of their call."""
    calls, results, others = chat_format.from_conversations(_table(spark, sf_dir, "conversations"))
    linked = chat_format.linked_calls(calls, results, spark.createDataFrame(REPLY, "name string, field string, kind string, required boolean"))
    return linked.unionByName(chat_format.plain_messages(others)).withColumnRenamed("conv", "conv_id").withColumn("errors", F.array_join("errors", "; "))


def op10_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.Vocabulary.from_sentencepiece(vocabulary))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of the rows whose vec_id is divisible by 100; where it is divisible by 7, the label is the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = lambda x: F.abs(x) < F.lit(float("inf"))
    whole = F.transform("embedding", lambda x: F.when(finite(x.cast("double")), F.floor(F.lit(256.0) * x.cast("double"))))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), whole.alias("embedding"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_packing(spark: SparkSession, sf_dir: str, file: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 tokens; the vocabulary is that of a public tokenizer's files."""
    import public_tokenizers

    vocabulary = packing.BytePairs.load(file or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(spelling_variants.word_counts(_table(spark, sf_dir, "documents")))


_OP7 = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sources),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         CASE k % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope
  FROM named),
summed AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(source_size) OVER () AS total
  FROM weighed),
shared AS (SELECT *, (1.5::DOUBLE * total - filled) / rest AS share FROM summed),
chosen AS (SELECT min_by(share, cap / weight) AS share FROM shared WHERE share * weight < cap),
targets AS (
  SELECT source, source_size, slope, least(cap, coalesce((SELECT share FROM chosen) * weight, cap)) AS target FROM weighed),
laid AS (
  SELECT doc_id, size, source_size, slope, target, CAST(round(target) AS BIGINT) AS want,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, CAST(greatest(0, least(size, want - start)) AS BIGINT) AS once, CAST(greatest(0, least(size, want - start - source_size)) AS BIGINT) AS again
  FROM laid),
uses AS (
  SELECT *, start / target AS x1, (start + source_size) / target AS x2 FROM cut)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, once + again AS taken, again,
       CASE WHEN once > 0 THEN abs(round(CASE WHEN slope = 0 THEN x1
            ELSE (sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * x1) - (1.0::DOUBLE - slope)) / (2.0::DOUBLE * slope) END, 9)) END AS position,
       CASE WHEN again > 0 THEN round(CASE WHEN slope = 0 THEN x2
            ELSE (sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * x2) - (1.0::DOUBLE - slope)) / (2.0::DOUBLE * slope) END, 9) END AS position_again
FROM uses
"""

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_near_dedup": op2_near_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mixing": op7_mixing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_chat_format": op9_chat_format,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_packing": op12_packing,
    "op13_spelling_variants": op13_spelling_variants,
}

#: The SQL has the rule by which conversations become calls; links, steps, errors and repeats are found from the calls.
_OP9 = """
WITH RECURSIVE spoken AS (
  SELECT conv_id, turn, role, text, coalesce(CAST(conv_id AS VARCHAR), '') || ':' AS c,
         coalesce((conv_id + turn) % 12, 0) AS k, coalesce((conv_id + turn) % 9, 3) AS r FROM conversations),
said AS (
  SELECT conv_id, turn, c || turn AS call_id, CASE k WHEN 6 THEN 'lookup' ELSE 'reply' END AS name, k,
         CASE WHEN k IN (4, 5, 9, 11) THEN '${' || c || (turn + 2) || '}' WHEN turn >= 2 AND k <> 1 THEN '${' || c || (turn - 2) || '}' END AS after,
         CASE WHEN k <> 2 THEN text END AS text
  FROM spoken WHERE role = 'user' AND turn IS NOT NULL),
calls AS (
  SELECT conv_id, turn, call_id, name,
         CASE k WHEN 7 THEN '{"text": ' ELSE '{' || array_to_string(list_filter([
           '"after":' || CAST(to_json(after) AS VARCHAR), CASE k WHEN 3 THEN '"note":"more"' END, '"text":' || CAST(to_json(text) AS VARCHAR),
           '"turn":' || CASE k WHEN 1 THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END], lambda x: x IS NOT NULL), ',') || '}' END AS arguments
  FROM said JOIN (VALUES (0), (1)) AS copies(copy) ON copy = 0 OR k = 8),
results AS (
  SELECT conv_id, turn - CASE r WHEN 2 THEN 2 ELSE 0 END AS turn, c || (turn - 1) || CASE r WHEN 0 THEN '?' ELSE '' END AS call_id, text AS content
  FROM spoken JOIN (VALUES (0), (1)) AS copies(copy) ON copy = 0 OR r = 1 WHERE role = 'assistant' AND turn IS NOT NULL),
ranked_calls AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, name, arguments) AS nth, count(*) OVER (PARTITION BY conv_id, call_id) AS times FROM calls),
ranked_results AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, content NULLS FIRST) AS nth, count(*) OVER (PARTITION BY conv_id, call_id) AS times FROM results),
one AS (SELECT * FROM ranked_calls WHERE nth = 1),
edges AS (
  SELECT DISTINCT a.conv_id, a.call_id AS a, b.call_id AS b
  FROM (SELECT conv_id, call_id, unnest(regexp_extract_all(arguments, '[$][{]([^}]+)[}]', 1)) AS target FROM one) a
  JOIN one b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.target = b.call_id AND a.call_id <> b.call_id),
reach AS (
  SELECT conv_id, a, b FROM edges
  UNION SELECT r.conv_id, r.a, e.b FROM reach r JOIN edges e ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.b = e.a),
circles AS (SELECT conv_id, a FROM reach WHERE a = b),
circular AS (
  SELECT conv_id, a FROM circles UNION SELECT r.conv_id, r.a FROM reach r JOIN circles s ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.b = s.a),
paths AS (
  SELECT conv_id, call_id AS a, call_id AS b, 0 AS k FROM one WHERE NOT EXISTS (SELECT 1 FROM circular c WHERE c.conv_id IS NOT DISTINCT FROM one.conv_id AND c.a = one.call_id)
  UNION SELECT p.conv_id, p.a, e.b, p.k + 1 FROM paths p JOIN edges e ON p.conv_id IS NOT DISTINCT FROM e.conv_id AND p.b = e.a),
places AS (
  SELECT p.conv_id, p.a, turn AS after_turn, k AS step, row_number() OVER (PARTITION BY p.conv_id, p.a ORDER BY turn DESC, k DESC) AS nth
  FROM paths p JOIN one ON p.conv_id IS NOT DISTINCT FROM one.conv_id AND p.b = one.call_id),
schema AS (SELECT * FROM (VALUES ('reply', 'after', 'STRING', false), ('reply', 'text', 'STRING', true), ('reply', 'turn', 'BIGINT', true)) AS s(name, field, kind, required)),
objects AS (SELECT *, json_valid(arguments) AND CASE WHEN json_valid(arguments) THEN json_type(arguments) = 'OBJECT' ELSE false END AS is_object FROM one),
known AS (SELECT * FROM objects WHERE is_object AND name IN (SELECT name FROM schema)),
given AS (
  SELECT conv_id, call_id, name, field, CASE WHEN json_type(arguments, '$.' || field) = 'VARCHAR' THEN 'STRING' WHEN json_type(arguments, '$.' || field) IN ('BIGINT', 'UBIGINT') THEN 'BIGINT' ELSE json_type(arguments, '$.' || field) END AS is_kind
  FROM (SELECT *, unnest(json_keys(arguments)) AS field FROM known)),
broken AS (
  SELECT conv_id, call_id, 'arguments: not an object' AS error FROM objects WHERE NOT is_object
  UNION ALL SELECT conv_id, call_id, 'name: no such tool' FROM objects WHERE is_object AND name NOT IN (SELECT name FROM schema)
  UNION ALL SELECT conv_id, call_id, g.field || CASE WHEN kind IS NULL THEN ': not in the schema' ELSE ': ' || is_kind || ' for ' || kind END FROM given g LEFT JOIN schema s USING (name, field) WHERE kind IS NULL OR kind <> is_kind
  UNION ALL SELECT conv_id, call_id, s.field || ': missing' FROM known k JOIN schema s USING (name) WHERE required AND NOT list_contains(json_keys(arguments), s.field)),
errors AS (SELECT conv_id, call_id, list(error ORDER BY error) AS errors FROM broken GROUP BY ALL),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, after_turn, step, coalesce(c.turn, r.turn) AS turn, c.name,
         CASE WHEN c.nth IS NULL THEN 'no_call' WHEN step IS NULL THEN 'circular' WHEN r.nth IS NULL THEN 'no_result' WHEN r.turn <= c.turn THEN 'early' ELSE 'linked' END AS status,
         array_to_string(list_filter(list_concat(coalesce(errors, []), [CASE WHEN c.times > 1 THEN 'call_id: repeated call' END, CASE WHEN r.times > 1 THEN 'call_id: repeated result' END]), lambda x: x IS NOT NULL), '; ') AS errors,
         c.arguments, r.content
  FROM one c FULL JOIN (SELECT * FROM ranked_results WHERE nth = 1) r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.call_id = r.call_id
  LEFT JOIN places p ON p.nth = 1 AND p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.a = c.call_id
  LEFT JOIN errors e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.call_id = c.call_id),
every AS (
  SELECT * FROM linked
  UNION ALL SELECT conv_id, call_id, NULL, NULL, turn, name, 'repeated_call', '', arguments, NULL FROM ranked_calls WHERE nth > 1
  UNION ALL SELECT conv_id, call_id, NULL, NULL, turn, NULL, 'repeated_result', '', NULL, content FROM ranked_results WHERE nth > 1)
SELECT conv_id, call_id, after_turn, step, turn, name, status, errors,
       '{' || array_to_string(list_filter(['"arguments":' || CASE WHEN json_valid(arguments) THEN arguments ELSE CAST(to_json(arguments) AS VARCHAR) END, '"call_id":' || CAST(to_json(call_id) AS VARCHAR),
         '"name":' || CAST(to_json(name) AS VARCHAR), '"result":' || CAST(to_json(content) AS VARCHAR)], lambda x: x IS NOT NULL), ',') || '}' AS json
FROM every
UNION ALL
SELECT conv_id, NULL, NULL, NULL, turn, role, 'message', '',
       '{' || array_to_string(list_filter(['"content":' || CAST(to_json(text) AS VARCHAR), '"role":' || CAST(to_json(role) AS VARCHAR)], lambda x: x IS NOT NULL), ',') || '}'
FROM spoken WHERE role IS NULL OR turn IS NULL OR role NOT IN ('user', 'assistant')
"""

_WORDS = "SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shingles as text, all pairs that share one, and what links reach.
_OP2 = f"""
WITH RECURSIVE said AS ({_WORDS.format(text=_LOWER)}),
shingles AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM said WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.r = s.a JOIN sizes y ON y.r = s.b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM said UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN said ON reach.b = said.r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, doc_id IS NULL AND component_id IS NULL) AS kept
FROM said JOIN least USING (r) LEFT JOIN sizes USING (r)
"""

#: Words in repeats of n words or more are those that repeated windows of n words cover.
_OP5 = f"""
WITH said AS ({_WORDS.format(text="coalesce(text, '')")}),
windows AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM said, (VALUES (5), (8), (16), (61)) AS sizes(n))),
again AS (SELECT r, n, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, n, g) > 1),
inside AS (SELECT r, n, count(DISTINCT p) AS words FROM (SELECT r, n, unnest(range(i, i + n)) AS p FROM again) GROUP BY r, n),
counted AS (
  SELECT r, coalesce(max(words) FILTER (n = 5), 0) AS n5, coalesce(max(words) FILTER (n = 8), 0) AS n8, coalesce(max(words) FILTER (n = 16), 0) AS n16, coalesce(max(words) FILTER (n = 61), 0) AS n61
  FROM said LEFT JOIN inside USING (r) GROUP BY r),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines,
         n5 AS n_repeat_words, len(w) < 10 OR 100 * n5 > 20 * len(w) AS base_failed, n8 AS covered_words, n16 AS copied_words, n61
  FROM said JOIN counted USING (r))
SELECT * EXCLUDE (lines, n61), CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       NOT base_failed AND covered_words <= 0.2::DOUBLE * n_words AND copied_words <= 0.1::DOUBLE * n_words AND n61 = 0 AS kept
FROM base
"""

_OP6 = f"""
WITH said AS ({_WORDS.format(text="coalesce(text, '')")}),
windows AS (SELECT r, doc_id, i, array_to_string(w[i : i + 49], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM said)),
earliest AS (SELECT g, min(doc_id) AS d FROM windows GROUP BY g),
held AS (SELECT r, i FROM windows JOIN earliest USING (g) WHERE d < doc_id OR (doc_id IS NULL AND d IS NOT NULL)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM held),
left_ AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM said) x ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM said LEFT JOIN left_ USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r)
"""

#: Every anchor with every row.
_OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256.0::DOUBLE * CAST(x AS DOUBLE))) AS code
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_dot_product(a.code, b.code) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
positives AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) AS k FROM scored WHERE alike QUALIFY k <= 5),
negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.k ORDER BY n.score DESC, n.id NULLS LAST) AS rank
  FROM positives p JOIN scored n ON p.a = n.a AND NOT n.alike AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""

ORACLE_SQL = {"op11_hard_negatives": _OP11, "op2_near_dedup": _OP2, "op5_quality_rules": _OP5, "op6_substring_dedup": _OP6, "op7_mixing": _OP7, "op9_chat_format": _OP9}
