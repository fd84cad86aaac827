"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isobath.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isobath.llm.pii import digest_columns, find_personal

    return digest_columns(find_personal(table(spark, sf_dir, "documents")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isobath.llm.secret_scan import digest_columns, find_secrets

    return digest_columns(find_secrets(table(spark, sf_dir, "documents")))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isobath.llm.warc import archived

    found = archived(table(spark, sf_dir, "pages"))
    page = lambda urn: F.regexp_extract(urn, "urn:record:(-?[0-9]*):", 1).try_cast("long")
    # a record that can't be used fails the query: nothing may be lost on the way
    whole = F.when(F.col("problem").isNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("broken record: "), F.col("problem"))))
    return found.select(page(F.col("record_id")).alias("page_id"), whole.cast("long").alias("payload_bytes"), "payload_digest", "record_type", page(F.col("fields")["warc-refers-to"]).alias("refers_to"))


OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM p
"""


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isobath.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isobath.llm.language_id import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    fold = held_out("doc_id")
    found = identify(docs, learn(docs.where(~fold)))
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from isobath.llm.token_counts import count_tokens

    found = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isobath.llm.decontaminate import find_contained

    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words and shingles as in ``shingles``; items shorter than five words are one shingle.
OP5_SQL = """
WITH letters AS (
  SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper_case, 'abcdefghijklmnopqrstuvwxyz' AS lower_case
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), upper_case, lower_case), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents, letters
), item AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), upper_case, lower_case), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark, letters
), item_shingle AS (
  SELECT DISTINCT i, item_id, least(5, len(w)) AS k, array_to_string(list_slice(w, p, p + least(5, len(w)) - 1), ' ') AS s
  FROM item, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS t(p) WHERE len(w) > 0
), size AS (SELECT i, count(*) AS n_item FROM item_shingle GROUP BY i
), doc_shingle AS (
  SELECT DISTINCT r, doc_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s
  FROM doc, (SELECT DISTINCT k FROM item_shingle) AS ks, unnest(range(1, len(w) - k + 2)) AS t(p)
), shared AS (
  SELECT r, doc_id, i, item_id, count(*) AS n_shared FROM doc_shingle JOIN item_shingle USING (k, s) GROUP BY ALL
)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_item AS BIGINT) AS n_item, n_shared / n_item AS containment
FROM shared JOIN size USING (i) WHERE n_shared >= 0.8 * n_item
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isobath.llm.exact_dedup import equal_texts

    return equal_texts(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM n WINDOW same AS (PARTITION BY t)
"""


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from isobath.llm.packing import pack_texts

    return pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isobath.llm.infill import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256))
    return restored(made).withColumn("restored_sha256", F.sha2("text", 256)).drop("text")


OP11_SQL = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), h AS (
  SELECT *, CAST('0x' || d[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || d[9:16] AS BIGINT) % (n + 1) AS y,
    CASE WHEN n = 0 OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR CAST('0x' || d[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || d[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM h
), p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isobath.llm.main_text import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


#: Holds for pages that mark their article by ``article``, with headings, paragraphs, bold and breaks and the character references below.
OP12_SQL = r"""
WITH a AS (
  SELECT row_number() OVER () AS r, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages
), b AS (
  SELECT r, i, string_split_regex(h, '</?(?:h1|p)>')[i] AS x FROM a, unnest(range(1, len(string_split_regex(h, '</?(?:h1|p)>')) + 1)) AS t(i)
), d AS (
  SELECT r, i, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), chr(160), ' '), '\s+', ' ', 'g')) AS x FROM b
)
SELECT page_id, url, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (x <> ''), '') AS text, CAST(length(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (x <> ''), '')) AS BIGINT) AS n_chars
FROM a LEFT JOIN d USING (r) GROUP BY r, page_id, url
"""


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from isobath.llm.dialogue import damage, repair

    return repair(damage(table(spark, sf_dir, "conversations")))


#: Checksums bit by bit; then the least (cost, edits) from each row and state, from the last row to the first.
OP13_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), m AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform(range(0, 8), lambda b: (ascii(k[i]) >> b) & 1)))),
    lambda r, b: xor(r >> 1, 3988292384 * (xor(r, b) & 1)))) % 20 AS m FROM c
), d AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM m, unnest(CASE m WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS t(copy)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM d
), f AS (
  SELECT *, CASE WHEN final = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o
), s AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), v AS (
  SELECT conv_id, n AS i, {'c': 0, 'e': '', 't': ''} AS v0, {'c': 10, 'e': 'II', 't': e'\nuser:\nassistant:'} AS vs, {'c': 5, 'e': 'I', 't': e'\nassistant:'} AS vu, {'c': 0, 'e': '', 't': ''} AS va FROM s
  UNION ALL
  SELECT conv_id, i - 1,
    list_min([w0, {'c': 5 + wu.c, 'e': 'I' || wu.e, 't': e'\nuser:' || wu.t}, {'c': 10 + wa.c, 'e': 'II' || wa.e, 't': e'\nuser:\nassistant:' || wa.t}]),
    list_min([ws, {'c': 5 + wu.c, 'e': 'I' || wu.e, 't': e'\nuser:' || wu.t}, {'c': 10 + wa.c, 'e': 'II' || wa.e, 't': e'\nuser:\nassistant:' || wa.t}]),
    list_min([wu, {'c': 5 + wa.c, 'e': 'I' || wa.e, 't': e'\nassistant:' || wa.t}]),
    list_min([wa, {'c': 5 + wu.c, 'e': 'I' || wu.e, 't': e'\nuser:' || wu.t}])
  FROM (
    SELECT v.conv_id, v.i, {'c': 2 + v0.c, 'e': 'D' || v0.e, 't': v0.t} AS d0, {'c': 2 + vs.c, 'e': 'D' || vs.e, 't': vs.t} AS ds, {'c': 2 + vu.c, 'e': 'D' || vu.e, 't': vu.t} AS du, {'c': 2 + va.c, 'e': 'D' || va.e, 't': va.t} AS da,
      {'c': more + 1 + vu.c, 'e': 'R' || vu.e, 't': e'\nuser:' || text || vu.t} AS ru, {'c': more + 1 + va.c, 'e': 'R' || va.e, 't': e'\nassistant:' || text || va.t} AS ra,
      {'c': more + CASE WHEN x = 's' THEN 0 ELSE 99 END + vs.c, 'e': 'K' || vs.e, 't': e'\n' || role || ':' || text || vs.t} AS ks, {'c': more + CASE WHEN x = 'u' THEN 0 ELSE 99 END + vu.c, 'e': 'K' || vu.e, 't': e'\n' || role || ':' || text || vu.t} AS ku,
      {'c': more + CASE WHEN x = 'a' THEN 0 ELSE 99 END + va.c, 'e': 'K' || va.e, 't': e'\n' || role || ':' || text || va.t} AS ka,
      list_min([d0, ru, ks, ku]) AS w0, list_min([ds, ru, ku]) AS ws, list_min([du, ra, ka]) AS wu, list_min([da, ru, ku]) AS wa
    FROM v JOIN (SELECT *, CASE fault WHEN '' THEN 0 WHEN 't' THEN 5 ELSE 99 END AS more, left(role, 1) AS x FROM f) AS r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i
  ) AS step
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(v0.c, 0) AS BIGINT) AS cost, coalesce(v0.e, '') AS audit, sha256(coalesce(v0.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.i = 0
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_warc, op2_repeats, op3_language_id, op4_token_counts, op5_decontaminate, op6_exact_dedup, op7_best_fit, op8_simhash, op9_personal_data, op10_secret_scan, op11_fill_in_middle, op12_main_text, op13_dialogue_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op5_decontaminate": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op11_fill_in_middle": OP11_SQL, "op12_main_text": OP12_SQL, "op13_dialogue_repair": OP13_SQL}
