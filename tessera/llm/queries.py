"""The ten operators and the pipeline, bound to the driver's tables.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import align, decontam, exact, html, lm, near, packing, piecewise, quality, suffix, tokens, trie, warc
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, one row per document and item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that also start earlier."""
    return suffix.without_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extracted(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts."""
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its WARC record reads."""
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document to the texts labelled good."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lm.scored(table(spark, sf_dir, "documents"), good, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near duplicates on two-word shingles."""
    return near.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of byte-level and sentencepiece tokens."""
    paths = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.align(table(spark, sf_dir, "documents"), *paths, with_groups=False)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations, with what sharing it saves."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("turn_conv_id", "turn_pos")


def op13_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness."""
    return piecewise.near_copies(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_decontamination, op2_quality_classifier, op3_suffix_dedup, op4_html_extraction, op5_exact_dedup, op6_token_counts,
        op7_warc, op8_lm_scoring, op9_near_dedup, op10_packing, op11_tokenizer_alignment, op12_prefix_trie,
        op13_piecewise_fingerprints,
    )
    return {f.__name__: f for f in found}


_OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents
), g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.n) AS text_sha256
FROM t JOIN g USING (n)
"""


_OP7_SQL = """
WITH t AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), g AS (SELECT h, max(page_id) AS latest FROM t WHERE payload_bytes >= 1000 GROUP BY h)
SELECT t.page_id, t.payload_bytes, sha1(t.h) AS payload_digest,
  CASE WHEN g.latest > t.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.latest > t.page_id THEN g.latest END AS refers_to
FROM t LEFT JOIN g USING (h)
"""


# Every window of an item's size in which any of its shingles stands, without fingerprints.
_OP1_SQL = r"""
WITH i AS (
  SELECT item_id, row_number() OVER () AS item, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark
), it AS (
  SELECT item_id, item, ws, least(len(ws), 5) AS k, len(ws) - least(len(ws), 5) + 1 AS m FROM i WHERE len(ws) > 0
), ish AS (
  SELECT item, k, m, shingle, count(*) AS n FROM (
    SELECT item, k, m, unnest(list_transform(range(1, m + 1), lambda x: array_to_string(ws[x : x + k - 1], ' '))) AS shingle FROM it) GROUP BY ALL
), d AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)
), dsh AS (
  SELECT doc, k, len(ws) - k + 1 AS n, unnest(range(0, len(ws) - k + 1)) AS pos, unnest(list_transform(range(1, len(ws) - k + 2), lambda x: array_to_string(ws[x : x + k - 1], ' '))) AS shingle
  FROM d, (SELECT DISTINCT k FROM it) WHERE len(ws) >= k
), hits AS (
  SELECT doc, dsh.n AS n_doc, item, m, pos, shingle, ish.n AS n_item FROM dsh JOIN ish USING (k, shingle)
), starts AS (
  SELECT DISTINCT doc, n_doc, item, m, unnest(range(greatest(pos - m + 1, 0), pos + 1)) AS start FROM hits
), common AS (
  SELECT doc, item, start, m, n_doc, shingle, least(count(*), any_value(n_item)) AS shared
  FROM starts JOIN hits USING (doc, item, m, n_doc) WHERE pos BETWEEN start AND start + m - 1 GROUP BY ALL
), found AS (
  SELECT doc, item, start, sum(shared) / (m + least(m, n_doc - start) - sum(shared)) AS similarity FROM common GROUP BY doc, item, start, m, n_doc
)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_max(start, (similarity, -start)) AS INTEGER) AS first_word, count(DISTINCT start) AS n_windows
FROM found JOIN d USING (doc) JOIN it USING (item) WHERE similarity * 100 >= 80 - 1e-9 GROUP BY doc_id, item_id
"""


# The example pages have their main text in one article element, without boilerplate in it.
_OP4_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages
), b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '<(/?p|br|/?h1)>', ' ', 'g'), '<[^>]+>', '', 'g') AS x FROM a
), t AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""


# All pairs that share a shingle and whose sizes allow the similarity; then all pairs within a component.
_OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT ways.b, r.low FROM r JOIN ways ON ways.a = r.node
), c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON node = doc_id
"""


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text of at most 20 ASCII signs, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, ascii(x)::BIGINT), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda r, _: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {step.replace('ascii(x)::BIGINT', 'b')}), 4294967295)"


# Rebuilt conversations as lists of turns, each prefix a list.
_OP12_SQL = f"""
WITH c AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS own, CAST({_crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS BIGINT) AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[1 : c.h], c.own[c.h + 1 :]) AS turns FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5
), p AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r
), m AS (SELECT conv_id, depth, n = depth AS ends, turns[1 : depth] AS prefix, CASE WHEN depth > 0 THEN turns[1 : depth - 1] END AS above FROM p
), g AS (
  SELECT depth, prefix, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN depth > 0 THEN strlen(prefix[depth].t) ELSE 0 END AS n_bytes FROM m GROUP BY depth, prefix
), k AS (SELECT above AS prefix, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY above
), f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (prefix)
), up AS (SELECT f.prefix[1 : d] AS prefix, CAST(n_children = 0 AS INTEGER) AS leaf, (n_convs - 1) * n_bytes AS saved FROM f, unnest(range(0, depth + 1)) t(d)
), s AS (SELECT prefix, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY prefix)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (prefix) LEFT JOIN f q ON q.prefix = f.above
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query in fair time; the others are tested against brute force."""
    return {"op1_decontamination": _OP1_SQL, "op4_html_extraction": _OP4_SQL, "op5_exact_dedup": _OP5_SQL, "op7_warc": _OP7_SQL, "op9_near_dedup": _OP9_SQL, "op12_prefix_trie": _OP12_SQL}
