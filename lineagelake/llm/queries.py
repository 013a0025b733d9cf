"""The registered queries of this package: thin wrappers that apply each operator to its
whole table, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineagelake.functions.storage import ship

from . import chat, html_extract, url_rules
from .decontaminate import contaminated
from .divergence import source_divergence
from .embedding_dedup import near_vectors
from .exact_dedup import exact_duplicates
from .near_dedup import near_duplicates
from .packing import pack
from .pii import digest
from .sharding import shard
from .toxicity import score_toxicity
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the public tokenizer of the packing query lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``.  Null and empty html: empty text; repeated rows repeat."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all ``documents``, two-word shingles, Jaccard 0.8.  Null and blank
    texts link with nothing; rows that repeat a doc_id are one document."""
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every row of ``documents``.  Null and empty texts get the intercept's score; labels
    of the held-out fold are never learnt from."""
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of all ``documents`` lies.  Null and empty texts are the end id alone;
    repeated rows are packed as often as they occur."""
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every row of ``documents``.  Null and empty texts have none; repeated rows
    each have theirs."""
    return digest(_table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every row of ``pages``.  Null urls have empty parts and are allowed; repeated rows
    are judged alike."""
    return url_rules.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, with conversation -1 of control strings.  Null
    texts and roles are empty; turns of equal number are ordered by role and text."""
    own = spark.sql("VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_turn_table(table.unionByName(own)))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every row of ``documents``.  Null texts have 8 bytes; repeated rows and rows without
    doc_id are rows like others."""
    return shard(_table(spark, sf_dir, "documents"), shards=24)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every row of ``documents`` that holds benchmark text.  Null and empty texts have
    none; repeated rows each have one."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all ``embeddings`` of one label at cosine 0.98.  Null, zero and
    non-finite vectors and null labels link with nothing."""
    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of all ``documents`` against the others of their language.  Null texts, langs and
    sources are empty; repeated rows count each."""
    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all ``documents``.  Null texts are empty and so equal; repeated
    rows are members each."""
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all ``embeddings``.  Null vectors and those with null or non-finite
    entries have none; repeated rows each have theirs."""
    out = whiten(_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", out["deviation"].cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_toxicity": op4_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_pii": op6_pii,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_sharding": op8_sharding,
    "op9_decontaminate": op9_decontaminate,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}
_OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY turn, role, txt)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(txt) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN txt ELSE '' END, '' ORDER BY turn, role, txt)) AS loss_sha256,
  CAST(sum(8 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A') || txt,
    '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
_OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s FROM w
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), each AS (SELECT doc_id, unnest(s) AS g FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, c AS component_id, c = doc_id AS kept FROM sizes JOIN c ON a = doc_id
"""
# The labels of these tables say nothing about URLs, so no rule is mined from them, and only
# the fixed rules block.
_OP3_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path FROM p
), r(rhost, rpath, says) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(says, length(rhost || rpath)) AS says
  FROM (SELECT DISTINCT page_id, host, path FROM h) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1, 2, 3
)
SELECT h.page_id, h.host, h.path, rule, coalesce(says, 'allow') AS verdict FROM h LEFT JOIN fit USING (page_id, host, path)
"""
_OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) >= 0.98 * sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1), c AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, c.c = v.vec_id AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""
_OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS n FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v) AS q
  FROM s JOIN k ON k.lang = s.lang JOIN l ON l.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), x AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""
_OP12_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": _OP2_SQL, "op3_url_filters": _OP3_SQL, "op7_chat_formatting": _OP7_SQL, "op10_embedding_dedup": _OP10_SQL,
    "op11_source_divergence": _OP11_SQL, "op12_exact_dedup": _OP12_SQL,
}
