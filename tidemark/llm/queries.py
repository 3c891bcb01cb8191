"""The thin queries of the numbered operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ann import nearest
from tidemark.llm.codes import compress_vectors
from tidemark.llm.common import crc_mod
from tidemark.llm.decontam import contaminated
from tidemark.llm.divergence import source_divergence
from tidemark.llm.langid import fit_languages, identify
from tidemark.llm.lm import count_words, fit_lm, score_documents
from tidemark.llm.mixing import mix
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.sparse import find_repeats
from tidemark.llm.subtree import remove_repeats
from tidemark.llm.tokens import read_digests, write_tokens
from tidemark.llm.toxicity import learn_lexicon, score_toxicity
from tidemark.llm.urlfilter import judge_urls
from tidemark.ship import ship

#: host, path, verdict
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out")
    lexicon = learn_lexicon(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return score_toxicity(docs, lexicon).select("doc_id", held_out, "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "matched", "window")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = docs.where(crc_mod(F.col("doc_id"), 7) != 2)
    counts = count_words(learned)
    held_out = (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out")
    return score_documents(docs, fit_lm(learned, counts), counts).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, distance=4, seed=42).select("doc_id", "fingerprint", "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=20, digest=True)


def op8_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    held_out = (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out")
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score", "margin", "rejected")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_digests(write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_toxicity, op2_decontamination, op3_lm_scoring, op4_url_filters, op5_simhash,
        op6_mixing, op7_substring_dedup, op8_sparse_suffix_dedup, op9_nearest_neighbours, op10_language_id,
        op11_token_files, op12_vector_codes, op13_source_divergence,
    )
    return {f.__name__: f for f in found}


OP4_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
urls AS (SELECT DISTINCT host, path FROM parsed),
best AS (
  SELECT u.host, u.path, arg_max(r.host || r.path, (length(r.host), length(r.path))) AS rule,
         arg_max(r.verdict, (length(r.host), length(r.path))) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.host, u.path)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""

OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS key
  FROM documents),
one AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM one),
targets AS (
  SELECT source, source_size,
         least(cap, coalesce(arg_min(level, cap / weight) FILTER (cap >= level * weight) OVER () * weight, cap)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS full_epochs FROM placed)
SELECT doc_id, size, source_size, target,
       (full_epochs * size + greatest(0, least(size, floor(target)::BIGINT - full_epochs * source_size - start)))::BIGINT AS taken
FROM cut
"""


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
items AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS b FROM benchmark),
masks(k, o, span, least, most) AS (VALUES (0, [0, 2, 4, 7, 8], 9, 8, 9999999), (1, [0, 1, 2, 3, 7], 8, 8, 9999999), (2, [0, 1, 3, 4], 5, 8, 19),
  (3, [0, 1, 2, 3, 4], 5, 5, 5), (4, [0, 1, 2, 3, 4, 5], 6, 6, 6), (5, [0, 1, 2, 3, 4, 5, 6], 7, 7, 7)),
at_doc AS (SELECT *, unnest(range(0, len(w) - 4)) AS i FROM words),
doc_seeds AS (SELECT doc_id, text, w, i, k, list_transform(o, lambda x: w[i + x + 1]) AS s FROM at_doc, masks WHERE i + span <= len(w)),
at_item AS (SELECT *, unnest(range(0, len(b) - 4)) AS j FROM items),
item_seeds AS (SELECT item_id, b, j, k, span, list_transform(o, lambda x: b[j + x + 1]) AS s FROM at_item, masks WHERE j + span <= len(b) AND len(b) BETWEEN least AND most),
hits AS (
  SELECT DISTINCT d.doc_id, d.text, d.w, i.item_id, i.b, d.i - i.j AS off, i.j, i.span, least(20, len(i.b)) AS len_
  FROM doc_seeds d JOIN item_seeds i USING (k, s)),
starts AS (SELECT *, unnest(range(greatest(0, j + span - len_), least(j, len(b) - len_) + 1)) AS s FROM hits),
sums AS (
  SELECT doc_id, text, item_id, len_, list_sum(list_transform(range(s, s + len_), lambda t: CASE WHEN off + t >= 0 AND off + t < len(w) AND w[off + t + 1] = b[t + 1] THEN 1 ELSE 0 END)) AS m FROM starts)
SELECT doc_id, item_id, max(m)::INT AS matched, max(len_)::INT AS "window"
FROM sums WHERE m >= ceil(len_ * 0.8::DOUBLE) GROUP BY doc_id, text, item_id
"""


_WINDOWS_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {length} + 1)) AS s FROM words WHERE len(ws) >= {length}),
windows AS (SELECT doc_id, s, array_to_string(ws[s + 1:s + {length}], ' ') AS k FROM places),
later AS (SELECT * FROM (SELECT doc_id, s, row_number() OVER w AS nth FROM windows WINDOW w AS (PARTITION BY k ORDER BY doc_id, s)) WHERE nth > 1)"""

OP7_SQL = (
    _WINDOWS_SQL.format(length=20)
    + """,
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM later, (SELECT unnest(range(20)) AS o)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM words w LEFT JOIN kept k USING (doc_id)"""
)

OP8_SQL = (
    _WINDOWS_SQL.format(length=50)
    + """,
edges AS (SELECT doc_id, s, s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 AS gap FROM later),
runs AS (SELECT doc_id, s, sum(coalesce(gap, false)::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM edges)
SELECT doc_id, min(s)::BIGINT AS start, (max(s) - min(s) + 50)::BIGINT AS n_words FROM runs GROUP BY doc_id, run"""
)


def _codes_sql(rounds: int = 6) -> str:
    """The rounds of op12 written out, one pair of steps a round."""
    gap = "list_sum(list_transform(range(1, len(c) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    steps = [
        """rows AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS nth, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS (SELECT nth, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM rows, (SELECT unnest(range(8)) AS p))",
        "book0 AS (SELECT p, nth - 1 AS e, x AS c FROM parts WHERE nth <= 16)",
    ]
    for r in range(rounds + 1):
        steps.append(f"near{r} AS MATERIALIZED (SELECT nth, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT nth, p, x, e, {gap} AS d FROM parts JOIN book{r} USING (p)) GROUP BY nth, p)")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
  SELECT p, e, list((s - ((s % n + n) % n)) // n ORDER BY i) AS c FROM (SELECT p, e, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{r}) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))""")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS sha FROM book{rounds})")
    steps.append(f"coded AS (SELECT nth, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY nth)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM coded JOIN rows USING (nth), digest"


OP12_SQL = _codes_sql()


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
each AS (SELECT doc, lang, source, unnest(ts) AS term FROM docs),
kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM each SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
whole AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM counts GROUP BY lang, term),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v))::BIGINT AS p
  FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
own AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v))::BIGINT AS q FROM whole JOIN sizes USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
above AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares JOIN own USING (lang, term) WHERE n > 0 AND p > q),
parts AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM above)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM parts QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op4_url_filters": OP4_SQL, "op6_mixing": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op8_sparse_suffix_dedup": OP8_SQL, "op12_vector_codes": OP12_SQL, "op13_source_divergence": OP13_SQL}
