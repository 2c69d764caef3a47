"""The queries of this subpackage over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, infill, lexical, licenses, mixing, packing, pii, quality, rulefit, similarity, topk, toxicity, urls
from .common import table


#: A deployment passes its own secret to ``pii.surrogates``; the queries need a fixed one so that reruns agree.
PII_KEY = "wavelane-query-key"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op2_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_entities and kinds of every document."""
    return pii.surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed_rules")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the file source/lang/doc_id: its own notice's licence, or the one it inherits."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(files, keep=("doc_id", "path")).select("doc_id", "path", "own", "score", "declares", "license", "found_in")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.join(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulefit.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.transform(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_bitplane, op3_pii, op4_mixing, op5_topk, op6_quality, op7_licenses, op8_toxicity, op9_urls, op10_similarity, op11_rules, op12_lexical, op13_infill)}


def license_sql() -> str:
    """All windows of all runs of lines against all templates, without any pruning. No path of the query names a licence
    file, so that whole licence texts play no part."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES))
    sizes = ", ".join(map(str, licenses.SIZES))
    keys = ", ".join(map(quoted, licenses.KEYWORDS))
    return rf"""
WITH tpl(k, license, t) AS (VALUES {rows}
), tw AS (
  SELECT k, license, term, count(*) AS m FROM (SELECT k, license, unnest(regexp_extract_all(lower(t), '(?:[a-z0-9]|\.[0-9])+')) AS term FROM tpl) GROUP BY ALL
), idf AS (
  SELECT term, CASE WHEN term IN ({keys}) THEN 4.0::DOUBLE ELSE 1 + ln((1 + (SELECT count(*) FROM tpl))::DOUBLE / (1 + count(*))) END AS v FROM tw GROUP BY term
), vec AS (SELECT k, license, term, m * v * v / sqrt(sum((m * v) ** 2) OVER (PARTITION BY k)) AS w FROM tw JOIN idf USING (term)
), l0 AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
), l1 AS (SELECT doc_id, i, raw, regexp_replace(raw, '(?i)^\s*(?:dnl|rem)($|[^\p{{L}}\p{{N}}])', '\1') AS line FROM l0
), l2 AS (
  SELECT *, regexp_extract_all(lower(line), '(?:[a-z0-9]|\.[0-9])+') AS words, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS n_words,
    regexp_matches(line, '[\p{{L}}\p{{N}}]') AS held FROM l1
), l3 AS (SELECT *, sum((NOT held)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l2
), l AS (SELECT doc_id, i, words, min(i) OVER r AS first, max(i) OVER r + 1 AS stop FROM l3 WHERE held WINDOW r AS (PARTITION BY doc_id, run)
), win AS (
  SELECT doc_id, i AS pos, n FROM l, (SELECT unnest([{sizes}])::BIGINT AS n) WHERE i + n <= stop
  UNION SELECT doc_id, first, stop - first FROM l
), fit AS (
  SELECT win.doc_id, pos, n FROM win JOIN l ON l.doc_id = win.doc_id AND l.i >= pos AND l.i < pos + n GROUP BY ALL
  HAVING n = 1 OR coalesce(sum(len(words)) FILTER (i > pos), 0) <= (SELECT 2 * max(c) FROM (SELECT sum(m) AS c FROM tw GROUP BY k))
), c AS (
  SELECT doc_id, pos, n, term, count(*) AS m
  FROM (SELECT fit.doc_id, pos, n, unnest(words) AS term FROM fit JOIN l ON l.doc_id = fit.doc_id AND l.i >= pos AND l.i < pos + n) GROUP BY ALL
), size AS (SELECT doc_id, pos, n, sqrt(sum((m * coalesce(v, 1 + ln(1.0::DOUBLE + (SELECT count(*) FROM tpl)))) ** 2)) AS size FROM c LEFT JOIN idf USING (term) GROUP BY ALL
), dot AS (SELECT doc_id, pos, n, k, license, sum(m * w) AS dot FROM c JOIN vec USING (term) GROUP BY ALL
), hit AS (
  SELECT doc_id, pos, n, license, round(dot / size, 9) AS score FROM dot JOIN size USING (doc_id, pos, n) WHERE round(dot / size, 9) >= {licenses.THRESHOLD}
), best AS (SELECT doc_id, arg_min(license, (-score, license)) AS own, max(score) AS score FROM hit GROUP BY doc_id
), part AS (SELECT l2.doc_id, sum(n_words) FILTER (EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = l2.doc_id AND i >= pos AND i < pos + n)) AS covered, sum(n_words) AS n_words FROM l2 SEMI JOIN hit USING (doc_id) GROUP BY l2.doc_id
), f AS (
  SELECT d.doc_id, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), CAST(d.doc_id AS VARCHAR)) AS path, own, score,
    own IS NOT NULL AND 2 * covered >= part.n_words AS declares FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN part USING (doc_id)
), g AS (SELECT *, regexp_extract(path, '(?s)^(.*)/[^/]*$', 1) AS dir FROM f
), stated AS (SELECT dir, arg_min(own, (-n, own)) AS license FROM (SELECT dir, own, count(*) AS n FROM g WHERE declares GROUP BY ALL) GROUP BY dir
), near AS (
  SELECT d.dir, max_by(s.dir, length(s.dir)) AS above, max_by(s.license, length(s.dir)) AS license
  FROM (SELECT DISTINCT dir FROM g) d JOIN stated s ON starts_with(d.dir || '/', s.dir || '/') OR s.dir = '' GROUP BY d.dir
)
SELECT doc_id, path, own, score, declares, coalesce(own, near.license) AS license, CASE WHEN own IS NULL THEN near.above END AS found_in FROM g LEFT JOIN near USING (dir)
"""


ORACLE_SQL = {
    "op5_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op10_similarity": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other
)
SELECT d.doc_id, d.class_id, coalesce(k.n, 0) AS n_links
FROM (SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id) d LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) k ON k.a = d.doc_id
""",
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, '-') AS key, md5(coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), rows AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key, digest) - 1 AS nth FROM d
), s AS (SELECT source, key, CAST(sum(size) AS BIGINT) AS source_size, list_extract([1.0::DOUBLE, 2, 3], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)) AS w FROM d GROUP BY source, key
), c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS full_at FROM s
), f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS part
  FROM c WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT key, source_size, CASE WHEN l IS NULL THEN cap ELSE least(cap, l * w) END AS target
  FROM f, (SELECT (SELECT part FROM f WHERE part <= full_at ORDER BY full_at, source NULLS LAST LIMIT 1) AS l)
), g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS certain FROM t
), z AS (
  SELECT key, size, count(*) AS n, any_value(greatest(0, target - certain * source_size)) AS needs FROM rows JOIN g USING (key) WHERE size > 0 GROUP BY key, size
), r0 AS (
  SELECT *, (needs - coalesce(sum(size * n) OVER (PARTITION BY key ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(CAST(size AS DOUBLE) * size * n) OVER (PARTITION BY key ORDER BY size ROWS UNBOUNDED PRECEDING) AS rate FROM z
), r1 AS (SELECT key, arg_max(rate, size) AS rate FROM r0 WHERE rate >= 0 AND rate * size <= 1 GROUP BY key
), p AS (
  SELECT key, size, n, CASE WHEN size * r1.rate < 1 THEN size * r1.rate ELSE 1.0::DOUBLE END AS chance,
         (len(bin(size)) - 1) * 4 + CAST(size * 4 // (1::BIGINT << (len(bin(size)) - 1)) AS INTEGER) - 4 AS class FROM z LEFT JOIN r1 USING (key)
), due AS (SELECT key, class, sum(chance * n) AS due FROM p WHERE chance < 1 GROUP BY key, class
), upto AS (
  SELECT key, class, floor(sum(due) OVER (PARTITION BY key ORDER BY class ROWS UNBOUNDED PRECEDING)
    + (CAST('0x' || substr(md5('11|start|' || key), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS upto FROM due
), takes AS (SELECT key, class, upto - coalesce(lag(upto) OVER (PARTITION BY key ORDER BY class), 0) AS take FROM upto
), u AS (
  SELECT rows.*, g.source_size, g.target, g.certain, coalesce(p.chance, 0) AS chance, p.class,
    (CAST('0x' || substr(md5('11|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || rows.key || '|' || digest || '|' || nth), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM rows JOIN g USING (key) LEFT JOIN p ON p.key = rows.key AND p.size = rows.size
), o AS (
  SELECT *, row_number() OVER (PARTITION BY key, class, chance > 0 AND chance < 1
    ORDER BY CASE WHEN chance > 0 AND chance < 1 THEN u / (1 - u) / (chance / (1 - chance)) END, doc_id NULLS FIRST, digest, nth) AS place FROM u
), m AS (
  SELECT o.*, certain + CASE WHEN chance = 1 OR chance > 0 AND chance < 1 AND place <= take THEN 1 ELSE 0 END AS copies
  FROM o LEFT JOIN takes ON takes.key = o.key AND takes.class = o.class
)
SELECT doc_id, size, source_size, target, chance, CAST(copies AS INTEGER) AS copies, CAST(copies * size AS BIGINT) AS taken FROM m
""",
    "op6_quality": r"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n
  FROM (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4))
), rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, (SELECT unnest(range(0, 5)) AS k) WHERE n > 1 GROUP BY doc_id
), ln AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, lang, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(ln.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(regexp_extract_all(t, '\p{Lu}')) AS n_upper, coalesce(ln.n, 0) AS n_lines
  FROM w LEFT JOIN ln ON ln.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    greatest(n_symbols::DOUBLE / greatest(word_chars, 1) / 0.1::DOUBLE, n_dup_lines::DOUBLE / greatest(n_lines, 1) / 0.6::DOUBLE,
      n_repeat_words::DOUBLE / greatest(n_words, 1) / 0.2::DOUBLE, n_upper::DOUBLE / greatest(word_chars, 1) / 0.2::DOUBLE) AS score FROM m
), h AS (SELECT coalesce(lang, '-') AS lang, score, q FROM b JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed
), c AS (
  SELECT lang, i, round(5.0::DOUBLE - 0.1::DOUBLE * i, 1) AS cut, sum((q = 1)::INT) AS n, sum((q = 1 AND score > round(5.0::DOUBLE - 0.1::DOUBLE * i, 1))::INT) AS k,
    sum((q <> 1 AND score > round(5.0::DOUBLE - 0.1::DOUBLE * i, 1))::INT) AS bad
  FROM h, (SELECT unnest(range(0, 50)) AS i) GROUP BY lang, i
), p AS (
  SELECT *, k <= 0.02 * n AND n > 0 AND list_sum(list_transform(range(0, k::BIGINT + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(greatest(n - j, 0) + 1) + j * ln(0.02::DOUBLE) + (n - j) * ln(0.98::DOUBLE)))) <= 0.05 / (SELECT count(DISTINCT lang) FROM h) AS proven FROM c
), o AS (SELECT *, bool_and(proven) OVER (PARTITION BY lang ORDER BY i) AS held FROM p
), cuts AS (SELECT lang, arg_max(cut, (bad - k, -i)) AS cut FROM o WHERE held AND bad > k GROUP BY lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(score <= cut, true) AS kept
FROM b LEFT JOIN cuts ON cuts.lang = coalesce(b.lang, '-')
""",
    "op7_licenses": license_sql(),
    "op12_lexical": r"""
WITH d AS (
  SELECT doc_id, ts, len(ts) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents) WHERE len(ts) > 0
), q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d
), p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL
), w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w, n_docs, n_terms FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), r AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM p JOIN w USING (term) JOIN q USING (term) GROUP BY item_id, doc_id
), k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 20
""",
    "op13_infill": r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), n AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n
), p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
""",
}
