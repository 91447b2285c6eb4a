"""The queries of this subpackage's operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import convtrie, decontam, divergence, htmlmain, langid, lines, mixing, ngramjoin, suffix, tokens, topk, toxicity, warc
from .common import table

END_ID = 1


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, files = tokens.write_records(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=END_ID)
    return tokens.read_records(spark, path, files)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, files = warc.build(warc.responses(table(spark, sf_dir, "pages")))
    pairs = warc.read_pairs(spark, path, files)
    return pairs.withColumn("page_id", F.col("source").cast("long")).withColumn("n_chars", F.length("text").cast("long")).drop("source")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.components(table(spark, sf_dir, "documents"), n=3, threshold=(9, 10))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = convtrie.end_digests(convtrie.conversation_trie(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("of"), "toxic")
    model = toxicity.fit(docs.where(~toxicity.held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("of")).select("text", "toxic"))
    found = toxicity.score(docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_output, op2_language_id, op3_warc_derivatives, op4_suffix_dedup, op5_decontamination, op6_line_dedup, op7_main_text, op8_top_k, op9_mixing, op10_ngram_join, op11_conversation_trie, op12_toxicity, op13_source_divergence)}


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL = {
    "op5_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g, least(13, len(w)) AS n FROM b, unnest(range(1, greatest(2, len(w) - 11))) AS r(k) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM win),
        dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(k)),
        hit AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
        words AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hit, unnest(range(0, n)) AS r(j) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM hit GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_main_text": r"""
        WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g') AS t FROM pages),
        u AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM u""",
    "op8_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op9_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (['5', '2', '1'])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS stop, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
        l AS (SELECT *, (budget - coalesce(sum(stop) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        t AS (SELECT source, source_size, budget, least(coalesce(max(CASE WHEN level * weight <= stop THEN level END) OVER () * weight, stop), stop) AS target FROM l),
        r AS (SELECT d.*, source_size, target, budget, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT doc_id, source, size, h, k, budget, (cum + k * source_size) / target AS f FROM r, unnest([0, 1]) AS p(k) WHERE size > 0),
        o AS (SELECT *, sum(size) OVER (ORDER BY f, source IS NULL, source, k, h, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
        n AS (SELECT doc_id, size, count(*) AS copies FROM o WHERE run <= budget GROUP BY doc_id, size)
        SELECT r.doc_id, r.size, source_size, target, CAST(coalesce(copies, 0) * r.size AS BIGINT) AS taken FROM r LEFT JOIN n ON r.doc_id IS NOT DISTINCT FROM n.doc_id AND r.size = n.size""",
    "op10_ngram_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS g FROM d, unnest(range(1, greatest(2, len(w) - 1))) AS r(k) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        c(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.reached = e.a)
        SELECT c.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id""",
    "op11_conversation_trie": r"""
        WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
        bits(n, x) AS (SELECT 0, range(256) UNION ALL SELECT n + 1, list_transform(x, lambda v: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) FROM bits WHERE n < 8),
        c AS (SELECT c.conv_id, c.conv_id - c.conv_id % 20 AS base, list_reduce(list_prepend(4294967295, list_transform(string_split(c.conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: xor(a >> 8, l.x[(xor(a, b) & 255) + 1])) AS crc FROM (SELECT DISTINCT conv_id FROM t) c, (SELECT x FROM bits WHERE n = 8) l),
        h AS (SELECT conv_id, base, xor(crc, 4294967295) % 4 AS h FROM c),
        b AS (SELECT h.conv_id, 0 AS own, t.i, r, x FROM h JOIN t ON t.conv_id = h.base AND t.i <= h.h UNION ALL SELECT h.conv_id, 1, t.i, r, x FROM h JOIN t ON t.conv_id = h.conv_id AND t.i > h.h),
        p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(r) || md5(x), '/') OVER (w ROWS UNBOUNDED PRECEDING) AS k, CAST(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)
              UNION ALL SELECT conv_id, 0, '', 0 FROM h),
        z AS (SELECT conv_id, max(depth) AS z FROM p GROUP BY conv_id),
        n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM p GROUP BY depth, k),
        e AS (SELECT depth, k, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) AS ids FROM p JOIN z USING (conv_id) WHERE depth = z GROUP BY depth, k),
        up AS (SELECT n.depth, n.k, u.depth AS pd, u.k AS pk FROM n JOIN p u ON u.conv_id = n.conv_id AND u.depth <= n.depth),
        kids AS (SELECT pd AS depth, pk AS k, count(*) AS c FROM up WHERE depth = pd + 1 GROUP BY pd, pk),
        sums AS (SELECT pd, pk, count(*) FILTER (WHERE kids.c IS NULL) AS leaves, sum((n.n - 1) * n.words) AS saved FROM up JOIN n USING (depth, k) LEFT JOIN kids USING (depth, k) GROUP BY pd, pk)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids.c, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM n JOIN sums ON pd = n.depth AND pk = n.k LEFT JOIN kids ON kids.depth = n.depth AND kids.k = n.k LEFT JOIN e ON e.depth = n.depth AND e.k = n.k
        LEFT JOIN up u ON u.depth = n.depth AND u.k = n.k AND u.pd = n.depth - 1 LEFT JOIN n q ON q.depth = u.pd AND q.k = u.pk""",
    "op13_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_FOLD}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT DISTINCT lang, source FROM d),
        s AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
        p AS (SELECT g.lang, g.source, term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (coalesce(s.n, 0) + l.v) AS p, 1 + 1000000000::HUGEINT * (k.c + 1) // (l.n + l.v) AS q
              FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= 200""",
}


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables. Tokenizing, classifying, byte strings, WARC files and SimHash are held against brute force in tests."""
    return dict(_SQL)
