"""The corpus operators as registered queries over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, fill_middle, host_rules, html_extract, jaccard_join, language, manifest, mixing, pii, secrets_scan, span_dedup, tiling, url_filter
from .common import held_out, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "removed", "text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, aside = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"))
    return language.identify(docs, language.train(docs, ~aside), aside)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs.select("doc_id", "text"), pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tiling.judge(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.digest(secrets_scan.scan(table(spark, sf_dir, "documents")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, aside = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"))
    model = compression.train(docs, table(spark, sf_dir, "labels"), ~aside)
    scored = compression.score(docs.select("doc_id", "text", aside.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 9))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, aside = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"))
    return mixing.mix(docs, table(spark, sf_dir, "labels").filter(~aside))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.arrange(table(spark, sf_dir, "documents")))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = url_filter.mine(url_filter.labelled(pages, table(spark, sf_dir, "labels")))
    return url_filter.judge(pages, rules).drop("url")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_substring_dedup,
        op3_language_id,
        op4_pii,
        op5_benchmark_decontamination,
        op6_ngram_jaccard_join,
        op7_secret_scans,
        op8_quality_classifier,
        op9_quality_rules,
        op10_mixing,
        op11_fill_in_middle,
        op12_url_filters,
        op13_merkle_manifest,
    )
}

#: Every pair of documents that share a shingle is counted, so this is for small tables.
OP6_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
        JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT r.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN sizes z ON z.doc_id = r.doc_id
GROUP BY r.doc_id
"""

#: Every window of every text is a row, so this too is for small tables.
OP9_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), runs AS (
    SELECT r, w, unnest(range(1, len(w) - 6)) AS place FROM words
), twice AS (
    SELECT r, place FROM (SELECT r, place, array_to_string(w[place:place + 7], ' ') AS run FROM runs) QUALIFY count(*) OVER (PARTITION BY r, run) > 1
), gaps AS (
    SELECT r, least(8, coalesce(lead(place) OVER (PARTITION BY r ORDER BY place) - place, 8)) AS own FROM twice
), repeats AS (
    SELECT r, sum(own)::BIGINT AS n FROM gaps GROUP BY r
), measured AS (
    SELECT doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM words LEFT JOIN repeats USING (r)
), failed AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        (n_symbols > 0.3::DOUBLE * n_words)::INT + (n_dup_lines > greatest(2, 0.05::DOUBLE * n_words))::INT
            + (n_words > 0 AND NOT word_chars::DOUBLE / greatest(n_words, 1) BETWEEN 2 AND 15)::INT AS soft_failures
    FROM measured
), hosts AS (
    SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR soft_failures > 0)::DOUBLE AS f FROM failed GROUP BY host
), overall AS (
    SELECT sum(f) / sum(n) AS m, var_pop(f / n) AS spread, avg(1 / n) AS draw FROM hosts
), prior AS (
    SELECT m, least(greatest(m * (1 - m) / greatest(spread - m * (1 - m) * draw, 1e-9) - 1, 1), 1000) AS strength FROM overall
), rates AS (
    SELECT host, m, (f + m * strength) / (n + strength) AS rate FROM hosts, prior
), verdicts AS (
    SELECT host, rate, CASE WHEN rate > 0.5 THEN 'blocked' WHEN rate > 2 * m THEN 'suspect' ELSE 'good' END AS verdict FROM rates
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND verdict <> 'blocked' AND soft_failures < CASE WHEN verdict = 'suspect' THEN 1 ELSE 2 END AS kept,
    d.host, round(rate, 9) AS host_rate, verdict AS host_verdict, soft_failures
FROM failed d JOIN verdicts v ON d.host IS NOT DISTINCT FROM v.host
"""

#: Units and cuts of op11, by the definition of its output.
OP11_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
    SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
            WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parts AS (
    SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM drawn
), made AS (
    SELECT *, CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END AS o FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN split_part(o[4:], '<S>', 1) || split_part(o, '<M>', 2) || split_part(split_part(o, '<S>', 2), '<M>', 1)
        ELSE split_part(split_part(o, '<P>', 2), '<M>', 1) || split_part(o, '<M>', 2) || split_part(o[4:], '<P>', 1) END) AS restored_sha256
FROM made
"""

#: Every subset of a labelled url's tokens is a row, so this is for small tables.
OP12_SQL = r"""
WITH fixed AS (
    SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) r(h, p, v)
), urls AS (
    SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '') AS query
    FROM pages
), ruled AS (
    SELECT u.page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS said
    FROM urls u JOIN fixed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u.page_id
), low AS (
    SELECT doc_id, min(quality) = 0 AS low FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), segments AS (
    SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM urls
), read AS (
    SELECT page_id, url, host, path, list_sort(list_distinct(list_concat(
        list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
        list_transform(s[1:len(s) - CASE WHEN ends_with(path, '/') THEN 0 ELSE least(1, len(s)) END], lambda x: 'p:' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' ELSE x END),
        list_transform(list_filter([regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)], lambda x: x <> ''), lambda x: 'e:' || x),
        list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'q:' || x)))) AS items
    FROM segments
), told AS (
    SELECT r.page_id, r.items, coalesce(u.said = 'block', low) AS bad
    FROM read r LEFT JOIN ruled u ON u.page_id = r.page_id LEFT JOIN low ON low.doc_id = r.page_id WHERE r.url IS NOT NULL AND coalesce(u.said = 'block', low) IS NOT NULL
), size AS (
    SELECT count(*) AS n, greatest(20, 0.005::DOUBLE * count(*)) AS least FROM told
), frequent AS (
    SELECT token FROM (SELECT unnest(items) AS token FROM told), size GROUP BY token, n, least HAVING count(*) >= least AND count(*) <= 0.95::DOUBLE * n
), kept AS (
    SELECT page_id, bad, list(token ORDER BY token) AS items FROM (SELECT page_id, bad, unnest(items) AS token FROM told) SEMI JOIN frequent USING (token) GROUP BY page_id, bad
), subsets AS (
    SELECT bad, list_filter(items, lambda x, i: (mask >> (i - 1)::BIGINT) & 1 = 1) AS antecedent FROM (SELECT bad, items, unnest(range(1, (1::BIGINT) << len(items))) AS mask FROM kept)
), rules AS (
    SELECT antecedent, count(*) FILTER (bad)::DOUBLE / count(*) AS confidence, count(*) FILTER (bad) AS support FROM subsets, size
    GROUP BY antecedent, least HAVING count(*) FILTER (bad) >= least AND count(*) FILTER (bad)::DOUBLE / count(*) >= 0.9
), pruned AS (
    SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules o WHERE len(o.antecedent) < len(r.antecedent) AND list_has_all(r.antecedent, o.antecedent) AND o.confidence >= r.confidence)
), matched AS (
    SELECT page_id, array_to_string(antecedent, ' ') AS mined, confidence FROM read JOIN pruned ON list_has_all(items, antecedent)
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, support DESC, antecedent) = 1
)
SELECT u.page_id, u.host, u.path, r.rule, coalesce(r.said, CASE WHEN m.mined IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
    CASE WHEN r.rule IS NULL THEN m.mined END AS mined, CASE WHEN r.rule IS NULL THEN m.confidence END AS confidence
FROM urls u LEFT JOIN ruled r ON r.page_id = u.page_id LEFT JOIN matched m ON m.page_id = u.page_id
"""

#: A leaf is read once for every level of the trees. The ids' crc32 is reckoned bit by bit.
OP13_SQL = r"""
WITH RECURSIVE fields AS (
    SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
        coalesce(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
            lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))) % 5 = 0, false) AS touched
    FROM documents
), leaves AS (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(CASE WHEN touched THEN lowered ELSE text END) || ':' || CASE WHEN touched THEN lowered ELSE text END, '-')) AS seen
    FROM fields
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves
), up AS (
    SELECT 0 AS level, source, place, leaf AS node, n FROM placed
    UNION ALL
    SELECT level + 1, source, place // 16, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 15) // 16 FROM up WHERE n > 1 GROUP BY level, source, place // 16
), subroots AS (
    SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1
), over AS (
    SELECT 0 AS level, place, node, n FROM subroots
    UNION ALL
    SELECT level + 1, place // 16, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 15) // 16 FROM over WHERE n > 1 GROUP BY level, place // 16
), steps AS (
    SELECT p.source, p.place, u.level AS level,
        coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place < u.place), '') AS before, coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place > u.place), '') AS after
    FROM placed p JOIN up u ON u.source IS NOT DISTINCT FROM p.source AND u.n > 1 AND u.place = p.place >> (4 * u.level)
        JOIN up s ON s.source IS NOT DISTINCT FROM p.source AND s.level = u.level AND s.place // 16 = u.place // 16
    GROUP BY p.source, p.place, u.level, u.place
), oversteps AS (
    SELECT p.source, 1000 + u.level AS level,
        coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place < u.place), '') AS before, coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place > u.place), '') AS after
    FROM subroots p JOIN over u ON u.n > 1 AND u.place = p.place >> (4 * u.level) JOIN over s ON s.level = u.level AND s.place // 16 = u.place // 16
    GROUP BY p.source, u.level, u.place
), every AS (
    SELECT source, place, level, before, after FROM steps
    UNION ALL
    SELECT p.source, p.place, o.level, o.before, o.after FROM placed p JOIN oversteps o ON o.source IS NOT DISTINCT FROM p.source
), paths AS (
    SELECT source, place, list({'before': before, 'after': after} ORDER BY level) AS path, string_agg(before || after, '' ORDER BY level) AS proof FROM every GROUP BY source, place
), folds AS (
    SELECT p.doc_id, p.source, p.place, p.leaf, p.seen AS node, coalesce(x.path, []) AS path, coalesce(x.proof, '') AS proof, 0 AS done
    FROM placed p LEFT JOIN paths x ON x.source IS NOT DISTINCT FROM p.source AND x.place = p.place
    UNION ALL
    SELECT doc_id, source, place, leaf, sha256(path[done + 1].before || node || path[done + 1].after), path, proof, done + 1 FROM folds WHERE done < len(path)
)
SELECT f.doc_id, f.leaf, s.node AS subroot, r.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified, f.source, f.place
FROM folds f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source, (SELECT node FROM over WHERE n = 1) r
WHERE f.done = len(f.path)
"""

ORACLES: dict[str, str] = {"op6_ngram_jaccard_join": OP6_SQL, "op9_quality_rules": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op12_url_filters": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
