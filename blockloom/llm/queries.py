"""One query per operator over its whole table, with the SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, archives, bpe, filter_audit, mixing, ngram_join, pii, quality, secret_scan, sharding, substrings, topk, valid_time
from .common import table

BPE_VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(BPE_VOCABULARY)


def op1_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_values", "kinds")


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"]))


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.convert(table(spark, sf_dir, "pages"))


def op8_fragment_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op9_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle(table(spark, sf_dir, "documents"))


def op10_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_time.enrich(table(spark, sf_dir, "sales"), table(spark, sf_dir, "client_changes"))


def op13_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (op1_pii_feistel, op2_entropy_mix, op3_bradley_terry, op4_two_stage_suffixes, op5_bpe, op6_learned_partitions, op7_arc_to_warc, op8_fragment_jaccard, op9_hypergeometric, op10_kd_topk, op11_filter_audit, op12_valid_time, op13_secret_ownership)
}

ORACLES = {
    "op4_two_stage_suffixes": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
        w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM h WHERE n >= 100)),
        again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
        runs AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
            SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM again)),
        spans AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM runs GROUP BY doc_id, run),
        cuts AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM spans),
        gone AS (SELECT c.doc_id, sum(e - s) AS removed, count(*) AS spans, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM cuts c JOIN h USING (doc_id) GROUP BY c.doc_id)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM h LEFT JOIN gone USING (doc_id)
    """,
    "op8_fragment_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
        ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id AS id, doc_id AS other FROM n UNION SELECT reach.id, ways.y FROM reach JOIN ways ON ways.x = reach.other),
        roots AS (SELECT id, min(other) AS root FROM reach GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN roots ON roots.id = d.doc_id
    """,
    "op7_arc_to_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
    """,
    "op10_kd_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        f AS (SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
                     regexp_matches(t, '[#$%&*|]') AS d, coalesce(first < doc_id, false) AS e FROM w),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
        steps AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
        r AS (SELECT m.*, o, step, fails[ascii(substr(o, step, 1)) - 64] AS own,
                     len(list_filter(range(1, step), lambda i: fails[ascii(substr(o, i, 1)) - 64])) > 0 AS gone, len(list_filter(fails, lambda y: y)) = 1 AS alone FROM m, steps),
        s AS (SELECT part, o, step, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (own AND gone), 0) AS redundant,
                     coalesce(sum(n) FILTER (own AND alone), 0) AS alone, coalesce(sum(good) FILTER (own AND NOT gone), 0) AS good, coalesce(sum(toxic) FILTER (own AND NOT gone), 0) AS toxic FROM r GROUP BY ALL)
        SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(alone AS BIGINT) AS unique_fails,
               CAST(good AS BIGINT) AS good_lost, CAST(toxic AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, substr(o, step, 1)) AS BIGINT) AS shapley FROM s
    """,
    "op12_valid_time": """
        WITH c AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
        k AS (SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(change_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                     lambda a, x: list_reduce(list_prepend(xor(a, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))) AS x FROM c),
        v AS (SELECT *, CAST(coalesce(greatest(0, least(7, floor((date_diff('day', DATE '1970-01-01', CAST(valid_at AS DATE)) + xor(x, 4294967295) % 4 - 19723) * 8 / 152))), 7) AS BIGINT) AS b FROM k),
        s AS (SELECT row_number() OVER () AS r, *, CAST(coalesce(greatest(0, least(7, floor((date_diff('day', DATE '1970-01-01', CAST(arrived_at AS DATE)) - 19723) * 8 / 152))), 7) AS BIGINT) AS b FROM sales),
        w AS (SELECT n, (SELECT max(sold_at) FROM s WHERE s.b < n) - INTERVAL 12 HOUR AS ws, (SELECT max(valid_at) FROM v WHERE v.b < n) - INTERVAL 12 HOUR AS wc FROM (SELECT unnest(range(0, 8)) AS n)),
        h AS (SELECT n, wc, CASE WHEN ws IS NOT NULL AND wc IS NOT NULL THEN least(ws, wc) END AS h FROM w),
        vs AS (SELECT v.*, coalesce(valid_at < wc, false) AS late FROM v JOIN h ON n = b),
        e AS (SELECT r, any_value(sale_id) AS sale_id, any_value(client_id) AS client_id, any_value(sold_at) AS sold_at, coalesce(min(n) FILTER (sold_at IS NULL OR sold_at < h), 8) AS e FROM s JOIN h ON n >= b GROUP BY r),
        eh AS (SELECT e.*, h.h AS before FROM e LEFT JOIN h ON h.n = e - 1),
        j AS (SELECT r, e, sold_at, u.*, u.b < e AND coalesce(u.valid_at <= before, false) AS passed FROM eh JOIN vs u ON u.client_id = eh.client_id AND u.b <= e AND NOT late),
        k2 AS (SELECT *, row_number() OVER (PARTITION BY r, passed ORDER BY valid_at DESC, seq DESC NULLS LAST, change_id DESC NULLS LAST, op DESC NULLS LAST, balance DESC NULLS LAST) AS nth FROM j),
        held AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY coalesce(valid_at <= sold_at, false) DESC, valid_at DESC, seq DESC NULLS LAST, change_id DESC NULLS LAST, op DESC NULLS LAST, balance DESC NULLS LAST) AS best FROM k2 WHERE NOT passed OR nth = 1),
        n AS (SELECT r, count(*) AS n FROM held GROUP BY r)
        SELECT 'sale' AS rec, eh.sale_id AS id, eh.e AS batch, coalesce(n.n, 0) AS n_held, held.change_id, CAST(floor(100 * balance + 0.5) AS BIGINT) AS balance_cents, op
        FROM eh LEFT JOIN n USING (r) LEFT JOIN held ON held.r = eh.r AND best = 1 AND valid_at <= eh.sold_at
        UNION ALL SELECT 'late', change_id, b, NULL, NULL, NULL, NULL FROM vs WHERE late
    """,
    "op13_secret_ownership": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS owner, coalesce(text, '') AS t FROM documents),
        m AS (
            SELECT rid, doc_id, owner, 0 AS place, unnest(regexp_extract_all(t, '(?s).*?(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')) AS upto,
                   unnest(regexp_extract_all(t, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')) AS match,
                   unnest(regexp_extract_all(t, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) AS val,
                   unnest(range(1, length(t) + 1)) AS nr FROM d
            UNION ALL SELECT rid, doc_id, owner, 1, unnest(regexp_extract_all(t, '(?s).*?AKIA[A-Z0-9]+')), unnest(regexp_extract_all(t, 'AKIA[A-Z0-9]+')), unnest(regexp_extract_all(t, 'AKIA[A-Z0-9]+')), unnest(range(1, length(t) + 1)) FROM d
            UNION ALL SELECT rid, doc_id, owner, 2, unnest(regexp_extract_all(t, '(?s).*?[0-9a-f]{16,}')), unnest(regexp_extract_all(t, '[0-9a-f]{16,}')), unnest(regexp_extract_all(t, '[0-9a-f]{16,}')), unnest(range(1, length(t) + 1)) FROM d
            UNION ALL SELECT rid, doc_id, owner, 3, unnest(regexp_extract_all(t, '(?s).*?[A-Za-z0-9+/_=-]{20,}')), unnest(regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}')), unnest(regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}')), unnest(range(1, length(t) + 1)) FROM d),
        p AS (SELECT rid, doc_id, owner, place, val, CAST(sum(length(upto)) OVER (PARTITION BY rid, place ORDER BY nr) AS BIGINT) AS e, length(match) AS n,
                     regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND len(list_distinct(string_split(val, ''))) >= 10 AS live FROM m WHERE match IS NOT NULL),
        base AS (SELECT *, e - n AS s FROM p WHERE place < 3 AND length(val) >= CASE place WHEN 0 THEN 12 WHEN 1 THEN 18 ELSE 16 END),
        words AS (SELECT *, e - n AS s FROM p WHERE place = 3 AND live),
        spans AS (SELECT * FROM base UNION ALL SELECT w.* FROM words w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.s < w.e AND w.s < b.e)),
        freq AS (SELECT val, count(DISTINCT owner) AS owners FROM spans GROUP BY val),
        judged AS (SELECT rid, place, s, e, CASE WHEN owners >= 3 THEN 'example' WHEN live THEN 'live' ELSE 'weak' END AS verdict,
                          (['assign', 'access', 'hex', 'live'])[place + 1] || ':' || s || ':' || e AS said FROM spans JOIN freq USING (val)),
        kept AS (SELECT rid, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS k, count(*) FILTER (place = 2) AS h, count(*) FILTER (place = 3) AS l,
                        string_agg(said, ',' ORDER BY s, place) FILTER (place < 3) AS base, string_agg(said, ',' ORDER BY s, place) AS spans,
                        count(*) FILTER (verdict = 'example') AS ex, count(*) FILTER (verdict = 'live') AS own
                 FROM judged WHERE place < 3 OR verdict = 'live' GROUP BY rid)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, coalesce(l, 0) AS n_live, sha256(coalesce(base, '')) AS base_sha256,
               coalesce(spans, '') AS spans, coalesce(ex, 0) AS n_examples, coalesce(own, 0) AS n_owner_specific
        FROM d LEFT JOIN kept USING (rid)
    """,
}
