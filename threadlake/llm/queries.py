"""The queries opN_<name>, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, language, minhash, ngram_trie, pii, prefix_trie, quality, sentencepieces, sstable, url_filter, warc, winnow
from .common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def remainder(n: int):
    """crc32 of the identifier as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(docs, table(spark, sf_dir, "labels"), learn=remainder(3) != 1)
    scored = quality.score(docs, weights)
    return scored.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language.train(docs, learn=remainder(4) != 2)
    found = language.predict(docs, prototypes)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"), payload=False, min_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_decode(table(spark, sf_dir, "documents"), PIECE_BPE, ids=False)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), places=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op11_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(7) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    scored = ngram_trie.scored(docs, remainder(7) != 2)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), rebuild=True)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_shards": op2_token_shards,
    "op3_language": op3_language,
    "op4_fingerprints": op4_fingerprints,
    "op5_warc": op5_warc,
    "op6_pii": op6_pii,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_decontamination": op9_decontamination,
    "op10_url_filter": op10_url_filter,
    "op11_ngram_trie": op11_ngram_trie,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, strlen(payload) AS n, sha1(payload) AS hex FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM d),
        b AS (SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(hex, i + 1, 1)) - 1) AS nib FROM g),
        t AS (SELECT *, list_transform(range(160), lambda i: (nib[i // 4 + 1] >> (3 - i % 4)) & 1) AS bit FROM b)
        SELECT page_id, n::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (bit[5 * k + 1] * 16 + bit[5 * k + 2] * 8 + bit[5 * k + 3] * 4 + bit[5 * k + 4] * 2 + bit[5 * k + 5] + 1)::BIGINT, 1)), '') AS payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> last THEN last END AS refers_to
        FROM t""",
    "op8_near_duplicates": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
        ab AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT a AS id, a AS reach FROM ab UNION SELECT r.id, ab.b FROM r JOIN ab ON ab.a = r.reach),
        c AS (SELECT id, min(reach) AS c FROM r GROUP BY id)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id""",
    "op9_decontamination": """
        WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, low),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, low),
        bp AS (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0),
        w AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS k FROM bp),
        dp AS (SELECT doc_id, ws, z.n, unnest(range(1, len(ws) - z.n + 2)) AS p FROM d, (SELECT DISTINCT n FROM w) z WHERE len(ws) >= z.n),
        h AS (SELECT doc_id, item_id, p, x.n FROM (SELECT doc_id, n, p, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS k FROM dp) x JOIN w USING (n, k)),
        hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
        it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op10_url_filter": """
        WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
        rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'),
            ('listed', 'ads.example.net', '/'), ('listed', 'tracker.example.net', '/'), ('listed', 'spam.example.com', '/')) AS r(v, h, q)),
        f AS (SELECT page_id, v, h || q AS rule FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)),
        best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM f WHERE v <> 'listed' GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN page_id IN (SELECT page_id FROM f WHERE v = 'listed') THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN best USING (page_id)""",
    "op12_prefix_trie": """
        WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
            coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        bits AS (SELECT i::UBIGINT AS i, i::UBIGINT AS v, 0 AS k FROM range(256) r(i) UNION ALL
            SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384::UBIGINT, v >> 1) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
        crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
        steps AS (SELECT c, c::VARCHAR AS s, 4294967295::UBIGINT AS x, 1 AS p FROM (SELECT DISTINCT c FROM t) UNION ALL
            SELECT c, s, xor(tab[(xor(x, ascii(s[p])::UBIGINT) & 255)::BIGINT + 1], x >> 8), p + 1 FROM steps, crc WHERE p <= length(s)),
        h AS (SELECT c, (xor(x, 4294967295::UBIGINT) % 6)::BIGINT AS h FROM steps WHERE p = length(s) + 1),
        r AS (SELECT h.c, 0 AS part, t.i, role, text FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.i < h.h UNION ALL SELECT t.c, 1, t.i, role, text FROM t JOIN h ON h.c = t.c WHERE t.i >= h.h),
        q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, sha256(length(role)::VARCHAR || ' ' || role || text) AS k, length(text) AS n FROM r),
        p AS (SELECT c, d, string_agg(k, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS k, n FROM q UNION ALL SELECT c, 0, '', 0 FROM h),
        l AS (SELECT c, max(d) AS d FROM p GROUP BY c),
        e AS (SELECT p.d, p.k, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids FROM p JOIN l USING (c, d) GROUP BY p.d, p.k),
        nodes AS (SELECT d, k, min(c) AS c, count(*) AS m, (count(*) - 1) * any_value(n) AS saved FROM p GROUP BY d, k),
        kids AS (SELECT x.d, x.k, count(y.k) AS kids FROM nodes x LEFT JOIN nodes y ON y.d = x.d + 1 AND starts_with(y.k, x.k) GROUP BY 1, 2),
        sums AS (SELECT x.d, x.k, sum(y.saved) AS saved, count(*) FILTER (WHERE z.kids = 0) AS leaves FROM nodes x JOIN nodes y ON y.d >= x.d AND starts_with(y.k, x.k) JOIN kids z ON z.d = y.d AND z.k = y.k GROUP BY 1, 2)
        SELECT x.c AS conv_id, x.d AS depth, y.c AS parent_conv_id, x.m AS n_convs, kids AS n_children, leaves AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM nodes x JOIN kids USING (d, k) JOIN sums USING (d, k) LEFT JOIN nodes y ON y.d = x.d - 1 AND y.k = left(x.k, (64 * (x.d - 1))::BIGINT) LEFT JOIN e ON e.d = x.d AND e.k = x.k""",
    "op13_collocations": """
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        pieces AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
        g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS p, count(*) AS f FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, range(1, 4) r(k)) GROUP BY 1, 2, 3),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
        c AS (SELECT *, string_split(p, ' ') AS ws FROM g WHERE k > 1 AND f >= 10),
        cuts AS (SELECT c.lang, c.k, c.p, c.ws, c.f AS a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN g x ON x.lang = c.lang AND x.k = j AND x.p = array_to_string(ws[1:j], ' ') JOIN g y ON y.lang = c.lang AND y.k = c.k - j AND y.p = array_to_string(ws[j + 1:], ' ')),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
        inside AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS p, f FROM c WHERE k = 3),
        longest AS (SELECT lang, p, max(f) AS f FROM inside GROUP BY 1, 2)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.p) AS rank, b.p AS phrase, a, l, r, n.n, score
        FROM best b JOIN n USING (lang) LEFT JOIN longest x ON b.k = 2 AND x.lang = b.lang AND x.p = b.p WHERE x.f IS NULL OR 100 * x.f < 50 * a
        QUALIFY rank <= 2000""",
}
