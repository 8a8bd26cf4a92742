"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import (
    bpe,
    decontamination,
    infill,
    language,
    lengths,
    near_duplicates,
    quality,
    repeats,
    secret_scan,
    sharding,
    topk,
    url_filter,
    whitening,
)

VOCABULARY = os.environ.get("TABULON_VOCABULARY")


def vocabulary() -> str:
    """Place of the tokenizer file on the driver."""
    if VOCABULARY:
        return VOCABULARY
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def remainder(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, and digests of its ids and of the text decoded from them."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.round_trip(documents, vocabulary())
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hashed(F.array_join("ids", ",")).alias("ids_sha256"),
        hashed(F.col("decoded")).alias("decoded_sha256"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, in two scans: half of the contents first, then all with the ledger of the first."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, ledger = secret_scan.scan(documents.where(secret_scan.blob_of("text") < "8"))
    scanned, _ = secret_scan.scan(documents, ledger=ledger)
    spans = F.col("spans")
    return scanned.select(
        "doc_id",
        *[secret_scan.of_kind(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        hashed(secret_scan.spelled(spans)).alias("base_sha256"),
        secret_scan.spelled(spans).alias("spans"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard, by its id."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; one crc32 remainder in four is never learned from."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit_quality(documents, labels.where(remainder(4) != 2))
    return quality.score_quality(documents, model).select(
        "doc_id",
        F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host and path, and the verdict on its URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every vector whose id is divisible by 20, against all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; one crc32 remainder in five is never learned from."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_language(documents.where(remainder(5) != 0))
    return language.identify(documents.drop("lang"), model).select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every encoded length of documents as a context limit."""
    return lengths.token_budget(table(spark, sf_dir, "documents"), vocabulary())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of benchmark items, and which items."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_items(documents, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontamination.hit_words().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        hashed(F.array_join("hit_items", ",")).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component and whether it is the one that stays."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three at line borders, and put together again."""
    made = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        hashed(F.col("fim_text")).alias("output_sha256"),
        hashed(infill.restored(F.col("fim_text"), F.col("form"))).alias("restored_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the four leading components, with variance one."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that stand elsewhere too."""
    return repeats.repeat_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_secrets": op3_secrets,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_topk": op7_topk,
    "op8_language": op8_language,
    "op9_token_counts": op9_token_counts,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_whitening": op12_whitening,
    "op13_suffix_dedup": op13_suffix_dedup,
}

SQL = {
    "op2_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
            FROM documents),
        i AS (
            SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
            FROM benchmark),
        item_windows AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS win
            FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM i WHERE len(w) > 0)),
        doc_windows AS (
            SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
                  FROM d, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k)),
        hits AS (SELECT DISTINCT doc_id, s, k, item_id FROM doc_windows JOIN item_windows USING (k, win)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                  FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op3_secrets": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        r AS (SELECT * FROM (VALUES
            (0, 'assign', 2, 8,
             '(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
            (1, 'access', 0, 16, 'AKIA[A-Z0-9]+'), (2, 'hex', 0, 32, '[0-9a-f]+')) AS v(k, kind, g, least_n, p)),
        m AS (
            SELECT doc_id, k, kind, string_split_regex(t, p) AS gap,
                   CASE k WHEN 0 THEN regexp_extract_all(t, p0, 0) WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0)
                          ELSE regexp_extract_all(t, '[0-9a-f]+', 0) END AS whole,
                   CASE k WHEN 0 THEN regexp_extract_all(t, p0, 2) WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0)
                          ELSE regexp_extract_all(t, '[0-9a-f]+', 0) END AS part, least_n
            FROM d, r),
        o AS (SELECT *, unnest(list_filter(range(1, len(part) + 1), lambda i: length(part[i]) >= least_n)) AS n FROM m),
        s AS (
            SELECT doc_id, k, kind, list_sum(list_transform(gap[1:n], lambda x: length(x)))
                   + coalesce(list_sum(list_transform(whole[1:n - 1], lambda x: length(x))), 0) AS a,
                   length(whole[n]) AS size
            FROM o),
        g AS (
            SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access,
                   count(*) FILTER (WHERE k = 2) AS n_hex,
                   string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + size AS BIGINT), ',' ORDER BY a, k) AS spans
            FROM s GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (doc_id)
    """.replace("p0", """'(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""),
    "op6_url_filter": """
        WITH h AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
                             ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
              AS v(verdict, rule_host, rule_path)),
        b AS (
            SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   arg_max(r.verdict, length(rule_host || rule_path)) AS verdict
            FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE
            WHEN regexp_matches(host, '(^|\\.)(spam-farm|cheap-pills|ads-track|casino-win|adult-x|free-bets)\\.')
              OR regexp_matches(path, '/(wp-login|cart|login|search)([^0-9A-Za-z]|$)') THEN 'block'
            ELSE 'allow' END) AS verdict
        FROM h LEFT JOIN b USING (page_id)
    """.replace("\\\\", "\\"),
    "op7_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 20
    """,
    "op11_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS w,
                   sha256('7:' || doc_id) AS h
            FROM documents),
        c AS (
            SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS c2,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                        WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM d),
        p AS (
            SELECT doc_id, t, len(w) AS n, form, array_to_string(w[1:least(c1, c2)], '') AS pre,
                   array_to_string(w[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid, array_to_string(w[greatest(c1, c2) + 1:], '') AS suf
            FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
}


def sql() -> dict[str, str]:
    """All SQL; that of the placement holds its table of slots, filled by the rule of turns."""
    owners = ",".join(str(k) for k in sharding.fill_slots())
    placed = f"""
        WITH t AS (SELECT string_split('{owners}', ',') AS owner),
        s AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {sharding.SLOTS} AS slot
              FROM documents)
        SELECT doc_id, slot, 'shard-' || lpad(owner[slot + 1], 3, '0') AS shard FROM s, t
    """
    return SQL | {"op4_sharding": placed}
