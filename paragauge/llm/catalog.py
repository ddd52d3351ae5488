"""Registered queries of the operators over the given tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragauge.llm import (
    bpe_replay, decision_list, hat_trie, html_crf, jaccard_join, mixing, pitman_yor,
    prefix_doubling, rule_ensemble, shard_table, trie_dedup, url_cascade, whitening,
)

#: DuckDB: ASCII lower case, and words.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x20\x09-\x0D]+"

SHARDS = [f"shard-{i:02d}" for i in range(32)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(read(spark, sf_dir, "pages"), ["page_id", "url"])


#: Host, beginning of the path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Listed sites, blocked where no rule fits: hosts whose pages are shorter than this on average.
THIN = 4000


def thin_sites(pages: DataFrame) -> DataFrame:
    hosts = pages.groupBy(url_cascade.host(F.col("url")).alias("host"))
    return hosts.agg(F.avg(F.length("html")).alias("size")).where(F.col("size") < THIN).select("host")


def op2_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_cascade.judge(pages, URL_RULES, thin_sites(pages), ["page_id"])


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = rule_ensemble.train(docs, read(spark, sf_dir, "labels"))
    return rule_ensemble.score(docs, model)


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = decision_list.train(docs, read(spark, sf_dir, "labels"))
    return decision_list.judge(docs, rules)


#: The mix reaches 96 % of the largest entropy and reads as many tokens as there are.
ENTROPY_SHARE = 0.96


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.counted(docs, entropy_share=ENTROPY_SHARE, budget=mixing.AS_MANY)
    return mixed.select(
        "doc_id", "source", "block", mixing.n_tokens(F.col("text")).alias("n_tokens"), "copies"
    )


def op6_trie_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.classes(read(spark, sf_dir, "documents"))


def op7_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_table.place(docs, SHARDS).select(
        "doc_id", "slot", "shard", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes")
    )


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(read(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_replay.encode(read(spark, sf_dir, "documents"), ids=False)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hat_trie.collocations(read(spark, sf_dir, "documents"))


def op13_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_doubling.remove_repeats(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_crf": op1_html_crf,
    "op2_url_cascade": op2_url_cascade,
    "op3_rule_ensemble": op3_rule_ensemble,
    "op4_decision_list": op4_decision_list,
    "op5_mixing": op5_mixing,
    "op6_trie_dedup": op6_trie_dedup,
    "op7_shard_table": op7_shard_table,
    "op8_pitman_yor": op8_pitman_yor,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_bpe": op10_bpe,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_prefix_doubling": op13_prefix_doubling,
}


def _rule(value: str) -> str:
    """CASE over the rules, longest first."""
    order = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    return " ".join(
        f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') "
        f"THEN '{ {'rule': h + p, 'verdict': v}[value] }'"
        for h, p, v in order
    )


def _slots() -> str:
    """Slots as (slot, shard) values, claimed in turns; stated apart from the operator."""
    import hashlib

    slots, free, turn = 4099, set(range(4099)), []
    for name in SHARDS:
        number = [int(hashlib.md5(f"{r}:{name}".encode()).hexdigest()[:12], 16) for r in ("offset", "skip")]
        start, step = number[0] % slots, number[1] % (slots - 1) + 1
        turn.append((name, iter([(start + j * step) % slots for j in range(slots)])))
    owner = {}
    while free:
        for name, wishes in turn:
            if free:
                slot = next(w for w in wishes if w in free)
                free.remove(slot)
                owner[slot] = name
    return ", ".join(f"({s}, '{n}')" for s, n in sorted(owner.items()))


def _score(a: str, left: str, right: str) -> str:
    return f"((1000000::HUGEINT * {a} * {a}) // ({left}::HUGEINT * {right}))::BIGINT"


ORACLE: dict[str, str] = {
    "op2_url_cascade": f"""
        WITH u AS (SELECT page_id, html,
            translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
        SELECT page_id, host, path, CASE {_rule("rule")} END AS rule,
            CASE {_rule("verdict")} WHEN host <> '' AND host IN (
                SELECT host FROM u GROUP BY host HAVING avg(length(html)) < {THIN}) THEN 'block'
            ELSE 'allow' END AS verdict
        FROM u""",
    "op5_mixing": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens,
                (('0x' || substr(md5('mix|block|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 6))::INT % 256)::INT AS block
            FROM documents),
        b AS (SELECT source, block, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
        s AS (SELECT source, sum(tokens)::BIGINT AS t FROM b GROUP BY source),
        p AS (SELECT source, t, t / (SELECT sum(t) FROM s)::DOUBLE AS share FROM s WHERE t > 0),
        e(i, low, high) AS (
            SELECT 0, 0::DOUBLE, 1::DOUBLE
            UNION ALL
            SELECT i + 1, CASE WHEN good THEN (low + high) / 2 ELSE low END,
                CASE WHEN good THEN high ELSE (low + high) / 2 END
            FROM (SELECT i, low, high, log2(sum(pow(share, (low + high) / 2)))
                    - (low + high) / 2 * sum(pow(share, (low + high) / 2) * log2(share))
                      / sum(pow(share, (low + high) / 2))
                    >= {ENTROPY_SHARE} * log2(count(*)) AS good
                  FROM e, p WHERE i < 60 GROUP BY i, low, high)),
        a AS (SELECT low AS exponent FROM e WHERE i = 60),
        w AS (SELECT source, t, round(pow(share, exponent) / (SELECT sum(pow(share, exponent)) FROM p, a)
                * (SELECT sum(t) FROM p))::BIGINT AS budget FROM p, a),
        q AS (SELECT s.source, CASE WHEN s.t > 0 THEN budget // s.t ELSE 1 END AS passes,
                CASE WHEN s.t > 0 THEN budget % s.t ELSE 0 END AS rest
              FROM s LEFT JOIN w ON s.source IS NOT DISTINCT FROM w.source),
        o AS (SELECT b.source, b.block, tokens, passes, rest, coalesce(sum(tokens) OVER (
                PARTITION BY b.source ORDER BY md5('mix|pass|' || coalesce(b.source, '') || '|' || passes || '|' || block), block
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS read
              FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source),
        c AS (SELECT source, block, (passes + CASE WHEN rest > 0 AND 2 * read + tokens <= 2 * rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM o)
        SELECT d.doc_id, d.source, d.block, d.n_tokens, c.copies
        FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.block = c.block""",
    "op6_trie_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op7_shard_table": f"""
        WITH t(slot, shard) AS (VALUES {_slots()}),
        d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
              (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT % 4099)::INT AS slot
              FROM documents)
        SELECT doc_id, slot, shard, n_bytes FROM d JOIN t USING (slot)""",
    "op12_collocations": f"""
        WITH w AS MATERIALIZED (
            SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
            FROM (SELECT coalesce(lang, 'und') AS lang,
                unnest(string_split_regex({LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
        one AS MATERIALIZED (
            SELECT lang, x, count(*) AS c FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY ALL),
        two AS MATERIALIZED (
            SELECT lang, ws[i] AS x, ws[i + 1] AS y, count(*) AS c
            FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM w) GROUP BY ALL HAVING count(*) >= 10),
        three AS MATERIALIZED (
            SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z, count(*) AS c
            FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM w) GROUP BY ALL HAVING count(*) >= 10),
        longer AS (
            SELECT lang, x, y, max(c) AS c
            FROM (SELECT lang, x, y, c FROM three UNION ALL SELECT lang, y, z, c FROM three) GROUP BY ALL),
        pairs AS (
            SELECT t.lang, t.x || ' ' || t.y AS phrase, t.c AS a, f.c AS l, s.c AS r,
                {_score("t.c", "f.c", "s.c")} AS score
            FROM two t JOIN one f ON t.lang = f.lang AND t.x = f.x JOIN one s ON t.lang = s.lang AND t.y = s.x
            LEFT JOIN longer o ON t.lang = o.lang AND t.x = o.x AND t.y = o.y
            WHERE o.c IS NULL OR 100 * o.c < 50 * t.c),
        cuts AS (
            SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.c AS a, 1 AS k, f.c AS l, s.c AS r,
                {_score("t.c", "f.c", "s.c")} AS score
            FROM three t JOIN one f ON t.lang = f.lang AND t.x = f.x
            JOIN two s ON t.lang = s.lang AND t.y = s.x AND t.z = s.y
            UNION ALL
            SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.c, 2, f.c, s.c, {_score("t.c", "f.c", "s.c")}
            FROM three t JOIN two f ON t.lang = f.lang AND t.x = f.x AND t.y = f.y
            JOIN one s ON t.lang = s.lang AND t.z = s.x),
        best AS (
            SELECT * FROM pairs UNION ALL
            SELECT lang, phrase, a, l, r, score FROM (
                SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts)
            WHERE place = 1),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM ranked JOIN (SELECT lang, sum(c)::BIGINT AS n FROM one GROUP BY lang) USING (lang)
        WHERE rank <= 2000""",
}
