"""Queries op1 to op10 over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, hmm, linededup, minmax, mixing, quality, secrets, urlfilter, wordpiece
from .shared import ship

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

URL_RULES = [
    urlfilter.Rule.parse("block", "com/en/"),
    urlfilter.Rule.parse("allow", "example.com/en/7"),
    urlfilter.Rule.parse("allow", "net/de/"),
    urlfilter.Rule.parse("block", "example.net/de/8"),
    urlfilter.Rule.parse("block", "org/es/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_columns(docs: DataFrame) -> DataFrame:
    kept = linededup.dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_columns(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, with_ids=False, space_led=True)


def op4_columns(docs: DataFrame) -> DataFrame:
    def joined(spans: F.Column) -> F.Column:
        return F.concat_ws(",", F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = [r.kind for r in secrets.BASE_RULES]
    found = secrets.scan_secrets(docs)
    base_spans = F.filter("findings", lambda f: f["kind"].isin(*base))
    return found.select("doc_id", *map(count, base), F.sha2(joined(base_spans), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_columns(_table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op8_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return hmm.score_documents(_table(spark, sf_dir, "documents"), held_out)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(bpe.read_vocabulary(VOCABULARY))
    return wordpiece.count_pieces(_table(spark, sf_dir, "documents"), *wordpiece.split_vocabulary(ranks))


def op10_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_secret_scan": op4_secret_scan,
    "op5_nearest": op5_nearest,
    "op6_quality_rules": op6_quality_rules,
    "op7_source_mix": op7_source_mix,
    "op8_hmm_score": op8_hmm_score,
    "op9_token_counts": op9_token_counts,
    "op10_minmax_dedup": op10_minmax_dedup,
}

_URL_PARTS = """
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
    FROM (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
                               ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages)
"""

_SPACE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES_SQL = f"""
    l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM docs),
    k AS (SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS key FROM l),
    hot AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {linededup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {linededup.MIN_DOCS}),
    marked AS (SELECT doc_id, line, pos, coalesce(doc_id < last, false) AS gone FROM k LEFT JOIN hot USING (key)),
    kept_lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                          coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
"""

NEAR_SQL = f"""
    w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM docs),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
    sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {minmax.PERCENT} * (a.n + b.n - count(*))),
    reach(u, v) AS (SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
    near AS (SELECT sets.doc_id, len(s) AS n_shingles, least(sets.doc_id, coalesce(min(reach.v), sets.doc_id)) AS component_id
             FROM sets LEFT JOIN reach ON reach.u = sets.doc_id GROUP BY sets.doc_id, len(s))
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH docs AS (SELECT doc_id, text FROM documents), {LINES_SQL}
        SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept_lines
    """,
    "op10_minmax_dedup": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), {NEAR_SQL}
        SELECT doc_id, n_shingles, component_id, component_id = doc_id AS kept FROM near
    """,
    "op2_url_filter": f"""
        WITH parts AS ({_URL_PARTS}),
        rules(rule_host, rule_path, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                                                  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        fits AS (
            SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   max_by(v, length(rule_host || rule_path)) AS v
            FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
    """,
}
