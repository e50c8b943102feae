"""One query per operator over its whole table, and the SQL that some of them can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm import byte_bpe, decontaminate, embedding_dedup, hmm_lm, line_dedup, merkle, near_dedup, periodic_runs, quality, secrets, suffix_dedup, token_store, url_rules
from cataloom.session import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    names = {"host": "__host", "path": "__path", "doc_score": "__doc_score", "host_rate": "__host_rate", "path_rate": "__path_rate", "posterior": "__posterior", "keep": "__keep"}
    return judged.select("doc_id", *[F.col(c).alias(n) for n, c in names.items()])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN).drop("same")


def op5_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.through_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed"), "text")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_texts(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.audit(table(spark, sf_dir, "documents"), changed={"text": F.translate("text", letters, letters.lower())}, where=tampered)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_repeats(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.find_runs(docs))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge(pages, url_rules.labels_of_pages(pages, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_store": op5_store,
    "op6_lines": op6_lines,
    "op7_embeddings": op7_embeddings,
    "op8_decontaminate": op8_decontaminate,
    "op9_suffix": op9_suffix,
    "op10_hmm": op10_hmm,
    "op11_manifest": op11_manifest,
    "op12_runs": op12_runs,
    "op13_urls": op13_urls,
}

#: Checksum of a document's number, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce(list_concat([xor(s, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""


def _part(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_part(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Both tiers of the tree as recursive unions over levels; a row's path is joined level by level and folded as a list.
_MANIFEST = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, {_leaf("text")} AS leaf,
        CASE WHEN {_CRC} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS shown
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes AS (
    SELECT tree, 0 AS level, pos, leaf AS digest, n FROM placed
    UNION ALL
    SELECT tree, any_value(level) + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), any_value(n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, pos // 8
), subroots AS (
    SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
    SELECT 0 AS level, pos, subroot AS digest, n FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), any_value(n + 7) // 8 FROM upper WHERE n > 1 GROUP BY pos // 8
), steps AS (
    SELECT p.doc_id, p.leaf, s.level, s.pos < p.pos // (8 ** s.level)::BIGINT AS is_left, s.pos, s.digest
    FROM placed p JOIN nodes s ON s.tree = p.tree AND s.pos // 8 = p.pos // (8 ** (s.level + 1))::BIGINT AND s.pos <> p.pos // (8 ** s.level)::BIGINT
    UNION ALL
    SELECT p.doc_id, p.leaf, 100 + s.level, s.pos < r.pos // (8 ** s.level)::BIGINT, s.pos, s.digest
    FROM placed p JOIN subroots r ON r.tree = p.tree JOIN upper s ON s.pos // 8 = r.pos // (8 ** (s.level + 1))::BIGINT AND s.pos <> r.pos // (8 ** s.level)::BIGINT
), levels AS (
    SELECT doc_id, leaf, level, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (is_left), '') AS lefts, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (NOT is_left), '') AS rights
    FROM steps GROUP BY doc_id, leaf, level
    UNION ALL  -- a run of one has no siblings, but is a level too
    SELECT p.doc_id, p.leaf, s.level, '', '' FROM placed p JOIN nodes s ON s.tree = p.tree AND s.pos = p.pos // (8 ** s.level)::BIGINT
    WHERE s.n > 1 AND s.n % 8 = 1 AND s.pos = s.n - 1
    UNION ALL
    SELECT p.doc_id, p.leaf, 100 + s.level, '', '' FROM placed p JOIN subroots r ON r.tree = p.tree JOIN upper s ON s.pos = r.pos // (8 ** s.level)::BIGINT
    WHERE s.n > 1 AND s.n % 8 = 1 AND s.pos = s.n - 1
), paths AS (
    SELECT doc_id, leaf, string_agg(lefts || rights, '' ORDER BY level) AS siblings, list({{'l': lefts, 'r': rights}} ORDER BY level) AS path FROM levels GROUP BY doc_id, leaf
), folded AS (
    SELECT p.doc_id, p.leaf, r.subroot, (SELECT digest FROM upper WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
        list_reduce(list_concat([{{'l': p.shown, 'r': ''}}], coalesce(path, [])), lambda d, x: {{'l': sha256(x.l || d.l || x.r), 'r': ''}}).l AS folded_root
    FROM placed p JOIN subroots r ON r.tree = p.tree LEFT JOIN paths w ON w.doc_id = p.doc_id AND w.leaf = p.leaf
)
SELECT *, folded_root = root AS verified FROM folded
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST, _PATH = _LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')"), "coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"


def _marks(kind: str, parts: str) -> str:
    return f"list_transform({parts}, lambda t: '{kind}' || regexp_replace({_LOWER.format('t')}, '[0-9]+', '#', 'g'))"


def _some(parts: str) -> str:
    return f"list_filter({parts}, lambda t: t <> '')"


_KEYS = f"list_transform({_some("string_split(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '&')")}, lambda t: split_part(t, '=', 1))"
_TOKENS = " || ".join(
    [_marks("h:", _some(f"string_split_regex({_HOST}, '[.-]')")), _marks("p:", _some(f"string_split({_PATH}, '/')")), _marks("q:", _KEYS), _marks("s:", "[split_part(url, '://', 1)]")]
)

#: Every combination of the items of every labelled page is counted, instead of mined; every rule is tried on every URL.
_URLS = f"""
WITH labelled AS (
    SELECT row_number() OVER () AS page, label, tokens FROM (
        SELECT CASE WHEN toxic = 1 OR quality = 0 THEN 'block' WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 'allow' END AS label,
            CASE WHEN {_HOST} = '' THEN [] ELSE list_distinct({_TOKENS}) END AS tokens
        FROM pages JOIN labels ON doc_id = page_id) WHERE label IS NOT NULL AND len(tokens) > 0
), least AS (
    SELECT count(*) AS n, ceil(greatest(0.002 * count(*), 8)) AS least FROM labelled
), items AS (
    SELECT list_sort(list(token)) AS needed, list_sort(list(token))[1] AS item
    FROM (SELECT token, list(page ORDER BY page) AS places FROM (SELECT page, unnest(tokens) AS token FROM labelled) GROUP BY token)
    WHERE len(places) >= (SELECT least FROM least) GROUP BY places
), held AS (
    SELECT page, any_value(label) AS label, coalesce(list(item ORDER BY item) FILTER (item IS NOT NULL), []) AS held
    FROM (SELECT page, label, unnest(tokens) AS token FROM labelled) LEFT JOIN items ON token = item GROUP BY page
), combined AS (
    SELECT label, list_filter(held, lambda t, i: (mask >> (i - 1)) & 1 = 1) AS antecedent FROM (SELECT label, held, unnest(range(0, 1 << len(held))) AS mask FROM held)
), rates AS (
    SELECT label, antecedent, hits, hits / sum(hits) OVER (PARTITION BY antecedent) AS confidence FROM (SELECT label, antecedent, count(*) AS hits FROM combined GROUP BY ALL)
), strong AS (
    SELECT r.* FROM rates r JOIN rates base ON base.label = r.label AND len(base.antecedent) = 0
    WHERE len(r.antecedent) > 0 AND r.hits >= (SELECT least FROM least) AND r.confidence >= 0.5 AND r.confidence > base.confidence
), shorter AS (
    SELECT label, antecedent, confidence, list_filter(antecedent, lambda t: t <> out) AS fewer FROM (SELECT *, unnest(antecedent) AS out FROM strong)
), beaten AS (
    SELECT DISTINCT s.label, s.antecedent FROM shorter s JOIN rates r ON r.label = s.label AND r.antecedent = s.fewer WHERE r.confidence >= s.confidence
), rules AS (
    SELECT label, hits, confidence, list_sort(flatten(list(needed))) AS needed
    FROM (SELECT label, antecedent, hits, confidence, unnest(antecedent) AS item FROM strong ANTI JOIN beaten USING (label, antecedent)) JOIN items USING (item)
    GROUP BY label, antecedent, hits, confidence
), split AS (
    SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages
), listed AS (
    SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
    FROM split
), asked AS (
    SELECT DISTINCT url, CASE WHEN host = '' THEN [] ELSE {_TOKENS} END AS tokens FROM listed WHERE rule IS NULL AND url IS NOT NULL
), learned AS (
    SELECT url, label, confidence, array_to_string(needed, ' ') AS mined,
        row_number() OVER (PARTITION BY url ORDER BY confidence DESC, hits DESC, len(needed), array_to_string(needed, ' '), label) AS nth
    FROM asked JOIN rules ON list_has_all(tokens, needed)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE coalesce(label, 'allow') END AS verdict, mined, confidence
FROM listed LEFT JOIN learned ON learned.url = listed.url AND nth = 1 AND rule IS NULL
"""

ORACLES: dict[str, str] = {"op11_manifest": _MANIFEST, "op13_urls": _URLS}
