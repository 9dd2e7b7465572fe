"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, convnet, decontaminate, langid, lines, media, merkle, neardup, sharding, toxicity, tries, urls, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    """The public word-end BPE file of this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many and which of them are later copies of repeated runs, and the text that stays."""
    found = lines.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return toxicity.severity(documents, toxicity.fit(documents, _read(spark, sf_dir, "labels")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(_read(spark, sf_dir, "documents"), word_vocabulary(), with_ids=False)


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), words=4)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages"))


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_digests(_read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return langid.identify(documents, langid.fit(documents))


def op11_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.rebuilt_trie(_read(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(_read(spark, sf_dir, "documents"))


def op13_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return convnet.quality(documents, convnet.fit(documents, _read(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_superminhash": op5_superminhash,
    "op6_url_filters": op6_url_filters,
    "op7_mpeg_audio": op7_mpeg_audio,
    "op8_decontamination": op8_decontamination,
    "op9_sampled_splitters": op9_sampled_splitters,
    "op10_language_id": op10_language_id,
    "op11_burst_trie": op11_burst_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_byte_convnet": op13_byte_convnet,
}

_LINES = """
WITH l AS (
  SELECT doc_id, CAST(unnest(generate_series(0, len(ls) - 1)) AS INT) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM (SELECT *, len(regexp_extract_all(line, '[^ \t-\r]+')) AS words FROM l) WHERE words > 0),
w AS (
  SELECT a.doc_id, a.i, k, md5(string_agg(b.line, chr(10) ORDER BY b.i)) AS key, list(b.pos ORDER BY b.i) AS places
  FROM n a CROSS JOIN (VALUES (1), (2), (3), (4), (5)) v(k) JOIN n b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + k - 1
  GROUP BY a.doc_id, a.i, k
  HAVING count(*) = k AND sum(b.words) >= 5),
f AS (SELECT k, key, min((doc_id, i)) AS origin FROM w GROUP BY k, key),
cut AS (SELECT DISTINCT w.doc_id, unnest(places) AS pos FROM w JOIN f ON f.k = w.k AND f.key = w.key WHERE (w.doc_id, w.i) <> origin)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(count(c.pos) AS BIGINT) AS n_removed,
  coalesce(string_agg(CAST(c.pos AS VARCHAR), ',' ORDER BY c.pos) FILTER (c.pos IS NOT NULL), '') AS removed_lines,
  md5(coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL), '')) AS kept_md5
FROM l LEFT JOIN cut c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id
"""

_WARC = """
WITH s AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS sha FROM pages),
m AS (SELECT sha, max(page_id) AS newest FROM s GROUP BY sha)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(s.sha, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM s JOIN m ON m.sha = s.sha
"""

_NEAR = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM t),
e AS (SELECT doc_id, len(sh) AS n, hash(g) AS g FROM (SELECT doc_id, sh, unnest(sh) AS g FROM s)),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c WHERE 100 * n >= 80 * (na + nb - n)),
linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, sh
"""

#: The unsigned CRC-32 of a text in ASCII, byte by byte: each byte is one step of eight shifts by the reversed polynomial.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen({x}) + 1), lambda i: ascii(substr({x}, i, 1))::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))"""


def crc32_sql(x: str) -> str:
    return f"xor({_CRC.format(x=x)}, 4294967295)"


def merkle_sql(levels: int = 6) -> str:
    """The manifest by `levels` levels of runs for groups and for subroots: enough for 16 ** levels nodes."""
    leaf = "sha256(concat(" + ", ".join(f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', {c}), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + "))"
    steps = []
    for tree, first, group in (("a", "leaves", "grp"), ("b", "tops", "one")):
        last = first
        for k in range(levels):
            steps.append(f"{tree}{k} AS (SELECT {group}, p // 16 AS p, any_value(n) > 1 AS more, (any_value(n) + 15) // 16 AS n, list(h ORDER BY p) AS run, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h FROM {last} GROUP BY {group}, p // 16)")
            last = f"{tree}{k}"
        if tree == "a":
            steps.append(f"tops AS (SELECT 1 AS one, grp, h, row_number() OVER (ORDER BY grp) - 1 AS p, count(*) OVER () AS n FROM {last})")
    joins, proof, fold = [], [], "l.changed"
    for tree, at in (("a", "l.p"), ("b", "t.p")):
        if tree == "b":
            joins.append("JOIN tops t ON t.grp = l.grp")
        for k in range(levels):
            t, i = f"{tree}{k}", f"({at} // {16 ** k}) % 16"
            joins.append(f"JOIN {t} ON {t}.{'grp = l.grp' if tree == 'a' else 'one = 1'} AND {t}.p = {at} // {16 ** (k + 1)}")
            left, right = f"array_to_string({t}.run[1:CAST({i} AS INT)], '')", f"array_to_string({t}.run[CAST({i} AS INT) + 2:], '')"
            proof.append(f"CASE WHEN {t}.more THEN {left} || {right} ELSE '' END")
            joins.append(f"CROSS JOIN LATERAL (SELECT CASE WHEN {t}.more THEN sha256({left} || {fold} || {right}) ELSE {fold} END AS h) f{t}")
            fold = f"f{t}.h"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {leaf.format(text='text')} AS h, {leaf.format(text=lowered)} AS low, CAST(doc_id AS VARCHAR) AS x FROM documents),
leaves AS (SELECT doc_id, grp, h, CASE WHEN {crc32_sql('x')} % 5 = 0 THEN low ELSE h END AS changed,
  row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY grp) AS n FROM d),
{", ".join(steps)},
r AS MATERIALIZED (SELECT l.doc_id, l.h AS leaf, t.h AS subroot, b{levels - 1}.h AS root, sha256({' || '.join(proof)}) AS proof_sha256, {fold} AS folded_root
  FROM leaves l {" ".join(joins)})
SELECT *, folded_root = root AS verified FROM r
"""


_TRIE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM (SELECT DISTINCT conv_id FROM t)),
c AS (SELECT c, c - c % 20 AS b, {crc32_sql('s')} % 4 AS h FROM i),
q AS (SELECT c, 0 AS part, pos, r, x FROM c JOIN t ON t.conv_id = b AND pos < h UNION ALL SELECT c, 1, pos, r, x FROM c JOIN t ON t.conv_id = c AND pos >= h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, sha256(concat(strlen(r), ':', r, x)) AS k, len(regexp_extract_all(x, '[^ \\t-\\r]+')) AS words FROM q),
p AS (SELECT c, d, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS k, words FROM s UNION ALL SELECT c, 0, '', 0 FROM c),
n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY d, k),
m AS (SELECT p.c, p.d, n.conv_id, n.n_convs, n.words FROM p JOIN n ON n.d = p.d AND n.k = p.k),
k AS (SELECT n.conv_id, n.d, n.n_convs, n.words, a.conv_id AS parent_conv_id FROM n LEFT JOIN m a ON a.c = n.conv_id AND a.d = n.d - 1),
f AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n_children FROM k WHERE d > 0 GROUP BY ALL),
g AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN f ON f.conv_id = k.conv_id AND f.d = k.d),
u AS (SELECT a.conv_id, a.d, count(*) FILTER (g.n_children = 0) AS n_leaves, sum((g.n_convs - 1) * g.words) AS saved_tokens FROM g JOIN m a ON a.c = g.conv_id AND a.d <= g.d GROUP BY a.conv_id, a.d),
e AS (SELECT conv_id, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY c) AS most FROM m) WHERE d = most GROUP BY conv_id, d)
SELECT g.conv_id, g.d AS depth, g.parent_conv_id, g.n_convs, CAST(g.n_children AS BIGINT) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM g JOIN u ON u.conv_id = g.conv_id AND u.d = g.d LEFT JOIN e ON e.conv_id = g.conv_id AND e.d = g.d
"""

#: The other queries rest on learned models, checksums or edit distances that SQL doesn't have.
ORACLES: dict[str, str] = {"op1_line_dedup": _LINES, "op2_warc": _WARC, "op5_superminhash": _NEAR, "op11_burst_trie": _TRIE, "op12_merkle_manifest": merkle_sql()}
