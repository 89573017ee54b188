"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import exact_dedup as _exact
from docloom.llm import fingerprints as _fingerprints
from docloom.llm import jaccard_join as _jaccard
from docloom.llm import merkle as _merkle
from docloom.llm import mixing as _mixing
from docloom.llm import packing as _packing
from docloom.llm import paragraphs as _paragraphs
from docloom.llm import quality as _quality
from docloom.llm import resampling as _resampling
from docloom.llm import secrets as _secrets
from docloom.llm import suffix_dedup as _suffix
from docloom.llm import urls as _urls
from docloom.llm import warc as _warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.packed_digests(_table(spark, sf_dir, "documents"))


def op8_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _paragraphs.cut_paragraphs(_table(spark, sf_dir, "documents"), digest=True)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "partners", F.lower(F.hex("kept")).alias("kept_sha256"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls.url_verdicts(_table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _suffix.remove_repeats(_table(spark, sf_dir, "documents"), digest=True)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merkle.tamper_test(_table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.secret_digests(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_paragraphs": op8_paragraphs,
    "op9_url_filters": op9_url_filters,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_secret_scan": op12_secret_scan,
    "op13_importance_resampling": op13_importance_resampling,
}


def _crc32_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, bit by bit."""
    byte = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
    bits = "list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda a, k: xor(a >> 1, (a & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: {bits}), 4294967295)"


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _merkle_sql(levels: int = 7) -> str:
    """Levels of runs of 16, for up to 16 ** 7 rows a source and sources."""

    def told(column: str) -> str:
        return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"

    def tree(name: str, base: str) -> str:
        """CTEs of the nodes of each level: grp, place, node, n (nodes of the group's level)."""
        ctes = [f"{name}0 AS MATERIALIZED (SELECT grp, place, node, count(*) OVER (PARTITION BY grp) AS n FROM {base})"]
        for k in range(levels):
            up = f"SELECT grp, place // 16 AS place, sha256(string_agg(node, '' ORDER BY place)) AS node FROM {name}{k} WHERE n > 1 GROUP BY grp, place // 16"
            ctes.append(f"{name}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM ({up}))")
        tops = " UNION ALL ".join(f"SELECT grp, node FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
        return ",\n".join([*ctes, f"{name}_top AS MATERIALIZED ({tops})"])

    def steps(name: str, rows: str, out: str) -> str:
        """CTEs that take rows (place in the tree, siblings so far, node to fold) up to the top of their group."""
        ctes, last = [], rows
        for k in range(levels):
            run = f"SELECT grp, place // 16 AS run, list(node ORDER BY place) AS nodes, first(n) AS n FROM {name}{k} GROUP BY grp, place // 16"
            at = "(r.place % 16)::INT"
            many = "t.n > 1"
            ctes.append(f"""{out}{k} AS MATERIALIZED (SELECT r.* REPLACE (
  CASE WHEN {many} THEN r.proof || array_to_string(list_concat(t.nodes[1:{at}], t.nodes[{at} + 2:]), '') ELSE r.proof END AS proof,
  CASE WHEN {many} THEN sha256(array_to_string(list_concat(t.nodes[1:{at}], [r.fold], t.nodes[{at} + 2:]), '')) ELSE r.fold END AS fold,
  r.place // 16 AS place) FROM {last} r LEFT JOIN ({run}) t ON r.grp IS NOT DISTINCT FROM t.grp AND r.place // 16 = t.run)""")
            last = f"{out}{k}"
        return ",\n".join(ctes)

    values = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = " || ".join(told("low" if v == "text" else v) for v in values)
    return f"""
WITH hashed AS (SELECT doc_id, source AS grp, sha256({" || ".join(map(told, values))}) AS leaf,
  CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN sha256({changed}) END AS changed
  FROM (SELECT *, CASE WHEN text IS NOT NULL THEN {_FOLDED} END AS low FROM documents)),
leaves AS MATERIALIZED (SELECT doc_id, grp, leaf, leaf AS node, coalesce(changed, leaf) AS fold, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
{tree("a", "leaves")},
subs AS MATERIALIZED (SELECT grp AS source, node AS subroot, node, 1 AS grp, row_number() OVER (ORDER BY encode(grp) NULLS FIRST) - 1 AS place FROM a_top),
{tree("b", "subs")},
lower0 AS (SELECT doc_id, grp, leaf, place, '' AS proof, fold FROM leaves),
{steps("a", "lower0", "up")},
upper0 AS (SELECT u.doc_id, u.leaf, s.subroot, u.proof, u.fold, s.grp, s.place FROM up{levels - 1} u JOIN subs s ON u.grp IS NOT DISTINCT FROM s.source),
{steps("b", "upper0", "over")}
SELECT o.doc_id, o.leaf, o.subroot, r.node AS root, sha256(o.proof) AS proof_sha256, o.fold AS folded_root, o.fold = r.node AS verified
FROM over{levels - 1} o, b_top r
"""


def _secrets_sql() -> str:
    """Places of matches from the lengths of what stands between them."""
    either = lambda p: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in p)
    assign = f"""({"|".join(map(either, ("password", "passwd", "secret", "token")))}|{either("api_?key")})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    parts = []
    for place, rule in enumerate(_secrets.RULES):
        pattern = assign if rule.fold else rule.pattern.replace("'", "''")
        parts.append(f"""SELECT id, {place} AS place, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {rule.group}) AS part, string_split_regex(text, '{pattern}') AS gaps FROM t""")
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT id, place, kind, least, gaps, found, part, unnest(range(1, len(found) + 1)) AS k FROM m WHERE len(found) > 0),
w AS (SELECT id, place, kind, len(found[k]) AS size, len(part[k]) >= least AS good,
  list_sum(list_transform(gaps[1:k], lambda g: len(g))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda g: len(g))), 0) AS start FROM e),
s AS (SELECT id, kind, place, start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM w WHERE good),
g AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY start, place) AS spans FROM s GROUP BY id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (id)
"""


def _resampling_sql() -> str:
    def counted(table: str) -> str:
        return f"SELECT row_number() OVER () AS id, *, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM {table}"

    return f"""
WITH d AS MATERIALIZED ({counted("documents")}),
f AS MATERIALIZED (SELECT id, unnest(words) AS feature FROM d),
b AS (SELECT unnest(words) AS feature FROM ({counted("benchmark")})),
names AS MATERIALIZED (SELECT feature, {_crc32_sql("feature")} % 10000 AS bucket FROM (SELECT feature FROM f UNION SELECT feature FROM b)),
s AS (SELECT bucket, count(*) AS s FROM f JOIN names USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN names USING (feature) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT id, sum(gain)::BIGINT AS weight FROM f JOIN names USING (feature) JOIN gains USING (bucket) GROUP BY id),
x AS (SELECT id, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (id)),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM x LEFT JOIN r USING (id)
"""


ORACLE_SQL = {
    "op2_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
""",
    "op6_warc": """
WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS original FROM t WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT t.page_id, t.payload_bytes, t.payload_digest,
       CASE WHEN g.original IS NOT NULL AND g.original <> t.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.original <> t.page_id THEN g.original END AS refers_to
FROM t LEFT JOIN g ON t.payload_digest = g.payload_digest AND t.payload_bytes = g.payload_bytes
""",
    "op11_merkle_manifest": _merkle_sql(),
    "op12_secret_scan": _secrets_sql(),
    "op13_importance_resampling": _resampling_sql(),
}
