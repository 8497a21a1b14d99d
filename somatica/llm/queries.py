"""Queries and SQL of this subpackage for the driver's entry file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatica.llm import embed_dedup, langid, license_scan, media, merkle, mixing, packing, periodic, pii, simhash, substring, toxicity, urlfilter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents"))


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_components(_read(spark, sf_dir, "embeddings"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_language(_read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"), F.array_join("sentences", ",").alias("sentences"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_read(spark, sf_dir, "documents"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(_read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(_read(spark, sf_dir, "documents"))


#: Host, path and verdict of the rules.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urlfilter.judge(pages, URL_RULES, urlfilter.queried_addresses(pages), by="address")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proof_digests(_read(spark, sf_dir, "documents"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(_read(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_embedding": op2_embedding,
    "op3_langid": op3_langid,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_license": op6_license,
    "op7_media": op7_media,
    "op8_substring": op8_substring,
    "op9_pii": op9_pii,
    "op10_urlfilter": op10_urlfilter,
    "op11_merkle": op11_merkle,
    "op12_periodic": op12_periodic,
    "op13_toxicity": op13_toxicity,
}

_MERKLE_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
# one level of a tree over another until one node is left in each; {key} names the trees
_MERKLE_LEVELS = """SELECT {key}, 0 AS lv, pos, h, n FROM {base} UNION ALL
 SELECT {key}, lv + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY {key}, lv, pos // 3"""

ORACLE_SQL: dict[str, str] = {
    # CRC-32 by its table of 256 entries; trees level by level; the proof of a row lists, for each level, the others of its run
    "op11_merkle": f"""WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, _: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
 rows AS MATERIALIZED (SELECT doc_id, source, sha256({_MERKLE_FIELDS.format(text="text")}) AS leaf, sha256({_MERKLE_FIELDS.format(text="replace(text, chr(10), '')")}) AS cut,
   coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ord(substr(doc_id::VARCHAR, k, 1)))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 2 = 0, FALSE) AS hit FROM documents, crc_table),
 leaves AS MATERIALIZED (SELECT *, leaf AS h, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM rows WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
 own AS ({_MERKLE_LEVELS.format(key="source", base="leaves", name="own")}),
 subs AS (SELECT source, h AS subroot, h, 0 AS root_of, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM own WHERE n = 1),
 upper AS ({_MERKLE_LEVELS.format(key="root_of", base="subs", name="upper")}),
 steps AS (SELECT l.source, l.pos AS leaf_pos, FALSE AS up, o.lv, string_agg(o.h, '' ORDER BY o.pos) FILTER (WHERE o.pos < l.pos // (3 ** o.lv)::BIGINT) AS a, string_agg(o.h, '' ORDER BY o.pos) FILTER (WHERE o.pos > l.pos // (3 ** o.lv)::BIGINT) AS b
    FROM leaves l JOIN own o ON l.source IS NOT DISTINCT FROM o.source AND o.pos // 3 = l.pos // (3 ** (o.lv + 1))::BIGINT WHERE o.n > 1 GROUP BY ALL
   UNION ALL SELECT l.source, l.pos, TRUE, o.lv, string_agg(o.h, '' ORDER BY o.pos) FILTER (WHERE o.pos < s.pos // (3 ** o.lv)::BIGINT), string_agg(o.h, '' ORDER BY o.pos) FILTER (WHERE o.pos > s.pos // (3 ** o.lv)::BIGINT)
    FROM leaves l JOIN subs s ON l.source IS NOT DISTINCT FROM s.source JOIN upper o ON o.pos // 3 = s.pos // (3 ** (o.lv + 1))::BIGINT WHERE o.n > 1 GROUP BY ALL),
 proofs AS MATERIALIZED (SELECT source, leaf_pos AS pos, list({{'a': coalesce(a, ''), 'b': coalesce(b, '')}} ORDER BY up, lv) AS path FROM steps GROUP BY ALL),
 done AS (SELECT l.doc_id, l.leaf, s.subroot, (SELECT h FROM upper WHERE n = 1) AS root, coalesce(p.path, []) AS path, CASE WHEN hit THEN cut ELSE leaf END AS start
   FROM leaves l JOIN subs s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN proofs p ON l.source IS NOT DISTINCT FROM p.source AND l.pos = p.pos),
 folded AS (SELECT doc_id, leaf, subroot, root, path, start AS acc, 1 AS k FROM done UNION ALL SELECT doc_id, leaf, subroot, root, path, sha256(path[k].a || acc || path[k].b), k + 1 FROM folded WHERE k <= len(path))
 SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(path, lambda s: s.a || s.b)), 'string_agg', '')) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM folded WHERE k > len(path)""",
    # all pairs of a label: the query finds its pairs by hashing, so on larger tables it may miss about one in a hundred
    "op2_embedding": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 r AS (SELECT vec_id AS n, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.n),
 c AS (SELECT n AS vec_id, min(root) AS component_id FROM r GROUP BY 1), k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
 SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)""",
    "op10_urlfilter": """WITH p AS (SELECT page_id, url, strpos(url, '://') AS pos FROM pages),
 h AS (SELECT page_id, CASE WHEN pos > 0 THEN translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
   CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p),
 r(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
 b AS (SELECT page_id, rh || rp AS rule, rv FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) = 1),
 f AS (SELECT DISTINCT h.host || h.path AS k FROM h JOIN p USING (page_id) WHERE pos > 0 AND h.host || h.path <> '' AND regexp_matches(substr(url, pos + 3), '^[^#]*\\?'))
 SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN host || path IN (SELECT k FROM f) THEN 'block' ELSE 'allow' END) AS verdict FROM h LEFT JOIN b USING (page_id)""",
}
