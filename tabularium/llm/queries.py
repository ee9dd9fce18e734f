"""Registered queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_planes, chosen_path, decontaminate, html_extract, language_id, line_spread, nn_descent, packing, ppm, repeats, token_counts, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op2_ppm_scores")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, i, s[i] AS line, trim(s[i], ' ' || chr(9) || chr(13)) AS bare
    FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), unnest(range(1, len(s) + 1)) AS q(i)),
b AS (SELECT bare, min(doc_id) AS first_id FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= 10),
k AS (SELECT doc_id, i, line, b.bare IS NULL OR doc_id = first_id AS stays FROM l LEFT JOIN b USING (bare)),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed FROM k GROUP BY doc_id)
SELECT doc_id, t.text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed FROM documents LEFT JOIN t USING (doc_id)"""


@query("op3_line_spread", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query("op4_nn_descent")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_trie_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op6_harmonic_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op7_site_templates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


OP8_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS sh FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS q(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = doc_id"""


@query("op8_chosen_path_near_duplicates", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents")).drop("key_a", "key_b")


# a window of an item occurs in a text where its words, joined and framed by spaces, are a part of the text's
OP9_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
    FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0),
runs AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM d, (SELECT DISTINCT n FROM wins), unnest(range(1, len(w) - n + 2)) AS r(i)),
met AS (SELECT doc_id, i, runs.n, item_id FROM runs JOIN wins ON runs.n = wins.n AND runs.win = wins.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM met, unnest(range(i, i + n)) AS q(p) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query("op9_winnowing_decontamination", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.verdict(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4)))::INT & 31) + 1, 1) for i in range(32)], '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""


@query("op10_warc_normaliser", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_shifted_cholesky_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def bit_plane_sql(rounds: int = 10, k: int = 8) -> str:
    """Assignments and moves spelled out round by round."""
    steps = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)""",
             "u AS MATERIALIZED (SELECT vec_id, d, x[d] AS x FROM v, range(1, 65) AS q(d))",
             f"""c0 AS MATERIALIZED (SELECT k, d, x[d] AS c FROM (SELECT x, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM v
    ORDER BY sha256('3:' || vec_id) LIMIT {k}), range(1, 65) AS q(d))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, arg_min(k, far * {k} + k) AS k, min(far)::BIGINT AS distance
    FROM (SELECT vec_id, k, sum((x - c) * (x - c)) AS far FROM u JOIN c{r} USING (d) GROUP BY vec_id, k) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT k, d, coalesce(m.c, p.c)::BIGINT AS c FROM c{r} AS p LEFT JOIN (SELECT k, d, (s - ((s % n) + n) % n) // n AS c
    FROM (SELECT k, d, sum(x) AS s, count(*) AS n FROM u JOIN a{r} USING (vec_id) GROUP BY k, d)) AS m USING (k, d))""")
    return f"""WITH {", ".join(steps)}, h AS (SELECT k, sha256(string_agg(c, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (k)"""


@query("op12_bit_plane_clusters", bit_plane_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_planes.cluster(table(spark, sf_dir, "embeddings"))


# hexadecimal digits keep bytes apart; two digits a byte
OP13_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 800)) AS g FROM d, unnest(range(0, n - 399)) AS q(p)),
m AS (SELECT doc_id, p FROM w JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, coalesce((p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 400)::INT, 1) AS new FROM m)),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b FROM i GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM s),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS before FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(from_hex(coalesce(before, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""


@query("op13_deep_shallow_repeats", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed")
    return found.select("doc_id", "n_bytes", removed, F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
