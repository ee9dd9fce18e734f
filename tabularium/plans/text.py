"""Text and privacy queries over whole documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import privacy as V
from ..operators import text as N
from .registry import Tables, query

TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    "n01_text_columns",
    """SELECT 'text' AS "column", avg(length(text)) AS average_length, avg(length(text)) > 20 AS is_text FROM documents
    UNION ALL SELECT 'lang', avg(length(lang)), avg(length(lang)) > 20 FROM documents UNION ALL SELECT 'source', avg(length(source)), avg(length(source)) > 20 FROM documents""",
    floats="average_length",
    digits=4,
)
def _(t: Tables):
    return N.text_columns(t.documents)


@query(
    "n02_language_rows",
    r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\x{0600}-\x{06FF}]', '', 'g')) / nullif(length(text), 0)::DOUBLE > 0.3 THEN 'ar' ELSE 'en' END AS language FROM documents""",
)
def _(t: Tables):
    return N.detect_language(t.documents, "text").select("doc_id", "language")


@query(
    "n02_corpus_language",
    r"""SELECT count(*) AS texts, round(avg(length(text)), 2) AS average_length,
    sum(length(regexp_replace(text, '[^\x{0600}-\x{06FF}]', '', 'g'))) / (sum(length(text)) + count(*) - 1)::DOUBLE AS arabic_share, 'en' AS language FROM documents""",
    floats="arabic_share",
)
def _(t: Tables):
    return N.corpus_language(t.documents, "text")


@query("n03_tokens", f"SELECT conv_id, turn, array_to_string({TOKENS}, ' ') AS tokens FROM conversations")
def _(t: Tables):
    made = N.tokenise(t.conversations, "text")
    return made.select("conv_id", "turn", F.concat_ws(" ", "tokens").alias("tokens"))


WORDS = f"""SELECT word, count(*) AS count FROM (SELECT unnest({TOKENS}) AS word FROM documents)
    WHERE length(word) > 2 AND NOT list_contains({sql_list(lexicon.STOP_EN)}, word) GROUP BY 1 ORDER BY 2 DESC, 1"""


@query("n04_word_counts", f"{WORDS} LIMIT 50")
def _(t: Tables):
    return N.word_counts(t.documents, "text")


@query(
    "n05_sentiment_rows",
    f"""SELECT conv_id, turn, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment FROM (
    SELECT conv_id, turn, len(list_intersect({TOKENS}, {sql_list(lexicon.POSITIVE_EN)})) AS p, len(list_intersect({TOKENS}, {sql_list(lexicon.NEGATIVE_EN)})) AS n FROM conversations)""",
)
def _(t: Tables):
    return N.with_sentiment(t.conversations, "text").select("conv_id", "turn", "sentiment")


@query(
    "n05_sentiment_summary",
    f"""WITH s AS (SELECT len(list_intersect({TOKENS}, {sql_list(lexicon.POSITIVE_EN)})) AS p, len(list_intersect({TOKENS}, {sql_list(lexicon.NEGATIVE_EN)})) AS n FROM documents)
    SELECT count(*) FILTER (p > n) AS positive, count(*) FILTER (n > p) AS negative, count(*) FILTER (n = p) AS neutral,
    round(count(*) FILTER (p > n) * 100.0::DOUBLE / count(*), 1) AS positive_pct, round(count(*) FILTER (n > p) * 100.0::DOUBLE / count(*), 1) AS negative_pct FROM s""",
)
def _(t: Tables):
    return N.sentiment_summary(t.documents, "text")


@query("n06_topics", f"{WORDS} LIMIT 10")
def _(t: Tables):
    return N.topics(t.documents, "text")


@query(
    "n07_clean_text",
    r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\p{Nd}+', '', 'g'), '\s+', ' ', 'g')) AS text FROM conversations""",
)
def _(t: Tables):
    return N.clean_text(t.conversations, "text").select("conv_id", "turn", "text")


@query(
    "n07_clean_text_ascii",
    r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z\s]', '', 'g'), '\s+', ' ', 'g')) AS text FROM conversations""",
)
def _(t: Tables):
    return N.clean_text(t.conversations, "text", ascii_only=True).select("conv_id", "turn", "text")


def _tfidf_sql(table: str, key: str, features: int | None, pairs: bool) -> str:
    words = f"list_filter({TOKENS}, lambda w: length(w) >= 2 AND NOT list_contains({sql_list(lexicon.STOP_EN)}, w))"
    grams = "w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])" if pairs else "w"
    keep = f"ORDER BY total DESC, term LIMIT {features}" if features else ""
    return f"""WITH d AS (SELECT {key}, {words} AS w FROM {table}), c AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({grams}) AS term FROM d) GROUP BY 1, 2),
    v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1 {keep}),
    r AS (SELECT {key}, term, tf, df, tf * (ln((1.0 + (SELECT count(*) FROM {table})) / (1 + df)) + 1) AS raw FROM c JOIN v USING (term))
    SELECT {key}, term, tf, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS weight FROM r"""


@query("n08_tfidf", _tfidf_sql("documents", "doc_id", 500, True), floats="weight")
def _(t: Tables):
    return N.tfidf(t.documents, "doc_id", "text", ngrams=2, max_features=500)


@query("n08_tfidf_full_vocabulary", _tfidf_sql("pages_text", "page_id", None, False).replace("pages_text", "(SELECT page_id, html AS text FROM pages)"), floats="weight")
def _(t: Tables):
    return N.tfidf(t.pages, "page_id", "html")


@query(
    "n09_top_terms_by_class",
    f"""WITH w AS ({_tfidf_sql('documents', 'doc_id', 500, False)}), s AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1),
    m AS (SELECT quality, term, sum(weight) / any_value(n) AS mean_weight FROM w JOIN labels USING (doc_id) JOIN s USING (quality) GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY quality ORDER BY round(mean_weight, 9) DESC, term)::INTEGER AS rank FROM m QUALIFY rank <= 10""",
    floats="mean_weight",
)
def _(t: Tables):
    weights = N.tfidf(t.documents, "doc_id", "text", max_features=500)
    return N.top_terms_by_class(weights, t.labels.select("doc_id", "quality"), "doc_id", "quality")


def pattern(name: str) -> str:
    return V.PII_PATTERNS[name].replace("'", "''")


@query(
    "v01_detect_pii",
    "SELECT doc_id, " + ", ".join(f"array_to_string(regexp_extract_all(text, '{pattern(n)}'), ';') AS {n}" for n in V.PII_PATTERNS) + " FROM documents",
)
def _(t: Tables):
    found = V.detect_pii(t.documents, "text")
    return found.select("doc_id", *[F.concat_ws(";", F.coalesce(F.try_element_at("pii", F.lit(n)), F.array())).alias(n) for n in V.PII_PATTERNS])


@query(
    "v02_scan_pii",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{n}' AS type, count(*) AS rows FROM {tab} WHERE regexp_matches({c}, '{pattern(n)}') HAVING count(*) > 0"""
        for tab, cols in (("documents", ["text", "lang", "source"]),)
        for c in cols
        for n in V.PII_PATTERNS
    ),
)
def _(t: Tables):
    return V.scan_pii(t.documents, ["text", "lang", "source"])


def _mask_sql(c: str) -> str:
    out = c
    for n in V.PII_PATTERNS:
        out = f"regexp_replace({out}, '{pattern(n)}', '[{n.upper()}_MASKED]', 'g')"
    return out


@query("v03_mask_pii", f"SELECT doc_id, {_mask_sql('text')} AS text FROM documents")
def _(t: Tables):
    return V.mask_pii(t.documents, "text").select("doc_id", "text")


@query("v03_mask_email", f"SELECT doc_id, regexp_replace(text, '{pattern('email')}', '[EMAIL_MASKED]', 'g') AS text FROM documents")
def _(t: Tables):
    return V.mask_pii(t.documents, "text", "email").select("doc_id", "text")


@query("v04_hash", "SELECT c_custkey, left(sha256('default_salt' || c_name), 16) AS c_name FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", V.hashed("c_name").alias("c_name"))


@query(
    "v05_age_bands",
    """SELECT p_partkey, CASE WHEN a > 0 AND a <= 18 THEN '0-18' WHEN a > 18 AND a <= 30 THEN '18-30' WHEN a > 30 AND a <= 50 THEN '30-50'
    WHEN a > 50 AND a <= 70 THEN '50-70' WHEN a > 70 AND a <= 100 THEN '70-100' END AS age FROM (SELECT p_partkey, p_size * 2 + p_partkey % 9 AS a FROM part)""",
)
def _(t: Tables):
    aged = t.part.select("p_partkey", (F.col("p_size") * 2 + F.col("p_partkey") % 9).alias("age"))
    return V.generalise_age(aged, "age")


@query("v06_location", "SELECT n_nationkey, left(n_name, 3) || '***' AS n_name FROM nation")
def _(t: Tables):
    return t.nation.select("n_nationkey", V.generalise_location("n_name").alias("n_name"))


@query(
    "v07_k_anonymity",
    """SELECT c_custkey, CASE WHEN n < 12 THEN '*' ELSE c_nationkey::VARCHAR END AS c_nationkey, CASE WHEN n < 12 THEN '*' ELSE c_mktsegment END AS c_mktsegment
    FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer)""",
)
def _(t: Tables):
    return V.k_anonymise(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], 12)


@query(
    "v08_anonymise",
    f"""SELECT doc_id, left(sha256('pepper' || source), 16) AS source, {_mask_sql('text')} AS text,
    CASE WHEN n_chars % 90 > 0 AND n_chars % 90 <= 18 THEN '0-18' WHEN n_chars % 90 > 18 AND n_chars % 90 <= 30 THEN '18-30' WHEN n_chars % 90 > 30 AND n_chars % 90 <= 50 THEN '30-50'
    WHEN n_chars % 90 > 50 AND n_chars % 90 <= 70 THEN '50-70' WHEN n_chars % 90 > 70 THEN '70-100' END AS age FROM documents""",
)
def _(t: Tables):
    df = t.documents.withColumn("age", F.col("n_chars") % 90).drop("n_chars")
    config = {"source": "hash", "lang": "drop", "text": "mask", "age": "generalize", "absent": "hash"}
    return V.anonymise(df, config, salt="pepper")


@query(
    "v09_clipped_means",
    """SELECT c_mktsegment, count(*) AS n, avg(least(greatest(c_acctbal, 0), 5000)) AS clipped_mean, 5000 / count(*)::DOUBLE AS sensitivity FROM customer GROUP BY 1""",
    floats="clipped_mean sensitivity",
    digits=4,
)
def _(t: Tables):
    return V.clipped_means(t.customer, ["c_mktsegment"], "c_acctbal", (0.0, 5000.0))


def uniform_sql(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 12))::BIGINT / 281474976710656.0)"


def laplace_sql(scale: str, text: str) -> str:
    u = f"({uniform_sql(text)} - 0.5)"
    return f"-({scale}) * sign({u}) * ln(greatest(1 - 2 * abs({u}), 1e-300))"


@query(
    "v09_private_means",
    f"""SELECT c_mktsegment, clipped_mean + {laplace_sql('5000 / n::DOUBLE', "'42|' || c_mktsegment")} AS private_mean
    FROM (SELECT c_mktsegment, count(c_acctbal) AS n, avg(least(greatest(c_acctbal, 0), 5000)) AS clipped_mean FROM customer GROUP BY 1)""",
    floats="private_mean",
    digits=4,
)
def _(t: Tables):
    return V.private_means(t.customer, ["c_mktsegment"], "c_acctbal", (0.0, 5000.0), seed=42)


@query(
    "v09_private_counts",
    f"""SELECT event_type, greatest(0, trunc(n + {laplace_sql('1.0', "'42|' || event_type")})::BIGINT) AS private_count FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""",
)
def _(t: Tables):
    return V.private_counts(t.events, ["event_type"], seed=42)


@query(
    "v10_randomised_response",
    f"""SELECT CASE WHEN {uniform_sql("'42:keep|' || doc_id")} < exp(1.0) / (1 + exp(1.0)) THEN toxic::BOOLEAN ELSE {uniform_sql("'42:coin|' || doc_id")} < 0.5 END AS toxic, count(*) AS n
    FROM labels GROUP BY 1""",
)
def _(t: Tables):
    answered = V.randomised_response(t.labels, "toxic", ["doc_id"], seed=42)
    return answered.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))


@query(
    "v11_compliance",
    f"""SELECT 'no_pii' AS "check", count(*) = 0 AS passed, CASE WHEN count(*) > 0 THEN 'text' ELSE '' END AS detail,
    CASE WHEN count(*) > 0 THEN 'anonymise or pseudonymise PII columns' END AS recommendation FROM documents
    WHERE {' OR '.join(f"regexp_matches(text, '{pattern(n)}')" for n in V.PII_PATTERNS)}
    UNION ALL SELECT 'consent_column', false, '', 'add consent tracking'""",
)
def _(t: Tables):
    return V.compliance(t.documents.select("text", "lang", "source"))


@query(
    "u06_custom_pii",
    f"""SELECT 'text' AS "column", 'url' AS type, count(*) AS rows FROM documents WHERE regexp_matches(text, 'https?://[a-z]+') HAVING count(*) > 0 UNION ALL """
    + " UNION ALL ".join(
        f"""SELECT 'text', '{n}', count(*) FROM documents WHERE regexp_matches(text, '{pattern(n)}') HAVING count(*) > 0""" for n in V.PII_PATTERNS
    ),
)
def _(t: Tables):
    return V.scan_pii(t.documents, ["text"], {"url": "https?://[a-z]+"})
