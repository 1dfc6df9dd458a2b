"""The corpus operators as queries over the tables of a folder: name to function of (spark, folder)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.bpe import tokenise
from quillstone.llm.common import table
from quillstone.llm.exact_dedup import exact_duplicates
from quillstone.llm.language import learn_languages, predict_language
from quillstone.llm.licences import scan_licences, template_bodies
from quillstone.llm.line_dedup import dedup_lines
from quillstone.llm.mixing import mix_sources
from quillstone.llm.near_dedup import near_duplicates
from quillstone.llm.token_files import read_token_files, write_token_files
from quillstone.llm.top_k import exact_top_k, quantise
from quillstone.llm.toxicity import learn_toxicity, toxicity_scores


def _fold(parts: int) -> Column:
    """The remainder by which documents are held out: of the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts, F.lit(-1))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document: 4-word shingles, at most 4 differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), budget=4, shingle=4, seed=42)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for each text, by a stateful stream of digests."""
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document by a lexicon learned on the labelled rows that are not held out."""
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), _fold(5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity_scores(docs, learn_toxicity(docs, labels.where(~held)))
    predicted = (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), predicted, "toxic_hits")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by naive Bayes, learned on the rows that are not held out."""
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _fold(4) == 2
    found = predict_language(docs.select("doc_id", "text"), learn_languages(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed so that each source has the same expected number of rows, as many in all as there are."""
    return mix_sources(table(spark, sf_dir, "documents"), weights=None, epochs=1.0, seed=42)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of each document, its own or inherited.

    Documents have no paths: they lie in source/lang/<thousand>, and two of three in a folder or two below that; one in five
    is called NOTICE.
    """
    n = F.col("doc_id")
    thousand, hundred, ten = (F.expr(f"doc_id div {k}").cast("string") for k in (1000, 100, 10))
    deeper = F.when(n % 3 == 1, hundred).when(n % 3 == 2, F.concat_ws("/", hundred, ten))
    path = F.concat_ws("/", "source", "lang", thousand, deeper, F.when(n % 5 == 0, "NOTICE").otherwise(n.cast("string")))
    return scan_licences(table(spark, sf_dir, "documents"), path)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document and their decoded text, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tokenise(docs, public_tokenizers.path("word_bpe_49k.json"))
    ids = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors with the largest inner product for every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantise(F.col("embedding")).alias("v"))
    found = exact_top_k(rows, rows.where(F.col("vec_id") % 20 == 0), k=20, id_col="vec_id", vector_col="v")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines and sentences that a document before them has, with the spans that stay and go."""
    found = dedup_lines(table(spark, sf_dir, "documents"))
    spans = {c: F.to_json(c) for c in ("kept_spans", "removed_spans", "copies_of")}
    return found.withColumns(spans)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files and read back."""
    docs = table(spark, sf_dir, "documents")
    found = read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))
    return found.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_exact_dedup,
        op3_toxicity,
        op4_language_id,
        op5_mix_sources,
        op6_license_scan,
        op7_bpe,
        op8_exact_top_k,
        op9_line_dedup,
        op10_token_files,
    )
}

_BODIES = template_bodies()
_TEMPLATES = ", ".join("({}, '{}', '{}')".format(k, name, body.replace("'", "''")) for k, (name, body) in enumerate(_BODIES))
_TERMS = r"unnest(list_distinct(list_filter(regexp_split_to_array(lower(body), '[^\p{L}\p{N}]+'), lambda t: t <> '')))"

#: Equivalent SQL of the queries that it can express.
ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op5_mix_sources": """
WITH RECURSIVE sizes AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
totals AS (SELECT count(*)::DOUBLE AS sources, sum(n) AS rows FROM sizes),
rates AS (SELECT source, 1.0::DOUBLE / sources * 1.0::DOUBLE * rows / n AS rate FROM sizes, totals),
cdf AS (
  SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS total FROM rates
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln((k + 1)::DOUBLE), total + exp(log_p + ln(rate) - ln((k + 1)::DOUBLE))
  FROM cdf WHERE k + 1 <= floor(rate + 12 * sqrt(rate) + 24)),
steps AS (SELECT source, list(total) AS totals FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, (('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u, totals
  FROM documents d JOIN steps USING (source))
SELECT doc_id, text, lang, source, n_chars, unnest(range(len(list_filter(totals, lambda t: t <= u))))::INTEGER AS copy FROM drawn""",
    "op6_license_scan": f"""
WITH tpl(template, license, body) AS (VALUES {_TEMPLATES}),
counts AS (SELECT template, license, {_TERMS} AS term FROM tpl),
idf AS (SELECT term, ln({1.0 + len(_BODIES)} / (1 + count(*))) + 1 AS idf FROM counts GROUP BY term),
unit AS (SELECT template, license, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY template)) AS weight FROM counts JOIN idf USING (term)),
texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, regexp_split_to_array(text, '\n[ \t\r]*\n') AS ps FROM documents),
units AS (
  SELECT doc_id, len(ls) = 1 AS whole, unnest(ls) AS body FROM texts
  UNION ALL SELECT doc_id, len(ps) = 1, unnest(list_filter(ps, lambda p: contains(p, chr(10)))) FROM texts
  UNION ALL SELECT doc_id, true, text FROM texts WHERE len(ps) > 1),
words AS (SELECT body, {_TERMS} AS term FROM (SELECT DISTINCT body FROM units)),
vectors AS (SELECT body, term, coalesce(idf, ln({1.0 + len(_BODIES)}) + 1) AS w FROM words LEFT JOIN idf USING (term)),
norms AS (SELECT body, sqrt(sum(w * w)) AS norm FROM vectors GROUP BY body),
scored AS (
  SELECT body, template, license, count(*) AS shared, round(sum(w * weight) / any_value(norm), 6) AS cosine
  FROM vectors JOIN unit USING (term) JOIN norms USING (body) GROUP BY body, template, license),
best AS (SELECT * FROM scored WHERE cosine >= 0.6 QUALIFY row_number() OVER (PARTITION BY body ORDER BY cosine DESC, license, shared DESC) = 1),
own AS (
  SELECT doc_id, license, cosine, shared, max(whole::INT) OVER (PARTITION BY doc_id) = 1 AS whole FROM units JOIN best USING (body)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, cosine DESC, license) = 1),
placed AS (
  SELECT doc_id, concat_ws('/', source, lang, doc_id // 1000, CASE doc_id % 3 WHEN 1 THEN (doc_id // 100)::VARCHAR
    WHEN 2 THEN (doc_id // 100) || '/' || (doc_id // 10) END) AS folder, doc_id % 5 = 0 AS named, license, cosine, shared, whole
  FROM documents LEFT JOIN own USING (doc_id)),
given AS (
  SELECT folder AS up_folder, license AS up, cosine AS near FROM placed WHERE license IS NOT NULL AND (named OR whole)
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY shared DESC, cosine DESC, license) = 1),
walked AS (
  SELECT p.*, up, near, up_folder FROM placed p LEFT JOIN given ON p.folder = up_folder OR starts_with(p.folder, up_folder || '/')
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(up_folder) DESC NULLS LAST) = 1)
SELECT doc_id, coalesce(license, up) AS license, coalesce(cosine, near) AS cosine,
       CASE WHEN license IS NOT NULL THEN 'own' WHEN up IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
       CASE WHEN license IS NULL THEN up_folder END AS directory
FROM walked""",
    "op8_exact_top_k": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20""",
}
