"""The corpus queries over whole tables, with reference SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerband.llm import langid, quality
from peerband.llm.exact_dedup import exact_dedup
from peerband.llm.licenses import build_index, scan_licenses
from peerband.llm.line_dedup import line_dedup
from peerband.llm.packing import pack
from peerband.llm.pieces import encode_pieces
from peerband.llm.simhash import simhash_components
from peerband.llm.spelling import spelling_variants
from peerband.llm.token_files import tokens_round_trip
from peerband.llm.url_rules import match_urls
from peerband.llm.vectors import near_vectors
from peerband.llm.whitening import whiten

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    """Where the public vocabulary files lie; executors must have them at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
    FROM t WINDOW same AS (PARTITION BY text)
    """
)
def op1_exact_dedup(spark, sf_dir):
    """Groups of equal texts; the largest doc_id of each stays."""
    found = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


@query()
def op4_simhash_near_dedup(spark, sf_dir):
    """Fingerprints of 3-word shingles, linked at two or fewer differing bits."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


#: Host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


@query(
    r"""
    WITH parts AS (
      SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages
    ), judged AS (
      SELECT *, CASE
        WHEN '.' || host LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN '.' || host LIKE '%.example.org' AND starts_with(path, '/en/1')
          THEN 'example.org/en/1'
        WHEN '.' || host LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN '.' || host LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN '.' || host LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
      FROM parts
    )
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1',
      'com/de/') THEN 'block' ELSE 'allow' END AS verdict
    FROM judged
    """
)
def op5_url_filters(spark, sf_dir):
    """Every page's URL under the allow and block rules; what no rule fits is allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    found = match_urls(table(spark, sf_dir, "pages"), rules, "page_id", "url", default="allow")
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


@query()
def op2_best_fit_packing(spark, sf_dir):
    """All documents as pieces of at most 2048 tokens in as few sequences as best fit finds."""
    found = pack(
        table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False
    )
    return found.withColumnRenamed("id", "doc_id")


@query()
def op8_sentencepiece(spark, sf_dir):
    """Token counts and digests of ids and decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode_pieces(docs, vocabulary("piece_bpe_32k.model"), digests=True)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query()
def op6_quality_classifier(spark, sf_dir):
    """A quality score of every document; a third of the ids is never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    model = quality.train(docs, labels)
    scored = quality.score_quality(docs.withColumn("held_out", quality.held_out()), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query()
def op9_language_id(spark, sf_dir):
    """The language of every document; a fifth of the ids is never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = langid.train(docs.where(~langid.held_out()))
    judged = langid.identify(
        docs.select("doc_id", "text").withColumn("held_out", langid.held_out()), trees
    )
    return judged.select("doc_id", "held_out", "lang_pred", "score")


@query()
def op7_license_scans(spark, sf_dir):
    """Places of license phrases in every document and the labels of verified templates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licenses(docs, build_index(docs))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


@query()
def op10_embedding_near_dedup(spark, sf_dir):
    """Links of all embeddings at a cosine of 0.95 or more, and one kept vector a component."""
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


@query()
def op3_line_dedup(spark, sf_dir):
    """Every document without the runs of lines that stand earlier."""
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


@query()
def op11_token_files(spark, sf_dir):
    """Token ids of every document written to ORC files in order, and what the files hold."""
    found = tokens_round_trip(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")
    )
    return found.withColumnRenamed("id", "doc_id")


@query()
def op12_spelling_variants(spark, sf_dir):
    """Every frequent word with its near words, its form and the root of its group."""
    found = spelling_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query()
def op13_embedding_whitening(spark, sf_dir):
    """All embeddings along the four leading components of their distinct integer vectors."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id").withColumn(
        "deviation", F.col("deviation").cast("long")
    )
