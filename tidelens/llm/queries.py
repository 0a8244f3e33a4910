"""Queries of the operators over their whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import jaccard, language, periodic, personal, pieces, quality, scoring, secrets, substrings, tiling, token_files, variants, vectors
from .common import documents, sha_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = pieces.encode(documents(spark, sf_dir), model)
    both = pieces.decode(ids, model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"), sha_of(F.col("decoded")).alias("decoded_sha256"))


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", (~quality.in_training()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op4_vectors", """
    WITH pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
                   WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
    n AS (SELECT x, count(*) AS n FROM pairs GROUP BY x),
    reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings),
    grown AS (WITH RECURSIVE r(x, y) AS (SELECT x, y FROM reach UNION SELECT r.x, p.y FROM r JOIN pairs p ON p.x = r.y) SELECT x, min(y) AS c FROM r GROUP BY x)
    SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, g.c AS component_id, e.vec_id = g.c AS kept
    FROM embeddings e LEFT JOIN n ON n.x = e.vec_id JOIN grown g ON g.x = e.vec_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = token_files.write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_crc(folder, index).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op6_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans = secrets.scan(documents(spark, sf_dir)), F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "novel")
    return found.select("doc_id", *[secrets.count_of(spans, k).alias(f"n_{k}") for k in secrets.KINDS],
                        sha_of(secrets.digest(base)).alias("base_sha256"), secrets.digest(spans).alias("spans"))


#: Word sets of five and their classes, links and groups, pair by pair.
JACCARD_SQL = r"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\r\f\v]+') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM words),
    grams AS (SELECT doc_id, unnest(g) AS gram FROM sets),
    sizes AS (SELECT doc_id, len(g) AS n FROM sets WHERE len(g) > 0),
    common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT x, y, c, p.n AS nx, q.n AS ny FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE c / (p.n + q.n - c) >= 0.8),
    reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
    counts AS (SELECT x, count(*) AS n, min(CASE WHEN c = nx AND c = ny THEN y END) AS same FROM links GROUP BY x),
    groups AS (SELECT x, min(y) AS g FROM reach GROUP BY x)
    SELECT d.doc_id, least(d.doc_id, coalesce(c.same, d.doc_id)) AS class_id, coalesce(c.n, 0)::BIGINT AS n_links, least(d.doc_id, coalesce(g.g, d.doc_id)) AS group_id
    FROM documents d LEFT JOIN counts c ON c.x = d.doc_id LEFT JOIN groups g ON g.x = d.doc_id"""


@query("op7_jaccard", JACCARD_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


@query("op8_personal")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans = personal.scan(documents(spark, sf_dir)), F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*personal.BASE))
    return found.select("doc_id", *[secrets.count_of(spans, k).alias(f"n_{k}") for k in personal.KINDS],
                        sha_of(secrets.digest(base)).alias("base_sha256"), secrets.digest(spans).alias("spans"))


@query("op9_pseudo_likelihood")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(documents(spark, sf_dir))


@query("op10_substrings")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def planted(row: dict, words: list[str]) -> list[str]:
    """The words of a document, a tenth of the documents made periodic from some word on, as the contract of operator 11 says."""
    n = len(words)
    if row["doc_id"] is None or not n:
        return words
    h = zlib.crc32(str(row["doc_id"]).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


@query("op11_periodic")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, runs = periodic.scan(documents(spark, sf_dir), rewrite=planted), F.col("runs")
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("back"), r["start"], r["period"])))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs", "collapsed")
    listed = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.back")).alias("length"), F.col("best.period").alias("period"),
                       F.expr("-1000 * best.back div best.period").alias("exponent_milli"), sha_of(listed).alias("runs_sha256"), sha_of(F.col("collapsed")).alias("collapsed_sha256"))


@query("op12_language")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.fit(docs)).select("doc_id", (~language.in_training()).alias("held_out"), "lang_pred", "score")


@query("op13_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.word_counts(documents(spark, sf_dir))).select("word", "form", "root", "n", "n_near", "form_n")
