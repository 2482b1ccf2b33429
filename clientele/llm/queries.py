"""One query per operator, over its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..sources.io import table_path
from . import curriculum, fragment_join, html_main, language_mix, license_dictionaries, line_runs, periodic_runs, phrase_index, ptolemaic, secret_owners, simple8b, stream_dedup, toxic_grammar
from .text import scratch

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir, name):
    return spark.read.parquet(table_path(sf_dir, name))


#: Sources of weight 5 come early in training, those of weight 1 late, those of weight 2 evenly.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), curriculum.FLAT, ((0.0, 0.5), (1.0, 1.5)))


@query
def op1_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_mix.detect(docs.select("doc_id", "text"), language_mix.fit(docs, fit_docs=5000))
    return out.select("kept.doc_id", language_mix.held_out(F.col("kept.doc_id")).alias("held_out"), "lang_pred", "score",
                      F.array_join("langs", ",").alias("langs"))


@query
def op2_source_mix(spark, sf_dir):
    """The mix of all documents, in the order of each one's first training position."""
    out = curriculum.curriculum(table(spark, sf_dir, "documents"), schedules=SCHEDULES, max_epochs=3)
    first = F.round(F.get("instances", F.lit(0))["position"], 6).alias("first_position")
    return out.select("doc_id", "size", "source_size", "target", "taken", first).orderBy("first_position", "doc_id")


@query
def op3_html_main_text(spark, sf_dir):
    return html_main.extract(table(spark, sf_dir, "pages"))


@query
def op4_exact_dedup(spark, sf_dir):
    out = stream_dedup.exact_dedup(spark, table_path(sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query
def op5_line_dedup(spark, sf_dir):
    out = line_runs.drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op6_decontamination(spark, sf_dir):
    out = phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), length=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      phrase_index.items_sha256(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op7_secret_scan(spark, sf_dir):
    out = secret_owners.scan_secrets(table(spark, sf_dir, "documents"))
    spans = F.coalesce("spans", F.array().cast(out.schema["spans"].dataType))
    base = F.filter(spans, lambda s: s["kind"] != "owned")
    n = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    live = F.size(F.filter(base, lambda s: s["live"])).cast("long").alias("n_live")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), n("owned"), live,
                      F.sha2(secret_owners.joined(base).cast("binary"), 256).alias("base_sha256"),
                      secret_owners.joined(spans).alias("spans"))


@query
def op8_ngram_jaccard(spark, sf_dir):
    return fragment_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


@query
def op9_license_scan(spark, sf_dir):
    out = license_dictionaries.scan(table(spark, sf_dir, "documents"))
    spans = F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return out.select("doc_id", "n_blocks", F.size("found").cast("long").alias("n_found"),
                      F.array_join(F.sort_array(F.array_distinct(F.transform("found", lambda x: x["license"]))), ",").alias("licenses"),
                      F.array_join(spans, ",").alias("spans"),
                      F.array_max(F.transform("found", lambda x: x["reduction"])).alias("reduction"))


def tokenizer_file(name="word_bpe_49k.json"):
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op10_token_files(spark, sf_dir):
    folder = scratch(spark, "token-files")
    simple8b.write_ids(table(spark, sf_dir, "documents"), folder, tokenizer_file(), end_id=1)
    return simple8b.read_index(spark, folder)


@query
def op11_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxic_grammar.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), fit_docs=20_000)
    out = toxic_grammar.score(docs, model)
    return out.select("doc_id", toxic_grammar.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_clauses", "best_clause")


@query
def op12_centroid_clusters(spark, sf_dir):
    out = ptolemaic.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, size=64, scale=64, seed=1)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", ptolemaic.centroid_sha256(F.col("centroid")).alias("centroid_sha256"))


def planted_period(doc_id, n):
    """One document of ten repeats a block from some word on to its end, by the checksum of its id; a null id does not."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    return None if h % 10 else (a, 1 + (n - a) // (3 + g % 8))


@query
def op13_periodic_runs(spark, sf_dir):
    out = periodic_runs.find_runs(table(spark, sf_dir, "documents"), least=12, rewrite=planted_period)
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    out = out.withColumn("best", periodic_runs.longest(F.col("runs")))
    exponent = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"),
                      F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
