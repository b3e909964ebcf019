"""The queries opN_<name>, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, chat, decontam, dedup, langid, lattice, manifest, pii, substring, suffix, warc
from .common import checkpoint, table
from .decontam import _UPPER
from .sql import SQL  # noqa: F401


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(sf_dir, "documents", spark), n=4)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(sf_dir, "embeddings", spark))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(sf_dir, "documents", spark)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(sf_dir, "documents", spark).select("doc_id", "text")).select("doc_id", "base", "added")
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in pii.BASE], F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.concat("base", "added")).alias("spans"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(table(sf_dir, "documents", spark), public_tokenizers.path("piece_bpe_32k.model"), counted=True)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(table(sf_dir, "documents", spark).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(sf_dir, "documents", spark), table(sf_dir, "benchmark", spark))
    hit = decontam.n_hit(F.col("hits"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with a weaker last answer (conversations hold no rejected ones): whole pairs, texts as digests."""
    out = chat.preference_format(chat.weakened(table(sf_dir, "conversations", spark)))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")]
    spans = [F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias(c) for c in ("chosen_spans", "rejected_spans")]
    return out.select("pair_id", "block", "part", "n_prompt", "n_chosen", "n_rejected", *digests, *spans)


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made of pages, as records with payloads: each page is a response; two of three are asked for again later and answered by 304, every
    ninth page with another validator. Times follow page_id, so revisits of one URL interleave with its other captures."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    p = pages.select("page_id", "url", html.alias("payload"), F.sha2(html, 256).alias("digest")).where("page_id is not null")
    at = lambda s: (F.lit(1704067200) + F.col("page_id") * 60 + s).cast("long").alias("at")
    name = lambda kind: F.concat(F.lit(f"{kind}-"), F.col("page_id").cast("string")).alias("record_id")
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    head = lambda **k: F.create_map(*[x for n, v in k.items() for x in (F.lit(n.replace("_", "-")), v)]).alias("headers")
    full = p.select(
        name("page"), F.lit("response").alias("type"), "url", at(0),
        head(content_type=F.lit("text/html"), content_length=F.octet_length("payload").cast("string"), etag=tag, cache_control=F.lit("max-age=60")), "payload",
    )
    other = F.when(F.col("page_id") % 9 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    again = p.where("page_id % 3 <> 0 or page_id % 9 = 0").select(
        name("revisit"), F.lit("revisit").alias("type"), "url", at(600),
        head(content_type=F.lit("text/plain"), etag=other, cache_control=F.lit("max-age=600"), server=F.lit("edge")), F.lit(b"").alias("payload"),
    )
    return full.unionByName(again)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl is written as WARC bytes, read back record by record, and its revisits are resolved."""
    read = warc.records_of(warc.to_warc(captures(table(sf_dir, "pages", spark))))
    full = F.col("type") == "response"
    records = read.select(
        "record_id", "type", "url", "ts", "headers", F.when(full, F.sha2("payload", 256)).alias("payload_digest"), F.when(full, F.octet_length("payload")).cast("long").alias("payload_length")
    )
    out = warc.resolve_revisits(checkpoint(records))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return out.select("record_id", "url", "status", "refers_to", entries.alias("headers"), "payload_digest", "payload_length")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark)
    return langid.identify(docs.select("doc_id", "text"), langid.train(docs), columns=["doc_id"]).select("doc_id", "held_out", "lang_pred", "score")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeated_bytes(table(sf_dir, "documents", spark))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def tampered_manifest(docs: DataFrame, **how) -> DataFrame:
    """The manifest of docs, and what verification says where a fifth of the texts were changed to lower case."""
    d = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, manifest.digest(*d, F.translate("text", _UPPER, _UPPER.lower())))
    out = manifest.manifest(docs.select("source", "doc_id", manifest.digest(*d, F.col("text")).alias("leaf"), changed.alias("tampered")), **how)
    folded = manifest.fold(F.col("levels"), F.coalesce("tampered", "leaf"))
    out = out.select("doc_id", "leaf", "subroot", "root", manifest.proof_of(F.col("levels")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_manifest(table(sf_dir, "documents", spark))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark)
    return align.align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_duplicates, op2_nearest_neighbours, op3_repeated_passages, op4_personal_data, op5_language_model, op6_bpe, op7_decontamination, op8_preference_format, op9_warc_revisits, op10_language, op11_suffix_dedup, op12_merkle_manifest, op13_tokenizer_alignment, pipeline)
}
