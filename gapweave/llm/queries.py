"""One query per operator over the whole given tables."""

from pyspark.sql import functions as F

from gapweave.llm import archive, bytepair, decontaminate, jaccard_join, licences, manifest, packing, periodic, quality, rules, sharding, token_counts, toxicity

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_ids(spark, sf_dir):
    """The target of the quality classifier: documents labelled as good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


@query
def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.resample(docs, good_ids(spark, sf_dir))
    return found.select("doc_id", "log_weight", "gumbel_key", "selected")


@query
def op2_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), carry=["doc_id"])
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op4_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rules.cascade(docs, complete=rules.BASE, carry=["doc_id"]).select("doc_id", *rules.BASE, failed.alias("base_failed"), "kept")


@query
def op5_sharding(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shards(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_archive(spark, sf_dir):
    records = archive.read(archive.write(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", "start", "n_words", "distance", "similarity")


@query
def op9_licences(spark, sf_dir):
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op10_packing(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    columns = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    shorter = manifest.leaf_digest(*columns, F.replace("text", F.lit("\n"), F.lit("")))
    presented = F.when(tampered & F.contains("text", F.lit("\n")), shorter).alias("presented")
    found = manifest.manifest(docs.select("doc_id", "source", manifest.leaf_digest(*columns, "text").alias("leaf"), presented))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


@query
def op12_bytepair(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bytepair.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, carry=["doc_id"])
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def planted(docs):
    """docs with a periodic end in about one text of ten, chosen and cut by the checksum of doc_id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    held = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w").cast("long")
    cut = held.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = (n - F.col("a")).cast("int")
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(period, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    whole = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), whole).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic(spark, sf_dir):
    found = periodic.periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")), carry=["doc_id"])
    # the largest length / period, compared exactly; of equals the first by start, then period
    best = F.expr(
        "aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), "
        "(b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)"
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("b.length") / F.col("b.period")).cast("long").alias("exponent_milli")
    return told.select("doc_id", "n_runs", "b.start", "b.length", "b.period", milli, "runs_sha256", "collapsed_sha256")
