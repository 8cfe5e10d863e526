"""The training-data operators bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name="word_bpe_49k.json"):
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_pattern_packing")
def op1(spark, sf_dir):
    from slideloom.llm.packing import pack, pieces

    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer()))


@query("op4_simhash_bytes")
def op4(spark, sf_dir):
    from slideloom.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op7_lpt_shards")
def op7(spark, sf_dir):
    from slideloom.llm.sharding import shard_by_size

    out = shard_by_size(table(spark, sf_dir, "documents"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn,
             [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS whole,
             coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0) AS filled, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS weight
      FROM w WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((whole - filled) / weight) FILTER (WHERE (whole - filled) / weight * w < cap) AS level FROM r),
t AS (SELECT source, source_size, turn, CASE WHEN (whole - filled) / weight * w < cap THEN level * w ELSE cap END AS target FROM r, l),
c AS (SELECT d.*, t.source_size, t.turn, t.target, floor(t.target + 0.5)::BIGINT AS quota,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(least(quota - place, size), 0) AS once, greatest(least(quota - source_size - place, size), 0) AS twice FROM c),
y AS (SELECT *, (place + once / 2.0::DOUBLE) / nullif(target, 0) AS y FROM k)
SELECT doc_id, source, size, source_size, round(target, 6) AS target, (once + twice)::BIGINT AS taken,
       CASE WHEN once > 0 THEN round(CASE turn % 3
            WHEN 0 THEN y WHEN 1 THEN 2 * y / (0.5 + sqrt(0.25 + 2 * y)) ELSE 2 * y / (1.5 + sqrt(greatest(2.25 - 2 * y, 0))) END, 9) END AS first_position
FROM y
"""


@query("op9_curriculum_mix", MIX_SQL)
def op9(spark, sf_dir):
    from slideloom.llm.curriculum import plan_mix

    out = plan_mix(table(spark, sf_dir, "documents"))
    # rows alike in id and text were planned as one
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select(
        F.col("_doc").alias("doc_id"), "source", "size", "source_size", F.round("target", 6).alias("target"), "taken",
        F.round(F.get(F.col("readings.position"), 0), 9).alias("first_position"),
    )


@query("op3_entropy_secrets")
def op3(spark, sf_dir):
    from slideloom.llm.secrets import BASE, find_secrets, written

    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), name="_spans").drop("text")
    base = F.filter("_spans", lambda s: s["place"] < len(BASE))
    many = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", *[many(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"),
        (F.size("_spans") - F.size(base)).cast("long").alias("n_entropy"),
    )


@query("op5_line_quality")
def op5(spark, sf_dir):
    from slideloom.llm.linequality import judge

    return judge(table(spark, sf_dir, "documents")).select(
        F.col("_doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "removed_words",
    )


#: Hexadecimal to base32: 5 digits make 4 letters.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_NUMBER = " + ".join(f"(strpos('0123456789abcdef', substr(hex, 5 * g + {k + 1}, 1)) - 1) * {16 ** (4 - k)}" for k in range(5))
_DIGITS = " || ".join(f"substr('{_LETTERS}', ((({_NUMBER}) // {32 ** (3 - k)}) % 32 + 1)::INTEGER, 1)" for k in range(4))
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
g AS (SELECT hex, min(page_id) AS first_id FROM h GROUP BY hex),
d AS (SELECT hex, string_agg({_DIGITS}, '' ORDER BY g) AS payload_digest FROM (SELECT DISTINCT hex FROM h), range(8) AS r(g) GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM h JOIN g USING (hex) JOIN d USING (hex)
"""


@query("op2_dictionary_warc", WARC_SQL)
def op2(spark, sf_dir):
    from slideloom.llm.warc import read_warc, shared_folder, write_warc

    folder = shared_folder(spark)
    archives = write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_cross_polytope")
def op6(spark, sf_dir):
    from slideloom.llm.crosspoly import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_recurrent_blocks")
def op8(spark, sf_dir):
    from slideloom.llm.blocks import extract

    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op10_license_dice")
def op10(spark, sf_dir):
    from slideloom.llm.licenses import scan

    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), name="_found").drop("text")
    best = F.get("_found", 0)
    return out.select(
        "doc_id", F.size("_found").cast("long").alias("n_matches"), best["license"].alias("license"), best["dice"].alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.col("_found.license"))), ",").alias("licenses"),
    )


@query("op11_chebyshev_whitening")
def op11(spark, sf_dir):
    from slideloom.llm.whitening import whiten

    out = whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return out.select("_row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query("op12_minhash_coordinates")
def op12(spark, sf_dir):
    from slideloom.llm.coordinates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op13_token_alignment")
def op13(spark, sf_dir):
    from slideloom.llm.tokenalign import align

    out = align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), keep=["doc_id"])
    return out.select("_row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
