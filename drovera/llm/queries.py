"""Named queries of the corpus operators over the bundled tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, decontam, hostrules, licenses, linededup, manifest, merkle, packing, pii, pii_examples, quality, simhash, tokens, whitening


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = brown.score_documents(table(spark, sf_dir, "documents"), lambda i: remainder(i, 7) != 2)
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = lambda i: remainder(i, 5) != 0
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    return scored.select("doc_id", F.coalesce(~learn(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.apply_host_rules(table(spark, sf_dir, "documents"))


def op10_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC records against a replica with damaged and lost records."""
    pages = table(spark, sf_dir, "pages")
    good = pages.select(F.col("page_id").alias("id"), merkle.record_bytes(F.col("url"), F.col("html")).alias("record"))
    damaged = F.replace(F.col("record"), F.lit("Content-Type: text/html"), F.lit("Content-Type: text/htmx"))
    replica = good.where("id % 211 <> 5").withColumn(
        "record", F.when(F.expr("id % 97 = 13"), damaged).otherwise(F.col("record"))
    )
    found = merkle.audit(good, replica)
    return found.select(
        F.col("id").alias("page_id"), F.col("file").alias("warc_file"), "offset_a", "size_a", "digest_a", "digest_b", "status"
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, checked against a leaf whose ``n_chars`` was raised for one document in seven."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    # Beyond 64 bits only in the sum, so that the largest count can be raised as well.
    raised = [(F.col(c).cast("decimal(20,0)") + 1).cast("decimal(20,0)") if c == "n_chars" else F.col(c) for c in fields]
    tampered = F.when(remainder(F.col("doc_id"), 7) == 0, manifest.leaf_digest(raised))
    found = manifest.manifest(docs, fields, carry={"tampered": tampered})
    checked = manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
        checked.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pii.fit(pii_examples.examples(spark))
    found = pii.find_personal(table(spark, sf_dir, "documents"), model)
    exact = F.filter("spans", lambda s: s["exact"])
    number = lambda k: F.size(F.filter(exact, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(number, pii.KINDS[:4]), F.sha2(pii.listed(exact), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_line_dedup, op3_brown_lm, op4_token_counts, op5_decontamination, op6_quality, op7_packing,
    op8_license_scan, op9_host_rules, op10_merkle_audit, op11_merkle_manifest, op12_whitening, op13_pii_crf,
)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# crc32 of the decimal doc_id, bit by bit.
_CRC32 = """xor(list_reduce(
    [4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
), 4294967295)"""
ORACLES: dict[str, str] = {
    "op2_line_dedup": f"""
        with l as (
            select doc_id, u.i, u.line, translate(trim(u.line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents) d,
                 lateral (select unnest(ls) as line, unnest(range(len(ls))) as i) u
        ), c as (
            select key, max(doc_id) as keeper from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5
        ), m as (
            select l.*, c.key is not null and l.doc_id < c.keeper as gone from l left join c on l.key = c.key
        )
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
        from m group by doc_id""",
    "op10_merkle_audit": r"""
        with r as (
            select page_id, url, html, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
                || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') as http
            from pages
        ), w as (
            select page_id, page_id // 1024 as warc_file, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: '
                || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10)
                || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || sha256(coalesce(html, ''))
                || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(http)) || chr(13) || chr(10) || chr(13) || chr(10) || http
                || chr(13) || chr(10) || chr(13) || chr(10) as record
            from r
        ), s as (
            select *, octet_length(encode(record)) as size_a,
                coalesce(sum(octet_length(encode(record))) over (partition by warc_file order by page_id rows between unbounded preceding and 1 preceding), 0) as offset_a
            from w
        )
        select page_id, warc_file, cast(offset_a as bigint) as offset_a, size_a, sha256(record) as digest_a,
            case when page_id % 211 <> 5 then sha256(replace(record, 'Content-Type: text/html', 'Content-Type: text/htmx')) end as digest_b,
            case when page_id % 211 = 5 then 'missing' else 'changed' end as status
        from s where page_id % 211 = 5 or page_id % 97 = 13""",
    "op11_merkle_manifest": f"""
        with recursive field as (
            select doc_id, lang, crc32 % 7 = 0 as hit, n_chars,
                coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-')
                || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') as head,
                coalesce(octet_length(encode(text)) || ':' || text, '-') as tail
            from (select *, {_CRC32} as crc32 from documents)
        ), leaf as (
            select *, row_number() over () as id, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos
            from (
                select *, sha256(head || coalesce(length(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
                    sha256(head || coalesce(length((n_chars::hugeint + 1)::varchar) || ':' || (n_chars::hugeint + 1), '-') || tail) as raised
                from field
            )
        ), tree as (
            select lang, 0 as level, pos, leaf as h, count(*) over (partition by lang) as nodes from leaf
            union all
            select lang, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(nodes) + 1) // 2
            from tree where nodes > 1 group by lang, level, pos // 2
        ), subroot as (
            select lang, level as height, h as subroot, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as trees
            from tree where nodes = 1
        ), top as (
            select 0 as level, place as pos, subroot as h, trees as nodes from subroot
            union all
            select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(nodes) + 1) // 2
            from top where nodes > 1 group by level, pos // 2
        ), hop as (
            select l.id, t.level as step, o.h as other, (l.pos >> t.level) & 1 = 1 as is_right
            from leaf l join (select distinct lang, level from tree where nodes > 1) t on l.lang is not distinct from t.lang
            left join tree o on o.lang is not distinct from t.lang and o.level = t.level and o.pos = xor(l.pos >> t.level, 1)
            union all
            select l.id, s.height + t.level, o.h, (s.place >> t.level) & 1 = 1
            from leaf l join subroot s on l.lang is not distinct from s.lang
            cross join (select distinct level from top where nodes > 1) t
            left join top o on o.level = t.level and o.pos = xor(s.place >> t.level, 1)
        ), fold as (
            select id, 0 as step, case when hit then raised else leaf end as h from leaf
            union all
            select f.id, f.step + 1, sha256(case when is_right then coalesce(other, '') || h else h || coalesce(other, '') end)
            from fold f join hop p on p.id = f.id and p.step = f.step
        ), proof as (
            select id, sha256(string_agg(coalesce(other, ''), '' order by step)) as proof_sha256 from hop group by id
        )
        select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
        from leaf l join subroot s on l.lang is not distinct from s.lang
        cross join (select h as root from top where nodes = 1)
        left join proof p on p.id = l.id
        join (select id, arg_max(h, step) as folded_root from fold group by id) f on f.id = l.id""",
}
