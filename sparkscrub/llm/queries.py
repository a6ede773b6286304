"""Queries of the operators of this subpackage over the standard tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, each document encoded once."""
    from sparkscrub.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), rule="start")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by a mix with weights 1, 2, 3, repeating."""
    from sparkscrub.llm.mixing import mix_sources

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, substitutions tolerated."""
    from sparkscrub.llm.decontaminate import find_contamination

    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id stays."""
    from sparkscrub.llm.exact_dedup import exact_duplicates

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = exact_duplicates(docs, keep="max")
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("text_digest")).alias("text_sha256"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in windows of 35 words that also start elsewhere, removed from every document."""
    from sparkscrub.llm.substrings import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"), window=35)


def _judged(scored: DataFrame, mod: int, rest: int) -> DataFrame:
    from sparkscrub.llm.labelled import held_out

    return scored.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a byte-level convolutional network."""
    from sparkscrub.llm.quality import fit_quality, score_quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit_quality(docs, _table(spark, sf_dir, "labels"), mod=3, rest=1)
    return _judged(score_quality(docs, net), 3, 1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by positive-unlabelled learning."""
    from sparkscrub.llm.toxicity import fit_toxicity, score_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), mod=5, rest=0)
    return _judged(score_toxicity(docs, model), 5, 0)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components by 4-word shingles with a Jaccard similarity of 0.8 or more."""
    from sparkscrub.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, looked up by its url in the two-level index and read back."""
    from sparkscrub.llm.warc import WarcArchive

    pages = _table(spark, sf_dir, "pages")
    records = WarcArchive(spark).write(pages).records(pages.select("url"))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    from sparkscrub.llm.pii import KINDS, find_personal_data, listed

    out = find_personal_data(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in KINDS]
    every = F.concat("base", "found")
    return out.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"),
        F.size("found").cast("long").alias("n_found"), (F.size(every) > 0).alias("has_personal_data"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mix_sources": op2_mix_sources,
    "op3_decontaminate": op3_decontaminate,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_near_dedup": op8_near_dedup,
    "op9_warc": op9_warc,
    "op10_personal_data": op10_personal_data,
}

#: Tokens as the decontamination compares them, in SQL.
_TOKENS = r"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op2_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents),
        s AS (
            SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
            FROM d GROUP BY source),
        r AS (
            SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                sum(w) OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
            FROM s),
        f AS (SELECT *, rest::DOUBLE * w >= (3 * source_size)::DOUBLE * rest_w AS stops FROM r),
        t AS (
            SELECT source, CAST(source_size AS BIGINT) AS source_size,
                CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE)
                ELSE CAST(max(rest) FILTER (NOT stops) OVER () * w AS DOUBLE) / sum(w) FILTER (NOT stops) OVER () END AS target
            FROM f),
        o AS (
            SELECT doc_id, size, source_size, target,
                coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
            CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (CAST(floor(target) AS BIGINT) // source_size)
                + least(size, greatest(0, CAST(floor(target) AS BIGINT) % source_size - ahead)) END AS BIGINT) AS taken
        FROM o""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
            count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
            doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
            sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        f AS (SELECT page_id, n, h, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
    "op3_decontaminate": rf"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TOKENS} AS w FROM documents),
        b AS (SELECT item_id, row_number() OVER () AS i, {_TOKENS} AS w FROM benchmark),
        dt AS (SELECT r, doc_id, len(w) AS dn, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM d),
        bt AS (SELECT i, item_id, len(w) AS bn, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS q FROM b),
        a AS (  -- one row for each alignment of a document and an item with tokens in common
            SELECT any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, any_value(dn) AS dn, any_value(bn) AS bn,
                greatest(0, any_value(p - q)) AS lo, least(any_value(dn), any_value(bn + p - q)) AS hi, list(p) AS ps
            FROM dt JOIN bt USING (t) GROUP BY r, i, p - q),
        c AS (SELECT *, least(20, hi - lo) AS compared FROM a WHERE len(ps) >= ceil(0.8 * least(20, hi - lo))),
        s AS (
            SELECT doc_id, item_id, compared, hi - lo AS n, dn, bn, s AS start, len(list_filter(ps, lambda p: p >= s AND p < s + compared)) AS matched
            FROM (SELECT *, unnest(range(lo, hi - compared + 1)) AS s FROM c)),
        g AS (
            SELECT * FROM s WHERE CASE WHEN n >= 10 THEN matched >= ceil(0.8 * compared)
                ELSE matched = n AND (n = dn OR n = bn) AND (n >= 5 OR dn = bn) END)
        SELECT doc_id, item_id, CAST(matched AS BIGINT) AS matched, CAST(compared AS BIGINT) AS compared, CAST(start AS BIGINT) AS start
        FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, compared DESC, start) = 1""",
    "op5_repeated_passages": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
        f AS (SELECT r, i FROM x QUALIFY count(*) OVER (PARTITION BY h) > 1),
        gone AS (SELECT DISTINCT r, i + k AS j FROM f, range(35) AS t(k)),
        k AS (
            SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept
            FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d) ANTI JOIN gone USING (r, j) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (r)""",
    "op8_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM d),
        e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
        links AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach AS (SELECT a, a AS b FROM (SELECT DISTINCT a FROM links) UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
        SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(least, doc_id) AS component_id, doc_id = coalesce(least, doc_id) AS kept
        FROM s LEFT JOIN c ON a = doc_id""",
}
