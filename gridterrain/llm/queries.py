"""One query for each operator, over the whole of its table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op9_fingerprints")
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridterrain.llm.fingerprints import edit_likeness, fingerprint_text

    found = edit_likeness(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint_text(F.col("fp")).alias("fingerprint"),
        fingerprint_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


# Weights of sources: their number of documents to this power.
MIX_EXPONENT, MIX_SEED = 0.7, 7

_MIX_SQL = f"""
WITH counts AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
weights AS (SELECT source, n_docs, power(n_docs::DOUBLE, {MIX_EXPONENT}) AS weight FROM counts),
rates AS (SELECT source, (SELECT sum(n_docs) FROM weights)::DOUBLE * weight / (SELECT sum(weight) FROM weights) / n_docs AS rate FROM weights),
terms AS (
  SELECT source, rate, i, CASE WHEN i = 0 THEN 0.0 ELSE ln(rate) - ln(i::DOUBLE) END AS step
  FROM rates, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS t(i)),
probabilities AS (SELECT source, i, exp(-rate + sum(step) OVER (PARTITION BY source ORDER BY i)) AS p FROM terms),
steps AS (SELECT source, i, sum(p) OVER (PARTITION BY source ORDER BY i) AS c FROM probabilities),
lists AS (SELECT source, list(c) AS cs FROM steps GROUP BY source),
counted AS (
  SELECT d.*, len(list_filter(l.cs, lambda c: ('0x' || substr(md5('{MIX_SEED}:copies:' || coalesce(d.doc_id::VARCHAR, '-')), 1, 13))::BIGINT::DOUBLE / {1 << 52} >= c)) AS n
  FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
copies AS (SELECT * EXCLUDE (n), unnest(range(0, n))::INTEGER AS copy FROM counted)
SELECT *, ('0x' || substr(md5('{MIX_SEED}:order:' || coalesce(doc_id::VARCHAR, '-') || ':' || copy), 1, 13))::BIGINT AS shuffle_key FROM copies
"""


@_query("op5_mixing", _MIX_SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridterrain.llm.mixing import mix_sources, source_counts, tempered_weights

    docs = _table(spark, sf_dir, "documents")
    return mix_sources(docs, tempered_weights(source_counts(docs), MIX_EXPONENT), seed=MIX_SEED)


_BASE32_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(coalesce(html, '')), {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::BIGINT + 1, 1)"
    for i in range(8) for s in (15, 10, 5, 0)
)
_WARC_SQL = f"""
WITH kept AS (SELECT coalesce(html, '') AS payload, max(page_id) AS largest FROM pages GROUP BY 1),
p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, {_BASE32_SQL} AS payload_digest, largest, largest IS NOT NULL AND page_id IS DISTINCT FROM largest AS again
  FROM pages JOIN kept ON payload = coalesce(html, ''))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN largest END AS refers_to FROM p
"""


@_query("op7_warc", _WARC_SQL)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridterrain.llm.warc import base32_sha1, plan_records, read_warc, write_warc
    from gridterrain.scratch import scratch_path

    planned = plan_records(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    read = read_warc(write_warc(planned, scratch_path(spark, "warc")))
    whole = F.col("payload").isNotNull()
    return read.select(
        F.col("id").alias("page_id"), F.when(whole, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(whole, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridterrain.llm.bpe import add_encoding

    coded = add_encoding(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), decoded="decoded")
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@_query("op10_token_shards")
def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridterrain.llm.shards import read_shards, write_shards
    from gridterrain.scratch import scratch_path

    manifest = write_shards(_table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), tokenizer_path(), end_id=2)
    return read_shards(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


_TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query("op4_topk", _TOP_SQL)
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridterrain.llm.topk import quantised, top_inner_products

    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("embedding"))
    return top_inner_products(vectors, F.col("vec_id") % 50 == 0, 5)


@_query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridterrain.llm.html import extract_text

    return extract_text(_table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


_SUBSTRING_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
windows AS (SELECT doc_id, s, hash(array_to_string(w[s:s + 19], ' ')) AS h, md5(array_to_string(w[s:s + 19], ' ')) AS m FROM starts JOIN d USING (doc_id)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h, m ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
lists AS (SELECT doc_id, count(*) AS n_removed, list(i) AS li FROM gone GROUP BY doc_id),
words AS (SELECT d.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i WHERE gone.i IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@_query("op1_substring_dedup", _SUBSTRING_SQL)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridterrain.llm.substrings import remove_repeats

    left = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))


@_query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridterrain.llm.jaccard import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"))


@_query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridterrain.llm.language import fit, is_held_out, label_languages

    docs = _table(spark, sf_dir, "documents")
    return label_languages(docs.select("doc_id", "text"), fit(docs)).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _field_sql(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CRC_STEP = "list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), {})"
_CRC_SQL = f"xor(list_reduce(string_split(doc_id::VARCHAR, ''), lambda c, x: {_CRC_STEP.format('xor(c, ascii(x))')}, 4294967295::BIGINT), 4294967295)"
# Levels of the SQL's trees: up to 8^7 leaves a language and 8^2 languages.
_LEVELS, _TOPS = 7, 2


def _level_sql(source: str, target: str, tree: str, carry: str) -> str:
    """Nodes of ``source`` with their siblings (``{target}_s``), and their parents (``{target}``)."""
    return f"""
{target}_s AS (SELECT *,
    coalesce(string_agg(h, '') OVER (PARTITION BY {tree}pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
    coalesce(string_agg(h, '') OVER (PARTITION BY {tree}pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights FROM {source}),
{target} AS (SELECT {carry}pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(h || rights) ELSE h END AS h FROM {target}_s WHERE pos % 8 = 0)"""


_MERKLE_SQL = f"""
WITH l0 AS (SELECT doc_id, lang, sha256({' || '.join(map(_field_sql, ('doc_id', 'source', 'lang', 'n_chars', 'text')))}) AS h,
    sha256({' || '.join(map(_field_sql, ('doc_id', 'source', 'lang', 'n_chars')))} || {_field_sql(f"translate(text, '{_UP}', '{_LOW}')")}) AS low,
    coalesce({_CRC_SQL} % 3 = 0, false) AS bad FROM documents),
a0 AS (SELECT doc_id, lang, h, CASE WHEN bad THEN low ELSE h END AS held, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM l0),
{','.join(_level_sql(f'a{i}', f'a{i + 1}', 'lang, ', 'lang, ') for i in range(_LEVELS))},
t0 AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a{_LEVELS}),
{','.join(_level_sql(f't{i}', f't{i + 1}', '', '') for i in range(_TOPS))},
f0 AS (SELECT doc_id, lang, pos, n, h AS leaf, held AS f, '' AS proof FROM a0),
{','.join(f"""
f{i + 1} AS (SELECT f.doc_id, f.lang, f.pos // 8 AS pos, (f.n + 7) // 8 AS n, leaf, CASE WHEN f.n > 1 THEN sha256(lefts || f || rights) ELSE f END AS f,
    CASE WHEN f.n > 1 THEN proof || lefts || rights ELSE proof END AS proof
    FROM f{i} f JOIN a{i + 1}_s s ON f.lang IS NOT DISTINCT FROM s.lang AND f.pos = s.pos)""" for i in range(_LEVELS))},
g0 AS (SELECT f.doc_id, t.pos, t.n, leaf, f, proof, t.h AS subroot FROM f{_LEVELS} f JOIN t0 t ON f.lang IS NOT DISTINCT FROM t.lang),
{','.join(f"""
g{i + 1} AS (SELECT doc_id, g.pos // 8 AS pos, (g.n + 7) // 8 AS n, leaf, subroot, CASE WHEN g.n > 1 THEN sha256(lefts || f || rights) ELSE f END AS f,
    CASE WHEN g.n > 1 THEN proof || lefts || rights ELSE proof END AS proof FROM g{i} g JOIN t{i + 1}_s s ON g.pos = s.pos)""" for i in range(_TOPS))}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM g{_TOPS}, t{_TOPS}
"""


@_query("op11_merkle_manifest", _MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridterrain.llm.merkle import hex_text, leaf_digest, merkle_proofs, proof_digest

    names = ["doc_id", "source", "lang", "n_chars"]
    docs = _table(spark, sf_dir, "documents").select(*names, "text")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaf = leaf_digest(F.col(n) for n in [*names, "text"])
    lowered = leaf_digest([*[F.col(n) for n in names], F.translate("text", _UP, _LOW)])
    rows = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(tampered, lowered).alias("other"))
    rows = rows.select("doc_id", "lang", "leaf", F.coalesce("other", "leaf").alias("held"))
    found = merkle_proofs(rows, "doc_id", "lang", "leaf", "held")
    return found.select(
        "doc_id", hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"),
        hex_text(proof_digest(F.col("path"))).alias("proof_sha256"), hex_text(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_AUDIT_SQL = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
fails AS (
  SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask FROM w),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM fails LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
steps AS (SELECT filter_order, i::INTEGER AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0)::INTEGER AS earlier FROM orders, unnest(range(1, 6)) AS s(i)),
found AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & own = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & earlier <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & own <> 0 AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & own <> 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM found
"""


@_query("op12_filter_audit", _AUDIT_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridterrain.llm.audit import interactions, part_counters, stream_masks

    masks = stream_masks(spark, f"{sf_dir}/documents.parquet")
    return interactions(part_counters(masks, _table(spark, sf_dir, "labels")))


@_query("op13_quality_rules")
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridterrain.llm.outliers import judge_quality

    return judge_quality(_table(spark, sf_dir, "documents"))
