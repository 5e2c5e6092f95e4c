"""The registered queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import ann, byte_bpe, chat, decontaminate, html_text, langid, line_dedup, manifest, periodic, setsketch, simhash, toxicity, warc
from wayline.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    lexicon = toxicity.learn(materialize(toxicity.join_labels(docs, labels), "labelled"))
    return toxicity.score(docs, lexicon).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


#: The rank file and the pattern that go together.
VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return byte_bpe.round_trip(docs, VOCABULARY, PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


#: A conversation of its own whose texts look like control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    back = chat.read_back(chat.format_chats(chat.log_of(rows.unionByName(probe))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op4_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), measured AS (
    SELECT *, length(regexp_replace(role || text, '[^\\<#]', '', 'g')) AS escapes FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + escapes + 20)::BIGINT AS formatted_chars
FROM measured GROUP BY conv_id
"""


@query
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    records = warc.list_records(warc.write_packages(pages))
    return warc.read_records(records, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op6_warc"] = r"""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), heads AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS head FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN head < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head < page_id THEN head END AS refers_to
FROM heads
"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return langid.identify(docs, langid.train(docs), declared="lang", host="source")


@query
def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over pages: declared markup language, address and host next to the page's main text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    texts = html_text.extract(pages.withColumn("declared", langid.declared_language(F.col("html"))))
    return langid.identify(texts, langid.train(docs), keys=("page_id",), declared="declared", url="url")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op8_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, pos, parts[pos] AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
         unnest(range(1, len(parts) + 1)) AS u(pos)
), keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT k.*, coalesce(k.doc_id < r.keeper, false) AS dropped FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), n=1)


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` in which the words of every tenth text, by the crc32 of its id, repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), "")
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    unit = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & (F.size(words) > 0), changed).otherwise(F.col("text")))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periods(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    most, line = periodic.strongest(F.col("runs")), lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    found = periodic.periodic_runs(docs).select("*", most.alias("most"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"most.{k}").alias(k) for k in ("start", "length", "period")],
        F.floor(1000 * F.col("most.length") / F.col("most.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*manifest.FIELDS)
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    values = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in manifest.FIELDS]
    proved = manifest.manifest(docs, keep=[F.when(altered, manifest.row_digest(values)).alias("tampered")])
    folded = proved.withColumn("folded_root", manifest.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE polynomial AS (
    SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
    FROM range(256) AS r(i)
), marked AS (
    SELECT *, coalesce('=' || source, '') AS grp,
           xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS altered
    FROM documents, polynomial
), shown AS (
    SELECT doc_id, grp, altered, text,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
    FROM marked
), leaves AS (
    SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           CASE WHEN altered THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered
    FROM shown
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), tree AS (
    SELECT grp, 0 AS level, idx, n, leaf AS digest FROM numbered
    UNION ALL
    SELECT grp, any_value(level) + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx))
    FROM tree WHERE n > 1 GROUP BY grp, idx // 3
), subroots AS (
    SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS sidx, count(*) OVER () AS n FROM tree WHERE n = 1
), over AS (
    SELECT 0 AS level, sidx AS idx, n, subroot AS digest FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx)) FROM over WHERE n > 1 GROUP BY idx // 3
), steps AS (
    SELECT grp, level, idx, coalesce(string_agg(digest, '') OVER b, '') AS before, coalesce(string_agg(digest, '') OVER a, '') AS after FROM tree WHERE n > 1
    WINDOW b AS (PARTITION BY grp, level, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           a AS (PARTITION BY grp, level, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), over_steps AS (
    SELECT level, idx, coalesce(string_agg(digest, '') OVER b, '') AS before, coalesce(string_agg(digest, '') OVER a, '') AS after FROM over WHERE n > 1
    WINDOW b AS (PARTITION BY level, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           a AS (PARTITION BY level, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), paths AS (
    SELECT d.grp, d.idx, s.level, s.before, s.after FROM numbered d JOIN steps s ON s.grp = d.grp AND s.idx = d.idx // power(3, s.level)::BIGINT
    UNION ALL
    SELECT d.grp, d.idx, 1000 + s.level, s.before, s.after
    FROM numbered d JOIN subroots r ON r.grp = d.grp JOIN over_steps s ON s.idx = r.sidx // power(3, s.level)::BIGINT
), proofs AS (
    SELECT grp, idx, string_agg(before || after, '' ORDER BY level) AS proof, list(before || '|' || after ORDER BY level) AS walk FROM paths GROUP BY grp, idx
), folded AS (
    SELECT d.doc_id, d.leaf, r.subroot, (SELECT digest FROM over WHERE n = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
           list_reduce(list_concat([coalesce(d.tampered, d.leaf)], coalesce(p.walk, [])),
                       lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
    FROM numbered d JOIN subroots r ON r.grp = d.grp LEFT JOIN proofs p ON p.grp = d.grp AND p.idx = d.idx
)
SELECT *, folded_root = root AS verified FROM folded
"""


@query
def op12_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
