"""The registered queries of this package, each over its whole tables, and their checking SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefusion.llm import (chat, decontamination, divergence, fill_middle, html_text, licenses, line_dedup, mixing, near_dup,
                             neighbours, pii, quality, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op10_html_text")
def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, folder, "pages"), ["page_id", "url"])


@query("op9_personal_data")
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(table(spark, folder, "documents"), "doc_id")


CLASHING = "\\### Assistant: </turn> ok"


def _sql_escaped(text: str) -> str:
    for plain in ("\\", "### ", "</turn>", ": "):
        text = f"replace({text}, '{plain}', '\\{plain}')"
    return text


@query("op2_chat_format", f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CLASHING}' UNION ALL SELECT -7, 1, 'assistant', '{CLASHING}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escaped('role')}) + length({_sql_escaped('text')}) + {len('### : </turn>') + 1}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id""")
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", CLASHING), (-7, 1, "assistant", CLASHING)], rows.schema))
    records = rows.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    turns = chat.canonical_turns(records, ["conv_id", "turn"], "record")
    return chat.digests(chat.format_turns(turns), "conv_id", [F.col("turn"), F.col("role"), F.col("text")])


@query("op4_mix", r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, size, count(*) AS multiplicity, size * count(*) AS words, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash,
    coalesce('s' || source, 'n') AS sk
  FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)
  GROUP BY doc_id, source, size)
, sources AS (SELECT source, sk, CAST(sum(words) AS BIGINT) AS source_size FROM sized GROUP BY source, sk)
, weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sources)
, levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(source_size * 3.0::DOUBLE) OVER (
      ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed)
, targets AS (SELECT *, least(source_size * 3.0::DOUBLE, max(level) OVER () * weight) AS target FROM levels)
, rated AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size + 1e-9) AS BIGINT)) ELSE 0 END AS base FROM targets)
, plan AS (SELECT *, CASE WHEN base < 3 THEN greatest(0, CAST(round(target) AS BIGINT) - base * source_size) ELSE 0 END AS rest FROM rated)
, ranked AS (SELECT s.*, p.source_size, p.target, p.base, p.rest,
    row_number() OVER w AS pos, CAST(sum(words) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized s JOIN plan p ON s.sk = p.sk WINDOW w AS (PARTITION BY s.sk ORDER BY s.hash, s.doc_id NULLS FIRST, s.size))
, gaps AS (SELECT sk, CAST(max(rest) - sum(CASE WHEN upto <= rest THEN words ELSE 0 END) AS BIGINT) AS gap FROM ranked GROUP BY sk)
, free AS (SELECT r.sk, g.gap, list({w: r.words, p: r.pos} ORDER BY r.words DESC, r.pos DESC) FILTER (WHERE r.words <= g.gap) AS docs
  FROM ranked r JOIN gaps g ON r.sk = g.sk WHERE r.upto > r.rest AND r.rest > 0 AND r.words > 0 GROUP BY r.sk, g.gap)
, fill AS (SELECT sk, gap, docs, CAST(NULL AS BIGINT) AS pos FROM free UNION ALL
  SELECT sk, gap - docs[1].w, list_filter(docs[2:], lambda d: d.w <= gap - docs[1].w), docs[1].p FROM fill WHERE len(docs) > 0)
, picked AS (SELECT sk, pos FROM fill WHERE pos IS NOT NULL)
, copied AS (SELECT r.*, least(3, r.base + CASE WHEN r.upto <= r.rest OR k.pos IS NOT NULL THEN 1 ELSE 0 END) AS copies
  FROM ranked r LEFT JOIN picked k ON r.sk = k.sk AND r.pos = k.pos)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken
FROM (SELECT *, unnest(range(multiplicity)) AS again FROM copied)""")
def op4_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("rate", "copies")


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("text_hash")


@query("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"))


@query("op3_quality")
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.importance_sample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(~held)
    scored = toxicity.toxicity(table(spark, folder, "documents"), labels)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op1_neighbours")
def op1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


@query("op6_licenses")
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query("op13_fill_middle", r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS parts,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents)
, chosen AS (
  SELECT doc_id, text, parts, CAST(len(parts) AS BIGINT) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(parts) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(parts) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
         WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM units)
, cut AS (
  SELECT doc_id, text, n, form, array_to_string(parts[1:least(c1, c2)], '') AS p,
    array_to_string(parts[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(parts[greatest(c1, c2) + 1:], '') AS s
  FROM chosen)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                   ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut""")
def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    formed = fill_middle.restore(fill_middle.fill_in_middle(table(spark, folder, "documents")))
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                         F.sha2("restored", 256).alias("restored_sha256"))


@query("op11_source_divergence", r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents)
, counted AS (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs
  FROM (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(terms) AS term FROM docs) GROUP BY lang, source, r, term)
  GROUP BY lang, source, term)
, kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY lang, term HAVING sum(docs) >= 30)
, langs AS (SELECT l.lang, count(k.term) AS v, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS total
  FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k ON l.lang = k.lang GROUP BY l.lang)
, groups AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT c.* FROM counted c JOIN kept k ON c.lang = k.lang AND c.term = k.term) c ON g.lang = c.lang AND g.source = c.source
  GROUP BY g.lang, g.source)
, shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.total + 5 * l.v) AS BIGINT) AS p,
    1 + CAST(1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * l.v) AS BIGINT) AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN kept k ON g.lang = k.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term)
, far AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source)
, pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source)
, parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 50""")
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))


@query("op12_line_dedup", """
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
, lines AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs)
, keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines)
, often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3)
, marked AS (SELECT e.*, coalesce(o.k IS NOT NULL AND e.doc_id IS DISTINCT FROM o.last, FALSE) AS gone FROM keyed e LEFT JOIN often o ON e.k = o.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id""")
def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.without_repeated_lines(table(spark, folder, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
