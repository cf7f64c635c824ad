"""How far the sources of a language are from each other, and which terms set a source apart: an audit in Arrow columns.

Terms are runs of letters and non-ASCII characters, only A-Z lower-cased. Inside `mapInArrow` a task lower-cases its texts (`ascii_lower`),
splits them (`split_pattern_regex`), encodes the terms (`dictionary_encode`) and counts them by hash `group_by`, first per document, then
per (language, source). These partial counts meet in one exchange and are summed. A language keeps the terms found in at least
`min_docs` of its documents. With V kept terms, N occurrences of them in a group and `smooth` added to each count, a term's share is
p = 1 + floor(SCALE * (count + smooth) / (N + smooth * V)), by long division in whole numbers.

The kept terms are dealt into shards of about `SHARD_TERMS` terms of one language, and the groups of a language into blocks of `BLOCK`
sources. Each (shard, block, block) is one small dense matrix of counts; its partial sums of |p - q| for every two sources, and each
source's best terms, leave the task, and an exchange merges them. The result itself has a row for every two sources of a language;
no task holds more than two blocks of one shard, however many rows a language has.

Defined results: null text, language and source are empty strings; groups whose documents hold no term take part with count 0; a language
without kept terms has distance 0 everywhere and no term rows; a language with one source has no pair rows; equal values are ordered
by item, in the order of UTF-8 bytes; repeated rows count again; texts of any length are read whole; an empty table gives an
empty result. Only the text, the language and the source are read; other columns, whatever their names, play no part. Counts are exact up to
9e15 occurrences in a group (`shares`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framefusion.llm.storage import broadcast_if_small, stored

# Fixed value: what stands between terms, as a pattern over code points.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 10 ** 9
SHARD_TERMS, BLOCK = 500, 128
CHUNK_BYTES, FLUSH_ROWS = 1 << 20, 1 << 18
_NAMES = ["lang", "source", "term"]


def shares(counts: np.ndarray, total: np.ndarray | int, terms: int, smooth: int) -> np.ndarray:
    """1 + floor(SCALE * (count + smooth) / (total + smooth * terms)), exactly: three digits of the quotient at a time, so that no
    product passes 2**63 while the divisor is below 9e15."""
    divisor = np.asarray(total, np.int64) + smooth * terms
    whole, rest = np.divmod(counts + smooth, divisor)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, divisor)
        whole = whole * 1000 + digits
    return whole + 1


def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about CHUNK_BYTES."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, side="right")))
        yield first, texts.slice(first, last - first)
        first = last


def count_terms(texts: pa.Array, groups: pa.Array) -> pa.Table:
    """(group, term, n, docs): occurrences and documents of every term, by the number of the group of each text."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
    terms = pc.dictionary_encode(pc.list_flatten(parts))
    table = pa.table({"row": pc.list_parent_indices(parts), "code": terms.indices})
    by_row = table.group_by(["row", "code"]).aggregate([([], "count_all")])
    by_row = by_row.append_column("group", groups.take(by_row["row"].combine_chunks()))
    counts = by_row.group_by(["group", "code"]).aggregate([("count_all", "sum"), ([], "count_all")])
    named = terms.dictionary.take(counts["code"].combine_chunks())
    out = pa.table({"group": counts["group"], "term": named, "n": counts["count_all_sum"], "docs": counts["count_all"]})
    return out.filter(pc.not_equal(out["term"], ""))


def _merged(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: (lang, source, term, n, docs). Groups are numbers until the counts leave the task."""
    numbers: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            names = [pa.array(x, pa.string()) for x in zip(*numbers)]
            for part in _merged(held, ["group", "term"]).to_batches(max_chunksize=1 << 14):
                group = part.column(0)
                yield pa.RecordBatch.from_arrays([names[0].take(group), names[1].take(group), *part.columns[1:]], [*_NAMES, "n", "docs"])
            held.clear()
            pa.default_memory_pool().release_unused()

    for batch in batches:
        texts, langs, sources = (batch.column(i).cast(pa.string()).fill_null("") for i in range(3))
        groups = pa.array([numbers.setdefault(x, len(numbers)) for x in zip(langs.to_pylist(), sources.to_pylist())], pa.int64())
        for first, piece in _pieces(texts):
            held.append(count_terms(piece, groups.slice(first, len(piece))))
            rows += held[-1].num_rows
            if rows > FLUSH_ROWS:
                held[:] = [_merged(held, ["group", "term"])]
                rows = held[0].num_rows
                if rows > FLUSH_ROWS // 2:
                    yield from flush()
                    rows = 0
    yield from flush()


def _texts(docs: DataFrame, **columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(docs[f"`{c}`"].cast("string"), F.lit("")).alias(name) for name, c in columns.items()])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) of every term. The tasks have summed their rows, so these meet by (lang, term) at once: what
    follows then finds all sources of a term in one place."""
    partial = _texts(docs, text=text, lang=lang, source=source).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return partial.repartition("lang", "term").groupBy(*_NAMES).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _best(values: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` largest values; all that tie with the last of them as well."""
    if len(values) <= most:
        return np.arange(len(values))
    return np.flatnonzero(values >= np.partition(values, len(values) - most)[len(values) - most])


def _audit(smooth: int, top: int):
    """A function of the counts and the groups of one (shard, left block, right block)."""

    def audit(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang, _, left, right = (k.as_py() for k in key)
        terms = counts["term"].combine_chunks().dictionary_encode()
        places = terms.indices.to_numpy()
        names = groups["source"].combine_chunks()
        rows = pc.index_in(counts["source"].combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
        matrix = np.zeros((len(names), len(terms.dictionary)), np.int64)
        matrix[rows, places] = counts["n"].to_numpy()
        total, kept = groups["total"].to_numpy(), int(groups["v"][0].as_py())
        p, nothing = shares(matrix, total[:, None], kept, smooth), shares(np.zeros(len(names), np.int64), total, kept, smooth)
        # Terms of the shard that neither block has.
        unseen = int(groups["terms"][0].as_py()) - matrix.shape[1]
        block = groups["block"].to_numpy()
        some, other = np.flatnonzero(block == left), np.flatnonzero(block == right)
        found: list[tuple[pa.Array, str, pa.Array, np.ndarray]] = []
        for i in some:
            far = np.abs(p[other] - p[i]).sum(axis=1) + unseen * np.abs(nothing[other] - nothing[i])
            names_i, others = pa.repeat(names[i], len(other)), names.take(pa.array(other))
            if left != right:
                found += [(names_i, "pair", others, far), (others, "pair", names_i, far)]
                continue
            apart = pa.array(other != i)
            found.append((names_i.filter(apart), "pair", others.filter(apart), far[other != i]))
            of_all = np.zeros(matrix.shape[1], np.int64)
            of_all[places] = counts["lang_n"].to_numpy()
            q = shares(of_all, int(groups["lang_total"][0].as_py()), kept, smooth)
            ahead = np.flatnonzero((matrix[i] > 0) & (p[i] > q))
            ahead = ahead[_best(p[i, ahead] - q[ahead], top)]
            found.append((pa.repeat(names[i], len(ahead)), "term", terms.dictionary.take(pa.array(ahead)), p[i, ahead] - q[ahead]))
        size = sum(len(x[3]) for x in found)
        return pa.table({
            "lang": pa.repeat(pa.scalar(lang, pa.string()), size), "source": pa.chunked_array([x[0] for x in found], pa.string()),
            "part": pa.chunked_array([pa.repeat(pa.scalar(x[1], pa.string()), len(x[3])) for x in found], pa.string()),
            "item": pa.chunked_array([x[2] for x in found], pa.string()),
            "value": pa.chunked_array([pa.array(x[3], pa.int64()) for x in found], pa.int64())})

    return audit


def divergences(counts: DataFrame, every: DataFrame, min_docs: int = 30, smooth: int = 5, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) from the counts of `term_counts`, which are read twice (write them first), and from
    every (lang, source) that occurs."""
    kept = (counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
            .where(F.col("docs") >= min_docs).select("lang", "term", "lang_n"))
    kept = stored(kept, "divergence-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")).select(
        "*", F.ceil(F.col("v") / SHARD_TERMS).cast("int").alias("shards"))
    langs = broadcast_if_small(langs)
    terms = kept.join(langs.select("lang", "shards"), "lang").select(
        "lang", "term", "lang_n", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    held = stored(counts.drop("docs").join(broadcast_if_small(terms), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "shard"), "divergence-kept")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    blocks = every.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    groups = every.join(blocks, "lang").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("total"), "v", "lang_total", "shards", "blocks",
        F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"))
    groups = stored(groups, "divergence-groups")
    # Every block meets itself and all others once, as (left, right) with left <= right.
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(
        F.least("block", b).alias("left"), F.greatest("block", b).alias("right"))))
    keys = ["lang", "shard", "left", "right"]
    counted = held.join(groups.select("lang", "source", "block", "blocks"), ["lang", "source"]).select("*", meets.alias("m")).select(
        "lang", "shard", "m.left", "m.right", "source", "term", "n", "lang_n")
    sizes = terms.groupBy("lang", "shard").agg(F.count(F.lit(1)).alias("terms"))
    sided = groups.join(sizes, "lang").select("*", meets.alias("m")).select(
        "lang", "shard", "m.left", "m.right", "source", "total", "v", "lang_total", "block", "terms")
    partial = counted.groupBy(*keys).cogroup(sided.groupBy(*keys)).applyInArrow(
        _audit(smooth, top), "lang string, source string, part string, item string, value long")
    merged = stored(partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "divergence-parts")
    # A language without kept terms has no shard: its sources are all at distance 0.
    bare = groups.where("shards IS NULL").select("lang", "source")
    level = bare.join(bare.withColumnRenamed("source", "item"), "lang").where(F.col("source") != F.col("item")).select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).cast("int").alias("rank")
    pairs = merged.where(F.col("part") == "pair").unionByName(level).select("*", rank)
    return pairs.unionByName(merged.where(F.col("part") == "term").select("*", rank).where(F.col("rank") <= top))


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30,
                      smooth: int = 5, top: int = 50) -> DataFrame:
    """The audit of a table of documents."""
    every = _texts(docs, lang=lang, source=source).distinct()
    return divergences(stored(term_counts(docs, text, lang, source), "divergence-counts"), every, min_docs, smooth, top)
