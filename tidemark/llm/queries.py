"""Named queries of the training-data operators, with SQL twins where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm import (
    filter_audit, line_rules, main_text, mixing, multi_index, ngram_join, one_bit_search, periodic_runs, private_data,
    quality_trees, toxicity, warc)
from tidemark.llm.common import crc_bucket, table
from tidemark.llm.packing import pack_documents


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicate(table(spark, sf_dir, "pages"))


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.training_order(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    trees = quality_trees.learn(docs, labels, ~held_out)
    scored = quality_trees.score(docs, trees, 0.3)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False))
    weights = toxicity.learn(docs, labels, ~held_out)
    scored = toxicity.score(docs, weights, 0.7)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return one_bit_search.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), "vec_id", "embedding")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return private_data.find(docs, private_data.learn(docs))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of a document: in one of ten, by hash, words recur from a place on. Not without an id."""
    key = zlib.crc32(str(doc_id).encode())
    if doc_id is None or key % 10 or not n:
        return None
    at = (key // 10) % n
    period = 1 + (n - at) // (3 + key // 10 % 8)
    places = np.arange(n)
    places[at:] = at + (places[at:] - at) % period
    return places


def _text_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(table(spark, sf_dir, "documents"), order=planted_order)
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    longest = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        _text_digest(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))).alias("runs_sha256"),
        _text_digest(F.col("text")).alias("collapsed_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.links(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_vector_packing": op2_vector_packing,
    "op3_mixing_sources": op3_mixing_sources,
    "op4_quality_trees": op4_quality_trees,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_toxicity": op6_toxicity,
    "op7_one_bit_search": op7_one_bit_search,
    "op8_main_text": op8_main_text,
    "op9_private_data": op9_private_data,
    "op10_line_rules": op10_line_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_filter_audit": op12_filter_audit,
    "op13_multi_index": op13_multi_index,
}

_MIX = r"""
with sizes as (
  select doc_id, source is null as no_source, coalesce(source, '') as source_key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, '')) as key
  from documents),
sources as (
  select no_source, source_key, sum(size)::bigint as source_size,
    ([3.0, 1.0, 2.0]::double[])[(row_number() over (order by no_source, source_key) - 1) % 3 + 1] as weight
  from sizes group by no_source, source_key),
ranked as (
  select *, 2.0::double * source_size as cap,
    row_number() over (order by 2.0::double * source_size / weight, no_source, source_key) as place from sources),
factors as (
  select *, (1.5::double * sum(source_size) over ()
      - coalesce(sum(cap) over (order by place rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by place rows between current row and unbounded following) as factor
  from ranked),
targets as (
  select no_source, source_key, source_size,
    least(cap, coalesce((select min_by(f.factor, f.place) from factors f where f.factor <= f.cap / f.weight) * weight, cap)) as target
  from factors),
placed as (
  select s.*, t.source_size, t.target,
    sum(size) over (partition by no_source, source_key order by key, doc_id nulls first, size rows unbounded preceding) - size / 2.0::double as middle
  from sizes s join targets t using (no_source, source_key))
select doc_id, size, source_size, target,
  (size * ((middle < target)::int + (middle + source_size < target)::int))::bigint as taken
from placed"""

_LINES = r"""
with base as (
  select doc_id, source, coalesce(text, '') as text from documents),
words as (
  select doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from base),
places as (
  select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c
  from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as i from words)),
twice as (
  select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from places),
covered as (
  select doc_id, count(distinct i + k)::bigint as n
  from twice, (values (0), (1), (2)) as s(k) where twice.n > 1 group by doc_id),
each_line as (
  select distinct doc_id, source,
    trim(translate(lower(x), '123456789', '000000000'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line
  from (select doc_id, source, unnest(lines) as x from words)),
many as (select source, line from each_line group by all having count(*) > 100),
lost as (
  select e.doc_id, sum(len(e.line)) filter (m.line is not null) as lost, sum(len(e.line)) as chars
  from each_line e left join many m on m.line = e.line and m.source is not distinct from e.source group by e.doc_id),
counts as (
  select doc_id, len(w)::bigint as n_words,
    len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (len(text) - len(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words
  from words left join covered using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and coalesce(lost, 0) <= 0.5 * coalesce(chars, 0) as kept
from counts left join lost using (doc_id)"""

_AUDIT = r"""
with facts as (
  select d.doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, coalesce(quality = 1, false) as good,
    coalesce(toxic = 1, false) as toxic, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents d left join (
    select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) l on d.doc_id = l.doc_id),
firsts as (select text, min(doc_id) as least from facts group by text),
fails as (
  select part, good, toxic,
    (len(w) < 100)::int
    + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
    + 4 * (100 * (len(text) - len(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * len(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > least, false)::int as mask
  from facts join firsts using (text)),
counts as (
  select part, mask, count(*)::bigint as n, (count(*) filter (good))::bigint as good, (count(*) filter (toxic))::bigint as toxic
  from fails group by part, mask),
letters as (select unnest([0, 1, 2, 3, 4]) as f, unnest(['A', 'B', 'C', 'D', 'E']) as letter),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.f, b.f, c.f, d.f, e.f] as fs
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
ranks as (
  select part, filter_order, fs, mask, n, good, toxic,
    coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda s: (mask >> fs[s]) & 1 = 1)), 6) as step
  from counts, orders),
steps as (
  select part, filter_order, s.step, fs[s.step] as f, mask, n, good, toxic, ranks.step as gone
  from ranks, (select unnest([1, 2, 3, 4, 5])::int as step) s),
table_ as (
  select part, filter_order, step, f,
    coalesce(sum(n) filter (gone > step), 0)::bigint as kept,
    coalesce(sum(n) filter (gone = step), 0)::bigint as removed,
    coalesce(sum(n) filter ((mask >> f) & 1 = 1 and gone < step), 0)::bigint as redundant,
    coalesce(sum(n) filter (mask = 1 << f), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (gone = step), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (gone = step), 0)::bigint as toxic_lost
  from steps group by part, filter_order, step, f)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, f))::bigint as shapley
from table_"""

ORACLES: dict[str, str] = {
    "op3_mixing_sources": _MIX,
    "op10_line_rules": _LINES,
    "op12_filter_audit": _AUDIT,
}
