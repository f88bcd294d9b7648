"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.llm import (
    count_rtree,
    exact_dedup,
    fair_mix,
    importance,
    language_crf,
    lbl,
    perspectives,
    quality,
    spelling_trie,
    token_files,
    url_templates,
    warc_index,
    winnow,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("n_chunks")


ORACLES["op1_chunk_recipes"] = r"""
with d as (select doc_id, length(coalesce(text, '')) as points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
       row_number() over w = 1 as kept, sha256(norm) as text_sha256
from d window w as (partition by norm order by points desc, doc_id)
"""


@query
def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # The table has no fetch times; page ids count captures up, so they stand in, as seconds.
    ts = F.date_format(F.timestamp_seconds("page_id"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    records, _, _ = warc_index.archive(pages, ts=ts)
    return records.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast("long").alias("refers_to"))


@query
def op3_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op3_fair_mix"] = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, 2 * cast(sum(size) as bigint) as cap,
             list_value(5, 2, 1)[1 + cast((row_number() over (order by source nulls last) - 1) % 3 as int)] as weight
      from d group by source),
l as (select *, sum(source_size) over () * cast(1.5 as double) as budget,
             coalesce(sum(cap) over before, 0) as cap_before, sum(weight) over () - coalesce(sum(weight) over before, 0) as heavy
      from s window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, cap * heavy <= (budget - cap_before) * weight as is_full from l),
t as (select source, source_size,
             case when is_full then cast(cap as double)
                  else (budget - sum(case when is_full then cap else 0 end) over ())
                       / sum(case when is_full then 0 else weight end) over () * weight end as target
      from f),
q as (select doc_id, size, source_size, target, cast(floor(target) as bigint) as cut,
             cast(coalesce(sum(size) over (partition by d.source order by md5(cast(doc_id as varchar)), doc_id
                      rows between unbounded preceding and 1 preceding), 0) as bigint) as before
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       least(size, greatest(cut - before, 0)) + least(size, greatest(cut - before - source_size, 0)) as taken
from q
"""


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    store = token_files.write_token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_store(store)


def bucket_of(doc_id: str, parts: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), bucket_of("of", 4) != 2)
    return quality.score_quality(docs, model).select(
        "doc_id", F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


ORACLES["op6_winnowing"] = r"""
with words as (
  select 'd' as kind, cast(doc_id as varchar) as id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'i', cast(item_id as varchar), null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
items as (select id, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p, w from words where kind = 'i' and len(w) > 0),
iw as (select distinct id, n, array_to_string(w[p:p + n - 1], ' ') as win from items),
docs as (select id, w, lens.n as n, unnest(range(1, cast(len(w) - lens.n + 2 as bigint))) as p
         from words, (select distinct n from iw) lens where kind = 'd' and len(w) >= lens.n),
dw as (select id, n, p, array_to_string(w[p:p + n - 1], ' ') as win from docs),
hit as (select distinct d.id, d.p, d.n, iw.id as item from dw d join iw on d.n = iw.n and d.win = iw.win),
n_hit as (select id, count(distinct k) as n_hit from (select id, unnest(range(p, p + n)) as k from hit) group by id),
its as (select id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct id, item from hit) group by id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join n_hit using (id) left join its using (id) where kind = 'd'
"""


@query
def op7_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket_of("doc_id", 5) == 1
    # A row without an id has no remainder: it is neither held out nor learnt from.
    model = lbl.fit_lm(docs.where(bucket_of("doc_id", 5) != 1))
    return lbl.score_lm(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                                            "base_score", "score")


RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@query
def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, sf_dir, "pages"), RULES).withColumnRenamed("id", "page_id")


@query
def op9_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rtree.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = perspectives.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return views.withColumn("mask", spans).drop("offset")


ORACLES["op10_perspectives"] = r"""
with m as (
  select conv_id, case when trim(coalesce(role, '')) = '' then 'unknown'
                       else regexp_replace(trim(role), '[\s<>|]+', '_', 'g') end as speaker,
         replace(coalesce(text, ''), '<|', '< |') as body, turn from conversations),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, speaker, body) - 1 as pos from m),
g as (select *, pos // 64 as segment from n),
w as (select distinct conv_id, speaker as perspective from g where speaker <> 'system'),
v as (select w.conv_id, segment, perspective from w join (select distinct conv_id, segment from g) s on w.conv_id is not distinct from s.conv_id),
r as (select v.conv_id, v.segment, v.perspective, pos, speaker = perspective as trained,
             '<|im_start|>' || case when speaker = 'system' then 'system' when speaker = perspective then 'assistant'
                                    else 'user name=' || speaker end || chr(10) as head,
             body || '<|im_end|>' as body
      from v join g on v.conv_id is not distinct from g.conv_id and v.segment = g.segment),
o as (select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, segment, perspective order by pos
                  rows between unbounded preceding and 1 preceding), 0) + length(head) as start from r)
select conv_id, segment, perspective, count(*) as n_messages, count(*) filter (trained) as n_trained,
       string_agg(head || body || chr(10), '' order by pos) as rendered,
       coalesce(string_agg(cast(start as bigint) || '-' || cast(start + length(body) as bigint), ',' order by pos) filter (trained), '') as mask
from o group by conv_id, segment, perspective
"""


@query
def op11_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # A row without an id has no remainder: it is neither held out nor learnt from.
    model = language_crf.fit_languages(docs, bucket_of("doc_id", 5) != 0)
    return language_crf.predict_languages(docs, model).select(
        "doc_id", F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op12_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_trie.spelling_variants(spelling_trie.word_counts(table(spark, sf_dir, "documents")))


# CRC-32 of a word: its table by the rule of the polynomial, then a fold over the UTF-8 bytes.
CRC_TABLE = """crc as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b::bigint, [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
               lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end)) as tab)"""
CRC_OF_HEX = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(hex), 2), lambda i: ('0x' || substr(hex, i, 2))::bigint)),
                  lambda c, x: xor(tab[1 + (xor(c, x) & 255)], c >> 8)), 4294967295::bigint)"""

ORACLES["op12_spelling_trie"] = f"""
with recursive {CRC_TABLE},
r as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
q as (select run, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as hex, count(*) as n from r group by doc_id, run),
h as (select run, n, {CRC_OF_HEX} as h from q, crc),
w as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h),
v as (select word, cast(sum(n) as bigint) as n from w where length(word) >= 5 group by word having sum(n) >= 3),
g as (select word, unnest(range(1, length(word) + 1)) as i, substr(word, 1, i - 1) || substr(word, i + 1) as gap from v),
e as (select g.word as long, v.word as short from g join v on v.word = gap),
p as (select a.word, b.word as near from g a join g b using (i, gap) where a.word <> b.word
      union select long, short from e union select short, long from e),
f as (select p.word, count(*) as n_near, arg_min(near, (-o.n, near)) as best, max(o.n) as best_n from p join v o on o.word = p.near group by p.word),
t as (select v.word, n, coalesce(n_near, 0) as n_near, case when best_n >= 2 * n then best end as form, case when best_n >= 2 * n then best_n end as form_n
      from v left join f using (word)),
s as (select word, word as root from t union all select s.word, t.form from s join t on t.word = s.root where t.form is not null)
select t.word, t.form, arg_max(s.root, o.n) as root, t.n, t.n_near, t.form_n from t join s using (word) join t o on o.word = s.root
group by t.word, t.form, t.n, t.n_near, t.form_n
"""


@query
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op13_importance"] = rf"""
with {CRC_TABLE},
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
dw as (select doc_id, unnest(w) as word from d), bw as (select unnest(w) as word from b),
v as (select word, hex(encode(word)) as hex from (select word from dw union select word from bw)),
k as (select word, {CRC_OF_HEX} % 10000 as bucket from v, crc),
s as (select bucket, count(*) as s from dw join k using (word) group by bucket), t as (select bucket, count(*) as t from bw join k using (word) group by bucket),
g as (select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + 10000)::double
             / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t) + 10000)::double))) as bigint) as gain
      from (select distinct bucket from k) left join s using (bucket) left join t using (bucket)),
e as (select doc_id, w, ('0x' || left(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 8))::bigint as h from d),
f as (select doc_id, sum(gain) as weight from dw join k using (word) join g using (bucket) group by doc_id),
r as (select doc_id, cast(len(w) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
             cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from e left join f using (doc_id)),
o as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as n from r)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n // 100 then place end as rank from o
"""
