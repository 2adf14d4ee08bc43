"""The registered queries of this folder, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairledger.llm import (
    collocations,
    decontam,
    exact_dedup,
    jaccard_join,
    line_dedup,
    lm_score,
    mixing,
    quality_lm,
    sharding,
    simhash_join,
    token_alignment,
    toxicity,
    warc,
)

SHARDS = 16
MIX_SEED = 17
SHARD_SEED = 29

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


OP1_SQL = f"""
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(body) as text_sha256
from (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as body from documents)
window same as (partition by body)
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), SHARDS, SHARD_SEED)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.backoff_scores(table(spark, sf_dir, "documents"))
    return scores.select(
        "doc_id", "n_words", "hits_1", "hits_2", "hits_3", F.round("log_score", 4).alias("log_score"),
        F.round("per_word", 6).alias("per_word"))


OP4_SQL = f"""
with d as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\\x20\\x09-\\x0D]+') as w
  from documents
), t as materialized (
  select doc_id, i, w[i] as a, case when i > 1 then w[i - 1] || ' ' || w[i] end as b,
         case when i > 2 then w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] end as c,
         case when i > 1 then w[i - 1] end as ca,
         case when i > 2 then w[i - 2] || ' ' || w[i - 1] end as cb
  from d, unnest(range(1, len(w) + 1)) u(i)
), n1 as materialized (select a as g, count(*) as n from t group by a),
n2 as materialized (select b as g, count(*) as n from t where b is not null group by b),
n3 as materialized (select c as g, count(*) as n from t where c is not null group by c),
s as (
  select doc_id, case when n3.n >= {lm_score.LEAST} then 3 when n2.n >= {lm_score.LEAST} then 2
                      else 1 end as hit,
         least(i, 3) as longest, n1.n as c1, n2.n as c2, n3.n as c3, x1.n as d1, x2.n as d2
  from t join n1 on n1.g = a left join n2 on n2.g = b left join n3 on n3.g = c
  left join n1 x1 on x1.g = ca left join n2 x2 on x2.g = cb
), v as (
  select doc_id, count(*) as n_words, count(*) filter (hit = 1) as hits_1,
         count(*) filter (hit = 2) as hits_2, count(*) filter (hit = 3) as hits_3,
         sum((longest - hit) * ln({lm_score.BACKOFF}) + case hit
             when 3 then ln(c3) - ln(d2) when 2 then ln(c2) - ln(d1)
             else ln(c1) - ln((select count(*) from t)) end) as log_score
  from s group by doc_id
)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(hits_1, 0) as hits_1,
       coalesce(hits_2, 0) as hits_2, coalesce(hits_3, 0) as hits_3,
       round(coalesce(log_score, 0), 4) as log_score, round(log_score / n_words, 6) as per_word
from documents left join v using (doc_id)
"""


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), seed=MIX_SEED)
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken", "source", "blocks", "first_shard")


# Quotients are listed one by one here. The level at which unbounded sources stand is the first
# whose next bound it does not pass; a source's words in the mix are its blocks' worth.
OP5_SQL = f"""
with d as materialized (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size
  from documents
), s as materialized (
  select source, sum(size)::bigint as source_size,
         1 + (row_number() over (order by source nulls last) - 1) % 3 as weight,
         row_number() over (order by source nulls last) as place
  from d group by source
), b as materialized (
  select *, {mixing.REPEATS} * source_size as bound,
         sum(source_size) over () as total,
         coalesce(sum({mixing.REPEATS} * source_size) over before, 0)::bigint as bounded,
         (sum(weight) over () - coalesce(sum(weight) over before, 0))::bigint as weights_left
  from s
  window before as (order by {mixing.REPEATS} * source_size / weight, place
                    rows between unbounded preceding and 1 preceding)
), level as (
  select (total - bounded)::bigint as rest, weights_left as shared_by from b
  where weight * (total - bounded) <= bound * weights_left
  order by bound / weight, place limit 1
), t as materialized (
  select source, place, source_size, total,
         least(bound::double, (weight * rest)::bigint::double / shared_by) as target
  from b, level
), seats as (select any_value((total + {mixing.BLOCK_WORDS - 1}) // {mixing.BLOCK_WORDS})::bigint as n
             from t),
awards as (
  select source, row_number() over (order by target / (2 * k + 1) desc, place, k) - 1 as award
  from t, (select unnest(range((select n from seats) + 1)) as k)
  where target > 0 and k <= target / {mixing.BLOCK_WORDS} + (select count(*) from s)
  qualify award < (select n from seats)
), dealt as materialized (
  select source, row_number() over (partition by source order by award) - 1 as block,
         (select min(x) from unnest(range({mixing.SHARDS})) u(x)
          where award < (select n from seats) * (x + 1) // {mixing.SHARDS}) as shard
  from awards
), quota as (select source, count(*) as blocks from dealt group by source),
placed as (
  select *, coalesce(sum(size) over (
    partition by source order by md5({MIX_SEED} || ':' || coalesce(doc_id::varchar, '') || ':' || size),
    size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d
), taken as (
  select p.doc_id, p.source, p.size, t.source_size, t.target, coalesce(q.blocks, 0) as blocks, start,
         list_sum([greatest(0, least(p.size, least(coalesce(q.blocks, 0) * {mixing.BLOCK_WORDS},
           {mixing.REPEATS} * t.source_size) - t.source_size * k - start))
           for k in range({mixing.REPEATS})])::bigint as taken
  from placed p join t on p.source is not distinct from t.source
  left join quota q on p.source is not distinct from q.source
)
select x.doc_id, x.size, x.source_size, x.target, x.taken, x.source, x.blocks,
       case when x.taken > 0 then e.shard end::int as first_shard
from taken x left join dealt e
  on x.source is not distinct from e.source and e.block = x.start // {mixing.BLOCK_WORDS}
"""


#: Date of the crawl that `pages` stand for.
CRAWLED = "2024-01-01T00:00:00Z"


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.derive(warc.responses(pages, CRAWLED))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted",
        "clauses")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), 4, (85, 100))


OP8_SQL = f"""
with recursive d as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\\x20\\x09-\\x0D]+') as w
  from documents
), g as materialized (
  select distinct doc_id, hash(array_to_string(w[k : k + least(4, len(w)) - 1], ' ')) as g
  from d, unnest(range(1, len(w) - least(4, len(w)) + 2)) u(k) where len(w) > 0
), n as materialized (select doc_id, count(*) as n from g group by doc_id),
links as materialized (
  select a.doc_id as x, b.doc_id as y
  from g a join g b on a.g = b.g and a.doc_id != b.doc_id
  join n l on l.doc_id = a.doc_id join n r on r.doc_id = b.doc_id
  where 100 * least(l.n, r.n) >= 85 * greatest(l.n, r.n)
  group by a.doc_id, b.doc_id, l.n, r.n
  having 100 * count(*) >= 85 * (l.n + r.n - count(*))
), reach as (
  select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x
)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(least(doc_id, min(y)), doc_id) as component_id
from documents left join n using (doc_id) left join reach on x = doc_id group by doc_id, n
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP9_SQL = f"""
with i as materialized (
  select item_id, w, least(5, len(w)) as width
  from (select item_id, {_WORDS} as w from benchmark where text is not null) where len(w) > 0
), s as materialized (
  select distinct item_id, width, array_to_string(w[k : k + width - 1], ' ') as g
  from i, unnest(range(1, len(w) - width + 2)) u(k)
), d as materialized (
  select doc_id, {_WORDS} as w from documents where text is not null
), g as materialized (
  select distinct doc_id, width, array_to_string(w[k : k + width - 1], ' ') as g
  from d, (select distinct width from s), unnest(range(1, len(w) - width + 2)) u(k)
), n as (select item_id, count(*) as item_shingles from s group by item_id)
select doc_id, item_id, item_shingles, count(*) as found, count(*) / item_shingles as containment
from g join s using (width, g) join n using (item_id)
group by doc_id, item_id, item_shingles having 5 * count(*) >= 4 * item_shingles
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", F.coalesce(F.size("spans"), F.lit(0)).alias("removed_units"), "removed_chars",
        F.concat_ws(";", F.transform("spans", lambda s: F.concat(
            s["start"], F.lit("+"), s["length"], F.lit("="), s["keep_doc_id"], F.lit(":"),
            s["keep_start"]))).alias("removed"),
        "clean_text",
    )


# Passages by words: two texts are laid over each other at each offset at which they share a unit, and
# the runs of equal words that hold one are measured. Ids are unique in the table.
OP10_SQL = f"""
with d as materialized (select doc_id, text from documents where doc_id is not null),
pieces as (
  select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as unit
  from (select doc_id, regexp_extract_all(
          coalesce(text, ''), '(?s).+?(?:[.!?][ \t]+|\n+|$)') as p from d)
), u as materialized (
  select doc_id, (sum(length(piece)) over (partition by doc_id order by unit) - length(piece))::bigint as start,
         regexp_extract_all(translate(piece, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as words,
         (sum(len(words)) over (partition by doc_id order by unit) - len(words))::bigint as first_word
  from pieces
), o as materialized (
  select doc_id, start, len(words) as n, first_word, first_value(doc_id) over same as keep_doc_id,
         first_value(start) over same as keep_start, first_value(first_word) over same as keep_first
  from u where len(words) >= {line_dedup.UNIT_WORDS}
  window same as (partition by array_to_string(words, ' ') order by doc_id, start)
), again as (select * from o where doc_id != keep_doc_id or start != keep_start),
pairs as (
  select doc_id, keep_doc_id from again group by all having sum(n) >= {line_dedup.SHARED_WORDS}
), laid as materialized (
  select doc_id, keep_doc_id, first_word - keep_first as shift, list(distinct first_word) as anchors
  from again semi join pairs using (doc_id, keep_doc_id) group by all
), w as materialized (
  select doc_id, unnest(words) as word, first_word + generate_subscripts(words, 1) - 1 as i from u
), equal as (
  select laid.doc_id, keep_doc_id, shift, w.i,
         w.i - row_number() over (partition by laid.doc_id, keep_doc_id, shift order by w.i) as run
  from laid join w on w.doc_id = laid.doc_id
  join w k on k.doc_id = keep_doc_id and k.i = w.i - shift and k.word = w.word
), runs as (
  select doc_id, keep_doc_id, shift, min(i) as lo, max(i) as hi from equal
  group by doc_id, keep_doc_id, shift, run having count(*) >= {line_dedup.PASSAGE_WORDS}
), held as (
  select r.* from runs r join laid using (doc_id, keep_doc_id, shift)
  where len(list_filter(anchors, lambda a: a between lo and hi)) > 0
), placed as materialized (
  select doc_id, list_transform(regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+'),
           lambda x: length(x)) as steps,
         list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda x: length(x)) as sizes
  from d semi join (select doc_id from held union select keep_doc_id from held) using (doc_id)
), each_word as (
  select doc_id, generate_subscripts(sizes, 1) - 1 as i, unnest(sizes) as size, unnest(steps) as step
  from placed
), ends as (
  select doc_id, i, size, sum(step) over (partition by doc_id order by i) as stop from each_word
), edges as materialized (select doc_id, i, (stop - size)::bigint as start, stop::bigint as stop from ends),
spans as materialized (
  select h.doc_id, a.start, b.stop - a.start as length, keep_doc_id, k.start as keep_start
  from held h join edges a on a.doc_id = h.doc_id and a.i = lo
  join edges b on b.doc_id = h.doc_id and b.i = hi
  join edges k on k.doc_id = keep_doc_id and k.i = lo - shift
), told as (
  select doc_id, count(*) as removed_units, string_agg(start || '+' || length || '=' || keep_doc_id || ':'
         || keep_start, ';' order by start, length, keep_doc_id, keep_start) as removed
  from spans group by doc_id
), bounds as (
  select doc_id, start, max(start + length) over (partition by doc_id order by start, length
           rows between unbounded preceding and 1 preceding) as before,
         max(start + length) over (partition by doc_id) as upto
  from spans
), left_over as (
  select doc_id, text[coalesce(before, 0) + 1 : start] as part, start from bounds join d using (doc_id)
  where start > coalesce(before, 0)
  union all select distinct doc_id, text[upto + 1 :], 9223372036854775807 from bounds join d using (doc_id)
), clean as (
  select doc_id, string_agg(part, '' order by start) as clean_text from left_over group by doc_id
)
select doc_id, coalesce(removed_units, 0)::int as removed_units,
       coalesce(length(text) - length(clean_text), 0) as removed_chars, coalesce(removed, '') as removed,
       case when removed is null then text else clean_text end as clean_text
from documents left join told using (doc_id) left join clean using (doc_id)
"""


def op11_simhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_join.near_duplicates(table(spark, sf_dir, "documents"), width=4, bits=4)
    return found.select(
        "doc_id", simhash_join.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(
        table(spark, sf_dir, "documents"), longest=3, least=10, top=2000, inside=50)


OP12_SQL = f"""
with p as materialized (
  select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece
        from documents)
), f as materialized (
  select lang, size, array_to_string(w[i : i + size - 1], ' ') as phrase, count(*) as n
  from p, (values (1), (2), (3)) s(size), unnest(range(1, len(w) - size + 2)) u(i)
  group by lang, size, phrase
), total as (select lang, sum(n)::bigint as n from f where size = 1 group by lang),
c as materialized (
  select lang, size, phrase, n as a, string_split(phrase, ' ') as v from f where size > 1 and n >= 10
), cuts as (
  select c.lang, c.size, c.phrase, a, k, x.n as l, y.n as r,
         (1000000::hugeint * a * a // (x.n::hugeint * y.n))::bigint as score
  from c, unnest(range(1, size)) u(k)
  join f x on x.lang = c.lang and x.phrase = array_to_string(list_slice(v, 1, k), ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(list_slice(v, k + 1, c.size), ' ')
), scored as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), around as (
  select lang, array_to_string(v[s : s + 1], ' ') as phrase, max(a) as longer
  from c, (values (1), (2)) t(s) where size = 3 group by all
)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank,
       phrase, a, l, r, total.n, score
from scored left join around using (lang, phrase) join total using (lang)
where longer is null or 100 * longer < 50 * a
qualify rank <= 2000
"""


#: Folder of the vocabulary files of public tokenizers.
TOKENIZERS = "/opt/tokenizers"


def op13_token_alignment(
    spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS,
) -> DataFrame:
    a = token_alignment.ByteBpe(f"{tokenizers}/byte_bpe_50k.json")
    b = token_alignment.PieceBpe(f"{tokenizers}/piece_bpe_32k.model")
    return token_alignment.scored(table(spark, sf_dir, "documents"), a, b)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sharding": op3_sharding,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_source_mixing": op5_source_mixing,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_simhash_join": op11_simhash_join,
    "op12_collocations": op12_collocations,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op4_lm_scoring": OP4_SQL,
    "op5_source_mixing": OP5_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_collocations": OP12_SQL,
}
