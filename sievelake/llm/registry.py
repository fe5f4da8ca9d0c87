"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import table
from sievelake.llm.merkle_sql import MERKLE_SQL

TOKENIZER = "word_bpe_49k.json"


_DOCS = r"""
docs as (select doc_id, coalesce(text, '') as text from documents),
whole as (select doc_id, string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(1)), '([.!?;:,]) ', '\1' || chr(1) || ' ', 'g'), chr(1)) as parts from docs),
pieces as (select doc_id, unnest(range(len(parts))) as piece, unnest(parts) as raw, len(parts) as n from whole),
clean as (select *, trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) as t, raw like '%' || chr(10) as ended from pieces),
placed as (select *, coalesce(sum(ended::int) over before, 0) as line, coalesce(sum(length(raw)) over before, 0) as start, coalesce(lag(ended) over (partition by doc_id order by piece), true) as begins
  from clean window before as (partition by doc_id order by piece rows between unbounded preceding and 1 preceding))"""
_KEPT = """
stay as (select p.*, lag(p.line) over w as line0, lag(p.ended) over w as ended0 from placed p left join gone g on p.doc_id = g.doc_id and p.piece = g.piece where g.piece is null window w as (partition by p.doc_id order by p.piece)),
kept as (select doc_id, string_agg(case when line0 < line and not ended0 then chr(10) else '' end || raw, '' order by piece) as kept from stay group by doc_id)"""

SQL = {
    "op4_line_winnowing": rf"""
with {_DOCS},
units as (
  select doc_id, piece, t || chr(10) || j as u, md5(t) || case when j > 0 then cast(j as varchar) else '' end as key, row_number() over (partition by doc_id order by piece, j) - 1 as pos
  from (select doc_id, piece, t, unnest(range((len(string_split(t, ' ')) - 1) // 12 + 1)) as j from clean where t <> '')
),
grams as (select * from (select doc_id, pos, lead(key, 1) over w as key, u || chr(11) || lead(u, 1) over w || chr(11) || lead(u, 2) over w as g from units window w as (partition by doc_id order by pos)) where g is not null),
least as (
  select doc_id, pos, count(*) over (partition by doc_id) as n,
    min(rpad(key, 40, ' ') || lpad(cast(pos as varchar), 10, '0')) over (partition by doc_id order by pos rows between current row and 2 following) as best
  from grams
),
prints as (select doc_id, pos, g from (select distinct doc_id, cast(substr(best, 41) as bigint) as pos from least where pos <= greatest(0, n - 3)) join grams using (doc_id, pos)),
joined as (
  select doc_id, pos, lag(pos) over (partition by doc_id, g order by pos) as before, first_value(doc_id) over w as doc0, first_value(pos) over w as pos0
  from prints window w as (partition by g order by doc_id, pos)
),
pairs as (select distinct doc_id, case when before is null then doc0 else doc_id end as other, pos - coalesce(before, pos0) as off from joined),
equal as (
  select p.doc_id, p.other, p.off, a.pos, a.piece from pairs p join units a on a.doc_id = p.doc_id join units b on b.doc_id = p.other and b.pos = a.pos - p.off and b.u = a.u
  where p.doc_id <> p.other or p.off <> 0
),
runs as (select *, pos - row_number() over (partition by doc_id, other, off order by pos) as run from equal),
gone as (select distinct doc_id, piece from (select *, count(*) over (partition by doc_id, other, off, run) as n from runs) where n >= 3),
{_KEPT},
removed as (select doc_id, count(*) as n_removed, string_agg(cast(piece as varchar), ',' order by piece) as removed_units from gone group by doc_id)
select d.doc_id, cast(case when d.text = '' then 0 else len(w.parts) end as bigint) as n_units, coalesce(r.n_removed, 0) as n_removed,
  coalesce(r.removed_units, '') as removed_units, sha256(coalesce(k.kept, '')) as kept_sha256
from docs d join whole w using (doc_id) left join kept k using (doc_id) left join removed r using (doc_id)
""",
    "op7_line_hash_dedup": rf"""
with {_DOCS},
ranked as (
  select doc_id, piece, len(string_split(t, ' ')) as words, begins and (ended or piece = n - 1) as whole, row_number() over (partition by doc_id order by piece) as nr,
    row_number() over (partition by t order by doc_id, piece) > 1 as later
  from placed where t <> ''
),
runs as (select *, nr - row_number() over (partition by doc_id order by piece) as head from ranked where later),
summed as (select *, sum(words) over (partition by doc_id, head) as run from runs),
gone as (select * from summed where whole or run >= 8),
{_KEPT},
removed as (
  select doc_id, count(*) as n_removed, count(distinct head) filter (where run >= 24) as n_passages,
    string_agg(start || ':' || (start + length(rtrim(raw, chr(10)))), ',' order by piece) as removed_spans
  from gone join placed using (doc_id, piece) group by doc_id
)
select d.doc_id, cast(case when d.text = '' then 0 else len(w.parts) end as bigint) as n_units, coalesce(r.n_removed, 0) as n_removed, coalesce(r.n_passages, 0) as n_passages,
  coalesce(r.removed_spans, '') as removed_spans, sha256(coalesce(k.kept, '')) as kept_sha256
from docs d join whole w using (doc_id) left join kept k using (doc_id) left join removed r using (doc_id)
""",
    "op12_merkle_manifest": MERKLE_SQL,
    "op13_source_divergence": r"""
with docs as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (select row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as c from words group by lang, term having count(distinct row) >= 30),
sizes as (select lang, count(*) as v, sum(c) as n from kept group by lang),
sources as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as c from words join (select lang, term from kept) using (lang, term) group by lang, source, term),
totals as (select lang, source, sum(c) as n from counts group by lang, source),
cells as (
  select s.lang, s.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 5)) // (coalesce(t.n, 0) + 5 * z.v) as p, 1 + (1000000000::hugeint * (k.c + 5)) // (z.n + 5 * z.v) as q
  from sources s join kept k using (lang) join sizes z using (lang) left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term left join totals t on t.lang = s.lang and t.source = s.source
),
apart as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value from sources a join sources b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source),
told as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', term, p - q from cells where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from told)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 50
""",
}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelake.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def gif_digest(docs: DataFrame) -> DataFrame:
    from sievelake.llm.gif import read_gifs, store_as_gif

    found = read_gifs(store_as_gif(docs))
    shown = F.expr("aggregate(frames, array_repeat(0L, 24), (a, f) -> zip_with(a, f.histogram, (x, y) -> x + y))")
    feature = F.concat(F.lit("frames="), F.size("frames").cast("string"), F.lit(";histogram="), F.array_join(shown.cast("array<string>"), ","))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_digest(table(spark, sf_dir, "documents"))


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelake.llm.sharding import histogram_sort

    found = histogram_sort(table(spark, sf_dir, "documents"), 8)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelake.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_secret_entropy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelake.llm.secretscan import scan_secrets, secret_digest

    return secret_digest(scan_secrets(table(spark, sf_dir, "documents")))


def op9_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelake.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelake.llm.linededup import winnow_lines

    found = winnow_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("n_units").cast("long").alias("n_units"),
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_units"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op7_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelake.llm.substring import repeated_units

    found = repeated_units(table(spark, sf_dir, "documents"), unit="line")
    return found.select(
        "doc_id",
        F.col("n_units").cast("long").alias("n_units"),
        F.size("removed").cast("long").alias("n_removed"),
        F.col("n_passages").cast("long").alias("n_passages"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias("removed_spans"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op10_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelake.llm.runindex import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelake.llm.decontam import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start", "words")


def op11_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelake.llm.bestfit import pack_best_fit

    return pack_best_fit(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelake.llm.merkle import lowered, merkle_manifest, tampering

    docs = table(spark, sf_dir, "documents")
    return merkle_manifest(docs, altered=tampering(docs["doc_id"]), text_now=lowered(docs["text"]))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelake.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return SQL
