"""The registered queries of the operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import language, manifest_sql
from recordloom.llm.bpe import encode_decode
from recordloom.llm.covertree import top_inner_products
from recordloom.llm.decontamination import benchmark_leaks
from recordloom.llm.divergence import source_divergence
from recordloom.llm.jaccard import near_duplicate_classes
from recordloom.llm.licenses import LICENCE_FILE, SIMILAR, SPEAKS, TEMPLATES, scan_licenses
from recordloom.llm.manifest import dataset_manifest
from recordloom.llm.simhash import near_fingerprints
from recordloom.llm.suffixes import remove_repeated_strings
from recordloom.llm.tokenfiles import token_counts
from recordloom.llm.toxicity import held_out, toxicity_scores
from recordloom.llm.windows import remove_repeated_windows

def vocabulary(name: str) -> str:
    """Where a public vocabulary lies; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return token_counts(docs, vocabulary("byte_bpe_50k.tiktoken")).select("doc_id", "n_tokens")


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return toxicity_scores(docs, labels, keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op6_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    coded = encode_decode(docs, vocabulary("word_bpe_49k.json"), keep=["doc_id"])
    return coded.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op1_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    leaks = benchmark_leaks(docs, items, keep=["doc_id"])
    return leaks.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return near_duplicate_classes(docs).select("doc_id", "class_id", "n_links")


@query
def op3_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return remove_repeated_strings(docs, 400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files in a tree: two levels of directories below each source, some named as licence files.

    Of the documents of a source, taken 20 ids at a time, every 64th lot lies above the
    directories of its group and every 8th above those of its subgroup.
    """
    lot = F.floor(F.col("doc_id") / 20)
    top = F.concat(F.coalesce("source", F.lit("none")), F.lit("/g"), F.floor(lot / 64).cast("string"))
    sub = F.concat(top, F.lit("/s"), F.floor(lot / 8).cast("string"))
    name = F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))
    path = (
        F.when(lot % 64 == 0, F.concat_ws("/", top, name)).when(lot % 8 == 0, F.concat_ws("/", sub, name))
        .otherwise(F.concat_ws("/", sub, F.concat(F.lit("file-"), F.col("doc_id").cast("string")))))
    return docs.select(path.alias("path"), "text")


@query
def op7_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = scan_licenses(as_files(table(spark, sf, "documents")))
    return found.withColumn("doc_id", F.regexp_extract("path", "-(\\d+)$", 1).cast("long"))


def _license_sql() -> str:
    rows = ", ".join("(" + ", ".join([str(i), *("'" + x.replace("'", "''") + "'" for x in t)]) + ")" for i, t in enumerate(TEMPLATES))
    split = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"""
with templates(template, license, body) as (values {rows}),
terms as (
  select license, template, term, count(*) as n from (
    select license, template, unnest({split.format('body')}) as term from templates) group by all),
files as (
  select doc_id, text, case when lot % 64 = 0 then top || '/LICENSE-' || doc_id
    when lot % 8 = 0 then top || '/s' || lot // 8 || '/LICENSE-' || doc_id
    else top || '/s' || lot // 8 || '/file-' || doc_id end as path
  from (select *, coalesce(source, 'none') || '/g' || lot // 64 as top from (select *, doc_id // 20 as lot from documents))),
seen as (
  select term, count(*) as n from (
    select unnest(list_distinct({split.format("coalesce(text, '')")})) as term from files)
  where term in (select term from terms) group by term),
total as (select cast(count(*) as double) as n from files),
idf as (
  select t.term, ln((1 + total.n) / (1 + coalesce(seen.n, 0))) + 1 as idf
  from (select distinct term from terms) t left join seen using (term), total),
spoken as (
  select distinct doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from files)
  where regexp_matches(lower(line), '{SPEAKS}')),
tokens as (
  select line, term, count(*) as n from (
    select line, unnest({split.format('line')}) as term from (select distinct line from spoken)) group by all),
weighted as (
  select line, term, tokens.n * coalesce(idf, ln(1 + total.n) + 1) as w from tokens left join idf using (term), total),
norms as (select line, sqrt(sum(w * w)) as norm from weighted group by line),
own as (select license, template, term, n * idf as tw from terms join idf using (term)),
lengths as (select template, sqrt(sum(tw * tw)) as length from own group by template),
scored as (
  select line, license, round(sum(w * tw / length) / any_value(norm), 6) as cosine
  from weighted join own using (term) join lengths using (template) join norms using (line) group by line, license, template),
best as (
  select doc_id, license as own_license, cosine from (
    select *, row_number() over (partition by doc_id order by cosine desc, license) as turn
    from spoken join scored using (line) where cosine >= {SIMILAR}) where turn = 1),
held as (
  select files.doc_id, path, own_license, cosine, regexp_extract(path, '^(.*)/', 1) as directory,
    regexp_extract(path, '([^/]*)$', 1) as name
  from files left join best using (doc_id)),
lent as (
  select directory as lender, own_license as lent from (
    select *, row_number() over (partition by directory order by cosine desc, own_license) as turn from held
    where own_license is not null and regexp_matches(name, '{LICENCE_FILE}')) where turn = 1),
nearest as (
  select directory, lender, lent from (
    select d.directory, lender, lent, row_number() over (partition by d.directory order by length(lender) desc) as turn
    from (select distinct directory from held) d join lent
      on d.directory = lender or starts_with(d.directory, lender || '/')) where turn = 1)
select doc_id, path, own_license, cosine, coalesce(own_license, lent) as license,
  case when own_license is not null then 'own' when lent is not null then 'inherited' end as origin,
  case when own_license is null then lender end as inherited_from
from held left join nearest using (directory)
"""


SQL["op7_license_scan"] = _license_sql()


@query
def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return remove_repeated_windows(docs, 35).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


SQL["op8_substring_dedup"] = r"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
words as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from texts),
windows as (
  select doc_id, place, array_to_string(words[place : place + 34], ' ') as said
  from (select doc_id, words, unnest(range(1, len(words) - 33)) as place from texts)),
repeated as (select doc_id, place from (select *, count(*) over (partition by said) as n from windows) where n > 1),
covered as (
  select w.*, coalesce(w.place - max(r.place) over (partition by w.doc_id order by w.place) < 35, false) as gone
  from words w left join repeated r using (doc_id, place)),
kept as (
  select doc_id, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by place) filter (not gone) as text
  from covered group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from texts left join kept using (doc_id)
"""


@query
def op9_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return top_inner_products(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


SQL["op9_exact_top_k"] = """
with held as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from held q join held c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 20
"""


@query
def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = language.identify_language(docs, keep=["doc_id"])
    return found.withColumn("held_out", language.held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "lang_pred", "score", "margin", "doubtful")


@query
def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence(table(spark, sf, "documents"))


SQL["op11_source_divergence"] = r"""
with texts as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as k,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
tokens as (select lang, source, k, unnest(words) as term from texts),
kept as (select lang, term, count(*) as n from tokens group by lang, term having count(distinct k) >= 10),
sizes as (select lang, count(*) as v, sum(n) as total from kept group by lang),
own as (select lang, term, 1 + 1000000000 * (n + 2)::hugeint // (total + 2 * v) as q from kept join sizes using (lang)),
counts as (select lang, source, term, count(*) as n from tokens semi join kept using (lang, term) group by lang, source, term),
totals as (
  select g.lang, g.source, coalesce(sum(n), 0) as total from (select distinct lang, source from texts) g
  left join counts c on c.lang = g.lang and c.source = g.source group by g.lang, g.source),
shares as (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 2)::hugeint // (t.total + 2 * s.v) as p
  from totals t join sizes s on s.lang = t.lang join kept k on k.lang = t.lang
  left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term),
met as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from totals a join totals b on a.lang = b.lang and a.source <> b.source
  left join met m on m.lang = a.lang and m.source = a.source and m.item = b.source),
words as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value
  from shares join own using (lang, term) where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from words))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 10
"""


@query
def op12_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_fingerprints(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op13_dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest; of documents whose id has an even crc32 the line breaks are deleted."""
    without = F.replace("text", F.lit("\n"), F.lit(""))
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return dataset_manifest(
        table(spark, sf, "documents"), tampered={"text": F.when(hit, without).otherwise(F.col("text"))})


SQL["op13_dataset_manifest"] = manifest_sql.SQL
