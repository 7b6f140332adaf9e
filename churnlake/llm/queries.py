"""Registered queries of the operators, with their SQL twins where SQL can state the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlake.llm import (
    bpe,
    chat_trees,
    class_lm,
    collocations,
    cross_polytope,
    decontamination,
    licenses,
    ngram_jaccard,
    periodic_runs,
    repeated_windows,
    sharding,
    token_files,
    toxicity,
)
from churnlake.llm.common import id_remainder, sha256_text, table

#: Folder of public vocabulary files; executors never read it.
TOKENIZERS = "/opt/tokenizers"


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, folder, "documents"))


OP1_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') as w
  from documents),
grams as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 3) + 1),
    lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) as g
  from words where len(w) > 0),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * shared >= 85 * (x.n + y.n - shared)),
reach as (
  select a as node, b as other from links
  union
  select r.node, l.b from reach r join links l on l.a = r.other),
least_reached as (select node, min(other) as other from reach group by node)
select d.doc_id, coalesce(s.n, 0) as n_shingles, least(d.doc_id, coalesce(r.other, d.doc_id)) as component_id
from documents d left join sizes s using (doc_id) left join least_reached r on r.node = d.doc_id"""


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256_text(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select coalesce(cast(item_id as varchar), 'null') as item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select distinct item, least(len(w), 10) as k, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1),
    lambda i: array_to_string(list_slice(w, i, i + 9), ' '))) as g
  from items where len(w) > 0),
sizes as (select distinct k from windows),
places as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from words, sizes where len(w) >= k),
hits as (
  select doc_id, i, p.k, item from (select doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') as g from places) p
  join windows using (k, g)),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
met as (
  select doc_id, count(distinct item) as n, string_agg(distinct item, ',' order by item) as ids from hits group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(covered.n, 0) as n_hit, coalesce(met.n, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(covered.n, 0) > 0 as contaminated
from words left join covered using (doc_id) left join met using (doc_id)"""


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, folder, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, folder, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_text(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sha256_text(F.col("decoded")).alias("decoded_sha256"),
    )


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest, target = token_files.write_token_files(
        table(spark, folder, "documents"), f"{TOKENIZERS}/word_bpe_49k.json"
    )
    ids = token_files.read_token_files(spark, manifest, target)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    scanned = licenses.scan_licenses(table(spark, folder, "documents"))
    starts = "transform(filter(places, p -> p.base), p -> p.start)"
    labels = "array_join(array_sort(array_distinct(transform({}, p -> p.label))), ',')"
    return scanned.selectExpr(
        "doc_id",
        "n_words",
        f"cast(size({starts}) AS bigint) AS n_base",
        f"array_min({starts}) AS first_word",
        f"array_max({starts}) AS last_word",
        f"{labels.format('filter(places, p -> p.base)')} AS base_labels",
        f"{labels.format('places')} AS labels",
        "score",
    )


#: A conversation whose texts hold control strings of a common template.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def linear_replies(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees of one branch: each row answers the row before it."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(by_turn).cast("long").alias("msg_id"))
    return rows.selectExpr(
        "*", "CASE WHEN msg_id > 1 THEN msg_id - 1 END AS parent_id", "cast(NULL AS double) AS score"
    )


def op9_chat_trees(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string"))
    back = chat_trees.read_back(chat_trees.format_trees(linear_replies(rows)))
    told = F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_text(told).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha256_text(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = """
with every as (
  select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
plain as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from every),
sized as (
  select *, 24 + length(role) + length(text)
    + 4 * (length(role || text) - length(replace(role || text, '&', '')))
    + 3 * (length(role || text) - length(replace(role || text, '<', '')))
    + 4 * (length(role || text) - length(replace(role || text, '[', '')))
    + 5 * (length(role || text) - length(replace(role || text, '|', ''))) as chars
  from plain)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id"""


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, folder, "labels"), train=id_remainder(F.col("doc_id")) != 0)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return cross_polytope.nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = class_lm.fit_class_model(docs, train=id_remainder(F.col("doc_id")) != 1)
    return class_lm.score_texts(docs, model).select(
        "doc_id",
        (id_remainder(F.col("doc_id")) == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document, by crc32 of its id, repeats some of its words to the end."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", number.alias("h"), F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')").alias("w"))
    planted = rows.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("g % nullif(n, 0)"))
    planted = planted.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = "array_join(transform(w, (x, i) -> if(i >= a, get(w, int(a + (i - a) % p)), x)), ' ')"
    return planted.select("doc_id", F.expr(f"CASE WHEN h % 10 = 0 AND n > 0 THEN {repeated} ELSE text END").alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, folder, "documents")))
    better = "x.length * best.period > best.length * x.period"
    told = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return found.withColumn(
        "best", F.expr(f"aggregate(slice(runs, 2, size(runs)), get(runs, 0), (best, x) -> if({better}, x, best))")
    ).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha256_text(F.expr(told)).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


OP12_SQL = r"""
with docs as (
  select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from docs),
words as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from words group by lang),
sizes as (select unnest([1, 2, 3]) as k),
runs as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) as phrase
  from words, sizes where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from runs group by all having count(*) >= 10),
candidates as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1),
cuts as (
  select lang, phrase, a, w, c, array_to_string(list_slice(w, 1, c), ' ') as lp, array_to_string(list_slice(w, c + 1, k), ' ') as rp
  from (select *, unnest(range(1, k)) as c from candidates)),
scored as (
  select cuts.*, x.f as l, y.f as r, cast((1000000::hugeint * a * a) // (x.f::hugeint * y.f) as bigint) as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = lp join f y on y.lang = cuts.lang and y.phrase = rp),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inside as (
  select lang, phrase, max(a) as longer from (
    select lang, a, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) as phrase
    from candidates where k = 3) group by all)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a, l, r, n, score
from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase join totals t on t.lang = b.lang
where longer is null or 100 * longer < 50 * a
qualify rank <= 2000"""


def op13_repeated_windows(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_windows.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id",
        "n_bytes",
        F.expr("coalesce(aggregate(removed, 0L, (n, s) -> n + s.end - s.start), 0L)").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_decontamination,
        op3_sharding,
        op4_bpe,
        op5_license_scan,
        op6_class_lm,
        op7_token_files,
        op8_nearest_neighbours,
        op9_chat_trees,
        op10_toxicity,
        op11_periodic_runs,
        op12_collocations,
        op13_repeated_windows,
    )
}
ORACLES: dict[str, str] = {"op1_ngram_jaccard": OP1_SQL, "op2_decontamination": OP2_SQL, "op9_chat_trees": OP9_SQL, "op12_collocations": OP12_SQL}
