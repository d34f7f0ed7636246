"""Queries op1 to op13: each maps a given table to an operator's records and its result back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.columns import let

from . import (
    chat_format,
    jaccard_join,
    kneser_ney,
    merkle_manifest,
    mixing,
    packing,
    personal_data,
    quality_rules,
    token_alignment,
    token_counts,
    token_files,
    url_rules,
    vp_tree,
    words,
)
from .bit_filter import likely

HOST_RULES = [
    url_rules.parse_rule("allow", "com/"),
    url_rules.parse_rule("block", "example.com/en/"),
    url_rules.parse_rule("allow", "www.example.com/en/"),
    url_rules.parse_rule("block", "net/es/"),
    url_rules.parse_rule("block", "net/fr/"),
]
#: Feeds, anchors on the page and paged lists: other addresses of pages that stand elsewhere whole.
PATTERNS = [
    url_rules.PatternRule(r"[?&]utm_source=feed(&|#|$)", ("utm", "source", "feed")),
    url_rules.PatternRule(r"[?&]page=[0-9]+&ref=", ("page", "ref")),
    url_rules.PatternRule(r"://m\.[^/?#]*/[a-z]+/[0-9]+#top$", ("m", "top")),
]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def candidates_of(docs: DataFrame, *columns: str) -> DataFrame:
    """Documents under the names of candidates, with the columns that an operator reads."""
    return docs.select(F.col("doc_id").alias("ordinal"), *(columns or ("source", "text")))


def trusted_candidates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Official candidates: labelled as good quality and not toxic."""
    good = labels.where("quality = 1 and toxic = 0").select("doc_id").distinct()
    texts = likely(docs.select("doc_id", "text"), good, "doc_id")
    # labels have no size bound, so they are never broadcast and the plan is the same at every size
    return candidates_of(texts.join(good.hint("merge"), "doc_id", "left_semi"), "text")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = candidates_of(read(spark, sf, "documents"))
    trusted = trusted_candidates(read(spark, sf, "documents"), read(spark, sf, "labels"))
    ratio = quality_rules.fit_ratio(docs, trusted)
    threshold = quality_rules.trusted_threshold(trusted, ratio)
    return quality_rules.quality_rules(docs, ratio, threshold=threshold).select(F.col("ordinal").alias("doc_id"), "quality.*")


def op2_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    groups = jaccard_join.jaccard_groups(candidates_of(read(spark, sf, "documents")))
    return groups.select(F.col("ordinal").alias("doc_id"), "n_shingles", "component_id")


def op3_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    trusted = trusted_candidates(docs, read(spark, sf, "labels"))
    judged = kneser_ney.perplexity_rules(candidates_of(docs, "lang", "text"), trusted, language="lang")
    return judged.select(F.col("ordinal").alias("doc_id"), "language", "n_tokens", "perplexity", "limit_perplexity", "kept")


def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = candidates_of(read(spark, sf, "documents"))
    sized = docs.select("ordinal", "source", words.word_count(F.col("text")).alias("size"), F.sha2("text", 256).alias("cluster"))
    packed = packing.pack_candidates(sized)
    return packed.select(F.col("ordinal").alias("doc_id"), "piece", "start", "length", "bin", "bin_start")


def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    index = token_files.write_token_files(
        candidates_of(read(spark, sf, "documents")), public_tokenizers.path("word_bpe_49k.json"), folder
    )
    return token_files.read_token_digests(index, folder).withColumnRenamed("ordinal", "doc_id")


def op6_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    docs = candidates_of(read(spark, sf, "documents"), "text")
    found = personal_data.protect_candidates(docs, with_text=False, term=personal_data.ANY_TERM)
    base = F.filter("spans", lambda s: s["kind"] < personal_data.KINDS.index("term"))
    return found.select(
        F.col("ordinal").alias("doc_id"),
        *[personal_data.kind_count(F.col("spans"), k).alias(f"n_{k}") for k in personal_data.KINDS],
        F.sha2(personal_data.span_text(base), 256).alias("base_sha256"),
        personal_data.span_text(F.col("spans")).alias("spans"),
    )


def op7_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("ordinal"), F.col("url").alias("source_url"))
    judged = url_rules.url_rules(pages, HOST_RULES, PATTERNS)
    return judged.select(F.col("ordinal").alias("page_id"), "host", "path", "rule", "verdict", "pattern")


def op8_vp_tree(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings")
    return vp_tree.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = candidates_of(read(spark, sf, "documents"), "text")
    counted = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(F.col("ordinal").alias("doc_id"), "tokens.*")


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix_sources(candidates_of(read(spark, sf, "documents")))
    return mixed.select(F.col("ordinal").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = candidates_of(read(spark, sf, "documents"), "source", "lang", "n_chars", "text")
    docs = docs.withColumnsRenamed({"lang": "stage", "n_chars": "size"})
    fields = [F.col(f) for f in merkle_manifest.FIELDS]
    lower = F.translate("text", personal_data.UPPER, personal_data.LOWER)
    tampered = merkle_manifest.leaf_digest(*fields[:-1], lower)
    leaves = docs.select(
        "ordinal",
        "stage",
        merkle_manifest.leaf_digest(*fields).alias("leaf"),
        F.when(F.crc32(F.col("ordinal").cast("string")) % 3 == 0, tampered).alias("presented"),
    )
    proved = merkle_manifest.prove(merkle_manifest.build_manifest(leaves, presented="presented"))
    return proved.select(
        F.col("ordinal").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified"
    )


def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    left, right = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = token_alignment.align_tokens(candidates_of(read(spark, sf, "documents")), left, right)
    shown = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return found.select(F.col("ordinal").alias("doc_id"), *numbers, shown.alias("groups_sha256"))


#: Two turns that hold the template's own marks.
MARKED_TEXT = "</s>[INST] ok [/INST]"


def op13_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    chats = chat_format.collect_turns(chat_format.canonical_turns(rows, ["role", "text"]), "conv_id", "turn")
    said = [F.struct(F.lit(r).alias("role"), F.lit(MARKED_TEXT).alias("content")) for r in ("user", "assistant")]
    marked = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(*said).alias("messages"))
    marked = chat_format.canonical_turns(marked, ["messages"]).select("conv_id", "turns")
    chats = chat_format.format_chats(chats.unionByName(marked))
    read_back = let(chats, {"back": chat_format.read_turns(F.col("formatted")), "learned": chat_format.loss_texts(F.col("formatted"), F.col("loss"))})
    lines = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return read_back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_jaccard_join,
        op3_kneser_ney,
        op4_best_fit_packing,
        op5_token_files,
        op6_personal_data,
        op7_url_rules,
        op8_vp_tree,
        op9_token_counts,
        op10_mixing,
        op11_merkle_manifest,
        op12_token_alignment,
        op13_chat_formatting,
    )
}
#: Words, shingles and spans of the other operators rest on hashes, searches or tokenizers that SQL lacks.
ORACLE: dict[str, str] = {
    "op7_url_rules": r"""
with cut as (select page_id, coalesce(url, '') as url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
  translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from cut),
rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best as (select page_id, url, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v from parts, rules
  where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id, url),
found as (select *, case when regexp_matches(low, '[?&]utm_source=feed(&|#|$)') then '[?&]utm_source=feed(&|#|$)'
  when regexp_matches(low, '[?&]page=[0-9]+&ref=') then '[?&]page=[0-9]+&ref='
  when regexp_matches(low, '://m\.[^/?#]*/[a-z]+/[0-9]+#top$') then '://m\.[^/?#]*/[a-z]+/[0-9]+#top$' end as pat from parts)
select f.page_id, f.host, f.path, b.rule, case when b.rule is null then f.pat end as pattern,
  case when b.rule is not null then b.v when f.pat is not null then 'block' else 'allow' end as verdict
from found f left join best b on f.page_id = b.page_id and f.url = b.url""",
    "op8_vp_tree": """
with e as (select vec_id, embedding::double[] as v from embeddings),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.v, b.v) as score from e a join e b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20""",
    # trees level by level from a numbered row of leaves; every node keeps its left and right siblings for the way up
    "op11_merkle_manifest": r"""
with recursive f as (select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
  coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head from documents),
crc as (select doc_id, list_reduce(list_concat([4294967295::bigint], range(8 * length(doc_id::varchar))::bigint[]), lambda c, i:
    case when xor(c, case when i % 8 = 0 then ascii(substr(doc_id::varchar, (i // 8)::int + 1, 1))::bigint else 0 end) % 2 = 1
    then xor(xor(c, case when i % 8 = 0 then ascii(substr(doc_id::varchar, (i // 8)::int + 1, 1))::bigint else 0 end) >> 1, 3988292384)
    else xor(c, case when i % 8 = 0 then ascii(substr(doc_id::varchar, (i // 8)::int + 1, 1))::bigint else 0 end) >> 1 end) as c from (select distinct doc_id from documents where doc_id is not null)),
leaf as (select f.doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
  case when xor(c, 4294967295) % 3 = 0 then sha256(head || coalesce(strlen(low) || ':' || low, '-')) end as tampered from f left join crc on crc.doc_id = f.doc_id),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from leaf),
tree as (select lang, 0 as level, pos, leaf as d, n from placed union all
  select lang, level + 1, pos // 8, sha256(string_agg(d, '' order by pos)), (n + 7) // 8 from tree where n > 1 group by lang, level, pos // 8, n),
sub as (select lang, level as height, d, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from tree where n = 1),
top as (select 0 as level, pos, d, n from sub union all
  select level + 1, pos // 8, sha256(string_agg(d, '' order by pos)), (n + 7) // 8 from top where n > 1 group by level, pos // 8, n),
side as (select lang, level, pos, coalesce(string_agg(d, '') over (w rows between unbounded preceding and 1 preceding), '') as l,
  coalesce(string_agg(d, '') over (w rows between 1 following and unbounded following), '') as r from tree where n > 1 window w as (partition by lang, level, pos // 8 order by pos)),
top_side as (select level, pos, coalesce(string_agg(d, '') over (w rows between unbounded preceding and 1 preceding), '') as l,
  coalesce(string_agg(d, '') over (w rows between 1 following and unbounded following), '') as r from top where n > 1 window w as (partition by level, pos // 8 order by pos)),
steps as (select p.lang, p.pos as leaf_pos, s.level, s.l, s.r from placed p join side s on s.lang is not distinct from p.lang and s.pos = p.pos // (8 ** s.level)::bigint
  union all select p.lang, p.pos, sub.height + t.level, t.l, t.r from placed p join sub on sub.lang is not distinct from p.lang join top_side t on t.pos = sub.pos // (8 ** t.level)::bigint),
fold as (select lang, pos, 0 as level, coalesce(tampered, leaf) as d, '' as proof from placed union all
  select f.lang, f.pos, f.level + 1, sha256(s.l || f.d || s.r), f.proof || s.l || s.r from fold f join steps s on s.lang is not distinct from f.lang and s.leaf_pos = f.pos and s.level = f.level),
ends as (select lang, pos, arg_max(d, level) as folded_root, arg_max(proof, level) as proof from fold group by lang, pos)
select p.doc_id, p.leaf, sub.d as subroot, top.d as root, sha256(proof) as proof_sha256, folded_root, folded_root = top.d as verified
from placed p join ends e on e.lang is not distinct from p.lang and e.pos = p.pos join sub on sub.lang is not distinct from p.lang join top on top.n = 1""",
    # a control string inside a text costs one backslash; marks and the spaces beside them cost 15, 9, 13 or 23 characters
    "op13_chat_formatting": r"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(i, r)),
c as (select *, '<s>|</s>|\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]|\[TURN\]|\[TEXT\]|\[/TURN\]' as marks from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(length(text) + len(regexp_extract_all(text, marks)) + case role when 'user' then 15 when 'assistant' then 9 when 'system' then 13
    else 23 + length(role) + len(regexp_extract_all(role, marks)) end) + count(*) - 1)::bigint as formatted_chars
from c group by conv_id""",
}
