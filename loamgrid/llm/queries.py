"""One query per training-data operator, with its SQL twin where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import best_fit, bottom_k, chat_parts, curve_packing, host_rules, id_blocks, language_codes, phrase_index, prefix_doubling, prefix_trie, progressive_jpeg, sentence_pieces, warc_bundles
from loamgrid.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_host_quality")
def host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = host_rules.judge(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_language_codes")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_codes.fit(docs.where(~language_codes.held_out()))
    return language_codes.identify(docs, model, ["doc_id", language_codes.held_out().alias("held_out")])


CONVERSATION_MINUS_7 = "</s>[INST] ok [/INST]"

OP7_SQL = """
with m as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *,
    regexp_replace(text, '([<\\[])(~*)(/s>|s>|/INST\\]|INST\\]|/OUT\\]|OUT\\]|/ROLE\\]|ROLE\\]|\\|image\\|>|\\|audio\\|>|\\|document\\|>)', '\\1~\\2\\3', 'g') as esc,
    case when role = 'user' then 22 when role = 'assistant' then 20
      else 28 + length(regexp_replace(role, '([<\\[])(~*)(/s>|s>|/INST\\]|INST\\]|/OUT\\]|OUT\\]|/ROLE\\]|ROLE\\]|\\|image\\|>|\\|audio\\|>|\\|document\\|>)', '\\1~\\2\\3', 'g')) end as frame
  from m)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, esc)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, esc) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(esc) + frame)::bigint as formatted_chars
from e group by conv_id
"""


@query("op7_chat_parts", OP7_SQL)
def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = rows.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONVERSATION_MINUS_7).alias("text")
    )
    got = chat_parts.format_conversations(rows.union(extra).withColumn("parts", chat_parts.text_part(F.col("text"))))
    turns = F.transform(chat_parts.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n")))
    got = got.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), F.array_join(chat_parts.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op2_curve_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


@query("op10_id_blocks")
def id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = id_blocks.new_folder(docs)
    return id_blocks.read_documents(id_blocks.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), folder), folder)


OP1_SQL = """
with h as (select page_id, coalesce(html, '') as p, sha1(coalesce(html, '')) as x from pages),
f as (select *, min(page_id) over (partition by p) as first from h)
select page_id, strlen(p)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from f
"""


@query("op1_warc_bundles", OP1_SQL)
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_bottom_k")
def near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_prefix_doubling")
def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = prefix_doubling.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op3_progressive_jpeg")
def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.features(progressive_jpeg.store(table(spark, sf_dir, "documents")))


@query("op9_sentence_pieces")
def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_best_fit")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = best_fit.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: crc32 of the decimal id, byte by byte over a table that eight shifts make; then the trie by lists of turns.
OP12_SQL = """
with recursive crc_table as (
  select list(v order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256)) as i))),
own as (
  select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
  from conversations where conv_id is not null group by conv_id),
h as (
  select conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 9 as h
  from own, crc_table),
built as (
  select a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) as turns
  from h a left join own b on b.conv_id = a.conv_id - a.conv_id % 5),
p as (select conv_id, len(turns) as size, unnest(range(len(turns) + 1)) as depth, turns from built),
nodes as (
  select depth, turns[1:depth] as path, min(conv_id) as conv_id, count(*) as n_convs, bool_and(size = depth) as leaf,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (size = depth), '')) as ends_sha256,
    (count(*) - 1) * case when depth = 0 then 0 else strlen(any_value(turns[depth].t)) end as own_saved
  from p group by depth, turns[1:depth]),
up as (select unnest(range(depth + 1)) as d, path, leaf, own_saved from nodes),
below as (select d, path[1:d] as path, sum(leaf::int)::bigint as n_leaves, sum(own_saved)::bigint as saved_tokens from up group by d, path[1:d]),
kids as (select depth - 1 as depth, path[1:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by depth, path[1:depth - 1])
select n.conv_id, n.depth, q.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::bigint as n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
from nodes n join below b on b.d = n.depth and b.path = n.path
left join kids k on k.depth = n.depth and k.path = n.path
left join nodes q on q.depth = n.depth - 1 and q.path = n.path[1:n.depth - 1]
"""


@query("op12_prefix_trie", OP12_SQL)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


OP11_SQL = """
with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as s from documents),
w as (select lang, regexp_extract_all(s, '[^\\x20\\x09]+') as w from p),
spots as (select lang, w, unnest(range(1, len(w) + 1)) as i from w),
g as (
  select lang, unnest([w[i], case when i + 1 <= len(w) then w[i] || ' ' || w[i + 1] end, case when i + 2 <= len(w) then w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end]) as phrase, unnest([1, 2, 3]) as k from spots),
f as (select lang, k, phrase, count(*) as f from g where phrase is not null group by lang, k, phrase),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select *, split_part(phrase, ' ', 1) as w1, split_part(phrase, ' ', 2) as w2, split_part(phrase, ' ', 3) as w3 from f where k > 1 and f >= 10),
inner_ as (select lang, phrase, max(f) as f from (select lang, w1 || ' ' || w2 as phrase, f from c where k = 3 union all select lang, w2 || ' ' || w3, f from c where k = 3) group by lang, phrase),
kept as (select c.* from c left join inner_ i on i.lang = c.lang and i.phrase = c.phrase and c.k = 2 where i.f is null or 100 * i.f < 50 * c.f),
cuts as (
  select lang, phrase, f, 1 as cut, w1 as lp, case when k = 2 then w2 else w2 || ' ' || w3 end as rp from kept
  union all select lang, phrase, f, 2, w1 || ' ' || w2, w3 from kept where k = 3),
scored as (
  select c.lang, c.phrase, c.f as a, l.f as l, r.f as r, (1000000::hugeint * c.f * c.f // (l.f::hugeint * r.f))::bigint as score, row_number() over (partition by c.lang, c.phrase order by 1000000::hugeint * c.f * c.f // (l.f::hugeint * r.f), cut) as place
  from cuts c join f l on l.lang = c.lang and l.phrase = c.lp join f r on r.lang = c.lang and r.phrase = c.rp),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from scored where place = 1)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""


@query("op11_phrase_index", OP11_SQL)
def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.collocations(table(spark, sf_dir, "documents"))
