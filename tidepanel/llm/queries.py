"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import bpe, chat, exact_dedup, lexical, licenses, lm, merkle, minhash, mixing, quality, simhash, suffix_dedup, topk

#: Shares of the tokens that the mix aims at.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.17, "es": 0.13}
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> bytes:
    """Content of a public vocabulary file; the driver reads it and sends it to the tasks."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def language_labels(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """doc_id, domain: the language of the documents that the labels table lists."""
    listed = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(listed, "doc_id", "left_semi")


def op1(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mixing_rates(docs, language_labels(spark, sf_dir, docs), TARGETS)


def op3(spark, sf_dir):
    import public_tokenizers

    return lm.lm_scores(table(spark, sf_dir, "documents"), tokenizer_file(RANKS), public_tokenizers.PATTERN)


def op4(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op5(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return span_texts(chat.format_preferences(turns, chat.neighbour_pairs(turns)))


def op5_answers(spark, sf_dir):
    return span_texts(chat.replaced_answers(table(spark, sf_dir, "conversations")))


def span_texts(out: DataFrame) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return out.select("chosen_id", "rejected_id", "prefix_turns", "prompt", "chosen", spans("chosen_spans"), "rejected", spans("rejected_spans"))


def op6(spark, sf_dir):
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7(spark, sf_dir):
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return out.drop("spans")


def op8(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(rows, rows.filter("vec_id % 100 = 0"), k=10, scale=1024)


def op9(spark, sf_dir):
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), tokenizer_file(VOCABULARY))


def op10(spark, sf_dir):
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


def op11(spark, sf_dir):
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12(spark, sf_dir):
    return merkle.tamper_evidence(table(spark, sf_dir, "documents"))


def op13(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=3)


OP1_SQL = """
with d as (
    select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
    from documents
)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
    coalesce(doc_id = max(doc_id) over g, false) as kept, text_sha256
from d window g as (partition by text_sha256)
"""

OP5_SQL = """
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), c as (
    select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, text) as turns from t group by conv_id
), p as (
    select a.conv_id as chosen_id, b.conv_id as rejected_id, a.turns as a, b.turns as b
    from c a join c b on b.conv_id = a.conv_id + 1 where a.conv_id % 2 = 0
), k as (
    select *, coalesce((
        select min(i) - 1 from range(1, greatest(len(a), len(b)) + 1) r(i) where a[i] is distinct from b[i]
    ), len(a)) as prefix_turns from p
), r as (
    select *, list_transform(a, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) as ra,
        list_transform(b, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) as rb
    from k
), s as (
    select *, ra[prefix_turns + 1:] as ca, rb[prefix_turns + 1:] as cb, a[prefix_turns + 1:] as xa, b[prefix_turns + 1:] as xb from r
)
select chosen_id, rejected_id, cast(prefix_turns as bigint) as prefix_turns,
    array_to_string(ra[1:prefix_turns], '') as prompt,
    array_to_string(ca, '') as chosen,
    coalesce((select string_agg(cast(e - length(ca[i]) + length(xa[i].role) + 5 as varchar) || '-' || cast(e as varchar), ',' order by i)
        from (select i, length(array_to_string(ca[1:i], '')) as e from range(1, len(ca) + 1) q(i)) where xa[i].role = 'assistant'), '') as chosen_spans,
    array_to_string(cb, '') as rejected,
    coalesce((select string_agg(cast(e - length(cb[i]) + length(xb[i].role) + 5 as varchar) || '-' || cast(e as varchar), ',' order by i)
        from (select i, length(array_to_string(cb[1:i], '')) as e from range(1, len(cb) + 1) q(i)) where xb[i].role = 'assistant'), '') as rejected_spans
from s
"""

#: Pairs that share a beginning; the formatting is that of OP5_SQL.
OP5_ANSWERS_SQL = """
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), c as (
    select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, text) as turns from t group by conv_id
), l as (
    select *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) as pos from c
), o as (
    select *, row_number() over (order by conv_id) as n, count(*) over () as total from l where pos is not null
), p as (
    select a.conv_id as chosen_id, b.conv_id as rejected_id, a.turns as a,
        a.turns[1:a.pos - 1] || [{'role': 'assistant', 'text': b.turns[b.pos].text}] || a.turns[a.pos + 1:] as b
    from o a join o b on b.n = a.n % a.total + 1 where a.total > 1
""" + OP5_SQL[OP5_SQL.index("), k as (") :]

OP8_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e, embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 as good
    from embeddings
), w as (
    select q.vec_id as query_id, c.vec_id as vec_id,
        cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id
    where q.vec_id % 100 = 0 and q.good and c.good and len(q.e) = len(c.e)
), r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as n from w
)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 10
"""

OP11_SQL = r"""
with t as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents where text is not null
), d as (
    select row_number() over () as r, doc_id, terms, len(terms) as n from t where len(terms) > 0
), s as (
    select count(*) as total, cast(sum(n) as bigint) as words from d
), p as (
    select r, term, count(*) as tf from (select r, unnest(terms) as term from d) group by r, term
), f as (
    select term, cast(floor(1000 * ln((2 * total + 2) / cast(2 * count(*) + 1 as double))) as bigint) as w from p, s group by term, total
), m as (
    select r, doc_id, 75 + (25 * n * total) // words as m from d, s
), q as (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select item_id, min(text) as text from benchmark where item_id is not null group by item_id)
), c as (
    select item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
    from q join f using (term) join p using (term) join m using (r) group by item_id, r, doc_id
), k as (
    select *, row_number() over (partition by item_id order by score desc, doc_id, r) as n from c where score > 0 and doc_id is not null
)
select item_id, cast(n as integer) as rank, doc_id, score from k where n <= 20
"""

OP12_SQL = """
with recursive d as materialized (
    select row_number() over () as r, doc_id, cast(doc_id as varchar) as s, cast(n_chars as varchar) as c, cast(n_chars + 1 as varchar) as c1, source, lang, text,
        coalesce('=' || lang, '-') as grp from documents
), f as (
    select r, s, doc_id, grp, coalesce(octet_length(encode(s)) || ':' || s, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
        || coalesce(octet_length(encode(lang)) || ':' || lang, '-') as head, c, c1, coalesce(octet_length(encode(text)) || ':' || text, '-') as tail from d
), h as (
    select r, doc_id, grp, sha256(head || coalesce(octet_length(encode(c)) || ':' || c, '-') || tail) as leaf,
        sha256(head || coalesce(octet_length(encode(c1)) || ':' || c1, '-') || tail) as other,
        coalesce(xor(list_reduce(list_transform(generate_series(1, length(s)), lambda i: cast(ord(s[i]) as bigint)), lambda a, x:
            list_reduce(generate_series(1, 8), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)), xor(a, x)), cast(4294967295 as bigint)), 4294967295) % 7 = 0, false) as hit
    from f
), l as materialized (
    select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by grp) as n from h
), t as (
    select grp, 0 as level, pos, leaf as h, n from l
    union all
    select grp, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from t where n > 1 group by grp, level, pos // 2, n
), nodes as materialized (select * from t),
sub as materialized (
    select grp, h as subroot, row_number() over (order by grp) - 1 as pos, count(*) over () as n from nodes where n = 1
), u as (
    select 0 as level, pos, subroot as h, n from sub
    union all
    select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from u where n > 1 group by level, pos // 2, n
), tops as materialized (select * from u),
steps as (
    select l.r, x.level, x.pos % 2 as odd, y.h from l join nodes x on x.grp = l.grp and x.pos = l.pos // (1 << x.level) and x.n > 1
        left join nodes y on y.grp = x.grp and y.level = x.level and y.pos = xor(x.pos, 1)
    union all
    select l.r, 1000 + x.level, x.pos % 2 as odd, y.h from l join sub s on s.grp = l.grp join tops x on x.pos = s.pos // (1 << x.level) and x.n > 1
        left join tops y on y.level = x.level and y.pos = xor(x.pos, 1)
), way as materialized (
    select *, row_number() over (partition by r order by level) as k from steps
), fold as (
    select r, 1 as k, case when hit then other else leaf end as h from l
    union all
    select o.r, o.k + 1, sha256(case when w.h is null then o.h when w.odd = 1 then w.h || o.h else o.h || w.h end) from fold o join way w on w.r = o.r and w.k = o.k
), proof as (
    select l.r, sha256(coalesce(string_agg(w.h, '' order by w.k), '')) as proof_sha256 from l left join way w on w.r = l.r group by l.r
)
select l.doc_id, l.leaf, s.subroot, g.h as root, p.proof_sha256, o.folded_root, o.folded_root = g.h as verified
from l join sub s on s.grp = l.grp join proof p on p.r = l.r join (select r, arg_max(h, k) as folded_root from fold group by r) o on o.r = l.r
join tops g on g.n = 1
"""

QUERIES = {
    "op1_exact_dedup": Query(op1, OP1_SQL),
    "op2_mixing": Query(op2),
    "op3_lm_scores": Query(op3),
    "op4_near_duplicates": Query(op4),
    "op5_preferences": Query(op5_answers, OP5_ANSWERS_SQL),
    "op5_turn_pairs": Query(op5, OP5_SQL),
    "op6_quality": Query(op6),
    "op7_licenses": Query(op7),
    "op8_top_k": Query(op8, OP8_SQL),
    "op9_bpe": Query(op9),
    "op10_suffix_dedup": Query(op10),
    "op11_lexical_search": Query(op11, OP11_SQL),
    "op12_merkle_manifest": Query(op12, OP12_SQL),
    "op13_simhash": Query(op13),
}
