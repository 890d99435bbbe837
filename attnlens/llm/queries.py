"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attnlens.llm import aligning, chat, decontam, fim, fingerprint, htmltext, linededup, lm, minhash, packing, sharding, toxicity, warc
from attnlens.llm.common import cut, table

REGIONS, RACKS, SHARDS = 4, 2, 5


def op1_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every 13-word window of ``benchmark``."""
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.with_verdict(found).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles have a similarity of 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op3_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learned from the labels outside the held-out third."""
    out = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    doc_id = F.col("row.doc_id")
    return out.select(doc_id.alias("doc_id"), toxicity.held_out(doc_id).alias("held_out"), "score",
                      (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op4_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every text, learned from those outside the held-out seventh."""
    return lm.scores(table(spark, sf_dir, "documents"))


def op5_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 by the tree of 4 regions x 2 racks x 5 shards; law ``key``."""
    return sharding.shard_rows(table(spark, sf_dir, "documents"), sharding.ShardTree.balanced(REGIONS, RACKS, SHARDS))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens of ``word_bpe_49k``."""
    import public_tokenizers

    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op7_site_spread_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three words and more on three sites and more go, but for their first occurrence."""
    out = linededup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")


def op8_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, written to the shared folder and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_scaled_sketch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, five-word shingles, one hash in four."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_tree_model_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_seekable_frames_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle forms of every document, from frames stored in the shared folder."""
    return fim.digests(fim.transform(cut(fim.frames(table(spark, sf_dir, "documents")))))


def op12_fragment_monoid_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of ``byte_bpe_50k`` and ``piece_bpe_32k`` tokens in every document."""
    import public_tokenizers

    found = aligning.links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that says control strings, read back from the prefix tree's tokens."""
    import public_tokenizers

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    both = rows.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], rows.schema))
    tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return chat.read_back(*chat.tree(both, tokenizer), tokenizer)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_fm_index_decontamination, op2_minhash_near_dedup, op3_weak_supervision_toxicity, op4_gated_recurrent_lm,
        op5_weighted_hash_tree, op6_sum_of_squares_packing, op7_site_spread_line_dedup, op8_chunked_warc, op9_scaled_sketch_fingerprints, op10_tree_model_html_text,
        op11_seekable_frames_fim, op12_fragment_monoid_alignment, op13_prefix_tree_chat)}


_OP1_SQL = r"""
with words as (
  select 'd' kind, doc_id id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
items as (
  select id, least(13, len(w)) n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) i, w from words where kind = 'b' and len(w) > 0),
windows as (select distinct id::varchar item, n, array_to_string(w[i:i + n - 1], ' ') s from items),
lengths as (select distinct n from windows),
places as (
  select id, w, n, unnest(range(1, len(w) - n + 2)) i from words, lengths where kind = 'd' and len(w) >= n),
hits as (
  select p.id, p.i, p.n, x.item from places p join windows x on x.n = p.n and x.s = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
covered as (select id, count(distinct k) n_hit from (select id, unnest(range(i, i + n)) k from hits) group by id),
found as (select id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct id, item from hits) group by id)
select d.doc_id, coalesce(len(x.w), 0)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(x.w), 0) contaminated
from documents d left join words x on x.kind = 'd' and x.id = d.doc_id left join covered c on c.id = d.doc_id left join found f on f.id = d.doc_id
"""


_CRC_TABLE = "(select list(c order by i) t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) r(i)))"


def _draws(name: str, children: str) -> str:
    """The child of ``children`` (list of structs id, w) that wins the weighted draw under ``name``."""
    return (f"list_sort(list_transform({children}, lambda c: {{'e': round(-ln((('0x' || substr(md5({name} || '/' || c.id), 1, 13))::bigint + 0.5)"
            f" / 4503599627370496.0) / c.w, 12), 'id': c.id}}))[1].id")


def _op5_sql() -> str:
    region = "[" + ", ".join(f"{{'id': {r}, 'w': 10.0}}" for r in range(REGIONS))
    racks = "[{'id': 0, 'w': 5.0}, {'id': 1, 'w': 5.0}]"
    leaves = "list_transform(range(5), lambda s: {'id': (region * 2 + rack) * 5 + s, 'w': 1.0})"
    return f"""
with base as (
  select doc_id, coalesce(doc_id::varchar, 'null') k, strlen(coalesce(text, '')) + 16 size, encode(coalesce(text, '')) b from documents),
r as (select *, {_draws("('region:' || k)", region + "]")} region, {_draws("('region:' || k)", region + ", {'id': 4, 'w': 1.0}]")} grown_region from base),
k as (select *, {_draws("('rack:' || region || ':' || k)", racks)} rack, {_draws("('rack:' || grown_region || ':' || k)", racks)} grown_rack from r),
s as (
  select *, {_draws("('shard:' || region || ':' || rack || ':' || k)", leaves)}::int shard from k),
g as (
  select *, case when grown_region = 4 then 40 else shard end::int grown_shard,
         ('0x' || substr(md5(k), 1, 8))::bigint % 256 bucket from s)
select doc_id, size::bigint size,
       (select xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(b) * 2, 2), lambda i: ('0x' || substr(hex(b), i, 2))::bigint)),
               lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295::bigint) from {_CRC_TABLE}) text_crc32,
       'key' law, shard, row_number() over (partition by shard order by bucket, doc_id) - 1 slot, grown_shard
from g"""


_OP7_SQL = """
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos from documents),
keyed as (select *, trim(line, ' ') t from lines),
flagged as (
  select t, min({'d': doc_id, 'p': pos}) first from keyed where len(regexp_split_to_array(t, '\\s+')) >= 3
  group by t having count(distinct source) >= 3),
marked as (
  select k.doc_id, k.pos, k.line, f.t is not null and not (k.doc_id = f.first.d and k.pos = f.first.p) gone
  from keyed k left join flagged f using (t))
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0)::bigint n_removed, case when d.text is null then null else coalesce(m.text, '') end as text
from documents d left join (
  select doc_id, count(*) n_lines, sum(gone::int) n_removed, string_agg(line, chr(10) order by pos) filter (not gone) as text
  from marked group by doc_id) m using (doc_id)
"""


_OP8_SQL = """
with b as (select page_id, encode(coalesce(html, '')) p from pages),
h as (select page_id, octet_length(p) n, unhex(sha1(p)) d, sha1(p) x from b),
g as (select x, min(page_id) first from h group by x)
select page_id, n payload_bytes,
       (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) % 32 + 1)::bigint, 1), '' order by i) from range(32) r(i)) payload_digest,
       case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to
from h join g using (x)
"""


_OP11_SQL = r"""
with h as (
  select doc_id, coalesce(text, '') x, sha256('7:' || coalesce(doc_id::varchar, 'null')) s, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u from documents),
d as (
  select doc_id, x, u, len(u) n, list_transform(range(4), lambda i: ('0x' || substr(s, 8 * i + 1, 8))::bigint) h from h),
c as (
  select *, least(h[1] % (n + 1), h[2] % (n + 1)) a, greatest(h[1] % (n + 1), h[2] % (n + 1)) b,
         case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h[3] % 100 >= 100 then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end form from d),
p as (
  select *, coalesce(array_to_string(u[1:a], ''), '') prefix, coalesce(array_to_string(u[a + 1:b], ''), '') middle, coalesce(array_to_string(u[b + 1:], ''), '') suffix from c)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(prefix) end::bigint prefix_chars, case when form <> 'plain' then length(middle) end::bigint middle_chars,
       sha256(case form when 'plain' then x when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) output_sha256,
       sha256(x) restored_sha256
from p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_fm_index_decontamination": _OP1_SQL, "op5_weighted_hash_tree": _op5_sql(), "op7_site_spread_line_dedup": _OP7_SQL, "op8_chunked_warc": _OP8_SQL,
            "op11_seekable_frames_fim": _OP11_SQL}
