"""The registered queries of this subpackage, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, graph_search, html_text, language_id, lattice_dedup, lattice_lm, poisson_mix, prefix_trie, recompression, sharding, spelling, tensored_minhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shards of the registered placement.
SHARDS = [f"shard-{k:02d}" for k in range(16)]


@query
def op1_sharding(spark, sf_dir):
    """Every document's slot and shard."""
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id", SHARDS).select("doc_id", "source", "slot", "shard", "shard_name")


# The turns are one row each: which slots are taken (as a text of 0 and 1), and who took the last.
ORACLE["op1_sharding"] = rf"""
with recursive shards as (
  select k::int as shard, 'shard-' || lpad(k::varchar, 2, '0') as shard_name from (select unnest(range(0, 16)) as k)),
orders as (
  select shard, shard_name, ('0x' || substr(md5(shard_name || '|offset'), 1, 15))::bigint % {sharding.TABLE_SIZE} as o,
         ('0x' || substr(md5(shard_name || '|skip'), 1, 15))::bigint % {sharding.TABLE_SIZE - 1} + 1 as s from shards),
wishes as (select shard, list((o + s * j) % {sharding.TABLE_SIZE} order by j) as w from orders, (select unnest(range(0, {sharding.TABLE_SIZE})) as j) group by shard),
claims(turn, taken, slot, shard) as (
  select 0, list_transform(range(0, {sharding.TABLE_SIZE}), lambda x: false), -1::bigint, -1
  union all
  select turn + 1, list_concat(list_concat(taken[:slot_now], [true]), taken[slot_now + 2:]), slot_now, k
  from (select turn, taken, wishes.shard as k, list_filter(w, lambda x: not taken[x + 1])[1] as slot_now
        from claims join wishes on wishes.shard = turn % 16 where turn < {sharding.TABLE_SIZE})),
placed as (select slot, shard from claims where slot >= 0)
select doc_id, source, slot, shard, shard_name
from documents
join placed on slot = ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint % {sharding.TABLE_SIZE}
join shards using (shard)
"""


#: Vocabulary whose pieces the registered scores lay over words; the operator takes any.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def held_out(remainder: int):
    """Documents that nothing is learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == remainder


@query
def op2_lattice_dedup(spark, sf_dir):
    """Links and components of embeddings of one label at cosine 0.93."""
    return lattice_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


ORACLE["op2_lattice_dedup"] = """
with recursive vectors as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links as (select x.vec_id as a, y.vec_id as b from vectors x join vectors y
  on x.label = y.label and len(x.e) = len(y.e) and x.vec_id <> y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.93),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a as vec_id, min(b) as m from reach group by a),
counts as (select a as vec_id, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(m, vec_id)) as component_id, vec_id = least(vec_id, coalesce(m, vec_id)) as kept
from embeddings left join least using (vec_id) left join counts using (vec_id)
"""


@query
def op3_language_id(spark, sf_dir):
    """Languages of documents, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out(0)))
    return language_id.identify(docs, model).select("doc_id", held_out(0).alias("held_out"), "lang_pred", "score")


@query
def op4_lattice_lm(spark, sf_dir):
    """Log probabilities of documents under the lattice model, learned from all but a fifth of them."""
    return lattice_lm.score(table(spark, sf_dir, "documents"), PIECES, ~held_out(1)).select(
        "doc_id", held_out(1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score")


@query
def op5_graph_search(spark, sf_dir):
    """The five nearest of every fiftieth embedding, found in pruned graphs."""
    return graph_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query
def op6_toxicity(spark, sf_dir):
    """Toxicity of documents, learned from labelled ones outside a held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out(0)))
    return toxicity.score(docs, model).select("doc_id", held_out(0).alias("held_out"), "score", "predicted")


@query
def op7_poisson_mix(spark, sf_dir):
    """Documents mixed to equal weights of their sources, as many as there are."""
    return poisson_mix.mix(table(spark, sf_dir, "documents"))


ORACLE["op7_poisson_mix"] = """
with recursive rates as (
  select source, (1.0::double / (select count(distinct source) from documents)) * (select count(*) from documents)::double / count(*) as rate
  from documents group by source),
parted as (select source, greatest(1, ceil(rate / 16.0))::int as parts, rate / greatest(1, ceil(rate / 16.0)) as mean from rates),
steps(source, k, p, total) as (
  select source, 0, exp(-mean), exp(-mean) from parted
  union all
  select s.source, k + 1, p * mean / (k + 1), total + p * mean / (k + 1) from steps s join parted using (source) where k < 88),
draws as (
  select doc_id, source, ('0x' || substr(md5('1|copies|' || part || '|' || doc_id), 1, 13))::bigint::double / 4503599627370496 as u
  from (select doc_id, source, unnest(range(1, parts + 1)) as part from documents join parted using (source))),
counted as (select d.doc_id, count(k) as n from draws d left join steps s on d.source = s.source and s.total <= d.u group by d.doc_id),
each as (select doc_id, unnest(range(0, n))::int as replica from counted)
select documents.*, replica, ('0x' || substr(md5('1|order|' || replica || '|' || doc_id), 1, 13))::bigint::double / 4503599627370496 as order_key
from each join documents using (doc_id)
"""


@query
def op8_substring_dedup(spark, sf_dir):
    """Words of repeated 13-word windows of documents."""
    return recompression.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE["op8_substring_dedup"] = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
starts as (select doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) as p from words),
windows as (select doc_id, p, array_to_string(w[p:p + 12], ' ') as s from starts),
least as (select s, min(doc_id) as first_id from windows group by s),
repeats as (select doc_id, list(p) as ps from windows join least using (s) where doc_id > first_id group by doc_id),
marks as (
  select doc_id, list_distinct(flatten(list_transform(ps, lambda p: range(p, p + 13)))) as gone from repeats),
kept as (
  select words.doc_id, len(w) as n, coalesce(len(gone), 0) as removed,
         case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end as k
  from words left join marks on words.doc_id = marks.doc_id)
select doc_id, n::bigint as n_words, removed::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""


#: The rank file and pattern of the registered encoding; the operator takes any.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query
def op10_byte_bpe(spark, sf_dir):
    """Byte-level BPE of documents: digests of the ids and of what they decode to."""
    return byte_bpe.digest(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query
def op9_minhash_dedup(spark, sf_dir):
    """Near duplicates of documents on two-word shingles, similarity 0.8."""
    return tensored_minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


ORACLE["op9_minhash_dedup"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, unnest(case when len(w) < 2 then (case when len(w) = 0 then [] else [w[1]] end)
    else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end) as s from words),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as c from sets x join sets y on x.s = y.s and x.doc_id < y.doc_id group by all),
links as (select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
least as (select a as doc_id, min(b) as m from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) as kept
from documents left join sizes using (doc_id) left join least using (doc_id)
"""


@query
def op11_html_text(spark, sf_dir):
    """Main texts of pages; weights come from pages that name their article."""
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


# What the rule means for pages whose article is one element of headings and paragraphs, as all pages of the tables are.
ORACLE["op11_html_text"] = r"""
with inner_html as (select page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)(</article>|$)', 1, 's') as a from pages),
blocks as (select page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h[1-6]|li|ul|ol|div|section|blockquote)(?:\s[^>]*)?>'),
  lambda b: regexp_replace(regexp_replace(b, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')) as bs from inner_html),
decoded as (select page_id, url, list_transform(bs, lambda b: trim(regexp_replace(
  regexp_replace(replace(replace(replace(replace(replace(b, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'),
    '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as bs from blocks),
texts as (select page_id, url, array_to_string(list_filter(bs, lambda b: b <> ''), chr(10) || chr(10)) as text from decoded)
select page_id, url, text, length(text)::bigint as n_chars from texts
"""


#: CRC-32 in DuckDB: the table of the reflected polynomial, and a fold of a list of bytes.
CRC32 = """
  table_of as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t)"""


def crc32_of(bytes_: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


@query
def op12_spelling(spark, sf_dir):
    """Words of documents with the more frequent spellings one letter away."""
    return spelling.variants(spelling.frequent(spelling.words_with_slips(table(spark, sf_dir, "documents"))))


ORACLE["op12_spelling"] = rf"""
with recursive {CRC32},
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), '{spelling.UPPER}', '{spelling.LOWER}') as x from documents),
each as (select doc_id, x, count(*) as n from runs group by all),
summed as (select x, n, {crc32_of("""flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || x, ''),
  lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [192 + (ord(c) >> 6), 128 + (ord(c) & 63)]::bigint[] end))""")} as h from each, table_of),
slips as (select case when h % 97 = 0 then left(x, h % length(x)) || substr(x, h % length(x) + 2) else x end as word, n from summed),
words as (select word, sum(n)::bigint as n from slips where length(word) >= 5 group by word having sum(n) >= 3),
holes as (select word, i, left(word, i - 1) as p, substr(word, i + 1) as s from (select word, unnest(range(1, length(word) + 1)) as i from words)),
inserted as (select distinct h.word as a, w.word as b from holes h join words w on w.word = p || s),
near as (select x.word as a, y.word as b from holes x join holes y on x.p = y.p and x.s = y.s and x.word <> y.word
  union all select a, b from inserted union all select b, a from inserted),
best as (select a as word, count(*) as n_near, arg_min(b, (-w.n, b)) as b, max(w.n) as bn from near join words w on w.word = b group by a),
known as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when bn >= 2 * w.n then b end as form, case when bn >= 2 * w.n then bn end as form_n
  from words w left join best using (word)),
walk(word, reached) as (select word, word from known union all select walk.word, form from walk join known on known.word = reached where form is not null),
ends as (select walk.word, reached from walk join known on known.word = reached where form is null)
select known.word, n, n_near, form, form_n, reached as root from known join ends using (word)
"""


@query
def op13_prefix_trie(spark, sf_dir):
    """Nodes of the trie of conversations that each start with up to three turns of one in twenty."""
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(turns, 20, "crc32(string(conv_id)) % 4"))


ORACLE["op13_prefix_trie"] = rf"""
with recursive {CRC32},
turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place,
  {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} as x from conversations where conv_id is not null),
own as (select conv_id, list(x order by place) as xs from turns group by conv_id),
counted as (select *, ({crc32_of("list_transform(string_split(conv_id::varchar, ''), lambda d: ascii(d)::bigint)")} % 4)::int as h from own, table_of),
rebuilt as (select c.conv_id, list_concat(coalesce(b.xs[:c.h], []), c.xs[c.h + 1:]) as p
  from counted c left join own b on b.conv_id = c.conv_id - c.conv_id % 20),
starts as (select conv_id, p[:d] as node, d, d = len(p) as ends from (select conv_id, p, unnest(range(0, len(p) + 1)) as d from rebuilt)),
nodes as (select node, d, min(conv_id) as conv_id, count(*) as n,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as sha,
  case when d = 0 then 0 else len(list_filter(regexp_split_to_array(node[d].text, '[ 	-
]+'), lambda w: w <> '')) end as words
  from starts group by node, d),
linked as (select c.*, p.conv_id as parent, (select count(*) from nodes k where k.d = c.d + 1 and k.node[:c.d] = c.node) as kids
  from nodes c left join nodes p on c.d > 0 and p.d = c.d - 1 and p.node = c.node[:c.d - 1]),
below as (select a.node, sum((k.kids = 0)::int) as leaves, sum((k.n - 1) * k.words) as saved
  from linked a join linked k on k.d >= a.d and k.node[:a.d] = a.node group by a.node)
select conv_id, d::bigint as depth, parent as parent_conv_id, n as n_convs, kids as n_children, leaves::bigint as n_leaves,
       saved::bigint as saved_tokens, sha as ends_sha256 from linked join below using (node)
"""
