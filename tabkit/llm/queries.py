"""One query per operator over the supplied tables, with the SQL twin where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .byte_bpe import decode_documents, encode_documents
from .importance import resample
from .jaccard_join import jaccard_components
from .line_dedup import dedup_lines
from .merkle import manifest
from .packing import Limits, pack_documents
from .quality_rules import base_failed, judge_quality, text_counts
from .secrets import KINDS, scan_secrets
from .sharding import shard_rows
from .shipping import ship
from .spelling import spelling_variants
from .token_counts import count_tokens
from .url_filter import judge_urls

#: The rules of op5: host and path, and what becomes of urls that they fit.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters found in 3 documents stay only where the id is largest."""
    kept = dedup_lines(_table(spark, sf_dir, "documents"), min_docs=3, min_chars=20, batches=4)
    return kept.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("text")).alias("kept_sha256"))


OP1_SQL = """
with lines as (
    select doc_id,
           unnest(string_split(coalesce(text, ''), chr(10))) as line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
    from documents
),
keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
),
frequent as (
    select key, max(doc_id) as top_id from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
),
judged as (
    select keyed.*, frequent.key is not null and frequent.top_id <> keyed.doc_id as gone
    from keyed left join frequent on keyed.key = frequent.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""

def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard_components(_table(spark, sf_dir, "documents"), shingle=3, num=9, den=10)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict per document; cutoffs per language from all labelled documents."""
    judged = judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), stratum="lang")
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, *[c for c in judged.columns if c not in first])


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base rule of ``op4_quality_rules``, which SQL can express, without its verdict."""
    ship(spark)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counts = text_counts(_table(spark, sf_dir, "documents"), ["doc_id"])
    return counts.select("doc_id", *names, base_failed().alias("base_failed"))


QUALITY_COUNTS_SQL = r"""
with texts as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
listed as (select row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from texts),
words as (select row, unnest(words) as word, unnest(range(len(words))) as pos from listed),
windows as (
    select row, pos, word || chr(32) || lead(word, 1) over w || chr(32) || lead(word, 2) over w as three from words window w as (partition by row order by pos)
),
again as (select row, pos from (select *, count(*) over (partition by row, three) as n from windows where three is not null) where n > 1),
covered as (select row, count(distinct pos + k) as n_repeat_words from again, (select unnest([0, 1, 2]) as k) group by row),
lines as (select row, unnest(string_split(text, chr(10))) as line from texts),
dups as (select row, count(line) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by row),
sizes as (select row, count(*) as n_words, sum(length(word))::bigint as word_chars from words group by row),
counts as (
    select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
           coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
    from texts left join sizes using (row) left join dups using (row) left join covered using (row)
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and score of the best unigram segmentation of every text."""
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; urls without a rule follow their aliases, and are allowed without any."""
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of every vector whose id is divisible by 20."""
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids, and give digests of both."""
    where, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = decode_documents(encode_documents(_table(spark, sf_dir, "documents"), where, pattern), where, pattern)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of equal numbers of rows, equal texts together."""
    return shard_rows(_table(spark, sf_dir, "documents"), shards=40).drop("group")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every text into sequences of at most 4096 tokens, 256 segments and 4096 loss-bearing tokens."""
    where = public_tokenizers.path("word_bpe_49k.json")
    pieces = pack_documents(_table(spark, sf_dir, "documents"), where, end_id=2, limits=Limits(4096, 256, 4096))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, key and verdict of every document; the target is labelled good, non-toxic text."""
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of 6 letters and 5 occurrences or more."""
    return spelling_variants(_table(spark, sf_dir, "documents"), min_chars=6, min_count=5, lead=5, slip=199)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, folded for half of them from a text that lost its line feeds."""
    docs = _table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], tampered)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the patterns in every document, and all spans with those that the network adds."""
    found = scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, _sha256(written("base")).alias("base_sha256"), written("spans").alias("spans"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "quality_counts": quality_counts,
    "op5_url_filter": op5_url_filter,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_importance_resampling": op10_importance_resampling,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_secret_scan": op13_secret_scan,
}

OP2_SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') as w
    from documents
),
shingles as materialized (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as s
    from words
),
sizes as materialized (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as common
    from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all
),
links as materialized (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * common >= 90 * (x.n + y.n - common)
),
reach(doc_id, other) as (
    select doc_id, doc_id from documents
    union
    select reach.doc_id, links.b from reach join links on reach.other = links.a
)
select d.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(other) as component_id
from documents d join reach on reach.doc_id = d.doc_id left join sizes on sizes.doc_id = d.doc_id
group by d.doc_id
"""

def _attribute_sql(name: str) -> str:
    value = rf"""regexp_extract(t, '(?is)[\s"''/]{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)"""
    return rf"""trim(replace(regexp_replace({value}, '^["'']|["'']$', '', 'g'), '&amp;', '&'))"""


_RULE_ROWS = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}', '{a}')" for r, a in URL_RULES)

OP5_SQL = rf"""
with recursive tags as (
    select url as from_url, unnest(list_concat(
        list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'),
            lambda t: list_contains(regexp_split_to_array(lower({_attribute_sql("rel")}), '\s+'), 'canonical')), lambda t: {_attribute_sql("href")}),
        list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: lower({_attribute_sql("http-equiv")}) = 'refresh'),
            lambda t: regexp_extract({_attribute_sql("content")}, '(?is)\burl\s*=\s*["'']?\s*([^"''>\s]+)', 1))
    )) as target
    from pages
),
parts as (
    select *, regexp_extract(from_url, '^[^:/?#]+://[^/?#]*') as origin, regexp_extract(from_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) as base_path,
           regexp_extract(target, '^[^?#]*') as path, regexp_extract(target, '^[^?#]*(.*)$', 1) as rest
    from tags where target <> '' and from_url is not null
),
merged as (
    select *, case when starts_with(path, '/') then path else regexp_extract('/' || regexp_replace(base_path, '^/', ''), '^.*/') || path end as whole from parts
),
links as (
    select from_url, case when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') then target
        when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') or starts_with(target, '#') or origin = '' then null
        when starts_with(target, '//') then regexp_extract(from_url, '^[^:/?#]+:') || target
        when path = '' then origin || base_path || rest
        else origin || list_reduce(list_prepend('', string_split(substr(whole, 2), '/')), lambda done, part: case when part = '.' then done
            when part = '..' then regexp_replace(done, '/[^/]*$', '') else done || '/' || part end)
            || case when regexp_matches(whole, '/\.\.?$') then '/' else '' end || rest end as to_url
    from merged
),
urls as (select url from pages union select from_url from links union select to_url from links),
parsed as (
    select url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from urls where url is not null
),
split as (
    select url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
           regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') as query
    from parsed
),
nodes as (
    select *, case when contains(url, '://') then host || path || case when query <> '' then '?' || query else '' end else url end as node
    from split
),
rules(rule_host, rule_path, rule, action) as (values {_RULE_ROWS}),
matched as (
    select url, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action
    from nodes join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
    where host <> '' group by url
),
edges as (
    select f.node as a, t.node as b from links join nodes f on f.url = from_url join nodes t on t.url = to_url
),
both_ways as (select a, b from edges union select b, a from edges),
reach(node, other) as (
    select distinct node, node from nodes
    union
    select reach.node, both_ways.b from reach join both_ways on reach.other = both_ways.a
),
decided as (
    select reach.node, count(*) filter (where action = 'block') > 0 and count(*) filter (where action = 'allow') = 0 as blocked
    from reach join nodes on nodes.node = reach.other left join matched on matched.url = nodes.url group by reach.node
)
select p.page_id, coalesce(n.host, '') as host, coalesce(n.path, '') as path, m.rule,
       coalesce(m.action, case when d.blocked then 'block' else 'allow' end) as verdict
from pages p left join nodes n on n.url = p.url left join matched m on m.url = p.url left join decided d on d.node = n.node
"""



def _crc32_sql(bytes_list: str) -> str:
    """DuckDB has no crc32: eight shifts for each byte of a list."""
    shifted = "case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end"
    step = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {shifted})"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_list}), lambda c, b: {step}), 4294967295::bigint)"


_HEX_BYTES = "list_transform(range(1, strlen(key) * 2, 2), lambda i: (instr('123456789ABCDEF', hex[i]) * 16 + instr('123456789ABCDEF', hex[i + 1]))::bigint)"

OP11_SQL = rf"""
with recursive runs as (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\x{{C0}}-\x{{FF}}]+')) as run
    from documents
),
counted as (select doc_id, run, count(*) as n from runs where length(run) >= 6 group by all),
hexed as (select run, n, coalesce(doc_id::varchar, '') || ':' || run as key, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as hex from counted),
hashed as (select run, n, {_crc32_sql(_HEX_BYTES)} as h from hexed),
typed as (
    select case when h % 199 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from hashed
),
words as materialized (select word, sum(n)::bigint as n from typed where length(word) >= 6 group by word having sum(n) >= 5),
cuts as materialized (
    select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
),
near as materialized (
    select a.word, b.word as other, b.n as other_n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union
    select a.word, b.word, b.n from cuts a join words b on a.rest = b.word
    union
    select b.word, a.word, a.n from cuts a join words b on a.rest = b.word
),
best as (select word, count(*) as n_near, max(other_n) as top_n from near group by word),
judged as materialized (
    select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.top_n >= 5 * w.n then b.top_n end as form_n,
           case when b.top_n >= 5 * w.n then (select min(other) from near x where x.word = w.word and x.other_n = b.top_n) end as form
    from words w left join best b on b.word = w.word
),
onward as (
    select word, word as root, form as further from judged
    union all
    select onward.word, onward.further, judged.form from onward join judged on judged.word = onward.further
)
select j.word, j.n, j.n_near, j.form, j.form_n, o.root from judged j join onward o on o.word = j.word and o.further is null
"""

_TREE = """{name}(tree, lvl, pos, hash, n) as (
    {leaves}
    union all
    select tree, lvl + 1, pos // 3, sha256(string_agg(hash, '' order by pos)), any_value((n + 2) // 3) from {name} where n > 1 group by tree, lvl, pos // 3
),
{name}_kin as materialized (
    select a.tree, a.lvl, a.pos, coalesce(string_agg(b.hash, '' order by b.pos) filter (b.pos < a.pos), '') as before,
           coalesce(string_agg(b.hash, '' order by b.pos) filter (b.pos > a.pos), '') as after
    from {name} a left join {name} b on b.tree = a.tree and b.lvl = a.lvl and b.pos // 3 = a.pos // 3 where a.n > 1 group by all
)"""
_CLIMB = """{name}(leaf, tree, lvl, pos, proof, folded) as (
    {start}
    union all
    select c.leaf, c.tree, c.lvl + 1, c.pos // 3, c.proof || k.before || k.after, sha256(k.before || c.folded || k.after)
    from {name} c join {kin} k on k.tree = c.tree and k.lvl = c.lvl and k.pos = c.pos
)"""


def _encoded_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::varchar)::varchar || ':' || ({value})::varchar, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_encoded_sql(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_DIGIT_BYTES = "list_transform(string_split(doc_id::varchar, ''), lambda d: ord(d)::bigint)"

OP12_SQL = f"""
with recursive hashed as (
    select doc_id, row_number() over (order by source nulls first, doc_id) as leaf_no, dense_rank() over (order by source nulls first) as tree, {_leaf_sql("text")} as leaf,
           case when {_crc32_sql(_DIGIT_BYTES)} % 2 = 0 then {_leaf_sql("replace(text, chr(10), '')")} else {_leaf_sql("text")} end as other
    from documents
),
leaves as materialized (
    select *, row_number() over (partition by tree order by doc_id) - 1 as pos, count(*) over (partition by tree) as n from hashed
),
{_TREE.format(name="low", leaves="select tree, 0, pos, leaf, n from leaves")},
subroots as materialized (select tree, hash, row_number() over (order by tree) - 1 as pos, count(*) over () as n from low where n = 1),
{_TREE.format(name="top", leaves="select 0, 0, pos, hash, n from subroots")},
{_CLIMB.format(name="up", kin="low_kin", start="select leaf_no, tree, 0, pos, '', other from leaves")},
at_subroot as materialized (select leaf, arg_max(proof, lvl) as proof, arg_max(folded, lvl) as folded, any_value(tree) as tree from up group by leaf),
{_CLIMB.format(name="over", kin="top_kin", start="select a.leaf, 0, 0, s.pos, a.proof, a.folded from at_subroot a join subroots s on s.tree = a.tree")},
at_root as (select leaf, arg_max(proof, lvl) as proof, arg_max(folded, lvl) as folded from over group by leaf)
select l.doc_id, l.leaf, s.hash as subroot, r.hash as root, sha256(a.proof) as proof_sha256, a.folded as folded_root, a.folded = r.hash as verified
from leaves l join subroots s on s.tree = l.tree join at_root a on a.leaf = l.leaf_no cross join (select hash from top where n = 1) r
"""

ORACLES = {
    "op2_jaccard_join": OP2_SQL,
    "op5_url_filter": OP5_SQL,
    "op1_line_dedup": OP1_SQL,
    "quality_counts": QUALITY_COUNTS_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
