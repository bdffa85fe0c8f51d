"""Oracle SQL (DuckDB) of the training-data queries that SQL can express."""

from __future__ import annotations

from .licenses import BASE, GRAM, LEAST_COVERED, NEAR_DIAGONALS, TEMPLATES
from .merkle import FIELDS
from .quality import FENCES, LEAST_ROWS, MIN_WORDS
from .urls import RULES

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(_LOWER.format("text"))
_SPACE_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_OP1 = f"""
with asked as (select item_id, w, least(10, len(w)) n from (select item_id, {_ALNUM_WORDS} w from benchmark) where len(w) > 0),
phrases as (select distinct item_id, n, array_to_string(w[i + 1:i + n], ' ') phrase from (select *, unnest(range(len(w) - n + 1)) i from asked)),
docs as (select doc_id, {_ALNUM_WORDS} w from documents),
sizes as (select distinct n from phrases),
windows as (select doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') phrase from (select doc_id, w, n, unnest(range(len(w) - n + 1)) i from docs, sizes where len(w) >= n)),
hits as (select distinct doc_id, item_id, i, windows.n from windows join phrases using (n, phrase)),
words as (select doc_id, count(distinct i + j) n_hit from (select doc_id, i, unnest(range(n)) j from hits) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids from (select distinct doc_id, cast(item_id as varchar) id from hits) group by doc_id)
select docs.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from docs left join words using (doc_id) left join items using (doc_id)
"""

_ENTITIES = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _block_text(block: str) -> str:
    text = f"regexp_replace({block}, '<[^>]+>', '', 'g')"
    for name, character in _ENTITIES:
        text = f"replace({text}, '{name}', '{character}')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


_OP2 = f"""
with bodies as (select page_id, url, regexp_extract(regexp_replace(coalesce(html, ''), '<[^<>]*$', ''), '(?s)<article>(.*?)(?:</article>|$)', 1) body from pages),
pieces as (select page_id, url, list_transform(string_split_regex(replace(body, '<br>', ' '), '</?(?:p|h1)>'), lambda b: {_block_text("b")}) p from bodies),
texts as (select page_id, url, array_to_string(list_filter(p, lambda b: b <> ''), chr(10) || chr(10)) as "text" from pieces)
select page_id, url, "text", cast(length("text") as bigint) n_chars from texts
"""

_RATIOS = {"word_length": "word_chars / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "repeat_ratio": "n_repeat_words / greatest(n_words, 1)"}
_OP3 = f"""
with docs as (select doc_id, lang, source, {_SPACE_WORDS} w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines from documents),
grams as (select doc_id, i, list_aggregate(w[i + 1:i + 3], 'string_agg', ' ') gram from (select doc_id, w, unnest(range(len(w) - 2)) i from docs where len(w) > 2)),
again as (select doc_id, i from grams join (select doc_id, gram from grams group by all having count(*) > 1) using (doc_id, gram)),
repeats as (select doc_id, count(distinct i + j) n from (select doc_id, i, unnest(range(3)) j from again) group by doc_id),
counts as (select docs.doc_id, lang, source, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars,
    cast(len(regexp_extract_all(array_to_string(w, ''), '[#*$%&|<>]')) as bigint) n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) n_dup_lines,
    cast(coalesce(n, 0) as bigint) n_repeat_words, len(lines) n_lines from docs left join repeats using (doc_id)),
ratios as (select *, {", ".join(f"{v} as {k}" for k, v in _RATIOS.items())} from counts),
groups as (select lang, source, count(*) n, {", ".join(f"quantile_disc({k}, [0.25, 0.75]) {k}" for k in _RATIOS)} from ratios where n_words > 0 group by all),
langs as (select lang, {", ".join(f"quantile_disc({k}, [0.25, 0.75]) all_{k}" for k in _RATIOS)} from ratios where n_words > 0 group by all),
fences as (select lang, source, {", ".join(f"(case when n >= {LEAST_ROWS} then {k} else all_{k} end) {k}" for k in _RATIOS)} from groups join langs using (lang))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words)
  and {" and ".join(f"coalesce(r.{k} <= f.{k}[2] + {a} * (f.{k}[2] - f.{k}[1]) + {b}, true)" for k, (a, b) in FENCES.items())} kept
from ratios r left join fences f on r.lang is not distinct from f.lang and r.source is not distinct from f.source
"""


def _license_templates() -> str:
    phrases = [*((p, k, True) for p, k in BASE.items()), *((p, k, False) for p, k in TEMPLATES.items())]
    rows = [f"({i}, '{k}', {b}, {len(p.split()) - GRAM + 1}, {at}, '{' '.join(p.split()[at : at + GRAM])}')" for i, (p, k, b) in enumerate(phrases) for at in range(len(p.split()) - GRAM + 1)]
    return ", ".join(rows)


_OP5 = f"""
with templates(template, label, base, n_grams, template_pos, gram) as (values {_license_templates()}),
docs as (select doc_id, {_ALNUM_WORDS} w from documents),
grams as (select doc_id, i, array_to_string(w[i + 1:i + {GRAM}], ' ') gram from (select doc_id, w, unnest(range(len(w) - {GRAM - 1})) i from docs where len(w) >= {GRAM})),
votes as (select doc_id, template, label, base, n_grams, i - template_pos diagonal, list_distinct(list(template_pos)) covered from grams join templates using (gram) group by all),
bases as (select doc_id, count(*) n_base, min(diagonal) first_word, max(diagonal) last_word, list(distinct label) base_set from votes where base and len(covered) = n_grams group by doc_id),
apart as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) <= {NEAR_DIAGONALS} then 0 else 1 end new from votes where not base),
spans as (select *, sum(new) over (partition by doc_id, template order by diagonal) span from apart),
covered as (select doc_id, label, len(list_distinct(flatten(list(covered)))) / n_grams share from spans group by doc_id, template, label, n_grams, span),
method as (select doc_id, max(share) share, list(distinct label) filter (share >= {LEAST_COVERED}) method_set from covered group by doc_id)
select docs.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_base, 0) as bigint) n_base, cast(first_word as bigint) first_word, cast(last_word as bigint) last_word,
  array_to_string(list_sort(coalesce(base_set, [])), ',') base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base_set, []), coalesce(method_set, [])))), ',') labels,
  cast(case when n_base > 0 then 1 else coalesce(share, 0) end as double) score
from docs left join bases using (doc_id) left join method using (doc_id)
"""

_OP6 = """
with sums as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) s from pages),
digests as (select page_id, n, array_to_string(list_transform(range(32),
  lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(s, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31), 1)), '') d from sums),
firsts as (select d, min(page_id) first from digests group by d)
select page_id, cast(n as bigint) payload_bytes, d payload_digest, case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to
from digests join firsts using (d)
"""

_HOST = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP7 = f"""
with rules(rule_host, rule_path, verdict) as (values {", ".join(f"('{h}', '{p}', '{v}')" for (h, p), v in RULES.items())}),
named as (select page_id, url, {_HOST} host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path from pages),
hosts as (select host, 2 * count(*) filter (regexp_matches(url, '[?#]')) >= count(*) copying from named where host <> '' group by host),
fit as (select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) rule, arg_max(verdict, length(rule_host || rule_path)) verdict
  from named join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id)
select page_id, host, path, rule, coalesce(verdict, case when copying then 'block' else 'allow' end) verdict
from named left join fit using (page_id) left join hosts using (host)
"""

_OP8 = f"""
with recursive docs as (select doc_id, {_SPACE_WORDS.replace("coalesce(text, '')", _LOWER.format("text"))} w from documents),
shingles as (select distinct doc_id, array_to_string(w[i + 1:i + 5], ' ') s from (select doc_id, w, unnest(range(greatest(len(w) - 4, 1))) i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
shared as (select a.doc_id a, b.doc_id b, count(*) n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select shared.a, shared.b from shared join sizes x on x.doc_id = shared.a join sizes y on y.doc_id = shared.b where 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from docs union select reach.doc_id, both_ways.b from reach join both_ways on reach.other = both_ways.a)
select docs.doc_id, cast(coalesce(any_value(n), 0) as bigint) n_shingles, min(other) component_id
from docs left join sizes using (doc_id) join reach using (doc_id) group by docs.doc_id
"""

_OP10 = f"""
with docs as (select doc_id, {_SPACE_WORDS} w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) passage from (select doc_id, w, unnest(range(len(w) - 49)) i from docs where len(w) >= 50)),
repeated as (select doc_id, i, row_number() over (partition by passage order by doc_id, i) > 1 later from windows qualify count(*) over (partition by passage) > 1),
runs as (select doc_id, i, later, false only_later from repeated union all select doc_id, i, later, true from repeated where later),
cut as (select *, case when i - lag(i) over (partition by doc_id, only_later order by i) <= 50 then 0 else 1 end new from runs),
islands as (select *, sum(new) over (partition by doc_id, only_later order by i) island from cut),
spans as (select doc_id, only_later, min(i) a, max(i) + 50 b from islands group by doc_id, only_later, island),
texts as (select doc_id, only_later, sum(b - a) n, string_agg(a || '-' || b, ',' order by a) s from spans group by doc_id, only_later)
select x.doc_id, cast(x.n as bigint) n_repeated, cast(coalesce(y.n, 0) as bigint) n_later, x.s spans, coalesce(y.s, '') later_spans
from texts x left join texts y on x.doc_id = y.doc_id and y.only_later where not x.only_later
"""



def _levels(name: str, levels: int) -> str:
    """Runs r of 16 nodes and the nodes above them, level by level; a tree of one node stays as it is."""
    out = []
    for k in range(levels):
        out.append(f"{name}_r{k} as (select tree, pos // 16 up, list(digest order by pos) kids, any_value(size) size from (select *, count(*) over (partition by tree) size from {name}{k}) group by tree, pos // 16)")
        out.append(f"{name}{k + 1} as (select tree, up pos, case when size = 1 then kids[1] else sha256(array_to_string(kids, '')) end digest from {name}_r{k})")
    return ",\n".join(out)


def _walk(name: str, at: int, levels: int) -> str:
    """One more sibling pair for each level: their digests join the proof, and the digest of the way is folded with them."""
    step = "array_to_string(kids[1:(pos % 16)], '') l, array_to_string(kids[(pos % 16 + 2):], '') r"
    return ",\n".join(
        f"w{at + k + 1} as (select doc_id, leaf, subtree, tree, up pos, case when size = 1 then proof else proof || l || r end proof, case when size = 1 then way else sha256(l || way || r) end way from (select w{at + k}.*, up, size, {step} from w{at + k} join {name}_r{k} on w{at + k}.tree = {name}_r{k}.tree and pos // 16 = up))"
        for k in range(levels)
    )


_part = lambda c: f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')"
_CRC = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [cast(ascii(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, v: case when v >= 0 then xor(c, v) else xor(c >> 1, 3988292384 * (c & 1)) end)"
_LEAF = f"sha256({' || '.join(map(_part, FIELDS[:-1]))} || {{}})"
#: Levels for 16^5 rows of a source and 16^3 sources.
_OP13 = f"""
with docs as (select doc_id, source, text, {_LEAF.format(_part("text"))} leaf, {_LEAF.format(_part(_LOWER.format("text").replace("coalesce(text, '')", "text")))} forged,
    xor({_CRC}, 4294967295) % 5 = 0 chosen from documents),
placed as (select *, dense_rank() over (order by source nulls first) - 1 tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 pos from docs),
s0 as (select tree, pos, leaf digest from placed),
{_levels("s", 5)},
t0 as (select 0 tree, tree pos, digest from s5),
{_levels("t", 3)},
w0 as (select doc_id, leaf, tree subtree, tree, pos, '' proof, case when chosen and text is not null then forged else leaf end way from placed),
{_walk("s", 0, 5)},
w6 as (select doc_id, leaf, subtree, 0 tree, subtree pos, proof, way from w5),
{_walk("t", 6, 3)}
select doc_id, leaf, s5.digest subroot, t3.digest root, sha256(proof) proof_sha256, way folded_root, way = t3.digest verified from w9 join s5 on subtree = s5.tree, t3
"""

ORACLE_SQL = {
    "op1_decontamination": _OP1, "op2_html_extraction": _OP2, "op3_quality_rules": _OP3, "op5_license_scan": _OP5, "op6_warc": _OP6, "op7_url_filter": _OP7, "op8_ngram_jaccard": _OP8, "op10_suffix_dedup": _OP10, "op13_merkle_manifest": _OP13,
}
