"""DuckDB SQL that gives the rows of the manifest, archive and fill-in-the-middle queries in a plain way of its own."""

from __future__ import annotations

from gleanmill.llm import fill_middle, merkle, warc


def _field(name: str) -> str:
    return f"case when {name} is null then '-' else strlen(cast({name} as varchar)) || ':' || {name} end"


def _crc32(text: str) -> str:
    """crc32 of a text of ASCII characters."""
    step = "lambda x, y: xor(x >> 1, 3988292384 * (x & 1))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda p: cast(ascii(substr({text}, p, 1)) as bigint))"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), {step})"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), {byte}), 4294967295)"


def _leaf(n_chars: str) -> str:
    names = [n_chars if name == "n_chars" else name for name in merkle.FIELDS]
    return "sha256(" + " || ".join(_field(f"({name})") for name in names) + ")"


_HALVED = "list_transform(range(1, len(nodes) + 1, 2), lambda j: sha256(nodes[j] || coalesce(nodes[j + 1], '')))"

MERKLE_SQL = f"""with recursive
leaves as (select row_number() over () as r, doc_id, coalesce('=' || lang, '') as grp, {_leaf("n_chars")} as leaf,
  case when n_chars is not null and {_crc32("cast(doc_id as varchar)")} % 7 = 0 then {_leaf("n_chars + 1")} end as changed from documents),
placed as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as i from leaves),
levels as (select grp, 0 as k, list(leaf order by i) as nodes from placed group by grp
  union all select grp, k + 1, {_HALVED} from levels where len(nodes) > 1),
tops as (select grp, nodes[1] as subroot, row_number() over (order by grp) - 1 as g from levels where len(nodes) = 1),
above as (select 0 as k, list(subroot order by g) as nodes from tops union all select k + 1, {_HALVED} from above where len(nodes) > 1),
nodes as (select grp, k, unnest(nodes) as h, generate_subscripts(nodes, 1) - 1 as j from levels),
above_nodes as (select k, unnest(nodes) as h, generate_subscripts(nodes, 1) - 1 as j from above),
steps as (
  select r, l.k as step, h, (i >> l.k) & 1 as odd from placed p join (select grp, k from levels where len(nodes) > 1) l on p.grp = l.grp
    left join nodes n on n.grp = l.grp and n.k = l.k and n.j = xor(i >> l.k, 1)
  union all
  select r, 1000 + l.k, h, (g >> l.k) & 1 from placed p join tops t on p.grp = t.grp, (select k from above where len(nodes) > 1) l
    left join above_nodes n on n.k = l.k and n.j = xor(g >> l.k, 1)),
paths as (select r, string_agg(coalesce(h, ''), '' order by step) as path, list(case when odd = 1 then 'L' else 'R' end || coalesce(h, '') order by step) as turns
  from steps group by r),
folded as (select p.*, subroot, coalesce(path, '') as path,
    list_reduce(list_prepend(coalesce(changed, leaf), coalesce(turns, [])),
      lambda h, s: case when s[1] = 'L' then sha256(substr(s, 2) || h) else sha256(h || substr(s, 2)) end) as folded_root
  from placed p join tops t on p.grp = t.grp left join paths on p.r = paths.r)
select doc_id, leaf, subroot, root, sha256(path) as proof_sha256, folded_root, folded_root = root as verified
from folded, (select nodes[1] as root from above where len(nodes) = 1)"""

WARC_SQL = f"""with payloads as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
firsts as (select payload_digest, max(page_id) as first_id from payloads where payload_bytes >= {warc.MIN_REVISIT} group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from payloads left join firsts using (payload_digest)"""

FILL_MIDDLE_SQL = f"""with cut as (select doc_id, coalesce(text, '') as body, sha256('{fill_middle.SEED}:' || coalesce(cast(doc_id as varchar), '')) as d,
  regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as units from documents),
drawn as (select *, len(units) as n, cast('0x' || d[1:8] as bigint) as h1, cast('0x' || d[9:16] as bigint) as h2,
  cast('0x' || d[17:24] as bigint) as h3, cast('0x' || d[25:32] as bigint) as h4 from cut),
formed as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when body = '' or contains(body, '{fill_middle.PREFIX}') or contains(body, '{fill_middle.SUFFIX}') or contains(body, '{fill_middle.MIDDLE}')
    or h3 % 100 >= {fill_middle.FIM_PERCENT} then 'plain' when h4 % 100 < {fill_middle.SPM_PERCENT} then 'spm' else 'psm' end as form from drawn),
parts as (select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from formed)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'psm' then '{fill_middle.PREFIX}' || prefix || '{fill_middle.SUFFIX}' || suffix || '{fill_middle.MIDDLE}' || middle
    when 'spm' then '{fill_middle.SUFFIX}' || suffix || '{fill_middle.PREFIX}' || prefix || '{fill_middle.MIDDLE}' || middle else body end) as output_sha256,
  sha256(body) as restored_sha256
from parts"""
