"""The dataset manifest in SQL: every level of both trees is a table of its own."""

from __future__ import annotations

#: Levels that the SQL spells out: 3 ** 20 documents of a source, 3 ** 12 sources.
LEAF_LEVELS, GROUP_LEVELS = 20, 12


def _said(x: str) -> str:
    return f"coalesce(strlen({x}) || ':' || {x}, '-')"


def _leaf(text: str) -> str:
    cells = [f"cast({c} as varchar)" for c in ("doc_id", "source", "lang", "n_chars")]
    return "sha256(" + " || ".join(_said(c) for c in (*cells, text)) + ")"


def _climb(name: str, levels: int) -> str:
    """From nodes ``{name}0`` (g, pos, n, h) and walkers ``{name}w0`` to ``{name}{levels}`` and ``{name}w{levels}``."""
    parts = []
    for i in range(levels):
        parts.append(f"""{name}s{i} as materialized (
  select a.g, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as lft,
    coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as rgt
  from {name}{i} a join {name}{i} b on a.g = b.g and a.pos // 3 = b.pos // 3 where a.n > 1 group by a.g, a.pos),
{name}w{i + 1} as materialized (
  select w.k, w.g, w.pos // 3 as pos, case when s.g is null then folded else sha256(lft || folded || rgt) end as folded,
    case when s.g is null then proof else proof || lft || rgt end as proof
  from {name}w{i} w left join {name}s{i} s on s.g = w.g and s.pos = w.pos),
{name}{i + 1} as materialized (
  select g, pos // 3 as pos, (any_value(n) + 2) // 3 as n,
    case when any_value(n) > 1 then sha256(string_agg(h, '' order by pos)) else any_value(h) end as h
  from {name}{i} group by g, pos // 3)""")
    return ",\n".join(parts)


_ROUND = "case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end"

SQL = f"""
with recursive rounds(b, i, c) as (
  select range, 0, range from range(256) union all select b, i + 1, {_ROUND} from rounds where i < 8),
crc as (select list(c order by b) as steps from rounds where i = 8),
docs as (
  select *, xor(list_reduce(list_prepend(cast(4294967295 as bigint),
      list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda c, b: xor(c // 256, steps[xor(c, b) % 256 + 1])), 4294967295) % 2 = 0 as hit from documents, crc),
leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf, folded) - 1 as pos,
    count(*) over (partition by source) as n, dense_rank() over (order by source nulls first) - 1 as g,
    row_number() over () as k
  from (select doc_id, source, {_leaf('text')} as leaf,
    case when hit then {_leaf("replace(text, chr(10), '')")} else {_leaf('text')} end as folded from docs)),
d0 as materialized (select g, pos, n, leaf as h from leaves),
dw0 as (select k, g, pos, folded, '' as proof from leaves),
{_climb('d', LEAF_LEVELS)},
t0 as materialized (select 0 as g, g as pos, count(*) over () as n, h from d{LEAF_LEVELS}),
tw0 as (select k, 0 as g, g as pos, folded, proof from dw{LEAF_LEVELS}),
{_climb('t', GROUP_LEVELS)}
select doc_id, leaf, s.h as subroot, r.h as root, sha256(proof) as proof_sha256, w.folded as folded_root, w.folded = r.h as verified
from leaves join tw{GROUP_LEVELS} w using (k) join d{LEAF_LEVELS} s on s.g = leaves.g cross join t{GROUP_LEVELS} r
"""
