"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op5_mix_sources"] = r"""
with recursive sized as (
  select doc_id, source, md5(coalesce(text, '')) as digest,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents
), totals as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), weighed as (
  select source, source_size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight
  from totals
), whole as (select sum(source_size) as n, sum(weight) as w from weighed),
level(turn, stopped, words) as (
  select 0, cast(-1 as bigint), cast(0.0 as double)
  union all
  select l.turn + 1, s.stopped,
         (1.5 * cast((select n from whole) as double) - 2.0 * cast(s.full_size as double)) / cast(s.open_weight as double)
  from level l, lateral (
    select count(*) filter (where 2.0 * source_size <= weight * l.words) as stopped,
           coalesce(sum(source_size) filter (where 2.0 * source_size <= weight * l.words), 0) as full_size,
           sum(weight) filter (where not (2.0 * source_size <= weight * l.words)) as open_weight
    from weighed) s
  where s.stopped <> l.stopped and s.open_weight > 0 and l.turn < 1000
), last as (select words from level order by turn desc limit 1),
targets as (
  select source, source_size,
         case when 2.0 * source_size <= weight * words then 2.0 * source_size else weight * words end as target
  from weighed, last
), rated as (
  select d.doc_id, d.source, d.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
         cast('0x' || substr(md5('mix:' || coalesce(cast(d.doc_id as varchar), 'null') || ':' || coalesce(d.source, 'null') || ':' || d.digest), 1, 13) as bigint)
           / 4503599627370496.0::double as u
  from sized d join targets t on d.source is not distinct from t.source
), taken as (
  select doc_id, source, size, source_size, cast(target as double) as target,
         cast(floor(rate) as bigint) + cast(u < rate - floor(rate) as bigint) as copies
  from rated)
select doc_id, source, size, source_size, target, copies, cast(size * copies as bigint) as taken from taken
"""

_CLOSURE = """
reach(node, other) as (
  select node, node from nodes
  union
  select r.node, e.b from reach r join edges e on e.a = r.other
), parts as (select node, min(other) as component_id from reach group by node)
"""

ORACLE["op8_rp_forest"] = f"""
with recursive v as (
  select vec_id, cast(embedding as double[]) as x,
         embedding is not null and len(embedding) > 0
           and coalesce(list_bool_and(list_transform(embedding, lambda e: e is not null and isfinite(e))), false)
           and coalesce(list_bool_or(list_transform(embedding, lambda e: e <> 0)), false) as ok
  from embeddings
), u as (select vec_id, x, sqrt(list_inner_product(x, x)) as norm from v where ok and vec_id is not null),
edges as (
  select p.vec_id as a, q.vec_id as b from u p join u q on p.vec_id <> q.vec_id and len(p.x) = len(q.x)
  where list_inner_product(p.x, q.x) / (p.norm * q.norm) >= 0.9
), nodes as (select vec_id as node from v where vec_id is not null),
{_CLOSURE.strip()}
select v.vec_id, cast((select count(*) from edges e where e.a = v.vec_id) as bigint) as n_links,
       cast(p.component_id as bigint) as component_id, coalesce(v.vec_id = p.component_id, false) as kept
from v left join parts p on p.node = v.vec_id
"""

ORACLE["op9_jaccard_join"] = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select distinct doc_id, concat_ws(' ', w[i], w[i + 1], w[i + 2]) as s
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)
  union all
  select doc_id, array_to_string(w, ' ') from w where len(w) in (1, 2)
), n as (select doc_id, count(*) as n from s group by doc_id),
edges as (
  select p.doc_id as a, q.doc_id as b
  from s p join s q on p.s = q.s and p.doc_id <> q.doc_id join n x on x.doc_id = p.doc_id join n y on y.doc_id = q.doc_id
  group by p.doc_id, q.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))
), nodes as (select doc_id as node from documents),
{_CLOSURE.strip()}
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, cast(p.component_id as bigint) as component_id
from documents d left join n using (doc_id) left join parts p on p.node = d.doc_id
"""

#: CRC-32 of a list of byte values: eight shifts a byte.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, {bytes}),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
#: Byte values of a text.
_BYTES = """list_transform(range(octet_length(encode({text}))), lambda p: cast('0x' || substr(hex(encode({text})), 2 * p + 1, 2) as bigint))"""


def _crc32(text: str) -> str:
    return _CRC32.format(bytes=_BYTES.format(text=text))


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


_LEAF = "sha256(" + " || ".join(_field(f) for f in (
    "cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)")) + " || {text})"

_FOLDED = "sha256(array_to_string(list_transform(r.hs, lambda x, i: case when i = w.pos % 3 + 1 then w.folded else x end), ''))"
_BESIDE = "w.proof || array_to_string(list_filter(r.hs, lambda x, i: i <> w.pos % 3 + 1), '')"

ORACLE["op11_merkle_manifest"] = f"""
with recursive d as (
  select doc_id, source, {_LEAF.format(text=_field("text"))} as leaf,
         case when {_crc32("cast(doc_id as varchar)")} % 2 = 0 then {_LEAF.format(text=_field("replace(text, chr(10), '')"))} end as tampered
  from documents
), placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
         dense_rank() over (order by source nulls first) - 1 as tree, count(*) over (partition by source) as n from d
), up(tree, lvl, pos, n, h) as (
  select tree, 0, pos, n, leaf from placed
  union all
  select tree, lvl + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' order by pos)) from up where n > 1
  group by tree, lvl, pos // 3
), subroots as (select tree, h as subroot from up where n = 1),
top(lvl, pos, n, h) as (
  select 0, tree, (select count(*) from subroots), subroot from subroots
  union all
  select lvl + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' order by pos)) from top where n > 1
  group by lvl, pos // 3
), runs as (
  select tree, lvl, pos // 3 as run, list(h order by pos) as hs from up where n > 1 group by tree, lvl, pos // 3
  union all
  select -1, lvl, pos // 3, list(h order by pos) from top where n > 1 group by lvl, pos // 3
), numbered as (select *, row_number() over () as id from placed),
way(id, tree, lvl, pos, folded, proof) as (
  select id, tree, 0, pos, coalesce(tampered, leaf), '' from numbered
  union all
  select w.id, w.tree, w.lvl + 1, w.pos // 3, {_FOLDED}, {_BESIDE} from way w join runs r using (tree, lvl)
  where r.run = w.pos // 3
), ends as (select id, tree, arg_max(folded, lvl) as folded, arg_max(proof, lvl) as proof from way group by id, tree),
rise(id, lvl, pos, folded, proof) as (
  select id, 0, tree, folded, proof from ends
  union all
  select w.id, w.lvl + 1, w.pos // 3, {_FOLDED}, {_BESIDE} from rise w join runs r using (lvl)
  where r.tree = -1 and r.run = w.pos // 3
), last as (select id, arg_max(folded, lvl) as folded, arg_max(proof, lvl) as proof from rise group by id),
whole as (select h as root from top where n = 1)
select l.doc_id, l.leaf, s.subroot, (select root from whole) as root, sha256(w.proof) as proof_sha256,
       w.folded as folded_root, w.folded = (select root from whole) as verified
from numbered l join last w using (id) join subroots s using (tree)
"""

ORACLE["op12_spelling_variants"] = rf"""
with recursive runs as (
  select doc_id, run, count(*) as n from (
    select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents)
  where length(run) >= 6 group by doc_id, run
), hashed as (select run, n, {_crc32("(cast(doc_id as varchar) || ':' || run)")} as h from runs),
cut as (
  select case when h % 199 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2)
              else run end as word, n from hashed
), v as (select word, cast(sum(n) as bigint) as n from cut where length(word) >= 6 group by word having sum(n) >= 5),
gaps as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
         from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
pairs as (
  select a.word, a.n, b.word as other, b.n as other_n from gaps a join gaps b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, a.n, b.word, b.n from gaps a join v b on a.rest = b.word
  union select b.word, b.n, a.word, a.n from gaps a join v b on a.rest = b.word
), ranked as (
  select word, n, other, other_n, count(*) over (partition by word) as n_near,
         row_number() over (partition by word order by other_n desc, encode(other)) as place from pairs
), best as (select word, n_near, case when other_n >= 5 * n then other end as form,
                   case when other_n >= 5 * n then other_n end as form_n from ranked where place = 1),
way(word, here, steps) as (
  select word, word, 0 from v
  union all
  select w.word, b.form, w.steps + 1 from way w join best b on b.word = w.here where b.form is not null
), roots as (select word, arg_max(here, steps) as root from way group by word)
select v.word, b.form, r.root, v.n, cast(coalesce(b.n_near, 0) as bigint) as n_near, b.form_n
from v left join best b using (word) join roots r using (word)
"""
