"""DuckDB oracle: the fixture views and one SQL text per registered query.

The oracle database has only the base tables, so each query text carries the
views it needs as ``with`` CTEs (``compose`` adds them in dependency order).
"""

from __future__ import annotations

import math
import re

HEAD = ("((contains(param, 'score') or contains(param, 'classifier') or contains(param, 'classification_head'))"
        " and not contains(param, 'lora_'))")
COMP = (f"(case when contains(param, 'lora_A') then 'lora_A' when contains(param, 'lora_B') then 'lora_B' "
        f"when {HEAD} then 'head' else 'other' end)")
LAYER = r"regexp_replace(param, 'lora_[AB]\.default\.weight$', '')"
TRANSMIT = (f"({HEAD} or (contains(param, 'lora_') and (method = 'standard_lora' "
            "or (method = 'ffa_lora' and contains(param, 'lora_B')) "
            "or (method = 'rolora' and ((round % 2 <> 0 and contains(param, 'lora_B')) "
            "or (round % 2 = 0 and contains(param, 'lora_A')))))))")
ROUND_PAT = r"Round (\d+) - Acc: ([\d.]+), F1: ([\d.]+), Loss: ([\d.]+), Comm: ([\d.]+)MB, Bias: ([\d.]+)"


def md5_key(*parts: str, seed: int = 42) -> str:
    inner = ", ':', ".join(f"cast({p} as varchar)" for p in parts)
    return f"md5(concat('{seed}', ':', {inner}))"


VIEWS: dict[str, str] = {
    "v_examples": """
select doc_id as example_id, text,
       cast(case lang when 'de' then 0 when 'en' then 1 when 'es' then 2 else 3 end as integer) as label
from documents""",
    "v_proportions": """
select cast(label as integer) as label, cast(client_id as integer) as client_id, cast(p1000 as integer) as p1000 from (values
  (0,0,100),(0,1,250),(0,2,50),(0,3,0),(0,4,600),
  (1,0,200),(1,1,200),(1,2,200),(1,3,200),(1,4,200),
  (2,0,700),(2,1,5),(2,2,95),(2,3,100),(2,4,100),
  (3,0,10),(3,1,10),(3,2,10),(3,3,960),(3,4,10)) as t(label, client_id, p1000)""",
    "v_assignment": """
select r.example_id, r.label, b.client_id from (
  select example_id, label, row_number() over (partition by label order by example_id) - 1 as rn,
         count(*) over (partition by label) as n from v_examples) r
join (select label, client_id, p1000,
             sum(p1000) over (partition by label order by client_id) as hi,
             sum(p1000) over (partition by label) as total from v_proportions) b
  on r.label = b.label and r.rn >= ((b.hi - b.p1000) * r.n) // b.total and r.rn < (b.hi * r.n) // b.total""",
    "v_vec": """
select label as client_id, case when label < 4 then 4 else 8 end as rank, rn,
       unnest(range(len(embedding))) as pos, cast(unnest(embedding) as double) as v
from (select label, embedding, row_number() over (partition by label order by vec_id) - 1 as rn from embeddings)""",
    "v_cells": """
select client_id,
       concat('layers.', cast(layer as varchar),
              case when s < rank then '.q_proj.lora_A.default.weight'
                   when s < 2 * rank then '.q_proj.lora_B.default.weight' else '.score.weight' end) as param,
       cast(case when s < rank then s when s < 2 * rank then pos else s - 2 * rank end as integer) as i,
       cast(case when s < rank then pos when s < 2 * rank then s - rank else pos end as integer) as j,
       v
from (select client_id, rank, rn // (2 * rank + 4) as layer, rn % (2 * rank + 4) as s, pos, v from v_vec)""",
    "v_cells_rounds": """
select method, cast(round as integer) as round, client_id, param, i, j,
       v * (1 + cast(round * (client_id + 1) as double) / 100) as v
from (select unnest(range(1, 6)) as round, *
      from (select unnest(['standard_lora', 'ffa_lora', 'rolora']) as method, * from v_cells))""",
    "v_client_meta": """
select label as client_id, case when label < 4 then 4 else 8 end as rank, count(*) as n_samples
from embeddings group by label""",
    "v_param_meta": """
select client_id, param, max(i) + 1 as n_rows, max(j) + 1 as n_cols,
       case when client_id % 2 = 0 then 'float32' else 'float16' end as dtype
from v_cells group by client_id, param""",
    "v_layers": "select distinct source as layer from documents",
    "v_predictions": """
select vec_id as example_id, cast(label % 4 as integer) as label,
       [list_sum([cast(embedding[p + 4 * q] as double) for q in range(len(embedding) // 4)]) for p in [1, 2, 3, 4]] as logits
from embeddings""",
    "v_features": """
select cast(label % 5 as integer) as client_id, vec_id as example_id, cast(label % 4 as integer) as y, embedding as x
from embeddings""",
    "v_round_metrics": """
select case user_id % 3 when 0 then 'standard_lora' when 1 then 'ffa_lora' else 'rolora' end as method,
       cast(case cast(floor(user_id / 3) as integer) % 3 when 0 then 10.0 when 1 then 0.5 else 0.1 end as double) as alpha,
       cast(event_id % 5 + 1 as integer) as round,
       round(avg(cast(case when event_type in ('click', 'view') then 1 else 0 end as double)), 6) as acc,
       round(avg(cast(case when event_type = 'purchase' then 1 else 0 end as double)), 6) as f1,
       round(avg(value), 6) as loss, round(sum(value), 4) as comm_mb,
       round(avg(cast(case when event_type = 'error' then 1 else 0 end as double)), 6) as bias
from events group by 1, 2, 3""",
    "v_run_uploads": """
select case user_id % 3 when 0 then 'standard_lora' when 1 then 'ffa_lora' else 'rolora' end as method,
       cast(case cast(floor(user_id / 3) as integer) % 3 when 0 then 10.0 when 1 then 0.5 else 0.1 end as double) as alpha,
       cast(event_id % 5 + 1 as integer) as round, user_id as client_id
from events where event_type = 'purchase'""",
    "v_final_results": """
select method, alpha, arg_max(acc, round) as final_acc, arg_max(f1, round) as final_f1,
       arg_max(loss, round) as final_loss, max(acc) as best_acc, max(f1) as best_f1,
       sum(comm_mb) as total_comm_mb, avg(bias) as mean_bias
from v_round_metrics group by method, alpha""",
    "v_run_log": """
select cast(user_id % 9 as integer) as run_id, event_id as line_no,
  case event_type
    when 'signup' then concat('Starting Alpha: ', case event_id % 3 when 0 then '10.0' when 1 then '0.5' else '0.1' end)
    when 'view' then concat('--- Method: ', case event_id % 3 when 0 then 'standard_lora' when 1 then 'ffa_lora' else 'rolora' end, ' ---')
    when 'error' then concat('  [DROPOUT] Client ', cast(event_id % 5 as varchar), ' failed to upload updates.')
    else concat('Round ', cast(event_id % 5 + 1 as varchar), ' - Acc: 0.', lpad(cast(event_id % 10000 as varchar), 4, '0'),
                ', F1: 0.', lpad(cast(event_id * 7 % 10000 as varchar), 4, '0'),
                ', Loss: ', case when event_id % 50 = 0 then 'nan' else concat('1.', lpad(cast(event_id * 3 % 10000 as varchar), 4, '0')) end,
                ', Comm: 46.', lpad(cast(event_id % 100 as varchar), 2, '0'), 'MB, Bias: 0.', lpad(cast(event_id % 1000000 as varchar), 6, '0'))
  end as line
from events""",
    "v_log_text": """
select run_id, row_number() over (partition by run_id order by line_no) as line_no, line from v_run_log""",
    "v_uploads": """
select event_id, ts, ts + to_seconds(cast(event_id * 7919 % 90000 as bigint)) as arrival_ts,
       user_id as client_id, cast(user_id % 3 + 1 as integer) as w, value as v
from events""",
    "v_weights": """
select client_id, n_samples, cast(n_samples as double) / sum(n_samples) over () as weight,
       1 / cast(count(*) over () as double) as inv_k
from v_client_meta""",
    "v_label_dist": """
select s.client_id,
       cast(coalesce(c.c0, 0) as bigint) as "World", cast(coalesce(c.c1, 0) as bigint) as "Sports",
       cast(coalesce(c.c2, 0) as bigint) as "Business", cast(coalesce(c.c3, 0) as bigint) as "Sci/Tech"
from (select distinct client_id from v_proportions) s
left join (select client_id, sum(case when label = 0 then 1 else 0 end) as c0,
                  sum(case when label = 1 then 1 else 0 end) as c1,
                  sum(case when label = 2 then 1 else 0 end) as c2,
                  sum(case when label = 3 then 1 else 0 end) as c3
           from v_assignment group by client_id) c on s.client_id = c.client_id""",
    "v_user_days": """
select distinct user_id as client_id, cast(day(ts) as integer) as round from events""",
    "v_cells_c": f"""
select client_id, {LAYER} as layer, {COMP} as comp, i, j, v from v_cells""",
    "v_sampled_layers": """
select layer from (
  select layer, row_number() over (order by layer) - 1 as pos, count(*) over () as n
  from (select layer from v_cells_c where comp in ('lora_A', 'lora_B') group by layer having count(distinct comp) = 2))
where n <= 4 or pos = 0 or pos = floor(1 * (n - 1) / 3) or pos = floor(2 * (n - 1) / 3) or pos = n - 1""",
    "v_cs": """
select * from v_cells_c where layer in (select layer from v_sampled_layers)""",
    "v_cs_all": """
select * from v_cells_c where layer in (
  select layer from v_cells_c where comp in ('lora_A', 'lora_B') group by layer having count(distinct comp) = 2)""",
    "v_rolora_r1": f"""
select client_id, param, i, j, v from v_cells_rounds where method = 'rolora' and round = 1 and {TRANSMIT}""",
    "v_standard_r1": f"""
select client_id, param, i, j, v from v_cells_rounds where method = 'standard_lora' and round = 1 and {TRANSMIT}""",
    "v_participants": f"""
select round, client_id from (
  select round, client_id,
         row_number() over (partition by round order by {md5_key('round', 'client_id')}, client_id) as pick
  from (select client_id, unnest(range(1, 6)) as round from v_client_meta))
where pick <= 3 and not (substr({md5_key('round', 'client_id', seed=43)}, 1, 8) < '33333333')""",
}


def _bias_sql(coef: str, cells: str = "v_cs") -> str:
    return f"""
with ideal as (
  select b.layer, b.i, a.j, sum(b.v * a.v * w.{coef}) as ideal
  from {cells} b join {cells} a on b.client_id = a.client_id and b.layer = a.layer and b.j = a.i
  join v_weights w on w.client_id = b.client_id
  where b.comp = 'lora_B' and a.comp = 'lora_A' group by b.layer, b.i, a.j),
avgc as (
  select layer, comp, i, j, sum(w.weight * v) as v from {cells} join v_weights w using (client_id)
  group by layer, comp, i, j),
fed as (
  select b.layer, b.i, a.j, sum(b.v * a.v) as fed
  from avgc b join avgc a on b.layer = a.layer and b.j = a.i
  where b.comp = 'lora_B' and a.comp = 'lora_A' group by b.layer, b.i, a.j),
d as (
  select coalesce(x.layer, y.layer) as layer, coalesce(x.ideal, 0) as ideal, coalesce(y.fed, 0) as fed
  from ideal x full outer join fed y on x.layer = y.layer and x.i = y.i and x.j = y.j)
select layer, round(sqrt(sum((ideal - fed) * (ideal - fed))) / (sqrt(sum(ideal * ideal)) + 1e-8), 6) as bias
from d group by layer"""


ROUND_BIAS_BODY = f"""
with cr as (
  select method, round, client_id, {LAYER} as layer, {COMP} as comp, i, j, v
  from SOURCE),
ml as (
  select method, round, layer from cr where comp in ('lora_A', 'lora_B')
  group by method, round, layer having count(distinct comp) = 2),
cs as (select cr.* from cr join ml using (method, round, layer)),
ideal as (
  select b.method, b.round, b.layer, b.i, a.j, sum(b.v * a.v * w.inv_k) as ideal
  from cs b join cs a on b.method = a.method and b.round = a.round and b.client_id = a.client_id
    and b.layer = a.layer and b.j = a.i
  join v_weights w on w.client_id = b.client_id
  where b.comp = 'lora_B' and a.comp = 'lora_A' group by b.method, b.round, b.layer, b.i, a.j),
avgc as (
  select method, round, layer, comp, i, j, sum(w.weight * v) as v from cs join v_weights w using (client_id)
  group by method, round, layer, comp, i, j),
fed as (
  select b.method, b.round, b.layer, b.i, a.j, sum(b.v * a.v) as fed
  from avgc b join avgc a on b.method = a.method and b.round = a.round and b.layer = a.layer and b.j = a.i
  where b.comp = 'lora_B' and a.comp = 'lora_A' group by b.method, b.round, b.layer, b.i, a.j),
d as (
  select coalesce(x.method, y.method) as method, coalesce(x.round, y.round) as round,
         coalesce(x.layer, y.layer) as layer, coalesce(x.ideal, 0) as ideal, coalesce(y.fed, 0) as fed
  from ideal x full outer join fed y
    on x.method = y.method and x.round = y.round and x.layer = y.layer and x.i = y.i and x.j = y.j),
pl as (
  select method, round, layer, sqrt(sum((ideal - fed) * (ideal - fed))) / (sqrt(sum(ideal * ideal)) + 1e-8) as bias
  from d group by method, round, layer),
g as (select distinct method, round from cr)
select g.method, g.round, round(coalesce(avg(pl.bias), 0.0), 6) as bias, cast(count(pl.layer) as bigint) as n_layers_measured
from g left join pl using (method, round) group by g.method, g.round"""
ROUND_BIAS_SQL = ROUND_BIAS_BODY.replace("SOURCE", f"v_cells_rounds where {TRANSMIT}")
CARRIED_SQL = f"""
with sent as (
  select method, round, client_id, param, {LAYER} as layer, {COMP} as comp, i, j, v
  from v_cells_rounds where {TRANSMIT}),
avg as (
  select method, round, param, i, j, sum(w.weight * v) as v from sent join v_weights w using (client_id)
  group by method, round, param, i, j),
pr as (select distinct method, round, param from avg),
src as (
  select method, as_of, param, max(round) as src_round
  from (select method, param, round, unnest(range(round, 6)) as as_of from pr)
  group by method, as_of, param),
gstate as (
  select s.method, cast(s.as_of as integer) as round, a.param, a.i, a.j, a.v
  from src s join avg a on a.method = s.method and a.round = s.src_round and a.param = s.param),
sent_names as (select distinct method, round, param from sent),
frozen as (
  select f.method, f.round, f.param, {LAYER.replace('param', 'f.param')} as layer,
         {COMP.replace('param', 'f.param')} as comp, f.i, f.j, f.v
  from gstate f
  where not exists (select 1 from sent_names n where n.method = f.method and n.round = f.round and n.param = f.param)),
names as (
  select method, round, param, 1 as is_sent from sent_names
  union all select distinct method, round, param, 0 as is_sent from frozen),
bl as (
  select method, round, {LAYER} as layer, count(distinct {COMP}) as nf, sum(is_sent) as ns
  from names where contains(param, 'lora_A') or contains(param, 'lora_B') group by method, round, {LAYER}),
measured as (select * from bl where nf = 2 and ns >= 1),
chosen as (select method, round, layer, ns from measured),
s2 as (select s.*, c.ns from sent s join chosen c using (method, round, layer)),
f2 as (select f.method, f.round, f.layer, f.comp, f.i, f.j, f.v from frozen f
       join chosen c on c.method = f.method and c.round = f.round and c.layer = f.layer and c.ns = 1),
ideal_both as (
  select b.method, b.round, b.layer, b.i, a.j, sum(b.v * a.v * w.inv_k) as ideal
  from s2 b join s2 a on b.method = a.method and b.round = a.round and b.client_id = a.client_id
    and b.layer = a.layer and b.j = a.i
  join v_weights w on w.client_id = b.client_id
  where b.ns = 2 and b.comp = 'lora_B' and a.comp = 'lora_A' group by b.method, b.round, b.layer, b.i, a.j),
tc as (
  select method, round, layer, comp, i, j, sum(w.inv_k * v) as v from s2 join v_weights w using (client_id)
  where ns = 1 group by method, round, layer, comp, i, j
  union all select method, round, layer, comp, i, j, v from f2),
ideal_half as (
  select b.method, b.round, b.layer, b.i, a.j, sum(b.v * a.v) as ideal
  from tc b join tc a on b.method = a.method and b.round = a.round and b.layer = a.layer and b.j = a.i
  where b.comp = 'lora_B' and a.comp = 'lora_A' group by b.method, b.round, b.layer, b.i, a.j),
tw as (
  select method, round, layer, comp, i, j, sum(w.weight * v) as v from s2 join v_weights w using (client_id)
  group by method, round, layer, comp, i, j
  union all select method, round, layer, comp, i, j, v from f2),
fed as (
  select b.method, b.round, b.layer, b.i, a.j, sum(b.v * a.v) as fed
  from tw b join tw a on b.method = a.method and b.round = a.round and b.layer = a.layer and b.j = a.i
  where b.comp = 'lora_B' and a.comp = 'lora_A' group by b.method, b.round, b.layer, b.i, a.j),
ideal as (select * from ideal_both union all select * from ideal_half),
d as (
  select coalesce(x.method, y.method) as method, coalesce(x.round, y.round) as round,
         coalesce(x.layer, y.layer) as layer, coalesce(x.ideal, 0) as ideal, coalesce(y.fed, 0) as fed
  from ideal x full outer join fed y
    on x.method = y.method and x.round = y.round and x.layer = y.layer and x.i = y.i and x.j = y.j),
pl as (
  select method, round, layer, sqrt(sum((ideal - fed) * (ideal - fed))) / (sqrt(sum(ideal * ideal)) + 1e-8) as bias
  from d group by method, round, layer),
g as (select distinct method, round from sent)
select g.method, g.round, round(coalesce(avg(pl.bias), 0.0), 6) as bias, cast(count(pl.layer) as bigint) as n_layers_measured
from g left join pl using (method, round) group by g.method, g.round"""


IS_ROUND = " and ".join(
    [f"starts_with(line, 'Round ') and regexp_matches(line, '{ROUND_PAT}')"]
    + [f"try_cast(regexp_extract(line, '{ROUND_PAT}', {k}) as {'integer' if k == 1 else 'double'}) is not null"
       for k in range(1, 7)])


def _parse_log_sql(last_block_only: bool = False, source: str = "v_run_log") -> str:
    pat = ROUND_PAT
    fields = ", ".join(
        [f"try_cast(regexp_extract(line, '{pat}', 1) as integer) as round"]
        + [f"try_cast(regexp_extract(line, '{pat}', {k}) as double) as {n}"
           for k, n in enumerate(["acc", "f1", "loss", "comm_mb", "bias"], start=2)])
    blocks = ""
    keep = ""
    if last_block_only:
        blocks = """,
la as (select run_id, alpha_txt, max(alpha_block) as last_alpha from ctx
       where contains(line, 'Starting Alpha: ') group by run_id, alpha_txt),
lm as (select run_id, alpha_block, method_ctx, max(method_block) as last_method from ctx
       where contains(line, '--- Method: ') and not contains(line, 'Starting Alpha: ')
       group by run_id, alpha_block, method_ctx)"""
        keep = """
  and alpha_block = (select last_alpha from la where la.run_id = ctx.run_id and la.alpha_txt = ctx.alpha_txt)
  and method_block = (select last_method from lm where lm.run_id = ctx.run_id and lm.alpha_block = ctx.alpha_block
                      and lm.method_ctx = ctx.method_ctx)"""
    return f"""
with ctx as (
  select run_id, line_no, line,
    sum(case when contains(line, 'Starting Alpha: ') then 1 else 0 end) over w as alpha_block,
    sum(case when contains(line, '--- Method: ') and not contains(line, 'Starting Alpha: ') then 1 else 0 end)
      over w as method_block,
    last_value(case when contains(line, 'Starting Alpha: ')
                    then trim(regexp_extract(line, 'Starting Alpha: (.*)', 1)) end ignore nulls) over w as alpha_txt,
    last_value(case when contains(line, 'Starting Alpha: ') then ''
                    when contains(line, '--- Method: ')
                    then trim(regexp_replace(trim(regexp_extract(line, '--- Method: (.*)', 1)), '---$', '')) end
               ignore nulls) over w as method_ctx
  from {source}
  window w as (partition by run_id order by line_no rows between unbounded preceding and current row)){blocks}
select run_id, cast(alpha_block as bigint) as alpha_block, alpha_txt, try_cast(alpha_txt as double) as alpha,
       method_ctx as method, line_no, {fields}
from ctx
where {IS_ROUND} and alpha_block > 0
  and method_ctx is not null and method_ctx <> ''{keep}"""


def _stream_log_sql() -> str:
    pat = ROUND_PAT
    fields = ", ".join(
        [f"try_cast(regexp_extract(line, '{pat}', 1) as integer) as round"]
        + [f"try_cast(regexp_extract(line, '{pat}', {k}) as double) as {n}"
           for k, n in enumerate(["acc", "f1", "loss", "comm_mb", "bias"], start=2)])
    return f"""
select run_id, line_no, {fields} from v_run_log
where {IS_ROUND}"""


TOKENIZE_SQL = """
with toks as (select example_id, label, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') as t from v_examples),
vocab as (
  select tok, row_number() over (order by cnt desc, tok) + 1 as id
  from (select tok, count(*) as cnt from (select unnest(t) as tok from toks) group by tok)),
places as (select example_id, unnest(t) as tok, unnest(range(len(t))) as pos from toks),
ids as (select p.example_id, p.pos, v.id from places p join vocab v on p.tok = v.tok),
chunks as (select example_id, label, cast(len(t) as bigint) as n_words,
                  unnest(range(greatest(1, (len(t) + 127) // 128))) as chunk_no from toks),
agg as (select example_id, pos // 128 as chunk_no, count(*) as n, sum(id) as s, arg_min(id, pos) as first_id,
               arg_max(id, pos) as last_id from ids group by example_id, pos // 128)
select c.example_id, c.label as labels, c.n_words, c.chunk_no,
       cast(coalesce(a.n, 0) as bigint) as n_tokens, cast(128 - coalesce(a.n, 0) as bigint) as n_pad,
       cast(coalesce(a.s, 0) as bigint) as sum_ids, a.first_id, a.last_id
from chunks c left join agg a using (example_id, chunk_no)"""


def _uniform_sql(*parts: str, seed: int = 42) -> str:
    inner = ", ':', ".join(p if p.startswith("'") else f"cast({p} as varchar)" for p in parts)
    h = f"substr(md5(concat('{seed}', ':', {inner})), 1, 13)"
    return f"((cast(concat('0x', {h}) as bigint) + 0.5::double) / 4503599627370496.0::double)"


def _gamma_sql(alpha: float, *key: str) -> str:
    """The first accepted of eight attempts, as in the operator."""
    d = (alpha if alpha >= 1 else alpha + 1) - 1 / 3
    c = 1 / math.sqrt(9 * d)
    tries = []
    for k in range(8):
        u1, u2, u3 = (_uniform_sql(f"'{k}{x}'", *key) for x in "abc")
        x = f"(sqrt(-2.0::double * ln({u1})) * cos({2 * math.pi!r}::double * {u2}))"
        v = f"pow(1.0::double + {c!r}::double * {x}, 3)"
        tries.append(f"case when {v} > 0 and ln({u3}) < 0.5::double * {x} * {x} + {d!r}::double - {d!r}::double * {v} "
                     f"+ {d!r}::double * ln(case when {v} > 0 then {v} end) then {d!r}::double * {v} end")
    g = f"coalesce({', '.join(tries)}, {d!r}::double)"
    return g if alpha >= 1 else f"({g} * pow({_uniform_sql(chr(39) + 'boost' + chr(39), *key)}, {1 / alpha!r}::double))"


DIRICHLET_SQL = f"""
with cells as (select label, cast(client_id as integer) as client_id from (
  select label, unnest(range(5)) as client_id from (select distinct label from v_examples))),
g as (select label, client_id, {_gamma_sql(0.5, 'label', 'client_id')} as g from cells)
select label, client_id, round(g / sum(g) over (partition by label), 6) as p from g"""

HASH_SPLIT_SQL = f"""
with b as (select label, client_id, sum(p1000) over (partition by label order by client_id) as hi,
                  sum(p1000) over (partition by label) as total from v_proportions),
e as (select example_id, label, {_uniform_sql("'split'", 'example_id')} as u from v_examples)
select e.example_id, e.label, (select min(b.client_id) from b where b.label = e.label
                               and e.u < cast(b.hi as double) / b.total) as client_id
from e"""


def _fit_sql(steps: int = 2, mu: float = 0.01, rate: float = 0.5) -> str:
    """Full-batch steps unrolled as CTEs: logits, softmax, gradient, new head."""
    sql = """
with r as (select client_id, example_id, y, unnest(range(len(x))) as j, cast(unnest(x) as double) as xj from v_features),
n as (select client_id, count(*) as n from v_features group by client_id),
w0 as (select client_id, class, j, 0.0::double as v from n, (select unnest(range(4)) as class), (select unnest(range(64)) as j))"""
    for t in range(steps + 1):
        sql += f""",
z{t} as (select r.client_id, r.example_id, r.y, w.class, sum(r.xj * w.v) as z from r
        join w{t} w on w.client_id = r.client_id and w.j = r.j group by r.client_id, r.example_id, r.y, w.class),
m{t} as (select client_id, example_id, max(z) as m from z{t} group by client_id, example_id),
s{t} as (select z.client_id, z.example_id, any_value(m.m) + ln(sum(exp(z.z - m.m))) as lse from z{t} z
        join m{t} m using (client_id, example_id) group by z.client_id, z.example_id)"""
        if t < steps:
            sql += f""",
p{t} as (select z.client_id, z.example_id, z.class, exp(z.z - s.lse) - case when z.class = z.y then 1 else 0 end as r
        from z{t} z join s{t} s using (client_id, example_id)),
g{t} as (select p.client_id, p.class, r.j, sum(p.r * r.xj) as g from p{t} p
        join r on r.client_id = p.client_id and r.example_id = p.example_id group by p.client_id, p.class, r.j),
w{t + 1} as (select w.client_id, w.class, w.j, w.v - {rate} * (g.g / n.n + {mu} * w.v) as v from w{t} w
        join g{t} g using (client_id, class, j) join n using (client_id))"""
    return sql + f"""
select n.client_id, n.n as n_rows, round(ln(4.0), 6) as first_loss,
       round((select avg(s.lse - z.z) from s{steps} s join z{steps} z on z.client_id = s.client_id
              and z.example_id = s.example_id and z.class = z.y where s.client_id = n.client_id), 6) as last_loss,
       round((select sum(v * v) from w{steps} w where w.client_id = n.client_id), 6) as norm2
from n"""


def _entry_sql(name: str, k: str, j: str) -> str:
    """An entry of the shared tables of the low-rank fit."""
    h = f"substr(md5(concat('42:{name}:', cast({k} as varchar), ':', cast({j} as varchar))), 1, 8)"
    return f"((cast(concat('0x', {h}) as bigint) / 2147483648.0::double - 1.0::double) * 0.1::double)"


def _table_sql(name: str, n: str) -> str:
    return (f"list_transform(range({n}), lambda k: list_transform(range(64), lambda j: "
            f"{_entry_sql(name, 'k', 'j') if name else '0.0::double'}))")


def _low_rank_sql(steps: int = 3, batches: int = 10, accumulate: int = 4, mu: float = 0.01, rate: float = 0.5) -> str:
    """One epoch of #46 unrolled: tensors as lists of rows, gradients summed place by place."""
    sums = "list_sum(list_transform(range(1, len({n}) + 1), lambda k: {t}))"
    sql = f"""
with o as (select client_id, y, cast(x as double[]) as x, row_number() over (partition by client_id order by {md5_key('example_id')}, example_id) - 1 as pos,
                  count(*) over (partition by client_id) as n from v_features),
m as (select *, (pos * least({batches}, n)) // n as mb, least({batches}, n) - 1 as last from o),
r as (select client_id, y, x, mb // {accumulate} as step, (mb // {accumulate} + 1) * {accumulate} - 1 <= last as whole,
             row_number() over () as id, 1.0::double / count(*) over (partition by client_id, mb) as share from m),
w0 as (select method, cast(round as integer) as round, client_id, rank, a, b, h, a as ga, b as gb, h as gh,
              method = 'standard_lora' or (method = 'rolora' and round % 2 = 0) as ta,
              method in ('standard_lora', 'ffa_lora') or (method = 'rolora' and round % 2 <> 0) as tb, 0.0::double as ls, 0.0::double as seen
       from (select client_id, rank, round, unnest(['standard_lora', 'ffa_lora', 'rolora']) as method,
                    {_table_sql('A', 'rank')} as a, case when round = 2 then {_table_sql('B', 'rank')} else {_table_sql('', 'rank')} end as b,
                    {_table_sql('H', '4')} as h
             from (select distinct client_id, case when client_id < 4 then 4 else 8 end as rank, unnest([1, 2]) as round from v_features)))"""
    for t in range(steps):
        sql += f""",
u{t} as (select w.method, w.round, w.client_id, w.a, w.b, w.h, r.id, r.y, r.x, r.share, r.whole,
                list_transform(w.a, lambda e: list_dot_product(e, r.x)) as u
         from r join w{t} w on w.client_id = r.client_id where r.step = {t}),
h{t} as (select *, list_transform(range(1, 65), lambda j: x[j] + {sums.format(n='u', t='u[k] * b[k][j]')}) as hid from u{t}),
z{t} as (select *, list_transform(h, lambda e: list_dot_product(e, hid)) as z from h{t}),
e{t} as (select *, list_max(z) + ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) as lse from z{t}),
p{t} as (select *, list_transform(z, lambda v, c: exp(v - lse) - case when c = y + 1 then 1 else 0 end) as off, lse - z[y + 1] as loss from e{t}),
q{t} as (select *, list_transform(range(1, 65), lambda j: {sums.format(n='off', t='off[k] * h[k][j]')}) as q from p{t}),
s{t} as (select *, list_transform(b, lambda e: list_dot_product(e, q)) as s from q{t}),
f{t} as (select method, round, client_id, share, unnest(flatten([
           flatten(list_transform(s, lambda e: list_transform(x, lambda v: e * v))),
           flatten(list_transform(u, lambda e: list_transform(q, lambda v: e * v))),
           flatten(list_transform(off, lambda e: list_transform(hid, lambda v: e * v)))])) as g,
           generate_subscripts(flatten([flatten(list_transform(s, lambda e: x)), flatten(list_transform(u, lambda e: q)),
           flatten(list_transform(off, lambda e: hid))]), 1) as place from s{t}),
d{t} as (select method, round, client_id, place, sum(g * share) / {accumulate} as g from f{t} group by method, round, client_id, place),
l{t} as (select method, round, client_id, list(g order by place) as g from d{t} group by method, round, client_id),
c{t} as (select method, round, client_id, sum(loss * share) as ls, round(sum(share)) as mbs from s{t} group by method, round, client_id),
j{t} as (select w.*, l.g, c.ls as lnow, coalesce(c.mbs, 0) as mbs,
           case when ta then list_sum(list_transform(flatten(a), lambda v, i: pow(v - flatten(ga)[i], 2))) else 0 end
           + case when tb then list_sum(list_transform(flatten(b), lambda v, i: pow(v - flatten(gb)[i], 2))) else 0 end
           + list_sum(list_transform(flatten(h), lambda v, i: pow(v - flatten(gh)[i], 2))) as far
         from w{t} w left join l{t} l using (method, round, client_id) left join c{t} c using (method, round, client_id)),
w{t + 1} as (select method, round, client_id, rank,
           case when ta and g is not null then list_transform(a, lambda e, k: list_transform(e, lambda v, j: v - {rate} * (g[(k - 1) * 64 + j] + mbs * {mu / accumulate!r}::double * (v - ga[k][j])))) else a end as a,
           case when tb and g is not null then list_transform(b, lambda e, k: list_transform(e, lambda v, j: v - {rate} * (g[(rank + k - 1) * 64 + j] + mbs * {mu / accumulate!r}::double * (v - gb[k][j])))) else b end as b,
           case when g is not null then list_transform(h, lambda e, k: list_transform(e, lambda v, j: v - {rate} * (g[(2 * rank + k - 1) * 64 + j] + mbs * {mu / accumulate!r}::double * (v - gh[k][j])))) else h end as h,
           ga, gb, gh, ta, tb, ls + coalesce(lnow, 0) + mbs * {mu / 2!r}::double * far as ls, seen + mbs as seen from j{t})"""
    norm = lambda c: f"round(list_sum(list_transform(flatten(w.{c}), lambda v: v * v)), 6) as norm2_{c}"
    return sql + f""",
cl as (select client_id, count(*) as n_rows, cast(max(step) + 1 as integer) as n_steps from r group by client_id)
select w.method, w.round, w.client_id, cl.n_rows, cl.n_steps, round(w.ls / w.seen, 6) as mean_loss, cast(0 as bigint) as n_nan,
       {norm('a')}, {norm('b')}, {norm('h')}
from w{steps} w join cl using (client_id)"""


ROUND_REPORT_SQL = f"""
with sent as (select * from v_cells_rounds where {TRANSMIT}),
up as (select method, round, count(distinct client_id) as n_clients, count(*) as n_sent from sent group by method, round),
wt as (select method, round, client_id, cast(n_samples as double) / sum(n_samples) over (partition by method, round) as weight
       from (select distinct method, round, client_id from sent) join v_client_meta using (client_id)),
av as (select method, round, param, i, j, sum(weight * v) as v from sent join wt using (method, round, client_id)
       group by method, round, param, i, j),
down as (select method, round, count(*) as n_avg from av group by method, round),
hd as (select method, round, i, j, sum(v) as v from av where HEAD group by method, round, i, j),
ho as (select vec_id, cast(label % 4 as integer) as label, unnest(range(len(embedding))) as j, cast(unnest(embedding) as double) as xj
       from embeddings where substr({md5_key('vec_id')}, 1, 8) < '33333333'),
z as (select av.method, av.round, ho.vec_id, ho.label, av.i, sum(av.v * ho.xj) as z from ho
      join hd av on av.j = ho.j group by av.method, av.round, ho.vec_id, ho.label, av.i),
sc as (select method, round, vec_id, label, arg_max(i, z) as pred, max(z) as m from z group by method, round, vec_id, label),
ls as (select z.method, z.round, z.vec_id, sc.label, sc.pred, any_value(sc.m) + ln(sum(exp(z.z - sc.m)))
              - sum(case when z.i = z.label then z.z else 0 end) as loss
       from z join sc using (method, round, vec_id) group by z.method, z.round, z.vec_id, sc.label, sc.pred),
cf as (select method, round, label, pred, count(*) as n from ls group by method, round, label, pred),
cl as (select method, round, label as c from cf union select method, round, pred from cf),
f1 as (select cl.method, cl.round, cl.c,
              coalesce(sum(cf.n) filter (where cf.label = cl.c and cf.pred = cl.c), 0) as tp,
              coalesce(sum(cf.n) filter (where cf.label = cl.c), 0) as nt, coalesce(sum(cf.n) filter (where cf.pred = cl.c), 0) as np
       from cl join cf using (method, round) group by cl.method, cl.round, cl.c),
ev as (select method, round, avg(case when nt + np > 0 then 2.0::double * tp / (nt + np) else 0 end) as macro_f1 from f1 group by method, round),
ac as (select method, round, count(*) as n, avg(case when label = pred then 1.0::double else 0.0 end) as accuracy, avg(loss) as mean_loss
       from ls group by method, round),
rb as (select * from (BIAS) as b)
select up.method, up.round, up.n_clients, round(up.n_sent * 4 / 1048576.0, 6) as upload_mb,
       round(down.n_avg * 4 / 1048576.0, 6) as download_mb, round((up.n_sent + down.n_avg * up.n_clients) * 4 / 1048576.0, 6) as round_mb,
       rb.bias, rb.n_layers_measured, ac.n as n_held_out, round(ac.accuracy, 6) as accuracy, round(ev.macro_f1, 6) as macro_f1,
       round(ac.mean_loss, 6) as mean_loss
from up join down using (method, round) join rb using (method, round) left join ac using (method, round) left join ev using (method, round)
""".replace("BIAS", ROUND_BIAS_SQL.strip()).replace("HEAD", HEAD)

CHECKPOINT_SQL = """
with c as (select method, round, count(*) as n_cells, sum(v) as sum_v from v_cells_rounds group by method, round)
select m.method, m.alpha, m.round, c.n_cells, round(c.sum_v, 6) as sum_v, m.acc, m.f1, m.loss, m.comm_mb, m.bias,
       concat('clients=5;method=', m.method) as config, cast(42 as integer) as seed
from v_round_metrics m join c using (method, round)"""


DROPPED_SQL = r"""
with marks as (
  select run_id, line_no, try_cast(nullif(regexp_extract(line, '^Round (\d+) - ', 1), '') as integer) as round,
         try_cast(nullif(regexp_extract(line, '\[DROPOUT\] Client (\d+) failed to upload updates', 1), '') as integer) as client_id
  from v_run_log
), parts as (
  select *, count(round) over (partition by run_id order by line_no rows between unbounded preceding and current row)
              - case when round is not null then 1 else 0 end as segment
  from marks where round is not null or client_id is not null)
select run_id, max(case when round is not null then line_no end) as line_no, max(round) as round,
       count(distinct client_id) as n_dropped, coalesce(string_agg(distinct cast(client_id as varchar), ',' order by cast(client_id as varchar)), '') as dropped
from parts group by run_id, segment having max(round) is not null"""

STATE_STREAM_SQL = """
with up as (
  select to_timestamp(1704067200 + (round - 1) * 86400 + (client_id * 7919 + round * 104729) % 86400) at time zone 'UTC' as ts,
         (client_id * 37 + round * 53) % 40 * 1800 as delay, round, c.client_id, param, i, j,
         v * (1 + cast(round * (client_id + 1) as double) / 100) as v
  from (select unnest(range(1, 6)) as round, * from v_cells) c),
ok as (select up.*, date_trunc('day', ts) as day, n_samples from up join v_client_meta using (client_id)
       where ts + to_seconds(delay) <= date_trunc('day', ts) + interval 1 day + interval 1 hour),
tot as (select day, count(*) as n_clients, sum(n) as n from (select day, client_id, max(n_samples) as n from ok group by day, client_id)
        group by day)
select strftime(day, '%Y-%m-%d %H:%M:%S') as round_start, any_value(tot.n_clients) as n_clients, param, i, j,
       round(sum(n_samples * v) / any_value(tot.n), 6) as v
from ok join tot using (day) group by day, param, i, j"""


QUERIES: dict[str, str] = {
    "scan_examples": f"""
select example_id, label,
       case when substr({md5_key('example_id')}, 1, 8) < '33333333' then 'test' else 'train' end as split,
       cast(length(text) as bigint) as text_len
from v_examples""",
    "csv_roundtrip": "select * from v_label_dist",
    "parse_run_log": _parse_log_sql(),
    "parse_run_log_last_block": _parse_log_sql(last_block_only=True),
    "run_log_unmatched": """
select run_id, count(*) as n_unmatched from v_run_log
where starts_with(line, 'Round ') and not ({is_round}) group by run_id""".replace("{is_round}", IS_ROUND),
    "parse_run_log_text": _parse_log_sql(source="v_log_text"),
    "checkpoint_roundtrip": CHECKPOINT_SQL,
    "dirichlet_proportions": DIRICHLET_SQL,
    "hash_split": HASH_SPLIT_SQL,
    "local_fit": _fit_sql(),
    "low_rank_fit": _low_rank_sql(),
    "round_report": ROUND_REPORT_SQL,
    "state_roundtrip": """
select client_id, param, i, j, round(v, 6) as v from v_cells_rounds where method = 'rolora' and round = 3""",
    "tokenize_pad": TOKENIZE_SQL,
    "param_component": f"select client_id, param, {COMP} as component from v_param_meta",
    "transmit_filter": f"""
select method, round, param, count(*) as n_cells, round(sum(v), 6) as sum_v
from v_cells_rounds where {TRANSMIT} group by method, round, param""",
    "layer_key": f"select client_id, param, {LAYER} as layer from v_param_meta",
    "element_bytes": """
select client_id, param,
       cast((case when dtype in ('float16', 'bfloat16') then 2 else 4 end) * n_rows * n_cols as bigint) as n_bytes
from v_param_meta""",
    "hash_bernoulli": f"""
select client_id, round from v_user_days
where not (substr({md5_key('round', 'client_id')}, 1, 8) < '33333333')""",
    "cohort_sample": f"""
select round, client_id, pick from (
  select round, client_id,
         row_number() over (partition by round order by {md5_key('round', 'client_id')}, client_id) as pick
  from v_user_days) where pick <= 3""",
    "proportional_split": "select * from v_assignment",
    "cumulative_boundaries": """
select b.label, b.client_id, n.n, cast(((b.hi - b.p1000) * n.n) // b.total as bigint) as lo_pos,
       cast((b.hi * n.n) // b.total as bigint) as hi_pos
from (select label, client_id, p1000, sum(p1000) over (partition by label order by client_id) as hi,
             sum(p1000) over (partition by label) as total from v_proportions) b
join (select label, count(*) as n from v_examples group by label) n on b.label = n.label""",
    "shuffle_within_group": f"""
select example_id, client_id,
       row_number() over (partition by client_id order by {md5_key('example_id')}, example_id) - 1 as pos
from v_assignment""",
    "cap_per_group": f"""
select client_id, example_id from (
  select client_id, example_id,
         row_number() over (partition by client_id order by {md5_key('example_id')}, example_id) as rk
  from v_assignment) where rk <= 300""",
    "label_distribution": "select * from v_label_dist",
    "label_distribution_quality": """
select s.client_id, cast(coalesce(c.c0, 0) as bigint) as low, cast(coalesce(c.c1, 0) as bigint) as high,
       cast(coalesce(c.c2, 0) as bigint) as unlabelled
from (select distinct client_id from v_proportions) s
left join (select a.client_id, sum(case when l.quality = 0 then 1 else 0 end) as c0,
                  sum(case when l.quality = 1 then 1 else 0 end) as c1,
                  sum(case when l.quality is null then 1 else 0 end) as c2
           from v_assignment a left join labels l on l.doc_id = a.example_id group by a.client_id) c
  on s.client_id = c.client_id""",
    "quality_metrics": """
with q as (select a.client_id, l.quality as label, 1 - l.toxic as pred
           from v_assignment a join labels l on l.doc_id = a.example_id),
cls as (select client_id, label as c from q union select client_id, pred from q),
f as (select cls.client_id, cls.c,
             (select count(*) from q where q.client_id = cls.client_id and label = cls.c and pred = cls.c) as tp,
             (select count(*) from q where q.client_id = cls.client_id and label = cls.c) as nt,
             (select count(*) from q where q.client_id = cls.client_id and pred = cls.c) as np
      from cls),
t as (select client_id, count(*) as n, avg(case when label = pred then 1.0 else 0.0 end)::double as acc
      from q group by client_id)
select t.client_id, t.n, (select count(*) from v_assignment a left join labels l on l.doc_id = a.example_id
                          where a.client_id = t.client_id and l.quality is null) as n_unlabelled, round(t.acc, 6) as accuracy,
       round(avg(case when nt + np > 0 then 2.0 * tp / (nt + np) else 0.0 end)::double, 6) as macro_f1,
       count(*) as n_classes
from t join f on f.client_id = t.client_id group by t.client_id, t.n, t.acc""",
    "group_weight": "select client_id, n_samples, round(weight, 6) as weight from v_weights",
    "weighted_padded_average": """
select param, i, j, round(sum(w.weight * c.v), 6) as v from v_cells c join v_weights w using (client_id)
group by param, i, j""",
    "param_max_shape": """
select param, max(n_rows) as n_rows, max(n_cols) as n_cols, count(*) as n_clients from v_param_meta group by param""",
    "state_overlay": """
with g as (select param, i, j, sum(w.weight * c.v) as v from v_rolora_r1 c join v_weights w using (client_id)
           group by param, i, j)
select l.client_id, l.param, l.i, l.j, round(coalesce(g.v, l.v), 6) as v
from v_cells l left join g on l.param = g.param and l.i = g.i and l.j = g.j""",
    "key_presence_filter": f"""
select client_id, param, count(*) as n_cells, round(sum(v), 6) as sum_v from v_cells_rounds
where method = 'standard_lora' and round = 2 and {TRANSMIT}
  and param in (select param from v_rolora_r1)
group by client_id, param""",
    "matrix_product": """
select b.client_id, b.layer, b.i, a.j, round(sum(b.v * a.v), 6) as w
from v_cells_c b join v_cells_c a on b.client_id = a.client_id and b.layer = a.layer and b.j = a.i
where b.comp = 'lora_B' and a.comp = 'lora_A' group by b.client_id, b.layer, b.i, a.j""",
    "mean_product": """
select b.layer, b.i, a.j, round(sum(b.v * a.v * w.inv_k), 6) as w
from v_cells_c b join v_cells_c a on b.client_id = a.client_id and b.layer = a.layer and b.j = a.i
join v_weights w on w.client_id = b.client_id
where b.comp = 'lora_B' and a.comp = 'lora_A' group by b.layer, b.i, a.j""",
    "aggregation_bias": _bias_sql("inv_k", "v_cs_all"),
    "aggregation_bias_weighted": _bias_sql("weight", "v_cs_all"),
    "aggregation_bias_sampled": _bias_sql("inv_k"),
    "round_bias": ROUND_BIAS_SQL,
    "round_bias_carry_frozen": CARRIED_SQL,
    "even_layer_sample": """
select layer, pos from (
  select layer, row_number() over (order by layer) - 1 as pos, count(*) over () as n from v_layers)
where n <= 4 or pos = 0 or pos = floor(1 * (n - 1) / 3) or pos = floor(2 * (n - 1) / 3) or pos = n - 1""",
    "communication_cost": f"""
select client_id,
  round(sum(nb) / 1048576.0, 6) as total_mb,
  round(sum(case when comp = 'lora_A' then nb else 0 end) / 1048576.0, 6) as lora_a_mb,
  round(sum(case when comp = 'lora_B' then nb else 0 end) / 1048576.0, 6) as lora_b_mb,
  round(sum(case when comp = 'head' then nb else 0 end) / 1048576.0, 6) as head_mb,
  cast(sum(n_rows * n_cols) as bigint) as n_values
from (select client_id, {COMP} as comp, n_rows, n_cols,
             (case when dtype in ('float16', 'bfloat16') then 2 else 4 end) * n_rows * n_cols as nb
      from v_param_meta) group by client_id""",
    "round_communication": f"""
with sent as (
  select p.round, p.method, pm.client_id, pm.param, pm.n_rows, pm.n_cols, pm.dtype, {COMP.replace('param', 'pm.param')} as comp
  from (select round, client_id, unnest(['standard_lora', 'ffa_lora', 'rolora']) as method from v_participants) p
  join v_param_meta pm on pm.client_id = p.client_id),
sent_t as (select * from sent where {TRANSMIT}),
up as (
  select method, round, count(distinct client_id) as n_clients,
         sum((case when dtype in ('float16', 'bfloat16') then 2 else 4 end) * n_rows * n_cols) / 1048576.0 as upload_mb
  from sent_t group by method, round),
shape as (
  select method, round, param, any_value(comp) as comp, max(n_rows) * max(n_cols) * 4 as nb
  from sent_t group by method, round, param),
down as (
  select method, round, sum(nb) / 1048576.0 as download_mb,
         sum(case when comp = 'lora_A' then nb else 0 end) / 1048576.0 as lora_a_mb,
         sum(case when comp = 'lora_B' then nb else 0 end) / 1048576.0 as lora_b_mb,
         sum(case when comp = 'head' then nb else 0 end) / 1048576.0 as head_mb
  from shape group by method, round)
select method, cast(round as integer) as round, n_clients, round(upload_mb, 6) as upload_mb,
       round(download_mb, 6) as download_mb, round(upload_mb + download_mb * n_clients, 6) as round_mb,
       round(lora_a_mb, 6) as lora_a_mb, round(lora_b_mb, 6) as lora_b_mb, round(head_mb, 6) as head_mb
from up join down using (method, round)""",
    "cumulative_communication": """
select method, alpha, round, comm_mb,
       round(sum(comm_mb) over (partition by method, alpha order by round rows between unbounded preceding and current row), 4)
         as cumulative_mb
from v_round_metrics""",
    "score_argmax_loss": """
select example_id, label, cast(list_position(logits, list_max(logits)) - 1 as integer) as pred,
       round(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
             - logits[label + 1], 6) as loss
from v_predictions""",
    "classification_metrics": """
with s as (
  select label, cast(list_position(logits, list_max(logits)) - 1 as integer) as pred,
         list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) - logits[label + 1] as loss
  from v_predictions),
cls as (select label as c from s union select pred from s),
f as (
  select c, (select count(*) from s where label = c and pred = c) as tp,
         (select count(*) from s where label = c) as nt, (select count(*) from s where pred = c) as np from cls)
select (select count(*) from s) as n,
       round((select avg(case when label = pred then 1.0 else 0.0 end) from s)::double, 6) as accuracy,
       round(avg(case when nt + np > 0 then 2.0 * tp / (nt + np) else 0.0 end)::double, 6) as macro_f1,
       count(*) as n_classes,
       round((select avg(loss) from s), 6) as mean_loss
from f""",
    "run_summary": """
select method, alpha, final_acc, final_f1, final_loss, best_acc, best_f1,
       round(total_comm_mb, 4) as total_comm_mb, round(mean_bias, 6) as mean_bias from v_final_results""",
    "accuracy_matrix": """
select alpha, max(case when method = 'standard_lora' then final_acc end) as standard_lora,
       max(case when method = 'ffa_lora' then final_acc end) as ffa_lora,
       max(case when method = 'rolora' then final_acc end) as rolora
from v_final_results group by alpha order by alpha desc""",
    "efficiency_frontier": """
with f as (select method, alpha, round(total_comm_mb, 4) as total_comm_mb, final_acc from v_final_results)
select method, alpha, total_comm_mb, final_acc,
       not exists (select 1 from f o where o.total_comm_mb <= f.total_comm_mb and o.final_acc >= f.final_acc
                   and (o.total_comm_mb < f.total_comm_mb or o.final_acc > f.final_acc)) as on_frontier
from f""",
    "convergence_curves": """
select alpha, method, round, acc,
       round(acc - lag(acc) over (partition by method, alpha order by round), 6) as delta_acc
from v_round_metrics""",
    "comm_totals": """
select method, round(sum(comm_mb), 4) as total_comm_mb from v_round_metrics where alpha = 10.0 group by method""",
    "bias_curves": "select method, round, bias from v_round_metrics where alpha = 10.0",
    "comm_saving": """
with t as (select method, alpha, sum(comm_mb) as total_comm_mb, avg(comm_mb) as mean_round_mb
           from v_round_metrics group by method, alpha)
select t.method, t.alpha, round(t.total_comm_mb, 4) as total_comm_mb, round(t.mean_round_mb, 6) as mean_round_mb,
       round(100.0 * (1.0 - t.total_comm_mb / b.total_comm_mb), 6) as saving_pct
from t left join (select alpha, total_comm_mb from t where method = 'standard_lora') b on t.alpha = b.alpha""",
    "degradation_report": """
with pm as (
  select method, arg_max(final_acc, alpha) as acc_high_alpha, arg_min(final_acc, alpha) as acc_low_alpha,
         min(alpha) as low_alpha
  from v_final_results group by method),
up as (select method, alpha, round, count(distinct client_id) as n from v_run_uploads group by method, alpha, round),
low as (
  select r.method, stddev_samp(r.acc) as acc_std_low_alpha, count(*) as n_rounds_low_alpha,
         cast(sum(coalesce(up.n, 0)) as bigint) as n_uploads, cast(min(coalesce(up.n, 0)) as bigint) as min_uploads,
         cast(count(*) filter (where up.n is null) as bigint) as n_rounds_without
  from v_round_metrics r join pm on r.method = pm.method and r.alpha = pm.low_alpha left join up on up.method = r.method and up.alpha = r.alpha and up.round = r.round
  group by r.method)
select pm.method, round(100.0 * (acc_low_alpha - acc_high_alpha), 6) as degradation_pts,
       round(acc_std_low_alpha, 6) as acc_std_low_alpha, n_rounds_low_alpha, n_uploads, min_uploads, n_rounds_without
from pm join low using (method)""",
    "run_comparison": """
select a.method, a.final_acc as final_acc_a, b.final_acc as final_acc_b, round(b.final_acc - a.final_acc, 6) as diff
from (select * from v_final_results where alpha = 10.0) a
join (select * from v_final_results where alpha = 0.1) b using (method)""",
    "proximal_penalty": """
with g as (select param, i, j, sum(w.weight * c.v) as v from v_standard_r1 c join v_weights w using (client_id)
           group by param, i, j)
select l.client_id, round(0.01 / 2 * sum((l.v - coalesce(g.v, 0)) * (l.v - coalesce(g.v, 0))), 6) as penalty
from v_cells l left join g on l.param = g.param and l.i = g.i and l.j = g.j
where l.param in (select param from g)
group by l.client_id""",
    "local_gradient": """
with r as (select client_id, example_id, y, unnest(range(len(x))) as j, cast(unnest(x) as double) as xj
           from v_features),
rc as (select *, unnest(range(4)) as class from r),
n as (select client_id, count(*) as n from v_features group by client_id)
select rc.client_id, cast(rc.class as integer) as class, cast(rc.j as integer) as j,
       round(sum((0.25 - case when rc.y = rc.class then 1 else 0 end) * rc.xj) / any_value(n.n), 6) as grad
from rc join n on n.client_id = rc.client_id
group by rc.client_id, rc.class, rc.j""",
    "stream_log_rounds": _stream_log_sql(),
    "stream_log_with_context": _parse_log_sql(),
    "dropped_clients": DROPPED_SQL,
    "stream_dropped_clients": DROPPED_SQL,
    "stream_state_average": STATE_STREAM_SQL,
    "stream_round_average": """
select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d %H:%M:%S') as round_start, count(*) as n,
       cast(sum(w) as bigint) as sum_w, round(sum(w * v), 6) as sum_wv, round(sum(w * v) / sum(w), 6) as avg_v
from v_uploads
where arrival_ts <= time_bucket(interval 1 day, ts) + interval 1 day + interval 1 hour
group by 1""",
}


# The same results from another form of the state.
for _same, _of in (("blocked_average", "weighted_padded_average"), ("blocked_overlay", "state_overlay"),
                   ("blocked_presence", "key_presence_filter"), ("blocked_max_shape", "param_max_shape"),
                   ("aggregation_bias_gram", "aggregation_bias")):
    QUERIES[_same] = QUERIES[_of]


def _deps(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def compose(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it uses (transitively), as CTEs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in _deps(VIEWS[name]):
            if d != name:
                visit(d)
        order.append(name)

    for v in _deps(sql):
        visit(v)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{v} as ({VIEWS[v].strip()})" for v in order)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def _no_negative_zero(sql: str) -> str:
    """A rounded tiny negative is -0.0 in DuckDB and 0.0 in Spark; adding 0 gives +0.0."""
    return re.sub(r", ([46])\) as (?!(?:double|integer|bigint|varchar)\b)", r", \1) + 0 as ", sql)


def oracle_queries() -> dict[str, str]:
    return {k: compose(_no_negative_zero(v)) for k, v in QUERIES.items()}
