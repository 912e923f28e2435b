"""SQL for the queries of this subpackage that DuckDB can express."""

from __future__ import annotations

_KEY = r"nullif(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '')"

P1_FOUND = f"""
with recursive tied as (
  select distinct sample_group_id as g, {_KEY.format("provenance.alignment_key")} as k
  from encoded_samples where sample_group_id is not null and provenance.alignment_key is not null
), next_to as (
  select distinct a.k as a, b.k as b from tied a join tied b using (g) where a.k is not null and b.k is not null
), shown as (
  select {_KEY.format("alignment_key")} as k, {_KEY.format("split")} as s from locale_records
), keys as (
  select k from shown where k is not null union select k from tied where k is not null
), reach as (
  select k, k as r from keys union select reach.k, next_to.b from reach join next_to on reach.r = next_to.a
), labelled as (
  select k, min(r) as c from reach group by k
), wrong as (
  select c from labelled join shown using (k) where s is not null
  group by c having count(distinct case when s in ('valid', 'validation') then 'dev' else s end) > 1
)
select k as alignment_key, c as component_key from labelled where c in (select c from wrong)
"""

P10_FOUND = """
with windows as (
  select distinct doc_id, hash(substr(text, i, 200)) as h, substr(text, i, 200) as w
  from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200)
)
select distinct a.doc_id as left_doc_id, b.doc_id as right_doc_id
from windows a join windows b on a.h = b.h and a.w = b.w and a.doc_id < b.doc_id
"""

P10_SHARES = """
with windows as (
  select doc_id, i, hash(substr(text, i, 200)) as h, substr(text, i, 200) as w
  from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200)
), held as (select h, w from windows group by h, w having count(distinct doc_id) > 1),
marked as (select distinct doc_id, i from windows join held using (h, w)),
parts as (select doc_id, least(200, coalesce(lead(i) over (partition by doc_id order by i) - i, 200)) as n from marked),
sums as (select doc_id, sum(n)::bigint as n from parts group by doc_id)
select doc_id, coalesce(length(text), 0) as characters, coalesce(n, 0) as shared, coalesce(n, 0) / nullif(length(text), 0) as share
from documents left join sums using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p10_found": P10_FOUND, "p10_shares": P10_SHARES}
