"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

WARC = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages
), b as (
  select *, min(page_id) over (partition by sha) as first,
    array_to_string(list_transform(string_split(sha, ''), lambda d: substr('0000000100100011010001010110011110001001101010111100110111101111',
      4 * (strpos('0123456789abcdef', d) - 1) + 1, 4)), '') as bits
  from p
)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * cast(substr(bits, 5 * i + 1, 1) as int) + 8 * cast(substr(bits, 5 * i + 2, 1) as int) + 4 * cast(substr(bits, 5 * i + 3, 1) as int)
    + 2 * cast(substr(bits, 5 * i + 4, 1) as int) + cast(substr(bits, 5 * i + 5, 1) as int), 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from b
"""

MIXING = """
with recursive d as (
  select doc_id, source, n_chars, greatest(coalesce(n_chars, 0), 0) as mass, md5('mix42:' || doc_id) as key from documents
), blocks as (
  select *, (sum(mass) over (partition by source order by key rows unbounded preceding) - mass) // 65536 as block from d
), w as (
  select source, sqrt(sum(mass)) as weight from d group by source
), n as (
  select *, count(*) over () as n, sum(weight) over () as total from w
), share as (
  select *, round(weight / total * (2000 - n), 9) as exact, floor(round(weight / total * (2000 - n), 9)) as whole from n
), ranked as (
  select *, row_number() over (order by round(exact - whole, 9) desc, source) as r, 2000 - n - sum(whole) over () as spare from share
), q as (
  select source, cast(1 + whole + (case when r <= spare then 1 else 0 end) as bigint) as quota from ranked
), s as (
  select list(quota order by source) as quotas, list(source order by source) as sources, count(*) as n from q
), edf as (
  select -1 as slot, list_transform(quotas, lambda x: 0::bigint) as had, null::bigint as pick, quotas, n from s
  union all
  select slot + 1, list_transform(range(1, n + 1), lambda i: had[i] + (case when i = chosen then 1 else 0 end)), chosen, quotas, n
  from (
    select *, list_min(list_filter(list_transform(range(1, n + 1),
      lambda i: case when had[i] < quotas[i] and had[i] * 2000 // quotas[i] <= slot + 1
        then ((had[i] + 1) * 2000 + quotas[i] - 1) // quotas[i] * 100000 + i end), lambda x: x is not null)) % 100000 as chosen
    from edf where slot < 1999
  )
), plan as (
  select slot as at, s.sources[pick] as source, row_number() over (partition by pick order by slot) - 1 as turn from edf, s where slot >= 0
), placed as (
  select b.*, b.block // q.quota * 2000 + plan.at as slot
  from blocks b join q on b.source = q.source join plan on plan.source = b.source and plan.turn = b.block % q.quota
)
select doc_id, source, n_chars, cast(block as bigint) as block, cast(slot as bigint) as slot,
  row_number() over (order by slot, key) as position
from placed
"""

#: Every repeated window marks the words it covers; lines are judged by the same rules as in ``lines``.
LINES = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), w as (
  select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, string_split(text, chr(10)) as lines from d
), windows as (
  select rid, unnest(range(0, len(words) - 7)) as pos, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) as run
  from w where len(words) >= 8
), twice as (
  select rid, pos from windows qualify count(*) over (partition by rid, run) > 1
), covered as (
  select rid, count(distinct pos + k) as n from twice, range(0, 8) as s(k) group by rid
), line as (
  select rid, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as pos from w
), bare as (
  select rid, line, pos, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as x from line
), judged as (
  select rid, line, pos, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n,
    len(regexp_extract_all(x, '[|>»›·•/]([\x20\x09-\x0D]|$)')) as parts,
    len(regexp_extract_all(x, '[!?#*$%&~=+_-]{2,}([\x20\x09-\x0D]|$)')) as marks,
    not regexp_matches(right(x, 2), '[.!?:;,…。！？]["''»”’)\]]?$') as open_end,
    length(x) <= 200 and regexp_matches(' ' || lower(x), '[\x20\x09-\x0D(](a(ll rights reserved|lle rechte vorbehalten)|c(opyright|ookies?|lick here)|datenschutzerkl|impressum|javascript'
      || '|l(icen[cs]ed under|orem ipsum)|mentions légales|newsletter|pol[ií]tica de privacidad|privacy policy|released under'
      || '|s(ign (in|up)|ubscribe to)|t(erms of (use|service)|ous droits réservés|odos los derechos))([^0-9A-Za-z_]|$)') as notice
  from bare
), per as (
  select rid, count(*) - count(distinct line) as n_dup,
    sum(case when (parts > 0 and parts * 100 >= n * 20) or (marks > 0 and marks * 100 >= n * 20) or (open_end and n < 8) or notice then n else 0 end) as lost
  from judged where n > 0 group by rid
), counted as (
  select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup, 0) as n_dup_lines,
    coalesce(covered.n, 0) as n_repeat_words, coalesce(lost, 0) as lost_words
  from w left join per using (rid) left join covered using (rid)
), based as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counted
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and lost_words * 100 <= n_words * 50 as kept, cast(lost_words as bigint) as lost_words
from based
"""

#: All scores of the anchors, plainly.
NEGATIVES = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as own, cast(list_inner_product(a.v, b.v) as bigint) as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positive as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where own
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as int) as rank,
  other_id as negative_id, positive_score, score as negative_score
from positive join scored using (anchor_id)
where not own and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other_id) <= 10
"""
