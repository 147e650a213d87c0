"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

QUALITY = rf"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, list_filter(string_split_regex(text, '{BLANKS}'), lambda x: x <> '') as w from t),
windows as (select r, i, array_to_string(w[i + 1 : i + 5], ' ') as win from w, unnest(range(0, greatest(len(w) - 4, 0))) as u(i)),
doubled as (select r, i from windows qualify count(*) over (partition by r, win) > 1),
covered as (select r, count(distinct i + k) as n from doubled, unnest(range(0, 5)) as v(k) group by r),
lines as (select r, unnest(string_split(text, chr(10))) as line from t),
judged as (select r, line, length(regexp_replace(line, '{BLANKS}', '', 'g')) as inked, length(line) - length(regexp_replace(line, '{SYMBOLS}', '', 'g')) as symbols,
  list_filter(string_split_regex(line, '{BLANKS}'), lambda x: x <> '') as lw from lines),
failed as (select r, line, inked, inked > 0 and (
    regexp_matches(lower(line), 'all rights reserved|licensed under the|released under the|copyright ©|copyright \(c\)|cookie policy|privacy policy|terms of use|terms of service|accept cookies|enable javascript|click here|subscribe to our|sign up for our|powered by')
    or (len(list_filter(lw, lambda x: x in ('|', '>', '>>', '»', '›', '·', '•', '/'))) >= 2 and 5 * len(list_filter(lw, lambda x: x in ('|', '>', '>>', '»', '›', '·', '•', '/'))) >= len(lw))
    or symbols * 10 > inked
    or (len(lw) >= 3 and not regexp_matches(line, '[.!?…。！？]'))) as bad from judged),
by_line as (select r, count(*) filter (inked > 0) - count(distinct line) filter (inked > 0) as dup, coalesce(sum(inked) filter (bad), 0) as lost, sum(inked) as inked from failed group by r),
all_of as (select doc_id, len(w.w) as n_words, inked as word_chars, length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) as n_symbols, dup as n_dup_lines, coalesce(n, 0) as n_repeat_words, lost
  from t join w using (r) join by_line using (r) left join covered using (r))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 2 * lost <= word_chars as kept
from all_of
"""

DECONTAMINATION = r"""
with low as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
d as (select r, doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from low),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
phrases as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i + 1 : i + 10], ' ') as phrase from b, unnest(range(0, greatest(len(w) - 9, 1))) as u(i) where len(w) > 0),
sizes as (select distinct n from phrases),
windows as (select r, n, i, array_to_string(w[i + 1 : i + n], ' ') as phrase from d, sizes, unnest(range(0, greatest(len(w) - n + 1, 0))) as u(i)),
hits as (select r, item_id, i, windows.n from windows join phrases using (n, phrase)),
words as (select r, count(distinct i + k) as n_hit from hits, unnest(range(0, n)) as v(k) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, cast(item_id as varchar) as item from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""


WARC = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from d)
select page_id, payload_bytes, payload_digest, case when first is null or page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from f
"""


REPEATS = """
with t as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (select r, coalesce(doc_id, -9223372036854775808) as d, i, substr(h, 2 * i + 1, 100) as s from t, unnest(range(0, len(h) // 2 - 49)) as u(i)),
hits as (select r, i from windows qualify min(d) over (partition by s) < d),
bytes as (select distinct r, i + k as b from hits, unnest(range(0, 50)) as v(k)),
runs as (select r, b, b - row_number() over (partition by r order by b) as run from bytes),
spans as (select r, min(b) as b, max(b) + 1 as e, row_number() over (partition by r order by min(b)) as k from runs group by r, run),
edges as (select r, k, b, e, lag(e, 1, 0) over (partition by r order by b) as after from spans),
cut as (select r, string_agg(substr(h, 2 * after + 1, 2 * (b - after)), '' order by b) as head, max(e) as e, sum(e - b) as n_removed, count(*) as n_spans from edges join t using (r) group by r)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(e, 0) + 1))) as kept_sha256
from t left join cut using (r)
"""

PHRASES = r"""
with low as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from low),
words as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from words group by lang),
counts as (select lang, k, array_to_string(w[i + 1 : i + k], ' ') as phrase, count(*) as f from words, unnest(range(1, 5)) as v(k), unnest(range(0, len(w) - k + 1)) as u(i) group by all having count(*) >= 30),
cand as (select lang, phrase, k, f as a, string_split(phrase, ' ') as w from counts where k > 1),
cuts as (select c.lang, c.phrase, a, j, l.f as l, r.f as r, cast((2000000::hugeint * a) // (l.f + r.f) as bigint) as score
  from (select *, unnest(range(1, k)) as j from cand) c join counts l on l.lang = c.lang and l.phrase = array_to_string(w[1:j], ' ') join counts r on r.lang = c.lang and r.phrase = array_to_string(w[j + 1 : c.k], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, max(a) as longer from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from cand)) group by all),
ranked as (select best.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best left join inside using (lang, phrase) where longer is null or 100::hugeint * longer < 80::hugeint * a)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": WARC, "op8_decontamination": DECONTAMINATION, "op9_quality_rules": QUALITY, "op11_repeats": REPEATS, "op12_phrases": PHRASES}
