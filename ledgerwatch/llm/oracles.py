"""The same results in DuckDB SQL, where SQL can say them."""

from __future__ import annotations

CHAT = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
shown as (
  select *,
    length('<|im_start|>') + length('<|im_end|>') + 2 + case
      when contains(text, '<|im_start|>') or contains(text, '<|im_end|>')
        or regexp_matches(text, '<\\+\|') or regexp_matches(role, '\n|%25|%3C|%7C|%0A')
        or contains(role, '<|im_start|>') or contains(role, '<|im_end|>')
      then length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '|', '%7C'), chr(10), '%0A'))
        + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))
      else length(role) + length(text) end as shown_chars
  from rows)
select conv_id,
  count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(shown_chars) as bigint) as formatted_chars
from shown group by conv_id"""

# runs of five words with their counts; links where the probability Jaccard is 0.8 or more:
# for each ratio of the weights of a shared run, their sum over the sum of larger weights
NEAR = r"""
with recursive w as (
  select doc_id, text, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') as ws from documents where text is not null),
runs as (
  select doc_id, unnest(case when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as run
  from w where len(ws) > 0),
c as (select doc_id, run, cast(count(*) as double) as n from runs group by all),
whole as (select doc_id, sum(n) as n from c group by 1),
pairs as (select x.doc_id as a, y.doc_id as b, x.n as an, y.n as bn from c x join c y on x.run = y.run and x.doc_id < y.doc_id),
ratios as (select a, b, an / bn as ratio, sum(an) as total from pairs group by all),
lesser as (
  select r.a, r.b, r.ratio, any_value(r.total) as total, sum(least(s.an, r.ratio * s.bn)) as least_sum
  from ratios r join pairs s on r.a = s.a and r.b = s.b group by all),
near as (
  select l.a, l.b, sum(l.total / (x.n + l.ratio * y.n - l.least_sum)) as likeness
  from lesser l join whole x on x.doc_id = l.a join whole y on y.doc_id = l.b group by 1, 2),
links as (
  select a, b from near where likeness >= 0.8 - 1e-12
  union select x.doc_id, y.doc_id from w x join w y on x.text = y.text and x.doc_id < y.doc_id where len(x.ws) = 0),
steps as (select a, b from links union all select b, a from links),
reach as (
  select doc_id, doc_id as other from documents
  union select r.doc_id, s.b from reach r join steps s on s.a = r.other)
select doc_id, min(other) as class_id, doc_id = min(other) as kept from reach group by doc_id"""

# a page's article without its tags, character references and runs of white space
ARTICLES = r"""
with inside as (
  select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g') as t
  from pages),
plain as (
  select page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(t,
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as text
  from inside)
select page_id, url, text, cast(length(text) as bigint) as n_chars from plain"""

# targets: below some level all sources stop at three times their size, the others share the rest by weight
MIX = r"""
with docs as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5('2:' || doc_id), 1, 15) as bigint) as place
  from documents),
sized as (select source, sum(size) as words from docs group by source),
weighed as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from sized),
ordered as (
  select *, row_number() over (order by 3.0 * words / weight, source nulls last) as nth,
    sum(words) over () as all_words, sum(weight) over () as all_weight,
    sum(3 * words) over (order by 3.0 * words / weight, source nulls last) as full_words,
    sum(weight) over (order by 3.0 * words / weight, source nulls last) as full_weight from weighed),
levels as (
  select nth, (all_words - full_words) / (all_weight - full_weight) as level from ordered where all_weight > full_weight
  union all select 0, cast(any_value(all_words) as double) / any_value(all_weight) from ordered),
chosen as (
  select level, nth from levels l
  where coalesce((select 3.0 * words / weight from ordered o where o.nth = l.nth + 1) > level, true) order by nth limit 1),
targets as (
  select source, words, case when nth <= (select nth from chosen) then 3.0 * words else weight * (select level from chosen) end as target
  from ordered),
flows as (
  select source, words, target, cast(least(round_even(target, 0), 3 * words) as bigint) as flow from targets),
placed as (
  select d.doc_id, d.size, f.words as source_size, f.target, case when f.words > 0 then f.flow // f.words else 0 end as uses,
    case when f.words > 0 then f.flow % f.words else 0 end as rest,
    sum(d.size) over (partition by d.source order by d.place, d.doc_id) - d.size / 2 as middle
  from docs d join flows f on d.source is not distinct from f.source)
select doc_id, size, cast(source_size as bigint) as source_size, round(target, 6) as target,
  cast(size * (uses + case when rest > 0 and middle <= rest then 1 else 0 end) as bigint) as taken from placed"""

# every kept term's smoothed share in every group of documents and in every language, term by term
DIVERGENCE = r"""
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
occ as (
  select row, lang, source,
    translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from d),
kept as (select lang, term from occ group by all having count(distinct row) >= 10),
sizes as (select lang, count(*) as v from kept group by all),
groups as (select distinct lang, source from d),
n as (select lang, source, term, count(*) as n from occ group by all),
cells as (select g.lang, g.source, k.term, coalesce(n.n, 0) as n
  from groups g join kept k using (lang) left join n using (lang, source, term)),
totals as (select lang, source, sum(n) as total from cells group by all),
shares as (
  select c.lang, c.source, c.term, c.n, 1 + (1000000000::hugeint * (c.n + 2)) // (t.total + 2 * s.v) as p
  from cells c join totals t using (lang, source) join sizes s using (lang)),
whole as (select lang, term, sum(n) as n from cells group by all),
whole_totals as (select lang, sum(n) as total from whole group by all),
lang_shares as (
  select w.lang, w.term, 1 + (1000000000::hugeint * (w.n + 2)) // (t.total + 2 * s.v) as q
  from whole w join whole_totals t using (lang) join sizes s using (lang)),
pairs as (
  select a.lang, a.source, b.source as item from groups a join groups b on a.lang = b.lang and a.source <> b.source),
pair_sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair_rows as (
  select lang, source, 'pair' as part, item, cast(coalesce(value, 0) as bigint) as value from pairs left join pair_sums using (lang, source, item)),
term_rows as (
  select lang, source, 'term' as part, term as item, cast(((p - q) * (p - q)) // (p + q) as bigint) as value
  from shares join lang_shares using (lang, term) where n > 0 and p > q),
ranked as (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
  from (select * from pair_rows union all select * from term_rows))
select * from ranked where part = 'pair' or rank <= 10"""

# phrases of two and three words by counting every one of them
PHRASES = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as ws
  from documents),
grams as (
  select lang, size as len, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) as phrase
  from (select *, unnest([1, 2, 3]) as size from pieces) where len(ws) >= size),
f as materialized (select lang, len, phrase, count(*) as a from grams group by all),
totals as (select lang, sum(a) as n from f where len = 1 group by all),
often as (select *, string_split(phrase, ' ') as ws from f where len > 1 and a >= 10),
halves as materialized (
  select lang, phrase, len, a, k, array_to_string(ws[1:k], ' ') as head, array_to_string(ws[k + 1:], ' ') as rest
  from (select *, unnest(range(1, len)) as k from often)),
cuts as (
  select c.lang, c.phrase, c.len, c.a, c.k, l.a as l, r.a as r, (1000000::hugeint * c.a * c.a) // (l.a::hugeint * r.a) as score
  from halves c join f l on l.lang = c.lang and l.phrase = c.head join f r on r.lang = c.lang and r.phrase = c.rest),
best as (select * from cuts qualify row_number() over (partition by lang, phrase, len order by score, k) = 1),
longer as (
  select lang, part, max(a) as a from (
    select lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as part from often where len = 3) group by all),
left_over as (select b.* from best b left join longer o on b.len = 2 and o.lang = b.lang and o.part = b.phrase where o.a is null or 100 * o.a < 50 * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_over)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join totals using (lang) where rank <= 2000"""

# every rule over every text; a match is taken with the gap before it, so running lengths give its place
SECRETS = r"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
rules(no, kind, pattern, kept, least, folded) as (values
  (0, 'assign', '((password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+))', 4, 6, true),
  (1, 'access', '(AKIA[A-Z0-9]+)', 2, 20, false),
  (2, 'hex', '([0-9a-f]+)', 2, 24, false),
  (3, 'private_key', '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 2, 0, false),
  (4, 'hub_token', '(gh[pousr]_[A-Za-z0-9]{36,})', 2, 0, false),
  (5, 'chat_token', '(xox[abpr]-[A-Za-z0-9-]{10,})', 2, 0, false),
  (6, 'cloud_key', '(AIza[A-Za-z0-9_-]{35})', 2, 0, false),
  (7, 'pay_key', '(sk_(?:live|test)_[A-Za-z0-9]{16,})', 2, 0, false),
  (8, 'signed_token', '(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})', 2, 0, false),
  (9, 'bearer', '(bearer\x20+[a-z0-9+/_.~-]{16,})', 2, 0, true),
  (10, 'url_login', '(://[A-Za-z0-9._%+-]+:[^\x00-\x20/@:]{3,}@[A-Za-z0-9])', 2, 0, false)),
asked as (
  select row, no, kind, kept, least, '(?s)(.*?)' || pattern as pattern,
    case when folded then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as t
  from d, rules),
found as (
  select row, no, kind, least, regexp_extract_all(t, pattern, 0) as w, regexp_extract_all(t, pattern, 1) as g,
    case when kept = 4 then regexp_extract_all(t, pattern, 4) else regexp_extract_all(t, pattern, 2) end as k
  from asked),
each as (select row, no, kind, least, unnest(range(1, len(w) + 1)) as i, w, g, k from found),
placed as (
  select row, no, kind, least, length(k[i]) as kept_length, length(w[i]) - length(g[i]) as size,
    sum(length(w[i])) over (partition by row, no order by i) as stop
  from each),
spans as (select row, no, kind, stop - size as start, stop from placed where kept_length >= least),
texts as (
  select row, count(*) filter (no = 0) as n_assign, count(*) filter (no = 1) as n_access, count(*) filter (no = 2) as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, no) filter (no < 3) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, no) as spans
  from spans group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join texts using (row)"""
