"""SQL for the oracle engine, from common table expressions that build on one another."""

from __future__ import annotations

from spanloom.functions import headings as H
from spanloom.functions import predicates as P
from spanloom.functions import text as T
from spanloom.functions.dialect import DUCK as D
from spanloom.functions.dialect import nested

SPOKEN = P.listed([k[0] for k in P.BLOCK_KINDS if k[2]])
SHOWN = P.listed([k[0] for k in P.BLOCK_KINDS if k[1]])
LF = "chr(10)"
BY_BOOK = "partition by book_id"
UP_TO = "rows between unbounded preceding and 1 preceding"

BOOKS = f"""books as (select book_id, string_agg(part, {LF} || {LF} order by k) as text from (
 select doc_id // 8 as book_id, doc_id % 8 as k, concat(
  case when doc_id % 8 = 0 then concat('Contents', {LF}, {LF}, 'Prologue . . . . . . 1', {LF}, 'Chapter 1 . . . . . . 7', {LF}, {LF}) else '' end,
  case when doc_id % 8 = 0 then 'Prologue' else concat('Chapter ', cast(doc_id % 8 as varchar)) end, {LF}, {LF}, text, {LF}, {LF},
  'THE COLLECTED PAPERS ', cast(doc_id % 8 as varchar), {LF}, {LF}, cast(10 + doc_id % 8 as varchar), {LF}, {LF}, '---') as part from documents) group by book_id)"""

MD_BOOKS = f"""md_books as (select conv_id, concat('# Conversation ', cast(conv_id as varchar), {LF}, {LF}, string_agg(part, {LF} || {LF} order by turn)) as text from (
 select conv_id, turn, concat('## ', role, {LF}, {LF}, text, {LF}, {LF}, '- **turn** ', cast(turn as varchar), {LF}, '  - `nested` item', {LF}, {LF}, '> quoted ', role, {LF},
  '> and on', {LF}, {LF}, '```', {LF}, 'x = ', cast(turn as varchar), {LF}, '# not a heading', {LF}, {LF}, '```', {LF}, {LF}, '* * *', {LF}, {LF}, 'Set _off_ in ', cast(turn as varchar), {LF}, '------', {LF},
  '#### Deep \\*mark\\*', {LF}, '3) third', {LF}, {LF}, '==', {LF}, '==', {LF}, '~~~', {LF}, '```', {LF}, '~~~', {LF}, {LF}, '---') as part from conversations) group by conv_id)"""


def lines_of(name: str, source: str, key: str) -> str:
    return f"""{name} as (select *, start + length(line) as "end" from (select {key}, n, line, coalesce(sum(length(line) + 1) over (partition by {key} order by n {UP_TO}), 0)::bigint as start
 from (select {key}, unnest(range(0, len(parts))) as n, unnest(parts) as line from (select {key}, string_split(text, {LF}) as parts from {source} where text <> ''))))"""


LINES = lines_of("lines", "books", "book_id")

CLASSIFIED = f"""l1 as (select *, {T.strip(D, 'line')} as t from lines),
l2 as (select *, t = '' as blank, {T.repetition_key(D, 't')} as key, coalesce(lag(t = '') over w, true) and coalesce(lead(t = '') over w, true) as alone, {P.ends_sentence(D, 't')} as stops,
 {P.is_short(D, 't')} as short, {P.is_shouted(D, 't')} as shouted, {P.is_contents_title(D, 't')} as lists, {P.is_division(D, 't')} as division from l1 window w as ({BY_BOOK} order by n)),
l3 as (select *, key <> '' and sum((not blank and short and not stops and alone)::int) over (partition by book_id, key) >= 3 as running, min(case when lists then n end) over ({BY_BOOK}) as heads from l2),
l4 as (select *, min(case when n > heads and not blank then n end) over ({BY_BOOK}) as f from l3),
l5 as (select *, coalesce(min(case when n >= f and (blank or not short or stops) then n end) over ({BY_BOOK}), max(n) over ({BY_BOOK}) + 1) as e from l4),
l6 as (select *, coalesce(n >= f and n < e and e - f >= 2, false) as entry, case when short and shouted then 1 when short and alone and not stops then 2 end as looks from l5),
classified as (select *, case when kind <> 'heading' then 0 when division then 1 else looks end as level from (select *, case when blank then null when entry or {P.is_contents_entry(D, 't')} then 'toc_entry'
 when {P.is_folio(D, 't')} then 'page_number' when {P.is_rule(D, 't')} then 'separator' when division then 'heading' when running then 'running_head' when looks is not null then 'heading' else 'paragraph' end as kind from l6))"""

BLOCKS = f"""blocks as (select book_id, block_no, min(kind) as kind, min(level) as level, min(start) as start, max("end") as "end", string_agg(t, ' ' order by n) as text from (
 select *, sum(fresh) over ({BY_BOOK} order by n) - 1 as block_no from (select *, (kind is not null and not coalesce(kind = 'paragraph' and lag(kind) over ({BY_BOOK} order by n) = 'paragraph', false))::int as fresh from classified)) where kind is not null group by book_id, block_no)"""

SECTIONS = f"""sections as (select book_id, section_no, coalesce(max(case when kind = 'heading' then text end), '') as title, max(case when kind = 'heading' then level end) as level, min(start) as start, max("end") as "end",
 bool_or(kind = 'paragraph') as has_prose, min(case when kind in {SPOKEN} then start end) as first_spoken, count(*) as n_blocks from (
 select *, s - min(s) over ({BY_BOOK}) as section_no from (select *, sum((kind = 'heading')::int) over ({BY_BOOK} order by block_no) as s from blocks)) group by book_id, section_no)"""

BOUNDS = f"""s1 as (select *, {P.is_opening(D, 'title')} as opens, {P.is_contents_title(D, 'title')} as lists from sections),
began as (select book_id, min(case when opens and has_prose then start end) as began from s1 group by book_id),
last_toc as (select book_id, max("end") as last from (select book_id, start, "end" from blocks where kind = 'toc_entry' union all select book_id, start, "end" from s1 where lists) join began using (book_id) where began is null or start < began group by book_id),
ends as (select book_id, coalesce(last, 0) as contents_end from began left join last_toc using (book_id)),
s2 as (select *, contents_end > 0 and start >= contents_end and not lists as past from s1 join ends using (book_id)),
s3 as (select *, bool_or(past and has_prose) over ({BY_BOOK}) as prose_past from s2),
opened as (select book_id, min(start) as first_open, min(first_spoken) as first_read from s3 where case when contents_end <= 0 then opens when prose_past then past and has_prose else past and opens end group by book_id),
bounds as (select book_id, contents_end, coalesce(first_open, contents_end) as body_opening, coalesce(first_read, past_read, any_read) as reading_start from ends left join opened using (book_id)
 left join (select book_id, min(case when start >= contents_end then start end) as past_read, min(start) as any_read from blocks join ends using (book_id) where kind in {SPOKEN} group by book_id) using (book_id))"""

RENDER = f"""render as (select book_id, row_number() over w - 1 as render_no, kind, level, start, "end", render_start, render_start + length(text) as render_end, text from (
 select *, coalesce(sum(length(text) + 1) over ({BY_BOOK} order by start, block_no {UP_TO}), 0)::bigint as render_start from blocks join ends using (book_id) where kind in {SHOWN} and text <> '' and start >= contents_end) window w as ({BY_BOOK} order by start, block_no))"""

CHAPTERS = f"""c1 as (select book_id, {T.strip(D, 'title')} as title, level, first_spoken as pos0 from sections join bounds using (book_id) where first_spoken >= coalesce(reading_start, 0)),
c2 as (select *, dense_rank() over ({BY_BOOK} order by level nulls last) as rank from c1 where title <> ''),
chapters as (select book_id, row_number() over ({BY_BOOK} order by pos0) - 1 as chapter_no, title, level, pos0 as char_offset from c2 where level is null or rank <= 2)"""

PLAYHEAD = "playhead as (select event_id, user_id % (select count(*) from books) as book_id, ts, event_type, value, cast(trunc(value * 10) as bigint) as char_offset from events)"

LAYOUT = """layout as (select book_id, n as ord, n // 25 as page_index, n // 3 as block_index, line as text, case when line like 'Chapter %' or line in ('Prologue', 'Contents', 'Index') then 18.0::double when line like 'THE COLLECTED%' then 9.0::double else 10.0::double end as size,
 n % 11 = 0 as bold, case when line like 'THE COLLECTED%' then 20.0::double when length(line) = 2 then 770.0::double else (120 + 20 * (n % 25))::double end as top, 800.0::double as page_height from (select * replace (case when n % 250 = 30 then 'Index' else line end as line) from lines where line <> ''))"""

LAYOUT_KINDS = f"""p1 as (select *, {T.strip(D, 'text')} as t from layout), p2 as (select *, {T.repetition_key(D, 't')} as key, {P.in_margin('top', '(top + size)', 'page_height')} as margin from p1 where t <> ''),
sized as (select book_id, arg_max(s, (n, s)) as body from (select book_id, round_even(size, 1) as s, sum(length(t)) as n from p2 group by book_id, s) group by book_id),
heads as (select book_id, key, count(distinct page_index) as n_pages from p2 where margin and key <> '' group by book_id, key having count(distinct page_index) >= 3),
p3 as (select p2.*, body, n_pages is not null as repeats from p2 join sized using (book_id) left join heads using (book_id, key)),
p4 as (select *, {P.is_large(D, 't', 'size', 'bold', 'body')} as large from p3),
p5 as (select *, bool_or(key in {P.listed(P.INDEX_TITLES)} and (margin or large)) over (partition by book_id, page_index) as indexed from p4),
p6 as (select *, case when {P.is_contents_entry(D, 't')} then 'toc_entry' when margin and {P.is_folio(D, 't')} then 'page_number' when margin and repeats then 'running_head' when large then 'heading' when indexed then 'index_entry' else 'paragraph' end as first_kind from p5),
kinds as (select *, case when first_kind = 'paragraph' and {P.is_folio(D, 't')} and (coalesce(lag(first_kind) over w = 'toc_entry', false) or coalesce(lead(first_kind) over w = 'toc_entry', false)) then 'page_number' else first_kind end as kind from p6 window w as ({BY_BOOK} order by ord))"""

#: Labels made from the words of documents, four after four, in the forms that books give them.
LABELS = f"""heads0 as (select doc_id, {T.words(D, "coalesce(text, '')")} as words from documents), four0 as (select doc_id, unnest(range(0, greatest(len(words) - 1, 0) // 4 + 1)) as i, words from heads0), cut0 as (select doc_id, i, array_to_string(words[4 * i + 1:4 * i + 4], ' ') as w from four0),
labels0 as (select doc_id * 100000 + i as label_id, case i % 10 when 0 then concat('chapter ', doc_id % 40, ' . . . . . ', doc_id % 300) when 1 then concat('Chapter ', doc_id % 9, ' - ', w) when 2 then concat('PART iv: ', w, ' ..... ', doc_id % 300)
 when 3 then w when 4 then concat(w, ' . . . . . xii') when 5 then upper(replace(w, 'ß', 'ss')) when 6 then concat('Axiom ', doc_id % 7, ' ', w) when 7 then concat('  prologue  ', case when doc_id % 2 = 0 then '' else ' 12' end) when 8 then concat('Appendix A ', w)
 else case i // 10 % 8 when 0 then concat('Book ', doc_id % 5, ': ', w) when 1 then ' Introduction  · · · · ix' when 2 then 'PREFACE' when 3 then 'epilogue' when 4 then 'Closing Reflections' when 5 then 'Afterword' when 6 then concat('appendix: ', w) else 'Table of Contents' end end as label from cut0)"""


def q(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


STRUCTURE = (BOOKS, LINES, CLASSIFIED, BLOCKS, SECTIONS)
WHOLE = (*STRUCTURE, BOUNDS)


def cleaned(relation: str, label: str) -> str:
    return nested(relation, H.clean_steps(D, label, "clean"))


def translated(at: str, to: str) -> str:
    ends = f"""{at}start as s, {at}"end" as e""" if not at else f"{at}start as s, {at}end as e"
    others = f"""{to}start as ts, {to}end as te""" if to else """start as ts, "end" as te"""
    return f"""rows as (select book_id, {ends}, {others}, lead({to}start) over ({BY_BOOK} order by {at}start) as following from render),
probes as (select book_id, unnest(range(0, length(text) + 1, 997)) as pos from books),
firsts as (select book_id, arg_min(struct_pack(s := s, e := e, ts := ts, te := te, following := following), s) as f from rows group by book_id),
hit as (select p.book_id, p.pos, case when r.s is null then f.f else struct_pack(s := r.s, e := r.e, ts := r.ts, te := r.te, following := r.following) end as h from probes p asof left join rows r on p.book_id = r.book_id and p.pos >= r.s left join firsts f on p.book_id = f.book_id)
select book_id, pos, case when h is null then 0 when pos < h.s then h.ts when pos >= h.e then coalesce(h.following, h.te) else least(h.ts + pos - h.s, h.te) end as mapped from hit"""


HEADING_LINES = rf"(?i)^[ \t]*chapter[ \t]+(?:[0-9]+|[ivxlcdm]+)($|[^\p{{L}}\p{{N}}_])"
PREFIX = r"(?i)^((?:chapter|part|book)\s+[0-9ivxlcdm]+)(?:$|[^\p{L}\p{N}_])"

#: Occurrences of headings in the texts: lines alone, with their next, and by their mark.
OCCURRENCES = f"""o1 as (select *, {T.strip(D, 'line')} as t from lines), o2 as (select *, coalesce(lag(t) over w = '', true) as prev_blank, coalesce(lead(t) over w = '', true) as next_blank from o1 window w as ({BY_BOOK} order by n)),
o3 as (select *, {P.has_leader(D, 't')} as leader, {D.has('t', '^[0-9]+(?:[.][0-9]+){0,99}$')} as number from o2 where t <> ''),
o4 as (select *, leader and {D.has(T.dotted(D, 't'), '^[. ]+$')} as alone from o3),
o5 as (select *, leader or coalesce(bool_or(alone) over f, false) or (coalesce(lag(number) over w, false) and coalesce(bool_or(leader) over f, false)) as probable_toc, lead(t) over w as following from o4 window w as ({BY_BOOK} order by n), f as ({BY_BOOK} order by n rows between 1 following and 4 following)),
o6 as (select book_id, start as char_offset, t as label, 'exact' as match, prev_blank, next_blank, probable_toc from o5 union all select book_id, start, case when right(t, 1) = '-' then concat(left(t, -1), following) else concat(t, ' ', following) end, 'wrapped', prev_blank, next_blank, probable_toc from o5 where following is not null),
o7 as (select *, {H.kind(D, 'clean')} as kind, {T.label_key(D, 'clean')} as key from {cleaned('o6', 'label')}),
occurrences as (select book_id, char_offset, match, key, clean as label, prev_blank, next_blank, probable_toc from o7 union all select book_id, char_offset, 'prefix', key, clean, prev_blank, next_blank, probable_toc from o7 where match = 'exact' and kind in ('chapter', 'part'))"""

CANDIDATES = f"""h1 as (select book_id, n, t as label, start as pos0 from classified where kind = 'heading'),
candidates as (select book_id, label, pos0 as char_offset, n::int as chunk_index, 'nav' as source from h1 union all select book_id, label, case when n % 5 = 0 then null else pos0 + (n * 37) % 600 end, null, 'text_scan' from h1 union all select book_id, label, pos0 + 900, null, 'other' from h1 where n % 3 = 0)"""
