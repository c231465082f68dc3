"""The named queries as plain SQL over the same tables, written from the rules and not from the Spark plans."""
from __future__ import annotations

import re

from claimlake.operators.quotes import NUMBER_WORDS
from claimlake.plans.tables import AS_OF

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SQUASH = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+|[가-힣]+')"
NONE = "[]::varchar[]"


def strip(x: str) -> str:
    return STRIP.format(x)


def squash(x: str) -> str:
    return SQUASH.format(x)


def words(x: str) -> str:
    return WORDS.format(x)


def key(text: str, speaker: str) -> str:
    w = words(text)
    return (f"(case when len({w}) > 0 then array_to_string(list_sort({w}[1:8]), ' ') else lower({strip(text)}) end"
            f" || coalesce('|' || lower(nullif({speaker}, '')), ''))")


def doc_id(col: str, prefixes: str) -> str:
    return rf"regexp_full_match({col}, '({prefixes})-[0-9]{{8}}-[0-9]+')"


def scalar(k: str, col: str) -> str:
    return (rf"'{k}: ' || case when regexp_full_match({col}, '[A-Za-z][A-Za-z0-9_./-]*') and lower({col}) not in "
            rf"('null','true','false','yes','no','on','off','y','n') then {col} else to_json(coalesce({col}, ''))::varchar end")


def refs(k: str) -> str:
    return (f"case when len({k}) = 0 then '{k}: []' else '{k}:' || E'\\n' || array_to_string(list_transform({k}, "
            f"lambda x: '- ' || to_json(x)::varchar), E'\\n') end")


def block(x: str) -> str:
    return (rf"(case when {strip(x)} = '' then '' else array_to_string(list_transform(string_split({strip(x)}, E'\n'), "
            rf"lambda l: case when {strip('l')} = '' then '>' else '> ' || l end), E'\n') end)")


HEADING = "## 원문"
CLAIM_BODY = (rf"'## Claim' || E'\n\n' || claim || E'\n' || case when {strip('quote')} = '' then '' else E'\n{HEADING}\n\n' || "
              rf"{block('quote')} || E'\n' end")
CLAIM_TEXT = (r"E'---\ntype: claim\n' || " + r" || E'\n' || ".join(
    [scalar(k, k) for k in ("id", "claim_type", "status", "proposed_status", "claim", "speaker", "sensitivity")]
    + [refs("source_refs"), refs("evidence_refs")])
    + rf" || E'\n---\n\n' || regexp_replace({CLAIM_BODY}, '\s+$', '') || E'\n'")

# Shared tables. A query is prefixed with those it names, and with those they name.
VIEWS = {
    "f_sources": r"""select doc_id, printf('source-%s-%03d', strftime(DATE '2024-01-01' + (doc_id % 30)::int, '%Y%m%d'), doc_id // 30 + 1) id,
 source origin, DATE '2024-01-01' + (doc_id % 30)::int captured_at,
 case doc_id % 3 when 0 then 'personal' when 1 then 'work' else 'confidential' end sensitivity,
 'https://' || source || '.example.org/' || doc_id url, E'## Raw\n\n' || text body, text from documents""",
    "f_claims": r"""with b as (select d.doc_id, split_part(d.text, E'\n', 1) l1, split_part(d.text, E'\n', 3) l3, l.quality, l.toxic,
  s.id sid, s.captured_at from documents d join f_sources s using (doc_id) left join labels l using (doc_id)),
 c as (select *, case when quality is null then case doc_id % 4 when 0 then 'accepted_for_now' when 1 then 'partially_true' else 'unverified' end
   when quality = 1 and toxic = 0 then 'verified' when quality = 1 then 'disputed' when toxic = 0 then 'attributed' else 'rejected' end status from b),
 e as (select *, case when doc_id % 17 = 0 then 'rejected' when status in ('unverified', 'accepted_for_now', 'partially_true') then 'pending'
   else status end folder from c)
 select doc_id, replace(sid, 'source', 'claim') id, status, folder, l1 claim, case when doc_id % 5 = 0 then 'spk' || (doc_id % 2) end speaker,
 case when doc_id % 11 = 0 then []::varchar[] when doc_id % 13 = 0 then ['source-20990101-001'] else [sid] end source_refs,
 case when status = 'verified' and doc_id % 2 = 0 then [''] when status = 'verified' then ['labels'] else []::varchar[] end evidence_refs,
 case when doc_id % 6 = 0 then '' when doc_id % 7 = 0 then l1 || ' drifted' when doc_id % 5 = 0 and l3 <> '' then l1 || ' (...) ' || l3 else l1 end quote,
 case when doc_id % 9 = 0 then captured_at + 10 end review_after,
 (['technical_fact','person_claim','opinion','hypothesis','decision','observation','instruction','misconception'])[1 + doc_id % 8] claim_type,
 case doc_id % 4 when 0 then 'attributed' when 1 then '' else 'verified' end proposed_status,
 case doc_id % 2 when 0 then 'personal' else 'work' end sensitivity,
 '10_Claims/' || folder || '/' || replace(sid, 'source', 'claim') || '.md' path from e""",
    "f_pages": r"""select conv_id, 'conv ' || conv_id as name, (['concept','pattern','glossary','comparison','misconception'])[1 + conv_id % 5] as type,
 case when conv_id % 4 = 0 then []::varchar[] else coalesce((select list(id order by id) from f_claims k where k.doc_id // 4 = conv_id), []) end claim_refs
 from (select distinct conv_id from conversations)""",
    "f_page_bodies": r"""select name, type, claim_refs, case conv_id % 3 when 1 then array_to_string(claim_refs[2:], ' ')
 when 2 then array_to_string(claim_refs, ' ') || ' claim-20240101-001' else array_to_string(claim_refs, ' ') end body from f_pages""",
    "f_clips": "select page_id, '00_Inbox/' || page_id || '.md' path, url, html txt from pages",
    "f_page_sources": r"""select page_id, printf('source-20240201-%03d', page_id) id, url,
 E'## Raw\n\n' || case when page_id % 3 = 0 then html else 'older capture' end body from pages where page_id % 3 < 2""",
    "f_inbox": f"""select c.path, c.url, case when s.url is not null and {squash('c.txt')} <> '' and contains({squash('s.body')}, {squash('c.txt')})
 then 'leftover' else 'pending' end state from f_clips c left join f_page_sources s using (url)""",
    "f_reviews": r"""select printf('learning-20240101-%03d', user_id) learning_id, event_id seq, ts::date d, event_type not in ('error', 'view') passed from events""",
    "f_items": r"""select user_id, printf('learning-20240101-%03d', user_id) id, 'topic ' || user_id topic,
 case user_id % 7 when 0 then null when 1 then 'seen' when 2 then 'odd' else 'unknown' end level,
 DATE '2024-01-01' + (user_id % 40)::int next_review from (select distinct user_id from events)""",
    "f_claim_files": r"""select * replace ('10_Claims/' || folder || '/' || id || '.md' as path) from (select * from f_claims union all
 select * replace ('outdated' as folder) from f_claims where doc_id % 29 = 0 and folder <> 'outdated')""",
    "f_index_entries": r"""select case when doc_id % 23 = 0 then 'claim-20990101-' || printf('%03d', doc_id) else id end id, 1 ord, left(claim, 60) || ' - unverified' line from f_claims
 union all select case when doc_id % 23 = 0 then 'claim-20990101-' || printf('%03d', doc_id) else id end, 2, left(claim, 60) || E' -\n ' || status from f_claims where doc_id % 2 = 0""",
    "f_upserted": f"select id, {squash('arg_max(line, ord)')} line from f_index_entries group by id",
    "f_snap_new": r"""select doc_id, case when doc_id % 10 = 0 then text || ' edited' else text end text from documents where doc_id % 10 <> 1
 union all select doc_id + 1000000, text from documents where doc_id % 50 = 0""",
    "f_queries": r"""select item_id query_id, split_part(b.text, E'\n', 1) q, embedding vector from benchmark b left join embeddings e on e.vec_id = b.item_id""",
    "f_gated": r"""select doc_id, text, not (doc_id % 3 = 2 or doc_id % 8 = 0) send from documents""",
    "f_drawings": r"""select page_id, case page_id % 5
  when 0 then html || '<svg width="9"><foreignObject><p>' || url || ' drawn as text in the page &amp; kept</p></foreignObject></svg>'
  when 1 then '<svg aria-label="' || url || '"></svg>' || html
  when 2 then html || '<svg><text>' || page_id || '</text><text> axis</text></svg><svg></svg>'
  when 3 then '<SVG><path d="' || url || '"/></SVG>' || html else html end text, url from pages""",
    "f_drawn": r"""select page_id, case page_id % 5 when 0 then 'restored' when 1 then 'label' else 'dropped' end kind,
  case page_id % 5 when 0 then length('<svg width="9"><foreignObject><p>' || url || ' drawn as text in the page &amp; kept</p></foreignObject></svg>')
   when 1 then length('<svg aria-label="' || url || '"></svg>') else length('<SVG><path d="' || url || '"/></SVG>') end before,
  case page_id % 5 when 0 then length(url || ' drawn as text in the page & kept') when 1 then length('[그림: ' || url || ']')
   else length('[svg 생략: ' || length('<SVG><path d="' || url || '"/></SVG>') || '자]') end after
  from pages where page_id % 5 in (0, 1, 3)
 union all select page_id, 'axes', length('<svg><text>' || page_id || '</text><text> axis</text></svg>'), length('[그림 텍스트: ' || page_id || ' axis]')
  from pages where page_id % 5 = 2
 union all select page_id, 'dropped', 11, length('[svg 생략: 11자]') from pages where page_id % 5 = 2""",
    "f_batch": r"""select '00_Inbox/' || doc_id || '.md' path, doc_id ord, case when doc_id % 4 = 0 then '' else 'Note ' || (doc_id // 2) end title,
  case doc_id % 21 when 5 then 'secret' else 'work' end sensitivity,
  case doc_id % 13 when 6 then text || 'JavaScript is not available' else text end txt from documents""",
    "f_held": r"""select id, case when doc_id % 6 = 1 then 'Note ' || doc_id || '.md' else id || '.md' end file from f_sources""",
    "f_revisions": r"""select id source_id, 1 seq, case doc_id % 5 when 0 then substr(body, 9) when 1 then ' ' when 2 then 'JavaScript is not available'
   else substr(body, 9) || ' again' end content, case when doc_id % 7 = 0 then ' ' else 'recapture' end reason from f_sources
 union all select case when doc_id % 12 = 0 then 'source-20990101-001' else id end, case when doc_id % 12 = 0 then doc_id + 3 else 2 end,
   substr(body, 9) || ' again', 'second' from f_sources where doc_id % 2 = 0""",
    "f_revised": rf"""select r.*, s.body stored, '## Raw' || E'\n\n' || content || E'\n' body, case when {strip('reason')} = '' then 'no reason'
   when {strip('content')} = '' then 'no content' when contains(content, 'JavaScript is not available') then 'bot wall'
   when s.id is null then 'no source' end why from f_revisions r left join f_sources s on s.id = r.source_id""",
    "f_commands": r"""select printf('claim-20240101-%03d', user_id) claim_id, event_id + 1 seq,
  case event_type when 'signup' then 'create' when 'view' then 'set_status' when 'click' then case when event_id % 3 = 0 then 'update_quote' else 'update_text' end
   when 'purchase' then 'promote' else 'set_status' end cmd,
  case event_type when 'view' then case when event_id % 4 = 0 then 'unverified' else 'accepted_for_now' end when 'error' then 'rejected' when 'purchase' then 'verified' end target,
  case when event_type = 'purchase' and event_id % 2 = 0 then [props] when event_type = 'purchase' then [''] else [] end evidence,
  case when event_type in ('signup', 'click') then 'text ' || (event_id % 7) end new_text,
  case when event_type = 'click' then 'quote ' || (event_id % 5) end new_quote,
  case when event_type = 'click' and event_id % 5 = 0 then '' else 'fix' end reason,
  case when event_type = 'error' then 'claim-20240102-001' end superseded_by,
  case when event_id % 19 = 0 then 'rumour' else 'observation' end claim_type, ts::date date from events""",
    "f_start": r"""select replace(id, 'learning', 'claim') claim_id from f_items where user_id % 3 = 0""",
    "f_rows": r"""select * from f_commands union all select claim_id, 0, 'seed', 'unverified', [], 'text 1', 'quote 2', null, null, 'observation', DATE '2023-12-01' from f_start""",
    "f_why1": r"""select *, case when cmd = 'create' and claim_type = 'rumour' then 'unknown claim_type'
   when cmd = 'promote' and evidence[1] = '' then 'no written evidence'
   when cmd in ('update_text', 'update_quote') and reason = '' then 'no reason' end why from f_rows""",
    "f_why2": r"""select * replace (coalesce(why, case when cmd = 'create' and exists_ then 'id taken'
   when cmd not in ('seed', 'create') and not exists_ then 'no such claim' end) as why) from (select *, coalesce(bool_or(cmd in ('seed', 'create') and why is null)
   over (partition by claim_id order by seq rows between unbounded preceding and 1 preceding), false) exists_ from f_why1)""",
    "f_why3": r"""select * replace (coalesce(why, case when cmd = 'update_text' and was_status <> 'unverified' then 'not unverified' end) as why) from (select *,
   last_value(case when why is null then case when cmd in ('create', 'seed') then 'unverified' when cmd in ('promote', 'set_status') then target end end ignore nulls) over w was_status,
   last_value(case when why is null then case when cmd in ('create', 'seed') then coalesce(new_quote, '') when cmd = 'update_quote' then new_quote end end ignore nulls) over w was_quote
   from f_why2 window w as (partition by claim_id order by seq rows between unbounded preceding and 1 preceding))""",
    "f_judged": r"""select * replace (coalesce(why, case when cmd = 'update_text' and was_text = new_text or cmd = 'update_quote' and was_quote = new_quote then 'unchanged' end) as why)
   from (select *, last_value(case when why is null and cmd in ('seed', 'create', 'update_text') then new_text end ignore nulls)
   over (partition by claim_id order by seq rows between unbounded preceding and 1 preceding) was_text from f_why3)""",
    "f_two": r"""select * replace (case when doc_id % 4 = 2 then list_append(source_refs, printf('source-%s-%03d',
   strftime(DATE '2024-01-01' + ((doc_id + 1) % 30)::int, '%Y%m%d'), (doc_id + 1) // 30 + 1)) else source_refs end as source_refs) from f_claims""",
    "f_numbered": r"""select * replace (claim || ' 1,' || (200 + doc_id % 3) || ' of ten' as claim,
   case when doc_id % 3 = 0 and quote <> '' then quote || ' (...) twelve 1201 Ten' else quote end as quote) from f_claims""",
    "f_terms": f"select doc_id, unnest({words('text')}) term from documents",
    "f_docs": f"select doc_id, len({words('text')}) dl from documents",
    "f_postings": "select doc_id, term, count(*) tf from f_terms group by all",
    "f_raw_idf": """select term, df, n, round(ln(n - df + 0.5e0) - ln(df + 0.5e0), 12) raw from
   (select term, count(*)::double df from f_postings group by term), (select count(*)::double n from documents)""",
    "f_idf": """select term, df, case when raw < 0 then round(0.25e0 * (select avg(raw) from f_raw_idf), 12) else raw end idf from f_raw_idf""",
    "f_qterms": f"select query_id, term, count(*) n from (select query_id, unnest({words('q')}) term from f_queries) group by all",
    "f_bm": """select query_id, doc_id, round(sum(cast(floor(idf * (tf * 2.5e0) / (tf + 1.5e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl)) * 1e12 + 0.5e0) as bigint) * n)::bigint / 1e12, 9) bm
   from f_qterms join f_idf using (term) join (select doc_id, term, tf::double tf from f_postings) using (term) join (select doc_id, dl::double dl from f_docs) using (doc_id),
   (select avg(dl) avgdl from f_docs) group by query_id, doc_id""",
    "f_cos": """select query_id, e.vec_id doc_id, case when q.vector is null then 0.0e0 else round(list_inner_product(e.embedding::double[], q.vector::double[])
   / (sqrt(list_inner_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_inner_product(q.vector::double[], q.vector::double[]))), 9) end cos
   from f_queries q, embeddings e""",
    "f_scored": """select q.query_id, d.doc_id, coalesce(bm, 0.0e0) bm, coalesce(cos, 0.0e0) cos from f_queries q cross join documents d
   left join f_bm using (query_id, doc_id) left join f_cos using (query_id, doc_id)""",
    "f_ranked": """select query_id, doc_id, rank() over (partition by query_id order by bm desc) - 1 bm_rank, rank() over (partition by query_id order by cos desc) - 1 cos_rank from f_scored""",
    "f_best": """select query_id, (row_number() over (partition by query_id order by s desc, doc_id))::int as position, doc_id, bm_rank, cos_rank, round(s, 6) score
   from (select *, 1.0e0 / (60 + bm_rank) + 1.0e0 / (60 + cos_rank) s from f_ranked)""",
    "f_best_bm": """select query_id, (row_number() over (partition by query_id order by s desc, doc_id))::int as position, doc_id, bm_rank, 0::bigint cos_rank, round(s, 6) score
   from (select *, 1.0e0 / (60 + bm_rank) + 1.0e0 / 60 s from f_ranked)""",
    "f_letters": """select *, list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: (length(v) - length(replace(v, c, '')))::double) vec from
   (select doc_id, left(t, (case when length(t) < 4000 then length(t) when length(t) // 2 < 4000 then length(t) // 2 when length(t) // 4 < 4000 then length(t) // 4 else length(t) // 8 end)::int) v
    from (select doc_id, 'passage: ' || left(text, 16000) t from documents where doc_id % 3 <> 2 and doc_id % 8 <> 0))""",
    "f_asked": """select query_id, list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: (length('query: ' || q) - length(replace('query: ' || q, c, '')))::double) vec from f_queries""",
    "f_letter_cos": """select query_id, d.doc_id, round(list_inner_product(d.vec, q.vec) / (coalesce(nullif(sqrt(list_inner_product(d.vec, d.vec)), 0), 1) * coalesce(nullif(sqrt(list_inner_product(q.vec, q.vec)), 0), 1)), 9) cos
   from f_asked q, f_letters d""",
    "f_letter_ranked": """select query_id, doc_id, rank() over (partition by query_id order by bm desc) - 1 bm_rank, rank() over (partition by query_id order by cos desc) - 1 cos_rank from
   (select q.query_id, d.doc_id, coalesce(bm, 0.0e0) bm, coalesce(cos, 0.0e0) cos from f_queries q cross join documents d left join f_bm using (query_id, doc_id) left join f_letter_cos using (query_id, doc_id))""",
    "f_letter_best": """select query_id, (row_number() over (partition by query_id order by s desc, doc_id))::int as position, doc_id, bm_rank, cos_rank, round(s, 6) score
   from (select *, 1.0e0 / (60 + bm_rank) + 1.0e0 / (60 + cos_rank) s from f_letter_ranked)""",
    "f_known": "select id from f_claims union all select id from f_sources",
    "f_state": f"""select case state when 'leftover' then 'ingested_leftovers' else 'unstructured_inbox' end stage, replace(path, '00_Inbox/', '') id from f_inbox
 union all select status || '_claims', id from f_claims where status in ('unverified', 'verified')
 union all select 'citable_unlinked', id from f_claims where status in ('verified', 'attributed', 'accepted_for_now', 'partially_true')
   and id not in (select unnest(claim_refs) from f_pages)
 union all select 'wiki_pages', name from f_pages union all select 'learning_items', id from f_items
 union all select 'due_reviews', id from f_items where next_review <= DATE '{AS_OF}'""",
}


def missing(claims: str) -> str:
    """Claims with the first piece of their quote that the referenced sources lack."""
    return rf"""select id, source_refs, list_filter(list_transform(string_split(quote, '(...)'), lambda p: {squash('p')}), lambda p: p <> '' and not contains(hay, p)) missing
 from (select k.id, any_value(k.quote) quote, any_value(k.source_refs) source_refs, string_agg({squash('s.body')}, ' ' order by list_position(k.source_refs, s.id)) hay
 from {claims} k, unnest(k.source_refs) u(ref) join f_sources s on s.id = u.ref where {strip('k.quote')} <> '' group by k.id)"""


VIEWS["f_missing"] = missing("f_claims")
VIEWS["f_missing_two"] = missing("f_two")


def bare(x: str) -> str:
    once = rf"regexp_replace({x}, '([0-9]),([0-9])', '\1\2', 'g')"
    return rf"regexp_replace({once}, '([0-9]),([0-9])', '\1\2', 'g')"


def marks(claims: str) -> str:
    said = " || ".join([bare(squash("quote"))] + [
        rf"case when regexp_matches({squash('quote')}, '(?i)\b{w}\b') then ' {d}' else '' end" for w, d in NUMBER_WORDS.items()])
    base = rf"""select k.*, u.ref, {squash('s.body')} hay from {claims} k, unnest(list_distinct(k.source_refs)) u(ref) join f_sources s on s.id = u.ref"""
    calc = rf"""select *, list_filter(list_transform(string_split(quote, '(...)'), lambda p: {squash('p')}), lambda p: p <> '' and not contains(hay, p)) absent,
 {squash('quote')} folded, {said} said from ({base})"""
    calc = rf"""select *, list_filter(regexp_extract_all({bare(squash('claim'))}, '[0-9]+(?:[.,][0-9]+)*'), lambda t: not contains(said, t)) unread from ({calc})"""
    return rf"""select id, ref, 'no quote' mark, '' detail from ({calc}) where {strip('quote')} = ''
 union all select id, ref, 'not in source', left(absent[1], 80) from ({calc}) where {strip('quote')} <> '' and len(absent) > 0
 union all select id, ref, 'short quote', length(folded)::varchar from ({calc}) where {strip('quote')} <> '' and length(folded) < 40
 union all select id, ref, 'numbers not in quote', array_to_string(unread, ', ') from ({calc}) where {strip('quote')} <> '' and len(unread) > 0
 union all select id, ref, 'no speaker', '' from ({calc}) where {strip('quote')} <> '' and proposed_status in ('attributed', 'opinion') and coalesce(speaker, '') = ''"""


VIEWS["f_marks"] = marks("f_claims")

FINDING = "select '{0}' as \"check\", '{1}' severity, {2} ref, {3} message from {4}"


def finding(check: str, severity: str, ref: str, message: str, rows: str) -> str:
    return FINDING.format(check, severity, ref, message, rows)


FOLDERS = """case status when 'unverified' then 'pending' when 'partially_true' then 'pending' when 'accepted_for_now' then 'pending'
 when 'opinion' then 'attributed' when 'deprecated' then 'outdated' else status end"""
IDS = "source|claim|session|decision|learning"
CHECKS = {
    "lint_status_folder": finding("status_folder_mismatch", "error", "id", f"'status ' || status || ' belongs in ' || {FOLDERS} || ', found in ' || folder",
                                  f"f_claims where folder <> {FOLDERS}"),
    "lint_missing_refs": finding("missing_source_refs", "warning", "id", "'no source_refs'", "f_claims where len(source_refs) = 0"),
    "lint_no_evidence": finding("verified_without_evidence", "warning", "id", "'verified, but no written evidence_refs'",
                                "f_claims where status = 'verified' and (len(evidence_refs) = 0 or trim(evidence_refs[1]) = '')"),
    "lint_duplicate_claim": finding("duplicate_claim", "warning", "string_agg(id, ', ' order by id)", "'same normalized key: ' || count(*) || ' claims'",
                                    f"f_claims group by {key('claim', 'speaker')} having count(*) > 1"),
    "lint_orphan_wiki": finding("orphan_wiki", "info", "name", "'page without claim_refs'", "f_pages where len(claim_refs) = 0"),
    "lint_thin_source": finding("thin_source", "warning", "id", f"'body of ' || length({strip('body')}) || ' chars'", f"f_sources where length({strip('body')}) < 200"),
    "lint_inbox": """select case state when 'leftover' then 'inbox_ingested_leftover' else 'inbox_unstructured' end as "check", 'info' severity, path ref,
        case state when 'leftover' then 'already inside a source' else 'waits for ingest' end message from f_inbox""",
    "lint_stale": finding("stale", "warning", "id", "'review_after ' || review_after::varchar || ' has passed'", f"f_claims where review_after::varchar <= '{AS_OF}'"),
    "lint_duplicate_id": finding("duplicate_id", "error", "id", "'in several files: ' || string_agg(path, ', ' order by path)", "f_claim_files group by id having count(*) > 1"),
    "lint_index_dangling": finding("index_dangling", "warning", "id", "'claim-index entry without a file'", "f_upserted where id not in (select id from f_claims)"),
}
_CLAIM_REFS = "select id holder, unnest(list_concat(source_refs, evidence_refs)) ref from f_claims"
_DANGLING = ("dangling_ref", "warning", "holder", "'refers to ' || ref || ', which does not exist'")
_LOST = f"where {doc_id('ref', IDS)} and ref not in (select id from f_known)"
CHECKS["lint_dangling_ref"] = finding(*_DANGLING, f"({_CLAIM_REFS} union all select name, unnest(claim_refs) from f_page_bodies) {_LOST}")


def quote_finding(view: str) -> str:
    return finding("quote_not_in_source", "warning", "id",
                   "'not verbatim in ' || array_to_string(source_refs, ', ') || '; first unmatched: ' || left(missing[1], 60)", f"{view} where len(missing) > 0")


CHECKS["lint_quote_not_in_source"] = quote_finding("f_missing_two")
# all checks over one corpus: claims with their copies, sources of documents and of pages, pages, clips
_FILES = [CHECKS[n].replace("f_claims where folder", "f_claim_files where folder").replace("from f_claims where len", "from f_claim_files where len")
          .replace("from f_claims where status", "from f_claim_files where status").replace("from f_claims group", "from f_claim_files group").replace("from f_claims where review", "from f_claim_files where review")
          .replace("from f_sources where", "from f_audited where") for n in CHECKS if n not in ("lint_dangling_ref", "lint_quote_not_in_source")]
VIEWS["f_audited"] = "select id, body from f_sources union all select id, body from f_page_sources"
_FILE_REFS = """(select id holder, unnest(list_concat(source_refs, evidence_refs)) ref from f_claim_files
 union all select '03_Resources/' || name || '.md', unnest(claim_refs) from f_pages)"""
ALL = " union all ".join([*_FILES, finding(*_DANGLING, f"{_FILE_REFS} where {doc_id('ref', IDS)} and ref not in (select id from f_claims union all select id from f_audited)"),
                          finding("unparseable", "error", "'10_Claims/pending/broken-' || doc_id || '.md'", "'frontmatter cannot be read'", "f_claims where doc_id % 50 = 7"),
                          quote_finding("(select m.* from f_missing m join f_claim_files using (id))")])


#: What the pages of the given tables hold: no nesting, no attributes but href, and emphasis that only a line break ends.
HTML_RULES = (
    (r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", ""), (r"(?s)<!--.*?-->", ""), (r"(?i)<!doctype[^>]*>", ""), (r"[\t\r\n ]+", " "),
    (r"<h1>(.*?)</h1>", "\n\n# \\1\n\n"), (r'<a href="([^"]*)">(.*?)</a>', "[\\2](\\1)"), (r"<b>([^<]*?) *<br>", "**\\1**"), (r"<li>", "\n* "),
    (r"</?(title|p|div|article|nav|ul|header|footer)\b[^>]*>", "\n\n"), (r"<[^>]+>", ""),
    ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
    (r" +\n", "\n"), (r"\n +", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \n]+", ""), (r"[ \n]+$", ""),
)


def html_rules() -> str:
    out = "html"
    for pattern, replacement in HTML_RULES:
        esc = lambda x: x.replace("'", "''")
        line = esc(replacement).replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{esc(pattern)}', '{line}', 'g')"
    return out


def folded(x: str) -> str:
    for a, b in zip("‘’“”–—−‑×ᵀ ⠀·", "''\"\"----xT  ."):
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    x = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    return f"replace(replace(replace({x}, '​', ''), '﻿', ''), '…', '...')"


RAW_BODY = r"ltrim(substr(s.body, 7), E'\n')"
PARTS = f"list_filter(list_transform(string_split({strip('k.quote')}, '(...)'), lambda p: {strip('p')}), lambda p: p <> '')"

SQL = {
    "frontmatter_roundtrip": f"""select id, claim_type, status, claim, coalesce(speaker, '') speaker, sensitivity, folder, array_to_string(source_refs, ',') source_refs,
        len(evidence_refs)::int n_evidence, {strip('quote')} quote from f_claims""",
    "search_docs": rf"""select id ref, case when claim = '' then id else claim end title, {strip(rf"id || '   ' || claim || ' ' || E'\n' || {CLAIM_BODY}")} text, path, sensitivity,
        false pre_ingest from f_claims""",
    "index_upsert": "select id, line from f_upserted",
    "status_folder": f"select status, {FOLDERS} folder, count(*) n from f_claims group by all",
    "page_folder": """select name, case type when 'concept' then 'Concepts' when 'pattern' then 'Patterns' when 'glossary' then 'Glossary'
        when 'comparison' then 'Comparisons' else 'Misconceptions' end folder from f_pages""",
    "render_claims": f"select path, {CLAIM_TEXT} as text from f_claims",
    "render_sources": r"select path, md5(x) digest, length(x)::int chars from (select '00_Inbox/raw/' || id || '.md' path, E'---\ntype: source\n' || "
        + r" || E'\n' || ".join(scalar(k, f"{k}::varchar") for k in ("id", "origin", "captured_at", "sensitivity", "url"))
        + rf" || E'\n---\n\n' || regexp_replace(body, '\s+$', '') || E'\n' x from f_sources)",
    "review_packet": rf"""select id, '## ' || id || '  [' || claim_type || '] proposed=' || proposed_status || ' source=' || array_to_string(source_refs, ',')
        || E'\n\n### claim\n' || claim || E'\n\n### quote\n' || {strip('quote')} || E'\n' as text from f_claims
        union all select '', '# ' || count(*) || E' claims\n' from f_claims""",
    "review_json": rf"""with k as (select u.ref source_id, id from f_claims, unnest(list_distinct(source_refs)) u(ref)),
        m as (select ref, count(distinct id) flagged from f_marks group by ref)
        select source_id, count(*) n_claims, coalesce(any_value(m.flagged), 0) flagged, min(k.id) first_id,
        any_value(coalesce(nullif({strip(rf'''regexp_extract(s.body, '(?m)^\s*title:\s*"?(.+?)"?\s*$', 1)''')}, ''), s.id)) title
        from k join f_sources s on s.id = k.source_id left join m on m.ref = k.source_id group by source_id""",
    "quarantine": """select id, case when doc_id % 10 = 3 then 'unknown claim_type' when doc_id % 15 = 4 then 'unknown sensitivity' else '' end reason from f_claims""",
    "id_shape": rf"""select doc_id, count_if({doc_id('ref', IDS)}) n_ids, count_if({doc_id('ref', 'source')}) n_sources from (select doc_id, unnest([
        'source-20240101-' || doc_id, 'claim-2024010-' || doc_id, 'claim-20240101-' || doc_id || 'x', 'note-20240101-' || doc_id,
        'decision-20240101-' || doc_id || E'\n']) ref from documents) group by doc_id""",
    "botwall": """select doc_id, case doc_id % 9 when 0 then 'Attention Required! | Cloudflare' when 1 then 'JavaScript is not available' end marker from documents""",
    "list_pending": "select id, claim, claim_type, proposed_status from f_claims where folder = 'pending' and status = 'unverified'",
    "due_reviews": f"select id, topic, coalesce(level, 'unknown') as level from f_items where next_review <= DATE '{AS_OF}'",
    "embed_gate": "select doc_id, send from f_gated",
    "svg_report": "select page_id, kind, count(*) n, sum(before)::bigint before, sum(after)::bigint after from f_drawn group by all",
    "svg_totals": "select kind, count(*) n, sum(before)::bigint before, sum(after)::bigint after, round((1 - sum(after) / sum(before)) * 100, 1) saved_pct from f_drawn group by kind",
    "html_markdown": f"select page_id, {html_rules()} markdown from pages",
    "safe_title": rf"""select doc_id, coalesce(nullif(left(trim({squash(r'''regexp_replace(title, '[/\\:*?"<>|\x00-\x1f]', ' ', 'g')''')}, '. '), 120), ''), 'source-' || doc_id) || '.md' file
        from (select doc_id, case doc_id % 7 when 0 then '' when 1 then ' .?.' when 2 then 'a/b:c' || split_part(text, E'\n', 1) || '. ' else text end title from documents)""",
    "slug": r"""select doc_id, coalesce(nullif(trim(regexp_replace(lower(l), '[^a-z0-9가-힣]+', '-', 'g'), '-'), ''), 'page') page,
        coalesce(nullif(trim(regexp_replace(lower(regexp_extract(rtrim('/src/' || l || '/', '/'), '[^/]*$')), '[^a-z0-9가-힣]+', '-', 'g'), '-'), ''), 'project') project
        from (select doc_id, split_part(text, E'\n', 1) l from documents)""",
    "ingest_sources": rf"""with j as (select *, case when sensitivity = 'secret' then 'unknown sensitivity' when contains(txt, 'JavaScript is not available') then 'bot wall' end why from f_batch),
        t as (select *, case when why is null and title <> '' then title || '.md' end file from j),
        f as (select *, min(ord) over (partition by file) first from t),
        g as (select * replace (coalesce(why, case when file is not null and (ord > first or file in (select file from f_held)) then 'title taken' end) as why) from f),
        n as (select *, printf('source-20240120-%03d', (select coalesce(max(substr(id, 17)::int), 0) from f_sources where id like 'source-20240120-%') + row_number() over (order by ord)) id from g where why is null)
        select ord, id, '00_Inbox/raw/' || coalesce(file, id || '.md') path, '' reason, (length(txt) + 9)::int chars from n
        union all select ord, '', '', why, 0 from g where why is not null""",
    "revise_sources": rf"""with p as (select *, last_value(case when why is null then body end ignore nulls) over (partition by source_id order by seq
        rows between unbounded preceding and 1 preceding) prev from f_revised)
        select source_id, seq, case when rejection is null then 'applied' else 'rejected' end outcome, rejection, length(old)::int old_chars, length(body)::int new_chars, {strip('reason')} reason
        from (select *, coalesce(prev, stored) old, coalesce(why, case when coalesce(prev, stored) = body then 'unchanged' end) rejection from p)""",
    "revised_bodies": "select s.id, md5(coalesce(any_value(r.b), any_value(s.body))) digest from f_sources s left join (select source_id, arg_max(body, seq) b from f_revised where why is null group by source_id) r on r.source_id = s.id group by s.id",
    "triage": """select doc_id, decision, rejection, case when rejection is null then 'triage ' || sid || ' -> ' || decision end line from (select doc_id, decision, sid,
        case when decision = 'later' then 'unknown decision' when doc_id % 10 = 1 then 'bad id' when doc_id % 10 = 0 then 'no source' end rejection
        from (select doc_id, case doc_id % 10 when 0 then 'source-20990101-001' when 1 then '../x' else id end sid,
        case doc_id % 4 when 0 then 'drop' when 1 then 'deep' when 2 then 'keep-as-link' else 'later' end decision from f_sources))""",
    "inherit_sensitivity": """select k.id, (['personal', 'work', 'confidential'])[1 + coalesce(max(case s.sensitivity when 'work' then 1 when 'confidential' then 2 else 0 end), 0)] inherited
        from (select id, unnest(list_concat(source_refs, [replace(replace(id, 'claim', 'source'), '2024010', '2024011'), 'a book'])) ref from f_claims) k
        left join f_sources s on s.id = k.ref group by k.id""",
    "allocate_ids": """with tops as (select substr(id, 8, 8) d, max(substr(id, 17)::int) top from f_sources group by 1)
        select doc_id, printf('source-%s-%03d', d, coalesce(top, 0) + n) id from (select doc_id, strftime(captured_at + 15, '%Y%m%d') d,
        row_number() over (partition by captured_at order by doc_id) n from f_sources) left join tops using (d)""",
    "inbox_classify": "select path, url, state from f_inbox",
    "resolve_source": """with files as (select id, case when doc_id % 2 = 0 then '00_Inbox/raw/Title ' || doc_id || '.md' else '00_Inbox/raw/' || id || '.md' end path, doc_id from f_sources),
        places as (select id k, 1 place, path from files union all select id, 0, path from files where doc_id % 2 = 1
         union all select id, 0, '00_Inbox/old/' || id || '.md' from f_sources where doc_id % 10 = 0),
        pick as (select k, min({place: place, path: path}) b from places group by k)
        select i.id, b.path path, b.place::int place from (select case when doc_id % 9 = 0 then id || '99' else id end id from f_sources) i left join pick on pick.k = i.id""",
    "recapture": rf"""select c.path, c.url, s.id source_id, case when s.id is null then 'new' when {strip('c.txt')} = {strip('substr(s.body, 9)')} then 'same' else 'revise' end state
        from f_clips c left join f_page_sources s using (url)""",
    "clip_title": rf"""select doc_id, {strip(rf'''regexp_extract(b, '(?m)^\s*title:\s*"?(.+?)"?\s*$', 1)''')} title from (select doc_id, E'---\nurl: x\n' ||
        case when doc_id % 3 = 0 then '' else '  title: "' || split_part(text, E'\n', 1) || E'"  \n' end || E'---\n' || text b from documents)""",
    "apply_commands": "select claim_id, seq, cmd, case when why is null then 'applied' else 'rejected' end outcome, why rejection from f_judged where cmd <> 'seed'",
    "commanded_claims": f"""with a as (select * from f_judged where why is null), s as (select claim_id,
        arg_max(case when cmd in ('create', 'seed') then 'unverified' else target end, seq) filter (cmd in ('seed', 'create', 'promote', 'set_status')) status,
        arg_max(new_text, seq) filter (cmd in ('seed', 'create', 'update_text')) claim,
        arg_max(coalesce(new_quote, ''), seq) filter (cmd in ('seed', 'create', 'update_quote')) quote,
        arg_max(case when cmd = 'promote' then evidence[1] else '' end, seq) filter (cmd in ('seed', 'create', 'promote')) evidence_refs,
        arg_max(superseded_by, seq) filter (cmd = 'set_status' and superseded_by is not null) by_,
        min(date) filter (cmd in ('seed', 'create')) created, arg_max(date, seq) updated, arg_max(date, seq) filter (cmd = 'promote') last_verified
        from a group by claim_id)
        select claim_id, status, {FOLDERS} folder, claim, quote, evidence_refs, coalesce(by_, '') superseded_by, created, updated, last_verified from s""",
    "current_claims": "select id, arg_min(folder, folder) folder, any_value(status) status, arg_min(path, folder) path from f_claim_files group by id",
    "normalize_key": f"select id, {key('claim', 'speaker')} as key from f_claims",
    "find_similar": f"""with c as (select {key('claim', 'speaker')} as key, count(*) n, min(id) first_id from f_claims where claim <> '' group by 1)
        select doc_id probe_id, p.key, coalesce(n, 0) n, first_id from (select doc_id, {key("replace(lower(split_part(text, E'\\n', 1)), ' ', ' - ')", "case when doc_id % 4 = 0 then 'SPK' || (doc_id % 2) end")} as key from documents) p left join c using (key)""",
    "similar_members": f"""select {key('claim', 'speaker')} as key, count(*) n, string_agg(id, ',' order by id) ids from f_claims where claim <> '' group by 1
        having key in (select {key("replace(lower(split_part(text, E'\\n', 1)), ' ', ' - ')", "''")} from documents)""",
    "quote_block": f"select doc_id, md5({block('text')}) quoted, md5({strip('text')}) extracted from documents",
    "create_pages": r"""with n as (select doc_id ord, 'Conv ' || (doc_id // 3) name, case doc_id % 11 when 7 then 'essay' when 8 then 'pattern' else 'concept' end type, 'conv-' || (doc_id // 3) slug from documents),
        j as (select *, case when type = 'essay' then 'unknown page_type' when ord <> min(ord) over (partition by type, slug)
          or (type, slug) in (select (type, replace(name, ' ', '-')) from f_pages) then 'page exists' end why from n)
        select name, type, slug, case when why is null then '03_Resources/' || case type when 'concept' then 'Concepts' else 'Patterns' end || '/' || slug || '.md' else '' end path, coalesce(why, '') reason from j""",
    "update_pages": r"""with p as (select *, turn seq from conversations),
        f as (select conv_id, arg_max([role], seq) filter (turn % 2 = 1) aliases, arg_max('reviewed', seq) filter (turn = 2) status, arg_max(text, seq) filter (turn % 3 = 0) body,
          max(DATE '2024-01-02' + turn::int) updated from p group by conv_id),
        r as (select conv_id, unnest([printf('claim-20240101-%03d', turn % 3), printf('claim-20240105-%03d', conv_id // 10 + 1)]) ref, unnest([turn * 2, turn * 2 + 1]) place from p),
        g as (select r.conv_id, ref, min(place) place from r join f_pages b using (conv_id) where not list_contains(b.claim_refs, ref) group by all),
        a as (select conv_id, list(ref order by place) added from g group by conv_id)
        select name, array_to_string(list_concat(claim_refs, coalesce(added, [])), ',') claim_refs, coalesce(array_to_string(aliases, ','), '') aliases,
        coalesce(status, 'draft') status, md5(coalesce(body, 'old')) body, updated from f_pages left join f using (conv_id) left join a using (conv_id)""",
    "project_docs": r"""with n as (select *, 'repo-' || (conv_id % 5) repo from conversations where turn = 0),
        h as (select 'repo-' || (conv_id % 5) repo, max(conv_id) top from conversations where turn = 1 and conv_id % 2 = 0 group by 1)
        select printf('decision-20240120-%03d', coalesce(top, 0) + row_number() over (partition by repo order by conv_id)) id, repo, 'Session ' || conv_id title, 'accepted' status,
        md5(E'## Context\n\n' || text || E'\n\n## Decision\n\n' || role || E'\n\n## Alternatives\n\nnone\n\n## Consequences\n\n\n') body from n left join h using (repo)""",
    "session_rollup": r"""select conv_id as session, count(*) n_entries, length(string_agg(text, E'\n' order by turn)) total_chars,
        left(string_agg(text, E'\n' order by turn), 500) || case when length(string_agg(text, E'\n' order by turn)) > 500
        then E'\n[truncated: showing 500 of ' || length(string_agg(text, E'\n' order by turn)) || ' chars]' else '' end as text from conversations group by conv_id""",
    "page_refs": r"select name, array_to_string(list_sort(list_distinct(regexp_extract_all(body, 'claim-\d{8}-\d{3,}'))), ',') refs from f_page_bodies",
    "ref_mismatch": r"""select name, array_to_string(list_sort(list_filter(c, lambda x: not list_contains(claim_refs, x))), ',') only_body,
        array_to_string(list_sort(list_filter(claim_refs, lambda x: not list_contains(c, x))), ',') only_refs
        from (select *, list_distinct(regexp_extract_all(body, 'claim-\d{8}-\d{3,}')) c from f_page_bodies) where len(only_body) > 0 or len(only_refs) > 0""",
    "one_hop": """with e as (select id h, unnest(list_concat(source_refs, evidence_refs)) t from f_claims union all select name, unnest(claim_refs) from f_pages),
        s as (select id from f_claims where status = 'verified')
        select id ref from s union select t from e where h in (select id from s) union select h from e where t in (select id from s)""",
    "create_items": rf"""select printf('learning-20240120-%03d', (select max(user_id) from f_items) + row_number() over (order by item_id)) id, split_part(text, E'\n', 1) topic, 'unknown' as level,
        DATE '{AS_OF}' created, DATE '{AS_OF}' next_review from benchmark""",
    "review_schedule": """with r as (select learning_id, list({d: d, passed: passed} order by seq) l from f_reviews group by 1),
        f as (select i.id, list_reduce(list_prepend({lvl: case i.level when 'seen' then 1 else 0 end, due: i.next_review, d: null::date, passed: null::boolean},
          list_transform(l, lambda x: {lvl: 0, due: null::date, d: x.d, passed: x.passed})),
          lambda a, x: case when x.passed then {lvl: least(a.lvl + 1, 5), due: x.d + ([1, 3, 7, 16, 35])[1 + least(a.lvl, 4)], d: x.d, passed: x.passed}
            else {lvl: a.lvl, due: x.d + 1, d: x.d, passed: x.passed} end) s, len(l) n from f_items i join r on r.learning_id = i.id)
        select id, (['unknown', 'seen', 'explained', 'used', 'reviewed', 'can-teach'])[s.lvl + 1] as level, s.due next_review, n n_reviews from f""",
    "fold_text": f"""select doc_id, md5({folded("'“A — b”… ' || text || ' ×​·'")}) folded from documents""",
    "check_quotes": rf"""with c as (select id, source_refs[1] ref, case when doc_id % 3 = 1 then replace(claim, ' ', '  ') else quote end q from f_claims)
        select c.id as key, case when s.id is null then null when contains({RAW_BODY}, q) then 'EXACT' when contains({folded(RAW_BODY)}, {folded('q')}) then 'FIXED' else 'NOTFOUND' end status,
        case when s.id is null or contains({RAW_BODY}, q) or not contains({folded(RAW_BODY)}, {folded('q')}) then null else replace(q, '  ', ' ') end fixed
        from c left join f_sources s on s.id = c.ref""",
    "quote_audit": rf"""select k.id, case when {strip('k.quote')} = '' then 'no quote' when s.id is null then 'source missing'
        when len(list_filter({PARTS}, lambda p: not contains({RAW_BODY}, p))) = 0 then 'exact'
        when len(list_filter({PARTS}, lambda p: not contains({folded(RAW_BODY)}, {folded('p')}))) = 0 then 'equal after folding' else 'not found' end verdict,
        {strip('k.quote')} <> '' and length({strip('k.quote')}) < 40 short from f_claims k left join f_sources s on s.id = k.source_refs[1]""",
    "audit_counts": """select 'total' metric, '' as key, count(*) n from f_claims union all select 'status', status, count(*) from f_claims group by all
        union all select 'claim_type', claim_type, count(*) from f_claims group by all union all select 'proposed_status', proposed_status, count(*) from f_claims group by all
        union all select 'source', coalesce(source_refs[1], '?'), count(*) from f_claims group by all union all select 'no_evidence', id, 1 from f_claims where len(evidence_refs) = 0
        union all select 'no_sources', id, 1 from f_claims where len(source_refs) = 0 union all select 'no_proposal', id, 1 from f_claims where proposed_status = ''""",
    "review_marks": f"""with m as ({marks('f_numbered')}) select id, mark, detail from m
        union all select k.id, null, null from f_numbered k, unnest(list_distinct(k.source_refs)) u(ref) join f_sources s on s.id = u.ref where k.id not in (select id from m)""",
    **CHECKS,
    "lint_unparseable": r"""select 'unparseable' as "check", 'error' severity, path ref, 'frontmatter cannot be read' message from f_claims
        where right(replace(path, '.md', ''), 3)::int % 5 in (0, 1)""",
    "lint_all": ALL,
    "lint_summary": f"select count(*) findings, count_if(severity = 'error') errors, count_if(severity = 'error') > 0 failed from ({ALL})",
    "claim_status_counts": "select status, count(distinct id) n from f_claim_files group by status",
    "referenced_claims": "select distinct unnest(claim_refs) id from f_pages",
    "citable_unlinked": "select id from f_state where stage = 'citable_unlinked'",
    "vault_state": "select stage, id from f_state",
    "stage_counts": """select s.stage, count(f.id) n from (select unnest(['unstructured_inbox', 'ingested_leftovers', 'unverified_claims', 'citable_unlinked', 'due_reviews', 'verified_claims',
        'wiki_pages', 'learning_items']) stage) s left join f_state f using (stage) group by s.stage""",
    "next_step": """select stage, count(*) n from f_state where stage in ('unstructured_inbox', 'ingested_leftovers', 'unverified_claims', 'citable_unlinked', 'due_reviews') group by stage
        order by list_position(['unstructured_inbox', 'ingested_leftovers', 'unverified_claims', 'citable_unlinked', 'due_reviews'], stage) limit 1""",
    "tokenize": rf"""with w as (select doc_id, {words("text || ' '")} w from documents), t as (select doc_id, list_concat(w, ['한','국','어','한국','국어','bm25','검'], {words("doc_id::varchar")}, ['밥','색']) t from w)
        select doc_id, md5(array_to_string(t, ' ')) tokens, len(t)::int n from t""",
    "postings": """select doc_id, term, tf, dl::int dl, df, n_docs, round(avgdl, 6) avgdl from f_postings join f_docs using (doc_id) join (select term, count(*) df from f_postings group by term) using (term),
        (select count(*) n_docs, avg(dl) avgdl from f_docs)""",
    "bm25_idf": "select term, df::bigint df, round(idf, 6) idf from f_idf",
    "bm25_score": "select query_id, doc_id, round(bm, 6) bm from f_bm",
    "embed_input": "select doc_id, length(i)::int chars, sha256(i) as key from (select doc_id, 'passage: ' || left(text, 16000) i from f_gated where send)",
    "embed_cache_missing": """with i as (select doc_id, left(text, 16000) x from documents) select distinct sha256(x) as key, length(x)::int chars from i
        where sha256(x) not in (select sha256(x) from i where doc_id % 3 = 0 and doc_id % 2 = 0 and doc_id % 5 <> 0)""",
    "embed_dims": """select case when vec_id % 10 = 0 then 32 else len(embedding) end::int dim, count(*) n from embeddings where vec_id % 10 = 0 or vec_id % 25 <> 1 group by 1""",
    "embed_job": f"""select distinct sha256(t) as key, array_to_string(list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: length(v) - length(replace(v, c, ''))), ',') vector,
        case when v = t then 'ok' else 'shortened' end embed_status from (select left(text, 16000) t,
        left(left(text, 16000), (case when length(left(text, 16000)) < 4000 then 4000 when length(left(text, 16000)) < 8000 then length(left(text, 16000)) // 2
          when length(left(text, 16000)) // 2 < 8000 then length(left(text, 16000)) // 2 // 2 else length(left(text, 16000)) // 2 // 2 // 2 end)::int) v from documents)""",
    "cosine_score": "select query_id, doc_id, round(cos, 6) cos from f_cos",
    "cosine_topk": """select query_id, (row_number() over (partition by query_id order by cos desc, doc_id))::int as position, doc_id, round(cos, 6) cos from f_cos
        qualify row_number() over (partition by query_id order by cos desc, doc_id) <= 8""",
    "competition_rank": "select event_type, event_id, rank() over (partition by event_type order by round(value, 1) desc) - 1 as rank from events",
    "hybrid_topk": "select * from f_best where position <= 8",
    "hybrid_hits": r"select query_id, position, 'doc-' || doc_id ref, split_part(text, E'\n', 1) title, score, left(text, 200) snippet from f_best join documents using (doc_id) where position <= 8",
    "bm25_topk": "select *, true degraded from f_best_bm where position <= 8",
    "hybrid_embedded": "select *, false degraded from f_letter_best where position <= 8",
    "query_outage": "select *, true degraded from f_best_bm where position <= 8",
    "snapshot_diff": """select coalesce(o.doc_id, n.doc_id) doc_id, case when o.doc_id is null then 'added' when n.doc_id is null then 'deleted' when o.text = n.text then 'same' else 'changed' end change
        from documents o full join f_snap_new n on o.doc_id = n.doc_id""",
    "index_refresh": f"select term, count(distinct doc_id) df from (select doc_id, unnest({words('text')}) term from f_snap_new) group by term",
    "placement_leak": """select id, sensitivity, root from (select id, sensitivity, case doc_id % 4 when 0 then '03_Resources' when 1 then '30_Learning' when 2 then '00_Inbox' else '01_Projects' end root from f_sources)
        where root in ('03_Resources', '30_Learning') and sensitivity <> 'personal'""",
    "derived_leak": """select k.id, k.sensitivity, s.sensitivity inherited from f_claims k, unnest(k.source_refs) u(ref) join f_sources s on s.id = u.ref
        where case k.sensitivity when 'personal' then 0 else 1 end < case s.sensitivity when 'personal' then 0 when 'work' then 1 else 2 end""",
}


def with_views(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bf_\w+\b", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    heads = ",\n".join(f"{n} as ({VIEWS[n]})" for n in needed)
    return f"with {heads}\nselect * from (\n{sql}\n)"


ORACLE = {name: with_views(sql) for name, sql in SQL.items()}
