"""Queries over claims and sections, each with independent SQL."""

from __future__ import annotations

from lectern.operators import planning as P
from lectern.operators import script as S
from lectern.sources.tables import table


def _claims(operator):
    return lambda spark, folder: operator(P.claims_once(table(spark, folder, "claims")))


def _located(spark, folder):
    return P.located_quotes(P.claims_once(table(spark, folder, "claims")), table(spark, folder, "sections"))


QUERIES = {
    "claims_section_difficulty": _claims(P.section_difficulty),
    "claims_hardest": _claims(P.hardest_claims),
    "claims_guest": _claims(P.guest_claims),
    "claims_landing": _claims(P.landing_claims),
    "claims_equal_blocks": _claims(P.equal_blocks),
    "claims_quiz": _claims(P.quiz_claims),
    "claims_chapter_need": _claims(P.chapter_need),
    "claims_bare_sections": lambda spark, folder: P.bare_sections(table(spark, folder, "sections"), P.claims_once(table(spark, folder, "claims"))),
    "claims_located_quotes": _located,
    "claims_merged_passages": lambda spark, folder: P.merged_passages(_located(spark, folder)),
    "claims_coverage_sets": lambda spark, folder: P.coverage_sets(S.script_lines(table(spark, folder, "script_lines")), P.claims_once(table(spark, folder, "claims"))),
    "script_revision_overlap": lambda spark, folder: P.revision_overlap(S.script_lines(table(spark, folder, "script_lines"))),
}

_C = """with c as (select distinct book_id, chapter_id, claim_id, claim_no, greatest(1, least(5, coalesce(difficulty, 3))) as difficulty, greatest(1, least(5, coalesce(exam_relevance, 3))) as relevance,
 span.section as section, span.quote as quote from claims),
n as (select *, count(*) over (partition by book_id, chapter_id) as n, row_number() over (partition by book_id, chapter_id order by claim_no, claim_id) - 1 as i from c),
b as (select *, greatest(3, least(5, cast(round_even(n / 4, 0) as int))) as blocks from n),
e as (select *, 1 + len(list_filter(range(1, blocks + 1), lambda k: cast(round_even(k * n / blocks, 0) as int) <= i)) as block_no from b),
s as (select distinct book_id, chapter_id, section_id, section_no, text from sections where text is not null),
q as (select c.*, s.section_id, s.section_no, case when instr(text, quote) > 0 then 100 when instr(lower(text), lower(quote)) > 0 then 99 else 0 end as score,
 case when instr(text, quote) > 0 then instr(text, quote) else instr(lower(text), lower(quote)) end as spot from c join s using (book_id, chapter_id) where quote is not null and quote <> ''),
r as (select *, row_number() over (partition by book_id, chapter_id, claim_id order by section_id <> section, section_no, section_id) as nth from q where score > 0),
loc as (select book_id, chapter_id, claim_id, section_id, spot - 1 as start_pos, spot - 1 + length(quote) as end_pos, score from r where nth = 1
 union all select book_id, chapter_id, claim_id, section, 0, 0, 0 from c where quote is not null and quote <> '' and not exists (select 1 from r where r.book_id = c.book_id and r.chapter_id = c.chapter_id and r.claim_id = c.claim_id))
"""
SQL = {
    "claims_section_difficulty": _C + "select *, difficulty > 4.0 as expert from (select book_id, chapter_id, section, round_even(avg(difficulty), 2) as difficulty, count(*) as claims from c group by 1, 2, 3)",
    "claims_hardest": _C + "select book_id, chapter_id, arg_max(claim_id, row(difficulty, relevance, -claim_no)) as hardest, arg_max(claim_id, row(relevance, difficulty, -claim_no)) as recap from c group by 1, 2",
    "claims_guest": _C + "select book_id, chapter_id, claim_id, row_number() over (partition by book_id, chapter_id order by claim_no, claim_id) as place from (select *, row_number() over (partition by book_id, chapter_id order by difficulty desc, claim_no, claim_id) as nth from n) where nth <= greatest(1, least(4, n // 3))",
    "claims_landing": _C + "select book_id, chapter_id, claim_id, place from (select *, row_number() over (partition by book_id, chapter_id order by difficulty desc, relevance desc, claim_no, claim_id) as place from c where difficulty >= 4) where place <= 5",
    "claims_equal_blocks": _C + "select book_id, chapter_id, claim_id, block_no from e",
    "claims_quiz": _C + """, pool as (select * from (select *, max(relevance) over (partition by book_id, chapter_id) as top from e) where relevance >= 4 or top < 4),
k as (select *, row_number() over (partition by book_id, chapter_id, block_no order by relevance desc, difficulty desc, claim_no, claim_id) as in_block from pool),
o as (select *, row_number() over (partition by book_id, chapter_id order by in_block > 1, relevance desc, difficulty desc, claim_no, claim_id) as nth from k)
select book_id, chapter_id, claim_id, row_number() over (partition by book_id, chapter_id order by claim_no, claim_id) as place from o where nth <= 3""",
    "claims_chapter_need": _C + "select book_id, chapter_id, seconds, claims, greatest(3, least(5, cast(round_even(claims / 4, 0) as int))) as blocks, cast(floor(seconds * 15 * 0.9) as bigint) as chars from (select book_id, chapter_id, sum([15, 25, 40, 60, 85][difficulty]) as seconds, count(*) as claims from c group by 1, 2)",
    "claims_bare_sections": _C + "select book_id, chapter_id, section_id, length(text) as chars from s where length(text) >= 400 and not exists (select 1 from c where c.book_id = s.book_id and c.chapter_id = s.chapter_id and c.section = s.section_id)",
    "claims_located_quotes": _C + "select * from loc",
    "claims_merged_passages": _C + """select book_id, chapter_id, section_id, passage_no, min(lo) as start_pos, max(hi) as end_pos, count(*) as claims from (
select *, sum(case when reach is null or lo > reach then 1 else 0 end) over (partition by book_id, chapter_id, section_id order by lo, hi, claim_id) as passage_no from (
select *, max(hi) over (partition by book_id, chapter_id, section_id order by lo, hi, claim_id rows between unbounded preceding and 1 preceding) as reach from (
select *, greatest(0, start_pos - 200) as lo, end_pos + 200 as hi from loc where score > 0))) group by 1, 2, 3, 4""",
    "claims_coverage_sets": _C + """, t as (select distinct book_id, episode_id as chapter_id, revision, unnest(covers) as claim_id from script_lines), ep as (select distinct book_id, episode_id as chapter_id, revision from script_lines)
select ep.book_id, ep.chapter_id, ep.revision, (select count(distinct claim_id) from c where c.book_id = ep.book_id and c.chapter_id = ep.chapter_id) as planned,
(select count(*) from t where t.book_id = ep.book_id and t.chapter_id = ep.chapter_id and t.revision = ep.revision) as told,
(select count(*) from t where t.book_id = ep.book_id and t.chapter_id = ep.chapter_id and t.revision = ep.revision and exists (select 1 from c where c.book_id = t.book_id and c.chapter_id = t.chapter_id and c.claim_id = t.claim_id)) as both,
(select count(distinct claim_id) from c where c.book_id = ep.book_id and c.chapter_id = ep.chapter_id and not exists (select 1 from t where t.book_id = c.book_id and t.chapter_id = c.chapter_id and t.revision = ep.revision and t.claim_id = c.claim_id)) as untold
from ep where exists (select 1 from c where c.book_id = ep.book_id and c.chapter_id = ep.chapter_id)""",
    "script_revision_overlap": """with k as (select distinct book_id, episode_id, revision, text from script_lines where text is not null), d as (select book_id, episode_id, min(revision) as lo, max(revision) as hi from k group by 1, 2 having min(revision) < max(revision))
select d.book_id, d.episode_id, count(b.text) as kept, count(*) filter (where b.text is null) as lost from d join k a on a.book_id = d.book_id and a.episode_id = d.episode_id and a.revision = d.lo
left join k b on b.book_id = d.book_id and b.episode_id = d.episode_id and b.revision = d.hi and b.text = a.text group by 1, 2""",
}
