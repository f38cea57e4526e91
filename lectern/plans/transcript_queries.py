"""Queries over times, unknown words and inexact quotes, with SQL where SQL can say it."""

from __future__ import annotations

from lectern.operators import fuzzy as Z
from lectern.operators import planning as P
from lectern.operators import script as S
from lectern.operators import transcript as N
from lectern.plans.script_queries import BASE
from lectern.sources.tables import table


def _lines(spark, folder):
    return S.script_lines(table(spark, folder, "script_lines"))


def _fuzzy(spark, folder):
    claims, sections = P.claims_once(table(spark, folder, "claims")), table(spark, folder, "sections")
    return Z.fuzzy_quotes(P.located_quotes(claims, sections), claims, sections)


QUERIES = {
    "script_line_times": lambda spark, folder: N.line_times(_lines(spark, folder)),
    "script_word_times": lambda spark, folder: N.word_times(_lines(spark, folder)),
    "blocks_spans": lambda spark, folder: N.block_spans(table(spark, folder, "blocks"), _lines(spark, folder)),
    "script_unknown_words": lambda spark, folder: N.unknown_words(_lines(spark, folder), table(spark, folder, "sections"), table(spark, folder, "claims"), table(spark, folder, "lexicon")),
    "script_early_terms": lambda spark, folder: N.early_terms(_lines(spark, folder), table(spark, folder, "claims"), table(spark, folder, "speakers")),
    "claims_fuzzy_quotes": _fuzzy,
}

_TIMES = """, lt0 as (select *, coalesce(length(text), 0) / 15.0 + 0.3 as len from l),
lt1 as (select *, sum(len + pause / 1000) over (partition by book_id, episode_id, revision order by pos, line_id rows unbounded preceding) as upto from lt0),
lt as (select book_id, episode_id, revision, line_id, coalesce(length(text), 0) as n, round(upto - pause / 1000 - len, 3) as start_s, round(upto - pause / 1000, 3) as end_s from lt1)
"""
SQL = {
    "script_line_times": BASE + _TIMES + "select book_id, episode_id, revision, line_id, start_s, end_s from lt",
    "script_word_times": BASE + """, w0 as (select book_id, episode_id, revision, line_id, length(text) / 15.0 as s, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') as ws from l where text is not null),
w1 as (select book_id, episode_id, revision, line_id, s, unnest(ws) as word, generate_subscripts(ws, 1) as word_no from w0),
w2 as (select *, sum(length(word) + 1) over (partition by book_id, episode_id, revision, line_id) as total, sum(length(word) + 1) over (partition by book_id, episode_id, revision, line_id order by word_no) as upto from w1)
select book_id, episode_id, revision, line_id, word_no, word, round(s * 0.05 + s * 0.9 * (upto - length(word) - 1) / total + 1e-7, 3) as start_s, round(s * 0.05 + s * 0.9 * upto / total + 1e-7, 3) as end_s from w2""",
    "blocks_spans": BASE + _TIMES + """, b as (select distinct book_id, episode_id, revision, block_id, line_ids, chars, too_long from blocks), bl as (select book_id, episode_id, revision, block_id, chars, too_long, unnest(list_distinct(line_ids)) as line_id from b)
select *, coalesce(chars = true_chars, false) as chars_agree, coalesce(flag = (true_chars > 3000), false) as flag_agrees from (select book_id, episode_id, revision, block_id, min(start_s) as start_s, max(end_s) as end_s, count(*) as lines, sum(n) as true_chars, any_value(chars) as chars, any_value(too_long) as flag
from bl join lt using (book_id, episode_id, revision, line_id) group by 1, 2, 3, 4)""".replace("select *, coalesce", "select book_id, episode_id, revision, block_id, start_s, end_s, lines, true_chars, coalesce"),
    "script_unknown_words": BASE + """, k as (select distinct book_id, unnest(regexp_extract_all(lower(text), '\\p{L}{5,}')) as word from sections union select distinct book_id, unnest(regexp_extract_all(lower(claim), '\\p{L}{5,}')) from claims union select distinct book_id, unnest(regexp_extract_all(lower(surface), '\\p{L}{5,}')) from lexicon),
u as (select book_id, episode_id, revision, pos, line_id, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}{5,}'))) as word from l)
select book_id, word, arg_min(episode_id, row(episode_id, revision, pos, line_id)) as episode_id, arg_min(line_id, row(episode_id, revision, pos, line_id)) as line_id, count(*) as lines from u where not exists (select 1 from k where k.book_id = u.book_id and k.word = u.word) group by 1, 2""",
    "script_early_terms": BASE + """, tm as (select distinct book_id, chapter_id as episode_id, lower(unnest(regexp_extract_all(claim, '[\\p{Ll},] (\\p{Lu}\\p{Ll}{3,})', 1))) as term from claims),
sd as (select book_id, episode_id, revision, pos, speaker, seg_type, line_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) as term from l),
fi as (select *, row_number() over (partition by book_id, episode_id, revision, term order by pos, line_id) as nth from sd join tm using (book_id, episode_id, term) where term not in (select lower(name) from speakers))
select book_id, episode_id, revision, line_id, term from fi where nth = 1 and seg_type <> 'quiz' and speaker in (select lower(id) from speakers where role = 'skeptic')""",
}
