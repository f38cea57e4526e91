"""Queries over section texts, the lexicon, samples and takes, each with independent SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import lexicon as L
from lectern.operators import matching as M
from lectern.operators import script as S
from lectern.operators import signal as G
from lectern.operators import structure as D
from lectern.sources.tables import table


def _sections(operator):
    return lambda spark, folder: operator(table(spark, folder, "sections"))


def _clips(operator):
    return lambda spark, folder: operator(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))


def _takes(spark, folder):
    li = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("turn"), F.col("l_linenumber").alias("take")).agg(F.min("l_discount").alias("wer"), F.min("l_quantity").alias("duration"))
    return li.withColumn("target", F.lit(25.0))


def _hashes(spark, folder):
    lines = S.script_lines(table(spark, folder, "script_lines")).where("text is not null")
    key = F.sha2(F.concat_ws("|", "speaker", "text", F.format_string("%.3f", F.col("pause_after_ms") / 1000)), 256)
    return lines.select(*S.EPISODE, "line_id", key.alias("content_key"), F.round(X.seeded_fraction(F.col("episode_id"), F.col("line_id")), 9).alias("fraction"))


def _applied(spark, folder):
    lines = S.script_lines(table(spark, folder, "script_lines")).select(*S.EPISODE, "line_id", "text")
    return L.applied(lines, L.merged(table(spark, folder, "lexicon"))).select(*S.EPISODE, "line_id", "spoken", (~F.col("spoken").eqNullSafe(F.col("text"))).alias("changed"))


def _upsert(spark, folder):
    raw = table(spark, folder, "lexicon")
    return L.upsert(L.merged(raw.where("source_chapter is null or source_chapter < 'ch05'")), L.merged(raw.where("source_chapter >= 'ch05'")))


QUERIES = {
    "sections_paragraphs": _sections(lambda s: D.paragraphs(s).groupBy("book_id", "section_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.max(F.length("para")).alias("longest"))),
    "sections_rejoined": _sections(lambda s: D.rejoined(D.paragraphs(s)).select("book_id", "section_id", "para_no", "parts", F.length("para").alias("chars"))),
    "sections_cleaned": _sections(lambda s: D.cleaned(D.paragraphs(s))),
    "sections_heading_like": _sections(lambda s: D.heading_like(D.lines(s))),
    "sections_running_lines": _sections(lambda s: D.running_lines(D.lines(s), 0.1)),
    "sections_joined_lines": _sections(lambda s: D.joined_lines(D.paragraphs(s)).select("book_id", "section_id", "para_no", F.md5("para").alias("digest"))),
    "sections_profile": _sections(D.section_profile),
    "chapters_profile": _sections(D.chapter_profile),
    "books_well_cut": _sections(lambda s: D.well_cut_books(D.chapter_profile(s))),
    "lexicon_merged": lambda spark, folder: L.merged(table(spark, folder, "lexicon")),
    "lexicon_in_order": lambda spark, folder: L.in_order(L.merged(table(spark, folder, "lexicon"))),
    "lexicon_upsert": _upsert,
    "lexicon_applied": _applied,
    "lexicon_candidates": _sections(lambda s: L.candidates(D.texts_once(s)).groupBy("kind", "form").agg(F.count(F.lit(1)).alias("sections"))),
    "script_content_keys": _hashes,
    "script_near_duplicates": lambda spark, folder: M.near_duplicate_digests(table(spark, folder, "script_lines"), [*S.EPISODE, "line_id"]),
    "script_revision_word_errors": lambda spark, folder: M.revision_word_errors(S.script_lines(table(spark, folder, "script_lines")).where("text is not null")),
    "takes_chosen": lambda spark, folder: M.chosen_takes(_takes(spark, folder)),
    "clips_levels": _clips(G.clip_levels),
    "clips_frame_levels": _clips(G.frame_levels),
    "clips_pauses": _clips(lambda c: G.pauses(G.frame_levels(c))),
    "clips_labelled_levels": _clips(G.labelled_levels),
    "speakers_reactions": lambda spark, folder: S.script_lines(table(spark, folder, "script_lines")).groupBy("speaker").agg(*[F.count_if(F.col("reaction") == r).alias(f"r_{r}") for r in ("hm", "laugh", "sigh")], F.count_if(F.col("reaction").isNull()).alias("r_none")),
}

_S = """with s as (select distinct book_id, section_id, chapter_id, text from sections where text is not null),
ln as (select book_id, section_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from s),
pa as (select book_id, section_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '') as ps from s),
p as (select book_id, section_id, unnest(ps) as para, generate_subscripts(ps, 1) - 1 as para_no from pa),
lx as (select distinct *, lower(trim(surface)) as key from lexicon),
mg as (select book_id, key, trim(surface) as surface, spoken, coalesce(lock, false) as locked from (select *, row_number() over (partition by book_id, key order by coalesce(lock, false) desc, source_chapter is null, source_chapter, spoken, surface) as nth from lx where key <> '') where nth = 1),
sl as (select distinct book_id, episode_id, revision, line_id, lower(trim(speaker)) as speaker, text, coalesce(pause_after_ms, 0) as pause, reaction from script_lines)
"""
_DB = "20 * log10(sqrt(list_sum(list_transform({x}, lambda v: v::double * v::double)) / len({x})) + 1e-9)"
_FRAMES = "fr as (select vec_id, label, embedding, unnest(list_transform(range(0, (len(embedding) - 1) // 8 + 1), lambda k: embedding[k * 8 + 1 : k * 8 + 8])) as x, unnest(range(0, (len(embedding) - 1) // 8 + 1)) as frame from embeddings), fd as (select vec_id, frame, " + _DB.format(x="x") + " as raw, " + _DB.format(x="embedding") + " as mean_db from fr), fl as (select vec_id, frame, round(raw, 4) as db, raw < mean_db - 6 as quiet from fd)"
_WORDS_NL, _WORDS_EN = ", ".join(f"'{w}'" for w in X.DUTCH_WORDS), ", ".join(f"'{w}'" for w in X.ENGLISH_WORDS)
_MG = "select book_id, key, spoken, coalesce(lock, false) as locked from (select *, row_number() over (partition by book_id, key order by coalesce(lock, false) desc, source_chapter is null, source_chapter, spoken, surface) as nth from lx where key <> '' and {}) where nth = 1"

SQL = {
    "sections_paragraphs": _S + "select book_id, section_id, count(*) as paragraphs, max(length(para)) as longest from p group by 1, 2",
    "sections_rejoined": _S + """, m as (select *, lag(para) over (partition by book_id, section_id order by para_no) as b from p),
i as (select *, sum(case when b is not null and not starts_with(b, '[') and not starts_with(para, '[') and not regexp_matches(b, '[.!?:;’''”\\])]\\s*$') and regexp_matches(para, '^\\s*[a-zà-ÿ]') then 0 else 1 end) over (partition by book_id, section_id order by para_no) as island from m)
select book_id, section_id, island as para_no, count(*) as parts, sum(length(para)) + count(*) - 1 as chars from i group by 1, 2, 3""",
    "sections_profile": _S + f"""select book_id, section_id, length(text) as chars, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) as words, density, density >= 0.02 as dense,
case when len(list_filter(tk, lambda t: t in ({_WORDS_EN}))) > 1.5 * len(list_filter(tk, lambda t: t in ({_WORDS_NL}))) then 'en' else 'nl' end as guess, len(regexp_extract_all(text, '[0-9]+([.,][0-9]+)?')) as numbers from (
select *, regexp_extract_all(lower(text), '[a-z]+') as tk, case when length(text) > 0 then round_even((length(text) - length(translate(text, '{X.MATH_CHARS}', '')) + 0.25 * len(regexp_extract_all(text, '\\p{{Nd}}'))) / length(text), 4) else 0.0 end as density from s)""",
    "chapters_profile": """select *, lag(chapter_id) over w as before, lead(chapter_id) over w as after from (select book_id, chapter_id, count(*) as sections, coalesce(sum(length(text)), 0) as chars, min(page_lo) as page_lo, max(page_hi) as page_hi
from (select distinct book_id, chapter_id, section_id, text, page_lo, page_hi from sections) group by 1, 2) window w as (partition by book_id order by chapter_id)""",
    "books_well_cut": "select *, chapters between 2 and 120 and median_chars >= 600 as well_cut from (select book_id, count(*) as chapters, median(chars) as median_chars from (select book_id, chapter_id, coalesce(sum(length(text)), 0) as chars from (select distinct book_id, chapter_id, section_id, text from sections) group by 1, 2) group by 1)",
    "sections_running_lines": _S + "select book_id, key, in_sections from (select book_id, regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g') as key, count(distinct section_id) as in_sections from ln where trim(line) <> '' and length(line) <= 80 group by 1, 2) join (select book_id, count(distinct section_id) as n from ln group by 1) using (book_id) where in_sections >= 2 and in_sections >= 0.1 * n",
    "sections_joined_lines": _S + "select book_id, section_id, para_no, md5(regexp_replace(regexp_replace(para, '(\\p{L})-\\n(\\p{Ll})', '\\1\\2', 'g'), '\\s*\\n\\s*', ' ', 'g')) as digest from p",
    "sections_cleaned": _S + f""", k as (select *, case when regexp_matches(para, '{D.FILL_IN}') then 'fill_in' when regexp_matches(para, '{D.FOOTNOTE}') then 'footnote' when length(para) <= 80 and regexp_matches(trim(para), '{D.EXERCISE.replace("'", "''")}') then 'exercise'
when length(para) <= 40 and regexp_matches(trim(para), '{D.REFERENCES}') then 'references' when regexp_matches(trim(para), '{D.CAPTION}') then 'caption' else 'kept' end as kind from p)
select book_id, section_id, """ + ", ".join(f"count(*) filter (where kind = '{x}') as {x if x != 'references' else chr(34) + x + chr(34)}" for x in ("fill_in", "footnote", "exercise", "references", "caption", "kept")) + ", coalesce(sum(length(para)) filter (where kind = 'kept'), 0) as kept_chars from k group by 1, 2",
    "sections_heading_like": _S + f"""select book_id, section_id, line_no, coalesce(nullif(trim(regexp_replace(t, '{D.NUMBERING}', '')), ''), t) as heading from (select *, trim(line) as t from ln)
where t <> '' and length(t) <= 120 and len(regexp_split_to_array(t, '\\s+')) <= 14 and not regexp_matches(t, '^[0-9.\\s]+$') and not regexp_matches(t, '[,;:]$') and (not ends_with(t, '.') or regexp_matches(t, '{D.NUMBERING}'))""",
    "lexicon_merged": _S + "select * from mg",
    "lexicon_in_order": _S + "select book_id, key, row_number() over (partition by book_id order by length(surface) desc, key) as place from mg",
    "lexicon_upsert": _S + ", o as (" + _MG.format("(source_chapter is null or source_chapter < 'ch05')") + "), n as (" + _MG.format("source_chapter >= 'ch05'") + """)
select book_id, key, case when change <> 'kept' then ns else os end as spoken, case when change <> 'kept' then nl else ol end as locked, change from (
select book_id, key, o.spoken as os, o.locked as ol, n.spoken as ns, n.locked as nl, case when o.spoken is null then 'inserted' when not o.locked and n.locked and o.spoken <> n.spoken then 'overwritten' else 'kept' end as change from o full join n using (book_id, key))""",
    "lexicon_candidates": _S + "select kind, form, count(*) as sections from (" + " union all ".join(f"select '{k}' as kind, unnest(list_filter(x, lambda v, i: list_position(x, v) = i)[1:60]) as form from (select regexp_extract_all(text, '{p}', 1) as x from s)" for k, p in L.CANDIDATES.items()) + ") group by 1, 2",
    "script_content_keys": _S + "select book_id, episode_id, revision, line_id, sha256(speaker || '|' || text || '|' || printf('%.3f', pause / 1000)) as content_key, round(('0x' || left(sha256(episode_id || '|' || line_id), 16))::ubigint / 18446744073709551616.0, 9) as fraction from sl where text is not null",
    "script_near_duplicates": _S + """, k as (select trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_ ]', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) as key, count(*) as copies from sl where text is not null group by 1),
w as (select key, string_split(key, ' ') as w from k where key <> ''), h as (select distinct key, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) as sh from w where len(w) >= 5),
n as (select key, count(*) as n from h group by 1), c as (select a.key as k1, b.key as k2, count(*) as shared from h a join h b on a.sh = b.sh and a.key <> b.key group by 1, 2),
l as (select k1, count(*) as links from c join n x on x.key = k1 join n y on y.key = k2 where shared >= 0.8 * (x.n + y.n - shared) - 1e-9 group by 1)
select md5(key) as key, copies, coalesce(links, 0) as links from k left join l on k1 = key where key <> ''""",
    "takes_chosen": "select turn, coalesce(good, least_take) as take, good is null as flagged, takes from (select l_orderkey as turn, arg_min(l_linenumber, row(abs(d - 25.0), l_linenumber)) filter (where w <= 0.05) as good, arg_min(l_linenumber, row(w, l_linenumber)) as least_take, count(*) as takes from (select l_orderkey, l_linenumber, min(l_discount) as w, min(l_quantity) as d from lineitem group by 1, 2) group by 1)",
    "clips_levels": "select vec_id, round(db, 4) as rms_db, round(list_max(list_transform(embedding, lambda v: abs(v::double))), 6) as peak, round(greatest(-30, least(30, -20 - db)), 4) as gain_db from (select *, " + _DB.format(x="embedding") + " as db from embeddings)",
    "clips_frame_levels": "with " + _FRAMES + " select * from fl",
    "clips_pauses": "with " + _FRAMES + " select vec_id, min(frame) as first_frame, count(*) as frames from (select *, frame - row_number() over (partition by vec_id order by frame) as island from fl where quiet) group by vec_id, island",
    "speakers_reactions": _S + "select speaker, count(*) filter (where reaction = 'hm') as r_hm, count(*) filter (where reaction = 'laugh') as r_laugh, count(*) filter (where reaction = 'sigh') as r_sigh, count(*) filter (where reaction is null) as r_none from sl group by 1",
}
