"""Queries of episode arithmetic, cutting, cues and the whole audit, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import performance as V
from lectern.operators import audit as A
from lectern.operators import copies as K
from lectern.operators import cutting as B
from lectern.operators import episode as E
from lectern.operators import folds as W
from lectern.operators import planning as P
from lectern.operators import review as R
from lectern.operators import script as S
from lectern.operators import sound as D
from lectern.operators import transcript as N
from lectern.plans.planning_queries import _C
from lectern.plans.script_queries import BASE, _rule, _union
from lectern.sources.tables import table


def _lines(spark, folder):
    return S.script_lines(table(spark, folder, "script_lines"))


def _claims(spark, folder):
    return P.claims_once(table(spark, folder, "claims"))


def _units(spark, folder):
    return B.units_of(table(spark, folder, "sections"))


def _minutes(spark, folder):
    return E.episode_minutes(_claims(spark, folder))


def _definitions(spark, folder):
    """The book's lexicon as the definitions of each of its chapters."""
    chapters = table(spark, folder, "claims").select("book_id", "chapter_id").distinct()
    return table(spark, folder, "lexicon").select("book_id", F.col("surface").alias("term")).distinct().join(chapters, "book_id")


def _openings(lines):
    """The first 44 characters of a book's lines as one script, so that openings that are used again are said twice in it."""
    return lines.withColumn("pos", F.xxhash64("episode_id", "revision", "line_id")).withColumn("line_id", F.concat_ws("-", "episode_id", "revision", "line_id")).withColumn("episode_id", F.lit("all")).withColumn("revision", F.lit(0)).withColumn("text", F.substring("text", 1, 44))


def _outline(spark, folder):
    """Equal blocks in the order of relevance, without the least relevant claims, the first claim of each block given twice and one unknown id in each."""
    claims = _claims(spark, folder)
    blocks = P.equal_blocks(claims)
    placed = claims.join(blocks, [*P.CHAPTER, "claim_id"]).where("relevance > 2").selectExpr("book_id", "chapter_id", "block_no", "claim_id", "10 - relevance as a", "claim_no")
    each = placed.selectExpr("book_id", "chapter_id", "block_no", "a * 10000 + claim_no as place", "claim_id")
    again = placed.selectExpr("book_id", "chapter_id", "5 as block_no", "900000 + claim_no as place", "claim_id")
    unknown = placed.selectExpr("book_id", "chapter_id", "block_no", "999999 as place", "'none' as claim_id").distinct()
    return each.unionByName(again).unionByName(unknown)


def _complete(spark, folder):
    lines = S.script_lines(table(spark, folder, "script_lines").repartition(*A.CHAPTER))
    return A.complete(lines, _claims(spark, folder), table(spark, folder, "speakers"), table(spark, folder, "lexicon"), table(spark, folder, "sections"), _definitions(spark, folder).select("book_id", F.col("chapter_id").alias("episode_id"), "term"))


def _names(spark, folder):
    speakers = table(spark, folder, "speakers")
    raws = _lines(spark, folder).select("speaker").distinct().select(F.col("speaker").alias("raw")).unionByName(speakers.select(F.upper("name").alias("raw"))).unionByName(speakers.select(F.concat("id", F.lit("x")).alias("raw")))
    return E.resolved_speakers(raws.distinct(), speakers)


def _guests(spark, folder):
    wanted = table(spark, folder, "books").select("book_id", F.lower(F.split_part("title", F.lit(" "), F.lit(1))).alias("domain")).distinct()
    return E.picked_guests(wanted.unionByName(table(spark, folder, "speakers").select(F.col("id").alias("book_id"), F.explode("domains").alias("domain"))), table(spark, folder, "speakers"))


def _misconceptions(spark, folder):
    claims = _claims(spark, folder)
    hard = claims.where("difficulty >= 4").select(*P.CHAPTER, F.col("claim_no").alias("no"), F.col("claim").alias("text")).where("text is not null")
    return E.misconception_blocks(hard, claims.where("claim is not null"), P.equal_blocks(claims))


QUERIES = {
    "claims_episode_minutes": lambda spark, folder: _minutes(spark, folder),
    "claims_episode_shape": lambda spark, folder: E.episode_shape(_claims(spark, folder), _minutes(spark, folder), moments=1),
    "claims_outline_repaired": lambda spark, folder: E.outline_repaired(_claims(spark, folder), _outline(spark, folder)),
    "claims_definition_blocks": lambda spark, folder: E.definition_blocks(_definitions(spark, folder), _claims(spark, folder).where("claim is not null"), P.equal_blocks(_claims(spark, folder))),
    "claims_misconception_blocks": _misconceptions,
    "script_flat_segments": lambda spark, folder: E.flat_segments(_lines(spark, folder)),
    "script_covers_resolved": lambda spark, folder: E.covers_resolved(_lines(spark, folder), _claims(spark, folder)),
    "script_segment_speakers": lambda spark, folder: E.segment_speakers(_lines(spark, folder), table(spark, folder, "speakers")),
    "script_performance": lambda spark, folder: E.line_performance(_lines(spark, folder)),
    "script_phrase_plan": lambda spark, folder: E.phrase_plan(table(spark, folder, "script_lines")),
    "script_scene_coverage": lambda spark, folder: E.scene_coverage(table(spark, folder, "script_lines")),
    "script_reaction_coverage": lambda spark, folder: E.reaction_coverage(table(spark, folder, "script_lines"), table(spark, folder, "speakers")),
    "script_previews": lambda spark, folder: R.previews(_lines(spark, folder), table(spark, folder, "speakers")),
    "script_rewrite_decision": lambda spark, folder: E.rewrite_decision(S.audit(_lines(spark, folder), table(spark, folder, "claims"), table(spark, folder, "speakers")), quality=True),
    "script_routed_findings": lambda spark, folder: E.routed_findings(S.coverage_rules(_lines(spark, folder), table(spark, folder, "claims")).unionByName(S.budget_rules(S.episode_stats(_lines(spark, folder), table(spark, folder, "speakers")))), _lines(spark, folder)),
    "script_overlap_over_terms": lambda spark, folder: S.overlap_over_terms(_lines(spark, folder).withColumn("mode", F.lit("backchannel")), table(spark, folder, "lexicon")),
    "script_near_duplicate_rule": lambda spark, folder: W.near_duplicate_lines(_lines(spark, folder)),
    "script_source_copy": lambda spark, folder: K.source_copy(_lines(spark, folder), _claims(spark, folder)),
    "script_unknown_by_episode": lambda spark, folder: N.unknown_words_by_episode(_lines(spark, folder), A.vocabulary(table(spark, folder, "sections"), table(spark, folder, "claims"), table(spark, folder, "lexicon"))),
    "script_complete_audit": lambda spark, folder: _complete(spark, folder).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("findings")),
    "script_repeated_starts": lambda spark, folder: S.duplicate_lines(_openings(_lines(spark, folder))).groupBy("book_id", "rule").agg(F.count(F.lit(1)).alias("findings")),
    "script_frame_of_bodies": lambda spark, folder: S.frame_rules(_lines(spark, folder).where("seg_type = 'body'")),
    "script_cast_of_hosts": lambda spark, folder: S.cast_rules(_lines(spark, folder), table(spark, folder, "speakers").where("id <> 'wende'").withColumn("kind", F.lit("guest"))),
    "script_formula_across_books": lambda spark, folder: S.formula_rules(_lines(spark, folder).withColumn("text", F.regexp_replace(F.lower("text"), "\\b(het|de) ", "er staat "))),
    "script_names_resolved": _names,
    "books_picked_guests": _guests,
    "units_body_sizes": lambda spark, folder: B.body_sizes(_units(spark, folder)),
    "units_headings": lambda spark, folder: B.headings(_units(spark, folder)).groupBy("book_id", "level").agg(F.count(F.lit(1)).alias("headings"), F.sum("span").alias("units")),
    "units_sections": lambda spark, folder: B.book_sections(_units(spark, folder), table(spark, folder, "books").select("book_id", "title")).drop("text"),
    "sections_parts": lambda spark, folder: E.section_parts(table(spark, folder, "sections")).select("book_id", "section_id", "part_no", "parts", F.length("text").alias("chars"), F.md5("text").alias("digest")),
    "chapters_readings": lambda spark, folder: E.chapter_parts(table(spark, folder, "sections")),
    "clips_band_corrections": lambda spark, folder: D.band_corrections(table(spark, folder, "embeddings"), "label", "embedding", F.lit(16000)),
    "script_breath_places": lambda spark, folder: D.breath_places(W.timeline(W.script_turns(_lines(spark, folder))), S.EPISODE, F.least(F.lit(0.9), 0.65 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("end_s") - F.col("start_s") - 2.0) / 3.0)))),
    "books_slugs": lambda spark, folder: E.slugs(table(spark, folder, "books").select("book_id", "title").dropDuplicates(["book_id"]), "title", "book_id"),
}

_FRACTION = "(('0x' || substr(sha256({key}), 1, 16))::ubigint / 18446744073709551616.0)"
_NEED = _C + """, g as (select book_id, chapter_id, claim_id from (select *, row_number() over (partition by book_id, chapter_id order by difficulty desc, claim_no, claim_id) as nth from n) where nth <= greatest(1, least(4, n // 3))),
k as (select c.book_id, c.chapter_id, count(*) as claims, sum(s) as all_s, coalesce(sum(case when g.claim_id is not null then s end), 0) as guest_s, max(difficulty) as hardest
 from (select *, case difficulty when 1 then 15.0 when 2 then 25.0 when 3 then 40.0 when 4 then 60.0 else 85.0 end as s from c) c left join g using (book_id, chapter_id, claim_id) group by 1, 2),
nd as (select *, all_s + 45.0 * least(2, greatest(3, least(5, round_even(claims / 4, 0)))) + case when hardest >= 4 then 120 else 0 end as need from k),
le as (select *, ceil((need + 195) / 60) as l2, ceil((need + 245) / 60) as l3, ceil((need + 295) / 60) as l4 from nd),
mi as (select *, cast(greatest(6, least(30, case when l2 < 10 then l2 when l3 < 18 then l3 else l4 end)) as int) as minutes from le)
"""


def _map(column: str, table_: dict, otherwise: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in table_.items()) + f" else {otherwise} end"


SQL = {
    "claims_episode_minutes": _NEED + "select book_id, chapter_id, minutes from mi",
    "claims_episode_shape": _NEED + """, sq as (select *, case when minutes < 10 then 2 when minutes < 18 then 3 else 4 end as questions, minutes >= 15 as g, hardest >= 4 as s from mi),
sr as (select *, minutes * 60.0 - 95 - 50 * questions as room, guest_s * 1.3 + 40 as gc from sq),
sa as (select *, s and not (room - case when g then gc else 0 end - 120 < 0.9 * (all_s - case when g then guest_s else 0 end + 45)) as ws from sr),
sb as (select *, g and not (room - gc - case when ws then 120 else 0 end < 0.9 * (all_s - guest_s + 45)) as wg from sa)
select book_id, chapter_id, minutes, questions, greatest(180.0, room - case when wg then gc else 0 end - case when ws then 120 else 0 end) as body_s, 50.0 * questions as quiz_s, 0.0 as recap_s, case when wg then gc else 0.0 end as guest_s, case when ws then 120.0 else 0.0 end as reexplain_s from sb""",
    "claims_outline_repaired": _C + """, o0 as (select book_id, chapter_id, block_no, claim_id, 10 - relevance as a, claim_no from e where relevance > 2),
o as (select book_id, chapter_id, block_no, (a * 10000 + claim_no) as place, claim_id, claim_no from o0),
k as (select c.book_id, c.chapter_id, c.claim_id, c.claim_no, o.block_no, o.place, o.claim_id is null as forgotten, f.first_block from c join (select book_id, chapter_id, min(block_no) as first_block from o group by 1, 2) f using (book_id, chapter_id) left join o using (book_id, chapter_id, claim_id)),
h as (select *, last_value(case when not forgotten then block_no end ignore nulls) over w as hb, last_value(case when not forgotten then place end ignore nulls) over w as hp from k window w as (partition by book_id, chapter_id order by claim_no, claim_id rows unbounded preceding)),
p as (select *, coalesce(hb, first_block) as b, coalesce(hp, -1) as after from h)
select book_id, chapter_id, b as block_no, row_number() over (partition by book_id, chapter_id, b order by after, forgotten, claim_no, claim_id) as place, claim_id, forgotten from p""",
    "claims_definition_blocks": _C + """, d as (select distinct book_id, k.chapter_id, lower(trim(surface)) as term from lexicon join (select distinct book_id, chapter_id from claims) k using (book_id) where trim(surface) <> ''),
t as (select book_id, chapter_id, claim_id, any_value(lower(claim)) as claim from claims where claim is not null group by 1, 2, 3)
select book_id, chapter_id, term, min(block_no) as block_no from d join t using (book_id, chapter_id) join e using (book_id, chapter_id, claim_id) where contains(t.claim, term) group by 1, 2, 3""",
    "script_flat_segments": BASE + """select * from (select *, row_number() over (partition by book_id, episode_id, revision order by "overlaps", "lines" desc, seg_no) as place from (select book_id, episode_id, revision, seg_no, count(*) filter (mode <> 'none') as "overlaps", count(*) as "lines" from l where seg_type = 'body' group by 1, 2, 3, 4)) where place <= 3""",
    "script_previews": BASE + """, f as (select *, row_number() over (partition by book_id, episode_id, revision, seg_no order by pos, line_id) as place from l)
select book_id, episode_id, revision, seg_no, place, coalesce(name, speaker) as speaker_name, case when length(text) > 220 then substr(text, 1, 217) || '...' else text end as preview from f left join (select lower(id) as speaker, name from speakers) s using (speaker) where place <= 3""",
    "script_covers_resolved": BASE + """, x as (select book_id, episode_id, revision, line_id, unnest(list_distinct(covers)) as cover from l),
y as (select *, case when contains(cover, ':') then split_part(cover, ':', 1) else episode_id end as chapter_id, case when contains(cover, ':') then split_part(cover, ':', 2) else cover end as claim_id from x)
select y.book_id, y.episode_id, revision, line_id, cover, y.chapter_id, y.claim_id, k.claim_id is not null as known from y left join (select distinct book_id, chapter_id, claim_id from claims) k on y.book_id = k.book_id and y.chapter_id = k.chapter_id and y.claim_id = k.claim_id""",
    "script_segment_speakers": BASE + "select distinct book_id, episode_id, revision, seg_no, case when seg_type = 'guest' then (select count(*) from speakers) else (select count(*) from speakers where kind = 'host') end as allowed from l",
    "script_phrase_plan": f"""with o as (select distinct book_id, episode_id, revision, line_id, text, delivery, phrases from script_lines),
p as (select book_id, episode_id, revision, line_id, delivery, unnest(case when len(phrases) > 0 then phrases else [{{'text': text, 'delivery': delivery, 'pause_after': 'none'}}] end) as p, generate_subscripts(case when len(phrases) > 0 then phrases else [{{'text': text, 'delivery': delivery, 'pause_after': 'none'}}] end, 1) - 1 as phrase_no from o),
q as (select *, len(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(p.text, ''), '[(\\[*]\\s*([^()\\[\\]*]{{1,40}}?)\\s*[)\\]*]', ' ', 'g'), '[\\s\\p{{Z}}]+([,.!?…])', '\\1', 'g'), '\\s*(—|…|-|\\.\\.\\.)\\s*$', '')), '[\\s\\p{{Z}}]+'), lambda w: w <> '')) as words, coalesce(p.delivery, delivery) as d, coalesce(p.pause_after, 'none') as pa from p)
select book_id, episode_id, revision, line_id, phrase_no, words, {_map("d", V.DELIVERY_RATE, "1.0")} as rate, round({_map("pa", {k: v[0] for k, v in V.PHRASE_PAUSE.items()}, "0.0")} + ({_map("pa", {k: v[1] - v[0] for k, v in V.PHRASE_PAUSE.items()}, "0.0")}) * {_FRACTION.format(key="'7|' || line_id || '|' || phrase_no || '|pause'")}, 6) as pause_s from q where words > 0""",
    "script_scene_coverage": f"""with o as (select distinct book_id, episode_id, revision, line_id, delivery, mood, timing, reaction, overlap.mode as mode, phrases from script_lines)
select book_id, episode_id, revision, count(delivery) > 0 as delivery, count(mood) > 0 as mood, count(timing) > 0 as timing, count(reaction) > 0 as reaction, count(*) filter (mode = 'interrupt') > 0 as interrupt, count(*) filter (mode = 'backchannel') > 0 as backchannel, count(*) filter (len(phrases) > 1) > 0 as phrases, count(distinct round_even({_map("delivery", V.DELIVERY_RATE, "1.0")}, 3)) >= 3 as three_rates from o group by 1, 2, 3""",
    "script_reaction_coverage": """with o as (select distinct book_id, episode_id, revision, line_id, lower(trim(speaker)) as speaker, reaction from script_lines),
n as (select speaker, count(*) filter (reaction = 'laugh') as laugh, count(*) filter (reaction = 'chuckle') as chuckle, count(*) filter (reaction = 'sigh') as sigh, count(*) filter (reaction = 'hm') as hm from o group by 1)
select s.speaker, coalesce(laugh, 0) as laugh, coalesce(chuckle, 0) as chuckle, coalesce(sigh, 0) as sigh, coalesce(hm, 0) as hm from (select distinct lower(id) as speaker from speakers) s left join n using (speaker)""",
    "script_overlap_over_terms": BASE + """, k as (select distinct book_id, lower(trim(surface)) as term from lexicon where kind in ('loanword_en', 'notation', 'loanword') and length(trim(surface)) > 1)
select distinct book_id, episode_id, revision, 'overlap_over_content' as rule, 'blocking' as severity, line_id, cast(null as varchar) as claim_id from p join k using (book_id) where prev_text is not null and contains(lower(prev_text), term) and regexp_matches(lower(prev_text), '(^|[^\\p{L}\\p{N}_])' || regexp_escape(term) || '($|[^\\p{L}\\p{N}_])')""",
    "script_repeated_starts": BASE + """, r as (select book_id, regexp_replace(lower(trim(regexp_replace(substr(text, 1, 44), '[\\s\\p{Z}]+', ' ', 'g'))), '[^\\p{L}\\p{N}_ ]', '', 'g') as key from l where seg_type not in ('quiz', 'recap'))
select book_id, 'duplicate_line' as rule, cast(sum(n - 1) as bigint) as findings from (select book_id, key, count(*) as n from r where length(key) >= 40 group by 1, 2) where n > 1 group by 1""",
    "script_frame_of_bodies": _union(*[f"select book_id, episode_id, revision, '{r}' as rule, 'warning' as severity, cast(null as varchar) as line_id, cast(null as varchar) as claim_id from (select distinct book_id, episode_id, revision from l where seg_type = 'body')" for r in ("no_cold_open", "no_outro")]),
    "script_cast_of_hosts": _union(_rule("unknown_speaker", "blocking", "l where speaker is null or speaker not in (select lower(id) from speakers where id <> 'wende')"), _rule("guest_outside_guest_segment", "blocking", "l where seg_type <> 'guest' and speaker in (select lower(id) from speakers where id <> 'wende')")),
    "script_formula_across_books": BASE + """, e as (select * exclude (text), regexp_replace(lower(text), '\\b(het|de) ', 'er staat ', 'g') as text from l),
h as (select *, count(*) over (partition by book_id, episode_id, revision) as n, row_number() over (partition by book_id, episode_id, revision, seg_no order by pos) as nth from e where regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(in de tekst|de tekst|de bron|volgens de bron|het boek|er staat|staat er)([^\\p{L}\\p{N}_]|$)')),
k as (select *, count(*) over (partition by book_id, episode_id, revision) as n, row_number() over (partition by book_id, episode_id, revision, seg_no order by pos) as nth from e where len(list_filter(regexp_split_to_array(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: regexp_matches(s, '(?i)(^|[^\\p{L}\\p{N}_])(is|zijn|blijft|blijven)\\s+(nog\\s+)?geen([^\\p{L}\\p{N}_]|$)') and len(regexp_split_to_array(s, '\\s+')) <= 9)) > 0)
""" + _rule("source_talk", "blocking", "h where n > 2 and nth = 1") + " union all " + _rule("stock_phrase", "blocking", "k where n > 3 and nth = 1"),
    "units_body_sizes": "select distinct book_id, 10.0 as body from sections",
}
