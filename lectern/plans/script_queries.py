"""Queries over dialogue scripts, each with independent SQL; those of the named patterns and the full audit have none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.operators import script as S
from lectern.sources.tables import table


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return S.script_lines(table(spark, folder, "script_lines"))


def _on_lines(rule: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: rule(_lines(spark, folder))


def _with_cast(rule: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: rule(_lines(spark, folder), table(spark, folder, "speakers"))


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    return S.audit(_lines(spark, folder), table(spark, folder, "claims"), table(spark, folder, "speakers"))


def _full_audit(spark: SparkSession, folder: str) -> DataFrame:
    return S.full_audit(_lines(spark, folder), table(spark, folder, "claims"), table(spark, folder, "speakers"))


QUERIES = {
    "script_duplicate_lines": _on_lines(S.duplicate_lines),
    "script_frame_rules": _on_lines(S.frame_rules),
    "script_cast_rules": _with_cast(S.cast_rules),
    "script_overlap_rules": _on_lines(S.overlap_rules),
    "script_coverage_rules": lambda spark, folder: S.coverage_rules(_lines(spark, folder), table(spark, folder, "claims")),
    "script_phrase_rule": _on_lines(S.phrase_rule),
    "script_tic_leak": _with_cast(S.tic_leak),
    "script_tic_overuse": _with_cast(S.tic_overuse),
    "script_repeated_opening": _on_lines(S.repeated_opening),
    "script_formula_rules": _on_lines(S.formula_rules),
    "script_retelling_rules": _with_cast(S.retelling_rules),
    "script_speakable_rules": _on_lines(S.speakable_rules),
    "script_telegraphic": _on_lines(S.telegraphic),
    "script_episode_stats": lambda spark, folder: S.episode_stats(_lines(spark, folder), table(spark, folder, "speakers")),
    "script_budget_rules": lambda spark, folder: S.budget_rules(S.episode_stats(_lines(spark, folder), table(spark, folder, "speakers"))),
    "script_flat_reaction": _on_lines(S.flat_reaction),
    "script_audit_verdicts": lambda spark, folder: S.verdicts(_audit(spark, folder)),
    "script_audit_by_rule": lambda spark, folder: _audit(spark, folder).groupBy("rule", "severity").count().withColumnRenamed("count", "findings"),
    "script_best_revision": lambda spark, folder: S.best_revision(_audit(spark, folder)),
    "script_pattern_rules": _on_lines(S.pattern_rules),
    "script_full_audit_verdicts": lambda spark, folder: S.verdicts(_full_audit(spark, folder)),
    "script_full_audit_by_rule": lambda spark, folder: _full_audit(spark, folder).groupBy("rule", "severity").count().withColumnRenamed("count", "findings"),
    "script_full_best_revision": lambda spark, folder: S.best_revision(_full_audit(spark, folder)),
    "script_turns": _on_lines(S.turns),
    "script_renumbered": _on_lines(S.renumbered),
    "script_latest_revision": lambda spark, folder: S.latest_revision(_lines(spark, folder)).select(*S.EPISODE, "line_id", "speaker", "pos"),
}

BASE = """
with l as (select distinct book_id, episode_id, revision, seg_no, seg_type, line_no, pos, line_id, lower(trim(speaker)) as speaker, text,
  coalesce(pause_after_ms, 0) as pause, target_minutes, coalesce(overlap.mode, 'none') as mode, overlap.target as target,
  overlap.cut_word as cut_word, coalesce(covers, []) as covers, coalesce(tags, []) as tags from script_lines),
p as (select *, lag(line_id) over w as prev_id, lag(speaker) over w as prev_speaker, lag(text) over w as prev_text, lag(seg_no) over w as prev_seg,
  lag(tags) over w as prev_tags, lag(mode) over w as prev_mode, lag(pause) over w as prev_pause
  from l window w as (partition by book_id, episode_id, revision order by pos, line_id)),
c as (select distinct book_id, chapter_id as episode_id, claim_id, exam_relevance from claims),
t as (select book_id, episode_id, revision, pos, seg_no, seg_type, speaker, line_id, unnest(list_distinct(covers)) as claim_id from l),
m as (select distinct lower(id) as owner, lower(unnest(tic_markers)) as marker from speakers)
"""


def _rule(name: str, severity: str, source: str, line: str = "line_id", claim: str = "null") -> str:
    return f"select book_id, episode_id, revision, '{name}' as rule, '{severity}' as severity, cast({line} as varchar) as line_id, cast({claim} as varchar) as claim_id from {source}"


def _union(*parts: str) -> str:
    return BASE + " union all ".join(parts)


_W = "[^\\p{L}\\p{N}_]"
_COUNT = "len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))"
_KEYED = f"(select *, regexp_replace(lower(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'))), '[^\\p{{L}}\\p{{N}}_ ]', '', 'g') as key from l where seg_type not in ('quiz', 'recap'))"
_PHRASE_LIST = ", ".join(f"('{p}')" for p in S.PHRASES)
_RETELL = ", ".join(f"'{x}'" for x in S.RETELLING)
_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(regexp_extract_all(s, '[\\p{L}\\p{N}_]+'))), lambda n: n > 0)"
_STATS = """(select *, case when in_seg is null then false else true end as has_quiz from (
 select book_id, episode_id, revision, count(*) as lines, sum(length(text)) as chars, round((sum(length(text)) / 15.0 + count(*) * 0.3 + sum(pause) / 1000) / 60, 4) as minutes,
 max(target_minutes) as target_minutes, count(*) filter (where mode = 'interrupt') as interrupts, count(*) filter (where mode = 'backchannel') as backchannels, max(quiz_no) as in_seg,
 count(*) filter (where seg_no = quiz_no and contains(text, '?') and speaker = 'tjalk') as quiz_questions, coalesce(max(case when seg_no = quiz_no then pause end), 0) as quiz_pause
 from (select *, min(case when seg_type = 'quiz' then seg_no end) over (partition by book_id, episode_id, revision) as quiz_no from l) group by 1, 2, 3))"""

_FRAME = [
    _rule("no_cold_open", "warning", "(select book_id, episode_id, revision, min_by(seg_type, pos) as s, null as line_id from l group by all) where s <> 'cold_open'"),
    _rule("no_outro", "warning", "(select book_id, episode_id, revision, max_by(seg_type, pos) as s, null as line_id from l group by all) where s <> 'outro'"),
]
_CAST = [
    _rule("unknown_speaker", "blocking", "l where speaker not in (select lower(id) from speakers)"),
    _rule("guest_outside_guest_segment", "blocking", "l join (select distinct lower(id) as sid, kind from speakers) on sid = speaker where kind = 'guest' and seg_type <> 'guest'"),
]
_OVERLAP = [
    "select book_id, episode_id, revision, ladder as rule, 'blocking' as severity, line_id, cast(null as varchar) as claim_id from (select *, case when line_no = 1 then 'overlap_at_segment_start' when target is distinct from prev_id then 'overlap_target' when speaker is not distinct from prev_speaker then 'overlap_same_speaker' end as ladder from p where mode <> 'none') where ladder is not null",
    _rule("interrupt_without_fragment", "blocking", "p where mode = 'interrupt' and prev_text is not null and not regexp_matches(rtrim(prev_text), '(—|…|-|\\.\\.\\.)$')", "prev_id"),
    _rule("cut_word_missing", "warning", "p where mode = 'interrupt' and prev_text is not null and cut_word is not null and instr(lower(prev_text), lower(cut_word)) = 0"),
    _rule("backchannel_too_long", "blocking", f"p where mode = 'backchannel' and {_COUNT} > 8"),
    _rule("overlap_over_content", "blocking", "p where mode <> 'none' and (regexp_matches(prev_text, '[0-9]') or regexp_matches(lower(prev_text), '\\b(is een|zijn een|heet|heten|noemen we|betekent|wil zeggen)\\b'))"),
]
_COVERAGE = [
    _rule("missing_claim", "blocking", "(select distinct book_id, episode_id, revision from l) e join c using (book_id, episode_id) where exam_relevance >= 3 and not exists (select 1 from t where t.book_id = e.book_id and t.episode_id = e.episode_id and t.revision = e.revision and t.claim_id = c.claim_id)", "null", "c.claim_id"),
    _rule("unknown_claim", "warning", "(select book_id, episode_id, revision, line_id, unnest(covers) as claim_id from l) u where not contains(claim_id, ':') and not exists (select 1 from c where c.book_id = u.book_id and c.episode_id = u.episode_id and c.claim_id = u.claim_id)", "line_id", "claim_id"),
]
_PHRASE = [_rule("banned_phrase", "blocking", f"l, (values {_PHRASE_LIST}) v(phrase) where regexp_matches(lower(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'))), '(^|{_W})' || phrase || '($|{_W})')", "line_id", "phrase")]
_LEAK = [_rule("tic_leak", "blocking", f"l join m on speaker <> owner and regexp_matches(lower(text), '(^|{_W})' || marker || '($|{_W})')", "line_id", "marker")]
_OVERUSE = [_rule("tic_overuse", "blocking", f"(select *, row_number() over (partition by book_id, episode_id, revision, seg_no, speaker, marker order by pos) as nth from (select *, 1 + count(*) over (partition by book_id, episode_id, revision, seg_no, speaker) // 15 as allowed from l) join m on owner = speaker where regexp_matches(lower(text), '(^|{_W})' || marker || '($|{_W})')) where nth = allowed + 1", "line_id", "marker")]
_OPENING = [_rule("repeated_opening", "blocking", "(select *, count(*) over (partition by book_id, episode_id, revision, seg_no, speaker, opening) as same, row_number() over (partition by book_id, episode_id, revision, seg_no, speaker, opening order by pos) as nth from (select *, array_to_string(regexp_extract_all(lower(text), '\\p{L}+')[1:2], ' ') as opening, count(*) over (partition by book_id, episode_id, revision, seg_no, speaker) as n from l) where opening <> '') where n >= 5 and same >= 3 and same >= 0.4 * n and nth = 3", "line_id", "opening")]
_DUPLICATE = [_rule("duplicate_line", "blocking", f"(select *, first_value(line_id) over w as first_id, row_number() over w as nth from {_KEYED} where length(key) >= 40 window w as (partition by book_id, episode_id, revision, key order by pos)) where nth > 1", "line_id", "first_id")]
_STOCK_HIT = "len(list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '(?i)(^|[^\\p{L}\\p{N}_])(is|zijn|blijft|blijven)\\s+(nog\\s+)?geen([^\\p{L}\\p{N}_]|$)') and len(string_split(s, ' ')) <= 9)) > 0"
_TALK_HIT = "regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(in de tekst|de tekst|de bron|volgens de bron|het boek|er staat|staat er)([^\\p{L}\\p{N}_]|$)')"
_FORMULA = [_rule(name, "blocking", f"(select *, count(*) over (partition by book_id, episode_id, revision) as n, row_number() over (partition by book_id, episode_id, revision, seg_no order by pos) as nth from l where {hit}) where n > {most} and nth = 1") for name, hit, most in (("stock_phrase", _STOCK_HIT, 3), ("source_talk", _TALK_HIT, 2))]
_RETELLING = [
    _rule("claim_repeated", "warning", f"(select *, first_value(seg_no) over (partition by book_id, episode_id, revision, claim_id order by pos) as home from t where seg_type not in ({_RETELL}) and not contains(claim_id, ':')) where home <> seg_no", "line_id", "claim_id"),
    _rule("skeptic_fact", "warning", f"(select *, min(pos) over (partition by book_id, episode_id, revision, claim_id) as first_pos from t where not contains(claim_id, ':')) where pos = first_pos and seg_type not in ({_RETELL}) and speaker in (select lower(id) from speakers where role = 'skeptic')", "line_id", "claim_id"),
]
_SPEAKABLE = [
    _rule("written_syntax", "warning", "l where contains(text, ';') or (len(covers) > 0 and regexp_matches(text, ':\\s+\\S'))"),
    _rule("number_overload", "warning", "l where len(regexp_extract_all(text, '[0-9]+([.,][0-9]+)?')) > 3"),
    _rule("uncovered_fact", "warning", "l where len(covers) = 0 and seg_type in ('body', 'guest', 'reexplain', 'quiz', 'recap') and regexp_matches(text, '[0-9]') and length(text) > 60"),
]
_TELEGRAPHIC = [_rule("telegraphic", "warning", f"(select *, row_number() over (partition by book_id, episode_id, revision, seg_no order by pos) as nth from (select *, count(*) filter (where hit) over s as hits, count(*) over s as n from (select *, len(lens) >= 2 and list_sum(lens) / len(lens) < 5 as hit from (select *, {_SENTENCES} as lens from l where seg_type in ('cold_open', 'body', 'guest', 'reexplain')) where list_sum(lens) >= 6) window s as (partition by book_id, episode_id, revision, seg_no)) where hit and hits >= 2 and hits >= 0.2 * n) where nth <= 4")]
_BUDGET = [
    _rule("too_many_interrupts", "blocking", f"{_STATS} where interrupts > ceil(greatest(minutes, 1.0) / 10 * 4)", "null"),
    _rule("too_few_overlaps", "warning", f"{_STATS} where interrupts + backchannels < greatest(1, ceil(minutes / 10 * 2))", "null"),
    _rule("duration", "warning", f"{_STATS} where minutes < 0.8 * target_minutes or minutes > 1.25 * target_minutes", "null"),
    _rule("quiz_questions", "warning", f"{_STATS} where has_quiz and quiz_questions < case when target_minutes < 10 then 2 when target_minutes < 18 then 3 else 4 end", "null"),
    _rule("quiz_pause", "warning", f"{_STATS} where has_quiz and quiz_pause <= 0", "null"),
]
_FLAT = [_rule("flat_emotional_reaction", "warning", "(select book_id, episode_id, revision, count(*) as n, count(*) filter (where len(tags) > 0) as tagged from p where len(prev_tags) > 0 and speaker <> prev_speaker group by 1, 2, 3) where n >= 4 and tagged / n < 0.3", "null")]
_ALL = [*_FRAME, *_CAST, *_OVERLAP, *_COVERAGE, *_PHRASE, *_LEAK, *_OVERUSE, *_OPENING, *_DUPLICATE, *_FORMULA, *_RETELLING, *_SPEAKABLE, *_TELEGRAPHIC, *_BUDGET, *_FLAT]
_FINDINGS = ", f as (" + " union all ".join(_ALL) + "), v as (select book_id, episode_id, revision, count(*) filter (where severity = 'blocking') as blocking, count(*) filter (where severity = 'warning') as warnings from f group by 1, 2, 3) "

SQL = {
    "script_duplicate_lines": _union(*_DUPLICATE),
    "script_frame_rules": _union(*_FRAME),
    "script_cast_rules": _union(*_CAST),
    "script_overlap_rules": _union(*_OVERLAP),
    "script_coverage_rules": _union(*_COVERAGE),
    "script_phrase_rule": _union(*_PHRASE),
    "script_tic_leak": _union(*_LEAK),
    "script_tic_overuse": _union(*_OVERUSE),
    "script_repeated_opening": _union(*_OPENING),
    "script_formula_rules": _union(*_FORMULA),
    "script_retelling_rules": _union(*_RETELLING),
    "script_speakable_rules": _union(*_SPEAKABLE),
    "script_telegraphic": _union(*_TELEGRAPHIC),
    "script_episode_stats": BASE + f"select book_id, episode_id, revision, lines, chars, minutes, target_minutes, interrupts, backchannels, has_quiz, quiz_questions, quiz_pause from {_STATS}",
    "script_budget_rules": _union(*_BUDGET),
    "script_flat_reaction": _union(*_FLAT),
    "script_audit_verdicts": BASE + _FINDINGS + "select book_id, episode_id, revision, blocking, warnings, blocking = 0 as passed from v",
    "script_audit_by_rule": BASE + _FINDINGS + "select rule, severity, count(*) as findings from f group by 1, 2",
    "script_best_revision": BASE + _FINDINGS + "select book_id, episode_id, arg_min(revision, row(blocking, warnings, -revision)) as best_revision from v group by 1, 2",
    "script_turns": BASE + f"select book_id, episode_id, revision, turn_no, min_by(speaker, pos) as speaker, min_by(seg_type, pos) as seg_type, min(pos) as first_pos, count(*) as lines, sum({_COUNT}) as words, sum(length(text)) as chars from (select *, sum(case when prev_id is null or seg_no <> prev_seg or speaker is distinct from prev_speaker or mode <> 'none' or prev_pause > 0 or prev_mode <> 'none' then 1 else 0 end) over (partition by book_id, episode_id, revision order by pos, line_id) as turn_no from p) group by 1, 2, 3, 4",
    "script_renumbered": BASE + "select a.book_id, a.episode_id, a.revision, a.pos, a.line_id, a.new_id, a.target, b.new_id as new_target from n a left join n b on a.book_id = b.book_id and a.episode_id = b.episode_id and a.revision = b.revision and a.target = b.line_id".replace("from n a", "from (select *, printf('l%03d', row_number() over (partition by book_id, episode_id, revision order by pos, line_id)) as new_id from l) a").replace("left join n b", "left join (select *, printf('l%03d', row_number() over (partition by book_id, episode_id, revision order by pos, line_id)) as new_id from l) b"),
    "script_latest_revision": BASE + "select book_id, episode_id, revision, line_id, speaker, pos from l where revision = (select max(revision) from l x where x.book_id = l.book_id and x.episode_id = l.episode_id)",
}
