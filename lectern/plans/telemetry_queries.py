"""Queries over timings and events, each with independent SQL."""

from __future__ import annotations

from lectern.operators import telemetry as T
from lectern.sources.tables import table

PASSES = ["extract", "plan", "lexicon", "outline", "write", "audit", "render", "chapter"]


def _on(name, operator):
    return lambda spark, folder: operator(T.timings_once(table(spark, folder, name)) if name == "timings" else table(spark, folder, name))


QUERIES = {
    "timings_latest_runs": _on("timings", T.latest_runs),
    "timings_typical_chapter": _on("timings", T.typical_chapter_seconds),
    "timings_typical_pass": _on("timings", T.typical_pass_seconds),
    "timings_running_typical": _on("timings", T.running_typical),
    "timings_latest_book_runs": _on("timings", T.latest_book_runs),
    "timings_last_failures": _on("timings", T.last_failures),
    "timings_run_listing": _on("timings", T.run_listing),
    "timings_status_matrix": _on("timings", lambda t: T.status_matrix(t, PASSES)),
    "events_progress": _on("events", T.progress),
    "events_latest_status": _on("events", T.latest_status),
    "events_replay": _on("events", lambda e: T.replay(e.select("event_id", "user_id", "event_type", "value"), 700)),
    "events_sessions": _on("events", T.sessions),
}

_T = "with t as (select distinct * from timings) "
SQL = {
    "timings_latest_runs": _T + """select book_id, chapter, run, passes, seconds, llm_calls, first_start, last_end, all_skipped, any_failed, last_end - first_start as elapsed_s from (
select book_id, chapter, run, count(*) as passes, coalesce(cast(sum(cast(seconds as decimal(18,2))) filter (where pass_name <> 'chapter' and status <> 'skipped') as double), 0) as seconds, sum(llm_calls) as llm_calls,
cast(floor(epoch(min(started_at))) as bigint) as first_start, cast(floor(epoch(max(finished_at))) as bigint) as last_end, bool_and(status = 'skipped') as all_skipped, bool_or(status = 'failed') as any_failed
from t where run = (select max(run) from t x where x.book_id = t.book_id and x.chapter is not distinct from t.chapter) group by 1, 2, 3)""",
    "timings_typical_chapter": _T + "select book_id, round_even(median(seconds), 2) as typical_s, count(*) as chapters from (select *, row_number() over (partition by book_id order by started_at desc, run desc) as nth from t where pass_name = 'chapter' and status = 'done' and seconds > 1) where nth <= 12 group by 1",
    "timings_typical_pass": _T + """select pass_name, median_s, total_s, passes, llm_calls, case when s >= 3600 then printf('%d u %02d min', s // 3600, s % 3600 // 60) when s >= 60 then printf('%d min %02d s', s // 60, s % 60) else printf('%d s', s) end as typical from (
select pass_name, round_even(median(seconds), 2) as median_s, cast(sum(cast(seconds as decimal(18,2))) as double) as total_s, count(*) as passes, sum(llm_calls) as llm_calls from t where status = 'done' group by 1), lateral (select cast(round_even(median_s, 0) as bigint) as s)""",
    "timings_running_typical": _T + "select book_id, run, pass_name, label, seconds, round_even(median(seconds) over (partition by book_id, pass_name order by started_at, run, label rows between unbounded preceding and 1 preceding), 4) as typical_s from t where status = 'done'",
    "timings_latest_book_runs": _T + """select book_id, day, count(*) as chapters, count(*) filter (where skipped) as n_skipped, count(*) filter (where failed) as n_failed, count(*) filter (where not skipped and not failed) as n_done from (
select book_id, left(run, 8) as day, chapter, bool_and(status = 'skipped') as skipped, bool_or(status = 'failed') as failed from t where chapter is not null and left(run, 8) = (select max(left(run, 8)) from t x where x.book_id = t.book_id and x.chapter is not null) group by 1, 2, 3) group by 1, 2""",
    "timings_last_failures": _T + "select book_id, chapter, pass_name, run, error from (select *, row_number() over (partition by book_id, chapter, pass_name order by started_at desc, run desc, label desc) as nth from t where status in ('failed', 'done')) where nth = 1 and status = 'failed'",
    "timings_run_listing": _T + "select book_id, run, rank, row_number() over (partition by book_id, run order by started_at, pass_name, label, status, seconds) as place, pass_name, status, round_even(seconds, 2) as seconds from (select *, dense_rank() over (partition by book_id order by run desc) as rank from t) where rank <= 3",
    "timings_status_matrix": _T + "select book_id, chapter, " + ", ".join(f"max(status) filter (where pass_name = '{p}') as pass_{p}" for p in PASSES) + " from (select *, row_number() over (partition by book_id, chapter, pass_name order by started_at desc, run desc, label desc, status desc) as nth from t where chapter is not null) where nth = 1 group by 1, 2",
    "events_progress": "select user_id, event_id, max(value) over w as progress, cast(floor((epoch_us(ts) - epoch_us(lag(ts) over w)) / 1000000) as bigint) as gap_s from events window w as (partition by user_id order by event_id)",
    "events_latest_status": "select user_id, arg_max(event_type, event_id) as status, max(event_id) as \"offset\", count(*) as events from events group by 1",
    "events_replay": "select event_id, user_id, event_type, value from events where event_id > 700 order by event_id limit 500",
    "events_sessions": """select user_id, session_no, count(*) as events, min(event_id) as first_event, cast(sum(cast(value as decimal(18,2))) as double) as value, count(distinct event_type) as kinds from (
select *, sum(case when gap is null or gap > 1800000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as session_no from (select *, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events)) group by 1, 2""",
}
