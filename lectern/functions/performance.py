"""Labels of delivery, mood, timing and phrase pauses as numbers, as column expressions. Values inside a range come from a hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as X

# Rate and exaggeration of each delivery, exaggeration of each mood, gaps of each timing, pauses after phrases.
DELIVERY_RATE = {"explain": 0.94, "think": 0.88, "excite": 1.08, "react": 1.02, "interrupt": 1.10, "realize": 0.90, "disagree": 1.05, "setup": 0.93, "punchline": 1.06}
DELIVERY_LIFT = {"explain": -0.05, "think": -0.10, "excite": 0.15, "react": 0.05, "interrupt": 0.10, "realize": 0.05, "disagree": 0.08, "setup": 0.0, "punchline": 0.12}
MOOD_LIFT = {"confident": 0.0, "challenged": 0.05, "surprised": 0.15, "amused": 0.10, "thoughtful": -0.10, "calm": -0.08}
TIMING_GAP = {"immediate": (-0.08, 0.10), "hesitate": (0.35, 0.6), "search": (0.6, 0.9), "deliberate": (0.9, 1.3)}
PHRASE_PAUSE = {"none": (0.0, 0.0), "short": (0.12, 0.2), "beat": (0.35, 0.55)}


def _looked_up(table: dict[str, float], label: Column, otherwise: float | None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, label), F.lit(otherwise).cast("double"))


def exaggeration_delta(delivery: Column, mood: Column) -> Column:
    """What the labels of a line add to the speaker's exaggeration; unknown and null labels add nothing."""
    return _looked_up(DELIVERY_LIFT, delivery, 0.0) + _looked_up(MOOD_LIFT, mood, 0.0)


def delivery_rate(delivery: Column) -> Column:
    return _looked_up(DELIVERY_RATE, delivery, 1.0)


def pick_in_range(low: Column, high: Column, *seed: Column) -> Column:
    return low + (high - low) * X.seeded_fraction(*seed)


def timing_gap(timing: Column, line_id: Column, seed: int = 7) -> Column:
    """The gap that a timing label asks for before the line, or null."""
    low, high = (_looked_up({k: v[i] for k, v in TIMING_GAP.items()}, timing, None) for i in (0, 1))
    return pick_in_range(low, high, F.lit(str(seed)), line_id, F.lit("timing"))


def phrase_pause(pause: Column, line_id: Column, index: Column, seed: int = 7) -> Column:
    """Seconds of silence after a phrase."""
    low, high = (_looked_up({k: v[i] for k, v in PHRASE_PAUSE.items()}, pause, 0.0) for i in (0, 1))
    return pick_in_range(low, high, F.lit(str(seed)), line_id, index.cast("string"), F.lit("pause"))
