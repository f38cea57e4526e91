"""The whole catalogue of rules over dialogue as one list of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import copies as K
from lectern.operators import folds as W
from lectern.operators import script as S
from lectern.operators import transcript as N
from lectern.session import settled

#: Rules that are planned and run together.
RULES_AT_ONCE = 4
#: The lines of an episode's revisions lie together.
CHAPTER = ["book_id", "episode_id"]


def vocabulary(sections: DataFrame, claims: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(book_id, word): what a book's script may say because its sections, claims or lexicon do."""
    return N.spoken_vocabulary(sections, "text").unionByName(N.spoken_vocabulary(claims, "claim")).unionByName(N.spoken_vocabulary(lexicon, "surface")).unionByName(N.spoken_vocabulary(lexicon, "spoken")).distinct()


def complete(
    lines: DataFrame, claims: DataFrame, speakers: DataFrame, lexicon: DataFrame, sections: DataFrame, definitions: DataFrame | None = None, samples: DataFrame | None = None, segments: DataFrame | None = None
) -> DataFrame:
    """claims: ``planning.claims_once``. Rules whose table isn't given (definitions, voice samples, segments) have no findings.

    Lines that were partitioned by CHAPTER before they were made unique are shuffled no more than that once: they are kept with
    their partitioning, which most rules stay within.
    """
    lines = settled(lines.sortWithinPartitions(*S.EPISODE, "pos", "line_id"), placed=True)
    claims = settled(claims)
    plan = claims.select("book_id", "chapter_id", "claim_id", F.col("relevance").alias("exam_relevance"))
    parts = [*S.audit_parts(lines, plan, speakers), S.pattern_rules(lines)]
    if definitions is not None:
        parts.append(S.definition_recital(lines, definitions))
    early = S.found(N.early_terms(lines, claims, speakers), "term_before_intro", "warning", claim="term")
    unknown = S.found(N.unknown_words_by_episode(lines, vocabulary(sections, claims, lexicon)), "unknown_word", "warning", claim="word")
    parts += [W.near_duplicate_lines(lines), K.source_copy(lines, claims), S.overlap_over_terms(lines, lexicon), early, unknown]
    if samples is not None:
        parts.append(K.sample_copy(lines, samples))
    if segments is not None:
        parts.append(S.empty_rules(lines, segments))
    # One plan of all rules is more than a small driver holds: a few rules at a time are run and only their findings kept.
    groups = [reduce(DataFrame.unionByName, [part.distinct() for part in parts[k : k + RULES_AT_ONCE]]) for k in range(0, len(parts), RULES_AT_ONCE)]
    out = reduce(DataFrame.unionByName, [settled(group) for group in groups])
    # Findings of one part are distinct where they are found; a line can break the rule on overlapped content in two, by its text and by a term.
    twice = F.col("rule") == "overlap_over_content"
    return out.where(~twice).unionByName(out.where(twice).distinct())
