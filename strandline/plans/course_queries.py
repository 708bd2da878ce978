"""Courses of events read by an automaton, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.operators import automata
from strandline.plans.base import registry, table

QUERIES, SQL, query = registry()

#: What a user's events make of them; any other event is unread in that state.
COURSE = automata.Automaton(
    ["new", "visitor", "engaged", "member", "customer", "lost"],
    {
        ("new", "view"): "visitor", ("new", "signup"): "member", ("visitor", "view"): "visitor", ("visitor", "click"): "engaged", ("visitor", "signup"): "member", ("engaged", "view"): "visitor",
        ("engaged", "purchase"): "customer", ("engaged", "signup"): "member", ("member", "purchase"): "customer", ("member", "error"): "lost", ("customer", "purchase"): "customer", ("customer", "error"): "lost", ("lost", "signup"): "member", ("lost", "view"): "visitor",
    },
)
_CASES = " ".join(f"WHEN '{s}:{k}' THEN '{t}'" for (s, k), t in COURSE.moves.items())
#: A step of the course: state and count of unread events, as one string.
_STEP = f"CASE WHEN (CASE split_part(s, '|', 1) || ':' || k {_CASES} END) IS NULL THEN split_part(s, '|', 1) || '|' || (CAST(split_part(s, '|', 2) AS BIGINT) + 1) ELSE (CASE split_part(s, '|', 1) || ':' || k {_CASES} END) || '|' || split_part(s, '|', 2) END"


@query(f"""WITH c AS (SELECT user_id, count(*) AS events, list_reduce(list_prepend('new|0', list(event_type ORDER BY ts, event_id)), lambda s, k: {_STEP}) AS s FROM events GROUP BY 1)
SELECT user_id, split_part(s, '|', 1) AS state, events, CAST(split_part(s, '|', 2) AS BIGINT) AS unread FROM c""")
def event_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's course ends, and how many of its events no state could read."""
    return automata.courses(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", COURSE)


@query(f"""WITH c AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids, list(event_type ORDER BY ts, event_id) AS kinds FROM events GROUP BY 1), p AS (SELECT user_id, ids, kinds, unnest(range(1, len(ids) + 1)) AS i FROM c),
r AS (SELECT user_id, ids[i] AS event_id, list_reduce(list_prepend('new|0', kinds[1 : i]), lambda s, k: {_STEP}) AS s, list_reduce(list_prepend('new|0', kinds[1 : i - 1]), lambda s, k: {_STEP}) AS before FROM p)
SELECT user_id, event_id, split_part(s, '|', 1) AS state, split_part(s, '|', 2) = split_part(before, '|', 2) AS read FROM r""")
def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the state behind it, and whether it was read."""
    found = automata.states(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", COURSE)
    return found.select("user_id", "event_id", "state", "read")
