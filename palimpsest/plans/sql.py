"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from ..operators import gates as G
from ..operators import ranking as R
from .text_queries import NORM, _any


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def pick(items, place: str) -> str:
    """An element of a list by a number modulo its length."""
    return f"list_extract({listed(items)}, ({place} % {len(items)} + 1)::INT)"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def norm(column: str) -> str:
    return NORM.replace("text", column)


def curly(column: str) -> str:
    return f"translate(lower({column}), '‘’', '''''')"


def bare_sql(q: str) -> str:
    filler = "|".join(sorted(G.SEARCH_FILLER, key=len, reverse=True))
    arms = []
    for m in G.SEARCH_MARKERS:
        rest = f"substr({q}, 1, instr({q}, {quoted(m)}) - 1) || substr({q}, instr({q}, {quoted(m)}) + {len(m)})"
        flat = rf"trim(regexp_replace(regexp_replace({rest}, '[,.!?;:]+', ' ', 'g'), '\s+', ' ', 'g'))"
        arms.append(f"WHEN contains({q}, {quoted(m)}) THEN regexp_full_match({flat}, {quoted(f'(?:(?:{filler})(?: |$))*')})")
    return "(CASE " + " ".join(arms) + " ELSE false END)"


def rule_sql(text: str) -> str:
    low = curly(text)
    said = f"trim(regexp_replace(trim({low}), '[.!?,]+$', ''))"
    signal = "(" + " OR ".join(matches(low, G.word(p)) for p in G.OUTSIDE_SIGNALS) + ")"
    own = f"({matches(f'lower({text})', G.word(G.FIRST_PERSON))} AND NOT {matches(low, G.word(G.OUTSIDE_ANCHORS))})"
    return f"(CASE WHEN list_contains({listed(G.ACKNOWLEDGEMENTS)}, {said}) THEN 'vault_answerable' WHEN {signal} AND {own} THEN 'vault_answerable' WHEN {signal} THEN 'needs_internet' END)"


def policy_sql(text: str) -> str:
    q = curly(text)
    return f"""(CASE WHEN {bare_sql(q)} THEN 'clarification' WHEN {_any(q, G.SEARCH_MARKERS)} THEN 'web_search' WHEN {_any(q, R.TASK_MARKERS)} THEN 'task_status'
 WHEN coalesce({rule_sql(text)} = 'needs_internet', false) THEN 'web_search' WHEN {_any(q, R.STATE_MARKERS)} THEN 'status_state' WHEN {_any(q, R.REFLECTIVE_MARKERS)} THEN 'reflective'
 WHEN {_any(q, R.RECALL_MARKERS)} THEN 'factual_recall' WHEN {_any(q, R.RECENT_MARKERS)} AND {_any(q, R.ACTIVITY_MARKERS)} THEN 'recent_activity' WHEN {_any(q, R.RECENT_MARKERS)} THEN 'recent'
 WHEN {_any(q, R.ACTIVITY_MARKERS)} THEN 'activity' ELSE 'default' END)"""


def relational_sql(text: str) -> str:
    return matches(f"lower({text})", r"(?:^|[^\p{L}\p{N}_])my\s+(?:" + "|".join(R.KIN + R.DOMAINS) + r")(?:$|[^\p{L}\p{N}_])")
