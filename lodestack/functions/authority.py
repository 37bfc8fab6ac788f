"""Document status, authority and currency as Column expressions; the time "now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRONT_KEYS = ["status", "doc_type", "last_reviewed", "authority", "canonical_owner", "superseded_by", "review_after", "applies_to"]
# Status words of a front block.
STATUS_WORDS = {
    "current": ["current", "accepted", "active", "published"],
    "draft": ["draft", "proposed", "proposal", "review"],
    "historical": ["historical", "historic", "history"],
    "legacy": ["legacy", "deprecated", "obsolete", "superseded", "retired"],
    "archived": ["archived", "archive", "closed"],
    "template": ["template"],
    "sample": ["sample", "example", "fixture"],
}
# Where a document shows its status, in the order in which the places are looked at: place, expression, status.
STATUS_RULES = [
    ("path", r"(^|/)(archive|archived)(/|$)", "archived"),
    ("path", r"(^|/)(history|historical|updates|changelog|evaluations?)(/|$)", "historical"),
    ("all", r"(^|[-_/])(legacy|deprecated|obsolete|superseded|retired)([-_/]|$)", "legacy"),
    ("path", r"(^|/)(templates?|boilerplate)(/|$)", "template"),
    ("title", r"(^|\s)template($|\s)", "template"),
    ("path", r"(^|/)(samples?|examples?|fixtures?)(/|$)", "sample"),
    ("text", r"(^|\n)status:\s*(draft|proposed|proposal|review)\b", "draft"),
    ("path", r"^(readme|agents)\.md$", "current"),
    ("path", r"(^|/)skills/", "current"),
    ("path", r"^docs/specs/", "draft"),
    ("path", r"^docs/(architecture|design|requirements|security|runbook|guide)\.md$", "current"),
    ("path", r"^docs/(adr|api|architecture|checklists|data-flow|design|guides|requirements|runbooks|security)/", "current"),
]
# Points of a path.
PATH_POINTS = [(r"^readme\.md$", 1.5), (r"(^|/)(reference|design|specs?)(/|$)", 1.25), (r"(^|/)(templates?|examples?)(/|$)", -2.0), (r"(^|/)(ai-agent|agents)(/|$)", -0.75)]
AUTHORITY_PRIORITY = {"current": 6, "unknown": 0, "draft": -3, "historical": -5, "template": -8, "sample": -8, "legacy": -10, "archived": -10}
CURRENCY_PRIORITY = {"current": 6, "unknown": 0, "stale": -3, "historical": -6, "superseded": -12}


def unquoted(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), "^[\"']|[\"']$", "")


def front_matter(text: Column) -> Column:
    """map of the supported keys of a front block; empty when there is none or it does not end."""
    block = F.regexp_extract(text, r"(?s)\A\s*---[ \t]*\r?\n(.*?)(?:^|\n)[ \t]*---[ \t]*(?:\r?\n|\z)", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda s: F.trim(F.substring_index(s, ":", 1)).isin(FRONT_KEYS) & s.contains(":"))
    pairs = F.transform(lines, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("k"), unquoted(F.regexp_replace(s, "^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    # a repeated key keeps its last value
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def _map(value: Column, table: dict, other) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(other)


def status(path: Column, title: Column, content: Column, declared: Column) -> Column:
    """Declared status where it is a known word; else ordered path, title and text rules.

    Without a declaration, a line of the text that begins with "status:" declares.
    """
    line = F.nullif(F.trim(F.regexp_extract(F.lower(F.substring(F.coalesce(content, F.lit("")), 1, 4000)), r"(?m)^status:[ \t]*([^\r\n]+)$", 1)), F.lit(""))
    word = F.lower(unquoted(F.coalesce(declared, line)))
    known = None
    for name, words in STATUS_WORDS.items():
        known = F.when(word.isin(words), name) if known is None else known.when(word.isin(words), name)
    low, head, body = F.lower(path), F.lower(F.coalesce(title, F.lit(""))), F.lower(F.substring(F.coalesce(content, F.lit("")), 1, 4000))
    places = {"path": low, "title": head, "text": body, "all": F.concat_ws("\n", low, head, F.substring(body, 1, 1000))}
    rules = F.lit("unknown")
    for place, regex, name in reversed(STATUS_RULES):
        rules = F.when(places[place].rlike(regex), name).otherwise(rules)
    return F.coalesce(known, rules)


def authority(state: Column) -> Column:
    return F.when(state == "current", "canonical").when(state.isin("draft", "unknown", "historical"), "supporting").otherwise("non_authoritative")


def authority_priority(state: Column) -> Column:
    return _map(state, AUTHORITY_PRIORITY, 0)


def priority_of(state: Column) -> Column:
    """Points of a currency state."""
    return _map(state, CURRENCY_PRIORITY, 0)


def currency(path: Column, state: Column, owner: Column, superseded_by: Column, review_after: Column, mapped_owner: Column, now: str) -> Column:
    """struct(state, priority). owner: declared canonical owner; mapped_owner: owner that the documentation map names; now: a timestamp."""
    start = F.when(state == "current", "current").when(state.isin("historical", "archived", "legacy"), "historical").otherwise("unknown")
    some = lambda c: F.coalesce(F.length(unquoted(c)) > 0, F.lit(False))
    one = F.when(some(superseded_by), "superseded").otherwise(start)
    by = F.when(some(owner), unquoted(owner)).otherwise(mapped_owner)
    two = F.when(by.isNotNull() & (by != path) & (authority(state) != "canonical") & (one == "current"), "unknown").otherwise(one)
    owned = F.coalesce(mapped_owner == path, F.lit(False))
    three = F.when(owned & ~state.isin("legacy", "archived"), "current").otherwise(two)
    # an owner gets its bonus on the priority of the state that it had before
    points = _map(two, CURRENCY_PRIORITY, 0) + F.when(owned, 4).otherwise(0)
    past = F.coalesce(F.try_to_timestamp(unquoted(review_after)) < F.lit(now).cast("timestamp"), F.lit(False))
    last = F.when(past & (three != "superseded"), "stale").otherwise(three)
    return F.struct(last.alias("state"), F.when(past, _map(last, CURRENCY_PRIORITY, 0)).otherwise(points).alias("priority"))


def path_boost(path: Column) -> Column:
    low = F.lower(path)
    out = F.lit(0.0)
    for regex, points in PATH_POINTS:
        out = out + F.when(low.rlike(regex), points).otherwise(0.0)
    return out
