"""Fitting prompts into token budgets.

Fits are searched on the lengths of a prompt's parts; the prompt itself is put
together once, when its parts are chosen.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from presswerk.functions.text import estimate_tokens, render, text

# The grid that is searched for a reduce prompt (limits of the source list, every how many batches,
# characters of a batch), what stands between batches, and the texts that stand for no batches and no lookback.
SOURCE_LIMITS = (None, 6000, 3500, 2000, 1200, 700)
DECIMATIONS = (1, 2, 3, 4, 6, 8, 12)
CLIPS = (4200, 3200, 2400, 1800, 1200, 900, 700, 500, 350, 250)
JOINT = "\n\n====================\n\n"
NO_BATCHES = "[Inga batch-summaries kunde inkluderas inom context-budget.]"
NO_LOOKBACK = "okänt tidsfönster"


def super_meta(template: Column, topics: Column, lookback: Column, budget: int, chars_per_token: float) -> Column:
    """The overview prompt: the topics' text loses its last 15 % (down to 500 characters) up to six times until it fits, else all beyond 2000."""

    def put(t):
        return render(template, lookback=lookback, topic_summaries=t)

    def step(t, _):
        cut = F.greatest(F.lit(500), F.floor(F.length(t) * F.lit(0.85)).cast("int"))
        return F.when(estimate_tokens(put(t), chars_per_token) <= budget, t).otherwise(F.substring(t, F.lit(1), cut))

    # A state is only known to fit if one of six tries saw it.
    tried = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.struct(text(topics).alias("t"), F.lit(False).alias("fits")), lambda s, i: F.struct(F.when(s["fits"], s["t"]).otherwise(step(s["t"], i)).alias("t"), (s["fits"] | (estimate_tokens(put(s["t"]), chars_per_token) <= budget)).alias("fits")))
    return put(F.when(tried["fits"], tried["t"]).otherwise(F.substring(tried["t"], 1, 2000)))


def tokens_of(chars: int, chars_per_token: float) -> int:
    return max(1, int(chars / chars_per_token))


def tokens(s: str, chars_per_token: float) -> int:
    return tokens_of(len(s), chars_per_token)


def fill(template: str, **values: str) -> str:
    """The template with its named places filled in one pass: a place that a value happens to name stays as it is."""
    return re.sub(r"\{(" + "|".join(values) + r")\}", lambda m: values[m[1]], template) if values else template


def filled_length(template: str, **sizes: int) -> int:
    """The length of the filled template, from those of the values."""
    return len(fill(template, **dict.fromkeys(sizes, ""))) + sum(n * template.count("{" + name + "}") for name, n in sizes.items())


def cut(s: str, n: int) -> str:
    return s if len(s) <= n else s[:n].rstrip() + "…"


def most_chars(budget: int, chars_per_token: float) -> int:
    """The most characters whose estimate is within the budget; -1 if none is."""
    if budget < 1:
        return -1
    n = int((budget + 1) * chars_per_token) + 1
    while tokens_of(n, chars_per_token) > budget:
        n -= 1
    return n


def fit_meta(template: str, batches: list[tuple[int, str]], sources: str, *, lookback: str, budget: int, chars_per_token: float = 2.4) -> str:
    """The reduce prompt at the first point of the grid at which a batch fits, with as many of the newest as do.

    Points are ordered by source limit, then decimation, then characters of a
    batch.  From the newest on, batches that are too large alone are passed over
    until one fits; the first later one that does not ends the list.
    """
    newest = sorted(batches, key=lambda b: -b[0])
    bodies = [(summary or "").strip() for _, summary in newest]
    heads = [f"Batch {number}:\n" for number, _ in newest]
    sizes = {clip: np.array([len(h) + len(cut(b, clip)) for h, b in zip(heads, bodies)], np.int64) for clip in CLIPS}
    smallest = {(every, clip): sizes[clip][::every].min(initial=1 << 60) for every, clip in product(DECIMATIONS, CLIPS)}
    most, places = most_chars(budget, chars_per_token), template.count("{batch_summaries}")
    when = lookback or NO_LOOKBACK

    for limit in SOURCE_LIMITS:
        src = sources if limit is None else cut(sources, limit)
        room = most - filled_length(template, batch_summaries=0, sources_list=len(src), lookback=len(when))
        room = room // places if places else (1 << 50) * (1 if room >= 0 else -1)
        point = next((p for p in product(DECIMATIONS, CLIPS) if smallest[p] <= room), None)
        if point is None:
            continue
        every, clip = point
        own = sizes[clip][::every]
        first = int(np.argmax(own <= room))
        upto = np.cumsum(own[first:] + len(JOINT)) - len(JOINT)
        chosen = range(first * every, (first + int(np.searchsorted(upto, room, side="right"))) * every, every)
        return fill(template, batch_summaries=JOINT.join(heads[k] + cut(bodies[k], clip) for k in chosen), sources_list=src, lookback=when)
    return fill(template, batch_summaries=NO_BATCHES, sources_list=cut(sources, min(x for x in SOURCE_LIMITS if x)), lookback=when)


@dataclass(frozen=True)
class Shrink:
    """Takes ``part`` down by ``factor`` while it is longer than ``above``, but not below ``floor``; with ``covered``, only while so much of the draft stays."""

    part: str
    above: int
    floor: int
    factor: float
    covered: float = 0.0

    def of(self, size: int) -> int:
        return max(self.floor, int(size * self.factor))


#: Steps in which a proofread or revise prompt is shrunk at most, and what its parts are cut to if they do not suffice.
SHRINKS, HARD = 14, {"desk_underlag": 1200, "feedback": 600, "draft_summary": 1200}


def edit_rules(draft_step: float, least_coverage: float) -> tuple[Shrink, ...]:
    """What gives way first: the desk's material, the feedback, the draft while enough of it stays, the draft."""
    return (
        Shrink("desk_underlag", 1200, 1200, 0.85),
        Shrink("feedback", 600, 600, 0.85),
        Shrink("draft_summary", 600, 600, draft_step, least_coverage),
        Shrink("draft_summary", 1200, 800, 0.85),
    )


def coverage(whole: int, part: int) -> float:
    return min(1.0, part / whole) if whole else 1.0


def fit_edit(template: str, draft: str, desk: str, feedback: str, *, lookback: str, budget: int, chars_per_token: float = 2.4, draft_step: float = 0.9, least_coverage: float = 0.8) -> tuple[str, dict]:
    """A proofread prompt (or, with draft_step 0.92 and least_coverage 1, a revise prompt) and what of its parts it holds.

    While the prompt is too long, the first of ``edit_rules`` that applies takes
    one part down; if no rule is left, or after SHRINKS steps, all are cut hard.
    """
    parts = {"draft_summary": (draft or "").strip(), "desk_underlag": desk or "", "feedback": feedback or ""}
    whole, rules = len(draft or ""), edit_rules(draft_step, least_coverage)
    sizes = {name: len(s) for name, s in parts.items()}

    def fits() -> bool:
        return tokens_of(filled_length(template, lookback=len(lookback), **sizes), chars_per_token) <= budget

    def applies(rule: Shrink) -> bool:
        size = sizes[rule.part]
        return size > rule.above and (not rule.covered or coverage(whole, min(size, rule.of(size))) >= rule.covered)

    for _ in range(SHRINKS):
        rule = None if fits() else next(filter(applies, rules), None)
        if rule is None:
            break
        sizes[rule.part] = rule.of(sizes[rule.part])
    if not fits():
        sizes = {name: min(n, HARD[name]) for name, n in sizes.items()}
    user = fill(template, lookback=lookback, **{name: s[: sizes[name]] for name, s in parts.items()})
    seen = {"est_tokens": tokens(user, chars_per_token), "draft_coverage": coverage(whole, sizes["draft_summary"])}
    return user, seen | {"draft_chars": sizes["draft_summary"], "desk_chars": sizes["desk_underlag"], "feedback_chars": sizes["feedback"]}


def next_budget(estimate: int, overflow: int, current: int) -> int:
    """The budget of the next try after a prompt was too long."""
    new = max(512, max(2048, estimate - overflow) - 1200)
    return new if new < current else max(512, int(current * 0.6))


_TO_LAST_BLANK = re.compile(r"(.+)[ \n\t]", re.S)


def trim_words(s: str, remove: int, chars_per_token: float, mark: str) -> str:
    """Cuts at least ``remove`` tokens from the end, up to a blank, and adds the mark; empty if nothing would be left."""
    kept = s[: max(0, len(s) - int(max(1, remove) * chars_per_token))]
    if not kept:
        return ""
    whole_words = _TO_LAST_BLANK.match(kept)
    return (whole_words[1] if whole_words else kept).rstrip() + mark


def retrying(make: Callable[[int], str], call: Callable[[str], str], budget: int, tries: int, overflow_error: type[Exception], chars_per_token: float) -> str:
    """Calls with prompts of shrinking budgets until one is not too long."""
    for left in range(tries, 0, -1):
        prompt = make(budget)
        try:
            return call(prompt)
        except overflow_error as e:
            if left == 1:
                raise
            budget = next_budget(tokens(prompt, chars_per_token), getattr(e, "overflow", 0), budget)
    raise AssertionError
