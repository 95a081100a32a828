"""Budgets: the fast fits against slow specifications that put every prompt together."""

from __future__ import annotations

from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from presswerk.operators import budget as bg

META = "{lookback}|{batch_summaries}|{sources_list}"
EDIT = "{lookback}<{draft_summary}><{desk_underlag}><{feedback}>"


def slow_meta(template, batches, sources, lookback, budget, cpt):
    """Every point of the grid and every list of batches, as texts."""

    def prompt(blocks, src):
        return bg.fill(template, batch_summaries=bg.JOINT.join(blocks), sources_list=src, lookback=lookback or bg.NO_LOOKBACK)

    order = sorted(batches, key=lambda b: b[0], reverse=True)
    for limit, every, clip in product(bg.SOURCE_LIMITS, bg.DECIMATIONS, bg.CLIPS):
        src = sources if limit is None else bg.cut(sources, limit)
        blocks = [f"Batch {n}:\n{bg.cut((s or '').strip(), clip)}" for k, (n, s) in enumerate(order) if k % every == 0]
        fits = [bg.tokens(prompt([b], src), cpt) <= budget for b in blocks]
        if any(fits):
            blocks = blocks[fits.index(True) :]
            most = max(k for k in range(1, len(blocks) + 1) if all(bg.tokens(prompt(blocks[:j], src), cpt) <= budget for j in range(1, k + 1)))
            return prompt(blocks[:most], src)
    return prompt([bg.NO_BATCHES], bg.cut(sources, 700))


words = st.integers(0, 900).flatmap(lambda n: st.sampled_from(["word ", "é\n", "x", " y  "]).map(lambda w: (w * n)[: 5 * n]))


@settings(max_examples=60, deadline=None)
@given(st.lists(words, max_size=14), words, st.sampled_from(["", "24h"]), st.integers(0, 4000), st.sampled_from([2.4, 3.6]), st.sampled_from([META, "{batch_summaries} {batch_summaries}", "no place", "{sources_list}{x}"]))
def test_meta_equals_slow_search(summaries, sources, lookback, budget, cpt, template):
    batches = list(enumerate(summaries, 1))
    assert bg.fit_meta(template, batches, sources, lookback=lookback, budget=budget, chars_per_token=cpt) == slow_meta(template, batches, sources, lookback, budget, cpt)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 9000), st.integers(0, 9000), st.integers(0, 4000), st.integers(1, 9000), st.sampled_from([(0.9, 0.8), (0.92, 1.0)]))
def test_edit_gives_way_in_order(draft, desk, feedback, budget, kind):
    step, least = kind
    user, seen = bg.fit_edit(EDIT, "d" * draft, "u" * desk, "f" * feedback, lookback="1d", budget=budget, draft_step=step, least_coverage=least)
    assert seen["est_tokens"] == bg.tokens(user, 2.4) and (user.count("d") - 1, user.count("u"), user.count("f")) == (seen["draft_chars"], seen["desk_chars"], seen["feedback_chars"])
    assert seen["draft_coverage"] == (min(1.0, seen["draft_chars"] / draft) if draft else 1.0)
    if bg.tokens("d" * (draft + desk + feedback + 8), 2.4) <= budget:
        assert (seen["draft_chars"], seen["desk_chars"], seen["feedback_chars"]) == (draft, desk, feedback)
    if seen["feedback_chars"] < feedback and seen["est_tokens"] <= budget:
        assert seen["desk_chars"] <= 1200
    if seen["draft_chars"] < draft and seen["est_tokens"] <= budget:
        assert seen["feedback_chars"] <= 600
    if seen["est_tokens"] > budget:
        assert seen["desk_chars"] <= 1200 and seen["feedback_chars"] <= 600 and seen["draft_chars"] <= 1200


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\t", max_size=60), st.integers(-3, 40), st.sampled_from([1.0, 2.4]))
def test_trim_ends_at_a_blank(s, remove, cpt):
    got = bg.trim_words(s, remove, cpt, "#")
    target = len(s) - int(max(1, remove) * cpt)
    if target <= 0:
        assert got == ""
    else:
        blanks = [k for k in range(1, target) if s[k] in " \n\t"]
        assert got == s[: blanks[-1] if blanks else target].rstrip() + "#"


def test_values_are_not_filled_again():
    assert bg.fill("{a}-{b}", a="{b}", b="x") == "{b}-x"
    assert bg.filled_length("{a}-{b}{a}", a=3, b=2) == 9
    assert [bg.most_chars(b, 2.4) for b in (0, 1, 10)] == [-1, 4, 26]
