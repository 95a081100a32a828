"""Column functions against plain Python and hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from presswerk.functions import text as fn

A = "array<struct<role:string,content:string>>"


def values(spark, rows, kinds, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, kinds).select(*columns).collect()]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


@pytest.mark.parametrize("raw,want", [("24h", 86400), ("3d", 259200), ("2w", 1209600), ("90m", 5400), ("10s", 10), (" 7 D ", 604800), ("7", 0), ("abc", 0), ("", 0), (None, 0)])
def test_lookback(spark, raw, want):
    assert one(spark, fn.lookback_seconds(F.lit(raw).cast("string"))) == want


def test_clip_counts_code_points(spark):
    cases = ["abc", "abcd", "abcde", "  abcd  ", "a😀bcd", None, " x "]
    got = [r[0] for r in values(spark, [(c,) for c in cases], "t string", fn.clip(F.col("t"), 4))]
    assert got == [(s if len(s := (c or "").strip()) <= 4 else s[:4] + "…") for c in cases]


def test_normalize_and_hash(spark):
    import hashlib

    assert one(spark, fn.normalize(F.lit(" A  b\n\tC "))) == "a b c"
    want = hashlib.sha256(b"T|u|a b").hexdigest()
    assert one(spark, fn.content_hash(F.lit(" T "), F.lit("u"), F.lit("A  b"))) == want
    assert one(spark, fn.content_hash(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == hashlib.sha256(b"||").hexdigest()


def test_times(spark):
    rows = [(0, 5), (-1, 5), (None, 5), (7, 5), (None, None), (0, 0)]
    got = values(spark, rows, "p long, f long", fn.eff_ts(F.col("p"), F.col("f")), fn.interleave_ts(F.col("p")))
    assert got == [(5, 0), (5, 0), (5, 0), (7, 7), (0, 0), (0, 0)]
    dates = ["Thu, 01 Feb 2024 00:00:00 GMT", "1 Feb 2024 02:00:00 +0200", "01 Feb 2024 00:00:00", "soon", None]
    assert [r[0] for r in values(spark, [(x,) for x in dates], "d string", fn.entry_ts(F.col("d")))] == [1706745600] * 3 + [None, None]


def test_trim_tail_keeps_words(spark):
    def plain(s, tokens, cpt):
        remove = int(max(1, tokens) * cpt)
        if not s or remove >= len(s):
            return ""
        target = len(s) - remove
        cut = max(s.rfind(c, 0, target) for c in " \n\t")
        return s[: cut if cut > 0 else target].rstrip() + fn.CUT_MARK

    cases = ["", "short", "one two three four five six", "x" * 40, "a\tb\ncccc dddd eeee ffff", " lead ing text that goes on"]
    for tokens in (0, 1, 3, 8):
        got = [r[0] for r in values(spark, [(c,) for c in cases], "t string", fn.trim_tail(F.col("t"), F.lit(tokens), 2.4))]
        assert got == [plain(c, tokens, 2.4) for c in cases]


def test_trim_tail_alnum_stops_at_line_ends(spark):
    def plain(s, tokens):
        target = len(s) - int(max(1, tokens) * 2.4)
        if not s or target <= 0:
            return s and fn.CUT_MARK.lstrip()
        while target > 0 and s[target - 1].isalnum():
            target -= 1
        return s[:target].rstrip() + fn.SHORT_MARK

    cases = ["", "short", *(f"one two{end}" + "x" * 9 for end in ["", " ", "\n", "\r\n", "\u2028", "\n\n"])]
    for tokens in (0, 1, 4, 5):  # 4 tokens are nine characters
        got = [r[0] for r in values(spark, [(c,) for c in cases], "t string", fn.trim_tail_alnum(F.col("t"), F.lit(tokens)))]
        assert got == [plain(c, tokens) for c in cases]


def test_messages(spark):
    m = [("system", "s"), ("user", "x" * 2000), ("assistant", None)]
    rows = [(m,), ([("assistant", "only")],), ([],)]
    messages, est, budget = fn.enforce_budget(F.col("m"), 100, 50, 20)
    got = values(spark, rows, f"m {A}", fn.last_user(F.col("m")), fn.messages_text(messages), est, budget)
    assert [g[0] for g in got] == [1, None, None]
    assert got[0][1] == "system:\ns\n\nuser:\n" + "x" * int(256 * 3.6) + fn.CUT_MARK + "\n\nassistant:\n"
    assert got[0][3] == 256 and got[2][2] == 1


def test_overflow(spark):
    assert one(spark, fn.overflow_tokens(F.lit("Exceeded MAX context length by 1201 tokens"))) == 1201
    assert one(spark, fn.overflow_tokens(F.lit("too long"))) is None
    assert [one(spark, fn.trim_action(F.lit(n))) for n in (0, 200, 201, 1200, 1201)] == ["word_trim", "word_trim", "drop_one_article", "drop_one_article", "drop_multiple_articles"]


def test_rewrite_and_retention(spark):
    long = "word " * 200
    cases = [(long, "", "empty_response"), ("", "x", "accepted_no_previous_text"), (long, "[abc] [def] [ghi] " + long, "placeholder_template"), (long, long[:340], "extreme_truncation"), (long, long[:400], "accepted"), ("## a\n" + long, long, "missing_section_headings")]
    got = [r[0] for r in values(spark, [c[:2] for c in cases], "p string, n string", fn.rewrite_verdict(F.col("p"), F.col("n")))]
    assert got == [c[2] for c in cases]
    reasons = [r[0] for r in values(spark, [(0, 5, 0), (100, 95, 0), (100, 50, 24), (100, 50, 25)], "p long, c long, d long", fn.retention(F.col("p"), F.col("c"), F.col("d"))[1])]
    assert reasons == ["accepted_no_previous_text", "accepted_ratio", "blocked_large_loss_without_delete_ops", "accepted_delete_justified"]


def test_edit_operations_match_plain_ones(spark):
    from presswerk.plans.edit import apply

    base = "alpha beta gamma beta"
    ops = [("replace", "", "beta", "BETA"), ("delete", "", "gamma", ""), ("insert_after", "", "alpha", "!"), ("insert_after", "", "alpha", ""), ("replace", "", "missing", "x"), ("delete", "", "", "")]
    want = apply(base, [dict(zip(("op", "issue_id", "target_quote", "text"), o)) for o in ops])
    got = values(spark, [(base, ops)], "b string, o array<struct<op:string,issue_id:string,target_quote:string,text:string>>", fn.apply_operations(F.col("b"), F.col("o")))[0][0]
    assert tuple(got) == want == ("alpha! BETA  beta", 3, 3, 5)


def test_sources_paragraph(spark):
    assert one(spark, fn.note_before_sources(F.lit("a\nKällor: x\nb\nkällor : y"), F.lit("N"))) == "a\nKällor: x\nb\n\nN\n\nkällor : y\n"
    assert one(spark, fn.note_before_sources(F.lit("a"), F.lit("N"))) == "a\n\nN\n"
    assert one(spark, fn.strip_appendix(F.lit("body\n\n## Källor\n\n- x"))) == "body"
    assert one(spark, fn.strip_appendix(F.lit("## Källor\n- x"))) == ""


def test_categories(spark):
    rows = [(["News"], [], ["ads"], True), (["Ads "], [], [" ADS"], False), (["a"], ["b"], [], False), (["B  b"], ["b b"], [], True), ([], [], [], True), (None, ["x"], None, False)]
    got = values(spark, [r[:3] for r in rows], "c array<string>, i array<string>, e array<string>", fn.passes_categories(F.transform("c", fn.norm_category), F.col("i"), F.col("e")))
    assert [g[0] for g in got] == [r[3] for r in rows]


def test_titles(spark):
    assert one(spark, fn.clean_title(F.lit(' "A title" \nmore'), F.lit("f"))) == "A title"
    assert one(spark, fn.clean_title(F.lit(" \n"), F.lit("f"))) == "f"
    assert one(spark, fn.default_title(F.lit(" 1w "), F.lit(1706745600), F.lit(1706745600))) == "Nyhetssammanfattning 2024-02-01 (1w)"
    assert one(spark, fn.default_title(F.lit(""), F.lit(0), F.lit(5))) == "Nyhetssammanfattning"
