"""Column functions on texts, timestamps, messages and labels.

Texts are stripped and collapsed at Unicode white space, lengths count code
points, and null counts as empty unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python strips it.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same as characters, for trimming without a regular expression.
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CUT_MARK = "\n\n[TRUNCATED FOR CONTEXT WINDOW]\n"
SHORT_MARK = "\n[TRUNCATED]\n"
NO_TOPIC = "Okategoriserat"
NO_SOURCE = "Okänd källa"
NO_TITLE = "(utan titel)"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(text(c), F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(text(c), F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), rf"{WS}+", " ")


def normalize(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), rf"{WS}+", " ")


def content_hash(title: Column, url: Column, body: Column) -> Column:
    return F.sha2(F.concat(strip(title), F.lit("|"), strip(url), F.lit("|"), normalize(body)), 256)


def stable_id(url: Column) -> Column:
    return F.sha2(text(url), 256)


def clip(c: Column, n: int = 5000) -> Column:
    """At most ``n`` characters of the stripped text, with an ellipsis if cut."""
    s = strip(c)
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n), F.lit("…")))


def clipped_length(c: Column, n: int) -> Column:
    s = F.length(strip(c))
    return F.when(s <= n, s).otherwise(F.lit(n + 1))


def estimate_tokens(c: Column, chars_per_token: float = 3.6) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text(c)) / F.lit(float(chars_per_token))).cast("long"))


def tokens_of_chars(chars: Column, chars_per_token: float = 2.4) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(chars / F.lit(float(chars_per_token))).cast("long"))


def trim_tail(c: Column, tokens: Column, chars_per_token: float = 2.4) -> Column:
    """Cuts ``tokens`` from the end, back to the last blank, line end or tab, and adds a mark; empty if nothing would be left."""
    s = text(c)
    remove = F.floor(F.greatest(F.lit(1), tokens) * F.lit(float(chars_per_token))).cast("int")
    target = F.length(s) - remove
    head = F.substring(s, F.lit(1), target)
    gap = F.length(head) - F.instr(F.reverse(F.translate(head, "\n\t", "  ")), " ")
    has_gap = F.instr(F.translate(head, "\n\t", "  "), " ") > 0
    cut = F.when(has_gap & (gap > 0), gap).otherwise(target)
    return F.when(s == "", s).when(target <= 0, "").otherwise(F.concat(rstrip(F.substring(s, F.lit(1), cut)), F.lit(CUT_MARK)))


def trim_tail_alnum(c: Column, tokens: Column, chars_per_token: float = 2.4) -> Column:
    """Like trim_tail, but back to the last character that is no letter or digit, with a shorter mark."""
    s = text(c)
    target = F.length(s) - F.floor(F.greatest(F.lit(1), tokens) * F.lit(float(chars_per_token))).cast("int")
    head = F.regexp_replace(F.substring(s, F.lit(1), target), r"[\p{L}\p{N}]+\z", "")  # $ would also match before a line end
    return F.when(s == "", s).when(target <= 0, CUT_MARK.lstrip()).otherwise(F.concat(rstrip(head), F.lit(SHORT_MARK)))


def messages_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("user")), F.lit(":\n"), text(m["content"]))), "\n\n")


def last_user(messages: Column) -> Column:
    """Index (from 0) of the last user message; null without one."""
    at = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull())
    return F.get(at, F.size(at) - 1)


def with_last_user(messages: Column, change) -> Column:
    last = last_user(messages)
    return F.transform(messages, lambda m, i: F.when(i == last, F.struct(m["role"].alias("role"), change(text(m["content"])).alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def budget_tokens(context: int, output: int, margin: int) -> int:
    return max(256, context - output - margin)


def enforce_budget(messages: Column, context: int = 32768, output: int = 700, margin: int = 1024) -> tuple[Column, Column, Column]:
    """(messages, estimated tokens, budget): the last user message is cut if the estimate is over the budget."""
    budget = budget_tokens(context, output, margin)
    chars = int(budget * 3.6)
    over = estimate_tokens(messages_text(messages)) > budget
    cut = with_last_user(messages, lambda c: F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit(CUT_MARK))).otherwise(c))
    out = F.when(over & last_user(messages).isNotNull(), cut).otherwise(messages)
    return out, estimate_tokens(messages_text(out)), F.lit(budget).cast("long")


def overflow_tokens(error: Column) -> Column:
    """The number in 'exceeded max context length by N tokens'; null without one."""
    return F.nullif(F.regexp_extract(text(error), r"(?i)exceeded max context length by (\d+) tokens", 1), F.lit("")).try_cast("long")


def trim_action(overflow: Column, threshold: int = 1200) -> Column:
    return F.when(overflow <= 200, "word_trim").when(overflow <= threshold, "drop_one_article").otherwise("drop_multiple_articles")


def lookback_seconds(c: Column) -> Column:
    """Seconds of '24h', '3d' and the like; 0 if it cannot be read."""
    s = F.lower(strip(c))
    pattern = r"^(\d+)\s*([smhdw])$"
    n = F.coalesce(F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).try_cast("long"), F.lit(0).cast("long"))
    unit = F.regexp_extract(s, pattern, 2)
    size = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800).otherwise(0)
    return n * size


def day(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")


def span(from_ts: Column, to_ts: Column) -> Column:
    """'day–day', one day if both are the same, empty if one is missing."""
    return F.when((F.coalesce(from_ts, F.lit(0)) == 0) | (F.coalesce(to_ts, F.lit(0)) == 0), "").when(day(from_ts) == day(to_ts), day(from_ts)).otherwise(F.concat(day(from_ts), F.lit("–"), day(to_ts)))


def lookback_label(raw: Column, from_ts: Column, to_ts: Column) -> Column:
    lb, s = strip(raw), span(from_ts, to_ts)
    return F.when((lb != "") & (s != ""), F.concat(lb, F.lit(" ("), s, F.lit(")"))).otherwise(F.concat(lb, s))


def default_title(lookback: Column, from_ts: Column, to_ts: Column) -> Column:
    lb, s = strip(lookback), span(from_ts, to_ts)
    return F.concat(F.lit("Nyhetssammanfattning"), F.when(s != "", F.concat(F.lit(" "), s)).otherwise(""), F.when(lb != "", F.concat(F.lit(" ("), lb, F.lit(")"))).otherwise(""))


def clean_title(c: Column, fallback: Column) -> Column:
    """First line without quotes, at most 120 characters."""
    line = F.regexp_extract(strip(c), r"^([^\n\r]*)", 1)
    for mark in (WS, '"', "'", WS):
        line = F.regexp_replace(line, f"^{mark}+|{mark}+$", "")
    cut = F.when(F.length(line) > 120, F.concat(rstrip(F.substring(line, 1, 120)), F.lit("…"))).otherwise(line)
    return F.when(line == "", fallback).otherwise(cut)


def eff_ts(published: Column, fetched: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.when(published > 0, published).when(fetched > 0, fetched).otherwise(zero)


def interleave_ts(published: Column) -> Column:
    return F.when(published > 0, published).otherwise(F.lit(0).cast("long"))


def minute(ts: Column) -> Column:
    """'2024-02-01 00:00'; empty for 0 or null."""
    return F.when(F.coalesce(ts, F.lit(0)) == 0, "").otherwise(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm"))


def entry_ts(published: Column) -> Column:
    """Epoch seconds of an RFC-822 date, without zone taken as UTC; null if it cannot be read."""
    s = F.regexp_replace(F.regexp_replace(strip(published), r"^[A-Za-z]{3,9},\s*", ""), r"\s(GMT|UT|UTC|Z)$", " +0000")
    zoned = F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss Z"))
    naive = F.try_to_timestamp(F.concat(s, F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.unix_timestamp(F.coalesce(zoned, naive))


def summary_class(doc_json: Column) -> Column:
    package = F.lower(F.coalesce(F.get_json_object(doc_json, "$.selection.prompt_package"), F.lit("")))
    return F.when(package.contains("weekly"), "weekly").when(package.contains("daily"), "daily").otherwise("other")


def normal_summary_id(c: Column) -> Column:
    """Null for empty, 'none' and 'null' in any case."""
    s = strip(c)
    return F.when(~F.lower(s).isin("", "none", "null"), s)


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(strip(c).try_cast("long"), F.lit(default).cast("long"))


def summary_doc_id(ts: Column, job: Column) -> Column:
    return F.concat(F.lit("sum_"), F.date_format(F.timestamp_seconds(ts), "yyyyMMdd_HHmm"), F.when(job.isNotNull(), F.concat(F.lit("_job"), job)).otherwise(""))


def article_block(idx: Column, title: Column, source: Column, url: Column, body: Column) -> Column:
    t, s, u, b = strip(title), strip(source), strip(url), strip(body)
    return F.concat(
        F.lit("["), idx, F.lit("] "), F.when(t == "", NO_TITLE).otherwise(t),
        F.when(s == "", "").otherwise(F.concat(F.lit(" ("), s, F.lit(")"))),
        F.when(u == "", "").otherwise(F.concat(F.lit(" "), u)),
        F.when(b == "", "").otherwise(F.concat(F.lit("\n"), b)),
    )


def render(template: Column, **values: Column) -> Column:
    """Replaces ``{key}`` by its value, others stay."""
    out = template
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), text(value))
    return out


def composed_text(sections: Column, ingress: Column) -> Column:
    """Ingress, then '## tag' and body of each section (tag, summary) that has a body."""
    full = F.filter(F.transform(sections, lambda s: F.struct(strip(s["tag"]).alias("tag"), strip(s["summary"]).alias("body"))), lambda s: s["body"] != "")
    parts = F.transform(full, lambda s: F.concat(F.lit("## "), s["tag"], F.lit("\n\n"), s["body"]))
    intro = strip(ingress)
    return strip(F.array_join(F.concat(F.when(intro != "", F.array(intro)).otherwise(F.array().cast("array<string>")), parts), "\n\n"))


def prepend_ingress(body: Column, ingress: Column) -> Column:
    b, i = strip(body), strip(ingress)
    return F.when((b != "") & (i != ""), F.concat(i, F.lit("\n\n"), b)).otherwise(F.concat(i, b))


def strip_appendix(c: Column) -> Column:
    s = rstrip(c)
    at = F.instr(s, "\n## Källor\n")
    return F.when(at > 0, rstrip(F.substring(s, F.lit(1), at - 1))).when(s.startswith("## Källor\n"), "").otherwise(s)


def note_before_sources(c: Column, note: Column) -> Column:
    """The note as a paragraph before the last line that starts with 'Källor:', else at the end."""
    s, n = strip(c), strip(note)
    head = F.regexp_extract(s, r"(?isu)^(.*(?:^|\n))källor\s*:[^\n]*", 1)
    found = F.regexp_like(s, F.lit(r"(?imud)^källor\s*:"))
    tail = F.substring(s, F.length(head) + 1, F.length(s))
    placed = F.concat(strip(F.concat(rstrip(head), F.lit("\n\n"), n, F.lit("\n\n"), F.regexp_replace(tail, rf"^{WS}+", ""))), F.lit("\n"))
    return F.when((s == "") | (n == ""), s).when(found, placed).otherwise(F.concat(s, F.lit("\n\n"), n, F.lit("\n")))


def log_excerpt(c: Column, n: int = 220) -> Column:
    s = collapse(c)
    return F.when(F.length(s) <= n, s).otherwise(F.concat(rstrip(F.substring(s, 1, n - 3)), F.lit("...")))


def coverage_ratio(total: Column, included: Column) -> Column:
    ratio = F.try_divide(F.length(text(included)).cast("double"), F.length(text(total)).cast("double"))
    return F.when(F.length(text(total)) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


# What an echoed template looks like.
PLACEHOLDER = r"(\[[^\]\n]{3,120}\])"
LABEL = r"(?imud)^(?:rubrik|ingress|brödtext)\s*:\s*(.+)$"
STOCK_PHRASE = "reviderad sammanfattning"
# Names of verdicts, and how short a rewrite may be.
EMPTY, NO_PREVIOUS, TEMPLATE, TRUNCATED, NO_HEADINGS, ACCEPTED = "empty_response", "accepted_no_previous_text", "placeholder_template", "extreme_truncation", "missing_section_headings", "accepted"
BY_RATIO, LARGE_LOSS, DELETED = "accepted_ratio", "blocked_large_loss_without_delete_ops", "accepted_delete_justified"
LEAST_REWRITE, LEAST_SHARE = 200, 0.35


def placeholder_template(c: Column) -> Column:
    """Whether a model echoed a template: 3 bracketed placeholders, 2 labels with one, or the stock phrase with one."""
    s = strip(c)
    hits = F.size(F.regexp_extract_all(s, F.lit(PLACEHOLDER), 1))
    labels = F.size(F.filter(F.regexp_extract_all(s, F.lit(LABEL), 1), lambda v: v.contains("[") & v.contains("]")))
    return (s != "") & ((hits >= 3) | (labels >= 2) | (F.lower(s).contains(STOCK_PHRASE) & (hits >= 1)))


def rewrite_verdict(previous: Column, new: Column) -> Column:
    p, n = strip(previous), strip(new)
    return (
        F.when(n == "", EMPTY)
        .when(p == "", NO_PREVIOUS)
        .when(placeholder_template(n), TEMPLATE)
        .when(F.length(n) < F.greatest(F.lit(LEAST_REWRITE), F.floor(F.length(p) * F.lit(LEAST_SHARE))), TRUNCATED)
        .when(p.contains("## ") & ~n.contains("## "), NO_HEADINGS)
        .otherwise(ACCEPTED)
    )


def retention(previous_chars: Column, candidate_chars: Column, deleted_chars: Column, least: float = 0.9) -> tuple[Column, Column]:
    """(ratio, reason): a text may shrink to ``least``, or further if half the loss was deleted on purpose."""
    ratio = F.when(previous_chars <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(candidate_chars.cast("double"), previous_chars.cast("double")))))
    lost = F.greatest(F.lit(0), previous_chars - candidate_chars)
    reason = (
        F.when(previous_chars <= 0, NO_PREVIOUS)
        .when(ratio >= least, BY_RATIO)
        .when(F.coalesce(deleted_chars, F.lit(0)) < F.floor(lost * F.lit(0.5)), LARGE_LOSS)
        .otherwise(DELETED)
    )
    return ratio, reason


def coerce_op(op: Column, idx: Column) -> Column:
    """An edit operation (op, operation, issue_id, target_quote, text, replacement, content) with defaults filled in."""
    kind = F.lower(strip(F.coalesce(F.nullif(op["op"], F.lit("")), op["operation"])))
    issue = strip(op["issue_id"])
    value = F.coalesce(*[F.nullif(op[k], F.lit("")) for k in ("text", "replacement", "content")])
    return F.struct(
        F.when(kind.isin("replace", "delete", "insert_after"), kind).otherwise("replace").alias("op"),
        F.when(issue == "", F.concat(F.lit("issue_"), idx)).otherwise(issue).alias("issue_id"),
        strip(op["target_quote"]).alias("target_quote"),
        strip(value).alias("text"),
    )


def apply_operations(base: Column, ops: Column) -> Column:
    """struct(text, applied, skipped, deleted_chars): each operation changes the first match of its target, in order."""

    def step(acc, op):
        target, new = text(op["target_quote"]), text(op["text"])
        at = F.when(target == "", F.lit(0)).otherwise(F.position(target, acc["text"]))
        end = at + F.length(target)
        head, match, tail = F.substring(acc["text"], F.lit(1), at - 1), target, F.substring(acc["text"], end, F.length(acc["text"]))
        kind = op["op"]
        fits = (at > 0) & (kind.isin("replace", "delete") | ((kind == "insert_after") & (new != "")))
        changed = F.when(kind == "replace", F.concat(head, new, tail)).when(kind == "delete", F.concat(head, tail)).otherwise(F.concat(head, match, new, tail))
        return F.struct(
            F.when(fits, changed).otherwise(acc["text"]).alias("text"),
            (acc["applied"] + fits.cast("int")).alias("applied"),
            (acc["skipped"] + (~fits).cast("int")).alias("skipped"),
            (acc["deleted_chars"] + F.when(fits & (kind == "delete"), F.length(target)).otherwise(0)).alias("deleted_chars"),
        )

    start = F.struct(text(base).alias("text"), F.lit(0).alias("applied"), F.lit(0).alias("skipped"), F.lit(0).alias("deleted_chars"))
    return F.aggregate(ops, start, step, lambda a: F.struct(strip(a["text"]).alias("text"), a["applied"].alias("applied"), a["skipped"].alias("skipped"), a["deleted_chars"].alias("deleted_chars")))


def checkpoint_key(job: Column, ids: Column, whole_job: bool = False) -> Column:
    digest = F.sha2(F.array_join(ids, "|"), 256)
    own = F.concat(F.lit("job_"), job) if whole_job else F.concat(F.lit("job_"), job, F.lit("_"), F.substring(digest, 1, 12))
    return F.when(job.isNotNull(), own).otherwise(F.substring(digest, 1, 16))


def source_line(title: Column, url: Column) -> Column:
    return F.concat(F.lit("- "), clip(title, 140), F.lit(" — "), text(url))


def norm_category(c: Column) -> Column:
    return normalize(c)


def categories(single: Column, many: Column, tags: Column) -> Column:
    """Union of a category, a list of them, and tags (term, else label, else name), normalised, without empty ones."""
    terms = F.transform(F.coalesce(tags, F.array()), lambda t: F.coalesce(F.nullif(t["term"], F.lit("")), F.nullif(t["label"], F.lit("")), t["name"]))
    every = F.concat(F.array(text(single)), F.coalesce(many, F.array().cast("array<string>")), terms)
    return F.array_distinct(F.filter(F.transform(every, norm_category), lambda c: c != ""))


def passes_categories(cats: Column, include: Column, exclude: Column) -> Column:
    """An excluded category wins; with an include list one of it is needed."""
    none = F.array().cast("array<string>")
    norm = lambda a: F.filter(F.transform(F.coalesce(a, none), norm_category), lambda c: c != "")
    inc, exc, own = norm(include), norm(exclude), F.coalesce(cats, none)
    return ~F.arrays_overlap(own, exc) & ((F.size(inc) == 0) | F.arrays_overlap(own, inc))


def ordered_distinct(items: Column) -> Column:
    return F.array_distinct(items)


def adaptive_budget(estimate: Column, overflow: Column, current: Column) -> Column:
    """The next, smaller budget after a prompt was too long."""
    limit = F.greatest(F.lit(2048), estimate - overflow)
    new = F.greatest(F.lit(512), limit - 1200)
    return F.when(new >= current, F.greatest(F.lit(512), F.floor(current * F.lit(0.6)).cast("long"))).otherwise(new).cast("long")
