"""Personal data: rules for the plain cases, and a BiLSTM-CRF tagger for those that rules drop."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.llm.common import bound_batches, drop_state, in_groups
from presswerk.llm.tagger import KINDS, LABELS, NEVER, Tagger, encode

EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The same where a run of characters begins, so that a long run is read once.
_EMAIL_START = re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL.pattern)
_IP_START = re.compile(r"(?<![0-9])" + IP.pattern)
#: What a span has: a digit, an @, or one that is spelled out.
_SIGN = re.compile(r"[0-9@]|[(\[{](?:at|dot)[)\]}]|\bat [\w-]+ dot\b", re.I)

#: Windows of the tagger, and how far apart they start.
WINDOW, STRIDE = 96, 48
#: Characters of a region that is decoded in one.
REGION = 2048
#: Windows of the corpus that the tagger is trained on, at most, besides the made ones.
CORPUS_WINDOWS, MADE_WINDOWS = 600, 2400
#: Log odds against no span from which on a span counts that no rule would know.
LEAST_ODDS = 2.0

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(s: str) -> bool:
    """Whether digits are a number up to 255, however many zeros lead."""
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or "0") <= 255


def valid(kind: str, s: str) -> bool:
    """Whether ``s`` is a well-formed value of the kind."""
    if kind == "email":
        return EMAIL.fullmatch(s) is not None
    if kind == "ip":
        return IP.fullmatch(s) is not None and all(map(_octet, s.split(".")))
    if kind == "card":
        return CARD.fullmatch(s) is not None and 16 <= len(_digits(s)) <= 19 and luhn(_digits(s))
    return PHONE.fullmatch(s) is not None and 8 <= len(_digits(s)) <= 15


_AT = re.compile(r"\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+|\s+@\s*|\s*@\s+", re.I)
_DOT = re.compile(r"\s*[(\[{]\s*(?:dot|\.)\s*[)\]}]\s*|\s+dot\s+|\s+\.\s+", re.I)
_DATE = re.compile(r"\d{4}([-./ ])\d{1,2}\1\d{1,2}|\d{1,2}([-./ ])\d{1,2}\2\d{2,4}")
_GROUPS = re.compile(r"\(?\d{1,5}\)?(?:[ ./-]{1,3}\(?\d{1,5}\)?){1,6}")


def plausible(kind: str, s: str) -> bool:
    """Whether ``s`` is a value of the kind in a form that the rules do not know: spelled out, or with other separators."""
    if kind == "email":
        return valid("email", _DOT.sub(".", _AT.sub("@", s)))
    if kind == "ip":
        return valid("ip", _DOT.sub(".", s))
    if kind == "card":
        own = _digits(s)
        return re.fullmatch(r"\d(?:[ ._/-]{0,2}\d)+", s) is not None and 15 <= len(own) <= 19 and luhn(own)
    return _GROUPS.fullmatch(s.removeprefix("+")) is not None and 8 <= len(_digits(s)) <= 15 and not _DATE.fullmatch(s) and not IP.fullmatch(s)


def _emails(text: str) -> Iterator[re.Match]:
    """Leftmost matches that do not overlap: at the begin of a run of characters, or where the last match cut one."""
    at = 0
    while m := (at and EMAIL.match(text, at)) or _EMAIL_START.search(text, at):
        yield m
        at = m.end()


def rule_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap; matches that fail their check are dropped, not tried again."""
    out = [("email", m.start(), m.end()) for m in _emails(text)] if "@" in text else []
    for kind, pattern, sign in (("ip", _IP_START, "."), ("card", CARD, ""), ("phone", PHONE, "+")):
        if sign in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold a span: those around a digit, an @, or a spelled-out one; elsewhere all is outside."""
    out: list[tuple[int, int]] = []
    for m in _SIGN.finditer(text):
        a, b = max(0, m.start() - STRIDE), min(len(text), m.end() + STRIDE)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """Overlapping windows over a region."""
    return [(at, min(at + WINDOW, b)) for at in range(a, max(a + 1, b - STRIDE), STRIDE)]


def _region_emissions(parts: list[tuple[np.ndarray, int, int]], tagger: Tagger, batch: int) -> list[np.ndarray]:
    """Emissions of each region (codes of its text, begin, end): the mean over the windows that hold a character, weighted by its distance from their ends."""
    sums = [np.zeros((b - a, LABELS), np.float32) for _, a, b in parts]
    weights = [np.zeros((b - a, 1), np.float32) for _, a, b in parts]
    where = [(k, x, y) for k, (_, a, b) in enumerate(parts) for x, y in windows(a, b)]
    for at in range(0, len(where), batch):
        some = where[at : at + batch]
        ids = np.zeros((WINDOW, len(some)), np.uint8)
        for row, (k, x, y) in enumerate(some):
            ids[: y - x, row] = parts[k][0][x:y]
        e = tagger.emissions(ids)
        for row, (k, x, y) in enumerate(some):
            n, a = y - x, parts[k][1]
            weight = np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)).astype(np.float32)[:, None]
            sums[k][x - a : y - a] += weight * e[:n, row]
            weights[k][x - a : y - a] += weight
    return [s / w for s, w in zip(sums, weights)]


def _cut(e: np.ndarray) -> list[int]:
    """Ends of the parts that a region is decoded in: each within STRIDE characters of a multiple of REGION, where outside leads most."""
    ends, lead = [], e[:, 0] - e[:, 1:].max(axis=1)
    for at in range(REGION, len(e) - STRIDE, REGION):
        ends.append(at - STRIDE + int(lead[at - STRIDE : at + STRIDE].argmax()))
    for k in ends:
        e[k, 1:] = NEVER  # so that no span runs over it
    return [*ends, len(e)]


def tagged_spans(texts: list[str], tagger: Tagger, batch: int = 256) -> list[list[tuple[Span, float]]]:
    """The tagger's spans in each text, with their log odds against no span.

    Emissions of overlapping windows are put together first; then each region
    has one label sequence, the best of all under the transitions, so that spans
    agree wherever windows began.
    """
    codes = {k: encode(text) for k, text in enumerate(texts) if _SIGN.search(text)}
    parts = [(k, a, b) for k in codes for a, b in regions(texts[k])]
    jobs = []
    for (k, a, _), e in zip(parts, _region_emissions([(codes[k], a, b) for k, a, b in parts], tagger, batch)):
        start = 0
        for end in _cut(e):
            if end > start:
                jobs.append((k, a + start, e[start:end]))
            start = end
    jobs.sort(key=lambda job: -len(job[2]))
    move, out = tagger.moves(), [[] for _ in texts]
    for at in range(0, len(jobs), batch):
        some = jobs[at : at + batch]
        e = np.zeros((len(some[0][2]), len(some), LABELS), np.float32)
        for row, (_, _, own) in enumerate(some):
            e[: len(own), row] = own
        tags = tagger.decode(e, np.array([len(own) for _, _, own in some]))
        for row, (k, first, own) in enumerate(some):
            t = tags[: len(own), row]
            for start in np.flatnonzero(t % 2 == 1):
                end = start + 1
                while end < len(t) and t[end] == t[start] + 1:
                    end += 1
                span = np.arange(start, end)
                odds = float((own[span, t[span]] - own[span, 0]).sum())
                before, after = [0 if start == 0 else t[start - 1]], t[end : end + 1].tolist()
                for sign, path in ((1, [*before, *t[span], *after]), (-1, [*before, *[0] * len(span), *after])):
                    odds += sign * float(move[path[:-1], path[1:]].sum())
                out[k].append(((KINDS[(t[start] - 1) // 2], int(first + start), int(first + end)), odds))
    return out


def find(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(rule spans, all spans) of each text, by kind and start.

    The tagger adds what the rules lose (values that run into others) and forms
    that they do not know: its spans count if they touch no rule span and are
    well-formed values of their kind, or plausible ones of which it is sure.
    """
    out = []
    for text, more in zip(texts, tagged_spans(texts, tagger)):
        base = rule_spans(text) if _SIGN.search(text) else []
        added = [s for s, odds in more if (valid(s[0], v := text[s[1] : s[2]]) or odds >= LEAST_ODDS and plausible(s[0], v)) and all(s[2] <= b[1] or s[1] >= b[2] for b in base)]
        order = lambda s: (KINDS.index(s[0]), s[1], s[2])
        out.append((sorted(base, key=order), sorted({*base, *added}, key=order)))
    return out


# -- training ---------------------------------------------------------------


def _made(rng: np.random.Generator, contexts: list[str]) -> tuple[str, list[Span]]:
    """A text with values of several kinds, alone, side by side, or next to look-alikes, in a context of the corpus."""

    def number(n: int) -> str:
        return "".join(str(d) for d in rng.integers(0, 10, n))

    def word() -> str:
        return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))

    def some(*forms: str) -> str:
        return str(rng.choice(forms))

    def value(kind: str) -> str:
        """A value, in half of the cases in a form that the rules do not know."""
        own = rng.random() < 0.5
        if kind == "email":
            name, host, end = f"{word()}{some('.', '_', '', '-')}{number(rng.integers(0, 4))}{word()[:2]}", f"{word()}{some('', number(1))}", some("com", "org", "example.com", "net", "de")
            at, dot = (("@", "."), (" (at) ", " (dot) "), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", "."))[0 if own else int(rng.integers(1, 7))]
            return f"{name}{at}{host}{dot}{end.replace('.', dot)}"
        if kind == "ip":
            return ("." if own else some("[.]", "(.)", "[.]", " . ")).join(str(x) for x in rng.integers(1, 256, 4))
        if kind == "card":
            body = number(15)
            full = next(body + str(d) for d in range(10) if luhn(body + str(d)))
            cut = some("", " ", "-", "") if own else some(".", "  ", "/", " - "[:2], "_")
            return cut.join(full[i : i + 4] for i in range(0, 16, 4))
        form = some("+1 ({0}) {1}-{2}", "+1 {0} {1} {2}", "+49 {0} {1}{2}", "+33 {0} {1} {2}", "+1-{0}-{1}-{2}") if own else some("({0}) {1}-{2}", "{0}-{1}-{2}", "0{0} {1} {2}", "0{0}/{1}{2}", "00{3} {0} {1} {2}", "{0}.{1}.{2}", "0{0} - {1} {2}")
        return form.format(number(3), number(3), number(4), number(2))

    def other() -> str:
        digits = lambda n: number(n)
        hexed = "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, 40))
        return some(
            digits(rng.integers(1, 9)), f"{digits(1)}.{digits(1)}", f"{digits(2)}.{digits(2)}.20{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(3)},{digits(2)}", f"{digits(2)}%", f"{word()}@", f"@{word()}",
            f"{word()}{digits(3)}{word()}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f'"{hexed}"', hexed[:20], f"{digits(2)}:{digits(2)}:{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}", f"{digits(1)}-{digits(1)}", f"{digits(3)} {digits(3)}", f"{digits(2)}/{digits(2)}/20{digits(2)}",
            f"{digits(4)}-{digits(4)}", f"at {word()}", f"looked at {word()} and {word()}", f"dot {word()}", f"{digits(1)}.{digits(1)}. ", f"{digits(2)} {word()} {digits(4)}", f"{digits(16)}",
        )

    parts, spans, at = [], [], 0
    left = str(rng.choice(contexts))[-int(rng.integers(0, 50)) :]
    for k in range(int(rng.integers(1, 4))):
        glue = left + " " if not k else str(rng.choice([" ", " ", ", ", " " + str(rng.choice(contexts))[:20] + " "]))
        parts.append(glue)
        at += len(glue)
        kind = str(rng.choice([*KINDS, "phone", "card", "none"]))
        s = other() if kind == "none" else value(kind)
        if kind != "none":
            spans.append((kind, at, at + len(s)))
        parts.append(s)
        at += len(s)
    tail = str(rng.choice([". ", " ", ", ", "\n"])) + str(rng.choice(contexts))[: int(rng.integers(0, 50))]
    return "".join(parts) + tail, spans


def _labelled(text: str, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        tags[a:b] = 2 + 2 * KINDS.index(kind)
        tags[a] -= 1
    return tags


def train(found: list[str], seed: int = 3, epochs: int = 6, made: int = MADE_WINDOWS) -> Tagger:
    """A tagger from labelled spans: those of the rules in stretches of the corpus, and made ones in such contexts.

    Stretches in which a rule's match failed its check are left out, as the
    rules do not know what is right there.
    """
    rng = np.random.default_rng(seed)
    contexts = sorted({re.sub(r"[^\w\s,.]|[0-9_]", "", x) for x in found} | {"the words around it are plain ones, nothing else"})
    examples = [_made(rng, contexts) for _ in range(made)]
    for text in found:
        whole = [(k, m.start(), m.end()) for k, p in zip(KINDS, (EMAIL, _IP_START, CARD, PHONE)) for m in p.finditer(text) if k != "card" or len(_digits(m[0])) > 10]
        if set(whole) == set(rule_spans(text)):
            examples.append((text, whole))
    ids, tags = np.zeros((len(examples), WINDOW), np.int64), np.zeros((len(examples), WINDOW), np.int64)
    for row, (text, spans) in enumerate(examples):
        start = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        own = _labelled(text, spans)[start : start + WINDOW]
        if len(own) and own[0] and own[0] % 2 == 0:
            own[0] -= 1
        ids[row, : len(own)], tags[row, : len(own)] = encode(text)[start : start + WINDOW], own
    tagger = Tagger()
    tagger.train(ids, tags, epochs=epochs)
    return tagger.frozen()


def fit(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = CORPUS_WINDOWS) -> Tagger:
    """Trains on at most ``limit`` stretches of the corpus, around the first digit or @ of a text, the first in the order of a hash of ids.

    Null texts and those without such a sign give none; repeated rows and null
    ids count like others; other columns are not read.  An empty table gives a
    tagger that has seen made values only.
    """
    rows = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
    first = F.regexp_instr("text", F.lit("[0-9@]"))
    near = rows.withColumn("at", first).where("at > 0").select(F.xxhash64("key", F.lit(9)).alias("h"), F.substring("text", F.greatest(F.lit(1), F.col("at") - STRIDE), F.lit(WINDOW)).alias("text"))
    first = near.orderBy("h", "text").limit(limit)
    return train([r["text"] for r in first.collect()])


# -- operators --------------------------------------------------------------

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _span_array(rows: list[list[Span]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in rows], kind)


def detect(spark: SparkSession, docs: DataFrame, tagger: Tagger, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): spans of the rules, and all, in every whole text; offsets are code points, ends exclusive.

    Null and empty texts hold none.  Repeated rows give a row each, a null id
    stays null, an empty table gives no rows; other columns are not read.
    """
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(tagger)

    def run(batches):
        drop_state()
        for batch in batches:
            found = [f for texts in in_groups(batch.column(1)) for f in find(texts, shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _span_array([f[0] for f in found]), _span_array([f[1] for f in found])], names=["doc_id", "base", "spans"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id long, base {SPANS}, spans {SPANS}")


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of rule spans of each kind, n_spans (of all spans), base_sha256, spans, and n_added (spans of the tagger alone)."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def redacted(text: str, spans: list[Span]) -> str:
    """Spans replaced by ``[EMAIL]`` and so on; overlapping ones by the kind of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(spark: SparkSession, docs: DataFrame, tagger: Tagger, *, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with all spans replaced in the text and n_chars (if there is one) set anew.

    Other columns, whatever their names, stay as they are.  A null text stays
    null, with a null n_chars; an empty one stays empty.  Repeated rows give a
    row each; an empty table gives no rows.
    """
    bound_batches(spark)
    shared, names = spark.sparkContext.broadcast(tagger), docs.columns
    where = names.index(text_col)

    def run(batches):
        drop_state()
        for batch in batches:
            texts = [t for group in in_groups(batch.column(where)) for t in (redacted(x, f[1]) for x, f in zip(group, find(group, shared.value)))]
            known = batch.column(where).is_valid().to_pylist()
            columns = list(batch.columns)
            columns[where] = pa.array([t if k else None for t, k in zip(texts, known)], batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(chars_col, F.when(F.col(text_col).isNotNull(), F.length(text_col)).cast(docs.schema[chars_col].dataType)) if chars_col in names else out
