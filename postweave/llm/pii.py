"""Personal data by exact patterns and a semi-Markov conditional random field.

The base patterns find e-mail addresses, IP addresses, card and phone numbers in every whole text. The
field adds spans that the patterns miss, such as a phone number without its plus sign or an address with
``[at]``. It scores whole candidate segments (digit counts, checksums, shapes, separators, neighbours)
for every type at once; dynamic programming over the tokens, with entities of at most ``MAX_TOKENS``
tokens, chooses boundaries and types jointly. A span is added if its segment beats plain text by
``margin`` nats and touches no base span.

The weights are fitted by conditional likelihood on windows around the base spans of at most
``train_docs`` documents, those with the smallest key hash among all that contain a digit or an at sign,
and on rewritten forms of those spans: other separators for positives, broken checksums and parts above
255 for negatives. A few fixed windows make sure that every type occurs.

Defined cases: null and empty texts have no spans; repeated rows are scanned alike; a null id stays null;
empty tables give empty results. Extra columns are left out, whatever their names; of overlapping spans with equal scores the first path found stays. Texts are scanned
whole: windows start at digits and at signs and run on to white space, and windows of over
``PIECE`` tokens are decoded in overlapping pieces. Every scan is linear in the text, whatever it repeats.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.llm.common import SPACES, text_of

KINDS = ["email", "ip", "card", "phone"]
MAX_TOKENS = 24
PIECE = 512
#: Characters of a window on either side of a trigger; it runs on to the next white space.
AROUND = 40
TRAIN_DOCS = 100
MARGIN = 1.0
BLANK = re.compile(r"[\x20\x09-\x0D]")
TRIGGER = re.compile(r"[0-9@]|\[at\]|\(at\)")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")

# The patterns of the query's contract, written so that no start is tried twice.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def ip_parts_fit(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            spans.append(("email", start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    spans += [("ip", *m.span()) for m in IP.finditer(text) if ip_parts_fit(m[0])]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            spans.append(("phone", *m.span()))
    return spans


class Window:
    """A stretch of tokens around triggers: their places in the text, and the candidate segments."""

    def __init__(self, text: str, bounds: list[tuple[int, int]]) -> None:
        self.text, self.bounds = text, bounds
        self.segments: list[tuple[int, int]] = []
        rows = []
        tokens = [text[a:b] for a, b in bounds]
        for s, first in enumerate(tokens):
            if not (first[0].isascii() and (first[0].isalnum() or first in "+(")):
                continue
            digits, at = 0, False
            for e in range(s, min(len(tokens), s + MAX_TOKENS)):
                token = tokens[e]
                if token == "\n":
                    break
                digits += len(token) if token.isascii() and token.isdigit() else 0
                at = at or token == "@" or token == "at"
                if (token.isascii() and token.isalnum()) and (digits >= 7 or digits >= 4 and "." in tokens[s:e] or at and "." in tokens[s:e]):
                    self.segments.append((s, e + 1))
                    rows.append(features(text, bounds[s][0], bounds[e][1]))
        self.values = np.array(rows, dtype=np.float64).reshape(len(rows), FEATURES)


CARD_SHAPE = re.compile(r"\d{4}([^0-9A-Za-z])\d{4}\1\d{4}\1\d{1,7}$")
EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+ ?(@|\[at\]|\(at\)) ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$")
PHONE_SHAPE = re.compile(r"\+?\d{0,3}[ .-]?\(?\d{2,4}\)?[ ./-]?\d{2,4}([ ./-]\d{2,5}){0,3}$")
GROUPED_PHONE = re.compile(r"(\+\d{1,3} )?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}$")
IP_SHAPE = re.compile(r"\d+\.\d+\.\d+\.\d+$")


def features(text: str, start: int, end: int) -> list[float]:
    """What the field knows of a whole span."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    n = len(digits)
    letters = sum(c.isalpha() for c in span)
    before, after = text[start - 1:start], text[end:end + 1]
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    plain = span.replace("[.]", ".").replace("(.)", ".")
    shape_ip = bool(IP_SHAPE.match(plain))
    bare = not letters
    return [
        1.0, 7 <= n <= 8, 9 <= n <= 12, 13 <= n <= 15, 16 <= n <= 19, n > 19 or n < 7,
        13 <= n <= 19 and bare and luhn(digits), 13 <= n <= 19 and not luhn(digits),
        shape_ip and ip_parts_fit(plain), shape_ip and not ip_parts_fit(plain),
        span[0] == "+", span.count("(") != span.count(")"), bare and bool(PHONE_SHAPE.match(span)),
        bare and bool(CARD_SHAPE.match(span)), bool(EMAIL_SHAPE.match(span)), letters > 0, " " in span,
        len(groups) == 1, 2 <= len(groups) <= 5, len(groups) > 5,
        (before.isalnum() or before in "+@") and before != "", after.isalnum() or after in ("@",) and after != "",
        before in ("+", ".", "-", "("), (end - start) / 20.0,
        bool(GROUPED_PHONE.match(span)),
    ]


FEATURES = 25


def windows(text: str) -> Iterator[tuple[Window, int, int]]:
    """Windows with the range of token starts that each one decides."""
    runs: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        low, high = max(0, m.start() - AROUND), m.end() + AROUND
        done = runs[-1][1] if runs else 0
        if high <= done:
            continue
        # On to the next white space, so that no word is cut; what a window before has is not walked again.
        while low > done and text[low - 1] not in SPACES:
            low -= 1
        after = BLANK.search(text, high)
        high = after.start() if after else len(text)
        if runs and low <= done:
            runs[-1][1] = high
        else:
            runs.append([low, high])
    for low, high in runs:
        bounds = [m.span() for m in TOKEN.finditer(text, low, min(high, len(text)))]
        for at in range(0, len(bounds), PIECE - MAX_TOKENS):
            last = at + PIECE >= len(bounds)
            part = bounds[at:at + PIECE]
            yield Window(text, part), 0, len(part) if last else PIECE - MAX_TOKENS
            if last:
                break


def log_add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


class Field:
    """Weights of the field: one vector per kind; plain text scores 0 a token; ``touch`` scores an
    entity that starts where another ends."""

    def __init__(self) -> None:
        self.weights = np.zeros((FEATURES, len(KINDS)))
        self.touch = 0.0

    def scores(self, window: Window) -> np.ndarray:
        return window.values @ self.weights

    def ending(self, window: Window) -> dict[int, list[int]]:
        by_end: dict[int, list[int]] = {}
        for i, (_, e) in enumerate(window.segments):
            by_end.setdefault(e, []).append(i)
        return by_end

    def best(self, window: Window) -> list[tuple[str, int, int, float]]:
        """The best path's entities: (kind, first token, end token, score)."""
        n = len(window.bounds)
        if not window.segments:
            return []
        scores = self.scores(window)
        top, kinds = scores.max(axis=1).tolist(), scores.argmax(axis=1).tolist()
        ends = self.ending(window)
        # After plain text (0) or an entity (1): value and way back.
        value = [[0.0, -np.inf]] + [[-np.inf, -np.inf] for _ in range(n)]
        back: list[list] = [[None, None] for _ in range(n + 1)]
        for p in range(1, n + 1):
            value[p][0] = max(value[p - 1])
            back[p][0] = int(value[p - 1][1] > value[p - 1][0])
            for i in ends.get(p, ()):
                s = window.segments[i][0]
                for state in (0, 1):
                    v = value[s][state] + top[i] + self.touch * state
                    if v > value[p][1]:
                        value[p][1], back[p][1] = v, (i, state)
        found, p, state = [], n, int(value[n][1] > value[n][0])
        while p > 0:
            if state == 0:
                p, state = p - 1, back[p][0]
            else:
                i, state = back[p][1]
                found.append((KINDS[kinds[i]], *window.segments[i], top[i]))
                p = window.segments[i][0]
        return found[::-1]

    def gradient(self, window: Window, gold: dict[tuple[int, int], int]) -> tuple[np.ndarray, float]:
        """Of the log-likelihood of the gold entities {(first, end): kind}, by forward and backward sums."""
        n, m = len(window.bounds), len(window.segments)
        scores = self.scores(window)
        sums = np.logaddexp.reduce(scores, axis=1) if m else np.zeros(0)
        total = sums.tolist()
        ends, starts = self.ending(window), {}
        for i, (s, _) in enumerate(window.segments):
            starts.setdefault(s, []).append(i)
        low = -1e30
        ahead = [[0.0, low]] + [[low, low] for _ in range(n)]
        for p in range(1, n + 1):
            ahead[p][0] = log_add(*ahead[p - 1])
            for i in ends.get(p, ()):
                s = window.segments[i][0]
                here = log_add(ahead[s][0], ahead[s][1] + self.touch) + total[i]
                ahead[p][1] = log_add(ahead[p][1], here)
        behind = [[low, low] for _ in range(n)] + [[0.0, 0.0]]
        for p in range(n - 1, -1, -1):
            for state in (0, 1):
                value = behind[p + 1][0]
                for i in starts.get(p, ()):
                    e = window.segments[i][1]
                    value = log_add(value, behind[e][1] + total[i] + self.touch * state)
                behind[p][state] = value
        z = log_add(*ahead[n])
        path, touching = np.zeros(m), 0.0
        for i, (s, e) in enumerate(window.segments):
            touch = math.exp(ahead[s][1] + self.touch + total[i] + behind[e][1] - z)
            path[i] = math.exp(ahead[s][0] + total[i] + behind[e][1] - z) + touch
            touching += touch
        expected = path[:, None] * np.exp(scores - sums[:, None])
        observed, seen, last = np.zeros((m, len(KINDS))), 0.0, None
        for i, (s, e) in enumerate(window.segments):
            if (s, e) in gold:
                observed[i, gold[(s, e)]] = 1.0
        for s, e in sorted(gold):
            seen += float(last == s)
            last = e
        return window.values.T @ (observed - expected), seen - touching


#: Windows in which every kind, and things that only look like one, occur.
SEEDS = [
    ("write to ann.lee@mail.example.com today", [("email", "ann.lee@mail.example.com")]),
    ("host 10.20.30.40 is down", [("ip", "10.20.30.40")]),
    ("paid with 4379362835490466 now", [("card", "4379362835490466")]),
    ("call +1 (310) 555-4510 again", [("phone", "+1 (310) 555-4510")]),
    ("version 12.400.3.1999 and 2024-01-15 or 1234567", []),
    ("token 2321bac4d15ec8f90433955bf9d3cf61da5bdd1e and 99999999999999999999999", []),
]


def rewritten(kind: str, span: str, rng: random.Random) -> list[tuple[str, str | None]]:
    """Other forms of a span with their kind, None for what is no personal data."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "email":
        apart, close = rng.choice([" [at] ", " (at) "]), rng.choice(["[at]", "(at)"])
        return [(span.replace("@", apart), kind), (span.replace("@", close), kind), (span.replace("@", " "), None)]
    if kind == "ip":
        parts = span.split(".")
        dot, wide = rng.choice(["[.]", "(.)"]), [*parts[:3], str(rng.randint(256, 999))]
        return [(".".join(wide), None), (".".join(parts[:3]), None), (dot.join(parts), kind), (dot.join(wide), None)]
    if kind == "card":
        grouped = rng.choice([".", "/"]).join(digits[i:i + 4] for i in range(0, len(digits), 4))
        broken = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        return [(grouped, kind), (broken, None), ("-".join(broken[i:i + 4] for i in range(0, len(broken), 4)), None)]
    local = digits[-10:]
    if len(local) < 10:
        return []
    return [(f"({local[:3]}) {local[3:6]}-{local[6:]}", kind), (f"{local[:3]}-{local[3:6]}-{local[6:]}", kind),
            (f"{local[:3]}.{local[3:6]}.{local[6:]}", kind), (local, None), (local[:8], None)]


def fit_field(texts: list[str], epochs: int = 20, rate: float = 0.5, seed: int = 0, most: int = 60) -> Field:
    """Maximum conditional likelihood on windows around at most ``most`` spans of the texts, by
    adaptive gradient steps with a small quadratic penalty."""
    rng = random.Random(seed)
    cases: list[tuple[str, list[tuple[str, int, int]]]] = []

    def case(before: str, span: str, after: str, kind: str | None) -> None:
        text = before + span + after
        cases.append((text, [(kind, len(before), len(before) + len(span))] if kind else []))

    for text, named in SEEDS:
        cases.append((text, [(kind, text.index(s), text.index(s) + len(s)) for kind, s in named]))
    every = [(text[max(0, s - AROUND):s], text[s:e], text[e:e + AROUND], kind) for text in texts for kind, s, e in base_spans(text)]
    # As many of each kind, or rare kinds would be learnt from the fixed windows alone.
    examples = [x for kind in KINDS for x in [y for y in every if y[3] == kind][:most // len(KINDS)]]
    examples += [(text[:text.index(s)], s, text[text.index(s) + len(s):], kind) for text, named in SEEDS for kind, s in named]
    for before, span, after, kind in examples:
        case(before, span, after, kind)
        for other, label in rewritten(kind, span, rng):
            case(before, other, after, label)

    ready = []
    for text, spans in cases:
        bounds = [m.span() for m in TOKEN.finditer(text)]
        window = Window(text, bounds)
        starts, stops = {a: i for i, (a, _) in enumerate(bounds)}, {b: i + 1 for i, (_, b) in enumerate(bounds)}
        gold = {(starts[s], stops[e]): KINDS.index(k) for k, s, e in spans if s in starts and e in stops}
        # A case is used if its entities are among the candidate segments.
        if set(gold) <= set(window.segments) and window.segments:
            ready.append((window, gold))
    field, squares, touch_square = Field(), np.full((FEATURES, len(KINDS)), 1e-6), 1e-6
    for _ in range(epochs):
        rng.shuffle(ready)
        for window, gold in ready:
            step, touch = field.gradient(window, gold)
            step -= 0.0005 * field.weights
            squares += step ** 2
            touch_square += touch ** 2
            field.weights += rate * step / np.sqrt(squares)
            field.touch += rate * touch / touch_square ** 0.5
    return field


def added_spans(field: Field, text: str, base: list[tuple[str, int, int]], margin: float) -> list[tuple[str, int, int]]:
    """The field's spans that touch no base span."""
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e in sorted(base, key=lambda x: x[1]):  # spans of different kinds may overlap
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    found = []
    for window, low, high in windows(text):
        for kind, s, e, score in field.best(window):
            start, end = window.bounds[s][0], window.bounds[e - 1][1]
            # The first span that ends after the start must begin at or after the end.
            at = bisect_right(ends, start)
            if low <= s < high and score >= margin and (at == len(starts) or starts[at] >= end):
                found.append((kind, start, end))
                starts.insert(at, start)
                ends.insert(at, end)
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def training_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> list[str]:
    """At most ``train_docs`` texts that contain a digit or an at sign, by the smallest hash of id and text.

    The hashes alone are ranked first, so tasks send no texts that are not used."""
    hashed = docs.select(text_of(text_col).alias("t"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    hashed = hashed.filter(F.col("t").rlike("[0-9]{2}|@"))
    last = hashed.select("h").distinct().orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    if last is None:
        return []
    chosen = hashed.filter(F.col("h") <= last).groupBy("h").agg(F.min("t").alias("t"))
    return [r["t"] for r in chosen.orderBy("h").limit(train_docs).collect()]


def find_personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text",
                       margin: float = MARGIN) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if TRIGGER.search(text) else []
                more = added_spans(field, text, base, margin) if TRIGGER.search(text) else []
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            if out:
                columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in list(zip(*out))[:4]),
                           *(pa.array(c, pa.string()) for c in list(zip(*out))[4:])]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = f"_id {dict(docs.dtypes)[id_col]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(scan, schema).withColumnRenamed("_id", id_col)
