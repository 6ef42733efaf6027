"""Personal data by exact detectors and a semi-Markov conditional random field.

Four detectors with fixed patterns find e-mail addresses, IP addresses, card numbers and phone numbers. Around every token
with a digit, an at-sign or an equals sign, key markers, words that announce a secret, and long tokens, a semi-Markov
model then labels segments of at most ``LONGEST`` tokens: features of a whole candidate span and of the tokens before it
score each type, and dynamic programming chooses boundaries and types of a window jointly. Its weights start from a prior,
that a kind is rare and has a shape of its own, and are fitted to examples of each kind and to at most ``WINDOWS`` windows of
the corpus, chosen by a hash, in which the detectors and patterns of credentials and account numbers give the segments.
Its spans come on top; the detectors' spans always stay.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import pieces, table, written

KINDS = ("email", "ip", "card", "phone", "secret", "id")
BASE = KINDS[:4]
LONGEST, AROUND, AT_ONCE = 8, 3, 256
TEXTS, WINDOWS, PART, EPOCHS = 20_000, 1500, 60, 10  # texts that windows are drawn from, windows, tokens of one, passes

# The patterns of the contract.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What weak labels and features look for.
_SECRETS = re.compile(
    r"\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*|-----(?:BEGIN|END) [A-Z ]*KEY-----"
    r"|(?:password|passwd|pwd|secret|token|api[_-]?key)\b[\"']?\s{0,2}[=:]\s{0,2}[\"']?(?P<value>[A-Za-z0-9+/_.=-]{8,})",
    re.I,
)
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_CUES = [re.compile(x, re.I) for x in (r"password|passwd|pwd|secret|token|api.?key|credential|private key", r"phone|tel\b|tel\.|call|mobil|fax", r"iban|account|konto|ssn|social|passport|compte|cuenta", r"card|visa|credit|karte|tarjeta|carte")]
_ANNOUNCING = ("password", "passwd", "pwd", "secret", "token", "api", "credential", "private key")  # one is in whatever the first cue finds
_ANCHOR = re.compile(r"[0-9@=]")
_LONG = re.compile(r"[A-Za-z+/_-]{24}")
_TOKEN = re.compile(r"\S{1,256}")
_OPENING, _CLOSING = "\"'([{<", ".,;:!?)\"'>]}%$&*#~^|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the four detectors, leftmost and not overlapping within a kind, by start and then kind."""
    out: list[tuple[int, int, str, int]] = []
    at = text.find("@")
    last = 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, 0, "email", found.end()))
            last = found.end()
        else:
            last = at + 1
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, "phone", m.end()))
    return [(a, kind, b) for a, _, kind, b in sorted(out)]


def iban(text: str) -> bool:
    """Whether the check digits of an account number are right."""
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and plain.isalnum() and plain.isascii() and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _calls(text: str, start: int, end: int) -> bool:
    """Whether a token opens a window."""
    if _ANCHOR.search(text, start, end) or end - start >= 24 and _LONG.search(text, start, end) or text.startswith("-----", start):
        return True
    return end - start < 24 and _CUES[0].search(text, start, end) is not None


def _announces(text: str) -> bool:
    """Whether a word in the text announces a secret. Plain searches come first, as the pattern is slow; three letters match it that lower case doesn't show."""
    low = text.lower()
    return (any(word in low for word in _ANNOUNCING) or any(c in text for c in "\u0130\u0131\u017f")) and _CUES[0].search(text) is not None


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans around what calls for a window; windows that would meet are one. Tokens lose punctuation around them."""
    if not (_ANCHOR.search(text) or "-----" in text or _LONG.search(text) or _announces(text)):
        return  # no token calls for one
    before: list[tuple[int, int]] = []
    open_: list[tuple[int, int]] = []
    quiet = 0
    for m in _TOKEN.finditer(text):
        core = m[0].rstrip(_CLOSING)
        inner = core.lstrip(_OPENING)
        span = (m.start() + len(core) - len(inner), m.start() + len(core)) if inner else (m.start(), m.start() + 1)
        if _calls(text, *span):
            if not open_:
                open_ = before[-AROUND:]
            open_.append(span)
            quiet = 0
        elif open_:
            open_.append(span)
            quiet += 1
            if quiet > 2 * AROUND:
                yield open_[: len(open_) - AROUND]
                before, open_ = open_[-AROUND:], []
        else:
            before = [*before[-AROUND:], span]
    if open_:
        yield open_


# Shapes of whole spans; those of each kind follow.
_SHAPES = [
    re.compile(r"[^@\s]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"), re.compile(r"[0-9]([ -]?[0-9])*"), re.compile(r"[0-9]([ -]?[0-9]){13,18}"), re.compile(r"(?=(?:[^0-9]*[0-9]){10})\+[0-9][ ().0-9-]+[0-9]"), re.compile(r"(?=(?:[^0-9]*[0-9]){10})\(?[0-9][ ().0-9-]+[0-9]"),
    re.compile(r"(?=.*[A-Z])(?=.*[0-9])[A-Z0-9]{16,}"), re.compile(r"(?i)(?=.*[a-f])(?=.*[0-9])[0-9a-f]{24,}"), re.compile(r"[A-Za-z_-]+[=:]\S{8,}"), re.compile(r"(?=.*[0-9+/_-])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_.=-]{20,}"),
    re.compile(r"-----[A-Z ]+-----"), re.compile(r"(AKIA|AIza|gh[pousr]_|sk[-_]|xox[a-z]-|eyJ|glpat-)[A-Za-z0-9_.-]{12,}"), re.compile(r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{2,4}){3,8}"), re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), re.compile(r"[^0-9@=]+"), re.compile(r"[0-9]{1,4}([./:-][0-9]{1,4}){1,2}"),
]
_FITS = {"email": (0,), "ip": (1,), "card": (3,), "phone": (4, 5), "secret": (6, 7, 8, 9, 10, 11), "id": (12, 13)}
N_FEATURES = 1 + LONGEST + len(_SHAPES) + len(KINDS) + 7 + 2 + len(_CUES) + 4
_OF_KIND = 1 + LONGEST + len(_SHAPES)


def _prior() -> np.ndarray:
    """Weights ``[kind, feature]`` before any fit: a kind is rare, most of all where its shape doesn't fit."""
    out = np.zeros((len(KINDS) + 1, N_FEATURES))
    for k in range(len(KINDS)):
        out[k + 1, 0], out[k + 1, _OF_KIND + k] = -5, 4
    return out


def features(text: str, start: int, end: int, tokens: int, previous: str) -> np.ndarray:
    """What a whole span looks like: its length, shapes, digits, checksums and edges, and a cue in or before it."""
    span = text[start:end]
    out = np.zeros(N_FEATURES)
    out[0] = 1
    out[tokens] = 1
    at = 1 + LONGEST
    for i, shape in enumerate(_SHAPES):
        out[at + i] = shape.fullmatch(span) is not None
    for k, kind in enumerate(KINDS):
        out[_OF_KIND + k] = any(out[at + i] for i in _FITS[kind])
    at = _OF_KIND + len(KINDS)
    digits = _digits(span)
    out[at + (0 if not digits else 1 if len(digits) < 4 else 2 if len(digits) < 10 else 3 if len(digits) < 14 else 4 if len(digits) < 16 else 5 if len(digits) < 20 else 6)] = 1
    at += 7
    out[at] = len(digits) >= 14 and luhn(digits)
    out[at + 1] = bool(out[1 + LONGEST + 12]) and iban(span)
    at += 2
    for i, cue in enumerate(_CUES):
        out[at + i] = cue.search(previous) is not None
    at += len(_CUES)
    out[at] = _CUES[0].search(span) is not None
    out[at + 1] = span.split(" ", 1)[0].isalpha()
    out[at + 2] = span.rsplit(" ", 1)[-1].isalpha()
    out[at + 3] = "\n" in span
    return out


def lattice(text: str, tokens: list[tuple[int, int]], first: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of the candidate segments that begin at tokens ``first`` to ``stop``, ``[token - first, tokens - 1]``, and which are candidates.

    Every token is one; several are where each holds a digit or is written in capitals.
    """
    n = len(tokens)
    stop = n if stop is None else min(stop, n)
    out, may = np.zeros((stop - first, LONGEST, N_FEATURES)), np.zeros((stop - first, LONGEST), bool)
    for i in range(first, stop):
        previous = text[max(tokens[max(0, i - 2)][0], tokens[i - 1][1] - 64) : tokens[i - 1][1]] if i else ""
        for k in range(min(LONGEST, n - i)):
            word = text[tokens[i + k][0] : tokens[i + k][1]]
            part = any("0" <= c <= "9" for c in word) or word.isupper()
            if k and not part:
                break
            out[i - first, k], may[i - first, k] = features(text, tokens[i][0], tokens[i + k][1], k + 1, previous), True
            if not part:
                break
    return out, may


def _scores(x: np.ndarray, may: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``[first, tokens - 1, kind]``, kind 0: outside, which only single tokens can be."""
    s = np.where(may[..., None], x @ weights.T, -np.inf)
    s[:, 1:, 0] = -np.inf
    return s


def segmented(kinds: np.ndarray, tops: np.ndarray) -> list[tuple[int, int, int]]:
    """The best way to cut tokens into segments: ``tops[i, k]`` is the score of the ``k + 1`` tokens from ``i`` as ``kinds[i, k]``."""
    n, longest = tops.shape
    best = np.full(n + 1, -np.inf)
    best[0] = 0
    back = np.zeros(n + 1, np.int64)
    for j in range(1, n + 1):
        for k in range(min(longest, j)):
            score = best[j - 1 - k] + tops[j - 1 - k, k]
            if score > best[j]:
                best[j], back[j] = score, k
    out = []
    j = n
    while j:
        i = j - 1 - int(back[j])
        out.append((i, j, int(kinds[i, back[j]])))
        j = i
    return out[::-1]


def decode(text: str, tokens: list[tuple[int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """``(first token, end token, kind)`` of the best segmentation's segments that aren't outside.

    Features are made for ``AT_ONCE`` tokens at a time and only each segment's best kind and score are held, so a long
    window, such as a text of nothing but numbers, needs few bytes a token.
    """
    n = len(tokens)
    kinds, tops = np.zeros((n, LONGEST), np.int8), np.zeros((n, LONGEST))
    for i in range(0, n, AT_ONCE):
        s = _scores(*lattice(text, tokens, i, i + AT_ONCE), weights)
        kinds[i : i + AT_ONCE], tops[i : i + AT_ONCE] = s.argmax(axis=2), s.max(axis=2)
    return [segment for segment in segmented(kinds, tops) if segment[2]]


def _gradient(x: np.ndarray, may: np.ndarray, gold: list[tuple[int, int, int]], weights: np.ndarray) -> np.ndarray:
    """Of the log-likelihood: the gold segmentation's features less those that the model expects."""
    n, s = len(x), _scores(x, may, weights)
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0
    summed = np.logaddexp.reduce(s, axis=2)
    for j in range(1, n + 1):
        forward[j] = np.logaddexp.reduce([forward[j - 1 - k] + summed[j - 1 - k, k] for k in range(min(LONGEST, j))])
    for i in range(n - 1, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1 + k] + summed[i, k] for k in range(min(LONGEST, n - i))])
    out = np.zeros_like(weights)
    for k in range(min(LONGEST, n)):
        m = n - k
        p = np.exp(s[:m, k] + forward[:m, None] + backward[k + 1 : k + 1 + m, None] - forward[n])
        out -= p.T @ x[:m, k]
    for i, j, kind in gold:
        out[kind] += x[i, j - i - 1]
    return out


def weak_spans(text: str) -> list[tuple[int, str, int]]:
    """Credentials and account numbers that patterns give, as labels to learn from."""
    out = [(*(m.span("value") if m["value"] else m.span()), "secret") for m in _SECRETS.finditer(text)]
    out += [(*m.span(), "id") for m in _IBAN.finditer(text) if iban(m[0])] + [(*m.span(), "id") for m in _NATIONAL.finditer(text)]
    return sorted((a, kind, b) for a, b, kind in out)


def labelled(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int]], list[tuple[int, int, int]]]]:
    """A window's tokens in parts of about ``PART``, and each part's segments.

    Tokens of a detector's span that doesn't begin and end where tokens do belong to no part; a pattern's span takes the
    tokens that it meets.
    """
    low = tokens[0][0]
    starts, ends = [a - low for a, _ in tokens], [b - low for _, b in tokens]
    kinds: list[tuple[int, int, int]] = []  # segments; kind -1: unknown
    own = text[low : tokens[-1][1]]
    done = 0
    for exact, a, kind, b in sorted([(True, *x) for x in base_spans(own)] + [(False, *x) for x in weak_spans(own)], key=lambda x: (x[1], not x[0])):
        i, j = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        if i < done or j <= i:
            continue
        known = j - i <= LONGEST and (not exact or starts[i] == a and ends[j - 1] == b)
        kinds += [(k, k + 1, 0) for k in range(done, i)] + [(i, j, KINDS.index(kind) + 1 if known else -1)]
        done = j
    kinds += [(k, k + 1, 0) for k in range(done, len(tokens))]
    part: list[tuple[int, int, int]] = []
    for segment in [*kinds, (len(tokens), len(tokens), -1)]:
        if segment[2] >= 0:
            part.append(segment)
        if part and (segment[2] < 0 or part[-1][1] - part[0][0] >= PART):
            first = part[0][0]
            yield tokens[first : part[-1][1]], [(i - first, j - first, kind) for i, j, kind in part]
            part = []


def examples() -> list[str]:
    """Sentences with a span of each kind, and with numbers and codes that are none, by rule."""
    rng = np.random.Generator(np.random.PCG64(7))
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    digits, hexes, capitals, letters = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = []
    for i in range(24):
        account = next(f"DE{c:02d}" + tail for tail in [pick(digits, 18)] for c in range(97) if iban(f"DE{c:02d}{tail}"))
        spaced = " ".join(account[k : k + 4] for k in range(0, len(account), 4))
        out += [
            f"pay it to {account if i % 2 else spaced} today", f"the number {pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)} is on file", f'then token = "{pick(hexes, 40)}" was set', f"with password={pick(letters + digits, 10)}7 in it", f"key AKIA{pick(capitals + digits, 16)} is live",
            f"mail {pick(letters, 5)}.{i}@{pick(letters, 6)}.org soon", f"from 10.{i}.{i * 7 % 256}.9 came", f"call +1 ({pick(digits, 3)}) 555-{pick(digits, 4)} now", f'the {["token", "secret", "password"][i % 3]}: "{pick(letters + capitals + digits, 18 + i % 9)}Qx7" is', f"use gh{'pousr'[i % 5]}_{pick(letters + capitals + digits, 36)} here", f"see\n-----BEGIN {['RSA ', 'EC ', ''][i % 3]}PRIVATE KEY-----\n{pick(letters + capitals + digits + '+/', 64)}\nand",
            f"values {' '.join(pick(digits, 1 + (i * k) % 4) for k in range(3 + i % 9))} follow", f"PAGE {i} OF {i + 3} IN PART {pick(digits, 2)}", f"part {pick(capitals, 1)}{pick(digits, 7)} was sent", f"in {1900 + i} and on 0{1 + i % 9}/1{i % 10}/20{10 + i} at 1{i % 10}:30", f"version {i}.{i % 7}.{i % 5} has {pick(digits, 5)} lines", f"order {pick(digits, 12)} costs = {pick(digits, 3)}.50", f"page {i} of {i + 9}, {pick(digits, 3)}-{pick(digits, 4)}", f"{pick(letters, 26)} is a long word, {pick(capitals, 1)}{pick(letters, 27)} too",
        ]
    return out


def fit(texts: list[str], epochs: int = EPOCHS) -> np.ndarray:
    """Weights ``[kind, feature]`` by gradient steps of sizes that adapt, from the prior and drawn to it."""
    prior = _prior()
    weights = prior.copy()
    data = []
    for text in [*examples(), *texts]:
        for window in windows(text):
            for tokens, gold in labelled(text, window):
                x, may = lattice(text, tokens)
                if all(may[i, j - i - 1] for i, j, _ in gold):
                    data.append((x, may, gold))
    sums = np.full_like(weights, 1e-3)
    for _ in range(epochs):
        for x, may, gold in data:
            g = _gradient(x, may, gold, weights) - 1e-3 * (weights - prior)
            sums += g * g
            weights += 0.3 * g / np.sqrt(sums)
    return weights


def added_spans(text: str, base: list[tuple[int, str, int]], weights: np.ndarray) -> list[tuple[int, str, int]]:
    """The model's spans that meet none of ``base``, which are sorted by start; both are passed through once."""
    out = []
    ahead, near = 0, []
    for tokens in windows(text):
        for i, j, kind in decode(text, tokens, weights):
            a, b = tokens[i][0], tokens[j - 1][1]
            while ahead < len(base) and base[ahead][0] < b:
                near.append(base[ahead])
                ahead += 1
            near = [span for span in near if span[2] > a]
            if not near:
                out.append((a, KINDS[kind - 1], b))
    return out


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def _masked(text: str, spans: list[tuple[int, str, int]]) -> str:
    out, at = [], 0
    for a, kind, b in sorted(spans, key=lambda s: (s[0], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b  # what two spans share is masked once
    return "".join([*out, text[at:]]) if out else text


def _found(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            rows = []
            for text in piece.column("text").to_pylist():
                base, spans = [], []
                if text:
                    base = base_spans(text)
                    spans = sorted(base + added_spans(text, base, weights), key=lambda s: (s[0], KINDS.index(s[1])))
                counts = [sum(kind == k for _, kind, _ in base) for k in BASE]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), _masked(text, spans) if text else text))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 3, strict=True)]
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(piece.num_columns)), *columns], [*piece.schema.names, *ADDED])

    return run


ADDED = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked")


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each part of each window, and whether it holds a segment."""
    for piece in pieces(batches, "text"):
        rows = [(text[part[0][0] : part[-1][1]], any(kind for _, _, kind in gold)) for text in piece.column("text").to_pylist() for window in windows(text) for part, gold in labelled(text, window)]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([g for _, g in rows], pa.bool_())], ["window", "holds"])


def learned(docs: DataFrame, most: int = WINDOWS) -> np.ndarray:
    """Weights from at most ``most`` windows, half of them with a segment, the first by a hash, of about ``TEXTS`` texts.

    Texts are drawn by a hash too, whatever their length; a window's parts have at most ``PART + LONGEST`` tokens of 256 characters.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    step = max(1, docs.count() // TEXTS)
    found = texts.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).mapInArrow(_sampled, "window string, holds boolean").withColumn("hash", F.xxhash64("window")).dropDuplicates(["hash"])
    found = written(found, "windows")
    chosen = [found.where(F.col("holds") == holds).orderBy("hash").limit(most // 2).collect() for holds in (True, False)]
    return fit([r["window"] for rows in chosen for r in rows])


def private_spans(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The columns of ``docs(text, ...)``, and ``n_email, n_ip, n_card, n_phone, base_sha256, spans, masked``, from whole texts.

    ``masked`` is the text with each span replaced by its kind. A null or empty text has no spans. Given columns with
    the new names are replaced; repeated rows give equal results, no rows none. Overlapping detectors' spans all stay.
    """
    docs = docs.drop(*ADDED)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_found(weights), f"{fields}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string")


def op6_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return private_spans(docs, learned(docs)).drop("text", "masked")
