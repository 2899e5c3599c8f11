"""Operator 9: personal data by base patterns and a semi-Markov conditional random field.

Base spans are those of fixed patterns and checks (e-mail addresses, IP addresses, payment cards, telephone numbers). The field adds spans
that the patterns miss, such as addresses with `(at)` and numbers without a country code. It works on islands, stretches of a text around
digits and at-signs; each candidate segment of an island, of at most `MOST_TOKENS` tokens, is scored as a whole for each kind, and dynamic
programming chooses boundaries and kinds together, in one forward walk whose work and memory grow with the length of the text. Weights
maximise the conditional likelihood (forward-backward in log space) on examples from a bounded sample of documents: base spans and rewritten
forms of them are entities, all else there is not. The sample's bounds are parameters (`Bounds`): documents, base spans and islands of each,
boundaries of an island, examples. They bound what is learned from, never what is searched.

Defined results: null and empty texts have no span; base spans always stay and added ones never overlap them; without any base span in the
sample nothing is added; repeated rows have equal results.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import keyed, longs_of, real_id, row_batch
from graphloom.session import materialise

#: The order of kinds among spans that begin together; tokens of a segment; passes over the examples and step; segments scored at once.
KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS, PASSES, STEP, DECAY, BLOCK = 24, 60, 0.3, 1e-3, 2048


@dataclass(frozen=True)
class Bounds:
    """What is learned from, at most: documents with digits or at-signs; of each document base spans that are rewritten, and islands; boundaries of an island; examples."""

    docs: int = 400
    spans: int = 2
    islands: int = 50
    boundaries: int = 400
    examples: int = 1600


# The base patterns. Starts inside a run of the same characters are left out, as they cannot match where the run's start fails.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_TRIGGER = re.compile(r"[0-9@]|[\[({] ?(?:at|dot|\.) ?[\])}]", re.I)
_CHUNK = re.compile(r"\S+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_AT = re.compile(r"@|\s?[\[({] ?at ?[\])}]\s?", re.I)
_DOT = re.compile(r"\s?[\[({] ?(?:dot|\.) ?[\])}]\s?|\.", re.I)
_DOT_WORD = re.compile(rf"(?:{_DOT.pattern})[A-Za-z0-9]", re.I)
_WORD_DOT = re.compile(rf"[A-Za-z0-9](?:{_DOT.pattern})$", re.I)
_GAP_DIGITS, _DIGITS_GAP = re.compile(r"[ .-]{1,2}[0-9]"), re.compile(r"[0-9][ .-]{1,2}$")

_RESULT = pa.schema([("id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("n_added", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
_RESULT_DDL = "id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_DIGIT = re.compile("[0-9]")


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of white-space separated chunks that hold a trigger, with a chunk on either side; gaps of up to two blanks are inside."""
    last, done = None, 0  # done: the end of the last chunk with a trigger; looking back ends there, so each character is passed once
    for m in _TRIGGER.finditer(text):
        if m.start() < done:
            continue
        start = max(done, text.rfind(" ", done, m.start()) + 1)
        start = max(start, text.rfind("\n", start, m.start()) + 1)
        e = _CHUNK.match(text, m.end())
        stop = done = e.end() if e else m.end()
        if text[done : done + 1] == " " and (after := _CHUNK.match(text, done + 1)):
            stop = after.end()
        if last is not None and start <= last[1] + 2:
            last = (last[0], max(stop, last[1]))
        else:
            if last is not None:
                yield last
            last = (start, stop)
    if last is not None:
        yield last


_FEATURES: dict[str, int] = {}


def _names() -> list[str]:
    sizes = [f"digits{b}" for b in ("0", "1-6", "7-9", "10", "11", "12-13", "14-15", "16", "17-19", "20+")]
    flags = ["bias", "at", "at1", "dots", "nodots", "plus", "paren", "quad", "octets", "octets-bad", "luhn", "luhn-bad", "letters", "noletters", "left-word", "right-word", "left-digit", "right-digit", "spaces", "nospaces", "groups1", "groups2", "groups3+", "first4", "odd-mark", "area", "right-dot", "left-dot", "right-digits", "left-digits", "open-bracket"]
    return sizes + flags


for _n in _names():
    _FEATURES[_n] = len(_FEATURES)


def segment_features(text: str, start: int, end: int) -> list[int]:
    """Indices of the features that a candidate segment has, as a whole and in its place."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n = len(digits)
    size = "0" if not n else "1-6" if n < 7 else "7-9" if n < 10 else str(n) if n < 12 else "12-13" if n < 14 else "14-15" if n < 16 else "16" if n == 16 else "17-19" if n < 20 else "20+"
    ats = _AT.findall(s)
    after = _AT.split(s)[-1] if ats else ""
    parts = [p for p in _DOT.split(s)]
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    groups = re.findall("[0-9]+", s)
    letters = bool(re.search("[A-Za-z]", s))
    left, right = text[start - 1 : start], text[end : end + 1]
    on = ["bias", f"digits{size}"]
    on += ["at"] * bool(ats) + ["at1"] * (len(ats) == 1) + ["dots" if _DOT.search(after) else "nodots"] * bool(ats)
    on += ["plus"] * s.startswith("+") + ["paren"] * s.startswith("(") + ["letters" if letters else "noletters"]
    on += ["quad"] * quad + (["octets" if all(len(p) < 4 and int(p) < 256 for p in parts) else "octets-bad"] if quad else [])
    on += ["luhn" if luhn(digits) else "luhn-bad"] * (14 <= n <= 19)
    on += ["left-word"] * bool(re.match(r"[^\W\d]", left)) + ["left-digit"] * left.isdigit() + ["right-word"] * bool(re.match(r"[^\W\d]", right)) + ["right-digit"] * right.isdigit()
    on += ["spaces" if " " in s else "nospaces", "groups1" if len(groups) < 2 else "groups2" if len(groups) == 2 else "groups3+"]
    on += ["first4"] * (len(groups) > 1 and all(len(g) == 4 for g in groups[:-1])) + ["odd-mark"] * bool(re.search(r"[^A-Za-z0-9 @().+_%\[\]{}-]", s)) + ["area"] * bool(re.match(r"\+?[0-9]{0,3} ?\(?[0-9]{3}\)?[ .-]", s))
    # what goes on beyond: a dotted name, or more groups of digits
    on += ["right-dot"] * bool(_DOT_WORD.match(text, end, end + 12)) + ["left-dot"] * bool(_WORD_DOT.search(text[max(0, start - 12) : start]))
    on += ["open-bracket"] * (sum(map(s.count, "([{")) != sum(map(s.count, ")]}")))
    on += ["right-digits"] * bool(_GAP_DIGITS.match(text, end, end + 4)) + ["left-digits"] * bool(_DIGITS_GAP.search(text[max(0, start - 4) : start]))
    return [_FEATURES[x] for x in on]


def candidates(text: str, start: int, end: int) -> tuple[array, Iterator[tuple[int, int]]]:
    """Token boundaries of an island and the segments, as pairs of boundary numbers, that could be an entity at all, by their first boundary."""
    bounds = array("q", (m.start() for m in _TOKEN.finditer(text, start, end)))
    n = len(bounds)
    bounds.append(end)
    opens, closes = bytearray(n + 1), bytearray(n + 1)
    digits, marks = array("q", [0]), array("q", [0])
    for k in range(n):
        a, b = bounds[k], bounds[k + 1]
        h = text[a]
        closes[k] = h.isascii() and h.isalnum()
        opens[k] = closes[k] or h in "+("
        digits.append(digits[-1] + (b - a if "0" <= h <= "9" else 0))
        marks.append(marks[-1] + (h == "@" or (h in "aA" and text[a:b].lower() == "at")))

    def segments() -> Iterator[tuple[int, int]]:
        for i in range(n):
            if not opens[i]:
                continue
            for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
                if closes[j - 1] and (digits[j] - digits[i] >= 7 or (j - i >= 3 and marks[j] - marks[i] == 1 and marks[i + 1] == marks[i] and marks[j - 1] == marks[j]) or (j - i >= 7 and digits[j] - digits[i] >= 4)):
                    yield i, j

    return bounds, segments()


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum([math.exp(v - top) for v in values]))


def _forward(n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log sums over all labellings before and after each boundary; scores: segments x kinds."""
    total = np.logaddexp.reduce(scores, axis=1).tolist() if len(segments) else []
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(segments):
        ends[j].append(k)
        starts[i].append(k)
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        alpha[j] = _log_sum([alpha[j - 1], *[alpha[segments[k][0]] + total[k] for k in ends[j]]]) if ends[j] else alpha[j - 1]
    for i in range(n - 1, -1, -1):
        beta[i] = _log_sum([beta[i + 1], *[beta[segments[k][1]] + total[k] for k in starts[i]]]) if starts[i] else beta[i + 1]
    return np.array(alpha), np.array(beta)


def best_labelling(n: int, scored: Iterator[tuple[int, int, float, int]]) -> list[tuple[int, int, int]]:
    """(first boundary, last boundary, kind) of the entities of the most probable labelling; scored: (first, last, score, kind) by first boundary.

    One walk forward: a boundary is settled when the first segment beyond it comes, as all segments that end there have come by then.
    """
    best, back, kind = array("d", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1))), bytearray(n + 1)
    reached = array("d", [-1.0]) * (n + 1)
    at = 0

    def settle(upto: int) -> None:
        nonlocal at
        while at < upto:
            at += 1
            if reached[at] > best[at - 1]:
                best[at] = reached[at]
            else:
                best[at], back[at] = best[at - 1], at - 1
                kind[at] = 255

    for i, j, score, k in scored:
        settle(i)
        if best[i] + score > reached[j] and score > 0:
            reached[j], back[j], kind[j] = best[i] + score, i, k
    settle(n)
    out, j = [], n
    while j > 0:
        if kind[j] != 255:
            out.append((back[j], j, kind[j]))
        j = back[j]
    return out[::-1]


def rewritten(span: str, kind: int) -> list[str]:
    """Forms of a base span that the patterns do not know."""
    if kind == 0:
        local, domain = span.split("@", 1)
        return [f"{local} (at) {domain.replace('.', ' (dot) ')}", f"{local}[at]{domain}", f"{local} [at] {domain.replace('.', '[dot]')}"]
    if kind == 1:
        return [span.replace(".", "[.]"), span.replace(".", " [dot] ")]
    if kind == 2:
        d = re.sub("[^0-9]", "", span)
        return [".".join(d[k : k + 4] for k in range(0, len(d), 4)), "  ".join(d[k : k + 4] for k in range(0, len(d), 4))]
    d = re.sub("[^0-9]", "", span)
    return [f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}"] if len(d) >= 10 else []


def look_alikes(span: str, kind: int) -> list[str]:
    """Digit strings that a base span is easily mistaken for, and that are no personal data."""
    d = re.sub("[^0-9]", "", span)
    if kind == 2:  # one digit off: the check sum fails
        wrong = d[:-1] + str((int(d[-1]) + 5) % 10)
        return [wrong, " ".join(wrong[k : k + 4] for k in range(0, len(wrong), 4))]
    if kind == 3 and len(d) >= 10:
        return [f"20{d[-2:]}-0{1 + int(d[-3]) % 9}-1{d[-4]} 1{d[-5]}:3{d[-6]}:2{d[-1]}", d[-8:], f"{d[-9:-2]}.{d[-2:]}"]
    if kind == 1:
        return [".".join(str(int(p) + 300) for p in span.split(".")), ".".join(span.split(".")[:3])]
    return []


#: An example: boundaries of an island, its segments, the features that each has, and (segment, kind) of the entities.
Example = tuple[int, list[tuple[int, int]], list[list[int]], list[tuple[int, int]]]


def examples_of(text: str, most: Bounds = Bounds()) -> Iterator[Example]:
    """What is learned from a text: its islands, and rewritten forms and look-alikes of its first base spans in their places."""
    spans = base_spans(text)
    versions = [(text, {(a, b): k for a, k, b in spans})]
    for a, k, b in spans[: most.spans]:
        for form in rewritten(text[a:b], k):
            begin, stop = max(0, text.rfind(" ", 0, max(0, a - 12)) + 1, a - 200), min(len(text), b + 12)
            near = text[begin:a] + form + text[b:stop]
            versions.append((near, {(a - begin, a - begin + len(form)): k}))
        versions += [(text[max(0, a - 12) : a] + form + text[b : b + 12], {}) for form in look_alikes(text[a:b], k)]
    for t, gold in versions:
        for start, end in islice(islands(t), most.islands):
            bounds, segments = candidates(t, start, end)
            if len(bounds) > most.boundaries or not (segments := list(segments)):
                continue
            hits = [(r, gold[bounds[i], bounds[j]]) for r, (i, j) in enumerate(segments) if (bounds[i], bounds[j]) in gold]
            kept, used = [], -1
            for r, k in sorted(hits, key=lambda h: segments[h[0]]):
                if segments[r][0] >= used:
                    kept.append((r, k))
                    used = segments[r][1]
            yield len(bounds) - 1, segments, [segment_features(t, bounds[i], bounds[j]) for i, j in segments], kept


def train(found: list[Example], most: Bounds = Bounds()) -> np.ndarray | None:
    """Weights (features x kinds) from examples; None if they have no entity."""
    if not any(e[3] for e in found):
        return None
    examples = []
    for k in np.random.default_rng(3).permutation(len(found))[: most.examples]:
        n, segments, features, gold = found[k]
        x = np.zeros((len(segments), len(_FEATURES)))
        for r, own in enumerate(features):
            x[r, own] = 1
        examples.append((n, segments, x, gold))
    w, seen = np.zeros((len(_FEATURES), len(KINDS))), np.zeros((len(_FEATURES), len(KINDS)))
    w[_FEATURES["bias"]] = -2
    for _ in range(PASSES):
        grad = -DECAY * len(examples) * w
        for n, segments, x, gold in examples:
            scores = x @ w
            alpha, beta = _forward(n, segments, scores)
            i, j = np.array(segments).T
            grad -= x.T @ np.exp(np.minimum(alpha[i][:, None] + scores + beta[j][:, None] - alpha[n], 0))
            for r, k in gold:
                grad[:, k] += x[r]
        seen += grad**2
        w += STEP * grad / np.sqrt(seen + 1e-9)
    return w


def _scored(text: str, bounds: array, segments: Iterator[tuple[int, int]], weights: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
    """(first, last, best score, its kind) of the segments, a block of them at a time."""
    while block := list(islice(segments, BLOCK)):
        scores = np.array([weights[segment_features(text, bounds[i], bounds[j])].sum(axis=0) for i, j in block])
        yield from ((i, j, s, k) for (i, j), s, k in zip(block, scores.max(axis=1).tolist(), scores.argmax(axis=1).tolist()))


def find_spans(text: str, weights: np.ndarray | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added ones, as (start, kind, end), sorted."""
    base = base_spans(text)
    added: list[tuple[int, int, int]] = []
    if weights is None:
        return base, added
    taken: list[list[int]] = []  # the base spans' union: sorted, disjoint
    for a, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    stops = [b for _, b in taken]

    def is_free(a: int, b: int) -> bool:
        k = bisect_right(stops, a)
        return k == len(taken) or taken[k][0] >= b

    for start, end in islands(text):
        bounds, segments = candidates(text, start, end)
        if taken:
            segments = ((i, j) for i, j in segments if is_free(bounds[i], bounds[j]))
        added += [(bounds[i], k, bounds[j]) for i, j, k in best_labelling(len(bounds) - 1, _scored(text, bounds, segments, weights))]
    return base, sorted(added)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(batches: Iterator[pa.RecordBatch], weights: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for b in batches:
        rows = []
        for i, t in zip(longs_of(b, "id").tolist(), b.column(b.schema.get_field_index("text")).to_pylist()):
            base, added = find_spans(t, weights) if _TRIGGER.search(t) else ([], [])
            counts = [sum(k == own for _, k, _ in base) for own in range(len(KINDS))] if base else [0] * len(KINDS)
            rows.append((i, *counts, len(added), hashlib.sha256(_joined(base).encode()).hexdigest() if base else empty, _joined(sorted(base + added))))
        if rows:
            yield row_batch(_RESULT, *zip(*rows))


def _examples(batches: Iterator[pa.RecordBatch], most: Bounds) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in b.column(b.schema.get_field_index("text")).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(list(islice(examples_of(t, most), most.examples)))])], names=["found"])


def fit(docs: DataFrame, most: Bounds = Bounds()) -> np.ndarray | None:
    """Trains on the documents with digits or at-signs whose ids and lengths have the smallest hashes, at most most.docs of them.

    Executors make the examples; only these, of bounded number and size for each document, reach the driver.
    """
    own = keyed(docs).withColumn("hash", F.xxhash64("id", F.octet_length("text")))
    useful = own.where(F.col("text").rlike(r"@|\+[0-9]|[0-9]{3}"))
    rows = docs.count()
    if rows > 16 * most.docs:  # texts are looked at only below a bound under which about 16 times as many documents lie as are asked for
        below = materialise(useful.where(F.col("hash") < int((16 * most.docs / rows - 0.5) * (1 << 64))).select("id", "key", "hash"), "with-digits")
        some = below if below.count() >= most.docs else useful.select("id", "key", "hash")
    else:
        some = useful.select("id", "key", "hash")
    few = materialise(some.distinct().orderBy("hash", "id", "key").limit(most.docs), "sample")
    sample = own.join(F.broadcast(few.select("id", "key", "hash")), ["id", "key", "hash"]).dropDuplicates(["id", "key"])  # few has at most most.docs narrow rows
    found = sample.select("id", "key", "text").sort("id", "key").select("text").mapInArrow(partial(_examples, most=most), "found binary").collect()
    return train([e for r in found for e in pickle.loads(r["found"])], most)


def personal_data(docs: DataFrame, weights: np.ndarray | None = None, most: Bounds = Bounds()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added: one row for each row of docs."""
    weights = fit(docs, most) if weights is None else weights
    out = keyed(docs).select("id", "text").mapInArrow(partial(_find, weights=weights), _RESULT_DDL)
    return out.select(real_id().alias("doc_id"), *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added")
