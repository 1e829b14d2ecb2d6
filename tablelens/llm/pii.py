"""Personal data by a semi-Markov conditional random field.

Base spans come from fixed patterns. They miss what patterns with one reading per start must miss: a phone number and a
card number with a blank between are one long run of digits, disguised addresses have no ``@``. The model scores whole
spans instead: shape, checksum, number ranges, neighbours. Dynamic programming over spans of a bounded number of atoms
finds the best segmentation of a region, borders and kinds together, and sums give each span its probability.

Characters that no candidate span covers can only be outside, and a region ends where no candidate goes on, so regions
are decoded apart without any loss. The model learns from a bounded sample of regions with their base spans, from
those spans put side by side or disguised, and from made-up look-alikes that are no personal data.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = 0  # label of a single atom outside; kinds are 1 to 4
LONGEST = 28  # atoms of a span
GROUPS = 6  # runs of digits of a number
SAMPLE = 200  # regions per set of kinds that the model learns from
EPOCHS = 6
SURE = 0.9  # probability from which a span is added
WIDTH = 1 << 14
BATCH_BYTES = 4 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match begins at the start of a run of digits: where that fails, later starts in the run fail too
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = r"(?:@|\x20?[\[({]\x20?at\x20?[\])}]\x20?)"
_DOT = r"(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)"
_MARK = re.compile(_AT, re.I)
_MAIL = re.compile(rf"[\w.%+-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I)
_MAIL_TAIL = re.compile(rf"[\w-]+(?:{_DOT}[\w-]+)+", re.I)
_DIGITS = re.compile(r"[+(]{0,2}[0-9](?:[\x20().\-/\[\]]{0,4}[0-9])++")
_ATOM = re.compile(r"[0-9]+|[^\W0-9]+|\W")
_RUN = re.compile(r"[0-9]+")


# ---- base spans ----------------------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_RUN.findall(text))


def octets(text: str) -> bool:
    parts = _RUN.findall(text)
    return len(parts) == 4 and all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` back to the start of its run: a later start in the run has the same rest, so it decides alone."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns as ``(kind, start, end)``, by kind as listed, then by start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if octets(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _only_digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]
    return out


# ---- candidate spans -----------------------------------------------------------------------

def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold spans, ascending and apart: digits with signs between, and what stands around at-marks."""
    found = [m.span() for m in _DIGITS.finditer(text) if m.end() - m.start() >= 7]
    last = 0
    if any(c in text for c in "@[({"):
        for m in _MARK.finditer(text):
            start = m.start()
            while start > last and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
                start -= 1
            tail = _MAIL_TAIL.match(text, m.end())
            if tail and start < m.start():
                found.append((start, tail.end()))
                last = tail.end()
    found.sort()
    merged: list[tuple[int, int]] = []
    for a, b in found:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _beside(c: str) -> str:
    if not c:
        return "edge"
    if c.isspace():
        return "blank"
    if c.isalpha():
        return "letter"
    return "digit" if c.isdigit() else c


def _numeric_features(span: str) -> list[str]:
    digits = _only_digits(span)
    exact = _RUN.sub(lambda m: "9" * len(m.group()), span)
    out = [f"shape {exact}", f"form {_RUN.sub('9', span)}", f"digits {len(digits)}", f"first {span[0] if span[0] in '+(' else '9'}"]
    if 13 <= len(digits) <= 19:
        out.append(f"checksum {luhn(digits)}")
    parts = len(_RUN.findall(span))
    out.append(f"parts {min(parts, 7)}")
    if parts == 4:
        out.append(f"octets {octets(span)}")
    return out


def _mail_features(span: str) -> list[str]:
    mark = _MARK.search(span)
    tail = span[mark.end() :]
    dots = [re.sub(r"\s", "_", d.lower()) for d in re.findall(_DOT, tail, re.I)]
    last = re.split(_DOT, tail, flags=re.I)[-1]
    sort = "letters" if last.isalpha() else "digits" if last.isdigit() else "both"
    return [f"mark {re.sub(r'[^@a]', '_', mark.group().lower())}", f"dots {'plain' if set(dots) == {'.'} else 'written'}", f"end {sort} {min(len(last), 5)}", f"ascii {span.isascii()}", f"open {span[0].isalnum()}"]


def _columns(kind: int, names: list[str]) -> list[int]:
    return [zlib.crc32(f"{kind} {n}".encode()) % WIDTH for n in names]


def _step(before: int, kind: int) -> int:
    return zlib.crc32(f"step {before} {kind}".encode()) % WIDTH


STEPS = [[_step(a, k) for k in range(len(KINDS) + 1)] for a in range(len(KINDS) + 1)]


@dataclass
class Lattice:
    """Atoms of one region and its candidate spans ``(first cut, last cut, kind, feature columns)`` by last cut."""

    cuts: list[int]
    spans: list[tuple[int, int, int, list[int]]] = field(default_factory=list)


def lattice(text: str, start: int, end: int) -> Lattice:
    """All spans of at most ``LONGEST`` atoms that could be an address or a number."""
    cuts = [start, *(start + m.end() for m in _ATOM.finditer(text[start:end]))]
    out = Lattice(cuts)
    n = len(cuts) - 1
    heads = [text[c] for c in cuts[:-1]]
    counts = [cuts[i + 1] - cuts[i] if heads[i].isdigit() and heads[i].isascii() else 0 for i in range(n)]
    plain = [counts[i] > 0 or heads[i] in " ().-/[]+" for i in range(n)]
    marks = [m.start() for m in _MARK.finditer(text, start, end)]
    for j in range(1, n + 1):
        # numbers end in digits
        if counts[j - 1]:
            total, groups, i = 0, 0, j - 1
            while i >= 0 and j - i <= LONGEST and plain[i] and total <= 19 and groups <= GROUPS:
                total, groups = total + counts[i], groups + (counts[i] > 0)
                if total <= 19 and groups <= GROUPS and (counts[i] or heads[i] in "+("):
                    _add_number(out, text, i, j, total, groups)
                if heads[i] == "+":
                    break
                i -= 1
        if marks and (heads[j - 1].isalnum() or heads[j - 1] == "_"):
            for i in range(max(0, j - LONGEST), j - 2):
                a, b = cuts[i], cuts[j]
                if bisect_left(marks, b) - bisect_right(marks, a) == 1 and not heads[i].isspace() and _MAIL.fullmatch(text, a, b) and not (i and text[a - 1] not in " \t\n" and (text[a - 1].isalnum() or text[a - 1] in "_.%+-")):
                    _add(out, text, i, j, [1], _mail_features)
    return out


def _add_number(out: Lattice, text: str, i: int, j: int, digits: int, groups: int) -> None:
    """The kinds that a number of so many digits and groups of digits can be at all."""
    span = text[out.cuts[i] : out.cuts[j]]
    kinds = [2] if groups == 4 and "." in span and span[0].isdigit() and octets(span) else []
    kinds += [3] if 13 <= digits <= 19 else []
    kinds += [4] if 7 <= digits <= 15 else []
    if kinds:
        _add(out, text, i, j, kinds, _numeric_features)


def _add(out: Lattice, text: str, i: int, j: int, kinds: list[int], features) -> None:
    a, b = out.cuts[i], out.cuts[j]
    names = features(text[a:b])
    names += [f"left {_beside(text[a - 1 : a])}", f"right {_beside(text[b : b + 1])}", "any"]
    out.spans += [(i, j, k, _columns(k, names)) for k in kinds]


# ---- model ---------------------------------------------------------------------------------

def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


class Model:
    """Weights of whole-span features and of steps between kinds; an outside atom scores 0 whatever came before."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros(WIDTH) if weights is None else weights

    def _scores(self, net: Lattice) -> tuple[list[float], list[list[float]]]:
        w = self.weights
        return [float(w[f].sum()) for *_, f in net.spans], [[0.0 if k == OUTSIDE else float(w[c]) for k, c in enumerate(row)] for row in STEPS]

    def best(self, net: Lattice) -> list[int]:
        """Numbers of the spans of the best segmentation."""
        score, step = self._scores(net)
        n, labels = len(net.cuts) - 1, range(len(KINDS) + 1)
        best = [[-math.inf] * len(labels) for _ in range(n + 1)]
        back: list[list[tuple | None]] = [[None] * len(labels) for _ in range(n + 1)]
        best[0][OUTSIDE] = 0.0
        at = 0
        for p in range(1, n + 1):
            before = max(labels, key=lambda k: best[p - 1][k])
            best[p][OUTSIDE], back[p][OUTSIDE] = best[p - 1][before], (p - 1, before, None)
            while at < len(net.spans) and net.spans[at][1] == p:
                i, _, k, _ = net.spans[at]
                before = max(labels, key=lambda b: best[i][b] + step[b][k])
                value = best[i][before] + step[before][k] + score[at]
                if value > best[p][k]:
                    best[p][k], back[p][k] = value, (i, before, at)
                at += 1
        out, p, k = [], n, max(labels, key=lambda k: best[n][k])
        while p > 0:
            i, before, number = back[p][k]
            if number is not None:
                out.append(number)
            p, k = i, before
        return out[::-1]

    def sums(self, net: Lattice) -> tuple[float, list[float], dict[tuple[int, int], float]]:
        """Logarithm of the sum over all segmentations, the probability of every span and of every step to a kind."""
        score, step = self._scores(net)
        n, labels = len(net.cuts) - 1, range(len(KINDS) + 1)
        ahead = [[-math.inf] * len(labels) for _ in range(n + 1)]
        ahead[0][OUTSIDE] = 0.0
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for number, (_, j, _, _) in enumerate(net.spans):
            ending[j].append(number)
        into: list[float] = [0.0] * len(net.spans)
        for p in range(1, n + 1):
            ahead[p][OUTSIDE] = _log_sum(ahead[p - 1])
            for number in ending[p]:
                i, _, k, _ = net.spans[number]
                into[number] = _log_sum([ahead[i][b] + step[b][k] for b in labels]) + score[number]
                ahead[p][k] = _log_sum([ahead[p][k], into[number]])
        behind = [[-math.inf] * len(labels) for _ in range(n + 1)]
        behind[n] = [0.0] * len(labels)
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for number, (i, _, _, _) in enumerate(net.spans):
            starting[i].append(number)
        for p in range(n - 1, -1, -1):
            for b in labels:
                ways = [behind[p + 1][OUTSIDE]]
                ways += [step[b][net.spans[x][2]] + score[x] + behind[net.spans[x][1]][net.spans[x][2]] for x in starting[p]]
                behind[p][b] = _log_sum(ways)
        total = behind[0][OUTSIDE]
        spans, steps = [], {}
        for number, (i, j, k, _) in enumerate(net.spans):
            spans.append(math.exp(into[number] + behind[j][k] - total))
            for b in labels:
                share = ahead[i][b] + step[b][k] + score[number] + behind[j][k] - total
                if share > -50:
                    steps[b, k] = steps.get((b, k), 0.0) + math.exp(share)
        return total, spans, steps

    def fit(self, examples: list[tuple[Lattice, list[int]]], epochs: int = EPOCHS, rate: float = 0.5, seed: int = 7) -> None:
        """Gradient steps on the likelihood of the right segmentations, with a step size per weight."""
        rng, seen = random.Random(seed), np.full(WIDTH, 1e-6)
        order = list(range(len(examples)))
        for _ in range(epochs):
            rng.shuffle(order)
            for x in order:
                net, right = examples[x]
                _, spans, steps = self.sums(net)
                slope: dict[int, float] = {}
                for number in right:
                    spans[number] -= 1.0
                for (*_, columns), p in zip(net.spans, spans):
                    if abs(p) > 1e-6:
                        for c in columns:
                            slope[c] = slope.get(c, 0.0) - p
                before, end = OUTSIDE, 0
                for number in right:
                    i, j, k, _ = net.spans[number]
                    c = STEPS[before if i == end else OUTSIDE][k]
                    slope[c] = slope.get(c, 0.0) + 1.0
                    before, end = k, j
                for (b, k), p in steps.items():
                    slope[STEPS[b][k]] = slope.get(STEPS[b][k], 0.0) - p
                at = np.fromiter(slope, np.int64, len(slope))
                g = np.fromiter(slope.values(), float, len(slope)) - 1e-4 * self.weights[at]
                seen[at] += g * g
                self.weights[at] += rate * g / np.sqrt(seen[at])

    def added(self, text: str, base: list[tuple[str, int, int]], sure: float = SURE) -> list[tuple[str, int, int]]:
        """Spans of the best segmentations that are likely enough and that the base lacks."""
        known, out = set(base), []
        for start, end in regions(text):
            net = lattice(text, start, end)
            fresh = [s for s in net.spans if (KINDS[s[2] - 1], net.cuts[s[0]], net.cuts[s[1]]) not in known]
            if not fresh:
                continue
            picked = [x for x in self.best(net) if (KINDS[net.spans[x][2] - 1], net.cuts[net.spans[x][0]], net.cuts[net.spans[x][1]]) not in known]
            if picked:
                likely = self.sums(net)[1]
                out += [(KINDS[net.spans[x][2] - 1], net.cuts[net.spans[x][0]], net.cuts[net.spans[x][1]]) for x in picked if likely[x] >= sure]
        return out


# ---- learning ------------------------------------------------------------------------------

def _example(text: str, gold: list[tuple[str, int, int]]) -> list[tuple[Lattice, list[int]]]:
    """The regions of ``text`` with the numbers of their right spans, where the candidates hold them all."""
    out = []
    for start, end in regions(text):
        net = lattice(text, start, end)
        place = {(KINDS[k - 1], net.cuts[i], net.cuts[j]): x for x, (i, j, k, _) in enumerate(net.spans)}
        mine = sorted(g[1:] + g[:1] for g in gold if g[1] < end and g[2] > start)
        right = [place.get((k, a, b)) for a, b, k in mine]
        if net.spans and None not in right and all(x[1] <= y[0] for x, y in zip(mine, mine[1:])):
            out.append((net, right))
    return out


def _with_checksum(rng: random.Random, head: str, n: int, right: bool = True) -> str:
    body = head + "".join(rng.choice("0123456789") for _ in range(n - 1 - len(head)))
    good = next(c for c in "0123456789" if luhn(body + c))
    return body + (good if right else rng.choice([c for c in "0123456789" if c != good]))


def _disguised(rng: random.Random, kind: str, value: str) -> str:
    """Another way to write a value of this kind."""
    digits = _only_digits(value)
    if kind == "email":
        name, _, host = value.partition("@")
        mark, dot = rng.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), ("{at}", "{dot}"), ("@", "[dot]"), ("@", "(dot)")])
        return name + mark + host.replace(".", dot)
    if kind == "ip":
        return rng.choice(["[.]", "(.)", " . "]).join(value.split("."))
    if kind == "card":
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return rng.choice([".", "/", "  ", " - ", "-", " "]).join(groups)
    local = digits[-10:].rjust(10, "5")
    a, b, c = local[:3], local[3:6], local[6:]
    return rng.choice([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}", f"001-{a}-{b}-{c}", f"+1/{a}/{b}-{c}", f"+1 ({a}) {b}-{c}", f"+1{a}{b}{c}"])


def _look_alike(rng: random.Random) -> str:
    """A number or sign that is no personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    big = lambda: str(rng.randrange(256, 1000))
    date = f"{rng.randrange(1950, 2035)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}"
    return rng.choice([
        date, f"{date} {rng.randrange(24):02}:{d(2)}:{d(2)}", ".".join(reversed(date.split("-"))), date.replace("-", "/"), date.replace("-", ""), f"{rng.randrange(1, 10)}.{d(3)}.{d(3)}.{d(3)}",
        d(7), d(8), d(9), d(10), d(11), d(12), _with_checksum(rng, "4", 16, False), _with_checksum(rng, "5", 15, False), _with_checksum(rng, "9", 13, False), d(4) + " " + d(4), " ".join(d(rng.randrange(1, 7)) for _ in range(rng.randrange(3, 9))),
        "-".join(d(rng.randrange(2, 6)) for _ in range(rng.randrange(2, 6))), f"{big()}.{big()}.{d(1)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}.{big()}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(2)}.{d(4)}, {d(2)}.{d(5)}",
        f"{d(3)}.{d(3)}.{d(3)},{d(2)}", f"({d(4)}-{d(4)})", f"{d(3)}/{d(3)}/{d(4)}", f"{d(2)}-{d(7)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(5)}-{d(4)}", f"x{d(9)}", f"a{d(12)}f", f"meet (at) noon", f"look @ {d(3)}", f"a [at] b",
    ])


def _regions_of(docs: DataFrame, text_col: str) -> DataFrame:
    """``what, code, window, at, gold``: every region with the characters around it and the base spans in it."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        names = ["what", "code", "window", "spans"]
        for batch in batches:
            rows = []
            for cell in batch.column(0):
                text = cell.as_py() or ""
                base = base_spans(text)
                for a, b in regions(text):
                    inside = sorted(s for s in base if s[1] < b and s[2] > a)
                    # without the rest of a neighbouring number
                    left, right = text[max(0, a - 24) : a], text[b : b + 24]
                    left, right = re.split(r"[0-9@]", left)[-1], re.split(r"[0-9@]", right)[0]
                    if b - a > 400 or any(s[1] < a or s[2] > b for s in inside):
                        continue
                    window, shift = left + text[a:b] + right, len(left) - a
                    code = int.from_bytes(hashlib.blake2b(window.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                    rows.append((" ".join(sorted({s[0] for s in inside})), code, window, ",".join(f"{k}:{s + shift}:{e + shift}" for k, s, e in inside)))
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)

    return docs.select(F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(run, "what string, code long, window string, spans string")


def sample_regions(docs: DataFrame, text_col: str = "text", size: int = SAMPLE) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """At most ``size`` different regions per set of base kinds, those with the smallest hashes."""
    order = Window.partitionBy("what").orderBy("code", "window")
    rows = _regions_of(docs, text_col).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size)
    out = []
    for r in rows.select("what", "code", "window", "spans").orderBy("what", "code", "window").toLocalIterator():
        gold = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        out.append((r["window"], gold))
    return out


def learn(sample: list[tuple[str, list[tuple[str, int, int]]]], seed: int = 5) -> Model:
    """A model from regions and their base spans; without any base span it adds nothing."""
    rng = random.Random(seed)
    values = [(k, w[a:b]) for w, gold in sample for k, a, b in gold]
    model = Model()
    if not values:
        return model
    made: list[tuple[str, list[tuple[str, int, int]]]] = [x for x in sample if x[1]]
    edges = [w[: min(a for _, a, _ in gold)][-12:] for w, gold in sample if gold]
    pick = lambda: rng.choice(edges).translate({ord(c): None for c in "0123456789@+("}) or "so "
    signs = ["", " ", ".", ",", "\n", ";"]
    for kind, value in values:
        parts = [(kind, value)] + [rng.choice(values) for _ in range(rng.randrange(1, 3))]
        rng.shuffle(parts)
        text, gold = pick(), []
        for k, v in parts:
            text += "" if not gold else " "
            gold.append((k, len(text), len(text) + len(v)))
            text += v
        made.append((text + " " + pick(), gold))
        text, other = pick(), _disguised(rng, kind, value)
        made.append((text + other + rng.choice(signs) + " " + pick(), [(kind, len(text), len(text) + len(other))]))
        text, fake = pick(), _look_alike(rng)
        made.append((text + fake + rng.choice(signs) + " " + pick(), []))
        # a look-alike beside a value
        text, fake = pick() + value + " ", _look_alike(rng)
        made.append((text + fake + " " + pick(), [(kind, len(text) - 1 - len(value), len(text) - 1)]))
    # what the texts themselves hold besides
    made += [x for x in sample if not x[1]]
    model.fit([e for text, gold in made for e in _example(text, gold)])
    return model


# ---- operator ------------------------------------------------------------------------------

def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, size: int = SAMPLE, sure: float = SURE) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per row of ``docs``.

    Counts and hash are those of the base spans; ``spans`` has these and what the model adds, by kind, start and end,
    in code points. A NULL text is empty and has no span. Rows are read by themselves, so equal rows give equal
    results of their own and NULL or equal ids do no harm. Work and memory grow with the length of a text and no faster;
    an empty table gives an empty result and teaches nothing, and without base spans nothing is added. Columns other
    than the two are not read, so no name of theirs can clash.
    """
    if model is None:
        model = learn(sample_regions(docs, text_col, size))
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model.weights)
    rank = {k: i for i, k in enumerate(KINDS)}

    def run(batches) -> Iterator[pa.RecordBatch]:
        mine = Model(sent.value)
        for batch in batches:
            counts, hashes, listed = [], [], []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                base = base_spans(text)
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                hashes.append(hashlib.sha256(_digest(base).encode()).hexdigest())
                every = sorted({*base, *mine.added(text, base, sure)}, key=lambda s: (rank[s[0]], s[1], s[2]))
                listed.append(_digest(every))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(hashes, pa.string()), pa.array(listed, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return slim.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
