"""Personal data: exact patterns, and a semi-Markov conditional random field that adds whole spans.

The base patterns (email, ip, card, phone) are found leftmost and non-overlapping per kind, in time linear in the
text; matches that fail their check are dropped. The field works on islands: runs of neighbouring tokens that hold
digits, an at sign or spelled-out at and dot. Every segment of up to `MAX_TOKENS` tokens is a candidate for each kind
that it could be at all (digit counts and the check digit for numbers, an at for addresses), whatever its form; single
tokens may also stand outside. Features of the whole segment, of the word before it and of the kinds of neighbouring
segments score a segmentation; sums over all of them by bounded-entity dynamic programming give each segment's
probability, and the best one chooses boundaries and kinds jointly. Added spans are segments of the best segmentation
of a probability of `SURE` at least that touch no base span.

It is trained here, on islands of at most `SAMPLE` documents of the corpus (those of smallest id hash that hold a digit
or an at sign), at most `2 * SAMPLE` islands with their surroundings, none of more than `TRAIN_TOKENS` tokens: base
spans are the truth, and of half of them the plain form is disguised, so that forms beyond the patterns are learned
from their build and surroundings. These bounds hold for training only; whole texts are searched, without limits.

Defined cases: null text equals empty text (no spans). Offsets are code points, ends exclusive. Ties between
segmentations go to the one with fewer spans. Without training rows nothing is added. Repeated ids return a row each;
an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 9
SAMPLE = 4000
TRAIN_TOKENS = 60
SURE = 0.75
EPOCHS = (0.3, 0.2, 0.1, 0.05)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_SIGN = re.compile(r"[0-9@]|(?i:[(\[{<](?:at|dot)[)\]}>])")
_SPELLED_AT = re.compile(r"\s*[(\[{<]at[)\]}>]\s*|\s+at\s+", re.IGNORECASE)
_SPELLED_DOT = re.compile(r"\s*[(\[{<](?:dot|\.)[)\]}>]\s*|\s+dot\s+", re.IGNORECASE)
_TRIM = ".,;:!?\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for run in _DIGITS.finditer(text):
        if run.start() >= end and (m := _IP.match(text, run.start())):
            end = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append(m.span())
    return out


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base matches, by kind as listed, then start."""
    found = emails(text) if "@" in text else []
    out = [("email", *s) for s in found]
    if _DIGITS.search(text):
        for kind, finder in (("ip", ips), ("card", cards), ("phone", phones)):
            out += [(kind, *s) for s in finder(text)]
    return out


def islands(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens with digits, at signs or spelled-out signs; a token beside (at) or (dot), and the words around `at` and `dot`, belong."""
    spelled = "dot" in text or "DOT" in text or "Dot" in text
    if not spelled and not _SIGN.search(text):
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    inside = [bool(_SIGN.search(text, *t)) for t in tokens]
    for i, (a, b) in enumerate(tokens):
        if text[a] in "([{<" and text[a:b].strip("()[]{}<>").lower() in ("at", "dot"):
            inside[max(0, i - 1) : i + 2] = [True] * len(inside[max(0, i - 1) : i + 2])
        elif spelled and b - a == 2 and text[a:b].lower() == "at" and any(text[x:y].lower() == "dot" for x, y in tokens[i + 2 : i + 4]):
            last = i + 2
            while last + 2 < len(tokens) and text[slice(*tokens[last + 2])].lower() == "dot":
                last += 2
            inside[max(0, i - 1) : last + 2] = [True] * len(inside[max(0, i - 1) : last + 2])
    out, run = [], []
    for token, holds in zip(tokens, inside):
        if holds:
            run.append(token)
        elif run:
            out.append(run)
            run = []
    return out + ([run] if run else [])


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _TRIM:
        start += 1
    while end > start and text[end - 1] in _TRIM:
        end -= 1
    return start, end


def plain_email(span: str) -> str:
    return _SPELLED_AT.sub("@", _SPELLED_DOT.sub(".", span))


def allowed(kind: str, span: str, digits: str) -> bool:
    """Whether the span could be of the kind at all, in whatever form."""
    if kind == "email":
        return len(span) > 4 and plain_email(span).count("@") == 1 and not span.startswith("@")
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    parts = _DIGITS.findall(span)
    return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)


def _shape(text: str) -> str:
    return re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 6)), re.sub(r"[A-Za-z]+", "a", text[:200]))[:24]


def features(text: str, kind: str, start: int, end: int, n_tokens: int, digits: str) -> list[str]:
    span, before = text[start:end], text[max(0, start - 24) : start].split()
    marks = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", span[:2000]))))[:8]
    out = [kind, f"{kind}|shape={_shape(span)}", f"{kind}|digits={min(len(digits), 20)}", f"{kind}|marks={marks}", f"{kind}|tokens={n_tokens}", f"{kind}|before={before[-1].lower()[:12] if before else ''}", f"{kind}|first={span[0] if not span[0].isalnum() else '9' if span[0].isdigit() else 'a'}", f"{kind}|letters={bool(re.search('[A-Za-z]', span))}"]
    if kind == "email":
        out.append(f"email|plain={bool(re.fullmatch(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', plain_email(span)))}")
    elif kind == "phone":
        groups = _DIGITS.findall(span)
        out += [f"phone|groups={min(len(groups), 6)}", f"phone|longest={max(map(len, groups))}", f"phone|between={''.join(sorted(set(re.sub('[0-9]', '', span[1:-1]))))[:6]}"]
    if kind in ("card", "phone"):
        between = set(re.split("[0-9]+", span)[1:-1])
        out += [f"{kind}|lengths={'-'.join(str(len(g)) for g in _DIGITS.findall(span)[:8])}", f"{kind}|joints={len(between)}"]
    elif kind == "ip":
        between = re.split("[0-9]+", span)[1:-1]
        out.append(f"ip|even={len(set(between)) == 1}|{between[0][:5]}")
    return out


def candidates(text: str, island: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int, list[str]]]:
    """(first token, last token, label, start, end, features): every segment that a kind allows, and each token outside (label 0)."""
    digits = [_digits(text[a:b]) for a, b in island]
    at = ["@" in text[a:b] or text[a:b].strip("()[]{}<>").lower() == "at" or bool(_SPELLED_AT.search(text, a, b)) for a, b in island]
    out: list = []
    for i in range(len(island)):
        held, ats = "", False
        for j in range(i, min(i + MAX_TOKENS, len(island))):
            held, ats = held + digits[j], ats or at[j]
            if len(held) > 19 and not ats:
                break
            start, end = trimmed(text, island[i][0], island[j][1])
            if start < end and (ats or len(held) >= 4):
                span = text[start:end]
                out += [(i, j, y + 1, start, end, features(text, k, start, end, j - i + 1, held)) for y, k in enumerate(KINDS) if (ats if k == "email" else len(held) >= 4) and allowed(k, span, held)]
    if out:
        out += [(i, i, 0, a, b, ["out", f"out|shape={_shape(text[a:b])}", f"out|digits={min(len(digits[i]), 20)}"]) for i, (a, b) in enumerate(island)]
    return out


def _follows(weights: dict[str, float]) -> list[list[float]]:
    """Weight of each label after each label; before an island stands label 0."""
    return [[weights.get(f"{x}>{y}", 0.0) for y in range(len(KINDS) + 1)] for x in range(len(KINDS) + 1)]


def _sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(math.fsum(math.exp(v - top) for v in values))


def _sums(n: int, found: list, weights: dict[str, float]) -> tuple[list[float], list, list, list[list[float]]]:
    """Scores of the segments, and sums over all segmentations before and after each place by the last label."""
    labels = range(len(KINDS) + 1)
    scores, follows = [math.fsum(weights.get(f, 0.0) for f in c[5]) for c in found], _follows(weights)
    starting, ending = defaultdict(list), defaultdict(list)
    for x, c in enumerate(found):
        starting[c[0]].append(x)
        ending[c[1]].append(x)
    forward = [[0.0 if y == 0 else -math.inf for y in labels]]
    into = []  # sums before each segment, by its label
    for t in range(n):
        into.append([_sum([forward[t][p] + follows[p][y] for p in labels]) for y in labels])
        own: list[list[float]] = [[] for _ in labels]
        for x in ending[t]:
            c = found[x]
            own[c[2]].append(into[c[0]][c[2]] + scores[x])
        forward.append([_sum(v) if v else -math.inf for v in own])
    backward = [[0.0] * len(labels) for _ in range(n + 1)]
    for t in range(n - 1, -1, -1):
        ways = [(found[x][2], scores[x] + backward[found[x][1] + 1][found[x][2]]) for x in starting[t]]
        backward[t] = [_sum([follows[p][y] + v for y, v in ways]) for p in labels]
    return scores, into, forward, backward


def segment(n: int, found: list, weights: dict[str, float]) -> list[tuple[int, float]]:
    """The spans (index, probability) of the best segmentation of n tokens."""
    scores, into, forward, backward = _sums(n, found, weights)
    follows, whole = _follows(weights), _sum(forward[n])
    best: list[dict[int, tuple[float, int, int]]] = [{0: (0.0, -1, 0)}] + [{} for _ in range(n)]
    for x in sorted(range(len(found)), key=lambda x: (found[x][1], found[x][2])):
        i, j, y = found[x][:3]
        for p, (v, _, _) in best[i].items():
            value = v + follows[p][y] + scores[x]
            if y not in best[j + 1] or value > best[j + 1][y][0]:
                best[j + 1][y] = (value, x, p)
    out, t, y = [], n, min(best[n], key=lambda y: (-best[n][y][0], y))
    while t:
        _, x, p = best[t][y]
        if y:
            c = found[x]
            out.append((x, math.exp(min(0.0, into[c[0]][y] + scores[x] + backward[t][y] - whole))))
        t, y = found[x][0], p
    return out


def _step(n: int, found: list, gold: set[int], weights: dict[str, float], rate: float) -> None:
    """One gradient step on an island's conditional likelihood."""
    scores, into, forward, backward = _sums(n, found, weights)
    follows, whole, labels = _follows(weights), _sum(forward[n]), range(len(KINDS) + 1)
    covered = {t for x in gold for t in range(found[x][0], found[x][1] + 1)}
    change: dict[str, float] = defaultdict(float)
    path = sorted([found[x][:3] for x in gold] + [(t, t, 0) for t in range(n) if t not in covered])
    before = 0
    for _, _, y in path:
        change[f"{before}>{y}"] += 1
        before = y
    for x, c in enumerate(found):
        after = scores[x] + backward[c[1] + 1][c[2]] - whole
        p = math.exp(min(0.0, into[c[0]][c[2]] + after))
        true = x in gold or (c[2] == 0 and c[0] not in covered)
        if p > 1e-4 or true:
            for f in c[5]:
                change[f] += true - p
            for y in labels:
                if forward[c[0]][y] > -math.inf:
                    change[f"{y}>{c[2]}"] -= math.exp(min(0.0, forward[c[0]][y] + follows[y][c[2]] + after))
    for f, v in change.items():
        weights[f] = weights.get(f, 0.0) * (1 - 1e-4) + rate * v


#: Other ways to write a span's marks.
_ATS, _DOTS = (" (at) ", "[at]", " at ", " [at] "), (".", ".", " dot ", "(dot)", " [dot] ")
_JOINTS = {"ip": ("[.]", " . ", "(.)", ",", "[.]", "-"), "card": (".", "/", "", "_", " - ", ":", ","), "phone": (".", "/", "", " ", "-", " - ", "_", ":")}


def _disguise(text: str, kind: str, start: int, end: int, rng: random.Random) -> str:
    span = text[start:end]
    if kind == "email":
        local, domain = span.split("@")
        span = local + rng.choice(_ATS) + domain.replace(".", rng.choice(_DOTS))
    elif kind == "ip":
        span = span.replace(".", rng.choice(_JOINTS[kind]))
    else:
        digits = _DIGITS.findall(span)
        front = rng.choice(("", "00", "(+", "tel:+", "(00")) if kind == "phone" else ""
        span = front + rng.choice(_JOINTS[kind]).join(digits) + (")" if front[:1] == "(" else "")
    return text[:start] + span + text[end:]


def train(docs: DataFrame) -> dict[str, float]:
    """Weights of the whole-span features, from at most SAMPLE documents' islands."""

    def contexts(batch: dict) -> dict:
        cut = []
        for text in batch["text"].to_pylist():
            for island in islands(text):
                if len(island) <= TRAIN_TOKENS:
                    cut.append(text[max(0, island[0][0] - 30) : island[-1][1] + 30])
        return {"piece": pa.array(cut, pa.string())}

    chosen = docs.filter(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.join(F.broadcast(chosen.distinct()), "doc_id").select("text")  # SAMPLE ids at most
    pieces = [r.piece for r in map_batches(rows, contexts, "piece string").orderBy(F.xxhash64("piece"), "piece").limit(2 * SAMPLE).collect()]
    rng, weights = random.Random(7), {}
    for rate in EPOCHS:
        for piece in pieces:
            truth = base_spans(piece)
            if truth and rng.random() < 0.5:
                kind, start, end = rng.choice(truth)
                changed = _disguise(piece, kind, start, end, rng)
                moved = len(changed) - len(piece)
                truth = [(k, s + moved * (s > start), e + moved * (e >= end)) for k, s, e in truth]
                piece = changed
            wanted = {(k, *trimmed(piece, s, e)) for k, s, e in truth}
            for island in islands(piece):
                if len(island) <= TRAIN_TOKENS and (found := candidates(piece, island)):
                    gold = {x for x, c in enumerate(found) if c[2] and (KINDS[c[2] - 1], c[3], c[4]) in wanted}
                    _step(len(island), found, _apart(found, gold), weights, rate)
    return {f: w for f, w in weights.items() if abs(w) > 1e-3}


def _apart(found: list, gold: set[int]) -> set[int]:
    """The gold segments without those that overlap a longer one."""
    out: set[int] = set()
    for x in sorted(gold, key=lambda x: (found[x][0] - found[x][1], x)):
        if all(found[x][1] < found[y][0] or found[y][1] < found[x][0] for y in out):
            out.add(x)
    return out


def added_spans(text: str, base: list[tuple[str, int, int]], weights: dict[str, float]) -> list[tuple[str, int, int]]:
    if not weights:
        return []
    taken, out = sorted((s, e) for _, s, e in base), []
    for island in islands(text):
        found = candidates(text, island)
        if found:
            for x, p in segment(len(island), found, weights):
                _, _, y, start, end, _ = found[x]
                if p >= SURE and not any(s < end and start < e for s, e in taken):
                    out.append((KINDS[y - 1], start, end))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all)."""

    def run(batch: dict) -> dict:
        counts, base_text, all_text = [], [], []
        for text in batch["text"].to_pylist():
            base = base_spans(text)
            counts.append([sum(1 for b in base if b[0] == k) for k in KINDS])
            base_text.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            all_text.append(_joined(base + added_spans(text, base, weights)))
        counted = np.array(counts, np.int64).reshape(-1, 4)
        return {"doc_id": batch["doc_id"]} | {f"n_{k}": pa.array(counted[:, i].copy()) for i, k in enumerate(KINDS)} | {"base_sha256": pa.array(base_text), "spans": pa.array(all_text)}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(texts, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
