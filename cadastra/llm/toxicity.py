"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

Training takes labelled rows outside the held-out quarter, at most `SAMPLE` of each class (those of smallest id hash;
copies of a whole text count once) and at most `SAMPLE_BYTES` of their text. Both dictionaries are trained by zstandard
on running text. As both classes share most of theirs, a dictionary of plain toxic text tells little (area under the
curve 0.6 on the given labels); so the toxic one is trained on the runs of toxic text that recur in more toxic
documents than their share in ordinary ones explains, and the ordinary one on ordinary text without such runs. What
both classes share costs the same in both, as the toxic content stands before the ordinary one.

A whole text is read in windows of `WINDOW` bytes of running text, one each `STEP` bytes. A window's distance is its
compressed length with the ordinary dictionary less that with the toxic one. Windows that share no five bytes with the
toxic content but for what the ordinary one holds too have distance 0 without being compressed. How many windows reach
each of the thresholds in `DISTANCES`, against the text's length, and the largest distances describe the text; a
logistic curve over these, weighted to the labels' own proportions, is calibrated on thirds of the sample that the
dictionaries used for them have not seen.

Only labels of the training rows and texts are used, never ids, languages or sources.

Defined cases: null or empty text has no windows and gets the score of a text without signs. A doc_id labelled twice is
toxic if one label says so. Without toxic or without ordinary training rows, or without runs that tell them apart, the
score is the share of toxic labels. Repeated ids return a row each; an empty table gives an empty result. Columns of
the input called score, held_out or predicted are replaced by the result's; all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadastra.llm.common import crc_mod, materialise, sliced

#: At most so many labelled rows of each class are learned from, and so many bytes of text of each.
SAMPLE = 3000
SAMPLE_BYTES = 32 << 20
HELD_OUT_MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.3
WINDOW, STEP = 32, 16
DISTANCES = (1, 2, 3, 4, 6)
LEVEL = 12
TOXIC_BYTES, ORDINARY_BYTES = 1 << 13, 1 << 16
#: Runs are the first so many bytes from a word's start that are found in LEAST_TEXTS toxic texts and LIFT times as often as in ordinary ones.
GRAMS = (6, 7, 8, 9, 10, 11, 12)
LEAST_TEXTS, LIFT, EVIDENCE = 4, 2, 6
#: At most so many such starts are used, those of most evidence.
STARTS = 400
PIECES = 40_000
BLOCK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def running(text: str) -> bytes:
    """The text with A-Z lower-cased, white space as single blanks, and one at both ends."""
    words = text.encode().lower().split()
    return b" " + b" ".join(words) + b" " if words else b""


def gram_hashes(raw: bytes, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, hashes of all substrings of so many bytes."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    h, out = np.zeros(len(x), np.uint64), []
    for i in range(max(sizes)):
        n = max(0, len(x) - i)
        h = h[:n] * _P + x[i:]
        if i + 1 in sizes:
            out.append(h)
    return out


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def starts(x: np.ndarray) -> np.ndarray:
    """Where in these bytes words begin (their blank) or characters of three bytes and more, which scripts without blanks have."""
    return np.flatnonzero((x == 32) | (x >= 0xE0))


class Runs:
    """The starts of runs that tell toxic texts from ordinary ones.

    A longer start counts beside a shorter one that it begins with only if it is at least half as frequent, or tells the
    classes apart twice as well: else what follows is chance.
    """

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        found, before = [], None
        for a_size, b_size in zip(self._grams(toxic), self._grams(ordinary)):
            (ga, first, a), (gb, b) = np.unique(a_size[0], return_index=True, return_counts=True), np.unique(b_size[0], return_counts=True)
            shorter = a_size[1][first]
            at = np.minimum(np.searchsorted(gb, ga), max(0, len(gb) - 1))
            share = (np.where(gb[at] == ga, b[at], 0) if len(gb) else np.zeros(len(ga))) + 0.5
            expected = share / max(1, len(ordinary)) * len(toxic)
            lift, evidence = a / expected, (a - expected) / np.sqrt(expected)
            if before is not None and len(before[0]):
                at = np.minimum(np.searchsorted(before[0], shorter), len(before[0]) - 1)
                grows = (2 * a >= before[1][at]) | (lift >= 2 * before[2][at])
            else:
                grows = True
            before = ga, a, lift
            good = (a >= LEAST_TEXTS) & (lift >= LIFT) & (evidence >= EVIDENCE) & grows
            found.append((ga[good], evidence[good]))
        every = np.sort(np.concatenate([f[1] for f in found]))[::-1]
        least = every[STARTS - 1] if len(every) > STARTS else 0
        self.known = [f[0][f[1] >= least] for f in found]

    @staticmethod
    def _grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each size, the distinct grams of every text, and what they begin with at the size before."""
        x = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        at = starts(x)
        owner = np.searchsorted(ends, at, side="right")
        h = shorter = np.zeros(len(at), np.uint64)
        for i in range(max(GRAMS)):
            inside = at + i < ends[owner]
            at, owner, h, shorter = at[inside], owner[inside], h[inside], shorter[inside]
            h = h * _P + (x[at + i].astype(np.uint64) + np.uint64(1))
            if i + 1 in GRAMS:
                _, first = np.unique(h ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), return_index=True)
                yield h[first], shorter[first]
                shorter = h

    def covered(self, raw: bytes) -> np.ndarray:
        """Whether each byte belongs to a run."""
        edges = np.zeros(len(raw) + 1, np.int64)
        at = starts(np.frombuffer(raw, np.uint8))
        for size, known, h in zip(GRAMS, self.known, gram_hashes(raw, GRAMS)):
            here = at[at < len(h)]
            hit = here[among(h[here], known)]
            edges[hit] += 1
            edges[hit + size] -= 1
        return np.cumsum(edges[:-1]) > 0

    def parts(self, raw: bytes, inside: bool) -> list[bytes]:
        """The text's parts that are runs, or those between them."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (self.covered(raw) == inside).astype(np.int8), [0]])))
        return [raw[a:b] for a, b in zip(edges[::2], edges[1::2])]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary; of samples too few or small for training, the samples themselves."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes] | None:
    """Contents of the toxic and the ordinary dictionary; None if nothing tells the classes apart."""
    runs = Runs(toxic, ordinary)
    samples = [b"\n".join(dict.fromkeys(runs.parts(raw, True))) for raw in toxic]
    pieces = [part[i : i + 2 * WINDOW] for raw in ordinary for part in runs.parts(raw, False) for i in range(0, len(part), 2 * WINDOW)]
    if not any(samples) or not pieces:
        return None
    return _trained(samples, TOXIC_BYTES, 16), _trained(pieces[:: -(-len(pieces) // PIECES)], ORDINARY_BYTES, WINDOW)


class Distances:
    """Compressed-length differences of a text's windows; one per task."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)

        self.toxic, self.ordinary = compressor(toxic + ordinary), compressor(ordinary)
        self.near = []
        for a, b in zip(gram_hashes(toxic, (5, 6)), gram_hashes(ordinary, (5, 6))):
            own, seen = np.setdiff1d(a, b), np.zeros(1 << 20, bool)
            seen[(own >> np.uint64(44)).astype(np.int64)] = True
            self.near.append((own, seen))

    def _windows(self, raw: bytes) -> np.ndarray:
        """Numbers of the windows that the toxic content may shorten."""
        found = []
        for start in range(0, len(raw), BLOCK):
            for (own, seen), h in zip(self.near, gram_hashes(raw[start : start + BLOCK + 8], (5, 6))):
                at = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
                found.append((start + at[among(h[at], own)]) // STEP)
        last = np.unique(np.concatenate(found))
        number = np.unique(np.concatenate([last - i for i in range(WINDOW // STEP)]))
        return number[(number >= 0) & (number * STEP < max(1, len(raw) - WINDOW + STEP))]

    def features(self, text: str) -> list[float]:
        raw = running(text)
        if not raw:
            return [0.0] * (2 + 2 * len(DISTANCES))
        values = []
        for n in self._windows(raw).tolist():
            window = raw[n * STEP : n * STEP + WINDOW]
            values.append(len(self.ordinary.compress(window)) - len(self.toxic.compress(window)))
        d = np.sort(np.array(values, np.float64))[::-1]
        count = np.array([(d >= least).sum() for least in DISTANCES], np.float64)
        return [max(0.0, d[:1].sum()) / 10, max(0.0, d[:3].sum()) / 30, *(count / np.sqrt(max(1, len(raw) // STEP))), *np.log1p(count)]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and intercept by Newton's method with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 0.05
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[float, DataFrame | None]:
    """The share of toxic labels, and the sample's rows: toxic, whole (the text's hash), text, fold."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(crc_mod(F.col("doc_id"), HELD_OUT_MODULUS) != HELD_OUT)
    n_ordinary, n_toxic = known.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") != 0)).first()
    share = (n_toxic + 0.5) / (n_toxic + n_ordinary + 1)
    if not n_toxic or not n_ordinary:
        return share, None
    order = F.xxhash64("doc_id")
    chosen = known.filter("toxic <> 0").orderBy(order, "doc_id").limit(SAMPLE).union(known.filter("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE))
    # at most 2 * SAMPLE ids
    rows = docs.select("doc_id", "text").filter("text <> ''").join(F.broadcast(chosen), "doc_id").withColumn("fold", crc_mod(F.col("doc_id"), HELD_OUT_MODULUS).cast("int"))
    # rows of one group have the same text
    rows = materialise(rows.groupBy((F.col("toxic") != 0).alias("toxic"), F.sha2("text", 256).alias("whole")).agg(F.first("text").alias("text"), F.min("fold").alias("fold")))
    left, taken = {True: SAMPLE_BYTES, False: SAMPLE_BYTES}, []
    for r in sorted(rows.select("toxic", "whole", F.octet_length("text").alias("size")).collect()):
        left[r.toxic] -= r.size
        if left[r.toxic] >= 0:
            taken.append((r.toxic, r.whole))
    taken = rows.sparkSession.createDataFrame(taken, "toxic boolean, whole string")
    return share, rows.join(F.broadcast(taken), ["toxic", "whole"])


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: dictionaries' contents, curve and base share.

    One task learns from the whole sample and one from it without each fold, bounded by SAMPLE and SAMPLE_BYTES; only
    dictionaries and the sample's features come to the driver.
    """
    share, rows = _sample(docs, labels)
    if rows is None:
        return {"base": share}

    def learn(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        held = sorted(zip(table.column("whole").to_pylist(), table.column("toxic").to_pylist(), table.column("text").to_pylist()))
        found = dictionaries([running(t) for _, toxic, t in held if toxic], [running(t) for _, toxic, t in held if not toxic])
        made = {"but": [key[0].as_py()], "toxic": [found[0]], "ordinary": [found[1]]} if found else {"but": [], "toxic": [], "ordinary": []}
        return pa.table(made, pa.schema([("but", pa.int32()), ("toxic", pa.binary()), ("ordinary", pa.binary())]))

    folds = [i for i in range(HELD_OUT_MODULUS) if i != HELD_OUT]
    parts = rows.withColumn("but", F.explode(F.array(*map(F.lit, [-1, *folds])))).filter("fold <> but")
    contents = {r.but: (bytes(r.toxic), bytes(r.ordinary)) for r in parts.groupBy("but").applyInArrow(learn, "but int, toxic binary, ordinary binary").collect()}
    if -1 not in contents:
        return {"base": share}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Distances] = {}
        for batch in batches:
            whole, toxic, x = [], [], []
            for r in batch.to_pylist():
                if r["fold"] in contents:
                    if r["fold"] not in made:
                        made[r["fold"]] = Distances(*contents[r["fold"]])
                    whole.append(r["whole"])
                    toxic.append(r["toxic"])
                    x.append(made[r["fold"]].features(r["text"]))
            yield pa.RecordBatch.from_arrays([pa.array(whole, pa.string()), pa.array(toxic, pa.bool_()), pa.array(x, pa.list_(pa.float64()))], ["whole", "toxic", "x"])

    described = sorted(rows.mapInArrow(describe, "whole string, toxic boolean, x array<double>").collect())
    y = np.array([float(r.toxic) for r in described])
    if len(set(y)) < 2:
        return {"base": share}
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    return {"base": share, "toxic": contents[-1][0], "ordinary": contents[-1][1], "curve": _logistic(np.array([r.x for r in described]), y, weight)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with held_out, score, predicted added."""
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model["toxic"], model["ordinary"]) if "curve" in model else None
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            if distances is None:
                p = np.full(len(texts), model["base"])
            else:
                x = np.array([distances.features(t or "") for t in texts]).reshape(-1, 2 + 2 * len(DISTANCES))
                p = 1 / (1 + np.exp(-np.clip(x @ model["curve"][:-1] + model["curve"][-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, "score"])

    scored = docs.mapInArrow(run, StructType([*docs.schema.fields]).add("score", "double"))
    return scored.withColumns({"held_out": crc_mod(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT, "predicted": (F.col("score") >= THRESHOLD).cast("int")})
