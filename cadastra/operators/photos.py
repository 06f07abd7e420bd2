"""Photo evidence: fingerprint distances, duplicates within a listing, one-to-one matches of two listings, scores.

A listing shows at most `MAX_PHOTOS` photos to a comparison, so the arrays folded here stay small; the folds run inside
Spark's own expressions, one listing or pair a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.session import written

MAX_PHOTOS = 30

#: A flipped part of a code is written, shuffled and looked up; this is its cost in pairs that meet.
FLIP_COST = 10
#: Flipped parts of one code at most; parts with more are not chosen.
MAX_FLIPS = 1_000


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def rgb_distance(a: Column, b: Column) -> Column:
    """Root mean square of the differences over 255, 1 at most; 1 where the lengths differ or are 0."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 1.0).otherwise(F.least(F.lit(1.0), F.sqrt(squares / F.size(a)) / 255.0))


def similarity(a: Column, b: Column) -> Column:
    """Three quarters structure, one quarter colour, of frames with bits and rgb."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.75 * (1 - hamming(a["bits"], b["bits"]) / 64.0) + 0.25 * (1 - rgb_distance(a["rgb"], b["rgb"]))))


def dedupe(frames: DataFrame, bits: int = 4, rgb: float = 0.08, max_photos: int = MAX_PHOTOS) -> DataFrame:
    """listing, frames: photos in order of pos that neither repeat a kept photo's sha nor lie near a kept photo."""
    frame = F.struct("pos", "photo", "sha", "bits", "rgb")
    listed = frames.filter(F.col("pos") <= max_photos).groupBy("listing").agg(F.array_sort(F.collect_list(frame)).alias("frames"))

    def again(kept: Column, f: Column) -> Column:
        return F.exists(kept, lambda k: (k["sha"] == f["sha"]) | ((hamming(k["bits"], f["bits"]) <= bits) & (rgb_distance(k["rgb"], f["rgb"]) <= rgb)))

    kept = F.aggregate("frames", F.slice("frames", 1, 0), lambda acc, f: F.when(again(acc, f), acc).otherwise(F.array_append(acc, f)))
    return listed.select("listing", kept.alias("frames"))


def one_to_one(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """pairs with matches: most similar frames first, ties left before right; each frame once."""
    each = F.transform(left, lambda a, i: F.transform(right, lambda b, j: F.struct((-similarity(a, b)).alias("order"), i.alias("i"), j.alias("j"), a["photo"].alias("left_photo"), b["photo"].alias("right_photo"))))
    possible = F.array_sort(F.flatten(each))
    taken = lambda acc, c: F.exists(acc, lambda m: (m["i"] == c["i"]) | (m["j"] == c["j"]))
    return pairs.withColumn("__possible", possible).withColumn(
        "matches", F.aggregate("__possible", F.slice("__possible", 1, 0), lambda acc, c: F.when(taken(acc, c), acc).otherwise(F.array_append(acc, c)))
    ).drop("__possible")


def matched(pairs: DataFrame) -> DataFrame:
    """low, high, place, left_photo, right_photo, similarity: a row for each match."""
    rows = one_to_one(pairs).select("low", "high", F.posexplode("matches").alias("place", "m"))
    return rows.select("low", "high", "place", "m.left_photo", "m.right_photo", F.bround(-F.col("m.order"), 6).alias("similarity"))


def top_mean(matches: DataFrame, top: int = 3) -> DataFrame:
    """low, high, score: mean of a pair's first matches."""
    return matches.filter(F.col("place") < top).groupBy("low", "high").agg(F.bround(F.avg("similarity"), 6).alias("score"))


def summary(scores: DataFrame) -> DataFrame:
    s = F.col("score")
    counts = [F.count_if(s >= 0.9).alias("at_least_90"), F.count_if(s >= 0.98).alias("at_least_98"), F.count_if(s < 0.7).alias("under_70")]
    return scores.agg(F.count("*").alias("pairs"), F.min(s).alias("lowest"), F.bround(F.median(s), 6).alias("middle"), F.max(s).alias("highest"), *counts)


def numbered(photos: DataFrame, listing: str, order: str) -> DataFrame:
    """photos with pos, from 1, within their listing."""
    return photos.withColumn("pos", F.row_number().over(Window.partitionBy(listing).orderBy(order)))


def usable_url(url: Column, markers: list[str]) -> Column:
    """Whether a url is neither blank nor a placeholder (a marker in any case)."""
    found = F.coalesce(F.trim(url), F.lit("")) == ""
    for m in markers:
        found = found | F.contains(F.lower(url), F.lit(m.lower()))
    return ~found


def _signed(places: Iterable[int]) -> int:
    """The 64-bit code with these places set, as a signed number."""
    code = sum(1 << p for p in places)
    return code - (code >> 63 << 64)


def _parts(rows: float, pairs: float, unlike: dict[int, float], bits: int) -> list[tuple[int, int, list[int]]]:
    """(mask, near, flips): parts of a code, of which codes at most `bits` apart have one where they are at most `near` apart.

    This holds for any parts with sum(near + 1) = bits + 1, whatever places they leave out; flips are the masks of up to
    `near` places of a part. How many of all pairs are unlike at a place only decides which parts cost least: the next
    place, that with most unlike pairs first, goes to the part that lets most pairs through.
    """
    chances = sorted(((n / pairs, place) for place, n in unlike.items() if n), reverse=True)
    least, chosen = pairs, [([], bits)]  # no places: all codes of a key meet
    for m in range(1, bits + 2):
        near = [(bits + 1) // m + (i < (bits + 1) % m) - 1 for i in range(m)]
        places: list[list[int]] = [[] for _ in near]
        apart = [[1.0] + [0.0] * t for t in near]  # chances that two codes differ at 0 to `near` places of the part
        for chance, place in chances:
            i = max(range(m), key=lambda i: sum(apart[i]))
            places[i].append(place)
            apart[i] = [as_far * (1 - chance) + nearer * chance for as_far, nearer in zip(apart[i], [0.0, *apart[i]])]
            flips = sum(math.comb(len(p), k) for p, t in zip(places, near) for k in range(t + 1))
            cost = rows * flips * FLIP_COST + pairs * sum(map(sum, apart))
            if flips <= MAX_FLIPS and cost < least:
                least, chosen = cost, [(list(p), t) for p, t in zip(places, near)]
    return [(_signed(p), t, [_signed(c) for k in range(t + 1) for c in combinations(p, k)]) for p, t in chosen]


def near_codes(codes: DataFrame, key: str, bits: int = 4) -> tuple[DataFrame, DataFrame]:
    """Links (key, low, high, distance) of different codes at most `bits` apart, and members (key, code, n, first) of each code.

    Codes (key, code, id) of one value are one class, so copies are never paired. Two 64-bit codes meet where a part of
    one, with up to `near` of its places flipped, equals that of the other (`_parts`). Exact, for any codes.
    """
    if not 1 <= bits <= 15:
        raise ValueError("1 to 15 bits")
    members = written(codes.groupBy(key, "code").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    placed = members.filter("code is not null").select(key, "code", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place"))
    each = placed.groupBy(key, "place").agg(F.count("*").cast("double").alias("rows"), F.expr("cast(sum(shiftrightunsigned(code, place) & 1) as double) as ones"))
    counts = each.groupBy("place").agg(F.sum("rows").alias("rows"), F.expr("sum(rows * rows) as pairs"), F.expr("sum(2 * ones * (rows - ones)) as unlike")).collect()  # 64 rows
    rows, pairs = (counts[0].rows, counts[0].pairs) if counts else (0, 0)
    parts = _parts(rows, pairs, {r.place: r.unlike for r in counts}, bits)
    dealt = [F.struct(F.lit(i).alias("part"), F.lit(mask).cast("long").alias("mask"), F.lit(flip).cast("long").alias("flip")) for i, (mask, _, flips) in enumerate(parts) for flip in flips]
    own = F.col("code").bitwiseAND(F.col("p.mask"))
    cut = members.select(key, "code", F.explode(F.array(*dealt)).alias("p")).select(key, "code", "p.part", own.alias("own"), own.bitwiseXOR(F.col("p.flip")).alias("value"))
    # two codes meet at the greater value of their parts; where these are equal, only the lower code looks for the other
    one = cut.filter("value >= own").select(key, "part", "value", F.col("code").alias("one"), (F.col("value") == F.col("own")).alias("equal"))
    other = cut.filter("value = own").select(key, "part", "value", F.col("code").alias("other"))
    met = one.join(other.hint("shuffle_hash"), [key, "part", "value"]).filter(~F.col("equal") | (F.col("one") < F.col("other")))
    # and count in the first of the parts where they are near
    first = F.coalesce(*(F.when(hamming(F.col("one").bitwiseAND(F.lit(mask).cast("long")), F.col("other").bitwiseAND(F.lit(mask).cast("long"))) <= near, i) for i, (mask, near, _) in enumerate(parts)))
    far = hamming(F.col("one"), F.col("other"))
    links = met.filter((far <= bits) & (first == F.col("part")))
    return links.select(key, F.least("one", "other").alias("low"), F.greatest("one", "other").alias("high"), far.alias("distance")), members


def prevalence(memberships: DataFrame, url: str) -> DataFrame:
    """memberships, urls, most: how many rows, distinct urls, and rows of the commonest url."""
    return memberships.groupBy(url).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("memberships"), F.count("*").alias("urls"), F.max("n").alias("most"))


def analysed(frames: DataFrame, failed: DataFrame, bits: int = 4, rgb: float = 0.08, max_photos: int = MAX_PHOTOS) -> DataFrame:
    """listing, frames (kept ones), considered, decoded, unique, errors, content_set_hash, evidence_set_hash.

    frames: decoded photos; failed: listing, url_hash, error of those that could not be read. The content hash is over all
    decoded photos, the evidence hash over what the kept ones show.
    """
    seen = frames.filter(F.col("pos") <= max_photos).groupBy("listing").agg(F.count("*").alias("decoded"), F.sha2(F.to_json(F.array_sort(F.collect_list("sha"))), 256).alias("content_set_hash"))
    lost = failed.groupBy("listing").agg(F.count("*").alias("errors"))
    shown = F.array_sort(F.transform("frames", lambda f: F.struct(f["bits"].alias("bits"), f["rgb"].alias("rgb"))))
    kept = dedupe(frames, bits, rgb, max_photos).select("listing", "frames", F.size("frames").cast("long").alias("unique"), F.sha2(F.to_json(shown), 256).alias("evidence_set_hash"))
    return seen.join(kept, "listing").join(lost, "listing", "left").withColumn("errors", F.coalesce("errors", F.lit(0).cast("long"))).withColumn("considered", F.col("decoded") + F.col("errors"))


def pair_documents(pairs: DataFrame, listings: DataFrame, versions: dict[str, str], top: int = 3) -> DataFrame:
    """low, high, document: versioned evidence of candidates (low, high, revision, low_hash, high_hash) as one struct.

    listings: as `analysed` gives them. Pairs with a side that shows nothing have none. The decision is always
    `uncertain`: scores are not calibrated, and nothing is merged by them.
    """
    side = lambda name: listings.select(F.col("listing").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in listings.columns if c != "listing"))
    both = pairs.join(side("low"), "low").join(side("high"), "high").filter("low_unique > 0 and high_unique > 0")
    matches = F.transform("matches", lambda m: F.struct(m["left_photo"].alias("left_photo"), m["right_photo"].alias("right_photo"), F.bround(-m["order"], 6).alias("similarity")))
    first = F.slice(matches, 1, top)
    score = F.bround(F.aggregate(first, F.lit(0.0), lambda s, m: s + m["similarity"]) / F.size(first), 6)
    stats = lambda s: F.struct(*(F.col(f"{s}_{c}").alias(c) for c in ("considered", "decoded", "unique", "errors")), (F.col(f"{s}_decoded") - F.col(f"{s}_unique")).alias("duplicates"))
    listing = lambda s: F.struct(F.col(f"{s}_hash").alias("identity_hash"), F.col(f"{s}_content_set_hash").alias("photo_content_set_hash"), F.col(f"{s}_evidence_set_hash").alias("photo_evidence_set_hash"), F.col(f"{s}_frames.photo").alias("assets"), stats(s).alias("stats"))
    document = F.struct(
        F.col("revision").alias("candidate_revision_hash"), F.lit("uncertain").alias("decision"), score.alias("score"), *(F.lit(v).alias(k) for k, v in versions.items()),
        listing("low").alias("listing_a"), listing("high").alias("listing_b"), matches.alias("matches"), F.lit(False).alias("calibrated"), F.lit(False).alias("auto_merge_allowed"),
    )
    return one_to_one(both, "low_frames", "high_frames").select("low", "high", document.alias("document"))
