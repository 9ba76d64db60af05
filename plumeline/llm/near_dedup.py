"""Near duplicates by b-bit MinHash.

1. Each document becomes its set of distinct word shingles (64-bit hashes), and of that set a 128-bit
   fingerprint, 128 minima, the hashes of 24 bands of four minima, and the two low bits of each mixed
   minimum, packed as bit planes in four longs.
2. Documents with the same set form one class; what follows runs on classes, so copies cost nothing.
3. Classes that share a band meet in a bucket. Each member is compared with the bucket's leader only.
   Bits that agree give a similarity, corrected for chance agreement; pairs far below the threshold
   stop there. The others are confirmed on the full sets, recomputed from the whole texts. Confirmed
   links give components.
4. Buckets that still hold several components get a centre: of the component of their most typical
   member (the one whose buckets hold the most members), the most typical class, so that the buckets of a
   group share one centre. Each member is compared with it in full, which gives what they share and what
   the member has beyond it. Two members share at most the lesser of what each shares with the centre, and
   what both have beyond it. Only a member x that isn't linked with the centre c still has to be compared.
   A member y that isn't smaller than c must share something beyond c with x, else x would be linked with
   c; how much at least follows from the sizes, so a common one stands among the rarest few beyond c of
   both (prefix filtering), and the two meet by a join on those. Rarity is a count of all that lies beyond
   centres, in a table of fixed size; any order would do, the rarest first makes the fewest pairs. A
   smaller y can be linked without that, but only if its size lies in a range that x's figures give; x
   asks for those sizes. What then meets has to pass the bound, another on what one has or lacks of the
   centre and the other doesn't (counted in bits, so never too high), and the estimate, and is confirmed on
   the full sets. So no link between components is lost, pairs inside a component are never listed, and a large
   group whose members lie just below the threshold costs as much as they have rare shingles in common.
5. New links join components; each document gets the least doc_id of its component.

A pair at the threshold of 0.8 shares no band with a probability of 3e-6; the estimate's cut-off lies
six standard deviations below the threshold. Links, components and fingerprints stay in Spark.

Defined results: null and empty texts, and texts of white space, have no shingles and link with nothing;
a text with fewer words than a shingle has one; rows that repeat a doc_id are one document; a null doc_id
never becomes a component's id unless all of its ids are null, and such rows count as kept only then; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, CHUNK_BYTES, chunks, cut, cut_counted, in_batches, membership, mix64, release, text_or_empty, to_buffer, with_membership, words
from .components import components

#: Minima, bands of ROWS minima each, and bits kept of each minimum.
HASHES, BANDS, ROWS, BITS = 128, 24, 4, 2
#: Standard deviations of the estimate that a pair may fall below the threshold and still be confirmed.
MARGIN = 6.0

_RANDOM = np.random.default_rng(20240229)
_A = (_RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _rolled(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words."""
    n = max(0, len(hashed) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        rolled = rolled * _STEP + hashed[j : j + n]
    return mix64(rolled)


def _whole(hashed: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle has; none without words."""
    if not len(hashed):
        return np.zeros(0, np.uint64)
    whole = len(hashed)
    for x in hashed:
        whole = (whole * int(_STEP) + int(x)) & (2**64 - 1)
    return mix64(np.array([whole], np.uint64))


def _distinct(found: np.ndarray) -> np.ndarray:
    found = np.sort(found)
    keep = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=keep[1:])
    return found[keep]


def _long_set(raw: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one long text, read in parts that end before white space."""
    parts, held, carried, begin = [], 0, np.zeros(0, np.uint64), 0
    while begin < len(raw):
        end = min(len(raw), begin + CHUNK_BYTES)
        while end < len(raw) and not _SPACE[raw[end]]:
            after = np.flatnonzero(_SPACE[raw[end : end + CHUNK_BYTES]])
            end = end + int(after[0]) if len(after) else min(len(raw), end + CHUNK_BYTES)
        hashed = np.concatenate([carried, words(raw[begin:end], np.array([0, end - begin]))[2]])
        parts.append(_distinct(_rolled(hashed, width)))
        held += len(parts[-1])
        if held > 2 * len(parts[0]) + 1_000_000:
            parts = [_distinct(np.concatenate(parts))]
            held = len(parts[0])
        carried, begin = hashed[max(0, len(hashed) - width + 1) :], end
    found = _distinct(np.concatenate(parts))
    return found if len(found) else _whole(carried)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    if len(offsets) == 2 and len(raw) > CHUNK_BYTES:
        return [_long_set(raw, width)]
    _, _, hashed, first = words(raw, offsets)
    rolled = _rolled(hashed, width)
    return [
        _distinct(rolled[begin : end - width + 1]) if end - begin >= width else _whole(hashed[begin:end])
        for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
    ]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES minima for each set; long sets are taken in parts."""
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    for i, found in enumerate(sets):
        short = (found >> np.uint64(32)).astype(np.uint32)
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            np.minimum(out[i], (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=out[i])
    return out


def signatures(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (rows x BANDS) and bit planes (rows x 4 longs) of a matrix of minima."""
    pairs = np.ascontiguousarray(low[:, : BANDS * ROWS]).view(np.uint64).reshape(len(low), BANDS, -1)
    bands = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(low), BANDS)).copy()
    for j in range(pairs.shape[2]):
        bands = mix64(bands * _STEP + pairs[:, :, j])
    mixed = low * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    planes = [np.packbits(((mixed >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64) for b in range(BITS)]
    return bands.view(np.int64), np.concatenate(planes, axis=1)


_FEATURES = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_key", "n", "fp_hi", "fp_lo", "p0", "p1", "p2", "p3")] + [("bands", pa.list_(pa.int64()))])
_FEATURE_SCHEMA = "doc_id long, text_key long, n long, fp_hi long, fp_lo long, p0 long, p1 long, p2 long, p3 long, bands array<long>"


def _featurer(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = to_buffer(batch.column(2))
            for a, b in chunks(offsets):
                sets = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                prints = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") for s in sets])
                bands, planes = signatures(minima(sets))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * BANDS + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
                numbers = [pa.array(x) for x in (np.array([len(s) for s in sets]), prints[:, 0], prints[:, 1], *planes.T)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *numbers, flat], schema=_FEATURES)

    return run


def features(docs: DataFrame, width: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text"))
    return in_batches(rows, _featurer(width), _FEATURE_SCHEMA)


def estimated(x: str, y: str) -> Column:
    """Similarity from the agreeing low bits, corrected for those that agree by chance."""
    differ = sum((F.bit_count(F.col(f"{x}.p{i}").bitwiseXOR(F.col(f"{y}.p{i}")).bitwiseOR(F.col(f"{x}.p{i + 2}").bitwiseXOR(F.col(f"{y}.p{i + 2}")))) for i in range(2)), F.lit(0))
    chance = 0.5**BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def cut_off(threshold: float) -> float:
    chance = 0.5**BITS
    agree = threshold + (1 - threshold) * chance
    return threshold - MARGIN * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - chance)


def _may_link(x: str, y: str, percent: int) -> Column:
    small, large = F.least(F.col(f"{x}.n"), F.col(f"{y}.n")), F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n"))
    return (small * 100 >= large * percent) & (estimated(x, y) >= cut_off(percent / 100))


def _confirmer(width: int, percent: int) -> Callable:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = to_buffer(batch.column(2))
            raw_v, offsets_v = to_buffer(batch.column(3))
            good = np.zeros(len(u), bool)
            for a, b in chunks(offsets):
                sets = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                for i in range(a, b):
                    if last[0] != v[i]:
                        own = raw_v[offsets_v[i] : offsets_v[i + 1]]
                        last = (v[i], shingle_sets(own, np.array([0, len(own)]), width)[0])
                    one, two = sets[i - a], last[1]
                    at = np.searchsorted(two, one)
                    at[at == len(two)] = 0
                    shared = int((two[at] == one).sum())
                    good[i] = 100 * shared >= percent * (len(one) + len(two) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good])], schema=schema)

    return run


#: Longs that hold, as bits, what a class has beyond its centre and what it lacks of it.
APART = 8
_BITS = [f"d{i}" for i in range(APART)]
_CENTRED = "cid long, centre long, n long, m long, shared long, beyond array<long>, " + ", ".join(f"{c} long" for c in _BITS)


def _marked(parts: list[np.ndarray]) -> np.ndarray:
    """A bit for each hash, its place taken from the hash: APART longs."""
    bits = np.zeros(64 * APART, bool)
    for part in parts:
        bits[((part >> np.uint64(40)) % np.uint64(64 * APART)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def _beyond(width: int) -> Callable:
    schema = pa.schema([(c, pa.int64()) for c in ("cid", "centre", "n", "m", "shared")] + [("beyond", pa.list_(pa.int64()))] + [(c, pa.int64()) for c in _BITS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = to_buffer(batch.column(2))
            raw_v, offsets_v = to_buffer(batch.column(3))
            for a, b in chunks(offsets):
                n, m, shared, beyond, bits = [], [], [], [], []
                for i, own in zip(range(a, b), shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width), strict=True):
                    if last[0] != v[i]:
                        text = raw_v[offsets_v[i] : offsets_v[i + 1]]
                        last = (v[i], shingle_sets(text, np.array([0, len(text)]), width)[0])
                    at = np.searchsorted(last[1], own)
                    at[at == len(last[1])] = 0
                    both = last[1][at] == own
                    n.append(len(own))
                    m.append(len(last[1]))
                    shared.append(int(both.sum()))
                    beyond.append(own[~both].view(np.int64))
                    lacking = np.ones(len(last[1]), bool)
                    lacking[at[both]] = False
                    bits.append(_marked([own[~both], last[1][lacking]]))
                columns = [u[a:b], v[a:b], *(np.array(x, np.int64) for x in (n, m, shared)), *np.array(bits).T]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:5]), pa.array(beyond, schema.field("beyond").type), *map(pa.array, columns[5:])], schema=schema)

    return run


def _against_centre(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """For pairs (u, v): u as cid, v as centre, their sizes n and m, how many shingles they share, and those that u has beyond v."""
    return in_batches(_with_texts(pairs, texts), _beyond(width), _CENTRED)


#: Places of the table that counts shingles beyond centres; its size is fixed.
RARITY_BITS = 18


def _rarity(centred: DataFrame) -> np.ndarray:
    """How many of the shingles beyond centres fall on each place of the table."""
    place = F.col("extra").bitwiseAND((1 << RARITY_BITS) - 1).cast("int")
    rows = centred.select(F.explode("beyond").alias("extra")).groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    counts[rows.column("place").to_numpy()] = rows.column("n").to_numpy()
    return np.minimum(counts, 2**31 - 1).astype(np.int32)


def least_shared(total, percent: int):
    """What two sets of this total size must share to be linked."""
    return -(-percent * total // (100 + percent))


_RARE = "centre long, extra long, cid long, own long, leads long, n long, m long, shared long, wide boolean, p0 long, p1 long, p2 long, p3 long, " + ", ".join(f"{c} long" for c in _BITS)


def _rarest(table: Broadcast, percent: int) -> Callable:
    """The rarest shingles beyond the centre, as many as a partner must meet; wide: those that only partners smaller than the centre need."""
    names = [x.split()[0] for x in _RARE.split(", ")]
    schema = pa.schema([(c, pa.bool_() if c == "wide" else pa.int64()) for c in names])
    mask = (1 << RARITY_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for batch in batches:
            own, leads, n, m, shared = (batch.column(c).to_numpy() for c in ("own", "leads", "n", "m", "shared"))
            lists = batch.column("beyond")
            values, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            # whatever the partner, it has at least so many shingles
            floor = least_shared(n - (-percent * n // 100), percent) - shared
            probing = own != leads
            # x shares too little with the centre, so with a partner of the centre's size or more it shares something else;
            # a partner y of such an x meets it in more, the larger y is
            few = np.maximum(np.maximum(floor, np.where(probing, least_shared(n + m, percent) - shared, percent * (n - m) // (100 + percent) + 1)), 1)
            many = np.where(probing, np.maximum(floor, 1), few)
            sizes = np.diff(ends)
            owner = np.repeat(np.arange(len(n)), sizes)
            order = np.lexsort((values, counts[values & mask], owner))
            rank = np.arange(len(values)) - ends[:-1][owner]
            # a shingle that stands alone in its place of the table meets nobody
            take = (rank <= (sizes - many)[owner]) & (counts[values & mask][order] > 1)
            row, extra = owner[take], values[order][take]
            wide = rank[take] > (sizes - few)[row]
            if len(row):
                columns, at = {"extra": pa.array(extra), "wide": pa.array(wide)}, pa.array(row)
                yield pa.RecordBatch.from_arrays([columns[c] if c in columns else batch.column(c).take(at) for c in names], schema=schema)

    return run


def _leaves_room(most: Column, x: str, y: str, percent: int) -> Column:
    """Whether sets that share at most this many shingles can be linked."""
    return most * 100 >= (F.col(f"{x}.n") + F.col(f"{y}.n") - most) * percent


def _extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (cid, component), of classes that aren't the least of theirs, with further links between classes."""
    to = lambda c: label.select(F.col("cid").alias(c), F.col("component").alias(f"{c}_in"))
    between = links.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("u_in", "u").alias("u"), F.coalesce("v_in", "v").alias("v"))
    between, seen = cut_counted(between.where("u <> v").distinct())
    if not seen["n"]:
        return label
    joined = components(between)
    over = joined.select(F.col("node").alias("component"), F.col("component").alias("above"))
    label = label.join(over, "component", "left").select("cid", F.coalesce("above", "component").alias("component"))
    return cut_counted(label.unionByName(joined.select(F.col("node").alias("cid"), "component")))[0]


def _relabelled(placed: DataFrame, label: DataFrame) -> DataFrame:
    """placed (bucket, size, cid) with own, the component, for buckets that hold more than one."""
    now = placed.join(label, "cid", "left").select("bucket", "size", "cid", F.coalesce("component", "cid").alias("own"))
    mixed = now.groupBy("bucket").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("bucket")
    return now.join(mixed, "bucket")


def _with_centres(mixed: DataFrame) -> DataFrame:
    """Pairs of the members of mixed buckets (u) and their bucket's centre (v)."""
    fame = mixed.groupBy("cid").agg(F.sum("size").alias("fame"), F.first("own").alias("own"))
    # the most famous member of each component, and of each bucket; buckets led by one component share its centre
    centre = fame.groupBy("own").agg(F.max_by("cid", F.struct("fame", "cid")).alias("centre"))
    known = fame.join(centre, "own").select("cid", "fame", "centre")
    led = mixed.select("bucket", "cid").join(known, "cid").groupBy("bucket").agg(F.max_by("centre", F.struct("fame", "cid")).alias("v"))
    return mixed.select("bucket", F.col("cid").alias("u")).join(led, "bucket").where("u <> v").select("u", "v").distinct()


def _still_open(centred: DataFrame, label: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of classes around a centre, in different components, which may be linked by what is known of them."""
    own = label.select(F.col("cid").alias("k"), "component")
    around = centred.join(own, F.col("cid") == F.col("k"), "left").withColumn("own", F.coalesce("component", "cid")).drop("k", "component")
    around = around.join(own, F.col("centre") == F.col("k"), "left").withColumn("leads", F.coalesce("component", "centre")).drop("k", "component")
    around = cut_counted(around.join(classes.select("cid", "p0", "p1", "p2", "p3"), "cid"))[0]
    plain = around.drop("beyond")
    # what one has or lacks of the centre and the other doesn't, they don't share: the bits that differ count some of it
    differ = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _BITS), F.lit(0))
    apart = (F.col("x.own") != F.col("y.own")) & (differ * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)) & _may_link("x", "y", percent)
    common = F.least("x.shared", "y.shared")
    # with something in common beyond the centre: x and y meet by what is rare. If both are outside the centre's
    # component and only x is smaller than it, they meet with the roles exchanged
    table = centred.sparkSession.sparkContext.broadcast(_rarity(centred))
    rare = cut_counted(in_batches(around, _rarest(table, percent), _RARE))[0]
    table.unpersist()
    met = rare.groupBy("centre", "extra").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("centre", "extra")
    rare = rare.join(met, ["centre", "extra"])
    room = _leaves_room(common + F.least(F.col("x.n") - F.col("x.shared"), F.col("y.n") - F.col("y.shared")), "x", "y", percent)
    reach = (F.col("y.n") < F.col("y.m")) | (~F.col("x.wide") & ~F.col("y.wide"))
    rich = rare.where("own <> leads").alias("x").join(rare.alias("y"), (F.col("x.centre") == F.col("y.centre")) & (F.col("x.extra") == F.col("y.extra")) & apart & room & reach)
    # with nothing: y is smaller than the centre, and x asks for its sizes
    low, high = F.ceil(F.col("n") * percent / 100).cast("long"), F.least(F.col("m") - 1, F.floor(F.col("shared") * (100 + percent) / percent).cast("long") - F.col("n"))
    asking = plain.where("own <> leads").withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("asked", F.explode(F.sequence("low", "high")))
    poor = asking.alias("x").join(plain.alias("y"), (F.col("x.centre") == F.col("y.centre")) & (F.col("x.asked") == F.col("y.n")) & apart & _leaves_room(common, "x", "y", percent))
    ids = F.col("x.cid").alias("u"), F.col("y.cid").alias("v")
    return rich.select(*ids).unionByName(poor.select(*ids))


def _texts_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """cid and the whole text of each wanted class."""
    held = docs.select(F.col("doc_id").cast("long").alias("rep_id"), F.xxhash64(text_or_empty()).alias("rep_key"), text_or_empty().alias("text"))
    who = cut(wanted.join(classes.select("cid", "rep_id", "rep_key"), "cid"))
    # few texts are wanted: the others stay where they are
    held = with_membership(held, "rep_key", membership(who, "rep_key")).where("maybe_in").drop("maybe_in")
    same = held["rep_id"].eqNullSafe(who["rep_id"]) & (held["rep_key"] == who["rep_key"])
    return held.join(who, same).select("cid", "text")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one, two = texts.select(F.col("cid").alias("u"), F.col("text").alias("text_u")), texts.select(F.col("cid").alias("v"), F.col("text").alias("text_v"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "text_u", "text_v")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    return in_batches(_with_texts(pairs, texts), _confirmer(width, percent), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept."""
    found = cut(features(docs, width))
    marks = ["n", "p0", "p1", "p2", "p3"]
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")).alias("rep")
    grouped = found.where("n > 0").groupBy("fp_hi", "fp_lo").agg(rep, *[F.first(c).alias(c) for c in [*marks, "bands"]])
    classes = cut(
        grouped.select(F.monotonically_increasing_id().alias("cid"), "fp_hi", "fp_lo", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"), *marks, "bands")
    )
    members = classes.select("cid", F.explode("bands").alias("bucket"))
    # the leader differs between four groups of buckets, so that one odd leader doesn't stand in all of them
    leaders = members.groupBy("bucket").agg(F.min_by("cid", F.xxhash64("cid", F.pmod("bucket", F.lit(4)))).alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    crowd = cut(members.join(leaders, "bucket"))
    known = classes.select("cid", *marks)
    pairs = crowd.where("cid <> leader").select(F.col("cid").alias("u"), F.col("leader").alias("v")).distinct()
    pairs = pairs.join(known.alias("x"), F.col("u") == F.col("x.cid")).join(known.alias("y"), F.col("v") == F.col("y.cid")).where(_may_link("x", "y", percent)).select("u", "v")
    pairs = cut_counted(pairs)[0]
    crowded = crowd.where("size > 2").select("bucket", "size", "cid")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("cid")).unionByName(crowded.select("cid")).distinct()
    texts = cut(_texts_of(docs, wanted, classes))
    release(docs.sparkSession)
    label = components(_confirmed(pairs, texts, width, percent)).select(F.col("node").alias("cid"), "component")
    del pairs, wanted
    release(docs.sparkSession)

    mixed, seen = cut_counted(_relabelled(crowded, label))
    if seen["n"]:
        centred = cut(_against_centre(_with_centres(mixed), texts, width))
        linked = F.col("shared") * 100 >= (F.col("n") + F.col("m") - F.col("shared")) * percent
        label = _extended(label, centred.where(linked).select(F.col("cid").alias("u"), F.col("centre").alias("v")))
        release(docs.sparkSession)
        more = _still_open(centred, label, classes, percent)
        more, seen = cut_counted(more.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        release(docs.sparkSession)
        if seen["n"]:
            label = _extended(label, _confirmed(more, texts, width, percent))
    del crowd, crowded, mixed, texts
    release(docs.sparkSession)
    placed = classes.select("cid", "fp_hi", "fp_lo", "rep_id").join(label, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = placed.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    named = cut(placed.join(least, "component").select("fp_hi", "fp_lo", "component_id"))
    del placed, least, label, classes
    release(docs.sparkSession)
    out = found.select("doc_id", "n", "fp_hi", "fp_lo").join(named, ["fp_hi", "fp_lo"], "left")
    component_id = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that represent their component, with all their columns; rows without an id stay."""
    drop = cut(near_duplicates(docs, width, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("dropped_id")).distinct())
    release(docs.sparkSession)
    # the documents' own columns stay in a struct, so none of their names can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("asked"))
    marked = with_membership(rows, "asked", membership(drop, "dropped_id"))
    # rows that are certainly kept need no join, so their texts don't move
    sure, unsure = marked.where("not maybe_in"), marked.where("maybe_in")
    return sure.select("row").unionAll(unsure.join(drop, F.col("asked") == F.col("dropped_id"), "left_anti").select("row")).select("row.*")
