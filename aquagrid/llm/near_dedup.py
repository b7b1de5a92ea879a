"""Near-duplicate classes by DartMinHash signatures and banded joining.

Every shingle (five words) is a region: as wide as its weight, and as high as needed. Darts
fall on it in an order fixed by hashes: the i-th dart on a region has a height, a place across
and a coordinate that depend on the shingle and i alone. Each coordinate of the signature keeps
the lowest dart that hit a region's width, so two texts share a coordinate with the probability
of their weighted Jaccard similarity. Heights are explored to a level that fills nearly all
coordinates with about k ln k + 2k darts in all, however long the text, and doubled for the
coordinates still open. With ``weighting="set"`` every shingle weighs 1 and the similarity is
plain Jaccard; ``"count"`` weighs it by its occurrences.

Exact copies (equal words) are one class before anything else, with the smallest id as their
representative. Representatives meet in band buckets. Each bucket's smallest id leads it, and
every member is first compared, exactly, on the shingles, with the smallest of its leaders only.
Members of a bucket that lie in another component than its leader after that meet all its other
members, in blocks of bounded size. No pair leaves a block unless it may be a link: the
signatures' low bits must agree within four standard deviations of what a link at the threshold
has (one in thirty thousand such links lies outside). What leaves is compared exactly. This goes
in two passes: first each such member meets its likeliest partner in the block, which joins most
of them to their component; then those that still lie apart meet all others, and a pair is given
only by the first bucket that the two share. Components come from label propagation with pointer
jumping; labels, links and buckets stay distributed and each step is stored.

Comparisons are grouped by leader; leaders with many members are split over salted groups. A
task holds one leader's shingles at a time.

Texts of fewer than five words are one shingle. Texts without words (missing, empty, blank) are
similar to nothing: each is a class of its own. Rows with a missing id get a missing class.
Rows that repeat an id count as one text (the one whose digest is smallest) and get one row
each. Ties go to the smaller id; other columns of the input are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aquagrid.llm.common import BLANKS, as_bytes, give_back, slices, stored, table, whole_text
from aquagrid.session import cut_lineage

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 50, 7
MEMBERS_PER_GROUP = 2_000
BLOCK = 2_000
COPY_SALTS = 1_024
WORDS_AT_ONCE = 100_000
DARTS_AT_ONCE = 1 << 15       # of a signature, in one step
KNOWN_WORDS, KNOWN_TEXTS = 100_000, 4_000    # hashes and signatures a task remembers

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
UNIT = 1.0 / (1 << 53)


def mixed(x):
    """A 64-bit finaliser, element by element."""
    x = x + MIX[0]
    for shift, factor in ((30, MIX[1]), (27, MIX[2])):
        x ^= x >> np.uint64(shift)
        x *= factor
    x ^= x >> np.uint64(31)
    return x


def uniform(x):
    """(0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * UNIT


def word_hashes(words, known):
    """64-bit hashes of words (bytes); ``known`` remembers them."""
    new = list(dict.fromkeys(filterfalse(known.__contains__, words)))
    if new:
        digests = b"".join([hashlib.blake2b(word, digest_size=8).digest() for word in new])
        known.update(zip(new, np.frombuffer(digests, "<u8").tolist()))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words, known, size=SHINGLE):
    """Distinct shingle hashes, sorted, and how often each occurs."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = word_hashes(words, known)
    width = min(size, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, width, np.uint64)
        for i in range(width):
            out = mixed(out ^ hashed[i:i + n])
    return np.unique(out, return_counts=True)


def signatures(sets, weights, k):
    """DartMinHash of many weighted sets: one row of k dart hashes each.

    ``sets``: arrays of element hashes; ``weights``: arrays of positive numbers. Every set needs
    an element. A region of width w is a strip per power of two, so that a dart's height and
    place do not depend on w: a dart counts if its place across lies below w.
    """
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element, weight = np.concatenate(sets), np.concatenate(weights).astype(np.float64)
    total = np.bincount(owners, weights=weight, minlength=len(sets))
    # strips [0, 1), [1, 2), [2, 4) ... up to the weight
    strips = np.maximum(np.ceil(np.log2(np.maximum(weight, 1e-300))), 0).astype(np.int64) + 1
    at = np.repeat(np.arange(len(element)), strips)
    strip = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(strip == 0, 0.0, 2.0 ** (strip - 1))
    width = np.where(strip == 0, 1.0, low)
    owner, weight = owners[at], weight[at]
    with np.errstate(over="ignore"):
        region = mixed(element[at] ^ mixed(strip.astype(np.uint64)))
    level = (k * np.log(k) + 2 * k) / total
    best = np.full(len(sets) * k, np.inf)
    names = np.zeros(len(sets) * k, np.uint64)
    height, thrown = np.zeros(len(region)), np.zeros(len(region), np.uint64)
    whole = bool((low + width <= weight).all())     # then no dart falls beside its region
    first, alive = owner * k, np.arange(len(region))
    while len(alive):
        waiting = []
        while len(alive):
            # about as many darts at once as still lie below the level
            left = (level[owner[alive]] - height[alive]) * width[alive]
            size = np.ceil(np.log2(np.clip(left, 1, DARTS_AT_ONCE))).astype(np.int64)
            going = []
            for power in np.unique(size):
                group, darts = alive[size == power], 1 << int(power)
                turns = np.arange(1, darts + 1, dtype=np.uint64)
                for start in range(0, len(group), step := DARTS_AT_ONCE // darts):
                    at = group[start:start + step]
                    with np.errstate(over="ignore"):
                        dart = mixed(region[at][:, None] + (thrown[at][:, None] + turns) * MIX[1])
                    top = np.log(uniform(dart))
                    top /= -width[at][:, None]
                    top[:, 0] += height[at]
                    np.cumsum(top, axis=1, out=top)
                    inside = top <= level[owner[at]][:, None]
                    count = inside.sum(axis=1)
                    over = count < darts
                    waiting.append(at[over])        # its next dart lies above the level
                    going.append(at[~over])
                    thrown[at] += count.astype(np.uint64)
                    height[at] = np.where(count > 0, top[np.arange(len(at)), count - 1], height[at])
                    at, dart, top = np.repeat(at, count), dart[inside], top[inside]
                    place = mixed(dart ^ MIX[2])    # 40 bits across, 24 for the coordinate
                    slot = (place >> np.uint64(40)).astype(np.int64)
                    slot -= slot // k * k
                    slot += first[at]
                    if not whole:
                        across = (place & np.uint64((1 << 40) - 1)) * 2.0 ** -40
                        hit = low[at] + across * width[at] < weight[at]
                        slot, top, dart = slot[hit], top[hit], dart[hit]
                    lower = top < best[slot]
                    slot, top, dart = slot[lower], top[lower], dart[lower]
                    np.minimum.at(best, slot, top)
                    won = best[slot] == top
                    names[slot[won]] = dart[won]
            alive = np.concatenate(going)
        rising = np.isinf(best.reshape(len(sets), k)).any(axis=1)
        level = np.where(rising, level * 2, level)
        waiting = np.concatenate(waiting)
        alive = waiting[rising[owner[waiting]]]
    return names.reshape(len(sets), k)


def bands_of(signature, bands, rows):
    """Band keys (signed 64-bit) of signature rows; the band's number is part of the key."""
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signature), bands)).copy()
        for i in range(rows):
            key = mixed(key ^ signature[:, i::rows][:, :bands])
    return key.view(np.int64)


def _weights(counts, weighting):
    return counts if weighting == "count" else np.ones(len(counts))


def sketch(docs: DataFrame, key="doc_id", text="text", bands=BANDS, rows=ROWS, size=SHINGLE,
           weighting="set") -> DataFrame:
    """(id, digest, bands, marks, keys) of every row with an id; marks are the signature's low
    four bits each, keys the low four bytes of each band. Without words only the id is there."""
    source = docs.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("id"), whole_text(text).alias("text"))

    def run(batches):
        known, made = {}, {}
        for batch in slices(batches):
            words, start, n = [], 0, 0
            for i, raw in enumerate(as_bytes(batch.column(1)), 1):
                words.append(raw.split())
                n += len(words[-1])
                if n < WORDS_AT_ONCE and i < batch.num_rows:
                    continue
                digests = [hashlib.md5(b" ".join(w)).digest() if w else None for w in words]
                if len(known) > KNOWN_WORDS:
                    known = {}
                if len(made) > KNOWN_TEXTS:
                    made = {}
                new = {d: w for d, w in zip(digests, words) if d and d not in made}
                if new:
                    found = [shingles(w, known, size) for w in new.values()]
                    signs = signatures([s for s, _ in found],
                                       [_weights(c, weighting) for _, c in found], bands * rows)
                    low = np.pad((signs & np.uint64(15)).astype(np.uint8),
                                 ((0, 0), (0, bands * rows % 2)))
                    low = low[:, ::2] | (low[:, 1::2] << 4)
                    named = bands_of(signs, bands, rows)
                    short = map(bytes, (named & 0xFFFFFFFF).astype(np.uint32))
                    made.update(zip(new, zip(named, map(bytes, low), short)))
                keys = [made[d][0].tolist() if d else [] for d in digests]
                marks, short = ([made[d][at] if d else None for d in digests] for at in (1, 2))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(words)), pa.array(digests, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary()),
                     pa.array(short, pa.binary())], ["id", "digest", "bands", "marks", "keys"])
                words, start, n = [], i, 0

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, digest binary, bands array<bigint>, marks binary, "
                             "keys binary")


def similarity(a, b, weights_a=None, weights_b=None):
    """Weighted Jaccard of two sorted element arrays (plain without weights)."""
    shared, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if weights_a is None:
        return len(shared) / max(len(a) + len(b) - len(shared), 1)
    low = np.minimum(weights_a[i], weights_b[j]).sum()
    return low / max(weights_a.sum() + weights_b.sum() - low, 1e-300)


def compare(docs: DataFrame, pairs: DataFrame, key="doc_id", text="text", size=SHINGLE,
            weighting="set", least=0.0, chosen=None) -> DataFrame:
    """(a, b, sim) of the distinct pairs (a, b) with a similarity of ``least`` or more: b's
    shingles meet a's, grouped by a. ``chosen`` (id, digest) names the text of an id that has
    several."""
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / MEMBERS_PER_GROUP).cast("int")
    groups = many.withColumn("salts", F.greatest(salts, F.lit(1)))
    salted = pairs.join(groups.filter("salts > 1").select("a", "salts"), "a", "left").select(
        F.col("b").alias("id"), "a",
        F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"),
        F.lit(1).alias("role"))
    leads = groups.select(F.col("a").alias("id"), "a", F.explode(F.sequence(
        F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = salted.unionByName(leads)
    wanted = (wanted.join(chosen.select("id", "digest"), "id", "left") if chosen is not None
              else wanted.withColumn("digest", F.lit(None).cast("binary")))
    one = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"),
                                                     whole_text(text).alias("text"))
    # a text travels compressed by the shuffle; its shingles are made where it is compared
    rows = (wanted.join(one, "id").repartition("a", "salt")
            .sortWithinPartitions("a", "salt", "role", "id"))

    def run(batches):
        known, lead, group = {}, None, None
        for batch in slices(batches, 200):
            out = []
            ids, leaders, salts_, roles, digests = (batch.column(i).to_pylist() for i in range(5))
            for n, raw in enumerate(as_bytes(batch.column(5))):
                if len(known) > KNOWN_WORDS:
                    known = {}
                words = raw.split()
                if digests[n] is not None and hashlib.md5(b" ".join(words)).digest() != digests[n]:
                    continue
                own = shingles(words, known, size)
                if roles[n] == 0:
                    lead, group = own, (leaders[n], salts_[n])
                elif group == (leaders[n], salts_[n]):
                    weights = (lead[1], own[1]) if weighting == "count" else ()
                    sim = similarity(lead[0], own[0], *weights)
                    if sim >= least:
                        out.append((leaders[n], ids[n], sim))
            if out:
                a, b, sim = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, batch.schema.field(1).type), pa.array(b, batch.schema.field(0).type),
                     pa.array(sim, pa.float64())], ["a", "b", "sim"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "a", "salt", "role", "digest", "text").mapInArrow(
        run, f"a {kind}, b {kind}, sim double")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of the component of every id in ``edges`` (a, b)."""
    both = stored(edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("id"), F.least("a", "m").alias("label"))
    labels = stored(labels)
    while True:
        near = (both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a")
                .agg(F.min("label").alias("near")).withColumnRenamed("a", "id"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        moved = (step.join(jump, "new", "left")
                 .select("id", F.least("new", "far").alias("label"),
                         (F.least("new", "far") != F.col("label")).alias("moved")))
        moved = stored(moved)
        labels = moved.select("id", "label")
        if not moved.filter("moved").head(1):
            return labels


def _partners(rows, threshold, coordinates, best):
    """(a, b) of the rows of one block, as arrays."""
    ids, label, loose = (rows[c] for c in ("id", "label", "loose"))
    # four bits of a coordinate agree by chance one time in sixteen
    agree = threshold + (1 - threshold) / 16
    least = agree * coordinates - 4 * np.sqrt(agree * (1 - agree) * coordinates)
    marks, padding = rows["marks"], coordinates % 2
    other, found = np.flatnonzero(rows["tall"]), []
    for x in np.flatnonzero(rows["wide"]):
        y = other[label[other] != label[x]]
        if not len(y):
            continue
        differ = marks[y] ^ marks[x]
        same = (((differ & 15) == 0).sum(axis=1) + (differ < 16).sum(axis=1)) - padding
        y, same = y[same >= least], same[same >= least]
        if best:
            y = y[[same.argmax()]] if len(y) else y
        elif len(y):
            y = y[~loose[y] | (ids[y] > ids[x])]
            first = (rows["keys"][y] == rows["keys"][x]).argmax(axis=1)
            y = y[rows["keys"][x][first] == np.uint32(rows["bucket"][x] & 0xFFFFFFFF)]
        found.append((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])))
    return tuple(map(np.concatenate, zip(*found))) if found else (ids[:0], ids[:0])


def _second_round(members, labels, marks, threshold, coordinates, best=False):
    """Pairs (a, b) of bucket members in different components that may be links.

    A pair is given by the first bucket that its two texts share, once. With ``best`` a block
    gives only the likeliest partner of each of its loose members."""
    at_leader = labels.select(F.col("id").alias("leader"), F.col("label").alias("leader_label"))
    known = (members.join(labels, "id", "left").join(at_leader, "leader", "left")
             .withColumn("label", F.coalesce("label", "id"))
             .withColumn("loose", F.col("label") != F.coalesce("leader_label", "leader")))
    sizes = (known.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("loose").alias("k"))
             .filter("k > 0").select(
                 "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("rows"),
                 F.ceil(F.col("k") / BLOCK).cast("int").alias("columns")))
    # block (i, j) holds the i-th part of all members and the j-th part of the loose ones
    sign = ["marks"] if best else ["marks", "keys"]
    spot = F.xxhash64("id")
    own_i, own_j = F.pmod(spot, F.col("rows")).cast("int"), F.pmod(spot, F.col("columns")).cast("int")
    across = F.transform(F.sequence(F.lit(0), F.col("columns") - 1),
                         lambda j: F.struct(own_i.alias("i"), j.alias("j")))
    down = F.when(F.col("loose"), F.transform(
        F.sequence(F.lit(0), F.col("rows") - 1),
        lambda i: F.struct(i.alias("i"), own_j.alias("j")))).otherwise(F.array())
    blocks = (known.join(sizes, "bucket").join(marks.select("id", *sign), "id")
              .withColumn("at", F.explode(F.array_union(across, down)))
              .select("bucket", "at.i", "at.j", "id", "label", "loose",
                      (F.col("at.i") == own_i).alias("tall"),
                      (F.col("loose") & (F.col("at.j") == own_j)).alias("wide"), *sign)
              .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"))

    def pairs(batch, first, end):
        rows = {c: batch.column(c).slice(first, end - first) for c in batch.schema.names}
        out = {c: v.to_numpy(zero_copy_only=False) for c, v in rows.items() if c not in sign}
        for c, kind in (("marks", np.uint8), ("keys", np.uint32)):
            if c in rows:
                out[c] = np.frombuffer(b"".join(rows[c].to_pylist()), kind).reshape(end - first, -1)
        return _partners(out, threshold, coordinates, best)

    def run(batches):
        rest = None
        for batch in chain((b for b in batches if b.num_rows), [None]):
            if batch is None:
                ends = [] if rest is None else [0, rest.num_rows]
                whole = rest
            else:
                whole = batch if rest is None else pa.concat_batches([rest, batch])
                at = [whole.column(c).to_numpy() for c in ("bucket", "i", "j")]
                turns = np.flatnonzero(np.any([v[1:] != v[:-1] for v in at], axis=0)) + 1
                ends = [0, *turns.tolist()]
                rest = whole.slice(ends[-1])
            found = [pairs(whole, *cut) for cut in zip(ends, ends[1:])]
            if any(len(a) for a, _ in found):
                a, b = map(np.concatenate, zip(*found))
                kind = whole.schema.field("id").type
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])
        rest = whole = None
        give_back()

    kind = blocks.schema["id"].dataType.simpleString()
    return blocks.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _copies(own: DataFrame) -> DataFrame:
    """(id, digest, rep): the smallest id that has each digest. A digest may have very many
    ids: they meet their representative in salted parts, which only then meet by digest."""
    salted = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS)).cast("int"))
    parts = salted.groupBy("digest", "salt").agg(F.min("id").alias("low"))
    reps = parts.groupBy("digest").agg(F.min("low").alias("rep"))
    named = parts.select("digest", "salt").join(reps, "digest")
    return salted.join(named, ["digest", "salt"]).select("id", "digest", "rep")


def classes(docs: DataFrame, key="doc_id", text="text", bands=BANDS, rows=ROWS, size=SHINGLE,
            threshold=THRESHOLD, weighting="set") -> DataFrame:
    """(key, class_id) of every row: the smallest id of its near-duplicate class."""
    return _classes(docs, key, text, bands, rows, size, threshold, weighting)[0]


def _classes(docs, key, text, bands=BANDS, rows=ROWS, size=SHINGLE, threshold=THRESHOLD,
             weighting="set"):
    """Classes, and (id, digest) of the chosen text of every id whose texts differ."""
    sketched = cut_lineage(sketch(docs, key, text, bands, rows, size, weighting))
    texts = sketched.filter(F.col("digest").isNotNull())
    own = texts.groupBy("id").agg(F.min("digest").alias("digest"))
    chosen = cut_lineage(sketched.groupBy("id").agg(
        F.min("digest").alias("digest"), F.max("digest").alias("last"),
        F.count_if(F.col("digest").isNull()).alias("blank"))
        .filter((F.col("digest") < F.col("last")) | (F.col("digest").isNotNull() & (F.col("blank") > 0)))
        .select("id", "digest"))
    copies = cut_lineage(_copies(own))
    banded = cut_lineage(
        texts.join(copies.filter("id = rep").select("id", "digest"), ["id", "digest"])
        .select("id", F.explode("bands").alias("bucket")).distinct())
    leaders = (banded.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("n"))
               .filter("n > 1").drop("n"))
    members = cut_lineage(banded.join(leaders, "bucket"))
    # each text meets the smallest of its leaders first
    stars = (members.filter("id <> leader").groupBy(F.col("id").alias("b"))
             .agg(F.min("leader").alias("a")))
    links = cut_lineage(compare(docs, stars, key, text, size, weighting, threshold, chosen)
                        .select("a", "b"))
    labels = components(links)
    marks = texts.join(copies.filter("id = rep").select("id", "digest"), ["id", "digest"]).select(
        "id", "marks", "keys").dropDuplicates(["id"])
    for best in (True, False):      # likeliest partners join most; the rest meets all others
        more = cut_lineage(_second_round(members, labels, marks, threshold, bands * rows, best))
        if not more.head(1):
            break
        extra = compare(docs, more, key, text, size, weighting, threshold, chosen)
        links = cut_lineage(links.unionByName(extra.select("a", "b")))
        labels = components(links)
    named = copies.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "id", F.coalesce("label", "rep").alias("class_id"))
    return (docs.select(F.col(key).alias("id")).join(named, "id", "left")
            .select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"))), chosen


def op8(spark, folder):
    return classes(table(spark, folder, "documents"))


def keep_one(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """The documents (all their columns) with one of each class: its smallest id, once, with the
    text that stands for that id. Rows without an id stay."""
    found, chosen = _classes(docs, key, text)
    kept = found.filter(F.col(key) == F.col("class_id")).select(key).distinct()
    named = docs.join(kept, key, "left_semi")
    # only ids whose texts differ have a digest here; for all others nothing is evaluated
    words = F.filter(F.split(whole_text(text), BLANKS), lambda w: w != "")
    own = F.unhex(F.md5(F.array_join(words, " ")))
    picked = (named.join(chosen.select(F.col("id").alias(key), F.col("digest").alias("_digest")), key, "left")
              .filter(F.col("_digest").isNull() | (own == F.col("_digest"))).select(*docs.columns))
    return picked.dropDuplicates([key]).unionByName(docs.filter(F.col(key).isNull()))
