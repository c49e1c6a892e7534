"""Near-duplicate documents by HyperMinHash sketches.

Every distinct shingle of a document is hashed once. Some hash bits choose one
of ``BUCKETS`` buckets; of the smallest remaining value in a bucket the sketch
stores the count of leading zeros and the ``MANTISSA`` bits that follow the
first one, 16 bits in all. For banding, ``FOLD`` neighbouring registers are reduced
to their least; bands of ``ROWS`` such registers are the join keys. A candidate
pair is judged on its sketches first, with the chance agreement of compressed
registers subtracted, and then on both full sets.

Size and skew
-------------
* Documents with the same set are one class, and one sketch of it goes on, so
  exact copies never meet in a band.
* A band group is never expanded into pairs. Its members are compared with the
  smallest one (a star); that joins most groups into one component. Groups that
  still hold several components are cut into tiles of ``TILE`` members, and
  pairs of different components are compared on sketches inside a tile. What they
  do not rule out is verified there too: the texts of the members are sent to the
  tile once, whatever the number of pairs, and links that join nothing new are
  left out, so no more links than members leave a tile.
* Most tiles join a block of strays with the blocks of one large component, so
  they grow with the group and not with its square. Where more than ``LARGE``
  members are strays, stars of the parts that the members' other bands make come
  first, which joins more of them; the group is compared whole after that, so its
  size decides on the work and not on the links. A group's blocks grow by the root
  of its size, so its tiles grow with it, and its members are sent to that root of
  tiles each; true strays are all compared inside them, which grows with their square.
* Links are confirmed on the shingles' words, not on hashes of them.
* Components are found with shuffled joins; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut, settled
from tessera.llm.rows import named, unpacked
from tessera.llm.scan import LOWER, SPACED, Block, mix, record, shingle_hash, small_batches, text_blocks
from tessera.operators.components import connected_components

P_BITS = 9
BUCKETS = 1 << P_BITS
#: A band register is the least of so many neighbouring ones; bands stay few while estimates use all registers.
FOLD = 4
MANTISSA = 10
ROWS = 4
EMPTY = 0xFFFF
TILE = 256
#: Stars of a group's parts come before its tiles, ``SPLITS`` times at most, while more members than this lie outside its largest component.
LARGE = 16_384
SPLITS = 2
#: Shingles of the members whose texts are held together.
HELD = 1 << 21
#: Standard deviations that an estimate may fall short of the threshold and still be verified.
SLACK = 5.0
U64 = np.uint64
#: Lower-cases A-Z of a byte string and leaves all other bytes.
LOWER_CASE = LOWER.tobytes()

SKETCH = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("regs", pa.binary())])


def block_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    block = Block(texts, SPACED, lower=True)
    words = block.word_hash()
    grams = shingle_hash(words, n)
    out = []
    for i in range(block.n_docs):
        a, b = block.first[i], block.first[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(shingle_hash(words[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, BUCKETS) compressed registers; EMPTY where no shingle fell into a bucket."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.full((len(sets), BUCKETS), EMPTY, np.uint16)
    if not sizes.sum():
        return out
    h = np.concatenate(sets)
    h = mix(h ^ U64(0xD6E8FEB86659FD93))
    slot = np.repeat(np.arange(len(sets)), sizes) * BUCKETS + (h >> U64(64 - P_BITS)).astype(np.int64)
    width = 64 - P_BITS
    least = np.full(len(sets) * BUCKETS, np.iinfo(np.uint64).max)
    np.minimum.at(least, slot, h & U64((1 << width) - 1))
    full = np.flatnonzero(least != np.iinfo(np.uint64).max)
    fraction, exponent = np.frexp(np.maximum(least[full], U64(1)).astype(np.float64))
    zeros = np.clip(width - exponent, 0, 62)
    # more zeros give a smaller register, so that registers are ordered as the values are
    out.reshape(-1)[full] = (62 - zeros) * (1 << MANTISSA) + ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return out


def jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected estimates for rows of registers, and how many registers they rest on.

    Two unequal minima still agree in a compressed register with a probability
    that the HyperMinHash paper approximates for similar cardinalities; that
    expected number of agreements is taken off before dividing.
    """
    both = (a != EMPTY) | (b != EMPTY)
    used = both.sum(-1)
    same = ((a == b) & both).sum(-1)
    load = np.maximum(na, nb) / BUCKETS
    phi = 4 * load / (1 + load) ** 2
    # the constant that the HyperMinHash paper publishes (a fixed value)
    by_chance = 0.16991948715973910 * 2.0 ** (P_BITS - MANTISSA) * phi
    return (same - by_chance) / np.maximum(used, 1), used


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """False where the sketches rule the pair out: sizes too unlike, or an estimate far below the threshold.

    The filled registers are a sample without replacement of the union, which
    has about (na + nb) / (1 + similarity) members for a pair at the threshold.
    """
    estimate, used = jaccard(a, b, na, nb)
    used = np.maximum(used, 1)
    unseen = np.clip(1 - used * (1 + similarity) / np.maximum(na + nb, 1), 0, 1)
    slack = SLACK * np.sqrt(similarity * (1 - similarity) / used * unseen) + 1 / used
    sizes = np.minimum(na, nb) >= (similarity - 1e-9) * np.maximum(na, nb)
    return sizes & (estimate >= similarity - slack)


def sketches(rows: DataFrame, n: int) -> DataFrame:
    """(doc, mark, doc_id, n_shingles, d1, d2, regs): set size, a 128-bit digest of the set, and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            sets = block_sets(texts, n)
            with np.errstate(over="ignore"):
                d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                d2 = np.array([mix(s * U64(0xA24BAED4963EE407)).sum(dtype=np.uint64) for s in sets], np.uint64)
            regs = registers(sets)
            own = dict(zip(("doc", "mark", "doc_id"), batch.columns, strict=False))
            yield record(SKETCH, **own, n_shingles=[len(s) for s in sets], d1=d1.view(np.int64), d2=d2.view(np.int64), regs=[r.tobytes() for r in regs])

    return rows.select("doc", "mark", "doc_id", "text").mapInArrow(run, "doc long, mark long, doc_id long, n_shingles long, d1 long, d2 long, regs binary")


BANDS = BUCKETS // FOLD // ROWS


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, bands) join keys, and which of them have a filled register."""
    k = BANDS
    folded = regs.reshape(-1, k, ROWS, FOLD).min(-1).astype(np.uint64)
    key = np.zeros(folded.shape[:2], np.uint64)
    for j in range(ROWS):
        key = (key << U64(16)) | folded[:, :, j]
    return mix(mix(key) + np.arange(k, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)), key != U64(0xFFFFFFFFFFFFFFFF)


def bands(reps: DataFrame) -> DataFrame:
    """(band, rep): one row for each band that has a filled register."""
    schema = pa.schema([("band", pa.int64()), ("rep", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, keep = band_keys(_regs(batch.column(1)))
            row, _ = np.nonzero(keep)
            yield record(schema, band=key[keep].view(np.int64), rep=batch.column(0).take(pa.array(row)))

    return reps.select("rep", "regs").mapInArrow(run, "band long, rep long")


def _regs(col: pa.Array) -> np.ndarray:
    """(rows, BUCKETS) registers of a binary column without nulls."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _promising(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = plausible(_regs(batch.column(2)), _regs(batch.column(3)), batch.column(4).to_numpy(), batch.column(5).to_numpy(), similarity)
                yield batch.select([0, 1]).filter(pa.array(ok))

    left = reps.select(F.col("rep").alias("a"), F.col("regs").alias("ra"), F.col("n_shingles").alias("na"))
    right = reps.select(F.col("rep").alias("b"), F.col("regs").alias("rb"), F.col("n_shingles").alias("nb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb", "na", "nb")
    return joined.mapInArrow(run, "a long, b long")


def word_sets(text: bytes, n: int) -> set[tuple[bytes, ...]]:
    """The distinct ``n``-word shingles of a text, or its whole word sequence if that is shorter."""
    words = text.translate(LOWER_CASE).split()
    return set(zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else {tuple(words)} if words else set()


def _linked(x: np.ndarray, y: np.ndarray, left: bytes, right: bytes, n: int, percent: int) -> bool:
    """Whether two texts, with the hashes x and y of their shingles, satisfy 100 * intersection >= percent * union."""
    def enough(a: int, b: int, common: int) -> bool:
        return 100 * common >= percent * (a + b - common)

    # hashes that coincide add to what is common; only what they leave is compared word by word
    if not enough(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))):
        return False
    a, b = word_sets(left, n), word_sets(right, n)
    return enough(len(a), len(b), len(a & b))


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets satisfy 100 * intersection >= percent * union, by texts (rep, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, at = np.zeros(batch.num_rows, bool), 0
            for part, left in text_blocks(iter([batch]), "ta"):
                right = [t or b"" for t in part.column(3).cast(pa.large_binary()).to_pylist()]
                for i, (x, y) in enumerate(zip(block_sets(left, n), block_sets(right, n), strict=True)):
                    ok[at + i] = _linked(x, y, left[i], right[i], n, percent)
                at += part.num_rows
            yield batch.select([0, 1]).filter(pa.array(ok))

    a = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _grouped(band: DataFrame) -> DataFrame:
    """(band, ..., rep, hub): the members of bands that hold several, with the smallest one, written."""
    def several() -> DataFrame:
        groups = cut(band.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1").drop("m"), "groups")
        return band.join(groups, "band")

    return settled(several, "in-groups")


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): each member with its band's smallest one."""
    return members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()


def _open(members: DataFrame, components: DataFrame) -> DataFrame:
    """The members of bands that hold several components, with theirs, the band's ``size`` and the number outside its largest, written."""
    def opened() -> DataFrame:
        placed = members.drop("hub").join(components, members.rep == components.node, "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")
        placed = cut(placed, "placed")
        sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("n"))
        split = sizes.groupBy("band").agg(F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("strays")).where("strays > 0")
        return placed.join(split, "band")

    return settled(opened, "open")


def _finer(large: DataFrame, reps: DataFrame) -> DataFrame:
    """(band, used, rep): members of groups (band, used, rep) under the sums of the group's key and that of each of their other bands.

    ``used`` has a bit for each band whose keys are summed; 0 stands for the one band of a first group.
    """
    schema = pa.schema([("band", pa.int64()), ("used", pa.int64()), ("rep", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, keep = band_keys(_regs(batch.column(3)))
            band, used = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            bits = np.int64(1) << np.arange(BANDS)
            used = np.where(used == 0, ((key == band[:, None]) * bits).sum(1), used)
            row, j = np.nonzero(keep & ((used[:, None] & bits) == 0))
            yield record(schema, band=(band[row] + key[row, j]).view(np.int64), used=used[row] | bits[j], rep=batch.column(2).take(pa.array(row)))

    rows = large.join(reps.select("rep", "regs"), "rep").select("band", "used", "rep", "regs")
    return rows.mapInArrow(run, "band long, used long, rep long").distinct()


def _tiles(open_bands: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """(band, i, j, part, rep, comp, others): the members of each tile that have plausible partners in other components, with those of them that are larger.

    Members are numbered by component and cut into blocks of TILE, so that most
    blocks hold one component; two blocks of the same single component make no tile.
    Blocks of a larger group are longer by the root of its size, so that tiles grow
    with the group and not with its square.
    A pair that shares several bands comes out of its first one only. A tile comes
    in parts of at most about HELD shingles, each with its pairs.
    """
    # blocks are cut inside the parts of a range partitioning, so a large band is numbered by many tasks
    parts = int(open_bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(open_bands.select("band", "rep", "comp", "size").repartitionByRange(parts, "band", "comp", "rep").withColumn("part", F.spark_partition_id()), "dealt")
    m = dealt.withColumn("block", F.expr(f"(cast(part as long) << 32) + (row_number() over (partition by part, band order by comp, rep) - 1) div greatest({TILE}, cast(ceil(sqrt({TILE} * size)) as long))"))
    m = cut(m.drop("part", "size"), "members")
    blocks = m.groupBy("band", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    x, y = blocks.alias("x"), blocks.alias("y")
    tiles = (
        x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.block") <= F.col("y.block")))
        .where("not (x.lo = x.hi and y.lo = y.hi and x.lo = y.lo)")
        .select("x.band", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    )
    sides = tiles.select("band", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = (
        sides.join(m, ["band", "block"])
        .join(reps.select("rep", "regs", "n_shingles"), "rep")
        .select("band", "i", "j", "block", "rep", "comp", "n_shingles", "regs")
        .repartition("band", "i", "j")
        .sortWithinPartitions("band", "i", "j")
    )
    schema = pa.schema([("band", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("part", pa.int32()), ("rep", pa.int64()), ("comp", pa.int64()), ("others", pa.list_(pa.int64()))])

    def plausible_pairs(rows: list[tuple]) -> Iterator[tuple[tuple, tuple]]:
        i, j = rows[0][1], rows[0][2]
        left = [r for r in rows if r[3] == i]
        right = left if i == j else [r for r in rows if r[3] == j]
        regs = np.frombuffer(b"".join(r[7] for r in right), np.uint16).reshape(-1, BUCKETS)
        size, comp = (np.array([r[k] for r in right]) for k in (6, 5))
        keys, filled = band_keys(regs)
        here = rows[0][0]
        for r in left:
            other = np.flatnonzero(comp > r[5]) if i == j else np.flatnonzero(comp != r[5])
            if not len(other):
                continue
            own = np.frombuffer(r[7], np.uint16).reshape(1, BUCKETS)
            hit = other[plausible(np.broadcast_to(own, (len(other), BUCKETS)), regs[other], np.full(len(other), r[6]), size[other], similarity)]
            key, _ = band_keys(own)
            first = ((keys[hit] == key) & filled[hit]).argmax(1)
            for q in hit[key[0, first].view(np.int64) == here].tolist():
                yield r, right[q]

    def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        others: dict[int, list[int]] = {}
        comps: dict[int, int] = {}
        part = total = 0

        def out() -> pa.RecordBatch:
            n = len(others)
            return record(schema, **{c: [rows[0][k]] * n for k, c in enumerate(("band", "i", "j"))}, part=[part] * n, rep=list(others), comp=[comps[x] for x in others], others=list(others.values()))

        for r, q in plausible_pairs(rows):
            more = sum(x[6] for x in (r, q) if x[4] not in others)
            if others and total + more > HELD:
                yield out()
                others, comps, part, total = {}, {}, part + 1, 0
                more = r[6] + q[6]
            total += more
            for x in (r, q):
                others.setdefault(x[4], [])
                comps[x[4]] = x[5]
            others[min(r[4], q[4])].append(max(r[4], q[4]))
        if others:
            yield out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != key:
                    if len(held) > 1:
                        yield from compare(held)
                    key, held = r[:3], []
                held.append(r)
        if len(held) > 1:
            yield from compare(held)

    return rows.mapInArrow(run, "band long, i long, j long, part int, rep long, comp long, others array<long>")


def _crossing(open_bands: DataFrame, reps: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links between different components of the given groups (band, rep, comp), enough to join all that their tiles join."""
    tiles = cut(_tiles(open_bands, reps, percent / 100), "tiles")
    rows = tiles.join(texts, "rep").select("band", "i", "j", "part", "rep", "comp", "others", "text").repartition("band", "i", "j", "part").sortWithinPartitions("band", "i", "j", "part")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(held: list[tuple]) -> pa.RecordBatch:
        of = {rep: (found, text) for rep, _, _, found, text in held}
        # components before are numbered apart from the members
        top = {("comp", comp): ("comp", comp) for _, comp, _, _, _ in held} | {rep: ("comp", comp) for rep, comp, _, _, _ in held}

        def root(x: object) -> object:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        joins = []
        for a, _, others, found, text in held:
            for b in others:
                x, y = root(a), root(b)
                if x != y and _linked(found, of[b][0], text, of[b][1], n, percent):
                    top[x] = y
                    joins.append((a, b))
        return record(schema, a=[a for a, _ in joins], b=[b for _, b in joins])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch, block in text_blocks(batches):
            sets = block_sets(block, n)
            fields = [c.to_pylist() for c in batch.columns[:7]]
            for *at, rep, comp, others, found, text in zip(*fields, sets, block, strict=True):
                if at != key:
                    if held:
                        yield links(held)
                    key, held = at, []
                held.append((rep, comp, others, found, text))
        if held:
            yield links(held)

    return rows.mapInArrow(run, "a long, b long")


def _placed(classes: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(d1, d2, n_shingles, least, group): the component of each class."""
    similarity = percent / 100
    members = _grouped(bands(classes).withColumn("used", F.lit(0).cast("long")))
    reps = cut(classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "doc", "mark", "n_shingles", "regs"), "grouped-reps")
    texts = rows.select("doc", "mark", "text").join(reps.select("rep", "doc", "mark"), ["doc", "mark"]).dropDuplicates(["doc", "mark"])
    texts = cut(texts.select("rep", "text"), "grouped-texts")

    every = cut(_verified(_promising(_stars(members), reps, similarity), texts, n, percent), "edges")
    opened = parts = _open(members, connected_components(every, "a", "b"))
    for _ in range(SPLITS):
        large = parts.where(f"strays > {LARGE}")
        if large.isEmpty():
            break
        finer = _grouped(_finer(large, reps))
        every = cut(every.unionByName(_verified(_promising(_stars(finer), reps, similarity), texts, n, percent)), "edges")
        found = connected_components(every, "a", "b")
        opened, parts = _open(members, found), _open(finer, found)
    late = _crossing(opened, reps, texts, n, percent)
    labels = connected_components(cut(every.unionByName(late), "all-edges"), "a", "b")

    return classes.join(labels, classes.rep == labels.node, "left").select("d1", "d2", "n_shingles", "least", F.coalesce("component", "rep").alias("group"))


def groups(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc, mark, doc_id, n_shingles, group, component_id) for rows (doc, mark, doc_id, text); ``group`` is null without words."""
    sk = cut(sketches(rows, n), "sketches")
    filled, bare = sk.where("n_shingles > 0"), sk.where("n_shingles = 0")
    # all firsts come from one row: they are filled together
    one = [F.first(c).alias(c) for c in ("doc", "mark", "regs")]
    classes = filled.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("least"), *one)
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    placed = settled(lambda: _placed(classes, rows, n, percent), "placed-classes")
    least = placed.groupBy("group").agg(F.min("least").alias("component_id"))
    by_class = placed.drop("least").join(least, "group")
    found = filled.drop("regs").join(by_class, ["d1", "d2", "n_shingles"]).select("doc", "mark", "doc_id", "n_shingles", "group", "component_id")
    return found.unionByName(bare.select("doc", "mark", "doc_id", "n_shingles", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are runs of non-space bytes, A-Z lower-cased; a document's set is its
    distinct ``n``-word shingles, or its whole word sequence where it has fewer.
    Two documents are linked where 100 * intersection >= percent * union;
    ``component_id`` is the smallest doc_id that links reach, and ``kept`` says
    whether it is the row's own.

    Nulls and empty texts have no set: they are linked with nothing and kept,
    with n_shingles 0. Rows that share a doc_id are told apart by their texts;
    equal rows come out as often as they came in. A row without a doc_id is
    linked like others: it is kept where nothing that it reaches has one
    (component_id null). Columns of ``docs`` other than doc_id and text are
    ignored. An empty table gives no rows.
    """
    found = groups(named(small_batches(docs).select("doc_id", "text")), n, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row, with all columns, of each group of near-duplicates in ``docs``: the smallest doc_id, null after all others.

    Of rows that agree in doc_id and text any one stays. Rows without words are
    in no group, and all stay.
    """
    rows = named(small_batches(docs))
    found = groups(rows, n, percent).where("group is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc", "mark")).alias("first")
    chosen = found.groupBy("group").agg(first).select("first.doc", "first.mark")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = rows.where(worded).join(chosen, ["doc", "mark"], "left_semi").dropDuplicates(["doc", "mark"])
    return unpacked(kept.select("row").unionByName(rows.where(~worded).select("row")), docs.columns)


def oracle_sql() -> str:
    """The rows of :func:`near_duplicates` over ``documents`` with shingles of four words and 80 percent, in DuckDB SQL: all pairs that share a shingle, for small tables."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, hash(array_to_string(list_slice(w, k, k + 3), ' ')) AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY 1), gn AS (SELECT * FROM g JOIN n USING (rid)),
both_ AS (SELECT a.rid AS a, b.rid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM gn a JOIN gn b ON a.g = b.g AND a.rid < b.rid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ WHERE 100 * c >= 80 * (na + nb - c)), sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
walk AS (SELECT rid, rid AS at FROM d UNION SELECT walk.rid, sym.b FROM walk JOIN sym ON sym.a = walk.at),
least_ AS (SELECT walk.rid, min(o.doc_id) AS component_id FROM walk JOIN d o ON o.rid = walk.at GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN least_ USING (rid) LEFT JOIN n USING (rid)"""
