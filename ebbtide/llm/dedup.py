"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is made of `symbols` minima of hash functions over its shingle set. The low 16
bits of the first `chunks * chunk_size` of them are its b-bit signature. Two signatures that differ in
at most `chunks * (errors + 1) - 1` symbols have, by the pigeonhole principle, a chunk with at most
`errors` differing symbols. Each chunk is therefore indexed once for every choice of `errors`
positions left out, and equality of one such key finds every pair within that distance. Pairs beyond
it still meet often: with ten chunks of six symbols and one error a pair of similarity 0.8 is missed
once in 40,000 times. Three bits of every minimum make a sketch; pairs whose sketches differ in more
than `most_apart` of the 256 minima (4.8 standard deviations above the mean at similarity 0.8) are
dropped where they meet. The others are confirmed on the full shingle sets.

Documents of equal sets form a class and only the smallest doc_id stands for it. A bucket's members are
compared with one hub, the member that meets the most documents over all its buckets: in a group of
near copies that is the text that the others were made from. Members linked with the hub are one
component. Of the other pairs, only those whose differences from the hub overlap are compared: with
D(x) = x minus hub plus hub minus x, the difference of x and y has |D(x)| + |D(y)| - 2 |D(x) & D(y)|
elements, so two texts of which one is no link of the hub must share more than a known number of
elements of D. Elements are put in order of rarity, and texts can only share that many if they share one
among the first few (prefix filter). All this is exact; a group of thousands of near copies, linked with
their origin or just not, costs thousands of comparisons instead of millions.
"""

import hashlib
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.llm.sending import broadcast, received
from ebbtide.llm.shingles import WordHashes, mix, shingle_set, texts, words
from ebbtide.session import materialize

SYMBOLS, PLANES = 256, 3
WORDS_OF_SKETCH = [f"sketch_{plane}_{k}" for plane in range(PLANES) for k in range(SYMBOLS // 64)]
PRINTS = ", ".join(["doc_id long, n_shingles long, set_key string, signature binary", *(f"{w} long" for w in WORDS_OF_SKETCH)])
SETS = "doc_id long, shingles array<long>"
BLOCK = 4096
BITMAP_BITS = 1 << 25


class Signer:
    """Signatures, sketches and chunk keys of shingle sets."""

    def __init__(self, chunks, chunk_size, errors, seed):
        self.chunks, self.size = chunks, chunk_size
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.offsets = rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
        self.salts = rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
        left = list(combinations(range(chunk_size), errors))
        self.keep = np.array([[p not in gone for p in range(chunk_size)] for gone in left])
        self.key_salts = rng.integers(0, 2**63, (chunks, len(left)), dtype=np.uint64)

    def minima(self, items):
        low = np.full(SYMBOLS, np.iinfo(np.uint32).max, np.uint32)
        high = (items >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(high), BLOCK):
            part = high[at:at + BLOCK, None] * self.factors
            part += self.offsets
            np.minimum(low, part.min(axis=0), out=low)
        return low

    def signatures(self, minima):
        """Per row of minima: the 16-bit symbols that are indexed, and the sketch as 64-bit words."""
        mixed = mix(minima.astype(np.uint64) + self.salts)
        symbols = (mixed[:, :self.chunks * self.size] & np.uint64(0xFFFF)).astype(np.uint16)
        planes = [np.packbits((mixed >> np.uint64(40 + k)).astype(np.uint8) & 1, axis=1) for k in range(PLANES)]
        return symbols, np.concatenate(planes, axis=1).view(np.int64)

    def bands(self, symbols):
        """Keys of all chunks with every allowed choice of left-out positions."""
        n = len(symbols)
        used = self.chunks * self.size
        parts = mix(symbols.astype(np.uint64) + self.salts[:used]).reshape(n, self.chunks, self.size)
        sums = np.stack([parts[:, :, keep].sum(axis=2, dtype=np.uint64) for keep in self.keep], axis=2)
        return mix(sums + self.key_salts).reshape(n, -1).view(np.int64)


def lists(flat, lengths):
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def fingerprints(docs, size, signer):
    """One row per document: set size, key of its set, signature and sketch (zeros without words)."""
    def run(batches):
        memo = WordHashes()
        for batch in batches:
            counts, keys, found = [], [], [np.empty((0, SYMBOLS), np.uint32)]
            for text in texts(batch.column(1)):
                items = shingle_set(words(text), size, memo)
                counts.append(len(items))
                keys.append(hashlib.blake2b(items.tobytes(), digest_size=16).hexdigest() if len(items) else None)
                found.append(signer.minima(items)[None, :])
            symbols, sketch = signer.signatures(np.concatenate(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.string()),
                 pa.array([row.tobytes() for row in symbols], pa.binary()),
                 *(pa.array(np.ascontiguousarray(word)) for word in sketch.T)],
                ["doc_id", "n_shingles", "set_key", "signature", *WORDS_OF_SKETCH])
    return docs.mapInArrow(run, PRINTS)


def indexed(heads, signer):
    """(band, rep): the chunk keys of every representative."""
    def run(batches):
        for batch in batches:
            symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16)
            keys = signer.bands(symbols.reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], ["band", "rep"])
    return heads.select("rep", "signature").mapInArrow(run, "band long, rep long")


def shingle_sets(docs, size, bitmap):
    """Sets of the documents whose bit is set in the bitmap."""
    bits = broadcast(docs.sparkSession, bitmap)

    def run(batches):
        memo, wanted = WordHashes(), received(bits)
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((wanted[at >> 3] >> (at & 7) & 1).astype(bool)))
            found = [shingle_set(words(text), size, memo) for text in texts(batch.column(1))]
            flat = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists(flat, [len(x) for x in found])], ["doc_id", "shingles"])
    return docs.select("doc_id", "text", bit_of("doc_id").alias("bit")).mapInArrow(run, SETS)


def bit_of(name):
    return F.pmod(F.xxhash64(name), F.lit(BITMAP_BITS))


def bitmap_of(ids):
    """Bitmap of fixed size with the bit of every id; other ids may share a bit, none is lost."""
    bit = bit_of("doc_id")
    parts = ids.groupBy(F.bitmap_bucket_number(bit + 1).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit + 1)).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in parts:
        piece = np.frombuffer(row.bits, np.uint8)
        out[(row.part - 1) * len(piece):row.part * len(piece)] = piece
    return out


def components(edges):
    """(node, component) for the edges (a, b): alternating large and small stars until nothing
    changes; the component is its smallest node."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state


def confirmed(pairs, docs, size, percent):
    """The pairs (a, b, n_a, n_b) whose sets share at least `percent` of their union. Sets are made
    anew for the documents of the pairs only; the texts themselves are not shuffled."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = shingle_sets(docs.where("doc_id is not null"), size, bitmap_of(ids))
    sets = materialize(sets.join(ids, "doc_id").dropDuplicates(["doc_id"]), "sets")
    both = pairs.join(sets.toDF("a", "x_a"), "a").join(sets.toDF("b", "x_b"), "b")
    return (both.withColumn("both", F.size(F.array_intersect("x_a", "x_b")))
            .where(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent).select("a", "b"))


def apart():
    """In how many minima the sketches of m and h differ."""
    step = SYMBOLS // 64
    differ = {w: F.col(f"m.{w}").bitwiseXOR(F.col(f"h.{w}")) for w in WORDS_OF_SKETCH}
    words = [reduce(lambda x, y: x.bitwiseOR(y), [differ[w] for w in WORDS_OF_SKETCH[k::step]]) for k in range(step)]
    return sum(map(F.bit_count, words))


def near(percent, most_apart):
    """Sizes and sketches of m and h allow the wanted similarity."""
    small, large = (f(F.col("m.n"), F.col("h.n")) for f in (F.least, F.greatest))
    return (small * 100 >= large * percent) & (apart() <= most_apart)


def pairs_of(joined):
    return joined.select(F.col("h.rep").alias("a"), F.col("m.rep").alias("b"),
                         F.col("h.n").alias("n_a"), F.col("m.n").alias("n_b")).distinct()


def differences(spokes, docs, size):
    """spokes (hub, rep) with n_hub and the elements in which rep differs from its hub."""
    ids = materialize(spokes.select(F.explode(F.array("hub", "rep")).alias("doc_id")).distinct(), "ids")
    sets = shingle_sets(docs.where("doc_id is not null"), size, bitmap_of(ids))
    sets = materialize(sets.join(ids, "doc_id").dropDuplicates(["doc_id"]), "sets")
    both = spokes.join(sets.toDF("hub", "x_h"), "hub").join(sets.toDF("rep", "x_r"), "rep")
    return both.select("hub", "rep", F.size("x_h").alias("n_hub"), F.concat(
        F.array_except("x_r", "x_h"), F.array_except("x_h", "x_r")).alias("diff"))


def by_differences(spokes, heads, docs, size, percent, most_apart, labels):
    """Pairs of different components that meet at a hub and share rare differences from it."""
    share = (100 - percent) / (100 + percent)
    spokes = (differences(spokes, docs, size).join(heads.select("rep", "n", *WORDS_OF_SKETCH), "rep")
              .join(labels.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    d = F.size("diff")
    least = (d + (F.col("n_hub") - F.col("n")) * share) / 2
    least_of_linked = (d - (F.col("n_hub") + F.col("n")) * share) / 2
    spokes = materialize(spokes.select(
        "hub", "rep", "n", "component", *WORDS_OF_SKETCH, "diff",
        (d <= (F.col("n_hub") + F.col("n")) * share).alias("linked"),
        # Among texts that are no links of the hub, and for links of it against those, more than
        # `least` elements are shared; between such a text and links of the hub, `least_of_linked`.
        (d - F.floor(F.greatest(least - 1e-9, F.lit(0.0)))).alias("short"),
        (d - F.greatest(F.lit(1), F.ceil(least_of_linked - 1e-9)) + 1).alias("long")), "spokes")
    elements = spokes.select("hub", "rep", "linked", "short", "long", F.explode("diff").alias("element"))
    held = elements.groupBy("hub", "element").agg(F.count("*").alias("times")).where("times > 1")
    alone = spokes.select("hub", "rep", d.alias("d"))
    shared = elements.join(held, ["hub", "element"])
    # Elements held once come first in the order of rarity; they are counted, not carried.
    place = F.row_number().over(Window.partitionBy("hub", "rep").orderBy("times", "element"))
    count = F.count("*").over(Window.partitionBy("hub", "rep"))
    ranked = shared.withColumn("place", place).withColumn("count", count).join(alone, ["hub", "rep"])
    ranked = ranked.withColumn("place", F.col("place") + F.col("d") - F.col("count"))
    keep = F.when(F.col("linked"), F.col("short")).otherwise(F.greatest("short", "long"))
    early = (F.col("place") <= F.col("short")).alias("early")
    first = materialize(ranked.where(F.col("place") <= keep).select("hub", "element", "rep", early).join(
        spokes.select("hub", "rep", "n", "component", "linked", *WORDS_OF_SKETCH), ["hub", "rep"]), "firsts")
    m, h = first.alias("m"), first.alias("h")
    meets = near(percent, most_apart) & (F.col("m.component") != F.col("h.component"))
    for key in ("hub", "element"):
        meets &= F.col(f"m.{key}") == F.col(f"h.{key}")
    loose = m.where("NOT m.linked AND early").join(
        h.where("NOT h.linked AND early"), meets & (F.col("m.rep") > F.col("h.rep")))
    mixed = m.where("NOT m.linked").join(h.where("h.linked AND early"), meets)
    return pairs_of(loose).union(pairs_of(mixed)).distinct()


def near_duplicates(docs, size=5, percent=80, chunks=10, chunk_size=6, errors=1, most_apart=74, seed=7):
    """Component of every document under "shares at least `percent` of the union of shingles".

    Returns doc_id, n_shingles, component_id, kept for each row of `docs` (columns doc_id, text).
    Null and wordless texts have no shingles and are linked with nothing; rows without doc_id keep
    a null component and stay. Of texts that share a doc_id, one is compared; all rows are returned.
    """
    docs = docs.select("doc_id", "text")
    signer = Signer(chunks, chunk_size, errors, seed)
    prints = materialize(fingerprints(docs, size, signer), "prints")
    same = [F.first(c).alias(c) for c in ("signature", *WORDS_OF_SKETCH)]
    heads = materialize(prints.where("doc_id is not null and n_shingles > 0").groupBy("set_key")
                        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), *same), "heads")
    entries = indexed(heads, signer)
    full = entries.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    entries = materialize(entries.join(full, "band"), "entries")
    scores = entries.groupBy("rep").agg(F.sum("members").alias("score"))
    scored = entries.join(scores, "rep")
    top = F.max(F.struct("score", (-F.col("rep")).alias("last"))).alias("top")
    hubs = scored.groupBy("band").agg(top).select("band", (-F.col("top.last")).alias("hub"))
    crowded = materialize(entries.join(hubs, "band"), "crowded")

    facts = heads.select("rep", "n", *WORDS_OF_SKETCH)
    spokes = crowded.where("rep != hub").select("hub", "rep").distinct()
    joined = (spokes.alias("s").join(facts.alias("m"), F.col("s.rep") == F.col("m.rep"))
              .join(facts.alias("h"), (F.col("s.hub") == F.col("h.rep")) & near(percent, most_apart)))
    pairs = materialize(pairs_of(joined), "pairs")
    labels = components(materialize(confirmed(pairs, docs, size, percent), "links"))

    named = (crowded.where("members > 2").join(labels.toDF("rep", "component"), "rep", "left")
             .withColumn("component", F.coalesce("component", "rep")))
    open_bands = named.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    spokes = materialize(named.join(open_bands, "band").where("rep != hub").select("hub", "rep").distinct(), "open")
    pairs = materialize(by_differences(spokes, heads, docs, size, percent, most_apart, labels), "pairs")
    more = materialize(confirmed(pairs, docs, size, percent), "links")
    if not more.isEmpty():
        labels = components(labels.toDF("a", "b").unionByName(more))

    classes = (heads.select("set_key", "rep").join(labels.toDF("rep", "component"), "rep", "left")
               .select("set_key", F.coalesce("component", "rep").alias("component")))
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return (prints.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), own))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def filtered(docs, **options):
    """One row of docs, all columns, for each component of near duplicates: the smallest doc_id's.
    Rows without doc_id and texts without words stay; of rows that repeat a doc_id one stays.

    Ids are shuffled, texts hardly: a bitmap of the ids that go or repeat, broadcast as at most
    BITMAP_BITS / 64 words, lets all others pass where they are read. Only rows whose bit is set are
    joined with the ids themselves."""
    found = materialize(near_duplicates(docs, **options), "components")
    named = found.where("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    judged = materialize(named.where("n > 1 or not kept"), "judged")
    word, place = F.floor(bit_of("doc_id") / 64).cast("int"), F.pmod(bit_of("doc_id"), F.lit(64)).cast("int")
    bits = F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits")
    bitmap = judged.select(word.alias("word"), place.alias("place")).groupBy("word").agg(bits)
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.withColumns({"word": word, "place": place}).join(F.broadcast(bitmap), "word", "left")
    held = F.col("doc_id").isNotNull() & F.coalesce(F.getbit("bits", F.col("place")) == 1, F.lit(False))
    left = (rows.where(held).select("doc_id", "doc")
            .join(judged.where("not kept").select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"]))
    return rows.where(~held).select("doc").unionByName(left.select("doc")).select("doc.*")
