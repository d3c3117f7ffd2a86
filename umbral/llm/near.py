"""Near-duplicates by weighted Jaccard similarity of word shingles: BagMinHash, bands, verification.

A text is the bag of its word shingles with their counts. A count is made up of the weights (0, 1],
(1, 2], (2, 4], ... up to it; each of these intervals of a shingle has a Poisson process of its own,
whose rate is the interval's length, seeded by the shingle. A point has a time, a place in the
signature and a weight, and counts for a bag that holds at least this weight. The earliest point at a
place is the signature there; two bags agree on it with a probability equal to their similarity. A
process is followed no further than the latest of its bag's earliest points.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbral.llm.common import materialise, mix, part_count, text_of
from umbral.llm.components import components
from umbral.llm.suffixes import FILTER_BITS, fixed_filter
from umbral.llm.tokens import slices
from umbral.operators.ordering import running_sums

WORDS, THRESHOLD = 5, 0.8
#: At 0.8 a pair shares no band of these with probability (1 - 0.8**5)**32 < 4e-6.
BANDS, ROWS = 32, 5
#: Texts that are compared all with all in one task: so many, and, a single text aside, so many bytes.
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 20
#: Nodes that are compared with one copy of their hub's text.
SHARE = 512
COLUMNS = 8192
CACHE = 160_000
SLICE = 4 << 20
GOLDEN = 0x9E3779B97F4A7C15


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > CACHE:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def bags(texts: list[str], hashes: Hashes, words: int = WORDS):
    """Text number, shingle and count of all bags, sorted; a text of fewer words is one shingle."""
    import numpy as np

    parts = [np.fromiter(map(hashes.__getitem__, t.lower().split()), np.uint64) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate([*parts, np.zeros(words, np.uint64)])
    n = int(sizes.sum())
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled = rolled * np.uint64(GOLDEN) + flat[k : k + n]
    doc = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes) <= np.repeat(sizes - words, sizes)
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    whole = []
    for i in short.tolist():
        h = int(sizes[i])
        for w in parts[i].tolist():
            h = (h * GOLDEN + w + 1) & 0xFFFFFFFFFFFFFFFF
        whole.append(h)
    doc = np.concatenate([doc[inside], short])
    shingle = mix(np.concatenate([rolled[inside], np.array(whole, np.uint64)]))
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    return doc[first], shingle[first], np.diff(np.append(first, len(doc)))


def signatures(doc, shingle, count, n: int, size: int = BANDS * ROWS):
    """Signatures of ``n`` bags: at each place a hash of the earliest point. Empty bags have zeros."""
    import numpy as np

    times = np.full(n * size, np.inf)
    points = np.zeros(n * size, np.uint64)
    high = int(count.max()).bit_length() if len(count) else 0
    parts = []
    for level in range(high + 1):
        low = (1 << level - 1) if level else 0
        own = np.flatnonzero(count > low)
        if len(own):
            seed = mix(shingle[own] + np.uint64((level + 1) * GOLDEN & 0xFFFFFFFFFFFFFFFF))
            parts.append((doc[own], seed, np.full(len(own), low), np.full(len(own), max(1, low)), count[own]))
    if not parts:
        return points.reshape(n, size)
    bag, seed, low, rate, held = (np.concatenate(x) for x in zip(*parts))
    time, step = np.zeros(len(bag)), 0
    while len(bag):
        step += 1
        random = mix(seed + np.uint64(step * GOLDEN & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((random >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)) / rate
        point = mix(random + np.uint64(GOLDEN))
        weight = low + 1 + (mix(point + np.uint64(GOLDEN)) % rate.astype(np.uint64)).astype(np.int64)
        place = bag * size + (point % np.uint64(size)).astype(np.int64)
        counts = np.flatnonzero(weight <= held)
        at, when, what = place[counts], time[counts], point[counts]
        np.minimum.at(times, at, when)
        best = when == times[at]
        points[at[best]] = what[best]
        active = np.unique(bag)
        latest = np.zeros(n)
        latest[active] = times.reshape(n, size)[active].max(axis=1)
        go = time < latest[bag]
        bag, seed, low, rate, held, time = bag[go], seed[go], low[go], rate[go], held[go], time[go]
    return points.reshape(n, size)


def _digests(doc, shingle, count, n: int):
    """Two 64-bit digests and the weight of each bag."""
    import numpy as np

    out = []
    for salt in (1, 2):
        total = np.zeros(n, np.uint64)
        np.add.at(total, doc, mix(mix(shingle + np.uint64(salt)) + count.astype(np.uint64) * np.uint64(GOLDEN)))
        out.append(mix(total).view(np.int64))
    return out[0], out[1], np.bincount(doc, count, n).astype(np.int64)


def _sign(bands: int, rows: int, words: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hashes = Hashes()
        names = ["doc_id", "check", "one", "two", "weight", *[f"b{i}" for i in range(bands)]]
        for whole in batches:
            for batch in slices(whole, rows=4000, size=SLICE):
                n = batch.num_rows
                bag = bags(batch.column("text").to_pylist(), hashes, words)
                one, two, weight = _digests(*bag, n)
                signature = signatures(*bag, n, bands * rows)
                columns = [batch.column("doc_id"), batch.column("check"), pa.array(one), pa.array(two), pa.array(weight)]
                for i in range(bands):
                    key = np.full(n, (i + 1) * GOLDEN & 0xFFFFFFFFFFFFFFFF, np.uint64)
                    for k in range(rows):
                        key = mix(key + signature[:, i * rows + k])
                    columns.append(pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _texts_of(shared, words: int):
    """Texts whose bag may be asked for, each bag once per slice."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bits, hashes = shared.value, Hashes()
        for whole in batches:
            for batch in slices(whole, rows=4000, size=SLICE):
                one, two, _ = _digests(*bags(batch.column("text").to_pylist(), hashes, words), batch.num_rows)
                cell = one & (FILTER_BITS - 1)
                keep = np.flatnonzero((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
                _, first = np.unique(np.stack([one[keep], two[keep]]), axis=1, return_index=True) if len(keep) else (None, keep)
                own = pa.array(keep[first])
                yield pa.RecordBatch.from_arrays([pa.array(one).take(own), pa.array(two).take(own), batch.column("text").take(own)], names=["one", "two", "text"])

    return run


def _verify(threshold: float, words: int):
    """Pairs of texts whose bags are similar enough, by their exact overlap. Rows come by hub and share of its
    nodes, the hub's own text (no ``node``) first, so that it is read once for a share."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hashes, own, bag = Hashes(), None, None
        for batch in batches:
            keep = []
            hubs, shares, nodes = (batch.column(c).to_pylist() for c in ("hub", "share", "node"))
            for i, (hub, share, node) in enumerate(zip(hubs, shares, nodes)):
                found = bags([batch.column("text")[i].as_py()], hashes, words)[1:]
                if node is None:
                    own, bag = (hub, share), found
                    continue
                if own != (hub, share):
                    raise ValueError("a share without its hub's text")
                (a, m), (b, n) = bag, found
                _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                both = int(np.minimum(m[x], n[y]).sum())
                if both / (int(m.sum()) + int(n.sum()) - both) >= threshold:
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("hub").take(at), batch.column("node").take(at)], names=["hub", "node"])

    return run


def _with_hub_texts(fitting: DataFrame, found: DataFrame) -> DataFrame:
    """``hub, share, node, text``: the nodes of each hub in shares of about ``SHARE``, each with the hub's text once."""
    sizes = fitting.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    shared = fitting.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / F.lit(SHARE))).alias("share"), "node")
    shared = materialise(shared)
    heads = shared.select("hub", "share").distinct().join(found.select(F.col("node").alias("hub"), "text"), "hub")
    rows = shared.join(found, "node").select("hub", "share", "node", "text")
    rows = rows.unionByName(heads.select("hub", "share", F.lit(None).cast("long").alias("node"), "text"))
    n = part_count(fitting.sparkSession)
    return rows.repartition(n, "hub", "share").sortWithinPartitions("hub", "share", F.asc_nulls_first("node"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """``node, root, place, text`` in the order of place and node as blocks of bounded size: ``block, nodes, roots, texts``.

    A row's block follows from the rows and the bytes before it in the whole order, so that blocks are as few as their
    bounds allow, however many partitions there are.
    """
    order = ["place", "node"]
    sizes = rows.select(*order, F.octet_length("text").cast("long").alias("size"))
    at = running_sums(sizes, [], order, {"row": F.lit(1), "bytes": F.col("size")})
    places = [F.floor((F.col("row") - 1) / BLOCK_ROWS), F.floor((F.col("bytes") - F.col("size")) / BLOCK_BYTES)]
    placed = rows.join(at.select("node", *[p.alias(n) for p, n in zip(places, ("by_row", "by_bytes"))]), "node")
    held = F.collect_list(F.struct("node", "root", "text"))
    grouped = placed.groupBy("by_row", "by_bytes").agg(held.alias("held"))
    return grouped.select(
        F.monotonically_increasing_id().alias("block"),
        *[F.col(f"held.{c}").alias(f"{c}s") for c in ("node", "root", "text")],
    )


def overlaps(one, two):
    """Sums of the smaller counts for all pairs of two sets of bags, as a matrix."""
    import numpy as np

    sides = []
    for doc, shingle, count in (one, two):
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        sides.append((np.repeat(doc, count), mix(np.repeat(shingle, count) + nth.astype(np.uint64) * np.uint64(GOLDEN))))
    common = np.intersect1d(sides[0][1], sides[1][1])
    total = np.zeros((int(one[0].max()) + 1, int(two[0].max()) + 1), np.float32)
    placed = []
    for doc, shingle in sides:
        at = np.minimum(np.searchsorted(common, shingle), max(0, len(common) - 1))
        keep = np.flatnonzero(common[at] == shingle) if len(common) else np.zeros(0, np.int64)
        order = keep[np.argsort(at[keep], kind="stable")]
        placed.append((doc[order], at[order]))
    for low in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - low)
        matrices = []
        for (doc, at), n in zip(placed, total.shape):
            a, b = np.searchsorted(at, [low, low + width])
            m = np.zeros((n, width), np.float32)
            m[doc[a:b], at[a:b] - low] = 1
            matrices.append(m)
        total += matrices[0] @ matrices[1].T
    return total


def _compare(threshold: float, words: int):
    """Links between the texts of two blocks that are not linked yet, by their exact overlaps."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hashes = Hashes()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("nodes", "roots", "texts", "other_nodes", "other_roots", "other_texts")}
                one = bags(row["texts"], hashes, words)
                two = one if row["other_texts"] is None else bags(row["other_texts"], hashes, words)
                both = overlaps(one, two).astype(np.float64)
                m, n = np.bincount(one[0], one[2]), np.bincount(two[0], two[2])
                similar = both / (m[:, None] + n[None, :] - both) >= threshold
                similar &= np.array(row["roots"])[:, None] != np.array(row["other_roots"])[None, :]
                if two is one:
                    similar = np.triu(similar, 1)
                a, b = np.nonzero(similar)
                columns = [pa.array(np.array(row["nodes"], np.int64)[a]), pa.array(np.array(row["other_nodes"], np.int64)[b])]
                yield pa.RecordBatch.from_arrays(columns, names=["hub", "node"])

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Class of each document: documents linked by similar pairs, also through others.

    Words are what stands between white space, in small letters; a text of fewer than ``words`` words
    is one shingle; texts without words, null ones too, are classes of their own. Similarity is the
    sum of the smaller counts over the sum of the larger ones. The class id is the smallest id in the
    class, and that document is kept (of several rows with that id, one). Equal bags are one node. In each
    bucket of a band, its hub, the node in most and largest buckets, is compared with all others. Nodes
    of buckets that this leaves unlinked are dealt into blocks, and blocks that share such a bucket are
    compared all with all inside a task, which returns links only; so every pair that shares a bucket
    is compared or linked already, and no table of pairs is made. Returns doc_id, check
    (xxhash64 of the text), class_id, class_size and kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    texts = texts.withColumn("check", F.xxhash64("text"))
    names = [f"b{i}" for i in range(bands)]
    signed = texts.mapInArrow(_sign(bands, rows, words), "doc_id long, check long, one long, two long, weight long, " + ", ".join(f"{b} long" for b in names))
    signed = materialise(signed.withColumn("tag", F.monotonically_increasing_id()))
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    filled = signed.where("weight > 0").groupBy("one", "two").agg(
        F.min("doc_id").alias("first_id"), F.min_by("tag", last).alias("first_tag"), F.count(F.lit(1)).alias("copies"), F.max("weight").alias("weight"), *[F.max(b).alias(b) for b in names]
    )
    nodes = materialise(filled.withColumn("node", F.monotonically_increasing_id()))

    banded = nodes.select("node", "weight", F.explode(F.array(*names)).alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(banded.join(sizes, "bucket"))
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    members = materialise(members.join(degree, "node").select("bucket", "node", "weight", "degree"))
    asked = members.select("node").distinct().join(nodes, "node").select("node", "one", "two")
    asked = materialise(asked)
    shared = spark.sparkContext.broadcast(fixed_filter(asked.select(F.col("one").alias("print"))))
    found = texts.select("text").mapInArrow(_texts_of(shared, words), "one long, two long, text string").join(asked, ["one", "two"])
    found = materialise(found.select("node", "text"))  # a node may stand here more than once
    found = materialise(found.groupBy("node").agg(F.first("text").alias("text")))

    # every node with the hub of each of its buckets
    hubs = _hubs(members)
    pairs = members.join(hubs, "bucket").where(F.col("node") != F.col("hub"))
    fits = F.least("weight", "hub_weight") >= F.lit(threshold) * F.greatest("weight", "hub_weight")
    fitting = pairs.where(fits).select("hub", "node").distinct()
    with_text = _with_hub_texts(fitting, found)
    links = materialise(with_text.mapInArrow(_verify(threshold, words), "hub long, node long"))
    roots = materialise(components(links))
    # what is left: buckets whose nodes are not linked yet, in blocks of nodes that such buckets connect
    rooted = members.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialise(rooted)
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("bucket")
    rooted = materialise(rooted.join(open_, "bucket"))
    if not rooted.isEmpty():
        least = rooted.groupBy("bucket").agg(F.min("node").alias("least"))
        near_by = materialise(components(rooted.join(least, "bucket").select("node", "least").where("node != least")))
        asked = rooted.select("node", "root").distinct().join(near_by.withColumnRenamed("root", "place"), "node", "left")
        asked = asked.withColumn("place", F.coalesce("place", "node")).join(found, "node")
        blocks = materialise(blocks_of(materialise(asked.select("node", "root", "place", "text"))))
        of_node = blocks.select("block", F.explode("nodes").alias("node"))
        of_bucket = materialise(rooted.select("bucket", "node").join(of_node, "node").select("bucket", "block").distinct())
        meeting = of_bucket.join(of_bucket.select("bucket", F.col("block").alias("other")), "bucket").where("block <= other")
        meeting = meeting.select("block", "other").distinct()
        other = blocks.select(F.col("block").alias("other"), F.col("nodes").alias("other_nodes"), F.col("roots").alias("other_roots"), F.col("texts").alias("other_texts"))
        # a block met with itself is not sent twice
        compared = meeting.join(blocks, "block").join(other, "other").withColumn("other_texts", F.when(F.col("block") != F.col("other"), F.col("other_texts")))
        more = compared.mapInArrow(_compare(threshold, words), "hub long, node long")
        roots = materialise(components(links.unionByName(more)))

    by_class = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_class = materialise(by_class.select("one", "two", "root", "first_id", "first_tag", "copies"))
    first = F.coalesce("first_id", F.lit((1 << 63) - 1))
    classes = by_class.groupBy("root").agg(F.min("first_id").alias("class_id"), F.min_by("first_tag", first).alias("keep_tag"), F.sum("copies").alias("class_size"))
    of_bag = by_class.select("one", "two", "root").join(classes, "root")
    grouped = signed.where("weight > 0").select("doc_id", "check", "tag", "one", "two").join(of_bag, ["one", "two"])
    grouped = grouped.select("doc_id", "check", "class_id", "class_size", (F.col("tag") == F.col("keep_tag")).alias("kept"))
    alone = signed.where("weight = 0").select("doc_id", "check", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone)


def _hubs(members: DataFrame) -> DataFrame:
    """Of each bucket the node that is in most and largest buckets, of these the first."""
    top = members.groupBy("bucket").agg(F.max("degree").alias("degree"))
    first = members.join(top, ["bucket", "degree"]).groupBy("bucket").agg(F.min("node").alias("hub"), F.min_by("weight", "node").alias("hub_weight"))
    return materialise(first)


def drop_near(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id; columns unchanged. Of repeated rows
    with one id and text, one stays."""
    kept = near_groups(docs).where("kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), "check").distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).alias("id"),
        F.xxhash64(text_of("text")).alias("check"),
    )
    first = Window.partitionBy("id", "check").orderBy("id", "check")  # as the join left them: no further shuffle
    joined = rows.join(kept, ["id", "check"]).withColumn("n", F.row_number().over(first)).where("n = 1")
    return joined.select("row.*")
