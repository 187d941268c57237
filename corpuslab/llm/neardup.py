"""Near-duplicates by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.graph import components

from .common import _arrow, _fields, among, checkpoint, map_rows, mix, ship, shingle_hashes, slices, tidy, without

#: Probabilities that a pair at the threshold shares no band, and that it agrees in too few coordinates to be verified across components.
BAND_LOSS, AGREEING_LOSS = 3e-7, 1.7e-6
#: Most coordinates a band, and the bands up to which they are taken.
MAX_ROWS, MAX_BANDS = 5, 32
#: Groups of equal sets beyond this share of the rows are joined by broadcast; there can't be more of them.
HEAVY_SHARE = 1000
#: Pairs of one hub that a join task may meet, and rows of a bucket that are compared with one another at once.
PAIRS_A_SALT, ROWS_A_CELL = 512, 512
#: Coordinates, of a byte each, in a word of a packed sketch.
_LANES = 8


@cache
def banding(percent: int) -> tuple[int, int, int]:
    """Bands, coordinates a band, and the coordinates in which a pair has to agree, for a threshold of ``percent`` hundredths."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be from 1 to 100: {percent}")
    p = percent / 100
    bands = lambda rows: 1 if p == 1 else math.ceil(math.log(BAND_LOSS) / math.log1p(-(p**rows)))
    rows = next((r for r in range(MAX_ROWS, 1, -1) if bands(r) <= MAX_BANDS), 1)
    n, least, below = bands(rows) * rows, 0, 0.0
    while least < n and (below := below + math.comb(n, least) * p**least * (1 - p) ** (n - least)) <= AGREEING_LOSS:
        least += 1
    return bands(rows), rows, least


#: The bands and coordinates of the default threshold.
BANDS, ROWS, LEAST_AGREEING = banding(85)


def _seeds(n: int, start: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def sketch(items: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """A fast similarity sketch of a set of 64-bit hashes.

    Round ``i < size`` throws every element into a bin by hash, with a value in
    ``[i, i + 1)``; round ``size + i`` throws all into bin ``i``.  A bin keeps
    its least value, and rounds end when none is empty, which the second half
    guarantees.  Coordinates of two sets agree with probability their Jaccard
    similarity, and concentrate like independent ones.
    """
    out, seeds = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF)), _seeds(2 * size, 1)
    low, empty = np.uint64((1 << 48) - 1), np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(2 * size):
        h = mix(items ^ seeds[i])
        value = (h & low) | (np.uint64(i) << np.uint64(48))
        if i < size:
            np.minimum.at(out, (((h >> np.uint64(48)) * np.uint64(size)) >> np.uint64(16)).astype(np.int64), value)
        else:
            out[i - size] = min(out[i - size], value.min())
        if out.max() != empty:
            break
    return out


def band_keys(coords: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of a sketch."""
    coords, keys = coords.reshape(bands, -1), _seeds(bands, 1 << 20)
    with np.errstate(over="ignore"):
        for r in range(coords.shape[1]):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + coords[:, r])
    return keys


def _fingerprint(items: np.ndarray) -> tuple[int, int]:
    a, b = _seeds(2, 1 << 30)
    with np.errstate(over="ignore"):
        return tuple(int(mix(items ^ s).sum(dtype=np.uint64).view(np.int64)) for s in (a, b))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int = 85) -> DataFrame:
    """``doc_id, h, n_shingles, fa, fb, bands``: a hash of id and text, and size, 128-bit fingerprint and band keys of the shingle set of each row."""
    bands, rows, _ = banding(percent)

    def run(columns: list) -> list:
        sets = [shingle_hashes(t, width) for t in columns[2]]
        prints = [_fingerprint(s) for s in sets]
        keys = [band_keys(sketch(s, bands * rows), bands).view(np.int64).tolist() if len(s) else [] for s in sets]
        return [columns[0], columns[1], [len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints], keys]

    kind = dict(docs.dtypes)[id_col]
    read = docs.select(id_col, F.xxhash64(id_col, text_col), F.col(text_col).cast("binary"))
    return map_rows(read, run, f"doc_id {kind}, h long, n_shingles long, fa long, fb long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``node, shingles`` of the wanted classes, read again from the texts of their representatives."""
    kind = dict(wanted.dtypes)["node"]

    def run(columns: list) -> list:
        sets = [(i, s) for i, text, a, b in zip(*columns) if _fingerprint(s := shingle_hashes(text, width)) == (a, b)]
        return [[i for i, _ in sets], [s.view(np.int64) for _, s in sets]]

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = among(texts, F.col("doc_id"), wanted.select(F.col("rep").alias("_id"), "node", "fa", "fb"))
    return map_rows(rows.select("node", "row.text", "fa", "fb"), run, f"node {kind}, shingles array<long>").dropDuplicates(["node"])


def _packed_sketches(sets: DataFrame, percent: int) -> DataFrame:
    """``node, w0, w1, ...``: a byte of each coordinate of the sketch, in 64-bit words."""
    bands, rows, _ = banding(percent)
    words = -(-bands * rows // _LANES)
    schema = f"node {dict(sets.dtypes)['node']}, " + ", ".join(f"w{i} long" for i in range(words))
    ship(sets.sparkSession)
    names, kinds = [f.name for f in _fields(schema)], _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                lists, out = batch.column("shingles"), np.zeros((batch.num_rows, words * _LANES), np.uint8)
                flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
                for i in range(batch.num_rows):
                    out[i, : bands * rows] = sketch(flat[ends[i] : ends[i + 1]], bands * rows).astype(np.uint8)
                packed = out.view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("node"), *[pa.array(np.ascontiguousarray(packed[:, k]), t) for k, t in enumerate(kinds[1:])]], names)

    return sets.select("node", "shingles").mapInArrow(run, schema)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``node, n, key, band``: of each set its rarest shingles, as many that two linked sets must share one.

    The order by frequency, then value, is the same in all sets; sets of ``n``
    and a similarity of ``p`` share at least ``ceil(p n)`` elements, so the first
    ``n - ceil(p n) + 1`` of both can't be disjoint.
    """
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    rated = each.join(each.groupBy("s").agg(F.count("*").alias("f")), "s")
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100).cast("int") + 1
    first = rated.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("x")).select("node", "n", F.slice("x", F.lit(1), keep).alias("x"))
    return first.select("node", F.col("n").cast("long").alias("n"), F.explode("x.s").alias("key"), F.lit(0).alias("band"))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(hub, node)`` whose full sets reach the similarity.

    A hub with many partners is split into salts, each with a copy of its set.
    """
    per_hub = pairs.groupBy("hub").count().withColumn("salts", F.ceil(F.col("count") / PAIRS_A_SALT).cast("int")).drop("count")
    own = pairs.join(per_hub, "hub").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).drop("salts")
    left = own.join(sets.withColumnRenamed("shingles", "a"), "node")
    hubs = per_hub.join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("b")), "hub").select("hub", "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    # 100 * inter >= p * (a + b - inter), with the intersection named once
    enough = (100 + percent) * F.size(F.array_intersect("a", "b")) >= percent * (F.size("a") + F.size("b"))
    return left.join(hubs, ["hub", "salt"]).filter(enough).select("hub", "node")


def _with_root(df: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    return df.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))


def _could_link(a: Column, b: Column, na: Column, nb: Column, percent: int) -> Column:
    """Whether sets of ``na`` and ``nb`` elements, of which at most the lesser of ``a`` and ``b`` are common, may reach the similarity."""
    return (100 + percent) * F.least(a, b) >= percent * (na + nb)


def _mixed(live: DataFrame) -> DataFrame:
    """The keys of buckets whose members lie in several components."""
    return live.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")


def _across(members: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Pairs of different components that share a bucket and may still be linked.

    A shingle that occurs in one component only can't be shared with another.
    Without those, most members are too small for any partner; the few that
    are left meet inside their buckets, under the same bound.  A crowded bucket
    is cut into blocks of its members, and a task compares two blocks at a
    time.  Unless ``exact``, sketches have to agree well enough, and a pair
    only comes out of the first bucket that it shares.
    """
    live = _with_root(members, roots, "node")
    live = checkpoint(live.join(_mixed(live), "key"))
    nodes = live.select("node", "n", "root").distinct()
    marks = nodes.join(sets, "node").select("node", "root", F.explode("shingles").alias("s"))
    single = marks.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"), F.min("node").alias("one")).filter("lo = hi")
    alone = single.filter("c = 1").groupBy(F.col("one").alias("node")).agg(F.count("*").alias("own"))
    shared = marks.join(single.filter("c > 1").select("s"), "s").groupBy("node").agg(F.count("*").alias("own"))
    own = alone.unionByName(shared).groupBy("node").agg(F.sum("own").alias("own"))
    free = nodes.join(own, "node", "left").select("node", (F.col("n") - F.coalesce("own", F.lit(0))).alias("t"))
    live = checkpoint(live.join(free.filter("t > 0"), "node").filter(100 * F.col("t") >= percent * F.col("n")))
    live = checkpoint(live.join(_mixed(live), "key"))
    if live.isEmpty():
        return live.select(F.col("node").alias("hub"), "node")
    blocks = live.groupBy("key").agg(F.ceil(F.count("*") / ROWS_A_CELL).cast("int").alias("blocks"))
    words: list[str] = []
    a = live.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    if not exact:
        sketches = checkpoint(_packed_sketches(live.select("node").distinct().join(sets, "node"), percent))
        words = sketches.columns[1:]
        a = a.join(sketches, "node")
    # a cell holds two blocks; a row goes to all cells of its own one
    a = a.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a = a.select("key", F.least("block", "x").alias("c1"), F.greatest("block", "x").alias("c2"), "block", "band", "node", "n", "t", "root", *words)
    left, right = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    pairs = (left("node") < right("node")) & (left("root") != right("root")) & ((left("c1") == left("c2")) | (left("block") != right("block")))
    pairs &= _could_link(left("t"), right("t"), left("n"), right("n"), percent)
    if not exact:
        pairs &= _agreeing(words, left, right, percent)
    for c in ("key", "c1", "c2"):
        pairs &= left(c) == right(c)
    return a.alias("a").join(a.alias("b"), pairs).select(left("node").alias("hub"), right("node").alias("node")).distinct()


def _agreeing(words: list[str], left: Callable[[str], Column], right: Callable[[str], Column], percent: int) -> Column:
    """Whether the sketches agree in enough coordinates, and the bucket's band is the first that they share."""
    bands, rows, least = banding(percent)
    unlike = {w: left(w).bitwiseXOR(right(w)) for w in words}
    differ = F.lit(0)
    for x in unlike.values():
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    enough = differ <= bands * rows - least
    if 8 * rows < 32:  # too few bits to tell a band's agreement; a pair may come out of several buckets
        return enough
    first = left("band")
    for k in reversed(range(bands)):
        masks: dict[int, int] = {}
        for c in range(k * rows, (k + 1) * rows):
            masks[c // _LANES] = masks.get(c // _LANES, 0) | 255 << 8 * (c % _LANES)
        same = F.lit(True)
        for i, m in masks.items():
            same &= unlike[words[i]].bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) == 0
        first = F.when(same, F.lit(k)).otherwise(first)
    return enough & (first == left("band"))


def _nodes(classes: DataFrame) -> tuple[DataFrame, bool]:
    """``classes`` with ``node``, a key of its own for each, and whether that is the least id of all of them; ids that repeat with unlike texts are told apart."""
    classes = checkpoint(classes)
    kind = dict(classes.dtypes)["rep"]
    repeated = checkpoint(classes.groupBy("rep").count().filter("count > 1").select("rep"))
    if repeated.isEmpty():
        return classes.withColumn("node", F.col("rep")), True
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    prints = F.xxhash64("rep", "fa", "fb") if whole else F.concat_ws("|", F.col("rep").cast("string"), F.hex("fa"), F.hex("fb"))
    marked = classes.join(repeated.withColumn("_again", F.lit(True)), "rep", "left")
    return checkpoint(marked.withColumn("node", F.when(F.col("_again"), prints).otherwise(F.col("rep").cast("bigint" if whole else "string"))).drop("_again")), False


def near_duplicates(docs: DataFrame, *, percent: int = 85, width: int = 5, exact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row.

    Documents are linked whose word shingle sets have a Jaccard similarity of
    ``percent`` hundredths or more; components are the linked documents'
    closure.  Words are what stands between ASCII white space, A-Z lower-cased.
    A text of fewer than ``width`` words is one shingle; null, empty and blank
    texts have none and are linked with nothing, as are rows with a null id
    (whose component is null and which are kept).  Rows that repeat an id with
    the same text share its component; with different texts they are documents
    of their own, each in the component of its text.  Texts of any length count
    whole; other columns, whatever their names, play no part; an empty table gives no rows.

    1. One pass over the texts gives size, fingerprint and band keys.
    2. Equal sets become one class with its least id, by a partial aggregate.
    3. Classes that share a band key are candidates; each is verified against
       the hub of its buckets, the member that shares most buckets with others.
    4. Star components; then all remaining pairs across components that the
       shingles allow (see ``_across``), verified on full sets like the hubs'.
    5. Components again, with both kinds of links.

    Inside a component nothing is left to verify, so a group of copies costs a
    pass over it for each of its hubs, not all its pairs.

    Banding and the sketch test lose a link with the probabilities
    ``BAND_LOSS`` and ``AGREEING_LOSS`` at most.  ``exact`` loses none: the
    candidates then share one of their rarest shingles, as every linked pair
    must, and the sketches aren't asked; it reads and sorts all sets.
    """
    return _placed(docs, percent, width, exact, id_col, text_col).drop("h")


def _placed(docs: DataFrame, percent: int = 85, width: int = 5, exact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_duplicates`` with the hash ``h`` of each row's id and text."""
    sig = checkpoint(signatures(docs, id_col, text_col, width, percent))
    usable = sig.filter("n_shingles > 0 and doc_id is not null")
    classes, plain = _nodes(usable.groupBy("fa", "fb", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("bands").alias("bands")))
    if exact:
        sets = checkpoint(_sets(docs, classes.select("rep", "node", "fa", "fb"), id_col, text_col, width))
        buckets = checkpoint(_prefixes(sets, percent))
    else:
        buckets = classes.select("node", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    crowded = buckets.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    members = checkpoint(buckets.join(crowded, "key"))
    if not exact:
        wanted = members.select("node").distinct().join(classes.select("rep", "node", "fa", "fb"), "node")
        sets = checkpoint(_sets(docs, wanted, id_col, text_col, width))
    ranked = members.join(members.groupBy("node").agg(F.sum("c").alias("w")), "node")
    hubs = ranked.groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("node").alias("hub"), F.col("n").alias("hub_n"))).alias("h")).select("key", "h.hub", "h.hub_n")
    star = members.join(hubs, "key").filter((F.col("node") != F.col("hub")) & _could_link(F.col("n"), F.col("hub_n"), F.col("n"), F.col("hub_n"), percent)).select("hub", "node").distinct()
    links = checkpoint(verify(star, sets, percent)).select(F.col("hub").alias("u"), F.col("node").alias("v"))
    roots = checkpoint(components(links))
    tidy(docs.sparkSession)
    more = checkpoint(verify(checkpoint(_across(members.drop("c"), sets, roots, percent, exact)), sets, percent)).select(F.col("hub").alias("u"), F.col("node").alias("v"))
    tidy(docs.sparkSession)
    if not more.isEmpty():
        roots = checkpoint(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)))
    named = _with_root(classes.drop("bands"), roots, "node")
    # a component's name is its least id
    named = named.withColumn("name", F.col("root")) if plain else named.join(named.groupBy("root").agg(F.min("rep").alias("name")), "root")
    named = checkpoint(named.select("fa", "fb", "n_shingles", "members", "name"))
    least = max(1, sig.count() // HEAVY_SHARE)
    heavy = F.broadcast(named.filter(F.col("members") > least).select("fa", "fb", "n_shingles", "name"))
    on = ["fa", "fb", "n_shingles"]
    usable = usable.drop("bands")
    placed = usable.join(heavy, on).unionByName(usable.join(heavy, on, "left_anti").join(named.filter(F.col("members") <= least).select(*on, "name"), on))
    rest = sig.filter("n_shingles = 0 or doc_id is null").drop("bands").withColumn("name", F.col("doc_id"))
    every = placed.unionByName(rest)
    return every.select("doc_id", "n_shingles", F.col("name").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("name")).alias("kept"), "h")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component, that of the least id; columns as they came.

    Rows with a null id stay, and so do rows that repeat the kept id and text.
    Of an id that repeats with unlike texts each row goes or stays by its own text.
    """
    key = F.struct(F.col(options.get("id_col", "doc_id")).alias("id"), F.xxhash64(options.get("id_col", "doc_id"), options.get("text_col", "text")).alias("h"))
    gone = _placed(docs, **options).filter("not kept").select(F.struct(F.col("doc_id").alias("id"), "h"))
    return without(docs, key, gone)
