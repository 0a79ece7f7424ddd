"""Op 6: near-duplicate documents by DartMinHash signatures and banded joining.

Elements are the runs of five words of a text, weighted by how often they occur; similarity is
weighted Jaccard (sum of minima over sum of maxima).  DartMinHash: every element has darts thrown at
the plane of weight by rank, as a Poisson process that a hash of the element decides.  The
plane of an element is cut into regions; the darts in
a region are drawn from the region's own hash, so equal elements have equal darts.  A document takes
the darts below its weights; each dart belongs to one of ``COORDINATES`` coordinates, which keeps its
earliest (lowest in rank).  Regions: up to a weight of ``UNITS`` layers are one high, above each is as high as all below it;
strips of rank start at half the inverse of their layer's height, and double.  Strips are opened in ascending order until no
coordinate can change.  That takes about k ln k darts (k coordinates), or half as many as there are elements
where that is more, however heavy single elements are.  Two documents agree on a coordinate with their
similarity as probability.

Joining: ``BANDS`` hashes of ``ROWS`` coordinates each.  Equal texts are first made one; texts are numbered by their hashes, not by their documents.
In each bucket of a band every member is tied to the smallest one.  Ties are tested one by one by their shingles: first one of each
text, then those whose ends are not yet connected.  What holds is put together to components.  In a bucket whose members are in several
components (and that has more than two, as pairs are tested by then), those outside of the smallest one's component meet all others, in blocks of
``BLOCK_DOCS`` documents and ``BLOCK_ELEMENTS`` elements, so that a link between any two that share a band is found: pairs of one component are passed over, as are
pairs whose sizes rule it out, and, in a block with very many pairs, those that agree on less than ``SURELY_APART`` of all coordinates.  No bucket or pair is capped, and what is compared
follows the buckets, not the components.

Two texts of similarity 0.8 share a band with probability 0.997, of 0.85 with 0.99998; they agree on less than 0.6 of 256 coordinates with a
probability of 1.3e-9 at most (Hoeffding).

Defined results: a text with fewer than five words (but one) is one element of all its words; a text without words, and a
null one, is alone in its class; a null doc_id has a null class; rows that share doc_id and text are
one document, rows that share a doc_id only are apart by text; the class is
the smallest doc_id of the group that no unlike text shares (the smallest, if there is none); other columns pass through ``one_of_each``
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

WORDS = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 8
COORDINATES = BANDS * ROWS
BLOCK_DOCS = 1500
BLOCK_ELEMENTS = 4_000_000
SURELY_APART = 0.6
PAIRS_A_TEXT = 32
UNITS = 8
TOGETHER = 1 << 14  # elements that darts are thrown at together, or one text's
SALTS = 8
SIGNED_BYTES = 1 << 18  # bytes of texts that are signed together
_WORD = re.compile(r"\w+")
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Elements and weights of texts."""

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct element hashes, weights)."""
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(sorted distinct element hashes, weights) of each text; words and runs of all texts are hashed together."""
        from xxhash import xxh3_64_intdigest

        words, lengths = [], []
        for text in texts:
            found = _WORD.findall(text.lower()) if text else []
            words += found
            lengths.append(len(found))
        told = pa.array(words, pa.large_string()).dictionary_encode()
        h = np.fromiter(map(xxh3_64_intdigest, told.dictionary.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(told.dictionary))[told.indices.to_numpy()]
        runs = _runs(h, WORDS)  # those that reach into the next text are left out below
        out, at = [], 0
        for n in lengths:
            own = runs[at : at + n - WORDS + 1] if n >= WORDS else _runs(h[at : at + n], n)[:1]
            out.append(_weighed(own) if n else (h[:0], np.zeros(0, dtype=np.int64)))
            at += n
        return out


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` of ``h``; the last ones, which are shorter, are of no use."""
    runs = np.full(len(h), size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            top = runs[: len(h) - k]
            top[:] = mixed(top * _U(0x9E3779B97F4A7C15) + h[k:])
    return runs


def _weighed(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``runs`` (one at least), and how often each occurs."""
    runs = np.sort(runs)
    first = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
    return runs[first], np.diff(first, append=len(runs))


def _poisson_steps(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... events, as limits of 53-bit numbers."""
    term, total, out, k = np.exp(-area), 0.0, [], 0
    while total < 1 - 1e-15 and k < 20 + 4 * area + 60:
        total += term
        out.append(total)
        k += 1
        term *= area / k
    return (np.array(out) * (1 << 53)).astype(np.uint64)


_STEPS: dict[float, np.ndarray] = {}
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def _throw(layer: tuple, strip: int, low: float, height: float, best: np.ndarray, k: int, at_row: np.ndarray | None = None) -> int:
    """Throw the darts of one strip of rank of a layer; each coordinate of ``best`` keeps its earliest.

    ``at_row``: where in ``best`` the coordinates of each element begin, if it holds those of several sets.
    """
    base, room, high = layer
    # a strip is cut into cells of area 1 at most, all thrown at together
    cells = max(1, int(high * height))
    area = high * height / cells
    if area not in _STEPS:
        _STEPS[area] = _poisson_steps(area)
    numbers = np.arange(cells, dtype=np.uint64) + _U(strip << 32)
    seed = mixed((base ^ (numbers * _U(0x9E3779B97F4A7C15))[:, None]).ravel())
    darts = np.searchsorted(_STEPS[area], seed >> _U(11), side="right")
    at = np.repeat(np.arange(len(seed)), darts)
    no = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
    name = mixed(seed[at] + (no.astype(np.uint64) + _U(1)) * _U(0xA0761D6478BD642F))
    place = mixed(name + _U(0x8EBC6AF09C88C6E3))
    thrown = len(at)
    if room is not None:
        inside = (place >> _U(40)).astype(np.float64) * (high / (1 << 24)) < room[at % len(base)]
        at, name, place = at[inside], name[inside], place[inside]
    slot = ((place & _U(0xFFF)) * _U(k) >> _U(12)).astype(np.int64)
    if at_row is not None:
        slot += at_row[at % len(base)]
    fresh = np.flatnonzero(best[slot] >= _order(low))
    at, name, place, slot = at[fresh], name[fresh], place[fresh], slot[fresh]
    rank = low + ((at // len(base)) + ((place >> _U(12)) & _U(0xFFFFF)).astype(np.float64) / (1 << 20)) * (height / cells)
    # in order of rank; equal ranks go by name
    np.minimum.at(best, slot, rank.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32) | name >> _U(32))
    return thrown


def _order(rank: float) -> np.uint64:
    return _U(int(np.float32(rank).view(np.uint32)) << 32)


def signature(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES, thrown: list | None = None) -> np.ndarray:
    """The earliest dart of each coordinate, as 32-bit names; weights may be whole or not.  ``thrown`` gets the number of darts."""
    top = float(weights.max())
    if top <= 1 and weights.dtype.kind != "f":
        layers = [(mixed(elements), None, 1.0)]
    else:
        whole = np.ceil(np.minimum(weights, UNITS)).astype(np.int64)
        owner = np.repeat(np.arange(len(elements)), whole)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
        room = weights[owner] - number if weights.dtype.kind == "f" else None  # the part of a layer below the weight
        layers = [(mixed(elements[owner] + number.astype(np.uint64) * _U(0xD1342543DE82EF95)), room, 1.0)]
        high = UNITS
        while high < top:
            some = np.flatnonzero(weights > high)
            layers.append((mixed(elements[some] + _U(high * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)), weights[some] - high, float(high)))
            high *= 2
    best = np.full(k, _EMPTY, dtype=np.uint64)
    bound = 0.5
    if len(layers) > 1:  # heavy elements fill the coordinates at low ranks
        wanted = k * np.log(k + 1) / float(weights.sum())
        while bound > wanted and bound > 1 / (2 * layers[-1][2]):
            bound /= 2
    tops, strips, n = [0.0] * len(layers), [0] * len(layers), 0
    while True:
        for i, layer in enumerate(layers):
            while tops[i] < bound:
                height = tops[i] or 1 / (2 * layer[2])
                n += _throw(layer, strips[i], tops[i], height, best, k)
                tops[i], strips[i] = tops[i] + height, strips[i] + 1
        if best.max() < _order(bound):
            if thrown is not None:
                thrown.append(n)
            return best.astype(np.uint32)
        bound *= 2


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES) -> np.ndarray:
    """``signature`` of each of ``sets`` (none of them empty, whole weights), a row each; the darts of many sets are thrown together."""
    out = np.empty((len(sets), k), dtype=np.uint32)
    together, held = [], 0
    for i, (elements, weights) in enumerate(sets):
        whole = int(weights.sum())
        if len(elements) > TOGETHER or whole > max(16 * k, 2 * len(elements)):  # heavy elements begin at lower ranks
            out[i] = signature(elements, weights, k)
            continue
        together.append(i)
        held += max(k, whole)
        if held >= TOGETHER:
            out[together] = _signatures([sets[j] for j in together], k)
            together, held = [], 0
    if together:
        out[together] = _signatures([sets[j] for j in together], k)
    return out


def _signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Signatures of ``sets``: the strips of a layer are the same for all, so each is thrown at the elements of those that still need it."""
    elements, weights = (np.concatenate([x[i] for x in sets]) for i in (0, 1))
    doc = np.repeat(np.arange(len(sets)), [len(x[0]) for x in sets])
    whole = np.minimum(weights, UNITS)
    owner = np.repeat(np.arange(len(elements)), whole)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
    layers = [(mixed(elements[owner] + number.astype(np.uint64) * _U(0xD1342543DE82EF95)), None, 1.0, doc[owner])]
    high, top = UNITS, int(weights.max())
    while high < top:
        some = np.flatnonzero(weights > high)
        layers.append((mixed(elements[some] + _U(high * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)), weights[some] - high, float(high), doc[some]))
        high *= 2
    best = np.full((len(sets), k), _EMPTY, dtype=np.uint64)
    bound, tops, strips = 0.5, [0.0] * len(layers), [0] * len(layers)
    while True:
        for i, (*layer, of) in enumerate(layers):
            while tops[i] < bound:
                height = tops[i] or 1 / (2 * layer[2])
                if len(of):
                    _throw(tuple(layer), strips[i], tops[i], height, best.reshape(-1), k, of * k)
                tops[i], strips[i] = tops[i] + height, strips[i] + 1
        still = best.max(axis=1) >= _order(bound)
        if not still.any():
            return best.astype(np.uint32)
        if not still.all():
            layers = [(base[at], room if room is None else room[at], high, of[at]) for base, room, high, of in layers for at in (still[of],)]
        bound *= 2


def bands_of(names: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band of a signature, or of each of several (a row each)."""
    rows = names.reshape(*names.shape[:-1], BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            h = mixed(h * _U(0x9E3779B97F4A7C15) + rows[..., k])
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted elements, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    least = int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())
    return least / (int(a[1].sum()) + int(b[1].sum()) - least)


class Components:
    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)


def linked(sides: list[int], groups: list[int], sets: list, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links that connect what all links >= ``threshold`` connect, but for what ``groups`` (a number for each document) connects already.

    ``sides`` tells each document's block: with two blocks, only pairs across them are compared.
    """
    n = len(sets)
    side, group, size = np.array(sides), np.array(groups), np.array([int(x[1].sum()) for x in sets])
    across, left, right = len(set(sides)) > 1, [], []
    for i in range(n - 1):
        rest = slice(i + 1, n)
        ok = (group[rest] != group[i]) & (np.minimum(size[rest], size[i]) >= threshold * np.maximum(size[rest], size[i]))
        at = np.flatnonzero(ok & (side[rest] != side[i]) if across else ok)
        left.append(np.full(len(at), i, dtype=np.int32))
        right.append((at + i + 1).astype(np.int32))
    left, right = np.concatenate([*left, np.zeros(0, np.int32)]), np.concatenate([*right, np.zeros(0, np.int32)])
    if len(left) > PAIRS_A_TEXT * n:  # where pairs are many, signatures cost less than they save
        names, some = np.tile(np.arange(COORDINATES, dtype=np.uint32), (n, 1)), np.flatnonzero(size)
        names[some] = signatures([sets[i] for i in some.tolist()])
        near = np.concatenate([np.count_nonzero(names[left[k : k + 4096]] == names[right[k : k + 4096]], axis=1) for k in range(0, len(left), 4096)]) / COORDINATES
        order = np.argsort(-near, kind="stable")
        order = order[near[order] >= SURELY_APART]
    else:
        order = np.arange(len(left))
    out: list[tuple[int, int]] = []
    known = Components(n)
    first: dict[int, int] = {}
    for i, g in enumerate(groups):
        known.join(first.setdefault(g, i), i)
    while len(order):
        for x in order[:2048].tolist():
            i, j = int(left[x]), int(right[x])
            if known.find(i) != known.find(j) and similarity(sets[i], sets[j]) >= threshold:
                known.join(i, j)
                out.append((i, j))
        order = order[2048:]
        if len(order):
            roots = np.array([known.find(i) for i in range(n)])
            order = order[roots[left[order]] != roots[right[order]]]
    return out


SIGNED = "doc_id long, h1 long, h2 long, bands array<long>, size long"


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, bands, size): two hashes of the text, the bands of its signature (null without words), and the number of its elements."""

    def sign(batches):
        shingle = Shingler()
        for batch in batches:
            bands, sizes = [], []
            for _, texts in tokens.slices(batch, SIGNED_BYTES):
                sets = shingle.many(texts.to_pylist())
                some = [i for i, x in enumerate(sets) if len(x[0])]
                found: list = [None] * len(sets)
                for i, row in zip(some, bands_of(signatures([sets[i] for i in some]))):
                    found[i] = row
                bands += found
                sizes += [len(x[0]) for x in sets]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["doc_id", "h1", "h2", "bands", "size"])
            common.tidy()

    return common.spread(keyed(docs)).mapInArrow(sign, SIGNED)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(6), text).alias("h2"), text.alias("text"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b); root is the smallest node it is connected with.

    Alternating large-star and small-star steps until nothing changes (labels only fall, so that ends); minima over a node's edges are
    partial before the shuffle, and a node with very many edges is split where they meet its minimum.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame, large: bool, few: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")).toDF("u", "v") if large else pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        if few:
            joined = both.join(F.broadcast(least.withColumnRenamed("u", "u_")), F.col("u") == F.col("u_"))
        else:
            salted = least.select(F.col("u").alias("u_"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s_"))
            joined = both.join(salted, (F.col("u") == F.col("u_")) & (F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int") == F.col("s_")))
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    edges, last = common.stored(edges.filter("a <> b").distinct(), label), None
    state = lambda: edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = state()
    while now != last and now[0]:
        last, old, few = now, edges, now[0] <= 100_000
        edges = common.stored(star(star(edges, True, few), False, few), label)
        now = state()
        common.drop_stored(old)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


LINKS = "a long, b long"


def tested(ties: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of ``ties`` (a, b) whose texts (node, text) are alike.  A ``b`` with many ties is in several tasks; each text is held once at a time."""
    degree = ties.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("parts"))
    dealt = common.spread_join(ties, degree, ["b"], ["a"], salts=SALTS).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).select("a", "b", "part")
    heads = dealt.select("b", "part").distinct().select("b", "part", F.col("b").alias("node"))
    wanted = heads.withColumn("late", F.lit(0)).union(dealt.select("b", "part", F.col("a").alias("node"), F.lit(1)))
    grouped = wanted.join(texts, "node").select("b", "part", "late", "node", "text").repartition("b", "part").sortWithinPartitions("b", "part", "late")

    def within(batches):
        shingle, head, own = Shingler(), None, None
        for batch in batches:
            out = []
            b, late, node = (batch.column(c).to_pylist() for c in ("b", "late", "node"))
            for i, text in enumerate(batch.column("text")):
                x = shingle(text.as_py())
                if not late[i]:
                    head, own = b[i], x
                elif head == b[i] and similarity(x, own) >= threshold:
                    out.append((node[i], head))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        del shingle
        common.tidy()

    return grouped.mapInArrow(within, LINKS)


def _in_component(rows: DataFrame, column: str, found: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component of ``column`` (itself, if it has no links) as ``name``."""
    roots = found.select(F.col("node").alias(column), F.col("root").alias("_root"))
    spread = [c for c in rows.columns if c != column]
    return common.spread_join(rows, roots, [column], spread, "left", SALTS).withColumn(name, F.coalesce("_root", column)).drop("_root")


def bucket_links(members: DataFrame, found: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) across components between texts that share a bucket.  ``members``: (node, size, band, h, b, n); ``found``: (node, root)."""
    m = _in_component(members.filter("n > 2"), "node", found, "c")
    m = common.stored(_in_component(m, "b", found, "cb").withColumn("guest", F.col("c") != F.col("cb")), "near-members")
    per = m.groupBy("band", "h").agg(
        F.count_if("guest").alias("guests"), F.count_if(~F.col("guest")).alias("hosts"),
        F.sum(F.when(F.col("guest"), F.col("size")).otherwise(0)).alias("guest_size"), F.sum(F.when(F.col("guest"), 0).otherwise(F.col("size"))).alias("host_size"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"), F.sum(F.xxhash64("c", "node").cast("decimal(38,0)")).alias("same2"),
    ).filter("guests > 0")
    # buckets of the same members need one look only
    per = per.groupBy("same", "same2", "guests", "hosts", "guest_size", "host_size").agg(F.min(F.struct("band", "h")).alias("k")).select("k.*", "guests", "hosts", "guest_size", "host_size")
    blocks = lambda n, size: F.ceil(F.greatest(F.col(n) / BLOCK_DOCS, F.col(size) / BLOCK_ELEMENTS)).cast("int")
    per = common.stored(per.select("band", "h", blocks("guests", "guest_size").alias("gb"), blocks("hosts", "host_size").alias("hb")), "near-open")
    open_ = common.spread_join(m.select("node", "band", "h", "c", "guest"), per, ["band", "h"], ["node"], salts=SALTS)
    gb, hb, r = F.col("gb"), F.col("hb"), F.xxhash64("node")
    side = F.when(F.col("guest"), F.pmod(r, gb)).otherwise(gb + F.pmod(r, hb)).cast("int")
    open_ = open_.withColumn("side", side)
    # a guest's block meets every block, a host's block those of guests
    pairs = F.transform(F.sequence(F.lit(0), F.when(F.col("guest"), gb + hb - 1).otherwise(gb - 1)), lambda k: F.struct(F.least(k, F.col("side")).alias("i"), F.greatest(k, F.col("side")).alias("j")))
    grouped = open_.select("band", "h", "side", "c", "node", F.explode(F.array_distinct(pairs)).alias("p")).select("band", "h", "p.i", "p.j", "side", "c", "node")
    grouped = grouped.join(texts, "node").select("band", "h", "i", "j", "side", "c", "node", "text")

    def within(batches):
        shingle = Shingler()
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("band", "h", "i", "j", "side", "c", "node", "text"))))
        for _, group in groupby(rows, key=lambda r: r[:4]):
            group = [(*r[4:7], shingle(r[7])) for r in group]
            found = linked([r[0] for r in group], [r[1] for r in group], [r[3] for r in group], threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([group[x[k]][2] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        del shingle
        common.tidy()

    return grouped.repartition("band", "h", "i", "j").sortWithinPartitions("band", "h", "i", "j", "node").mapInArrow(within, LINKS)


def _texts_of(docs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of ``nodes``; one row of each text's document is enough."""
    wanted = texts.join(nodes, "node").select("node", "h1", "h2", F.col("doc").alias("doc_id"))
    return keyed(docs).join(wanted, ["doc_id", "h1", "h2"]).select("node", "text").dropDuplicates(["node"])


def found_links(docs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of the texts that have links.  ``texts``: (node, doc, h1, h2, bands, size)."""
    held = texts.select("node", "size", F.posexplode("bands").alias("band", "h"))
    buckets = common.stored(held.groupBy("band", "h").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-buckets")
    if buckets.isEmpty():
        return texts.select("node", F.col("node").alias("root")).limit(0)
    members = common.stored(common.spread_join(held, buckets, ["band", "h"], ["node"], salts=SALTS).select("node", "size", "band", "h", "b", "n"), "near-shared")
    ties = common.stored(members.filter("node <> b").select(F.col("node").alias("a"), "b").distinct(), "near-ties")
    whole = common.stored(_texts_of(docs, texts, members.select("node").distinct()), "near-texts")
    # of each text one tie, then those that are still open
    first = ties.groupBy("a").agg(F.min("b").alias("b"))
    links = common.stored(tested(first, whole, threshold), "near-links")
    found = common.stored(components(links, "near-first"), "near-found")
    rest = _in_component(_in_component(ties.join(first, ["a", "b"], "left_anti"), "a", found, "ra"), "b", found, "rb").filter("ra <> rb").select("a", "b")
    more = common.stored(tested(rest, whole, threshold), "near-links")
    if not more.isEmpty():
        links = links.union(more)
        found = common.stored(components(links, "near-second"), "near-found")
    more = common.stored(bucket_links(members, found, whole, threshold), "near-links")
    return found if more.isEmpty() else common.stored(components(links.union(more), "near-third"), "near-found")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, h1, h2, class_id, head): for each row its text's hashes, its class, and whether its document and text stand for the class."""
    rows = common.stored(signed(docs), "near-signed")
    known = rows.filter("doc_id is not null and bands is not null")
    shared = common.stored(known.select("doc_id", "h1", "h2").distinct().groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("shared")), "near-shared-ids")
    known = known.withColumn("shared", F.lit(False)) if shared.isEmpty() else common.spread_join(known, shared, ["doc_id"], ["h1"], "left").fillna(False, ["shared"])
    # the document that a text is named after
    own = F.min(F.struct("shared", "doc_id"))
    texts = known.groupBy("h1", "h2").agg(own.alias("own"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    texts = common.stored(texts.select(F.monotonically_increasing_id().alias("node"), F.col("own.doc_id").alias("doc"), F.col("own.shared").alias("shared"), "h1", "h2", "bands", "size", "copies"), "near-distinct")
    found = found_links(docs, texts, threshold)
    names = texts.drop("bands").join(found, "node")
    heads = names.groupBy("root").agg(F.min(F.struct("shared", "doc", "h1", "h2")).alias("top"))
    names = common.spread_join(names, heads, ["root"], ["node"], salts=SALTS).select("h1", "h2", "doc", F.col("top.doc").alias("class"), F.struct("h1", "h2").eqNullSafe(F.struct("top.h1", "top.h2")).alias("first"))
    # texts of several rows that are linked with no other
    copies = texts.filter("copies > 1").join(found.select("node"), "node", "left_anti").select("h1", "h2", "doc", F.col("doc").alias("class"), F.lit(True).alias("first"))
    names = common.stored(names.union(copies), "near-names")
    placed = common.spread_join(rows.select("doc_id", "h1", "h2", F.col("bands").isNull().alias("bare")), names, ["h1", "h2"], ["doc_id"], "left", SALTS)
    alone = F.col("doc_id").isNull() | F.col("bare") | F.col("class").isNull()
    head = alone | (F.col("first") & (F.col("doc_id") == F.col("doc")))
    return placed.select("doc_id", "h1", "h2", F.when(alone, F.col("doc_id")).otherwise(F.col("class")).alias("class_id"), head.alias("head"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, that of its smallest document; of rows that repeat doc_id and text one stays.

    Rows with a null doc_id stay, as do rows without words, and unlike texts of one doc_id.
    """
    found = common.stored(classes(docs, threshold), "near-decided")
    gone = found.filter("doc_id is not null and not head").select(F.col("doc_id").alias("_doc"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(6), text).alias("h2"))
    same = (F.col("doc_id") == F.col("_doc")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    kept = hashed.join(common.sized_broadcast(common.stored(gone, "near-gone")), same, "left_anti")
    twins = common.stored(found.filter("doc_id is not null and head").groupBy("doc_id", "h1", "h2").count().filter("count > 1").select(F.col("doc_id").alias("_doc"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")), "near-twins")
    if not twins.isEmpty():
        twice = common.sized_broadcast(twins)
        kept = kept.join(twice, same, "left_anti").union(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "h1", "h2"]))
    return kept.select("row.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id")
