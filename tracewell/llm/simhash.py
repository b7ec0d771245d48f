"""Operator 10, SimHash near-duplicates: exact links at ``RADIUS`` or fewer differing bits through vantage-point trees.

A fingerprint holds, for each bit, whether over half of the XXH64 values (seed 42) of the 3-word shingles have it. Equal
fingerprints collapse to one row first, so a group of copies, however large, is one point with its smallest doc_id.

The metric search. Two points that differ in at most r bits differ in at most r - 1 of the first ``WIDE`` bits, or in none of
the others (else they would differ in r and one more). So there are two trees, each under the Hamming distance of its
own bits: one searched with radius r - 1 = 1, one with radius 0. A node holds a vantage point and a distance mu; points go left
if they are nearer than mu. Each point is stored in one shard of each tree. The triangle bound |d(v, x) - d(v, y)| <= d(x, y)
prunes the branches that the radius cannot reach; a point at the boundary overlaps and is asked in the other branch too. Of a
pair parted by mu only the left point has to be asked, which halves the overlap. Vantage point and mu are those, of a few,
that leave the fewest comparisons, on a sample of at most ``SAMPLE`` points for the upper levels: the shards, by which Spark
shuffles. A shard goes on splitting by its own vantage points, and leaves are compared with all 64 bits.

A shard of more than ``SHARD`` rows is parted by a tree of its own sample before any task gets it, as often as needed; one
that no tree can part (all points near each other) becomes a grid of blocks, each pair in one of them. A task returns a
spanning forest of its links, never all pairs, and connected components of these come from alternating large-star and
small-star steps, each checkpointed to the shared folder.

Defined results: null, empty or word-free text: fingerprint zero, linked like any other. Fewer than 3 words: the whole
sequence is the one shingle. Very long texts are read whole. Null doc_id: takes part with its text, counts as larger than any.
Repeated rows: each is returned; :func:`deduplicate` keeps exactly one of them. Ties go to the smallest doc_id. Empty table: no
rows. Other columns, whatever their names, are kept by :func:`deduplicate` and left out by the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_digest

from .common import cut, least_hashed, shared_dir
from .tokens import batches

SHINGLE, SEED, RADIUS, WIDE = 3, 42, 2, 40
#: Points sampled for the trees' upper levels, rows of a shard aimed at and at most, points compared without a tree.
SAMPLE, LEAF, SHARD, BRUTE = 20_000, 16_384, 200_000, 512
#: Vantage points tried at a node; shards parted anew in one round, the points sampled in each, and how often before the grid.
TRIES, REDEALT, SUBSAMPLE, LEVELS = 4, 2_000, 512, 6
MAX_BROADCAST = 500_000
ALL = (1 << 64) - 1


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts, ends = [0, *(s + 1 for s in spaces)], [*spaces, len(joined)]
    k = min(SHINGLE, len(words))
    raw = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)])
    votes = np.zeros(64, np.int64)
    bits = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    for i in range(0, len(bits), 8192):
        votes += np.unpackbits(bits[i : i + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, row: str | None = None) -> DataFrame:
    """_row, doc_id, fp (the 64 bits as a signed number) for each row of ``docs``. ``row`` names a column that numbers the rows."""

    def run(frames):
        for frame in batches(frames):
            fp = np.array([fingerprint(t) for t in frame["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"_row": frame["_row"], "doc_id": frame["doc_id"].astype("Int64"), "fp": fp})

    number = F.col(row) if row else F.monotonically_increasing_id()
    own = docs.select(number.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.mapInPandas(run, "_row long, doc_id long, fp long")


def band_masks(wide: int = WIDE) -> tuple[int, int]:
    """The first ``wide`` of the 64 places, and the others."""
    return ALL >> (64 - wide) << (64 - wide), ALL >> wide


def distance(points: np.ndarray, vantage: int, mask: int = ALL) -> np.ndarray:
    return np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int64)


def choose(points: np.ndarray, home: np.ndarray, asked: np.ndarray, mask: int, near: int) -> tuple[int, int] | None:
    """Vantage point and mu that leave the fewest comparisons of home points with each other and with the asked ones.

    Of ``TRIES`` home points, each with every mu. None where no split leaves clearly fewer than there are: the points are all
    alike, or so close that nearly all of them lie at the boundary.
    """
    best, n, m = None, len(home), len(asked)
    for v in points[home[np.linspace(0, n - 1, min(n, TRIES)).astype(np.int64)]].tolist():
        own = np.bincount(distance(points[home], v, mask), minlength=66).cumsum()
        ask = np.bincount(distance(points[asked], v, mask), minlength=66).cumsum() if m else np.zeros(66, np.int64)
        mu = np.arange(1, 65)
        at = lambda sums, k: np.where(k < 0, 0, sums[np.clip(k, 0, 65)])  # noqa: E731 how many are k or nearer
        left = at(own, mu - 1)
        crossing = left - at(own, mu - near - 1)
        cost = left * (left + at(ask, mu + near - 1)) + (n - left) * (n - left + crossing + m - at(ask, mu - near - 1))
        k = int(cost.argmin())
        if best is None or cost[k] < best[0]:
            best = (int(cost[k]), v, int(mu[k]))
    return None if best is None or best[0] > 0.9 * n * (n + m) else best[1:]


def divide(d: np.ndarray, q: np.ndarray, mu: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By distances of home and asked points: home on the left, home on the left to be asked on the right, asked left, right.

    Home points are stored on one side. By the triangle bound two points within ``near`` of each other differ by no more in
    their distances, so of a pair parted by mu the left one lies at the boundary: it is asked on the right, the right
    one need not be asked on the left. Points that are only asked look on either side that the bound leaves open.
    """
    left = d < mu
    return left, left & (d >= mu - near), q < mu + near, q >= mu - near


class Tree:
    """The upper part of a vantage-point tree, grown on a sample; its leaves are shards of about ``leaf`` rows.

    ``scale`` is how many points a sampled one stands for.
    """

    def __init__(self, sample: np.ndarray, mask: int, near: int, scale: float, leaf: int):
        self.mask, self.near = mask, near
        vantage, mu, child, todo, self.leaves = [], [], [], [(np.arange(len(sample)), np.arange(0), None)], 0
        while todo:
            home, asked, link = todo.pop()
            small = len(home) < 16 or (len(home) + len(asked)) * scale <= leaf
            split = None if small else choose(sample, home, asked, mask, near)
            if link:
                child[link[0]][link[1]] = -1 - self.leaves if split is None else len(vantage)
            if split is None:
                self.leaves += 1
                continue
            left, crossing, ask_left, ask_right = divide(distance(sample[home], split[0], mask), distance(sample[asked], split[0], mask), split[1], near)
            todo += [(home[left], asked[ask_left], (len(vantage), 0)), (home[~left], np.concatenate([asked[ask_right], home[crossing]]), (len(vantage), 1))]
            vantage.append(split[0])
            mu.append(split[1])
            child.append([0, 0])
        self.vantage, self.mu = np.array(vantage, np.uint64), np.array(mu, np.int64)
        self.child = np.array(child, np.int64).reshape(-1, 2)

    def shards(self, points: np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which point, shard, whether it is stored there or only asked)."""
        which, home = np.arange(len(points)), np.ones(len(points), bool) if home is None else home
        node, found = np.full(len(points), 0 if len(self.vantage) else -1), []
        while True:
            ended = node < 0
            found.append((which[ended], -1 - node[ended], home[ended]))
            which, node, home = which[~ended], node[~ended], home[~ended]
            if not len(which):
                return tuple(np.concatenate(x) for x in zip(*found, strict=True))
            d, mu = np.bitwise_count((points[which] ^ self.vantage[node]) & np.uint64(self.mask)).astype(np.int64), self.mu[node]
            left = np.where(home, d < mu, d < mu + self.near)
            right = np.where(home, d >= mu, d >= mu - self.near)
            crossing = home & left & (d >= mu - self.near)
            parts = [(left, 0, home), (right, 1, home), (crossing, 1, np.zeros(len(home), bool))]
            which, home, node = (
                np.concatenate([which[x] for x, *_ in parts]), np.concatenate([h[x] for x, _, h in parts]), np.concatenate([self.child[node[x], k] for x, k, _ in parts]),
            )


class _Forest:
    """Links within one task as a union of small trees: at most one link per point."""

    def __init__(self, points: np.ndarray):
        self.points, self.up = points, np.arange(len(points))

    def roots(self, of: np.ndarray) -> np.ndarray:
        r = self.up[of]
        while ((n := self.up[r]) != r).any():
            r = n
        self.up[of] = r
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        roots = self.roots(np.arange(len(self.points)))
        own = np.flatnonzero(roots != np.arange(len(roots)))
        return self.points[own], self.points[roots[own]]


def _compare(points: np.ndarray, home: np.ndarray, asked: np.ndarray, forest: _Forest, radius: int) -> None:
    """Link home points to each other and to the asked ones, block by block over all 64 bits.

    A block whose points are connected already is compared only with points outside its tree, as no other link adds anything.
    """
    for i in range(0, len(home), 128):
        q, others = home[i : i + 128], np.concatenate([home[i:], asked])
        known = forest.roots(q)
        if (known == known[0]).all():
            others = others[forest.roots(others) != known[0]]
        for j in range(0, len(others), 4096):
            o = others[j : j + 4096]
            a, b = np.nonzero(np.bitwise_count(points[q][:, None] ^ points[o][None, :]) <= radius)
            forest.link(q[a], o[b])


def shard_links(points: np.ndarray, home: np.ndarray, mask: int, near: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of a shard's home points with each other and with those that are only asked.

    The tree goes on inside the shard. Where all agree on the band, their difference is in the other bits, so it goes on over
    these with the whole radius.
    """
    forest, todo = _Forest(points), [(np.flatnonzero(home), np.flatnonzero(~home), mask, near)]
    while todo:
        own, asked, m, r = todo.pop()
        if len(own) * (len(own) + len(asked)) <= BRUTE * BRUTE:
            _compare(points, own, asked, forest, radius)
            continue
        split = choose(points, own, asked, m, r)
        if split is None:
            value, other = points[own] & np.uint64(m), points[asked] & np.uint64(m)
            values, counts = np.unique(value, return_counts=True)
            v = values[counts.argmax()]
            if len(values) == 1 and (other == v).all() and m == mask:
                todo.append((own, asked, ~m & ALL, radius))
            elif r == 0 and (len(values) > 1 or (other != v).any()):
                todo += [(own[value == v], asked[other == v], m, r), (own[value != v], asked[other != v], m, r)]
            else:
                _compare(points, own, asked, forest, radius)
            continue
        left, crossing, ask_left, ask_right = divide(distance(points[own], split[0], m), distance(points[asked], split[0], m), split[1], r)
        todo += [(own[left], asked[ask_left], m, r), (own[~left], np.concatenate([asked[ask_right], own[crossing]]), m, r)]
    return forest.links()


_ROUTED = "shard string, band int, fp long, home boolean"


def _rows(shard: np.ndarray, band: int, fp: np.ndarray, home: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"shard": shard.astype(object), "band": np.full(len(fp), band, np.int32), "fp": fp, "home": home})


def _routed(frame: pd.DataFrame, tree: Tree, prefix: str, band: int) -> pd.DataFrame:
    """The rows of a frame (fp, home) in the shards of a tree."""
    fp, home = frame["fp"].to_numpy(np.int64), frame["home"].to_numpy(bool)
    which, shard, stored = tree.shards(fp.view(np.uint64), home)
    return _rows(np.char.add(prefix, shard.astype(str)), band, fp[which], stored)


def _in_grid(frame: pd.DataFrame, name: str, band: int, blocks: int) -> pd.DataFrame:
    """The rows of a shard that no tree can part, as a grid of blocks: row i holds the home points of hash i, column j asks those of hash j."""
    fp, home = frame["fp"].to_numpy(np.int64), frame["home"].to_numpy(bool)
    own = (((fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)
    out = []
    for k in range(blocks):
        every = np.full(len(fp), k)
        for stored, pick, i, j in ((True, home, own, every), (False, ~home | (own != k), every, own)):
            at = np.char.add(np.char.add(f"{name}#", i[pick].astype(str)), np.char.add(",", j[pick].astype(str)))
            out.append(_rows(at, band, fp[pick], np.full(len(at), stored)))
    return pd.concat(out)


def _sample(rows: DataFrame, shards: DataFrame, most: int) -> pd.DataFrame:
    """shard, fp: about ``most`` home points of each named shard (shard, n), those of the smallest hashes."""
    share = F.lit(float(most)) / F.col("n")
    low = F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < share * float(1 << 40)
    return rows.where("home").join(F.broadcast(shards), "shard").where(low).select("shard", "fp").toPandas()


def links(points: DataFrame, radius: int = RADIUS, wide: int = WIDE) -> DataFrame:
    """a, b: a spanning forest, for each shard, of the links between distinct fingerprints (column fp)."""
    bands = list(zip(band_masks(wide), (radius - 1, 0), strict=True))
    sample = np.array([r["fp"] for r in least_hashed(points.select("fp"), "fp", SAMPLE).collect()], np.int64).view(np.uint64)  # at most SAMPLE numbers
    scale = points.count() / max(1, len(sample))
    trees = [Tree(sample, mask, near, scale, LEAF) for mask, near in bands]

    def route(frames):
        for frame in frames:
            for k, tree in enumerate(trees):
                yield _routed(frame, tree, f"{k}.", k)

    rows = cut(points.select("fp", F.lit(True).alias("home")).mapInPandas(route, _ROUTED))
    while True:
        sizes = rows.groupBy("shard").agg(F.count("*").alias("n"), F.first("band").alias("band"))
        large = sizes.where(F.col("n") > SHARD).orderBy(F.desc("n"), "shard").limit(REDEALT).collect()  # the others in the next round
        large = [r for r in large if "#" not in r["shard"]]
        if not large:
            break
        rows = cut(_dealt_anew(rows, large, bands))

    def find(frame):
        fp = frame["fp"].to_numpy(np.int64).view(np.uint64)
        mask, near = bands[int(frame["band"].iloc[0])]
        a, b = shard_links(fp, frame["home"].to_numpy(bool), mask, near, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.groupBy("shard").applyInPandas(find, "a long, b long")


def _dealt_anew(rows: DataFrame, large: list, bands: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with each of the named shards parted by a tree of its own or, where that doesn't part it, in a grid."""
    names = rows.sparkSession.createDataFrame([(r["shard"], r["n"]) for r in large], "shard string, n long")  # at most REDEALT rows
    points = {k: v["fp"].to_numpy(np.int64).view(np.uint64) for k, v in _sample(rows, names, SUBSAMPLE).groupby("shard")}
    plan = {}
    for r in large:
        own = points.get(r["shard"], np.zeros(0, np.uint64))
        tree = Tree(own, *bands[r["band"]], r["n"] / max(1, len(own)), max(1, SHARD // 4)) if r["shard"].count("/") < LEVELS else None
        plan[r["shard"]] = (r["band"], tree if tree is not None and tree.leaves > 1 else None, -(-3 * r["n"] // SHARD))

    def again(frames):
        for frame in frames:
            for name, own in frame.groupby("shard"):
                band, tree, blocks = plan[name]
                yield _in_grid(own, name, band, blocks) if tree is None else _routed(own, tree, f"{name}/", band)

    names = F.broadcast(names.select("shard"))
    return rows.join(names, "shard", "left_anti").unionByName(rows.join(names, "shard", "left_semi").mapInPandas(again, _ROUTED))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root: every node of the links and the smallest node that it reaches. Large-star and small-star in turn."""
    now = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select(F.col("v").alias("x"), F.col("u").alias("y"))
        if large:
            both = both.unionByName(pairs.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        met = both.join(least, "x")
        out = met.where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")) if large else met.select(F.col("y").alias("v"), F.col("m").alias("u")).unionByName(least.select(F.col("x").alias("v"), F.col("m").alias("u")))
        return out.where("u <> v").distinct()

    mark = None
    if now.isEmpty():
        return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    for _ in range(most):
        now = cut(star(star(now, True), False))
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if new == mark:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        mark = new
    raise RuntimeError(f"components did not settle in {most} rounds")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, row: str | None = None) -> DataFrame:
    """_row, doc_id, fp, component_id (smallest doc_id reachable), keep (true for one row of each component)."""
    rows = cut(fingerprints(docs, row))
    own = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    points = cut(rows.groupBy("fp").agg(F.min(own).alias("first"), F.count("*").alias("n")))
    comp = components(links(points, radius))
    linked = comp.unionByName(comp.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    first = points.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = first.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("total")).where("total > 1")
    shared = cut(first.join(best, "root").select("fp", "best"))  # only fingerprints that more than one row is linked by
    shared = F.broadcast(shared) if shared.count() <= MAX_BROADCAST else shared
    found = rows.join(shared, "fp", "left")
    return found.select("_row", "doc_id", "fp", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.id")).alias("component_id"), F.coalesce(F.col("best.row") == F.col("_row"), F.lit(True)).alias("keep"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id.

    The rows are numbered once and written with their numbers: another scan may be split in another way.
    """
    cols, spark, path = docs.columns, docs.sparkSession, shared_dir(docs.sparkSession, "numbered")
    own = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)], F.monotonically_increasing_id().alias("_row"))
    own.write.option("compression", "zstd").parquet(path)
    own = spark.read.schema(own.schema).parquet(path)
    doc_id, text = (own.columns[cols.index(c)] for c in ("doc_id", "text"))
    keyed = own.select("_row", F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    gone = cut(near_duplicates(keyed, row="_row").where(~F.col("keep")).select("_row"))
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone
    left = own.join(gone, "_row", "left_anti")
    return left.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)])
