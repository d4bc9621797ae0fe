"""Inverted file over vectors: lists of near vectors, product-quantised, exact where asked.

Vectors are dealt to lists by the nearest of two levels of centroids. The first level
is fitted on a bounded sample of all vectors; lists that come out long are cut
again, each by centroids fitted on a bounded sample of its own, all in parallel, so lists
stay short however many vectors there are. What is left of a vector in its list is
coded in a byte for every few components. The index keeps the length of what the code
misses, so a code gives bounds of the true distance.

A search visits the lists nearest to a query and reads codes only; the best by code
are measured on the stored vectors. An exact search takes the k-th distance found
that way as a limit, then visits every list whose sphere reaches within it and measures
every vector whose bound does: the same rows as a scan, from a part of the lists. Rows are
kept in a versioned store by object, so a changed object replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from saltmarsh.functions.vectors import squared_l2
from saltmarsh.operators.ranking import framed
from saltmarsh.operators.rows import materialise
from saltmarsh.sources import snapshots

# First-level centroids at most, vectors that a list should hold, and second-level centroids of one list at most.
COARSE = 1024
LIST_ROWS = 128
FINE = 1024
# Vectors that centroids are fitted on, at most about so many for the first level and for each list.
SAMPLE_ROWS = 1 << 14
ROUNDS = 12
# Components that share a code byte, and codes of a byte.
GROUP = 4
CODES = 256
# Rows of one list, or lists, that one task holds; a search for the best by code holds so many times more rows.
SLICE = 1 << 13
CODED = 8
# Queries that one task holds, and rows of a list whose codes are one row of a search.
QUERY_BLOCK = 1 << 10
PIECE = 1 << 10
# Pairs of a query and a row that a task holds before it keeps the best, or measures at once.
PAIRS = 1 << 20
# Points whose distances to all centres are held at once.
POINTS = 1 << 10
# Lists that a search visits, and candidates by code for each wanted row that it measures.
VISITED = 24
MEASURED = 8


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres."""
    gaps = np.square(points).sum(1)[:, None] - 2 * (points @ centres.T) + np.square(centres).sum(1)
    return np.maximum(gaps, 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of every point and the squared distance to it, a block of points after the other."""
    own, gap = np.empty(len(points), np.int64), np.empty(len(points))
    for start in range(0, len(points), POINTS):
        gaps = distances(points[start : start + POINTS], centres)
        own[start : start + POINTS], gap[start : start + POINTS] = gaps.argmin(1), gaps.min(1)
    return own, gap


def cluster(points: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``count`` centres of the points by Lloyd's rounds; a centre without points takes the worst served one."""
    random = np.random.default_rng(11)
    points = points[np.lexsort(points.T[::-1])]
    centres = points[random.choice(len(points), min(count, len(points)), replace=False)]
    for _ in range(rounds):
        own, gap = nearest(points, centres)
        size = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, points[:, d], len(centres)) for d in range(points.shape[1])], 1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        empty = np.flatnonzero(size == 0)
        centres[empty] = points[np.argsort(-gap)[: len(empty)]]
    return np.unique(centres, axis=0)


def stacked(column: pd.Series) -> np.ndarray:
    widths = set(column.map(len))
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {sorted(widths)}")
    return np.stack(column.to_numpy()).astype(np.float64)


@dataclass(frozen=True)
class Codebook:
    """One table of at most ``CODES`` part vectors for every ``GROUP`` components."""

    tables: list[np.ndarray]

    @staticmethod
    def fit(rest: np.ndarray) -> Codebook:
        return Codebook([cluster(rest[:, i : i + GROUP], CODES, 8) for i in range(0, rest.shape[1], GROUP)])

    def encode(self, rest: np.ndarray) -> np.ndarray:
        parts = [nearest(rest[:, i * GROUP : i * GROUP + t.shape[1]], t)[0] for i, t in enumerate(self.tables)]
        return np.stack(parts, 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([t[codes[:, i]] for i, t in enumerate(self.tables)], 1)


@dataclass(frozen=True)
class Layout:
    """What assigns a vector: first-level centroids and the code tables. Its size does not depend on the rows."""

    coarse: np.ndarray
    book: Codebook

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [("coarse", i, 0, c.tolist()) for i, c in enumerate(self.coarse)]
        rows += [("book", i, j, v.tolist()) for i, t in enumerate(self.book.tables) for j, v in enumerate(t)]
        return spark.createDataFrame(rows, "kind string, place int, code int, vector array<double>")

    @staticmethod
    def read(table: DataFrame) -> Layout:
        held = table.toPandas().sort_values(["kind", "place", "code"])
        book = held[held.kind == "book"]
        tables = [np.stack(part.vector.to_list()) for _, part in book.groupby("place")]
        return Layout(np.stack(held[held.kind == "coarse"].vector.to_list()), Codebook(tables))


def _sampled(rows: DataFrame, share: Column) -> DataFrame:
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    return rows.filter(unit < share)


def _fit_layout(rows: DataFrame, count: int) -> Layout:
    lists = max(1, min(COARSE, count // LIST_ROWS))

    def fit(frames):
        held = [f for f in frames if len(f)]
        if held:
            points = stacked(pd.concat(held).sort_values("key")["vector"])
            coarse = cluster(points, lists)
            book = Codebook.fit(points - coarse[nearest(points, coarse)[0]])
            for kind, tables in (("coarse", [coarse]), ("book", book.tables)):
                for place, table in enumerate(tables):
                    number = np.arange(len(table))
                    yield pd.DataFrame({"kind": kind, "place": number if kind == "coarse" else place, "code": 0 if kind == "coarse" else number, "vector": list(table)})

    # One task takes the sample, whose size is bounded.
    sample = _sampled(rows, F.lit(SAMPLE_ROWS / max(count, 1))).select("key", "vector").repartition(1)
    return Layout.read(sample.mapInPandas(fit, "kind string, place int, code int, vector array<double>"))


def _with_coarse(rows: DataFrame, layout: Layout) -> DataFrame:
    centres = layout.coarse

    def assign(frames):
        for frame in frames:
            if len(frame):
                points = stacked(frame["vector"])
                if points.shape[1] != centres.shape[1]:
                    raise ValueError(f"vectors of different widths: {sorted({points.shape[1], centres.shape[1]})}")
                yield frame.assign(coarse=nearest(points, centres)[0].astype(np.int32))

    return rows.mapInPandas(assign, T.StructType([*rows.schema.fields, T.StructField("coarse", T.IntegerType())]))


def _fit_lists(placed: DataFrame, layout: Layout) -> DataFrame:
    """list_id, coarse, centre of all lists: those of long first-level lists are fitted, others have their centroid."""
    sizes = placed.groupBy("coarse").agg(F.count(F.lit(1)).alias("size"))
    centres = placed.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(layout.coarse)], "coarse int, centre array<double>")
    # One row per first-level list on this side.
    sized = centres.join(sizes, "coarse", "left").withColumn("parts", F.least(F.lit(FINE), F.ceil(F.coalesce("size", F.lit(0)) / LIST_ROWS)).cast("int"))
    long = materialise(sized.filter("parts > 2"), "long-lists")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        found = cluster(stacked(frame.sort_values("key")["vector"]), int(frame["parts"].iloc[0]))
        return pd.DataFrame({"coarse": int(frame["coarse"].iloc[0]), "sub": np.arange(len(found), dtype=np.int64), "centre": list(found)})

    sample = _sampled(placed.join(F.broadcast(long.select("coarse", "size", "parts")), "coarse"), F.lit(SAMPLE_ROWS) / F.col("size"))
    fine = sample.select("key", "vector", "coarse", "parts").groupBy("coarse").applyInPandas(fit, "coarse int, sub long, centre array<double>")
    fine = materialise(fine, "fine-lists")
    whole = centres.join(fine.select("coarse").distinct(), "coarse", "left_anti").select("coarse", F.lit(0).cast("long").alias("sub"), "centre")
    every = whole.union(fine)
    return every.select((F.col("coarse").cast("long") * FINE + F.col("sub")).alias("list_id"), "coarse", "centre")


def _sliced(rows: DataFrame, by: str, other: DataFrame, size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``slice`` of at most about so many rows of one group, and the other side once for every slice of its group."""
    slices = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("slices"))
    slices = materialise(slices, "slices")
    left = rows.join(slices, by).withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")).drop("slices")
    right = other.join(slices, by).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return left, right


def _encoded(placed: DataFrame, lists: DataFrame, layout: Layout) -> DataFrame:
    """Rows with list_id, codes, miss (length of what the code misses) and gap (distance to the centre)."""
    book, names = layout.book, placed.columns
    schema = T.StructType(
        [*placed.schema.fields, *T.StructType.fromDDL("list_id long, codes binary, miss double, gap double").fields]
    )

    def encode(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({f.name: [] for f in schema})
        own = own.sort_values("list_id")
        points, centres = stacked(rows["vector"]), stacked(own["centre"])
        at = nearest(points, centres)[0]
        rest = points - centres[at]
        codes = book.encode(rest)
        miss = np.sqrt(np.square(rest - book.decode(codes)).sum(1))
        gap = np.sqrt(np.square(rest).sum(1))
        found = rows[names].assign(list_id=own["list_id"].to_numpy()[at], codes=[c.tobytes() for c in codes], miss=miss, gap=gap)
        return found

    left, right = _sliced(placed, "coarse", lists)
    return left.groupBy("coarse", "slice").cogroup(right.groupBy("coarse", "slice")).applyInPandas(encode, schema).drop("coarse")


def _plain(rows: DataFrame, key: str, vector: str, object_key: str, carried: Sequence[str]) -> DataFrame:
    vectors = F.col(vector).cast("array<double>").alias("vector")
    return rows.select(F.col(key).alias("key"), F.col(object_key).alias("object_key"), vectors, *carried).filter("vector IS NOT NULL")


def build(rows: DataFrame, path: str, key: str, vector: str = "embedding", object_key: str | None = None, carried: Sequence[str] = ()) -> None:
    """Fit and write an index of the rows. Keys are unique; ``carried`` columns can be filtered on. Null vectors are left out."""
    plain = materialise(_plain(rows, key, vector, object_key or key, carried), "vectors")
    layout = _fit_layout(plain, plain.count())
    placed = materialise(_with_coarse(plain, layout), "placed")
    lists = _fit_lists(placed, layout)
    layout.table(rows.sparkSession).coalesce(1).write.parquet(f"{path}/layout")
    lists.write.parquet(f"{path}/lists")
    snapshots.write(_encoded(placed, rows.sparkSession.read.schema(lists.schema).parquet(f"{path}/lists"), layout), f"{path}/rows", "object_key")


def update(rows: DataFrame, path: str, key: str, vector: str = "embedding", object_key: str | None = None, carried: Sequence[str] = ()) -> int:
    """The rows replace all rows of their objects; returns the new version."""
    spark = rows.sparkSession
    layout = Layout.read(spark.read.parquet(f"{path}/layout"))
    placed = materialise(_with_coarse(_plain(rows, key, vector, object_key or key, carried), layout), "placed")
    return snapshots.update(spark, f"{path}/rows", _encoded(placed, spark.read.parquet(f"{path}/lists"), layout), "groups")


def _routed(asked: DataFrame, lists: DataFrame, layout: Layout, visited: int | None) -> DataFrame:
    """Queries with ``coarse``, the first-level lists to look into, and ``block``: near queries, at most about QUERY_BLOCK."""
    centres = layout.coarse
    # Groups of near centroids, one for about QUERY_BLOCK queries.
    groups = cluster(centres, max(1, -(-asked.count() // QUERY_BLOCK)))
    far = {r["coarse"]: r["far"] for r in lists.groupBy("coarse").agg(F.max("far").alias("far")).collect()}  # one number per first-level list
    spread = np.array([far.get(i, -np.inf) for i in range(len(centres))])

    def choose(frames):
        for whole in frames:
            for start in range(0, len(whole), POINTS):
                frame = whole.iloc[start : start + POINTS]
                points = stacked(frame["vector"])
                gaps = np.sqrt(distances(points, centres))
                if visited is None:
                    near = gaps <= frame["reach"].to_numpy()[:, None] + spread
                else:
                    gaps[:, np.isinf(spread)] = np.inf
                    near = (gaps <= np.partition(gaps, min(visited, len(centres)) - 1, 1)[:, [min(visited, len(centres)) - 1]]) & np.isfinite(gaps)
                yield frame.assign(coarse=[np.flatnonzero(n) for n in near], block=nearest(points, groups)[0])

    fields = [T.StructField("coarse", T.ArrayType(T.LongType())), T.StructField("block", T.LongType())]
    placed = materialise(asked.mapInPandas(choose, T.StructType([*asked.schema.fields, *fields])), "routed")
    # One row per block on this side.
    sizes = placed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("slices"))
    sliced = placed.join(F.broadcast(sizes), "block")
    return sliced.withColumn("block", F.col("block") + len(groups) * F.pmod(F.xxhash64("query_id"), F.col("slices"))).drop("slices")


def _dealt(held: DataFrame, asked: DataFrame, sizes: DataFrame, most: int, *by: str) -> tuple[DataFrame, DataFrame]:
    """What the queries of a block meet, cut into parts of about so many rows, and the queries once for every part."""
    parts = materialise(sizes.groupBy("block").agg(F.greatest(F.ceil(F.sum("size") / most), F.lit(1)).cast("int").alias("parts")), "parts")
    left = held.join(parts, "block").withColumn("part", F.pmod(F.xxhash64(*by), F.col("parts")).cast("int")).drop("parts")
    right = asked.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left, right


def _met(left: DataFrame, right: DataFrame, function, schema: T.StructType) -> DataFrame:
    by = ["block", "part"]
    # Columns of the left side come from the right one.
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(function, schema)


def _least(found: DataFrame, name: str, value: str, count: int) -> DataFrame:
    """query_id, block and the ``count`` names of a query with the least values, then the least names, of all parts."""
    pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col(value), F.col(name)))))
    merged = found.groupBy("query_id").agg(F.min("block").alias("block"), F.slice(pairs, 1, count).alias("pairs"))
    return merged.select("query_id", "block", F.col(f"pairs.{name}").alias(name))


def _none(schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame({f.name: [] for f in schema}, dtype=object)


def _answers(asked: pd.DataFrame, schema: T.StructType, name: str, value: str, query: np.ndarray, names: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    """One row for each query that has pairs; these are in order of the query."""
    who, starts = np.unique(query, return_index=True)
    if not len(who):
        return _none(schema)
    rows = asked.iloc[who]
    cut = {name: np.split(names, starts[1:]), value: np.split(values, starts[1:])}
    return pd.DataFrame({f.name: cut[f.name] if f.name in cut else rows[f.name] for f in schema}, index=rows.index)


def _nearest_lists(asked: DataFrame, lists: DataFrame, layout: Layout, visited: int | None) -> DataFrame:
    """query_id, vector, reach, block and ``lists``: the ``visited`` nearest lists of each query, or all that reach within its limit."""
    routed = _routed(asked, lists, layout, visited)
    fields = "block long, part int, lists array<long>, gaps array<double>"
    schema = T.StructType([asked.schema["query_id"], *T.StructType.fromDDL(fields).fields])

    def choose(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        query, ids, values = [], [], []
        if len(own) and len(asked):
            own = own.sort_values("list_id")
            centres, radius, number = stacked(own["centre"]), own["radius"].to_numpy(), own["list_id"].to_numpy()
            middle = centres.mean(0)
            centres -= middle
            known, place = np.unique(own["coarse"].to_numpy(), return_inverse=True)
            step = max(1, PAIRS // len(own))
            for start in range(0, len(asked), step):
                some = asked.iloc[start : start + step]
                points = stacked(some["vector"]) - middle
                gaps = np.sqrt(distances(points, centres))
                chosen = np.zeros((len(some), len(known) + 1), bool)
                at = np.searchsorted(known, coarse := np.concatenate(some["coarse"].to_numpy()))
                at[known[np.minimum(at, len(known) - 1)] != coarse] = len(known)
                chosen[np.repeat(np.arange(len(some)), some["coarse"].map(len)), at] = True
                gaps[~chosen[:, place]] = np.inf
                if visited is None:
                    # Rounding may make a gap this much longer.
                    slack = 1e-7 * np.sqrt(max(np.square(points).sum(1).max(), np.square(centres).sum(1).max()))
                    near = (gaps <= some["reach"].to_numpy()[:, None] + radius + slack) & np.isfinite(gaps)
                else:
                    size = min(visited, len(own))
                    near = (gaps <= np.partition(gaps, size - 1, 1)[:, [size - 1]]) & np.isfinite(gaps)
                who, which = np.nonzero(near)
                query.append(start + who)
                ids.append(number[which])
                values.append(gaps[who, which])
        if not query:
            return _none(schema)
        return _answers(asked.reset_index(drop=True), schema, "lists", "gaps", *map(np.concatenate, (query, ids, values)))

    wanted = routed.select("block", F.explode("coarse").alias("coarse")).distinct()
    counts = lists.groupBy("coarse").agg(F.count(F.lit(1)).alias("size"))
    met = wanted.join(lists.select(F.col("coarse").cast("long").alias("coarse"), "list_id", "centre", "radius"), "coarse")
    sizes = wanted.join(counts.withColumn("coarse", F.col("coarse").cast("long")), "coarse")
    found = _met(*_dealt(met, routed, sizes, SLICE, "list_id"), choose, schema)
    if visited is None:
        found = found.groupBy("query_id").agg(F.flatten(F.collect_list("lists")).alias("lists"))
    else:
        found = _least(found, "lists", "gaps", visited).select("query_id", "lists")
    return routed.drop("coarse").join(found, "query_id")


def _packed(codes: DataFrame, lists: DataFrame) -> DataFrame:
    """Lists in pieces of at most about PIECE rows: list_id, centre, and keys, codes and misses of the rows."""
    piece = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / PIECE)).alias("piece")
    rows = codes.join(lists.select("list_id", "size"), "list_id").select("list_id", piece, F.struct("key", "codes", "miss").alias("row"))
    pieces = rows.groupBy("list_id", "piece").agg(F.collect_list("row").alias("rows"))
    pieces = pieces.select("list_id", "piece", *[F.col(f"rows.{name}").alias(name) for name in ("key", "codes", "miss")])
    return pieces.join(lists.select("list_id", "centre"), "list_id")


def _best(query: np.ndarray, row: np.ndarray, rough: np.ndarray, place: np.ndarray, best: int) -> tuple[np.ndarray, ...]:
    """The ``best`` pairs of each query, in order of the query; of equals those first in place."""
    order = np.argsort(query, kind="stable")
    kept = []
    for own in np.split(order, np.flatnonzero(np.diff(query[order])) + 1):
        if len(own) > best:
            gaps = rough[own]
            own = own[gaps <= np.partition(gaps, best - 1)[best - 1]]
            if len(own) > best:
                own = own[np.lexsort((place[row[own]], rough[own]))[:best]]
        kept.append(own)
    kept = np.concatenate(kept)
    return query[kept], row[kept], rough[kept]


def _by_code(codes: DataFrame, probes: DataFrame, lists: DataFrame, layout: Layout, best: int | None) -> DataFrame:
    """query_id, block, part, key: for each query the keys of the ``best`` rows of its lists by code, or in each part all within its limit."""
    book = layout.book
    keys = T.StructField("key", T.ArrayType(codes.schema["key"].dataType))
    schema = T.StructType([probes.schema["query_id"], *T.StructType.fromDDL("block long, part int, rough array<double>").fields, keys])

    def scan(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return _none(schema)
        points, reach = stacked(asked["vector"]), asked["reach"].to_numpy()
        names = np.concatenate(held["key"].to_numpy())
        place = np.arange(len(names)) if best is None else pd.factorize(names, sort=True, use_na_sentinel=False)[0]
        known, own = np.unique(held["list_id"].to_numpy(), return_inverse=True)
        # Each list with the queries that visit it.
        query = np.repeat(np.arange(len(asked)), asked["lists"].map(len))
        at = np.searchsorted(known, wanted := np.concatenate(asked["lists"].to_numpy()))
        here = known[np.minimum(at, len(known) - 1)] == wanted
        pairs = np.unique(at[here] * len(asked) + query[here])
        visits, bounds = pairs % len(asked), np.searchsorted(pairs // len(asked), np.arange(len(known) + 1))
        some, count, first = [], 0, 0
        for which, some_codes, miss, centre in zip(own, held["codes"], held["miss"], held["centre"]):
            rest = book.decode(np.frombuffer(b"".join(some_codes), np.uint8).reshape(len(some_codes), -1))
            visitors = visits[bounds[which] : bounds[which + 1]]
            for start in range(0, len(visitors), QUERY_BLOCK):
                who = visitors[start : start + QUERY_BLOCK]
                moved = points[who] - centre
                gaps = distances(moved, rest)
                rough = np.sqrt(gaps)
                if best is None:
                    # Rounding may make a distance this much longer.
                    slack = 1e-7 * np.sqrt(max(np.square(moved).sum(1).max(), np.square(rest).sum(1).max()))
                    hit, row = np.nonzero(rough - miss <= reach[who][:, None] + slack)
                else:
                    size = min(best, len(rest))
                    hit, row = np.nonzero(rough <= np.partition(rough, size - 1, 1)[:, [size - 1]])
                some.append((who[hit], first + row, rough[hit, row]))
                count += len(hit)
                if best is not None and count > PAIRS:
                    some = [_best(*map(np.concatenate, zip(*some)), place, best)]
                    count = 0
            first += len(some_codes)
        if not sum(len(s[0]) for s in some):
            return _none(schema)
        query, row, rough = _best(*map(np.concatenate, zip(*some)), place, best or len(names))
        return _answers(asked.reset_index(drop=True), schema, "key", "rough", query, names[row], rough)

    wanted = probes.select("block", F.explode("lists").alias("list_id")).distinct()
    # Lists that nobody visits are not shuffled.
    packed = _packed(codes.join(wanted.select("list_id").distinct(), "list_id", "left_semi"), lists)
    sizes = wanted.join(lists.select("list_id", "size"), "list_id")
    most = SLICE if best is None else CODED * SLICE
    found = _met(*_dealt(wanted.join(packed, "list_id"), probes, sizes, most, "list_id", "piece"), scan, schema)
    return found.drop("rough") if best is None else _least(found, "key", "rough", best).withColumn("part", F.lit(0))


def _measured(found: DataFrame, asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, key, distance of the k nearest found rows of each query in each part, measured on the stored vectors."""
    schema = T.StructType([found.schema["query_id"], rows.schema["key"], T.StructField("distance", T.DoubleType())])

    def measure(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asked):
            points, vectors = stacked(held["vector"]).T.copy(), stacked(asked["vector"]).T.copy()
            keys, order = np.unique(held["key"].to_numpy(), return_inverse=True)
            rows_of = np.argsort(order, kind="stable")
            # A key may have several rows.
            firsts = np.searchsorted(order[rows_of], np.arange(len(keys) + 1))
            lengths = asked["key"].map(len).to_numpy()
            for own in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(np.cumsum(lengths) // PAIRS)) + 1):
                wanted = np.concatenate(asked["key"].iloc[own].to_numpy())
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                count = np.where(keys[at] == wanted, firsts[at + 1] - firsts[at], 0)
                query = np.repeat(np.repeat(own, lengths[own]), count)
                row = rows_of[np.repeat(firsts[at] - np.cumsum(count) + count, count) + np.arange(count.sum())]
                distance = np.zeros(len(row))
                for point, vector in zip(points, vectors):
                    distance += np.square(point[row] - vector[query])
                best = np.lexsort((order[row], distance, query))
                best = best[np.arange(len(best)) - np.searchsorted(query[best], query[best]) < k]
                out.append((asked["query_id"].to_numpy()[query[best]], held["key"].to_numpy()[row[best]], distance[best]))
        return framed(schema.names, out)

    found = materialise(found, "found")
    needed = found.select("block", "part", F.explode("key").alias("key")).distinct().join(rows.select("key", "vector"), "key")
    return _met(needed, found.join(asked.select("query_id", "vector"), "query_id"), measure, schema)


def search(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int,
    query_id: str = "query_id",
    vector: str = "embedding",
    name: str = "key",
    where: Column | None = None,
    exact: bool = False,
    visited: int = VISITED,
    measured: int = MEASURED,
) -> DataFrame:
    """query_id, key (as ``name``), distance, rank of the k nearest rows of each query, by squared distance, then key.

    Without ``exact`` only ``visited`` lists are read and ``measured`` times k rows are measured. ``where``
    filters the indexed rows by key, object_key or carried columns first.
    """
    layout = Layout.read(spark.read.parquet(f"{path}/layout"))
    rows = snapshots.read(spark, f"{path}/rows")
    rows = rows if where is None else rows.filter(where)
    codes = rows.select("key", "list_id", "codes", "miss").filter("key IS NOT NULL")
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = asked.filter("query_id IS NOT NULL AND vector IS NOT NULL")
    asked = materialise(asked.withColumn("reach", F.lit(float("inf"))), "asked")
    radius = rows.groupBy("list_id").agg(F.max("gap").alias("radius"), F.count("key").alias("size"))
    lists = spark.read.parquet(f"{path}/lists").join(radius, "list_id")
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(layout.coarse)], "coarse int, first array<double>")
    far = F.sqrt(squared_l2(F.col("first"), F.col("centre"))) + F.col("radius")
    lists = materialise(lists.join(centres, "coarse").withColumn("far", far).drop("first"), "lists")

    probes = materialise(_nearest_lists(asked, lists, layout, visited), "probes")
    found = _measured(_by_code(codes, probes, lists, layout, k * measured), asked, rows, k)
    order = W.partitionBy("query_id").orderBy("distance", "key")
    if exact:
        ranked = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == k).select("query_id", "distance")
        # A little more than the k-th distance, for the rounding of the products behind rough distances.
        limit = F.coalesce(F.sqrt("distance") * (1 + 1e-6) + 1e-6, F.lit(float("inf")))
        limited = materialise(asked.drop("reach").join(ranked, "query_id", "left").select("query_id", "vector", limit.alias("reach")), "limited")
        reached = materialise(_nearest_lists(limited, lists, layout, None), "probes")
        found = _measured(_by_code(codes, reached, lists, layout, None), asked, rows, k)
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("key").alias(name), "distance", "rank")
