"""Hard-negative mining over an inverted multi-index.

Vectors are cut into two halves and each half space has a codebook of ``WORDS``
centres, fitted on at most ``FIT_VALUES`` numbers of the rows with the smallest
hashes (the only sample); every row is indexed. A cell is a pair of centres. For
an anchor q, a row's half score is at most q . centre + |q| * radius, where the
radius is the largest distance of any row from that centre, so the sum of two
half bounds covers all rows of a cell. A multi-sequence heap visits the cells in
falling order of that sum and stops as soon as the next bound is under what is
still needed:

* positives: the score of the fifth best row of the anchor's label found so far;
* negatives: for each positive a window of scores; it is certified once its
  fifth best row is over the next bound, or the bound has fallen below it.
  A cell is skipped where even its lower bound is above every window.

The heap stops for a while after a number of rows, which grows by ``GROWTH``
each round; a round scores what was visited and decides with the scores found
which anchors go on. Results are exact: bounds are rounded up and components
are integers, so scores are as well.

Rows are laid out in pages of about ``PAGE_ROWS``: neighbouring small cells share
a page and a large cell has several, chosen by a hash, so no task holds a hot
cell. Anchors are cut into blocks of about ``ANCHOR_ROWS``. A round joins (page, block) as
a unit of work, multiplies matrices there and returns no more than ``POSITIVES``
or ``NEGATIVES`` rows per anchor (and window) and unit, which Spark merges.

Scores are exact for components up to 2 ** 22 in size after scaling; larger ones
count as that. Vectors of different lengths have no score with each other: each
length has an index of its own. A row with a null vec_id is no anchor, keeps its
label and comes last among equal scores.

Cases: rows with a null label, a null vector, or null or non-finite components
take no part; an empty vector's scores are 0; repeated rows and vec_ids are rows
of their own; an anchor without positives, and a positive without negatives in
its window, give no rows; ties go to the smaller vec_id; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staging

POSITIVES, NEGATIVES = 5, 5
ANCHOR_STEP, RELABEL_STEP, LABELS, SCALE = 100, 7, 10, 256
LEAST = "(4 * {} + 4) DIV 5"  # the least score in the window of a positive with that score: 80 % of it, rounded up
WORDS = 64                 # centres of a half space
FIT_VALUES, FIT_STEPS = 1 << 20, 8
PAGE_ROWS, ANCHOR_ROWS = 4096, 1024
FIRST_ROWS, GROWTH = 4096, 16
LARGEST = 1 << 22
SCORED = 1 << 22           # scores in memory at once
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# -- codebooks ---------------------------------------------------------------

def halves(x: np.ndarray) -> list[np.ndarray]:
    return [x[:, :x.shape[1] // 2], x[:, x.shape[1] // 2:]]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def codebook(x: np.ndarray, words: int, seed: int) -> np.ndarray:
    """Centres of ``x`` by Lloyd's rounds. They are integers, so that bounds are
    the same on every machine and each round goes on where the last one ended."""
    different = np.unique(x, axis=0)
    if len(different) <= words:
        return different
    centres = np.random.default_rng(seed).permutation(different)[:words]
    for _ in range(FIT_STEPS):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=words)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return np.rint(centres)


def matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


# -- the multi-sequence heap ---------------------------------------------------

class Cells:
    """Cells that hold rows, visited in falling order of the summed bounds."""

    def __init__(self, books: list[np.ndarray], radii: list[np.ndarray], sizes: dict[int, int]):
        self.books, self.radii, self.sizes = books, radii, sizes

    def visit(self, anchor: np.ndarray):
        """(bound, lower bound, cell) of every cell; bounds never fall short."""
        upper, lower, order = [], [], []
        for part, book, radius in zip(halves(anchor[None, :]), self.books, self.radii):
            centre, spread = book @ part[0], np.sqrt((part * part).sum()) * radius
            order.append(np.argsort(-(centre + spread), kind="stable"))
            upper.append((centre + spread)[order[-1]].tolist())
            lower.append((centre - spread)[order[-1]].tolist())
        width = len(self.books[1])
        heap = [(-(upper[0][0] + upper[1][0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(upper[1]):
                heapq.heappush(heap, (-(upper[0][i] + upper[1][j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(upper[0]):
                heapq.heappush(heap, (-(upper[0][i + 1] + upper[1][0]), i + 1, 0))
            cell = int(order[0][i]) * width + int(order[1][j])
            if cell in self.sizes:
                slack = 1e-9 * (abs(bound) + 1)
                yield -bound + slack, lower[0][i] + lower[1][j] - slack, cell


def layout(sizes: dict[int, int], page_rows: int) -> tuple[dict[int, tuple[int, int]], int]:
    """First page and number of pages of each cell; and the pages in all."""
    places, page, held = {}, 0, 0
    for cell in sorted(sizes):
        n = sizes[cell]
        if held and held + n > page_rows:
            page, held = page + 1, 0
        pages = -(-n // page_rows)
        places[cell] = (page, pages)
        page, held = (page + pages, 0) if pages > 1 else (page, held + n)
    return places, page + (held > 0)


# -- tasks ------------------------------------------------------------------------

def _planner(shared, dim: int, rows: int):
    """Pages that the anchors visit next: anchors come with the number of
    cells seen, the score still needed and the top of their windows."""
    names = ["block", "page", "anchor", "cells", "next_seen", "next_bound"]

    def run(batches):
        books, radii, sizes, places = shared.value
        cells = Cells(books, radii, sizes)
        for batch in batches:
            vectors = matrix(batch.column("vec"), dim) if dim else np.zeros((batch.num_rows, 0))
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("block", "rid", "seen", "need", "top")]
            for vec, block, rid, seen, need, top in zip(vectors, *columns):
                wanted: dict[int, list[int]] = {}
                covered, at, bound = 0, 0, None
                for at, (bound, low, cell) in enumerate(cells.visit(vec)):
                    if (need is not None and bound < need) or covered >= rows:
                        break
                    if at < seen or (top is not None and low > top):
                        continue
                    covered += sizes[cell]
                    first, pages = places[cell]
                    for page in range(first, first + pages):
                        wanted.setdefault(page, []).append(cell)
                else:
                    at, bound = len(sizes), None
                if need is not None and bound is not None and bound < need:
                    bound = None  # certified
                for page, some in wanted.items():
                    out.append((block, page, rid, some, at, bound))
                out.append((block, -1, rid, [], at, bound))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.float64()))], names=names)
    return run


def _best(score: np.ndarray, ids: np.ndarray, rid: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best allowed rows."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        edge = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= edge]
    return at[np.lexsort((rid[at], ids[at], -score[at]))[:k]]


def _scorer(dim: int, negatives: bool):
    """Best rows of one page for the anchors of one block that visit it.

    For positives a row is (anchor, 0, score, row); for negatives there is one
    list for each of the anchor's windows."""
    names = ["anchor", "window", "score", "row", "row_id"]

    def run(rows, asked):
        rows, asked = rows.combine_chunks(), asked.combine_chunks()
        out = []
        if rows.num_rows and asked.num_rows:
            cell, rid, label = (rows[c].to_numpy() for c in ("cell", "rid", "label"))
            ids = rows["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
            x = matrix(rows["vec"].combine_chunks(), dim) if dim else np.zeros((rows.num_rows, 0))
            q = matrix(asked["vec"].combine_chunks(), dim) if dim else np.zeros((asked.num_rows, 0))
            exact = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(dim, 1) < 2 ** 53
            known, at_cell = np.unique(cell, return_inverse=True)
            lists, anchors, labels = (asked[c].to_pylist() for c in ("cells", "anchor", "label"))
            needs, windows = asked["need"].to_pylist(), asked["windows"].to_pylist()  # (least, most) of each
            step = max(1, SCORED // rows.num_rows)
            for start in range(0, len(anchors), step):
                part = q[start:start + step]
                scores = (part @ x.T).astype(np.int64) if exact else part.astype(np.int64) @ x.T.astype(np.int64)
                for i, score in enumerate(scores, start):
                    visited = np.isin(known, lists[i])[at_cell]
                    if needs[i] is not None:
                        visited &= score >= needs[i]
                    if negatives:
                        allowed = visited & (label != labels[i])
                        for w, top in enumerate(windows[i]):
                            best = _best(score, ids, rid, allowed & (score <= top["most"]) & (score >= top["least"]), NEGATIVES)
                            out += [(anchors[i], w, int(score[b]), int(rid[b]), b) for b in best]
                    else:
                        best = _best(score, ids, rid, visited & (label == labels[i]) & (rid != anchors[i]), POSITIVES)
                        out += [(anchors[i], 0, int(score[b]), int(rid[b]), b) for b in best]
        columns = list(zip(*out)) or [[]] * 5
        vec_id = rows["vec_id"].take(pa.array(columns[4], pa.int64())).combine_chunks() if out else pa.array([], pa.int64())
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()),
                                     pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), vec_id], names=names)
    return run


# -- rounds --------------------------------------------------------------------------

class Index:
    """Rows of one vector length in pages, and the cells for the heap."""

    def __init__(self, rows: DataFrame, dim: int, staging: Staging, name: str):
        self.dim, self.staging, self.spark = dim, staging, rows.sparkSession
        sample = (rows.orderBy(F.xxhash64("rid"), "rid").limit(max(WORDS, FIT_VALUES // max(dim, 1)))
                  .select("vec").toArrow())
        fitted = matrix(sample["vec"].combine_chunks(), dim) if dim else np.zeros((sample.num_rows, 0))
        books = [codebook(part, WORDS, seed) for seed, part in enumerate(halves(fitted))]
        shared = self.spark.sparkContext.broadcast(books)

        def place(batches):
            for batch in batches:
                x = matrix(batch.column("vec"), dim) if dim else np.zeros((batch.num_rows, 0))
                near, far = [], []
                for part, book in zip(halves(x), shared.value):
                    near.append(nearest(part, book))
                    far.append(np.sqrt(((part - book[near[-1]]) ** 2).sum(axis=1)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array((near[0] * len(shared.value[1]) + near[1]).astype(np.int32)),
                     *map(pa.array, far)], names=[*batch.schema.names, "cell", "far0", "far1"])

        columns = "rid long, vec_id long, label long, vec array<int>"
        placed = staging.write(rows.select("rid", "vec_id", "label", "vec")
                               .mapInArrow(place, columns + ", cell int, far0 double, far1 double"), f"placed-{name}")
        # At most WORDS ** 2 cells.
        found = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far0").alias("far0"),
                                           F.max("far1").alias("far1")).collect()
        sizes = {r["cell"]: r["n"] for r in found}
        radii = [np.zeros(len(book)) for book in books]
        for r in found:
            words = divmod(r["cell"], len(books[1]))
            for radius, word, far in zip(radii, words, (r["far0"], r["far1"])):
                radius[word] = max(radius[word], far * (1 + 1e-9) + 1e-6)
        places, _ = layout(sizes, PAGE_ROWS)
        self.shared = self.spark.sparkContext.broadcast((books, radii, sizes, places))
        # At most WORDS ** 2 rows of three numbers.
        pages = F.broadcast(self.spark.createDataFrame([(c, *p) for c, p in places.items()], "cell int, first int, pages int"))
        salt = F.pmod(F.xxhash64(F.lit("page"), F.col("rid")), F.col("pages"))
        self.rows = staging.write(placed.drop("far0", "far1").join(pages, "cell")
                                  .withColumn("page", (F.col("first") + salt).cast("int")).drop("first", "pages"), f"rows-{name}")
        staging.drop(f"placed-{name}")

    def round(self, anchors: DataFrame, rows: int, negatives: bool) -> tuple[DataFrame, DataFrame]:
        """What the anchors visit next, and the candidates found there.

        ``anchors``: block, rid, label, vec, seen, need, top, windows."""
        # The anchors' files are few: spread the heaps over all cores.
        spread = anchors.repartition(self.spark.sparkContext.defaultParallelism, "rid")
        plan = self.staging.write(spread.mapInArrow(
            _planner(self.shared, self.dim, rows),
            "block int, page int, anchor long, cells array<int>, next_seen long, next_bound double"), "plan")
        visits = plan.filter("page >= 0").select("block", "page", "anchor", "cells")
        asked = visits.join(anchors.select(F.col("rid").alias("anchor"), "label", "vec", "need", "windows"), "anchor")
        units = visits.select("page", F.col("block").alias("of_block")).distinct()
        met = self.rows.join(units, "page").withColumnRenamed("page", "of_page")
        found = self.staging.write(
            met.groupBy("of_page", "of_block").cogroup(asked.groupBy("page", "block"))
            .applyInArrow(_scorer(self.dim, negatives), "anchor long, window int, score long, row long, row_id long"), "found")
        return plan.filter("page < 0").select("anchor", "next_seen", "next_bound"), found

    def search(self, anchors: DataFrame, k: int, negatives: bool, name: str) -> DataFrame:
        """The ``k`` best rows of each anchor and window: anchor, window, score, row, row_id, place."""
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("row_id"), "row")
        budget, best = FIRST_ROWS, None
        state = self.staging.write(anchors.withColumn("seen", F.lit(0).cast("long")), f"state-{name}")
        while state.count():
            step, found = self.round(state, budget, negatives)
            budget *= GROWTH
            both = found if best is None else best.drop("place").unionByName(found)
            best = self.staging.write(both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k),
                                      f"best-{name}")
            # A window needs rows over its k-th score, or over its own least one.
            last = best.filter(F.col("place") == k).select("anchor", "window", F.col("score").alias("kth"))
            asked = (state.select(F.col("rid").alias("anchor"), F.posexplode("windows").alias("window", "of"))
                     .select("anchor", "window", "of.least") if negatives
                     else state.select(F.col("rid").alias("anchor"), F.lit(0).alias("window"), F.lit(None).cast("long").alias("least")))
            need = (asked.join(last, ["anchor", "window"], "left").groupBy("anchor")
                    .agg(F.min(F.coalesce("kth", "least")).alias("known"),
                         F.max(F.coalesce("kth", "least").isNull()).alias("open")))
            left = (step.join(need, "anchor")
                    .withColumn("need", F.when(~F.col("open"), F.col("known")))
                    .filter("next_bound IS NOT NULL AND (need IS NULL OR next_bound >= need)"))
            state = self.staging.write(
                state.drop("seen", "need").join(left.select(F.col("anchor").alias("rid"), F.col("next_seen").alias("seen"), "need"), "rid"),
                f"state-{name}")
        return best if best is not None else self.spark.createDataFrame(
            [], "anchor long, window int, score long, row long, row_id long, place int")


def _one_length(rows: DataFrame, dim: int, staging: Staging, name: str) -> DataFrame:
    index = Index(rows, dim, staging, name)
    anchors = rows.filter(F.pmod("vec_id", F.lit(ANCHOR_STEP)) == 0)
    blocks = max(1, -(-anchors.count() // ANCHOR_ROWS))
    none = F.lit(None).cast("long")
    start = staging.write(
        anchors.select("rid", "label", "vec", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"))
        .withColumns({"need": none, "top": none, "windows": F.array().cast("array<struct<most:bigint,least:bigint>>")}),
        f"anchors-{name}")
    positives = index.search(start, POSITIVES, False, f"positives-{name}")
    # A positive under 0 has an empty window. Equal scores share a window.
    window = F.struct(F.col("score").alias("most"), F.expr(LEAST.format("score")).alias("least"))
    scores = (positives.filter("score >= 0").groupBy(F.col("anchor").alias("rid"))
              .agg(F.array_sort(F.collect_set(window)).alias("windows"), F.max("score").alias("top")))  # 5 at most
    asked = (start.drop("top", "windows", "need").join(scores, "rid")
             .withColumn("need", F.col("windows")[0]["least"]))
    negatives = index.search(staging.write(asked, f"asked-{name}"), NEGATIVES, True, f"negatives-{name}")
    windows = staging.write(asked.select(F.col("rid").alias("anchor"), F.posexplode("windows").alias("window", "of"))
                            .select("anchor", "window", F.col("of.most").alias("score")), f"windows-{name}")
    ids = start.select(F.col("rid").alias("anchor")).join(rows.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    pairs = (positives.select("anchor", "score", F.col("row_id").alias("positive_id")).join(windows, ["anchor", "score"])
             .withColumnRenamed("score", "positive_score"))
    hits = negatives.select("anchor", "window", F.col("place").cast("int").alias("rank"), F.col("row_id").alias("negative_id"),
                            F.col("score").alias("negative_score"))
    return (pairs.join(hits, ["anchor", "window"]).join(ids, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def mine_hard_negatives(vectors: DataFrame) -> DataFrame:
    """One row per anchor, positive and negative, by rank."""
    spark: SparkSession = vectors.sparkSession
    staging = Staging(spark, "negatives")
    finite = "forall(vec, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))"
    rows = staging.write(
        vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"),
                       F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
        .filter(f"label IS NOT NULL AND vec IS NOT NULL AND {finite}")
        .withColumn("label", F.when(F.col("vec_id") % RELABEL_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
        .withColumn("vec", F.expr(f"transform(vec, v -> CAST(floor(greatest(least({SCALE} * v, double({LARGEST})), double(-{LARGEST}))) AS int))")),
        "rows").withColumn("dim", F.size("vec"))
    out = spark.createDataFrame([], RESULT)
    for i, r in enumerate(rows.select("dim").distinct().orderBy("dim").collect()):  # lengths of embeddings are few
        out = out.unionByName(_one_length(rows.filter(F.col("dim") == r["dim"]).drop("dim"), r["dim"], staging, str(i)))
    return out
