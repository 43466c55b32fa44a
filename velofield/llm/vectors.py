"""Near-duplicate embeddings by int8 tile products (operator 7)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velofield.llm.shared import checkpointed, connected_components, partitions, ranked

#: Vectors of a tile's side, and blocks whose distance is looked at together before that of each two.
TILE, SUPER = 2048, 32
#: Vectors that the order of vectors is laid out by: one for so many blocks, between these bounds.
PIVOT_BLOCKS, PIVOTS = 4, (64, 1024)
_SLACK, _FINE_SLACK = 1e-6, 1e-10


def quantise(x: np.ndarray, kind: type = np.int8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, norm of what the codes miss) of vectors: each is scale * codes + rest, |rest| = miss."""
    most = np.iinfo(kind).max
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / most
    codes = np.rint(x / scale[:, None]).astype(kind)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1) + 1e-12


def encode(unit: np.ndarray) -> dict[str, np.ndarray]:
    """Int8 codes q, scales s and errors e of unit vectors, and finer q2, s2, e2 of what these codes miss."""
    q, s, e = quantise(unit)
    q2, s2, e2 = quantise(unit - q * s[:, None], np.int16)
    return {"q": q, "s": s, "e": e, "q2": q2, "s2": s2, "e2": e2}


def tile_links(a: dict, b: dict, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of the pairs surely linked, and of those that full precision must decide.

    With x = s q + e for both vectors, |x.y - s s' q.q'| <= |e| (1 + |e'|) + |e'| (1 + |e|) + |e| |e'|: the products of
    codes are whole numbers, exact in the type used, so the bound holds for every pair. Pairs whose bounds contain the
    threshold get a second bound from the codes of both steps, which is thousands of times closer.
    """
    kind = np.float32 if a["q"].shape[1] * 127 * 127 < 1 << 24 else np.float64
    dot = a["q"].astype(kind) @ b["q"].astype(kind).T
    worst = a["e"].max() * (1 + b["e"].max()) + b["e"].max() * (1 + a["e"].max()) + a["e"].max() * b["e"].max()
    dot *= a["s"].astype(kind)[:, None]
    i, j = np.nonzero(dot >= ((threshold - worst - 1e-4) / b["s"]).astype(kind)[None, :])
    if same:
        i, j = i[i != j], j[i != j]
    value = np.zeros(len(i))
    for at in range(0, len(i), 1 << 17):
        x, y = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
        value[at : at + (1 << 17)] = np.einsum("ij,ij->i", a["q"][x].astype(np.int32), b["q"][y].astype(np.int32)) * a["s"][x] * b["s"][y]
    ea, eb = a["e"][i], b["e"][j]
    bound = ea * (1 + eb) + eb * (1 + ea) + ea * eb + _SLACK
    sure, open_ = value - bound >= threshold, (value + bound >= threshold) & (value - bound < threshold)
    i_sure, j_sure, i, j = [i[sure]], [j[sure]], i[open_], j[open_]
    i_open, j_open = [i[:0]], [j[:0]]
    for at in range(0, len(i), 1 << 15):
        x, y = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        full = [t["q"][k] * t["s"][k][:, None] + t["q2"][k] * t["s2"][k][:, None] for t, k in ((a, x), (b, y))]
        value, ea, eb = np.einsum("ij,ij->i", *full), a["e2"][x], b["e2"][y]
        bound = ea * (1 + eb) + eb * (1 + ea) + ea * eb + _FINE_SLACK
        sure, open_ = value - bound >= threshold, (value + bound >= threshold) & (value - bound < threshold)
        i_sure.append(x[sure])
        j_sure.append(y[sure])
        i_open.append(x[open_])
        j_open.append(y[open_])
    return tuple(np.concatenate(v) for v in (i_sure, j_sure, i_open, j_open))


def _forest(i: np.ndarray, j: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, smallest vector of its component) for the vectors that the links of one tile touch."""
    ids, at = np.unique(np.concatenate([ids_a[i], ids_b[j]]), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors whose cosine with another is at least ``threshold``: vec_id, n_links, component_id, kept.

    Equal vectors form one class. Classes are laid out by their nearest of some pivots and cut into blocks; each pair of
    blocks is one tile, unless the centres of the blocks, or of the groups of neighbouring blocks they are in, are too far
    apart for any link. A tile multiplies int8 codes; quantisation error bounds decide most pairs, finer codes most of the
    rest, and only pairs whose finer bounds contain the threshold are computed in double precision. A
    tile returns each vector's number of links and its spanning links, not all pairs; components come from these.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors link only with
    vectors of their own length; each repeated row counts as a vector of its own; rows with a null id link nothing and stay
    null; an empty table gives an empty one; other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(F.exists("v", bad), F.lit(True)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    classes = checkpointed(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("v")))
    wanted = min(max(classes.count() // (PIVOT_BLOCKS * tile), PIVOTS[0]), PIVOTS[1])
    pivots = [np.array(r["v"]) for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(wanted).collect()]
    if not pivots:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    by_dim = {d: np.array([p / np.abs(p).max() for p in pivots if len(p) == d]) for d in {len(p) for p in pivots}}

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(3).to_numpy(zero_copy_only=False)
            near, close = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for dim, p in by_dim.items():
                own = np.flatnonzero(size == dim)
                if len(own):
                    x = _matrix(batch.column(1).take(pa.array(own)), dim)
                    c = (x / np.abs(x).max(axis=1, keepdims=True)) @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T
                    near[own], close[own] = c.argmax(axis=1), c.max(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(near), pa.array(close)], names=["rep", "v", "copies", "dim", "near", "close"])

    laid = classes.select("rep", "v", "copies", "dim").mapInArrow(lay, "rep long, v array<double>, copies long, dim int, near int, close double")
    blocks = ranked(laid, "dim", "near", "close", "rep").select("rep", "v", "copies", "dim", F.floor(F.col("rank") / tile).cast("long").alias("block"))

    def code(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v").combine_chunks(), table.column("dim")[0].as_py())
        x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        mean, radius = _ball(x, np.zeros(len(x)))
        cells = {"block": table.column("block")[0].as_py(), "dim": x.shape[1], "centre": mean, "radius": radius}
        cells |= {n: np.ascontiguousarray(table.column(n).to_numpy().astype("<i8")).tobytes() for n in ("rep", "copies")} | {n: v.tobytes() for n, v in encode(x).items()}
        return pa.Table.from_pylist([cells], schema=packed)

    data = ["rep", "copies", "q", "s", "e", "q2", "s2", "e2"]
    packed = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())] + [(n, pa.binary()) for n in data])
    coded = checkpointed(blocks.groupBy("block", "dim").applyInArrow(lambda t: code(t), "block long, dim int, centre array<double>, radius double, " + ", ".join(f"{n} binary" for n in data)))
    outline = coded.select(F.floor(F.col("block") / SUPER).cast("long").alias("super"), "block", "dim", "centre", "radius")

    def surround(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        mean, radius = _ball(_matrix(table.column("centre").combine_chunks(), dim), table.column("radius").to_numpy())
        return pa.table({"super": table.column("super")[:1], "dim": table.column("dim")[:1], "centre": pa.array([mean], pa.list_(pa.float64())), "radius": [radius]})

    supers = checkpointed(outline.groupBy("super", "dim").applyInArrow(lambda t: surround(t), "super long, dim int, centre array<double>, radius double"))
    other = lambda df, at: df.select(F.col(at).alias(f"_{at}"), "dim", F.col("centre").alias("_centre"), F.col("radius").alias("_radius"))
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.aggregate(F.zip_with("centre", "_centre", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y))))
    meet = apart - F.col("radius") - F.col("_radius") <= math.acos(threshold) + 1e-6
    count = supers.agg(F.max("super").alias("n")).first()["n"] + 1
    # Each group meets itself and the half of the others that follows it on a ring, so all have as many partners.
    ring = supers.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(count // 2)))).withColumn("_super", (F.col("super") + F.col("_k")) % count)
    ring = ring.where(F.lit(count % 2 == 1) | (F.col("_k") < F.lit(count // 2)) | (F.col("_k") == 0) | (F.col("super") < F.col("_super")))
    groups = ring.join(other(supers, "super"), ["_super", "dim"]).where(meet).select("super", "_super", "dim")
    second = other(outline.drop("super"), "block").withColumn("_super", F.floor(F.col("_block") / SUPER).cast("long"))
    tiles = groups.join(outline, ["super", "dim"]).join(second, ["_super", "dim"]).where((F.col("super") != F.col("_super")) | (F.col("block") <= F.col("_block")))
    tiles = tiles.where(meet).select("block", "_block", "dim")
    left = coded.select("block", "dim", F.struct(*data).alias("a"))
    right = coded.select(F.col("block").alias("_block"), "dim", F.struct(*data).alias("b"))
    met = tiles.join(left, ["block", "dim"]).join(right, ["_block", "dim"]).select("block", "_block", "dim", "a", "b")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same, dim = batch.column(0)[row].as_py() == batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                a, b = (_unpack(batch.column(k)[row].as_py(), dim) for k in (3, 4))
                i, j, oi, oj = tile_links(a, b, threshold, same)
                parts = []  # kind, x, y, n, m: links of x; a spanning link of x and y; a pair of n and m copies to decide
                if len(i):
                    parts.append((0, a["rep"], a["rep"], np.bincount(i, b["copies"][j], len(a["rep"])), None))
                    if not same:
                        parts.append((0, b["rep"], b["rep"], np.bincount(j, a["copies"][i], len(b["rep"])), None))
                    parts.append((1, *_forest(i, j, a["rep"], b["rep"]), None, None))
                if same:
                    oi, oj = oi[oi < oj], oj[oi < oj]
                parts.append((2, a["rep"][oi], b["rep"][oj], a["copies"][oi], b["copies"][oj]))
                for kind, x, y, n, m in parts:
                    keep = np.ones(len(x), bool) if kind == 2 else n > 0 if kind == 0 else x != y
                    cells = [np.zeros(len(x)) if v is None else v for v in (x, y, n, m)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), kind, np.int32)), *(pa.array(v[keep].astype(np.int64)) for v in cells)], names=["kind", "x", "y", "n", "m"])

    found = checkpointed(met.mapInArrow(multiply, "kind int, x long, y long, n long, m long"))
    full = classes.select("rep", "v")
    near = found.where("kind = 2").join(full.toDF("x", "vx"), "x").join(full.toDF("y", "vy"), "y")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
    unit = lambda v: F.transform(v, lambda p: p / F.array_max(F.transform(v, F.abs)))
    near = near.withColumn("vx", unit(F.col("vx"))).withColumn("vy", unit(F.col("vy")))
    near = near.where(dot(F.col("vx"), F.col("vy")) / (F.sqrt(dot(F.col("vx"), F.col("vx"))) * F.sqrt(dot(F.col("vy"), F.col("vy")))) >= threshold).select("x", "y", "n", "m")
    near = checkpointed(near)
    counts = found.where("kind = 0").select("x", "n").union(near.select("x", F.col("m"))).union(near.select("y", F.col("n"))).groupBy(F.col("x").alias("rep")).agg(F.sum("n").alias("n"))
    edges = found.where("kind = 1").select("x", "y").union(near.select("x", "y"))
    parts = connected_components(edges)
    by_class = classes.select("v", "rep", "copies").join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(by_class, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _unpack(cells: dict, dim: int) -> dict[str, np.ndarray]:
    """The arrays of a packed block."""
    kinds = {"rep": "<i8", "copies": "<i8", "q": np.int8, "q2": "<i2"}
    found = {n: np.frombuffer(x, kinds.get(n, "<f8")) for n, x in cells.items()}
    return found | {n: found[n].reshape(-1, dim) for n in ("q", "q2")}


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _ball(x: np.ndarray, radius: np.ndarray) -> tuple[list[float], float]:
    """A unit vector near all of the unit vectors, and the largest angle to what lies ``radius`` around one of them."""
    mean = x.mean(axis=0)
    mean /= np.linalg.norm(mean) or 1.0
    return mean.tolist(), float((np.arccos(np.clip(x @ mean, -1, 1)) + radius).max())
