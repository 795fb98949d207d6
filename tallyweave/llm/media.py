"""Copies of images, also cropped or edited ones, by local binary descriptors.

An image is a binary PGM value (P5).  Corners are found on several scales, each gets the
direction of its patch's centre of brightness, and 256 comparisons of pixel pairs, turned into
that direction, make its descriptor.  Descriptors are looked up through eight tables of 32
bits each: two of them that agree in any table are compared by Hamming distance.  The pairs
of a query and an image must then agree on one similarity transform; the number of corners
that do is the evidence for a copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import key_filter, passes, stored

SCALES = (1.0, 0.75, 0.5625)
CORNERS = 32  # the strongest of each scale and cell
CELL = 56  # pixels; a side has one cell less than these fit, one at least
RADIUS, REACH = 13, 15  # of a descriptor's patch, and how far it is from the image's border at least
TABLES = 8
TURNS = 32  # directions
DISTANCE = 56  # of 256 bits
INLIERS = 8


def pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def pixels_of(image: bytes | None) -> np.ndarray:
    """The grey values of a PGM image; anything else is an image without pixels."""
    try:
        parts, at = [], 0
        while len(parts) < 4:
            end = min(e for e in (image.find(b"\n", at), image.find(b" ", at)) if e >= 0)
            parts.append(image[at:end])
            at = end + 1
        width, height = int(parts[1]), int(parts[2])
        if parts[0] != b"P5" or int(parts[3]) > 255 or len(image) - at < width * height:
            raise ValueError("not a PGM image")
        return np.frombuffer(image, dtype=np.uint8, count=width * height, offset=at).reshape(height, width)
    except (ValueError, AttributeError):
        return np.zeros((0, 0), dtype=np.uint8)


def _pattern() -> np.ndarray:
    """For each direction the offsets (y, x) of both ends of the 256 tests, spread over a disc."""
    rng = np.random.default_rng(17)
    away, around = RADIUS * np.sqrt(rng.random((256, 2))), 2 * np.pi * rng.random((256, 2))
    ends = np.stack([away * np.sin(around), away * np.cos(around)], axis=2)
    out = []
    for t in range(TURNS):
        a = 2 * np.pi * t / TURNS
        turn = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])  # on (y, x)
        out.append(np.rint(ends @ turn.T))
    return np.array(out).astype(np.int64)


_TESTS = _pattern()
_DISC = np.array([(y, x) for y in range(-7, 8) for x in range(-7, 8) if y * y + x * x <= 56])


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2r + 1 pixels, edges repeated: rows are added up, then columns."""
    h, w = a.shape
    tall = np.empty((h + 2 * r, w))
    tall[r : r + h] = a
    tall[:r], tall[r + h :] = a[0], a[-1]
    wide = np.empty((h, w + 2 * r))
    middle = wide[:, r : r + w]
    np.add(tall[:h], tall[1 : h + 1], out=middle)
    for k in range(2, 2 * r + 1):
        middle += tall[k : k + h]
    wide[:, :r], wide[:, r + w :] = middle[:, :1], middle[:, -1:]
    out = wide[:, :w] + wide[:, 1 : w + 1]
    for k in range(2, 2 * r + 1):
        out += wide[:, k : k + w]
    out *= 1 / (2 * r + 1) ** 2
    return out


def _resized(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return a
    h, w = int(a.shape[0] * scale), int(a.shape[1] * scale)
    y, x = np.minimum((np.arange(h) + 0.5) / scale - 0.5, a.shape[0] - 1.001), np.minimum((np.arange(w) + 0.5) / scale - 0.5, a.shape[1] - 1.001)
    y0, x0 = np.maximum(y.astype(int), 0), np.maximum(x.astype(int), 0)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x0 + 1] * fx
    low = a[y0 + 1][:, x0] * (1 - fx) + a[y0 + 1][:, x0 + 1] * fx
    return top * (1 - fy) + low * fy


def _strongest(strength: np.ndarray, y: np.ndarray, x: np.ndarray, shape: tuple[int, int], cells: tuple[int, int]) -> np.ndarray:
    """The places of the CORNERS strongest corners of each cell, the strongest first."""
    order = np.argsort(-strength, kind="stable")
    cell = (y * cells[0] // shape[0] * cells[1] + x * cells[1] // shape[1])[order]
    by_cell = np.argsort(cell, kind="stable")
    firsts = np.searchsorted(cell[by_cell], cell[by_cell])
    return order[np.sort(by_cell[np.arange(len(cell)) - firsts < CORNERS])]


def describe(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors (corners, 32 bytes) and geometry (corners: y, x, scale number, direction number)."""
    bits, places = [], []
    for level, scale in enumerate(SCALES):
        if min(pixels.shape) * scale < 2 * REACH + 3:
            break
        a = _resized(pixels.astype(np.float64), scale)
        gy, gx = np.gradient(_box(a, 1))
        yy, xx, xy = _box(gy * gy, 2), _box(gx * gx, 2), _box(gy * gx, 2)
        strength = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
        h, w = a.shape
        inner = strength[REACH : h - REACH, REACH : w - REACH]
        peak = inner > 1.0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    other = strength[REACH + dy : h - REACH + dy, REACH + dx : w - REACH + dx]
                    peak &= (inner > other) if (dy, dx) < (0, 0) else (inner >= other)
        y, x = np.nonzero(peak)
        cells = max(1, pixels.shape[0] // CELL - 1), max(1, pixels.shape[1] // CELL - 1)
        best = _strongest(inner[y, x], y + REACH, x + REACH, a.shape, cells)
        y, x = y[best] + REACH, x[best] + REACH
        if not len(y):
            continue
        disc = a[y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
        angle = np.arctan2(*np.einsum("nk,kc->cn", disc, _DISC, optimize=False))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        smooth = _box(a, 1)
        ends = _TESTS[turn]
        first, second = ends[:, :, 0], ends[:, :, 1]
        test = smooth[y[:, None] + first[..., 0], x[:, None] + first[..., 1]] < smooth[y[:, None] + second[..., 0], x[:, None] + second[..., 1]]
        bits.append(np.packbits(test, axis=1))
        places.append(np.stack([(y + 0.5) / scale, (x + 0.5) / scale, np.full(len(y), level), turn], axis=1))
    if not bits:
        return np.zeros((0, 32), np.uint8), np.zeros((0, 4))
    return np.concatenate(bits), np.concatenate(places)


def table_keys(descriptors: np.ndarray) -> np.ndarray:
    """(corners, TABLES): the table's number and its 32 bits."""
    words = np.ascontiguousarray(descriptors).view(">u4").astype(np.int64)
    return words | np.arange(TABLES, dtype=np.int64) << 32


def consensus(matches: np.ndarray) -> int:
    """The most corners that agree on one similarity transform.

    matches: rows (query corner, image corner, query y, x, scale, direction, image y, x, scale, direction).
    Each match proposes a turn, a scaling and a shift; another agrees if it lands within a few
    pixels with about the same turn and scaling.  Directions and scales are numbers of coarse
    steps, so a match also proposes, with each match that has about the same ones, the turn and
    scaling that take the one's corners to the other's.  Every corner counts once.
    """
    best = 0
    q, t = matches[:, 2:6], matches[:, 6:10]
    turn = (t[:, 3] - q[:, 3]) % TURNS
    level = t[:, 2] - q[:, 2]
    here, there = q[:, 1] + 1j * q[:, 0], t[:, 1] + 1j * t[:, 0]  # x + iy
    for k in range(len(matches)):
        gap = np.abs((turn - turn[k] + TURNS // 2) % TURNS - TURNS // 2)
        alike = np.flatnonzero((gap <= 2) & (level == level[k]))
        own = matches[alike]
        if min(len(set(own[:, 0].tolist())), len(set(own[:, 1].tolist()))) <= best:
            continue  # no proposal of this match can do better
        size = SCALES[1] ** -level[k]
        step = np.exp(2j * np.pi * turn[k] / TURNS) * size
        proposed = [np.array([step])]
        if turn[k] in (1, TURNS - 1):
            proposed.append(np.array([size + 0j]))  # direction numbers are often one off
        away, moved = here[alike] - here[k], there[alike] - there[k]
        far = np.abs(away) >= 8.0
        pairs = moved[far] / away[far]
        change = pairs / step
        proposed.append(pairs[(np.abs(np.abs(change) - 1) < 0.2) & (np.abs(np.angle(change)) < 3 * np.pi / TURNS)])
        for z in np.concatenate(proposed):
            fits = np.abs(there[k] + away * z - there[alike]) < 3.0
            if fits.sum() > best:
                best = max(best, min(len(set(own[fits, 0].tolist())), len(set(own[fits, 1].tolist()))))
    return best


ROW = "key long, {id} long, corner int, bits binary, y double, x double, level double, turn double"


def _corner_rows(images: DataFrame, name: str, words=None) -> DataFrame:
    """A row for each corner and table; with ``words``, a filter of fixed size, only those whose key may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if words is None else words.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                columns = [[] for _ in range(8)]
                for number, image in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    bits, places = describe(pixels_of(image.as_py()))
                    keys = table_keys(bits)
                    keep = np.ones(keys.shape, dtype=bool) if wanted is None else passes(wanted, keys.reshape(-1)).reshape(keys.shape)
                    corner, table = np.nonzero(keep)
                    raw = [b.tobytes() for b in bits]
                    for column, values in zip(columns, (keys[corner, table], np.full(len(corner), number), corner, [raw[c] for c in corner], *places[corner].T), strict=True):
                        column.extend(values)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", name, "corner", "bits", "y", "x", "level", "turn"])

    return images.mapInArrow(run, ROW.format(id=name))


def find_copies(images: DataFrame, queries: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """(query_id, image_id, matches, inliers) of the images that hold (part of) a query's picture.

    Both tables have an id and a PGM column; rows with a null id or image, and images too small
    for a corner, match nothing.  Equal images should be passed once (see ``image_classes``).
    Queries' table keys go into a filter of fixed size that is broadcast; images' corners that
    pass it are joined with the queries' by key, compared, and grouped by (query, image).
    """
    spark = images.sparkSession
    q = stored(_corner_rows(queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), image_col), "query_id"), "query-corners")

    held = spark.sparkContext.broadcast(key_filter(q.select("key")))
    own = images.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), image_col)
    t = _corner_rows(own, "image_id", held)
    names = ("corner", "bits", "y", "x", "level", "turn")
    pairs = q.select("key", "query_id", *(F.col(c).alias(f"q_{c}") for c in names)).join(t.select("key", "image_id", *(F.col(c).alias(f"t_{c}") for c in names)), "key")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), dtype=np.uint8).reshape(-1, 32) for c in ("q_bits", "t_bits")]
            distance = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1)
            yield batch.filter(pa.array(distance <= DISTANCE)).drop_columns(["key", "q_bits", "t_bits"])

    kept = pairs.mapInArrow(close, "query_id long, q_corner int, q_y double, q_x double, q_level double, q_turn double, image_id long, t_corner int, t_y double, t_x double, t_level double, t_turn double").dropDuplicates(["query_id", "image_id", "q_corner", "t_corner"])
    columns = [f"{s}_{c}" for s in "qt" for c in ("y", "x", "level", "turn")]
    grouped = kept.groupBy("query_id", "image_id").agg(F.collect_list(F.array(F.col("q_corner").cast("double"), F.col("t_corner").cast("double"), *columns)).alias("m")).where(F.size("m") >= INLIERS)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().flatten().to_numpy().reshape(-1, 10)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            votes = np.array([consensus(flat[ends[k] : ends[k + 1]]) for k in range(len(sizes))], dtype=np.int64)
            fine = pa.array(votes >= INLIERS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)), pa.array(votes)], names=["query_id", "image_id", "matches", "inliers"]).filter(fine)

    return grouped.mapInArrow(agree, "query_id long, image_id long, matches long, inliers long")


def image_classes(images: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """(image_id, class_id, image_hash): class_id is the smallest id of an equal image; null images are a class of their own each."""
    hashed = images.select(F.col(id_col).cast("long").alias("image_id"), F.sha2(image_col, 256).alias("image_hash"))
    least = hashed.where("image_hash is not null").groupBy("image_hash").agg(F.min("image_id").alias("class_id"))
    return hashed.join(least, "image_hash", "left").select("image_id", F.coalesce("class_id", "image_id").alias("class_id"), "image_hash")


SIZE = 112


def render(vector: list[float] | None) -> bytes | None:
    """A textured picture that a vector determines: the tables hold no images, so queries draw them."""
    if vector is None:
        return None
    raw = np.asarray([0.0 if v is None else v for v in vector], dtype="<f4").tobytes()
    seed = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    rng = np.random.default_rng(seed)
    a = np.zeros((SIZE, SIZE))
    for cells, height in ((8, 50), (20, 90), (40, 115)):  # texture, coarse to fine
        a += _resized(rng.uniform(0, height, (cells, cells)), SIZE / cells)
    return pgm(np.clip(_box(a, 1), 0, 255))


def edited(image: bytes, share: float = 0.75) -> bytes:
    """A cropped, relit and noisy copy of an image; its own bytes decide the details."""
    a = pixels_of(image).astype(np.float64)
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(image, digest_size=8).digest(), "big"))
    h, w = int(a.shape[0] * share), int(a.shape[1] * share)
    y, x = int(rng.integers(0, a.shape[0] - h + 1)), int(rng.integers(0, a.shape[1] - w + 1))
    a = a[y : y + h, x : x + w]
    a = a * rng.uniform(0.8, 1.1) + rng.uniform(-15, 15) + rng.normal(0, 2, a.shape)
    return pgm(np.clip(a, 0, 255))


def rendered(vectors: DataFrame, copies: bool = False) -> DataFrame:
    """(image_id, image) from rows (id, vector); with ``copies`` the edited ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                images = [render(v) for v in part.column(1).to_pylist()]
                if copies:
                    images = [None if i is None else edited(i) for i in images]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(images, pa.binary())], names=["image_id", "image"])

    return vectors.mapInArrow(run, "image_id long, image binary")


def drawn_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50) -> DataFrame:
    """Draws each vector's picture, edits a copy of every ``every``-th one, and looks for their originals among all pictures.

    One row for each vector: vec_id, class_id (the smallest id of an equal picture), query_id
    (for rows whose id is divisible by ``every``: the smallest such id of the class, under which
    its edited copy was searched) and found, the classes (class_id, inliers) that the copy was
    found in, best first.  A null vector has no picture: it is its own class and finds nothing.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    classes = stored(image_classes(rendered(own)).select("image_id", "class_id"), "image-classes")
    firsts = classes.where("image_id = class_id").select(F.col("image_id").alias("vec_id")).distinct()
    asked = classes.where(F.col("image_id") % every == 0).groupBy("class_id").agg(F.min("image_id").alias("query_id"))
    images = rendered(own.join(firsts, "vec_id", "left_semi").dropDuplicates(["vec_id"]))
    queries = rendered(own.join(asked.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").dropDuplicates(["vec_id"]), copies=True)
    matches = find_copies(images, queries).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("inliers")).alias("by"), F.col("image_id").alias("class_id"), "inliers"))).alias("best"))
    found = matches.select("query_id", F.transform("best", lambda x: F.struct(x["class_id"].alias("class_id"), x["inliers"].alias("inliers"))).alias("found"))
    # Only rows that are queries meet the answers.
    is_query = F.coalesce(F.col("image_id") % every == 0, F.lit(False))
    answered = classes.where(is_query).join(asked, "class_id", "left").join(found, "query_id", "left").select("image_id", "class_id", "query_id", "found")
    others = classes.where(~is_query).select("image_id", "class_id", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast(found.schema["found"].dataType).alias("found"))
    return answered.union(others).withColumnRenamed("image_id", "vec_id")
