"""Zone maps and Bloom filters of table parts.

For each declared key (one column or several) of a part: least and greatest
value of every column, and a Bloom filter of the keys.  Both are built by
aggregation when the part is staged.  A filter has 24 bits a key and 8 hash
positions (about one false hit in 30,000 keys), in a power of two up to
``MAX_BITS``; beyond it there are more false hits, never a false miss.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY, HASHES, MIN_BITS, MAX_BITS = 24, 8, 1 << 10, 1 << 23
#: Rows of a part that is indexed in one job, and units whose bounds are tested before their filters are read.
SMALL, MANY = 20_000, 64
#: Filters that a task fills at once.
HELD = 32


def _hashes(key: Sequence[str]) -> list[Column]:
    """Two hashes of a key; the positions are their combinations.  Integers of
    any width hash alike."""
    wide = [F.col(c).cast("long") for c in key]
    return [F.xxhash64(*wide, F.lit(seed)).bitwiseAND(F.lit((1 << 60) - 1)) for seed in (1, 2)]


def _bits(rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (BITS_A_KEY * rows - 1).bit_length()))


def _places(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.concatenate([(a + k * b) & (bits - 1) for k in range(HASHES)])


def build(df: DataFrame, unit: Column, keys: Sequence[Sequence[str]]) -> dict[str, dict]:
    """unit (as text) -> rows, zones and filter of each key, of the rows of
    ``df``.  Of a part up to SMALL rows the driver gets the keys' hashes in one
    job; of a larger one a row of bounds per unit and the set words of the filters."""
    cols = sorted({c for k in keys for c in k})
    hashes = [h.alias(f"__{i}{n}") for i, k in enumerate(keys) for n, h in zip("ab", _hashes(k))]
    d = df.select(unit.alias("__unit"), *[F.col(c).cast("long").alias(c) for c in cols])
    if keys:
        few = d.select("__unit", *cols, *hashes).limit(SMALL + 1).toArrow()
        if few.num_rows <= SMALL:
            return _build_few(few, cols, keys)
    bounds = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]
    out = {}
    for r in d.groupBy("__unit").agg(F.count(F.lit(1)).alias("n"), *bounds).collect():
        out[r["__unit"]] = {"rows": r["n"], "zones": {c: [r[f"lo_{c}"], r[f"hi_{c}"]] for c in cols}, "filters": {}}
    if not out or not keys:
        return out
    bits = {u: _bits(x["rows"]) for u, x in out.items()}
    number = {u: i for i, u in enumerate(sorted(out))}
    at = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])[F.col("__unit")]
    sizes, n_keys, n_hashes, held = [bits[u] // 64 for u in sorted(out)], len(keys), HASHES, HELD

    def set_words(it):
        """The words that a task's rows set; it holds the filters of the units that its rows are of, HELD at most."""
        own = {}

        def flush():
            for (u, k), x in own.items():
                w = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), u * n_keys + k, np.int32)), pa.array(w.astype(np.int32)), pa.array(x[w])], names=["f", "w", "b"])
            own.clear()

        for b in it:
            unit_at = b.column(0).to_numpy()
            for u in np.unique(unit_at):
                rows = unit_at == u
                if len(own) >= held:
                    yield from flush()
                for k in range(n_keys):
                    if (u, k) not in own:
                        own[u, k] = np.zeros(sizes[u], np.int64)
                    one, two = (b.column(1 + 2 * k + j).to_numpy()[rows] for j in (0, 1))
                    for n in range(n_hashes):
                        p = (one + n * two) & (sizes[u] * 64 - 1)
                        np.bitwise_or.at(own[u, k], p >> 6, np.int64(1) << (p & 63))
        yield from flush()

    rows = d.select(at.alias("__at"), *hashes)
    t = rows.mapInArrow(set_words, "f int, w int, b long").groupBy("f", "w").agg(F.bit_or("b").alias("b")).toArrow()
    filters, places, values = (t.column(c).to_numpy() for c in ("f", "w", "b"))
    words = {(u, i): np.zeros(n // 64, np.int64) for u, n in bits.items() for i in range(n_keys)}
    for (u, i), x in words.items():
        own = filters == number[u] * n_keys + i
        x[places[own]] = values[own]
    for u in out:
        out[u]["filters"] = {",".join(k): words[u, i].tobytes() for i, k in enumerate(keys)}
    return out


def _build_few(t: pa.Table, cols: Sequence[str], keys: Sequence[Sequence[str]]) -> dict[str, dict]:
    out = {}
    names = np.array(t.column("__unit").to_pylist(), object)
    for u in sorted(set(names.tolist())):
        own = t.filter(pa.array(names == u))
        zones = {}
        for c in cols:
            have = own.column(c).drop_null().to_numpy()
            zones[c] = [int(have.min()), int(have.max())] if len(have) else [None, None]
        filters = {}
        for i, k in enumerate(keys):
            words = np.zeros(_bits(own.num_rows) // 64, np.int64)
            p = _places(own.column(f"__{i}a").to_numpy(), own.column(f"__{i}b").to_numpy(), len(words) * 64)
            np.bitwise_or.at(words, p >> 6, np.int64(1) << (p & 63))
            filters[",".join(k)] = words.tobytes()
        out[u] = {"rows": own.num_rows, "zones": zones, "filters": filters}
    return out


def units_that_may_hold(keys: DataFrame, key: Sequence[str], units: Sequence[tuple[dict, Callable[[], bytes]]]) -> list[int]:
    """Positions in ``units`` (zones, and what reads the filter) that may hold
    any row of ``keys``.  Keys with a null are in none.  Every key is tested in
    tasks against the zones and filters; of more than MANY units those out of
    the whole batch's bounds are left out first."""
    have = keys.select(*[F.col(c).cast("long").alias(c) for c in key]).dropna()
    left = list(enumerate(units))
    if len(left) > MANY:
        b = have.agg(*[f(c).alias(f"{n}_{c}") for c in key for n, f in (("lo", F.min), ("hi", F.max))]).first()
        meets = lambda z, c: z[0] is not None and z[0] <= b[f"hi_{c}"] and z[1] >= b[f"lo_{c}"]
        left = [] if b[0] is None else [(i, u) for i, u in left if all(meets(u[0][c], c) for c in key)]
    if not left:
        return []
    spark = keys.sparkSession
    shared = spark.sparkContext.broadcast([(i, [u[0][c] for c in key], np.frombuffer(u[1](), np.int64)) for i, u in left])  # at most MAX_BITS a unit

    def run(it):
        found: set[int] = set()
        for batch in it:
            a, b, *values = (batch.column(c).to_numpy() for c in range(batch.num_columns))
            for i, zones, words in shared.value:
                if i in found or any(z[0] is None for z in zones):
                    continue
                in_zone = np.ones(len(a), bool)
                for v, (lo, hi) in zip(values, zones):
                    in_zone &= (v >= lo) & (v <= hi)
                x, y = a[in_zone], b[in_zone]
                hit = np.ones(len(x), bool)
                for p in _places(x, y, len(words) * 64).reshape(HASHES, -1):
                    hit &= (words[p >> 6] >> (p & 63)) & 1 == 1
                if hit.any():
                    found.add(i)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["unit"])

    one, two = _hashes(key)
    rows = have.select(one.alias("__a"), two.alias("__b"), *key).mapInArrow(run, "unit long").collect()  # at most the units, once a task
    return sorted({r["unit"] for r in rows})
