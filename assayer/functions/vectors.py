"""Vectors over replicates, in NumPy over Arrow batches: sums of many rows' multiplicities at once.

A row's multiplicities come as a binary value, a byte for each replicate; here they are a row of a matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: of a range of scores and each replicate: labels 1 and 0 and twice the pairs won inside it, in the bag and out of it
PARTS = ["i1", "i0", "iw", "o1", "o0", "ow"]
#: replicates whose running sums are held at once; numbers that partial sums may hold before they are sent on; multiplicities of the
#: scores that a task holds before it sorts them and sends them on
_AT_ONCE, _HELD, _SORTED = 128, 1 << 21, 1 << 25
#: equal scores of a label from which their multiplicities are added up before they are sent on
_ALIKE = 4


def dense(draws: pa.BinaryArray, n: int) -> np.ndarray:
    """Multiplicities (rows x n) from binary values of n bytes each."""
    return np.frombuffer(draws.buffers()[2] or b"", dtype=np.uint8, count=len(draws) * n, offset=draws.offset * n).reshape(-1, n)


def binary(rows: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
    """Rows of a matrix or vector as binary values, one for the rows from each start to the next."""
    flat = np.ascontiguousarray(rows)
    width = flat.nbytes // max(1, len(flat))
    ends = (np.append(starts, len(flat)) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def dealt(keys: list[str], n: int, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (keys, `_picks`, the unit that each replicate draws) to (keys, `_chunk`, `_codes`): picks by chunk of units, each as the
    place in the chunk's matrix of units and replicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sent() -> Iterator[pa.RecordBatch]:
            batch = _joined(held)
            order, starts = grouped(batch, keys)
            picks = np.asarray(_column(batch, "_picks").flatten()).reshape(-1, n)
            for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
                mine = picks[order[a:b]]
                at = (mine // chunk).reshape(-1)
                by = np.argsort(at.astype(np.uint16) if at.max() < 1 << 16 else at, kind="stable")
                codes = ((mine % chunk) * n + np.arange(n)).astype(np.uint32).reshape(-1)[by]
                cut = np.flatnonzero(np.append(True, np.diff(at[by]) != 0))
                one = pa.array(np.full(len(cut), order[a]))
                yield pa.RecordBatch.from_arrays([*(_column(batch, k).take(one) for k in keys), pa.array(at[by][cut].astype(np.int64)), binary(codes, cut)], names=[*keys, "_chunk", "_codes"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows * n
            if size > _HELD:
                yield from sent()
                held, size = [], 0
        if held:
            yield from sent()

    return run


def streamed(keys: list[str], n: int, chunk: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (keys, `_units`) to (keys, `_chunk`, `_rep`, `_counts`): how often `numpy.random.RandomState(seed)` draws the units of
    each chunk in each replicate. The stream is sequential, so a task draws a key's; it holds one replicate's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, k in enumerate(_column(batch, "_units").to_pylist()):
                stream = np.random.RandomState(seed)
                starts = np.arange(0, k, chunk)
                one = pa.array(np.full(len(starts), i))
                for rep in range(n):
                    counts = np.zeros(k, dtype=np.int32)
                    for a in range(0, k, _HELD):
                        counts += np.bincount(stream.randint(0, k, size=min(_HELD, k - a)), minlength=k).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(_column(batch, c).take(one) for c in keys), pa.array(np.arange(len(starts), dtype=np.int64)), pa.array(np.full(len(starts), rep, dtype=np.int32)), binary(_bytes(counts), starts)], names=[*keys, "_chunk", "_rep", "_counts"])

    return run


def _bytes(counts: np.ndarray) -> np.ndarray:
    if len(counts) and counts.max() > 255:
        raise OverflowError("a unit is drawn more than 255 times in a replicate")
    return counts.astype(np.uint8)


def counted(columns: list[str], n: int, chunk: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A chunk's samples (columns, `_pos`) and its picks, as `dealt` or `streamed` gives them, to the samples with `_draws`."""

    def run(samples: pa.Table, picks: pa.Table) -> pa.Table:
        at = samples.column("_pos").to_numpy() % chunk
        size = int(at.max(initial=-1)) + 1
        if "_codes" in picks.column_names:
            codes = np.frombuffer(b"".join(picks.column("_codes").to_pylist()), dtype=np.uint32)
            drawn = _bytes(np.bincount(codes, minlength=size * n)).reshape(-1, n)
        else:
            drawn = np.zeros((max([size, *map(len, picks.column("_counts").to_pylist())]), n), dtype=np.uint8)
            for rep, counts in zip(picks.column("_rep").to_pylist(), picks.column("_counts").to_pylist(), strict=True):
                drawn[: len(counts), rep] = np.frombuffer(counts, dtype=np.uint8)
        w = drawn[at] if len(at) else np.zeros((0, n), dtype=np.uint8)
        return samples.select(columns).append_column("_draws", binary(w, np.arange(len(at))))

    return run


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def grouped(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the order of groups of equal `names`, where each group begins); nulls are equal to each other."""
    codes = [pc.fill_null(_column(batch, c).dictionary_encode(null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False) for c in names]
    order = np.lexsort(codes) if codes else np.arange(batch.num_rows)
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for c in codes:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order, np.flatnonzero(new)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def partial_sums(keys: list[str], names: list[str], n: int, out_of_bag: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (keys, `_values`, `_draws`) to sums over replicates of each value, a row for each key of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            sums = np.stack(list(held.values()))
            columns = [pa.array([k[i] for k in held], type=kinds[i]) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, *(_lists(sums[:, j]) for j in range(len(names)))], names=[*keys, *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [_column(batch, k).type for k in keys]
            order, starts = grouped(batch, keys)
            values = np.asarray(_column(batch, "_values").flatten(), dtype=float).reshape(batch.num_rows, len(names))[order]
            w = dense(_column(batch, "_draws"), n)[order]
            w = (w == 0 if out_of_bag else w).astype(float)
            firsts = [_column(batch, k).take(pa.array(order[starts])).to_pylist() for k in keys]
            for g, (a, b) in enumerate(zip(starts, [*starts[1:], len(order)], strict=True)):
                key = tuple(f[g] for f in firsts)
                part = values[a:b].T @ w[a:b]
                held[key] = held[key] + part if key in held else part
            if len(held) * n * len(names) > _HELD:
                yield sent()
                held = {}
        if held:
            yield sent()

    return run


def _combined(codes: list[np.ndarray]) -> np.ndarray:
    """One number for each combination of codes, below 2^16 wherever there are so few."""
    out, size = np.zeros(len(codes[0]), dtype=np.int64), 1
    for c in codes:
        most = int(c.max(initial=0)) + 1
        if size * most >= 1 << 31:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
            size = int(out.max(initial=0)) + 1
        out, size = out * most + c, size * most
    return np.unique(out, return_inverse=True)[1].astype(np.int64) if size > 1 << 16 else out


def _codes(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values.dictionary_encode(null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def dealt_scores(keys: list[str], labels: list[str], cells: list[str], n: int, bounds: dict[tuple, list[float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (keys, labels, label, `_draws`, `_cells`, a list of (cells, score)) to scores by key, cell, range and label: (keys, labels,
    cells, `_range`, label, `s`, `bag`, `rest`), sorted scores and their multiplicities as binary values, bytes where `rest` is
    missing and u32 otherwise. Equal scores of a label are added up, `rest` being how many were not drawn. `bounds` has the
    greatest scores' lower ends of ranges by key and cell. Scores that are not finite are left out."""
    names = [*keys, *labels]

    def sent(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _joined(held)
        lists = _column(batch, "_cells")
        flat = lists.flatten()
        parts = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
        value = parts["score"].to_numpy(zero_copy_only=False).astype(float)
        row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        label = _column(batch, "label").to_numpy(zero_copy_only=False).astype(np.int64)
        code = _combined([*(_codes(_column(batch, c))[row] for c in names), *(_codes(parts[c]) for c in cells), label[row]])
        at = np.flatnonzero(np.isfinite(value))
        if not len(at):
            return
        at = at[np.argsort(value[at], kind="stable")]
        at = at[np.argsort(code[at].astype(np.uint16) if code.max() < 1 << 16 else code[at], kind="stable")]
        s, code = value[at], code[at]
        starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (s[1:] != s[:-1])))
        sizes = np.diff(np.append(starts, len(s)))
        many = np.repeat(sizes >= _ALIKE, sizes)
        w = dense(_column(batch, "_draws"), n)
        kinds = [(np.flatnonzero(~many), w[row[at[~many]]], None)]
        if many.any():
            inside = w[row[at[many]]]
            first = np.concatenate([[0], np.cumsum(sizes[sizes >= _ALIKE])[:-1]])
            kinds.append((starts[sizes >= _ALIKE], *(np.add.reduceat(x, first, axis=0, dtype=np.uint32) for x in (inside, inside == 0))))
        for where, bag, rest in kinds:
            if not len(where):
                continue
            own, mine = code[where], s[where]
            ranges = np.zeros(len(where), dtype=np.int32)
            groups = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            if bounds:
                firsts = at[where[groups]]
                of = zip(*(_column(batch, k).take(pa.array(row[firsts])).to_pylist() for k in keys), *(parts[c].take(pa.array(firsts)).to_pylist() for c in cells), strict=True)
                for key, a, b in zip(of, groups, [*groups[1:], len(own)], strict=True):
                    if key in bounds:
                        ranges[a:b] = np.searchsorted(bounds[key], mine[a:b], side="right")
            cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (ranges[1:] != ranges[:-1])))
            firsts = at[where[cut]]
            columns = [*(_column(batch, c).take(pa.array(row[firsts])) for c in names), *(parts[c].take(pa.array(firsts)) for c in cells), pa.array(ranges[cut]), pa.array(label[row[firsts]].astype(np.int32))]
            last = pa.nulls(len(cut), pa.binary()) if rest is None else binary(rest, cut)
            yield pa.RecordBatch.from_arrays([*columns, binary(mine, cut), binary(bag, cut), last], names=[*names, *cells, "_range", "label", "s", "bag", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(_column(batch, "_cells").flatten()) * n
            if size > _SORTED:
                yield from sent(held)
                held, size = [], 0
        if held:
            yield from sent(held)

    return run


def pairs_won(by: list[str], n: int) -> Callable[[pa.Table], pa.Table]:
    """All scores of one range, as `dealt_scores` gives them, to one row of `PARTS`, each a vector over replicates."""

    def run(table: pa.Table) -> pa.Table:
        pieces = [np.frombuffer(x, dtype=float) for x in table.column("s").to_pylist()]
        y = np.repeat(table.column("label").to_numpy(), [len(x) for x in pieces])
        rests = table.column("rest").to_pylist()
        bags = [np.frombuffer(b, dtype=np.uint8 if r is None else np.uint32).reshape(-1, n) for b, r in zip(table.column("bag").to_pylist(), rests, strict=True)]
        rests = [b == 0 if r is None else np.frombuffer(r, dtype=np.uint32).reshape(-1, n) for b, r in zip(bags, rests, strict=True)]
        order = np.argsort(np.concatenate(pieces), kind="stable")
        s, y = np.concatenate(pieces)[order], y[order]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        sums = []
        for matrix in (bags, rests):
            parts = []
            for a in range(0, n, _AT_ONCE):
                w = np.concatenate([m[:, a : a + _AT_ONCE] for m in matrix])[order].astype(np.int64)
                w1, w0 = (np.add.reduceat(w * (y == k)[:, None], starts, axis=0) for k in (1, 0))
                parts.append((w1.sum(axis=0), w0.sum(axis=0), (w1 * (2 * (np.cumsum(w0, axis=0) - w0) + w0)).sum(axis=0)))
            sums += [np.concatenate(x) for x in zip(*parts, strict=True)]
        keys = [table.column(c).combine_chunks().slice(0, 1) for c in by]
        return pa.Table.from_arrays([*keys, *(_lists(x[None]) for x in sums)], names=[*by, *PARTS])

    return run


def dealt_hashes(keys: list[str], n: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (keys, `_value`, `_hash`, n digests of 16 bytes each) to rows by key, order `_rep` and `_cell`, the first `bits` of the digest,
    with the digests and values as binary values. Values are whole numbers of 8 bytes."""

    def sent(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        order, starts = grouped(batch, keys)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        digests = dense(_column(batch, "_hash"), 16 * n).reshape(-1, n, 16)
        values = _column(batch, "_value").to_numpy()
        for rep in range(n):
            mine = digests[:, rep][order]
            cell = (mine[:, :4].copy().view(">u4").ravel().astype(np.int64) << bits) >> 32
            code = (group << bits) + cell
            by = np.argsort(code.astype(np.uint16) if code.max() < 1 << 16 else code, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(code[by]) != 0))
            one = pa.array(order[by[cut]])
            yield pa.RecordBatch.from_arrays(
                [*(_column(batch, k).take(one) for k in keys), pa.array(np.full(len(cut), rep, dtype=np.int32)), pa.array(cell[by[cut]].astype(np.int32)), binary(mine[by], cut), binary(values[order[by]], cut)],
                names=[*keys, "_rep", "_cell", "_hash", "_values"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows * n
            if size > _HELD:
                yield from sent(_joined(held))
                held, size = [], 0
        if held:
            yield from sent(_joined(held))

    return run


def in_hash_order(by: list[str], kind: type) -> Callable[[pa.Table], pa.Table]:
    """A cell's digests and values, as `dealt_hashes` gives them, to one row of its values, as `kind`, in the order of digests and then values."""

    def run(table: pa.Table) -> pa.Table:
        hashes = np.frombuffer(b"".join(table.column("_hash").to_pylist()), dtype=">u8").reshape(-1, 2)
        values = np.frombuffer(b"".join(table.column("_values").to_pylist()), dtype=np.int64)
        order = np.lexsort((values, hashes[:, 1].astype(np.uint64), hashes[:, 0].astype(np.uint64)))
        return pa.Table.from_arrays([*(table.column(c).combine_chunks().slice(0, 1) for c in by), binary(values[order].astype(kind), np.zeros(1, dtype=np.int64)), pa.array([len(values)])], names=[*by, "_values", "_n"])

    return run


def labelled(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (keys, `_rep`, `_values`, `_labels`), a cell's samples and the labels for their places, to (keys, `_rep`, `_sample`, `_label`):
    samples with label 1, and all samples of the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, rep in enumerate(_column(batch, "_rep").to_pylist()):
                to, got = (np.frombuffer(_column(batch, c)[i].as_buffer(), dtype=k) for c, k in (("_values", np.int64), ("_labels", np.uint8)))
                if len(to) != len(got):
                    raise ValueError("a cell has more or fewer places than labels")
                if rep:
                    to, got = to[got == 1], got[got == 1]
                one = pa.array(np.full(len(to), i))
                yield pa.RecordBatch.from_arrays([*(_column(batch, k).take(one) for k in [*keys, "_rep"]), pa.array(to), pa.array(got.astype(np.int32))], names=[*keys, "_rep", "_sample", "_label"])

    return run
