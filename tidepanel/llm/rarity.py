"""Document fingerprints from improbable features.

Every window of 64 bytes gets the entropy of its byte counts; entropies far from those of running text are rare. A window
is a feature if it is the rarest of enough of the 64-window stretches that it lies in, so features are local and an edit
changes only those around it. Texts below 192 bytes have few such windows or none; their 8-byte windows are features too.
Features set five bits each in a chain of Bloom filters, and two fingerprints are compared
by the overlap of their filters' bits beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import expand, map_arrow, text_buffers

WINDOW = 64
POPULARITY = 16
#: Texts with fewer bytes than ``SHORT`` also have every window of ``SMALL`` bytes as a feature.
SHORT, SMALL = 192, 8
FILTER_BITS = 2048
FILTER_FEATURES = 160
#: Entropy per mille of its maximum that is most common in running text, and the bounds of what can be a feature.
TYPICAL, LEAST, MOST = 690, 100, 990
#: Bytes that are looked at together; longer texts go in overlapping segments with the same result.
SEGMENT = 1_000_000
#: Bytes whose equals within a window are counted at once.
STRETCH = 1 << 16

_SCALE = 1024
_TERM = np.rint(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * _SCALE).astype(np.int32)
_NEVER = np.int64(1) << 20


def _window_sums(data: np.ndarray) -> np.ndarray:
    """Sum of c * log2(c) over the byte counts c of the window that starts at each place, for all full windows."""
    n = len(data)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes within a window before, and behind
    for first in range(0, n, STRETCH):  # short enough for a core's cache
        last = min(first + STRETCH, n)
        same = np.empty(last - first, bool)
        for lag in range(1, min(WINDOW, n - first)):
            size = min(last, n - lag) - first
            np.equal(data[first:first + size], data[first + lag:first + lag + size], out=same[:size])
            met = same[:size].view(np.uint8)
            ahead[first:first + size] += met
            back[first + lag:first + lag + size] += met
    step = np.diff(_TERM).astype(np.int64)
    # the byte that leaves goes first, so a byte that is met again exactly one window later starts from the lower count
    gain, loss = step[back], step[ahead]
    grown = np.cumsum(gain)
    return grown[WINDOW - 1:] - np.concatenate(([0], np.cumsum(loss)))[:n - WINDOW + 1]


def _rank(sums: np.ndarray) -> np.ndarray:
    """Precedence of windows: the rarer, the lower; windows out of bounds never count."""
    entropy = (np.log2(WINDOW) - sums / (WINDOW * _SCALE)) / np.log2(WINDOW) * 1000
    rank = np.rint((1000 - np.abs(entropy - TYPICAL)) * 16).astype(np.int64)
    return np.where((entropy < LEAST) | (entropy > MOST), _NEVER, rank)


def _segments(sizes: np.ndarray) -> np.ndarray:
    """Rows (text, first byte, end, first kept, end of kept): one for most texts, several for a long one."""
    rows = []
    for t, n in enumerate(sizes.tolist()):
        if n <= SEGMENT:
            rows.append((t, 0, n, 0, n))
        else:
            rows += [(t, max(0, s - WINDOW + 1), min(n, s + SEGMENT + 2 * WINDOW), s, min(n, s + SEGMENT)) for s in range(0, n, SEGMENT)]
    return np.array(rows, np.int64).reshape(-1, 5)


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """64-bit features of every text, in order of first appearance. A text without any has its own hash as the only one."""
    sizes = np.diff(offsets)
    found: list[list[np.ndarray]] = [[] for _ in sizes]
    rows = _segments(sizes)
    cut = np.concatenate(([0], np.cumsum(rows[:, 2] - rows[:, 1])))
    first = 0
    while first < len(rows):
        last = min(max(int(np.searchsorted(cut, cut[first] + SEGMENT, "right")) - 1, first + 1), len(rows))
        _collect(data, offsets, rows[first:last], found)
        first = last
    out = []
    for t, parts in enumerate(found):
        if SMALL <= sizes[t] < SHORT:
            small = np.lib.stride_tricks.sliding_window_view(data[offsets[t]:offsets[t + 1]], SMALL)
            parts = [*parts, _mixed(np.ascontiguousarray(small).view("<u8"))]
        values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        if not len(values):
            values = np.frombuffer(hashlib.sha256(data[offsets[t]:offsets[t + 1]].tobytes()).digest()[:8], np.uint64)
        _, at = np.unique(values, return_index=True)
        out.append(values[np.sort(at)])
    return out


def _mixed(words: np.ndarray) -> np.ndarray:
    """One hash for each row of words."""
    mixed = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        mixed = (mixed ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def _collect(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, found: list[list[np.ndarray]]) -> None:
    size = rows[:, 2] - rows[:, 1]
    place = np.cumsum(size + WINDOW) - size  # every segment stands behind a gap of one window
    buffer = np.zeros(int(place[-1] + size[-1]) + WINDOW, np.uint8)
    inside = expand(place, size)
    buffer[inside] = data[expand(offsets[rows[:, 0]] + rows[:, 1], size)]
    windows = len(buffer) - WINDOW + 1
    rank = np.full(windows, _NEVER, np.int64)
    starts = expand(place, np.maximum(size - WINDOW + 1, 0))
    if not len(starts):
        return
    rank[starts] = _rank(_window_sums(buffer)[starts])
    low = rank << 32 | np.arange(windows)
    span = 1
    while span < WINDOW:  # least of the next 2, 4, ... 64 windows; the leftmost of equals
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = low[low >> 32 < _NEVER]
    popular = np.bincount(low & 0xFFFFFFFF, minlength=windows) >= POPULARITY
    chosen = np.flatnonzero(popular)
    row = np.searchsorted(place, chosen, "right") - 1
    at = chosen - place[row] + rows[row, 1]
    kept = (at >= rows[row, 3]) & (at < rows[row, 4])
    chosen, row = chosen[kept], row[kept]
    if not len(chosen):
        return
    mixed = _mixed(np.ascontiguousarray(buffer[chosen[:, None] + np.arange(WINDOW)]).view("<u8"))
    edges = np.flatnonzero(np.diff(row)) + 1
    for r, values in zip(row[np.concatenate(([0], edges))].tolist(), np.split(mixed, edges)):
        found[int(rows[r, 0])].append(values)


def bloom_chain(values: np.ndarray) -> np.ndarray:
    """Bits of the features, 160 to a filter: one row of 32 words per filter."""
    count = -(-len(values) // FILTER_FEATURES)
    bits = np.zeros((count, FILTER_BITS), bool)
    row = np.arange(len(values)) // FILTER_FEATURES
    for k in range(5):
        bits[row, (values >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: mean over the shorter chain of each filter's best overlap with the other chain, beyond what chance gives."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    ones_a, ones_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for filter_, ones in zip(a, ones_a):
        common = np.bitwise_count(filter_ & b).sum(1, dtype=np.int64)
        chance = ones * ones_b / FILTER_BITS
        most = np.minimum(ones, ones_b)
        total += float(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / len(a)


def fingerprint(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def chains(texts: list[str]) -> list[np.ndarray]:
    data, offsets = text_buffers(pa.array(texts, pa.large_string()))
    return [bloom_chain(v) for v in features(data, offsets)]


def _key(doc_id: Column, text: Column) -> Column:
    """Text that sorts like (null first, id, hash of the text): 33 characters."""
    ordered = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(doc_id.isNotNull().cast("int").cast("string"), ordered(F.coalesce(doc_id, F.lit(0)).cast("long")), ordered(F.xxhash64(text)))


def _cuts(docs: DataFrame, doc_id: str, buckets: int) -> list[str]:
    """Least keys of the buckets behind the first one, ascending. They follow the quantiles of the ids; an id, or the null,
    that fills several buckets is cut by the hash. Only ids are read and at most ``buckets`` numbers come to the driver."""
    quantiles = F.percentile_approx(doc_id, [k / buckets for k in range(buckets)], 10_000)
    found = docs.agg(F.count("*").alias("rows"), F.count(doc_id).alias("named"), quantiles.alias("cuts")).first()
    without = buckets * (found["rows"] - found["named"]) // max(found["rows"], 1)
    times = Counter([(0, 0)] * without + [(1, int(v)) for v in found["cuts"] or []])
    return [f"{named}{value + (1 << 63):016X}{(k << 64) // n:016X}" for (named, value), n in sorted(times.items()) for k in range(n)][1:]


def _bucket_of(key: Column, cuts: list[str]) -> Column:
    """Number of cuts up to a key: first among every so many cuts, then among those of one stretch."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    literal = lambda rows: F.split(F.lit(",".join(rows)), ",")  # noqa: E731 - one folded constant
    stretch = F.size(F.filter(literal(cuts[step - 1::step]), lambda c: c <= key))
    return stretch * step + F.size(F.filter(F.slice(literal(cuts), stretch * step + 1, step), lambda c: c <= key))


def _with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (bucket, extra, doc_id, text): buckets are ranges of ids and, within one id, of a hash of the text, and the
    first row of the next bucket comes once more as the ``extra`` last row of a bucket (the very first row for the last
    bucket)."""
    cuts = _cuts(docs, doc_id, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), _key(F.col(doc_id), whole).alias("key"))
    placed = placed.withColumn("bucket", _bucket_of(F.col("key"), cuts))
    lead = [(r["bucket"], r["first"]) for r in placed.groupBy("bucket").agg(F.min("key").alias("first")).orderBy("bucket").collect()]  # one row a bucket
    rows = placed.select("bucket", F.lit(0).alias("extra"), "doc_id", "text", "key")
    if lead:
        heads = docs.sparkSession.createDataFrame([(lead[k - 1][0], first) for k, (_, first) in enumerate(lead)], "to int, key string")
        firsts = placed.join(F.broadcast(heads), "key").groupBy("to").agg(F.min(F.struct("doc_id", "text", "key")).alias("row"))
        rows = rows.union(firsts.select("to", F.lit(1), "row.doc_id", "row.text", "row.key"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "extra", "key", "text").select("bucket", "extra", "doc_id", "text")


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many of the next
    document's, in ascending order of id; the first follows the last. Null texts count as empty, an empty text has a
    fingerprint too. Rows with equal ids follow each other by a hash of the text; null ids come first. A single document
    is its own next. Texts on both sides of ``SHORT`` bytes share the features of long texts only. Other columns are not read. An empty table gives an empty one.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def compare(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        half = [len(t) // 2 for t in texts]
        edited = [t[:len(t) - h] + f[:h] for t, h, f in zip(texts, half, following)]
        # the chain of the next text is the next row's own, but for the last of the block
        own = chains([*texts, following[-1]])
        changed = chains(edited)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
        columns = [pa.array(ids), pa.array(list(map(len, texts)), pa.int64()), pa.array(sha), pa.array(list(map(fingerprint, own[:-1]))), pa.array(list(map(fingerprint, changed))),
                   pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64())]
        return pa.RecordBatch.from_arrays([columns[0].cast(pa.int64()) if kind == "bigint" else columns[0], *columns[1:]],
                                          names=[doc_id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row still waits for its next
        ids: list = []
        texts: list[str] = []
        following: list[str] = []
        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                for bucket, extra, i, t in zip(*(batch.slice(k, 500).column(c).to_pylist() for c in range(4))):
                    if held is not None and held[0] == bucket:
                        ids.append(held[1])
                        texts.append(held[2])
                        following.append(t)
                        size += len(t)
                    if held is not None and texts and (size > SEGMENT or held[0] != bucket or extra):
                        yield compare(ids, texts, following)
                        ids, texts, following, size = [], [], [], 0
                    held = None if extra else (bucket, i, t)
        if texts:
            yield compare(ids, texts, following)

    rows = _with_next(docs, doc_id, text)
    return map_arrow(rows, work, f"{doc_id} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
