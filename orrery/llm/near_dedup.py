"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. A shingle is `n` words in a row (lower case, punctuation dropped; a text of fewer words is one shingle). Shingles are
   hashed into 2**20 features, as hashing TF does, and the number of documents that hold each feature is counted over
   all documents: a vector of fixed size, summed up in slices. A shingle weighs tf * idf of its feature, whatever its tf.
2. Each document draws `bands * rows` consistent weighted samples; documents that agree in all rows of a band are
   candidates. Texts of the very same shingles are one from here on, named by a 64-bit code of them.
3. In each band's bucket the smallest code leads; pairs with a leader are verified by weighted Jaccard similarity, and
   verified pairs joined into groups. Where a bucket still holds several groups, all its pairs across groups whose total
   weights allow that similarity are verified too, so that no candidate pair is left out: the groups are the components
   of all candidate pairs of similarity at least `threshold`.

Defined results: null and empty texts, and texts without a word, are like no other document; rows with a null doc_id
belong to no group and always stay. A row is named by its doc_id and its text, so different texts of one doc_id are
texts of their own, each of which may be in another group. Of a group the row of the least doc_id stays, of several rows
of that id the one whose text has the least MD5, and of rows that repeat id and text the one whose columns, written as
JSON, come first. Texts may be of any length: they are taken whole, in slices of many texts. Other columns are not
looked at, whatever their names. An empty table has no groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._components import components
from ._shared import column, doc_columns, drop_table, small, trim, written
from ._tokens import sliced

BITS, SHINGLE, BANDS, ROWS, THRESHOLD, SEED = 20, 3, 40, 4, 0.5, 7
SLICES = 64
TABLE = 1 << 16
CELLS = 48_000


def shingles(texts: Sequence[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles: the text's place, a 32-bit hash, how often; by text and hash."""
    buf, starts = _words.buffer([x.lower().encode("utf-8", "replace") for x in texts])
    ws, we = _words.spans(buf, _words.PUNCT)
    doc = np.searchsorted(starts, ws, "right") - 1
    h = _words.hashes(buf, ws, we)
    sizes = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(sizes)
    odd = np.uint64(0xD6E8FEB86659FD93)
    total, reach = h.copy(), np.minimum(n, sizes)[doc]  # a short text is one shingle
    for k in range(1, n):
        more = reach > k
        more[len(h) - k :] = False
        i = np.flatnonzero(more)
        total[i] = total[i] * odd + h[np.minimum(i + k, len(h) - 1)]
    fits = np.arange(len(h)) + reach <= ends[doc]
    key = (doc[fits].astype(np.uint64) << np.uint64(32)) | (_words.mixed(total[fits]) >> np.uint64(32))
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), tf


def batches_of(batches, columns=("doc_id", "text")):
    """Ids, lists of texts and whatever further columns, of a bounded number of characters."""
    for b in batches:
        ids, texts = b[columns[0]].to_numpy(zero_copy_only=False), [x or "" for x in b[columns[1]].to_pylist()]
        for i, j in sliced(texts):
            yield ids[i:j], texts[i:j], *(b[c].slice(i, j - i) for c in columns[2:])
    trim()


def document_counts(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """How many rows hold each of the 2**bits features. The result has a fixed size."""
    width = (1 << bits) // SLICES

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for _, texts in batches_of(batches):
            doc, h, _ = shingles(texts, n)
            feature = h >> np.uint32(32 - bits)
            key = np.unique(doc * (1 << bits) + feature)
            total += np.bincount(key & ((1 << bits) - 1), minlength=1 << bits)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.astype(np.int32).tobytes() for x in total.reshape(SLICES, width)], pa.binary())], ["slice", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b["slice"].to_pylist(), b["counts"], strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(x.as_buffer(), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])

    rows = docs.mapInArrow(count, "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect()
    out = np.zeros((SLICES, width), np.int64)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def idf_of(counts: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log((n_docs + 1) / (counts + 1)).astype(np.float32) + np.float32(0.05)


_tables: list[np.ndarray] = []


def variates() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), and their logarithms."""
    if not _tables:
        u = (np.arange(TABLE) + 0.5) / TABLE
        low, high = np.zeros(TABLE), np.full(TABLE, 60.0)
        for _ in range(60):
            mid = (low + high) / 2
            below = 1 - (1 + mid) * np.exp(-mid) < u
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        _tables.extend([high.astype(np.float32), np.log(high).astype(np.float32)])
    return _tables[0], _tables[1]


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, k: int, seed: int = SEED) -> np.ndarray:
    """n_docs x k consistent weighted samples (0 for a document without shingles).

    For a shingle of weight w and the k-th draw, with r and c of Gamma(2, 1) and b uniform, all three from the shingle's
    hash: t = floor(log w / r + b), log a = log c - r (t - b + 1). The shingle of least a is the sample; as log a follows
    from shingle and t alone, its bits name both."""
    gamma, log_gamma = variates()
    odd = np.random.default_rng(seed).integers(0, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((n_docs, k), np.uint32)
    if not len(doc):
        return out
    mixed, logw = _words.mixed(h.astype(np.uint64))[:, None], np.log(weight.astype(np.float32))[:, None]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    best = np.full((n_docs, k), np.inf, np.float32)
    # runs of shingles, so that what is at hand fits the cache; a document may go over several. All runs share these arrays:
    # fresh ones of that size come from the machine page by page, which takes longer than what is done with them
    step = max(1, CELLS // k)
    shape = min(step, len(doc)), k
    xs, bits, (rs, cs, bs, ts) = np.empty(shape, np.uint64), np.empty(shape, np.uint64), np.empty((4, *shape), np.float32)
    for at in range(0, len(doc), step):
        s = slice(at, min(at + step, len(doc)))
        x, y, r, c, b, t = (part[: s.stop - at] for part in (xs, bits, rs, cs, bs, ts))
        np.multiply(mixed[s], odd, out=x)
        place = y.view(np.int64)  # "clip" clips nothing here, but writes to out without a copy
        gamma.take(np.right_shift(x, np.uint64(48), out=y).view(np.int64), out=r, mode="clip")
        np.right_shift(x, np.uint64(32), out=y)
        y &= np.uint64(TABLE - 1)
        log_gamma.take(place, out=c, mode="clip")
        np.right_shift(x, np.uint64(8), out=y)
        y &= np.uint64(0xFFFFFF)
        np.multiply(place, np.float32(2.0**-24), out=b, casting="unsafe", dtype=np.float32)
        np.divide(logw[s], r, out=t)
        t += b
        np.floor(t, out=t)
        t -= b
        t += np.float32(1)
        t *= r
        c -= t
        cuts = [at, *first[np.searchsorted(first, at, "right") : np.searchsorted(first, s.stop)].tolist(), s.stop]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            own = best[doc[i]]
            np.minimum(own, np.minimum.reduce(c[i - at : j - at], axis=0), out=own)
    held = doc[first]
    out[held] = best[held].view(np.uint32)
    return out


def band_keys(sample: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each document."""
    x = sample.reshape(len(sample), bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1)
    for i in range(rows):
        key = _words.mixed(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, i])
    return key.view(np.int64)


def similarity(a: bytes, b: bytes, idf: np.ndarray, bits: int = BITS) -> float:
    """Weighted Jaccard of two packed documents: sum of lesser weights over sum of greater ones."""
    (ha, ta), (hb, tb) = unpacked(a), unpacked(b)
    wa, wb = idf[ha >> np.uint32(32 - bits)] * ta, idf[hb >> np.uint32(32 - bits)] * tb
    i = np.searchsorted(hb, ha)
    i[i == len(hb)] = 0
    hit = hb[i] == ha if len(hb) else np.zeros(len(ha), bool)
    both = np.minimum(wa[hit], wb[i[hit]]).sum(dtype=np.float64)
    total = wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - both
    return float(both / total) if total > 0 else 0.0


def packed(h: np.ndarray, tf: np.ndarray) -> bytes:
    """How many, their hashes, their frequencies in a byte each, and in full those that fill the byte."""
    big = tf >= 255
    return np.uint32(len(h)).tobytes() + h.tobytes() + np.where(big, 255, tf).astype(np.uint8).tobytes() + tf[big].astype(np.uint32).tobytes()


def unpacked(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(x, np.uint32, 1)[0])
    tf = np.frombuffer(x, np.uint8, n, 4 + 4 * n).astype(np.int64)
    tf[tf == 255] = np.frombuffer(x, np.uint32, -1, 4 + 5 * n) if len(x) > 4 + 5 * n else 255
    return np.frombuffer(x, np.uint32, n, 4), tf


def codes(doc: np.ndarray, h: np.ndarray, tf: np.ndarray, n_docs: int) -> np.ndarray:
    """A name for each text's shingles and frequencies: a sum of 64-bit hashes, equal for equal ones."""
    out = np.zeros(n_docs, np.uint64)
    np.add.at(out, doc, _words.mixed(_words.mixed(h.astype(np.uint64)) + tf.astype(np.uint64)))
    return out.view(np.int64)


def verified(pairs: DataFrame, features: DataFrame, idf, threshold: float, bits: int) -> DataFrame:
    """The pairs (a, b) whose texts are that similar. Each side is joined by shuffle; skew joins split hot leaders."""
    fb = features.select(F.col("code").alias("b"), F.col("f").alias("fb"))
    fa = features.select(F.col("code").alias("a"), F.col("f").alias("fa"))
    joined = pairs.join(fb, "b").join(fa, "a")

    def run(batches):
        for x in batches:
            keep = [similarity(p.as_buffer(), q.as_buffer(), idf.value, bits) >= threshold for p, q in zip(x["fa"], x["fb"], strict=True)]
            yield pa.RecordBatch.from_arrays([x["a"], x["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def members(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, name (MD5 of the text) of every row in a group of several, and kept: doc_id and name of the one that stays."""
    spark = docs.sparkSession
    d = doc_columns(docs).filter("doc_id is not null")
    counts = document_counts(d, n, bits)
    idf = spark.sparkContext.broadcast(idf_of(counts, d.count()))  # 2**bits numbers, whatever the corpus

    def sign(batches):
        for ids, texts, names in batches_of(batches, ("doc_id", "text", "name")):
            doc, h, tf = shingles(texts, n)
            weight = idf.value[h >> np.uint32(32 - bits)] * tf
            keys = band_keys(samples(doc, h, weight, len(texts), bands * rows), bands, rows)
            held = np.bincount(doc, minlength=len(texts)) > 0
            offsets = pa.array(np.arange(held.sum() + 1, dtype=np.int32) * bands)
            cols = [pa.array(ids[held], pa.int64()), names.filter(pa.array(held)), pa.array(codes(doc, h, tf, len(texts))[held])]
            cols += [pa.array(np.bincount(doc, weight, len(texts))[held]), pa.ListArray.from_arrays(offsets, pa.array(keys[held].ravel()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "name", "code", "weight", "keys"])

    named = d.select("doc_id", "text", F.unhex(F.md5("text")).alias("name"))
    signed = written(named.mapInArrow(sign, "doc_id long, name binary, code long, weight double, keys array<long>"), "signatures")
    one = signed.groupBy("code").agg(F.min("doc_id").alias("doc_id"), F.first("weight").alias("weight"), F.first("keys").alias("keys"))
    long = one.select("code", "doc_id", "weight", F.explode(F.array_distinct("keys")).alias("key"))
    # leaders come from partial aggregates, so that no bucket is held by one task
    leaders = long.groupBy("key").agg(F.min("code").alias("a"), F.count("*").alias("m")).filter("m > 1").select("key", "a")
    buckets = written(long.join(leaders, "key").select("key", "a", F.col("code").alias("b"), "doc_id", "weight"), "buckets")
    stars = written(buckets.filter("a <> b").select("a", "b").distinct(), "stars")

    def pack(batches):
        for _, texts, _ in batches_of(batches, ("doc_id", "text", "name")):
            doc, h, tf = shingles(texts, n)
            at = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(codes(doc, h, tf, len(texts))), pa.array([packed(h[i:j], tf[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["code", "f"])

    needed = buckets.select("doc_id", F.col("b").alias("code")).distinct()
    texts = named.join(needed.select("doc_id").distinct(), "doc_id", "left_semi")
    # an id may stand on other texts and on many rows
    features = texts.mapInArrow(pack, "code long, f binary").join(needed.select("code"), "code", "left_semi").dropDuplicates(["code"])
    features = written(features, "features")
    found = written(verified(stars, features, idf, threshold, bits), "verified")
    label = components(found)
    # buckets that still hold several groups: all their pairs across groups
    grouped = buckets.join(label, buckets["b"] == label["id"], "left").select("key", "b", "weight", F.coalesce("component", "b").alias("g"))
    mixed = grouped.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low <> high").select("key")
    mixed = written(grouped.join(mixed, "key", "left_semi"), "mixed")
    x = mixed.select("key", F.col("b").alias("a"), F.col("g").alias("ga"), F.col("weight").alias("wa"))
    y = mixed.select("key", "b", F.col("g").alias("gb"), F.col("weight").alias("wb"))
    # the similarity is at most the lesser total weight over the greater; weights are summed up in single precision
    alike = f"wa >= {threshold * 0.999} * wb and wb >= {threshold * 0.999} * wa"
    across = x.join(y, "key").filter(f"a < b and ga <> gb and {alike}").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    more = verified(across, features, idf, threshold, bits)
    edges = written(found.unionByName(more), "edges")
    linked = components(edges)
    rows_of = signed.select("doc_id", "name", "code").distinct().join(linked, F.col("code") == F.col("id"), "left").select("doc_id", "name", F.coalesce("component", "code").alias("class"))
    kept = rows_of.groupBy("class").agg(F.min(F.struct("doc_id", "name")).alias("kept"), F.count("*").alias("m")).filter("m > 1")
    out = written(rows_of.join(kept, "class").select("doc_id", "name", "kept"), "members")
    for x in (signed, buckets, stars, features, found, label, mixed, edges, linked):
        drop_table(x)
    return out


def groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, kept_doc_id: every document that goes, with the one of its group that stays. A doc_id on several texts has
    a row for each group that it goes from."""
    return members(docs, **options).filter("doc_id <> kept.doc_id").select("doc_id", F.col("kept.doc_id").alias("kept_doc_id")).distinct()


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without those that are in a group and don't stay, and one of rows that repeat id and text; all
    columns as they are."""
    gone = members(docs, **options).filter("doc_id <> kept.doc_id or name <> kept.name").select(F.col("doc_id").alias("mark_id"), F.col("name").alias("mark_name"))
    none = F.unhex(F.lit(""))
    key = lambda df: (column(df, "doc_id").cast("long").alias("mark_id"), F.coalesce(F.unhex(F.md5(column(df, "text").cast("string"))), none).alias("mark_name"))
    twice = docs.select(*key(docs)).filter("mark_id is not null").groupBy("mark_id", "mark_name").count().filter("count > 1").drop("count")
    marks = twice.join(gone, ["mark_id", "mark_name"], "left_anti").withColumn("mark_gone", F.lit(False)).unionByName(gone.withColumn("mark_gone", F.lit(True)))
    names = {c: next(n for i in range(len(docs.columns) + 1) if (n := f"{c}_{i}") not in docs.columns) for c in marks.columns}
    # documents meet names and not texts, and are themselves shuffled only where there are many
    marks = small(marks.withColumnsRenamed(names))
    i, name = key(docs)
    marked = docs.join(marks, (i == marks[names["mark_id"]]) & (name == marks[names["mark_name"]]), "left")
    again = marked.filter(F.col(names["mark_gone"]) == False)  # noqa: E712
    row = F.struct(*(column(again, c) for c in docs.columns))
    first = again.groupBy(names["mark_id"], names["mark_name"]).agg(F.min_by(row, F.to_json(row)).alias("r"))
    once = marked.filter(F.col(names["mark_gone"]).isNull()).select(*(column(marked, c) for c in docs.columns))
    return once.unionByName(first.select(*(F.col("r")[c].alias(c) for c in docs.columns)))
