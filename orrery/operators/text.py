"""Entities in text: fixed patterns, and runs of capitalised words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: name, pattern, type
PATTERNS = (
    ("email", r"\b[0-9A-Z_a-z%+.-]+@[.0-9A-Za-z-]+\.[a-zA-Z|]{2,}\b", "contact"),
    ("url", r"(?:https?://|www\.)[^<>\"\s]+", "url"),
    ("phone", r"\b(?:\d{3}[.-]?){2}\d{4}\b", "contact"),
    ("date_iso", r"\b\d{4}(?:-\d\d){2}\b", "date"),
    ("money_usd", r"[$]\d+(?:,\d\d\d)*(?:[.]\d\d)?", "money"),
)
STOPWORDS = frozenset("a an and ante are at con de del e el en es for in is la las los o on or para por que son the to u un una unas unos with y".split())
CONNECTORS = frozenset("de del el la y".split())
TOKEN = re.compile(r"\b[0-9A-Za-zÁÉÍÑÓÚÜáéíñóúü]+\b")
LONGEST = 4
SCHEMA = "doc_id long, entity string, kind string, score double, n long, starts array<int>"


def structural(text: str) -> list[tuple[str, str, float, int, list[int]]]:
    """entity, kind, score, count, starts. Of hits that differ in case alone the last stays."""
    out = {}
    for _, pattern, kind in PATTERNS:
        for m in re.finditer(pattern, text):
            out[m.group().lower()] = (m.group(), kind, 1.0, 1, [m.start()])
    return list(out.values())


def proper(word: str) -> bool:
    return word.istitle() and word.lower() not in STOPWORDS


def ngrams(text: str) -> list[tuple[str, str, float, int, list[int]]]:
    """Runs of capitalised words, which a connector may join to the next one; a tenth more score each further time."""
    tokens = [(m.group(), m.start()) for m in TOKEN.finditer(text)]
    found: dict[str, list[int]] = {}
    i = 0
    while i < len(tokens):
        if not proper(tokens[i][0]):
            i += 1
            continue
        j = i + 1
        while j < len(tokens) and j - i < LONGEST:
            if proper(tokens[j][0]):
                j += 1
            elif tokens[j][0].lower() in CONNECTORS and tokens[j + 1 :] and tokens[j + 1][0].istitle():
                j += 2
            else:
                break
        found.setdefault(" ".join(t for t, _ in tokens[i:j]), []).append(tokens[i][1])
        i = j
    return [(e, "proper_noun", min(1.0, 0.8 + 0.1 * (len(s) - 1)), len(s), s) for e, s in found.items()]


def merged(text: str) -> list[tuple[str, str, float, int, list[int]]]:
    """Both, joined without regard to case: counts add up, the greater score stays, the first spelling and kind too."""
    out: dict[str, list] = {}
    for row in [*structural(text), *ngrams(text)]:
        if (key := row[0].lower()) in out:
            out[key][2] = max(out[key][2], row[2])
            out[key][3] += row[3]
        else:
            out[key] = list(row)
    return [tuple(x) for x in out.values()]


def frames(batches, how, most: int = 20_000):
    """Rows of extract() in frames of about `most`, so that the entities of a whole batch are never held at once."""
    rows = []
    columns = ["doc_id", "entity", "kind", "score", "n", "starts"]
    for pdf in batches:
        for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
            rows += [(d, *r) for r in how(t)] if t else []
            if len(rows) >= most:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def extract(docs: DataFrame, how=merged) -> DataFrame:
    """doc_id, entity, kind, score, n, starts; how: one of the functions above."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(lambda batches: frames(batches, how), SCHEMA)


#: what a text must hold for a pattern to hit; finding that costs little
SIGNS = {"email": lambda c: c.contains("@"), "url": lambda c: c.contains("://") | c.contains("www."), "phone": lambda c: c.rlike(r"\d{3}[.-]?\d{3}"), "date_iso": lambda c: c.rlike(r"\d-\d\d-"), "money_usd": lambda c: c.contains("$")}


def pattern_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """pattern, n, n_docs: how often the fixed patterns hit, with built-in expressions alone."""
    n = lambda name, p: F.when(F.col(text).isNotNull() & ~SIGNS[name](F.col(text)), 0).otherwise(F.size(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))))
    hits = docs.select(F.array(*[F.struct(F.lit(name).alias("pattern"), n(name, p).alias("n")) for name, p, _ in PATTERNS]).alias("a"))
    flat = hits.select(F.explode("a").alias("x")).select("x.*")
    return flat.groupBy("pattern").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("n_docs"))


def validated(candidates: DataFrame, splats: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """candidates (vec_id, score, embedding) with cluster_id: that of the splat (splat_id, mu) of greatest product with the
    normalised embedding, which adds 0.2 to the score (1 at most) where it is above 0.8; without splats, of k-means of five
    clusters at most."""
    from ..functions.vectors import normalize
    from .ivf import kmeans
    from .knn import knn

    c = candidates.select("vec_id", "score", normalize(F.col("embedding")).alias("embedding"))
    if splats is None:
        own = kmeans(c, max(1, min(5, c.count())), seed).select("vec_id", F.col("cluster").cast("long").alias("cluster_id"))
        return c.drop("embedding").join(own, "vec_id", "left")
    near = knn(c.select(F.col("vec_id").alias("query_id"), "embedding"), splats.select(F.col("splat_id").alias("vec_id"), F.col("mu").alias("embedding")), 1, "dot")
    near = near.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("cluster_id"), (-F.col("distance")).alias("similarity"))
    score = F.when(F.col("similarity") > 0.8, F.least(F.lit(1.0), F.col("score") + 0.2)).otherwise(F.col("score"))
    return c.drop("embedding").join(near, "vec_id", "left").select("vec_id", score.alias("score"), "cluster_id")


def corpus_entities(found: DataFrame) -> DataFrame:
    """Entities over all documents, without regard to case."""
    return found.groupBy(F.lower("entity").alias("entity")).agg(F.sum("n").alias("n"), F.max("score").alias("score"), F.countDistinct("doc_id").alias("n_docs"))
