"""Quality rules on tokeniser fertility: characters per token, byte-fallback share and token entropy of a text by a
public vocabulary, with rejection bands per language or script.

A band is median plus or minus `width` times the interquartile range (at least `floor`) of all documents of that
language whose token counts lie between the same powers of two, as entropy and noise follow length; texts without a
language go by their script. Entropy is taken relative to log2 of the number of tokens. A band that would rest on fewer
than `least` documents takes in the neighbouring sizes of its language, one more on either side at a time; where the
language has too few in all, the documents of the text's script, likewise from its own size outwards, and then those of
the whole table. So every document with tokens is judged, unless the whole table has fewer than `least`.

Defined results: null or empty texts have no tokens, null statistics and verdict "empty"; they are not kept.
Null languages go by script; of scripts with as many letters the last by name counts. Texts of any length are measured
whole. Statistics at the very edge of a band are kept. Repeated rows and ids each stand for themselves; other columns are
not touched, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import column, doc_columns, small, written
from ._tokens import TOKENIZERS, file_bytes, piece_tokens

#: statistic: the least interquartile range that a band takes for it
STATS = {"chars_per_token": 0.03, "byte_share": 0.004, "token_entropy": 0.008}
WIDTH, LEAST = 4.0, 30


def statistics(text: Column, model: bytes) -> Column:
    """struct<n_tokens, chars_per_token, byte_share, token_entropy, script>; null for a text without tokens, but for the script."""

    @F.pandas_udf("n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string")
    def run(texts: pd.Series) -> pd.DataFrame:
        sp, is_byte = piece_tokens(model)
        out = []
        for x in texts:
            ids = np.array(sp.encode(x), np.int64) if x else ()
            n = len(ids)
            if not n:
                out.append((0, None, None, None, script(x or "")))
                continue
            ids.sort()
            edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
            p = np.diff(edges) / n
            entropy = float(-(p * np.log2(p)).sum()) / np.log2(n) if n > 1 else 1.0
            out.append((n, len(x) / n, float(is_byte[ids].mean()), entropy, script(x)))
        return pd.DataFrame(out, columns=["n_tokens", "chars_per_token", "byte_share", "token_entropy", "script"])

    return run(text)


SCRIPTS = ("arabic", "cyrillic", "greek", "han", "latin", "other")
_made: dict = {}


def script(text: str) -> str:
    """The script of most letters of a text, by whole-text counts; of equals the last by name."""
    if not _made:
        every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        table = np.zeros(0x110000, np.uint8)
        for k, p in enumerate((r"\p{Arabic}", r"\p{Cyrillic}", r"\p{Greek}", r"\p{Han}", r"\p{Latin}", r"[\p{L}--[\p{Arabic}\p{Cyrillic}\p{Greek}\p{Han}\p{Latin}]]"), 1):
            table[[ord(c) for c in regex.findall(p, every, regex.V1)]] = k
        _made["table"] = table
    counts = np.zeros(len(SCRIPTS) + 1, np.int64)
    for a in range(0, len(text), 1 << 20):
        counts += np.bincount(_made["table"][np.frombuffer(text[a : a + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=len(counts))
    return max(zip(counts[1:].tolist(), SCRIPTS, strict=True))[1]


def band_key(lang: Column, script: Column) -> Column:
    return F.when(F.trim(lang) != "", lang).otherwise(F.concat(F.lit("script:"), script))


def measured(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, band_key, n_tokens, the statistics and the script of every row."""
    d = doc_columns(docs, "lang").select("doc_id", "lang", statistics(F.col("text"), file_bytes(vocabulary, folder)).alias("s"))
    return d.select("doc_id", band_key(F.col("lang"), F.col("s.script")).alias("band_key"), "s.*")


def size_class(n_tokens: Column) -> Column:
    return F.floor(F.log2(n_tokens)).cast("int")


def grouped(rows: DataFrame, *columns: str) -> DataFrame:
    """Each row for its language (level 0), its script (1) and the whole table (2): level, name, band_size, and columns."""
    levels = F.array(*[F.struct(F.lit(i).alias("level"), c.alias("name")) for i, c in enumerate((F.col("band_key"), F.col("script"), F.lit("")))])
    return rows.select(F.explode(levels).alias("g"), "band_size", *columns).select("g.*", "band_size", *columns)


def reaches(cells: DataFrame, least: int) -> DataFrame:
    """level, name, band_size, reach: by how many sizes on either side a band has to go to rest on `least` documents; none where all do not suffice."""
    g = grouped(cells, "n").groupBy("level", "name", "band_size").agg(F.sum("n").alias("n"))
    other = g.select("level", "name", F.col("band_size").alias("other"), F.col("n").alias("more"))
    far = g.join(other, ["level", "name"]).groupBy("level", "name", "band_size", F.abs(F.col("band_size") - F.col("other")).alias("reach")).agg(F.sum("more").alias("n"))
    held = F.sum("n").over(W.partitionBy("level", "name", "band_size").orderBy("reach"))
    return far.withColumn("held", held).filter(F.col("held") >= least).groupBy("level", "name", "band_size").agg(F.min("reach").alias("reach"))


def bands(rows: DataFrame, width: float = WIDTH, least: int = LEAST) -> DataFrame:
    """key, key_script, key_size, n_docs, and mid and half of each statistic: the band of each language, script and size of rows with tokens."""
    some = rows.filter("n_tokens > 0").select("band_key", "script", size_class(F.col("n_tokens")).alias("band_size"), *STATS)
    cells = some.groupBy("band_key", "script", "band_size").agg(F.count("*").alias("n"))
    keys = ["band_key", "script", "band_size"]
    narrowest = F.min(F.struct("level", "name", (F.col("band_size") - F.col("reach")).alias("low"), (F.col("band_size") + F.col("reach")).alias("high"))).alias("b")
    mine = grouped(cells.withColumn("cell", F.struct(*keys)), "cell").join(reaches(cells, least), ["level", "name", "band_size"])
    mine = mine.groupBy("cell").agg(narrowest).select("cell", "b.*")
    aggs = [F.count("*").alias("n_docs")]
    for s, floor in STATS.items():
        q = F.percentile_approx(s, [0.25, 0.5, 0.75], 10000)
        aggs += [q[1].alias(f"{s}_mid"), (F.greatest(q[2] - q[0], F.lit(floor)) * width).alias(f"{s}_half")]
    used = ["level", "name", "low", "high"]
    inside = small(mine.select(*used).distinct())
    within = grouped(some, *STATS).join(inside, ["level", "name"]).filter("band_size between low and high")
    limits = within.groupBy(*used).agg(*aggs)
    return mine.join(limits, used).select(F.col("cell.band_key").alias("key"), F.col("cell.script").alias("key_script"), F.col("cell.band_size").alias("key_size"), *limits.columns[4:])


def verdict(stat, band) -> Column:
    """stat and band: the columns of a row's statistics and of its band, by name."""
    out = F.when(stat("n_tokens") == 0, "empty")
    for s in STATS:
        out = out.when(F.abs(stat(s) - band(f"{s}_mid")) > band(f"{s}_half"), s)
    return out.otherwise("keep")


def in_band(stat, band) -> Column:
    return (stat("band_key") == band("key")) & (stat("script") == band("key_script")) & (size_class(stat("n_tokens")) == band("key_size"))


def fertility(docs: DataFrame, width: float = WIDTH, least: int = LEAST, vocabulary: str = "piece_bpe_32k.model", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, band_key, n_tokens, the statistics, verdict ("keep", "empty", or the statistic that is out of its band)."""
    rows = written(measured(docs, vocabulary, folder), "fertility")
    # some twenty rows for each language or script
    joined = rows.join(small(bands(rows, width, least)), in_band(F.col, F.col), "left")
    return joined.select(*(c for c in rows.columns if c != "script"), verdict(F.col, F.col).alias("verdict"))


def keep_fertile(docs: DataFrame, width: float = WIDTH, least: int = LEAST, vocabulary: str = "piece_bpe_32k.model", folder: str = TOKENIZERS) -> DataFrame:
    """The rows of docs that fertility() keeps, with all their columns as they are."""
    mine, limit = (next(n for i in range(len(docs.columns) + 1) if (n := f"{x}_{i}") not in docs.columns) for x in ("fertility", "band"))
    lang = column(docs, "lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = column(docs, "text").cast("string")
    measures = docs.withColumn(mine, statistics(text, file_bytes(vocabulary, folder)))
    rows = written(measures.withColumn(mine, F.col(mine).withField("band_key", band_key(lang, F.col(f"{mine}.script")))), "fertile")
    limits = small(bands(rows.select(f"{mine}.*"), width, least).select(F.struct("*").alias(limit)))
    stat, band = (lambda c: F.col(f"{mine}.{c}")), (lambda c: F.col(f"{limit}.{c}"))
    kept = rows.join(limits, in_band(stat, band), "left").filter(verdict(stat, band) == "keep")
    return kept.select(*(column(rows, c) for c in docs.columns))
