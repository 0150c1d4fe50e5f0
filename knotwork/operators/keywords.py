"""The keyword index: postings of every term, built once and read in slices (SK3, RT1, RT4, SL2).

A term is a run of letters, digits and marks of any script, in small letters and without the accents of
Latin, Greek and Cyrillic letters. Postings (term, key, tf, len) are written in the order of term and key, in
ranges of both, so a common term fills several files and a question reads the row groups of its own terms
only. Beside them lie the figures of the corpus, one row.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.scratch import Scratch

# The parameters of the ranking function.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def _folds() -> tuple[str, str, str]:
    """Small accented letters and what they are without accents, and marks that vanish; by Unicode's own decompositions."""
    accented, plain = ["ς"], ["σ"]
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and c == c.lower() and all(unicodedata.combining(p) for p in parts[1:]) and parts[0] == parts[0].lower():
            accented.append(c)
            plain.append(parts[0])
    return "".join(accented), "".join(plain), "".join(map(chr, range(0x300, 0x370)))


_ACCENTED, _PLAIN, _MARKS = _folds()
_BREAK = r"[^\p{L}\p{N}\p{M}]+"


def folded(text: Column | str) -> Column:
    """text in small letters, without accents."""
    c = F.col(text) if isinstance(text, str) else text
    return F.translate(F.lower(c), _ACCENTED + _MARKS, _PLAIN)


def tokens(text: Column | str) -> Column:
    """The terms of a text in order; null has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(folded(F.coalesce(c, F.lit(""))), _BREAK), lambda t: t != "")


def query_tokens(text: str) -> list[str]:
    """The different terms of a question, as tokens() has them."""
    low = text.lower().translate(str.maketrans(_ACCENTED, _PLAIN, _MARKS))
    return list(dict.fromkeys("".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in low).split()))


def tokens_sql(expr: str) -> str:
    """The DuckDB text of tokens."""
    return f"list_filter(regexp_split_to_array(translate(lower(coalesce({expr}, '')), '{_ACCENTED + _MARKS}', '{_PLAIN}'), '{_BREAK}'), lambda x: x <> '')"


@dataclass
class KeywordIndex:
    """postings: term, key, tf, len. stats: one row with n texts and their mean length avgdl."""

    postings: DataFrame
    stats: DataFrame
    key: str

    def search(self, terms: list[str], *extra: str) -> DataFrame:
        """RT1: key, extra columns and rank (below 0, the least the best) of the texts that hold a term; the corpus' figures are those of all texts.

        A term that is asked for twice counts once; without terms there are no rows.
        """
        found = self.postings.where(F.col("term").isin(sorted(set(terms))) if terms else F.lit(False))
        df = found.groupBy("term").agg(F.count("*").alias("df"))  # a row a term that is asked for
        j = found.join(F.broadcast(df), "term").join(F.broadcast(self.stats))
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = F.when(idf <= 0, IDF_FLOOR).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
        return j.groupBy(self.key, *extra).agg((-F.sum(part)).alias("rank"))


def build_index(spark: SparkSession, texts: DataFrame, key: str, text: str, extra: tuple[str, ...] = ()) -> KeywordIndex:
    """The index of texts (key unique). extra: columns that are kept beside the postings, such as a type to filter by.

    Null and blank texts count for the corpus' figures with no terms. A null key is a text like any other.
    """
    tmp = Scratch(spark)
    cut = texts.select(key, *extra, tokens(text).alias("t")).withColumn("len", F.size("t"))
    terms = cut.select(key, *extra, "len", F.explode("t").alias("term"))
    postings = terms.groupBy("term", key, *extra, "len").agg(F.count("*").cast("int").alias("tf"))
    postings = tmp.cut(postings.repartitionByRange("term", key).sortWithinPartitions("term", key))
    held = postings.groupBy().agg(F.sum("tf").alias("total"))
    n = texts.agg(F.count("*").alias("n"))
    stats = tmp.cut(n.join(held).select("n", (F.col("total") / F.col("n")).alias("avgdl")))
    return KeywordIndex(postings, stats, key)


_kept: dict[tuple, KeywordIndex] = {}


def kept_index(spark: SparkSession, name: str, texts: DataFrame, key: str, text: str, extra: tuple[str, ...] = ()) -> KeywordIndex:
    """The index of that name in this session, built when it is first asked for; drop_index() makes room for a new one."""
    at = (spark.sparkContext.applicationId, name)
    if at not in _kept:
        _kept[at] = build_index(spark, texts, key, text, extra)
    return _kept[at]


def drop_index(spark: SparkSession, name: str) -> None:
    """SK3: delete-all; the next question builds the index again."""
    _kept.pop((spark.sparkContext.applicationId, name), None)


def added(spark: SparkSession, index: KeywordIndex, texts: DataFrame, text: str, extra: tuple[str, ...] = ()) -> KeywordIndex:
    """SK3: the index with a batch of texts more; only the batch is taken apart. A key that the index has must not come again."""
    new = build_index(spark, texts, index.key, text, extra)
    total = F.sum(F.col("n") * F.coalesce("avgdl", F.lit(0.0)))
    stats = index.stats.unionByName(new.stats).agg(F.sum("n").alias("n"), (total / F.sum("n")).alias("avgdl"))
    return KeywordIndex(index.postings.unionByName(new.postings), stats, index.key)


def newest_first(df: DataFrame, by: Column, created: str, key: str, k: int) -> DataFrame:
    """SL2: the first k by a column, of equals the newest, then by key, with pos from 0."""
    order = [by, F.col(created).desc_nulls_last(), F.col(key)]
    return df.orderBy(*order).limit(k).withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)  # k rows
