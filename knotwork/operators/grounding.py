"""What a summary of results rests on: search hints, attributions, and evidence from symbols and call sites (RT16, SF9, SF16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.scalars import compact
from knotwork.operators.texts import coalesced_sites

# Words that are no hints, and short ones that are.
STOP = """about after also and are been being between both but can codebase concept concepts could does each for from have how into its local
matches most not only other our out over same should that the their them then there these they this those under use used using what when where which while with work""".split()
SHORT = ["ai", "db", "ml", "llm", "api", "sdk", "cli", "ux", "ui"]
# Weights of a term by where it stands, the excerpt's characters, and the numbers of symbols, callers and callees.
CONCEPT, ORIGIN, EXCERPT, EXCERPT_CHARS, SYMBOLS, CALLERS, CALLEES = 3, 2, 1, 320, 30, 5, 8


def hint_terms(text: Column | str, extra_stop: tuple[str, ...] = ()) -> Column:
    """SF9: the ASCII words of a text in small letters: no stop words, no numbers, none of two letters but a few."""
    c = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.filter(words, lambda w: ~w.isin([*STOP, *extra_stop]) & ((F.length(w) > 2) | w.isin(SHORT)) & ~w.rlike("^[0-9]+$"))


def summary_hints(matches: DataFrame, question: str, most: int) -> DataFrame:
    """SF9: term, score, pos: the terms that a summary of matches (pos from 0, concept, origin, content) should know, without those of the question.

    A term scores in its match's place from the end: three times in the concept's name, twice in the origin, once (each text once)
    in the first EXCERPT_CHARS characters; ties by term.
    """
    n = matches.agg(F.count("*").alias("__n"))
    m = matches.join(F.broadcast(n)).withColumn("w", F.greatest(F.lit(1), F.col("__n") - F.col("pos")))  # one row
    parts = F.array(
        F.struct(F.lit(CONCEPT).alias("f"), hint_terms("concept").alias("t")),
        F.struct(F.lit(ORIGIN).alias("f"), hint_terms("origin").alias("t")),
        F.struct(F.lit(EXCERPT).alias("f"), F.array_distinct(hint_terms(compact("content", EXCERPT_CHARS))).alias("t")),
    )
    terms = m.select("w", F.explode(parts).alias("p")).select((F.col("w") * F.col("p.f")).alias("s"), F.explode("p.t").alias("term"))
    asked = terms.sparkSession.range(1).select(F.explode(hint_terms(F.lit(question))).alias("term"))
    scored = terms.join(F.broadcast(asked.distinct()), "term", "left_anti").groupBy("term").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "term").limit(max(1, most))  # the words of a question
    return scored.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "term")))


def without_places(text: Column | str) -> Column:
    """SF16: a claim without its marks of place, [file:line]."""
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\[[^\[\]\s]+:\d+\]", ""), " {2,}", " "))


def claims(texts: DataFrame, key: str, text: str) -> DataFrame:
    """SF16: key, line, claim, concepts of each line that attributes something to concepts, [[a, b]]."""
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "said"))
    inner = F.regexp_extract_all("said", F.lit(r"\[\[([^\]]+)\]\]"), 1)
    names = F.array_distinct(F.filter(F.flatten(F.transform(inner, lambda s: F.transform(F.split(s, ","), lambda x: F.trim(x)))), lambda x: x != ""))
    out = lines.withColumn("concepts", names).where(F.size("concepts") > 0)
    return out.select(key, (F.col("line") + 1).alias("line"), without_places(F.regexp_replace("said", r"\s*\[\[[^\]]+\]\]", "")).alias("claim"), "concepts")


def symbol_evidence(matches: DataFrame, bindings: DataFrame, symbols: DataFrame, most: int = SYMBOLS) -> DataFrame:
    """RT16: pos, file_path, line, term: the symbols that the matches (pos, concept_id) are bound to, each place once, at most `most` in the order of match, confidence and symbol.

    bindings: concept_id, symbol_id, confidence; symbols: symbol_id, name, file_path, line_start.
    """
    j = matches.select("pos", "concept_id").join(bindings.select("concept_id", "symbol_id", "confidence"), "concept_id").join(symbols, "symbol_id")
    first = j.groupBy("file_path", F.col("line_start").alias("line")).agg(F.min(F.struct("pos", (-F.coalesce("confidence", F.lit(0.0))).alias("minus"), "symbol_id", "name")).alias("b"))
    order = ["b.pos", "b.minus", "b.symbol_id", "file_path", "line"]
    top = first.orderBy(*order).limit(most)
    return top.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("pos"), "file_path", "line", F.col("b.name").alias("term"), F.col("b.symbol_id").alias("symbol_id"))  # `most` rows


def call_evidence(symbols: DataFrame, sites: DataFrame, callers: int = CALLERS, callees: int = CALLEES) -> DataFrame:
    """RT16: caller, file, first_line, last_line, sites: where the evidence's symbols (name) are called and call others, near sites as one span.

    sites: caller, callee, file, line; of each symbol the first `callers` and `callees` by file and line.
    """
    names = symbols.select(F.col("name")).distinct()
    up = Window.partitionBy("name").orderBy("file", "line", "caller")
    down = Window.partitionBy("name").orderBy("file", "line", "callee")
    into = sites.join(names, F.col("callee") == F.col("name")).withColumn("rn", F.row_number().over(up)).where(F.col("rn") <= callers)
    out = sites.join(names, F.col("caller") == F.col("name")).withColumn("rn", F.row_number().over(down)).where(F.col("rn") <= callees)
    both = into.select("name", "file", "line").unionByName(out.select("name", "file", "line")).withColumnRenamed("name", "caller")
    return coalesced_sites(both)
