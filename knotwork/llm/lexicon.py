"""What a corpus knows about its sentences: abbreviations, opening words, and the words of spaceless scripts.

Nothing is listed by hand. One pass over all documents counts, for every word before a full stop, how often
it ends a block and what follows it; for every word, how often it opens a sentence that surely begins; and
for the short strings of spaceless scripts, how often they occur, stand before a stop and stand behind one.

- A word whose stop hardly ever ends a block, though blocks do end in stops, is an abbreviation: its stop
  belongs to it. A stop after a number or a capital letter is judged together with the word before it.
- A word whose stop is often followed by a small letter may end a sentence; the letter decides.
- A word whose stop is often followed by a number goes on with the number.
- An opening word stands at sure beginnings far more often than elsewhere.

Every key is judged, rare ones too, each by itself where its counts lie; what is sent to every task is what was
found (the lexicon), not what was looked at. Strings of more than LETTERS characters are no words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.scratch import Scratch

LETTERS = 40
LONGEST = 4
_OPENERS = "([{（［【「『《〈«„“\"‘‚'¿¡*_`"
_CLOSERS = ")]}）］】」』》〉»”’\"'*_`"
_QUOTES = frozenset("»”’\"'」』")
#: Patterns begin with a character or a set of characters, so that re skips to the next place in question.
_DOT = re.compile(rf"\.(?<=[^\s.…!?]\.)[{re.escape(_CLOSERS)}]*(?=\s|$)")
_FOLLOW = re.compile(r"\s*(\S+)")
_SURE = re.compile(rf"[!?][{re.escape(_CLOSERS)}]*\s+(\S+)")
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_RUN = re.compile(f"[{CJK}][{CJK}]*")
_CJK_STOPS, _CJK_CLOSERS = "。！？", "」』”）"


def normal(word: str) -> str:
    word = word.strip(_OPENERS)
    return word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()


def keys_of(word: str, before: str) -> list[str]:
    """The keys under which a word before a full stop is counted; before: the word before it, looked at if the word is short."""
    w = word.lstrip(_OPENERS)
    if w.isdigit():
        return [f"{normal(before)} #"] if len(w) <= 2 else ["##"]
    if len(w) == 1 and w.isupper():
        return [f"{normal(before)} X"]
    k = normal(w)
    return [k, f"{normal(before)} {k}"] if before and len(w) <= 3 else [k]


def _word_before(text: str, i: int) -> str:
    """The run of other than white space that ends before i, white space between them aside."""
    near = text[max(0, i - 64) : i].rsplit(None, 1)
    if len(near) == 2 or i <= 64:
        return near[-1] if near else ""
    end = _end_before(text, i)
    return text[_begin(text, end) : end]


def _begin(text: str, i: int) -> int:
    """Where the run of other than white space that ends at i begins."""
    while i and not text[i - 1].isspace():
        i -= 1
    return i


def _end_before(text: str, i: int) -> int:
    while i and text[i - 1].isspace():
        i -= 1
    return i


@dataclass
class Lexicon:
    """keys that never end a sentence, may end one, go on with a number, or (capital letters) do end one; short words that stand without a stop or end blocks; opening words; cost, final and opening odds of spaceless words."""

    never: set = field(default_factory=set)
    maybe: set = field(default_factory=set)
    numbered: set = field(default_factory=set)
    closed: set = field(default_factory=set)
    short: set = field(default_factory=set)
    openers: set = field(default_factory=set)
    costs: dict = field(default_factory=dict)
    finals: dict = field(default_factory=dict)
    starts: dict = field(default_factory=dict)

    def words(self, run: str) -> list[str]:
        """The cheapest path through the lattice of words over a whole run; an unknown character costs more than any word."""
        n, costs = len(run), self.costs
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                c = costs.get(run[i:j], 14.0 if j == i + 1 else math.inf)
                if best[i] + c < best[j]:
                    best[j], back[j] = best[i] + c, i
        out, j = [], n
        while j:
            out.append(run[back[j] : j])
            j = back[j]
        return out[::-1]

    def odds(self, left: str, right: str) -> float:
        """Log odds that a sentence ends between two runs of a spaceless script; above 0 it does. What is unknown says nothing."""
        last, first = self.words(left)[-1:], self.words(right)[:1]
        return (self.finals.get(last[0], 0.0) if last else 0.0) + (self.starts.get(first[0], 0.0) if first else 0.0)


def observed(text: str, paragraphs: Callable[[str], Iterator[tuple[int, int]]], counts: dict[str, Counter]) -> None:
    """Adds what a text says to counts: dot (key, what follows), word, open; run, last and first of spaceless scripts."""
    dot, opened = counts["dot"], counts["open"]
    counts["word"].update(text.split())
    for a, b in paragraphs(text):
        part = text[a:b]
        first = part.split(None, 1)[:1]
        if first:
            opened[first[0]] += 1
        for m in _DOT.finditer(part):
            i = m.start()
            word = part[max(0, i - 25) : i].rsplit(None, 1)[-1]
            if len(word) > 24:
                continue
            nxt = _FOLLOW.match(part, m.end())
            keys = keys_of(word, _word_before(part, i - len(word)) if len(word.lstrip(_OPENERS)) <= 3 else "")
            if nxt is None or nxt.group(1)[0] in _QUOTES or m.end() - i > 1 and not _QUOTES.isdisjoint(m.group()):  # a quotation ends in a stop of its own
                what = "end"
            else:
                c = nxt.group(1).lstrip(_OPENERS)[:1]
                what = "digit" if c.isdigit() else "low" if c.islower() else "up" if c.isupper() else "other"
            for k in keys:
                dot[k, what] += 1
        for m in _SURE.finditer(part):
            opened[m.group(1)] += 1
    if text.isascii():
        return
    done = 0  # behind the run or the stop looked at last
    for m in _RUN.finditer(text):
        run, i, j = m.group(), m.start(), m.end()
        counts["run"][run] += 1
        before = i - 1
        while before >= done and text[before] in _CJK_CLOSERS:
            before -= 1
        if before >= done and text[before] in _CJK_STOPS:
            counts["first"][run[:LONGEST]] += 1
            done = j
        elif text[j : j + 1] and text[j] in _CJK_STOPS:
            counts["last"][run[-LONGEST:]] += 1
            done = j + 1
        elif i == 0 or text[i - 1] == "\n":
            counts["first"][run[:LONGEST]] += 1
            done = j


def expanded(counts: dict[str, Counter]) -> dict[str, Counter]:
    """The counts with the strings of the runs of spaceless scripts in place of the runs."""
    gram, final, start = Counter(), Counter(), Counter()
    for run, c in counts["run"].items():
        for n in range(1, LONGEST + 1):
            for i in range(len(run) - n + 1):
                gram[run[i : i + n]] += c
    for end, c in counts["last"].items():
        for n in range(1, len(end) + 1):
            final[end[-n:]] += c
    for begin, c in counts["first"].items():
        for n in range(1, len(begin) + 1):
            start[begin[:n]] += c
    return {"dot": counts["dot"], "word": counts["word"], "open": counts["open"], "gram": gram, "final": final, "start": start}


def counted(docs: DataFrame, text: str, paragraphs: Callable[[str], Iterator[tuple[int, int]]]) -> DataFrame:
    """kind, k, what, n: the counts of all documents, pre-aggregated in the tasks."""
    kinds = ("dot", "word", "open", "run", "last", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: Counter() for k in kinds}

        def flush() -> pa.RecordBatch:
            rows = [(kind, *((k, "") if kind != "dot" else k), n) for kind, c in expanded(counts).items() for k, n in c.items() if kind == "dot" or len(k) <= LETTERS]
            for c in counts.values():
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())], names=["kind", "k", "what", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    observed(t, paragraphs, counts)
            if sum(map(len, counts.values())) > 400_000:
                yield flush()
        yield flush()

    return docs.select(text).mapInArrow(run, "kind string, k string, what string, n long")


def share(end: int, all_: int) -> float:
    """The share of stops that end a block, kept off 0 and 1."""
    return min(0.9, max(0.02, end / max(1, all_)))


def verdicts(k: str, c: dict[str, int], plain: int, e0: float) -> Iterator[str]:
    """The sets of the lexicon in which a key belongs by what follows its stop; plain: how often it stands without one."""
    n, end = sum(c.values()), c.get("end", 0)
    inside = n - end
    small = c.get("low", 0) + c.get("digit", 0)
    size = len(k.split(" ")[-1].replace(".", ""))
    score = end * math.log(0.01 / e0) + inside * math.log(0.99 / (1 - e0)) + min(small, 6) * 0.8 - 0.5 * max(0, size - 3)
    dotted = n / (n + plain)
    mixed, pair = k.endswith((" #", " X")), " " in k
    word = not any(ch.isdigit() for ch in k)
    low, digit = c.get("low", 0), c.get("digit", 0)
    numbered = digit >= 3 and digit / max(1, inside) >= 0.3 and not pair and word and size <= 5 and n >= 5 and end / n < e0 / 4
    if pair and not mixed:  # two words: only where small letters or numbers follow
        if n >= 5 and score > 1.5 and small / max(1, inside) >= 0.3 and word:
            yield "never"
        elif n >= 5 and low / max(1, inside) >= 0.3 and word:
            yield "maybe"
    elif numbered and small / max(1, inside) < 0.95:
        pass
    elif n >= 3 and score > 1.5 and (mixed or dotted >= 0.5) and (mixed or word):
        yield "never"
    elif n >= 3 and inside and low / inside >= 0.12 and (dotted >= 0.5 or "." in k) and size <= 6 and word and not mixed:
        yield "maybe"
    if mixed and n >= 2 and end * 5 >= n:
        yield "closed"
    if numbered:
        yield "numbered"
    if len(k) <= 4 and end:
        yield "short"


def cohesive(g: str, n: int, singles: dict[str, int], whole: int) -> bool:
    """Whether a string of a spaceless script is a word: any character is, longer ones that are far more frequent than chance has them."""
    return len(g) == 1 or n >= 5 and n * whole ** (len(g) - 1) > 20 * math.prod(singles.get(c, 1) for c in g)


def judged(dots: Counter, words: Counter, exact: Counter, opened: Counter, grams: Counter, finals: Counter, starts: Counter) -> Lexicon:
    """The lexicon of counts. words: by small letters; exact: as written."""
    lex = Lexicon()
    by: dict[str, dict[str, int]] = {}
    for (k, what), n in dots.items():
        by.setdefault(k, {})[what] = n
    e0 = share(sum(n for (_, w), n in dots.items() if w == "end"), sum(dots.values()))
    for k, c in by.items():
        for kind in verdicts(k, c, words.get(k, 0), e0):
            getattr(lex, kind).add(k)
    lex.short |= {w for w in words if len(w) <= 4}
    for w, n in opened.items():
        if n >= 3 and n / max(n, exact.get(w, n)) >= 0.4:
            lex.openers.add(w)
    whole = sum(n for g, n in grams.items() if len(g) == 1) or 1
    for g, n in grams.items():
        if cohesive(g, n, grams, whole):
            lex.costs[g] = math.log(whole / n) + 1
    f0, s0 = sum(n for g, n in finals.items() if len(g) == 1) / whole, sum(n for g, n in starts.items() if len(g) == 1) / whole
    for out, seen, base in ((lex.finals, finals, f0), (lex.starts, starts, s0)):
        for g, n in seen.items():
            if g in lex.costs:
                rest = max(0, grams[g] - n)
                out[g] = math.log((n + 0.5 * base) / (rest + 0.5) / (base / max(1e-9, 1 - base) + 1e-9))
        for g in lex.costs:
            if g not in out and grams[g] >= 5:
                out[g] = math.log(0.5 * base / (grams[g] + 0.5) / (base / max(1e-9, 1 - base) + 1e-9))
    return lex


def learned(docs: DataFrame, text: str, paragraphs: Callable[[str], Iterator[tuple[int, int]]]) -> Lexicon:
    """The lexicon of all documents, as judged() gives it of all their counts; keys are judged in tasks, and what belongs in the lexicon comes to the driver."""
    all_ = counted(docs, text, paragraphs).groupBy("kind", "k", "what").agg(F.sum("n").alias("n"))
    all_ = all_.groupBy("kind", "k").agg(F.map_from_entries(F.collect_list(F.struct("what", "n"))).alias("c"), F.sum("n").alias("n"))  # at most five a key
    all_ = Scratch(docs.sparkSession).cut(all_)
    of = lambda kind, n="n": all_.where(F.col("kind") == kind).select("k", F.col("n").alias(n))
    dot = all_.where("kind = 'dot'")
    ends = dot.agg(F.sum(F.coalesce(F.col("c")["end"], F.lit(0))).alias("e"), F.sum("n").alias("n")).first()
    e0 = share(ends["e"] or 0, ends["n"] or 0)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(kind, k) for k, c, plain in zip(*(x.to_pylist() for x in b.columns)) for kind in verdicts(k, dict(c), plain, e0)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["kind", "k"])

    low = of("word").groupBy(F.lower("k").alias("k")).agg(F.sum("n").alias("plain"))
    found = dot.select("k", "c").join(low, "k", "left").select("k", "c", F.coalesce("plain", F.lit(0)).alias("plain")).mapInArrow(decide, "kind string, k string")
    short = low.where(F.length("k") <= 4).select(F.lit("short").alias("kind"), "k")
    opened = of("open").where("n >= 3").join(of("word", "exact"), "k", "left").where(F.col("n") / F.greatest("n", "exact") >= F.lit(0.4)).select(F.lit("openers").alias("kind"), "k")

    singles = of("gram").where(F.length("k") == 1).toArrow()  # the characters of the spaceless scripts, some 28,000
    singles = dict(zip(singles["k"].to_pylist(), singles["n"].to_pylist()))
    whole = sum(singles.values()) or 1

    def whole_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([cohesive(k, n, singles, whole) for k, n in zip(*(x.to_pylist() for x in b.columns))], pa.bool_()))

    grams = of("gram").where((F.length("k") == 1) | (F.col("n") >= 5)).mapInArrow(whole_words, "k string, n long")
    grams = grams.join(of("final", "final"), "k", "left").join(of("start", "start"), "k", "left").select("k", "n", "final", "start").toArrow().to_pydict()
    counts = [Counter({k: n for k, n in zip(grams["k"], grams[c]) if n}) for c in ("n", "final", "start")]
    lex = judged(Counter(), Counter(), Counter(), Counter(), *counts)
    for kind, k in zip(*found.unionByName(short).unionByName(opened).toArrow().to_pydict().values()):
        getattr(lex, kind).add(k)
    return lex
