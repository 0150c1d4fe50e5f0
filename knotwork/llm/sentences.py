"""Sentence units of documents in any script.

Lines first: fenced blocks, headings, list items and table rows are blocks of their own, an empty line ends
a paragraph, a single line break is a blank. Within a paragraph all marks that may end a sentence, or open
or close a quotation, form a lattice of gaps; a gap is a node of the result if no quotation or bracket is
open across it and its surroundings say so: the word before it (abbreviations, initials, numbers), the mark
itself, and how the next word opens. Which words are abbreviations or open sentences is learned from the
corpus (lexicon.py); which marks end sentences is a property that Unicode gives them.

Chinese and Japanese have gaps that no mark decides: the text after a closing quotation or a row of dots.
There the whole runs at both sides are segmented by the cheapest path through a lattice of the corpus'
words, and the gap is judged by how often the last word stands before a stop and the first behind one.
Thai and Lao have no stops: every blank between two of their letters ends a unit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from knotwork.llm.lexicon import CJK, Lexicon, keys_of, learned

#: Marks that end sentences, of all scripts, by Unicode's own property; full stops and dots of ellipses aside.
STOPS = "".join(regex.findall(r"\p{SB=STerm}", "".join(map(chr, range(0x80, 0x20000))))) + "།༎;;"
#: Unicode counts this mark of Georgian and other scripts among those that do not end sentences.
_HARD = frozenset(STOPS) - frozenset(";;")

_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})(.*)")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_ITEM = re.compile(r"[ \t]*(?:[-*+•◦‣]|\d{1,3}[.)]|[a-z]\))[ \t]+(?=\S)")
_STAMP = re.compile(r"[ \t]*(?:\[\d{1,2}:\d\d(?::\d\d)?\]|\d{1,2}[.:]\d\d(?::\d\d)?[ \t]+[—–-])[ \t]+")
_LINES = re.compile(r"\r\n|\r|\n")
_OPEN, _CLOSE = "([{（［【「『《〈«„“‘‚", {")": "(", "]": "[", "}": "{", "）": "（", "］": "［", "】": "【", "」": "「", "』": "『", "》": "《", "〉": "〈", "»": "«", "”": "“„", "’": "‘‚"}
_AFTER = frozenset(")]}）］】」』》〉»”’\"'")
_CJK = CJK
#: Scripts that have no stops: a blank between two of their letters ends a unit.
_STOPLESS = "ก-ฺเ-๎ກ-ຽເ-ໟ"
_SIGNS = "\"()\\[\\]（）［］【】「」『』《》〈〉«»„“”"
#: A set with characters beyond the basic plane is searched one by one for every character of a text, so it is used only where one of them occurs.
_FAR_STOPS = frozenset(c for c in STOPS if c > "\uffff")
_NEAR_STOPS = "".join(c for c in STOPS if c <= "\uffff")


def _event(stops: str) -> re.Pattern:
    return re.compile(rf"[.…]+[!?]*|[!?{stops}][!?！？。.…]*|[{_SIGNS}]|(?<=[{_STOPLESS}])[ \t\xa0\r\n]+(?=[{_STOPLESS}])")


_EVENT, _NEAR_EVENT = _event(STOPS), _event(_NEAR_STOPS)
#: The same where scripts without stops don't occur: it begins with a set, so that re skips to the next of its characters.
_MARKS = re.compile(rf"[.…!?{_NEAR_STOPS}{_SIGNS}](?:(?<=[.…])[.…]*[!?]*|(?<=[!?{_NEAR_STOPS}])[!?！？。.…]*|)")
_HAS_STOPLESS, _HAS_FAR = re.compile(rf"[{_STOPLESS}]"), re.compile("[\U00010000-\U0010ffff]")
#: What the last line of a paragraph ends in where a list may begin right below it.
_BEHIND = frozenset(STOPS) | frozenset(".!?…:：”\"»）)」")
_IS_CJK = re.compile(rf"[{_CJK}]")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_BEFORE_WORD = frozenset("([{«„“\"‘（「『¿¡|")
_NEXT = re.compile(r"[^\s]+")
_PLAIN_LOW = re.compile(r"[a-zß-öø-ÿа-яёά-ώα-ω'’]+[,;:.!?)»”\"…]*$")


def _marks_of(text: str) -> re.Pattern:
    """The pattern that finds in text what _EVENT finds, with the least work."""
    if text.isascii():
        return _MARKS
    if _HAS_FAR.search(text) and not _FAR_STOPS.isdisjoint(text):
        return _EVENT
    return _NEAR_EVENT if _HAS_STOPLESS.search(text) else _MARKS


def _word_at(text: str, start: int, dot: int) -> int:
    """Where the word that ends at dot begins: behind white space or an opening sign, however far away."""
    if dot > start and not text[dot - 1].isspace():
        word = text[max(start, dot - 32) : dot].rsplit(None, 1)[-1]
        if word.isalpha() and (len(word) < 32 or dot - 32 <= start):
            return dot - len(word)
    i = dot
    while i > start and not text[i - 1].isspace() and text[i - 1] not in _BEFORE_WORD:
        i -= 1
    return i


def _before(text: str, start: int, at: int) -> str:
    """The run of other than white space before the word at at."""
    j = at
    while j > start and text[j - 1] in _BEFORE_WORD:
        j -= 1
    while j > start and text[j - 1].isspace():
        j -= 1
    i = j
    while i > start and not text[i - 1].isspace():
        i -= 1
    return text[i:j]


def _run(text: str, at: int, step: int, start: int, end: int) -> str:
    """The whole run of a spaceless script that ends before at (step -1) or begins there (step 1)."""
    i = at
    if step < 0:
        while i > start and not _IS_CJK.match(text[i - 1]):
            i -= 1
        j = i
        while i > start and _IS_CJK.match(text[i - 1]):
            i -= 1
        return text[i:j]
    while i < end and _IS_CJK.match(text[i]):
        i += 1
    return text[at:i]


def _goes_on(text: str, before: int, after: int, start: int, end: int, lex: Lexicon) -> bool:
    """Whether a gap in a spaceless script that no stop decides lies within a sentence: by the words at both sides. Knowing neither, it ends one."""
    return lex.odds(_run(text, before, -1, start, end), _run(text, after, 1, start, end)) < 0


def _low(text: str, at: int) -> bool:
    """Whether a plain word in small letters begins there: no name, path or other code."""
    m = _NEXT.match(text, at)
    return bool(m and _PLAIN_LOW.match(m.group()))


def _abbreviated(text: str, start: int, dot: int, nxt: int, lex: Lexicon) -> bool:
    """Whether the single full stop at dot belongs to the word before it and the sentence goes on at nxt."""
    at = _word_at(text, start, dot)
    w = text[at:dot]
    if not w:
        return False
    keys = keys_of(w, _before(text, start, at) if len(w) <= 3 else "")
    follow = _NEXT.match(text, nxt)
    follow = follow.group() if follow else ""
    first = follow.lstrip("([{„“«\"'")[:1]
    if first.isdigit() and not lex.numbered.isdisjoint(keys) or not lex.never.isdisjoint(keys):
        return True
    if not lex.maybe.isdisjoint(keys):
        return _low(text, nxt)
    k = keys[0]
    if k.endswith(" X"):  # an initial, unless the words around it are known to end and open sentences
        return follow[:1].isupper() and len(follow) > 1 and follow.rstrip(",;:") not in lex.openers and k not in lex.closed
    # a short capital word that the corpus never has without a stop, before a name or a number
    if w[0].isupper() and len(k) <= 4 and k not in lex.short and w.isalpha():
        return first.isdigit() or first.isupper() and len(follow) > 1 and follow.rstrip(",;:.") not in lex.openers
    return False


def _ends(text: str, start: int, a: int, b: int, end: int, lex: Lexicon) -> bool:
    """Whether the marks text[a:b] end the sentence begun at start, in a paragraph that ends at end."""
    nxt = b
    while nxt < end and text[nxt].isspace():
        nxt += 1
    if nxt == end:
        return True
    run, gap, c = text[a:b], nxt > b, text[nxt]
    if run[0] in ";;":
        return (gap or run[0] == ";") and bool(_GREEK.search(text, start, a))
    if run[0] in _HARD:
        return True
    if not gap:
        if _IS_CJK.match(c):
            return not (run[0] == "…" or len(run) > 1 and run[0] == ".") or not _goes_on(text, a, nxt, start, end, lex)
        return run[-1] in "!?" and c.isupper() and a > start and (text[a - 1].isalnum() or text[a - 1] in "=)")
    if "!" in run or "?" in run:
        return c not in ",;:—–"
    if run[0] == "…" or len(run) > 1:
        if text[a - 1 : a].isspace() and c.islower():
            return False
        if _IS_CJK.match(text[a - 1 : a] or " "):
            return not _goes_on(text, a, nxt, start, end, lex)
        return not _low(text, nxt)
    return c not in ",;:" and not _abbreviated(text, start, a, nxt, lex)


def _closes(text: str, start: int, opened: int, closed: int, end: int, lex: Lexicon) -> bool:
    """Whether the sentence ends behind a quotation or bracket whose last sentence is finished."""
    inner = closed - 1
    while inner > opened and (text[inner].isspace() or text[inner] in _AFTER):
        inner -= 1
    if (text[inner] not in ".!?…;;" and text[inner] not in _HARD) or inner <= opened:
        return False
    if text[inner] in ";;" and not _GREEK.search(text, opened, inner):
        return False
    at = _word_at(text, opened + 1, inner)
    if text[inner] == "." and not lex.never.isdisjoint(keys_of(text[at:inner], _before(text, opened + 1, at))):
        return False
    nxt = closed + 1
    while nxt < end and text[nxt].isspace():
        nxt += 1
    if nxt >= end:
        return True
    c, before = text[nxt], text[start:opened].rstrip()
    at_start = not before or before[-1] in "¿¡"
    bracket = text[opened] in "([{（［【"
    if bracket:
        return at_start and c not in ",;:.!?，、；：。"
    if c in ",;:—–-，、；：.!?。！？…":
        return False
    told = bool(before) and before[-1] in ":：,，،、"
    if c.islower():
        return told and not _low(text, nxt)
    if c.isupper() or c.isdigit() or c in "¿¡«„“\"(《「『（[*_`<|=#№":
        return told or nxt > closed + 1
    if at_start:
        return nxt > closed + 1 and bool(_IS_CJK.match(c)) and not _goes_on(text, closed, nxt, start, end, lex)
    return told


def _paragraph(text: str, a: int, b: int, first: int, out: list[tuple[int, int]], lex: Lexicon, marks: re.Pattern = _EVENT) -> None:
    """Appends the sentences of text[a:b]; marks before first (a list mark, a time stamp) are not looked at."""
    events = list(marks.finditer(text, first, b))
    # the lattice of openings and closings: only pairs count
    partner: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for k, m in enumerate(events):
        c = m.group()
        if c == '"':
            i = m.start()
            if stack and any(s == '"' for s, _ in stack):
                while stack[-1][0] != '"':
                    stack.pop()
                partner[stack.pop()[1]] = k
            elif i + 1 < b and not text[i + 1].isspace():
                stack.append(('"', k))
        elif c == "“" and stack and any(s == "„" for s, _ in stack):
            while stack[-1][0] != "„":
                stack.pop()
            partner[stack.pop()[1]] = k
        elif len(c) == 1 and c in _OPEN:
            stack.append((c, k))
        elif c in _CLOSE and any(s in _CLOSE[c] for s, _ in stack):
            while stack[-1][0] not in _CLOSE[c]:
                stack.pop()
            partner[stack.pop()[1]] = k
    start, k, n = a, 0, len(events)
    while k < n:
        m = events[k]
        if k in partner:
            close = partner[k]
            o, e = m.start(), events[close].end()
            k = close + 1
            if _closes(text, start, o, events[close].start(), b, lex):
                while e < b and text[e] in _AFTER:
                    e += 1
                out.append((start, e))
                start = e
            continue
        k += 1
        i, j = m.start(), m.end()
        if i < start:
            continue
        c = m.group()
        if c[0].isspace():
            out.append((start, i))
            start = i
        elif c[0] not in '"()[]（）［］【】「」『』《》〈〉«»„“”':
            if c[0] == "." and len(c) == 1 and j < b and not text[j].isspace() and text[j] not in _AFTER and not _IS_CJK.match(text[j]):
                continue
            while j < b and text[j] in _AFTER and not any(e.start() == j and q in partner for q, e in enumerate(events[k : k + 1], k)):
                j += 1
            if _ends(text, start, i, m.end(), b, lex) or j > m.end() and _ends_behind(text, start, i, m.end(), j, b, lex):
                out.append((start, j))
                start = j
    out.append((start, b))


def _ends_behind(text: str, start: int, a: int, b: int, j: int, end: int, lex: Lexicon) -> bool:
    """Marks before closing signs that nothing opened."""
    nxt = j
    while nxt < end and text[nxt].isspace():
        nxt += 1
    return nxt == end or (nxt > j and not text[nxt].islower() and text[nxt] not in ",;:") and not (text[a:b] == "." and _abbreviated(text, start, a, nxt, lex))


def blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, first) of the blocks of a text in order: first is -1 where a block is one unit, else what is before first are its marks."""
    fence, fence_at, para = "", 0, -1
    at, end = 0, len(text)
    cuts = [(m.start(), m.end()) for m in _LINES.finditer(text)]
    cuts.append((end, end))
    last_end, prev = 0, "blank"
    for stop, after in cuts:
        line_at, at = at, after
        if fence:
            m = _FENCE.match(text, line_at, stop)
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not m.group(2).strip():
                yield fence_at, stop, -1
                fence, prev = "", "block"
            continue
        line = text[line_at:stop].rstrip()
        head = line.lstrip()
        if not head:
            kind = "blank"
        else:
            c, kind, first = head[0], "text", line_at
            if c in "`~" and _FENCE.match(text, line_at, stop) and not (c == "`" and "`" in head.lstrip("`")):
                kind = "fence"
            elif c == "#" and _HEADING.match(text, line_at, stop):
                kind = "heading"
            elif c == "|":
                kind = "row"
            elif (c in "-*+•◦‣" or c.isdigit() or c.isalpha() and head[1:2] == ")") and (m := _ITEM.match(text, line_at, stop)) and (prev != "text" or text[last_end - 1 : last_end] in _BEHIND):
                kind, first = "item", m.end()
            elif (c == "[" or c.isdigit()) and (m := _STAMP.match(text, line_at, stop)) and (prev != "text" or c == "[" or text[last_end - 1 : last_end] in _BEHIND):
                kind, first = "stamp", m.end()
        if kind != "text" and para >= 0:
            yield para, last_end, para_first
            para = -1
        if kind == "fence":
            fence, fence_at = _FENCE.match(text, line_at, stop).group(1), line_at
        elif kind in ("heading", "row"):
            yield line_at, stop, -1
            prev = "block"
        elif kind == "item":
            yield line_at, stop, first
            prev = "item"
        elif kind == "stamp":
            para, para_first, prev = line_at, first, "text"
        elif kind == "text":
            if para < 0:
                para, para_first = line_at, line_at
            prev = "text"
        else:
            prev = "blank"
        last_end = line_at + len(line)
    if fence:
        yield fence_at, end, -1
    if para >= 0:
        yield para, last_end, para_first


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """The blocks that may hold several units, without their marks."""
    for a, b, first in blocks(text):
        if first >= 0:
            yield first, b


def sentences(text: str | None, lex: Lexicon) -> list[tuple[int, int]]:
    """(start, end) of the units of a text, in code points, without outer white space."""
    out: list[tuple[int, int]] = []
    text = text or ""
    marks = _marks_of(text)
    for a, b, first in blocks(text):
        if first < 0:
            out.append((a, b))
        else:
            _paragraph(text, a, b, first, out, lex, marks)
    done = []
    for a, b in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            done.append((a, b))
    return done


def sentence_units(docs: DataFrame, key: str, text: str, lex: Lexicon | None = None) -> DataFrame:
    """key, start_char, end_char of every unit of every document.

    Units cover all of a text but white space, in order, whatever its length. A null, empty or blank text has
    none. Repeated rows give repeated units, keys may be null, other columns are ignored; an empty table
    gives no rows. The lexicon is learned from all documents unless it is given; then they are cut each by
    itself, so nothing but counts is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lex or learned(docs, text, paragraphs))  # what was found, see the lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                spans = sentences(t, shared.value)
                rows += [i] * len(spans)
                starts += [a for a, _ in spans]
                ends += [b for _, b in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "start_char", "end_char"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, start_char int, end_char int")
