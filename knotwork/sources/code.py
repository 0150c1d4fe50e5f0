"""Symbols, calls and imports of source text (SC8-SC10), by patterns instead of parsers: an approximation.

One text is one row, so texts of any number are spread; each function below takes one text.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# What defines a symbol in each language, kind by pattern; the first group is the name.
_TS = [("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*="), ("enum", r"^\s*(?:export\s+)?enum\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?(?:\(|function\b|\w+\s*=>)"), ("method", r"^\s+(?:(?:public|private|protected|static|async|override|get|set)\s+)*\*?(?!(?:if|for|while|switch|catch|function|return|with|do)\b)(\w+)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^={;]+)?\{\s*$")]
DEFINITIONS = {
    "typescript": _TS,
    "javascript": _TS,
    "python": [("class", r"^\s*class\s+(\w+)"), ("function", r"^(?:async\s+)?def\s+(\w+)"), ("method", r"^\s+(?:async\s+)?def\s+(\w+)")],
    "go": [("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("struct", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface"), ("type", r"^type\s+(\w+)\s")],
    "rust": [("function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(\w+)")],
    "elixir": [("class", r"^\s*defmodule\s+([\w.]+)"), ("interface", r"^\s*defprotocol\s+([\w.]+)"), ("function", r"^\s*def(?:p|macrop?)?\s+(\w+[?!]?)")],
}
_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*(?:(?:\.|::|#)\w+)*)\s*\(")
_WORDS = frozenset("if for while switch return function def class func fn catch match await async elif with and or not in print defp do".split())
_EXPORTED = {"typescript": r"^\s*export\b", "javascript": r"^\s*export\b", "rust": r"^\s*pub\b", "elixir": r"^\s*def(?:module|protocol|macro)?\s"}
_IMPORTS = {"typescript": r"(?:import|export)\s[^;]*?from\s+['\"](\.[^'\"]*)['\"]", "python": r"from\s+(\.+[\w.]*)\s+import"}


def symbols_of(text: str, language: str) -> list[dict]:
    """SC8: name, kind, line_start, line_end, signature (at most three lines and 500 characters), body_hash, export_status, parent, qualified_name.

    The parent is the innermost symbol around it, the qualified name the names from the outermost on; methods outside a class are none.
    """
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        for kind, pattern in DEFINITIONS.get(language, []):
            if m := re.match(pattern, line):
                out.append({"name": m.group(1), "kind": kind, "line_start": i + 1, "indent": len(line) - len(line.lstrip())})
                break
    for s in out:
        after = len(lines)
        for i in range(s["line_start"], len(lines)):
            line = lines[i]
            if line.strip() and len(line) - len(line.lstrip()) <= s["indent"]:
                after = i + 1 if re.match(r"\s*(?:[})]|end\b)", line) else i
                break
        while after > s["line_start"] and not lines[after - 1].strip():
            after -= 1
        body = "\n".join(lines[s["line_start"] - 1 : after])
        first = lines[s["line_start"] - 1]
        status = "default_export" if re.match(r"\s*export\s+default\b", first) else "exported" if re.match(_EXPORTED.get(language, r"$^"), first) or (language == "go" and s["name"][:1].isupper()) or (language == "python" and not s["name"].startswith("_")) else "local"
        s |= {"line_end": after, "signature": re.split(r"\{|\bdo\b", "\n".join(body.split("\n")[:3]))[0].strip()[:500], "body_hash": hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest(), "export_status": status}
    around: list[dict] = []
    for s in out:
        s.pop("indent", None)
        around = [p for p in around if p["line_end"] >= s["line_end"] and p["line_start"] < s["line_start"]]
        s["parent"] = around[-1]["qualified_name"] if around else None
        s["qualified_name"] = f"{s['parent']}.{s['name']}" if around else s["name"]
        s["stray"] = s["kind"] == "method" and language in ("typescript", "javascript") and not (around and around[-1]["kind"] == "class")
        around.append(s)
    return [{k: v for k, v in s.items() if k != "stray"} for s in out if not s["stray"]]


def calls_of(text: str, language: str) -> list[tuple[str, str, int, str]]:
    """SC9: caller ('<module>' outside any symbol), callee, line, snippet of at most 200 characters; one a callee and line."""
    spans = [(s["line_start"], s["line_end"], s["name"]) for s in symbols_of(text, language)]
    heads, seen, out = {a for a, _, _ in spans}, set(), []
    for i, line in enumerate(text.split("\n"), 1):
        for m in _CALL.finditer(line):
            callee = m.group(1)
            if callee in _WORDS or (i in heads and callee in {n for a, _, n in spans if a == i}) or (callee, i) in seen:
                continue
            seen.add((callee, i))
            inside = [(a, n) for a, b, n in spans if a <= i <= b]
            out.append((max(inside)[1] if inside else "<module>", callee, i, line.strip()[:200]))
    return out


def imports_of(text: str, language: str) -> list[str]:
    """SC10: relative imports, as written."""
    pattern = _IMPORTS.get("typescript" if language == "javascript" else language)
    return re.findall(pattern, text) if pattern else []


def resolve_import(importer: str, spec: str, language: str) -> str:
    """SC10: the path a relative import means, without its extension where none is written."""
    base = posixpath.dirname(importer)
    if language == "python":
        dots = len(spec) - len(spec.lstrip("."))
        return posixpath.normpath(posixpath.join(base, *[".."] * (dots - 1), *spec.lstrip(".").split(".")))
    return posixpath.normpath(posixpath.join(base, spec))


def existing_path(target: str, known: frozenset[str] | set[str], language: str) -> str | None:
    """SC10: the file of known that an import without extension means: itself, with one of the language's extensions, or the index of a folder."""
    ends = {"python": (".py", "/__init__.py")}.get(language, (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js"))
    plain = re.sub(r"\.(?:[mc]?js|jsx)$", "", target)
    return next((p for p in (target, *(target + e for e in ends), *(plain + e for e in ends)) if p in known), None)


def _spread(texts: DataFrame, each, schema: str) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            yield pd.DataFrame([row for p, lang, t in b.itertuples(index=False) if t for row in each(p, lang or "", t)], columns=names)

    return texts.select("path", "language", "text").mapInPandas(run, schema)


def extract_symbols(texts: DataFrame) -> DataFrame:
    """SC8 over texts (path, language, text); null texts have none."""
    keys = ["name", "kind", "line_start", "line_end", "signature", "body_hash", "export_status", "parent", "qualified_name"]
    return _spread(texts, lambda p, lang, t: [(p, *[s[k] for k in keys]) for s in symbols_of(t, lang)], "path string, name string, kind string, line_start int, line_end int, signature string, body_hash string, export_status string, parent string, qualified_name string")


def extract_calls(texts: DataFrame) -> DataFrame:
    return _spread(texts, lambda p, lang, t: [(p, *c) for c in calls_of(t, lang)], "path string, caller string, callee string, line int, snippet string")


def extract_imports(texts: DataFrame) -> DataFrame:
    return _spread(texts, lambda p, lang, t: [(p, resolve_import(p, s, lang)) for s in imports_of(t, lang)], "from_path string, to_path string")
