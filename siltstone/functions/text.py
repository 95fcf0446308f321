"""Text functions on plain Python strings, run through Arrow: masking, function extraction, name similarity, blocks, JSON
recovery.  Each is a pure function; ``functions_of`` and ``signals_of`` apply them to a table of sources."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

from pyspark.sql import DataFrame

from siltstone.functions.words import STOP

#: Words that look like calls but aren't, for all languages.
KEYWORDS = ["if", "for", "while", "switch", "return", "sizeof", "catch", "elif", "with", "assert", "del", "not", "and", "or", "in", "is", "lambda", "print", "super", "self", "func", "fn", "match", "new", "throw", "typeof", "defer", "go", "select", "case", "else", "do", "try", "except", "raise", "yield", "await", "async"]

#: Names that are called everywhere and say nothing about a project's own functions.
COMMON_CALLS = [
    "printf", "fprintf", "sprintf", "snprintf", "scanf", "sscanf", "malloc", "calloc", "realloc", "free", "memcpy", "memset", "memmove", "memcmp",
    "strlen", "strcmp", "strncmp", "strcpy", "strncpy", "strcat", "assert", "static_assert", "print", "len", "range", "enumerate", "zip", "map",
    "filter", "sorted", "reversed", "list", "dict", "set", "tuple", "int", "float", "str", "bool", "type", "super", "isinstance", "issubclass",
    "hasattr", "getattr", "setattr", "delattr", "open", "close", "input", "round", "abs", "min", "max", "sum", "any", "all", "iter", "next", "hash",
    "id", "repr", "ord", "chr", "hex", "oct", "bin", "format", "vars", "dir", "help", "eval", "exec", "compile", "append", "extend", "insert",
    "remove", "pop", "clear", "copy", "keys", "values", "items", "get", "update", "make", "new", "nil", "panic", "recover", "delete", "cap",
    "println", "eprintln", "write", "writeln", "vec", "box", "rc", "arc", "option", "result", "some", "none", "ok", "err", "console", "log", "warn",
    "error", "info", "debug", "require", "define", "module", "exports", "Math", "Object", "Array", "String", "Number", "Boolean", "Date", "RegExp",
    "Error", "Promise", "JSON", "setTimeout", "setInterval", "clearTimeout", "clearInterval", "main",
]

#: Statements that end a block's control flow, by language; DEFAULT_TERMINATOR for any other language.
TERMINATORS = {
    "rust": r"\b(return\b|panic!\s*\(|std::process::exit\s*\(|unreachable!\s*\()",
    "c": r"\b(return\b|exit\s*\(|_Exit\s*\(|abort\s*\(|longjmp\s*\()",
    "c++": r"\b(return\b|exit\s*\(|_Exit\s*\(|abort\s*\(|throw\s|std::terminate\s*\(|std::exit\s*\()",
    "python": r"\b(return\b|sys\.exit\s*\(|raise\s|exit\s*\(|quit\s*\()",
    "cuda": r"\b(return\b|exit\s*\(|_Exit\s*\(|abort\s*\(|__trap\s*\()",
    "java": r"\b(return\b|throw\s|System\.exit\s*\()",
    "go": r"\b(return\b|panic\s*\(|log\.Fatal\w*\s*\(|os\.Exit\s*\()",
    "c#": r"\b(return\b|throw\s|Environment\.Exit\s*\()",
    "kotlin": r"\b(return\b|throw\s|exitProcess\s*\(|System\.exit\s*\()",
    "swift": r"\b(return\b|throw\s|fatalError\s*\(|preconditionFailure\s*\(|exit\s*\()",
    "php": r"\b(return\b|throw\s|die\s*\(|exit\s*\()",
    "ruby": r"\b(return\b|raise\s|abort\s*\(|exit\s*\(|exit!\s*\()",
    "scala": r"\b(return\b|throw\s|sys\.exit\s*\(|System\.exit\s*\()",
    "dart": r"\b(return\b|throw\s|exit\s*\()",
    "javascript": r"\b(return\b|throw\s|process\.exit\s*\()",
    "typescript": r"\b(return\b|throw\s|process\.exit\s*\()",
    "arkts": r"\b(return\b|throw\s|process\.exit\s*\()",
    "erlang": r"\b(?:throw|exit|error)\s*\(|\berlang:(?:error|exit)\s*\(",
}
DEFAULT_TERMINATOR = r"\b(return\b|exit\s*\(|raise\s|throw\s|abort\s*\()"


def terminates(block: str, language: str) -> bool:
    """Whether a block of code has a statement that ends its control flow."""
    return re.search(TERMINATORS.get(language.lower(), DEFAULT_TERMINATOR), block) is not None


def mask(source: str, hashes: bool = False) -> str:
    """Comments and string contents as spaces; newlines stay, so that positions keep their meaning.
    hashes: '#' begins a comment and triple quotes a string, as in Python; else // and /* */ do."""
    quote = r"'''[\s\S]*?(?:'''|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|" if hashes else ""
    comment = r"#[^\n]*" if hashes else r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
    literal = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?" + ("" if hashes else r"|`(?:\\.|[^`\\])*`?")
    return re.sub(f"{quote}{comment}|{literal}", lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def matching_brace(masked: str, at: int) -> int:
    """Position of the brace that closes the one at ``at``; -1 if it stays open."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return -1


def _brace_functions(source: str, language: str) -> Iterator[tuple[str, int, int]]:
    masked = mask(source)
    if language == "go":
        head = re.compile(r"^[ \t]*func\s*(?:\([^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*\([^{}]*\{", re.M)
    elif language == "rust":
        head = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s*)?)*fn\s+(?P<name>\w+)[^{};]*\{", re.M)
    elif language in ("javascript", "typescript", "arkts"):
        head = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:static\s+|public\s+|private\s+|protected\s+|async\s+)*(?:function\s*\*?\s*(?P<name>[\w$]+)|(?P<method>[\w$]+)(?=\s*[(<]))\s*(?:<[^>(]*>)?\s*\([^{}]*?\)[^{}();=]*\{", re.M)
    else:
        head = re.compile(r"^[ \t]*(?:[\w:<>,*&\[\]~@\s]+?[\s*&])?(?P<name>[~\w:]+)\s*\([^{};]*\)[^{};()=]*\{", re.M)
    at = 0
    while m := head.search(masked, at):
        name = m.groupdict().get("name") or m.groupdict().get("method") or ""
        end = matching_brace(masked, m.end() - 1)
        attribute = language == "rust" and re.search(r"#\[(?:\w+::)?test\]\s*\Z", source[: m.start() + len(m[0]) - len(m[0].lstrip())])
        bare = name.split("::")[-1]
        if not name or bare in KEYWORDS or bare in ("class", "struct", "enum", "namespace", "interface", "impl"):
            at = m.end()
            continue
        if end < 0:
            at = m.end()
            continue
        if not attribute:
            first = m.start() + len(m[0]) - len(m[0].lstrip())
            yield name, source.count("\n", 0, first), source.count("\n", 0, end)
        at = end + 1


def _indented_functions(source: str) -> Iterator[tuple[str, int, int]]:
    lines, masked = source.split("\n"), mask(source, True).split("\n")
    scopes: list[tuple[int, str]] = []
    for i, line in enumerate(masked):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while scopes and scopes[-1][0] >= indent:
            scopes.pop()
        m = re.match(r"\s*(def|class)\s+(\w+)", line)
        if not m:
            continue
        if m[1] == "def":
            end, depth = i, 0
            for j in range(i, len(masked)):
                text = masked[j]
                if j > i and depth <= 0 and text.strip() and len(text) - len(text.lstrip()) <= indent:
                    break
                depth += len(re.findall(r"[(\[{]", text)) - len(re.findall(r"[)\]}]", text))
                if lines[j].strip():
                    end = j
            first = i
            while first and re.match(r"\s*@", masked[first - 1]) and len(masked[first - 1]) - len(masked[first - 1].lstrip()) == indent:
                first -= 1
            yield "::".join([*(n for _, n in scopes), m[2]]), first, end
        scopes.append((indent, m[2]))


def functions_in(source: str, language: str) -> list[tuple[str, int, int]]:
    """(identifier, first line, last line), 0-based inclusive, in order; the n-th repeat of a name gets _n."""
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    found = _indented_functions(source) if language == "python" else _brace_functions(source, language)
    seen: dict[str, int] = {}
    out = []
    for name, first, last in sorted(found, key=lambda x: x[1]):
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append((f"{name}_{n}" if n else name, first, last))
    return out


def name_parts(name: str) -> list[str]:
    """Parts of a name in lower case, without repeats: the whole, snake parts of two letters or more and neighbouring pairs of
    them, camel parts."""
    snake = [p for p in name.lower().split("_") if len(p) > 1]
    camel = [p for p in re.split(r"_|(?=[A-Z])", name) if len(p) > 1]
    return list(dict.fromkeys([name.lower(), *snake, *map("_".join, zip(snake, snake[1:], strict=False)), *(p.lower() for p in camel)]))


def similar(a: str, b: str, least: float = 0.75, size: int = 5) -> bool:
    """Gestalt pattern matching: the share of matched characters is at least ``least``; only names of ``size`` or more."""
    if min(len(a), len(b)) < size or 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    return SequenceMatcher(None, a, b).ratio() >= least


def blocks(lines: list[str], size: int, braces: bool = True) -> list[tuple[int, int]]:
    """(first, end) of blocks of at least ``size`` lines that begin at the depth of the first line; two sizes or less that
    are left are one block."""
    if len(lines) <= size:
        return [(0, len(lines))]
    masked = mask("\n".join(lines)).split("\n") if braces else lines
    cuts, depth, start = [], 0, 0
    for i, line in enumerate(masked):
        if i - start >= size and len(lines) - start > 2 * size and depth <= 0:
            cuts.append(i)
            start = i
        depth += (line.count("{") - line.count("}")) if braces else 0
    at = [0, *cuts, len(lines)]
    return list(zip(at, at[1:], strict=False))


def recover_json(text: str):
    """The single JSON object or array in a text with prose around it; None if there is none or more than one."""
    decoder, found, at = json.JSONDecoder(), [], 0
    while m := re.compile(r"[\[{]").search(text, at):
        try:
            value, at = decoder.raw_decode(text, m.start())
            found.append(value)
        except ValueError:
            at = m.start() + 1
    return found[0] if len(found) == 1 else None


def deep_merge(base: dict, overlay: dict) -> dict:
    """Nested objects merged, the overlay winning."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in overlay.items()}


def utf16_offset(text: str, line: int, unit: int) -> int:
    """Character offset of a position in UTF-16 units on a 0-based line; lines end with LF, CRLF or CR."""
    starts = [0, *(m.end() for m in re.finditer(r"\r\n|\n|\r", text))]
    at = starts[min(line, len(starts) - 1)]
    while unit > 0 and at < len(text) and text[at] not in "\r\n":
        unit -= 2 if ord(text[at]) > 0xFFFF else 1
        at += 1
    return at


def _prose(text: str) -> list[str]:
    return sorted(set(re.findall(r"\b[a-zA-Z]{4,}\b", text.lower())) - set(STOP))


def _type_name(node) -> str:
    node = node.func if isinstance(node, ast.Call) else node
    return (node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else "").lower()


def _parsed(source: str):
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def python_signals(source: str) -> list[dict]:
    """Per function, nested ones too: name, lines from 1, called names, and in lower case names in use (with parameters,
    attributes and words of texts), words of the body, exceptions raised or caught.  None of a source that doesn't parse."""
    tree, lines = _parsed(source), source.splitlines()
    out = []
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            inner = list(ast.walk(node))
            calls = {c.func.attr if isinstance(c.func, ast.Attribute) else c.func.id for c in inner if isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute | ast.Name)}
            idents = {i.id for i in inner if isinstance(i, ast.Name)} | {i.attr for i in inner if isinstance(i, ast.Attribute)} | {i.arg for i in inner if isinstance(i, ast.arg)}
            idents |= {w for i in inner if isinstance(i, ast.Constant) and isinstance(i.value, str) for w in re.findall(r"[a-zA-Z_][a-zA-Z0-9_]{2,}", i.value)}
            types = [i.exc if isinstance(i, ast.Raise) else i.type for i in inner if isinstance(i, ast.Raise | ast.ExceptHandler)]
            out.append({
                "name": node.name, "first": node.lineno, "last": node.end_lineno, "calls": sorted(calls), "idents": sorted({i.lower() for i in idents}),
                "words": _prose("\n".join(lines[node.lineno - 1 : node.end_lineno])), "exceptions": sorted({t for t in map(_type_name, types) if t}), "docstring": ast.get_docstring(node) or "",
            })
    return sorted(out, key=lambda r: (r["first"], r["name"]))


def python_classes(source: str) -> list[dict]:
    """Per class, nested ones too: name, docstring and the first lines of all functions within."""
    tree = _parsed(source)
    return [
        {"name": c.name, "docstring": ast.get_docstring(c) or "", "method_lines": sorted(m.lineno for m in ast.walk(c) if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef))}
        for c in (ast.walk(tree) if tree else ()) if isinstance(c, ast.ClassDef)
    ]


def generic_signals(source: str, language: str) -> list[dict]:
    """The same by patterns, for other languages; calls are read without comments and texts."""
    lines = source.split("\n")
    out = []
    for name, first, last in functions_in(source, language):
        body = "\n".join(lines[first : last + 1])
        out.append({
            "name": name, "first": first + 1, "last": last + 1, "calls": sorted(set(re.findall(r"\b([A-Za-z_]\w*)\s*\(", mask(body))) - set(KEYWORDS)),
            "idents": sorted({i.lower() for i in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", body)}), "words": _prose(body),
            "exceptions": sorted({e.lower() for e in re.findall(r"\b[A-Z][A-Za-z0-9]*(?:Error|Exception|Warning)\b", body)}), "docstring": "",
        })
    return out


def functions_of(sources: DataFrame) -> DataFrame:
    """sources: (path, lang, content).  (path, lang, ident, start_idx, end_idx, body) of every function."""

    def run(it):
        import pyarrow as pa

        for batch in it:
            rows = [
                (p, lang, name, a, b, "\n".join(content.split("\n")[a : b + 1]))
                for p, lang, content in zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "content")), strict=True)
                if content and lang
                for name, a, b in functions_in(content, lang)
            ]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "lang", "ident", "start_idx", "end_idx", "body"])

    return sources.select("path", "lang", "content").mapInArrow(run, "path string, lang string, ident string, start_idx int, end_idx int, body string")


def signals_of(sources: DataFrame) -> DataFrame:
    """(path, name, first, last, calls, idents, words, exceptions, docstring) of every function."""
    schema = "path string, name string, first int, last int, calls array<string>, idents array<string>, words array<string>, exceptions array<string>, docstring string"

    def run(it):
        import pandas as pd

        for pdf in it:
            rows = [
                {"path": p} | r for p, lang, content in zip(pdf["path"], pdf["lang"], pdf["content"], strict=True) if content
                for r in ((python_signals(content) or generic_signals(content, lang)) if lang == "python" else generic_signals(content, lang))
            ]
            yield pd.DataFrame(rows, columns=["path", "name", "first", "last", "calls", "idents", "words", "exceptions", "docstring"])

    return sources.select("path", "lang", "content").mapInPandas(run, schema)


def classes_of(sources: DataFrame) -> DataFrame:
    """(path, name, docstring, method_lines) of every class of Python sources."""

    def run(it):
        import pandas as pd

        for pdf in it:
            rows = [{"path": p} | r for p, content in zip(pdf["path"], pdf["content"], strict=True) if content for r in python_classes(content)]
            yield pd.DataFrame(rows, columns=["path", "name", "docstring", "method_lines"])

    python = sources.filter("lang = 'python'").select("path", "content")
    return python.mapInPandas(run, "path string, name string, docstring string, method_lines array<int>")


def similar_names(left: DataFrame, right: DataFrame, name: str, least: float = 0.75) -> DataFrame:
    """(a, b): names of two tables that match closely.  Three quarters of matched characters leave a run of two in both, so
    pairs are formed by shared bigrams and lengths, and only these are compared."""
    from pyspark.sql import functions as F

    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("n") - 1)), lambda i: F.substring("n", i, 2)))
    side = lambda df, out: df.select(F.col(name).alias("n")).distinct().filter("length(n) >= 5").select(F.col("n").alias(out), F.explode(grams).alias("g"))
    pairs = side(left, "a").join(side(right, "b"), "g").filter(f"2 * least(length(a), length(b)) >= {least} * (length(a) + length(b))").select("a", "b").distinct()

    @F.pandas_udf("boolean")
    def close(a, b):
        import pandas as pd

        return pd.Series([similar(x, y, least) for x, y in zip(a, b, strict=True)])

    return pairs.filter(close("a", "b"))
