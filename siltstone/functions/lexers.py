"""Patterns of code by language: what a token is, what a call looks like, which words never are one."""

from __future__ import annotations

from siltstone.functions.text import DEFAULT_TERMINATOR, TERMINATORS

# Every pattern below is possessive where it repeats, so that long tokens need no stack.
_WORD = r"[\p{L}_$][\p{L}\p{N}_$]*+"
_NUMBER = r"\p{N}[\p{L}\p{N}_.]*+"
_C_NUMBER = r"\p{N}(?:'?[\p{L}\p{N}_.])*+"
_BLANK = r"[ \t\f\x0B]++"
_LINE_END = r"\r\n|\n|\r"
_SIGN = r"[{}()\[\];,]"
_REST = r"[^\p{L}\p{N}_$\s\"'`/#%{}()\[\];,]++|[\s\S]"
_DOUBLE = r"\"(?:[^\"\\\n]++|\\[\s\S])*+\"?"
_SINGLE = r"'(?:[^'\\\n]++|\\[\s\S])*+'?"
_BACKTICK = r"`(?:[^`\\]++|\\[\s\S])*+`?"
_LINE_COMMENT = r"//[^\r\n]*+"
_SPLICED_COMMENT = r"//(?:[^\\\r\n]++|\\\r?\n|\\)*+"
_BLOCK_COMMENT = r"/\*[\s\S]*?(?:\*/|\z)"
_PART = r"[^*/]++|\*(?!/)|/(?!\*)"
_NESTED_COMMENT = rf"/\*(?:{_PART}|/\*(?:{_PART}|/\*(?:{_PART})*+\*/)*+\*/)*+(?:\*/|\z)"
_DIRECTIVE = r"(?m:^)[ \t]*+#(?:\\\r?\n|(?!//|/\*)[^\r\n])*+"
_TEXT_BLOCK = r"\"\"\"(?:[^\"\\]++|\\[\s\S]|\"(?!\"\"))*+(?:\"\"\")?"
_PYTHON_TEXT = _TEXT_BLOCK + "|" + r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+(?:''')?"
_C_RAW = r"R\"(?<raw>[^()\\\s\"]{0,16})\([\s\S]*?\)\k<raw>\""
_RUST_RAW = r"b?r(?<raw>#{0,8})\"[\s\S]*?\"\k<raw>"
_RUST_CHAR = r"'(?:[^'\\\n]|\\(?:u\{[^}]*+\}|x[0-9a-fA-F]{2}|[^ux]))'"
_JS_PATTERN = r"(?:(?<=[(,=:\[!&|?{};\n][ \t]{0,8})|(?<=\breturn[ \t]{1,8}))/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"


def _any(*patterns: str) -> str:
    return "|".join([*patterns, _BLANK, _LINE_END, _SIGN, _REST])


_C = _any(_SPLICED_COMMENT, _BLOCK_COMMENT, _DIRECTIVE, _C_RAW, _DOUBLE, _SINGLE, _WORD, _C_NUMBER)
_JS = _any(_LINE_COMMENT, _BLOCK_COMMENT, _JS_PATTERN, _DOUBLE, _SINGLE, _BACKTICK, _WORD, _NUMBER)

#: Tokens by language: the alternatives of a pattern cover every character once.
TOKENS = {
    "c": _C,
    "cpp": _C,
    "cuda": _C,
    "java": _any(_LINE_COMMENT, _BLOCK_COMMENT, _TEXT_BLOCK, _DOUBLE, _SINGLE, _WORD, _NUMBER),
    "javascript": _JS,
    "typescript": _JS,
    "arkts": _JS,
    "go": _any(_LINE_COMMENT, _BLOCK_COMMENT, _DOUBLE, _SINGLE, r"`[^`]*+`?", _WORD, _NUMBER),
    "rust": _any(_LINE_COMMENT, _NESTED_COMMENT, _RUST_RAW, _DOUBLE, _RUST_CHAR, _WORD, _NUMBER),
    "python": _any(r"#[^\r\n]*+", _PYTHON_TEXT, _DOUBLE, _SINGLE, _WORD, _NUMBER),
    "erlang": _any(r"%[^\r\n]*+", r"\$\\?.", _DOUBLE, _SINGLE, _WORD, _NUMBER),
}
DEFAULT_TOKENS = _any(_LINE_COMMENT, _BLOCK_COMMENT, _DOUBLE, _SINGLE, _BACKTICK, _WORD, _NUMBER)

#: How a comment, a text and a directive begin, for tokens of any language but where another is named.
COMMENT = {"python": "^#", "erlang": "^%"}
DEFAULT_COMMENT = r"^/[/*]"
TEXT = r"^(?:[\"'`]|R\"|b?r#*\"|/[^/*\s=]).|^\$."
DIRECTIVE = r"^[ \t]*#."

#: A call site by language; group 1 is the name.
CALLS = {
    "c": r"\b(\w+)\s*(?:<[^>]*>)?\s*\(",
    "cpp": r"\b(\w+)\s*(?:<[^>]*>)?\s*\(",
    "cuda": r"\b(\w+)\s*(?:<[^>]*>)?\s*\(",
    "java": r"\b(\w+)\s*(?:<[^>]*>)?\s*\(",
    "javascript": r"\b(\w+)\s*(?:<[^>]*>)?\s*\(",
    "typescript": r"\b(\w+)\s*(?:<[^>]*>)?\s*\(",
    "arkts": r"\b(\w+)\s*(?:<[^>]*>)?\s*\(",
    "rust": r"\b(\w+)\s*(?:::<[^>]*>)?\s*\(",
    "go": r"\b(\w+)\s*(?:\[[^\]]*\])?\s*\(",
}
DEFAULT_CALL = r"\b(\w+)\s*\("

#: Reserved words that stand before a bracket and aren't calls, by language.
_C_WORDS = ["if", "else", "while", "for", "do", "switch", "case", "return", "break", "continue", "goto", "sizeof", "struct", "union", "enum", "typedef", "extern", "inline", "static", "const", "volatile"]
_CPP_WORDS = [*_C_WORDS, "new", "delete", "throw", "catch", "alignof", "decltype", "operator", "class", "namespace", "using", "template", "typename", "auto", "mutable", "virtual", "override", "final", "explicit", "constexpr"]
_JS_WORDS = ["if", "else", "while", "for", "do", "switch", "return", "throw", "new", "delete", "typeof", "instanceof", "void", "const", "let", "var", "class", "import", "export", "async", "await"]
RESERVED = {
    "c": _C_WORDS,
    "cpp": _CPP_WORDS,
    "cuda": [*_CPP_WORDS, "__global__", "__device__", "__host__", "__shared__", "__constant__", "__managed__", "__restrict__"],
    "python": ["if", "else", "elif", "while", "for", "with", "try", "except", "return", "yield", "class", "import", "from", "lambda", "assert", "raise"],
    "go": ["if", "else", "for", "switch", "select", "return", "defer", "go", "chan", "map", "range", "type", "var", "const"],
    "rust": ["if", "else", "while", "for", "loop", "match", "return", "let", "mut", "pub", "use", "mod", "impl", "trait", "struct", "enum", "type", "where", "unsafe", "async", "await"],
    "java": ["if", "else", "while", "for", "do", "switch", "case", "return", "break", "continue", "goto", "new", "delete", "throw", "catch", "sizeof", "class", "struct", "enum", "typedef", "using", "interface", "abstract", "synchronized", "native", "throws", "instanceof", "static", "final", "void"],
    "javascript": _JS_WORDS,
    "typescript": _JS_WORDS,
    "arkts": [*_JS_WORDS, "struct"],
    "erlang": ["after", "and", "andalso", "band", "begin", "bnot", "bor", "bsl", "bsr", "bxor", "case", "catch", "cond", "div", "end", "fun", "if", "let", "maybe", "not", "of", "or", "orelse", "receive", "rem", "try", "when", "xor"],
}

#: The same language under the name that terminators go by.
_TERMINATOR_NAMES = {"cpp": "c++"}


def rows() -> list[tuple]:
    """(lang, tokens, comment, call, reserved, terminator) of every language and of '' for any other."""
    names = sorted({*TOKENS, *CALLS, *RESERVED, *TERMINATORS})
    return [
        (n, TOKENS.get(n, DEFAULT_TOKENS), COMMENT.get(n, DEFAULT_COMMENT), CALLS.get(n, DEFAULT_CALL), RESERVED.get(n, []), TERMINATORS.get(_TERMINATOR_NAMES.get(n, n), DEFAULT_TERMINATOR))
        for n in ["", *names]
    ]
