"""Word lists of relevance scoring."""

#: Words of prose that say nothing.
STOP = [
    "this", "that", "with", "from", "have", "been", "will", "also", "when", "then", "they", "them", "some", "into", "more", "like", "such", "which",
    "were", "each", "does", "what", "about", "would", "should", "could", "their", "there", "where", "these", "those", "after", "before", "other",
    "only", "using", "used", "code", "issue", "error", "function", "class", "method", "file", "line", "true", "false", "none", "type", "value",
    "object", "self", "args", "kwargs", "return", "raise", "pass", "import",
]

#: Quoted words that are language rather than names.
NOISE = [
    "class", "def", "return", "import", "from", "with", "for", "while", "if", "else", "elif", "try", "except", "finally", "raise", "pass", "break",
    "continue", "lambda", "yield", "global", "nonlocal", "assert", "del", "and", "or", "not", "in", "is", "none", "true", "false", "async", "await",
    "self", "cls", "super", "print", "list", "dict", "tuple", "set", "str", "int", "float", "bool", "type", "len", "range", "open", "isinstance",
]
