"""Code as rows: tokens with places and depths, and what follows from them as joins, windows and folds: code without comments,
scopes and their functions, blocks that end with statements, call sites and terminating statements.

Sources are (path, lang, content).  A path is a file: of rows that repeat path, lang and content one is read.  Rows without a
path or content have no tokens.  Texts move before they become tokens; tokens stay where their text went.  Long files of
scopes are cut behind braces where a part can be read by itself, so that no task holds the tokens of a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.lexers import DIRECTIVE, TEXT, rows
from siltstone.functions.text import COMMON_CALLS
from siltstone.session import written

FILE = ["path", "lang", "file"]
SEGMENT = [*FILE, "segment"]

#: Characters of a file that is never cut, and lines of a chunk of a longer one.
UNCUT, CHUNK_LINES = 20_000, 200


def _languages(df: DataFrame) -> DataFrame:
    """The dimension of languages, a fixed list of some 20 rows."""
    return F.broadcast(df.sparkSession.createDataFrame(rows(), "l string, tokens string, comment string, call string, reserved array<string>, terminator string"))


def with_language(df: DataFrame, *columns: str) -> DataFrame:
    """Add columns of the dimension; a language that it hasn't (and null) gets the general ones."""
    known = [r[0] for r in rows()]
    name = F.when(F.lower("lang").isin(known), F.lower("lang")).otherwise("").alias("_l")
    own = [F.col(f"d.{c}").alias(f"_{c}") for c in columns]
    return df.select("*", name).alias("s").join(_languages(df).alias("d"), F.col("_l") == F.col("d.l")).select("s.*", *own).drop("_l")


def _pieces(content: str = "content") -> Column:
    """The tokens of a text in order; together they are the text."""
    return F.regexp_extract_all(content, F.col("_tokens"), F.lit(0))


def _is_comment(piece: Column) -> Column:
    return F.rlike(piece, F.col("_comment"))


def _is_text(piece: Column) -> Column:
    return F.rlike(piece, F.lit(TEXT))


def _blanked(piece: Column) -> Column:
    """A blank for each byte but those of line ends, as places in the file's bytes stay the same."""
    for wide, blanks in ((r"[\x{10000}-\x{10FFFF}]", "    "), (r"[\x{0800}-\x{FFFF}]", "   "), (r"[\x{0080}-\x{07FF}]", "  "), (r"[^\r\n]", " ")):
        piece = F.regexp_replace(piece, wide, blanks)
    return piece


def _unclosed(piece: Column) -> Column:
    """A comment or text that the end of the file or line cut off."""
    comment = piece.startswith("/*") & ~(piece.endswith("*/") & (F.length(piece) >= 4))
    quote = F.substring(piece, 1, 1)
    text = _is_text(piece) & (~F.substring(piece, -1, 1).eqNullSafe(quote) | (F.length(piece) < 2))
    return comment | quote.isin('"', "'", "`") & (text | (F.length(piece) == 1) & (F.col("lang") != "rust"))


def _balanced(pieces: Column) -> Column:
    """Brackets close in the order in which they open; the fold's state is the stack of open ones."""
    closes = F.create_map(*(F.lit(x) for pair in (("}", "{"), (")", "("), ("]", "[")) for x in pair))
    signs = F.filter(pieces, lambda p: p.isin(*"{}()[]"))
    step = lambda stack, p: (
        F.when(p.isin("{", "(", "["), F.concat(stack, p))
        .when(F.substring(stack, -1, 1) == F.element_at(closes, p), F.left(stack, F.length(stack) - 1))
        .otherwise(F.concat(F.lit("!"), stack))
    )
    return F.aggregate(signs, F.lit(""), step) == ""


def _sound() -> Column:
    """Whether ``_pieces`` close what they open, and hold no ??/ in C, which would have to be translated first."""
    return ~F.exists("_pieces", _unclosed) & _balanced(F.col("_pieces")) & ~((F.col("lang") == "c") & F.contains("content", F.lit("??/")))


def without_comments(sources: DataFrame) -> DataFrame:
    """Add ``code``: the content with every comment's bytes blanked, line ends kept; null where the content is null or in
    error: a comment, text or bracket that doesn't close, or a ??/ in C, which would have to be translated first."""
    df = with_language(sources, "tokens", "comment").withColumn("_pieces", _pieces())
    code = F.array_join(F.transform("_pieces", lambda p: F.when(_is_comment(p), _blanked(p)).otherwise(p)), "")
    return df.withColumn("code", F.when(_sound(), code)).drop("_tokens", "_comment", "_pieces")


#: Where code in error is read: comments, texts, and # behind other signs of its line.
_PLAIN = r"/\*[\s\S]*?(?:\*/|\z)|//[^\n]*+|\"(?:[^\"\\]++|\\[\s\S])*+\"?|'(?:[^'\\]++|\\[\s\S])*+'?|(?:^|\n)[ \t]*+#|#[^\n]*+|[^/\"'#\n]++|[\s\S]"


def code_lines(sources: DataFrame) -> DataFrame:
    """Add ``code``: the lines that hold more than comments and blanks.  Code in error loses by plainer rules: both kinds of
    comment with their delimiters, and what follows a # that isn't the first sign of its line."""
    df = without_comments(sources)
    plain = F.transform(F.regexp_extract_all("content", F.lit(_PLAIN), F.lit(0)), lambda p: F.when(p.startswith("/*"), F.regexp_replace(p, r"[^\n]", "")).when(p.startswith("//") | p.startswith("#") & (p != "#"), "").otherwise(p))
    cleaned = F.coalesce("code", F.array_join(plain, ""))
    return df.withColumn("code", F.array_join(F.filter(F.split(cleaned, "\n"), lambda line: F.rlike(line, F.lit(r"\S"))), "\n"))


def masked(sources: DataFrame) -> DataFrame:
    """Add ``code``: the content with comments and texts as blanks, one a character."""
    df = with_language(sources, "tokens", "comment")
    hide = lambda p: F.when(p.isin(*_SIGNS, " ", "\n") | _latin(p), p).when(_is_comment(p) | _is_text(p), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)
    return df.withColumn("code", F.array_join(F.transform(_pieces(), hide), "")).drop("_tokens", "_comment")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """As many partitions as shuffles have: a text becomes many rows, so its bytes say little about the work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Signs that are a token alone; these and ``_latin`` are told by a comparison, which spares most tokens the patterns.
_SIGNS = list("{}()[];,")


def _latin(text: Column) -> Column:
    """A word by its first letter, without a quote (texts may begin with letters)."""
    return ((text >= "A") & (text < "[") | (text >= "a") & (text < "{")) & ~F.contains(text, F.lit('"'))


def _kind(text: Column) -> Column:
    return (
        F.when(text.isin(*_SIGNS), "sign").when(text == " ", "blank").when(_latin(text), "word").when(_is_comment(text), "comment").when(text.isin("\n", "\r\n", "\r"), "line_end").when(F.rlike(text, F.lit(r"^[ \t\f\x0B]+$")), "blank")
        .when(F.col("lang").isin("c", "cpp", "cuda") & F.rlike(text, F.lit(DIRECTIVE)), "directive").when(_is_text(text), "text")
        .when(F.rlike(text, F.lit(r"^[\p{L}_$]")), "word").when(F.rlike(text, F.lit(r"^\p{N}")), "number").otherwise("sign")
    )


def _line_ends(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r")), F.regexp_count(text, F.lit(_LINE_ENDS))).otherwise(0)


_NO_CODE = ["comment", "directive", "line_end"]
_LINE_ENDS = r"\r\n|\n|\r"
#: What was counted before a segment: tokens, characters, line ends, open braces and other open brackets.
_BASE = ["n", "chars", "lines", "braces", "brackets"]


def _first_cut() -> tuple[Column, Column]:
    """Places of braces among ``_pieces``, and by them (``_signs``) how many of ``_pieces`` go up to the first brace behind which a file can be cut; null if there is none.  It closes what
    can't be a value: the brace before it closes too, or opens behind a round bracket.  So no head or value goes on beyond it."""
    piece = lambda i: F.get("_pieces", i)
    blank = lambda i: F.rlike(piece(i), F.lit(r"^\s+$"))
    signs = F.filter(F.transform("_pieces", lambda p, i: F.when(p.isin("{", "}"), i)), lambda i: i.isNotNull())
    behind = lambda i: (piece(i - 1) == ")") | blank(i - 1) & ((piece(i - 2) == ")") | blank(i - 2) & (piece(i - 3) == ")"))
    pairs = F.transform("_signs", lambda i, k: F.struct(i.alias("at"), F.get("_signs", k - 1).alias("before")))
    fits = lambda x: x["before"].isNotNull() & (piece(x["at"]) == "}") & ((piece(x["before"]) == "}") | behind(x["before"]))
    return signs, F.get(F.filter(pairs, fits), F.lit(0))["at"] + 1


def _segments(files: DataFrame) -> DataFrame:
    """(path, lang, file, segment, content, base, after) of long files: segments from 0, each but the first behind a brace of
    ``_first_cut``.  base: what was counted before it; after: the first token of code behind it.

    A file is cut into chunks at ends of lines that are tokens; chunks become tokens by themselves, with the line end before
    them in front, and are cut once more, at the first brace that allows it.  What comes before that belongs to the segment
    before.  What has to be summed up along a file are a few numbers a chunk."""
    line = F.concat(F.lit(r"(?:(?!\z)(?:(?!\r?\n)(?:"), F.col("_tokens"), F.lit(rf"))*+(?:\r?\n|\z)){{1,{CHUNK_LINES}}}+"))
    chunks = with_language(files, "tokens", "comment").select(*FILE, "_tokens", "_comment", F.posexplode(F.regexp_extract_all("content", line, F.lit(0))).alias("chunk", "content"))
    led = F.regexp_extract_all(F.concat(F.lit("\n"), "content"), F.col("_tokens"), F.lit(0))
    pieces = _spread(chunks, *FILE, "chunk").withColumn("_pieces", F.when(F.col("chunk") == 0, _pieces()).otherwise(F.slice(led, 2, F.greatest(F.size(led) - 1, F.lit(0)))))
    signs, cut = _first_cut()
    pieces = pieces.withColumn("_signs", signs).withColumn("_cut", F.when(F.col("chunk") > 0, cut))
    part = lambda new, start, n: F.struct(F.lit(new).alias("new"), F.slice("_pieces", start, n).alias("pieces"))
    whole = F.array(F.struct(F.lit(0).alias("new"), F.col("_pieces").alias("pieces")))
    both = F.when(F.col("_cut").isNull(), whole).otherwise(F.array(part(0, F.lit(1), F.col("_cut")), part(1, F.col("_cut") + 1, F.size("_pieces") - F.col("_cut"))))
    parts = pieces.select(*FILE, "_comment", "chunk", F.inline(both)).filter(F.size("pieces") > 0)
    count = lambda *signs: F.size(F.filter("pieces", lambda p: p.isin(*signs)))
    code = lambda pieces: F.get(F.filter(pieces, lambda p: ~_kind(p).isin(*_NO_CODE, "blank")), F.lit(0))
    first = F.coalesce(code(F.slice("pieces", 1, 16)), code(F.col("pieces")))
    text = F.array_join("pieces", "")
    sums = parts.select(
        *FILE, "chunk", "new", text.alias("content"), first.alias("first"), F.size("pieces").alias("n"), F.length(text).alias("chars"), F.regexp_count(F.array_join("pieces", " "), F.lit(_LINE_ENDS)).alias("lines"),
        (count("{") - count("}")).alias("braces"), (count("(", "[") - count(")", "]")).alias("brackets"),
    )
    along, back = Window.partitionBy(*FILE).orderBy("chunk", "new"), Window.partitionBy(*FILE).orderBy(F.desc("chunk"), F.desc("new"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    base = F.struct(*(F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int").alias(c) for c in _BASE))
    placed = sums.withColumn("base", base).withColumn("segment", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    placed = placed.withColumn("after", F.last("first", True).over(back.rowsBetween(Window.unboundedPreceding, -1))).select(*SEGMENT, "chunk", "new", "content", "base", "after")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "new", "content"))), lambda x: x["content"]), "")
    return placed.groupBy(*SEGMENT).agg(joined.alias("content"), F.min("base").alias("base"), F.max_by("after", F.struct("chunk", "new")).alias("after"))


def tokens(sources: DataFrame, cut: bool = False) -> DataFrame:
    """(path, lang, file, at, start, end, line, last_line, kind, text, depth, bracket): every token but blanks, in order of
    ``at``.  start and end (exclusive) are characters, lines count from 0; depth and bracket count the braces and the other
    brackets that are open after the token.  kind: comment, text, directive, line_end, word, number, sign.

    With ``cut`` also segment, after and first_line: the tokens of a segment lie in one partition, those of a file don't have to.
    """
    files = sources.select("path", "lang", "content").filter("path is not null and content is not null").withColumn("file", F.xxhash64("content"))
    zero = F.struct(*(F.lit(0).alias(c) for c in _BASE))
    one = lambda df: df.select(*FILE, F.lit(0).alias("segment"), "content", zero.alias("base"), F.lit(None).cast("string").alias("after"))
    if cut:
        long = _spread(files.filter(F.length("content") > UNCUT), "path").dropDuplicates()
        texts = _spread(one(files.filter(F.length("content") <= UNCUT)).unionByName(_segments(long)), *SEGMENT).dropDuplicates()
    else:
        texts = one(_spread(files, "path").dropDuplicates(["path", "lang", "content"]))
    keys = SEGMENT if cut else FILE
    led = F.regexp_extract_all(F.concat(F.lit("}"), "content"), F.col("_tokens"), F.lit(0))
    pieces = F.when(F.col("segment") == 0, _pieces()).otherwise(F.slice(led, 2, F.greatest(F.size(led) - 1, F.lit(0)))) if cut else _pieces()
    each = with_language(texts, "tokens", "comment").select(*SEGMENT, "base", "after", "_comment", F.posexplode(pieces).alias("i", "text"))
    text = F.col("text")
    upto = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = lambda opens, closes: F.when(text.isin(*opens), 1).when(text.isin(*closes), -1).otherwise(0)
    # The first token of a text brings along what was counted before it.
    step = lambda c, name: c + F.when(F.col("i") == 0, F.col(f"base.{name}")).otherwise(0)
    steps = {"_chars": step(F.length("text"), "chars"), "_breaks": step(_line_ends(text), "lines"), "_braces": step(turn("{", "}"), "braces"), "_brackets": step(turn("([", ")]"), "brackets")}
    each = each.select(*SEGMENT, "after", F.col("base.lines").alias("first_line"), (F.col("i") + F.col("base.n")).alias("at"), _kind(text).alias("kind"), "text", _line_ends(text).alias("_lines"), *(c.alias(k) for k, c in steps.items()))
    total = lambda c: F.sum(c).over(upto).cast("int")
    places = each.select(*SEGMENT, "after", "first_line", "at", "kind", "text", "_lines", total("_chars").alias("end"), total("_breaks").alias("_after"), total("_braces").alias("depth"), total("_brackets").alias("bracket"))
    before = F.col("_after") - F.col("_lines")
    last = F.when(F.col("kind") == "line_end", before).otherwise(F.col("_after"))
    more = ["segment", "after", "first_line"] if cut else []
    return places.filter("kind <> 'blank'").select(*FILE, *more, "at", (F.col("end") - F.length("text")).alias("start"), "end", before.alias("line"), last.alias("last_line"), "kind", "text", "depth", "bracket")


# -- scopes

#: A bracket with what it holds, to three levels, in a head (tokens joined by blanks).
_ARGS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
_AFTER = rf"(?: (?:const|noexcept(?: {_ARGS})?|override|final|volatile|mutable|try|&|&&|throws [^()]+|throw {_ARGS}|-> .+|: .+))*"
_C_FUNCTION = rf"^(?:[^()=]*? )??((?:\w+(?: <[^()]*>)? :: )*(?:~ ?)?\w+|(?:\w+ :: )*operator .+?) {_ARGS}{_AFTER}$"
_JS_FUNCTION = rf"^(?:[\w @]* )?(?:function (?:\* )?)?#? ?([\w$]+) (?:<[^()]*> )?{_ARGS}(?: : .+)?$"
_JS_ARROW = rf"^(?:[\w ]* )?(?:const|let|var) ([\w$]+) (?:: [^=]+ )?= (?:async )?(?:{_ARGS}|[\w$]+)(?: : [^=]+)? =>$"
_JS_CALL = r"^(?:return|throw|await|yield|new|else|case|typeof|void|delete)\b"
_FUNCTION = {
    "c": [_C_FUNCTION], "cpp": [_C_FUNCTION], "cuda": [_C_FUNCTION], "java": [_C_FUNCTION],
    "javascript": [_JS_FUNCTION, _JS_ARROW], "typescript": [_JS_FUNCTION, _JS_ARROW], "arkts": [_JS_FUNCTION, _JS_ARROW],
    "go": [rf"^func (?:{_ARGS} )?(\w+) .*$"],
    "rust": [r"^(?:.* )?fn (\w+)\b.*$"],
}
_C_SCOPE = r"^(?:template <.*> )?(?:(?:typedef|static|const|export|inline) )*(?:(?:struct|class|union|enum)(?: class| struct)?|namespace) ((?:\w+ :: )*\w+)(?: final)?(?: : [^()]*)?$"
_JAVA_SCOPE = r"^(?:[\w@ .\"()-]* )?(?:class|interface|enum|record) (\w+)\b.*$"
_JS_SCOPE = r"^(?:[\w@ ]* )?(?:class|interface|enum|namespace|module|struct) ([\w$]+)\b[^()]*$"
_SCOPE = {
    "c": _C_SCOPE, "cpp": _C_SCOPE, "cuda": _C_SCOPE, "java": _JAVA_SCOPE, "javascript": _JS_SCOPE, "typescript": _JS_SCOPE, "arkts": _JS_SCOPE, "go": r"^type (\w+) (?:struct|interface)$",
    "rust": r"^(?:.* )?(?:impl (?:<[^{]*> )?(?:[\w:<>, ']+? for )?(?:\w+ :: )*|(?:mod|trait|struct|enum) )(\w+)\b.*$",
}


def _by_language(patterns: dict[str, str], head: Column) -> Column:
    """Group 1 of the language's pattern in a head; null if there is none."""
    out = F.lit(None).cast("string")
    for pattern in dict.fromkeys(patterns.values()):
        langs = [k for k, v in patterns.items() if v == pattern]
        out = F.when(F.col("lang").isin(langs), F.nullif(F.regexp_extract(head, pattern, 1), F.lit(""))).otherwise(out)
    return out


def _marked(code: DataFrame) -> DataFrame:
    """Add label (an access label of C++), literal (a brace of a value without inner braces: in brackets, or a member's
    initial value in C++) and begins (a word on a new line that doesn't go on with the line before: Go and JavaScript).
    Before each segment but the first stands the brace behind which it was cut."""
    along = Window.partitionBy(*SEGMENT).orderBy("at")
    behind_cut = lambda c: F.when(F.col("segment") > 0, c)
    near = code.withColumns({
        "prev": F.coalesce(F.lag("text").over(along), behind_cut("}")), "prev_kind": F.coalesce(F.lag("kind").over(along), behind_cut("sign")),
        "prev_line": F.coalesce(F.lag("last_line").over(along), behind_cut(F.col("first_line"))), "next": F.coalesce(F.lead("text").over(along), "after"),
    })
    access = F.col("lang").isin("cpp", "cuda") & (F.col("text").isin("public", "private", "protected") & (F.col("next") == ":") | (F.col("text") == ":") & F.col("prev").isin("public", "private", "protected"))
    begins = F.col("lang").isin("go", "javascript", "typescript", "arkts") & (F.col("line") > F.col("prev_line")) & (F.col("prev_kind").isin("word", "number", "text") | F.col("prev").isin(")", "]", "}")) & ((F.col("kind") == "word") | F.col("text").startswith("@"))
    braces = near.withColumn("label", F.coalesce(access, F.lit(False))).withColumn("begins", F.coalesce(begins & ~F.col("prev").isin("export", "default", "async", "static"), F.lit(False)))
    is_brace = F.col("text").isin("{", "}")
    later = Window.partitionBy(*SEGMENT).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.last(F.when(is_brace, F.struct("text", "next")), True).over(later)
    opens = (F.col("text") == "{") & (ahead["text"] == "}") & ((F.col("bracket") > 0) & F.col("prev").isin("=", ",", "(", ":") | F.col("lang").isin("cpp", "cuda") & (F.col("prev_kind") == "word") & ahead["next"].isin(",", "{"))
    leaf = braces.withColumn("opens", F.coalesce(opens, F.lit(False)))
    behind = F.last(F.when(is_brace, F.struct("text", "opens")), True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    closes = (F.col("text") == "}") & (behind["text"] == "{") & behind["opens"]
    return leaf.withColumn("literal", F.col("opens") | F.coalesce(closes, F.lit(False)))


def scopes(sources: DataFrame) -> DataFrame:
    """Every pair of braces of brace languages: (path, lang, file, at, level, head, first_line, open_line, end_line, kind,
    name).  head: the code since the last brace or semicolon, tokens joined by blanks; kind: function, scope (of a namespace,
    class or the like) or block; end_line: that of the closing brace of the same level, null if it stays open."""
    code = tokens(sources.filter(F.col("lang").isin(*_FUNCTION)), cut=True).filter(~F.col("kind").isin(_NO_CODE))
    code = _marked(code).filter("not label")
    along = Window.partitionBy(*SEGMENT).orderBy("at")
    ends = ((F.col("text") == ";") | F.col("text").isin("{", "}") & ~F.col("literal")).cast("int")
    earlier, upto = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = code.withColumn("part", F.coalesce(F.sum(ends).over(earlier), F.lit(0)) + F.sum(F.col("begins").cast("int")).over(upto))
    word = F.when(F.col("kind") == "text", '""').otherwise(F.col("text"))
    begins = ~F.col("lang").isin("rust") | F.col("text").isin("pub", "fn", "async", "const", "unsafe", "extern", "default", "impl", "mod", "trait", "struct", "enum")
    heads = parts.groupBy(*SEGMENT, "part").agg(
        F.array_sort(F.collect_list(F.struct("at", word.alias("word")))).alias("words"), F.max_by("text", "at").alias("sign"), F.max_by("depth", "at").alias("depth"),
        F.max("at").alias("at"), F.max("line").alias("open_line"), F.min(F.when(begins & ~F.col("text").isin("{", "}", ";"), F.col("line"))).alias("first_line"),
    )
    level = F.when(F.col("sign") == "{", F.col("depth")).otherwise(F.col("depth") + 1)
    braces = heads.filter("sign in ('{', '}')").withColumn("level", level)
    along = Window.partitionBy(*FILE, "level").orderBy("at")
    closing = F.when(F.lead("sign").over(along) == "}", F.lead("open_line").over(along))
    head = F.array_join(F.transform(F.slice("words", 1, F.size("words") - 1), lambda w: w["word"]), " ")
    pairs = braces.withColumn("end_line", closing).filter("sign = '{'").withColumn("head", head)
    plain = F.when(F.col("lang") == "java", F.regexp_replace("head", rf"@ \w+(?: \. \w+)*(?: {_ARGS})? ", "")).otherwise(F.col("head"))
    plain = F.trim(F.regexp_replace(plain, r"^(?:(?:public|private|protected|default|case \S+) : ?)+|\[ \[.*?\] \]", ""))
    scope = _by_language(_SCOPE, F.col("plain"))
    found = F.coalesce(*(_by_language({k: v[i] for k, v in _FUNCTION.items() if len(v) > i}, F.col("plain")) for i in range(2)))
    own = F.element_at(F.split(found, " :: "), -1)
    reserved = F.array_contains(F.col("_reserved"), own)
    call = ~F.col("lang").isin("rust", "go") & F.rlike("plain", F.lit(r"(?:^|[ (])(?:new|return|throw|else) ")) & ~F.rlike("plain", F.lit("operator (?:new|delete)"))
    test = (F.col("lang") == "rust") & F.rlike("head", F.lit(r"# \[ (?:\w+ :: )*test \]"))
    is_function = found.isNotNull() & ~reserved & ~call & ~(F.col("lang").isin("javascript", "typescript", "arkts") & F.rlike("plain", F.lit(_JS_CALL)))
    kinds = F.when(F.col("scope").isNotNull(), "scope").when(F.col("is_function") & test, "test").when(F.col("is_function"), "function").otherwise("block")
    out = with_language(pairs.withColumn("plain", plain), "reserved").withColumn("scope", scope).withColumn("found", found).withColumn("is_function", is_function)
    name = F.when(F.col("scope").isNotNull(), F.col("scope")).when(F.col("is_function"), F.col("found"))
    joined = F.regexp_replace(F.replace(F.replace(name, F.lit(" :: "), F.lit("::")), F.lit("~ "), F.lit("~")), r"(?<=operator) (?=\W)|(?<=\W) (?=\W)", "")
    return out.select(*FILE, "at", "level", F.col("plain").alias("head"), F.coalesce("first_line", "open_line").alias("first_line"), "open_line", "end_line", kinds.alias("kind"), joined.alias("name"))


def brace_functions(sources: DataFrame) -> DataFrame:
    """(path, lang, ident, start_idx, end_idx) of the functions of brace languages, lines from 0, inclusive.  ident: names of
    the scopes around and of the function, joined by ::; the n-th repeat in a file gets _n.  Functions inside a function
    belong to it and have no row, nor have those marked as tests in Rust.  One that stays open ends with the file.

    The scope around a brace at a lower level is the last one opened there before it: a window by level, over the braces and
    a row for every level of each function.
    """
    all_pairs = written(scopes(sources), "scopes")
    named = all_pairs.filter("kind in ('scope', 'function', 'test')")
    probe = F.explode(F.when(F.col("level") > 1, F.sequence(F.lit(1), F.col("level") - 1)).otherwise(F.array())).alias("level")
    probes = named.filter("kind = 'function'").select(*FILE, F.col("at").alias("of"), "at", probe)
    opened = all_pairs.select(*FILE, F.lit(None).cast("int").alias("of"), "at", "level", F.struct("kind", "name").alias("scope"))
    seen = opened.unionByName(probes.withColumn("scope", F.lit(None).cast("struct<kind: string, name: string>")))
    upto = Window.partitionBy(*FILE, "level").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    around = seen.withColumn("around", F.last(F.when(F.col("of").isNull(), F.col("scope")), True).over(upto)).filter("of is not null")
    outer = around.groupBy(*FILE, F.col("of").alias("at")).agg(F.array_sort(F.collect_list(F.struct("level", "around"))).alias("outer"))
    files = sources.select("path", "lang", F.xxhash64("content").alias("file"), F.regexp_count(F.regexp_replace("content", r"(?:\r\n|\n|\r)\z", ""), F.lit(_LINE_ENDS)).alias("last")).distinct()
    found = named.filter("kind = 'function'").join(outer, [*FILE, "at"], "left").join(files, FILE)
    inside = F.exists("outer", lambda o: o["around"]["kind"].isin("function", "test"))
    names = F.filter(F.transform("outer", lambda o: F.when(o["around"]["kind"] == "scope", o["around"]["name"])), lambda n: n.isNotNull())
    ident = F.concat_ws("::", F.array_append(F.coalesce(names, F.array().cast("array<string>")), F.replace("name", F.lit("/"), F.lit("_"))))
    top = found.filter(~F.coalesce(inside, F.lit(False))).select("path", "lang", "file", "at", ident.alias("ident"), F.col("first_line").alias("start_idx"), F.coalesce("end_line", "last").alias("end_idx"))
    n = F.row_number().over(Window.partitionBy(*FILE, "ident").orderBy("at")) - 1
    return top.withColumn("n", n).select("path", "lang", F.when(F.col("n") > 0, F.concat_ws("_", "ident", "n")).otherwise(F.col("ident")).alias("ident"), "start_idx", "end_idx")


# -- blocks

#: First words of statements that end with their block, and of declarations that do; words that go on after one.
_BLOCK_WORDS = ["if", "for", "while", "switch", "do", "try", "else", "loop", "match", "unsafe", "synchronized", "with", "foreach", "}"]
_DECLARED = ["class", "struct", "enum", "union", "function", "interface", "fn", "impl", "trait", "mod", "async", "export", "static", "abstract", "record"]
_GO_ON = ["else", "catch", "finally"]
_JOINED = r"^(?:[.,;)\]}?:=+*/%&|^<>(\[`-]|in$|of$|instanceof$|as$).*"
#: Languages whose functions are split at statements; Python is split by lines, others where braces are at the first depth.
_STATEMENTS = ["c", "cpp", "java", "javascript", "typescript", "rust"]


def _statement_ends(code: DataFrame) -> DataFrame:
    """(path, lang, file, ends): last lines of the statements that make up the body of a text's first function, in order.

    An ordered fold over the tokens between the body's braces and outside of inner ones; the state is the first word of the
    statement and the lines found.  A statement ends with a semicolon; with the brace of a control block or declaration,
    unless else, catch or finally (after do: while) follows; before the body's end; and in JavaScript and TypeScript with a line that
    the next token doesn't continue."""
    along = Window.partitionBy(*FILE).orderBy("at")
    body = code.withColumns({c: F.lead(x).over(along) for c, x in (("next", "text"), ("next_line", "line"), ("next_depth", "depth"))})
    body = body.withColumn("closed", F.sum(F.when((F.col("text") == "}") & (F.col("depth") == 0), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    body = body.filter("coalesce(closed, 0) = 0 and depth = 1 and bracket = 0 and text <> '{'")
    items = body.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("at", "kind", "text", "last_line", "next", "next_line", "next_depth"))).alias("items"))
    script = F.col("lang").isin("javascript", "typescript")

    def step(s, t):
        first = F.when(s["first"] == "", t["text"]).otherwise(s["first"])
        control = first.isin(_BLOCK_WORDS)
        goes_on = t["next"].isin(_GO_ON) | (first == "do") & (t["next"] == "while")
        declared = first.isin(_DECLARED) & (t["next"] != ";") & ~(F.col("lang").isin("c", "cpp") & F.rlike(t["next"], F.lit(r"^[\w*,]")))
        brace = (t["text"] == "}") & ~goes_on & (control | declared)
        newline = script & ~control & (t["next_line"] > t["last_line"]) & (t["kind"].isin("word", "number", "text") | t["text"].isin(")", "]", "}")) & ~F.rlike(t["next"], F.lit(_JOINED)) & ~goes_on
        ends = (t["text"] == ";") & ~((first == "do") & (t["next"] == "while")) | brace | newline | (t["next_depth"] == 0)
        ends = F.coalesce(ends, F.lit(True))
        return F.struct(F.when(ends, "").otherwise(first).alias("first"), F.when(ends, F.array_append(s["ends"], t["last_line"])).otherwise(s["ends"]).alias("ends"))

    start = F.struct(F.lit("").alias("first"), F.array().cast("array<int>").alias("ends"))
    return items.select(*FILE, F.array_distinct(F.aggregate("items", start, step, lambda s: s["ends"])).alias("ends"))


def _depth_ends(code: DataFrame) -> DataFrame:
    """(path, lang, file, ends): the lines after which braces are as deep as after the first line (if none is open there, as
    deep as they first are); null if no brace opens."""
    per_line = code.withColumn("n", F.explode(F.sequence("line", "last_line"))).groupBy(*FILE, "n").agg(F.max_by("depth", "at").alias("d"))
    lines = per_line.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("n", "d"))).alias("lines"))
    entry = F.when(F.get("lines", F.lit(0))["d"] != 0, F.get("lines", F.lit(0))["d"]).otherwise(F.get(F.filter("lines", lambda x: x["d"] > 0), F.lit(0))["d"])
    return lines.withColumn("entry", entry).select(*FILE, F.when(F.col("entry").isNotNull(), F.transform(F.filter("lines", lambda x: x["d"] == F.col("entry")), lambda x: x["n"])).alias("ends"))


def cut_lines(ends: Column, total: Column, size: int) -> Column:
    """Greedy cuts as a fold over the lines at which a block may end: (first, last) of the blocks, lines from 0.  A block has
    more than ``size`` lines, or as many as there are; 2 * size or fewer that are left are one block."""
    state = F.struct(F.lit(0).alias("start"), F.array().cast("array<struct<first: int, last: int>>").alias("cuts"))

    def step(s, end):
        cut = (total - s["start"] > 2 * size) & (end >= s["start"] + size) & (end < total - 1)
        block = F.struct(s["start"].alias("first"), end.alias("last"))
        return F.struct(F.when(cut, end + 1).otherwise(s["start"]).alias("start"), F.when(cut, F.array_append(s["cuts"], block)).otherwise(s["cuts"]).alias("cuts"))

    return F.aggregate(ends, state, step, lambda s: F.array_append(s["cuts"], F.struct(s["start"].alias("first"), (total - 1).cast("int").alias("last"))))


def split_blocks(functions: DataFrame, size: int = 40) -> DataFrame:
    """functions: (path, lang, content), a function each.  (path, lang, block, first, last, text): blocks of about ``size``
    lines that end with a statement of the body.  Prefixes "Line N:" don't count as code, but stay in the blocks.

    Where the code is in error or no statement is found, blocks end where braces are at their first depth; without braces
    and in Python, after ``size`` lines.  Functions of ``size`` lines or fewer are one block.  Null or blank content has one
    empty block."""
    whole = functions.select("path", "lang", F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)^\s+|\s+\z", "").alias("content"))
    whole = written(whole, "functions").withColumn("lines", F.split("content", "\n")).withColumn("total", F.size("lines"))
    bare = whole.filter(F.col("total") > size).select("path", "lang", F.regexp_replace("content", r"(?m)^Line \d+: ?", "").alias("content"))
    bare = bare.filter("lang <> 'python'")
    sound = with_language(bare.filter(F.col("lang").isin(_STATEMENTS)), "tokens", "comment").withColumn("_pieces", _pieces()).filter(_sound())
    ends = written(_statement_ends(tokens(sound).filter(~F.col("kind").isin(_NO_CODE))), "statements")
    # Depths are needed only where no statements were found.
    rest = bare.withColumn("file", F.xxhash64("content")).join(ends, FILE, "left_anti")
    statements, depths = ends.withColumnRenamed("ends", "statements"), _depth_ends(tokens(rest)).withColumnRenamed("ends", "depths")
    keyed = whole.withColumn("file", F.xxhash64(F.regexp_replace("content", r"(?m)^Line \d+: ?", "")))
    found = keyed.join(depths, FILE, "left").join(statements, FILE, "left")
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("total") / size))), lambda i: (i * size - 1).cast("int"))
    greedy = F.aggregate(every, F.array().cast("array<int>"), lambda ends, e: F.when(F.col("total") - (e + 1 - size) > 2 * size, F.array_append(ends, e)).otherwise(ends))
    at_lines = F.transform(F.array_append(greedy, F.lit(-1)), lambda e: e)
    by_lines = F.transform(at_lines, lambda e, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.element_at(at_lines, i) + 1).cast("int").alias("first"), F.when(e < 0, F.col("total") - 1).otherwise(e).cast("int").alias("last")))
    parts = F.when(F.col("total") <= size, F.array(F.struct(F.lit(0).alias("first"), (F.col("total") - 1).cast("int").alias("last")))).when(
        F.coalesce("statements", "depths").isNotNull(), cut_lines(F.coalesce("statements", "depths"), F.col("total"), size)
    ).otherwise(by_lines)
    cut = found.select("path", "lang", "lines", F.posexplode(parts).alias("block", "part"))
    return cut.select("path", "lang", "block", "part.first", "part.last", F.array_join(F.slice("lines", F.col("part.first") + 1, F.col("part.last") - F.col("part.first") + 1), "\n").alias("text"))


# -- calls and terminating statements


def call_sites(functions: DataFrame, *keep: str) -> DataFrame:
    """functions: (caller, lang, content).  (caller, columns to keep, name): names in front of a bracket, by the language's own pattern, without
    its reserved words and without names that are called everywhere; comments and texts don't count."""
    df = with_language(masked(functions.select("caller", "lang", "content", *(c for c in keep if c != "lang")).filter("content is not null")), "call", "reserved")
    names = F.array_except(F.array_distinct(F.regexp_extract_all("code", F.col("_call"), F.lit(1))), F.concat("_reserved", F.lit(COMMON_CALLS)))
    return df.select("caller", *keep, F.explode(names).alias("name")).distinct()


def terminating(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Add ``terminating``: whether the block has a statement that ends its control flow, by the pattern of its language
    (cpp goes by C++'s).  Null text: false."""
    return with_language(blocks, "terminator").withColumn("terminating", F.coalesce(F.rlike(text, F.col("_terminator")), F.lit(False))).drop("_terminator")
