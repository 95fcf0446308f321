"""Column expressions: paths and identities, usage buckets, cost, labels, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension and language of extracted sources.
LANGUAGES = {"py": "python", "c": "c", "h": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "go": "go", "rs": "rust", "java": "java", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "ets": "arkts", "erl": "erlang"}

#: Directories that hold tests, and names of test files.
TEST_DIRS = ["test", "tests", "__tests__", "testing", "test_helpers", "testdata", "testutils", "fixtures", "mocks"]
TEST_NAMES = "|".join([
    r"^test_.*\.py$",
    r"^.*_test\.py$",
    r"^conftest\.py$",
    r"^.*_test\.go$",
    r"^.*_test\.(?:cpp|cc|cxx|c|h|hpp)$",
    r"^test_.*\.(?:cpp|cc|cxx|c|h|hpp)$",
    r"^.*Test(?:s|Case)?\.java$",
    r"^.*\.(?:test|spec)\.(?:js|jsx|ts|tsx)$",
    r"^.*_test\.rs$",
    r"^.*\.test\.(?:ets)$",
    r"^.*_(?:SUITE|tests?)\.erl$",
])


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name; '' without a dot."""
    name = base_name(path)
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise("")


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.lit("unknown"))


def directory_name(name: Column) -> Column:
    """A file's directory of functions: its last dot becomes '-', unless the name begins with it."""
    return F.regexp_replace(name, r"^(.+)\.([^.]*)$", "$1-$2")


def fqn(path: Column, ident: Column) -> Column:
    """dir::base-ext::ident of a source path and an identifier."""
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", ""))
    return F.concat_ws("::", F.regexp_replace(folder, "/", "::"), directory_name(base_name(path)), ident)


def fqn_source(name: Column, extensions: list[str] | None = None) -> Column:
    """The source path of an fqn: the last part that reads <base>-<known extension>; null without one."""
    known = "|".join(extensions or LANGUAGES)
    parts = F.split(name, "::")
    hits = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.get(parts, i - 1).rlike(rf"^.+-({known})$"))
    at = F.array_max(hits)
    return F.when(at.isNotNull(), F.array_join(F.concat(F.slice(parts, 1, at - 1), F.array(F.regexp_replace(F.get(parts, at - 1), r"-([^-]*)$", ".$1"))), "/"))


def bare_name(ident: Column) -> Column:
    """The last scope part, without decoration: parameters, template arguments and a leading '~' or '*'."""
    out = F.regexp_replace(ident, r"\(.*$", "")
    out = F.regexp_replace(out, r"<[^<>]*>", "")
    return F.regexp_replace(F.element_at(F.split(out, "::|\\."), -1), r"^[~*&\s]+", "")


def bug_id(path: Column) -> Column:
    """Result path without extension, separators as '--'."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), "/", "--")


def in_scope(path: Column, scopes: list[str]) -> Column:
    """Whether a path (a leading './' doesn't count) is one of the scopes or below one; no scope: all are."""
    p = F.regexp_replace(path, r"^\./", "")
    out = F.lit(not scopes)
    for s in scopes:
        out = out | (p == s) | p.startswith(s + "/")
    return out


def is_test_file(path: Column, exempt: list[str] | None = None) -> Column:
    dirs = F.slice(F.split(F.lower(path), "/"), 1, F.size(F.split(path, "/")) - 1)
    hit = F.arrays_overlap(dirs, F.array(*map(F.lit, TEST_DIRS))) | base_name(path).rlike(TEST_NAMES)
    return hit & ~path.isin(exempt or [])


def exclusion_reason(path: Column, scopes: list[str]) -> Column:
    """Why a path is left out: scope first, then tests; null if it isn't."""
    return F.when(~in_scope(path, scopes), "outside submodules").when(is_test_file(path), "test file")


def _n(name: str, raw: str) -> Column:
    return F.expr(f"try_variant_get({raw}, '$.{name}', 'bigint')")


def usage_estimate(raw: str) -> Column:
    """struct(input, output, cache_read, cache_write) of a VARIANT column by key presence.  Where a prompt count comes with
    cached tokens, the input is the count of misses, or else what the cached tokens leave of it."""
    details = [F.nullif(_n(f"{k}_details.cached_tokens", raw), F.lit(0)) for k in ("prompt_tokens", "input_tokens")]
    hit = F.coalesce(_n("cache_read_input_tokens", raw), _n("prompt_cache_hit_tokens", raw), *details, F.lit(0))
    prompt = _n("prompt_tokens", raw)
    whole = F.coalesce(_n("input_tokens", raw), prompt, F.lit(0))
    fresh = F.coalesce(_n("prompt_cache_miss_tokens", raw), F.greatest(F.lit(0), whole - hit))
    return F.struct(
        F.when(prompt.isNotNull() & (hit != 0), fresh).otherwise(whole).alias("input"),
        F.coalesce(_n("output_tokens", raw), _n("completion_tokens", raw), F.lit(0)).alias("output"),
        hit.alias("cache_read"), F.coalesce(_n("cache_creation_input_tokens", raw), F.lit(0)).alias("cache_write"),
    )


def usage_native(raw: str) -> Column:
    """The same as a live dashboard reads it: the first vendor's keys unless all four are 0, then the second's, split by
    cache hits only."""
    first = [F.coalesce(_n(k, raw), F.lit(0)) for k in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")]
    none = (first[0] == 0) & (first[1] == 0) & (first[2] == 0) & (first[3] == 0)
    hit = F.coalesce(_n("prompt_cache_hit_tokens", raw), F.lit(0))
    second = [F.greatest(F.lit(0), F.coalesce(_n("prompt_tokens", raw), F.lit(0)) - hit), F.coalesce(_n("completion_tokens", raw), F.lit(0)), hit, F.lit(0)]
    return F.struct(*(F.when(none, b).otherwise(a).alias(n) for n, a, b in zip(("input", "output", "cache_read", "cache_write"), first, second, strict=True)))


def usage_agent(raw: str) -> Column:
    """The same for agent traces: the first value that isn't 0 counts, and nested cached tokens stay in the input."""
    some = lambda *names: F.coalesce(*(F.nullif(_n(n, raw), F.lit(0)) for n in names), F.lit(0))
    hit = _n("prompt_cache_hit_tokens", raw)
    split = F.when(F.coalesce(hit, F.lit(0)) > 0, F.greatest(F.lit(0), _n("prompt_tokens", raw) - hit))
    return F.struct(
        F.coalesce(F.nullif(_n("input_tokens", raw), F.lit(0)), split, some("prompt_tokens")).alias("input"), some("output_tokens", "completion_tokens").alias("output"),
        some("cache_read_input_tokens", "prompt_cache_hit_tokens", "prompt_tokens_details.cached_tokens").alias("cache_read"),
        some("cache_creation_input_tokens", "cache_write_input_tokens").alias("cache_write"),
    )


def cost(usage: dict[str, Column], price: dict[str, Column]) -> Column:
    """Sum of bucket times unit price; null when a price is missing."""
    out = F.lit(0.0)
    for name, n in usage.items():
        out = out + n * price[name]
    return out


def trace_value(record: str, key: str) -> Column:
    """The first of key, +key and *key in a map column."""
    return F.coalesce(*(F.element_at(record, p + key) for p in ("", "+", "*")))


def status_code(status: Column) -> Column:
    return F.when(status == "success", "200").when(status == "format_error", "FMT").otherwise("ERR")


def _scaled(n: Column, unit: int, places: int) -> Column:
    """n / unit with some decimal places, as the quotient's binary value rounds: at a tie of the decimal value, what the double
    is more or less than it decides, and the even digit where it is the tie itself."""
    step = unit // 10**places
    base, rest = F.floor(n / step).cast("long"), n.cast("long") % step
    quotient = n.cast("double") / F.lit(float(unit))
    # The quotient in two parts that have room for an exact product with the unit.
    high = quotient * 134217729.0 - (quotient * 134217729.0 - quotient)
    more = (high * float(unit) - n.cast("double")) + (quotient - high) * float(unit)
    up = (2 * rest > step) | ((2 * rest == step) & ((more > 0) | ((more == 0) & (base % 2 == 1))))
    digits = base + F.when(up, 1).otherwise(0)
    whole = F.floor(digits / 10**places).cast("long")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((digits % 10**places).cast("string"), places, "0"))


#: Fixed value: the label of what isn't known.
UNKNOWN = "—"


def token_label(n: Column) -> Column:
    """12, 3.4K, 5.67M; a dash for null."""
    return F.when(n.isNull(), UNKNOWN).when(n >= 1_000_000, F.concat(_scaled(n, 1_000_000, 2), F.lit("M"))).when(n >= 1000, F.concat(_scaled(n, 1000, 1), F.lit("K"))).otherwise(n.cast("long").cast("string"))


def duration_label(seconds: Column) -> Column:
    """5s, 1m 05s, 1h 01m 40s; a dash for null."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long"), s % 60
    return F.when(s.isNull(), UNKNOWN).when(s >= 3600, F.format_string("%dh %02dm %02ds", h, m % 60, r)).when(s >= 60, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", s))


def cost_label(usd: Column) -> Column:
    """Dollars with fewer decimals the more there are: $0.123, $12.34, $123.4, $12346; a dash for null."""
    places = ((1, 3), (100, 2), (10_000, 1))
    out = F.lit(None).cast("string")
    for below, n in places:
        out = F.coalesce(out, F.when(F.abs(usd) < below, F.format_string(f"$%.{n}f", usd.cast("double"))))
    return F.when(usd.isNull(), "—").otherwise(F.coalesce(out, F.format_string("$%.0f", usd.cast("double"))))


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def has_exactly_keys(json: Column, keys: list[str]) -> Column:
    """Whether a JSON text is an object with exactly these keys."""
    return F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def valid_spec(json: Column) -> Column:
    """A sidecar with exactly signature, pre_condition and post_condition, all texts."""
    keys = ["signature", "pre_condition", "post_condition"]
    variant = F.try_parse_json(json)
    texts = [F.coalesce(F.schema_of_variant(F.try_variant_get(variant, f"$.{k}", "variant")) == "STRING", F.lit(False)) for k in keys]
    return has_exactly_keys(json, keys) & texts[0] & texts[1] & texts[2]


def terminal_validation(record: str, key: str) -> Column:
    """A finished record (VARIANT): the id matches, the status is one of three, texts are texts, attempts is a whole number
    above 0 and no boolean."""
    kind = lambda n: F.schema_of_variant(F.expr(f"try_variant_get({record}, '$.{n}', 'variant')"))
    text = lambda n: F.expr(f"try_variant_get({record}, '$.{n}', 'string')")
    out = (text("id") == F.col(key)) & text("confirmation_status").isin("confirmed", "not_confirmed", "error")
    for n in ("source_file", "function_name", "probe_script", "detail_file", "probe_stdout", "trigger_summary"):
        out = out & (kind(n) == "STRING")
    return F.coalesce(out & (kind("attempts") == "BIGINT") & (_n("attempts", record) > 0), F.lit(False))


def search(query: str, *fields: str) -> Column:
    """Whether fields joined by spaces contain the query, whatever the case."""
    return F.contains(F.lower(F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in fields))), F.lit(query.strip().lower()))


def node_end_line(start_line: Column, end_line: Column, end_column: Column) -> Column:
    """The last line of a syntax node: one that ends at column 0 of a later line ends with the line before."""
    return F.when((end_column == 0) & (end_line > start_line), end_line - 1).otherwise(end_line)


def phase_value(columns: Column, phase: Column, ending: str = "_callers") -> Column:
    """The entry phase<n><ending> of a map, or else its first one of any phase with that ending; null without one."""
    exact = F.concat(F.lit("phase"), phase.cast("string"), F.lit(ending))
    other = F.get(F.filter(F.map_keys(columns), lambda k: k.startswith("phase") & k.endswith(ending)), F.lit(0))
    return F.when(F.map_contains_key(columns, exact), F.element_at(columns, exact)).otherwise(F.element_at(columns, other))
