"""Queries over code that is written from the tables: scopes, blocks, comments, calls, terminating statements.  The
statements derive the expected rows from the tables' values, not from the code."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import syntax as S
from siltstone.plans.registry import query
from siltstone.session import shared_dir


def _files(rows: DataFrame, path: Column, lang: Column, order: list[str], piece: Column, head: Column, tail: str) -> DataFrame:
    """(path, lang, content): pieces of a path in order, between head and tail."""
    pieces = rows.select(path.alias("path"), lang.alias("lang"), *order, piece.alias("piece"), head.alias("head"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "piece"))), lambda p: p["piece"]), "")
    return pieces.groupBy("path", "lang").agg(F.concat(F.first("head"), joined, F.lit(tail)).alias("content"))


def _format(text: str, *columns) -> Column:
    return F.format_string(text, *(F.col(c) if isinstance(c, str) else c for c in columns))


@query("""with p as (select p_partkey k, split_part(p_brand, '#', 2) b, p_size % 5 n from part),
r as (select k, b, n, sum(n) over (partition by b order by k) - n before, row_number() over (partition by b order by k) - 1 i from p)
select 'b' || b || '.cpp' as path, 'cpp' as lang, 'b' || b || '::C' || k || '::f' || n as ident, (1 + 9 * i + before + 3)::int start_idx, (1 + 9 * i + before + 6 + n)::int end_idx from r
union all select 'b' || b || '.cpp', 'cpp', 'b' || b || '::C' || k || '::~C' || k, (1 + 9 * i + before + 7 + n)::int, (1 + 9 * i + before + 7 + n)::int from r
union all select 'B' || b || '.java', 'java', 'B' || b || '::m' || n || case when row_number() over (partition by b, n order by k) > 1 then '_' || (row_number() over (partition by b, n order by k) - 1) else '' end, (2 + 5 * i + before)::int, (2 + 5 * i + before + 4 + n)::int from r
union all select 'b' || b || '.ts', 'typescript', 'N' || k || '::inner', (7 * i + before + 1)::int, (7 * i + before + 3 + n)::int from r
union all select 'b' || b || '.ts', 'typescript', 'arrow' || k, (7 * i + before + 5 + n)::int, (7 * i + before + 6 + n)::int from r""")
def scoped_functions(t):
    """Functions with the scopes around them, in three languages; comments and texts hold braces."""
    parts = t.part.select("p_partkey", "p_name", (F.col("p_size") % 5).alias("n"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("b"))
    more = F.expr("repeat('    g(x); /* } ( */\n', n)")
    cpp = _format("class C%d final : public Base {\n // %s { \"\n public:\n  int f%d(int x) const {\n    if (x) { s = \"}\\\"\"; }\n%s    auto l = [&](int z) { return z; };\n  }\n  ~C%d() {}\n};\n", "p_partkey", "p_name", "n", more, "p_partkey")
    java = _format("  @Override\n  public int m%d(int x)\n      throws E {\n%s    new Runnable() { public void run() { } }; // %s }\n  }\n", "n", more, "p_name")
    ts = _format("namespace N%d {\n  export function inner(x: number, o = {}): number {\n    const s = `} %s ${x}`\n%s  }\n}\nexport const arrow%d = async (x: number) => { // {\n}\n", "p_partkey", "p_name", more, "p_partkey")
    each = [
        _files(parts, _format("b%s.cpp", "b"), F.lit("cpp"), ["p_partkey"], cpp, _format("namespace b%s {\n", "b"), "}\n"),
        _files(parts, _format("B%s.java", "b"), F.lit("java"), ["p_partkey"], java, _format("package p;\npublic class B%s {\n", "b"), "}\n"),
        _files(parts, _format("b%s.ts", "b"), F.lit("typescript"), ["p_partkey"], ts, F.lit(""), ""),
    ]
    return S.brace_functions(each[0].unionByName(each[1]).unionByName(each[2]))


#: Lines of the statement that an order becomes.
_LINES = "case o_orderstatus when 'F' then 3 when 'O' then 1 else 4 end"


@query(f"""with recursive o as (select o_custkey c, {_LINES} n, sum({_LINES}) over (partition by o_custkey order by o_orderkey) as last from orders),
f as (select c, max(last) + 2 total from o group by 1),
b as (select c, 0::hugeint as first, total from f union all
  select c, last + 1, total from (select b.c, b.total, min(o.last) as last from b join o on o.c = b.c and o.last >= b.first + 10 where b.total - b.first > 20 group by all) where last < total - 1)
select c::bigint o_custkey, (row_number() over (partition by c order by first) - 1)::int block, first::int as first, (coalesce(lead(first) over (partition by c order by first), total) - 1)::int as last from b""")
def statement_blocks(t):
    """A function a customer with a statement an order, in blocks of about ten lines."""
    statement = F.when(F.col("o_orderstatus") == "F", _format("  if (x) {\n    y(%d);\n  }\n", "o_orderkey")).when(F.col("o_orderstatus") == "O", _format("  x = %d; // } ;\n", "o_orderkey")).otherwise(_format("  do {\n    f(\"};\", %d\n    ); /* { */\n  } while (x);\n", "o_orderkey"))
    functions = _files(t.orders, F.col("o_custkey").cast("string"), F.lit("c"), ["o_orderkey"], statement, F.lit("int f(int x) {\n"), "}\n")
    return S.split_blocks(functions, 10).select(F.col("path").cast("long").alias("o_custkey"), "block", "first", "last")


@query("""with l as (select doc_id, unnest(string_split(replace(replace(text, chr(13), ' '), '\\', '/'), chr(10))) line, generate_subscripts(string_split(replace(text, chr(13), ' '), chr(10)), 1) i from documents)
select doc_id, md5(string_agg('x = "#"  ' || repeat(' ', strlen(line) + 2), chr(10) order by i)) code, count(*) filter (line <> '') as n from l group by 1""")
def comment_free_code(t):
    """A Python source a document, with the document's lines as comments; their bytes become blanks."""
    lines = F.split(F.replace(F.replace("text", F.lit("\r"), F.lit(" ")), F.lit("\\"), F.lit("/")), "\n")
    content = F.array_join(F.transform(lines, lambda x: F.concat(F.lit('x = "#"  # '), x)), "\n")
    sources = t.documents.filter("text is not null").select("doc_id", F.lit("python").alias("lang"), content.alias("content"), F.size(F.filter(lines, lambda x: x != "")).cast("long").alias("n"))
    return S.without_comments(sources).select("doc_id", F.md5(F.encode("code", "UTF-8")).alias("code"), "n")


@query("""with s as (select l_orderkey k, l_partkey p, l_returnflag f, ['c', 'rust', 'go', 'python'][(l_orderkey % 4 + 1)::int] lang from lineitem)
select lang, f.p_brand as brand, count(*) calls from (select distinct k, lang, p from s where f <> 'A') s join part f on f.p_partkey = s.p group by 1, 2""")
def calls_by_language(t):
    """An order is a function that calls its parts, by the form of its language; what came back is commented out or a text."""
    lang = F.element_at(F.array(*map(F.lit, ("c", "rust", "go", "python"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    form = lambda *forms: F.element_at(F.array(*(_format(x, "l_partkey") for x in forms)), (F.col("l_orderkey") % 4 + 1).cast("int"))
    call = form("  if (x) p%d<int>(1);\n", "  while true { p%d::<u8>(1); }\n", "  defer p%d[int](1)\n", "  print(p%d (1))\n")
    gone = F.when(F.col("l_linenumber") % 2 == 0, form("  /* p%d(1);\n*/\n", "  /* /* p%d(1) */ */\n", "  // p%d(1)\n", "  # p%d(1)\n")).otherwise(_format("  s = \"p%d(1)\"\n", "l_partkey"))
    piece = F.when(F.col("l_returnflag") == "A", gone).otherwise(call)
    lines = t.lineitem.withColumn("lang", lang)
    sources = _files(lines, F.col("l_orderkey").cast("string"), F.col("lang"), ["l_linenumber", "l_partkey"], piece, F.lit("head\n"), "")
    names = t.part.select(_format("p%d", "p_partkey").alias("name"), F.col("p_brand").alias("callee"))
    found = S.call_sites(sources.withColumnRenamed("path", "caller"), "lang").join(names, "name")
    return found.groupBy("lang", F.col("callee").alias("brand")).agg(F.count("*").alias("calls"))


@query("""select lang, l_shipmode_like as kind, sum(ends::int)::bigint ending, count(*) blocks from (
select l_orderkey % 6 as lang, min(l_linestatus) l_shipmode_like, bool_or(l_quantity > 45) ends from lineitem group by l_orderkey) group by 1, 2""")
def terminating_blocks(t):
    """Blocks of code, an order each, that end their control flow, by language."""
    langs = ["rust", "cpp", "go", "java", "erlang", "cobol"]
    ends = ["  panic!(\"x\");\n", "  throw x;\n", "  log.Fatalf(1)\n", "  System.exit (1);\n", "  erlang:error(x),\n", "  abort ();\n"]
    other = ["  panics!(x); r = returned;\n", "  throws(x); /* return */\n", "  xpanic(1) // os.Exit(1)\n", "  throwable(x); \"return\";\n", "  return, thrown(x),\n", "  aborted(); // exit()\n"]
    at = (F.col("l_orderkey") % 6 + 1).cast("int")
    piece = F.when(F.col("l_quantity") > 45, F.element_at(F.array(*map(F.lit, ends)), at)).otherwise(F.element_at(F.array(*map(F.lit, other)), at))
    lines = t.lineitem.withColumn("lang", F.element_at(F.array(*map(F.lit, langs)), at))
    blocks = _files(lines, F.col("l_orderkey").cast("string"), F.col("lang"), ["l_linenumber", "l_partkey"], piece, F.lit(""), "")
    kinds = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.min("l_linestatus").alias("kind"))
    found = S.terminating(S.masked(blocks), "code").join(kinds, "path")
    return found.groupBy((F.col("path").cast("long") % 6).alias("lang"), "kind").agg(F.sum(F.col("terminating").cast("long")).alias("ending"), F.count("*").alias("blocks"))


@query("""select 'src/' || lower(replace(p_brand, '#', '.')) || '-cpp/N' || p_size || '/f' || p_partkey || '.cpp' as file, md5(p_name || chr(13) || chr(10) || p_type) as content from part
union all select '_m/__init__-py/' || case when s_suppkey % 10 = 0 then '_function' || '' else replace(s_name, '#', '_') || '_x' end || '.py', md5(s_suppkey::varchar) from supplier where s_suppkey % 10 <> 0 or s_suppkey = 10""")
def function_files(t):
    """Every function as a file of its own, written and read back; names may begin with _."""
    from siltstone.sources.function_files import read_function_files, write_function_files

    cpp = t.part.select(
        F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("."))), F.lit(".cpp")).alias("path"), F.concat(F.lit("N"), F.col("p_size").cast("string"), F.lit("::f"), F.col("p_partkey").cast("string")).alias("ident"),
        F.concat("p_name", F.lit("\r\n"), "p_type").alias("content"),
    )
    ident = F.when(F.col("s_suppkey") == 10, "").otherwise(F.concat(F.replace("s_name", F.lit("#"), F.lit("/")), F.lit("_x")))
    python = t.supplier.filter("s_suppkey % 10 <> 0 or s_suppkey = 10").select(F.lit("_m/__init__.py").alias("path"), ident.alias("ident"), F.col("s_suppkey").cast("string").alias("content"))
    place = f"{shared_dir(t.spark)}/siltstone/functions-{uuid.uuid4().hex}"
    write_function_files(cpp.unionByName(python), place)
    return read_function_files(t.spark, place).select("file", F.md5(F.encode("content", "UTF-8")).alias("content"))
