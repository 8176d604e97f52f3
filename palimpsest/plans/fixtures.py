"""Derived views over the driver's tables: inputs for the operators at scale."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators.glyphs import Pages
from palimpsest.sources.store import tasks_for

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

_LI = """li as (
  select l_orderkey k, l_partkey pk, l_suppkey sk,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) n
  from {lineitem})"""

# Forty orders make a page, and ten pages a document, so that documents grow in number with the orders and not in size.
_PAGE = "cast(floor(o_orderkey / 40) as bigint) + 1"

#: SQL that Spark and DuckDB read alike; a pair where they don't.
VIEWS: dict[str, str | tuple[str, str]] = {
    "lines": (
        r"select doc_id, cast(pos as bigint) as line_no, line from {documents} lateral view posexplode(split(text, '\n')) l as pos, line",
        "select doc_id, unnest(range(len(string_split(text, chr(10))))) as line_no, unnest(string_split(text, chr(10))) as line from {documents}",
    ),
    "spec_lines": f"""with {_LI},
raw as (
  select {_PAGE} as page, o_orderkey as k, 1 as n, concat('R', o_orderkey + 100, ' order-', o_orderkey, ' is cust-', o_custkey) as body from {{orders}}
  union all select {_PAGE}, o_orderkey, 0, concat({_PAGE}, '.', o_orderkey, ' Section for clerk') from {{orders}} where o_orderkey % 10 = 0
  union all select {_PAGE}, o_orderkey, 7, 'NOTE urgent orders follow' from {{orders}} where o_orderpriority = '1-URGENT'
  union all select {_PAGE}, li.k, 2 * li.n, case when li.n % 2 = 1 then concat('or part-', li.pk) else concat('[ supp-', li.sk, ' ]') end
    from li join {{orders}} o on o.o_orderkey = li.k
  union all select {_PAGE}, li.k, 2 * li.n + 1, 'J3/24-007' from li join {{orders}} o on o.o_orderkey = li.k where li.n = 2 and li.k % 4 = 0)
select page, row_number() over (partition by page order by k, n, body) as line_no,
       concat(row_number() over (partition by page order by k, n, body), ' ', body) as line
from raw""",
    "rule_edges": """select concat('part-', p_partkey) src, concat('part-', (p_partkey * 7 + 3) % n.c) dst
  from {part} cross join (select count(*) c from {part}) n where p_partkey % 11 <> 0
union all select concat('part-', p_partkey), concat('supp-', p_partkey % 100) from {part} where p_partkey % 3 = 0
union all select concat('part-', p_partkey), concat('ghost-', p_partkey) from {part} where p_partkey % 97 = 0
union all select concat('supp-', s_suppkey), concat('nation-', s_nationkey) from {supplier}
union all select concat('nation-', n_nationkey), concat('region-', n_regionkey) from {nation}""",
    "rule_items": f"""with {_LI}
select concat('order-', k, case when k % 3 = 0 then '-stmt' else '' end) as lhs,
       cast(floor((n + 1) / 2) as int) as alt, cast((n - 1) % 2 + 1 as int) as pos,
       case pk % 4 when 0 then 'token' when 1 then 'optional' when 2 then 'repeat0' else 'ref' end as item_kind,
       case when pk % 4 = 3 then concat('order-', (k * 5 + n) % c.c, case when ((k * 5 + n) % c.c) % 3 = 0 then '-stmt' else '' end)
            else concat('part-', pk) end as name
from li cross join (select count(*) c from {{orders}}) c""",
    "classifications": """select concat('supp-', s_suppkey, '-name') as name, 'alias' as kind, '' as target, '-name' as suffix, '' as prefix, '' as sep from {supplier}
union all select concat('supp-', s_suppkey, '-list'), 'list', '', '-list', '', ',' from {supplier}
union all select concat('scalar-supp-', s_suppkey), 'scalar', '', '', 'scalar-', '' from {supplier}
union all select concat('old-supp-', s_suppkey), 'erratum', concat('supp-', s_suppkey), '', '', '' from {supplier}
union all select concat('WORD-', s_suppkey), 'lexical', '', '', '', '' from {supplier}
union all select concat('hole-', s_suppkey), 'semantic-only', '', '', '', '' from {supplier} where s_suppkey % 5 = 0
union all select concat('WORD-', s_suppkey), 'lexical', '', '', '', '' from {supplier} where s_suppkey % 4 = 0
union all select concat('old-supp-', s_suppkey), 'erratum', 'supp-0', '', '', '' from {supplier} where s_suppkey % 10 = 3""",
    # Tables of fifty facts, one a part: their ranges are apart but where faults are planted.
    "lex_facts": """select cast(floor(p_partkey / 50) as bigint) as tbl, p_partkey as fact, case when p_partkey % 173 = 5 then 'TERM-4' else concat('TERM-', p_partkey) end as source_term,
       case when p_partkey % 211 = 9 then '' else concat('target-', p_partkey - case when p_partkey % 331 = 7 then 1 else 0 end) end as target, p_brand as class, 'doc' as document, cast(p_size as varchar(9)) as clause,
       case when p_partkey % 397 = 11 then null else p_partkey end as page, case when p_partkey % 467 = 3 then 'none' else repeat('a', 64) end as hash,
       case when p_partkey % 150 = 55 then 'processor-defined' else '' end as codepoint
  from {part}""",
    "lex_ranges": """select cast(floor(p_partkey / 50) as bigint) as tbl, p_partkey as fact, 32 + 20 * (p_partkey % 50) as first, 32 + 20 * (p_partkey % 50) + p_size % 15 as last from {part} where p_partkey % 150 not in (55, 56)
union all select cast(floor(p_partkey / 50) as bigint), p_partkey, 8192 + 20 * (p_partkey % 50), 8192 + 20 * (p_partkey % 50) + 9 from {part} where p_partkey % 3 = 0 and p_partkey % 150 <> 56
union all select cast(floor(p_partkey / 50) as bigint), p_partkey, 30 + 20 * (p_partkey % 50), 200 + 20 * (p_partkey % 50) from {part} where p_partkey % 500 in (110, 430)
union all select cast(floor(p_partkey / 50) as bigint), p_partkey, 70000 + p_partkey, 69990 + p_partkey from {part} where p_partkey % 600 = 300
union all select cast(floor(p_partkey / 50) as bigint), p_partkey, 55000, 55300 from {part} where p_partkey % 700 = 660""",
    "glyphs": (
        """select doc_id, cast(pos as bigint) as text_index, ch,
       cast(6.0 * (pos % 40) + (case when pos % 7 = 0 then 4.0 else 0.0 end) as double) as x1, cast(6.0 * (pos % 40) + 5.0 as double) as x2,
       cast(12.0 * cast(floor(pos / 40) as int) + 0.5 * (pos % 3) as double) as y1
from {documents} lateral view posexplode(split(text, '')) g as pos, ch where ch <> ''""",
        """select doc_id, pos as text_index, ch,
       cast(6.0 * (pos % 40) + (case when pos % 7 = 0 then 4.0 else 0.0 end) as double) as x1, cast(6.0 * (pos % 40) + 5.0 as double) as x2,
       cast(12.0 * cast(floor(pos / 40) as int) + 0.5 * (pos % 3) as double) as y1
from (select doc_id, unnest(range(length(text))) as pos, unnest(string_split(text, '')) as ch from {documents}) where ch <> ''""",
    ),
    "semantic_items": (
        """select concat('S', d.doc_id % 700) as id, d.doc_id as pos, d.lang as subject, d.source as document,
  cast(d.doc_id % 15 + 1 as string) as clause, concat('R', d.doc_id % 1600) as rule, cast(d.doc_id % 50 as int) as page,
  case when d.doc_id % 41 = 0 then '' else sha2(d.text, 256) end as source_hash,
  case d.doc_id % 9 when 0 then 'mechanical' when 1 then 'search' when 2 then 'smt' when 3 then 'llm' when 4 then 'llm-repair'
    when 5 then 'human' when 6 then 'imported' when 7 then 'differential' else 'unknown' end as origin,
  case when l.quality = 1 then 'resolved' when l.quality = 0 then 'unresolved' else 'disputed' end as resolution
from {documents} d left join {labels} l on l.doc_id = d.doc_id""",
        "",
    ),
    "tree_nodes": """with n as (select n_nationkey, n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) j from {nation}),
s as (select s_suppkey, s_nationkey, row_number() over (partition by s_nationkey order by s_suppkey) k from {supplier})
select 'rhs' as path, 'root' as name
union all select concat('rhs/', r_regionkey + 1), concat('region-', r_regionkey) from {region}
union all select concat('rhs/', n_regionkey + 1, '/', j), concat('nation-', n_nationkey) from n
union all select concat('rhs/', n.n_regionkey + 1, '/', n.j, '/', s.k), concat('supp-', s_suppkey) from s join n on n.n_nationkey = s.s_nationkey""",
}
VIEWS["alias_rules"] = """select concat('part-', p_partkey) as lhs, 1 as alt, case when p_partkey % 3 <> 0 then concat('part-', (p_partkey * 7 + 3) % n.c) end as ref, p_type as role, p_brand as source from {part} cross join (select count(*) c from {part}) n
union all select concat('part-', p_partkey), 2, case when p_partkey % 26 = 19 then concat('ghost-', p_partkey) end, concat(p_type, '-alt'), concat('size-', p_size) from {part} where p_partkey % 13 = 6"""
VIEWS["expr_nodes"] = """with i as (select lhs, alt, pos, item_kind, name, case when item_kind = 'ref' then 0 else cast(substr(name, 6) as bigint) % 7 end as m from {rule_items}),
w as (select lhs, concat('rhs/', alt, '/', pos, '/1') as path, name, m from i where item_kind in ('optional', 'repeat0'))
select lhs as tree, 'rhs' as path, 'choice' as kind, '' as name, 1 as minimum from i group by lhs
union all select lhs, concat('rhs/', alt), 'sequence', '', 1 from i group by lhs, alt
union all select lhs, concat('rhs/', alt, '/', pos), case item_kind when 'ref' then 'reference' when 'repeat0' then 'repeat' else item_kind end, case when item_kind in ('ref', 'token') then name else '' end, case when item_kind = 'repeat0' then cast(m % 2 as int) else 1 end from i
union all select lhs, path, case when m in (0, 6) then 'token' when m = 1 then 'choice' when m = 2 then 'optional' when m = 5 then 'repeat' else 'sequence' end, case when m in (0, 6) then name else '' end, 0 from w
union all select lhs, concat(path, '/1'), case when m = 1 then 'choice' when m in (2, 3) then 'token' when m = 5 then 'optional' else 'sequence' end, case when m in (2, 3) then name else '' end, 1 from w where m in (1, 2, 3, 4, 5)
union all select lhs, concat(path, '/2'), case when m = 1 then 'token' else 'reference' end, case when m = 1 then name else lhs end, 1 from w where m in (1, 4)
union all select lhs, concat(path, '/1/1'), case when m = 5 then 'sequence' else 'token' end, case when m = 5 then '' else name end, 1 from w where m in (1, 4, 5)
union all select lhs, concat(path, '/1/2'), 'reference', lhs, 1 from w where m in (1, 4)
union all select lhs, concat(path, '/1/1/1'), 'reference', lhs, 1 from w where m = 5"""
VIEWS["evidence"] = """with e as (select document, clause, source_hash, page, pos as byte_start, rule, subject as lhs, id as path, origin as kind, resolution as status from {semantic_items})
select * from e
union all select document, clause, source_hash, page, byte_start, rule, lhs, path, 'search', 'unresolved' from e where byte_start % 3 = 0
union all select * from e where byte_start % 10 = 4"""
VIEWS["checked_items"] = """select case when pos % 43 = 5 then null else id end as id, pos, case when pos % 47 = 6 then null else subject end as subject, case when pos % 53 = 7 then null else document end as document,
 case when pos % 59 = 8 then null when pos % 59 = 9 then '' else clause end as clause, case when pos % 61 = 10 then null when pos % 61 = 11 then '' else rule end as rule, case when pos % 67 = 12 then null else page end as page,
 case when pos % 71 = 13 then null else source_hash end as source_hash, case when pos % 73 = 14 then null else origin end as origin, case when pos % 79 = 15 then null when pos % 79 = 16 then 'open' else resolution end as resolution
 from {semantic_items}"""
_items = VIEWS["semantic_items"][0]
# Spark joins digests and no texts to the labels.
_digests = _items.replace("sha2(d.text, 256)", "d.digest").replace("{documents} d", "(select doc_id, lang, source, sha2(text, 256) as digest from {documents}) d")
VIEWS["semantic_items"] = (_digests, _items.replace("sha2(d.text, 256)", "sha256(d.text)").replace("as string", "as varchar"))
# Spark cuts line items and lines into as many partitions as line items need, so that its windows don't grow with the input.
_lines = VIEWS["spec_lines"]
_cut = _lines.replace("from {lineitem}", "from (select /*+ repartition({tasks}, l_orderkey) */ l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity from {lineitem})")
VIEWS["spec_lines"] = (_cut.replace("\nfrom raw", "\nfrom (select /*+ repartition({tasks}, page) */ * from raw)"), _lines)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir, or a derived view over them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][0]
    needs = set(re.findall(r"\{(\w+)\}", sql))
    given = {n: view(spark, sf_dir, n) for n in needs - {"tasks"}}
    if "tasks" in needs:
        given["tasks"] = tasks_for(given["lineitem"])
    return spark.sql(sql, **given) if given else spark.sql(sql)


def glyph_pages(documents: DataFrame) -> Pages:
    """The view glyphs as pages whose glyphs are drawn where they are worked on."""

    def draw(rows: pa.RecordBatch) -> pa.RecordBatch:
        pos = rows["text_index"].to_numpy()
        at = 6.0 * (pos % 40)
        place = {"x1": at + np.where(pos % 7 == 0, 4.0, 0.0), "x2": at + 5.0, "y1": 12.0 * (pos // 40) + 0.5 * (pos % 3)}
        return pa.RecordBatch.from_pydict({n: rows[n] for n in rows.schema.names} | place)

    kind = dict(documents.dtypes)["doc_id"]
    return Pages(documents.select("doc_id", "text"), {"doc_id": kind, "text_index": "bigint", "ch": "string", "x1": "double", "x2": "double", "y1": "double"}, draw)


def duck(*names: str) -> str:
    """The views as DuckDB's common table expressions: `with a as (...), b as (...)`."""
    out = []
    for name in names:
        sql = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][1]
        out.append(f"{name} as ({re.sub(r'[{](\w+)[}]', r'\1', sql)})")
    return "with recursive " + ",\n".join(out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable:
    """Register a function of (t), t(name) being a table or view. sql goes on after the views' expressions."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda v: view(spark, sf_dir, v))
        if sql:
            head = duck(*views) if views else ""
            joint = ",\n" if head and sql.lstrip().startswith("+") else "\n"
            SQL[name] = head + joint + sql.lstrip().removeprefix("+")
        return f

    return keep
