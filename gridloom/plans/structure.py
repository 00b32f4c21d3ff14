"""Grid, region, header, period, column and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import a1
from gridloom.functions import text as tx
from gridloom.operators import bands, profile
from gridloom.operators.structure import REGION, dedupe_names
from gridloom.plans import inputs
from gridloom.plans.inputs import lake, table
from gridloom.sources.grid import to_grid

BIG = "bigint"


def grid_melt(spark, sf):
    cells = to_grid(table(spark, sf, "part"), "Part", ["p_partkey"])
    return cells.select("sheet", "r", F.col("c").cast(BIG).alias("c"), "raw_kind", "raw_text", "raw_num", "val_kind")


GRID_MELT = """
with p as (select *, row_number() over (order by p_partkey) + 1 as r from part),
m as (
  select r, 1 c, 'int' k, cast(p_partkey as varchar) t, cast(p_partkey as double) n from p
  union all select r, 2, 'text', p_name, null from p union all select r, 3, 'text', p_brand, null from p
  union all select r, 4, 'text', p_type, null from p
  union all select r, 5, 'int', cast(p_size as varchar), cast(p_size as double) from p
  union all select r, 6, 'float', cast(p_retailprice as varchar), p_retailprice from p
  union all select 1, 1, 'text', 'p_partkey', null union all select 1, 2, 'text', 'p_name', null
  union all select 1, 3, 'text', 'p_brand', null union all select 1, 4, 'text', 'p_type', null
  union all select 1, 5, 'text', 'p_size', null union all select 1, 6, 'text', 'p_retailprice', null)
select 'Part' as sheet, cast(r as bigint) as r, cast(c as bigint) as c, k as raw_kind, t as raw_text, n as raw_num, k as val_kind
from m where t is not null
"""

# -- sparse grid of line items ----------------------------------------------------------------------
SPARSE = """
cells as (
  select l_returnflag as sheet, l_orderkey + 1 as r, l_linenumber as c,
    case when l_linenumber <= 2 then 'text' when l_linenumber <= 4 then 'float' when l_linenumber = 5 then 'int'
         when l_linenumber = 6 then 'bool' else 'date' end as kind,
    case when l_linenumber <= 2 then min(l_linestatus) || '-' || cast(l_linenumber as varchar)
         when l_linenumber <= 4 then cast(max(l_extendedprice) as varchar)
         when l_linenumber = 5 then cast(cast(max(l_quantity) as bigint) as varchar)
         when l_linenumber = 6 then case when max(l_discount) > 0.05 then 'True' else 'False' end
         else strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') end as txt
  from lineitem group by l_returnflag, l_orderkey, l_linenumber),
rowset as (select distinct sheet, r from cells),
rb as (select sheet, r, r - row_number() over (partition by sheet order by r) as g from rowset),
bands as (select sheet, g, min(r) as b0, max(r) as b1 from rb group by sheet, g),
rband as (select rb.sheet, rb.r, b0, b1 from rb join bands using (sheet, g)),
cc as (select distinct c.sheet, b0, b1, c.c from cells c join rband using (sheet, r)),
ci as (select *, c - row_number() over (partition by sheet, b0 order by c) as g from cc),
regions as (select sheet, b0 as min_r, b1 as max_r, min(c) as min_c, max(c) as max_c from ci group by sheet, b0, b1, g),
labelled as (
  select c.*, g.min_r, g.max_r, g.min_c, g.max_c from cells c join rband b using (sheet, r)
  join regions g on g.sheet = c.sheet and g.min_r = b.b0 and c.c between g.min_c and g.max_c),
scores as (
  select sheet, min_r, max_r, min_c, max_c, r,
    0.3 * (count(*) / (max_c - min_c + 1)) + 0.3 * (count(*) filter (where kind = 'text') / count(*))
    + 0.25 * (count(distinct lower(trim(txt))) / count(*)) + 0.15 * (count(*) filter (where length(txt) <= 60) / count(*)) as score
  from labelled where r <= min_r + 4 group by sheet, min_r, max_r, min_c, max_c, r),
headers as (
  select sheet, min_r, min_c, r as header_row, score from (
    select *, row_number() over (partition by sheet, min_r, min_c order by score desc, r) as k from scores)
  where k = 1 and score >= 0.35)
"""


def row_bands(spark, sf):
    st = lake(spark, sf, inputs.sparse_lines).structure
    return bands.row_bands(st.runs).select("sheet", "band_start", "band_end")


ROW_BANDS = f"with {SPARSE} select sheet, b0 as band_start, b1 as band_end from bands"


def regions_sparse(spark, sf):
    st = lake(spark, sf, inputs.sparse_lines).structure
    return st.rectangles.select("sheet", "region_no", "min_r", F.col("min_c").cast(BIG).alias("min_c"), "max_r",
                                F.col("max_c").cast(BIG).alias("max_c"))


REGIONS_SPARSE = f"""with {SPARSE}
select sheet, cast(row_number() over (partition by sheet order by min_r, min_c) as bigint) as region_no,
  min_r, cast(min_c as bigint) as min_c, max_r, cast(max_c as bigint) as max_c from regions"""


def _key(df):
    return df.withColumn("min_c", F.col("min_c").cast(BIG))


def header_scores(spark, sf):
    st = lake(spark, sf, inputs.sparse_lines).structure
    return _key(st.scores).select("sheet", "min_r", "min_c", "r", F.round("score", 6).alias("score"))


HEADER_SCORES = f"with {SPARSE} select sheet, min_r, cast(min_c as bigint) as min_c, r, round(score, 6) as score from scores"


def header_row(spark, sf):
    st = lake(spark, sf, inputs.sparse_lines).structure
    return _key(st.headers).select("sheet", "min_r", "min_c", "header_row")


HEADER_ROW = f"with {SPARSE} select sheet, min_r, cast(min_c as bigint) as min_c, header_row from headers"

COLUMNS_CTE = r"""
slots as (
  select g.*, h.header_row, g.min_c + u.i as c, u.i + 1 as idx from regions g
  left join headers h using (sheet, min_r, min_c), unnest(range(0, max_c - min_c + 1)) as u(i)),
head_text as (
  select s.sheet, s.min_r, s.min_c, s.c, l.txt from slots s join labelled l
  on l.sheet = s.sheet and l.min_r = s.min_r and l.min_c = s.min_c and l.c = s.c and l.r = s.header_row
  where not (l.kind = 'bool' and l.txt = 'False') and not (l.kind in ('int', 'float') and try_cast(l.txt as double) = 0)),
bases as (
  select s.*, regexp_replace(regexp_replace(lower(trim(coalesce(t.txt, 'column_' || idx))), '\W+', '_', 'g'), '^_+|_+$', '', 'g') as b0
  from slots s left join head_text t using (sheet, min_r, min_c, c)),
based as (select *, case when regexp_matches(b0, '^\d') then 'c_' || b0 else b0 end as base from bases),
nth as (select *, row_number() over (partition by sheet, min_r, min_c, base order by idx) as k from based),
tried as (select *, case when k = 1 then base else base || '_' || k end as t from nth),
named as (
  select *, case when row_number() over (partition by sheet, min_r, min_c, t order by k, idx) = 1 then t
                 else t || '_c' || idx end as name from tried)
"""


def region_columns(spark, sf):
    st = lake(spark, sf, inputs.sparse_lines).structure
    return _key(st.columns).select("sheet", "min_r", "min_c", F.col("idx").cast(BIG).alias("idx"), "name", "type", "sql_type")


REGION_COLUMNS = f"""with {SPARSE}, {COLUMNS_CTE},
counts as (
  select n.sheet, n.min_r, n.min_c, n.idx, n.name, count(l.txt) as n, count(*) filter (where l.kind = 'bool') as nb,
    count(*) filter (where l.kind = 'int') as ni, count(*) filter (where l.kind in ('int', 'float')) as nn,
    count(*) filter (where l.kind = 'date') as nd
  from named n left join labelled l on l.sheet = n.sheet and l.min_r = n.min_r and l.min_c = n.min_c and l.c = n.c
    and l.r >= coalesce(n.header_row + 1, n.min_r) group by all)
select sheet, min_r, cast(min_c as bigint) as min_c, cast(idx as bigint) as idx, name,
  case when n = 0 then 'text' when nb = n then 'boolean' when ni = n then 'integer' when nn = n then 'decimal'
       when nd = n then 'date' else 'text' end as type,
  case when n = 0 then 'varchar' when nb = n then 'boolean' when nn = n then 'double' else 'varchar' end as sql_type
from counts"""


def region_shapes(spark, sf):
    regions = lake(spark, sf, inputs.sparse_lines).regions
    return _key(regions).select(
        "sheet", "region_no", "table_name", "region_id", "bounds", "header_row", "data_start_row", "row_count",
        F.col("column_count").cast(BIG).alias("column_count"), "region_kind", "orientation",
        F.round("raw_confidence", 6).alias("confidence"), F.size("sample_rows").cast(BIG).alias("n_samples"), "source_ref")


REGION_SHAPES = f"""with {SPARSE}, {COLUMNS_CTE},
sampled as (
  select l.sheet, l.min_r, l.min_c, count(distinct l.r) as n_samples from labelled l left join headers h using (sheet, min_r, min_c)
  where l.r between coalesce(h.header_row + 1, l.min_r) and coalesce(h.header_row + 1, l.min_r) + 2 group by all),
filled as (select sheet, min_r, min_c, count(*) as n from labelled group by all),
label as (select sheet, min_r, min_c, string_agg(name, ' ' order by idx) as names from named group by all),
shaped as (
  select g.*, h.header_row, coalesce(s.n_samples, 0) as n_samples, f.n, names,
    row_number() over (partition by g.sheet order by g.min_r, g.min_c) as region_no
  from regions g left join headers h using (sheet, min_r, min_c) left join sampled s using (sheet, min_r, min_c)
  join filled f using (sheet, min_r, min_c) join label using (sheet, min_r, min_c)),
kinds as (
  select *, case when regexp_matches(names, 'amount|debit|credit|transaction|vendor|invoice|date') then 'ledger'
      when max_r - min_r <= 6 and max_c - min_c <= 3 then 'parameters'
      when regexp_matches(names, 'total|summary|variance|month') then 'summary'
      when n_samples >= 1 and max_c > min_c then 'table' else 'unknown' end as region_kind,
    chr(64 + min_c) || min_r || ':' || chr(64 + max_c) || max_r as bounds from shaped)
select sheet, cast(region_no as bigint) as region_no, lower(sheet) || '_' || region_kind || '_' || region_no as table_name,
  lower(sheet) || '_r' || region_no as region_id, bounds, header_row, coalesce(header_row + 1, min_r) as data_start_row,
  max_r - coalesce(header_row, min_r) as row_count, cast(max_c - min_c + 1 as bigint) as column_count, region_kind,
  'tabular' as orientation,
  round(least(1.0, n / ((max_r - min_r + 1) * (max_c - min_c + 1)) * 0.8 + case when header_row is null then 0.0 else 0.2 end), 6) as confidence,
  cast(n_samples as bigint) as n_samples, 'lake#''' || sheet || '''!' || bounds as source_ref
from kinds"""


def sample_rows(spark, sf):
    st = lake(spark, sf, inputs.sparse_lines).structure
    rows = st.sample_rows.select(*REGION, F.explode("sample").alias("s")).select(
        "sheet", "min_r", "min_c", F.col("s.r").alias("r"), F.explode("s.cells").alias("x"))
    return _key(rows).select("sheet", "min_r", "min_c", "r", F.col("x.idx").cast(BIG).alias("idx"), F.col("x.value").alias("value"))


SAMPLE_ROWS = f"""with {SPARSE}
select l.sheet, l.min_r, cast(l.min_c as bigint) as min_c, l.r, cast(l.c - l.min_c + 1 as bigint) as idx,
  case when kind = 'date' then replace(txt, ' ', 'T') else txt end as value
from labelled l left join headers h using (sheet, min_r, min_c)
where l.r between coalesce(h.header_row + 1, l.min_r) and coalesce(h.header_row + 1, l.min_r) + 2"""

# -- names and addresses ----------------------------------------------------------------------------


def safe_identifiers(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    named = pages.select(
        F.lit("w").alias("workbook"), F.expr("cast(page_id div 100 as string)").alias("sheet"), F.lit(1).alias("min_r"), F.lit(1).alias("min_c"),
        "page_id", (F.col("page_id") % 100 + 1).alias("idx"), tx.safe_identifier(F.col("url"), "column").alias("base"))
    return dedupe_names(named, "base", "name").select("page_id", "base", "name")


SAFE_IDENTIFIERS = r"""
with b as (
  select page_id, page_id // 100 as g, page_id % 100 + 1 as idx,
    lower(regexp_replace(regexp_replace(trim(url), '[^\p{L}\p{Nd}\p{M}_]+', '_', 'g'), '^_+|_+$', '', 'g')) as b0 from pages),
c as (select *, case when b0 = '' then 'column' when regexp_matches(b0, '^\d') then 'c_' || b0 else b0 end as base from b),
n as (select *, row_number() over (partition by g, base order by idx) as k from c),
t as (select *, case when k = 1 then base else base || '_' || k end as tried from n)
select page_id, base, case when row_number() over (partition by g, tried order by k, idx) = 1 then tried
  else tried || '_c' || idx end as name from t
"""


def a1_addresses(spark, sf):
    line = table(spark, sf, "lineitem").select((F.col("l_orderkey") + 1).alias("r"), ((F.col("l_partkey") * 97 + F.col("l_suppkey")) % 16384 + 1).cast("int").alias("c"))
    named = line.withColumn("address", a1.cell_a1(F.col("r"), F.col("c")))
    row, col = a1.cell_ref(F.col("address"))
    back = (row == F.col("r")) & (col == F.col("c"))
    return named.select("r", F.col("c").cast(BIG).alias("c"), "address", back.alias("back"))


A1_ADDRESSES = """
with l as (select l_orderkey + 1 as r, (l_partkey * 97 + l_suppkey) % 16384 + 1 as c from lineitem)
select r, c, case when c <= 26 then chr(cast(64 + c as int))
    when c <= 702 then chr(cast(65 + (c - 27) // 26 as int)) || chr(cast(65 + (c - 27) % 26 as int))
    else chr(cast(65 + (c - 703) // 676 as int)) || chr(cast(65 + ((c - 703) // 26) % 26 as int)) || chr(cast(65 + (c - 703) % 26 as int)) end
  || cast(r as varchar) as address, true as back
from l
"""

# -- periods and matrices ---------------------------------------------------------------------------
MONTHS_GRID = """
sums as (select 'Y' || year(o_orderdate) as sheet, o_custkey + 3 as r, month(o_orderdate) + 1 as c, round(sum(o_totalprice), 2) as v
         from orders group by all),
cells as (
  select sheet, r, c, 'float' as kind, cast(v as varchar) as txt, v from sums
  union all select distinct sheet, r, 1, 'text', 'Customer ' || (r - 3), null from sums
  union all select s.sheet, 1, h.c, 'text', h.t, null from (select distinct sheet from sums) s,
    (values (1, 'Customer'), (2, 'Jan'), (3, 'Feb'), (4, 'Mar'), (5, 'Apr'), (6, 'May'), (7, 'Jun'), (8, 'Jul'),
            (9, 'Aug'), (10, 'Sep'), (11, 'Oct'), (12, 'Nov'), (13, 'Dec')) h(c, t)),
rowset as (select distinct sheet, r from cells),
rb as (select sheet, r, r - row_number() over (partition by sheet order by r) as g from rowset),
bands as (select sheet, g, min(r) as b0, max(r) as b1 from rb group by sheet, g),
rband as (select rb.sheet, rb.r, b0, b1 from rb join bands using (sheet, g)),
cc as (select distinct c.sheet, b0, b1, c.c from cells c join rband using (sheet, r)),
ci as (select *, c - row_number() over (partition by sheet, b0 order by c) as g from cc),
regions as (select sheet, b0 as min_r, b1 as max_r, min(c) as min_c, max(c) as max_c from ci group by sheet, b0, b1, g),
matrix as (
  select *, (max_c - greatest(min_c, 2) + 1 >= 3) and min_c = 1 as is_matrix from regions)
"""


def period_row(spark, sf):
    return lake(spark, sf, inputs.customer_months).structure.period_rows.select("sheet", "period_row")


PERIOD_ROW = """
with sums as (select distinct 'Y' || year(o_orderdate) as sheet from orders) select sheet, cast(1 as bigint) as period_row from sums
"""


def matrix_regions(spark, sf):
    st = lake(spark, sf, inputs.customer_months).structure
    return _key(st.shapes).select(
        "sheet", "min_r", "min_c", "max_r", F.col("max_c").cast(BIG).alias("max_c"), "orientation",
        F.when(F.col("is_matrix"), F.col("row_count")).alias("matrix_rows"))


MATRIX_REGIONS = f"""with {MONTHS_GRID}
select sheet, min_r, cast(min_c as bigint) as min_c, max_r, cast(max_c as bigint) as max_c,
  case when is_matrix then 'matrix' else 'tabular' end as orientation, case when is_matrix then max_r - min_r + 1 end as matrix_rows
from matrix"""


def matrix_columns(spark, sf):
    cols = lake(spark, sf, inputs.customer_months).structure.columns.where("is_matrix")
    return _key(cols).select("sheet", "min_r", "min_c", F.col("idx").cast(BIG).alias("idx"), "name")


MATRIX_COLUMNS = f"""with {MONTHS_GRID},
names as (select * from (values (1, 'line_item'), (2, 'jan'), (3, 'feb'), (4, 'mar'), (5, 'apr'), (6, 'may'), (7, 'jun'), (8, 'jul'),
            (9, 'aug'), (10, 'sep'), (11, 'oct'), (12, 'nov'), (13, 'dec')) h(idx, name))
select sheet, min_r, cast(min_c as bigint) as min_c, cast(idx as bigint) as idx, name
from matrix join names on idx <= max_c where is_matrix"""


def period_hits(spark, sf):
    """R12 over whole texts: words that start with a period token, per document language."""
    words = table(spark, sf, "documents").select("lang", F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''")
    from gridloom.operators.structure import is_period

    return words.groupBy("lang").agg(F.count(F.lit(1)).alias("words"), F.count_if(is_period(F.col("word"))).alias("hits"))


PERIOD_HITS = r"""
with w as (select lang, unnest(regexp_split_to_array(text, '\s+')) as word from documents)
select lang, count(*) as words,
  count(*) filter (where regexp_matches(lower(word), '^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|q1|q2|q3|q4|year|month|week|fy)')) as hits
from w where word <> '' group by lang
"""

# -- profiles of the four sheets --------------------------------------------------------------------
_FOUR = """
four(sheet, idx, n, cols, min_c, last_col, kind) as (
  select 'Orders', 0, (select count(*) from orders), 6, 1, 'F', 'ledger' union all
  select 'Customer', 1, (select count(*) from customer), 5, 1, 'E', 'table' union all
  select 'Supplier', 2, (select count(*) from supplier), 4, 1, 'D', 'table' union all
  select 'Nation', 3, (select count(*) from nation), 3, 1, 'C', 'table')
"""


def sheet_profile(spark, sf):
    return lake(spark, sf, inputs.four_sheets).profile.select(
        "sheet", F.col("sheet_idx").cast(BIG).alias("sheet_idx"), "bounds", "hidden", "formula_count", "region_count", "source_ref",
        "merged_ranges_count")


SHEET_PROFILE = f"""with {_FOUR}
select sheet, cast(idx as bigint) as sheet_idx, 'A1:' || last_col || (n + 1) as bounds, false as hidden, cast(0 as bigint) as formula_count,
  cast(1 as bigint) as region_count, 'lake#''' || sheet || '''!A1:' || last_col || (n + 1) as source_ref, cast(0 as bigint) as merged_ranges_count
from four"""


def sheet_list(spark, sf):
    return lake(spark, sf, inputs.four_sheets).sheets().select("sheet", "bounds", "hidden", "formula_count", "region_count")


SHEET_LIST = f"""with {_FOUR}
select sheet, 'A1:' || last_col || (n + 1) as bounds, false as hidden, cast(0 as bigint) as formula_count, cast(1 as bigint) as region_count from four"""


def table_list(spark, sf):
    return lake(spark, sf, inputs.four_sheets).tables().select(
        "sheet", "table_name", "bounds", "kind", "orientation", "rows", F.array_join("columns", ",").alias("columns"),
        F.size("derived_columns").cast(BIG).alias("n_derived"))


TABLE_LIST = f"""with {_FOUR},
texts(sheet, name, hits, n) as (
  select 'Orders', 'o_orderstatus', count(*) filter (where regexp_matches(o_orderstatus, '[0-9]')), count(*) from orders union all
  select 'Orders', 'o_orderpriority', count(*) filter (where regexp_matches(o_orderpriority, '[0-9]')), count(*) from orders union all
  select 'Orders', 'o_orderdate', count(o_orderdate), count(*) from orders union all
  select 'Customer', 'c_name', count(*) filter (where regexp_matches(c_name, '[0-9]')), count(*) from customer union all
  select 'Customer', 'c_mktsegment', count(*) filter (where regexp_matches(c_mktsegment, '[0-9]')), count(*) from customer union all
  select 'Supplier', 's_name', count(*) filter (where regexp_matches(s_name, '[0-9]')), count(*) from supplier union all
  select 'Nation', 'n_name', count(*) filter (where regexp_matches(n_name, '[0-9]')), count(*) from nation),
like_text as (select sheet, count(*) filter (where hits >= greatest(2, n // 2)) as k from texts group by sheet)
select f.sheet, lower(f.sheet) || '_' || kind || '_1' as table_name, 'A1:' || last_col || (n + 1) as bounds, kind, 'tabular' as orientation,
  cast(n as bigint) as rows,
  case f.sheet when 'Orders' then 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority'
    when 'Customer' then 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' when 'Supplier' then 's_suppkey,s_name,s_nationkey,s_acctbal'
    else 'n_nationkey,n_name,n_regionkey' end as columns,
  cast(4 * (k + case f.sheet when 'Orders' then 3 when 'Customer' then 3 when 'Supplier' then 3 else 2 end) as bigint) as n_derived
from four f join like_text using (sheet)"""


def best_source(spark, sf):
    return lake(spark, sf, inputs.four_sheets).best_source().select("sheet", "rank", "reason", F.round("score", 3).alias("score"))


BEST_SOURCE = f"""with {_FOUR},
scored as (select sheet, idx, kind, case kind when 'table' then 61.0 else 41.0 end as score from four),
ranked as (select *, row_number() over (order by score desc, idx) as k from scored)
select sheet, cast(k as bigint) as rank, kind || ' region (conf 1.00)' as reason, cast(score as double) as score from ranked where k <= 3"""


def best_region_kinds(spark, sf):
    """R23 over every sparse region: weight of its kind plus confidence, best region per sheet."""
    st = lake(spark, sf, inputs.sparse_lines)
    ranked = profile.best_source(st.structure.bounds, st.regions)
    return ranked.select("sheet", F.split("reason", " ")[0].alias("kind"))


BEST_REGION_KINDS = f"""with shapes as ({REGION_SHAPES})
select sheet, max_by(region_kind, case region_kind when 'summary' then 100 when 'table' then 60 when 'ledger' then 40 when 'parameters' then 20 else 0 end) as kind
from shapes group by sheet"""

QUERIES = {
    "grid_melt": grid_melt, "row_bands": row_bands, "regions_sparse": regions_sparse, "header_scores": header_scores,
    "header_row": header_row, "region_columns": region_columns, "region_shapes": region_shapes, "sample_rows": sample_rows,
    "safe_identifiers": safe_identifiers, "a1_addresses": a1_addresses, "period_row": period_row, "period_hits": period_hits,
    "matrix_regions": matrix_regions, "matrix_columns": matrix_columns, "sheet_profile": sheet_profile, "sheet_list": sheet_list,
    "table_list": table_list, "best_source": best_source, "best_region_kinds": best_region_kinds,
}
ORACLES = {
    "grid_melt": GRID_MELT, "row_bands": ROW_BANDS, "regions_sparse": REGIONS_SPARSE, "header_scores": HEADER_SCORES,
    "header_row": HEADER_ROW, "region_columns": REGION_COLUMNS, "region_shapes": REGION_SHAPES, "sample_rows": SAMPLE_ROWS,
    "safe_identifiers": SAFE_IDENTIFIERS, "a1_addresses": A1_ADDRESSES, "period_row": PERIOD_ROW, "period_hits": PERIOD_HITS,
    "matrix_regions": MATRIX_REGIONS, "matrix_columns": MATRIX_COLUMNS, "sheet_profile": SHEET_PROFILE, "sheet_list": SHEET_LIST,
    "table_list": TABLE_LIST, "best_source": BEST_SOURCE, "best_region_kinds": BEST_REGION_KINDS,
}
