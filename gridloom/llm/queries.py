"""Registered queries of the training-data operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.llm.common import documents, table


def op1_exact_dedup(spark, sf):
    from gridloom.llm.exact_dedup import exact_duplicates

    return exact_duplicates(documents(spark, sf))


OP1_SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""


def op2_suffix_dedup(spark, sf):
    from gridloom.llm.suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf))


def op3_token_output(spark, sf):
    from gridloom.llm.token_output import packed_matrices

    return packed_matrices(documents(spark, sf))


def op4_html_text(spark, sf):
    from gridloom.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf, "pages"))


def op5_pack(spark, sf):
    from gridloom.llm.packing import pack

    return pack(documents(spark, sf))


def op6_quality_rules(spark, sf):
    from gridloom.llm.quality import quality

    return quality(documents(spark, sf)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_mix_sources(spark, sf):
    from gridloom.llm.mixing import mix

    return mix(documents(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size, md5('mix-1:' || doc_id) as draw from documents),
placed as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1.0::double as w from sized group by source),
filled as (
  select *, source_size * 3.0::double as cap, sum(source_size) over ()::double as total,
    coalesce(sum(source_size * 3.0::double) over (order by source_size * 3.0::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
    sum(w) over (order by source_size * 3.0::double / w, source nulls last rows between current row and unbounded following) as rest_w from placed),
levels as (select min_by((total - before) / rest_w, cap / w) as level from filled where (total - before) / rest_w * w <= cap),
targets as (
  select source, source_size, least(cap, coalesce(level * w, cap)) as target,
    case when source_size > 0 then floor(least(cap, coalesce(level * w, cap)) / source_size)::bigint else 0 end as whole from filled, levels),
run as (
  select s.doc_id, s.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size as rest,
    sum(s.size) over (partition by s.source order by s.draw, s.doc_id rows between unbounded preceding and current row) as upto
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
  cast(size * (whole + case when upto <= rest or (upto - size < rest and (upto - rest) * 2 < size) then 1 else 0 end) as bigint) as taken from run
"""


def op8_line_dedup(spark, sf):
    """Lines per document, lines dropped as instances of recurring templates, and a digest of what is left."""
    from gridloom.llm.line_dedup import drop_recurring_lines

    return drop_recurring_lines(documents(spark, sf), report=True).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP8_SQL = r"""
with l as (
  select doc_id, generate_subscripts(lines, 1) as line_no, unnest(lines) as line from (
    select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents)),
p as (
  select doc_id, line_no, line, case when strlen(line) > 2 * length(line)
    then regexp_extract_all(regexp_replace(line, '[0-9]+', '<*>', 'g'), '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]|[^\x20\x09-\x0D\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]+')
    else regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') end as t from l),
c as (select doc_id, line_no, line, t, len(t) as k, least(len(t) - 3, 8) as m from p where len(t) > 0 and doc_id is not null),
b as (select k, m, t, min(doc_id) as first from c where k > 3 group by all),
parted as (
  select *, list_transform(range(0, m), lambda g: t[cast(floor(g * (k - 3) / m) as int) + 4 : cast(floor((g + 1) * (k - 3) / m) as int) + 3]) as parts from b),
masks as (
  select 8 as m, x, y from range(1, 9) r(x), range(1, 9) s(y) where x < y
  union all select q.m, x, x from range(4, 8) q(m), range(1, 8) r(x) where x <= q.m),
forms as (
  select k, t, first, t[1:3] as head, x, y, parts[1:x - 1] as p1, parts[x + 1:y - 1] as p2, parts[y + 1:] as p3 from parted join masks using (m)),
templates as (select k, head, x, y, p1, p2, p3, min(first) as since from forms group by all),
earlier as (
  select f.k, f.t, min(e.since) as since from forms f join templates e
  on e.k = f.k and e.head = f.head and e.x = f.x and e.y = f.y and e.p1 = f.p1 and e.p2 = f.p2 and e.p3 = f.p3 group by f.k, f.t),
lim as (select b.t, least(b.first, coalesce(e.since, b.first)) as since from b left join earlier e on e.t = b.t),
short as (select line, min(doc_id) as since from c where k <= 3 group by line),
gone as (
  select c.doc_id, c.line_no from c join lim on c.t = lim.t where c.k > 3 and c.doc_id > lim.since
  union all select c.doc_id, c.line_no from c join short on c.line = short.line where c.k <= 3 and c.doc_id > short.since)
select l.doc_id, count(*) as n_lines, count(g.line_no) as n_dropped,
  sha256(coalesce(array_to_string(list(l.line order by l.line_no) filter (where g.line_no is null), chr(10)), '')) as text_sha256
from l left join gone g on g.doc_id = l.doc_id and g.line_no = l.line_no group by l.doc_id
"""


def op9_simhash(spark, sf):
    from gridloom.llm.simhash import near_duplicate_components

    return near_duplicate_components(documents(spark, sf))


def op10_language_id(spark, sf):
    from gridloom.llm.language import identify

    return identify(documents(spark, sf))


def op11_spelling_variants(spark, sf):
    from gridloom.llm.spelling import spelling_variants

    return spelling_variants(documents(spark, sf))


def op12_harmonic_pack(spark, sf):
    from gridloom.llm.harmonic import pack_harmonic

    return pack_harmonic(documents(spark, sf))


def op13_align_tokenizers(spark, sf):
    from gridloom.llm.alignment import align_tokenizers

    return align_tokenizers(documents(spark, sf))


QUERIES = {q.__name__: q for q in (
    op1_exact_dedup, op2_suffix_dedup, op3_token_output, op4_html_text, op5_pack, op6_quality_rules, op7_mix_sources, op8_line_dedup, op9_simhash,
    op10_language_id, op11_spelling_variants, op12_harmonic_pack, op13_align_tokenizers)}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op7_mix_sources": OP7_SQL, "op8_line_dedup": OP8_SQL}
