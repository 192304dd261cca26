"""Queries of the general data operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, profile, proximity, spikes
from ..session import clean, read
from ..sources import formats


def _mm(name: str) -> Column:
    return F.round(clean(name) * 1000.0)


def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, spec = F.col, profile.ColumnSpec
    header = [
        spec("max_x", _mm("max_x"), _mm("max_x") < _mm("min_x"), c("max_x")),
        spec("min_z", _mm("min_z"), _mm("min_z") > _mm("max_z"), c("min_z")),
        spec("number_of_point_records", c("number_of_point_records"), c("number_of_point_records") < 1, c("number_of_point_records")),
    ]
    points = [spec("classification", c("classification"), ~c("classification").between(0, 255), c("classification"))]
    return profile.union_counts([profile.value_counts(read(spark, sf_dir, "header"), header), profile.value_counts(read(spark, sf_dir, "lasdata"), points)])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.issues(profile.profile(profile_counts(spark, sf_dir))).where("issue <> 'pattern'")


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(profile_counts(spark, sf_dir))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile without expressions, which SQL can state."""
    return profile.profile(profile_counts(spark, sf_dir), patterns=False)


def p2_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.induce_expressions(profile_counts(spark, sf_dir)).groupBy("column_name", "regex").agg(F.count(F.lit(1)).alias("shapes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.found(read(spark, sf_dir, "lasdata"), read(spark, sf_dir, "polygons"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.found(read(spark, sf_dir, "lasdata"))


def p4_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds that can be stated in SQL: readings beyond physical limits and stuck runs."""
    return spikes.readings(read(spark, sf_dir, "lasdata")).where("kind <> 'spike'")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.found(read(spark, sf_dir, "header"), read(spark, sf_dir, "vlr"), read(spark, sf_dir, "lasdata"))


def p6_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unified_points(read(spark, sf_dir, "lasdata"), read(spark, sf_dir, "vlr"), read(spark, sf_dir, "header"))


def p6_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the one table can be stated in SQL: each point once, scan angles in one unit, fields of the versions."""
    names = [n for group in drift.VERSION_FIELDS.values() for n in group]
    return p6_unified(spark, sf_dir).select("point_id", "file_id", "point_index", "load_id", "intensity", "scan_angle", *names[:4])


def p6_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.lifespans(read(spark, sf_dir, "header"), read(spark, sf_dir, "vlr"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_profile, p2_shares, p2_expressions, p3_found, p4_found, p4_plain, p6_found, p6_unified, p6_points, p6_lifespans)}


_P2_SQL = """
with cells as (
  select load_id, 'max_x' as column_name, case when isnan(max_x) then null else round(max_x*1000) end as v,
         coalesce(round(max_x*1000) < case when isnan(min_x) then null else round(min_x*1000) end, false) as bad from header
  union all select load_id, 'min_z', case when isnan(min_z) then null else round(min_z*1000) end,
         coalesce(round(min_z*1000) > case when isnan(max_z) then null else round(max_z*1000) end, false) from header
  union all select load_id, 'number_of_point_records', cast(number_of_point_records as double), coalesce(number_of_point_records < 1, false) from header
  union all select load_id, 'classification', cast(classification as double), coalesce(classification not between 0 and 255, false) from lasdata),
c as (select load_id, column_name, v, sum(case when bad and v is not null then 1 else 0 end) as bad, count(*) as n from cells group by all),
l as (select load_id, column_name, sum(n) as rows, sum(n) filter (v is null) as nulls, sum(bad) as bad, max(n) filter (v is not null) as mode, count(v) as distinct_values, min(v) as min_value, max(v) as max_value from c group by all),
l2 as (select load_id, column_name, distinct_values, min_value, max_value, rows, coalesce(nulls,0) as nulls, bad, mode, rows - coalesce(nulls,0) as nn from l),
t as (select column_name, sum(rows) as rows, sum(nulls) as nulls, sum(bad) as bad, sum(nn) as nn from l2 group by all),
tv as (select column_name, v, sum(n) as t from c where v is not null group by all),
g as (select a.load_id, a.column_name, tv.v, tv.t, coalesce(c.n,0) as n from l2 a join tv using (column_name) left join c on c.load_id=a.load_id and c.column_name=a.column_name and c.v=tv.v),
cum as (select load_id, column_name, t - n as o, sum(n) over w as cl, sum(t) over w as ct from g window w as (partition by load_id, column_name order by v)),
s as (select l2.load_id, l2.column_name, max(cum.o) as omode, max(abs(cl / nullif(l2.nn,0) - (ct-cl) / nullif(t.nn-l2.nn,0))) as gap
      from l2 join t using (column_name) join cum on cum.load_id=l2.load_id and cum.column_name=l2.column_name group by all),
f as (select l2.*, t.rows - l2.rows as orows, t.nulls - l2.nulls as onulls, t.bad - l2.bad as obad, t.nn - l2.nn as onn, s.omode, s.gap
      from l2 join t using (column_name) left join s on s.load_id=l2.load_id and s.column_name=l2.column_name where l2.load_id is not null)
"""
P2_SQL = _P2_SQL + """
select load_id, column_name, 'nulls' as issue from f where nulls/rows - onulls/nullif(orows,0) > 0.05
union all select load_id, column_name, 'range' from f where bad/nullif(nn,0) - obad/nullif(onn,0) > 0.02
union all select load_id, column_name, 'repeat' from f where mode/nullif(nn,0) - omode/nullif(onn,0) > 0.16
union all select load_id, column_name, 'shift' from f where gap > 0.42
"""

P2_SHARES_SQL = _P2_SQL + """
select load_id, column_name, rows, distinct_values, min_value, max_value, nulls/rows as null_share, onulls/nullif(orows,0) as others_null_share, bad/nullif(nn,0) as invalid_share, obad/nullif(onn,0) as others_invalid_share,
  mode/nullif(nn,0) as mode_share, omode/nullif(onn,0) as others_mode_share, gap from f
"""

P3_SQL = """
with p as (select point_id as id, cast(round(any_value(x)*1000) as bigint) as x, cast(round(any_value(y)*1000) as bigint) as y
           from lasdata where point_id is not null and not isnan(x) and not isnan(y) and abs(x) < 1e12 and abs(y) < 1e12 group by point_id),
cells as (select *, x // 1000 as cx, y // 1000 as cy from p),
wide as (select id, x, y, cx + dx.d as cx, cy + dy.d as cy from cells, (values (-1),(0),(1)) dx(d), (values (-1),(0),(1)) dy(d)),
near as (select a.id as id_a, b.id as id_b from cells a join wide b on a.cx=b.cx and a.cy=b.cy and a.id < b.id
         and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 90300),
v as (select distinct poly_id, seq, x, y from polygons),
ok as (select poly_id from v group by 1 having count(*) >= 3 and count(x) = count(*) and count(y) = count(*) and not bool_or(isnan(x) or isnan(y))),
r as (select poly_id, seq, round(x*1000) as x, round(y*1000) as y from v join ok using (poly_id)),
e as (select poly_id, x as x1, y as y1, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2
      from r window w as (partition by poly_id order by seq rows between unbounded preceding and unbounded following)),
box as (select poly_id, min(x1) as x0, max(x1) as x9, min(y1) as y0, max(y1) as y9 from e group by 1),
cand as (select poly_id, id, p.x, p.y from p join box on p.x between x0 and x9 and p.y between y0 and y9),
wind as (select c.poly_id, c.id, sum(case
           when y1 <= c.y and y2 > c.y and (x2-x1)*(c.y-y1) - (c.x-x1)*(y2-y1) > 0 then 1
           when y1 > c.y and y2 <= c.y and (x2-x1)*(c.y-y1) - (c.x-x1)*(y2-y1) < 0 then -1 else 0 end) as w
         from cand c join e using (poly_id) group by 1, 2)
select 'near' as kind, id_a, id_b from near
union all select 'region', poly_id, id from wind where w <> 0
"""


_FORMAT_ROWS = ", ".join(f"({k}, '{n}', '{t}')" for k in formats.SUPPORTED for n, t in formats.fields_of(k))
_VERSION_ROWS = ", ".join(f"({m}, '{n}')" for m, names in drift.VERSION_FIELDS.items() for n in names)
_TYPE_ROWS = ", ".join(f"({k}, '{n}', {size})" for k, (n, size) in formats.EXTRA_TYPES.items())
_FIELDS_SQL = f"""
with h as (select distinct file_id, project_id_guid1 as s, coalesce(file_creation_year, 0) as y, coalesce(file_creation_day_of_year, 0) as d, point_data_format as pdrf, version_minor as minor
           from header where point_data_format between 0 and 10 and version_minor between 0 and 4),
f as (select *, row_number() over (partition by s order by y, d, file_id) as ord from h),
b as (select * from (values {_FORMAT_ROWS}) t(pdrf, name, type)),
v as (select * from (values {_VERSION_ROWS}) t(minor, name)),
k as (select * from (values {_TYPE_ROWS}) t(code, type, size)),
r as (select file_id, is_extended, idx, u.i, substr(hex(data), u.i * 384 + 1, 384) as x
      from (select * from vlr where user_id = 'LASF_Spec' and record_id = 4 and octet_length(data) >= 192) a, lateral (select unnest(range(octet_length(a.data) // 192)) as i) u),
t as (select file_id, is_extended, idx, i, lower(trim(split_part(decode(unhex(substr(x, 9, 64))), chr(0), 1))) as name, lower(trim(split_part(decode(unhex(substr(x, 321, 64))), chr(0), 1))) as description,
             cast('0x' || substr(x, 5, 2) as integer) as code, cast('0x' || substr(x, 7, 2) as integer) as options from r),
e as (select file_id, regexp_replace(t.name, '[^a-z0-9_]', '_', 'g') as name, case when code = 0 then 'bytes[' || options || ']' else k.type end as type, description, case when code = 0 then options else k.size end as size
      from t left join k using (code) qualify row_number() over (partition by file_id, regexp_replace(t.name, '[^a-z0-9_]', '_', 'g') order by is_extended, idx, i) = 1),
a as (select s, ord, file_id, b.name, b.type, '' as description from f join b using (pdrf)
      union all select s, ord, file_id, v.name, 'header', '' from f join v on f.minor >= v.minor
      union all select s, ord, f.file_id, e.name, e.type, e.description from f join e using (file_id))
"""
P6_SQL = f"""{_FIELDS_SQL},
new as (select c.*, row_number() over (partition by c.s, c.ord, c.description order by c.name) as n from a c left join a p on p.s is not distinct from c.s and p.ord = c.ord - 1 and p.name = c.name where c.ord > 1 and p.name is null),
gone as (select p.s, p.ord + 1 as ord, q.file_id, p.name, p.type, p.description, row_number() over (partition by p.s, p.ord, p.description order by p.name) as n
         from a p join f q on q.s is not distinct from p.s and q.ord = p.ord + 1 left join a c on c.s is not distinct from p.s and c.ord = p.ord + 1 and c.name = p.name where c.name is null),
m as (select n.file_id, n.name, n.type, g.name as old_name, g.type as old_type from new n join gone g on n.file_id = g.file_id and n.description = g.description and n.n = g.n where n.description <> '')
select c.file_id, c.name as field, 'retyped' as change_kind from a c join a p on p.s is not distinct from c.s and p.ord = c.ord - 1 and p.name = c.name and p.type <> c.type
union all select file_id, name, 'renamed' from m union all select file_id, name, 'retyped' from m where type <> old_type
union all select file_id, name, 'added' from new where not exists (select 1 from m where m.file_id = new.file_id and m.name = new.name)
union all select file_id, name, 'removed' from gone where not exists (select 1 from m where m.file_id = gone.file_id and m.old_name = gone.name)
union all select p.file_id, 'extradata', 'mismatch' from (select file_id, min(coalesce(octet_length(extradata), 0)) as low, max(coalesce(octet_length(extradata), 0)) as high from lasdata group by 1) p
  join f using (file_id) left join (select file_id, sum(size) as size from e group by 1) z using (file_id) where low <> coalesce(z.size, 0) or high <> coalesce(z.size, 0)
"""


_LIMITS = ", ".join(f"('{f.name}', {f.low!r}, {f.high!r}, {f.longest})" for f in spikes.FIELDS)
P4_PLAIN_SQL = f"""
with p as (select point_id, file_id, point_source_id, any_value(point_index) as i, any_value(z) as z, any_value(intensity) as intensity, any_value(gps_time) as gps_time
           from lasdata where point_id is not null and file_id is not null and point_source_id is not null and point_index is not null group by all),
r as (select point_id, file_id, point_source_id, i, 'z' as field, z as v from p union all select point_id, file_id, point_source_id, i, 'intensity', cast(intensity as double) from p
      union all select point_id, file_id, point_source_id, i, 'gps_time', gps_time from p),
o as (select *, row_number() over w - row_number() over (partition by file_id, point_source_id, field, v order by i, point_id) as run from r where v is not null and not isnan(v)
      window w as (partition by file_id, point_source_id, field order by i, point_id)),
n as (select *, count(*) over (partition by file_id, point_source_id, field, v, run) as length from o)
select point_id, field, case when v < low or v > high then 'limit' else 'stuck' end as kind from n join (values {_LIMITS}) t(field, low, high, longest) using (field) where v < low or v > high or length > longest
"""

P6_POINTS_SQL = """
with h as (select file_id, point_data_format as pdrf, version_minor as minor, start_of_waveform_data as w, start_of_extended_variable_length_record as e, number_of_extended_variable_length_record as n, legacy_number_of_point_records as l
           from header where file_id is not null qualify row_number() over (partition by file_id order by coalesce(load_id, 2147483647), received_at nulls first) = 1),
f as (select * from h where pdrf between 0 and 10 and minor between 0 and 4),
p as (select * from lasdata where point_id is not null qualify row_number() over (partition by point_id order by load_id nulls last) = 1 union all select * from lasdata where point_id is null)
select p.point_id, p.file_id, p.point_index, p.load_id, p.intensity,
  case when coalesce(f.pdrf, case when p.bits2 is not null then 6 else 0 end) >= 6 then cast(p.scan_angle as double) * 6e-3 else cast(p.scan_angle as double) end as scan_angle,
  case when f.minor >= 3 then w end as start_of_waveform_data, case when f.minor >= 4 then e end as start_of_extended_variable_length_record,
  case when f.minor >= 4 then n end as number_of_extended_variable_length_record, case when f.minor >= 4 then l end as legacy_number_of_point_records
from p left join f using (file_id)
"""

P6_LIFESPANS_SQL = f"""{_FIELDS_SQL},
runs as (select *, ord - row_number() over (partition by s, name, type order by ord) as island from a)
select s as series, name as field, type, min(ord) as first_ord, max(ord) as last_ord, min_by(file_id, ord) as first_file, max_by(file_id, ord) as last_file, count(*) as files from runs group by s, name, type, island
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p2_shares": P2_SHARES_SQL, "p3_found": P3_SQL, "p4_plain": P4_PLAIN_SQL, "p6_found": P6_SQL, "p6_points": P6_POINTS_SQL, "p6_lifespans": P6_LIFESPANS_SQL}
