"""A messy case list and a gazetteer derived from the order tables.

Used by the registered queries, the benchmark and the tests.  The same SQL text
serves Spark and the checking database; only the few functions that differ are
filled in per dialect.  Both tables grow with the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casewell.settings import limit_method_size

SOURCES = ("orders", "lineitem", "customer", "supplier", "part", "nation", "region")

_FIRST = ("Amina", "Ibrahim", "Zainab", "Moussa", "Fatima", "Ousmane", "Aisha", "Cheikh",
          "Mariam", "Yusuf", "Halima", "Abdou")
_LAST = ("Diallo", "Kyari", "Gana", "Goni", "Traore", "Ndiaye", "Shettima", "Bukar", "Kambale", "Paluku")
_SYL = ("ba", "ko", "ri", "ma", "tu", "le", "sa", "no", "di", "ga", "wu", "fe", "ya", "mo", "zi",
        "ke", "la", "ru", "po", "shi")
_NOUN = ("Camp", "Town", "Market", "Bridge", "Hill")
_MOIS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre",
         "octobre", "novembre", "décembre")


class Dialect:
    """The handful of functions whose spelling differs between the two engines."""

    def __init__(self, spark: bool):
        self.spark = spark

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def fmt(self, d: str, spark: str, duck: str) -> str:
        return f"date_format({d}, '{spark}')" if self.spark else f"strftime({d}, '{duck}')"

    def days(self, a: str, b: str) -> str:
        return f"datediff({a}, {b})" if self.spark else f"datediff('day', {b}, {a})"

    def text(self, x: str) -> str:
        return f"cast({x} as {'string' if self.spark else 'varchar'})"

    def pad(self, x: str, n: int) -> str:
        return f"lpad({self.text(x)}, {n}, '0')"

    def table(self, name: str) -> str:
        return f"{{{name}}}" if self.spark else name

    def pick(self, index: str, values) -> str:
        """The value at a zero-based position of a fixed list."""
        items = ", ".join("null" if v is None else f"'{v}'" for v in values)
        if self.spark:
            return f"element_at(array({items}), cast({index} as int) + 1)"
        return f"list_extract([{items}], cast({index} as int) + 1)"


def _cat(*parts: str) -> str:
    return "(" + " || ".join(parts) + ")"


def _locality_base(s: str, q: Dialect) -> str:
    cap = [x.capitalize() for x in _SYL]
    return _cat(q.pick(f"{s} % 20", cap), q.pick(f"{q.div(s, 20)} % 20", _SYL),
                q.pick(f"{q.div(s, 7)} % 20", _SYL), "' '", q.pick(f"{s} % 5", _NOUN))


def gazetteer_sql(spark: bool) -> str:
    """One row per supplier: a health post with its three administrative levels."""
    q = Dialect(spark)
    s = "s.s_suppkey"
    return f"""
    select ref_row, admin1_name, admin1_pcode, admin2_name, admin1_pcode || n3 as admin2_pcode,
           admin3_name, admin1_pcode || n3 || s2 as admin3_pcode,
           locality_name, admin1_pcode || n3 || s2 || s6 as locality_pcode, latitude, longitude
    from (
      select cast({s} as bigint) as ref_row,
             r.r_name as admin1_name, 'R' || {q.pad('r.r_regionkey', 2)} as admin1_pcode,
             replace(n.n_name, '_', ' ') as admin2_name, {q.pad('n.n_nationkey', 3)} as n3,
             replace(n.n_name, '_', ' ') || {q.pick(f'{s} % 2', (' North', ' South'))} as admin3_name,
             {q.pad(f'{s} % 2 + 1', 2)} as s2, {_locality_base(s, q)} as locality_name, {q.pad(s, 6)} as s6,
             cast((({s} * 37) % 1700) as double) / 10.0 - 85.0 as latitude,
             cast((({s} * 91) % 3500) as double) / 10.0 - 175.0 as longitude
      from {q.table('supplier')} s
      join {q.table('nation')} n on s.s_nationkey = n.n_nationkey
      join {q.table('region')} r on n.n_regionkey = r.r_regionkey
    ) g"""


def cases_sql(spark: bool) -> str:
    """One row per order, plus exact copies of some rows."""
    q = Dialect(spark)
    first, last = q.pick("q % 12", _FIRST), q.pick(f"{q.div('q', 12)} % 10", _LAST)
    num = "(q * 7) % 90"
    iso = lambda d: q.fmt(d, "yyyy-MM-dd", "%Y-%m-%d")
    onset = f"""case k % 8
        when 0 then {iso('d')}
        when 1 then {q.fmt('d', 'dd/MM/yyyy', '%d/%m/%Y')}
        when 2 then {q.fmt('d', 'dd-MM-yyyy', '%d-%m-%Y')}
        when 3 then {_cat(q.text('day(d)'), "' '", q.pick('month(d) - 1', _MOIS), "' '", q.text('year(d)'))}
        when 4 then {q.text(q.days('d', "date '1899-12-30'"))}
        when 5 then {q.fmt('d', 'yyyyMMdd', '%Y%m%d')}
        when 6 then {q.fmt('d', 'dd-MMM-yyyy', '%d-%b-%Y')}
        else 'NA' end"""
    columns = f"""
      cast(k as bigint) as row_id,
      case when k % 101 = 0 then null when k % 97 = 1 then 'C-' || {q.text('k - 1')}
           else 'C-' || {q.text('k')} end as case_id,
      case k % 5 when 0 then name when 1 then upper(name) when 2 then last || ' ' || first
           when 3 then name || ' Jr' else '  ' || name || ' ' end as full_name,
      case when q % 2 = 0 then {q.pick('k % 6', ('F', 'f', 'Femme', 'Female', '2', 'NA'))}
           else {q.pick('k % 6', ('M', 'm', 'Homme', 'Male', '1', 'inconnu'))} end as sex,
      case when k % 131 = 0 then '-5' when k % 137 = 0 then '145'
           else case k % 7 when 0 then {q.text(num)} || ' ans' when 1 then {q.text(num)} || ' mois'
                when 2 then {q.text(num)} || 'd' when 3 then {q.text(num)}
                when 4 then {q.text(num)} || ' yo' when 5 then '-99'
                else {q.text(num)} || ',5 ans' end end as age,
      case when k % 7 = 3 and k % 2 = 0
           then {q.pick(f"{q.div('k', 2)} % 4", ('mois', 'semaines', 'jours', 'ans'))} end as age_unit,
      {iso(f"case when k % 53 = 0 then d + 10 else d - cast(365 * ({num}) as int) end")} as date_birth,
      {onset} as date_onset,
      {q.fmt('d', 'MM/dd/yyyy', '%m/%d/%Y')} as date_report,
      {iso("case when k % 17 = 0 then d - 6 else d + cast(k % 5 as int) end")} as date_consultation,
      {iso('adm')} as date_admission,
      {iso("case when k % 4 = 0 then null when k % 23 = 0 then adm - 2 else adm + cast(k % 15 as int) end")}
        as date_discharge,
      {iso('d + 1')} as date_sample_collected,
      {iso("case when k % 37 = 0 then d - 1 else d + 1 + cast(k % 4 as int) end")} as date_lab_result,
      {q.pick('k % 12', ('DCD', 'Mort', 'Guéri', 'gueri', 'Sortie', 'Discharged', 'LAMA', 'Evade', 'Transfere',
                        'Vivant', 'Survivor', 'En cours'))} as outcome,
      {iso("case when k % 71 = 0 then d - 3 when (k % 12 < 2 and k % 5 <> 0) or k % 61 = 0 "
           "then d + cast(k % 20 as int) end")} as date_death,
      {q.pick('k % 8', ('Confirme', 'PCR+', 'Prob', 'Epidemiologiquement lie', 'SUSP', 'Non-cas', 'unknown', 'NA'))}
        as case_definition,
      {q.pick('k % 8', ('Oui', '1', 'No', '0', 'O', 'N', '+', '-'))} as hospitalized,
      case when k % 9 = 0 then 'Oui' else 'Non' end as pregnant,
      case k % 6 when 0 then '0' || tel when 1 then '00221' || tel
           when 2 then '+221 ' || tel when 3 then tel
           when 4 then '12-34' else 'NA' end as phone,
      case when k % 19 = 0 then '11°30''00" S' when k % 13 = 0 then replace(lat0, '.', ',')
           when k % 11 = 0 then lon0 else lat0 end as lat,
      case when k % 11 = 0 and k % 13 <> 0 and k % 19 <> 0 then lat0 else lon0 end as lon,
      case k % 4 when 0 then p_name when 1 then upper(p_name) when 2 then substr(p_name, 1, 2) || substr(p_name, 4)
           else ' ' || replace(p_name, ' ', '  ') end as health_facility,
      r_name as admin1,
      case when k % 29 = 0 then replace(nat, 'NATION', 'NATON') when k % 3 = 0 then nat || ' LGA'
           when k % 3 = 1 then 'district ' || nat else nat end as admin2,
      case when sk is not null then nat || {q.pick('sk % 2', (' North', ' South'))} end as admin3,
      case k % 6 when 2 then upper(place) when 3 then substr(place, 1, 1) || substr(place, 3)
           when 4 then null when 5 then case when k % 4 = 1 then 'Unknown bush' else place || ' idp' end
           else place end as locality"""
    return f"""
    with shipped as (
      select l_orderkey, cast(min(l_shipdate) as date) as fs, min(l_suppkey) as sk, min(l_partkey) as pk
      from {q.table('lineitem')} group by l_orderkey
    ), base as (
      select {"/*+ MERGE(l) */" if spark else ""} o.o_orderkey as k, o.o_custkey as q, cast(o.o_orderdate as date) as d, l.sk as sk, p.p_name as p_name,
             case when o.o_orderkey % 3 = 0 then null when o.o_orderkey % 5 = 0 then l.fs
                  else cast(o.o_orderdate as date) + cast(o.o_orderkey % 9 as int) end as adm,
             {q.text("cast(((o.o_custkey * 37) % 1700) as double) / 10.0 - 85.0")} as lat0,
             {q.text("cast(((o.o_custkey * 91) % 3500) as double) / 10.0 - 175.0")} as lon0,
             r.r_name as r_name, replace(n.n_name, '_', ' ') as nat,
             {q.text("770000000 + o.o_custkey")} as tel, case when l.sk is not null then {_locality_base("l.sk", q)} end as place
      from {q.table('orders')} o
      join {q.table('customer')} c on o.o_custkey = c.c_custkey
      left join shipped l on o.o_orderkey = l.l_orderkey
      left join {q.table('supplier')} s on s.s_suppkey = l.sk
      left join {q.table('part')} p on p.p_partkey = l.pk
      left join {q.table('nation')} n on n.n_nationkey = coalesce(s.s_nationkey, c.c_nationkey)
      left join {q.table('region')} r on r.r_regionkey = n.n_regionkey
    ), named as (
      select *, {first} as first, {last} as last, {_cat(first, "' '", last)} as name from base
    ), made as (select {columns} from named)
    select * from made
    union all
    select row_id + 1000000000 as row_id, {', '.join(CASE_COLUMNS[1:])} from made where row_id % 211 = 0"""


CASE_COLUMNS = (
    "row_id", "case_id", "full_name", "sex", "age", "age_unit", "date_birth", "date_onset", "date_report",
    "date_consultation", "date_admission", "date_discharge", "date_sample_collected", "date_lab_result", "outcome",
    "date_death", "case_definition", "hospitalized", "pregnant", "phone", "lat", "lon", "health_facility",
    "admin1", "admin2", "admin3", "locality",
)

AS_OF = "2001-06-30"


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    limit_method_size(spark)
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in SOURCES}


def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(cases_sql(True), **_tables(spark, sf_dir))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(gazetteer_sql(True), **_tables(spark, sf_dir))
