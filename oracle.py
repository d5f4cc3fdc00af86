"""The registered queries in plain SQL, written for DuckDB and independent of the library.

Only the derivation of the input case list and gazetteer is shared with it.
"""

from __future__ import annotations

from casewell.plans.casebook import AS_OF, CASE_COLUMNS, cases_sql, gazetteer_sql

MISSING = ("", "nan", "na", "n/a", "n.a.", "n_a", "null", "none", "nil", "--", "---", "-99", "-999", "999", "9999",
           "?", "??", ".", "/", "missing", "manquant", "sin dato", "sd", "non renseigne", "non renseigné", "n.r.",
           "nsp", "not applicable", "unspecified")
FRENCH = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre",
          "novembre", "décembre")
ENGLISH = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
           "november", "december")
DATES = ("date_birth", "date_onset", "date_report", "date_consultation", "date_admission", "date_discharge",
         "date_sample_collected", "date_lab_result", "date_death")
BANDS = ((5, "<5"), (15, "5-14"), (30, "15-29"), (50, "30-49"), (65, "50-64"), (80, "65-79"))


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _in(x: str, items) -> str:
    return f"{x} in (" + ", ".join(f"'{i}'" for i in items) + ")"


def _missing(x: str) -> str:
    return f"({x} is null or {_in(f'lower(trim({x}))', MISSING)})"


def _round(x: str, n: int) -> str:
    return f"(floor(({x}) * {10 ** n}::double + 0.5::double) / {10 ** n}::double)"


def _pct(part: str, whole: str, n: int) -> str:
    return f"case when {whole} > 0 then {_round(f'{part}::double * 100.0::double / {whole}::double', n)} else 0.0::double end"


def _date(x: str) -> str:
    """The formats the case list uses."""
    parts = f"string_split({x}, ' ')"
    return f"""case when {_missing(x)} then null
      when regexp_full_match({x}, '\\d{{5}}') then date '1899-12-30' + cast({x} as integer)
      when regexp_full_match({x}, '(19|20)\\d{{6}}') then cast(try_strptime({x}, '%Y%m%d') as date)
      when regexp_full_match({x}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_cast({x} as date)
      when regexp_full_match({x}, '\\d{{2}}[/-]\\d{{2}}[/-]\\d{{4}}')
        then coalesce(cast(try_strptime(replace({x}, '/', '-'), '%d-%m-%Y') as date),
                      cast(try_strptime(replace({x}, '/', '-'), '%m-%d-%Y') as date))
      when regexp_full_match({x}, '\\d{{2}}-[A-Za-z]{{3}}-\\d{{4}}') then cast(try_strptime({x}, '%d-%b-%Y') as date)
      else make_date(cast({parts}[3] as integer), cast(list_position({_list(FRENCH)}, {parts}[2]) as integer),
                     cast({parts}[1] as integer)) end"""


def _report(x: str) -> str:
    return f"cast(try_strptime({x}, '%m/%d/%Y') as date)"


def _week(d: str) -> str:
    return f"cast(isoyear({d}) as varchar) || '-W' || lpad(cast(week({d}) as varchar), 2, '0')"


_NUM = "cast(replace(regexp_extract({x}, '^(\\d+([.,]\\d+)?)', 1), ',', '.') as double)"


def _plausible(y: str) -> str:
    return f"case when {y} between 0 and 120 then {_round(y, 2)} end"


def _age(x: str) -> str:
    n = _NUM.format(x=x)
    return f"""case when {_missing(x)} or not regexp_matches({x}, '^\\d') then null
      when {x} like '% mois' then {_plausible(f'{n} / 12.0::double')}
      when {x} like '%d' then {_plausible(f'{n} / 365.25::double')}
      else {_plausible(n)} end"""


def _age_unit(x: str, u: str) -> str:
    n = f"try_cast(replace(trim({x}), ',', '.') as double)"
    return f"""coalesce(case {u} when 'mois' then {_plausible(f'{n} / 12.0::double')}
      when 'semaines' then {_plausible(f'{n} * 7 / 365.25::double')}
      when 'jours' then {_plausible(f'{n} / 365.25::double')}
      when 'ans' then {_plausible(n)} end, {_age(x)})"""


def _band(y: str) -> str:
    return f"case when {y} < 0 then null " + " ".join(f"when {y} < {hi} then '{b}'" for hi, b in BANDS) + \
        f" when {y} >= 80 then '80+' end"


SEX = ("case when sex is null or sex = 'NA' then null when lower(sex) in ('f', 'femme', 'female', '2') then 'Female' "
       "when lower(sex) in ('m', 'homme', 'male', '1') then 'Male' else 'Unknown' end")
CLASS = ("case case_definition when 'Confirme' then 'Confirmed' when 'PCR+' then 'Confirmed' when 'Prob' then 'Probable' "
         "when 'Epidemiologiquement lie' then 'Probable' when 'SUSP' then 'Suspect' when 'Non-cas' then 'Discarded' "
         "when 'unknown' then 'Unknown' end")
OUTCOME = ("case outcome when 'DCD' then 'Dead' when 'Mort' then 'Dead' when 'Guéri' then 'Recovered' "
           "when 'gueri' then 'Recovered' when 'Sortie' then 'Discharged' when 'Discharged' then 'Discharged' "
           "when 'LAMA' then 'LAMA' when 'Evade' then 'LAMA' when 'Transfere' then 'Transferred' "
           "when 'Vivant' then 'Alive' when 'Survivor' then 'Alive' else 'Unknown' end")


def _yes_no(x: str) -> str:
    return f"case when {x} in ('Oui', '1', 'O', '+') then 'Yes' when {x} in ('No', '0', 'N', '-', 'Non') then 'No' end"


PHONE = ("case when phone in ('NA', '12-34') then null when phone like '00%' then '+' || substr(phone, 3) "
         "when phone like '0%' then '+221' || substr(phone, 2) when phone like '+%' then replace(phone, ' ', '') "
         "else '+221' || phone end")


def _coord(x: str, limit: int, letter: str) -> str:
    num = f"try_cast(replace({x}, ',', '.') as double)"
    dms = f"(11.0::double + 30.0::double / 60.0::double) * {'-1' if letter == 'S' else '1'}"
    v = f"case when {x} like '%°%' then {dms} else {num} end"
    return f"case when {v} between -{limit} and {limit} then {_round(v, 6)} end"


SWAPPED = f"({_coord('lat', 90, 'S')}) is null and ({_coord('lon', 180, 'W')}) is not null " \
          f"and ({_coord('lon', 90, 'S')}) is not null and ({_coord('lat', 180, 'W')}) is not null"
LAT = f"case when {SWAPPED} then {_coord('lon', 90, 'S')} else {_coord('lat', 90, 'S')} end"
LON = f"case when {SWAPPED} then {_coord('lat', 180, 'W')} else {_coord('lon', 180, 'W')} end"

CASES = f"with c as materialized ({cases_sql(False)})"
GAZ = f"g as materialized ({gazetteer_sql(False)})"


def _clean_cte() -> str:
    own = {c: _date(c) for c in DATES}
    own["date_report"] = _report("date_report")
    own |= {"sex": SEX, "case_definition": CLASS, "outcome": OUTCOME, "hospitalized": _yes_no("hospitalized"),
            "pregnant": _yes_no("pregnant"), "phone": PHONE, "lat": LAT, "lon": LON,
            "age": _age_unit("age", "age_unit")}
    cols = ", ".join(f"{own[c]} as {c}" if c in own else c for c in CASE_COLUMNS)
    return f"k0 as materialized (select {cols} from c), k as materialized (select *, {_band('age')} as age_group from k0)"


CLEAN = f"{CASES}, {_clean_cte()}"


def _union(parts) -> str:
    return " union all ".join(parts)


# --- validation ------------------------------------------------------------
def _issue_parts(as_of: str) -> list[str]:
    who = "coalesce(case when trim(case_id) <> '' then case_id end, 'Row ' || row_id)"

    def part(no, cond, column, kind, sev, raw, msg, w=who):
        return (f"select row_id, {w} as case_id, {no} as rule_no, '{column}' as column_name, '{kind}' as issue_type, "
                f"'{sev}' as severity, {msg} as message, {raw} as raw_value from k where {cond}")
    out = [part(1, "case_id is null or trim(case_id) = ''", "case_id", "MISSING_MANDATORY", "ERROR",
                "cast(null as varchar)", "'case identifier is missing'", "cast(null as varchar)")]
    seq = ((2, "date_birth", "date_onset", "date_onset", "ERROR"), (3, "date_onset", "date_consultation", "date_consultation", "ERROR"),
           (4, "date_onset", "date_admission", "date_admission", "ERROR"),
           (5, "date_consultation", "date_admission", "date_admission", "WARNING"),
           (6, "date_admission", "date_discharge", "date_discharge", "ERROR"), (7, "date_onset", "date_death", "date_death", "ERROR"),
           (8, "date_admission", "date_death", "date_death", "ERROR"),
           (9, "date_sample_collected", "date_lab_result", "date_lab_result", "ERROR"))
    for no, a, b, col, sev in seq:
        out.append(part(no, f"{a} > {b}", col, "DATE_CHRONOLOGY", sev, f"{col}::varchar",
                        f"'{b} ' || {b}::varchar || ' is before {a} ' || {a}::varchar"))
    for no, col in ((10, "date_onset"), (11, "date_consultation"), (12, "date_admission"), (13, "date_death")):
        out.append(part(no, f"{col} > date '{as_of}'", col, "DATE_CHRONOLOGY", "ERROR", f"{col}::varchar",
                        f"'{col} ' || {col}::varchar || ' is after {as_of}'"))
    out.append(part(14, "age < 0", "age", "INVALID_AGE", "ERROR", "age::varchar", "'age is negative: ' || age::varchar"))
    out.append(part(14, "age > 120", "age", "INVALID_AGE", "WARNING", "age::varchar", "'age is above 120: ' || age::varchar"))
    out.append(part(15, "pregnant = 'Yes' and sex = 'Male'", "pregnant", "INCONSISTENT_STATUS", "ERROR",
                    "'Pregnant=Yes, Sex=Male'", "'pregnant male'"))
    out.append(part(16, "outcome = 'Dead' and date_death is null", "date_death", "INCONSISTENT_STATUS", "WARNING", "outcome",
                    "'outcome is Dead without a date of death'"))
    out.append(part(16, "outcome in ('Recovered', 'Discharged', 'Alive') and date_death is not null", "outcome",
                    "INCONSISTENT_STATUS", "ERROR", "'Outcome=' || outcome || ', DateDeath=' || date_death::varchar",
                    "'outcome is ' || outcome || ' with a date of death ' || date_death::varchar"))
    out.append(part(17, "hospitalized = 'No' and date_admission is not null", "hospitalized", "INCONSISTENT_STATUS", "WARNING",
                    "'Hospitalized=No, DateAdmission=' || date_admission::varchar",
                    "'not hospitalized but admitted on ' || date_admission::varchar"))
    return out


ISSUES = f"{CLEAN}, iss as materialized ({_union(_issue_parts(AS_OF))})"

# --- gazetteer and places --------------------------------------------------
STOP = "village|localite|ward|lga|district|zone de sante|commune|city|ville"


def _place(x: str) -> str:
    folded = f"strip_accents(lower(trim({x})))"
    return (f"coalesce(trim(regexp_replace(regexp_replace(regexp_replace({folded}, '\\b({STOP})\\b', ' ', 'g'), "
            f"'[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '')")


LEVELS = (("Locality", "locality", "locality_name", "locality_pcode"), ("Admin3_Ward", "admin3", "admin3_name", "admin3_pcode"),
          ("Admin2_LGA", "admin2", "admin2_name", "admin2_pcode"), ("Admin1_State", "admin1", "admin1_name", "admin1_pcode"))
_ENTRIES = _union(
    f"select '{lvl}' as level, {_place(name)} as norm, {code} as pcode, {name} as name, latitude as lat, longitude as lon, "
    f"ref_row as r, {'-ref_row' if lvl == 'Locality' else 'ref_row'} as pref from g"
    for lvl, _, name, code in LEVELS)
INDEX = (f"{GAZ}, ent as (select *, row_number() over (partition by level, norm order by pref) as rn, "
         f"min(r) over (partition by level, norm) as cand_order from ({_ENTRIES}) e where norm <> '' and pcode <> ''), "
         f"idx as materialized (select level, norm, pcode, name, lat, lon, cand_order from ent where rn = 1)")


def _attach(source: str, matches: str) -> str:
    joins, pick = [], []
    for i, (lvl, col, _, _) in enumerate(LEVELS):
        joins.append(f"left join {matches} m{i} on m{i}.level = '{lvl}' and m{i}.norm = {_place('x.' + col)} and trim(x.{col}) <> ''")
    def coal(field):
        return "case " + " ".join(f"when m{i}.pcode is not null then m{i}.{field}" for i in range(4)) + " end"
    level = "case " + " ".join(f"when m{i}.pcode is not null then '{l[0]}'" for i, l in enumerate(LEVELS)) + " else 'Unmatched' end"
    return (f"select x.*, {coal('pcode')} as pcode_assigned, {level} as match_level, coalesce({coal('score')}, 0.0::double) as match_score, "
            f"{coal('name')} as matched_name, {coal('lat')} as geo_lat, {coal('lon')} as geo_lon from {source} x {' '.join(joins)}")


EXACT = f"{CASES}, {INDEX}, hit as (select *, 100.0::double as score from idx), coded as ({_attach('c', 'hit')})"


def _lcs(a: str, b: str) -> str:
    """Bit-parallel longest common subsequence length of two texts shorter than 100 letters."""
    full = f"((1::hugeint << length({a})) - 1)"
    bits = (f"list_sum(list_transform(range(length({a})), lambda i: case when substr({a}, i + 1, 1) = ch "
            f"then 1::hugeint << cast(i as integer) else 0::hugeint end))::hugeint")
    return (f"(length({a}) - bit_count(list_reduce(list_concat([{full}], list_transform(string_split({b}, ''), lambda ch: {bits})), "
            f"lambda acc_, hit_: ((acc_ + (acc_ & hit_)) | (acc_ - (acc_ & hit_))) & {full})))")


def _ratio(a: str, b: str) -> str:
    return f"200.0::double * {_lcs(a, b)} / (length({a}) + length({b}))"


def _sorted(x: str) -> str:
    return f"list_aggregate(list_sort(string_split({x}, ' ')), 'string_agg', ' ')"


def _partial(s: str, l: str) -> str:
    """``s`` is the shorter text."""
    m, n = f"length({s})", f"length({l})"
    windows = (f"list_concat(list_transform(range(1, {m}), lambda i: substr({l}, 1, cast(i as integer))), "
               f"list_transform(range(0, {n} - {m} + 1), lambda i: substr({l}, cast(i + 1 as integer), {m})), "
               f"list_transform(range({n} - {m} + 1, {n}), lambda i: substr({l}, cast(i + 1 as integer))))")
    return f"list_max(list_transform({windows}, lambda w: {_ratio(s, 'w')}))"


def _scored(n: str = "", idx: str = "idx") -> str:
    """Matches ``hit{n}`` of the names in ``probe{n}`` among the entries ``idx``."""
    return f"""residual{n} as materialized (select * from probe{n} anti join {idx} using (level, norm)),
 srt{n} as materialized (select level, norm, {_sorted('norm')} as s from (select level, norm from residual{n} union select level, norm from {idx}) u),
 sortpair{n} as materialized (select r.level, r.norm, i.norm as cand, i.cand_order, {_ratio('a.s', 'b.s')} as score
   from residual{n} r join {idx} i on r.level = i.level join srt{n} a on a.level = r.level and a.norm = r.norm
   join srt{n} b on b.level = i.level and b.norm = i.norm
   where 2.0 * least(length(a.s), length(b.s)) >= 0.799 * (length(a.s) + length(b.s))),
 bysort{n} as materialized (select level, norm, cand, score, row_number() over (partition by level, norm order by score desc, cand_order) as rn
   from sortpair{n} where score >= 80 - 1e-9),
 rest{n} as materialized (select * from residual{n} anti join (select level, norm from bysort{n}) b using (level, norm)),
 pairs{n} as materialized (select r.level, r.norm, i.norm as cand, i.cand_order,
     case when length(r.norm) <= length(i.norm) then r.norm else i.norm end as s,
     case when length(r.norm) <= length(i.norm) then i.norm else r.norm end as l
   from rest{n} r join {idx} i on r.level = i.level),
 partpair{n} as materialized (select *, greatest({_partial('s', 'l')}, case when length(s) = length(l) then {_partial('l', 's')} else 0 end) as score from pairs{n}),
 bypart{n} as materialized (select level, norm, cand, score, row_number() over (partition by level, norm order by score desc, cand_order) as rn
   from partpair{n} where score >= 85 - 1e-9),
 found{n} as materialized (
   select level, norm, norm as cand, 100.0::double as score from probe{n} semi join {idx} using (level, norm)
   union all select level, norm, cand, score from bysort{n} where rn = 1
   union all select level, norm, cand, score from bypart{n} where rn = 1),
 hit{n} as materialized (select f.level, f.norm, f.score, i.pcode, i.name, i.lat, i.lon from found{n} f join {idx} i on i.level = f.level and i.norm = f.cand)"""


FUZZY = f"""{CASES}, {INDEX},
 probe as materialized (select distinct * from ({_union(f"select '{lvl}' as level, {_place(col)} as norm from c" for lvl, col, _, _ in LEVELS)}) p where norm <> ''),
 {_scored()},
 coded as ({_attach('c', 'hit')})"""


def _nested(exact: bool) -> str:
    """The cascade from the coarsest level down, names looked up below the place found so far."""
    entries = []
    for k, (lvl, _, name, code) in enumerate(LEVELS):
        places = [f"'{lvl}'", *[f"case when {up[3]} <> '' then '{lvl}' || chr(10) || '{up[0]}' || chr(10) || {up[3]} end" for up in LEVELS[k + 1:]]]
        entries += [f"select {place} as level, {_place(name)} as norm, {code} as pcode, {name} as name, latitude as lat, longitude as lon, "
                    f"ref_row as r, {'-ref_row' if lvl == 'Locality' else 'ref_row'} as pref from g" for place in places]
    steps = [f"""nent as (select *, row_number() over (partition by level, norm order by pref) as rn, min(r) over (partition by level, norm) as cand_order
       from ({_union(entries)}) e where level is not null and norm <> '' and pcode <> ''),
     nidx as materialized (select level, norm, pcode, name, lat, lon, cand_order from nent where rn = 1),
     named as materialized (select row_id, {', '.join(f"coalesce(case when trim({col}) <> '' then {_place(col)} end, '') as p{i}" for i, (_, col, _, _) in enumerate(LEVELS))} from c),
     path4 as materialized (select distinct p0, p1, p2, p3, null::varchar as pcode, null::varchar as lvl, null::double as score, null::varchar as name,
       null::double as lat, null::double as lon from named)"""]
    for i in (3, 2, 1, 0):
        level = LEVELS[i][0]
        steps.append(f"at{i} as materialized (select *, coalesce('{level}' || chr(10) || lvl || chr(10) || pcode, '{level}') as place from path{i + 1})")
        if exact:
            steps.append(f"hit{i} as (select *, 100.0::double as score from nidx)")
        else:
            steps.append(f"probe{i} as materialized (select distinct place as level, p{i} as norm from at{i} where p{i} <> '')")
            steps.append(_scored(str(i), "nidx"))
        pick = ", ".join(f"case when h.pcode is not null then {new} else a.{old} end as {old}" for new, old in (
            ("h.pcode", "pcode"), (f"'{level}'", "lvl"), ("h.score", "score"), ("h.name", "name"), ("h.lat", "lat"), ("h.lon", "lon")))
        steps.append(f"path{i} as materialized (select p0, p1, p2, p3, {pick} from at{i} a left join hit{i} h on h.level = a.place and h.norm = a.p{i})")
    return (f"{CASES}, {GAZ}, {', '.join(steps)} select row_id, pcode as pcode_assigned, coalesce(lvl, 'Unmatched') as match_level, "
            f"{_round('coalesce(score, 0.0::double)', 1)} as match_score, name as matched_name, lat as geo_lat, lon as geo_lon "
            "from named join path0 using (p0, p1, p2, p3)")


# --- duplicates ------------------------------------------------------------
CONTENT = CASE_COLUMNS[1:]
_FILLED = " + ".join(f"(case when {c} is not null then 1 else 0 end)" for c in CONTENT)
DEDUP = f"""{CASES}, r as materialized (select row_id, {', '.join(CONTENT)}, {_FILLED} as filled from c),
 ex as materialized (select * from (select row_id, case_id, filled, count(*) over w as n, min(row_id) over w as group_id
   from r window w as (partition by {', '.join(CONTENT)})) x where n > 1),
 ids as materialized (select * from (select row_id, case_id, filled, count(*) over w as n, min(row_id) over w as group_id
   from (select * from r anti join ex using (row_id)) f where trim(case_id) <> '' window w as (partition by case_id)) x where n > 1),
 mem as materialized (select row_id, group_id, case_id, filled, 'exact' as duplicate_type from ex
   union all select row_id, group_id, case_id, filled, 'exact_id' from ids),
 ranked as materialized (select *, row_number() over (partition by group_id order by filled desc, row_id) as best,
   row_number() over (partition by group_id order by row_id) as first_no,
   row_number() over (partition by group_id order by row_id desc) as last_no from mem)"""


def _keep(rank: str) -> str:
    return f"{DEDUP} select row_id, {', '.join(CONTENT)} from r where row_id not in (select row_id from ranked where {rank} > 1)"


_MERGED = ", ".join(
    f"arg_min({c}, case when best = 1 then -1 else row_id end) filter (where {c} is not null) as {c}" for c in CONTENT)
_MERGE = f"""{DEDUP}, joined as (select r.*, k.group_id, k.best from r join ranked k using (row_id))
 select row_id, {', '.join(CONTENT)} from r where row_id not in (select row_id from ranked)
 union all select min(row_id) filter (where best = 1) as row_id, {_MERGED} from joined group by group_id"""

# --- facilities ------------------------------------------------------------
_TITLE = ("list_aggregate(list_transform(string_split(trim(health_facility), ' '), "
          "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ' ')")
FACILITY = f"""{CASES}, nm as materialized (
   select {_TITLE} as name, count(*) as cnt, min(row_id) as first_row from c where trim(health_facility) <> '' group by 1),
 no as materialized (select *, row_number() over (order by cnt desc, first_row) as no, {_sorted("regexp_replace(lower(name), ' +', ' ', 'g')")} as s from nm),
 edge as materialized (select a.no as a, b.no as b, {_ratio('a.s', 'b.s')} as score from no a join no b on a.no < b.no
   where 2.0 * least(length(a.s), length(b.s)) >= 0.849 * (length(a.s) + length(b.s))),
 nb as materialized (select b as no, list(a order by a) as before from edge where score >= 85 - 1e-9 group by b),
 walk as (with recursive st(no, leaders) as (
     select 0::bigint, []::bigint[]
     union all
     select st.no + 1, case when nb.before is null or not list_has_any(st.leaders, nb.before)
                            then list_append(st.leaders, st.no + 1) else st.leaders end
     from st left join nb on nb.no = st.no + 1 where st.no < (select max(no) from no))
   select leaders from st order by no desc limit 1),
 led as materialized (select unnest(leaders) as no from walk),
 own as materialized (select n.no, n.name, n.cnt, min(e.a) as leader from no n
   left join edge e on e.b = n.no and e.score >= 85 - 1e-9 and e.a in (select no from led)
     and n.no not in (select no from led)
   group by all),
 fac as materialized (select o.no, o.name, l.name as canonical, o.cnt, case when o.leader is null then 100.0::double else e.score end as score
   from own o join no l on l.no = coalesce(o.leader, o.no) left join edge e on e.a = o.leader and e.b = o.no)"""

# --- analytics -------------------------------------------------------------
DELAYS = (("onset_to_consultation", "date_onset", "date_consultation"), ("onset_to_admission", "date_onset", "date_admission"),
          ("hospital_length_of_stay", "date_admission", "date_discharge"), ("onset_to_death", "date_onset", "date_death"))
BINS = (("0-2 days", 0, 2), ("3-5 days", 3, 5), ("6-10 days", 6, 10), ("11-20 days", 11, 20), (">20 days", 21, 180))
DELAY = f"{CLEAN}, dl as materialized (" + _union(
    f"select '{n}' as delay, datediff('day', {a}, {b}) as days from k where datediff('day', {a}, {b}) between 0 and 180"
    for n, a, b in DELAYS) + ")"


def _curve(period: str, by: str = "") -> str:
    extra = f", coalesce({by}, 'Unknown') as stratum" if by else ""
    return f"{CLEAN} select {period} as period{extra}, count(*) as cases from k where date_onset is not null group by all order by all"


def _alerts(counts: str, by: str, mult: float) -> str:
    part = f"partition by {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""a as (select *, avg(cases) over ({part}) as mean, stddev_pop(cases) over ({part}) as sd, count(*) over ({part}) as weeks from {counts})
 select {lead}week, cases, {_round('mean', 1)} as baseline_mean, case when cases > mean + 2 * sd then 'HIGH' else 'MEDIUM' end as severity,
   {_round(f'mean * {mult}::double', 1)} as threshold
 from a where weeks >= 3 and cases >= 5 and (cases > mean * {mult}::double or (sd > 0 and cases > mean + 2 * sd))"""


def _weekly(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"{CLEAN}, w as materialized (select {lead}{_week('date_onset')} as week, count(*) as cases from k where date_onset is not null group by all)"


EVENTS = f"with w as materialized (select event_type, {_week('ts::date')} as week, count(*) as cases from events where ts is not null group by all)"
_LAST2 = """x as (select *, lag(cases) over (partition by {by} order by week) as before,
   row_number() over (partition by {by} order by week desc) as rn, count(*) over (partition by {by}) as weeks from {w}),
 pk as (select {by}, week as peak_week from (select *, row_number() over (partition by {by} order by cases desc, week) as p from {w}) q where p = 1),
 t as (select x.{by}, weeks, cases as last_week_cases, before as previous_week_cases, peak_week,
   case when weeks >= 2 and before > 0 then """ + _round("(cases - before)::double / before::double * 100.0::double", 1) + """ else 0.0::double end as g
   from x join pk on x.{by} = pk.{by} where rn = 1)"""


def _quality() -> str:
    keys = ("case_id", "sex", "age", "date_onset", "outcome", "case_definition")
    filled = " + ".join(f"count(*) filter (where trim({c}::varchar) <> '') * 100.0::double / count(*)::double" for c in keys)
    dd = DEDUP[DEDUP.index(", r as"):]
    return f"""{ISSUES}{dd}, q as (
   select (0.0::double + {filled}) / 6.0::double as completeness, count(*)::double as n from k),
 i as (select count(*) filter (where issue_type = 'DATE_CHRONOLOGY' and severity = 'ERROR') as chrono,
   count(*) filter (where issue_type <> 'DATE_CHRONOLOGY' and severity = 'ERROR') as errors,
   count(*) filter (where severity = 'WARNING') as warnings from iss),
 u as (select count(*) - count(distinct group_id) as surplus from mem),
 s as (select completeness, greatest(0.0::double, 100.0::double - chrono * 2.0::double / n * 100.0::double) as chronology,
   greatest(0.0::double, 100.0::double - (errors * 2.0::double + warnings * 0.5::double) / n * 100.0::double) as validity,
   greatest(0.0::double, 100.0::double - surplus * 2.5::double / n * 100.0::double) as uniqueness from q, i, u),
 o as (select *, {_round('least(100.0::double, greatest(0.0::double, completeness * 0.3::double + chronology * 0.25::double + validity * 0.25::double + uniqueness * 0.2::double))', 1)} as overall from s),
 sc as materialized (select overall, case when overall >= 90 then 'A' when overall >= 80 then 'B' when overall >= 70 then 'C' when overall >= 60 then 'D' else 'F' end as grade,
   {_round('completeness', 1)} as completeness, {_round('chronology', 1)} as chronology, {_round('validity', 1)} as validity, {_round('uniqueness', 1)} as uniqueness from o)"""


# A column's kind and category; columns without a tag are unclassified text.
PROFILED = (
    ("case_id", "string", "identifier"), ("full_name", "string", "demographic_pii"), ("sex", "categorical", "demographic"),
    ("age", "numeric", "demographic"), ("age_unit", "categorical", "demographic"), ("date_birth", "date", "demographic"),
    ("date_onset", "date", "timeline"), ("date_report", "string", "unclassified"), ("date_consultation", "date", "timeline"),
    ("date_admission", "date", "timeline"), ("date_discharge", "date", "timeline"), ("date_sample_collected", "date", "laboratory"),
    ("date_lab_result", "date", "laboratory"), ("outcome", "categorical", "clinical"), ("date_death", "date", "timeline"),
    ("case_definition", "categorical", "clinical"), ("hospitalized", "binary", "clinical"), ("pregnant", "binary", "clinical"),
    ("phone", "string", "demographic_pii"), ("lat", "string", "unclassified"), ("lon", "string", "unclassified"),
    ("health_facility", "string", "geographic"), ("admin1", "string", "geographic"), ("admin2", "string", "geographic"),
    ("admin3", "string", "geographic"), ("locality", "string", "unclassified"))
VALUES = f"{CASES}, v as materialized (" + _union(
    f"select '{c}' as column_name, {c} as value, row_id from c where trim({c}) <> ''" for c in CONTENT) + "), " \
    "vc as materialized (select column_name, value, count(*) as cnt from v group by all)"


def build() -> dict[str, str]:
    text_cols = [c for c in CASE_COLUMNS if c != "row_id"]
    q: dict[str, str] = {}
    q["null_tokens"] = f"{CASES} " + _union(
        f"select '{c}' as column_name, count(*) filter (where {c} is not null and {_missing(c)}) as token_cells, "
        f"count(*) filter (where {c} is null) as null_cells from c" for c in text_cols)
    q["null_tokens_documents"] = _union(
        f"select '{c}' as column_name, count(*) filter (where {c} is not null and {_missing(c)}) as token_cells, "
        f"count(*) filter (where {c} is null) as null_cells from documents" for c in ("text", "lang", "source"))
    q["excel_serial_dates"] = (f"{CASES} select row_id, date '1899-12-30' + cast(date_onset as integer) as serial_date from c "
                               "where regexp_full_match(date_onset, '\\d{5}') and cast(date_onset as integer) between 25569 and 60000")
    q["parse_mixed_dates"] = f"{CASES} select row_id, {_date('date_onset')} as onset from c"
    q["rare_dates"] = f"""{CASES} select row_id, case when row_id % 3 = 0 then make_date(2000, date_consultation[6:7]::int, date_consultation[9:10]::int)
      else date_consultation::date end as date_consultation from c"""
    q["csv_cases"] = f"""{CASES} select row_id as case_row, full_name,
      full_name || chr(10) || '"' || coalesce(case_id, 'none') || '", end' as note from c"""
    q["json_cases"] = f"""{CASES} select row_id as case_row, '}} {{[' || full_name || '"' || chr(92) as label, date_birth, sex, age from c"""
    sp = "string_split(date_onset, ' ')"
    q["normalise_date_text"] = f"""{CASES} select row_id, case when contains(date_onset, ' ')
      then {sp}[1] || ' ' || list_extract({_list(e if len(f) > 4 else e[:3] for e, f in zip(ENGLISH, FRENCH))}, list_position({_list(FRENCH)}, {sp}[2])) || ' ' || {sp}[3]
      when regexp_matches(date_onset, '-[A-Z]') then lower(date_onset) else date_onset end as onset_text from c"""
    def vote(c, first):
        a, b = (f"try_cast(regexp_extract({c}, '(\\d{{1,2}})[/.-](\\d{{1,2}})[/.-](\\d{{2,4}})', {i}) as integer)" for i in (1, 2))
        x, y = (a, b) if first else (b, a)
        return f"count(*) filter (where {x} > 12 and {y} <= 12)"
    q["day_first_vote"] = f"{CASES} " + _union(
        f"select *, mdy_votes <= dmy_votes as day_first from (select '{c}' as column_name, {vote(c, True)} as dmy_votes, {vote(c, False)} as mdy_votes from c) x"
        for c in CASE_COLUMNS if c.startswith("date_"))
    def stat(c):
        d = _report(c) if c == "date_report" else _date(c)
        return (f"select '{c}' as column_name, count(*) as total_rows, count({c}) as raw_non_null, count({d}) as parsed, "
                f"count(*) filter (where ({d}) is null and not {_missing(c)}) as failed from c")
    q["date_column_stats"] = f"{CASES} " + _union(stat(c) for c in DATES)
    q["epi_week_columns"] = (f"{CASES}, o as (select row_id, {_date('date_onset')} as onset from c) select row_id, onset, {_week('onset')} as epi_week, "
                             "cast(week(onset) as integer) as epi_week_num, cast(isoyear(onset) as integer) as epi_year from o")
    q["weekly_counts_share"] = (f"{CASES}, o as (select {_date('date_onset')} as onset from c), w as (select {_week('onset')} as week, count(*) as cases from o where onset is not null group by 1), "
                                f"n as (select count(*) as total from c) select week, cases, {_pct('cases', 'total', 1)} as pct from w, n")
    q["age_years"] = f"{CASES} select row_id, {_age('age')} as age_years from c"
    q["age_with_unit"] = f"{CASES} select row_id, {_age_unit('age', 'age_unit')} as age_years from c"
    q["age_from_birth"] = (f"{CASES}, o as (select row_id, datediff('day', {_date('date_birth')}, {_date('date_onset')}) as n from c) "
                           f"select row_id, case when n >= 0 then {_round('n / 365.25::double', 2)} end as age_at_onset from o")
    q["age_bands"] = f"{CASES}, o as (select {_age_unit('age', 'age_unit')} as y from c) select {_band('y')} as age_group, count(*) as cases from o group by 1"
    q["age_column_stats"] = (f"{CASES}, o as (select age, {_age_unit('age', 'age_unit')} as y from c) select count(*) as total_rows, count(y) as parsed_count, "
                             f"count(*) filter (where y is null and not {_missing('age')}) as invalid_count, coalesce(avg(y), 0) as mean_age, coalesce(median(y), 0) as median_age from o")
    q["std_sex"] = f"{CASES} select row_id, {SEX} as sex_std from c"
    q["std_case_class"] = f"{CASES} select row_id, {CLASS} as case_class from c"
    q["std_outcome"] = f"{CASES} select row_id, {OUTCOME} as outcome_std from c"
    q["std_binary"] = f"{CASES} select row_id, {_yes_no('hospitalized')} as hospitalized, {_yes_no('pregnant')} as pregnant from c"
    q["clean_coordinates"] = f"{CASES} select row_id, {LAT} as lat, {LON} as lon, cast({SWAPPED} as integer) as swapped from c"
    q["coordinate_stats"] = (f"{CASES}, o as (select {LAT} as a, {LON} as b, {SWAPPED} as s from c) select count(*) filter (where a is not null and b is not null) as cleaned, "
                             "count(*) filter (where s) as swapped_fixed, count(*) filter (where a is null or b is null) as invalid from o")
    q["clean_phones"] = f"{CASES} select row_id, {PHONE} as phone_std from c"
    q["phone_stats"] = (f"{CASES}, o as (select phone, {PHONE} as p from c) select count(p) as valid, "
                        "count(*) filter (where p is null and trim(phone) not in ('', 'NA', 'nan', 'None')) as invalid, count(*) as total from o")
    mask = "case when length(w) <= 1 then w when length(w) = 2 then substr(w, 1, 1) || '*' else substr(w, 1, 1) || repeat('*', length(w) - 2) || right(w, 1) end"
    q["mask_names"] = f"{CASES} select row_id, list_aggregate(list_transform(string_split(trim(full_name), ' '), lambda w: {mask}), 'string_agg', ' ') as masked from c"
    q["hash_names"] = f"{CASES} select row_id, 'HASH_' || upper(substr(sha256('field-office:' || lower(trim(full_name))), 1, 10)) as hashed from c"
    number = lambda t: f"'PATIENT_' || case when {t}.n < 1000 then lpad({t}.n::varchar, 4, '0') else {t}.n::varchar end"
    first = lambda c: f"(select {c}, row_number() over (order by min(row_id)) as n from c where {c} is not null group by 1)"
    q["pseudonymise"] = (f"{CASES} select c.row_id, {number('f')} as full_name, {number('p')} as phone from c "
                         f"left join {first('full_name')} f on c.full_name = f.full_name left join {first('phone')} p on c.phone = p.phone")
    q["drop_pii"] = f"{CASES} select * exclude (full_name, phone) from c"
    q["normalise_places"] = f"{CASES} select row_id, " + ", ".join(f"{_place(c)} as {c}_norm" for c in ("admin2", "admin3", "locality")) + " from c"
    q["strip_accents_documents"] = "select doc_id, md5(strip_accents(lower(text))) as plain_md5, length(strip_accents(lower(text))) as plain_chars from documents"
    q["facility_titles"] = f"{CASES} select {_TITLE} as facility, count(*) as cases from c where trim(health_facility) <> '' group by 1"
    q["valid_points"] = f"{CASES}, o as (select row_id, {LAT} as lat, {LON} as lon from c) select * from o where lat between -90 and 90 and lon between -180 and 180"
    cols = CASE_COLUMNS[1:]
    q["search_any_column"] = f"{CASES} select row_id, {', '.join(cols)} from c where contains(row_id::varchar, 'amina') or " + " or ".join(f"coalesce(contains(lower({x}), 'amina'), false)" for x in cols)
    q["level_filter"] = f"{EXACT} select row_id, pcode_assigned, match_level from coded where match_level = 'Admin2_LGA'"
    q["validation_issues"] = f"{ISSUES} select * from iss"
    q["raw_age_issues"] = (f"{CASES}, o as (select row_id, try_cast(age as double) as a from c) select row_id, case when a < 0 then 'ERROR' else 'WARNING' end as severity, "
                           "a::varchar as raw_value from o where a < 0 or a > 120")
    before = "1996-01-01"
    q["issues_before_outbreak"] = (f"{ISSUES} select rule_no, severity, count(*) as cnt from iss where rule_no < 10 group by all "
                                   f"union all select 18, 'WARNING', count(*) from k where date_onset < date '{before}' having count(*) > 0")
    q["issues_by_severity_type"] = (f"{ISSUES}, n as (select 'severity' as dimension, severity as value from iss union all select 'issue_type', issue_type from iss), "
                                    "z as (select dimension, value, 1 as one from n union all select 'severity', unnest(['ERROR', 'WARNING', 'INFO']), 0) "
                                    "select dimension, value, cast(sum(one) as bigint) as cnt from z group by all")
    q["issues_top"] = f"{ISSUES} select row_id, rule_no, severity, column_name from iss order by case severity when 'ERROR' then 1 when 'WARNING' then 2 else 3 end, row_id, rule_no"
    q["gazetteer_index"] = f"with {INDEX} select level, norm, pcode, name, lat, lon, cand_order from idx"
    out = "row_id, pcode_assigned, match_level, match_score, matched_name, geo_lat, geo_lon"
    q["geocode_exact"] = f"{EXACT} select {out} from coded"
    q["geocode_fuzzy"] = f"{FUZZY} select level, norm, pcode, {_round('score', 1)} as score from hit"
    q["geocode_cascade"] = f"{FUZZY} select {out.replace('match_score', _round('match_score', 1) + ' as match_score')} from coded"
    q["geocode_nested"], q["geocode_nested_exact"] = _nested(exact=False), _nested(exact=True)
    lv = _list([l[0] for l in LEVELS] + ["Unmatched"])
    q["flagship"] = (f"{FUZZY}, w as materialized (select match_level, {_week('onset')} as week, count(*) as cases "
                     f"from (select match_level, {_date('date_onset')} as onset from coded) y where onset is not null group by all), "
                     f"al as materialized (with {_alerts('w', 'match_level', 1.5)}) "
                     "select w.match_level, w.week, w.cases, al.severity from w left join al on w.match_level = al.match_level and w.week = al.week")
    q["geojson_fields"] = (f"{EXACT} select 'Feature' as kind, 'Point' as shape, geo_lon as x, geo_lat as y, row_id, {', '.join(CONTENT)}, "
                           "pcode_assigned as _pcode, match_level as _match_level from coded where geo_lat between -90 and 90 and geo_lon between -180 and 180")
    q["geocode_summary"] = f"""{FUZZY}, l as (select unnest({lv}) as match_level), n as (select count(*) as total, count(*) filter (where match_level <> 'Unmatched') as geocoded,
      avg(match_score) filter (where match_score > 0) as m from coded), p as (select match_level, count(*) as cnt from coded group by 1)
      select l.match_level, coalesce(cnt, 0) as cnt, {_pct('coalesce(cnt, 0)', 'total', 1)} as pct, total, geocoded, {_pct('geocoded', 'total', 1)} as rate_pct,
      coalesce({_round('m', 1)}, 0.0::double) as mean_score from l left join p using (match_level), n"""
    q["exact_duplicates"] = f"{DEDUP} select row_id, group_id from ex"
    q["duplicate_ids"] = f"{DEDUP} select row_id, group_id, case_id from ids"
    q["duplicate_groups"] = (f"{DEDUP} select group_id, duplicate_type, count(*) as size, min(row_id) filter (where best = 1) as recommended_keep, "
                             "case when duplicate_type = 'exact_id' then min(case_id) end as matching_id from ranked group by group_id, duplicate_type")
    q["duplicate_keys"] = (f"{DEDUP} select group_id, row_id, duplicate_type, case duplicate_type when 'exact' then 'all_columns' else 'case_id' end as key, "
                           "case duplicate_type when 'exact' then 'identical row' else case_id end as value from mem")
    q["dedup_flag"] = f"{DEDUP} select r.row_id, case when group_id is null then 0 else 1 end as is_duplicate, group_id as duplicate_group_id from r left join mem using (row_id)"
    q["dedup_keep_first"], q["dedup_keep_last"], q["dedup_most_complete"] = _keep("first_no"), _keep("last_no"), _keep("best")
    q["dedup_merge"] = _MERGE
    q["facility_clusters"] = f"{FACILITY} select name, canonical, cnt, {_round('score', 1)} as score from fac"
    q["facility_harmonised"] = (f"{FACILITY} select f.canonical as health_facility, count(*) as cases from (select case when trim(health_facility) <> '' then {_TITLE} end as name from c) x "
                                "left join fac f using (name) group by 1")
    q["quality_scores"] = f"{_quality()} select * from sc"
    kinds = "(values " + ", ".join(f"('{c}', '{k}', '{cat}')" for c, k, cat in PROFILED) + ") p(column_name, inferred_type, category)"
    tail = (f"t as (select count(*) as total_count from c), u as (select column_name, count(*) as unique_count, cast(sum(cnt) as bigint) as filled from vc group by 1)")
    q["column_profile"] = (f"{VALUES}, {tail} select p.column_name, inferred_type, case when category <> 'unclassified' then p.column_name end as mapped_tag, total_count, total_count - coalesce(filled, 0) as missing_count, "
                           f"{_pct('(total_count - coalesce(filled, 0))', 'total_count', 1)} as missing_pct, coalesce(unique_count, 0) as unique_count from {kinds} left join u using (column_name), t")
    q["top_values"] = f"{VALUES} select column_name, value, cnt, cast(r as integer) as rank from (select *, row_number() over (partition by column_name order by cnt desc, value) as r from vc) x where r <= 5"
    q["sample_values"] = f"{VALUES} select column_name, value, cast(r as integer) as rank from (select *, row_number() over (partition by column_name order by row_id) as r from v) x where r <= 4"
    q["inspect_columns"] = (f"{VALUES}, {tail}, f as (select column_name, arg_min(value, row_id) as first_value from v group by 1) select p.column_name, case when category <> 'unclassified' then p.column_name end as mapped_tag, category, "
                            f"{_pct('coalesce(filled, 0)', 'total_count', 1)} as completeness_pct, coalesce(unique_count, 0) as unique_count, first_value from {kinds} left join u using (column_name) left join f using (column_name), t")
    q["profile_issue_counts"] = f"{ISSUES} select column_name, count(*) as issue_count from iss group by 1"
    cnt = lambda cond: f"count(*) filter (where {cond})"
    q["case_indicators"] = f"""{CLEAN}, o as (select count(*) as total_cases, {cnt("case_definition = 'Confirmed'")} as confirmed_cases, {cnt("case_definition = 'Probable'")} as probable_cases,
      {cnt("case_definition = 'Suspect'")} as suspect_cases, {cnt("outcome = 'Dead'")} as deaths, {cnt("outcome = 'Recovered'")} as recovered, {cnt("hospitalized = 'Yes'")} as hospitalized_count,
      {cnt("sex = 'Male'")} as male_count, {cnt("sex = 'Female'")} as female_count from k)
      select *, {_pct('deaths', 'total_cases', 2)} as cfr_pct, case when deaths + recovered > 0 then {_pct('deaths', '(deaths + recovered)', 2)} else {_pct('deaths', 'total_cases', 2)} end as closed_cfr_pct,
      {_pct('hospitalized_count', 'total_cases', 2)} as hospitalization_rate_pct,
      case when female_count > 0 then {_round('male_count::double / female_count::double', 2)} when male_count > 0 then male_count::double else 1.0::double end as sex_ratio_m_f from o"""
    q["age_stats"] = (f"{CLEAN} select " + ", ".join(f"{_round(e, 1)} as {n}" for n, e in (
        ("median", "quantile_cont(age, 0.5)"), ("mean", "avg(age)"), ("q25", "quantile_cont(age, 0.25)"),
        ("q75", "quantile_cont(age, 0.75)"), ("min", "min(age)"), ("max", "max(age)"))) + " from k")
    q["epi_curve_day"] = _curve("strftime(date_onset, '%Y-%m-%d')")
    q["epi_curve_week"] = _curve(_week("date_onset"))
    q["epi_curve_month"] = _curve("strftime(date_onset, '%Y-%m')")
    q["epi_curve_stratified"] = _curve(_week("date_onset"), "outcome")
    q["epi_curve_wide"] = (f"{CLEAN} select strftime(date_onset, '%Y-%m') as period, " + ", ".join(
        (f"{cnt(f'''coalesce(case_definition, 'Unknown') = '{x}' ''')} as \"{x}\"") for x in ("Confirmed", "Probable", "Suspect", "Discarded", "Unknown"))
        + ", count(*) as total from k where date_onset is not null group by 1")
    q["epi_curve_wide_observed"] = (f"{CLEAN} select strftime(date_onset, '%Y-%m') as period, " + ", ".join(
        (f"{cnt(f'''coalesce(sex, 'Unknown') = '{x}' ''')} as \"{x}\"") for x in ("Female", "Male", "Unknown"))
        + ", count(*) as total from k where date_onset is not null group by 1")
    hist = ", ".join(f"{cnt(f'days between {lo} and {hi}')} as \"{n}\"" for n, lo, hi in BINS)
    q["delay_stats"] = (f"{DELAY} select delay, count(*) as count, {_round('avg(days)', 1)} as mean_days, {_round('quantile_cont(days, 0.5)', 1)} as median_days, "
                        f"{_round('quantile_cont(days, 0.25)', 1)} as q25_days, {_round('quantile_cont(days, 0.75)', 1)} as q75_days, cast(min(days) as integer) as min_days, cast(max(days) as integer) as max_days, {hist} from dl group by 1")
    q["delay_histogram"] = f"{DELAY} " + _union(f"select delay, '{n}' as bin, {cnt(f'days between {lo} and {hi}')} as cnt from dl group by 1" for n, lo, hi in BINS)
    cfr = lambda key, cond: (f"{CLEAN}, o as (select {key}, count(*) as total, {cnt(chr(111) + 'utcome = ' + chr(39) + 'Dead' + chr(39))} as deaths from k where {cond} group by 1) "
                             f"select *, {_pct('deaths', 'total', 2)} as cfr_pct from o")
    q["cfr_by_sex"] = cfr("sex", "sex in ('Male', 'Female')")
    q["cfr_by_age"] = cfr("age_group", "age_group is not null")
    q["pyramid"] = (f"{CLEAN} select cast(list_position({_list([b for _, b in BANDS] + ['80+'])}, age_group) as integer) as band_no, age_group, {cnt('sex = ' + chr(39) + 'Male' + chr(39))} as male, "
                    f"{cnt('sex = ' + chr(39) + 'Female' + chr(39))} as female, {cnt('sex is null or sex not in (' + chr(39) + 'Male' + chr(39) + ', ' + chr(39) + 'Female' + chr(39) + ')')} as other from k where age_group is not null group by 1, 2")
    q["weekly_alerts_cases"] = f"{_weekly()}, {_alerts('w', '', 1.1)}"
    q["weekly_alerts_regions"] = f"{_weekly('admin1')}, {_alerts('w', 'admin1', 1.5)}"
    q["weekly_alerts_events"] = f"{EVENTS}, {_alerts('w', 'event_type', 1.1)}"
    q["incidence_trend"] = (f"{EVENTS}, {_LAST2.format(by='event_type', w='w')} select event_type, case when g > 20 then 'increasing' when g < -20 then 'decreasing' else 'stable' end as trend, "
                            "g as weekly_growth_pct, peak_week, case when weeks >= 2 then last_week_cases end as last_week_cases, previous_week_cases from t")
    q["doubling_time"] = (f"{_weekly('admin1')}, w1 as (select * from w qualify week < max(week) over (partition by admin1)), {_LAST2.format(by='admin1', w='w1')} "
                          f"select admin1, g as weekly_growth_pct, case when g > 0 then {_round('ln(2.0::double) / ln(1.0::double + g / 100.0::double)', 1)} end as doubling_weeks from t")
    q["filled_weeks"] = (f"{CLEAN}, m as (select admin1, date_trunc('week', date_onset)::date as monday, count(*) as cases from k where date_onset is not null group by all), "
                         "s as (select admin1, unnest(generate_series(min(monday), max(monday), interval 7 day))::date as monday from m group by 1) "
                         f"select s.admin1, {_week('s.monday')} as week, coalesce(m.cases, 0) as cases from s left join m on m.admin1 = s.admin1 and m.monday = s.monday")
    mp = EXACT.replace(CASES, CLEAN).replace("from c x", "from k x")
    q["map_points"] = (f"{mp} select coalesce(case_id, 'Case ' || row_id) as id, geo_lat as lat, geo_lon as lng, matched_name as name, pcode_assigned as pcode, match_level, match_score as score, "
                       f"{_week('date_onset')} as epi_week from coded where geo_lat between -90 and 90 and geo_lon between -180 and 180 order by row_id")
    return q
