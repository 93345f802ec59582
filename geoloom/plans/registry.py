"""Registered queries and their oracle SQL.

Every query runs an operator of the library over whole tables; fixtures build
the operator's input from the driver tables by expressions.  The oracle SQL says
the same independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions import style as st
from ..operators import address, buildings, gazetteer, kinds, route, search, terrain, tiles
from ..sources.scratch import stash

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- addresses ------------------------------------------------------------

ADDR = """
select case when l_orderkey % 29 = 0 then '' else n_name end ort,
       case when l_orderkey % 5 = 0 then '' else cast(10000 + l_orderkey % 89999 as varchar(10)) end plz,
       case when l_partkey % 31 = 0 then '' else concat(p_name, ' str.') end strasse,
       concat(cast(1 + l_orderkey % 199 as varchar(10)),
              case when l_linenumber = 2 then 'a' when l_linenumber = 3 then 'b' else '' end) hnr,
       47.0D + (l_orderkey % 777) * 0.0101D lat, 5.5D + (l_orderkey % 1000) * 0.0123D lon
from {lineitem} join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey
"""
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


def _sql(spark: SparkSession, sf: str, q: str) -> DataFrame:
    return spark.sql(q, **{t: table(spark, sf, t) for t in TABLES if f"{{{t}}}" in q})


def _duck(q: str) -> str:
    """Oracle form of a fixture: table names and plain double literals."""
    import re

    return re.sub(r"(\d\.\d+)D\b", r"\1::double", re.sub(r"\{(\w+)\}", r"\1", q))


def addr_raw(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, ADDR)


def addr_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The joined rows, written once for queries that read them several times."""
    return stash(addr_raw(spark, sf), "raw")


A = f"with a as ({_duck(ADDR)}), "
PLACES = A + """p as (select ort, min(nullif(plz, '')) plz, avg(lat) lat, avg(lon) lon, count(*) anzahl from a where ort <> '' group by ort),
pi as (select row_number() over (order by ort) id, * from p)"""
STREETS = PLACES + """, s as (select pi.id ort_id, strasse, avg(a.lat) lat, avg(a.lon) lon, count(*) anzahl from a join pi using (ort) where strasse <> '' group by all),
si as (select row_number() over (order by ort_id, strasse) id, * from s),
sf as (select id, ort_id, strasse as name, lat, lon, anzahl, trim(regexp_replace(replace(replace(lower(strasse), 'str.', 'strasse'), 'str ', 'strasse '), 'str$', 'strasse')) such from si)"""


def _round(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("addr_places", PLACES + " select ort, plz, round(lat, 6) lat, round(lon, 6) lon, anzahl from p")
def addr_places(spark: SparkSession, sf: str) -> DataFrame:
    return _round(address.places(addr_raw(spark, sf)), "lat", "lon")


@query("addr_places_top", PLACES + " select ort, anzahl from p order by anzahl desc, ort limit 25")
def addr_places_top(spark: SparkSession, sf: str) -> DataFrame:
    return address.places(addr_raw(spark, sf)).orderBy(F.desc("anzahl"), "ort").limit(25).select("ort", "anzahl")


@query("addr_ids", PLACES + " select id, ort as name from pi")
def addr_ids(spark: SparkSession, sf: str) -> DataFrame:
    return address.place_index(addr_raw(spark, sf)).select("id", "name")


@query("addr_streets", STREETS + " select id, ort_id, name, round(lat, 9) lat, round(lon, 9) lon, anzahl, such as such1 from sf")
def addr_streets(spark: SparkSession, sf: str) -> DataFrame:
    raw = addr_rows(spark, sf)
    return _round(address.street_index(raw, address.place_index(raw)), "lat", "lon", n=9).drop("such2")


@query("addr_numbers", STREETS + """ select si.id strasse_id, hnr nummer, round(a.lat, 6) lat, round(a.lon, 6) lon,
    coalesce(try_cast(nullif(regexp_extract(hnr, '[0-9]+'), '') as bigint), 0) sortier from a join pi using (ort) join si on si.ort_id = pi.id and si.strasse = a.strasse""")
def addr_numbers(spark: SparkSession, sf: str) -> DataFrame:
    raw = addr_rows(spark, sf)
    p = address.place_index(raw)
    return _round(address.number_index(raw, p, address.street_index(raw, p)), "lat", "lon")


@query("addr_distinct_numbers", A + "d as (select distinct hnr nummer from a) select nummer, cast(regexp_extract(nummer, '[0-9]+') as bigint) sortier from d")
def addr_distinct_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return address.distinct_numbers(addr_raw(spark, sf))


OSM_NODES = """
select c_custkey id, case when c_custkey % 97 = 0 then 200.0D else 47.0D + (c_custkey % 777) * 0.0101D end lat, 5.5D + (c_custkey % 1000) * 0.0123D lon,
  map('addr:housenumber', case when c_custkey % 3 = 0 then '' else cast(c_custkey % 50 as string) end, 'addr:city', case when c_custkey % 5 = 0 then '' else c_mktsegment end,
      'addr:place', c_name, 'addr:street', 'Weg') tags from {customer}"""
OSM_WAYS = """
select o_orderkey id, case when o_orderkey % 13 = 0 then cast(array() as array<bigint>)
    else array(o_custkey + case when o_orderkey % 11 = 0 then 1000000 else 0 end, 1L) end nodes,
  map('addr:housenumber', case when o_orderkey % 7 = 0 then '' else cast(o_orderkey % 80 as string) end, 'addr:street', o_orderpriority, 'addr:place', o_orderstatus) tags from {orders}"""


@query("addr_union_ways_nodes", """
with n as (select c_custkey id, case when c_custkey % 97 = 0 then 200 else 47.0::double + (c_custkey % 777) * 0.0101::double end lat, 5.5::double + (c_custkey % 1000) * 0.0123::double lon, * from customer),
ok as (select * from n where lat <= 90),
r as (select o_orderstatus ort, o_orderpriority strasse, cast(o_orderkey % 80 as varchar) hnr, lat, lon from orders join ok on ok.id = o_custkey + case when o_orderkey % 11 = 0 then 1000000 else 0 end
        where o_orderkey % 13 <> 0 and o_orderkey % 7 <> 0
      union all select case when id % 5 = 0 then c_name else c_mktsegment end, 'Weg', cast(id % 50 as varchar), lat, lon from ok where id % 3 <> 0)
select ort, strasse, hnr, count(*) n, round(avg(lat), 9) lat, round(avg(lon), 9) lon from r group by all""")
def addr_union_ways_nodes(spark: SparkSession, sf: str) -> DataFrame:
    raw = address.raw_addresses(_sql(spark, sf, OSM_NODES), _sql(spark, sf, OSM_WAYS))
    return raw.groupBy("ort", "strasse", "hnr").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lon"), 9).alias("lon"))


# --- search ---------------------------------------------------------------

ROUNDS = """, r1 as (select *, 1 runde from {rows} where {prefix} order by anzahl desc, id limit 25),
r2 as (select *, 2 runde from {rows} where {inside} order by anzahl desc, id limit 25),
u as (select * from r1 union all select * from r2 where id not in (select id from r1)) """


@query("search_places", PLACES + ", pf as (select *, lower(ort) such from pi)" + ROUNDS.format(rows="pf", prefix="starts_with(such, 'nation_1')", inside="contains(such, 'nation_1')") + """
select id, ort as name, round(lat, 6) lat, round(lon, 6) lon, anzahl, coalesce(plz, '') plz, runde from u order by runde, anzahl desc, id limit 25""")
def search_places(spark: SparkSession, sf: str) -> DataFrame:
    return _round(search.search_places(address.place_index(addr_raw(spark, sf)), " Nation_1"), "lat", "lon")


@query("search_streets", STREETS + ROUNDS.format(rows="sf", prefix="starts_with(such, 'red')", inside="contains(such, 'red')") + """
select u.id, name, pi.ort, round(u.lat, 9) lat, round(u.lon, 9) lon, u.anzahl, runde from r1 u join pi on pi.id = u.ort_id""")
def search_streets(spark: SparkSession, sf: str) -> DataFrame:
    raw = addr_rows(spark, sf)
    p = address.place_index(raw)
    return _round(search.search_streets(address.street_index(raw, p), p, "Red"), "lat", "lon", n=9)


@query("search_streets_two_round", STREETS + ", sp as (select * from sf where ort_id = 3)" + ROUNDS.format(rows="sp", prefix="starts_with(such, 'strasse')", inside="contains(such, 'strasse')") + """
select u.id, name, pi.ort, round(u.lat, 9) lat, round(u.lon, 9) lon, u.anzahl, runde from u join pi on pi.id = u.ort_id order by runde, u.anzahl desc, u.id limit 25""")
def search_streets_two_round(spark: SparkSession, sf: str) -> DataFrame:
    raw = addr_rows(spark, sf)
    p = address.place_index(raw)
    return _round(search.search_streets(address.street_index(raw, p), p, "Straße", 3), "lat", "lon", n=9)


@query("search_numbers", STREETS + """, n as (select hnr nummer, round(a.lat, 6) lat, round(a.lon, 6) lon, case when lower(hnr) = '1' then 0 when starts_with(lower(hnr), '1') then 1 end rang,
  cast(regexp_extract(hnr, '[0-9]+') as bigint) sortier from a join pi using (ort) join si on si.ort_id = pi.id and si.strasse = a.strasse where si.id = 5)
select nummer, rang from n where rang is not null order by rang, sortier, nummer limit 25""")
def search_numbers(spark: SparkSession, sf: str) -> DataFrame:
    raw = addr_rows(spark, sf)
    p = address.place_index(raw)
    return search.search_numbers(address.number_index(raw, p, address.street_index(raw, p)), 5, "1").select("nummer", "rang")


BASE = "regexp_replace(replace(replace(replace(lower({0}), 'ß', 'ss'), 'str.', 'strasse'), 'str ', 'strasse '), 'str$', 'strasse')"
BASE_TEXT = BASE.format("text")


@query("fold_forms", f"""
with f as (select doc_id, {BASE_TEXT} b from documents),
g as (select doc_id, trim(strip_accents(replace(replace(replace(b, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')), ' ') f1, trim(strip_accents(b), ' ') f2 from f)
select doc_id, sha256(f1) such1, sha256(f2) such2, case when f1 = f2 then 1 else 2 end formen from g""")
def fold_forms(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    d = d.select("doc_id", text.transcribed_form("text").alias("f1"), text.stripped_form("text").alias("f2"), F.size(text.search_forms("text")).alias("formen"))
    return d.select("doc_id", F.sha2("f1", 256).alias("such1"), F.sha2("f2", 256).alias("such2"), "formen")


#: Part names with letters that the German tables do not have, and white space at the end.
LETTERS = """select p_partkey, concat(p_name, ' ', case p_partkey % 9 when 0 then 'Chișinău' when 1 then 'Đakovo' when 2 then 'Tromsø' when 3 then 'Huế' when 4 then 'Łódź'
  when 5 then 'Ἀθῆναι' when 6 then 'Þórshöfn' when 7 then 'Ağrı' else 'Nürnberg' end, case when p_partkey % 2 = 0 then chr(9) else '' end) n from {part}"""


@query("fold_other_letters", f"""with p as ({_duck(LETTERS)}), b as (select p_partkey, lower(n) n, trim(lower(n), ' ' || chr(9)) b from p)
select p_partkey, strip_accents(replace(b, 'ü', 'ue').replace('ö', 'oe')) such1, strip_accents(b) such2,
  regexp_replace(strip_accents(replace(n, 'ü', 'ue').replace('ö', 'oe')), '[^\\x00-\\x7F]', '', 'g') k from b""")
def fold_other_letters(spark: SparkSession, sf: str) -> DataFrame:
    p = _sql(spark, sf, LETTERS)
    return p.select("p_partkey", text.transcribed_form("n").alias("such1"), text.stripped_form("n").alias("such2"), text.gazetteer_key("n").alias("k"))


@query("sort_key_numbers", "select c_custkey, coalesce(try_cast(nullif(regexp_extract(c_name, '[0-9]+'), '') as bigint), 0) sortier from customer")
def sort_key_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", text.number_sort_key("c_name").alias("sortier"))


@query("gazetteer_keys", """select doc_id, sha256(regexp_replace(strip_accents(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')), '[^\\x00-\\x7F]', '', 'g')) k from documents""")
def gazetteer_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.gazetteer_key("text"), 256).alias("k"))


@query("text_scalars", """select o_orderkey, regexp_extract(s, '[^}]*$') tag, case when m = 'm' then v / 1000 else v end km, regexp_replace(regexp_extract(p, '[^/]*$'), '\\.[^.]*$', '') stem, substr(split_part(o_orderpriority || chr(10) || 'x', chr(10), 1), 1, 6) line
from (select *, '{urn:x}' || o_orderstatus s, 'a/b/' || o_orderkey || '.jp2' p, case when o_orderkey % 2 = 0 then 'm' else 'km' end m, (o_orderkey % 900) + 0.5::double v from orders)""")
def text_scalars(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    unit = F.when(F.col("o_orderkey") % 2 == 0, "m").otherwise("km")
    km = F.concat((F.col("o_orderkey") % 900).cast("string"), F.lit(",5 "), unit)
    return o.select(
        "o_orderkey", text.local_name(F.concat(F.lit("{urn:x}"), "o_orderstatus")).alias("tag"), text.kilometres(km).alias("km"),
        text.file_stem(F.concat(F.lit("a/b/"), F.col("o_orderkey").cast("string"), F.lit(".jp2"))).alias("stem"),
        text.first_line(F.concat("o_orderpriority", F.lit("\nx")), 6).alias("line"),
    )


# --- gazetteer ------------------------------------------------------------

GAZ = "select o_custkey gid, cast(floor(o_totalprice) as bigint) pop, o_orderkey ordinal, o_orderstatus st, 47.0D + (o_orderkey % 777) * 0.0101D lat, 5.5D + (o_orderkey % 1000) * 0.0123D lon from {orders}"


@query("gaz_best_by_pop", f"""with g as ({_duck(GAZ)}), r as (select *, row_number() over (partition by gid order by pop desc, ordinal) k, min(ordinal) over (partition by gid) first_seen from g)
select gid, pop, ordinal, st, first_seen from r where k = 1""")
def gaz_best_by_pop(spark: SparkSession, sf: str) -> DataFrame:
    return gazetteer.best_by_population(_sql(spark, sf, GAZ)).select("gid", "pop", "ordinal", "st", "first_seen")


@query("gaz_preferred_name", """with r as (select conv_id gid, text as name, row_number() over (partition by conv_id order by case when role = 'assistant' then 0 else 1 end, turn) k from conversations)
select gid, name from r where k = 1""")
def gaz_preferred_name(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    n = c.select(F.col("conv_id").alias("gid"), F.col("turn").alias("ordinal"), F.col("text").alias("name"), (F.col("role") == "assistant").alias("preferred"))
    return gazetteer.preferred_name(n)


@query("gaz_dedup", f"""with g as ({_duck(GAZ)}), k as (select *, lower(st) k, round(lat, 1) la, round(lon, 1) lo from g),
r as (select *, row_number() over (partition by k, la, lo order by pop desc, ordinal) n, min(ordinal) over (partition by k, la, lo) first_seen from k)
select gid, pop, st as name, first_seen from r where n = 1""")
def gaz_dedup(spark: SparkSession, sf: str) -> DataFrame:
    g = _sql(spark, sf, GAZ).withColumnRenamed("st", "name").withColumn("first_seen", F.col("ordinal"))
    return gazetteer.dedup_nearby(g).select("gid", "pop", "name", "first_seen")


@query("gaz_alias_sets", """select p_partkey, array_to_string(list_sort(list_distinct([x for x in [p_name, p_brand, p_type, p_brand, ''] if x <> '' and x <> p_name])), '|') aliases from part""")
def gaz_alias_sets(spark: SparkSession, sf: str) -> DataFrame:
    names = [F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_brand"), F.lit("")]
    return table(spark, sf, "part").select("p_partkey", F.array_join(gazetteer.aliases(names, F.col("p_name")), "|").alias("aliases"))


GAZ_LINES = """select o_orderkey ordinal, concat_ws('\\t', cast(o_custkey as string), concat('Ort ', o_orderstatus), 'x', 'y',
  case when o_orderkey % 17 = 0 then 'kaputt' else cast(30 + o_orderkey % 50 as string) end, cast(o_orderkey % 60 - 15 as string), case when o_orderkey % 6 = 0 then 'H' else 'P' end, 'PPL',
  case when o_orderkey % 2 = 0 then 'DE' else 'NL' end, '', '07', '', '', '', case when o_orderkey % 4 = 0 then '' else cast(o_orderkey % 1000 as string) end, 'rest') value from {orders}"""


@query("gaz_place_filter", """with x as (select o_orderkey ordinal, 30 + o_orderkey % 50 lat, o_orderkey % 60 - 15 lon, case when o_orderkey % 4 = 0 then 0 else o_orderkey % 1000 end pop, * from orders)
select ordinal, cast(lat as double) lat, cast(lon as double) lon, pop from x where o_orderkey % 17 <> 0 and o_orderkey % 6 <> 0 and o_orderkey % 2 = 0 and lat between 34 and 72 and lon between -11 and 40""")
def gaz_place_filter(spark: SparkSession, sf: str) -> DataFrame:
    return gazetteer.place_lines(_sql(spark, sf, GAZ_LINES), "DE").select("ordinal", "lat", "lon", "pop")


#: Lines of two gazetteer files and of alternate names, with many equal populations.
TWO_FILES = """select o_orderkey ordinal, concat_ws('\\t', cast(o_custkey as string), concat('%s ', cast(o_custkey %% 300 as string)), concat('a', cast(o_custkey %% 300 as string)), '',
  cast(40 + o_custkey %% 20 as string), cast(o_custkey %% 30 as string), 'P', 'PPL', case when o_orderkey %% 3 = 0 then 'NL' else 'DE' end, '', '07', '', '', '', cast(o_orderkey %% %d as string)) value from {orders}"""
NAME_LINES = """select o_orderkey ordinal, concat_ws('\\t', cast(o_orderkey as string), case when o_orderkey % 19 = 0 then 'x' else cast(o_custkey as string) end, case when o_orderkey % 4 = 0 then 'en' else 'de' end,
  concat('Name ', cast(o_orderkey % 50 as string)), case when o_orderkey % 6 = 1 then '1' when o_orderkey % 5 > 0 then '' end,
  case when o_orderkey % 7 = 2 then concat('', chr(9), '', chr(9), '1') end) value from {orders}"""


@query("gaz_two_files", """with u as (
  select 0 f, o_orderkey ordinal, o_custkey gid, 'Land ' || (o_custkey % 300) as name, 'DE' country, o_orderkey % 3 pop from orders where o_orderkey % 3 <> 0
  union all select 1, o_orderkey, o_custkey, 'Welt ' || (o_custkey % 300), case when o_orderkey % 3 = 0 then 'NL' else 'DE' end, o_orderkey % 4 from orders),
b as (select *, row_number() over (partition by gid order by pop desc, f, ordinal) k,
  min(f * (select max(o_orderkey) + 1 from orders) + ordinal) over (partition by gid) first_seen from u),
l as (select o_custkey gid, 'Name ' || (o_orderkey % 50) as name, row_number() over (partition by o_custkey order by case when o_orderkey % 6 = 1 then 0 else 1 end, o_orderkey) k
  from orders where o_orderkey % 19 <> 0 and o_orderkey % 4 <> 0 and not (o_orderkey % 7 = 2 and (o_orderkey % 6 = 1 or o_orderkey % 5 > 0)) and (o_orderkey % 6 = 1 or o_orderkey % 5 > 0 or o_orderkey % 7 = 2)),
d as (select b.gid, coalesce(l.name, b.name) display, b.name as original, b.country, b.pop, b.first_seen, 40 + b.gid % 20 lat, b.gid % 30 lon from b left join l on l.gid = b.gid and l.k = 1 where b.k = 1),
e as (select *, row_number() over (partition by lower(display), lat, lon order by pop desc, first_seen) k, min(first_seen) over (partition by lower(display), lat, lon) first from d)
select display, cast(lat as double) lat, cast(lon as double) lon, pop, country, array_to_string(list_sort(list_distinct(list_filter([original, 'a' || (gid % 300)], lambda x: x <> display))), '|') aliases, first first_seen from e where k = 1""")
def gaz_two_files(spark: SparkSession, sf: str) -> DataFrame:
    country, world = (_sql(spark, sf, TWO_FILES % (name, n)) for name, n in (("Land", 3), ("Welt", 4)))
    g = gazetteer.gazetteer(world, country, _sql(spark, sf, NAME_LINES))
    return g.select("display", "lat", "lon", "pop", "country", F.array_join("aliases", "|").alias("aliases"), "first_seen")


@query("gaz_lookup", f"""with g as ({_duck(GAZ)}) select gid, pop from g where lower(st) = 'f' order by pop desc, ordinal limit 1""")
def gaz_lookup(spark: SparkSession, sf: str) -> DataFrame:
    g = _sql(spark, sf, GAZ).withColumn("first_seen", F.col("ordinal"))
    return gazetteer.lookup(g, "F", "st").select("gid", "pop")


UPSERT = "select o_custkey k, o_orderkey ordinal, o_orderstatus v from {orders} where o_orderkey % 2 = %d"


@query("upsert_last_wins", """with r as (select o_custkey k, o_orderkey ordinal, o_orderstatus v, row_number() over (partition by o_custkey order by o_orderkey % 2 desc, o_orderkey desc) n from orders)
select k, ordinal, v from r where n = 1""")
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    old, new = (_sql(spark, sf, UPSERT.replace("%d", str(i))) for i in (0, 1))
    return gazetteer.upsert(old, new, ["k"])


@query("upsert_first_wins", """with r as (select o_custkey k, o_orderkey ordinal, o_orderstatus v, row_number() over (partition by o_custkey order by o_orderkey % 2, o_orderkey) n from orders)
select k, ordinal, v from r where n = 1""")
def upsert_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    old, new = (_sql(spark, sf, UPSERT.replace("%d", str(i))) for i in (0, 1))
    return gazetteer.upsert(old, new, ["k"], keep_old=True)


# --- coordinates ----------------------------------------------------------

LL = "select o_orderkey id, 5.5D + (o_orderkey % 1000) * 0.0123D lon, 47.0D + (o_orderkey % 777) * 0.0101D lat from {orders}"
LLD = f"with p as ({_duck(LL)}) "
XY = "(lon + 180) / 360 * 65536 fx, (1 - asinh(tan(radians(lat))) / pi()) / 2 * 65536 fy"


@query("tile_xyz", LLD + f", f as (select id, {XY} from p) select id, cast(floor(fx) as bigint) x, cast(floor(fy) as bigint) y from f")
def tile_xyz(spark: SparkSession, sf: str) -> DataFrame:
    x, y = geo.tile_xy("lon", "lat", F.lit(16))
    return _sql(spark, sf, LL).select("id", x.alias("x"), y.alias("y"))


@query("tile_tms", LLD + f", f as (select id, {XY} from p) select id, 65535 - cast(floor(fy) as bigint) tms from f")
def tile_tms(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, LL).select("id", geo.flip_row(geo.tile_xy("lon", "lat", F.lit(16))[1], F.lit(16)).alias("tms"))


@query("tile_pixel", LLD + """, f as (select id, (lon + 180) / 360 * 65536 fx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 65536 fy from p)
select id, cast(floor((fx - floor(fx)) * 256) as bigint) px, cast(floor((fy - floor(fy)) * 256) as bigint) py from f""")
def tile_pixel(spark: SparkSession, sf: str) -> DataFrame:
    fx, fy = geo.tile_fraction_secant("lon", "lat", F.lit(16))
    return _sql(spark, sf, LL).select("id", geo.pixel_in_tile(fx).alias("px"), geo.pixel_in_tile(fy).alias("py"))


@query("tile_bounds", LLD + f""", f as (select id, {XY} from p), m as (select id, floor(fx) x, floor(fy) y, 2 * 20037508.342789244 / 65536 m from f)
select id, round(x * m - 20037508.342789244, 3) west, round(20037508.342789244 - (y + 1) * m, 3) south, round(m, 3) size, round(m / 256, 6) pixel from m""")
def tile_bounds(spark: SparkSession, sf: str) -> DataFrame:
    x, y = geo.tile_xy("lon", "lat", F.lit(16))
    w, s, e, _ = geo.tile_bounds(x, y, F.lit(16))
    return _sql(spark, sf, LL).select("id", F.round(w, 3).alias("west"), F.round(s, 3).alias("south"), F.round(geo.tile_metres(16), 3).alias("size"), F.round(geo.pixel_metres(16), 6).alias("pixel"))


@query("tile_extent_range", LLD + """, m as (select id, lon / 180 * 20037508.342789244 x, asinh(tan(radians(lat))) / pi() * 20037508.342789244 y, 2 * 20037508.342789244 / 1024 t from p)
select id, cast(floor((x + 20037508.342789244) / t) as bigint) x0, cast(floor((x + 50000 - 1e-6 + 20037508.342789244) / t) as bigint) x1,
  cast(floor((20037508.342789244 - (y + 50000 - 1e-6)) / t) as bigint) y0, cast(floor((20037508.342789244 - y) / t) as bigint) y1 from m""")
def tile_extent_range(spark: SparkSession, sf: str) -> DataFrame:
    x, y = geo.lonlat_to_mercator("lon", "lat")
    r = geo.tile_range(x, y, x + 50000, y + 50000, F.lit(10))
    return _sql(spark, sf, LL).select("id", *(c.alias(n) for c, n in zip(r, ("x0", "x1", "y0", "y1"))))


@query("mercator_roundtrip", LLD + "select id, round(lon, 8) lon, round(lat, 8) lat from p")
def mercator_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = geo.mercator_to_lonlat(*geo.lonlat_to_mercator("lon", "lat"))
    return _sql(spark, sf, LL).select("id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


UTM = """, c as (select id, radians(lat) phi, radians(lon - 9) dl, 0.006694380022900788::double e2, 0.006739496775478858::double ep from p),
u as (select id, phi, 6378137.0 / sqrt(1 - e2 * sin(phi) * sin(phi)) n, tan(phi) * tan(phi) t, ep * cos(phi) * cos(phi) c, cos(phi) * dl a, e2, ep,
  6378137.0 * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * phi - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * sin(2 * phi)
   + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * sin(4 * phi) - (35 * e2 * e2 * e2 / 3072) * sin(6 * phi)) m from c),
en as (select id, 0.9996 * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a ** 5 / 120) + 500000 east,
  0.9996 * (m + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a ** 6 / 720)) north from u) """


@query("utm_km_tiles", LLD + UTM + "select id, cast(floor(east / 1000) as bigint) km_e, cast(floor(north / 1000) as bigint) km_n, round(east, 3) east, round(north, 3) north from en")
def utm_km_tiles(spark: SparkSession, sf: str) -> DataFrame:
    e, n = geo.to_utm("lon", "lat")
    ke, kn = geo.km_tile(e, n)
    return _sql(spark, sf, LL).select("id", ke.alias("km_e"), kn.alias("km_n"), F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


@query("utm_roundtrip", LLD + "select id, round(lon, 4) lon, round(lat, 4) lat from p")
def utm_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = geo.from_utm(*geo.to_utm("lon", "lat"))
    return _sql(spark, sf, LL).select("id", F.round(lon, 4).alias("lon"), F.round(lat, 4).alias("lat"))


@query("flat_distances", LLD + """select id, round(sqrt(pow((8.0 - lon) * 111320 * cos(radians(lat)), 2) + pow((50.0 - lat) * 110540, 2)), 3) m, round(lon + (8.0 - lon) * 0.25, 9) as quarter from p""")
def flat_distances(spark: SparkSession, sf: str) -> DataFrame:
    d = geo.flat_distance("lon", "lat", 8.0, 50.0)
    return _sql(spark, sf, LL).select("id", F.round(d, 3).alias("m"), F.round(geo.between_points("lon", 8.0, 0.25), 9).alias("quarter"))


RING = [(6.0, 48.0), (14.0, 49.0), (11.0, 54.0), (9.0, 50.0), (6.5, 53.0)]
EDGES = "(values " + ", ".join(f"({a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for a, b in zip(RING, RING[1:] + RING[:1])) + ") e(ax, ay, cx, cy)"


@query("point_in_polygon", LLD + f"""select id, count(*) filter (where (ay > lat) <> (cy > lat) and lon < (cx - ax) * (lat - ay) / (cy - ay) + ax) % 2 = 1 inside from p, {EDGES} group by id""")
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING))
    return _sql(spark, sf, LL).select("id", geo.in_ring(F.col("lon"), F.col("lat"), ring).alias("inside"))


@query("segment_distances", LLD + """, s as (select id, lon, lat, least(1, greatest(0, ((lon - 6.0) * 8 + (lat - 48.0)) / 65)) t from p) select id, round(sqrt(pow(lon - 6 - t * 8, 2) + pow(lat - 48 - t, 2)), 9) d from s""")
def segment_distances(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, LL).select("id", F.round(geo.segment_distance("lon", "lat", 6.0, 48.0, 14.0, 49.0), 9).alias("d"))


@query("retry_delays", """with x as (select o_orderkey id, [200, 404, 429, 500, 503][1 + o_orderkey % 5] code, o_orderkey % 4 a from orders)
select id, cast(case when code = 429 then 10 * 2 ** a when code in (500, 502, 503, 504) then 2 * 2 ** a end as double) s from x""")
def retry_delays(spark: SparkSession, sf: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, (200, 404, 429, 500, 503))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), geo.retry_delay(code, F.col("o_orderkey") % 4).alias("s"))


# --- tiles ----------------------------------------------------------------

CATALOGUE = "select concat('dgm1_32_', cast(300 + p_partkey % 90 as string), '_', cast(5600 + p_partkey % 97 as string), case when p_partkey % 10 = 0 then '' else '_1_nw' end, case when p_partkey % 7 = 0 then '.jp2' else '.tif' end) name, p_size size, p_partkey from {part}"
CATD = "with c as (select 'dgm1_32_' || (300 + p_partkey % 90) || '_' || (5600 + p_partkey % 97) || case when p_partkey % 10 = 0 then '' else '_1_nw' end || case when p_partkey % 7 = 0 then '.jp2' else '.tif' end as name, p_size size, p_partkey from part), "


@query("catalog_name_parse", CATD + "x as (select p_partkey, regexp_extract(name, '_32_?(\\d{3})_(\\d{4})[_.]', ['e', 'n']) t from c) select p_partkey, cast(nullif(t.e, '') as int) east, cast(nullif(t.n, '') as int) north from x")
def catalog_name_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, CATALOGUE).select("p_partkey", text.tile_of_name("name").alias("t")).select("p_partkey", F.col("t.east").alias("east"), F.col("t.north").alias("north"))


@query("catalog_parts_parse", CATD + "x as (select p_partkey, string_split(name, '_') s from c where name like '%.jp2') select p_partkey, cast(s[3] as int) east, cast(s[4] as int) north from x where len(s) >= 5")
def catalog_parts_parse(spark: SparkSession, sf: str) -> DataFrame:
    t = _sql(spark, sf, CATALOGUE).select("p_partkey", text.tile_of_parts("name").alias("t")).where("t is not null")
    return t.select("p_partkey", F.col("t.east").alias("east"), F.col("t.north").alias("north"))


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    one = _sql(spark, sf, CATALOGUE).select(F.col("p_partkey").alias("ordinal"), F.array(F.struct(F.array(F.struct("name", F.col("size").cast("string").alias("size"))).alias("files"))).alias("datasets"))
    return tiles.last_of_tile(tiles.catalogue_files(one))


LAST = CATD + "l as (select 300 + p_partkey % 90 x, 5600 + p_partkey % 97 y, arg_max(name, p_partkey) as name, cast(arg_max(size, p_partkey) as bigint) size from c group by all)"


@query("catalog_last_wins", LAST + " select * from l")
def catalog_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalogue(spark, sf)
    return c.select(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "name", "size")


AREAS = [("innen", 320, 340, 5620, 5640), ("mitte", 330, 360, 5610, 5650), ("aussen", 300, 390, 5600, 5697)]
GRID = LAST + ", b(rang, bereich, x0, x1, y0, y1) as (values " + ", ".join(f"({i}, '{a[0]}', {a[1]}, {a[2]}, {a[3]}, {a[4]})" for i, a in enumerate(AREAS)) + """),
g as (select rang, bereich, x, y from (select *, unnest(range(x0, x1)) x from b) cross join (select unnest(range(5600, 5697)) y) where y >= y0 and y < y1),
m as (select x, y, arg_min(bereich, rang) bereich, any_value(name) as name, any_value(size) size from g join l using (x, y) group by x, y)"""


@query("tile_area_assign", GRID + """, j as (select bereich, count(l.name) found, count(*) - count(l.name) missing from g left join l using (x, y) group by bereich)
select j.*, coalesce(k.marked, 0) marked, cast(coalesce(k.bytes, 0) as bigint) bytes from j left join (select bereich, count(*) marked, sum(size) bytes from m group by bereich) k using (bereich)""")
def tile_area_assign(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.assign_areas(tiles.area_grid(spark, AREAS), _catalogue(spark, sf))[1]


@query("tile_area_list", GRID + " select bereich, regexp_replace(name, '\\.jp2$', '.tif') as name, size from m where bereich = 'innen'")
def tile_area_list(spark: SparkSession, sf: str) -> DataFrame:
    marked = tiles.assign_areas(tiles.area_grid(spark, AREAS), _catalogue(spark, sf))[0]
    return tiles.marker_filter(marked, "innen").select("bereich", "name", "size")


@query("tile_intersect_missing", LAST + """, w as (select distinct 300 + l_orderkey % 95 x, 5600 + l_partkey % 100 y from lineitem)
select count(l.name) found, count(*) - count(l.name) missing, cast(sum(l.size) as bigint) bytes from w left join l using (x, y)""")
def tile_intersect_missing(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "lineitem").select((300 + F.col("l_orderkey") % 95).alias("x"), (5600 + F.col("l_partkey") % 100).alias("y"))
    found, missing = tiles.wanted_and_missing(w, _catalogue(spark, sf))
    both = found.select("size", F.lit(1).alias("f")).unionByName(missing.select(F.lit(None).cast("bigint").alias("size"), F.lit(0).alias("f")))
    return both.agg(F.sum("f").alias("found"), F.sum(1 - F.col("f")).alias("missing"), F.sum("size").alias("bytes"))


@query("tile_todo", "select distinct 16 z, o_orderkey % 300 x, o_custkey % 300 y from orders except select 16, c_custkey % 200, c_custkey % 300 from customer")
def tile_todo(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.lit(16).alias("z"), (F.col("o_orderkey") % 300).alias("x"), (F.col("o_custkey") % 300).alias("y")).distinct()
    return tiles.still_to_do(o, table(spark, sf, "customer").select(F.lit(16).alias("z"), (F.col("c_custkey") % 200).alias("x"), (F.col("c_custkey") % 300).alias("y")))


@query("tiles_around", LLD + f""", f as (select id, {XY} from p) select id, cast(floor(fx) as bigint) + dx x, cast(floor(fy) as bigint) + dy y from f, (select unnest([-1, 0, 1]) dx), (select unnest([-1, 0, 1]) dy)""")
def tiles_around(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.around(_sql(spark, sf, LL), 16).select("id", "x", "y")


@query("tile_boxes", """with z as (select unnest(range(5, 11)) z), b as (select z, 2 ** z n from z),
r as (select z, floor((5.5 + 180) / 360 * n) x0, floor((15.1 + 180) / 360 * n) x1, floor((1 - asinh(tan(radians(55.1))) / pi()) / 2 * n) y0, floor((1 - asinh(tan(radians(47.2))) / pi()) / 2 * n) y1 from b)
select cast(z as int) z, count(*) n, cast(sum(x) as bigint) sx, cast(sum(y) as bigint) sy from (select z, unnest(range(x0::bigint, x1::bigint + 1)) x, y0, y1 from r) q, lateral (select unnest(range(y0::bigint, y1::bigint + 1)) y) group by z""")
def tile_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = spark.range(5, 11).select(F.col("id").cast("int").alias("z"), F.lit(5.5).alias("west"), F.lit(47.2).alias("south"), F.lit(15.1).alias("east"), F.lit(55.1).alias("north"))
    return tiles.box_grid(b).groupBy("z").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("size_mismatch", """with e as (select 'f' || p_partkey as name, p_size soll from part), i as (select 'f' || l_partkey as name, cast(max(l_quantity) as int) ist from lineitem where l_partkey % 9 <> 0 group by l_partkey)
select name, soll, ist from e left join i using (name) where ist is null or ist <> soll""")
def size_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string")).alias("name")
    e = table(spark, sf, "part").select(name("p_partkey"), F.col("p_size").alias("soll"))
    # every ninth part gets a name that no part has
    i = table(spark, sf, "lineitem").withColumn("l_partkey", F.expr("case when l_partkey % 9 = 0 then -1 - l_partkey else l_partkey end"))
    i = i.groupBy(name("l_partkey")).agg(F.max("l_quantity").cast("int").alias("ist"))
    return tiles.size_mismatches(e, i)


@query("newest_build", """select max(d) as day from (select cast(o_orderdate as date) d, o_orderkey from orders) where o_orderkey % 3 = 0 and d between date '1998-06-01' - 11 and date '1998-06-01' having max(d) is not null""")
def newest_build(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 3 == 0).alias("available"))
    return tiles.newest_build(days, "1998-06-01").select("day")


@query("harvest_progress", """select count(*) done, count(*) filter (where event_type = 'click') empty, count(*) filter (where event_type = 'error') errors, round(100.0 * count(*) / 1000000, 6) percent,
round(count(*) / 60.0, 6) rate, round((1000000 - count(*)) / (count(*) / 60.0), 4) remaining from events""")
def harvest_progress(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.when(F.col("event_type") == "click", "empty").when(F.col("event_type") == "error", "error").otherwise("done").alias("state"))
    p = tiles.progress(e, 1_000_000, 60.0)
    return p.withColumns({"percent": F.round(p["percent"].cast("double"), 6), "rate": F.round("rate", 6), "remaining": F.round("remaining", 4)})


@query("grid_layout", "select symbol, (i % 8) * 76 x, 100 + (i // 8) * 76 y from (select n_name symbol, row_number() over (order by n_name) - 1 i from nation)")
def grid_layout(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "nation").select(F.col("n_name").alias("symbol"))
    g = tiles.grid_layout(s, "symbol", 8, 76, 100)
    return g.select("symbol", F.col("x").cast("bigint").alias("x"), "y")


# --- styles and kinds -----------------------------------------------------

FEATURES = """select event_id ordinal, user_id, event_type kind, cast(regexp_extract(props, '([0-9]+)', 1) as int) k, value from {events}"""


def _features(spark: SparkSession, sf: str) -> DataFrame:
    e = _sql(spark, sf, FEATURES)
    k = F.col("k")
    return e.select(
        "ordinal", F.when(k % 13 != 0, F.col("kind")).alias("kind"), (k % 18).alias("min_zoom"), F.when(k % 7 != 0, F.concat(F.lit("n"), k.cast("string"))).alias("name"),
        F.when(k % 3 == 0, F.concat(F.lit("d"), (k % 5).cast("string"))).alias("kind_detail"), F.when(k % 4 == 0, F.concat(F.lit("de"), k.cast("string"))).alias("name:de"),
        F.when(k % 5 == 0, k * 10).alias("elevation"), F.when(k % 2 == 0, "Polygon").otherwise("LineString").alias("geom_type"), (k % 20).cast("double").alias("zoom"),
    )


FD = """with e as (select event_id ordinal, event_type ek, cast(regexp_extract(props, '([0-9]+)', 1) as int) k from events),
f as (select ordinal, case when k % 13 <> 0 then ek end kind, k % 18 min_zoom, case when k % 7 <> 0 then 'n' || k end as name, case when k % 3 = 0 then 'd' || (k % 5) end kind_detail,
  case when k % 4 = 0 then 'de' || k end name_de, case when k % 5 = 0 then k * 10 end elevation, case when k % 2 = 0 then 'Polygon' else 'LineString' end geom_type, cast(k % 20 as double) zoom from e) """
GET = ["get", "kind"]
LAYERS = {
    "main": {"id": "main", "minzoom": 3, "filter": ["all", ["has", "name"], ["match", GET, ["click", "view"], True, False]]},
    "rest": {"id": "rest", "minzoom": 5, "maxzoom": 18, "filter": ["all", ["has", "name"], ["<=", ["get", "min_zoom"], ["zoom"]], ["match", GET, ["click", "view"], False, True]]},
    "area": {"id": "area", "maxzoom": 9, "filter": ["==", ["geometry-type"], "Polygon"]},
}
ATTRS = st.Attributes(zoom="zoom")


@query("style_filter_poi", FD + "select ordinal from f where name is not null and min_zoom <= zoom and coalesce(kind not in ('click', 'view'), true) and zoom >= 5 and zoom < 18")
def style_filter_poi(spark: SparkSession, sf: str) -> DataFrame:
    return st.layer_features(_features(spark, sf), LAYERS["rest"], ATTRS).select("ordinal")


@query("style_layers", FD + """select 'main' layer, count(*) n from f where name is not null and coalesce(kind in ('click', 'view'), false) and zoom >= 3
union all select 'area', count(*) from f where geom_type = 'Polygon' and zoom < 9""")
def style_layers(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    parts = [st.layer_features(f, LAYERS[n], ATTRS).agg(F.count("*").alias("n")).select(F.lit(n).alias("layer"), "n") for n in ("main", "area")]
    return parts[0].unionByName(parts[1])


@query("style_color_match", FD + "select ordinal, case when kind in ('click') then '#a5cdec' when kind in ('view', 'purchase') then '#cde0c4' else '#e5e6da' end color from f")
def style_color_match(spark: SparkSession, sf: str) -> DataFrame:
    e = ["match", GET, "click", "#a5cdec", ["view", "purchase"], "#cde0c4", "#e5e6da"]
    return _features(spark, sf).select("ordinal", st.compile_expression(e, ATTRS).alias("color"))


@query("style_interpolate", FD + """select ordinal, round(case when zoom <= 3 then 0.6 when zoom <= 10 then 0.6 + (zoom - 3) * (0.8 / 7) when zoom <= 17 then 1.4 + (zoom - 10) * (1.1 / 7) else 2.5 end, 9) width from f""")
def style_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    e = ["interpolate", ["linear"], ["zoom"], 3, 0.6, 10, 1.4, 17, 2.5]
    return _features(spark, sf).select("ordinal", F.round(st.compile_expression(e, ATTRS), 9).alias("width"))


@query("style_labels", FD + """select ordinal, case when elevation is not null then coalesce(coalesce(name_de, name), '') || ' ' || elevation || ' m' else coalesce(name_de, name) end label, upper(coalesce(name_de, name, '')) caps from f""")
def style_labels(spark: SparkSession, sf: str) -> DataFrame:
    names = ["coalesce", ["get", "name:de"], ["get", "name"]]
    label = ["case", ["has", "elevation"], ["concat", names, " ", ["get", "elevation"], " m"], names]
    caps = {"layout": {"text-field": [*names, ""], "text-transform": "uppercase"}}
    return _features(spark, sf).select("ordinal", st.compile_expression(label, ATTRS).alias("label"), st.label_text(caps, ATTRS).alias("caps"))


@query("kind_histogram", FD + """select coalesce(kind, '-') kind, count(*) n, cast(min(min_zoom) as double) zoom_from, cast(max(min_zoom) as double) zoom_to, arg_min(name, ordinal) filter (where name is not null) example,
count(*) filter (where kind_detail is null) no_detail from f group by kind""")
def kind_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return kinds.kind_summary(_features(spark, sf)).drop("first_seen").withColumn("kind", F.coalesce("kind", F.lit("-")))


@query("kind_detail", FD + "select coalesce(kind, '-') kind, kind_detail, count(*) n from f where kind_detail is not null group by all order by n desc, min(ordinal) limit 10")
def kind_detail(spark: SparkSession, sf: str) -> DataFrame:
    return kinds.most_common(kinds.kind_details(_features(spark, sf)), 10).select(F.coalesce("kind", F.lit("-")).alias("kind"), "kind_detail", "n")


@query("phantom_kinds", """with w(layer, kind) as (values ('main', 'click'), ('main', 'ghost'), ('rest', 'click'), ('rest', 'view'), ('rest', 'spook'))
select layer, array_to_string(list_sort(list(kind)), ',') kinds from w where kind not in (select event_type from events) group by layer""")
def phantom_kinds(spark: SparkSession, sf: str) -> DataFrame:
    style = {"layers": [{"id": "main", "filter": ["match", GET, ["click", "ghost"], True, False]}, {"id": "rest", "filter": ["all", ["match", GET, ["click", "view", "spook"], False, True]]}]}
    return kinds.phantom_kinds(st.style_kinds(spark, style), _sql(spark, sf, FEATURES)).select("layer", F.array_join("kinds", ",").alias("kinds"))


VIEWS = {"metadata": {"views": [{"id": "nacht", "kinds": ["purchase", "click"]}, {"id": "tag", "kinds": ["signup"]}]}}


@query("style_views", FD + """select 'nacht' view, ordinal from f where kind in ('click', 'view', 'purchase') and kind is distinct from 'view'
union all select 'tag', ordinal from f where kind in ('click', 'view', 'signup') and kind is distinct from 'view'
union all select '', ordinal from f where kind in ('click', 'view') and kind is distinct from 'view'""")
def style_views(spark: SparkSession, sf: str) -> DataFrame:
    f, out = _features(spark, sf), None
    for view in ("nacht", "tag", ""):
        shown = ["match", GET, st.view_kinds(VIEWS, ["click", "view"], view), True, False]
        rows = st.layer_features(f, {"id": "v", "filter": ["all", shown, ["!=", GET, "view"]]}, ATTRS).select(F.lit(view).alias("view"), "ordinal")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("style_missing_symbols", FD + "select coalesce(kind_detail, kind) symbol, count(*) n from f where coalesce(kind_detail, kind) not in (select 'd' || r_regionkey from region where r_regionkey < 2) group by 1")
def style_missing_symbols(spark: SparkSession, sf: str) -> DataFrame:
    image = st.compile_expression(["image", ["coalesce", ["get", "kind_detail"], ["get", "kind"]]], ATTRS)
    sheet = table(spark, sf, "region").where("r_regionkey < 2").select(F.concat(F.lit("d"), F.col("r_regionkey").cast("string")).alias("symbol"))
    wanted = _features(spark, sf).select(image.alias("symbol")).where("symbol is not null")
    return kinds.missing_symbols(wanted, sheet).groupBy("symbol").agg(F.count("*").alias("n"))


@query("kind_union", "select distinct event_type kind from events union select distinct o_orderstatus from orders")
def kind_union(spark: SparkSession, sf: str) -> DataFrame:
    return kinds.kinds_of_layers(_sql(spark, sf, FEATURES), table(spark, sf, "orders").select(F.col("o_orderstatus").alias("kind")))


@query("distinct_messages", """select 'm' || (event_id % 37) message from events where (event_id % 600 >= 400) or event_id % 11 = 0 group by 1 order by min(event_id) limit 6""")
def distinct_messages(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    log = table(spark, sf, "events").select(
        i.alias("ordinal"), (i % 600).alias("status"), F.when(i % 11 == 0, "ERR_X").when(i % 3 == 0, "ERR_ABORTED").alias("error"), F.concat(F.lit("m"), (i % 37).cast("string")).alias("message")
    )
    return kinds.distinct_messages(log).select("message")


@query("unknown_sources", "select n_name layer, 's' || n_regionkey source from nation where n_regionkey not in (select r_regionkey from region where r_name < 'B' or r_name > 'F') and n_nationkey % 7 <> 3")
def unknown_sources(spark: SparkSession, sf: str) -> DataFrame:
    # a style of 25 layers, three of them without a source
    here = table(spark, sf, "region").where("r_name < 'B' or r_name > 'F'").collect()
    layers = [{"id": r.n_name} | ({"source": f"s{r.n_regionkey}"} if r.n_nationkey % 7 != 3 else {}) for r in table(spark, sf, "nation").collect()]
    return st.unknown_sources(spark, {"sources": {f"s{r.r_regionkey}": {} for r in here}, "layers": layers}).select("layer", "source")


# --- terrain --------------------------------------------------------------

CELLS = "select l_orderkey, l_linenumber, l_extendedprice / 100 h, l_orderkey % 256 px, l_partkey % 256 py, case when l_linenumber = 7 then -9999.0D else l_extendedprice / 100 end g from {lineitem}"
CD = f"with c as ({_duck(CELLS)}), "
ENC = "e as (select l_orderkey, l_linenumber, h, least(greatest(h + 32768, 0), 65535.996) v from c), t as (select *, cast(floor(floor(v) / 256) as int) r, cast(floor(v) % 256 as int) g, cast(floor((v - floor(v)) * 256) as int) b from e) "


@query("terrarium_encode", CD + ENC + "select l_orderkey, l_linenumber, r, g, b from t")
def terrarium_encode(spark: SparkSession, sf: str) -> DataFrame:
    return terrain.encode(_sql(spark, sf, CELLS).drop("g")).select("l_orderkey", "l_linenumber", "r", "g", "b")


@query("terrarium_roundtrip", CD + ENC + "select l_orderkey, l_linenumber, round(r * 256 + g + b / 256.0 - 32768, 6) h from t")
def terrarium_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    t = terrain.encode(_sql(spark, sf, CELLS).drop("g"))
    return t.select("l_orderkey", "l_linenumber", F.round(geo.decode_height("r", "g", "b"), 6).alias("h"))


@query("terrain_gap_fill", CD + """x as (select *, px // 16 tx, py // 16 ty from c), m as (select tx, ty, avg(g) filter (where g >= -1000) m from x group by all)
select l_orderkey, l_linenumber, round(case when g < -1000 then m else g end, 6) h from x join m using (tx, ty) where m is not null""")
def terrain_gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    c = _sql(spark, sf, CELLS).withColumn("tx", F.floor(F.col("px") / 16)).withColumn("ty", F.floor(F.col("py") / 16)).drop("h").withColumnRenamed("g", "h")
    return terrain.fill_gaps(c, ["tx", "ty"]).select("l_orderkey", "l_linenumber", F.round("h", 6).alias("h"))


@query("terrain_pyramid", CD + "v as (select px // 8 px, py // 8 py, g from c where g >= -1000) select px, py, round(avg(g), 9) h, count(*) n from v group by all")
def terrain_pyramid(spark: SparkSession, sf: str) -> DataFrame:
    c = _sql(spark, sf, CELLS).select("px", "py", F.col("g").alias("h"))
    p = terrain.pyramid(c, 3)[-1]
    return p.select("px", "py", F.round("h", 9).alias("h"), F.col("n").cast("bigint").alias("n"))


#: Cells of 64 x 64; some lie far away, so that their blocks have gaps.
BLOCKS = "select case when (l_orderkey % 64 * 7 + l_partkey % 64 * 3) % 101 = 0 then 10000 else 0 end + l_orderkey % 64 px, l_partkey % 64 py, l_extendedprice / 100 h from {lineitem}"


@query("terrain_tiles", f"with c as ({_duck(BLOCKS)}), " + """u as (select distinct px, py from c), n as (select px // 8 tx, py // 8 ty, count(*) n from u group by all having count(*) = 64)
select n.tx, n.ty, px % 8 ix, py % 8 iy from u join n on px // 8 = tx and py // 8 = ty""")
def terrain_tiles(spark: SparkSession, sf: str) -> DataFrame:
    c = _sql(spark, sf, BLOCKS).groupBy("px", "py").agg(F.max("h").alias("h"))
    return terrain.cut_tiles(c, 8).select("tx", "ty", "ix", "iy")


@query("terrain_diff", CD + ENC + ", d as (select abs(r * 256 + g + b / 256.0 - 32768 - (h + case when l_orderkey % 97 = 0 then 0.25 else 0 end)) d from t) select round(max(d), 6) max_abw, 0::bigint fehlend, case when max(d) <= 6 then 'gut' else 'schlecht' end urteil from d")
def terrain_diff(spark: SparkSession, sf: str) -> DataFrame:
    t = terrain.encode(_sql(spark, sf, CELLS).drop("g")).withColumn("soll", F.col("h") + F.when(F.col("l_orderkey") % 97 == 0, 0.25).otherwise(0.0))
    return terrain.deviation(t).withColumn("max_abw", F.round("max_abw", 6))


@query("terrain_resample", CD + "v as (select cast(floor(px * 0.3::double + py * 0.1::double) as bigint) px, cast(floor(py * 0.3::double) as bigint) py, g from c where g >= -1000) select px, py, round(avg(g), 9) h from v group by all")
def terrain_resample(spark: SparkSession, sf: str) -> DataFrame:
    c = _sql(spark, sf, CELLS).select("px", "py", F.col("g").alias("h"))
    return terrain.resample(c, F.floor(F.col("px") * 0.3 + F.col("py") * 0.1), F.floor(F.col("py") * 0.3)).withColumn("h", F.round("h", 9))


@query("terrain_sample", CD + """r as (select px, py, avg(h) h from c group by all), p as (select c_custkey id, (c_custkey % 250) + 0.25::double fx, (c_custkey * 7 % 250) + 0.5::double fy from customer),
k as (select id, cast(floor(fx) as bigint) + a px, cast(floor(fy) as bigint) + b py, abs(1 - a - (fx - floor(fx))) * abs(1 - b - (fy - floor(fy))) w from p, (select unnest([0, 1]) a), (select unnest([0, 1]) b))
select id, round(sum(h * w) / sum(w), 9) h from k join r using (px, py) group by id""")
def terrain_sample(spark: SparkSession, sf: str) -> DataFrame:
    r = _sql(spark, sf, CELLS).groupBy("px", "py").agg(F.avg("h").alias("h"))
    i = F.col("c_custkey")
    p = table(spark, sf, "customer").select(i.alias("id"), (i % 250 + 0.25).cast("double").alias("fx"), (i * 7 % 250 + 0.5).cast("double").alias("fy"))
    return terrain.bilinear(p, r).withColumn("h", F.round("h", 9))


@query("dark_share", "select round(avg(case when l_orderkey % 5 = 0 and l_partkey % 2 = 0 then 1.0 else 0.0 end), 9) dark from lineitem")
def dark_share(spark: SparkSession, sf: str) -> DataFrame:
    z = (F.col("l_orderkey") % 5).alias("r")
    p = table(spark, sf, "lineitem").select(z, F.lit(0).alias("g"), F.lit(0).alias("b"), F.when(F.col("l_partkey") % 2 == 0, 255).otherwise(0).alias("a"))
    return terrain.dark_share(p).withColumn("dark", F.round("dark", 9))


# --- routes ---------------------------------------------------------------

SERIES = "select user_id id, row_number() over (partition by user_id order by ts, event_id) seq, value h, event_type, event_id, cast(regexp_extract(props, '([0-9]+)', 1) as int) k from {events}"
SD = f"with s as ({_duck(SERIES)}), "


@query("elevation_profile", SD + """g as (select id, seq, avg(h) over (partition by id order by seq rows between 2 preceding and 2 following) g from s), d as (select id, g - lag(g) over (partition by id order by seq) d from g)
select id, round(sum(greatest(d, 0)), 4) auf, round(sum(greatest(-d, 0)), 4) ab from d group by id having count(*) >= 3""")
def elevation_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _round(route.ascents(_sql(spark, sf, SERIES)), "auf", "ab", n=4)


@query("profile_thinned", SD + "n as (select id, count(*) n from s group by id) select id, seq from s join n using (id) where (seq - 1) % cast(ceil(n / 20.0) as bigint) = 0")
def profile_thinned(spark: SparkSession, sf: str) -> DataFrame:
    return route.thinned(_sql(spark, sf, SERIES), 20).select("id", F.col("seq").cast("bigint").alias("seq"))


@query("profile_scaled", SD + "r as (select id, min(h) lo, max(h) hi from s group by id) select id, seq, round(40 * (1 - (h - lo) / greatest(hi - lo, 10)), 6) y from s join r using (id)")
def profile_scaled(spark: SparkSession, sf: str) -> DataFrame:
    return route.scaled(_sql(spark, sf, SERIES)).select("id", F.col("seq").cast("bigint").alias("seq"), F.round("y", 6).alias("y"))


def _trip(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    rest = F.when(k % 3 == 0, F.concat((k * 10).cast("string"), F.lit(" m"))).otherwise(F.concat(k.cast("string"), F.lit(",5 km")))
    return _sql(spark, sf, SERIES).select(
        "id", "seq", rest.alias("rest"), F.when(k % 11 == 0, "Route neu berechnet").otherwise(F.col("event_type")).alias("anweisung"), F.when(k % 17 == 0, "Abseits").otherwise("ok").alias("zustand"),
        (k % 19 != 0).alias("navimodus"), F.when(k % 5 != 0, (k % 60).cast("double")).alias("neigung"), (k * 7 % 360).cast("double").alias("drehung"),
    )


@query("route_delta_checks", SD + """m as (select id, seq, case when k % 3 = 0 then k * 10 / 1000.0::double else k + 0.5::double end km from s), d as (select id, km - lag(km) over (partition by id order by seq) d from m)
select id, count(*) filter (where d > 0.05) anstiege, round(coalesce(max(d) filter (where d > 0.05), 0), 6) groesster from d group by id""")
def route_delta_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _round(route.rises(_trip(spark, sf)), "groesster")


TRIP = SD + "t as (select *, case when k % 11 = 0 then 'Route neu berechnet' else event_type end anweisung, k * 7 % 360 drehung, case when k % 5 <> 0 then cast(k % 60 as double) end neigung from s) "


@query("route_changes", TRIP + ", c as (select id, seq, anweisung <> lag(anweisung) over (partition by id order by seq) c from t) select id, count(*) filter (where c) wechsel from c group by id")
def route_changes(spark: SparkSession, sf: str) -> DataFrame:
    return route.changes(_trip(spark, sf), "anweisung")


@query("trip_counters", TRIP + """select id, count(*) messungen, count(*) filter (where k % 11 = 0) neuberechnungen, count(*) filter (where k % 17 = 0) abseits, count(*) filter (where k % 19 = 0) ohne_modus,
count(distinct floor(drehung / 10.0 + 0.5)) richtungen, count(*) filter (where neigung < 40) flach, (list_sort(list(neigung) filter (where neigung is not null)))[1 + len(list(neigung) filter (where neigung is not null)) // 2] neigung_median from t group by id""")
def trip_counters(spark: SparkSession, sf: str) -> DataFrame:
    return route.trip_counters(_trip(spark, sf))


@query("until_stable", SD + "h as (select id, seq, k % 4 = lag(k % 4) over (partition by id order by seq) same from s) select id, min(seq) stabil from h where same group by id")
def until_stable(spark: SparkSession, sf: str) -> DataFrame:
    f = _sql(spark, sf, SERIES).select("id", "seq", (F.col("k") % 4).alias("hash"))
    return route.until_stable(f).select("id", F.col("stabil").cast("bigint").alias("stabil"))


@query("never_shown", TRIP + """, m as (select distinct id from s), v as (select id, unnest(['start', 'click', 'ghost']) text, unnest([0, 1, 2]) seq from m)
select id, text from v where seq > 0 and not exists (select 1 from t where t.id = v.id and t.anweisung = v.text)""")
def never_shown(spark: SparkSession, sf: str) -> DataFrame:
    t = _trip(spark, sf)
    m = t.select("id").distinct().select("id", F.posexplode(F.array(*map(F.lit, ("start", "click", "ghost")))).alias("seq", "text"))
    return route.never_shown(m, t).select("id", "text")


LINE = "select *, 8.0D + seq * 0.0007D + (k % 5) * 0.0001D lon, 50.0D + seq * 0.0003D + (k % 7) * 0.0001D lat from (" + SERIES + ")"
LD = f"with p as ({_duck(LINE)}), st as (select *, coalesce(sqrt(pow((lon - lag(lon) over w) * 111320 * cos(radians(lag(lat) over w)), 2) + pow((lat - lag(lat) over w) * 110540, 2)), 0) step from p window w as (partition by id order by seq)), wy as (select *, sum(step) over (partition by id order by seq) way from st) "


@query("route_length", LD + "select id, round(max(way), 3) m, count(*) n from wy group by id")
def route_length(spark: SparkSession, sf: str) -> DataFrame:
    return route.cumulative(_sql(spark, sf, LINE)).groupBy("id").agg(F.round(F.max("way"), 3).alias("m"), F.count("*").alias("n"))


@query("route_resample", LD + """, g as (select id, lag(lon) over w lon0, lag(lat) over w lat0, lon, lat, way - step w0, way w1 from wy window w as (partition by id order by seq)),
n as (select *, unnest(range(cast(floor(w0 / 25) as bigint) + 1, cast(floor(w1 / 25) as bigint) + 1)) nr from g where lon0 is not null)
select id, 0::bigint nr, round(lon, 7) lon, round(lat, 7) lat from g where lon0 is null
union all select id, nr, round(lon0 + (lon - lon0) * (nr * 25 - w0) / (w1 - w0), 7), round(lat0 + (lat - lat0) * (nr * 25 - w0) / (w1 - w0), 7) from n""")
def route_resample(spark: SparkSession, sf: str) -> DataFrame:
    return _round(route.resample(_sql(spark, sf, LINE), 25.0), "lon", "lat", n=7)


@query("line_gap", f"with p as ({_duck(LINE)}) select id, round(max(sqrt(pow(0.0002 * 111320 * cos(radians(lat)), 2) + pow(0.0001 * (seq % 3) * 110540, 2))), 4) abweichung from (select *, max(seq) over (partition by id) n from p) where seq < n or n = 1 group by id")
def line_gap(spark: SparkSession, sf: str) -> DataFrame:
    a = _sql(spark, sf, LINE)
    # the other line lacks the last point
    last = F.max("seq").over(Window.partitionBy("id"))
    b = a.withColumn("n", last).where("seq < n or n = 1").withColumn("lon", F.col("lon") + 0.0002).withColumn("lat", F.col("lat") + 0.0001 * (F.col("seq") % 3))
    return _round(route.largest_gap(a, b), "abweichung", n=4)


@query("rate_slots", SD + """i as (select id, k * 1.0::double t, row_number() over (partition by id order by k, event_id) n from s)
select id, n, round(max(t - (n - 1) * 0.5::double) over (partition by id order by n) + (n - 1) * 0.5::double, 6) s from i""")
def rate_slots(spark: SparkSession, sf: str) -> DataFrame:
    s = _sql(spark, sf, SERIES).select("id", F.col("k").cast("double").alias("t"))
    return tiles.rate_slots(s, 2.0).select("id", "n", F.round("slot", 6).alias("s"))


@query("building_control", "select l_orderkey % 50 tile, count(*) n, round(median(l_quantity), 1) median, max(l_quantity) max from lineitem group by 1")
def building_control(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("tile"), F.col("l_quantity").alias("hoehe"))
    return buildings.tile_control(b)


@query("supersample", CD + "v as (select px // 8 px, py // 8 py, h from c) select px, py, round(avg(h), 9) h, count(*) n from v group by all")
def supersample(spark: SparkSession, sf: str) -> DataFrame:
    c = terrain.halve(_sql(spark, sf, CELLS).select("px", "py", "h"), 8)
    return c.select("px", "py", F.round("h", 9).alias("h"), F.col("n").cast("bigint").alias("n"))


@query("node_positions", "with n as (select o_custkey id, o_orderkey ordinal, o_totalprice / 10000 lat from orders) select id, arg_max(lat, ordinal) lat from n where lat <= 40 group by id")
def node_positions(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ordinal"), (F.col("o_totalprice") / 10000).alias("lat"), F.lit(7.0).alias("lon"))
    return address.latest_positions(n.where("lat <= 40")).select("id", "lat")


# --- generic forms --------------------------------------------------------


@query("join_semi", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def join_semi(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("join_anti", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 4 = 0)")
def join_anti(spark: SparkSession, sf: str) -> DataFrame:
    # other orders get a customer that is not there
    o = table(spark, sf, "orders").select(F.expr("case when o_orderkey % 4 = 0 then o_custkey else -1 - o_custkey end").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("topk_spend", "select o_custkey, round(sum(o_totalprice), 2) spend from orders group by o_custkey order by spend desc, o_custkey limit 25")
def topk_spend(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spend")).orderBy(F.desc("spend"), "o_custkey").limit(25)


@query("union_all", "select n_name as name from nation union all select r_name from region union all select n_name from nation")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    return n.unionByName(table(spark, sf, "region").select(F.col("r_name").alias("name"))).unionByName(n)


@query("intersect_keys", "select o_custkey k from orders intersect select s_suppkey from supplier")
def intersect_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_suppkey"))


@query("except_keys", "select p_partkey k from part except select l_partkey from lineitem where l_quantity > 40")
def except_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, sf, "lineitem").where("l_quantity > 40").select("l_partkey"))


# --- file formats ------------------------------------------


@query("geojson_lines", """with c as (select c_custkey, c_custkey % 30 + 0.25::double lon, c_custkey % 20 + 40.5::double lat, 0.5 + (c_custkey % 90) / 2 hoehe from customer)
select '{"type":"Feature","properties":{"hoehe":' || hoehe::double || '},"geometry":{"type":"Polygon","coordinates":[[[' || lon || ',' || lat || '],[' || (lon + 0.5) || ',' || lat || '],[' || lon || ',' || (lat + 0.5)
  || '],[' || lon || ',' || lat || ']]]}}' as value from c""")
def geojson_lines(spark: SparkSession, sf: str) -> DataFrame:
    k, rows = F.col("c_custkey"), table(spark, sf, "customer")
    lon, lat = k % 30 + 0.25, k % 20 + 40.5
    corner = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    ring = geo.close_ring(F.array(corner(lon, lat), corner(lon + 0.5, lat), corner(lon, lat + 0.5)))
    return buildings.as_geojson(rows.select((0.5 + k % 90 / 2).alias("hoehe"), ring.alias("ring")))


@query("positional_lines", """select '["' || p_name || ' \\"x\\"",' || (40.5 + p_partkey % 20)::double || ',' || (7.25 + p_partkey % 9)::double || ',' || p_partkey || ',"DE","0' || (p_partkey % 10) || '",["' || p_brand || '","' || p_type || '"]]' as value from part""")
def positional_lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(
        F.concat("p_name", F.lit(' "x"')).alias("display"), (40.5 + k % 20).cast("double").alias("lat"), (7.25 + k % 9).cast("double").alias("lon"), k.alias("pop"),
        F.lit("DE").alias("country"), F.concat(F.lit("0"), (k % 10).cast("string")).alias("adm1"), F.array("p_brand", "p_type").alias("aliases"),
    )
    return gazetteer.as_positional_json(p)


@query("polyline_decode", LLD + "select id, 0::int seq, round(lon, 6) lon, round(lat, 6) lat from p union all select id, 1, round(lon + 0.5, 6), round(lat - 0.25, 6) from p")
def polyline_decode(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.binary import encode_polyline, polyline_points

    @F.udf("string")
    def line(a: float, b: float) -> str:
        return encode_polyline([(a, b), (a + 0.5, b - 0.25)])

    p = _sql(spark, sf, LL).select("id", line("lon", "lat").alias("shape"))
    return p.select("id", F.posexplode(polyline_points("shape")).alias("seq", "p")).select("id", "seq", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query("mvt_decode", "select n_nationkey, 'pois' layer, n_name kind, cast(n_nationkey as varchar) min_zoom, case when n_nationkey % 2 = 0 then 'true' else 'false' end new from nation")
def mvt_decode(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.binary import register_mvt, write_tile

    register_mvt(spark)

    @F.udf("binary")
    def tile(name: str, k: int) -> bytes:
        return write_tile({"pois": [([(0, 0), (9, 0), (9, 9)], {"kind": name, "min_zoom": k, "new": k % 2 == 0})], "roads": [([(1, 1), (2, 2), (3, 1)], {"kind": "path"})]})

    t = table(spark, sf, "nation").select("n_nationkey", tile("n_name", "n_nationkey").alias("tile"))
    f = spark.sql("select n_nationkey, layer, attrs from {t}, lateral mvt_features(tile, 'pois')", t=t)
    return f.select("n_nationkey", "layer", *(F.element_at("attrs", F.lit(k)).alias(k) for k in ("kind", "min_zoom", "new")))


@query("png_tiles", f"with c as ({_duck(BLOCKS)}), " + """u as (select px, py, max(h) h from c group by all),
v as (select *, px // 8 tx, py // 8 ty, least(greatest(h + 32768, 0), 65535.996) v, count(*) over (partition by px // 8, py // 8) n from u)
select tx, ty, px % 8 ix, py % 8 iy, cast(floor(floor(v) / 256) as int) r, cast(floor(v) % 256 as int) g, cast(floor((v - floor(v)) * 256) as int) b from v where n = 64""")
def png_tiles(spark: SparkSession, sf: str) -> DataFrame:
    # pictures are drawn, then read back pixel by pixel
    from ..functions.binary import png_pixels

    c = _sql(spark, sf, BLOCKS).groupBy("px", "py").agg(F.max("h").alias("h"))
    t = terrain.png_tiles(terrain.cut_tiles(c, 8), 8).select("tx", "ty", F.posexplode(png_pixels("png")).alias("i", "p"))
    return t.select("tx", "ty", (F.col("i") % 8).cast("bigint").alias("ix"), F.floor(F.col("i") / 8).alias("iy"), "p.r", "p.g", "p.b")


@query("xml_buildings", """select cast(s_suppkey as varchar) id, cast(s_suppkey % 400 as double) hoehe, case when s_suppkey % 4 = 3 then 6 else 5 end::int punkte,
  case when s_suppkey % 4 = 0 then 'zweite Fläche' when s_suppkey % 4 = 1 then 'ohne exterior' when s_suppkey % 4 = 2 then 'tiefste' else 'Boden' end art from supplier where s_suppkey % 400 between 1 and 300""")
def xml_buildings(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.files import buildings_of

    east, n = 360000 + F.col("s_suppkey") * 20, F.col("s_suppkey") % 4

    def pos(z: int, width: int, corners: int = 4):  # noqa: ANN202
        spots = [(0, 0), (width, 0), (width, 6), (0, 6), (0, 3)][:corners]
        return F.concat_ws(" ", *(F.concat((east + x).cast("string"), F.lit(f" {5670000 + y} {z}")) for x, y in spots))

    def polygon(points, exterior: bool = True):  # noqa: ANN001, ANN202
        a, b = ("<exterior>", "</exterior>") if exterior else ("", "")
        return F.concat(F.lit(f"<Polygon>{a}<posList>"), points, F.lit(f"</posList>{b}</Polygon>"))

    ground = lambda *p: F.concat(F.lit("<b:GroundSurface>"), *p, F.lit("</b:GroundSurface>"))
    # the first usable of two grounds though the other one is lower; a bare ring; the lowest face; a ring of five points
    two = F.concat(ground(polygon(F.lit("1 2 3"))), ground(polygon(pos(60, 8))), ground(polygon(pos(50, 12))))
    faces = F.concat(polygon(pos(70, 12)), polygon(pos(50, 10)), polygon(pos(55, 14)))
    body = F.when(n == 0, two).when(n == 1, ground(polygon(pos(50, 9), False))).when(n == 2, faces).otherwise(ground(polygon(pos(50, 11, 5))))
    xml = F.concat(
        F.lit('<c xmlns:b="u"><b:Building id="'), F.col("s_suppkey").cast("string"), F.lit('"><b:measuredHeight>'), (F.col("s_suppkey") % 400).cast("string"),
        F.lit("</b:measuredHeight>"), body, F.lit("</b:Building></c>"),
    )
    b = buildings.footprints(table(spark, sf, "supplier").select(F.explode(buildings_of(xml.cast("binary"))).alias("b")).select("b.*"))
    east_of = lambda p: geo.to_utm(p["lon"], p["lat"])[0]
    # the kind is told by the width of the ring in metres
    width = F.round(east_of(F.element_at("ring", 2)) - east_of(F.element_at("ring", 1))).cast("int")
    kind = F.element_at(F.create_map(*[F.lit(v) for p in {8: "zweite Fläche", 9: "ohne exterior", 10: "tiefste", 11: "Boden"}.items() for v in p]), width)
    return b.select("id", "hoehe", F.size("ring").alias("punkte"), kind.alias("art"))
