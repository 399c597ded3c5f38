"""Queries of set operations, tables, ranks, lookups by series, access, sources and streams, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import access, compose, groups
from .plans.array import NDArray
from .queries import _N, _REF, EVENTS, ORDERS, PART, grid, part, query, rounded_cells, suppliers, table, vector
from .session import shared_path
from .sources import container, files
from .streaming import events as streams


def counts(spark, sf_dir) -> NDArray:
    return grid(spark, sf_dir, "km", "int32")


def sizes(spark, sf_dir) -> NDArray:
    return grid(spark, sf_dir, "k", "int32")


# ---- sets
query("set_union", f"{PART}, {_REF} select km as v from a where km is not null union select v from r")(lambda s, d: counts(s, d).union(suppliers(s, d)))
query("set_intersect", f"{PART}, {_REF} select km as v from a where km is not null intersect select v from r")(lambda s, d: counts(s, d).intersect(suppliers(s, d)))
query("set_except", f"{PART}, {_REF} select km as v from a where km is not null except select v from r")(lambda s, d: counts(s, d).except_(suppliers(s, d)))
query("set_except_all", f"{PART}, {_REF} select v, count(*) as n from (select km as v from a where km is not null except all select v from r) group by v")(lambda s, d: counts(s, d).except_all(suppliers(s, d)))
query("set_is_in", f"{PART}, {_REF} select addr, km in (select v from r) as v from a")(lambda s, d: counts(s, d).is_in(suppliers(s, d)).df)
query("set_sorted", f"{PART} select row_number() over (order by v) - 1 as addr, v from (select distinct km as v from a where km is not null)")(lambda s, d: NDArray.from_values(counts(s, d).value_set(), 50, "int32").df)

# ---- tables and joins
_NAMES = [f"c{k}" for k in range(50)]
query("table_column", f"{PART} select i0 as addr, k as v from a where i1 = 7")(lambda s, d: sizes(s, d).as_table(_NAMES).column("c7").df)
query("table_frame", f"{PART} select i0, max(case when i1 = 0 then km end) as c0, max(case when i1 = 3 then km end) as c3 from a group by i0")(lambda s, d: counts(s, d).as_table(_NAMES).frame().select("i0", "c0", "c3"))
_BOTH = f"{PART}, {_REF} select a.addr, coalesce(a.km, r.v) as v, r.addr as other from a"
query("join_inner", f"{_BOTH} join r on r.v = a.km")(lambda s, d: counts(s, d).join_values(suppliers(s, d)))
query("join_left", f"{_BOTH} left join r on r.v = a.km")(lambda s, d: counts(s, d).join_values(suppliers(s, d), "left"))
query("join_full", f"{_BOTH} full join r on r.v = a.km")(lambda s, d: counts(s, d).join_values(suppliers(s, d), "full"))
query("join_semi", f"{PART}, {_REF} select addr, km as v from a where km in (select v from r)")(lambda s, d: counts(s, d).join_values(suppliers(s, d), "left_semi"))
query("join_anti", f"{PART}, {_REF} select addr, km as v from a where km is null or km not in (select v from r)")(lambda s, d: counts(s, d).join_values(suppliers(s, d), "left_anti"))


def bounds(spark, sf_dir) -> tuple[NDArray, NDArray]:
    n = table(spark, sf_dir, "nation")
    low = F.col("n_nationkey") * F.col("n_nationkey") / 10.0
    return NDArray.from_table(n, "n_nationkey", low), NDArray.from_table(n, "n_nationkey", low + 5)


query("join_interval", f"{PART} select a.addr, cast(n.n_nationkey as bigint) as other from a join nation n on a.km between n.n_nationkey * n.n_nationkey / 10.0 and n.n_nationkey * n.n_nationkey / 10.0 + 5")(lambda s, d: counts(s, d).join_interval(*bounds(s, d)))


def over_view(spark, sf_dir):
    counts(spark, sf_dir).as_view("tessera_counts")
    return spark.sql("select i1, sum(v) as total from tessera_counts group by i1 having sum(v) > 100")


query("table_view", f"{PART} select i1, cast(sum(km) as bigint) as total from a group by i1 having sum(km) > 100")(over_view)
query("table_json", f"{PART} select addr, to_json({{v: k}}) as json from a")(lambda s, d: sizes(s, d).to_json().select("addr", F.col("json")))

# ---- ranks
for _how, _sql in {"rank": "rank()", "dense_rank": "dense_rank()", "percent_rank": "percent_rank()", "cume_dist": "cume_dist()"}.items():
    query(f"rank_{_how}_axis", f"{PART} select a.addr, round(cast(x.v as double), 9) as v from a left join (select addr, {_sql} over (partition by i0 order by km) as v from a where km is not null) x on x.addr = a.addr")(lambda s, d, how=_how: rounded_cells(counts(s, d).ranking(how, by=(0,)), 9))
query("rank_whole", f"{PART} select a.addr, cast(x.v as int) as v from a left join (select addr, rank() over (order by km) as v from a where km is not null) x on x.addr = a.addr")(lambda s, d: counts(s, d).ranking("rank").df)
query("rank_ntile", f"{PART} select a.addr, cast(x.v as int) as v from a left join (select addr, ntile(4) over (partition by i0 order by km, addr) as v from a where km is not null) x on x.addr = a.addr")(lambda s, d: counts(s, d).ranking("ntile", 4, by=(0,)).df)

# ---- groups
_SUM = "grouping(i0, i1) as gid, round(sum(v), 6) as sum from a group by"
for _name, _sets in {"sets": [(0,), (1,), ()], "cube": None, "rollup": None}.items():
    _sql = {"sets": "grouping sets ((i0), (i1), ())", "cube": "cube (i0, i1)", "rollup": "rollup (i0, i1)"}[_name]
    query(f"group_grid_{_name}", f"{PART} select i0, i1, {_SUM} {_sql}")(lambda s, d, name=_name, sets=_sets: (grid(s, d).grouping_sets(sets, "sum") if sets else getattr(grid(s, d), name)((0, 1), "sum")).select("i0", "i1", "gid", F.round("sum", 6).alias("sum")))
query("group_kernel", f"{PART} select i0 as addr, k as v from a where i1 = 7")(lambda s, d: sizes(s, d).kernel((1,), 7).df)
query("group_block_put", f"{PART} select addr, case when i0 % 2 = 1 and i1 % 5 = 2 and i0 < {_N} // 100 * 2 then (i0 // 2) * 10 + i1 // 5 else k end as v from a")(lambda s, d: (lambda g: g.block_put(7, g.block_pick(7, 2, 5).address().as_type("int32"), 2, 5))(sizes(s, d)).df)
query("group_groups_by", f"{PART}, m as (select i0, row_number() over (order by sum(k), i0) - 1 as j from a group by i0) select m.j * 50 + a.i1 as addr, a.k as v from a join m on m.i0 = a.i0")(lambda s, d: sizes(s, d).groups_by(0, F.sum("v")).df)
_EDGES = [0, 10, 20, 30, 40]
query("group_histogram_object", f"{PART}, g as (select unnest(range(6))::int as b0), h as (select least(floor(km / 10.0), 4)::int + 1 as b0, 1.0 as w from a where km is not null union all select least(floor(k / 10.0), 4)::int + 1, 0.5 from a) select g.b0, coalesce(sum(h.w), 0)::double as n from g left join h using (b0) group by g.b0")(
    lambda s, d: groups.Histogram([_EDGES], offsets=[1]).increment(part(s, d), F.col("km")).add(part(s, d), F.col("k"), weight=F.lit(0.5)).cells(s)
)
query("group_histogram_merged", f"{PART} select least(floor(km / 10.0), 4)::int as b0, (count(*) * 2)::double as n from a where km < 40 group by 1")(lambda s, d: (lambda h: h.merge(h))(groups.Histogram([_EDGES]).increment(part(s, d), F.col("km"))).inner(s))

# ---- lookups by series: five scales of six values, (s + 1) * k * k
_SERIES = """s as (select unnest(range(5)) as s), st as (select s, k, (s + 1) * k * k as lo, (s + 1) * (k + 1) * (k + 1) as hi from s, (select unnest(range(5)) as k)) """


def scales(spark) -> NDArray:
    k = F.col("addr") % 6
    return NDArray.generate(spark, (5, 6), (F.floor(F.col("addr") / 6) + 1) * k * k)


def asked(spark) -> NDArray:
    """Eight places for each series; one is masked."""
    i, j = F.floor(F.col("addr") / 8), F.col("addr") % 8
    return NDArray.generate(spark, (5, 8), F.when(j != 5, i * 3 + j * 7.5 - 2))


_ASKED = "q as (select i * 8 + j as addr, i, j, case when j <> 5 then i * 3 + j * 7.5 - 2 end as x from (select unnest(range(5)) as i), (select unnest(range(8)) as j)) "
query("lookup_series_section", f"with {_SERIES}, x as (select n_nationkey as j, n_nationkey * 2.25 as x from nation) select st.s * 25 + x.j as addr, round(st.k + (x.x - lo) / (hi - lo), 6) as v from x join st on (x.x >= lo or k = 0) and (x.x < hi or k = 4)")(lambda s, d: rounded_cells(scales(s).vectorized_section(NDArray.from_table(table(s, d, "nation"), "n_nationkey", F.col("n_nationkey") * 2.25))))
query("lookup_series_section_linear", f"with {_SERIES}, x as (select n_nationkey as j, n_nationkey * 2.25 as x from nation), f as (select st.s, x.j, arg_min(st.k + (x.x - lo) / (hi - lo), st.k) as v from x join st on x.x between lo and hi group by 1, 2) select s.s * 25 + x.j as addr, round(coalesce(f.v, -1), 6) as v from x cross join s left join f on f.s = s.s and f.j = x.j")(lambda s, d: rounded_cells(scales(s).vectorized_section_linear(NDArray.from_table(table(s, d, "nation"), "n_nationkey", F.col("n_nationkey") * 2.25))))
query("lookup_series_find", f"with {_SERIES}, {_ASKED} select q.addr, round(st.k + (q.x - lo) / (hi - lo), 6) as v from q left join st on st.s = q.i and (q.x >= lo or k = 0) and (q.x < hi or k = 4)")(lambda s, d: rounded_cells(scales(s).vectorized_find_linear_addr(asked(s))))
query("lookup_series_fetch", f"with {_ASKED}, y as (select i, k, (i + 1) * k * k as y from (select unnest(range(5)) as i), (select unnest(range(6)) as k)), p as (select addr, i, x / 8 as x from q) select p.addr, round(a.y * (1 - (p.x - floor(p.x))) + b.y * (p.x - floor(p.x)), 6) as v from p left join y a on a.i = p.i and a.k = floor(p.x) and p.x between 0 and 5 left join y b on b.i = p.i and b.k = ceil(p.x) and p.x between 0 and 5")(lambda s, d: rounded_cells(scales(s).vectorized_fetch_linear_addr(asked(s).with_value(F.col("v") / 8))))

# ---- access, views of other types, operators from the left
query("access_range", f"{PART} select (i0 - 1) * 4 + i1 - 5 as addr, k as v from a where i0 in (1, 2) and i1 between 5 and 8")(lambda s, d: sizes(s, d)[1:3, 5:9].df)
query("access_places", f"{PART} select case i0 when 0 then 1 else 0 end * 50 + i1 as addr, k as v from a where i0 in (0, 2)")(lambda s, d: sizes(s, d)[(2, 0), None].df)
query("access_condition", f"{PART} select row_number() over (order by addr) - 1 as addr, km as v from a where km > 40")(lambda s, d: counts(s, d)[F.col("v") > 40].df)
query("access_cell", f"{PART} select 0::bigint as addr, k as v from a where i0 = 1 and i1 = 3")(lambda s, d: sizes(s, d)[1, 3].df)
query("access_replace_value", f"{PART} select addr, case when km = 8 then -8 else km end as v from a")(lambda s, d: counts(s, d).replace_value(8, -8).df)
query("access_by", "select p.n_nationkey * 5 + q.r_regionkey as addr, cast(p.n_nationkey * q.r_regionkey as double) as v from nation p, region q")(lambda s, d: NDArray.from_table(table(s, d, "nation"), "n_nationkey", "n_nationkey").by(NDArray.from_table(table(s, d, "region"), "r_regionkey", "r_regionkey")).df)
query("access_summation", "select cast(sum(i * j + 1) as double) as v from (select unnest(range(6)) as i), (select unnest(range(4)) as j)")(lambda s, d: access.summation(s, (6, 4), lambda i, j: i * j + 1))
query("access_refer_narrow", f"{PART} select addr * 4 + j as addr, ((km + 70000) >> (8 * j)) & 255 as v from a, (select unnest(range(4)) as j)")(lambda s, d: grid(s, d, F.col("km") + 70000, "int32").refer("uint8").df)
query("access_refer_wide", f"{PART} select a.addr // 2 as addr, cast(a.k as bigint) + cast(b.k as bigint) * 4294967296 as v from a join a b on b.addr = a.addr + 1 where a.addr % 2 = 0")(lambda s, d: sizes(s, d).refer("int64").df)
query("access_fake", f"{PART} select addr, cast(trunc(w) as int) as v from a")(lambda s, d: grid(s, d, "w").fake("int32").df)
query("access_left_operators", f"{PART} select addr, round(3 - w, 6) as v from a")(lambda s, d: rounded_cells(3.0 - grid(s, d, "w")))
query("access_left_bits", f"{PART} select addr, km & 6 as v from a")(lambda s, d: (6 & counts(s, d)).df)
query("access_is_kind_of", f"{PART} select addr, case when km is not null then true end as v from a")(lambda s, d: counts(s, d).is_kind_of("int").df)
query("access_index", f"{PART} select addr, i1 as v from a")(lambda s, d: sizes(s, d).index(1).df)
query("access_address", f"{PART} select addr, addr as v from a")(lambda s, d: sizes(s, d).address().df)
query("access_false", f"{PART} select addr, false as v from a")(lambda s, d: sizes(s, d).false().df)
query("access_test", f"{PART} select addr, km > 10 as v from a")(lambda s, d: counts(s, d).test(lambda v: v > 10).df)
query("access_materialized", f"{PART} select addr, km as v from a")(lambda s, d: counts(s, d).to_ca().df)

# ---- elements, masks and shapes without a query so far
query("element_fill", f"{PART} select addr, 5 as v from a")(lambda s, d: sizes(s, d).fill(5).df)
query("element_zero", f"{PART} select addr, 0 as v from a")(lambda s, d: sizes(s, d).template(0).df)
query("element_one", f"{PART} select addr, 1 as v from a")(lambda s, d: sizes(s, d).template(1).df)
query("element_convert", f"{PART} select addr, km * 2 + 1 as v from a")(lambda s, d: counts(s, d).convert(lambda v: v * 2 + 1).df)
query("element_is_real", f"{PART} select addr, k % 2 = 0 as r from a")(lambda s, d: part(s, d).select("addr", S.is_real(S.cpx(F.col("w"), (F.col("k") % 2).cast("double"))).alias("r")))
query("mask_value", f"{PART} select addr, k as v from a")(lambda s, d: sizes(s, d).with_mask(F.col("v") > 30).value.df)
query("mask_mask", f"{PART} select addr, k > 30 as v from a")(lambda s, d: sizes(s, d).with_mask(F.col("v") > 30).mask.df)
query("index_set", f"{PART} select addr, case when i1 = 3 then true else b end as v from a")(lambda s, d: grid(s, d, "b", "boolean").set_(F.col("i1") == 3).df)
query("index_unset", f"{PART} select addr, case when i1 = 3 then false else b end as v from a")(lambda s, d: grid(s, d, "b", "boolean").unset(F.col("i1") == 3).df)
query("index_copy_cell", f"{PART} select addr, case when addr = 9 then (select k from a where addr = 4) else k end as v from a")(lambda s, d: sizes(s, d).copy_cell(4, 9).df)
query("shape_compact", f"{PART} select i0, i1, k as v from a")(lambda s, d: (lambda g: g.reshape(1, g.shape[0], 1, 50).compact())(sizes(s, d)).indexed().select("i0", "i1", "v"))
query("shape_to_row", f"{PART} select 0::bigint as i0, addr as i1, k as v from a")(lambda s, d: sizes(s, d).to_row().indexed().select("i0", "i1", "v"))
query("shape_to_column", f"{PART} select addr as i0, 0::bigint as i1, k as v from a")(lambda s, d: sizes(s, d).to_column().indexed().select("i0", "i1", "v"))
query("compose_composite", f"{PART} select j * {_N} + addr as addr, k + j as v from a, (select unnest(range(4)) as j)")(lambda s, d: (lambda g: compose.composite((2, 2), [g.with_value(F.col("v") + j) for j in range(4)]))(sizes(s, d)).df)
query("element_hash", f"{PART} select true as same, true as differs from a limit 1")(lambda s, d: (lambda a, b, c: a.join(b.withColumnRenamed("v", "w"), how="cross").join(c.withColumnRenamed("v", "x"), how="cross").select((F.col("v") == F.col("w")).alias("same"), (F.col("v") != F.col("x")).alias("differs")))(counts(s, d).content_hash(), counts(s, d).like(counts(s, d).df.repartition(3)).content_hash(), counts(s, d).replace_value(8, 9).content_hash()))


# ---- sources: written to the shared folder and read again
def csv_round(spark, sf_dir):
    path = shared_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "nation"), path)
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


def array_round(spark, sf_dir):
    path, a = shared_path(spark, "array"), counts(spark, sf_dir)
    a.attributes["unit"] = "pieces"
    files.save(a, path)
    back = files.load(spark, path)
    return back.df.select("addr", "v", F.lit(len(back.shape)).alias("axes"), F.lit(back.attributes["unit"]).alias("unit"))


def container_round(spark, sf_dir):
    path = shared_path(spark, "container")
    container.save(counts(spark, sf_dir), path)
    return container.read(spark, path, "int32").select("addr", "v")


def container_parts(spark, sf_dir):
    path, a = shared_path(spark, "containers"), counts(spark, sf_dir)
    container.save_parts(a, path, cells=300)
    return container.load_parts(spark, path, a.shape, "int32").df


def binary_round(spark, sf_dir):
    a = sizes(spark, sf_dir)
    return container.from_binary(spark, container.to_binary(a), a.shape, "int32").df


def jdbc_round(spark, sf_dir):
    """A database that each executor has a copy of, as an embedded one is its own JVM's."""
    url = files.embed_jdbc(table(spark, sf_dir, "nation"), "nation")
    got = files.read_jdbc(spark, url, "nation", "n_nationkey", (0, 25), 4, driver=files.DERBY)
    return got.select(*[F.col(c).alias(c.lower()) for c in got.columns])


def image_cells(spark, sf_dir):
    path = shared_path(spark, "image") + "/one.png"
    files.write_image(NDArray.generate(spark, (3, 4, 3), F.col("addr"), "uint8"), path)
    return files.image_cells(files.read_image(spark, path)).select("addr", "v")


query("source_csv", "select n_nationkey, n_name, n_regionkey from nation")(csv_round)
query("source_csv_lines", "select n_nationkey || ',' || n_name || ',' || n_regionkey as line from nation")(lambda s, d: files.csv_lines(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")))
query("source_array", f"{PART} select addr, km as v, 2 as axes, 'pieces' as unit from a")(array_round)
query("source_container", f"{PART} select addr, km as v from a")(container_round)
query("source_container_parts", f"{PART} select addr, km as v from a")(container_parts)
query("source_binary", f"{PART} select addr, k as v from a")(binary_round)
query("source_jdbc", "select n_nationkey, n_name, n_regionkey from nation")(jdbc_round)
query("source_image", "select i as addr, cast(i as smallint) as v from (select unnest(range(36)) as i)")(image_cells)

# ---- streams
query("stream_sliding", "with w as (select *, unnest([0, 1]) as j from events) select time_bucket(interval 30 minute, ts) - j * interval 30 minute as start, count(*) as n, round(sum(value), 4) as total from w group by 1")(lambda s, d: streams.windowed(table(s, d, "events"), "ts", "1 hour", "30 minutes").select("start", "n", F.round("total", 4).alias("total")))


# ---- plans that small tables otherwise don't reach
def forced(name: str, call, sql: str):
    """A query with the limits of small arrays lowered, so that the distributed branch runs."""

    def run(spark, sf_dir):
        from .operators import prefix

        held = prefix.LEAST_RANGE, prefix.LEAST_STRETCH, prefix.MOST_STRETCH, prefix.MOST_TOTALS
        prefix.LEAST_RANGE, prefix.LEAST_STRETCH, prefix.MOST_STRETCH, prefix.MOST_TOTALS = 300, 64, 64, 8
        try:
            return call(spark, sf_dir)
        finally:
            prefix.LEAST_RANGE, prefix.LEAST_STRETCH, prefix.MOST_STRETCH, prefix.MOST_TOTALS = held

    query(name, sql)(run)


_FRAME = "over (order by addr rows between unbounded preceding and current row)"
forced("distributed_cumsum", lambda s, d: rounded_cells(vector(s, d, "events").cumsum(), 4), f"{EVENTS} select addr, round(coalesce(sum(v) {_FRAME}, 0), 4) as v from e")
forced("distributed_cummax", lambda s, d: rounded_cells(vector(s, d, "events").cummax(), 4), f"{EVENTS} select addr, round(coalesce(max(v) {_FRAME}, (select arg_min(v, addr) from e where v is not null)), 4) as v from e")
forced("distributed_dimcumcount", lambda s, d: grid(s, d).dimcumcount(1).df, f"{PART} select addr, count(v) over (partition by i0 order by i1 rows between unbounded preceding and current row) as v from a")
forced("distributed_rank", lambda s, d: vector(s, d, "events").order().df, f"{EVENTS} select e.addr, r.n as v from e left join (select addr, row_number() over (order by v, addr) - 1 as n from e where v is not null) r on r.addr = e.addr")
forced("distributed_moving_mean", lambda s, d: rounded_cells(vector(s, d, "events").windows("mean", (-2, 2), bounds="mask"), 4), f"{EVENTS} select addr, round(avg(v) over (order by addr rows between 2 preceding and 2 following), 4) as v from e")
forced("distributed_moving_periodic", lambda s, d: rounded_cells(vector(s, d, "events").windows("sum", (-2, 0), bounds="periodic"), 4), f"{EVENTS}, n as (select count(*) as n from e), x as (select addr, v from e union all select addr - n, v from e, n where addr >= n - 2) select addr, round(s, 4) as v from (select addr, sum(v) over (order by addr rows between 2 preceding and current row) as s from x) where addr >= 0")
forced("distributed_percentile", lambda s, d: rounded_cells(vector(s, d, "events").percentile(0, 10, 33.5, 50, 90, 100)), f"{EVENTS} select unnest([0::bigint, 1, 2, 3, 4, 5]) as addr, round(unnest(quantile_cont(v, [0, 0.1, 0.335, 0.5, 0.9, 1])), 6) as v from e")
forced("distributed_section", lambda s, d: rounded_cells(vector(s, d, "events").with_value(F.col("addr") / 4).section(vector(s, d, "events")), 6), f"{EVENTS} select addr, round(v * 4, 6) as v from e")
forced("distributed_duplicates", lambda s, d: counts(s, d).duplicated_values(), f"{PART} select km as value, addr, n from (select km, addr, row_number() over (partition by km order by addr) - 1 as n from a where km is not null) where n > 0")
forced("distributed_sort", lambda s, d: vector(s, d).sort().df, f"{ORDERS}, r as (select v, row_number() over (order by v, addr) as n from o where v is not null), p as (select addr, row_number() over (order by addr) as n from o where v is not null) select o.addr, r.v from o left join p on p.addr = o.addr left join r on r.n = p.n")
