"""Aggregates over notices and awards (A), windows and pages (W, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendril.catalog import query
from tendril.operators import relational as R
from tendril.plans.views import AS_OF, BUY, LINE, OPP, SUP, buyers, lines, money, opportunities, sql_money, suppliers


@query("a01_month_series", f"""with {OPP}, cal as (select unnest(generate_series(date_trunc('month', (select min(published) from opp)), date_trunc('month', (select max(published) from opp)), interval 1 month)) m)
select strftime(m, '%Y-%m-%d') "month", count(id) n, count(id) filter (priority = '1-URGENT') urgent from cal left join opp on date_trunc('month', published) = m group by m""")
def a01(s: SparkSession, d: str) -> DataFrame:
    """Notices by month over an unbroken calendar, urgent ones beside."""
    out = R.zero_filled_months(opportunities(s, d), "published", n=F.count("*"), urgent=F.count_if(F.col("priority") == "1-URGENT"))
    return out.select(F.col("month").cast("string").alias("month"), "n", "urgent")


@query("a02_top_countries_other", f"""with {OPP}, {BUY}, c as (select country, count(*) n from opp left join buy using (buyer) group by country),
r as (select *, case when country is not null then row_number() over (order by country is null, n desc, country) end k from c)
select case when k <= 15 then country else 'OTHER' end country, cast(sum(n) as bigint) n from r group by 1""")
def a02(s: SparkSession, d: str) -> DataFrame:
    """Notices of the 15 most frequent countries and of all others."""
    counts = opportunities(s, d).join(buyers(s, d).select("buyer", "country"), "buyer", "left").groupBy("country").agg(F.count("*").alias("n"))
    return R.top_n_and_other(counts, "country", "n", 15)


@query("a03_per_status", f"with {OPP} select status, count(*) n, cast(min(published) as varchar) first_day, cast(max(published) as varchar) last_day, count(amount) stated from opp group by status")
def a03(s: SparkSession, d: str) -> DataFrame:
    """Count, span and stated values for each source (here status)."""
    return opportunities(s, d).groupBy("status").agg(F.count("*").alias("n"), F.min("published").cast("string").alias("first_day"), F.max("published").cast("string").alias("last_day"), F.count("amount").alias("stated"))


@query("a04_response_window", f"""with {OPP}, {LINE}, w as (select date_diff('day', published, shipped) as days from line join opp using (id) where date_diff('day', published, shipped) between 0 and 1095)
select quantile_disc(days, 0.25) q1, quantile_disc(days, 0.5) q2, quantile_disc(days, 0.75) q3, count(*) n from w""")
def a04(s: SparkSession, d: str) -> DataFrame:
    """Discrete quartiles of the days from publication to delivery, 0 to 1095."""
    w = lines(s, d).select("id", "shipped").join(opportunities(s, d).select("id", "published"), "id").select(F.datediff("shipped", "published").cast("long").alias("days")).where("days between 0 and 1095")
    q = F.expr("percentile_disc(0.25) within group (order by days)"), F.expr("percentile_disc(0.5) within group (order by days)"), F.expr("percentile_disc(0.75) within group (order by days)")
    return w.agg(*[c.cast("long").alias(f"q{i + 1}") for i, c in enumerate(q)], F.count("*").alias("n"))


@query("a05_median", f"with {OPP} select status, round(quantile_cont(amount, 0.5), 4) median from opp group by status")
def a05(s: SparkSession, d: str) -> DataFrame:
    """Continuous median of the values."""
    return opportunities(s, d).groupBy("status").agg(F.round(F.expr("percentile_cont(0.5) within group (order by amount)"), 4).alias("median"))


@query("a06_groups_once", f"with {LINE}, g as (select distinct id, substr(code, 1, 3) grp from line) select grp, count(*) n from g group by grp order by n desc, grp limit 12")
def a06(s: SparkSession, d: str) -> DataFrame:
    """The twelve commonest code groups, a notice once for each."""
    return lines(s, d).select("id", F.substring("code", 1, 3).alias("grp")).distinct().groupBy("grp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "grp").limit(12)


@query("a08_buyer_profile", f"""with {OPP}, {BUY} select buyer, country, count(*) n, count(*) filter (status = 'O') open_n, {sql_money('amount')} total, cast(min(published) as varchar) first_day, cast(max(published) as varchar) last_day from opp join buy using (buyer) group by buyer, country""")
def a08(s: SparkSession, d: str) -> DataFrame:
    """Counts, open notices, total and span for each buyer."""
    return opportunities(s, d).join(buyers(s, d).select("buyer", "country"), "buyer").groupBy("buyer", "country").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "O").alias("open_n"), money("amount").alias("total"), F.min("published").cast("string").alias("first_day"), F.max("published").cast("string").alias("last_day"))


@query("a09_month_gaps", f"""with {OPP}, b as (select status, date_trunc('month', min(published)) a, date_trunc('month', max(published)) z from opp group by status),
grid as (select status, unnest(generate_series(a + interval 1 month, z - interval 1 month, interval 1 month)) m from b),
n as (select g.status, m, count(o.id) n from grid g left join opp o on o.status = g.status and date_trunc('month', o.published) = m group by g.status, m),
h as (select status, quantile_cont(n, 0.5) med, count(*) as months from n group by status)
select n.status, strftime(m, '%Y-%m-%d') "month", n.n from n join h using (status) where months >= 3 and n.n < 0.5 * med""")
def a09(s: SparkSession, d: str) -> DataFrame:
    """Whole months with less than half the median month of their source."""
    opp = opportunities(s, d)
    ends = opp.groupBy("status").agg(F.trunc(F.min("published"), "month").alias("a"), F.trunc(F.max("published"), "month").alias("z"))
    grid = ends.where("add_months(a, 1) <= add_months(z, -1)").select("status", F.explode(F.expr("sequence(add_months(a, 1), add_months(z, -1), interval 1 month)")).alias("month"))
    n = grid.join(opp.groupBy("status", F.trunc("published", "month").alias("month")).agg(F.count("*").alias("n")), ["status", "month"], "left").na.fill(0, ["n"])
    med = n.groupBy("status").agg(F.expr("percentile_cont(0.5) within group (order by n)").alias("med"), F.count("*").alias("months"))
    return n.join(med, "status").where("months >= 3 and n < 0.5 * med").select("status", F.col("month").cast("string").alias("month"), "n")


@query("a10_summary_grouping_sets", f"""with {LINE}, {SUP} select substr(code, 1, 2) division, country, count(distinct winner) winners, count(distinct id) notices, count(distinct id) filter (kind = 'R') returned, cast(grouping(substr(code, 1, 2), country) as bigint) g
from line join sup using (winner) group by grouping sets ((substr(code, 1, 2), country), (substr(code, 1, 2)), (country), ())""")
def a10(s: SparkSession, d: str) -> DataFrame:
    """Distinct winners and notices by division and country, and all totals. Lines are first brought to the distinct
    winners and notices of a cell, which are far fewer, so that the four totals expand those only."""
    rows = lines(s, d).join(suppliers(s, d).select("winner", "country"), "winner").select(F.substring("code", 1, 2).alias("division"), "country", "winner", "id", (F.col("kind") == "R").alias("back"))
    winners = rows.select("division", "country", "winner").distinct().cube("division", "country").agg(F.count_distinct("winner").alias("winners"), F.grouping_id().alias("g"))
    notices = rows.groupBy("division", "country", "id").agg(F.max("back").alias("back")).cube("division", "country").agg(F.count_distinct("id").alias("notices"), F.count_distinct(F.when(F.col("back"), F.col("id"))).alias("returned"), F.grouping_id().alias("g2"))
    n = notices.withColumnsRenamed({"division": "d2", "country": "c2"})
    both = winners.join(n, F.col("division").eqNullSafe(F.col("d2")) & F.col("country").eqNullSafe(F.col("c2")) & (F.col("g") == F.col("g2")))
    return both.select("division", "country", "winners", "notices", "returned", F.col("g").cast("long").alias("g"))


@query("a12_distinct_key", f"with {LINE}, {OPP} select priority, count(distinct coalesce(case when kind = 'R' then concat('p:', winner) end, concat('n:', id))) n from line join opp using (id) group by priority")
def a12(s: SparkSession, d: str) -> DataFrame:
    """Distinct procurements by the first key that is there."""
    key = F.coalesce(F.when(F.col("kind") == "R", F.concat(F.lit("p:"), "winner")), F.concat(F.lit("n:"), "id"))
    return lines(s, d).join(opportunities(s, d).select("id", "priority"), "id").groupBy("priority").agg(F.count_distinct(key).alias("n"))


@query("a13_best_value", f"""with {LINE}, b as (select *, row_number() over (partition by winner, id order by case kind when 'A' then 0 when 'N' then 1 else 2 end, amount desc, part, nr) k from line)
select kind, count(*) n, {sql_money('amount')} total from b where k = 1 group by kind""")
def a13(s: SparkSession, d: str) -> DataFrame:
    """The best value of each winner and notice (kind before amount), summed by kind."""
    rank = F.expr("case kind when 'A' then 0 when 'N' then 1 else 2 end")
    return R.distinct_on(lines(s, d), ["winner", "id"], [rank, F.desc("amount"), F.col("part"), F.col("nr")]).groupBy("kind").agg(F.count("*").alias("n"), money("amount").alias("total"))


@query("a15_largest", f"with {LINE}, r as (select kind, id, part, nr, amount, row_number() over (partition by kind order by amount desc, id, part, nr) k from line) select kind, id, part, amount, cast(k as bigint) k from r where k <= 10")
def a15(s: SparkSession, d: str) -> DataFrame:
    """The ten largest contracts of each kind."""
    return R.top_k(lines(s, d).select("kind", "id", "part", "nr", "amount"), ["kind"], [F.desc("amount"), F.col("id"), F.col("part"), F.col("nr")], 10, "k").select("kind", "id", "part", "amount", F.col("k").cast("long").alias("k"))


@query("a16_mode", f"with {OPP}, c as (select buyer, priority, count(*) n from opp group by buyer, priority), r as (select *, row_number() over (partition by buyer order by n desc, priority) k from c) select buyer, priority mode from r where k = 1")
def a16(s: SparkSession, d: str) -> DataFrame:
    """The commonest priority of each buyer, the smallest of equals."""
    return R.mode_of(opportunities(s, d), ["buyer"], "priority")


@query("a17_flags", f"with {LINE} select winner, bool_or(kind = 'R') any_returned, bool_and(state = 'F') all_final, array_to_string(list_sort(list(distinct substr(code, 1, 2))), ',') divisions from line group by winner")
def a17(s: SparkSession, d: str) -> DataFrame:
    """Whether any and whether all, and the sorted set of divisions."""
    return lines(s, d).groupBy("winner").agg(F.bool_or(F.col("kind") == "R").alias("any_returned"), F.bool_and(F.col("state") == "F").alias("all_final"), F.array_join(F.array_sort(F.collect_set(F.substring("code", 1, 2))), ",").alias("divisions"))


@query("a18_first_by_preference", f"with {LINE}, r as (select id, code, row_number() over (partition by id order by amount desc, part desc, nr desc) k from line where kind <> 'R') select id, code from r where k = 1")
def a18(s: SparkSession, d: str) -> DataFrame:
    """The code of the most valuable line of a notice, returned lines left out."""
    return lines(s, d).where("kind <> 'R'").groupBy("id").agg(F.max_by("code", F.struct("amount", "part", "nr")).alias("code"))


@query("a19_market_money", f"with {LINE}, {SUP} select country, kind, {sql_money('amount')} total, count(*) n from line join sup using (winner) group by country, kind")
def a19(s: SparkSession, d: str) -> DataFrame:
    """Totals by country and kind."""
    return lines(s, d).join(suppliers(s, d).select("winner", "country"), "winner").groupBy("country", "kind").agg(money("amount").alias("total"), F.count("*").alias("n"))


@query("a20_supplier_list", f"with {LINE} select winner, count(distinct id) n, cast(min(year(shipped)) as bigint) first_year, cast(max(year(shipped)) as bigint) last_year from line group by winner")
def a20(s: SparkSession, d: str) -> DataFrame:
    """Procurements and years of each supplier."""
    return lines(s, d).groupBy("winner").agg(F.count_distinct("id").alias("n"), F.min(F.year("shipped")).cast("long").alias("first_year"), F.max(F.year("shipped")).cast("long").alias("last_year"))


@query("a21_supplier_profile", f"with {LINE} select winner, cast(year(shipped) as bigint) y, count(distinct id) n, {sql_money('amount')} total, cast(sum(count(distinct id)) over (partition by winner order by year(shipped)) as bigint) so_far from line group by winner, year(shipped)")
def a21(s: SparkSession, d: str) -> DataFrame:
    """A supplier's years with a running count."""
    by = lines(s, d).groupBy("winner", F.year("shipped").cast("long").alias("y")).agg(F.count_distinct("id").alias("n"), money("amount").alias("total"))
    return by.withColumn("so_far", F.sum("n").over(Window.partitionBy("winner").orderBy("y")))


@query("a22_family_totals", f"with {OPP}, {BUY}, o as (select buyer, count(*) n, count(*) filter (status = 'O') open_n from opp group by buyer) select family, count(*) buyers, cast(sum(n) as bigint) n, cast(sum(open_n) as bigint) open_n from o join buy using (buyer) group by family")
def a22(s: SparkSession, d: str) -> DataFrame:
    """Aggregates of each buyer, then of its family."""
    one = opportunities(s, d).groupBy("buyer").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "O").alias("open_n"))
    return one.join(buyers(s, d).select("buyer", "family"), "buyer").groupBy("family").agg(F.count("*").alias("buyers"), F.sum("n").alias("n"), F.sum("open_n").alias("open_n"))


@query("a24_demand_map", f"""with {OPP}, {BUY}, {LINE}, f as (select distinct o.id, b.country, o.buyer, o.published, o.priority from line l join opp o on o.id = l.id join buy b on b.buyer = o.buyer where l.code like '34%' or l.code like '35%'),
c as (select country, count(distinct id) n, count(distinct id) filter (priority = '1-URGENT') urgent, count(distinct buyer) buyers, max(published) latest from f group by country)
select *exclude(latest), cast(latest as varchar) latest, (select count(distinct id) from f) total from c""")
def a24(s: SparkSession, d: str) -> DataFrame:
    """Demand for two divisions by country beside the total."""
    ids = lines(s, d).where("code like '34%' or code like '35%'").select("id").distinct()
    f = opportunities(s, d).join(ids, "id").join(buyers(s, d).select("buyer", "country"), "buyer")
    by = f.groupBy("country").agg(F.count("*").alias("n"), F.count_if(F.col("priority") == "1-URGENT").alias("urgent"), F.count_distinct("buyer").alias("buyers"), F.max("published").cast("string").alias("latest"))
    return by.crossJoin(F.broadcast(f.agg(F.count("*").alias("total"))))


@query("a25_growing", f"""with {LINE}, p as (select winner, id, max(shipped) shipped from line group by winner, id), w as (select winner, count(*) filter (shipped > date '{AS_OF}' - 365 and shipped <= date '{AS_OF}') recent, count(*) filter (shipped > date '{AS_OF}' - 730 and shipped <= date '{AS_OF}' - 365) prior from p group by winner)
select winner, recent, prior from w where recent >= 2 and recent > prior""")
def a25(s: SparkSession, d: str) -> DataFrame:
    """Winners with more procurements in the last 365 days than in the 365 before."""
    one = lines(s, d).groupBy("winner", "id").agg(F.max("shipped").alias("shipped"))
    span = lambda a, b: F.expr(f"shipped > date_sub(date'{AS_OF}', {a}) and shipped <= date_sub(date'{AS_OF}', {b})")
    return one.groupBy("winner").agg(F.count_if(span(365, 0)).alias("recent"), F.count_if(span(730, 365)).alias("prior")).where("recent >= 2 and recent > prior")


@query("a26_network_directory", f"with {LINE}, {SUP} select winner, country, count(distinct id) projects, count(distinct id) filter (nr = 1) led, {sql_money('amount')} total, cast(min(year(shipped)) as bigint) first_year, cast(max(year(shipped)) as bigint) last_year, count(distinct kind) kinds from line join sup using (winner) group by winner, country")
def a26(s: SparkSession, d: str) -> DataFrame:
    """Directory of organisations in projects."""
    return lines(s, d).join(suppliers(s, d).select("winner", "country"), "winner").groupBy("winner", "country").agg(F.count_distinct("id").alias("projects"), F.count_distinct(F.when(F.col("nr") == 1, F.col("id"))).alias("led"), money("amount").alias("total"), F.min(F.year("shipped")).cast("long").alias("first_year"), F.max(F.year("shipped")).cast("long").alias("last_year"), F.count_distinct("kind").alias("kinds"))


@query("a28_funding_by_programme", f"with {LINE} select winner, substr(code, 1, 2) programme, {sql_money('amount')} total, count(*) filter (discount = 0) without_n from line group by 1, 2")
def a28(s: SparkSession, d: str) -> DataFrame:
    """Funding of each organisation by programme, entries without contribution beside."""
    return lines(s, d).groupBy("winner", F.substring("code", 1, 2).alias("programme")).agg(money("amount").alias("total"), F.count_if(F.col("discount") == 0).alias("without_n"))


@query("a30_scope_counts", f"with {OPP}, {LINE}, c as (select id, bool_or(code like '35%') core, bool_or(code like '3%') relevant from line group by id) select count(*) filter (core) core_n, count(*) filter (relevant and not core) supply_n, count(*) filter (relevant) relevant_n, count(*) all_n from opp left join c using (id)")
def a30(s: SparkSession, d: str) -> DataFrame:
    """Notices in each scope."""
    c = lines(s, d).groupBy("id").agg(F.bool_or(F.col("code").startswith("35")).alias("core"), F.bool_or(F.col("code").startswith("3")).alias("relevant"))
    return opportunities(s, d).select("id").join(c, "id", "left").agg(F.count_if("core").alias("core_n"), F.count_if(F.expr("relevant and not core")).alias("supply_n"), F.count_if("relevant").alias("relevant_n"), F.count("*").alias("all_n"))


@query("a31_capped_count", f"with {OPP} select least(count(*), 1000) n from opp where status = 'O'")
def a31(s: SparkSession, d: str) -> DataFrame:
    """Open notices, counted up to a thousand only."""
    return R.capped_count(opportunities(s, d).where("status = 'O'"), 1000)


@query("a32_mosaic", f"""with {LINE}, {SUP}, cell as (select distinct winner, country, substr(code, 1, 2) division from line join sup using (winner)), n as (select country, division, count(*) k from cell group by 1, 2)
select winner, min(k) smallest_cell from cell join n using (country, division) group by winner having min(k) >= 2""")
def a32(s: SparkSession, d: str) -> DataFrame:
    """Winners all of whose cells of country and division hold two or more."""
    cells = lines(s, d).select("winner", F.substring("code", 1, 2).alias("division")).distinct().join(suppliers(s, d).select("winner", "country"), "winner")
    return R.k_anonymous(cells, "winner", ["country", "division"], 2)


@query("a33_share", f"""with {LINE}, t as (select winner, substr(code, 1, 2) division, sum(cast(amount as decimal(18,2))) v from line group by 1, 2)
select winner, division, round(cast(v as double) / cast(sum(v) over (partition by division) as double), 6) share from t""")
def a33(s: SparkSession, d: str) -> DataFrame:
    """A winner's share of each division."""
    v = lines(s, d).groupBy("winner", F.substring("code", 1, 2).alias("division")).agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("v"))
    total = v.groupBy("division").agg(F.sum("v").alias("t"))
    return v.join(total, "division").select("winner", "division", F.round(F.col("v").cast("double") / F.col("t").cast("double"), 6).alias("share"))


@query("a34_coverage", f"with {OPP}, {BUY} select country, count(*) n, count(*) filter (amount > 100000) valued from opp join buy using (buyer) group by country")
def a34(s: SparkSession, d: str) -> DataFrame:
    """How many notices of each country state a value worth naming."""
    return opportunities(s, d).join(buyers(s, d).select("buyer", "country"), "buyer").groupBy("country").agg(F.count("*").alias("n"), F.count_if(F.col("amount") > 100000).alias("valued"))


@query("a35_pulse", f"with {OPP}, m as (select max(published) t from opp) select count(*) filter (published > t - 30) last_30, count(*) filter (published > t - 60 and published <= t - 30) prior_30, count(*) filter (deadline between t and t + 14) closing from opp, m")
def a35(s: SparkSession, d: str) -> DataFrame:
    """The last 30 days, the 30 before, and what closes in 14."""
    opp = opportunities(s, d)
    now = opp.agg(F.max("published").alias("t"))
    return opp.crossJoin(F.broadcast(now)).agg(F.count_if(F.expr("published > date_sub(t, 30)")).alias("last_30"), F.count_if(F.expr("published > date_sub(t, 60) and published <= date_sub(t, 30)")).alias("prior_30"), F.count_if(F.expr("deadline between t and date_add(t, 14)")).alias("closing"))


@query("a36_completeness", f"""with {OPP}, {LINE}, a as (select published d, count(*) landed from opp group by 1), b as (select shipped d, count(distinct id) official from line group by 1)
select cast(coalesce(a.d, b.d) as varchar) d, coalesce(landed, 0) landed, coalesce(official, 0) official, round(coalesce(landed, 0) / cast(nullif(coalesce(official, 0), 0) as double), 4) ratio from a full join b on a.d = b.d""")
def a36(s: SparkSession, d: str) -> DataFrame:
    """Landed against official totals of each day."""
    a = opportunities(s, d).groupBy(F.col("published").alias("d")).agg(F.count("*").alias("landed"))
    b = lines(s, d).groupBy(F.col("shipped").alias("d")).agg(F.count_distinct("id").alias("official"))
    return a.join(b, "d", "full").na.fill(0, ["landed", "official"]).select(F.col("d").cast("string").alias("d"), "landed", "official", F.round(F.expr("landed / cast(nullif(official, 0) as double)"), 4).alias("ratio"))


@query("a37_evaluation", f"with {OPP}, e as (select priority, amount > 200000 predicted, status = 'F' actual from opp) select priority, count(*) filter (predicted and actual) tp, count(*) filter (predicted and not actual) fp, count(*) filter (not predicted and actual) fn, round(count(*) filter (predicted and actual) / cast(nullif(count(*) filter (predicted), 0) as double), 6) precision_ from e group by priority")
def a37(s: SparkSession, d: str) -> DataFrame:
    """Precision of a rule against known cases, by kind."""
    e = opportunities(s, d).select("priority", (F.col("amount") > 200000).alias("p"), (F.col("status") == "F").alias("a"))
    return e.groupBy("priority").agg(F.count_if(F.expr("p and a")).alias("tp"), F.count_if(F.expr("p and not a")).alias("fp"), F.count_if(F.expr("not p and a")).alias("fn"), F.round(F.expr("count_if(p and a) / cast(nullif(count_if(p), 0) as double)"), 6).alias("precision_"))


@query("a38_greatest_then_sum", f"with {LINE}, p as (select id, winner, max(quantity) q from line group by id, winner) select winner, round(sum(q), 2) persons from p group by winner")
def a38(s: SparkSession, d: str) -> DataFrame:
    """The greatest figure of a procedure, then the sum over procedures."""
    return lines(s, d).groupBy("id", "winner").agg(F.max("quantity").alias("q")).groupBy("winner").agg(F.round(F.sum("q"), 2).alias("persons"))


@query("a39_visits", "with m as (select max(ts) t from events) select event_type, count(*) filter (ts > t - interval 1 day) day_n, count(*) filter (ts > t - interval 7 day) week_n, count(*) all_n from events, m group by event_type")
def a39(s: SparkSession, d: str) -> DataFrame:
    """Events of the last day, week and all time."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_type", "ts")
    now = e.agg(F.max("ts").alias("t"))
    return e.crossJoin(F.broadcast(now)).groupBy("event_type").agg(F.count_if(F.expr("ts > t - interval 1 day")).alias("day_n"), F.count_if(F.expr("ts > t - interval 7 days")).alias("week_n"), F.count("*").alias("all_n"))


@query("w01_latest_per_country", f"with {OPP}, {BUY}, r as (select country, id, published, row_number() over (partition by country order by published desc nulls last, id desc) k from opp join buy using (buyer)) select country, id, cast(published as varchar) published, cast(k as bigint) k from r where k <= 3")
def w01(s: SparkSession, d: str) -> DataFrame:
    """The three latest notices of each country."""
    rows = opportunities(s, d).join(buyers(s, d).select("buyer", "country"), "buyer").select("country", "id", "published")
    return R.top_k(rows, ["country"], [F.desc_nulls_last("published"), F.desc("id")], 3, "k").select("country", "id", F.col("published").cast("string").alias("published"), F.col("k").cast("long").alias("k"))


@query("w02_page_with_total", f"with {OPP} select id, amount, count(*) over () total from opp where status = 'P' order by amount desc, id limit 20")
def w02(s: SparkSession, d: str) -> DataFrame:
    """A page of the most valuable partial notices with the number of all."""
    rows = opportunities(s, d).where("status = 'P'").select("id", "amount")
    return R.with_total(rows).orderBy(F.desc("amount"), "id").limit(20)


@query("w03_plan_rank", f"with {OPP} select buyer, id, row_number() over (partition by buyer order by published, id) - 1 place from opp")
def w03(s: SparkSession, d: str) -> DataFrame:
    """The place of each notice among those of its buyer, from 0."""
    return opportunities(s, d).select("buyer", "id", (F.row_number().over(Window.partitionBy("buyer").orderBy("published", "id")) - 1).cast("long").alias("place"))


@query("w04_max_beside", f"with {LINE}, r as (select winner, id, amount, max(amount) over (partition by winner) most, row_number() over (partition by winner order by amount, id, part, nr) k from line) select winner, id, amount, most from r where k = 1")
def w04(s: SparkSession, d: str) -> DataFrame:
    """A winner's smallest line beside its greatest amount."""
    g = lines(s, d).groupBy("winner").agg(F.min(F.struct("amount", "id", "part", "nr")).alias("f"), F.max("amount").alias("most"))
    return g.select("winner", "f.id", "f.amount", "most")


@query("w05_distinct_on", f"with {LINE} select distinct on (id) id, code, amount from line order by id, amount desc, part, nr")
def w05(s: SparkSession, d: str) -> DataFrame:
    """One line of each notice: the most valuable."""
    return R.distinct_on(lines(s, d), ["id"], [F.desc("amount"), F.col("part"), F.col("nr")]).select("id", "code", "amount")


@query("w06_previous", "select user_id, event_id, lag(value) over (partition by user_id order by ts, event_id) previous, round(value - lag(value) over (partition by user_id order by ts, event_id), 4) change from events")
def w06(s: SparkSession, d: str) -> DataFrame:
    """Each entry beside the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.lag("value").over(w).alias("previous"), F.round(F.col("value") - F.lag("value").over(w), 4).alias("change"))


@query("l01_order", f"with {OPP} select id, cast(deadline as varchar) deadline, amount from opp order by deadline asc nulls last, amount desc, id limit 50")
def l01(s: SparkSession, d: str) -> DataFrame:
    """The fifty notices that close first."""
    return opportunities(s, d).orderBy(F.asc_nulls_last("deadline"), F.desc("amount"), "id").limit(50).select("id", F.col("deadline").cast("string").alias("deadline"), "amount")


@query("l01_places", f"with {OPP} select id, cast(deadline as varchar) deadline, amount, row_number() over (order by deadline asc nulls last, amount desc, id) place from opp")
def l01_places(s: SparkSession, d: str) -> DataFrame:
    """Every notice with its place in the order in which they close."""
    rows = R.ranked(opportunities(s, d).select("id", "deadline", "amount"), [F.asc_nulls_last("deadline"), F.desc("amount"), F.col("id")])
    return rows.select("id", F.col("deadline").cast("string").alias("deadline"), "amount", "place")


@query("l03_two_part", f"with {OPP} select id, case when status = 'O' then 0 else 1 end part from opp order by part, case when status = 'O' then deadline end asc, case when status <> 'O' then deadline end desc, id limit 40 offset 7300")
def l03(s: SparkSession, d: str) -> DataFrame:
    """A page that may span the open part (soonest first) and the rest (latest first)."""
    rows = opportunities(s, d).withColumn("part", F.when(F.col("status") == "O", 0).otherwise(1))
    order = [F.col("part"), F.asc(F.when(F.col("part") == 0, F.col("deadline"))), F.desc(F.when(F.col("part") == 1, F.col("deadline"))), F.col("id")]
    return rows.orderBy(*order).offset(7300).limit(40).select("id", "part")


@query("l04_page", f"with {OPP} select id, amount from opp order by amount desc, id limit 25 offset 75")
def l04(s: SparkSession, d: str) -> DataFrame:
    """Page four of the most valuable notices."""
    return R.page(opportunities(s, d).select("id", "amount"), [F.desc("amount"), F.col("id")], 4, 25)


@query("l05_keyset", f"with {OPP} select id, buyer, status from opp where id < 9000 order by id desc limit 500")
def l05(s: SparkSession, d: str) -> DataFrame:
    """The next 500 rows of an export below the cursor."""
    return R.keyset_page(opportunities(s, d).select("id", "buyer", "status"), "id", 9000, 500)


@query("l06_stored_order", f"with {LINE}, v as (select winner, {sql_money('amount')} total from line group by winner) select winner, total, row_number() over (order by total desc, winner) place from v")
def l06(s: SparkSession, d: str) -> DataFrame:
    """Winners by value with their place, to be stored."""
    v = lines(s, d).groupBy("winner").agg(money("amount").alias("total"))
    return R.ranked(v, [F.desc("total"), F.col("winner")])


@query("l07_calendar", f"with {OPP} select cast(deadline as varchar) deadline, count(*) n, min(id) first_id from opp where status = 'O' group by deadline order by deadline desc limit 60")
def l07(s: SparkSession, d: str) -> DataFrame:
    """Open notices by closing day, the last sixty days."""
    return opportunities(s, d).where("status = 'O'").groupBy("deadline").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).orderBy(F.desc("deadline")).limit(60).select(F.col("deadline").cast("string").alias("deadline"), "n", "first_id")
