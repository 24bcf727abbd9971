"""Joins (J), set operations (U), entity resolution (R) and history (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendril.catalog import query
from tendril.operators import relational as R
from tendril.plans.views import BUY, LINE, OPP, SUP, buyers, lines, money, opportunities, sql_money, suppliers
from tendril.session import table

HEADS = "heads as (select s_suppkey id, case when s_suppkey % 2 = 1 then s_suppkey // 2 when s_suppkey % 6 = 0 and s_suppkey > 0 then s_suppkey // 3 end parent from supplier)"


def pointers(s: SparkSession, d: str) -> DataFrame:
    """Rows that were merged into another: odd ids into their half, multiples of six into their third."""
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("case when s_suppkey % 2 = 1 then s_suppkey div 2 when s_suppkey % 6 = 0 and s_suppkey > 0 then s_suppkey div 3 end").alias("parent"))


CHAIN = f"{HEADS}, walk(id, now_at, n) as (select id, id, 0 from heads union all select walk.id, heads.parent, n + 1 from walk join heads on heads.id = walk.now_at where heads.parent is not null and n < 8), live as (select id, arg_max(now_at, n) head from walk group by id)"


@query("j01_fact_dim", f"with {LINE}, {SUP}, {OPP} select region, status, count(*) n, {sql_money('l.amount')} total from line l join opp o on o.id = l.id join sup using (winner) group by region, status")
def j01(s: SparkSession, d: str) -> DataFrame:
    """Awards with their notices and winners."""
    j = lines(s, d).select("id", "winner", "amount").join(opportunities(s, d).select("id", "status"), "id").join(suppliers(s, d).select("winner", "region"), "winner")
    return j.groupBy("region", "status").agg(F.count("*").alias("n"), money("amount").alias("total"))


@query("j02_left_restricted", f"with {OPP}, {LINE} select o.id, count(l.id) returned from opp o left join line l on l.id = o.id and l.kind = 'R' group by o.id")
def j02(s: SparkSession, d: str) -> DataFrame:
    """Every notice with its awards of one kind, none included."""
    n = lines(s, d).where("kind = 'R'").groupBy("id").agg(F.count("*").alias("returned"))
    return opportunities(s, d).select("id").join(n, "id", "left").na.fill(0, ["returned"])


@query("j03_family_head", f"with recursive {CHAIN}, {LINE} select coalesce(live.head, winner) head, count(*) n from line left join live on live.id = winner group by 1")
def j03(s: SparkSession, d: str) -> DataFrame:
    """Awards by the head of the winner's family."""
    live = R.resolve_chain(pointers(s, d), "id", "parent").select(F.col("id").alias("winner"), "head")
    return lines(s, d).groupBy("winner").agg(F.count("*").alias("k")).join(live, "winner", "left").groupBy(F.coalesce("head", "winner").alias("head")).agg(F.sum("k").alias("n"))


@query("j04_family_members", f"with recursive {CHAIN} select a.id, b.id member from live a join live b using (head)")
def j04(s: SparkSession, d: str) -> DataFrame:
    """From any member to all members."""
    live = R.resolve_chain(pointers(s, d), "id", "parent")
    return live.join(live.select(F.col("id").alias("member"), "head"), "head").select("id", "member")


@query("j05_chain_live", f"with recursive {CHAIN} select id, head from live")
def j05(s: SparkSession, d: str) -> DataFrame:
    """The live row at the end of each chain of merges."""
    return R.resolve_chain(pointers(s, d), "id", "parent")


@query("j06_merged_in", f"with recursive {CHAIN} select head, count(*) n, max(id) last_id from live where id <> head group by head")
def j06(s: SparkSession, d: str) -> DataFrame:
    """How many rows were merged into each live row."""
    return R.resolve_chain(pointers(s, d), "id", "parent").where("id <> head").groupBy("head").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query("j07_semi", f"with {OPP}, {LINE} select status, count(*) n from opp where exists (select 1 from line where line.id = opp.id and code like '35%') group by status")
def j07(s: SparkSession, d: str) -> DataFrame:
    """Notices that have a line of a division."""
    return opportunities(s, d).join(lines(s, d).where("code like '35%'").select("id"), "id", "left_semi").groupBy("status").agg(F.count("*").alias("n"))


@query("j08_collapse", f"""with {OPP}, f as (select * from opp where amount > 50000)
select id, buyer, status from f o where not exists (select 1 from f t where t.buyer = o.buyer and t.status = o.status and t.priority = o.priority and t.id <> o.id and (t.published > o.published or t.published = o.published and t.id > o.id))
and not exists (select 1 from f t where t.buyer = o.buyer and t.id <> o.id and t.status = 'F' and o.status = 'P' and t.published >= o.published)""")
def j08(s: SparkSession, d: str) -> DataFrame:
    """Notices that no newer one of the same filters replaces: the later of equal rows, and a final one for a partial."""
    f = opportunities(s, d).where("amount > 50000")
    newer = (F.col("t.published") > F.col("o.published")) | ((F.col("t.published") == F.col("o.published")) & (F.col("t.id") > F.col("o.id")))
    final = (F.col("t.status") == "F") & (F.col("o.status") == "P") & (F.col("t.published") >= F.col("o.published"))
    return R.hide_replaced(f, "id", (["buyer", "status", "priority"], newer), (["buyer"], final)).select("id", "buyer", "status")


@query("j09_not_in", f"with {OPP} select id from opp where id not in (select l_orderkey from lineitem)")
def j09(s: SparkSession, d: str) -> DataFrame:
    """Notices without award."""
    return opportunities(s, d).select("id").join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("id")), "id", "left_anti")


@query("j11_twins", f"with {LINE}, c as (select a.id, a.part pa, b.part pb, a.winner w, row_number() over (partition by a.id, a.winner order by b.amount desc, b.part, b.nr, a.part, a.nr) k from line a join line b on a.id = b.id and a.winner = b.winner and a.part < b.part) select id, w winner, pa, pb from c where k = 1")
def j11(s: SparkSession, d: str) -> DataFrame:
    """Twin rows of one notice and winner, the preferred pair of each."""
    a = lines(s, d).select("id", "winner", F.col("part").alias("pa"), F.col("nr").alias("na"))
    b = lines(s, d).select("id", "winner", F.col("part").alias("pb"), F.col("nr").alias("nb"), "amount")
    pairs = a.join(b, ["id", "winner"]).where("pa < pb")
    return R.distinct_on(pairs, ["id", "winner"], [F.desc("amount"), F.col("pb"), F.col("nb"), F.col("pa"), F.col("na")]).select("id", "winner", "pa", "pb")


BAND = f"{OPP}, c as (select a.id a, b.id b from opp a join opp b on a.buyer = b.buyer and a.priority = b.priority and a.id < b.id and abs(date_diff('day', a.published, b.published)) <= 14)"


def band(s: SparkSession, d: str) -> DataFrame:
    o = opportunities(s, d).select("id", "buyer", "priority", "published")
    a, b = o.alias("a"), o.alias("b")
    on = (F.col("a.buyer") == F.col("b.buyer")) & (F.col("a.priority") == F.col("b.priority")) & (F.col("a.id") < F.col("b.id")) & (F.abs(F.datediff("a.published", "b.published")) <= 14)
    return a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("j12_band_link", f"with {BAND} select a, b from c")
def j12(s: SparkSession, d: str) -> DataFrame:
    """Notices of one buyer and priority within 14 days."""
    return band(s, d)


@query("j13_unambiguous", f"with {BAND} select a, b from c where (select count(distinct b) from c x where x.a = c.a) = 1 and (select count(distinct a) from c x where x.b = c.b) = 1")
def j13(s: SparkSession, d: str) -> DataFrame:
    """Of these, pairs in which neither has another candidate."""
    return R.mutual_single(band(s, d), "a", "b").select("a", "b")


@query("j14_best_match", f"with {OPP}, m as (select a.id, b.id match, row_number() over (partition by a.id order by abs(date_diff('day', a.published, b.published)), b.id desc) k from opp a join opp b on a.buyer = b.buyer and a.id <> b.id and b.status = 'F' where a.status = 'O') select id, match from m where k = 1")
def j14(s: SparkSession, d: str) -> DataFrame:
    """For each open notice the nearest final one of its buyer."""
    o = opportunities(s, d).select("id", "buyer", "published", "status")
    b = o.where("status = 'F'").select("buyer", F.col("id").alias("match"), F.col("published").alias("then"))
    pairs = o.where("status = 'O'").join(b, "buyer").withColumn("gap", F.abs(F.datediff("published", "then")))
    return pairs.groupBy("id").agg(F.min(F.struct("gap", F.negate("match").alias("m"))).alias("best")).select("id", F.negate("best.m").alias("match"))


@query("j15_value_pick", f"with {LINE}, c as (select a.id, a.part, a.nr, a.winner, b.amount, row_number() over (partition by a.id, a.part, a.nr, a.winner order by case b.kind when 'A' then 0 when 'N' then 1 else 2 end, case when a.part = b.part and a.nr = b.nr and a.winner = b.winner then 0 else 1 end, b.amount desc) k from line a join line b on a.id = b.id) select id, part, nr, winner, amount from c where k = 1")
def j15(s: SparkSession, d: str) -> DataFrame:
    """The value of each line: of its own row or another of the notice, by kind, own first, then amount."""
    a = lines(s, d).select("id", "part", "nr", "winner")
    rank = F.expr("case kind when 'A' then 0 when 'N' then 1 else 2 end")
    b = lines(s, d).select("id", F.col("part").alias("p2"), F.col("nr").alias("n2"), F.col("winner").alias("w2"), "amount", rank.alias("rank"))
    pick = F.min_by("amount", F.struct("rank", F.expr("case when part = p2 and nr = n2 and winner = w2 then 0 else 1 end"), F.negate("amount")))
    return a.join(b, "id").groupBy("id", "part", "nr", "winner").agg(pick.alias("amount"))


@query("j16_prefixes", f"with {LINE}, h as (select distinct id, substr(code, 1, n) head from line, (select unnest([2, 3, 4]) n)) select head, count(*) n from h group by head")
def j16(s: SparkSession, d: str) -> DataFrame:
    """Notices under every code prefix of two to four digits, each once."""
    heads = lines(s, d).select("id", F.explode(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda n: F.substring(F.col("code"), F.lit(1), n))).alias("head"))
    return heads.distinct().groupBy("head").agg(F.count("*").alias("n"))


@query("j17_trigram", """with w as (select p_partkey id, p_brand, unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) w from part), g as (select distinct id, p_brand, substr('  ' || w || ' ', i, 3) t from w, (select unnest(range(1, 40)) i) where w <> '' and i <= length(w) + 1),
n as (select id, count(*) n from g group by id), c as (select a.id a, b.id b, count(*) k from g a join g b on a.t = b.t and a.p_brand = b.p_brand and a.id < b.id group by 1, 2)
select c.a, c.b, round(k / cast(x.n + y.n - k as double), 4) similarity from c join n x on x.id = a join n y on y.id = b where k / cast(x.n + y.n - k as double) >= 0.6""")
def j17(s: SparkSession, d: str) -> DataFrame:
    """Similar names within a brand, by trigrams."""
    found = R.trigram_pairs(table(s, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey", "p_name", ["p_brand"], 0.6, 4)
    return found.select("a", "b", "similarity")


@query("j18_neighbours", f"with {LINE}, e as (select distinct id, winner from line), p as (select a.winner w, b.winner p, count(*) n from e a join e b on a.id = b.id and a.winner <> b.winner group by 1, 2), r as (select *, row_number() over (partition by w order by n desc, p) k from p) select w member, p partner, n shared from r where k <= 20")
def j18(s: SparkSession, d: str) -> DataFrame:
    """The twenty partners with whom each winner shares most notices."""
    n = R.neighbours(lines(s, d), "winner", "id")
    return R.top_k(n, ["member"], [F.desc("shared"), F.col("partner")], 20)


@query("j19_scalar", f"with {OPP} select id, round(amount / (select avg(amount) from opp), 6) ratio from opp where status = 'P'")
def j19(s: SparkSession, d: str) -> DataFrame:
    """Values against the mean of all."""
    o = opportunities(s, d)
    return o.where("status = 'P'").crossJoin(F.broadcast(o.agg(F.avg("amount").alias("mean")))).select("id", F.round(F.col("amount") / F.col("mean"), 6).alias("ratio"))


@query("j20_parameter_list", f"with {OPP} select id, status from opp where buyer in (1, 7, 49, 343)")
def j20(s: SparkSession, d: str) -> DataFrame:
    """Rows of a given list of keys."""
    asked = s.createDataFrame([(1,), (7,), (49,), (343,)], "buyer long")
    return opportunities(s, d).join(F.broadcast(asked), "buyer").select("id", "status")


@query("j21_latest_state", "with r as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) k from events) select user_id, event_type, value, case when value is distinct from lag_value then true else false end moved from (select e.user_id, e.event_type, e.value, p.value lag_value from r e left join r p on p.user_id = e.user_id and p.event_type = e.event_type and p.k = 2 where e.k = 1)")
def j21(s: SparkSession, d: str) -> DataFrame:
    """The newest state of each entity and field, and whether it differs from the one before."""
    r = R.top_k(table(s, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], 2, "k")
    g = r.groupBy("user_id", "event_type").agg(F.max(F.when(F.col("k") == 1, F.col("value"))).alias("value"), F.max(F.when(F.col("k") == 2, F.col("value"))).alias("was"))
    return g.select("user_id", "event_type", "value", (~F.col("value").eqNullSafe(F.col("was"))).alias("moved"))


@query("j22_value_borrow", f"with {OPP}, p as (select id, case when status = 'P' then null else amount end v, buyer from opp), b as (select buyer, max(amount) most from opp where status = 'F' group by buyer) select p.id, coalesce(v, most) v from p left join b using (buyer)")
def j22(s: SparkSession, d: str) -> DataFrame:
    """A row without value takes that of its twin."""
    o = opportunities(s, d)
    most = o.where("status = 'F'").groupBy("buyer").agg(F.max("amount").alias("most"))
    return o.join(most, "buyer", "left").select("id", F.coalesce(F.when(F.col("status") != "P", F.col("amount")), "most").alias("v"))


@query("j23_every", f"with {LINE} select id, winner from line group by id, winner having count(*) > 1 and bool_and(kind <> 'R')")
def j23(s: SparkSession, d: str) -> DataFrame:
    """Pairs that occur more than once and never with one kind."""
    return lines(s, d).groupBy("id", "winner").agg(F.count("*").alias("n"), F.bool_and(F.col("kind") != "R").alias("ok")).where("n > 1 and ok").select("id", "winner")


COMP = f"{LINE}, {OPP}, {BUY}, m as (select distinct winner, family, substr(code, 1, 4) class from line join opp using (id) join buy using (buyer))"


@query("j24_competition", f"with {COMP} select a.winner, b.winner rival, count(*) markets from m a join m b using (family, class) where a.winner < b.winner group by 1, 2 having count(*) >= 3")
def j24(s: SparkSession, d: str) -> DataFrame:
    """Winners that meet in three or more markets of buyer family and class."""
    m = lines(s, d).join(opportunities(s, d).select("id", "buyer"), "id").join(buyers(s, d).select("buyer", "family"), "buyer").select("winner", F.concat_ws(":", "family", F.substring("code", 1, 4)).alias("market"))
    return R.meeting_pairs(m, "winner", "market", 3).select(F.col("member").alias("winner"), F.col("partner").alias("rival"), F.col("shared").alias("markets"))


@query("j25_gap", f"with {LINE}, {SUP}, p as (select l.id, max(case when country = 'NATION_7' then 1 else 0 end) has from line l join sup using (winner) group by l.id), e as (select distinct id, winner from line) select winner, count(*) n from e join p using (id) group by winner having count(*) >= 100 and sum(has) < 0.06 * count(*)")
def j25(s: SparkSession, d: str) -> DataFrame:
    """Winners of many notices of which few have a winner of one country."""
    has = lines(s, d).select("id", "winner").join(suppliers(s, d).select("winner", "country"), "winner").groupBy("id").agg(F.max(F.when(F.col("country") == "NATION_7", 1).otherwise(0)).alias("has"))
    return lines(s, d).select("id", "winner").distinct().join(has, "id").groupBy("winner").agg(F.count("*").alias("n"), F.sum("has").alias("h")).where("n >= 100 and h < 0.06 * n").select("winner", "n")


@query("j26_two_sided", f"with {LINE}, {SUP}, e as (select distinct id, winner, country from line join sup using (winner)) select a.winner leader, count(distinct b.winner) partners, count(distinct a.id) projects from e a join e b on a.id = b.id and b.country = 'NATION_3' and a.country <> 'NATION_3' group by a.winner")
def j26(s: SparkSession, d: str) -> DataFrame:
    """Leaders that work with partners of one country."""
    e = lines(s, d).select("id", "winner").distinct().join(suppliers(s, d).select("winner", "country"), "winner")
    b = e.where("country = 'NATION_3'").select("id", F.col("winner").alias("partner"))
    return e.where("country <> 'NATION_3'").join(b, "id").groupBy(F.col("winner").alias("leader")).agg(F.count_distinct("partner").alias("partners"), F.count_distinct("id").alias("projects"))


@query("u01_union_total", f"with {OPP}, c as (select status, count(*) n from opp group by status) select status, n from c union all select 'ALL', cast(sum(n) as bigint) from c")
def u01(s: SparkSession, d: str) -> DataFrame:
    """Counts and a row with their total."""
    c = opportunities(s, d).groupBy("status").agg(F.count("*").alias("n"))
    return c.unionByName(c.agg(F.lit("ALL").alias("status"), F.sum("n").alias("n")))


@query("u02_union_ids", f"with {OPP} select buyer id from opp where amount > 400000 union select buyer from opp where priority = '1-URGENT'")
def u02(s: SparkSession, d: str) -> DataFrame:
    """Ids that meet one of two conditions, each once."""
    o = opportunities(s, d)
    return o.where("amount > 400000").select(F.col("buyer").alias("id")).union(o.where("priority = '1-URGENT'").select("buyer")).distinct()


@query("u03_snapshot_diff", f"""with {LINE}, {OPP}, y as (select buyer, year(shipped) y, list_sort(list(distinct winner)) w from line join opp using (id) group by 1, 2), p as (select *, lag(w) over (partition by buyer order by y) b from y)
select buyer, cast(y as bigint) y, array_to_string(list_sort(list_filter(w, lambda x: not list_contains(b, x))), ',') added, array_to_string(list_sort(list_filter(b, lambda x: not list_contains(w, x))), ',') removed from p where b is not null""")
def u03(s: SparkSession, d: str) -> DataFrame:
    """Winners that came and went, year by year, for each buyer."""
    y = lines(s, d).join(opportunities(s, d).select("id", "buyer"), "id").groupBy("buyer", F.year("shipped").cast("long").alias("y")).agg(F.collect_set("winner").alias("w"))
    p = y.withColumn("b", F.lag("w").over(Window.partitionBy("buyer").orderBy("y"))).where("b is not null")
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return p.select("buyer", "y", text(F.array_except("w", "b")).alias("added"), text(F.array_except("b", "w")).alias("removed"))


@query("u04_except", f"with {OPP} select buyer from opp where status = 'O' except select buyer from opp where status = 'F'")
def u04(s: SparkSession, d: str) -> DataFrame:
    """Buyers with open notices and no final one."""
    o = opportunities(s, d)
    return o.where("status = 'O'").select("buyer").subtract(o.where("status = 'F'").select("buyer"))


@query("u05_components", f"with recursive {BAND}, e as (select a u, b v from c union all select b, a from c), ids as (select distinct u id from e), reach(id, r) as (select id, id from ids union select reach.id, v from reach join e on u = r) select id, min(r) component from reach group by id")
def u05(s: SparkSession, d: str) -> DataFrame:
    """Groups of notices linked within 14 days."""
    return R.components(band(s, d), "a", "b")


@query("u06_event_groups", "select regexp_replace(event_type, '[0-9]+$', '') base, cast(user_id % 50 as bigint) grp, strftime(date_trunc('day', ts), '%Y-%m-%d') day_, count(*) n, min(event_id) first_id from events group by 1, 2, 3")
def u06(s: SparkSession, d: str) -> DataFrame:
    """Events of one kind, group and day as one, the first for all."""
    return table(s, d, "events").groupBy(F.regexp_replace("event_type", "[0-9]+$", "").alias("base"), (F.col("user_id") % 50).alias("grp"), F.date_trunc("day", "ts").cast("date").cast("string").alias("day_")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


R01 = """o as (select organisation_id id, country, canonical_name, national_reg_no no from organisation),
q as (select rec_id, buyer_id, nullif(trim(nomacheteur), '') name from boamp_notices)"""


@query("r01_cascade", f"""with {R01}, byname as (select lower(trim(canonical_name)) name, min(id) id from o group by 1)
select rec_id, coalesce(x.id, n.id) resolved, case when x.id is not null then 'identifier' when n.id is not null then 'name' else 'none' end stage, case when x.id is not null then 0.97 when n.id is not null then 0.95 else 0.0 end confidence
from q left join o x on x.id = q.buyer_id left join byname n on n.name = lower(q.name)""")
def r01(s: SparkSession, d: str) -> DataFrame:
    """Buyers by identifier, then by exact name, with the deciding stage."""
    o = table(s, d, "organisation").select(F.col("organisation_id").alias("oid"), "canonical_name")
    q = table(s, d, "boamp_notices").select("rec_id", "buyer_id", F.lower(F.nullif(F.trim("nomacheteur"), F.lit(""))).alias("name"))
    by_name = o.groupBy(F.lower(F.trim("canonical_name")).alias("name")).agg(F.min("oid").alias("by_name"))
    j = q.join(o.select(F.col("oid").alias("buyer_id"), F.col("oid").alias("by_id")), "buyer_id", "left").join(by_name, "name", "left")
    stage = F.when(F.col("by_id").isNotNull(), "identifier").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return j.select("rec_id", F.coalesce("by_id", "by_name").alias("resolved"), stage.alias("stage"), F.when(stage == "identifier", 0.97).when(stage == "name", 0.95).otherwise(0.0).alias("confidence"))


@query("r02_flag_inheritance", "select a.organisation_id, bool_or(coalesce(b.is_defence_buyer, false)) flagged from organisation a join organisation b on a.country = b.country and split_part(lower(a.canonical_name), ' ', 1) = split_part(lower(b.canonical_name), ' ', 1) group by a.organisation_id")
def r02(s: SparkSession, d: str) -> DataFrame:
    """A flag that any namesake of the country carries."""
    o = table(s, d, "organisation").select("organisation_id", "country", F.split(F.lower("canonical_name"), " ")[0].alias("w"), F.coalesce("is_defence_buyer", F.lit(False)).alias("f"))
    return o.join(o.groupBy("country", "w").agg(F.bool_or("f").alias("flagged")), ["country", "w"]).select("organisation_id", "flagged")


@query("r06_identical_families", "select lower(trim(canonical_name)) name, country, count(*) n, min(organisation_id) head from organisation where canonical_name is not null and country is not null group by 1, 2 having count(*) >= 1")
def r06(s: SparkSession, d: str) -> DataFrame:
    """Buyers of one name and country, the lowest id at the head."""
    return table(s, d, "organisation").where("canonical_name is not null and country is not null").groupBy(F.lower(F.trim("canonical_name")).alias("name"), "country").agg(F.count("*").alias("n"), F.min("organisation_id").alias("head"))


@query("r09_number_conflict", "with n as (select supplier_id, country, ltrim(regexp_replace(unnest(numbers), '[^0-9]', '', 'g'), '0') no from supplier_dedupe), k as (select distinct supplier_id, country, no from n where length(no) >= 9) select a.supplier_id a, b.supplier_id b, cast(levenshtein(a.no, b.no) as bigint) dist from k a join k b on a.country = b.country and a.supplier_id < b.supplier_id and substr(a.no, 1, 5) = substr(b.no, 1, 5) and a.no <> b.no")
def r09(s: SparkSession, d: str) -> DataFrame:
    """Numbers of two winners that begin alike and differ, with their edit distance."""
    n = table(s, d, "supplier_dedupe").select("supplier_id", "country", F.explode("numbers").alias("no")).select("supplier_id", "country", F.ltrim(F.regexp_replace("no", "[^0-9]", ""), F.lit("0")).alias("no")).where("length(no) >= 9").distinct().withColumn("head", F.substring("no", 1, 5))
    a, b = n.alias("a"), n.alias("b")
    j = a.join(b, (F.col("a.country") == F.col("b.country")) & (F.col("a.head") == F.col("b.head")) & (F.col("a.supplier_id") < F.col("b.supplier_id")) & (F.col("a.no") != F.col("b.no")))
    return j.select(F.col("a.supplier_id").alias("a"), F.col("b.supplier_id").alias("b"), F.levenshtein("a.no", "b.no").cast("long").alias("dist"))


@query("r11_folded_groups", "with f as (select supplier_id, country, regexp_replace(lower(name), '[^a-z]+', '', 'g') k from supplier_dedupe) select country, k, count(*) n, min(supplier_id) first_id from f where k <> '' and country is not null group by 1, 2 having count(*) > 1")
def r11(s: SparkSession, d: str) -> DataFrame:
    """Names that are one without case, blanks and signs."""
    f = table(s, d, "supplier_dedupe").select("supplier_id", "country", F.regexp_replace(F.lower("name"), "[^a-z]+", "").alias("k")).where("k <> '' and country is not null")
    return f.groupBy("country", "k").agg(F.count("*").alias("n"), F.min("supplier_id").alias("first_id")).where("n > 1")


@query("t01_change_set", "with p as (select user_id, event_id, event_type, value, props, lag(event_type) over w a, lag(value) over w b, lag(props) over w c, row_number() over w k from events window w as (partition by user_id order by ts, event_id)) select user_id, event_id, concat_ws(',', case when event_type is distinct from a then 'kind' end, case when value is distinct from b then 'value' end, case when nullif(props, '') is distinct from nullif(c, '') then 'props' end) changed from p where k > 1")
def t01(s: SparkSession, d: str) -> DataFrame:
    """Which fields each entry changes against the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").select("user_id", "event_id", "ts", "event_type", "value", "props", F.row_number().over(w).alias("k"), *[F.lag(c).over(w).alias(f"was_{c}") for c in ("event_type", "value", "props")])
    fields = {"kind": "event_type", "value": "value", "props": "props"}
    changed = R.change_set({n: F.col(f"was_{c}") for n, c in fields.items()}, {n: F.col(c) for n, c in fields.items()})
    return e.where("k > 1").select("user_id", "event_id", F.array_join(changed, ",").alias("changed"))


@query("t03_scd2", "select user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') valid_from, strftime(lead(ts) over (partition by user_id order by ts, event_id), '%Y-%m-%d %H:%M:%S') valid_to from events")
def t03(s: SparkSession, d: str) -> DataFrame:
    """Contiguous validity of each entity's entries."""
    v = R.validity(table(s, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id")
    text = lambda c: F.substring(F.col(c).cast("string"), 1, 19)
    return v.select("user_id", "event_id", text("ts").alias("valid_from"), text("valid_to").alias("valid_to"))


@query("t05_local_key", f"with {OPP}, k as (select id, buyer, cast(id % 997 as varchar) no from opp), m as (select no, min(buyer) owner from k group by no) select id, case when buyer = owner then no else concat(no, '#', substr(sha1(cast(buyer as varchar)), 1, 8)) end key_ from k join m using (no)")
def t05(s: SparkSession, d: str) -> DataFrame:
    """A local number that another buyer holds gets a suffix of the buyer's hash."""
    k = opportunities(s, d).select("id", "buyer", (F.col("id") % 997).cast("string").alias("no"))
    m = k.groupBy("no").agg(F.min("buyer").alias("owner"))
    key = F.when(F.col("buyer") == F.col("owner"), F.col("no")).otherwise(F.concat("no", F.lit("#"), F.substring(F.sha1(F.col("buyer").cast("string")), 1, 8)))
    return k.join(m, "no").select("id", key.alias("key_"))


@query("t06_change_window", """with f as (select user_id, min(ts) born from events group by user_id), w as (select max(ts) - interval 14 day a from events), d as (select user_id, date_trunc('day', ts) dy, arg_min(value, (ts, event_id)) was, arg_max(value, (ts, event_id)) now_, count(*) n from events, w where ts >= a group by 1, 2)
select user_id, strftime(dy, '%Y-%m-%d') day_, was, now_, n, case when born >= (select a from w) and date_trunc('day', born) = dy then 'new' else 'amended' end kind from d join f using (user_id) where was <> now_""")
def t06(s: SparkSession, d: str) -> DataFrame:
    """What each entity changed on each of the last 14 days: first value before, last value after."""
    e = table(s, d, "events").select("user_id", "ts", "event_id", "value")
    born = e.groupBy("user_id").agg(F.min("ts").alias("born"))
    start = e.agg((F.max("ts") - F.expr("interval 14 days")).alias("a"))
    recent = e.crossJoin(F.broadcast(start)).where("ts >= a")
    order = F.struct("ts", "event_id")
    day = recent.groupBy("user_id", "a", F.date_trunc("day", "ts").alias("dy")).agg(F.min_by("value", order).alias("was"), F.max_by("value", order).alias("now_"), F.count("*").alias("n")).where("was <> now_")
    kind = F.when((F.col("born") >= F.col("a")) & (F.date_trunc("day", "born") == F.col("dy")), "new").otherwise("amended")
    return day.join(born, "user_id").select("user_id", F.col("dy").cast("date").cast("string").alias("day_"), "was", "now_", "n", kind.alias("kind"))


@query("t08_iso_week", "select strftime(ts, '%G-W%V') as week, event_type, count(*) n from events group by 1, 2")
def t08(s: SparkSession, d: str) -> DataFrame:
    """Weekly counts by ISO week."""
    year = F.year(F.date_add(F.date_trunc("week", "ts").cast("date"), 3))
    week = F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return table(s, d, "events").groupBy(week.alias("week"), "event_type").agg(F.count("*").alias("n"))


@query("t10_contract_end", f"""with {OPP}, e as (select id, case when priority = '1-URGENT' then published + 90 when priority = '2-HIGH' then cast(published + interval 12 month as date) else deadline + 365 end ends, case when priority = '1-URGENT' then 'stated' when priority = '2-HIGH' then 'computed' else 'estimated' end basis from opp)
select basis, count(*) filter (ends between date '2000-01-01' and date '2000-04-01') in_3, count(*) filter (ends between date '2000-01-01' and date '2000-07-01') in_6, count(*) filter (ends between date '2000-01-01' and date '2001-01-01') in_12 from e group by basis""")
def t10(s: SparkSession, d: str) -> DataFrame:
    """Contracts that end within 3, 6 and 12 months, by what their end rests on."""
    end = F.expr("case when priority = '1-URGENT' then date_add(published, 90) when priority = '2-HIGH' then add_months(published, 12) else date_add(deadline, 365) end")
    basis = F.expr("case when priority = '1-URGENT' then 'stated' when priority = '2-HIGH' then 'computed' else 'estimated' end")
    e = opportunities(s, d).select(end.alias("ends"), basis.alias("basis"))
    within = lambda to: F.count_if(F.expr(f"ends between date'2000-01-01' and date'{to}'"))
    return e.groupBy("basis").agg(within("2000-04-01").alias("in_3"), within("2000-07-01").alias("in_6"), within("2001-01-01").alias("in_12"))


@query("t12_unlisted", f"with {LINE}, y as (select distinct winner, year(shipped) y from line), m as (select max(y) z from y) select winner, cast(z - max(y) as bigint) missed from y, m group by winner, z having max(y) < z")
def t12(s: SparkSession, d: str) -> DataFrame:
    """How many latest runs (years) each winner has been missing from."""
    y = lines(s, d).select("winner", F.year("shipped").alias("y"))
    last = y.agg(F.max("y").alias("z"))
    return y.groupBy("winner").agg(F.max("y").alias("seen")).crossJoin(F.broadcast(last)).where("seen < z").select("winner", (F.col("z") - F.col("seen")).cast("long").alias("missed"))


@query("t14_reversions", "with p as (select user_id, event_id, event_type, lag(event_type) over w a, lag(event_type, 2) over w b from events window w as (partition by user_id order by ts, event_id)) select user_id, count(*) n from p where event_type = b and event_type <> a group by user_id")
def t14(s: SparkSession, d: str) -> DataFrame:
    """How often a state comes back after another."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(s, d, "events").select("user_id", "event_type", F.lag("event_type").over(w).alias("a"), F.lag("event_type", 2).over(w).alias("b"))
    return p.where("event_type = b and event_type <> a").groupBy("user_id").agg(F.count("*").alias("n"))


@query("s17_upsert", f"with {OPP}, h as (select id, amount, status from opp where id % 5 <> 0), c as (select id, case when id % 7 = 0 then amount + 1 else amount end amount, status from opp where id % 3 <> 0) select case when h.id is null then 'new' when c.id is null then 'kept' when h.amount is not distinct from c.amount and h.status is not distinct from c.status then 'unchanged' else 'changed' end outcome, count(*) n from h full join c on h.id = c.id group by 1")
def s17(s: SparkSession, d: str) -> DataFrame:
    """Outcomes of an upsert of one delivery into another."""
    o = opportunities(s, d).select("id", "amount", "status")
    held, came = o.where("id % 5 <> 0"), o.where("id % 3 <> 0").withColumn("amount", F.expr("case when id % 7 = 0 then amount + 1 else amount end"))
    return R.upsert(held, came, "id", ["amount", "status"]).groupBy("outcome").agg(F.count("*").alias("n"))
