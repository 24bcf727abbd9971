"""Further aggregates, resolution, timelines and stored sets."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendril.catalog import query
from tendril.functions import scalar as S
from tendril.operators import relational as R
from tendril.operators import timeline
from tendril.plans.linking import CHAIN, pointers
from tendril.plans.texts import FOLD
from tendril.plans.views import BUY, LINE, OPP, SUP, buyers, lines, money, opportunities, sql_money, suppliers
from tendril.session import table


@query("a07_amendment_share", "with f as (select user_id, event_type, count(*) n, count(distinct value) v from events group by 1, 2) select event_type, count(*) entities, count(*) filter (v > 1) amended, round(count(*) filter (v > 1) / cast(count(*) as double), 6) share from f group by event_type")
def a07(s: SparkSession, d: str) -> DataFrame:
    """The share of entities whose field ever changed."""
    f = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count_distinct("value").alias("v"))
    return f.groupBy("event_type").agg(F.count("*").alias("entities"), F.count_if(F.col("v") > 1).alias("amended"), F.round(F.expr("count_if(v > 1) / cast(count(*) as double)"), 6).alias("share"))


@query("a11_two_sets", f"with {LINE} select kind, state, count(*) n, {sql_money('amount')} total from line group by grouping sets ((kind), (state))")
def a11(s: SparkSession, d: str) -> DataFrame:
    """Two groupings in one pass."""
    return lines(s, d).groupingSets([["kind"], ["state"]], "kind", "state").agg(F.count("*").alias("n"), money("amount").alias("total"))


@query("a14_sums_apart", f"with {LINE} select winner, {sql_money('case when quantity > 1 then amount end')} counted, count(*) filter (quantity <= 1) suspect, {sql_money('case when kind = $$R$$ then amount end')} frameworks from line group by winner")
def a14(s: SparkSession, d: str) -> DataFrame:
    """Sums with suspect unit prices left out and counted, one kind apart."""
    return lines(s, d).groupBy("winner").agg(money(F.when(F.col("quantity") > 1, F.col("amount"))).alias("counted"), F.count_if(F.col("quantity") <= 1).alias("suspect"), money(F.when(F.col("kind") == "R", F.col("amount"))).alias("frameworks"))


@query("a23_units", f"with {OPP}, {BUY} select country, segment, count(distinct buyer) units, count(*) n from opp join buy using (buyer) group by 1, 2")
def a23(s: SparkSession, d: str) -> DataFrame:
    """Units of the buyers of a country."""
    return opportunities(s, d).select("buyer").join(buyers(s, d).select("buyer", "country", "segment"), "buyer").groupBy("country", "segment").agg(F.count_distinct("buyer").alias("units"), F.count("*").alias("n"))


@query("a27_partner_span", f"with {LINE}, e as (select distinct id, winner, year(shipped) y from line) select a.winner w, b.winner p, count(distinct a.id) shared, cast(min(least(a.y, b.y)) as bigint) first_year, cast(max(greatest(a.y, b.y)) as bigint) last_year from e a join e b on a.id = b.id and a.winner < b.winner group by 1, 2 having count(distinct a.id) >= 3")
def a27(s: SparkSession, d: str) -> DataFrame:
    """Partners of three shared projects or more with the span of years."""
    e = lines(s, d).groupBy("id", "winner").agg(F.min(F.year("shipped")).alias("lo"), F.max(F.year("shipped")).alias("hi"))
    a, b = e.alias("a"), e.alias("b")
    j = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.winner") < F.col("b.winner")))
    g = j.groupBy(F.col("a.winner").alias("w"), F.col("b.winner").alias("p")).agg(F.count("*").alias("shared"), F.min(F.least("a.lo", "b.lo")).cast("long").alias("first_year"), F.max(F.greatest("a.hi", "b.hi")).cast("long").alias("last_year"))
    return g.where("shared >= 3")


@query("a29_suggestions", f"with {LINE}, {SUP}, c as (select winner, country, count(distinct id) projects, count(distinct id) filter (code like '35%') topical, max(shipped) latest from line join sup using (winner) group by 1, 2) select winner, topical, projects, row_number() over (order by case when country = 'NATION_5' then 0 else 1 end, topical desc, projects desc, latest desc, winner) place from c")
def a29(s: SparkSession, d: str) -> DataFrame:
    """Partners for a topic: a preferred country first, then topical projects."""
    c = lines(s, d).join(suppliers(s, d).select("winner", "country"), "winner").groupBy("winner", "country").agg(F.count_distinct("id").alias("projects"), F.count_distinct(F.when(F.col("code").startswith("35"), F.col("id"))).alias("topical"), F.max("shipped").alias("latest"))
    order = [F.when(F.col("country") == "NATION_5", 0).otherwise(1), F.desc("topical"), F.desc("projects"), F.desc("latest"), F.col("winner")]
    return R.ranked(c, order).select("winner", "topical", "projects", "place")


@query("f15_members_named", f"with recursive {CHAIN}, {SUP} select s.winner, live.head from sup s join live on live.id = s.winner where live.head in (select head from live l join sup m on m.winner = l.id where m.name like '%7')")
def f15(s: SparkSession, d: str) -> DataFrame:
    """Suppliers of groups one of whose members bears a name."""
    live = R.resolve_chain(pointers(s, d), "id", "parent").select(F.col("id").alias("winner"), "head")
    named = live.join(suppliers(s, d).where("name like '%7'").select("winner"), "winner").select("head").distinct()
    return live.join(suppliers(s, d).select("winner"), "winner").join(named, "head").select("winner", "head")


@query("f19_curated", r"select supplier_id, case when lower(name) ~ '(optronics|elektronik)' then 'electronics' when lower(name) ~ '(marine|hydraulik)' then 'naval' end as line_ from supplier_dedupe where lower(name) ~ '(optronics|elektronik|marine|hydraulik)'")
def f19(s: SparkSession, d: str) -> DataFrame:
    """Names of a curated list of patterns."""
    name = F.lower("name")
    line = F.when(name.rlike("(optronics|elektronik)"), "electronics").when(name.rlike("(marine|hydraulik)"), "naval")
    return table(s, d, "supplier_dedupe").select("supplier_id", line.alias("line_")).where("line_ is not null")


@query("j10_keep_newest", f"with {OPP} select id from opp o where not exists (select 1 from opp t where t.buyer = o.buyer and t.priority = o.priority and (t.published > o.published or t.published = o.published and t.id > o.id))")
def j10(s: SparkSession, d: str) -> DataFrame:
    """The newest notice of each buyer and title: one aggregation instead of a theta join."""
    return opportunities(s, d).groupBy("buyer", "priority").agg(F.max_by("id", F.struct("published", "id")).alias("id")).select("id")


@query("r03_staged", """with o as (select organisation_id id, national_reg_no reg, vat_number vat, lower(canonical_name) name, country from organisation), a as (select *, coalesce('r:' || reg, 'v:' || vat, 'n:' || name || ':' || country) k from o) select id, min(id) over (partition by k) canonical, split_part(k, ':', 1) stage from a""")
def r03(s: SparkSession, d: str) -> DataFrame:
    """The canonical row by the first key that is stated: register number, VAT number, name and country."""
    o = table(s, d, "organisation").select(F.col("organisation_id").alias("id"), F.coalesce(F.concat(F.lit("r:"), "national_reg_no"), F.concat(F.lit("v:"), "vat_number"), F.concat(F.lit("n:"), F.lower("canonical_name"), F.lit(":"), "country")).alias("k"))
    head = o.where("k is not null").groupBy("k").agg(F.min("id").alias("canonical"))
    return o.join(head, "k").select("id", "canonical", F.substring_index("k", ":", 1).alias("stage"))


@query("r04_legal_forms", r"select supplier_id, regexp_extract(" + FOLD.format("name") + r", ' (gmbh & co kg|gmbh co kg|gmbh|ag|sarl|sas|sa|slu|sl|bv|nv|ab|srl|spa|sro)( |$)', 1) as form from supplier_dedupe")
def r04(s: SparkSession, d: str) -> DataFrame:
    """Legal forms in names."""
    return table(s, d, "supplier_dedupe").select("supplier_id", F.regexp_extract(S.fold(F.col("name")), " (gmbh & co kg|gmbh co kg|gmbh|ag|sarl|sas|sa|slu|sl|bv|nv|ab|srl|spa|sro)( |$)", 1).alias("form"))


@query("r05_repoint", f"with recursive {CHAIN}, {LINE} select coalesce(live.head, winner) winner, count(*) n, count(*) filter (live.head <> winner) moved from line left join live on live.id = winner group by 1")
def r05(s: SparkSession, d: str) -> DataFrame:
    """Awards carried over to the heads of merged rows."""
    live = R.resolve_chain(pointers(s, d), "id", "parent").select(F.col("id").alias("winner"), "head")
    n = lines(s, d).groupBy("winner").agg(F.count("*").alias("k")).join(live, "winner", "left")
    return n.groupBy(F.coalesce("head", "winner").alias("head")).agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("head") != F.col("winner"), F.col("k"))), F.lit(0)).alias("moved")).withColumnRenamed("head", "winner")


@query("r08_dedupe_plan", "with k as (select supplier_id, country, unnest(list_distinct(list_filter(list_transform(numbers, lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) between 8 and 10))) no from supplier_dedupe), g as (select country, no, count(distinct supplier_id) n, min(supplier_id) head from k group by 1, 2) select country, no, n, head from g where n > 1 and country is not null")
def r08(s: SparkSession, d: str) -> DataFrame:
    """Groups of winners that state one number in a country."""
    digits = F.array_distinct(F.filter(F.transform("numbers", lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda x: F.length(x).between(8, 10)))
    k = table(s, d, "supplier_dedupe").select("supplier_id", "country", F.explode(digits).alias("no")).where("country is not null")
    return k.groupBy("country", "no").agg(F.count_distinct("supplier_id").alias("n"), F.min("supplier_id").alias("head")).where("n > 1")


@query("r12_ratio")
def r12(s: SparkSession, d: str) -> DataFrame:
    """Pairs of buyers of a country whose names' matching blocks make up 0.9 or more of them."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    o = table(s, d, "organisation").select("organisation_id", "country", F.lower("canonical_name").alias("name")).where("name is not null")
    # at a ratio of 0.9 a tenth of each name lies outside the blocks, in as many places at most: 0.7 of the trigrams of
    # either name stay, which is 0.53 of all; equal names are far above
    near = R.trigram_pairs(o, "organisation_id", "name", ["country"], 0.5)
    x, y = o.select(F.col("organisation_id").alias("a"), F.col("name").alias("x")), o.select(F.col("organisation_id").alias("b"), F.col("name").alias("y"))
    pairs = near.join(x, "a").join(y, "b")
    return pairs.select("a", "b", ratio("x", "y").alias("r")).where("r >= 0.9").select("a", "b", F.round("r", 4).alias("ratio"))


@query("t02_timeline")
def t02(s: SparkSession, d: str) -> DataFrame:
    """Amendments of tenders: fields of the snapshots in order, lines that change nothing or are taken back at once left out."""
    lib = table(s, d, "lib").select("tender_no", "retrievedAt", "snap_id", F.explode(F.expr("map('status', status, 'deadline', deadline, 'value', value_amount)")).alias("field", "value"))
    return timeline.amendments(lib, "tender_no", ["retrievedAt", "snap_id", "field"], "field", "value")


@query("t07_first_wins", "with e as (select user_id, date_trunc('day', ts) dy, event_type, row_number() over (partition by user_id, date_trunc('day', ts) order by case event_type when 'signup' then 0 when 'purchase' then 1 else 2 end, ts, event_id) k from events) select user_id, strftime(dy, '%Y-%m-%d') day_, event_type kind from e where k = 1")
def t07(s: SparkSession, d: str) -> DataFrame:
    """One event for each entity and day, by the rank of its kind."""
    rank = F.expr("case event_type when 'signup' then 0 when 'purchase' then 1 else 2 end")
    e = table(s, d, "events").withColumn("dy", F.date_trunc("day", "ts"))
    return e.groupBy("user_id", "dy").agg(F.min_by("event_type", F.struct(rank.alias("r"), "ts", "event_id")).alias("kind")).select("user_id", F.col("dy").cast("date").cast("string").alias("day_"), "kind")


@query("t09_consortium_diff", f"with {LINE}, p as (select id, list_sort(list(distinct winner)) now_, coalesce(list_sort(list(distinct winner) filter (state = 'F')), []) was from line group by id) select id, cast(len(list_filter(now_, lambda x: not list_contains(was, x))) as bigint) added, cast(len(was) as bigint) kept from p where len(list_filter(now_, lambda x: not list_contains(was, x))) > 0")
def t09(s: SparkSession, d: str) -> DataFrame:
    """Members of a consortium that its last snapshot did not have."""
    p = lines(s, d).groupBy("id").agg(F.collect_set("winner").alias("now_"), F.collect_set(F.when(F.col("state") == "F", F.col("winner"))).alias("was"))
    return p.select("id", F.size(F.array_except("now_", "was")).cast("long").alias("added"), F.size("was").cast("long").alias("kept")).where("added > 0")


@query("t11_date_changes", """with o as (select tender_no, deadline, lag(deadline) over (partition by tender_no order by "retrievedAt", snap_id) was, "retrievedAt" r, snap_id from lib where deadline is not null) select tender_no, snap_id, strftime(try_cast(was as timestamptz) at time zone 'UTC', '%Y-%m-%d %H:%M') was_, strftime(try_cast(deadline as timestamptz) at time zone 'UTC', '%Y-%m-%d %H:%M') now_ from o where was is not null and try_cast(was as timestamptz) <> try_cast(deadline as timestamptz)""")
def t11(s: SparkSession, d: str) -> DataFrame:
    """Every change of a stated deadline, as instants."""
    w = Window.partitionBy("tender_no").orderBy("retrievedAt", "snap_id")
    utc = F.to_utc_timestamp(F.col("deadline").try_cast("timestamp"), F.current_timezone())
    o = table(s, d, "lib").where("deadline is not null").select("tender_no", "snap_id", "retrievedAt", utc.alias("now")).withColumn("was", F.lag("now").over(w))
    text = lambda c: F.substring(F.col(c).cast("string"), 1, 16)
    return o.where("was <> now").select("tender_no", "snap_id", text("was").alias("was_"), text("now").alias("now_"))


@query("w07_recent_against_prior", f"with {LINE} select substr(code, 1, 2) division, count(*) filter (year(shipped) = 1999) recent, count(*) filter (year(shipped) = 1998) prior, count(*) filter (year(shipped) = 1999) - count(*) filter (year(shipped) = 1998) diff from line group by 1")
def w07(s: SparkSession, d: str) -> DataFrame:
    """A window against the one before, in one pass."""
    year = F.year("shipped")
    g = lines(s, d).groupBy(F.substring("code", 1, 2).alias("division")).agg(F.count_if(year == 1999).alias("recent"), F.count_if(year == 1998).alias("prior"))
    return g.withColumn("diff", F.col("recent") - F.col("prior"))


@query("x03_labels_to_codes", f"with {LINE}, l as (select distinct code, p_name from lineitem join part on p_partkey = l_partkey join line on line.part = p_partkey) select substr(code, 1, 3) prefix, count(distinct code) codes from l where lower(p_name) like '%widget%' group by 1")
def x03(s: SparkSession, d: str) -> DataFrame:
    """Code prefixes under which a word occurs in labels."""
    labels = table(s, d, "part").where(F.lower("p_name").contains("widget")).select(F.col("p_partkey").alias("part"))
    return lines(s, d).select("part", "code").join(labels, "part").groupBy(F.substring("code", 1, 3).alias("prefix")).agg(F.count_distinct("code").alias("codes"))


@query("x06_stored_matches", "with f as (select doc_id, published_at, " + FOLD.format("text") + " t from documents), c as (select max(published_at) - interval 30 day a from documents) select doc_id, case when published_at >= (select a from c) then 'tested again' else 'stored' end how from f where t like '% depot%' and published_at is not null")
def x06(s: SparkSession, d: str) -> DataFrame:
    """A stored set of matches, and the rows since tested anew."""
    docs = table(s, d, "documents").where("published_at is not null").select("doc_id", "published_at", S.fold(F.col("text")).alias("t"))
    cut = docs.agg((F.max("published_at") - F.expr("interval 30 days")).alias("a"))
    hit = docs.where(S.all_words(F.col("t"), ["depot"])).select("doc_id", "published_at")
    return hit.crossJoin(F.broadcast(cut)).select("doc_id", F.when(F.col("published_at") >= F.col("a"), "tested again").otherwise("stored").alias("how"))


@query("s05_pruned_columns", "select count(*) n, count(distinct l_suppkey) suppliers from lineitem where l_shipdate >= timestamp '1999-01-01'")
def s05(s: SparkSession, d: str) -> DataFrame:
    """A scan of two columns with a filter that reaches the files."""
    from tendril.sources.records import read_columns

    return read_columns(s, f"{d}/lineitem.parquet", "l_suppkey", "l_shipdate").where(F.col("l_shipdate") >= F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("s09_register_join", f"with {LINE}, {SUP}, a as (select winner, count(*) n from line group by winner), b as (select winner, max(shipped) latest from line where kind = 'R' group by winner) select s.winner, s.country, coalesce(n, 0) n, cast(latest as varchar) latest from sup s left join a using (winner) left join b using (winner)")
def s09(s: SparkSession, d: str) -> DataFrame:
    """A register joined with two side tables that may lack rows."""
    a = lines(s, d).groupBy("winner").agg(F.count("*").alias("n"), F.max(F.when(F.col("kind") == "R", F.col("shipped"))).cast("string").alias("latest"))
    return suppliers(s, d).select("winner", "country").join(a, "winner", "left").na.fill(0, ["n"])


@query("g07_alerts", "select event_id, user_id, event_type from events where event_type = 'purchase' and value >= 50 or event_type = 'error' and value >= 90")
def g07(s: SparkSession, d: str) -> DataFrame:
    """Events that meet saved searches."""
    from tendril.streaming import windows

    searches = s.createDataFrame([("purchase", 50.0, None), ("error", 90.0, None)], "event_type string, least double, seen timestamp_ntz")
    hits: list[DataFrame] = []
    windows.alerts(searches, lambda df, _: hits.append(df))(table(s, d, "events"), 0)
    return hits[0].select("event_id", "user_id", "event_type")
