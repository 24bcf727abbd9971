"""Normalisation (N), classification (F), text search (X), decisions (D), event windows (G) and sources (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendril.catalog import query
from tendril.functions import scalar as S
from tendril.operators import relational as R
from tendril.plans.views import AS_OF, LINE, OPP, lines, opportunities
from tendril.session import table

FOLD = S.fold_sql("{0}")
CODES = f"{LINE}, codes as (select id, list_sort(list(distinct code)) codes from line group by id)"


def codes(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d).groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"))


@query("n03_coalesce_lists", "select rec_id, coalesce(nullif(trim(annonce_lie[1]), ''), nullif(trim(idweb), '')) first_of, cast(coalesce(len(annonce_lie), 0) as bigint) n from boamp_notices")
def n03(s: SparkSession, d: str) -> DataFrame:
    """The first of a list, else a scalar."""
    first = F.try_element_at("annonce_lie", F.lit(1))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(s, d, "boamp_notices").select("rec_id", F.coalesce(blank(first), blank(F.col("idweb"))).alias("first_of"), F.coalesce(F.size("annonce_lie"), F.lit(0)).cast("long").alias("n"))


@query("n04_cpv_clean", """with c as (select rec_id, unnest(list_distinct(regexp_extract_all(payload, '"([0-9]{8})(?:-[0-9])?"', 1))) code from ted_live_notices_2026_10) select rec_id, count(*) n, min(code) low, max(code) high from c group by rec_id""")
def n04(s: SparkSession, d: str) -> DataFrame:
    """Eight-digit codes of a notice, each once."""
    found = F.array_distinct(F.regexp_extract_all("payload", F.lit(r'"([0-9]{8})(?:-[0-9])?"'), 1))
    c = table(s, d, "ted_live_notices_2026_10").select("rec_id", found.alias("c")).where("size(c) > 0")
    return c.select("rec_id", F.size("c").cast("long").alias("n"), F.array_min("c").alias("low"), F.array_max("c").alias("high"))


@query("n05_amounts", "select snap_id, case when try_cast(replace(regexp_replace(value_amount, '\\s', '', 'g'), ',', '.') as double) > 1 then round(try_cast(replace(regexp_replace(value_amount, '\\s', '', 'g'), ',', '.') as double), 2) end amount from lib")
def n05(s: SparkSession, d: str) -> DataFrame:
    """Amounts written in several ways; placeholders are none."""
    return table(s, d, "lib").select("snap_id", F.round(S.amount(F.col("value_amount")), 2).alias("amount"))


@query("n07_instants", "select snap_id, strftime(try_cast(deadline as timestamptz) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') utc from lib")
def n07(s: SparkSession, d: str) -> DataFrame:
    """Instants of several offsets as UTC."""
    at = F.to_utc_timestamp(F.col("deadline").try_cast("timestamp"), F.current_timezone())
    return table(s, d, "lib").select("snap_id", F.substring(at.cast("string"), 1, 19).alias("utc"))


@query("n08_deadline_over_lots", f"with {LINE} select id, cast(max(shipped) as varchar) latest, cast(min(shipped) as varchar) earliest, cast(arg_max(nr, (shipped, part, nr)) as bigint) last_lot from line group by id")
def n08(s: SparkSession, d: str) -> DataFrame:
    """The latest and earliest day over the lots."""
    return lines(s, d).groupBy("id").agg(F.max("shipped").cast("string").alias("latest"), F.min("shipped").cast("string").alias("earliest"), F.max_by("nr", F.struct("shipped", "part", "nr")).cast("long").alias("last_lot"))


@query("n11_redact", r"select rec_id, regexp_replace(regexp_replace(""" + '"orderObject"' + r""", '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\+[0-9][0-9 ()-]{7,}[0-9]', '[phone]', 'g') as text from ezamowienia_status_cases""")
def n11(s: SparkSession, d: str) -> DataFrame:
    """E-mail addresses and international numbers out of stored text."""
    return table(s, d, "ezamowienia_status_cases").select("rec_id", S.redact(F.col("orderObject")).alias("text"))


@query("n12_name_form", "select supplier_id, " + FOLD.format("name") + " form from supplier_dedupe")
def n12(s: SparkSession, d: str) -> DataFrame:
    """Normal form of names."""
    return table(s, d, "supplier_dedupe").select("supplier_id", S.fold(F.col("name")).alias("form"))


@query("n13_token_sort_key", "select supplier_id, array_to_string(list_sort(list_filter(string_split(" + FOLD.format("name") + ", ' '), lambda w: length(w) >= 2)), ' ') key_ from supplier_dedupe")
def n13(s: SparkSession, d: str) -> DataFrame:
    """Words of a name, sorted."""
    words = F.filter(F.split(S.fold(F.col("name")), " "), lambda w: F.length(w) >= 2)
    return table(s, d, "supplier_dedupe").select("supplier_id", F.array_join(F.array_sort(words), " ").alias("key_"))


@query("n14_register_check", """with n as (select supplier_id, unnest(numbers) raw from supplier_dedupe), k as (select supplier_id, raw, regexp_replace(raw, '[^0-9]', '', 'g') no from n)
select supplier_id, raw, length(no) = 10 and (6 * cast(substr(no, 1, 1) as int) + 5 * cast(substr(no, 2, 1) as int) + 7 * cast(substr(no, 3, 1) as int) + 2 * cast(substr(no, 4, 1) as int) + 3 * cast(substr(no, 5, 1) as int) + 4 * cast(substr(no, 6, 1) as int) + 5 * cast(substr(no, 7, 1) as int) + 6 * cast(substr(no, 8, 1) as int) + 7 * cast(substr(no, 9, 1) as int)) % 11 = cast(substr(no, 10, 1) as int) valid from k where length(no) = 10""")
def n14(s: SparkSession, d: str) -> DataFrame:
    """Check digits of ten-digit register numbers."""
    n = table(s, d, "supplier_dedupe").select("supplier_id", F.explode("numbers").alias("raw")).where(F.length(F.regexp_replace("raw", "[^0-9]", "")) == 10)
    return n.select("supplier_id", "raw", S.register_check_pl(F.col("raw")).alias("valid"))


@query("n15_fold", "select doc_id, md5(" + FOLD.format("text") + ") folded from documents")
def n15(s: SparkSession, d: str) -> DataFrame:
    """Search form of whole texts (as a hash)."""
    return table(s, d, "documents").select("doc_id", F.md5(S.fold(F.col("text"))).alias("folded"))


@query("n16_cpv_heads", f"with {CODES}, h as (select distinct id, substr(code, 1, n) head from line, (select unnest(range(2, 9)) n)) select id, array_to_string(list_sort(list(head)), ',') heads from h group by id")
def n16(s: SparkSession, d: str) -> DataFrame:
    """All prefixes of a notice's codes."""
    return codes(s, d).select("id", F.array_join(F.array_sort(S.cpv_heads(F.col("codes"))), ",").alias("heads"))


@query("n17_cpv_level", f"with {LINE}, c as (select distinct code, regexp_replace(code, '0+$', '') bare from line) select code, rpad(bare, cast(greatest(2, length(bare)) as integer), '0') as level from c")
def n17(s: SparkSession, d: str) -> DataFrame:
    """Codes without trailing zeros."""
    return lines(s, d).select("code").distinct().select("code", S.cpv_level(F.col("code")).alias("level"))


@query("n18_content_hash", f"with {OPP} select id, sha256(concat_ws(chr(31), cast(buyer as varchar), status, cast(published as varchar), priority)) hash_ from opp")
def n18(s: SparkSession, d: str) -> DataFrame:
    """Content hash of a record."""
    return opportunities(s, d).select("id", S.canonical_hash(F.col("buyer"), F.col("status"), F.col("published"), F.col("priority")).alias("hash_"))


@query("n19_slug", "select organisation_id, regexp_replace(regexp_replace(" + FOLD.format("canonical_name") + ", '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') slug from organisation")
def n19(s: SparkSession, d: str) -> DataFrame:
    """Slugs of names."""
    return table(s, d, "organisation").select("organisation_id", S.slug(F.col("canonical_name")).alias("slug"))


@query("n20_first_sentence", "select rec_id, regexp_extract(\"orderObject\", '^([^.;]+)', 1) as first_sentence from ezamowienia_status_cases where \"orderObject\" is not null")
def n20(s: SparkSession, d: str) -> DataFrame:
    """The first sentence of an order's object."""
    return table(s, d, "ezamowienia_status_cases").where("orderObject is not null").select("rec_id", F.regexp_extract("orderObject", "^([^.;]+)", 1).alias("first_sentence"))


@query("n22_round_trip", "select count(*) n, count(*) filter (props is not null) stated, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) total from events")
def n22(s: SparkSession, d: str) -> DataFrame:
    """Payloads to records and back without loss."""
    e = table(s, d, "events").select("props", F.from_json("props", "k bigint").alias("r"))
    back = F.from_json(F.to_json("r"), "k bigint")
    return e.select("props", back["k"].alias("k")).agg(F.count("*").alias("n"), F.count("props").alias("stated"), F.sum("k").alias("total"))


SIGNALS = "bool_or(substr(code, 1, 2) = '35') military, bool_or(substr(code, 1, 2) in ('34', '38', '48', '50', '51')) dual, count(distinct code) codes"


@query("f01_signals", f"with {LINE}, {OPP}, s as (select id, {SIGNALS} from line group by id) select id, military, dual, codes > 5 many, priority = '1-URGENT' urgent, case when military and priority = '1-URGENT' then 1.0 when military then 0.9 when dual then 0.45 else 0.1 end confidence from opp join s using (id)")
def f01(s: SparkSession, d: str) -> DataFrame:
    """Independent signals of a notice and a confidence ladder."""
    sig = _signals(s, d)
    j = opportunities(s, d).select("id", (F.col("priority") == "1-URGENT").alias("urgent")).join(sig, "id")
    ladder = F.when(F.expr("military and urgent"), 1.0).when(F.col("military"), 0.9).when(F.col("dual"), 0.45).otherwise(0.1)
    return j.select("id", "military", "dual", (F.col("codes") > 5).alias("many"), "urgent", ladder.alias("confidence"))


def _signals(s: SparkSession, d: str) -> DataFrame:
    head = F.substring("code", 1, 2)
    return lines(s, d).groupBy("id").agg(F.bool_or(head == "35").alias("military"), F.bool_or(head.isin("34", "38", "48", "50", "51")).alias("dual"), F.count_distinct("code").alias("codes"))


@query("f02_code_filter", f"with {CODES} select id, array_to_string(list_filter(codes, lambda c: c like '35%' and c not like '350%'), ',') kept from codes where len(list_filter(codes, lambda c: c like '35%' and c not like '350%')) > 0")
def f02(s: SparkSession, d: str) -> DataFrame:
    """The codes of a division less its exceptions."""
    kept = F.filter("codes", lambda c: c.startswith("35") & ~c.startswith("350"))
    return codes(s, d).select("id", kept.alias("k")).where("size(k) > 0").select("id", F.array_join("k", ",").alias("kept"))


@query("f05_scope_partition", f"with {LINE}, s as (select id, {SIGNALS} from line group by id) select case when military then 'core' when dual then 'supply' else 'none' end scope, count(*) n from s group by 1")
def f05(s: SparkSession, d: str) -> DataFrame:
    """Scopes partition all notices."""
    return _signals(s, d).groupBy(F.when(F.col("military"), "core").when(F.col("dual"), "supply").otherwise("none").alias("scope")).agg(F.count("*").alias("n"))


@query("f08_name_classes", """select organisation_id, case when lower(canonical_name) ~ '(naval|navy|marine)' then 'navy' when lower(canonical_name) ~ '(depot|depôt|dépôt|baza|base|składnica)' then 'depot' when lower(canonical_name) ~ '(wehr|defen|wojsk|mat[ée]riel|armed)' then 'defence' else 'other' end class from organisation""")
def f08(s: SparkSession, d: str) -> DataFrame:
    """Classes of buyers by ordered vocabularies."""
    name = F.lower(F.coalesce("canonical_name", F.lit("")))
    # Vocabulary by class, the first that matches counts.
    words = (("navy", "(naval|navy|marine)"), ("depot", "(depot|depôt|dépôt|baza|base|składnica)"), ("defence", "(wehr|defen|wojsk|mat[ée]riel|armed)"))
    out = F.lit("other")
    for label, pattern in reversed(words):
        out = F.when(name.rlike(pattern), label).otherwise(out)
    return table(s, d, "organisation").select("organisation_id", out.alias("class"))


@query("f09_mention", "select doc_id, lower(text) ~ '(subcontract|unterauftrag|sous-trait|podwykonaw)' mentions from documents where text is not null")
def f09(s: SparkSession, d: str) -> DataFrame:
    """Whether a text mentions subcontracting, in four languages."""
    return table(s, d, "documents").where("text is not null").select("doc_id", F.lower("text").rlike("(subcontract|unterauftrag|sous-trait|podwykonaw)").alias("mentions"))


@query("f13_filter_set", f"with {LINE}, {OPP} select id, buyer from opp where status in ('O', 'P') and amount between 50000 and 400000 and exists (select 1 from line where line.id = opp.id and (code like '34%' or code like '50%')) and not exists (select 1 from line where line.id = opp.id and code like '31%')")
def f13(s: SparkSession, d: str) -> DataFrame:
    """A composed filter: status, value range, code prefixes wanted and excluded."""
    c = lines(s, d)
    base = opportunities(s, d).where("status in ('O', 'P') and amount between 50000 and 400000")
    wanted = c.where("code like '34%' or code like '50%'").select("id")
    return base.join(wanted, "id", "left_semi").join(c.where("code like '31%'").select("id"), "id", "left_anti").select("id", "buyer")


@query("f16_withheld", "select organisation_id from organisation where organisation_id not in (select organisation_id from organisation where national_reg_no is null and vat_number is null)")
def f16(s: SparkSession, d: str) -> DataFrame:
    """Rows less a list of withheld ones."""
    o = table(s, d, "organisation").select("organisation_id", "national_reg_no", "vat_number")
    return o.join(o.where("national_reg_no is null and vat_number is null").select("organisation_id"), "organisation_id", "left_anti").select("organisation_id")


@query("f18_anomalies", f"with {OPP} select id, concat_ws(',', case when deadline - published > 50 then 'long' end, case when amount < 1000 then 'small' end, case when published > date '{AS_OF}' then 'later' end) flags from opp where deadline - published > 50 or amount < 1000 or published > date '{AS_OF}'")
def f18(s: SparkSession, d: str) -> DataFrame:
    """Odd notices with what is odd about them."""
    flags = F.concat_ws(",", F.when(F.datediff("deadline", "published") > 50, "long"), F.when(F.col("amount") < 1000, "small"), F.when(F.col("published") > F.lit(AS_OF).cast("date"), "later"))
    return opportunities(s, d).select("id", flags.alias("flags")).where("flags <> ''")


@query("x01_word_prefix", "with f as (select doc_id, " + FOLD.format("text") + " t from documents) select doc_id from f where t like '% delivery%' and t like '% contr%'")
def x01(s: SparkSession, d: str) -> DataFrame:
    """Texts in which both words begin a word."""
    return table(s, d, "documents").select("doc_id", S.fold(F.col("text")).alias("t")).where(S.all_words(F.col("t"), ["delivery", "contr"])).select("doc_id")


@query("x02_synonyms", "with f as (select doc_id, " + FOLD.format("text") + " t from documents) select doc_id from f where (t like '% tent%' or t like '% zelt%' or t like '% namiot%') and (t like '% radio%' or t like '% funk%')")
def x02(s: SparkSession, d: str) -> DataFrame:
    """Every slot is met by one of its words in some language."""
    slots = (("tent", "zelt", "namiot"), ("radio", "funk"))
    t = F.col("t")
    ok = F.lit(True)
    for slot in slots:
        ok = ok & t.rlike(" (" + "|".join(slot) + ")")
    return table(s, d, "documents").select("doc_id", S.fold(F.col("text")).alias("t")).where(ok).select("doc_id")


@query("x04_length_match", "with f as (select doc_id, " + FOLD.format("text") + " t from documents) select doc_id from f where concat(t, ' ') like '% van %' or t like '% camp%' or t like '%gener%'")
def x04(s: SparkSession, d: str) -> DataFrame:
    """Short words whole, words of four letters as beginnings, longer ones anywhere."""
    t = F.col("t")
    return table(s, d, "documents").select("doc_id", S.fold(F.col("text")).alias("t")).where(S.word_match(t, "van") | S.word_match(t, "camp") | S.word_match(t, "gener")).select("doc_id")


@query("x07_federated", """with p as (select p_partkey id, p_name name from part where lower(p_name) like '%ring%'), o as (select organisation_id id, canonical_name name from organisation where lower(canonical_name) like '%base%'), a as (select 'part' list, id, name from p union all select 'organisation', id, name from o),
r as (select *, row_number() over (partition by list order by length(name), name, id) k from a) select list, id, name from r where k <= 10""")
def x07(s: SparkSession, d: str) -> DataFrame:
    """One search over two lists, the shortest names first in each."""
    p = table(s, d, "part").where(F.lower("p_name").contains("ring")).select(F.lit("part").alias("list"), F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"))
    o = table(s, d, "organisation").where(F.lower("canonical_name").contains("base")).select(F.lit("organisation").alias("list"), F.col("organisation_id").alias("id"), F.col("canonical_name").alias("name"))
    return R.top_k(p.unionByName(o), ["list"], [F.length("name"), F.col("name"), F.col("id")], 10)


@query("x08_overlap", "with q as (select sample_id, list_distinct(list_filter(string_split(" + FOLD.format("text") + ", ' '), lambda w: length(w) > 7)) w from reading_samples) select a.sample_id a, b.sample_id b, cast(len(list_intersect(a.w, b.w)) as bigint) n from q a join q b on a.sample_id < b.sample_id where len(list_intersect(a.w, b.w)) >= 12")
def x08(s: SparkSession, d: str) -> DataFrame:
    """Samples that share twelve long words, by an inverted index."""
    w = table(s, d, "reading_samples").select("sample_id", F.explode(F.array_distinct(F.filter(F.split(S.fold(F.col("text")), " "), lambda x: F.length(x) > 7))).alias("w"))
    return R.neighbours(w, "sample_id", "w").where("member < partner and shared >= 12").select(F.col("member").alias("a"), F.col("partner").alias("b"), F.col("shared").alias("n"))


@query("x09_quote_found", "with q as (select organisation_id, " + FOLD.format("city") + " q from organisation where city is not null and length(city) >= 5), t as (select doc_id, " + FOLD.format("text") + " t from documents) select organisation_id, count(*) n from q join t on contains(concat(t, ' '), concat(q, ' ')) group by organisation_id")
def x09(s: SparkSession, d: str) -> DataFrame:
    """How many texts hold each quote as whole words: quotes of one word meet the texts' words by an equi-join."""
    q = table(s, d, "organisation").where("city is not null and length(city) >= 5").select("organisation_id", F.trim(S.fold(F.col("city"))).alias("w"))
    single = q.where("w not like '% %'")
    words = table(s, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.trim(S.fold(F.col("text"))), " "))).alias("w"))
    hits = words.join(single, "w").select("organisation_id", "doc_id")
    more = q.where("w like '% %'").withColumn("first", F.split("w", " ")[0])
    cand = words.join(more.select("organisation_id", F.col("w").alias("phrase"), F.col("first").alias("w")), "w")
    texts = table(s, d, "documents").select("doc_id", F.concat(S.fold(F.col("text")), F.lit(" ")).alias("t"))
    held = cand.join(texts, "doc_id").where(F.col("t").contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))).select("organisation_id", "doc_id")
    return hits.unionByName(held).distinct().groupBy("organisation_id").agg(F.count("*").alias("n"))


@query("d01_three_valued", """with r as (select organisation_id id, is_defence_buyer a, case when vat_number is null then null else vat_number like 'FR%' end b, national_reg_no is not null c from organisation) select id, a and b as both_, a or b as either_, not a as not_a, (a and b) or c as nested from r""")
def d01(s: SparkSession, d: str) -> DataFrame:
    """Three-valued logic over fields that may be unknown."""
    r = table(s, d, "organisation").select(F.col("organisation_id").alias("id"), F.col("is_defence_buyer").alias("a"), F.col("vat_number").startswith("FR").alias("b"), F.col("national_reg_no").isNotNull().alias("c"))
    return r.select("id", F.expr("a and b").alias("both_"), F.expr("a or b").alias("either_"), F.expr("not a").alias("not_a"), F.expr("(a and b) or c").alias("nested"))


@query("d04_longest_path", "with recursive e as (select s_suppkey id, s_suppkey // 2 before from supplier where s_suppkey > 0 union all select s_suppkey, s_suppkey // 3 from supplier where s_suppkey > 0 and s_suppkey % 3 = 0), walk(id, n) as (select s_suppkey, 0 from supplier where s_suppkey = 0 union select e.id, n + 1 from walk join e on e.before = walk.id) select id, cast(max(n) as bigint) as level from walk group by id")
def d04(s: SparkSession, d: str) -> DataFrame:
    """Levels of a graph of prerequisites: the longest way from a root."""
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"))
    some = sup.where("id > 0")
    edges = some.select("id", F.expr("id div 2").alias("before")).unionByName(some.where("id % 3 = 0").select("id", F.expr("id div 3").alias("before")))
    return R.longest_levels(edges, "id", "before", sup.where("id = 0"))


@query("d06_reconcile", "with f as (select user_id, event_type, value, row_number() over (partition by user_id order by case event_type when 'purchase' then 0 when 'click' then 1 else 2 end, ts desc, event_id desc) k from events) select user_id, event_type source, value from f where k = 1")
def d06(s: SparkSession, d: str) -> DataFrame:
    """One fact for each entity by the rank of its source, then the newest."""
    rank = F.expr("case event_type when 'purchase' then 0 when 'click' then 1 else 2 end")
    return R.distinct_on(table(s, d, "events"), ["user_id"], [rank, F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("event_type").alias("source"), "value")


@query("d07_readings", r"select doc_id, cast(len(regexp_extract_all(text, '[0-9]+ (?:euros?|Euro)')) as bigint) prices, regexp_extract(text, '([0-9]+) (?:euros?|Euro)', 1) as first_price from documents where text is not null")
def d07(s: SparkSession, d: str) -> DataFrame:
    """Fixed patterns read from texts: prices."""
    t = table(s, d, "documents").where("text is not null")
    return t.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("([0-9]+ (?:euros?|Euro))"), 1)).cast("long").alias("prices"), F.regexp_extract("text", "([0-9]+) (?:euros?|Euro)", 1).alias("first_price"))


@query("d11_freshness", "with m as (select max(ts) t from events) select event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen, max(ts) < (select t from m) - interval 10 minute stale from events group by event_type")
def d11(s: SparkSession, d: str) -> DataFrame:
    """The newest row of each source and whether it is late."""
    e = table(s, d, "events").groupBy("event_type").agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(e.agg(F.max("last").alias("t")))).select("event_type", F.substring(F.col("last").cast("string"), 1, 19).alias("last_seen"), F.expr("last < t - interval 10 minutes").alias("stale"))


@query("g01_first_delivery", 'select "objectId" object_id, min(rec_id) rec_id, count(*) n from ezamowienia_status_cases where "objectId" is not null group by 1')
def g01(s: SparkSession, d: str) -> DataFrame:
    """Overlapping deliveries, each object once with its first row."""
    return table(s, d, "ezamowienia_status_cases").where("objectId is not null").groupBy(F.col("objectId").alias("object_id")).agg(F.min("rec_id").alias("rec_id"), F.count("*").alias("n"))


@query("g02_late_policy", """with e as (select snap_id, tender_no, "retrievedAt" s, max("retrievedAt") over (partition by tender_no order by loaded_at, snap_id rows between unbounded preceding and 1 preceding) seen from lib) select snap_id, case when seen is null then 'new' when s < seen then 'stale' when s = seen then 'same' else 'newer' end outcome from e""")
def g02(s: SparkSession, d: str) -> DataFrame:
    """Each arrival against the newest stamp seen before it."""
    w = Window.partitionBy("tender_no").orderBy("loaded_at", "snap_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(s, d, "lib").select("snap_id", F.col("retrievedAt").alias("s"), F.max("retrievedAt").over(w).alias("seen"))
    return e.select("snap_id", F.when(F.col("seen").isNull(), "new").when(F.col("s") < F.col("seen"), "stale").when(F.col("s") == F.col("seen"), "same").otherwise("newer").alias("outcome"))


@query("g04_quarantine", """select case when json_valid(payload) then 'good' else 'bad' end kind, feed_kind, count(*) n from feed_records group by 1, 2""")
def g04(s: SparkSession, d: str) -> DataFrame:
    """Records that can be read, and those set aside."""
    good = F.try_parse_json("payload").isNotNull()
    return table(s, d, "feed_records").groupBy(F.when(good, "good").otherwise("bad").alias("kind"), "feed_kind").agg(F.count("*").alias("n"))


@query("g05_tumbling", "select strftime(date_trunc('day', ts), '%Y-%m-%d') day_, event_type, count(*) n, round(cast(sum(cast(value as decimal(18,2))) as double), 2) total from events group by 1, 2")
def g05(s: SparkSession, d: str) -> DataFrame:
    """Daily windows."""
    from tendril.streaming import windows

    return windows.tumbling(table(s, d, "events"), "1 day").select(F.substring(F.col("start").cast("string"), 1, 10).alias("day_"), "event_type", "n", "total")


@query("g06_sliding", "with e as (select date_trunc('day', ts) d, event_type from events), w as (select d - to_days(cast(k as int)) a, event_type from e, (select unnest(range(0, 14)) k)) select strftime(a, '%Y-%m-%d') start_, event_type, count(*) n from w group by 1, 2")
def g06(s: SparkSession, d: str) -> DataFrame:
    """Windows of 14 days, one begins each day."""
    from tendril.streaming import windows

    return windows.sliding(table(s, d, "events"), "14 days", "1 day").select(F.substring(F.col("start").cast("string"), 1, 10).alias("start_"), "event_type", "n")


@query("g_session", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start_, count(*) n from s group by user_id, k")
def g_session(s: SparkSession, d: str) -> DataFrame:
    """Sessions that a gap of 30 minutes ends."""
    from tendril.streaming import windows

    return windows.sessions(table(s, d, "events"), "30 minutes").select("user_id", F.substring(F.col("start").cast("string"), 1, 19).alias("start_"), "n")


@query("g08_split_windows", f"with {OPP}, m as (select date_trunc('month', published) m, count(*) n from opp group by 1), w as (select date_trunc('week', published) w, date_trunc('month', published) m, count(*) n from opp group by 1, 2) select 'month' kind, strftime(m, '%Y-%m-%d') as start_, n from m where n <= 190 union all select 'week', strftime(greatest(w, m), '%Y-%m-%d'), w.n from w join m using (m) where m.n > 190")
def g08(s: SparkSession, d: str) -> DataFrame:
    """Load windows: months, and weeks where a month holds too many."""
    o = opportunities(s, d).select(F.trunc("published", "month").alias("m"), F.trunc("published", "week").alias("w"))
    m = o.groupBy("m").agg(F.count("*").alias("n"))
    w = o.groupBy("w", "m").agg(F.count("*").alias("k")).join(m.where("n > 190"), "m")
    return m.where("n <= 190").select(F.lit("month").alias("kind"), F.col("m").cast("string").alias("start_"), "n").unionByName(w.select(F.lit("week").alias("kind"), F.greatest("w", "m").cast("string").alias("start_"), F.col("k").alias("n")))


@query("s02_json_in_text", """select rec_id, case when donnees like '{"OBJET": [%' then 'list' when donnees like '{"OBJET": {%' then 'object' when donnees like '{"EFORMS"%' then 'eforms' end shape, coalesce(json_extract_string(donnees, '$.OBJET.CPV.PRINCIPAL'), json_extract_string(donnees, '$.OBJET[0].CPV[0]'), json_extract_string(donnees, '$.EFORMS.lot[0].cpv')) cpv from boamp_notices""")
def s02(s: SparkSession, d: str) -> DataFrame:
    """Nested JSON in a text column, in its three shapes."""
    from tendril.sources.records import notice_body

    return notice_body(table(s, d, "boamp_notices"))


@query("s04_union_dedupe", """with a as (select "noticeNumber" no, rec_id from ezamowienia_status_cases where "tenderType" is not null union all select "noticeNumber", rec_id from ezamowienia_status_cases where outdated) select no, min(rec_id) rec_id from a where no is not null group by no""")
def s04(s: SparkSession, d: str) -> DataFrame:
    """Results of several searches together, each notice once."""
    e = table(s, d, "ezamowienia_status_cases").select(F.col("noticeNumber").alias("no"), "rec_id", "tenderType", "outdated")
    both = e.where("tenderType is not null").select("no", "rec_id").unionByName(e.where("outdated").select("no", "rec_id"))
    return both.where("no is not null").groupBy("no").agg(F.min("rec_id").alias("rec_id"))


@query("s06_list_and_detail", f"with {OPP}, dt as (select l_orderkey id, count(*) n, max(l_linenumber) lots from lineitem group by 1) select id, status, n, cast(lots as bigint) lots from opp left join dt using (id)")
def s06(s: SparkSession, d: str) -> DataFrame:
    """A list merged with its details."""
    detail = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.max("l_linenumber").cast("long").alias("lots"))
    return opportunities(s, d).select("id", "status").join(detail, "id", "left")
