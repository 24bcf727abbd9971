"""Records in one form, values and periods, persons, families, attribution of changes, feed progress (N, F, R, T, X, L, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendril.catalog import query
from tendril.functions import scalar as S
from tendril.functions import values as V
from tendril.operators import relational as R
from tendril.plans.texts import FOLD
from tendril.plans.views import LINE, OPP, lines, opportunities
from tendril.session import table

_TITLE = """payload->'$."notice-title"'"""


def _sql_language(block: str, lang: str) -> str:
    return f"""nullif(trim(case when json_type({block}) = 'ARRAY' then list_filter(from_json({block}, '[{{"lang":"VARCHAR","text":"VARCHAR"}}]'), lambda e: e.lang = '{lang}')[1].text
      when json_type({block}->'$.{lang}') = 'OBJECT' then {block}->>'$.{lang}.value' when json_type({block}->'$.{lang}') = 'ARRAY' then list_filter(cast({block}->'$.{lang}' as varchar[]), lambda t: trim(t) <> '')[1] else {block}->>'$.{lang}' end), '')"""


@query(
    "n01_ted_record",
    f"""select rec_id, coalesce(nullif(trim("publication-number"), ''), payload->>'$."publication-number"') native_id, {_sql_language(_TITLE, 'eng')} title_en,
      coalesce("notice-type", payload->>'$."notice-type"') kind, cast(try_cast(substr(payload->>'$."dispatch-date"', 1, 10) as date) as varchar) dispatched,
      cast(case when json_type(payload->'$.lots') = 'ARRAY' then json_array_length(payload->'$.lots') when json_type(payload->'$.lots') = 'OBJECT' then len(json_keys(payload->'$.lots')) else 0 end as bigint) lots,
      case when try_cast(payload->>'$."total-value"' as double) > 1 then try_cast(payload->>'$."total-value"' as double) end amount, upper(substr(payload->>'$."total-value-cur"[0]', 1, 3)) currency, payload->>'$."legal-basis"[0]' legal_basis
    from ted_live_notices_2026_10""",
)
def n01_ted(s: SparkSession, d: str) -> DataFrame:
    """Notices of the European journal as records; the fields' several JSON shapes are one."""
    raw = table(s, d, "ted_live_notices_2026_10")
    fields = ("publication-number", "notice-type", "notice-title", "dispatch-date", "lots", "total-value", "total-value-cur", "legal-basis")
    r = raw.select("rec_id", "publication-number", "notice-type", F.from_json("payload", ", ".join(f"`{f}` string" for f in fields)).alias("r"))
    at = lambda f: F.col(f"r.`{f}`")
    amount = at("total-value").try_cast("double")
    lots = F.when(F.substring(at("lots"), 1, 1) == "[", F.json_array_length(at("lots"))).when(F.substring(at("lots"), 1, 1) == "{", F.size(F.json_object_keys(at("lots")))).otherwise(0)
    return r.select(
        "rec_id", F.coalesce(F.nullif(F.trim("publication-number"), F.lit("")), at("publication-number")).alias("native_id"), V.in_language(at("notice-title"), "eng").alias("title_en"), F.coalesce("notice-type", at("notice-type")).alias("kind"),
        F.substring(at("dispatch-date"), 1, 10).try_cast("date").cast("string").alias("dispatched"), lots.cast("long").alias("lots"), F.when(amount > V.PLACEHOLDER, amount).alias("amount"),
        F.upper(F.substring(F.get_json_object(at("total-value-cur"), "$[0]"), 1, 3)).alias("currency"), F.get_json_object(at("legal-basis"), "$[0]").alias("legal_basis"),
    )


@query(
    "n01_boamp_record",
    """select rec_id, coalesce(nullif(trim(idweb), ''), id) native_id, trim(objet) title, coalesce(nullif(trim(nomacheteur), ''), 'UNKNOWN') buyer, cast(try_cast(substr(trim(dateparution), 1, 10) as date) as varchar) published,
      upper(trim(nature)) kind, coalesce(donnees->>'$.OBJET.CPV.PRINCIPAL', donnees->>'$.OBJET[0].CPV[0]', donnees->>'$.EFORMS.lot[0].cpv') cpv, coalesce(annonce_lie[1], '') related from boamp_notices""",
)
def n01_boamp(s: SparkSession, d: str) -> DataFrame:
    """French notices as records; the body's shape depends on its schema."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    cpv = F.coalesce(*[F.get_json_object("donnees", p) for p in ("$.OBJET.CPV.PRINCIPAL", "$.OBJET[0].CPV[0]", "$.EFORMS.lot[0].cpv")])
    return table(s, d, "boamp_notices").select(
        "rec_id", F.coalesce(blank("idweb"), "id").alias("native_id"), F.trim("objet").alias("title"), F.coalesce(blank("nomacheteur"), F.lit("UNKNOWN")).alias("buyer"), F.substring(F.trim("dateparution"), 1, 10).try_cast("date").cast("string").alias("published"),
        F.upper(F.trim("nature")).alias("kind"), cpv.alias("cpv"), F.coalesce(F.try_element_at("annonce_lie", F.lit(1)), F.lit("")).alias("related"),
    )


@query(
    "n01_ezam_record",
    """select "objectId" native_id, arg_max(trim("orderObject"), (loaded_at, rec_id)) title, coalesce(arg_max(nullif(trim("organizationName"), ''), (loaded_at, rec_id)), 'UNKNOWN') buyer,
      arg_max(regexp_replace("organizationNationalId", '[^0-9]', '', 'g'), (loaded_at, rec_id)) register, count(*) deliveries, max(lower(trim("orderType"))) kind
    from ezamowienia_status_cases where "objectId" is not null group by 1""",
)
def n01_ezam(s: SparkSession, d: str) -> DataFrame:
    """Notices of the Polish board as records, each once: of several deliveries the last that states a field."""
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct("loaded_at", "rec_id")))
    rows = table(s, d, "ezamowienia_status_cases").where("objectId is not null")
    return rows.groupBy(F.col("objectId").alias("native_id")).agg(
        last(F.trim("orderObject")).alias("title"), F.coalesce(last(F.nullif(F.trim("organizationName"), F.lit(""))), F.lit("UNKNOWN")).alias("buyer"), last(F.regexp_replace("organizationNationalId", "[^0-9]", "")).alias("register"),
        F.count("*").alias("deliveries"), F.max(F.lower(F.trim("orderType"))).alias("kind"),
    )


@query(
    "n06_value_choice",
    f"""with {LINE}, {OPP}, lot as (select id, list(cast(amount as double) order by nr, amount, kind) amounts, list(distinct kind) kinds, arg_min(kind, (nr, amount, kind)) first_kind, count(*) n, sum(cast(amount as decimal(18,2))) total from line group by id)
    select id, case when status = 'F' then amount when len(kinds) = 1 then round(cast(total as double), 2) else amounts[1] end amount,
      case when status = 'F' then 'EUR' when len(kinds) = 1 then kinds[1] else first_kind end currency, case when status = 'F' then 'total' when len(kinds) = 1 then 'lot_sum' else 'first_lot' end kind
    from opp join lot using (id)""",
)
def n06(s: SparkSession, d: str) -> DataFrame:
    """Which of several stated values is the notice's: only results state a total, a lot's flag stands for its currency."""
    lot = F.array_sort(F.collect_list(F.struct("nr", F.col("amount").cast("double").alias("a"), "kind")))
    lots = lines(s, d).groupBy("id").agg(lot.alias("lots"))
    none = F.lit(None).cast("double")
    total = F.when(F.col("status") == "F", F.col("amount"))
    chosen = V.choose_value(F.col("status") == "F", total, none, none, F.transform("lots", lambda x: x["a"]), F.lit("EUR"), F.transform("lots", lambda x: x["kind"]), F.size("lots"))
    return opportunities(s, d).join(lots, "id").select("id", chosen.alias("v")).select("id", "v.*")


@query(
    "n10_contract_period",
    f"""with {LINE}, lot as (select id, shipped, cast(shipped as date) + cast(quantity as integer) ended, quantity, case state when 'F' then 'MONTH' else 'DAY' end unit, nr from line)
    select id, cast(min(shipped) as varchar) starts, cast(max(ended) as varchar) ends, cast(arg_max(quantity, (case unit when 'MONTH' then quantity * cast(1.0 as double) else quantity * (1 / cast(30.4375 as double)) end, quantity)) as integer) duration,
      arg_max(unit, (case unit when 'MONTH' then quantity * cast(1.0 as double) else quantity * (1 / cast(30.4375 as double)) end, quantity)) unit, cast(max(nr) as integer) renewals from lot group by id""",
)
def n10(s: SparkSession, d: str) -> DataFrame:
    """The contract period over the lots: earliest start, latest end, longest duration in its own unit, most renewals."""
    lot = lines(s, d).select("id", "shipped", F.date_add("shipped", F.col("quantity").cast("int")).alias("ended"), F.col("quantity").cast("double").alias("q"), F.when(F.col("state") == "F", "MONTH").otherwise("DAY").alias("unit"), "nr")
    lots = lot.groupBy("id").agg(F.collect_list(F.struct("shipped", "ended", "q", "unit", "nr")).alias("l"))
    each = lambda f: F.transform("l", lambda x: x[f])
    period = V.contract_period(each("shipped"), each("ended"), each("q"), each("unit"), each("nr"))
    return lots.select("id", period.alias("p")).select("id", F.col("p.start").cast("string").alias("starts"), F.col("p.end").cast("string").alias("ends"), "p.duration", "p.unit", "p.renewals")


# Words that a sentence of purpose holds, and words that show it is about something else.
_KEEP, _DROP = "objective|purpose|support|develop|provide|requirement|supply|delivery", "deadline|eligib|applicant|submit|budget"


@query(
    "n21_purpose_sentences",
    f"""with s as (select doc_id, trim(unnest(string_split_regex(text, '[.!?]+(\\s+|$)'))) sentence from documents where text is not null)
    select doc_id, count(*) n, count(*) filter (regexp_matches(lower(sentence), '{_KEEP}') and not regexp_matches(lower(sentence), '{_DROP}')) kept from s where regexp_matches(sentence, '[a-zA-Z]') group by doc_id""",
)
def n21(s: SparkSession, d: str) -> DataFrame:
    """Sentences of a text, and those that tell its purpose; a sentence that is not known to do so is dropped."""
    parts = F.filter(F.split("text", r"[.!?]+(\s+|$)"), lambda x: x.rlike("[a-zA-Z]"))
    kept = F.filter("p", lambda x: F.lower(x).rlike(_KEEP) & ~F.lower(x).rlike(_DROP))
    rows = table(s, d, "documents").where("text is not null").select("doc_id", parts.alias("p")).where("size(p) > 0")
    return rows.select("doc_id", F.size("p").cast("long").alias("n"), F.size(kept).cast("long").alias("kept"))


@query(
    "f11_superseded",
    """select rec_id, exists (select 1 from boamp_notices x where list_contains(x.annonce_lie, b.idweb) and x.rec_id <> b.rec_id) rectified,
      exists (select 1 from boamp_notices x where x.idweb = b.idweb and x.rec_id <> b.rec_id and upper(trim(x.nature)) = 'ATTRIBUTION' and try_cast(substr(x.dateparution, 1, 10) as date) >= try_cast(substr(b.dateparution, 1, 10) as date)) awarded,
      exists (select 1 from ted_live_notices_2026_10 t where t.buyer_id = b.buyer_id and try_cast(substr(t."publication-date", 1, 10) as date) = try_cast(substr(b.dateparution, 1, 10) as date) and t."notice-type" = 'can-standard') twin_finished
    from boamp_notices b""",
)
def f11(s: SparkSession, d: str) -> DataFrame:
    """Whether another notice takes a notice's place: one that corrects it, an award of the same number that is as late, a
    finished twin on the other board. Three look-ups by key, none of which multiplies rows."""
    day = lambda c: F.substring(c, 1, 10).try_cast("date")
    b = table(s, d, "boamp_notices").select("rec_id", "idweb", "buyer_id", day("dateparution").alias("day"), "annonce_lie", F.upper(F.trim("nature")).alias("kind"))
    # of the rows that name a number, the least and the greatest tell whether one is another row
    named = b.select("rec_id", F.explode(F.array_distinct("annonce_lie")).alias("idweb")).groupBy("idweb").agg(F.min("rec_id").alias("low"), F.max("rec_id").alias("high"))
    # of the awards of a number, the two latest
    awards = b.where("kind = 'ATTRIBUTION' and day is not null and idweb is not null")
    latest = R.top_k(awards, ["idweb"], [F.desc("day"), "rec_id"], 2).groupBy("idweb").agg(F.collect_list(F.struct("rec_id", "day")).alias("latest"))
    ted = table(s, d, "ted_live_notices_2026_10").where(F.col("notice-type") == "can-standard").select("buyer_id", day("publication-date").alias("day"), F.lit(True).alias("twin")).dropna().distinct()
    out = b.join(named, "idweb", "left").join(latest, "idweb", "left").join(ted, ["buyer_id", "day"], "left")
    other = F.exists("latest", lambda x: (x["rec_id"] != F.col("rec_id")) & (x["day"] >= F.col("day")))
    false = F.lit(False)
    return out.select("rec_id", F.coalesce((F.col("low") != F.col("rec_id")) | (F.col("high") != F.col("rec_id")), false).alias("rectified"), F.coalesce(other, false).alias("awarded"), F.coalesce("twin", false).alias("twin_finished"))


@query(
    "f14_funding_filters",
    """select p_partkey id, regexp_matches(p_name, '^[a-m]') chip, p_size between 10 and 30 as size_fits, contains(p_type, 'STEEL') regime, p_retailprice >= 1000 who, p_brand like '%3%' brand
    from part where regexp_matches(p_name, '^[a-m]') or p_size between 10 and 30 or contains(p_type, 'STEEL')""",
)
def f14(s: SparkSession, d: str) -> DataFrame:
    """A set of filters beside one another, with what each says; those on columns reach the scan."""
    chip, size, regime = F.col("p_name").rlike("^[a-m]"), F.col("p_size").between(10, 30), F.col("p_type").contains("STEEL")
    return table(s, d, "part").where(chip | size | regime).select(F.col("p_partkey").alias("id"), chip.alias("chip"), size.alias("size_fits"), regime.alias("regime"), (F.col("p_retailprice") >= 1000).alias("who"), F.col("p_brand").like("%3%").alias("brand"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(
    "f17_natural_persons",
    f"""with w as (select supplier_id, trim(coalesce(name, '')) n, regexp_matches(coalesce(name, ''), '{_re2(V.CORPORATE)}') corporate, regexp_replace(upper(coalesce(numbers[1], '')), '[\\s.\\-/]', '', 'g') num from supplier_dedupe)
    select supplier_id, case when n = '' or regexp_matches(n, '{_re2(V.MARKED)}') then 'person_marked' when regexp_matches(num, '{_re2(V.PERSON_NUMBER)}') and not corporate then 'person_identifier' when corporate then null
      when regexp_matches(n, '{_re2(V.TRADING)}') then 'person_in_trading_name' when regexp_matches(n, '{_re2(V.NAME_SHAPE)}') then 'person_name' end reason from w""",
)
def f17(s: SparkSession, d: str) -> DataFrame:
    """Winners that are natural persons, and why."""
    return table(s, d, "supplier_dedupe").select("supplier_id", V.person_reason(F.col("name"), F.try_element_at("numbers", F.lit(1))).alias("reason"))


@query(
    "l02_funding_order",
    f"with {OPP} select id, row_number() over (order by case when priority = '1-URGENT' then 0 else 1 end, case when status = 'F' then 1 else 0 end, case when deadline < date '1995-01-01' then 1 else 0 end, deadline, id) - 1 as place from opp",
)
def l02(s: SparkSession, d: str) -> DataFrame:
    """Urgent first, closed last, past the cut-off last, then by deadline: every row with its place."""
    o = opportunities(s, d)
    order = [F.when(F.col("priority") == "1-URGENT", 0).otherwise(1), F.when(F.col("status") == "F", 1).otherwise(0), F.when(F.col("deadline") < F.lit("1995-01-01").cast("date"), 1).otherwise(0), F.col("deadline"), F.col("id")]
    keyed = o.select("id", *[c.alias(f"k{i}") for i, c in enumerate(order)])
    ranked = R.ranked(keyed, [F.col(f"k{i}") for i in range(len(order))])
    return ranked.select("id", (F.col("place") - 1).cast("long").alias("place"))


# Words in names, and the group that a company with such a word belongs to.
_GROUPS = {"optronics|instruments": "precision", "hydraulik|mechanika|armatur": "machines", "textil|polymer": "materials", "marine|aero": "vehicles"}


@query("r10_company_groups", " union all ".join(f"select '{g}' as parent, country, count(*) members, min(supplier_id) first_member from supplier_dedupe where regexp_matches(lower(name), '{p}') group by country" for p, g in _GROUPS.items()))
def r10(s: SparkSession, d: str) -> DataFrame:
    """Companies under curated parents: one reading of the names, a row for each parent that a name belongs to."""
    parents = F.array_compact(F.array(*[F.when(F.lower("name").rlike(p), F.lit(g)) for p, g in _GROUPS.items()]))
    rows = table(s, d, "supplier_dedupe").select("supplier_id", "country", F.explode(parents).alias("parent"))
    return rows.groupBy("parent", "country").agg(F.count("*").alias("members"), F.min("supplier_id").alias("first_member"))


@query("r07_org_families")
def r07(s: SparkSession, d: str) -> DataFrame:
    """Stars of organisations that review pairs hold together: pairs of low confidence or that are rejected are no pairs,
    and the row with the most pairs heads its free neighbours. No SQL: rows are taken in turn, each by what was taken
    before; tests hold it against that."""
    from tendril.operators import families

    links = table(s, d, "accept_merge_candidates").where("status <> 'rejected' and confidence >= 0.85 and candidate <> head")
    pairs = links.select(F.least("candidate", "head").alias("a"), F.greatest("candidate", "head").alias("b")).distinct()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("org")).groupBy("org").agg((-F.count("*")).alias("rank"))
    return families.stars(pairs, "a", "b", ends, "org", "rank")


# Tax rates, by which a value moves when it is read with tax and then without.
_RATES = (1.21, 1.10, 1.07, 1.04, 1.03)
_VERSIONS = """v as (select snap_id, tender_no, title, status, try_cast(value_amount as double) amount, lag(snap_id) over w prev, lag(title) over w t0, lag(status) over w s0, lag(try_cast(value_amount as double)) over w a0 from lib window w as (partition by tender_no order by "retrievedAt", snap_id))"""
_CHANGED = "title is distinct from t0 and title is not null and t0 is not null"


@query(
    "t04_change_attribution",
    f"""with {_VERSIONS}, c as (select snap_id, tender_no, coalesce(title <> t0, false) ct, coalesce(status <> s0, false) cs, coalesce(amount <> a0, false) ca,
      coalesce({' or '.join(f'abs(a0 / nullif(amount, 0) - {r}) < 0.005' for r in _RATES)}, false) ratio from v where prev is not null)
    select snap_id, tender_no, case when ca and ratio and not ct and not cs then 'remapped' when ca and ratio then 'remapped_fields' else 'publisher' end kind, cast(ct as integer) + cast(cs as integer) + cast(ca as integer) n from c where ct or cs or ca""",
)
def t04(s: SparkSession, d: str) -> DataFrame:
    """Whose change a version is: a value that moved by a tax rate alone is another reading, beside real changes it is
    noted for its field only, all else is the publisher's."""
    w = Window.partitionBy("tender_no").orderBy("retrievedAt", "snap_id")
    v = table(s, d, "lib").select("snap_id", "tender_no", "title", "status", F.col("value_amount").try_cast("double").alias("amount"), F.lag("snap_id").over(w).alias("prev"), F.lag("title").over(w).alias("t0"), F.lag("status").over(w).alias("s0"), F.lag(F.col("value_amount").try_cast("double")).over(w).alias("a0"))
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    ratio = F.lit(False)
    for r in _RATES:
        ratio |= F.abs(F.try_divide("a0", "amount") - r) < 0.005
    c = v.where("prev is not null").select("snap_id", "tender_no", differs("title", "t0").alias("ct"), differs("status", "s0").alias("cs"), differs("amount", "a0").alias("ca"), F.coalesce(ratio, F.lit(False)).alias("ratio")).where("ct or cs or ca")
    kind = F.when(F.expr("ca and ratio and not ct and not cs"), "remapped").when(F.expr("ca and ratio"), "remapped_fields").otherwise("publisher")
    return c.select("snap_id", "tender_no", kind.alias("kind"), F.expr("int(ct) + int(cs) + int(ca)").alias("n"))


@query(
    "t13_annotations",
    f"""with {_VERSIONS}, note as (select snap_id, 'value' kind, 0 as from_run from v where amount <> a0 union all select snap_id, 'title', 0 from v where title <> t0 union all select snap_id, 'value', 1 from v where amount is distinct from a0 and prev is not null)
    select snap_id, kind, min(from_run) from_run from note group by snap_id, kind""",
)
def t13(s: SparkSession, d: str) -> DataFrame:
    """Notes beside versions, one for each version and kind: what a second run would note again is there already."""
    w = Window.partitionBy("tender_no").orderBy("retrievedAt", "snap_id")
    amount = F.col("value_amount").try_cast("double")
    v = table(s, d, "lib").select("snap_id", "title", amount.alias("amount"), F.lag("snap_id").over(w).alias("prev"), F.lag("title").over(w).alias("t0"), F.lag(amount).over(w).alias("a0"))
    held = F.array_compact(F.array(F.when(F.col("amount") != F.col("a0"), F.lit("value")), F.when(F.col("title") != F.col("t0"), F.lit("title"))))
    again = F.col("prev").isNotNull() & ~F.col("amount").eqNullSafe(F.col("a0"))
    more = F.when(again & ~F.array_contains(held, "value"), F.array(F.lit("value"))).otherwise(F.array().cast("array<string>"))
    notes = F.concat(F.transform(held, lambda k: F.struct(k.alias("kind"), F.lit(0).alias("from_run"))), F.transform(more, lambda k: F.struct(k.alias("kind"), F.lit(1).alias("from_run"))))
    return v.select("snap_id", F.explode(notes).alias("n")).select("snap_id", "n.kind", "n.from_run")


_INITIALS = f"list_aggregate(list_transform(string_split(trim({FOLD.format('canonical_name')}), ' '), lambda w: w[1]), 'string_agg', '')"


@query(
    "x05_abbreviations",
    f"""with o as (select organisation_id, canonical_name, {_INITIALS} abbr from organisation where canonical_name is not null)
    select abbr, count(distinct canonical_name) names, count(t.rec_id) notices from o left join ted_live_notices_2026_10 t on t.buyer_id = o.organisation_id where length(abbr) >= 2 group by abbr""",
)
def x05(s: SparkSession, d: str) -> DataFrame:
    """Abbreviations of buyers, made of their words' initials, the names they stand for and the notices that a search by
    them finds. Notices are counted by buyer before names come in."""
    words = F.split(F.trim(S.fold(F.col("canonical_name"))), " ")
    orgs = table(s, d, "organisation").where("canonical_name is not null").select("organisation_id", "canonical_name", F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "").alias("abbr"))
    counts = table(s, d, "ted_live_notices_2026_10").groupBy(F.col("buyer_id").alias("organisation_id")).agg(F.count("*").alias("n"))
    return orgs.where("length(abbr) >= 2").join(counts, "organisation_id", "left").groupBy("abbr").agg(F.count_distinct("canonical_name").alias("names"), F.coalesce(F.sum("n"), F.lit(0)).alias("notices"))


@query(
    "g03_feed_progress",
    """with f as (select feed, file_name, max(file_date) file_date, count(*) n, max(loaded_at) loaded from feed_records where file_date is not null group by feed, file_name),
      mark as (select feed, max(file_date) mark from f where loaded <= (select min(loaded_at) + (max(loaded_at) - min(loaded_at)) / 2 from feed_records) group by feed)
    select f.feed, count(*) filter (mark is null or file_date > mark) files, cast(coalesce(sum(n) filter (mark is null or file_date > mark), 0) as bigint) records, max(file_date) as new_mark from f left join mark on mark.feed = f.feed group by f.feed""",
)
def g03(s: SparkSession, d: str) -> DataFrame:
    """What a walk of each feed has still to read: files newer than the mark that the former walk left (here at half of
    the time of loading), and the mark it leaves. A feed without a mark is read whole."""
    rows = table(s, d, "feed_records").where("file_date is not null")
    half = table(s, d, "feed_records").agg((F.min("loaded_at") + (F.max("loaded_at") - F.min("loaded_at")) / 2).alias("half"))
    files = rows.groupBy("feed", "file_name").agg(F.max("file_date").alias("file_date"), F.count("*").alias("n"), F.max("loaded_at").alias("loaded"))
    files = files.join(F.broadcast(half))  # one row
    feeds = files.withColumn("mark", F.max(F.when(F.col("loaded") <= F.col("half"), F.col("file_date"))).over(Window.partitionBy("feed")))
    open_ = F.col("mark").isNull() | (F.col("file_date") > F.col("mark"))
    return feeds.groupBy("feed").agg(F.count_if(open_).alias("files"), F.coalesce(F.sum(F.when(open_, F.col("n"))), F.lit(0)).cast("long").alias("records"), F.max("file_date").alias("new_mark"))
