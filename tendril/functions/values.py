"""What a record states in several ways, brought to one: values, periods, texts by language, natural persons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amounts up to the first say nothing; from the second on none is believed; from the third on one that the record's own
#: smaller figures contradict this many fold.
PLACEHOLDER, IMPLAUSIBLE, LARGE, FOLD = 1.0, 1e10, 1e9, 100.0
#: Months in a unit of duration, and the longest period in months.
UNITS, LONGEST = {"DAY": 1 / 30.4375, "WEEK": 7 / 30.4375, "MONTH": 1.0, "YEAR": 12.0}, 600.0


def in_language(block: Column, lang: str) -> Column:
    """The first text of a language in a JSON text that holds texts by language: as texts, lists of texts or wrapped
    values by key, or as a list of (lang, text) entries. Of a list the first that is not blank counts; blank texts are none."""
    path = f"$.{lang}"
    stated = F.get_json_object(block, path)
    several = F.from_json(F.when(F.substring(stated, 1, 1) == "[", stated), "array<string>")
    some = F.try_element_at(F.filter(several, lambda t: F.trim(t) != ""), F.lit(1))
    plain = F.when(several.isNotNull(), some).otherwise(F.coalesce(F.get_json_object(block, f"{path}.value"), stated))
    entries = F.from_json(F.when(F.substring(F.trim(block), 1, 1) == "[", block), "array<struct<lang:string,text:string>>")
    listed = F.try_element_at(F.filter(entries, lambda e: e["lang"] == lang), F.lit(1))["text"]
    return F.nullif(F.trim(F.when(F.substring(F.trim(block), 1, 1) == "[", listed).otherwise(plain)), F.lit(""))


def choose_value(result: Column, total: Column, awarded: Column, estimate: Column, lots: Column, currency: Column, lot_currencies: Column, n_lots: Column) -> Column:
    """Struct (amount, currency, kind) of the value that is the record's: for results the total, else the awarded value;
    then the estimate, the total, the sum of the lots if each states a value and all in one currency, the first lot's.
    Kind is total, estimated, lot_sum, first_lot, or without amount implausible or not_stated; null if nothing is stated.
    lots: array of amounts in the order of lots; lot_currencies: array; n_lots: how many lots there are."""
    real = F.filter(lots, lambda a: a > PLACEHOLDER)
    bound = F.least(*[F.coalesce(c, F.lit(float("inf"))) for c in (F.when(estimate > PLACEHOLDER, estimate), F.array_max(real) * F.greatest(F.coalesce(n_lots, F.lit(1)), F.size(real)))])
    wild = lambda a: (a >= IMPLAUSIBLE) | ((a >= LARGE) & (a > FOLD * bound) & (a != bound))
    fits = lambda a: (a > PLACEHOLDER) & ~wild(a)
    usable = F.filter(lots, lambda a: (a > PLACEHOLDER) & (a < IMPLAUSIBLE))
    sums = F.round(F.aggregate(usable, F.lit(0.0), lambda x, a: x + a), 2)
    kinds = F.array_distinct(F.transform(F.filter(lot_currencies, lambda c: c.isNotNull()), lambda c: F.upper(F.trim(c))))
    whole = (F.size(kinds) == 1) & (F.size(usable) == F.coalesce(n_lots, F.size(usable)))
    value = lambda a, c, k: F.struct(a.cast("double").alias("amount"), c.alias("currency"), F.lit(k).alias("kind"))
    none = F.lit(None)
    stated = F.array(total, awarded, estimate)
    every = F.concat(stated, lots)
    return (
        F.when(result & fits(total), value(total, currency, "total")).when(result & fits(awarded), value(awarded, currency, "total")).when(fits(estimate), value(estimate, currency, "estimated")).when(fits(total), value(total, currency, "total"))
        .when((F.size(usable) > 0) & whole & (sums < IMPLAUSIBLE), value(sums, F.try_element_at(kinds, F.lit(1)), "lot_sum"))
        .when((F.size(usable) > 0) & ~whole, value(F.try_element_at(usable, F.lit(1)), F.try_element_at(F.filter(lot_currencies, lambda c: c.isNotNull()), F.lit(1)), "first_lot"))
        .when(F.exists(F.filter(every, lambda a: a.isNotNull()), lambda a: a > PLACEHOLDER), value(none, none.cast("string"), "implausible"))
        .when(F.exists(every, lambda a: a.isNotNull()), value(none, none.cast("string"), "not_stated"))
    )


def contract_period(starts: Column, ends: Column, values: Column, units: Column, renewals: Column) -> Column:
    """Struct (start, end, duration, unit, renewals) over the lots: the earliest start, the latest end unless it lies
    before the start, the longest duration as stated (a broken one in whole months), the most renewals. A duration pairs
    with its unit by place if there are as many; one unit that all state holds for all."""
    known = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    clean = F.transform(units, lambda u: F.upper(F.trim(u)))
    paired = F.when(F.size(units) == F.size(values), F.arrays_zip(values.alias("v"), clean.alias("u"))).when(F.size(F.array_distinct(clean)) == 1, F.transform(values, lambda v: F.struct(v.alias("v"), clean[0].alias("u"))))
    months = F.transform(paired, lambda p: F.struct((p["v"] * F.try_element_at(known, p["u"])).alias("m"), p["v"].alias("v"), p["u"].alias("u")))
    longest = F.array_max(F.filter(months, lambda p: (p["v"] > 0) & (p["m"] <= LONGEST)))
    even = longest["v"] == F.floor(longest["v"])
    start, end = F.array_min(starts), F.array_max(ends)
    duration = F.when(even, longest["v"]).when(longest.isNotNull(), F.greatest(F.lit(1), F.round(longest["m"]))).cast("int")
    return F.struct(
        start.alias("start"), F.when(start.isNull() | (end >= start), end).alias("end"), duration.alias("duration"), F.when(even, longest["u"]).when(longest.isNotNull(), F.lit("MONTH")).alias("unit"),
        F.array_max(F.filter(renewals, lambda n: (n >= 0) & (n < 100))).cast("int").alias("renewals"),
    )


# Words that a company's or body's name holds, numbers that a natural person bears, and words that stand
# for persons.
CORPORATE = r"(?i)(^|[^\p{L}])(gmbh|ag|kg|sarl|sas|sa|slu|sl|srl|spa|bv|nv|ab|sro|as|spj|z o\.? ?o\.?|aktiengesellschaft|gesellschaft|aktiebolag|vennootschap|sp[oó][lł]ka|soci[eé]t[eé]|sociedad|limited|ltd|systems|instruments|group|holding|consortium|konsorcjum|g\.m\.b\.h\.?|s\.a\.?r?\.?l?\.?|s\.l\.?(u\.)?|s\.p\.a\.?|b\.v\.?|n\.v\.?)([^\p{L}]|$)"
PERSON_NUMBER = r"^(\d{8}[A-Z]|[XYZ]\d{7}[A-Z]|\*+.*)$"
MARKED = r"(?i)natural person|osoba fizyczna|personne physique|persona f[ií]sica"
TRADING = r"(?i)(^|\s)(p\.?h\.?u\.?|f\.?h\.?u\.?|p\.?p\.?h\.?u\.?|firma handlowa|us[lł]ugi|zak[lł]ad|ingenieurb[uü]ro|schreinerei|malerbetrieb|tischlerei|menuiserie|atelier|entreprise|talleres|suministros|reformas|construcciones)(\s|$)"
NAME_SHAPE = r"^\p{Lu}(\.|[\p{Ll}'-]+)([ -]\p{Lu}(\.|[\p{Ll}'-]+)){1,3}$"


def person_reason(name: Column, number: Column) -> Column:
    """Why a winner is taken for a natural person: person_marked, person_identifier, person_in_trading_name or
    person_name; null for anybody else. A corporate word in the name outweighs a person's number and the name's shape."""
    bare, corporate = F.trim(F.coalesce(name, F.lit(""))), F.coalesce(name, F.lit("")).rlike(CORPORATE)
    digits = F.regexp_replace(F.upper(F.coalesce(number, F.lit(""))), r"[\s.\-/]", "")
    return F.when((bare == "") | bare.rlike(MARKED), "person_marked").when(digits.rlike(PERSON_NUMBER) & ~corporate, "person_identifier").when(corporate, None).when(bare.rlike(TRADING), "person_in_trading_name").when(bare.rlike(NAME_SHAPE), "person_name")
