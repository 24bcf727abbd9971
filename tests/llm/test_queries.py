"""Whole results of the named queries of this subpackage."""

import os
import random

import pytest

from tendril.llm import catalog, matching, pii
from tendril.llm.company_names import Names

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_p5_masked_covers_both_tables(spark):
    """Every row of both tables, with the placeholders at the places that p5_found gives."""
    queries = catalog.load()[0]
    texts = {}
    for tbl, row_id, col in (("ezamowienia_status_cases", "rec_id", "orderObject"), ("supplier_dedupe", "supplier_id", "name")):
        texts |= {(tbl, r[0]): r[1] for r in spark.read.parquet(f"{SF}/{tbl}.parquet").select(row_id, col).collect()}
    spans = {}
    for r in queries["p5_found"](spark, SF).collect():
        spans.setdefault((r.tbl, r.rec_id), []).append((r.start_at, r.end_at, r.kind))
    want = sorted((k, None if t is None else pii.masked(t, sorted(spans.get(k, [])))) for k, t in texts.items())
    rows = queries["p5_masked"](spark, SF).collect()
    assert sorted(((r.tbl, r.rec_id), r.text) for r in rows) == want
    assert {k[0] for k, t in want if t and t != texts[k]} == {"ezamowienia_status_cases", "supplier_dedupe"}


def test_p1_number_with_many_spellings_keeps_its_rows(spark):
    """A number of one company with more than MOST_NAMES spellings still links a name beyond the radius; one stated by
    as many companies links none of them."""
    r = random.Random(7)
    name = "Verbastulin Okramedu"
    spellings = {name}
    while len(spellings) < matching.MOST_NAMES + 40:
        k = r.choice([i for i, c in enumerate(name) if c.islower()])
        spellings.add(name[:k] + r.choice("bdfgjkmpvz") + name[k + 1 :])
    far = "Verxostulyn Okwamadu"
    parse = Names(frozenset()).parse
    bits = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(matching.name_vector(parse(a)[0]), matching.name_vector(parse(b)[0]), strict=True))
    assert min(bits(far, s) for s in spellings) > matching.RADIUS
    rows = [(i, s, ["112233441"], "FR", None) for i, s in enumerate([*sorted(spellings), far])]
    others = {"".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(6)).title() for _ in range(2 * matching.MOST_NAMES)}
    rows += [(1000 + i, s, ["556677889"], "FR", None) for i, s in enumerate(sorted(others))]
    df = spark.createDataFrame(rows, "sid long, name string, numbers array<string>, country string, city string")
    scored, groups, member = matching.matches(df, "sid", "name", "numbers", "country", "city")
    n = len(spellings) + 1
    assert {(x.id_a, x.id_b) for x in matching.pairs_of_groups(groups, member).collect()} == {(i, j) for i in range(n) for j in range(i + 1, n)}
    assert scored.where("p >= 1000").count() < len(others)  # not all pairs of them were compared


def test_p1_all_spellings_of_a_usual_number_meet(spark):
    """Two spellings that are each like one another, but neither close by bits nor like the most usual ones of their
    number, are found whether it has a hundred spellings of few companies or of more than MOST_NAMES."""
    r = random.Random(11)
    made = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(6)).title()
    parse = Names(frozenset()).parse
    vector = lambda n: sum((b & (2**64 - 1)) << 64 * k for k, b in enumerate(matching.name_vector(parse(n)[0])))
    like = lambda a, b: 2 * (vector(a) & vector(b)).bit_count() / (vector(a).bit_count() + vector(b).bit_count())
    pair = ("Verbastulin Okramedu Silfanore", "Verbastulin Okramydu Silfanyre")
    assert (vector(pair[0]) ^ vector(pair[1])).bit_count() > matching.RADIUS and like(*pair) >= matching.OWN_NAME
    unlike = lambda n: max(like(p, n) for p in pair) < matching.LEAST_NAME
    others = sorted(filter(unlike, {made() for _ in range(3 * matching.MOST_NAMES)}))[: 2 * matching.MOST_NAMES]
    slips = sorted(n for n in {"Gadokibure"[:k] + a + b + "Gadokibure"[k + 1 :] for k in range(1, 10) for a in "bdfgk" for b in "aeo"} if unlike(n))[: matching.MOST_NAMES + 20]
    assert len(others) > matching.MOST_NAMES + 30 and len(slips) > matching.MOST_NAMES
    rows = [(i, n, ["112233441"], "FR", None) for i, n in enumerate([*others, *pair])]
    rows += [(1000 + i, n, ["556677889"], "SE", None) for i, n in enumerate([*slips, *pair])]
    df = spark.createDataFrame(rows, "sid long, name string, numbers array<string>, country string, city string")
    scored, _, _ = matching.matches(df, "sid", "name", "numbers", "country", "city")
    got = {(x.p, x.q) for x in scored.where("confidence >= 0.5").collect()}
    assert {(len(others), len(others) + 1), (1000 + len(slips), 1001 + len(slips))} <= got
    assert not [x for x in got if x[0] < len(others)]
